"""Visible text of HTML, by a real parser: every named and numeric reference is decoded."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed lists: elements whose content is not text, and those that begin a line.
IGNORED = ("script", "style", "head")
VOID = ("meta", "link")
BLOCKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")

OPEN, CLOSE, TEXT = 1, -1, 0


class _Events(HTMLParser):
    """What the parser meets, in order; a tag that closes itself is an opening and a closing one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.met: list[tuple[int, str]] = []

    def handle_starttag(self, tag, attrs):
        self.met.append((OPEN, tag))

    def handle_endtag(self, tag):
        self.met.append((CLOSE, tag))

    def handle_data(self, data):
        self.met.append((TEXT, data))


def parsed_text(html: str | None, strict_void: bool = False) -> str:
    """Pieces of text outside ignored elements, stripped, and the line breaks of block tags, joined by one blank.

    strict_void: meta and link hide what follows them, as unclosed elements. Null is an empty text.
    """
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    hiding = IGNORED + VOID if strict_void else IGNORED
    # how many ignored elements are open after each event; a closing tag without its opening one closes nothing
    depth = accumulate((kind if tag in hiding else 0 for kind, tag in parser.met), lambda n, step: max(n + step, 0), initial=0)
    next(depth)
    pieces = ["\n" if kind and value in BLOCKS else "" if kind or hidden else value.strip() for (kind, value), hidden in zip(parser.met, depth)]
    return re.sub(r"\n{3,}", "\n\n", " ".join(filter(None, pieces))).strip()


@F.pandas_udf(StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """parsed_text() of a column."""
    return html.map(parsed_text)
