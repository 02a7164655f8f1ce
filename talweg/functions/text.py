"""Text normalizers and tokens as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0].isalpha() and len(unicodedata.normalize("NFKD", chr(code))) > 1:
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def _decomposed(text: str) -> str:
    """Full compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _fast() -> str:
    """A character class of ASCII and those Latin letters and punctuation marks for which translation is the decomposition."""
    table = str.maketrans(ACCENTED, PLAIN)
    ranges: list[list[int]] = []
    for code in (*range(0x250), *range(0x2010, 0x2028)):
        if _decomposed(chr(code)) == chr(code).translate(table):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


#: Texts that the translation of single letters doesn't serve.
BEYOND = f"[^{_fast()}]"


def strip(text: Column) -> Column:
    """Python's strip: white space of any kind, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_accents(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, ACCENTED, PLAIN)).otherwise(text)


@F.pandas_udf(StringType())
def normalize_search_exact(texts: pd.Series) -> pd.Series:
    """normalize_search() with full compatibility decomposition, for texts beyond the Latin letters."""
    return texts.map(lambda t: re.sub(r"[^\w\s]|[\x1C-\x1F]", " ", _decomposed(t or "").lower()))


@F.pandas_udf(StringType())
def normalize_eval_exact(texts: pd.Series) -> pd.Series:
    """normalize_eval() with full compatibility decomposition."""
    return texts.map(lambda t: re.sub(r"\s+", " ", _decomposed(t or "")).strip().lower())


def _chosen(text: Column, exact: Callable[[Column], Column], fast: Callable[[Column], Column]) -> Column:
    """The exact form of texts beyond the fast one. Python is given null for all others."""
    text = F.coalesce(text, F.lit(""))
    beyond = text.rlike(r"[^\x00-\x7F]") & text.rlike(BEYOND)
    return F.when(beyond, exact(F.when(beyond, text))).otherwise(fast(text))


def normalize_search(text: Column) -> Column:
    """Lower case without accents; everything but letters, digits, underscores and white space becomes a space."""
    return _chosen(text, normalize_search_exact, lambda t: F.regexp_replace(F.lower(without_accents(t)), r"(?U)[^\w\s]", " "))


def tokens(text: Column) -> Column:
    """The words of the search form, repeats included: runs of letters, digits and underscores."""
    text = F.coalesce(text, F.lit(""))
    plain = ~text.rlike(r"[^\x00-\x7F]")
    beyond = ~plain & text.rlike(BEYOND)
    found = F.when(plain, F.split(F.lower(text), "[^a-z0-9_]+")).when(beyond, F.split(normalize_search_exact(F.when(beyond, text)), r"(?U)\s+"))
    return F.filter(found.otherwise(F.split(F.lower(without_accents(text)), r"(?U)\W+")), lambda t: t != "")


class _Letters(dict):
    """The decomposition of each letter met."""

    def __missing__(self, letter: str) -> str:
        self[letter] = found = _decomposed(letter)
        return found


_LETTERS, _BEYOND_ASCII, _WORD = _Letters(), re.compile(r"[^\x00-\x7F]"), re.compile(r"\w+")


def words(text: str, mark: str = "") -> list[str]:
    """tokens() of one text in Python. A mark, a character that is no letter, comes as a token of its own wherever it stands."""
    plain = text if text.isascii() else _BEYOND_ASCII.sub(lambda m: _LETTERS[m[0]], text)
    return (re.compile(rf"\w+|{re.escape(mark)}") if mark else _WORD).findall(plain.lower())


def normalize_eval(text: Column) -> Column:
    """Lower case without accents and with single blanks; punctuation stays."""
    return _chosen(text, normalize_eval_exact, lambda t: F.lower(strip(F.regexp_replace(without_accents(t), r"(?U)\s+", " "))))


def first_line(text: Column, otherwise: Column) -> Column:
    """The first line that isn't blank, without outer quotes; the alternative if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")
    line = strip(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r'^"+|"+$', ""))
    return F.coalesce(F.when(line != "", line), otherwise)


def fenced_json(text: Column, kind: str = "object") -> Column:
    """The JSON object or array in a model's answer, code fences removed; null if there is none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```(json)?|```$", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}" if kind == "object" else r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def log_key(value: Column) -> Column:
    """A key for logs that doesn't give the value away: 12 hex digits of its SHA-256; '-' for none."""
    return F.when(F.coalesce(value, F.lit("")) == "", "-").otherwise(F.substring(F.sha2(value, 256), 1, 12))


def shown(value: Column, decimals: int = 3) -> Column:
    """A number for a report: '-' for null."""
    return F.coalesce(F.format_string(f"%.{decimals}f", value), F.lit("-"))
