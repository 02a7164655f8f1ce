"""Structure-aware chunking: sections, units, packing with overlap, provenance by offset."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.text import strip

SIZE, OVERLAP = 900, 150
LONGEST_TITLE = 80
#: Fixed formats: a numbered title; paragraph and sentence breaks.
NUMBERED = r"^\s*\d+(?:\.\d+)*[.)]?\s+\S"
PARAGRAPH = r"\n\s*\n"
#: A line with its end, whatever kind of end it has.
_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE = rf"[^{_ENDS}]+(?:\r\n|[{_ENDS}])?|\r\n|[{_ENDS}]"
SENTENCE = r"(?<=[.!?…])\s+"


def is_title(line: Column) -> Column:
    """A short line that is numbered, or whose letters (three at least) are all capitals."""
    bare = strip(line)
    letters = F.regexp_replace(bare, r"[^\p{L}]", "")
    return (bare != "") & (F.length(bare) <= LONGEST_TITLE) & (bare.rlike(f"(?U){NUMBERED}") | letters.rlike(r"^\p{Lu}{3,}$"))


def sections(text: Column) -> Column:
    """array<struct<start, title>> of the title lines, start in code points from 0."""
    none = F.array().cast("array<struct<start:int,title:string>>")

    def step(state: Column, line: Column) -> Column:
        title = F.array(F.struct(state["at"].alias("start"), strip(line).alias("title")))
        return F.struct((state["at"] + F.length(line)).alias("at"), F.when(is_title(line), F.concat(state["found"], title)).otherwise(state["found"]).alias("found"))

    return F.aggregate(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINE), F.lit(0)), F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]


def section_at(found: Column, offset: Column) -> Column:
    """As-of lookup: the last title at or before an offset, or null."""
    return F.try_element_at(F.filter(found, lambda s: s["start"] <= offset), F.lit(-1))["title"]


def asof_rows(found: DataFrame, offsets: Column) -> DataFrame:
    """(doc_id, s: sections, ...) -> (doc_id, start, section): the last title at or before each offset, or null.

    Titles and offsets become the rows of one sort by document and place; the text isn't among them.
    """
    titles = F.transform("s", lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("asked"), x["title"].alias("title")))
    asked = F.transform(offsets, lambda i: F.struct(i.alias("start"), F.lit(1).alias("asked"), F.lit(None).cast("string").alias("title")))
    rows = found.select("doc_id", F.inline(F.concat(titles, asked)))
    before = Window.partitionBy("doc_id").orderBy("start", "asked").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("section", F.last("title", ignorenulls=True).over(before)).filter("asked = 1")
    return met.select("doc_id", F.col("start").cast("bigint").alias("start"), "section")


def page_at(pages: Column, offset: Column) -> Column:
    """As-of lookup in array<struct<start, page>>: the last page that starts at or before an offset; 1 without any."""
    return F.coalesce(F.try_element_at(F.filter(pages, lambda p: p["start"] <= offset), F.lit(-1))["page"], F.lit(1))


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc, page, text) -> (doc, text, pages: array<struct<start, page>>): pages joined by a blank line."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int")
    rows = pages.withColumn("start", start).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "start", "text"))).alias("p"))  # the pages of one document
    return rows.select("doc", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.transform("p", lambda x: F.struct(x["start"].alias("start"), x["page"].alias("page"))).alias("pages"))


def units(text: Column, size: int = SIZE) -> Column:
    """Paragraphs that fit; else their sentences that fit; else slices of the sentence. array<string>."""
    pieces = lambda t, pattern: F.filter(F.transform(F.split(t, pattern), strip), lambda x: x != "")
    slices = lambda s: F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(size)), lambda i: F.substring(s, i + 1, F.lit(size)))
    sentences = lambda p: F.flatten(F.transform(pieces(p, SENTENCE), lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(slices(s))))
    return F.flatten(F.transform(pieces(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(sentences(p))))


def fixed_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Slices of a fixed size that overlap, stripped, blank ones left out; the last one ends with the text."""
    t = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(t, i + 1, F.lit(size)))), lambda x: x != "")


# chunks with provenance


_PARAGRAPH, _SENTENCE, _NUMBERED = re.compile(PARAGRAPH), re.compile(SENTENCE), re.compile(NUMBERED)


def _stripped_parts(text: str, begin: int, end: int, breaks: re.Pattern) -> Iterator[tuple[int, int]]:
    """The spans between breaks, without the white space at their ends; blank ones are left out."""
    edges = [begin, *(e for m in breaks.finditer(text, begin, end) for e in m.span()), end]
    for a, b in zip(edges[::2], edges[1::2]):
        part = text[a:b]
        bare = part.strip()
        if bare:
            a += len(part) - len(part.lstrip())
            yield a, a + len(bare)


def unit_spans(text: str, *sizes: int) -> list[tuple[int, int]] | list[list[tuple[int, int]]]:
    """units() as spans of the text; for several sizes a list each, with paragraphs and sentences looked for once."""
    made: list[list[tuple[int, int]]] = [[] for _ in sizes or (SIZE,)]
    for a, b in _stripped_parts(text, 0, len(text), _PARAGRAPH):
        sentences = None
        for size, spans in zip(sizes or (SIZE,), made):
            if b - a <= size:
                spans.append((a, b))
                continue
            if sentences is None:
                paragraph = text[a:b]  # the look-behind must not see beyond the paragraph
                sentences = [(a + c, a + d) for c, d in _stripped_parts(paragraph, 0, b - a, _SENTENCE)]
            for c, d in sentences:
                if d - c <= size:
                    spans.append((c, d))
                else:
                    spans += [(i, min(i + size, d)) for i in range(c, d, size)]
    return made[0] if len(made) == 1 else made


def packed(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Consecutive units as groups (first, end). Each unit costs its length and one.

    A group ends before the unit that would exceed the size. The next one begins with the longest run of last
    units whose lengths, joined, fit the overlap. On the running sums of the costs both are comparisons.
    """
    sums = [0, *accumulate(n + 1 for n in lengths)]
    groups, first = [], 0
    for i in range(len(lengths)):
        if i > first and sums[i + 1] - sums[first] > size:
            groups.append((first, i))
            first = max(first, bisect_left(sums, sums[i] - overlap - 1))
    if len(lengths) > first:
        groups.append((first, len(lengths)))
    return groups


def title_starts(text: str) -> tuple[list[int], list[str]]:
    starts, titles, at = [], [], 0
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if bare and len(bare) <= LONGEST_TITLE:
            letters = "".join(filter(str.isalpha, bare))
            if _NUMBERED.match(bare) or len(letters) >= 3 and all(map(str.isupper, letters)):
                starts.append(at)
                titles.append(bare)
        at += len(line)
    return starts, titles


def chunk_text(text: str, name: str, pages: list[tuple[int, int]] = (), size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    """The chunks of one document: text with header, body, header, section, page."""
    spans = unit_spans(text, size)
    starts, titles = title_starts(text)
    chunks = []
    for a, b in packed([e - s for s, e in spans], size, overlap):
        body = "\n".join(text[s:e] for s, e in spans[a:b]).strip()
        if not body:
            continue
        offset = spans[a][0]
        at = bisect_right(starts, offset)
        section = titles[at - 1] if at else None
        page = bisect_right([p[0] for p in pages], offset)
        header = f"{name} > {section}" if section else name
        chunks.append({"chunk_no": len(chunks), "text": f"[{header}]\n{body}", "body": body, "header": header, "section": section, "page": pages[page - 1][1] if page else 1})
    return chunks


CHUNK = "struct<chunk_no:int,text:string,body:string,header:string,section:string,page:int>"


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc, text[, pages]) -> (doc, chunk_no, text, body, header, section, page). Null and blank texts have none."""
    kind = pa.list_(pa.struct([("chunk_no", pa.int32()), ("text", pa.string()), ("body", pa.string()), ("header", pa.string()), ("section", pa.string()), ("page", pa.int32())]))
    paged = docs if "pages" in docs.columns else docs.withColumn("pages", F.lit(None).cast("array<struct<start:int,page:int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [chunk_text(t or "", d or "", [(p["start"], p["page"]) for p in ps or ()], size, overlap) for d, t, ps in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["doc", "c"])

    rows = paged.select(F.col("doc").cast("string"), "text", "pages").mapInArrow(run, f"doc string, c array<{CHUNK}>")
    return rows.select("doc", F.inline("c"))
