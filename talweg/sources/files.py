"""Documents out of files: one row per page, whatever the format. A bad file gives no rows, never an error."""

from __future__ import annotations

import io
import logging
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.sources.html import parsed_text

Pages = list[tuple[int, str]]
log = logging.getLogger(__name__)


def _one_page(text: str) -> Pages:
    text = text.strip()
    return [(1, text)] if text else []


def read_text(content: bytes) -> Pages:
    return _one_page(content.decode("utf-8", errors="replace"))


def read_html(content: bytes) -> Pages:
    return _one_page(parsed_text(content.decode("utf-8", errors="replace")))


def read_docx(content: bytes) -> Pages:
    """Paragraphs of word/document.xml, their runs joined, blank ones left out."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")).strip() for p in root.iter(f"{space}p"))
    return _one_page("\n\n".join(filter(None, paragraphs)))


def read_pdf(content: bytes, ocr: Callable[[bytes], Pages] | None = None) -> Pages:
    """Pages with text; if there are none, what ``ocr`` makes of the file. Needs pypdf; without it a PDF has no rows."""
    try:
        from pypdf import PdfReader
    except ImportError:
        log.warning("a PDF has no rows: pypdf isn't installed")
        return []
    texts = ((i, (page.extract_text() or "").strip()) for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1))
    found = [(i, t) for i, t in texts if t]
    return found or scanned(content, ocr)


def scanned(content: bytes, ocr: Callable[[bytes], Pages] | None) -> Pages:
    """The pages that a recognizer finds; none without one, and none if it fails."""
    if ocr is None:
        log.warning("a PDF has no text, and there is no recognizer")
        return []
    try:
        return [(i, t.strip()) for i, t in ocr(content) if t and t.strip()]
    except Exception as error:  # a recognizer must not end the scan
        log.warning("a recognizer failed: %s", error)
        return []


#: Readers by extension; open to further ones.
EXTRACTORS: dict[str, Callable[[bytes], Pages]] = {".pdf": read_pdf, ".txt": read_text, ".md": read_text, ".html": read_html, ".htm": read_html, ".docx": read_docx}


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, content, hash) of the files of a folder, not of its subfolders, with a known extension."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    known = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*EXTRACTORS)
    return files.filter(known).select(name.alias("doc"), "content", F.sha2("content", 256).alias("hash"))


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], Pages]] | None = None, ocr: Callable[[bytes], Pages] | None = None) -> DataFrame:
    """(doc, content) -> (doc, page, text). Rows without a name, of an unknown kind or with content that can't be read have none."""
    readers = dict(EXTRACTORS if extractors is None else extractors)
    if ocr is not None and readers.get(".pdf") is read_pdf:
        readers[".pdf"] = partial(read_pdf, ocr=ocr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, str]] = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = readers.get("." + (doc or "").rpartition(".")[2].lower())
                try:
                    rows += [(doc, page, text) for page, text in (reader(content or b"") if reader else [])]
                except Exception as error:  # whatever a file contains, the scan goes on
                    log.warning("%s can't be read: %s", doc, error)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["doc", "page", "text"])

    return files.select("doc", "content").mapInArrow(run, "doc string, page int, text string")
