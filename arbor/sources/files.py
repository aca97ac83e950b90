"""Sources and sinks: directories of documents, Markdown, Word, pages of PDF, JSON trees."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = r"\.(pdf|md|markdown|docx|docm)$"


def doc_type(path: Column) -> Column:
    """pdf, markdown or word by a path's suffix in any case, else null."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.(md|markdown)$"), "markdown").when(low.rlike(r"\.(docx|docm)$"), "word")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def with_doc_ids(files: DataFrame) -> DataFrame:
    """``files`` with doc_id: the stem in lower case with blanks and slashes as hyphens; the n-th of the same gets -n."""
    base = F.translate(F.lower(stem(F.col("path"))), " /", "--")
    out = files.withColumn("_base", base)
    n = F.row_number().over(Window.partitionBy("_base").orderBy("path"))
    return out.withColumn("_n", n).withColumn("doc_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), F.col("_n").cast("string")))).drop("_base", "_n")


def excluded(path: str, patterns: list[str]) -> bool:
    """Whether a path's end matches a glob part by part, or its name is one of the patterns."""
    parts = path.split("/")
    for pattern in patterns:
        own = pattern.strip("/").split("/")
        if parts[-1] == pattern or (len(own) <= len(parts) and all(fnmatch.fnmatchcase(a, b) for a, b in zip(parts[-len(own) :], own))):
            return True
    return False


def scan_directory(spark: SparkSession, directory: str, exclude: list[str] | None = None) -> DataFrame:
    """path, doc_type, doc_id and content of the documents below a directory, whatever store it is in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "content")
    files = files.withColumn("doc_type", doc_type(F.col("path"))).where("doc_type is not null")
    if exclude:
        patterns = list(exclude)
        keep = F.udf(lambda p: not excluded(p, patterns), "boolean")
        files = files.where(keep("path"))
    return with_doc_ids(files)


def markdown_files(files: DataFrame) -> DataFrame:
    """doc_id, value (the text) and stem of Markdown files."""
    return files.where("doc_type = 'markdown'").select("doc_id", F.decode("content", "UTF-8").alias("value"), stem(F.col("path")).alias("stem"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_docx(content: bytes) -> list[tuple[int, str, str]]:
    """(number from 1, style name, text) of a Word file's paragraphs that have a text; empty ones count in the numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for k, p in enumerate(body.findall(f"{_W}p") if body is not None else [], 1):
        text = ""
        for e in p.iter():
            text += (e.text or "") if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag in (f"{_W}br", f"{_W}cr") else ""
        style = p.find(f"{_W}pPr/{_W}pStyle")
        own = style.get(f"{_W}val") if style is not None else ""
        if text.strip():
            out.append((k, styles.get(own, own) or "", text.strip()))
    return out


def word_paragraphs(files: DataFrame) -> DataFrame:
    """doc_id, par_no, style, text and stem of the paragraphs of Word files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *p, s) for d, c, s in zip(batch["doc_id"], batch["content"], batch["stem"]) for p in read_docx(c)]
            yield pd.DataFrame(rows, columns=["doc_id", "par_no", "style", "text", "stem"])

    rows = files.where("doc_type = 'word'").select("doc_id", "content", stem(F.col("path")).alias("stem"))
    return rows.mapInPandas(read, "doc_id string, par_no int, style string, text string, stem string")


Extractor = Callable[[bytes], list[str]]


def pdf_pages(files: DataFrame, extract: Extractor, tokens: Callable[[str], int] = lambda t: len(t.split())) -> DataFrame:
    """doc_id, page_no, text and token_count of PDF pages. ``extract`` gives the texts of a file's pages: a library for PDF
    is plugged in here, none comes with this package."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, t, tokens(t)) for d, c in zip(batch["doc_id"], batch["content"]) for k, t in enumerate(extract(c), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "token_count"])

    return files.where("doc_type = 'pdf'").select("doc_id", "content").mapInPandas(read, "doc_id string, page_no int, text string, token_count int")


def text_extractor(parser: str = "plain") -> Extractor:
    """Extractors by name: ``plain`` takes form feeds as page ends; the names of PDF libraries work if these are installed."""
    if parser == "plain":
        return lambda content: content.decode("utf-8", "replace").split("\f")
    if parser == "PyPDF2":
        import PyPDF2

        return lambda content: [p.extract_text() or "" for p in PyPDF2.PdfReader(io.BytesIO(content)).pages]
    if parser == "PyMuPDF":
        import pymupdf

        return lambda content: [p.get_text() for p in pymupdf.open(stream=content, filetype="pdf")]
    raise ValueError(f"unknown parser: {parser}")


def json_trees(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem without _structure) and value of JSON trees."""
    rows = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return rows.select(F.regexp_replace(stem(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))), r"_structure$", "").alias("doc_id"), "value")


def write_trees(trees: DataFrame, path: str) -> None:
    """JSON trees (doc_id, value), a line for each document, partitioned by nothing so that any number can be written."""
    trees.write.mode("overwrite").json(path)


def html_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, line_no, level and text of a web page's title (0), headings (1 to 6), paragraphs and list items (null)."""
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " ")
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<(?:title|h[1-6]|p|li)\b[^>]*>.*?</(?:title|h[1-6]|p|li)>"), F.lit(0))
    rows = pages.select("doc_id", F.posexplode(blocks).alias("n", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("block", r"<[^>]*>", " "), r"\s+", " "))
    level = F.when(tag == "title", 0).when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return rows.select("doc_id", (F.col("n") + 1).alias("line_no"), level.alias("level"), text.alias("text")).where("text != ''")


def safe_name(name: str) -> str:
    """A file name without slashes."""
    return re.sub("/", "-", os.fspath(name))
