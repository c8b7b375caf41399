"""Source documents to paragraphs, and the engine's own JSON tables.

Files are read by Spark (``binaryFile``), so any store that Spark reads will do. Only opening a
DOCX or PDF needs Python; it runs in Arrow batches, one file at a time, and a file that can't be
read gives a note in place of paragraphs. All later steps are windows over lines.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus

# Fixed value: the suffixes that are read.
SUFFIXES = "docx md txt pdf".split()
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PARAGRAPHS = "file string, index int, text string, style string, note string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, suffix, size, sha1, content) of all source files, by path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return found.select("path", name.alias("file"), suffix.alias("suffix"), F.col("length").alias("size"), F.sha1("content").alias("sha1"), "content")


def docx_paragraphs(content: bytes, keep_empty: bool = False) -> list[tuple[str, str | None]]:
    """(text, style) of the body's paragraphs; those nested in another (text boxes) belong to none."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    out: list[tuple[str, str | None]] = []

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            if child.tag == f"{_W}p":
                out.append((_run_text(child).strip(), _style(child)))
            else:
                walk(child)

    walk(root)
    return [p for p in out if p[0] or keep_empty]


def _run_text(paragraph: ElementTree.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    parts: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            if child.tag == f"{_W}t":
                parts.append(child.text or "")
            elif child.tag in marks:
                parts.append(marks[child.tag])
            elif child.tag != f"{_W}p":
                walk(child)

    walk(paragraph)
    return "".join(parts)


def _style(paragraph: ElementTree.Element) -> str | None:
    style = paragraph.find(f"{_W}pPr/{_W}pStyle")
    return None if style is None else style.get(f"{_W}val")


def _python_reader(table: DataFrame, read: Callable[[bytes], list[tuple[str, str | None]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"]):
                try:
                    rows += [(file, i, text, style, None) for i, (text, style) in enumerate(read(bytes(content)))] or [(file, None, None, None, "empty")]
                except (OSError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    rows.append((file, None, None, None, f"unreadable: {type(error).__name__}"))
            yield pd.DataFrame(rows, columns=["file", "index", "text", "style", "note"]).astype({"index": "Int32"})

    return table.select("file", "content").mapInPandas(run, _PARAGRAPHS)


def _indexed(table: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    index = F.row_number().over(W.partitionBy("doc").orderBy("pos")) - 1
    return table.select(F.col("doc").alias("file"), index.alias("index"), "text", F.lit(None).cast("string").alias("style"), F.lit(None).cast("string").alias("note"))


def text_paragraphs(table: DataFrame) -> DataFrame:
    """Blocks between blank lines; byte order mark dropped, line ends unified, doubled headings dropped."""
    body = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    body = F.regexp_replace(body, "\r\n?", "\n")
    blocks = table.select(F.col("file").alias("doc"), F.posexplode(F.split(body, r"\n\s*\n")).alias("pos", "text"))
    blocks = blocks.withColumn("text", T.u_trim(F.col("text"))).where("text <> ''")
    return _indexed(corpus.without_doubled_headings(blocks))


def stitched_lines(lines: DataFrame) -> DataFrame:
    """Lines of extracted pages ``(doc, pos, text)`` to paragraphs: noise, frequent lines, blocks."""
    return _indexed(corpus.stitched(corpus.infrequent(corpus.denoised(lines))))


def pdf_lines(content: bytes) -> list[tuple[str, str | None]]:
    """Lines of a PDF; needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise ValueError("pypdf is not installed") from error
    return [(line, None) for page in PdfReader(io.BytesIO(content)).pages for line in (page.extract_text() or "").splitlines()]


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """All source files as paragraphs ``(file, index, text, style, note)``, by suffix."""
    found = files(spark, folder)
    docx = _python_reader(found.where("suffix = 'docx'"), docx_paragraphs)
    text = text_paragraphs(found.where("suffix in ('md', 'txt')"))
    raw = _python_reader(found.where("suffix = 'pdf'"), pdf_lines)
    pdf = stitched_lines(raw.where("note is null").select(F.col("file").alias("doc"), F.col("index").alias("pos"), "text"))
    return docx.unionByName(text).unionByName(pdf).unionByName(raw.where("note is not null"))


def joined_text(table: DataFrame, sep: str = "\n") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("index", "text")))
    return table.where("text is not null").groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), sep).alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped, a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def cases(spark: SparkSession, path: str, parents: DataFrame) -> DataFrame:
    """Evaluation records ``{question, gold[law#article], why}`` with each gold's parent; one that has none stops the job."""
    records = spark.read.schema("question string, gold array<string>, why string").option("multiLine", True).json(path)
    records = records.withColumn("pos", F.monotonically_increasing_id())
    keys = records.select("pos", "question", "why", F.posexplode_outer("gold").alias("place", "key"))
    law, no = F.substring_index("key", "#", 1), F.substring_index("key", "#", -1)
    joined = keys.withColumn("law_id", law).withColumn("article_no", no).join(parents.select("law_id", "article_no", "parent_id"), ["law_id", "article_no"], "left")
    checked = F.when(F.col("key").isNotNull() & F.col("parent_id").isNull(), F.raise_error(F.concat(F.lit("no such article: "), "key"))).otherwise(F.col("parent_id"))
    gold = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("place", checked.alias("parent_id")))))
    return joined.groupBy("pos", "question", "why").agg(F.transform(gold, lambda x: x["parent_id"]).alias("gold_ids")).drop("pos")


def ledger(table: DataFrame, mode: str | None = None, status: str | None = None) -> DataFrame:
    """Rows of the document ledger, newest first, by what is asked."""
    for column, value in (("mode", mode), ("status", status)):
        if value is not None:
            table = table.where(F.col(column) == value)
    return table.orderBy(F.desc("created_at"), F.desc("doc_id"))
