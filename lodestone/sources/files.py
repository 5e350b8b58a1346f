"""Readers of files as records or texts, and sinks. Text formats pass a strict charset gate; binary ones go to their extractor."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ingest

#: What is taken for a document.
EXTENSIONS = [".md", ".txt", ".html", ".htm", ".docx", ".pdf"]
TEXTS = "path string, body string, problem string"


def decode(data: bytes) -> str | None:
    """UTF-8 with or without a mark, else GB18030 if it encodes back to the same bytes; None rather than a damaged text."""
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        text = data.decode("gb18030")
        return text if text.encode("gb18030") == data else None
    except UnicodeError:
        return None


def preview(data: bytes) -> str | None:
    """The beginning of a file: up to three bytes of a torn last character don't count."""
    for cut in range(4):
        if (text := decode(data[: len(data) - cut])) is not None:
            return text
    return None


def docx_text(data: bytes) -> str:
    """The paragraphs of a word file, trimmed, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")).strip() for p in root.iter() if p.tag.endswith("}p"))
    return "\n".join(x for x in lines if x)


def pdf_text(data: bytes) -> str:
    """What the shown strings of a PDF's plain or deflated streams say; best effort, '' where streams aren't text."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body)
        except zlib.error:
            pass
        shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", body)
        part = " ".join(re.sub(rb"\\([()\\])", rb"\1", a or b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", b))).decode("latin-1") for a, b in shown)
        solid = re.sub(r"\s", "", part)
        if solid and sum(c.isalnum() or c in ".,;:!?-'\"()" for c in solid) >= 0.8 * len(solid):
            out.append(part)
    return "\n".join(out)


def candidates(spark: SparkSession, path: str, most: int = 64 << 20, oldest_days: int = 36_500, now: str | None = None) -> DataFrame:
    """The files under path with the reason to skip each (null: a candidate), newest first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    day = F.lit(now).cast("timestamp") if now else F.max("modificationTime").over(W.partitionBy())
    f = f.withColumn("age_days", F.datediff(day, "modificationTime"))
    return f.withColumn("skip", ingest.skip_reason(F.col("path"), F.col("length"), F.col("age_days"), EXTENSIONS, most, oldest_days)).orderBy(F.desc("modificationTime"), "path")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, problem) of the documents under path, extracted and normalised; problem names what couldn't be read."""
    import pandas as pd

    def run(parts):
        for pdf in parts:
            out = []
            for p, data in zip(pdf["path"], pdf["content"]):
                ext = re.search(r"\.[^.]*$", p.lower())
                try:
                    if ext and ext[0] == ".docx":
                        body = docx_text(data)
                    elif ext and ext[0] == ".pdf":
                        body = pdf_text(data)
                    else:
                        body = decode(data)
                    out.append((p, body, "undecodable" if body is None else None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((p, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["path", "body", "problem"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = raw.where(F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).isin(EXTENSIONS) & ~F.col("path").rlike(r"/[.~][^/]*$")).select("path", "content")
    t = raw.mapInPandas(run, TEXTS)
    html = F.lower("path").rlike(r"\.html?$")
    body = tx.normalize(F.when(html, tx.extract_html(F.col("body"))).otherwise(F.col("body")))
    return t.withColumn("body", body).withColumn("problem", F.when(F.col("problem").isNull() & (F.col("body") == ""), "empty").otherwise(F.col("problem")))


def read_json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Records of a file with one JSON object a line; damaged lines are dropped."""
    r = spark.read.option("mode", "DROPMALFORMED")
    return (r.schema(schema) if schema else r).json(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Records of a JSON array, or the one of a single object."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows with a trimmed header; ragged rows are filled or cut, quotes may span lines."""
    d = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(path)
    return d.toDF(*[c.strip() for c in d.columns])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one text each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def read_parquet_strings(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with every column as text."""
    d = spark.read.parquet(path)
    return d.select(*[(F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string")).alias(c) for c, t in d.dtypes])


def kind_of(name: str, head: bytes) -> str:
    """What a file is, by extension, then by its first bytes: parquet, jsonl, json, csv, tsv, text or binary."""
    ext = name.lower().rpartition(".")[2]
    known = {"parquet": "parquet", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "csv": "csv", "tsv": "tsv", "md": "text", "txt": "text"}
    if head[:4] == b"PAR1":
        return "parquet"
    if ext in known:
        return known[ext]
    if b"\0" in head or head and sum(b < 32 and b not in (9, 10, 13) for b in head) > len(head) / 10:
        return "binary"
    text = (preview(head) or "").lstrip()
    return "json" if text.startswith("[") else "jsonl" if text.startswith("{") else "text"


def write_safe_csv(df: DataFrame, path: str) -> None:
    """Text cells guarded against being read as formulas."""
    df.select(*[ingest.safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.csv(path, header=True)
