"""File sources and sinks: documents, images, audit exports, profile exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactframe import rules
from redactframe.functions.text import trim
from redactframe.operators.documents import doc_format, needs_ocr

TEXT_FORMATS = ["text", "json", "csv", "md"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _described(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    kept = [c for c in ("content",) if c in files.columns]
    return files.select("path", name.alias("name"), F.col("length").alias("n_bytes"), *kept).withColumn(
        "format", doc_format(F.col("name"), F.lit(None).cast("string")))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of document files: path, name, format, n_bytes. The scan does not name the contents, so none is opened."""
    return _described(_files(spark, path).select("path", "length"))


def file_contents(spark: SparkSession, path: str, most_bytes: int) -> DataFrame:
    """Files of at most ``most_bytes`` with their content. The limit is a plain filter on the length and reaches the
    scan, which then skips larger files before it opens them."""
    return _described(_files(spark, path).where(F.col("length") <= most_bytes))


def utf8_text(content: Column) -> Column:
    """Bytes as text: malformed sequences become the replacement character, a byte order mark goes.

    decode() would fail the whole job on one malformed file.
    """
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def ingest(spark: SparkSession, path: str, most_bytes: int = rules.MAX_DOCUMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder with their text, and rejected files with a code.

    Size and type are decided from a listing; a second scan opens only files within ``most_bytes``. A file scan skips
    files without bytes, so EMPTY appears only for files that come as a table. PDF text needs a parser library and comes in
    as a text table instead; a PDF file is reported as NO_PARSER.
    """
    return _ingested(scan_files(spark, path), file_contents(spark, path, most_bytes), most_bytes)


def ingest_bytes(files: DataFrame, most_bytes: int = rules.MAX_DOCUMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``ingest`` of files that are rows: ``path`` and ``content`` (null: no bytes), such as members of archives or a stored binaryFile scan."""
    described = _described(files.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("length"), "content"))
    return _ingested(described.drop("content"), described.where(F.col("n_bytes").between(1, most_bytes)), most_bytes)


def _ingested(listed: DataFrame, readable: DataFrame, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    code = (
        F.when(F.col("format").isNull(), "UNSUPPORTED")
        .when(F.col("n_bytes") == 0, "EMPTY")
        .when(F.col("n_bytes") > most_bytes, "TOO_LARGE")
        .when(F.col("format") == "pdf", "NO_PARSER")
    )
    early = listed.withColumn("reject_code", code).filter("reject_code IS NOT NULL").select(
        "path", "name", "format", "n_bytes", "reject_code")
    plain = readable.filter(F.col("format").isin(TEXT_FORMATS)).select(
        "path", "name", "format", "n_bytes", utf8_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("reject_code"))
    word = docx_text(readable.filter(F.col("format") == "docx"), most_bytes)
    read = plain.unionByName(word)
    rejected = early.unionByName(read.filter("reject_code IS NOT NULL").drop("text"))
    accepted = read.filter("reject_code IS NULL").drop("reject_code").withColumn("needs_ocr", needs_ocr(F.col("text")))
    return accepted, rejected


_DOCX_SCHEMA = "path string, name string, format string, n_bytes long, text string, reject_code string"


def docx_text(files: DataFrame, most_bytes: int = rules.MAX_DOCUMENT_BYTES) -> DataFrame:
    """One text per DOCX file: a line per paragraph, its runs joined. Broken files become reject rows, and so do
    files whose document part unpacks to more than ten times ``most_bytes``: reading stops there."""
    out = files.select("path", "name", "format", "n_bytes", "content").mapInPandas(_docx_reader(10 * most_bytes), _DOCX_SCHEMA)
    tidy = F.regexp_replace(F.regexp_replace("text", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return out.withColumn("text", trim(tidy))


def _docx_reader(most: int):
    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def read(content: bytes) -> tuple[str | None, str | None]:
        import io
        import zipfile
        import zlib
        from xml.etree import ElementTree

        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as part:
                xml = part.read(most + 1)
            if len(xml) > most:
                return None, "TOO_LARGE"
            root = ElementTree.fromstring(xml)
        except KeyError:
            return None, "DOCX_NO_DOCUMENT"
        except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, OSError, ValueError, NotImplementedError):
            return None, "DOCX_UNREADABLE"
        paragraphs = [p for p in root.iter() if local(p.tag) == "p"]
        texts = ["".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in paragraphs]
        return "\n".join(texts), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [read(bytes(c)) for c in batch["content"]]
            yield batch.drop(columns="content").assign(
                text=[r[0] for r in results], reject_code=[r[1] for r in results])

    return run


# --- images ------------------------------------------------------------------------


def _be(content: Column, at: int, n: int) -> Column:
    """Big-endian unsigned integer at a 1-based byte position."""
    return F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")


@F.pandas_udf(T.ArrayType(T.LongType()))
def jpeg_size(images: pd.Series) -> pd.Series:
    """[width, height] from the first frame header, or null. The marker walk needs a loop."""

    def one(data):
        if data is None or data[:2] != b"\xff\xd8":
            return None
        at = data.find(b"\xff", 2)
        while 0 <= at < len(data) - 9:
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = (int.from_bytes(data[at + i : at + i + 2], "big") for i in (5, 7))
                return [width, height]
            at = data.find(b"\xff", at + 1)
        return None

    return images.map(one)


def image_sizes(images: DataFrame, content: str = "content") -> DataFrame:
    """Adds width and height from the PNG or JPEG header; null for anything else.

    PNG is read by plain expressions; only non-PNG rows reach Python.
    """
    c = F.col(content)
    is_png = (F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A") & (F.hex(F.substring(c, 13, 4)) == "49484452")
    size = jpeg_size(F.when(~F.coalesce(is_png, F.lit(False)), c))
    d = images.withColumn("__size", size)
    return d.select(
        *[x for x in images.columns],
        F.when(is_png, _be(c, 17, 4)).otherwise(F.get("__size", F.lit(0))).alias("width"),
        F.when(is_png, _be(c, 21, 4)).otherwise(F.get("__size", F.lit(1))).alias("height"))


def degenerate_images(images: DataFrame, content: str = "content") -> DataFrame:
    """Images with an axis under 28 pixels; unreadable headers are not flagged."""
    least = rules.MIN_IMAGE_SIDE
    return image_sizes(images, content).filter((F.col("width") < least) | (F.col("height") < least))


# --- sinks ------------------------------------------------------------------------


def write_audit(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Export rows (see audit.export_rows) as CSV with a header, or as JSON lines."""
    if kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown export kind {kind}")


def profile_documents(entries: DataFrame) -> DataFrame:
    """One JSON document per profile: profile_name and data. Keys are unique per profile."""
    packed = entries.groupBy("profile_name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("data"))
    return packed.select("profile_name", F.to_json(F.struct(F.col("profile_name").alias("profileName"), "data")).alias("document"))


def write_profiles(entries: DataFrame, path: str, buckets: int = 64) -> None:
    """Profile export: entries as JSON lines, all of a profile in one of ``buckets`` folders (a hash of its name)."""
    entries.withColumn("bucket", F.pmod(F.xxhash64("profile_name"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").json(path)
