"""Files as frames: text files, folders, stored blueprints, PDF text by a supplied parser."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that scans leave out, and extensions that they take.
SKIPPED_FOLDERS = (".git", "node_modules", "build", "dist", "Binaries", "Intermediate", "Saved", "DerivedDataCache")
TEXT_EXTENSIONS = ("txt", "md", "h", "hpp", "cpp", "c", "cc", "cs", "py", "swift", "js", "ts", "json", "ini")


def _stamped(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("metadata", F.create_map(F.lit("source_kind"), F.lit("file"), F.lit("source_uri"), F.col("path"), F.lit("source_filename"), name, F.lit("source_extension"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, problem, metadata of UTF-8 files; a file that is not UTF-8 or is blank has a problem instead of text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    problem = F.when(F.col("content").isNull() | text.isNull(), "encoding").when(F.trim(text) == "", "empty")
    return _stamped(raw.select("path", F.when(problem.isNull(), text).alias("text"), problem.alias("problem")))


def wanted(path: Column, extensions: tuple[str, ...] = TEXT_EXTENSIONS, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> Column:
    """Whether a scan takes a path, case aside."""
    low = F.lower(path)
    inside = F.lit(False)
    for folder in skipped:
        inside = inside | low.contains(f"/{folder.lower()}/")
    return F.regexp_extract(low, r"\.([^./]+)$", 1).isin([e.lower() for e in extensions]) & ~inside


def scan_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, skipped: tuple[str, ...] = SKIPPED_FOLDERS) -> DataFrame:
    """path, text, size, hash of the folder's text files, in path order."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(wanted(F.col("path"), extensions, skipped))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select("path", text.alias("text"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash")).orderBy(F.lower("path"), "path")


def blueprints(spark: SparkSession, path: str) -> DataFrame:
    """path, text of exported JSON files, one row a file; rows that do not parse have valid = false."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    return raw.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.try_parse_json("value").isNotNull().alias("valid"))


def pdf_files(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]], first_pages: int = 500) -> DataFrame:
    """path, text: page texts by the parser given, joined by blank lines. No parser comes with this engine."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda c: "\n\n".join(p for p in pages_of(c)[:first_pages] if p.strip()) or None)

    return _stamped(raw.select("path", text("content").alias("text")))


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, source_uri, text of raw pages: scripts, styles and tags go, common entities are read."""
    t = F.coalesce("html", F.lit(""))
    for pattern in (r"(?is)<(script|style)\b.*?</\1>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        t = F.regexp_replace(t, pattern, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return pages.select("page_id", F.col("url").alias("source_uri"), F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text"))
