"""Commit logs as rows, from exported text or from a repository on disk (a Python data source)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

#: The record form that both readers agree on: a header line, the body, then the diff after a marker line.
HEADER, DIFF = "COMMIT:", "DIFF:"
DIFF_BYTES = 8192
SCHEMA = "hash string, short_hash string, author string, date string, subject string, body string, diff string"


def header(hash_: Column, short: Column, author: Column, date: Column, subject: Column) -> Column:
    return F.concat(F.lit(HEADER), F.concat_ws("|", hash_, short, author, date, subject))


def parse_header(line: Column) -> dict[str, Column]:
    """Columns of a header line; a subject may hold the divider."""
    parts = F.split(F.substring(line, F.lit(len(HEADER) + 1), F.length(line)), r"\|", 5)
    return {name: F.get(parts, i) for i, name in enumerate(("hash", "short_hash", "author", "date", "subject"))}


def parse_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """Commits of exported logs: each record begins with a header at a line's start."""
    records = logs.select(F.explode(F.split(F.concat(F.lit("\n"), F.col(text)), rf"\n(?={HEADER})")).alias("r")).where(F.col("r").startswith(HEADER))
    line = F.regexp_extract("r", r"^([^\n]*)", 1)
    rest = F.substring(F.col("r"), F.length(line) + 2, F.length("r"))
    parts = F.split(F.concat(F.lit("\n"), rest), rf"\n{DIFF}\n", 2)
    diff = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    cut = F.when(F.octet_length(diff) <= DIFF_BYTES, diff).otherwise(F.substring(F.encode(diff, "UTF-8"), 1, DIFF_BYTES).cast("string"))
    return records.select(*[c.alias(n) for n, c in parse_header(line).items()], F.regexp_replace(F.get(parts, F.lit(0)), r"^\s+|\s+$", "").alias("body"), cut.alias("diff"))


class GitLog(DataSource):
    """spark.read.format("git_log").option("path", ...).load(): the repository must be where the one reading task runs."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        path, most = self.options["path"], int(self.options.get("maxCount", -1))  # all of them, unless told otherwise
        if self.options.get("since", "").startswith("-"):
            raise ValueError("since must name a commit")
        since = [f"{self.options['since']}..HEAD"] if self.options.get("since") else []
        run = lambda *a: subprocess.run(["git", "-C", path, *a], capture_output=True, text=True, check=True, errors="replace").stdout
        for record in run("log", "--no-merges", f"--max-count={most}", "--format=%H%x1f%h%x1f%an%x1f%aI%x1f%s%x1f%b%x1e", *since).split("\x1e"):
            fields = record.strip("\n").split("\x1f")
            if len(fields) == 6:
                diff = run("show", "--format=", "--patch", fields[0]).encode()[:DIFF_BYTES].decode("utf-8", "ignore")
                yield (*fields, diff)
