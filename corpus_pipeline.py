"""A corpus pipeline of five stages; each reads what the one before wrote.

Every stage works on all documents its predecessor kept, and all but the last return the columns of documents, whatever
else these are called, untouched but for text and n_chars.

Nulls: a null or empty text is neither toxic nor contaminated, has no lines and no near copies, and has no tokens; a null
doc_id is a value like any other. Repeated rows are copies of each other, of which near-dedup keeps one. Ties go to the
smallest doc_id, then the smallest text hash. Empty tables (documents, labels, benchmark) give empty results or let all
documents pass. Texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, lines, setsketch, toxic
from lodestone.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxic.drop_toxic(docs, toxic.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing but blank lines is left. A null text stays; n_chars follows the text."""
    out = lines.without_repeats(docs)
    changed, text = F.col("n_dropped") > 0, F.col("kept")
    out = out.where(~changed | (F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "") != ""))
    columns = lines.with_text(docs.columns, text)
    for i, c in enumerate(docs.columns):
        if c.lower() == "n_chars":
            columns[i] = F.when(changed, F.length(text)).otherwise(F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c)
    return out.select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return setsketch.keep_one(docs, percent=80, k=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.token_digests(docs, bpe.word_bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Stages with a fitted model and a sketch have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
