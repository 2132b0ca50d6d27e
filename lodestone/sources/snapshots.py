"""Tables as versioned folders with a pointer: a commit writes a new folder, then moves the pointer.

One writer at a time. Readers keep the version they opened. Put, delete and supersede are appends to a mutation log; a commit
replays the log into the next version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import magnitude
from ..operators import state


class Snapshots:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The current version, 0 before the first commit: the largest one that is marked whole."""
        fs, p = self._fs(f"{self.root}/versions")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([0, *(int(n[5:]) for n in names if n.startswith("done-"))])

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data-{self.version() if version is None else version}")

    def commit(self, frames: DataFrame) -> int:
        """Writes the next version whole, then marks it."""
        n = self.version() + 1
        frames.write.mode("overwrite").parquet(f"{self.root}/data-{n}")
        fs, p = self._fs(f"{self.root}/versions/done-{n}")
        fs.create(p, False).close()
        return n

    def apply(self, mutations: DataFrame) -> int:
        """Commits the current frames with their state after mutations; other columns stay, new frames have nulls."""
        now = self.read()
        after = state.replay(now, mutations)
        return self.commit(after.join(now.drop("status", "superseded_by"), "frame_id", "left").select(*now.columns))


def checked_embeddings(embeddings: DataFrame, dims: int) -> DataFrame:
    """embeddings, failing on a vector of another dimension or without finite length."""
    ok = (F.size("vector") == dims) & ~F.isnan(magnitude(F.col("vector")))
    return embeddings.withColumn("vector", F.when(ok, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector does not have {dims} finite values"))))


def with_checksums(frames: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("search_text", F.lit("")), "UTF-8")
    return frames.withColumns({"payload": payload, "checksum": F.sha2(payload, 256)})
