"""A cache of labels: frames of equal content, asked with equal words, are labelled once; later runs answer them from the cache.

Entries are Parquet under path, one folder a run: content_key (of content and prompt), label, cached_at. Two frames of a run with one
key make one call. A key that several runs wrote has the entry of the last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "content_key string, label string, cached_at timestamp"


def content_key(content: Sequence[str], prompt: str) -> Column:
    """The hash of what a frame shows and of the prompt; null and empty content differ."""
    return F.md5(F.concat(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), F.lit(prompt)))


class LabelCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def entries(self, before: int | None = None) -> DataFrame:
        """One row a key: what the last run that had it wrote, of the runs before the given one."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(f"{ENTRY}, run long").parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("run") < before)
        last = Window.partitionBy("content_key").orderBy(F.desc("run"))
        return rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "run")

    def split(self, frames: DataFrame, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """frames (with content_key) that the cache knows, with their label, and those that it does not."""
        known = self.entries(before)
        return frames.join(known.select("content_key", "label"), "content_key"), frames.join(known, "content_key", "left_anti")

    def upsert(self, labelled: DataFrame, run: int) -> None:
        """content_key and label of new entries; a run that is repeated replaces what it wrote."""
        rows = labelled.select("content_key", "label", F.current_timestamp().alias("cached_at"))
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def label(self, frames: DataFrame, call: Callable[[DataFrame], DataFrame], run: int) -> DataFrame:
        """frames with label and hit: misses are called once a key (call adds label to frames of distinct content_key), kept, and join the rest.

        A repeated run starts from what the runs before it kept, so it gives the same and keeps the same.
        """
        hits, misses = self.split(frames, run)
        self.upsert(call(misses.dropDuplicates(["content_key"])), run)
        fresh = self.spark.read.schema(ENTRY).parquet(f"{self.path}/run={run}").select("content_key", "label")
        return hits.withColumn("hit", F.lit(True)).unionByName(misses.join(fresh, "content_key").withColumn("hit", F.lit(False)))
