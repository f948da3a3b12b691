"""Bands of a growing table: each batch of arriving rows re-ranks the keys that it touches and replaces only their buckets.

The store is a folder with rows/batch=N/bucket=B, written once and never changed, and manifest/batch=N with the buckets that batch N
wrote. A bucket's rows are those of the last batch whose manifest names it. A manifest is one small file that its writer renames into
place after the rows are there, so readers see a batch whole or not at all. A batch that is repeated after a failure starts from the
manifests before its own and writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

BUCKETS = 64


class BandStore:
    """Rows with the bands that rerank gives them, by key; ident tells a row that arrives again from a new one."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], ident: Sequence[str], rerank: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.ident, self.rerank, self.buckets = spark, path.rstrip("/"), list(key), list(ident), rerank, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """The batch that last wrote each bucket, of the batches before the given one; a row a bucket and batch."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/manifest")
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return {r["bucket"]: r["batch"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _rows(self, schema: T.StructType, last: dict[int, int]) -> DataFrame:
        """Rows of the buckets as their last batches wrote them; other buckets' folders are pruned."""
        if not last:
            return self.spark.createDataFrame([], schema)
        named = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/rows")
        by: dict[int, list[int]] = {}
        for bucket, batch in last.items():
            by.setdefault(batch, []).append(bucket)
        some = F.lit(False)
        for batch, own in by.items():
            some = some | ((F.col("batch") == batch) & F.col("bucket").isin(own))
        return named.where(some).drop("batch", "bucket")

    def apply(self, arrived: DataFrame, batch: int) -> None:
        """Take a batch in. Rows of it replace earlier ones with their ident; keys that it does not name keep their rows as they are."""
        new = self._bucketed(arrived.dropDuplicates(self.ident)).persist()
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most as many as there are buckets
        kept = [new]
        if touched:
            last = self._manifest(batch)
            schema = self.rerank(arrived.limit(0)).schema
            old = self._rows(schema, {b: last[b] for b in touched if b in last})
            keys = new.select(*self.key).distinct()
            same = old.join(keys, self.key, "left_anti")
            mixed = old.join(keys, self.key, "left_semi").select(*arrived.columns).join(new.select(*self.ident), self.ident, "left_anti").unionByName(new.select(*arrived.columns)).persist()  # read by what reranks it, more than once
            kept.append(mixed)
            out = self._bucketed(self.rerank(mixed).select(*schema.names).unionByName(same.select(*schema.names)))
            # one file a bucket and batch
            out.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        for df in kept:
            df.unpersist()

    def follow(self, arriving: DataFrame, checkpoint: str) -> StreamingQuery:
        """All that has arrived, batch by batch; the running query ends by itself."""
        return arriving.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, schema: T.StructType) -> DataFrame:
        """The rows as they are now. schema: that of reranked rows."""
        return self._rows(schema, self._manifest())
