"""Places within a key that no single task has to number: two passes over a range partitioning instead of one window a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import new_folder
from .windows import CUTS, part_of

#: Rows of one key that one task numbers by a window; a table with a larger key is numbered in two passes.
ROWS_A_TASK = 2_000_000
_ROW = (1 << 33) - 1


def _names(order: Sequence) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in order]


def largest(df: DataFrame, key: Sequence[str]) -> int:
    """The number of rows of the largest key."""
    return df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0


def numbered(df: DataFrame, key: Sequence[str], order: Sequence, at: str = "place", n: str = "n", rows: int = ROWS_A_TASK, largest_key: int | None = None) -> DataFrame:
    """df with each row's place in its key, from 0, in the given order, and the key's number of rows.

    Keys of up to rows rows are numbered by one window. Where a key has more, all rows are dealt by ranges of key and order, so a
    large key lies in many tasks, sorted and numbered within their task; prefix counts of the tasks (a row a task) make places in
    the whole of these, and the first place of each key makes places in the key. Rows equal in key and order may come either way.
    largest_key: what largest() gives, if the caller knows it.
    """
    if (largest(df, key) if largest_key is None else largest_key) <= rows:
        w = Window.partitionBy(*key)
        return df.withColumns({at: (F.row_number().over(w.orderBy(*_names(order))) - 1).cast("long"), n: F.count("*").over(w)})
    return spread(df, key, order, at, n)


def spread(df: DataFrame, key: Sequence[str], order: Sequence, at: str = "place", n: str = "n") -> DataFrame:
    """numbered() in two passes, whatever the keys' sizes."""
    spark, there = df.sparkSession, new_folder(df.sparkSession, "ranks")
    by = [F.col(k) for k in key] + _names(order)
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    dealt.write.parquet(there)  # ranges are cut by a sample, so they are cut once
    rows = spark.read.schema(dealt.schema).parquet(there)
    task, own = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit(_ROW))
    sizes = rows.groupBy(task.alias("__task")).agg(F.count("*").alias("__size"))  # a row a task
    before = sizes.withColumn("__before", F.sum("__size").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))).select("__task", F.coalesce("__before", F.lit(0)).alias("__before"))
    whole = rows.withColumn("__task", task).join(F.broadcast(before), "__task").withColumn("__whole", F.col("__before") + own).drop("__task", "__before", "__id")
    firsts = whole.groupBy(*(F.col(k).alias(f"__{k}") for k in key)).agg(F.min("__whole").alias("__first"), F.count("*").alias(n))
    on = [whole[k].eqNullSafe(firsts[f"__{k}"]) for k in key]
    return whole.join(firsts, on).withColumn(at, F.col("__whole") - F.col("__first")).drop("__whole", "__first", *(f"__{k}" for k in key))


def band(at: Column, n: Column) -> Column:
    """Bands 5 to 1 of a place from 0 among n; each cut is at least one row."""
    out = F.lit(1)
    for b, share in zip((2, 3, 4, 5), reversed(CUTS), strict=True):
        out = F.when(at < F.greatest(F.lit(1), part_of(n, share)), b).otherwise(out)
    return out.cast("int")


def banded(df: DataFrame, value: str, key: Sequence[str], tie: Sequence[str], name: str = "band", rows: int = ROWS_A_TASK, largest_key: int | None = None) -> DataFrame:
    """Bands 5 to 1 by descending rank within the key, ties in the order of tie; keys of more than rows rows are spread over tasks."""
    return numbered(df, key, [F.desc(value), *tie], "__at", "__n", rows, largest_key).withColumn(name, band(F.col("__at"), F.col("__n"))).drop("__at", "__n")
