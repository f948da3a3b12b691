"""Review tables as CSV: written for people to mark, read back as the keys they keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def write_review(clips: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """One folder of CSV files with headings, or one for each value of by; any column order, commas and line feeds in texts are quoted."""
    clips.write.partitionBy(*by).option("header", True).option("escape", '"').csv(path)


def kept_keys(review: DataFrame) -> DataFrame:
    """ep and time_s (whole seconds) of rows marked y, yes or 1 in any case; rows whose numbers can't be read are left out."""
    marked = F.upper(F.trim("keep")).isin("Y", "YES", "1")
    out = review.where(marked).withColumns({"ep": R.number(F.col("ep"), "int"), "time_s": R.number(F.col("time_s"), "double").cast("int")})
    return out.where("ep is not null and time_s is not null").drop("keep")


def read_review(spark, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_calibration(spark, path: str) -> DataFrame:
    """Calibration tables: the first column, whatever its heading says, is label; ep, time_s and the other columns follow as text."""
    raw = read_review(spark, path)
    first, *rest = raw.columns
    return raw.select(F.col(f"`{first}`").alias("label"), *(F.col(f"`{c}`").alias("time_s" if c == "time(s)" else c) for c in rest))


def labelled(calibration: DataFrame, references: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """References with their label 1 to 3, met on key, ep and whole seconds, not on row numbers; rows without a label are left out."""
    marks = calibration.select(*key, R.number(F.trim("label"), "int").alias("label"), R.number(F.col("ep"), "int").alias("ep"), R.number(F.col("time_s"), "double").cast("int").alias("time_s"))
    marks = marks.where("label between 1 and 3").groupBy(*key, "ep", "time_s").agg(F.min("label").alias("label"))
    return references.withColumn("time_s", F.col("time_s").cast("int")).join(marks, [*key, "ep", "time_s"])


def edit_list(spark, path: str) -> DataFrame:
    """An edit list: source, src_start, src_dur, rec_start (frames) and label of each entry; entries without a source or a length are left out."""
    raw = spark.read.schema("source string, src_start long, src_dur long, rec_start long, label string").json(path)
    return raw.where(F.col("source").isNotNull() & (F.col("src_dur") > 0)).withColumn("src_start", F.coalesce("src_start", F.lit(0)))
