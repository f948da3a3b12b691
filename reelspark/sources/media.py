"""Media catalogue: which episode each file holds, by its name; contents are never read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R


def episode_name(ep: Column, template: str = "{ep}.mp4") -> Column:
    """The template with {ep}, {ep02} and {ep03} filled in; numbers are padded, never cut."""
    number = ep.cast("string")
    out = F.lit(template)
    for mark, width in (("{ep}", 0), ("{ep02}", 2), ("{ep03}", 3)):
        if mark in template:
            out = F.replace(out, F.lit(mark), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number))
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, bytes of the .mp4 files below path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(path)
    return f.select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("bytes"))


def folders(spark: SparkSession, path: str) -> DataFrame:
    """series_id, path, name, bytes of media in parts: below series_id=<id>, a folder name=<file> with what belongs to it. Sizes and paths only."""
    return in_parts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """What folders() gives, from an inventory as stores of many small files keep one: JSON lines with path and length of each file, in any number of files."""
    return in_parts(spark.read.schema("path string, length long").json(path))


def in_parts(listed: DataFrame) -> DataFrame:
    """series_id, path, name, bytes of whole media, from path and length of their parts."""
    whole = F.regexp_extract("path", r"^(.*/series_id=[^/]+/name=[^/]+)/[^/]+$", 1)
    rows = listed.select(whole.alias("path"), "length").where("path <> ''").groupBy("path").agg(F.sum("length").alias("bytes"))
    return rows.select(F.regexp_extract("path", r"/series_id=([^/]+)/name=[^/]+$", 1).alias("series_id"), "path", F.regexp_extract("path", r"/name=([^/]+)$", 1).alias("name"), "bytes")


def missing(expected: DataFrame, there: DataFrame) -> DataFrame:
    """Episodes (series_id, ep) that ought to have a file and have none."""
    return expected.select("series_id", "ep").distinct().join(there.select("series_id", "ep"), ["series_id", "ep"], "left_anti")


def episodes(found: DataFrame, template: str = "{ep}.mp4", key: Sequence[str] = ()) -> DataFrame:
    """key, ep, path, bytes: one file an episode of a key; the template's name goes before 1.mp4, 01.mp4 and 第1集.mp4, then the smaller path."""
    old = r"^(?:第)?(\d+)(?:集)?\.mp4$"
    digits = F.coalesce(F.nullif(F.regexp_extract("name", old, 1), F.lit("")), F.regexp_extract("name", r"(\d+)", 1))
    x = found.withColumn("ep", R.number(digits, "int"))

    def fits(f):  # of a name and its episode, which are worked out once a file, though the filter below moves down to the parts
        name, ep = f["name"], f["ep"]
        return F.when(name == episode_name(ep, template), 0).when(name == episode_name(ep), 1).when(name == episode_name(ep, "{ep02}.mp4"), 2).when(name == episode_name(ep, "第{ep}集.mp4"), 3).when(name.rlike(old), 4)

    x = x.withColumn("__fit", F.get(F.transform(F.array(F.struct("name", "ep")), fits), F.lit(0))).where("ep is not null and __fit is not null")
    return x.withColumn("__k", F.row_number().over(Window.partitionBy(*key, "ep").orderBy("__fit", "path"))).where("__k = 1").select(*key, "ep", "path", "bytes")
