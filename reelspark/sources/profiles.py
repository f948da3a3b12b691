"""Story profiles: JSON, one folder a series (series_id=<id>), with plot nodes, quotes and relationships under either of their names.

What is missing, damaged or no list gives no rows. Episode ranges that hold fewer than two numbers become 0 to 0; a quote whose
episode or time can't be read keeps its text and has null there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

#: The objects of a profile.
NODES = "array<struct<`集数范围`:string,`阶段`:string,`概要`:string,`描述`:string>>"
QUOTES = "array<struct<episode:string,timestamp:string,text:string,type:string,impact:int>>"
PEOPLE = "array<struct<`姓名`:string,`身份`:string,`性格标签`:array<string>,`关键事件`:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """series_id and value, the file's text; an empty folder is an error of the caller."""
    return spark.read.text(path, wholetext=True).select(F.col("series_id").cast("string").alias("series_id"), "value")


def write_rows(profiles: DataFrame, path: str) -> None:
    """Profiles (series_id and value) of many series as JSON lines, in as many files as there are tasks; read_rows() gives what read() gives of folders."""
    profiles.select("series_id", "value").write.json(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("series_id string, value string").json(path)


def _listed(schema: str, *names: str) -> Column:
    """The first of the named lists that is there."""
    found = [F.from_json(F.get_json_object("value", f"$['{n}']"), schema) for n in names]
    return F.coalesce(*found)


def episode_range(text: Column) -> Column:
    """lo and hi of texts like "EP01-EP10"."""
    n = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    part = lambda k: F.when(F.size(n) >= 2, R.number(F.get(n, F.lit(k)), "int")).otherwise(0)
    return F.struct(F.coalesce(part(0), F.lit(0)).alias("lo"), F.coalesce(part(1), F.lit(0)).alias("hi"))


def nodes(profiles: DataFrame) -> DataFrame:
    """series_id, node_pos, stage, ep_lo, ep_hi, summary."""
    x = profiles.select("series_id", F.posexplode(_listed(NODES, "key_plot_nodes", "story_nodes", "情节节点")).alias("node_pos", "n"))
    ep = episode_range(F.col("n.集数范围"))
    told = F.coalesce(F.nullif(F.col("n.描述"), F.lit("")), F.col("n.概要"), F.lit(""))
    return x.select("series_id", "node_pos", F.coalesce("n.阶段", F.lit("")).alias("stage"), ep["lo"].alias("ep_lo"), ep["hi"].alias("ep_hi"), told.alias("summary"))


def quotes(profiles: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """series_id, ep, time_s, text, type, impact. alone: files that are a list of quotes, for series whose profile has none."""
    own = profiles.select("series_id", _listed(QUOTES, "golden_quotes").alias("q"))
    if alone is not None:
        other = alone.select("series_id", F.from_json("value", QUOTES).alias("o"))
        own = own.join(other, "series_id", "full").select("series_id", F.when(F.size("q") > 0, F.col("q")).otherwise(F.col("o")).alias("q"))
    x = own.select("series_id", F.explode("q").alias("q"))
    clock = F.split("q.timestamp", ":")
    at = R.number(F.get(clock, F.lit(0)), "int") * 60 + R.number(F.get(clock, F.lit(1)), "int")
    return x.select("series_id", R.number(F.regexp_extract("q.episode", r"(\d+)", 1), "int").alias("ep"), at.cast("double").alias("time_s"), "q.text", "q.type", F.coalesce("q.impact", F.lit(0)).alias("impact"))


def people(profiles: DataFrame) -> DataFrame:
    """series_id, name, part, traits, key_event."""
    x = profiles.select("series_id", F.explode(_listed(PEOPLE, "character_relationships", "人物关系")).alias("p"))
    return x.select("series_id", F.col("p.姓名").alias("name"), F.col("p.身份").alias("part"), F.coalesce("p.性格标签", F.array().cast("array<string>")).alias("traits"), F.col("p.关键事件").alias("key_event"))
