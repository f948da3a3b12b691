"""Joins of intervals, points and stages, all within a key such as series and episode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one side in one bucket of a key beyond which the bucket is dealt over several tasks.
BUCKET_ROWS = 50_000


def overlapping(left: DataFrame, right: DataFrame, key: Sequence[str], width: float, most: int = BUCKET_ROWS) -> DataFrame:
    """Pairs of rows of equal keys whose spans overlap, each once: all columns of both, lo and hi of left, from and to of right.

    Spans are cut into buckets of a width, so both sides hash on key and bucket; a pair counts in the bucket where its overlap
    begins. A bucket with more than most rows on a side is dealt over a grid: that side's rows go to one of its parts each, and to
    every part of the other. Rows with a null key or bound, and those that end before they begin, meet nothing.
    """
    cut = lambda df, a, b: df.where(F.col(a) <= F.col(b)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))
    x, y = cut(left, "lo", "hi"), cut(right, "from", "to")
    on = [*key, "__b"]
    parts = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / most).alias(name)).where(F.col(name) > 1)
    hot = parts(x, "__p").join(parts(y, "__q"), on, "full").fillna(1, ["__p", "__q"])
    if hot.limit(1).count():
        x, y = x.join(hot, on, "left").fillna(1, ["__p", "__q"]), y.join(hot, on, "left").fillna(1, ["__p", "__q"])
        own = lambda df, n: F.pmod(F.xxhash64(*(c for c in df.columns if not c.startswith("__"))), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
        x = x.withColumn("__r", own(x, "__p")).withColumn("__s", every("__q")).drop("__p", "__q")
        y = y.withColumn("__s", own(y, "__q")).withColumn("__r", every("__p")).drop("__p", "__q")
        on = [*on, "__r", "__s"]
    begins = F.greatest("lo", "from")
    return x.join(y, on).where((begins < F.least("hi", "to")) & (F.floor(begins / width) == F.col("__b"))).drop("__b", "__r", "__s")


def stabbed(rows: DataFrame, stages: DataFrame, key: Sequence[str], at: str, default: str) -> DataFrame:
    """rows with story_stage: the first stage of the key, by node_pos, whose span ep_lo to ep_hi holds at, else the default.

    Only distinct points of a key meet its stages.
    """
    points = rows.select(*key, at).distinct()
    first = points.join(stages, list(key)).where(F.col(at).between(F.col("ep_lo"), F.col("ep_hi"))).groupBy(*key, at).agg(F.min_by("stage", "node_pos").alias("story_stage"))
    return rows.join(first, [*key, at], "left").withColumn("story_stage", F.coalesce("story_stage", F.lit(default)))


def _level(x: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(1), F.least(F.lit(5), F.bround(x, 0).cast("int") + 1))).otherwise(1)


def speech_features(clips: DataFrame, cues: DataFrame, key: Sequence[str], clip: str = "ingest_pos", width: float = 2.5, letters: int = 80, most: int = BUCKET_ROWS) -> DataFrame:
    """What is said in the window around each clip, by the cues of its own key: how much, how fast, how loud that sounds, and its text."""
    half, peak_chars, busy = max(0.5, width / 2), 14, 0.72
    w = clips.select(*key, clip, "time_s", F.greatest(F.lit(0.0), F.col("time_s") - half).alias("lo"), (F.col("time_s") + half).alias("hi"))
    c = cues.select(*key, "cue_pos", "text", "chars", F.col("start_s").alias("from"), F.col("end_s").alias("to"))
    hit = overlapping(w, c, key, 8.0, most)
    over = F.least("hi", "to") - F.greatest("lo", "from")
    part = F.col("chars") * (over / F.greatest(F.lit(0.001), F.col("to") - F.col("from")))
    edge = (F.abs(F.col("from") - F.col("time_s")) <= 0.45) | (F.abs(F.col("to") - F.col("time_s")) <= 0.45)
    hit = hit.select(*key, clip, "cue_pos", "text", over.alias("over"), part.alias("part"), edge.alias("edge"))
    sums = hit.groupBy(*key, clip).agg(F.sum("over").alias("covered"), F.sum("part").alias("total"), F.max("part").alias("peak"), F.max("edge").alias("edge"), F.count("*").alias("n"))
    said = hit.where(F.coalesce("text", F.lit("")) != "").groupBy(*key, clip, "text").agg(F.min("cue_pos").alias("at"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    said = said.groupBy(*key, clip).agg(F.substring(F.regexp_replace(F.trim(text), r"\s+", " "), 1, letters).alias("excerpt"))
    out = w.join(sums, [*key, clip], "left").join(said, [*key, clip], "left").fillna({"covered": 0.0, "total": 0.0, "peak": 0.0, "n": 0, "edge": False, "excerpt": ""})
    span = F.greatest(F.lit(0.5), F.col("hi") - F.col("lo"))
    out = out.withColumns({"coverage": F.least(F.lit(1.0), F.col("covered") / span), "cps": F.col("total") / span})
    peak = F.col("peak") >= peak_chars
    return out.select(
        *key, clip, F.round("coverage", 3).alias("speech_coverage"), F.round("cps", 3).alias("chars_per_second"),
        _level(F.col("cps") / 2.2, F.col("total")).alias("speech_density"), _level(F.col("coverage") * 2.2 + F.col("cps") / 3.5, F.col("total")).alias("audio_energy"),
        peak.alias("has_speech_peak"), (peak | F.col("edge") | (F.col("coverage") >= busy)).alias("beat_nearby"), F.col("excerpt").alias("transcript_excerpt"),
        F.when(F.col("n") == 0, "low").when((F.col("n") >= 2) | (F.col("coverage") >= 0.55), "high").otherwise("medium").alias("audio_event_conf"),
        F.when(F.col("edge"), "boundary").when(F.col("n") > 0, "dense_speech").otherwise("none").alias("dialogue_anchor"),
    )
