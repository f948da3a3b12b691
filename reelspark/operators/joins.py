"""Range, interval and proximity joins; each has an equality key, so it hashes, and a bucket where ranges are wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buckets(at: str, width: float):
    """A time's bucket with both neighbours."""
    b = F.floor(F.col(at) / width)
    return F.array(b - 1, b, b + 1)


def not_near(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, seconds: float) -> DataFrame:
    """Rows of left without a row of right of the same key less than seconds away."""
    r = right.select(*key, F.col(at).alias("__at"), F.explode(buckets(at, seconds)).alias("__b")).distinct()
    on = [*(left[k].eqNullSafe(r[k]) for k in key), F.floor(left[at] / seconds) == r["__b"], F.abs(left[at] - r["__at"]) < seconds]
    return left.join(r, on, "left_anti")


def near(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, seconds: float) -> DataFrame:
    """Rows of left with a row of right of the same key at most seconds away."""
    r = right.select(*key, F.col(at).alias("__at"), F.explode(buckets(at, seconds)).alias("__b")).distinct()
    on = [*(left[k] == r[k] for k in key), F.floor(left[at] / seconds) == r["__b"], F.abs(left[at] - r["__at"]) <= seconds]
    return left.join(r, on, "left_semi")


def beside(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, seconds: float, name: str) -> DataFrame:
    """left with a flag: whether a row of right of the same key lies at most seconds away.

    Times of right meet per key and bucket, so left is joined once, a row to one row at most, and keeps its partitioning if they are few.
    """
    r = right.where(F.col(at).isNotNull()).select(*key, F.col(at).alias("__at"), F.explode(buckets(at, seconds)).alias("__b")).groupBy(*key, "__b").agg(F.collect_set("__at").alias("__at"))
    d = left.withColumn("__b", F.floor(F.col(at) / seconds)).join(r, [*key, "__b"], "left")
    hit = F.exists("__at", lambda t: F.abs(F.col(at) - t) <= seconds)
    return d.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__at", "__b")


def staged(clips: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first stage whose episode range holds the clip's episode, else '未知'. nodes: a fixed handful of rows."""
    episodes = clips.select("ep").distinct()
    first = episodes.join(F.broadcast(nodes), F.col("ep").between(F.col("ep_lo"), F.col("ep_hi"))).groupBy("ep").agg(F.min_by("stage", "node_pos").alias("story_stage"))
    return clips.join(first, "ep", "left").withColumn("story_stage", F.coalesce("story_stage", F.lit("未知")))


def speech(clips: DataFrame, cues: DataFrame, width: float = 2.5) -> DataFrame:
    """Coverage, characters a second and what follows from them, over the cues that overlap the window around each clip."""
    half, size = width / 2, 8.0
    lo, hi = F.greatest(F.lit(0.0), F.col("time_s") - half), F.col("time_s") + half
    w = clips.select("ep", "ingest_pos", "time_s", lo.alias("lo"), hi.alias("hi")).withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    c = cues.select("ep", "cue_pos", "start_s", "end_s", "chars", F.explode(F.sequence(F.floor(F.col("start_s") / size), F.floor(F.col("end_s") / size))).alias("b"))
    over = F.least("hi", "end_s") - F.greatest("lo", "start_s")
    # an overlap is counted in the bucket where it begins
    hit = w.join(c, ["ep", "b"]).withColumn("over", over).where((F.col("over") > 0) & (F.floor(F.greatest("lo", "start_s") / size) == F.col("b")))
    part = F.col("chars") * F.col("over") / F.greatest(F.lit(0.001), F.col("end_s") - F.col("start_s"))
    edge = (F.abs(F.col("start_s") - F.col("time_s")) <= 0.45) | (F.abs(F.col("end_s") - F.col("time_s")) <= 0.45)
    sums = hit.groupBy("ingest_pos").agg(F.sum("over").alias("covered"), F.sum(part).alias("total"), F.max(part).alias("peak"), F.max(edge).alias("edge"), F.count("*").alias("n"))
    span = F.greatest(F.lit(0.5), hi - lo)
    out = clips.select("ep", "ingest_pos", "time_s").join(sums, "ingest_pos", "left").fillna({"covered": 0.0, "total": 0.0, "peak": 0.0, "n": 0, "edge": False})
    out = out.withColumn("coverage", F.least(F.lit(1.0), F.col("covered") / span)).withColumn("cps", F.col("total") / span)
    peak = F.col("peak") >= 14
    return out.select(
        "ingest_pos", "ep", F.round("coverage", 3).alias("speech_coverage"), F.round("cps", 3).alias("chars_per_second"),
        F.when(F.col("total") > 0, F.greatest(F.lit(1), F.least(F.lit(5), F.bround(F.col("cps") / 2.2, 0).cast("int") + 1))).otherwise(1).alias("speech_density"),
        peak.alias("has_speech_peak"), (peak | F.col("edge") | (F.col("coverage") >= 0.72)).alias("beat_nearby"),
        F.when(F.col("n") == 0, "low").when((F.col("n") >= 2) | (F.col("coverage") >= 0.55), "high").otherwise("medium").alias("audio_event_conf"),
        F.when(F.col("edge"), "boundary").when(F.col("n") > 0, "dense_speech").otherwise("none").alias("dialogue_anchor"),
    )


def unknown(keys: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key has not been dealt with."""
    return keys.join(done.select(*on).distinct(), list(on), "left_anti")


def excerpts(clips: DataFrame, cues: DataFrame, width: float = 2.5, letters: int = 80) -> DataFrame:
    """ingest_pos, excerpt and parts: the distinct texts of the cues that overlap the window around each clip, in their order."""
    half, size = width / 2, 8.0
    lo, hi = F.greatest(F.lit(0.0), F.col("time_s") - half), F.col("time_s") + half
    w = clips.select("ep", "ingest_pos", lo.alias("lo"), hi.alias("hi")).withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    c = cues.select("ep", "cue_pos", "start_s", "end_s", "text", F.explode(F.sequence(F.floor(F.col("start_s") / size), F.floor(F.col("end_s") / size))).alias("b"))
    hit = w.join(c, ["ep", "b"]).where((F.col("start_s") < F.col("hi")) & (F.col("end_s") > F.col("lo")))
    said = hit.groupBy("ingest_pos", "text").agg(F.min("cue_pos").alias("at"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))), lambda x: x["text"])
    return said.groupBy("ingest_pos").agg(F.substring(F.array_join(parts, " "), 1, letters).alias("excerpt"), F.count("*").alias("parts"))
