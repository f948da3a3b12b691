"""Template ranking and story order over whole pools of candidates, as windows of one key; every choice has a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_beats(pool: DataFrame, key: Sequence[str], score: str, tie: str, top_n: Column, beat: str, stage: str, ep: str, at: str, beats: Sequence[str], forced: Column) -> DataFrame:
    """The clips that a template uses, with pos: each beat's share of the best, the rest filled up by stage, at most top_n.

    beats: beat names in their order; the map column `beats` has each one's share. What is left is filled by how often its
    stage has been chosen, rare ones first and unchosen ones last, then by score. The best clip for which forced holds comes
    first, chosen or not. Then one clip each 5 s of an episode stays; places that this frees go to what was dropped, one each 3 s.
    """
    w = Window.partitionBy(*key)
    best = w.orderBy(F.desc(score), tie)
    d = pool.withColumns({"__r": F.row_number().over(best), "__n": F.least(top_n, F.count("*").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))})
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(*key, beat).orderBy("__r")))
    share = F.coalesce(F.col("beats")[F.col(beat)], F.lit(0.0))
    d = d.withColumn("__in", (share > 0) & (F.col("__k") <= F.greatest(F.lit(1), F.bround(F.col("__n") * share, 0))))
    used = F.sum(F.col("__in").cast("int")).over(Window.partitionBy(*key, stage))
    place = F.create_map(*(F.lit(x) for k, b in enumerate(beats) for x in (b, k)))
    d = d.withColumns({"__c": F.sum(F.col("__in").cast("int")).over(w), "__use": F.when((used > 0) & (F.coalesce(F.col(stage), F.lit("")) != ""), used).otherwise(99)})
    d = d.withColumn("__f", F.row_number().over(Window.partitionBy(*key, "__in").orderBy("__use", "__r")))
    d = d.withColumn("__head", F.coalesce(F.col("__r") == F.min(F.when(forced, F.col("__r"))).over(w), F.lit(False)))
    d = d.where(F.col("__in") | (F.col("__f") <= F.col("__n") - F.col("__c")) | F.col("__head"))
    order = [F.desc("__head"), F.desc("__in"), F.when(F.col("__in"), F.coalesce(place[F.col(beat)], F.lit(9))).otherwise(F.col("__use")), "__r"]
    d = d.withColumn("__p", F.row_number().over(w.orderBy(*order)))
    one = lambda seconds, *more: F.row_number().over(Window.partitionBy(*key, ep, F.bround(F.col(at) / seconds, 0), *more).orderBy("__p")) == 1
    d = d.withColumn("__s", one(5)).withColumn("__d", one(3, "__s")).where("__s or __d")
    d = d.withColumn("__q", F.row_number().over(w.orderBy(F.desc("__s"), "__p"))).where("__q <= __n")
    return d.withColumnRenamed("__q", "pos").drop("__r", "__n", "__k", "__in", "__c", "__use", "__f", "__head", "__p", "__s", "__d")


def in_story_order(chosen: DataFrame, key: Sequence[str], stage: str, order: str, ep: str = "ep", at: str = "time_s", hook: str = "hook_value", flow: str = "flow") -> DataFrame:
    """Adds place: stages in the template's flow, the first by time, the others by hook; fewer than three clips keep their order.

    Of five or more, the last fifth must hold the flow's last stage if any clip has it. The earliest clip of episode 1's first
    minute opens.
    """
    w = Window.partitionBy(*key)
    n, s = F.count("*").over(w), F.col(stage)
    known = F.array_position(flow, s)
    keys = [known == 0, F.when(known > 0, known).otherwise(s), F.when((s == 1) & (known > 0), F.col(ep)), F.when((s == 1) & (known > 0), F.col(at)), F.when((s != 1) | (known == 0), -F.col(hook)), F.col(order)]
    d = chosen.withColumns({"__n": n, "__few": n < 3}).withColumn("__a", F.when(F.col("__few"), F.row_number().over(w.orderBy(order))).otherwise(F.row_number().over(w.orderBy(*keys))))
    fifth = F.floor(F.col("__n") / 5)
    last = s == F.element_at(flow, -1)
    held = F.max(F.when(last & (F.col("__a") > F.col("__n") - F.greatest(F.lit(1), fifth)), 1)).over(w)
    mover = F.max(F.when(last & (F.col("__a") <= F.col("__n") - fifth), F.col("__a"))).over(w)
    d = d.withColumn("__m", F.when((F.col("__n") >= 5) & held.isNull(), mover))
    d = d.withColumn("__b", F.when(F.col("__a") == F.col("__m"), F.col("__n")).when(F.col("__a") > F.col("__m"), F.col("__a") - 1).otherwise(F.col("__a")))
    early = (F.col(ep) == 1) & (F.col(at) < 60) & ~F.col("__few")
    first = F.min(F.when(early, F.struct(at, "__b"))).over(w)["__b"]
    d = d.withColumn("__c", F.when(F.col("__b") == first, 0).otherwise(F.col("__b")))
    return d.withColumn("place", F.row_number().over(w.orderBy("__c"))).drop("__n", "__few", "__a", "__m", "__b", "__c")
