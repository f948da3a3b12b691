"""Ranking, banding, de-duplication and order-dependent steps, all keyed so that no window spans the whole table."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a group, best first, that bands 5, 4, 3, 2 end at.
CUTS = (0.05, 0.15, 0.35, 0.60)


def part_of(n: Column, share: float) -> Column:
    """The whole part of n times a share of whole hundredths, exactly: 0.35 of 180 is 63, which floor(n * 0.35) in doubles misses."""
    return F.floor(n * F.lit(round(share * 100)) / 100)


def banded(df: DataFrame, value: str, key: Sequence[str], tie: Sequence[str], name: str = "band") -> DataFrame:
    """Bands 5 to 1 by descending rank within the key; ties in the order of tie; each cut is at least one row."""
    w = Window.partitionBy(*key).orderBy(F.desc(value), *tie)
    rank = F.row_number().over(w) - 1
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # in the same order, so that both share a pass
    band = F.lit(1)
    for b, share in zip((2, 3, 4, 5), reversed(CUTS), strict=True):
        band = F.when(rank < F.greatest(F.lit(1), part_of(n, share)), b).otherwise(band)
    return df.withColumn(name, band.cast("int"))


def first_in_window(df: DataFrame, key: Sequence[str], seconds: Column, order: Sequence, width: float) -> DataFrame:
    """The first row, in the given order, of each key and half-even rounded time window."""
    w = Window.partitionBy(*key, F.bround(seconds / width, 0)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def repeats(df: DataFrame, key: Sequence[str], order: Sequence, value: str, alternate: bool = False) -> DataFrame:
    """Rows whose value equals that of the row before them in the key's order: in a run all but the first; alternate: every second one."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("__same", F.coalesce(F.col(value) == F.lag(value).over(w), F.lit(False)))
    if not alternate:
        return d.where("__same").drop("__same")
    d = d.withColumn("__run", F.sum(F.when(F.col("__same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(*key, "__run").orderBy(*order))
    return d.withColumn("__at", at).where("__at % 2 = 0").drop("__same", "__run", "__at")


def top(df: DataFrame, key: Sequence[str], order: Sequence, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= n)


def capped_rank(df: DataFrame, group: Sequence[str], capped: str, order: Sequence, per: int, n: int) -> DataFrame:
    """At most per rows of each capped value, then the first n of the group: what the greedy loop over a sorted list keeps."""
    few = top(df, [*group, capped], order, per, "__k").drop("__k")
    return top(few, group, order, n)


def deviation(rank: str) -> Column:
    """stddev_samp of whole numbers from whole sums, so that groups whose spread is equal tie in every order of their rows; null for a single row."""
    n, s = F.count(rank), F.sum(F.col(rank).cast("long"))
    squares = F.sum(F.col(rank).cast("long") * F.col(rank))
    return F.when(n > 1, F.sqrt((n * squares - s * s) / (n * (n - 1))))


def running(df: DataFrame, key: Sequence[str], order: Sequence, amount: Column, name: str) -> DataFrame:
    """The sum of amount over the rows before."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0.0)))


def spaced(df: DataFrame, key: Sequence[str], at: str, gap: float, after: float | None = None) -> DataFrame:
    """Per key, the ascending times that lie more than gap after the last one kept; after: times up to it don't count.

    Times stream by in order of key and time; a task holds the last one kept.
    """
    names = [*key, at]

    def thin(frames):
        now, last = None, None
        for f in frames:
            out = []
            for *k, t in f[names].itertuples(index=False):
                if k != now or t - last > gap:
                    now, last = k, t
                    out.append((*k, t))
            yield pd.DataFrame(out, columns=names)

    rows = df.select(*key, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull())
    if after is not None:
        rows = rows.where(F.col(at) > after)
    return rows.repartition(*key).sortWithinPartitions(*names).mapInPandas(thin, rows.schema)


def one_row(rank: str = "rank", scene: str | None = None) -> Column:
    """What the variety fold reads of a clip; scenes count by their first ten letters."""
    skey = F.substring(F.coalesce(F.col(scene), F.lit("")), 1, 10) if scene else F.lit("")
    return F.struct(F.col(rank).cast("int").alias("rank"), F.col("ep").cast("int").alias("ep"), F.col("time_s").cast("double").alias("t"), F.coalesce("shot", F.lit("")).alias("shot"), skey.alias("scene"))


def varied(rows: str, target: Column, per_ep: int = 4, same_shot: int = 2, apart: float = 8.0, per_scene: int = 2) -> Column:
    """The rows (an array column of one_row() by rank) that a greedy choice keeps, in the order of choice.

    At most per_ep clips an episode, same_shot equal shots in a row, apart seconds between clips of an episode, per_scene clips
    of a scene; it ends at target. A second pass adds a clip for each of six episode ranges that has none.
    """
    eps = F.transform(rows, lambda x: x["ep"])
    lo = F.array_min(eps)
    width = F.greatest(F.lit(1), F.floor((F.array_max(eps) - lo + 1) / 6)).cast("int")

    def fits(out, x):
        same = F.filter(out, lambda o: o["ep"] == x["ep"])
        last = F.slice(out, F.greatest(F.lit(1), F.size(out) - (same_shot - 1)), F.lit(same_shot))
        row = (F.size(out) >= same_shot) & F.forall(last, lambda o: o["shot"] == x["shot"])
        crowd = (x["scene"] != "") & (F.size(F.filter(out, lambda o: o["scene"] == x["scene"])) >= per_scene)
        return (F.size(same) < per_ep) & ~row & F.forall(same, lambda o: F.abs(o["t"] - x["t"]) >= apart) & ~crowd

    add = lambda out, x: F.concat(out, F.array(x))
    first = F.aggregate(rows, F.filter(rows, lambda _: F.lit(False)), lambda out, x: F.when((F.size(out) < target) & fits(out, x), add(out, x)).otherwise(out))

    def second(lo, width):
        bucket = lambda x: F.least(F.lit(5), F.floor((x["ep"] - lo) / width).cast("int"))
        covered = lambda out, x: F.exists(out, lambda o: bucket(o) == bucket(x))
        return F.aggregate(rows, first, lambda out, x: F.when(~covered(out, x) & fits(out, x), add(out, x)).otherwise(out))

    return F.get(F.transform(F.array(F.struct(lo.alias("lo"), width.alias("width"))), lambda z: second(z["lo"], z["width"])), F.lit(0))


def diverse(ranked: DataFrame, key: Sequence[str], rank: str = "rank", scene: str | None = None, target: str | None = None, **limits) -> DataFrame:
    """Greedy selection under varied()'s limits over each key's ranked, already cut list. Adds taken, the order of choice."""
    g = ranked.groupBy(*key).agg(F.array_sort(F.collect_list(one_row(rank, scene))).alias("__all"), (F.min(target) if target else F.lit(1 << 30)).cast("int").alias("__target"))
    chosen = g.select(*key, F.posexplode(varied("__all", F.col("__target"), **limits)).alias("taken", "__x")).select(*key, (F.col("taken") + 1).alias("taken"), F.col("__x.rank").alias(rank))
    return ranked.join(chosen, [*key, rank])


def batches(lines: DataFrame, key: str, order: Sequence[str], text: str, size: int = 25_000) -> DataFrame:
    """Each key's lines, in order and joined by line feeds, cut into texts of at most size characters: key, batch, text.

    A batch ends behind the last line feed past its half, else at its full size. Lines stream by in key order, so a task holds
    one open batch and one line, however long a key's text is. Null lines are left out.
    """

    def cut(frames):
        now, held, n = None, "", -1
        for f in frames:
            out = []
            for k, line in zip(f[key].tolist(), f[text].tolist(), strict=True):
                if n >= 0 and k == now:
                    held += "\n" + line
                else:
                    if n >= 0:
                        out.append((now, n, held))
                    now, held, n = k, line, 0
                begin = 0
                while len(held) - begin > size:
                    feed = held.rfind("\n", begin, begin + size)
                    end = feed + 1 if feed > begin + size // 2 else begin + size
                    out.append((now, n, held[begin:end]))
                    begin, n = end, n + 1
                held = held[begin:]
            yield pd.DataFrame(out, columns=[key, "batch", "text"])
        if n >= 0:
            yield pd.DataFrame([(now, n, held)], columns=[key, "batch", "text"])

    kind = lines.schema[key].dataType.simpleString()
    some = lines.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, *order, text)
    return some.repartition(key).sortWithinPartitions(key, *order).mapInPandas(cut, f"{key} {kind}, batch int, text string")


def stretched(cuts: DataFrame, key: Sequence[str], order: str, dur: str, longest: str, target: str) -> DataFrame:
    """Where a key's clips fill less than 0.8 of the target, lengthen them in order until 0.9 is reached.

    Each takes at most twice its even share of what is missing and at most 1.5 times the longest. Groups are bounded by the
    rank cut before.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.struct(*[c for c in cuts.columns if c not in key]).alias("r"))))
    start = F.struct(F.lit(0.0).alias("need"), F.array().cast("array<double>").alias("durs"))

    def step(acc, x):
        room = x["r"][longest] * 1.5 - x["r"][dur]
        add = F.when((acc["need"] > 0) & (room > 0), F.least(room, acc["need"] / F.size("__rows") * 2)).otherwise(0.0)
        return F.struct((acc["need"] - add).alias("need"), F.concat(acc["durs"], F.array(F.round(x["r"][dur] + add, 1))).alias("durs"))

    g = cuts.groupBy(*key).agg(rows.alias("__rows"), F.sum(dur).alias("__sum"), F.min(target).cast("double").alias("__target"))
    need = F.when(F.col("__sum") < F.col("__target") * 0.8, F.col("__target") * 0.9 - F.col("__sum")).otherwise(0.0)
    g = g.withColumn("__durs", F.aggregate("__rows", start.withField("need", need), step, lambda a: a["durs"]))
    one = g.select(*key, F.posexplode("__rows").alias("__k", "__x"), "__durs")
    return one.select(*key, "__x.r.*", F.get("__durs", F.col("__k")).alias("stretched_s"))


def key_times(points: DataFrame, key: Sequence[str], at: str, duration: str, frames: Sequence[int] = (4, 7, 10)) -> DataFrame:
    """The seconds at which each key's frames are taken: key, time_s.

    Near both ends, and per bucket of the duration the first scene point in it, else its centre; without any point, at fixed shares;
    times under five seconds apart become their mean; at most as many as the duration's class has frames. points: one row a scene
    point, at null where a key has none. Points meet per key and bucket, so what a key collects is bounded by its frames.
    """
    d = F.col(duration)
    most = F.when(d < 90, frames[0]).when(d < 180, frames[1]).otherwise(frames[2])
    inside = lambda t: (t > 1.0) & (t < d - 1)
    p = points.withColumn("__most", most).withColumn("__b", F.least(F.floor(F.col(at) / (d / (F.col("__most") - 2))), F.col("__most") - 3))
    p = p.groupBy(*key, duration, "__most", "__b").agg(F.min(F.when(inside(F.col(at)), F.col(at))).alias("__t"), F.count(at).alias("__n"))
    g = p.groupBy(*key, duration, "__most").agg(F.map_from_entries(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("__b", "__t")))).alias("__first"), F.sum("__n").alias("__n"))
    size = d / (F.col("__most") - 2)
    filled = F.transform(F.sequence(F.lit(0), F.col("__most") - 3), lambda k: F.bround(F.coalesce(F.col("__first")[k.cast("long")], (k + 0.5) * size), 1))
    # Shares of the duration, by class, where there are no scene points.
    plan = F.when(d < 90, F.array(*map(F.lit, (0.25, 0.50, 0.75)))).when(d < 180, F.array(*map(F.lit, (0.15, 0.30, 0.50, 0.70, 0.85)))).otherwise(F.array(*map(F.lit, (0.10, 0.22, 0.35, 0.50, 0.60, 0.75, 0.90))))
    times = F.filter(F.when(F.col("__n") > 0, filled).otherwise(F.transform(plan, lambda s: F.bround(d * s, 1))), inside)
    ends = F.when(d > 5, F.array(F.lit(2.0), F.bround(d - 2, 1))).otherwise(F.array(F.lit(2.0)))
    merge = lambda kept, t: F.when(
        (F.size(kept) == 0) | (t - F.element_at(kept, -1) >= 5.0), F.concat(kept, F.array(t))
    ).otherwise(F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.bround((F.element_at(kept, -1) + t) / 2, 1))))
    merged = F.aggregate(F.array_sort(F.array_distinct(F.concat(ends, times))), F.array().cast("array<double>"), merge)
    return g.select(*key, F.explode(F.slice(merged, 1, F.col("__most"))).alias("time_s"))


def narrative_mix(ranked: DataFrame, key: Sequence[str], order: Sequence, role: str, shares: dict[str, float], n: int = 8) -> DataFrame:
    """n rows of each key: the best of each role, then each role's share, then the best of the rest. Adds pos, by the roles' order."""
    w = Window.partitionBy(*key)
    quota = F.create_map(*(F.lit(x) for k, s in shares.items() for x in (k, max(1, round(n * s)))))
    beat = F.create_map(*(F.lit(x) for k, r in enumerate(shares) for x in (r, k)))
    r = ranked.withColumn("__k", F.row_number().over(Window.partitionBy(*key, role).orderBy(*order)))
    tier = F.when(F.col("__k") == 1, 0).when(F.col("__k") <= F.coalesce(quota[F.col(role)], F.lit(1)), 1).otherwise(2)
    few = r.withColumn("__tier", tier).withColumn("__n", F.row_number().over(w.orderBy("__tier", *order))).where(F.col("__n") <= n)
    return few.withColumn("pos", F.row_number().over(w.orderBy(F.coalesce(beat[F.col(role)], F.lit(9)), *order))).drop("__k", "__tier", "__n")


def episode_spread(chosen: DataFrame, pool: DataFrame, key: Sequence[str], role: str, rank: str, long: int = 50) -> DataFrame:
    """chosen, with clips swapped so that each third of a long story is there: per key, at most one swap a third.

    A third without a clip takes the pool's best of it, for the first chosen clip of the same role whose own third keeps another.
    Keys whose last episode is at most long stay as they are. Both have key, role, rank and ep; a group holds the chosen rows and
    three more.
    """
    ends = pool.groupBy(*key).agg(F.max("ep").alias("__max"))
    third = F.when(F.col("ep") <= F.floor(F.col("__max") * 0.33), 0).when(F.col("ep") <= F.floor(F.col("__max") * 0.66), 1).otherwise(2)
    placed = lambda df: df.join(ends, list(key)).withColumn("__third", F.when(F.col("ep") > 0, third).otherwise(-1))
    best = top(placed(pool.select(*chosen.columns)).where((F.col("__third") >= 0) & (F.col("__max") > long)), [*key, "__third"], [rank], 1, "__k").drop("__k")
    both = placed(chosen).withColumn("__in", F.lit(True)).unionByName(best.withColumn("__in", F.lit(False)))
    columns = chosen.columns

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf[pdf["__in"]].sort_values(rank).to_dict("records")
        for k in range(3):
            spare = pdf[~pdf["__in"] & (pdf["__third"] == k)].to_dict("records")
            thirds = [r["__third"] for r in kept]
            if not spare or k in thirds:
                continue
            out = next((j for j, r in enumerate(kept) if r[role] == spare[0][role] and thirds.count(r["__third"]) > 1), None)
            if out is not None:
                kept = [*kept[:out], *kept[out + 1 :], spare[0]]
        return pd.DataFrame(kept, columns=columns)

    return both.groupBy(*key).applyInPandas(swap, chosen.schema)
