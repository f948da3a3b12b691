"""Operators on literal rows: banding sizes, de-duplication, spacing limits, timecodes."""

from pyspark.sql import functions as F

from reelspark.functions import rules
from reelspark.operators import joins, ranks, windows


def test_band_sizes(spark):
    df = spark.range(457).select(F.lit("s").alias("k"), F.col("id"), (F.col("id") % 6).alias("v"))
    n = {r["band"]: r["count"] for r in windows.banded(df, "v", ["k"], ["id"]).groupBy("band").count().collect()}
    assert n == {5: 22, 4: 46, 3: 91, 2: 115, 1: 183}


def test_small_groups_have_a_best_row(spark):
    df = spark.createDataFrame([("a", 1, 3)], "k string, id int, v int")
    assert windows.banded(df, "v", ["k"], ["id"]).first()["band"] == 5


def test_band_cuts_are_exact(spark):
    df = spark.range(180).select(F.lit("s").alias("k"), "id", F.col("id").alias("v"))
    for banded in (windows.banded, ranks.banded):
        n = {r["band"]: r["count"] for r in banded(df, "v", ["k"], ["id"]).groupBy("band").count().collect()}
        assert n == {5: 9, 4: 18, 3: 36, 2: 45, 1: 72}  # 0.35 * 180 is 62.99 in doubles
    assert [r[0] for r in spark.createDataFrame([(90,), (1,)], "n long").select(windows.part_of(F.col("n"), 0.7)).collect()] == [63, 0]


def test_equal_deviations_tie(spark):
    ranks_of = {1: (7, 9, 12), 2: (25, 28, 30), 3: (12, 7, 9), 4: (14, 19, 17), 5: (4,)}
    df = spark.createDataFrame([(g, r) for g, rs in ranks_of.items() for r in rs], "g int, r int").repartition(3, "r")
    sd = {r["g"]: r["sd"] for r in df.groupBy("g").agg(windows.deviation("r").alias("sd")).collect()}
    assert sd[1] == sd[2] == sd[3] == sd[4] and round(sd[1], 4) == 2.5166 and sd[5] is None


def test_window_dedup(spark):
    df = spark.createDataFrame([(1, 10.0, 0), (1, 12.0, 1), (1, 30.0, 2), (2, 10.0, 3)], "ep int, t double, pos int")
    once = windows.first_in_window(df, ["ep"], F.col("t"), ["pos"], 5.0)
    assert sorted(r["pos"] for r in once.collect()) == [0, 2, 3]
    assert windows.first_in_window(once, ["ep"], F.col("t"), ["pos"], 5.0).count() == 3


def test_diverse_limits(spark):
    rows = [("s", k, 1 + k % 3, float(k * 3 % 60), "近景" if k % 2 else "特写") for k in range(40)]
    df = spark.createDataFrame(rows, "s string, rank int, ep int, time_s double, shot string")
    out = windows.diverse(df, ["s"]).collect()
    for ep in {r["ep"] for r in out}:
        times = sorted(r["time_s"] for r in out if r["ep"] == ep)
        assert len(times) <= 4 and all(b - a >= 8 for a, b in zip(times, times[1:]))


def test_spaced(spark):
    df = spark.createDataFrame([("e", x) for x in (1.0, 2.0, 4.5, 5.0, 9.0)], "k string, t double")
    assert sorted(r["t"] for r in windows.spaced(df, ["k"], "t", 3.0).collect()) == [1.0, 4.5, 9.0]


def test_not_near(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 4.9), (1, 20.0)], "ep int, t double")
    b = spark.createDataFrame([(1, 9.5)], "ep int, t double")
    assert sorted(r["t"] for r in joins.not_near(a, b, ["ep"], "t", 5.0).collect()) == [0.0, 20.0]


def test_timecode(spark):
    df = spark.createDataFrame([(3661.52,), (-2.0,)], "s double")
    assert [r[0] for r in df.select(rules.timecode(F.col("s"))).collect()] == ["01:01:01:13", "00:00:00:00"]
