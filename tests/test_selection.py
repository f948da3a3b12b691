"""Enrichment, ranking, variety, order and scaling: literal rows and what must hold of every output."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions import enrichment as E
from reelspark.functions import rules as R
from reelspark.functions import selection as S
from reelspark.functions import words
from reelspark.operators import ranking as K
from reelspark.operators import windows as W
from reelspark.plans import dims, documents, genres, reviewing, selection

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cuts(spark):
    return selection.cuts(spark, DATA).toPandas()


def test_decisions_of_a_strong_clip(spark):
    row = {
        "event": "冲突", "event_subtype": "无", "mood": "紧张", "shot": "特写", "desc_clean": "他抓住对方衣领，怒吼着把人按住在墙上", "props": "", "scene": "院子", "subtitle_text": "你敢动她试试", "chars_text": "", "reject_reason": "低质量", "event_conf": "可见",
        "visual_quality": 4, "emotion": 5, "action_level": 3, "action_direction": "增强", "emotion_trend": "上升", "face_quality": "正脸", "has_speech_peak": True, "beat_nearby": False, "transcript_excerpt": "你敢", "dialogue_anchor": "boundary", "audio_energy": 3, "speech_density": 4,
        "composition_type": "引导线", "light_beauty": "电影级", "color_palette": "暖",
    }
    r = E.decided(spark.createDataFrame([row])).first()
    assert (r["reject_reason"], r["event_subtype"], r["promo_value"], r["hook_value"], r["action_level"], r["action_value"]) == ("无", "抓扯", 5, 5, 4, 3)
    assert (r["aesthetic_score"], r["cinematic_beauty"], r["dialogue_value"], r["rhythm_value"], r["audio_hook_value"], r["cut_anchor"]) == (10, 5, 5, 4, 5, "dialogue")
    assert (r["first_role"], r["best_cut"], r["pre_roll"], r["suggested_duration"], r["conflict_side"]) == ("hook", "on_action", 0.5, 2.5, "单人爆发")


@pytest.mark.parametrize("given,quality,shot,subtitle,blob,conf,want", [
    ("低质量", 2, "近景", "", "", "可见", "低质量"), ("低质量", 3, "近景", "", "", "可见", "无"), ("纯文字", 4, "近景", "短", "", "可见", "无"), ("纯文字", 4, "空镜", "短", "", "可见", "纯文字"),
    ("无", 4, "近景", "", "网络剧片许可证", "可见", "片头"), ("无", 2, "空镜", "", "", "可见", "空镜"), ("无", 4, "近景", "十二个字以上的一段字幕文字在这里", "文字卡", "可见", "纯文字"), ("无", 2, "近景", "", "", "模糊", "模糊"), ("无", 4, "近景", "", "似乎在笑", "可见", "推测污染"),
])
def test_reject_rules(spark, given, quality, shot, subtitle, blob, conf, want):
    d = spark.createDataFrame([(given, quality, shot, subtitle, blob, conf)], "reject_reason string, visual_quality int, shot string, subtitle_text string, desc_clean string, event_conf string")
    assert d.select(E.reject(F.col("desc_clean"))).first()[0] == want


def test_exposure_and_length():
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    d = s.createDataFrame([(250.0, 9.0), (5.0, 9.0), (15.0, 0.5), (240.0, 0.5), (128.0, 0.1)], "m double, s double")
    assert [r[0] for r in d.select(E.exposure(F.col("m"), F.col("s"))).collect()] == ["白屏", "黑屏", "低质量", "低质量", "无"]


def test_selection_keeps_its_limits(cuts):
    for (_, _), g in cuts.groupby(["series_id", "mol_type"]):
        if g["rung"].iloc[0] not in ("strict", "relaxed"):
            continue
        strict = g["rung"].iloc[0] == "strict"
        own = g.assign(ep=g["ep"].where(g["ingest_pos"] % 9 != 0, g["ep"] - 76)).sort_values("taken")
        assert own.groupby("ep").size().max() <= (4 if strict else 6)
        for _, e in own.groupby("ep"):
            t = sorted(e["time_s"])
            assert all(b - a >= (8 if strict else 3) for a, b in zip(t, t[1:]))
        assert own.groupby(own["scene"].str[:10]).size().max() <= 2
        shots, same = own["shot"].tolist(), 2 if strict else 3
        assert all(len(set(shots[k : k + same + 1])) > 1 for k in range(len(shots) - same))


def test_timeline_adds_up(cuts):
    for _, g in cuts.groupby(["series_id", "mol_type"]):
        g = g.sort_values("place")
        assert g["place"].tolist() == list(range(1, len(g) + 1)) and g["offset_s"].is_monotonic_increasing
        assert g["offset_s"].iloc[-1] == pytest.approx((g["cut_s"].iloc[:-1] - 0.3).clip(lower=0).sum(), abs=1e-2)
        assert (g["cut_s"] <= 1.5 * g["dur_hi"] + 0.051).all() and (g["cut_s"] >= g["dur_s"] - 1e-9).all()


def test_forced_opening_and_spacing(spark):
    rows = [(k, 1, float(k * 20), f, s, 10.0 - k, forced, {"hook": 0.5, "rising": 0.5}) for k, (f, s, forced) in enumerate([("rising", "a", False), ("rising", "a", False), ("hook", "b", False), ("rising", "b", False), ("rising", "c", True), ("rising", "c", False)])]
    d = spark.createDataFrame(rows, "id long, ep int, t double, nf string, st string, score double, forced boolean, beats map<string,double>").withColumn("k", F.lit("x"))
    got = K.by_beats(d, ["k"], "score", "id", F.lit(4), "nf", "st", "ep", "t", ["hook", "rising"], F.col("forced")).orderBy("pos").collect()
    assert [r["id"] for r in got] == [4, 2, 0, 1]


def test_story_order_moves(spark):
    rows = [(1, 50, 9.0, 3, 5), (2, 30, 9.0, 3, 4), (3, 99, 9.0, 0, 3), (4, 98, 9.0, 0, 2), (5, 1, 40.0, 1, 1), (6, 2, 9.0, 1, 5)]
    d = spark.createDataFrame(rows, "taken int, ep int, time_s double, st int, hook_value int").withColumns({"k": F.lit("x"), "flow": F.array(*map(F.lit, (1, 2, 3)))})
    got = [r["taken"] for r in K.in_story_order(d, ["k"], "st", "taken").orderBy("place").collect()]
    assert got == [5, 6, 1, 3, 4, 2]  # the earliest of episode 1 opens; the last stage gets the last fifth


def test_scaling(spark):
    t = dims.molecules(spark).where("mol_type = 'hook_clash'")
    same, twice, short = (S.scaled(t.withColumn("s", F.lit(n)), "s").first() for n in (90, 180, 45))
    assert (same["min_clips"], same["dur_lo"], same["beats"]) == (15, 3.0, {"hook": 0.4, "inciting": 0.4, "rising": 0.2})
    assert (twice["min_clips"], twice["max_clips"], twice["dur_lo"], twice["dur_hi"]) == (30, 70, 4.2, 8.5) and (short["min_clips"], short["dur_lo"]) == (8, 2.1)
    assert short["beats"]["hook"] > same["beats"]["hook"] > twice["beats"]["hook"] and sum(twice["beats"].values()) == pytest.approx(1, abs=0.02)


def test_runs_of_equal_rows(spark):
    d = spark.createDataFrame([("x", k, v) for k, v in enumerate("aaaabcc")], "k string, n int, v string")
    gone = lambda **a: [r["n"] for r in W.repeats(d, ["k"], ["n"], "v", **a).orderBy("n").collect()]
    assert gone() == [1, 2, 3, 6] and gone(alternate=True) == [1, 3, 6]


def test_classic_ranking_limits(spark):
    p = genres.classic_ranking(spark, DATA).toPandas()
    assert p.groupby(["series_id", "ep"]).size().max() <= 2 and p.groupby("series_id").size().max() <= 20


def test_spoken_names(spark):
    d = spark.createDataFrame([(1, "阿青说：走。沈默问：去哪？阿青道：回家。老人说好。"), (1, "他说不")], "k int, t string")
    r = genres.spoken_names(d, "k", "t").first()
    assert (r["name"], r["n"]) == ("阿青", 2)


def test_sources_that_stand_in(spark):
    a, b = spark.createDataFrame([("s1", 1)], "k string, v int"), spark.createDataFrame([("s1", 2), ("s2", 3)], "k string, v int")
    assert sorted((r["k"], r["v"]) for r in reviewing.preferred([a, b], "k").collect()) == [("s1", 1), ("s2", 3)]
    r = reviewing.with_legacy_defaults(spark.createDataFrame([(4, 0, 2)], "emotion int, faces int, dialogue_lines int")).first()
    assert (r["usable"], r["face_quality"], r["action_level"], r["dialogue_visible"], r["reject_reason"]) == (True, "模糊", 4, True, "无")


def test_reel_names(spark):
    d = spark.createDataFrame([("第7集.mp4",), ("ep123.mov",), ("片头 title-card long",), ("片头",)], "s string")
    assert [r[0] for r in d.select(documents.reel(F.col("s"))).collect()] == ["EP07", "EP123", "title-card l", "REEL"]


def test_no_plan_gathers_everything(spark):
    for name in ("beat_ranking", "spread_selection", "genre_consensus", "episode_split"):
        plan = {**genres.query.__globals__["QUERIES"]}[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def _initial(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranking_reads_the_clips_once(spark):
    """stages and quotes are looked up beside the clips, not in clips that are read and decided anew."""
    for df in (selection.told(spark, DATA), selection.ranked(spark, DATA)):
        plan = _initial(df)
        assert plan.count("event_id#") and plan.count("props#") and sum("Relation [event_id" in line for line in plan.splitlines()) == 1


def test_long_texts_use_no_alternations(spark):
    """the decisions on labels hold no regular expressions, whose code a stage's methods outgrew."""
    from reelspark.plans import enrichment

    assert "RLIKE" not in _initial(enrichment.decided(spark, DATA))


def test_pools_are_counted_and_placed_in_one_pass(spark):
    """one window over the six rows a clip."""
    plan = _initial(selection.filter_pools(spark, DATA))
    assert sum("Window [" in line and "mol_type" in line for line in plan.splitlines()) == 1


def test_leftovers_read_the_ranking_that_was_written(spark):
    """the clips are ranked once, not once for all and once for the chosen."""
    assert "Relation [event_id" not in _initial(documents.unused_candidates(spark, DATA))


def test_times_beside(spark):
    from reelspark.operators import joins as J

    left = spark.createDataFrame([(1, 1, 5.0), (2, 1, 15.1), (3, 2, 5.0), (4, 1, None), (5, None, 5.0)], "id int, ep int, t double")
    right = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, None)], "ep int, t double")
    got = J.beside(left, right, ["ep"], "t", 5.0, "q").orderBy("id").collect()
    assert [(r["id"], r["q"]) for r in got] == [(1, True), (2, False), (3, False), (4, False), (5, False)]


def test_words_of_lists_are_found_in_one_walk(spark):
    lists = [["血", "伤口"], ["流血", "口"], ["ab", "b"], ["一群"]]
    texts = ["", "血", "伤口流血", "xab", "B", "一 群", None]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("n", words.held(F.col("t"), lists))
    bit = lambda k: F.col("n").bitwiseAND(F.lit(1 << k)) != 0
    got = d.orderBy("k").select("n", *map(bit, range(4)), *(R.holds(F.col("t"), ws) for ws in lists)).collect()
    assert [r[0] for r in got] == [0, 1, 3, 4, 0, 0, None]
    assert all(tuple(r)[1:5] == tuple(r)[5:] for r in got)
    with pytest.raises(ValueError):
        words.held(F.col("t"), [["x"]] * 64)


def test_genres_are_counted_without_alternations(spark):
    plan = genres.verdict(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan
