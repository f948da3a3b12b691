"""Parsers, folds and the stream on literal rows and against brute force."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelspark.functions import directions, labels
from reelspark.operators import windows
from reelspark.plans import catalogue
from reelspark.sources import annotations, media, profiles, reviews, subtitles
from reelspark.streaming import ingest

SF = "/root/testdata/sf0.001"


def clip(spark, body):
    return annotations.typed(annotations.lines(spark.createDataFrame([(f"ep01_f1 2s {body}",)], "value string"))).first()


def test_label_dialects(spark):
    v2 = clip(spark, '{"shot":"特写","event":"打斗","emo":4,"action_level":3,"face_quality":"正脸","action_direction":"增强","emotion_trend":"爆发","mood":"紧张；愤怒","visual_quality":0}')
    assert (v2["ep"], v2["time_s"], v2["format"], v2["emotion"], v2["action_direction"], v2["emotion_trend"]) == (1, 2.0, "v2", 4, "增强", "爆发")
    assert v2["visual_quality"] == 3 and v2["scene_types"] == ["打斗", "紧张", "愤怒", "特写"]
    old = clip(spark, "情绪：4。类型：恐怖/对峙。")
    assert (old["format"], old["emotion"], old["scene_types"]) == ("legacy", 4, ["恐怖", "对峙"])
    v3 = clip(spark, '好 ```json {"shot":"近景","hook_value":5,"cut_role":"hook","best_cut":"on_action","pre_roll":0.5} ``` 完')
    assert (v3["hook_value"], v3["cut_role"], v3["best_cut"], v3["pre_roll"], v3["suggested_duration"]) == (5, "hook", "on_action", 0.5, 2.5)
    assert clip(spark, '{"event":"无镜头"}')["format"] == "legacy" and clip(spark, "{broken")["emotion"] == 3


def test_lines_that_are_none(spark):
    df = spark.createDataFrame([(None,), ("",), ("ep01 2s",), ("ep07_f2 2.5s x y",), ("ep08 ??s x",)], "value string")
    assert sorted((r["ep"], r["time_s"], r["body"]) for r in annotations.lines(df).collect()) == [(7, 2.5, "x y"), (8, 0.0, "x")]


def test_hint(spark):
    r = spark.range(1).select(F.lit("他似乎在 正在说话[动作:增强] [情绪趋势：爆发]").alias("h"))
    r = r.select(annotations.cleaned_hint(F.col("h")).alias("c"), annotations.hint_tag(F.col("h"), "动作").alias("a"), annotations.hint_tag(F.col("h"), "情绪趋势").alias("e"), annotations.hint_tag(F.col("h"), "适合位置").alias("p"))
    assert tuple(r.first()) == ("他 嘴唇微张", "增强", "爆发", None)


def test_cues(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\nNOTE x\n\n1\n00:01.500 --> 00:03.000\n一 \n二\n\n01:00:00.000 --> 01:00:01.250\nend\n\n00:05.000 --> 00:06.000\n", encoding="utf-8")
    got = subtitles.cues(spark.read.option("lineSep", "\n\n").text(str(tmp_path / "a.vtt"))).orderBy("start_s").collect()
    assert [tuple(r) for r in got] == [(1.5, 3.0, "一 二", 3, 1.5), (3600.0, 3601.25, "end", 3, 1.25)]


def test_batches(spark):
    rows = [(k % 3, k, "字" * (k * 37 % 90)) for k in range(60)] + [(7, 0, "长" * 450), (8, 0, None), (9, 0, "")]
    df = spark.createDataFrame(rows, "ep int, pos int, text string")
    want = []
    for ep in (0, 1, 2, 7, 9):
        text, at, n = "\n".join(t for e, _, t in rows if e == ep), 0, 0
        while at < len(text) or n == 0:
            end = at + 200
            if end < len(text) and (feed := text.rfind("\n", at, end)) > at + 100:
                end = feed + 1
            want.append((ep, n, text[at:end]))
            at, n = end, n + 1
    assert sorted(tuple(r) for r in windows.batches(df, "ep", ["pos"], "text", 200).collect()) == sorted(want)


def test_stretched(spark):
    rows = [("s", k, 3.0 + k % 2, 5.0, 60) for k in range(6)] + [("full", k, 10.0, 10.0, 60) for k in range(6)]
    df = spark.createDataFrame(rows, "key string, pos int, dur double, hi double, target int")
    got = {(r["key"], r["pos"]): r["stretched_s"] for r in windows.stretched(df, ["key"], "pos", "dur", "hi", "target").collect()}
    need, want = 60 * 0.9 - 21.0, []
    for k in range(6):
        add = min(7.5 - rows[k][2], need / 6 * 2) if need > 0 else 0.0
        want.append(round(rows[k][2] + add, 1))
        need -= add
    assert [got["s", k] for k in range(6)] == want and all(got["full", k] == 10.0 for k in range(6))


def _times(points, d):
    most = 4 if d < 90 else 7 if d < 180 else 10
    if points:
        n, found = most - 2, {}
        for t in sorted(points):
            if 1 < t < d - 1:
                found.setdefault(min(int(t / (d / n)), n - 1), t)
        picked = [round(found.get(k, (k + 0.5) * d / n), 1) for k in range(n)]
    else:
        picked = [round(d * s, 1) for s in {4: (0.25, 0.5, 0.75), 7: (0.15, 0.3, 0.5, 0.7, 0.85), 10: (0.1, 0.22, 0.35, 0.5, 0.6, 0.75, 0.9)}[most]]
    out = []
    for t in sorted({2.0, *[round(d - 2, 1)] * (d > 5), *(t for t in picked if 1 < t < d - 1)}):
        if out and t - out[-1] < 5:
            out[-1] = round((out[-1] + t) / 2, 1)
        else:
            out.append(t)
    return out[:most]


def test_key_times(spark):
    rows = [(k, float(t) if k % 4 else None, 4.0 + 13 * k) for k in range(20) for t in range(k, 300, 11 + 7 * k)]
    df = spark.createDataFrame(rows, "k int, t double, d double")
    got = windows.key_times(df, ["k"], "t", "d").groupBy("k").agg(F.sort_array(F.collect_list("time_s")).alias("ts")).collect()
    assert len(got) == 20
    for r in got:
        want = _times([t for k, t, _ in rows if k == r["k"] and t is not None], 4.0 + 13 * r["k"])
        assert len(want) == len(r["ts"]) and all(abs(a - b) < 0.11 for a, b in zip(want, r["ts"], strict=True)), (r["k"], want, r["ts"])


def test_narrative_mix_covers_roles(spark):
    rows = [("s", k, 100.0 - k, "rising" if k < 30 else ["setup", "climax", "hook"][k % 3]) for k in range(40)]
    df = spark.createDataFrame(rows, "s string, pos0 int, score double, role string")
    out = windows.narrative_mix(df, ["s"], [F.desc("score"), "pos0"], "role", {"hook": 0.2, "setup": 0.1, "rising": 0.4, "climax": 0.3}).orderBy("pos").collect()
    assert len(out) == 8 and [r["role"] for r in out][:2] == ["hook", "hook"] and {r["role"] for r in out} == {"hook", "setup", "rising", "climax"}


def test_review_csv(spark, tmp_path):
    df = spark.createDataFrame([("y", "3", "4.0", 'a, "b"\nc'), ("N", "1", "2", ""), (" 1", "x", "2", ""), (None, "1", "1", "")], "keep string, ep string, time_s string, descr string")
    reviews.write_review(df, str(tmp_path / "r"))
    assert [tuple(r) for r in reviews.kept_keys(reviews.read_review(spark, str(tmp_path / "r"))).collect()] == [(3, 4, 'a, "b"\nc')]


def test_stream_answers_repeats_once(spark, tmp_path):
    for k in range(2):
        pd.DataFrame({"text": ["a", None, "a", f"n{k}"], "at": pd.to_datetime(["2026-01-01"] * 4).astype("datetime64[us]")}).to_parquet(tmp_path / f"{k}.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    for _ in range(2):
        stream = ingest.first_arrivals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet")), ["text"], "at")
        ingest.ingest(stream, lambda b: b, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(str(r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["None", "a", "n0", "n1"]


def test_batches_of_all_dialogue(spark):
    lines = catalogue._spoken(spark, SF)
    whole = lines.groupBy("ep").agg(F.sum(F.length("line") + 1).alias("n")).collect()
    got = catalogue.QUERIES["dialogue_batches"](spark, SF).groupBy("ep").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r["ep"]: r["n"] - 1 for r in whole} == {r["ep"]: r["n"] for r in got}


def test_profiles(spark):
    whole = '{"key_plot_nodes": "none", "情节节点": [{"集数范围": "EP01-EP10", "阶段": "序幕", "概要": "a"}, {"集数范围": "?"}], "golden_quotes": [], "人物关系": [{"姓名": "甲", "性格标签": ["狠"]}]}'
    p = spark.createDataFrame([("a", whole), ("b", "{damaged"), ("c", None), ("d", '{"golden_quotes": [{"episode": "EP03", "timestamp": "01:30", "text": "x", "impact": 4}, {"episode": "?", "timestamp": "soon"}]}')], "series_id string, value string")
    assert [tuple(r) for r in profiles.nodes(p).orderBy("node_pos").collect()] == [("a", 0, "序幕", 1, 10, "a"), ("a", 1, "", 0, 0, "")]
    alone = spark.createDataFrame([("a", '[{"episode": "EP1", "timestamp": "0:05", "text": "y", "impact": 3}]'), ("d", '[{"text": "unused"}]'), ("e", "no list")], "series_id string, value string")
    got = profiles.quotes(p, alone).orderBy("series_id", F.desc_nulls_last("ep")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 5.0, "y", None, 3), ("d", 3, 90.0, "x", None, 4), ("d", None, None, None, None, 0)]
    assert [tuple(r) for r in profiles.people(p).collect()] == [("a", "甲", None, ["狠"], None)]
    assert profiles.nodes(p.where("false")).count() == 0


def test_media_and_calibration(spark, tmp_path):
    for name in ("1.mp4", "01.mp4", "第2集.mp4", "show-003.mp4", "x.mp4", "4.txt"):
        (tmp_path / name).write_bytes(b"12")
    got = media.episodes(media.files(spark, str(tmp_path)), "show-{ep03}.mp4").orderBy("ep").collect()
    assert [(r["ep"], r["path"].rsplit("/", 1)[1], r["bytes"]) for r in got] == [(1, "1.mp4", 2), (2, "第2集.mp4", 2), (3, "show-003.mp4", 2)]
    (tmp_path / "c.csv").write_text("label(1=不可用/2=可用/3=顶级),ep,time(s),desc\n3,1,2.0,a\n,1,9,b\n7,2,1,c\nx,2,1,d\n", "utf-8-sig")
    refs = spark.createDataFrame([(1, 2.4, 5), (1, 9.0, 4), (2, 1.0, 3)], "ep int, time_s double, hook_value int")
    assert [tuple(r) for r in reviews.labelled(reviews.read_calibration(spark, str(tmp_path / "c.csv")), refs).collect()] == [(1, 2, 5, 3)]


def test_characters_and_directions(spark):
    people = "array<struct<id:string,gender:string,face:string,action:string,emo:string>>"
    df = spark.createDataFrame([([("A", "女", None, "走", "4"), ("B", None, None, None, None)],), ([],), (None,)], f"c {people}")
    assert [r[0] for r in df.select(labels.characters(F.col("c"))).collect()] == ["A(女,?,走,4); B(?,?,?,?)", "", None]
    w = spark.range(1).select(*(directions.weight(F.lit(d), "dialogue") for d in ("commentary", "unknown"))).first()
    assert [float(x) for x in w] == [3.5, 2.5]


@pytest.mark.parametrize("last", [76, 40])
def test_episode_spread(spark, last):
    pool = spark.createDataFrame([("s", k, 1 + (k * 7) % last if k > 8 else 1 + k, "a" if k % 3 else "b") for k in range(200)] + [("s", 999, last, "a")], "s string, rank int, ep int, role string")
    chosen = pool.where("rank <= 5")
    got = {r["rank"]: r for r in windows.episode_spread(chosen, pool, ["s"], "role", "rank").collect()}
    if last <= 50:
        assert sorted(got) == list(range(6))
        return
    third = lambda ep: 0 if ep <= 25 else 1 if ep <= 50 else 2
    assert len(got) == 6 and {third(r["ep"]) for r in got.values()} == {0, 1, 2}
    rows = pool.collect()
    for k in (1, 2):
        best = min(r["rank"] for r in rows if third(r["ep"]) == k)
        assert best in got
