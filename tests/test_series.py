"""Series kept apart, places spread over tasks, bands that follow batches, cached labels, replies and sentences read in full."""

import json
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import intervals as I
from reelspark.operators import ranks as K
from reelspark.operators import windows as W
from reelspark.plans import catalogue, incremental, reviewing, series, weighting
from reelspark.plans import parsing as P
from reelspark.sources import annotations as N
from reelspark.sources import label_cache as C
from reelspark.sources import legacy as L
from reelspark.sources import media as M
from reelspark.sources import profiles as Q
from reelspark.sources import reviews as V
from reelspark.streaming import ingest
from reelspark.streaming import rebanding as B


def test_series_with_equal_episodes_do_not_mix(spark):
    clips = spark.createDataFrame([("A", 1, 1, 10.0), ("B", 1, 2, 10.0), ("B", 2, 3, 10.0)], "series_id string, ep int, ingest_pos long, time_s double")
    cues = spark.createDataFrame([("A", 1, 0, "said in A", 9, 9.5, 10.5), ("B", 1, 0, "said in B", 9, 30.0, 31.0)], "series_id string, ep int, cue_pos int, text string, chars int, start_s double, end_s double")
    got = {r["ingest_pos"]: r["transcript_excerpt"] for r in I.speech_features(clips, cues, ["series_id", "ep"]).collect()}
    assert got == {1: "said in A", 2: "", 3: ""}
    stages = spark.createDataFrame([("A", 0, "one", 1, 5), ("A", 1, "late", 1, 9), ("B", 0, "two", 2, 9)], "series_id string, node_pos int, stage string, ep_lo int, ep_hi int")
    assert {r["ingest_pos"]: r["story_stage"] for r in I.stabbed(clips, stages, ["series_id"], "ep", "?").collect()} == {1: "one", 2: "?", 3: "two"}


@pytest.mark.parametrize("most", [10_000, 7])
def test_each_overlap_once(spark, most):
    r = np.random.default_rng(0)
    left = [(k % 2, k, float(a), float(a + b)) for k, (a, b) in enumerate(zip(r.integers(0, 60, 120), r.integers(0, 30, 120), strict=True))]
    right = [(k % 2, k, float(a), float(a + b)) for k, (a, b) in enumerate(zip(r.integers(0, 60, 90) + 0.5, r.integers(0, 20, 90), strict=True))]
    x = spark.createDataFrame([*left, (None, 900, 1.0, 2.0), (0, 901, None, 2.0), (0, 902, 5.0, 1.0)], "s int, l int, lo double, hi double")
    y = spark.createDataFrame([*right, (None, 900, 1.0, 2.0)], "s int, r int, `from` double, `to` double")
    got = sorted((p["l"], p["r"]) for p in I.overlapping(x, y, ["s"], 8.0, most).collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and max(a[2], b[2]) < min(a[3], b[3]))


def test_places_of_a_large_key_are_spread(spark):
    rows = [("hot" if k % 10 else f"k{k % 70}", (k * 7919) % 11, k) for k in range(20_000)] + [(None, 3, 99_999)]
    d = spark.createDataFrame(rows, "key string, value int, id long").repartition(5)
    by = [F.desc("value"), "id"]
    windowed, spread = K.numbered(d, ["key"], by), K.numbered(d, ["key"], by, rows=1000)
    assert sorted(map(str, windowed.collect())) == sorted(map(str, spread.select(*windowed.columns).collect()))
    tasks = d.repartitionByRange(8, "key", *by).where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 3 and max(t["count"] for t in tasks) < 9000
    assert "partitionBy=[key" not in spread._jdf.queryExecution().executedPlan().toString() and "windowspecdefinition(key" not in spread._jdf.queryExecution().executedPlan().toString()
    names = ["id", "band"]
    assert sorted(map(tuple, W.banded(d, "value", ["key"], ["id"]).select(*names).collect())) == sorted(map(tuple, K.banded(d, "value", ["key"], ["id"], rows=100).select(*names).collect()))


def test_bands_follow_batches(spark, tmp_path):
    rows = [(f"S{k % 5}", k, (k * 31) % 17) for k in range(300)]
    frame = lambda part: spark.createDataFrame(part, "series string, id long, value int")
    rank = lambda df: W.banded(df, "value", ["series"], ["id"])
    store = B.BandStore(spark, f"file:{tmp_path}/store", ["series"], ["id"], rank, 4)
    schema = rank(frame([])).schema
    read = lambda: sorted(map(tuple, store.read(schema).collect()))
    assert read() == []
    parts = [rows[:100], [r for r in rows[100:200] if r[0] != "S3"], [*rows[200:], *(r for r in rows[100:200] if r[0] == "S3")]]
    for n, part in enumerate(parts):
        store.apply(frame(part), n)
    whole = sorted(map(tuple, rank(frame(rows)).collect()))
    assert read() == whole
    store.apply(frame(parts[2]), 2)  # repeated after a failure
    assert read() == whole
    store.apply(frame(rows[:10]), 3)  # rows that came before
    assert read() == whole
    store.apply(frame([("S0", 0, 99)]), 4)  # a row that changed
    assert read() == sorted(map(tuple, rank(frame([("S0", 0, 99), *rows[1:]])).collect()))
    store.apply(frame([]), 5)
    assert len(read()) == 300


def test_cache_calls_once_a_content(spark, tmp_path):
    cache, calls = C.LabelCache(spark, f"file:{tmp_path}/cache"), []
    frame = lambda ids: spark.createDataFrame([(i, i % 4 or None) for i in ids], "id long, shown int").withColumn("content_key", C.content_key(["shown"], "v1"))

    def call(missed):
        calls.append(missed.count())
        return missed.withColumn("label", F.concat(F.lit("l"), F.coalesce(F.col("shown").cast("string"), F.lit("none"))))

    def run(ids, n):
        return sorted((r["id"], r["label"], r["hit"]) for r in cache.label(frame(ids), call, n).collect())

    label = lambda i: f"l{i % 4 or 'none'}"
    assert run([0, 1, 2, 4, 5], 1) == [(i, label(i), False) for i in (0, 1, 2, 4, 5)]
    second = [(i, label(i), i % 4 != 3) for i in range(8)]
    assert run(range(8), 2) == second and run(range(8), 2) == second  # the second time after a failure
    assert run(range(8), 3) == [(i, label(i), True) for i in range(8)]
    assert calls == [3, 1, 1, 0] and cache.entries().count() == 4
    assert frame([1]).first()["content_key"] != spark.createDataFrame([(1, 1)], "id long, shown int").withColumn("content_key", C.content_key(["shown"], "v2")).first()["content_key"]


def test_first_arrivals_of_a_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + timedelta(hours=1)), ("b", t), ("a", t + timedelta(days=9))]
    spark.createDataFrame(rows, "what string, at timestamp").coalesce(1).write.parquet(f"file:{tmp_path}/in")
    for _ in range(2):
        s = spark.readStream.schema("what string, at timestamp").parquet(f"file:{tmp_path}/in")
        ingest.first_arrivals(s, ["what"], "at", "30 days").writeStream.format("parquet").option("path", f"file:{tmp_path}/out").option("checkpointLocation", f"file:{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["what"] for r in spark.read.parquet(f"file:{tmp_path}/out").collect()) == ["a", "b"]


SHOT = '{"shot": "特写", "emo": 4}'


@pytest.mark.parametrize(
    "text",
    [SHOT, "```json\n" + SHOT + "\n```", '{"note": 1} then ' + SHOT, '{"shot": null} ' + SHOT + " {}", 'open { "never ' + SHOT, '{"a": {"b": "}{\\"}{"}} ' + SHOT, "}} " + SHOT + " {{", "{见下} " + SHOT + " } {", '{"a": ' + SHOT + "} x {"],
)
def test_labels_behind_other_objects(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(N.label(F.col("t")).alias("v")).first()["v"]
    assert r["shot"] == "特写" and r["emo"] == 4


def test_many_braces_take_linear_time(spark):
    took = {}
    for n in (10_000, 80_000):
        began = time.time()
        assert json.loads(N.first_shot("{" * n + SHOT + "}" * (n // 2)))["shot"] == "特写"
        assert N.first_shot('{"a": 1} ' * n + '{"x": ' * 9 + '"shot"') is None
        took[n] = time.time() - began
    assert took[80_000] < 40 * max(took[10_000], 0.02) and took[80_000] < 10
    assert N.first_shot(None) is None and N.first_shot("no object") is None


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("情绪：4。类型：恐怖/对峙。", (4, False, "", ["恐怖", "对峙"], 0, 0)),
        ("夜里抬棺，众人惊恐。情绪评分：5（诡异/对峙）(诡异)", (5, True, "夜里抬棺，众人惊恐。", ["诡异", "对峙", "惊恐", "抬棺"], 0, 2)),
        ("你敢？情绪 3", (3, False, "你敢？", [], 1, 0)),
        ("老人说他问过 情绪：2 类型:对话", (2, True, "老人说他问过", ["对话"], 2, 2)),
        ("画面里有我(战斗)", (3, True, "画面里有我(战斗)", ["战斗"], 0, 0)),
        ("", (3, False, "", [], 0, 0)),
    ],
)
def test_legacy_sentences(spark, line, want):
    r = spark.createDataFrame([(line,)], "t string").select(L.fields(F.col("t")).alias("x")).select("x.*").first()
    assert (r["emotion"], r["has_content"], r["desc_clean"], r["scene_types"], r["dialogue_lines"], r["faces"]) == want


def test_facts_without_a_source(spark):
    clips = spark.createDataFrame([("A", 1, "他失忆了，DNA", None), ("A", 2, "车祸", "磕头 磕头"), ("B", 3, "失忆", ""), ("C", 4, "失忆", "")], "series string, id int, d string, e string")
    sources = spark.createDataFrame([("A", "出了车祸"), ("A", None), ("A", "DNA"), ("B", "无事")], "series string, said string")
    got = sorted((r["id"], r["term"]) for r in P.unsupported(clips, sources, "series", ["d", "e"], "said").collect())
    assert got == [(1, "失忆"), (2, "磕头"), (3, "失忆")]


def test_names_from_speech(spark):
    lines = spark.createDataFrame([("A", 1, "阿青说走"), ("A", 2, "沈默问谁"), ("A", 3, "，沈默喊，阿青道"), ("A", 4, "他们说"), ("B", 1, "无人")], "s string, k int, t string")
    assert [tuple(r) for r in P.named_by_speech(lines, "s", ["k"], "t").collect()] == [("A", "阿青", 2)]


def test_what_stretches_leave(spark):
    chosen = spark.createDataFrame([("A", 2, 6), ("A", 7, 9), ("A", 12, 15), ("C", 0, 7)], "s string, first int, last int")
    sizes = spark.createDataFrame([("A", 20), ("B", 4), ("C", 8)], "s string, n long")
    got = sorted(tuple(r) for r in P.remainder(chosen, sizes, "s").collect())
    assert got == [("A", 0, 1, 8), ("A", 10, 11, 8), ("A", 16, 19, 8), ("B", 0, 3, 4)]


def test_profiles_of_several_lines(spark, tmp_path):
    text = json.dumps({"人物关系": [{"姓名": "阿青", "身份": "侠客", "性格标签": ["勇"], "关键事件": "初见"}], "情节节点": [{"集数范围": "EP01-EP10", "阶段": "序幕"}]}, ensure_ascii=False, indent=2)
    (tmp_path / "series_id=S1").mkdir()
    (tmp_path / "series_id=S1" / "story_profile.json").write_text(text, "utf-8")
    p = Q.read(spark, f"file:{tmp_path}")
    assert [tuple(r) for r in Q.people(p).select("name", "part").collect()] == [("阿青", "侠客")]
    assert [tuple(r) for r in Q.nodes(p).select("stage", "ep_lo", "ep_hi").collect()] == [("序幕", 1, 10)]


def test_media_are_listed_without_their_contents(spark, tmp_path):
    for at, size in (("S1/1.mp4/a", 3), ("S1/1.mp4/b", 4), ("S1/01.mp4/a", 9), ("S2/第1集.mp4/a", 5), ("S2/readme.txt/a", 5)):
        series, name, part = at.split("/")
        there = tmp_path / f"series_id={series}" / f"name={name}"
        there.mkdir(parents=True, exist_ok=True)
        (there / part).write_bytes(b"x" * size)
    e = M.episodes(M.folders(spark, f"file:{tmp_path}"), key=["series_id"])
    assert sorted((r["series_id"], r["ep"], r["bytes"]) for r in e.collect()) == [("S1", 1, 7), ("S2", 1, 5)]
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1][:200]
    wanted = spark.createDataFrame([("S1", 1), ("S1", 2), ("S3", 1)], "series_id string, ep int")
    assert sorted(map(tuple, M.missing(wanted, e).collect())) == [("S1", 2), ("S3", 1)]


def test_media_of_an_inventory(spark, tmp_path):
    files = [("S1/name=1.mp4/a", 3), ("S1/name=1.mp4/b", 4), ("S1/name=01.mp4/a", 9), ("S2/name=第1集.mp4/a", 5), ("S2/name=readme.txt/a", 5), ("S2/loose.mp4", 1)]
    (tmp_path / "list.json").write_text("\n".join(json.dumps({"path": f"s3://media/series_id={p}", "length": n}) for p, n in files), "utf-8")
    e = M.episodes(M.inventory(spark, f"file:{tmp_path}"), key=["series_id"])
    assert sorted((r["series_id"], r["ep"], r["bytes"]) for r in e.collect()) == [("S1", 1, 7), ("S2", 1, 5)]


def files_below(path):
    return [f for f in path.rglob("*") if f.is_file() and f.name.startswith("part-")]


def test_files_do_not_grow_with_series(spark, tmp_path, monkeypatch):
    for module in (series, weighting, reviewing, catalogue):
        monkeypatch.setattr(module.A, "new_folder", lambda spark, name: f"file:{tmp_path}/{name}")
    for name in ("media_scan", "flat_fields", "series_review_keys", "profile_people", "review_files"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").count()
    for folder in ("media", "flat-fields", "series-review", "profiles", "review-data"):
        assert 0 < len(files_below(tmp_path / folder)) <= 8, folder  # 10 series of 76 episodes


def test_marks_of_one_series_leave_the_others_alone(spark, tmp_path):
    rows = [("A", "y", 1, 4.0, "x"), ("B", "n", 1, 4.0, "x"), ("B", "Y", 2, 5.9, 'a, "b"\nc')]
    d = spark.createDataFrame(rows, "series_id string, keep string, ep int, time_s double, note string")
    V.write_review(d, f"file:{tmp_path}/r", ["series_id"])
    got = V.kept_keys(V.read_review(spark, f"file:{tmp_path}/r")).select("series_id", "ep", "time_s").collect()
    assert sorted(map(tuple, got)) == [("A", 1, 4), ("B", 2, 5)]
    marks = spark.createDataFrame([("A", "2", "1", "4.2"), ("B", "3", "1", "4")], "series_id string, label string, ep string, time_s string")
    refs = spark.createDataFrame([("A", 1, 4.0), ("B", 1, 4.0)], "series_id string, ep int, time_s double")
    assert sorted((r["series_id"], r["label"]) for r in V.labelled(marks, refs, ["series_id"]).collect()) == [("A", 2), ("B", 3)]


def test_batches_of_growing_bands_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental.A, "new_folder", lambda spark, name: f"file:{tmp_path}/{name}")
    monkeypatch.setattr(incremental, "scored", lambda spark, sf_dir: catalogue.scored(spark, sf_dir).repartition(4))
    n = incremental.growing_bands(spark, "/root/testdata/sf0.001").count()
    assert n == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert len(list((tmp_path / "bands" / "manifest").glob("batch=*"))) == 4  # three batches and the repeated one
