"""Rules of template selection as Columns: boosts from the story, scores, filters and the scaling of templates to a length.

Template columns (mol_type, events, shots, emo_min, ...) stand beside the clip's; see dims.molecules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import dims
from . import enrichment as E
from . import rules as R

# Events that raise a clip within a peak; guesses that a selected clip's description must not hold.
PEAK_EVENTS = ["对峙", "冲突", "打斗"]
HEDGES = ["似乎", "可能", "大概", "仿佛", "看起来像", "似在"]


def any_of(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def texts() -> dict[str, Column]:
    """The event text, and what character_boost() reads, as columns: rules that go through words would build them anew for each."""
    event = F.lower(E.event_text())
    return {"_event": E.event_text(), "_event_low": event, "_words": F.concat_ws(" ", F.lower(E.text("desc_clean")), event)}


def narrative_boost(nodes: Column, names: Column) -> Column:
    """Of a clip with texts(), over the story's nodes (stage, ep_lo, ep_hi) that hold the episode: a peak 1, an event of conflict in it 1 more, and half a point for each name in the description where names count."""
    clash, said = R.flag(R.holds(F.col("_event"), PEAK_EVENTS)), F.size(F.filter(names, lambda n: (F.length(n) >= 2) & F.contains(E.text("desc_clean"), n)))

    def points(node):
        peak = R.flag(R.any_word(node["stage"], dims.PEAKS)) * (clash + 1)
        return F.when(F.col("ep").between(node["ep_lo"], node["ep_hi"]), peak + F.when(R.any_word(node["stage"], dims.NAMED), said * 0.5).otherwise(0.0)).otherwise(0.0)

    return F.aggregate(F.transform(nodes, points), F.lit(0.0), lambda a, x: a + x)


def character_boost(characters: Column) -> Column:
    """Of a clip with texts(): half a point for each character (name, terms) that the clip names, one more if its event holds one of the character's terms; 4 at most."""
    event, words = F.col("_event_low"), F.col("_words")
    points = lambda c: F.when((F.length(c["name"]) >= 2) & F.contains(words, F.lower(c["name"])), F.when(any_of(event, c["terms"]), 1.5).otherwise(0.5)).otherwise(0.0)
    return F.least(F.lit(4.0), F.aggregate(F.transform(characters, points), F.lit(0.0), lambda a, x: a + x))


def _held(text: Column, words: list[str]) -> Column:
    """Those of the words that the text holds, once each."""
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words)))


def prepared() -> dict[str, Column]:
    """What scores and filters need of a clip with texts() whatever the template: worked out once, before clips meet templates.

    _hits and _shots: the templates' events and shots that a clip shows; _plain: its score without theirs; _fair: whether any
    template may take it; _high: whether it is of high conflict.
    """
    text, seen = F.col("_event"), F.coalesce("dialogue_visible", F.lit(False))
    events, shots = (sorted({w for m in dims.MOLECULES.values() for w in m[k]}) for k in (6, 7))
    base = F.col("emotion") * 12 + F.col("action_level") * 10 + F.col("visual_quality") * 8 + R.flag(F.col("face_quality").isin("正脸", "侧脸", "半面"), 10) + R.flag(seen, 8)
    base = base + F.least(F.lit(10), F.floor(F.length(E.text("subtitle_text")) / 2)) + sum((R.flag(F.contains(text, F.lit(x)), 12) for x in dims.SCORED_SUBTYPES), F.lit(0))
    lost = R.flag(~F.col("usable"), 100) + R.flag(F.col("event_conf") == "模糊", 50)
    fair = F.col("usable") & (F.col("reject_reason") == "无") & ~((F.col("event_conf") == "模糊") & (F.col("visual_quality") <= 2)) & ~F.coalesce(R.holds(F.col("desc_clean"), HEDGES), F.lit(False)) & (F.length(E.text("desc_clean")) >= 30)
    return {"_hits": _held(text, events), "_shots": _held(E.text("shot"), shots), "_plain": base - lost, "_fair": fair, "_high": high_conflict(F.col("_event"))}


def molecular_score() -> Column:
    """Of a prepared() clip beside a template."""
    kind, aes = F.col("mol_type"), F.coalesce("aesthetic_score", F.lit(0))
    quoted, anchored = E.text("transcript_excerpt") != "", E.text("dialogue_anchor").isin("boundary", "dense_speech")
    density, energy, seen = F.coalesce("speech_density", F.lit(1)), F.coalesce("audio_energy", F.lit(1)), F.coalesce("dialogue_visible", F.lit(False))
    own = (
        F.when(kind == "quote_rhythm", density * 8 + R.flag(quoted, 16) + R.flag(anchored, 10))
        .when(kind == "identity_twist", density * 6 + R.flag(quoted, 12) + R.flag(seen, 8))
        .when(kind == "emotional_resonance", energy * 7 + R.flag(quoted, 10))
        .when(kind.isin("hook_clash", "suspense_hook"), energy * 5 + R.flag(F.col("has_speech_peak"), 12) + R.flag(F.col("beat_nearby"), 8))
        .otherwise(F.when(aes > 0, aes * 15).otherwise(F.col("visual_quality") * 10) + R.flag(F.col("shot").isin("全景", "特写"), 15) + R.flag(F.col("face_quality") == "无人", 4) + F.least(F.lit(4), energy))
    )
    return (F.col("_plain") + F.size(F.filter("events", lambda e: F.array_contains("_hits", e))) * 18 + own + F.when((aes > 0) & (kind != "cinematic_beauty"), aes * 5).otherwise(0)).cast("int")


def fusion_score() -> Column:
    """The weighted mean of the parts, with what the story, quotes (narrative, quoted) and characters (characters) add."""
    kind = F.col("mol_type")
    return R.fusion_score() + F.col("narrative") * 0.08 + R.flag((kind == "quote_rhythm") & F.col("quoted"), 0.15) + F.when(kind == "identity_twist", F.col("characters") * 0.05).otherwise(0.0)


def high_conflict(event: Column) -> Column:
    strong = (F.col("emotion") >= 5) | (F.col("action_level") >= 4)
    return strong & R.holds(event, dims.CLASH) & (F.col("visual_quality") >= 3) & ~F.col("face_quality").isin("无人", "模糊") & (F.col("event_conf") != "模糊") & F.col("usable")


def fits(strict: bool) -> Column:
    """Whether a prepared() clip passes its template's filter; the relaxed one asks a level less of emotion and neither faces, events nor shots."""
    among = lambda words, held: F.exists(words, lambda w: F.array_contains(held, w))
    beauty, quality = F.col("mol_type") == "cinematic_beauty", F.col("visual_quality")
    subtype, face = ~E.text("event_subtype").isin("", "无"), E.text("face_quality")
    least = F.col("emo_min") if strict else F.greatest(F.lit(2), F.col("emo_min") - 1)
    ok = F.col("_fair") & (F.col("emotion") >= least) & F.when(beauty, (quality >= 4) | ((quality >= 3) & subtype)).otherwise(quality >= 3)
    ok = ok & ~(beauty & (face == "模糊")) & ~(beauty & (F.trim(E.text("event")) == "") & ~subtype)
    if strict:
        ok = ok & (beauty | (~face.isin("模糊", "无人") & ~((face == "") & (F.coalesce("faces", F.lit(0)) < 1))))
        ok = ok & ((F.size("events") == 0) | among("events", "_hits")) & ((F.size("shots") == 0) | among("shots", "_shots"))
    return ok


def quality_fits() -> Column:
    """The pool that a picture-led template falls back on."""
    return (F.col("visual_quality") >= 3) & F.col("usable") & (F.col("reject_reason") == "无") & ~E.text("event_subtype").isin("", "无") & (F.length(E.text("desc_clean")) >= 30)


def stage_index() -> Column:
    """1 to 5 by the stage's name, else by the episode; 0 beyond the story."""
    named = F
    for k, word in enumerate(dims.STAGE_WORDS):
        named = named.when(E.text("story_stage").contains(word), k + 1)
    return named.otherwise(R.stage_index(F.col("ep")))


def scaled(templates: DataFrame, seconds: str) -> DataFrame:
    """Templates for the wanted length in the column seconds (null: as they are): lengths by the root of the ratio, counts by the ratio, beats moved towards hooks or climaxes."""
    ratio = F.coalesce(F.col(seconds), F.col("target_dur")) / F.col("target_dur")
    same = ratio == 1.0
    hi = F.bround(F.least(F.lit(12.0), F.col("dur_hi") * F.sqrt(ratio)), 1)
    lo = F.bround(F.greatest(F.lit(1.5), F.col("dur_lo") * F.sqrt(ratio)), 1)
    least = F.greatest(F.lit(4), F.bround(F.col("min_clips") * ratio, 0).cast("int"))
    most = F.greatest(least + 2, F.bround(F.col("max_clips") * ratio, 0).cast("int"))
    change = lambda k: F.when(k.isin("hook", "inciting"), 1.0 + (1.0 - ratio) * 0.3).when(k.isin("climax", "transition"), 1.0 + (ratio - 1.0) * 0.3).otherwise(1.0)
    moved = F.transform_values("beats", lambda k, v: F.bround(F.greatest(F.lit(0.05), F.least(F.lit(0.7), v * change(k))), 2))
    hundredths = lambda v: F.bround(v * 100, 0).cast("long")  # noqa: E731  (whole numbers, so that the sum has no order)
    t = templates.withColumn("__beats", moved).withColumn("__sum", F.aggregate(F.map_values("__beats"), F.lit(0).cast("long"), lambda a, x: a + hundredths(x)))
    new = {
        "beats": F.when(same, F.col("beats")).otherwise(F.transform_values("__beats", lambda _, v: F.bround(hundredths(v) / F.col("__sum"), 2))),
        "dur_lo": F.when(same, F.col("dur_lo")).when(lo >= hi, hi - 1.0).otherwise(lo), "dur_hi": F.when(same, F.col("dur_hi")).otherwise(hi),
        "min_clips": F.when(same, F.col("min_clips")).otherwise(least), "max_clips": F.when(same, F.col("max_clips")).otherwise(most),
        "target_dur": F.coalesce(F.col(seconds), F.col("target_dur")).cast("int"),
    }
    return t.select(*(c for c in templates.columns if c not in new), *(v.alias(k) for k, v in new.items()))
