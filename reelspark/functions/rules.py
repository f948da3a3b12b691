"""Scalar rules as Columns: keyword tests, trend scores, reject and subtype decisions, template scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dims


def any_word(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def holds(text: Column, words: list[str]) -> Column:
    """any_word for long texts that are columns (the text is read once a word).

    An alternation is tried anew at each letter, and a stage that holds many of them gets methods beyond the 8,000 bytes that the
    JVM compiles.
    """
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def clamp(value: Column, lo: int = 1, hi: int = 5) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value.cast("int")))


def number(text: Column, kind: str) -> Column:
    """A text as a number; null where it is none."""
    return text.try_cast(kind)


def falsy(value: Column, default) -> Column:
    """Null and zero become the default."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def first_of(text: Column, rules: list[tuple[str, list[str]]], default, test=any_word) -> Column:
    """The name of the first rule one of whose words the text holds."""
    out = F
    for name, words in rules:
        out = out.when(test(text, words), F.lit(name))
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def event_text() -> Column:
    return F.concat_ws(" ", "event", "event_subtype", "shot")


def flag(condition: Column, points: float = 1) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def trend_base(which: int) -> Column:
    """Promo (0) or hook (1) base of the trend pair; 2 for pairs that are not listed."""
    pair = F.concat_ws("|", "emotion_trend", "action_direction")
    table = F.create_map(*(F.lit(x) for (a, b), v in dims.TREND.items() for x in (f"{a}|{b}", v[which])))
    return F.coalesce(table[pair], F.lit(2))


def usable() -> Column:
    return F.col("reject_reason") == "无"


def hook_value() -> Column:
    conflict, action = any_word(event_text(), dims.HIGH_CONFLICT), any_word(event_text(), dims.HIGH_ACTION)
    face = F.col("face_quality").isin("正脸", "半面")
    return clamp(trend_base(1) + flag(conflict) + flag((F.col("action_direction") == "增强") & action) + flag(face) - flag(~usable(), 4))


def promo_value() -> Column:
    return clamp(trend_base(0) + flag(any_word(event_text(), dims.HIGH_CONFLICT)) + flag(F.col("face_quality").isin("正脸", "半面")) - flag(~usable(), 4))


def reject_reason(blob: Column, visual_quality: Column, shot: Column, given: Column) -> Column:
    """Ordered decision: a given reason stands unless the picture is good enough, then what the text says, then an empty poor shot."""
    stands = (given != "无") & ~((given == "低质量") & (visual_quality >= 3))
    said = first_of(blob, dims.REJECT_WORDS, F.when((shot == "空镜") & (visual_quality <= 2), F.lit("空镜")).otherwise(F.lit("无")))
    return F.when(stands, given).otherwise(said)


def event_subtype(blob: Column, given: Column, reason: Column, test=any_word) -> Column:
    frames = reason.isin("片头", "片尾", "纯文字", "白屏", "黑屏", "空镜")
    return F.when(given != "无", given).when(frames, reason).otherwise(first_of(blob, dims.SUBTYPE_WORDS, "无", test))


def conflict_side(blob: Column, test=any_word) -> Column:
    return first_of(blob, dims.SIDE_WORDS, "无", test)


def cut_role(hook: Column) -> Column:
    """After banding: band 5 to 1."""
    return F.element_at(F.array(*(F.lit(r) for r in ("ending", "setup", "rise", "climax", "hook"))), hook)


def high_conflict() -> Column:
    return ((F.col("emotion") >= 5) | (F.col("action_level") >= 4)) & any_word(event_text(), dims.CLASH) & (F.col("visual_quality") >= 3) & ~F.col("face_quality").isin("无人", "模糊") & usable()


def molecular_score() -> Column:
    """Needs the template's columns beside the clip's."""
    text, kind = event_text(), F.col("mol_type")
    targets = F.size(F.filter("events", lambda e: F.contains(text, e)))
    subtypes = sum((flag(text.contains(s), 12) for s in dims.SCORED_SUBTYPES), F.lit(0))
    aes = F.col("aesthetic_score")
    own = (
        F.when(kind == "quote_rhythm", F.col("speech_density") * 8)
        .when(kind == "identity_twist", F.col("speech_density") * 6)
        .when(kind == "emotional_resonance", F.col("audio_energy") * 7)
        .when(kind.isin("hook_clash", "suspense_hook"), F.col("audio_energy") * 5)
        .otherwise(F.when(aes > 0, aes * 15).otherwise(F.col("visual_quality") * 10) + flag(F.col("shot").isin("全景", "特写"), 15) + flag(F.col("face_quality") == "无人", 4) + F.least(F.lit(4), F.col("audio_energy")))
    )
    base = F.col("emotion") * 12 + F.col("action_level") * 10 + F.col("visual_quality") * 8 + flag(F.col("face_quality").isin("正脸", "侧脸", "半面"), 10)
    return (base + targets * 18 + subtypes + own + F.when((aes > 0) & (kind != "cinematic_beauty"), aes * 5).otherwise(0) - flag(~usable(), 100)).cast("int")


def fusion_score() -> Column:
    """Weighted mean of the normalised parts; weights of missing parts go to the others."""
    parts = [(F.col("w_molecular"), F.col("molecular") / 250.0), (F.col("w_aesthetic"), F.col("aesthetic_score") / 10.0), (F.col("w_hook"), F.col("hook_value") / 5.0), (F.col("w_promo"), F.col("promo_value") / 5.0)]
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    return sum((F.coalesce(w * v, F.lit(0.0)) for w, v in parts), F.lit(0.0)) / total


def clip_score() -> Column:
    rarity = F.create_map(*(F.lit(x) for kv in dims.RARITY.items() for x in kv))
    rare = sum((F.coalesce(rarity[F.col(c)], F.lit(1.0)) for c in ("event", "event_subtype", "shot")), F.lit(0.0))
    emotion = F.element_at(F.array(*(F.lit(float(x)) for x in (0, 5, 15, 40, 70))), F.col("emotion"))
    return F.round(emotion * 4.0 + F.least(F.lit(30.0), rare * 5) * 2.0 + F.least(F.lit(40), F.col("speech_density") * 8) * 2.0 + 12 * 1.5, 1)


def narrative() -> Column:
    table = F.create_map(*(F.lit(x) for kv in dims.NARRATIVE.items() for x in kv))
    return F.coalesce(table[F.col("event")], F.lit("rising"))


def stage_index(ep: Column) -> Column:
    return F.when(ep <= 10, 1).when(ep <= 25, 2).when(ep <= 45, 3).when(ep <= 62, 4).when(ep <= 76, 5).otherwise(0)


def timecode(seconds: Column, fps: int = 25) -> Column:
    frames = F.floor(F.greatest(seconds, F.lit(0.0)) * fps + 0.5).cast("long")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = F.floor(frames / fps)
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60), part(frames % fps))
