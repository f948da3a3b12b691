"""Rules that make an edit decision of a full label: rejection, subtype, promo and hook values, aesthetics, sound, roles and timing.

All read columns by their names (event, event_subtype, mood, shot, desc_clean, chars_text, ...); missing text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import dims
from . import rules as R

# Words that mark a guess, points of composition, light and colour, roles of events and subtypes, timing by role.
HEDGES = ["似乎", "可能", "大概", "仿佛", "看起来像", "似在", "意味着"]
CARD_WORDS = ["纯文字", "文字卡", "竖排文字"]
COMPOSITION = {"对称": 3, "引导线": 3, "三分法": 2, "中心对称": 1}
LIGHT = {"电影级": 5, "良好": 3, "普通": 1, "差": 0}
COLOUR = {"暖": 2, "冷": 2, "高饱和": 2, "低饱和": 1, "自然": 1}
TIMING = {"hook": ("on_action", 0.5, 2.0, 2.5), "climax": ("before_action", 1.0, 2.5, 3.5), "setup": ("after_reaction", 1.5, 3.5, 5.0), "ending": ("after_reaction", 0.5, 1.5, 2.0), "rise": ("before_action", 1.0, 2.5, 3.5)}
FRAMES = ["片头", "片尾", "纯文字", "白屏", "黑屏", "空镜"]


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def blob() -> Column:
    """Everything a label says, the scene types among it."""
    kinds = (text(c) for c in ("event", "event_subtype", "mood", "shot"))
    return F.concat_ws(" ", *(text(c) for c in ("event", "event_subtype", "desc_clean", "mood", "props", "shot", "scene", "subtitle_text")), *kinds, text("chars_text"))


def event_text() -> Column:
    """What templates look for events in: event, subtype, scene types and description."""
    return F.concat_ws(" ", *(text(c) for c in ("event", "event_subtype", "mood", "shot", "desc_clean")))


def reject(words: Column) -> Column:
    """Ordered: a given reason stands unless the picture contradicts it; then what is said, an empty poor shot, a text card, a poor or guessed label."""
    given, quality, subtitle = F.coalesce(F.nullif("reject_reason", F.lit("")), F.lit("无")), R.clamp(F.coalesce("visual_quality", F.lit(3))), F.length(F.trim(text("subtitle_text")))
    lifted = ((given == "低质量") & (quality >= 3)) | ((given == "纯文字") & (quality >= 4) & (subtitle < 12) & (text("shot") != "空镜"))
    said = R.first_of(words, dims.REJECT_WORDS, "", R.holds)
    return (
        F.when((given != "无") & ~lifted, given)
        .when(said != "", said)
        .when((text("shot") == "空镜") & (quality <= 2), "空镜")
        .when((subtitle >= 12) & R.holds(words, CARD_WORDS), "纯文字")
        .when((text("event_conf") == "模糊") & (quality <= 2), "模糊")
        .when(R.holds(F.col("desc_clean"), HEDGES), "推测污染")
        .otherwise("无")
    )


def lookup(name: str, table: dict, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[text(name)], F.lit(default))


def decided(clips: DataFrame) -> DataFrame:
    """Clips with the decision columns beside their own; a clip's own reject_reason and event_subtype are replaced."""
    d = clips.withColumn("__blob", blob()).withColumn("reject_reason", reject(F.col("__blob")))
    bad = F.col("reject_reason") != "无"
    d = d.withColumn("usable", ~bad).withColumn("event_subtype", R.event_subtype(F.col("__blob"), F.coalesce(F.nullif("event_subtype", F.lit("")), F.lit("无")), F.col("reject_reason"), R.holds))
    stronger = (F.col("action_direction") == "增强") & R.holds(F.col("__blob"), dims.HIGH_ACTION)
    clash, face = R.flag(R.holds(F.col("__blob"), dims.HIGH_CONFLICT)), R.flag(F.col("face_quality").isin("正脸", "半面"))
    peak, beat, quoted = F.coalesce("has_speech_peak", F.lit(False)), F.coalesce("beat_nearby", F.lit(False)), text("transcript_excerpt") != ""
    anchored = text("dialogue_anchor").isin("boundary", "dense_speech")
    hook = R.trend_base(1) + clash + R.flag(stronger) + face + R.flag(F.length(F.trim(text("subtitle_text"))) >= 4) + R.flag(peak | beat) - R.flag(bad, 4)
    aesthetic = lookup("composition_type", COMPOSITION, 0) + lookup("light_beauty", LIGHT, 1) + lookup("color_palette", COLOUR, 1)
    energy, density = R.clamp(F.coalesce("audio_energy", F.lit(1))), R.clamp(F.coalesce("speech_density", F.lit(1)))
    # the action value is that before the raise, the level kept for later steps that after it
    d = d.withColumns({
        "event_conf": F.when(bad, "模糊").otherwise(F.coalesce("event_conf", F.lit("可见"))),
        "promo_value": R.clamp(R.trend_base(0) + clash + face - R.flag(bad, 4)), "hook_value": R.clamp(hook),
        "emotion_value": R.clamp(F.coalesce("emotion", F.lit(3))), "action_value": R.clamp(F.coalesce("action_level", F.lit(1))), "visual_value": R.clamp(F.coalesce("visual_quality", F.lit(3))),
        "raised_action": F.least(F.lit(5), F.coalesce("action_level", F.lit(1)) + R.flag(stronger)),
        "aesthetic_score": aesthetic, "cinematic_beauty": R.clamp(aesthetic),
        "dialogue_value": R.clamp(density + R.flag(quoted) + R.flag(anchored)), "rhythm_value": R.clamp(energy + R.flag(beat) + R.flag(peak)), "audio_hook_value": R.clamp(energy + R.flag(peak, 2) + R.flag(beat)),
        "cut_anchor": F.when(quoted & anchored, "dialogue").when(peak | beat, "impact_audio").otherwise("visual"),
        "conflict_side": R.conflict_side(F.col("__blob"), R.holds),
    })
    return timed(d.withColumn("action_level", F.col("raised_action")).drop("raised_action", "__blob").withColumn("first_role", first_role()), "first_role")


def first_role() -> Column:
    """The role before banding, which also times the cut."""
    event, subtype = F.col("event"), F.col("event_subtype")
    return (
        F.when(F.col("hook_value") >= 4, "hook")
        .when((event == "打斗") | subtype.isin("奇幻爆发", "怒吼", "倒地"), "climax")
        .when(event.isin("冲突", "威胁", "对峙"), "rise")
        .when(event.isin("跪地", "悲伤") | subtype.isin("哭泣", "受伤"), "setup")
        .when(F.col("promo_value") <= 2, "ending")
        .otherwise("rise")
    )


def timed(clips: DataFrame, role: str) -> DataFrame:
    """Clips with best_cut, pre_roll, post_roll and suggested_duration of their role."""
    names = {"best_cut": 0, "pre_roll": 1, "post_roll": 2, "suggested_duration": 3}
    return clips.withColumns({n: lookup(role, {r: t[k] for r, t in TIMING.items()}, TIMING["rise"][k]) for n, k in names.items()})


def exposure(mean: Column, spread: Column) -> Column:
    """What is wrong with a frame's brightness, or '无'."""
    return F.when(mean >= 245, "白屏").when(mean <= 8, "黑屏").when((spread <= 0.8) & ((mean <= 20) | (mean >= 235)), "低质量").otherwise("无")


def length_class(seconds: Column) -> tuple[Column, Column]:
    """An episode's class and how many frames it gives."""
    return F.when(seconds < 90, "short").when(seconds < 180, "medium").otherwise("long"), F.when(seconds < 90, 4).when(seconds < 180, 7).otherwise(10)
