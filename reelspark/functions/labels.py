"""Labels made whole: reject reason, trends, levels and qualities that a model left out, and characters as text. Null means left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R

# Emotion by (emotion trend, action direction), else 2; action level by direction; trend words.
EMOTION = {
    ("爆发", "增强"): 5, ("爆发", "持续"): 4, ("爆发", "静止"): 3,
    ("上升", "增强"): 4, ("上升", "持续"): 3, ("上升", "静止"): 2,
    ("稳定", "增强"): 3, ("稳定", "持续"): 2, ("稳定", "静止"): 1,
    ("下降", "增强"): 3, ("下降", "持续"): 2, ("下降", "静止"): 1,
}
ACTION = {"增强": 4, "持续": 2, "静止": 1, "减弱": 1}
TRENDS = ["上升", "稳定", "下降", "爆发"]
# Words behind reject reasons, faces, speech and subtypes.
LICENCE, ENDING = ["许可证", "网络剧片"], ["完", "剧终"]
WHITE, BLACK, CARD = ["纯白", "白色背景", "大面积过曝"], ["纯黑", "黑色背景"], ["纯文字", "竖排", "字幕卡"]
FACES = [("正脸", ["正脸", "可见"]), ("侧脸", ["侧脸", "半面"]), ("背影", ["背影"])]
SPEAKING = ["嘴唇微张", "张嘴", "嘴微张"]
SUBTYPES = [("受伤", ["血", "伤", "痛苦"]), ("倒地", ["跪", "倒地", "躺"]), ("怒吼", ["怒吼", "呐喊", "张口怒"]), ("奇幻爆发", ["发光", "能量", "光束"])]
FRAMES = ["片头", "片尾", "纯文字", "白屏", "黑屏", "空镜"]


def filled(labels: DataFrame) -> DataFrame:
    """Labels with probe_usable and probe_reason beside them (null: nothing was measured); the first rule that fits gives the reason."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    chars = text("chars")
    blob = F.concat_ws(" ", *(text(c) for c in ("hint", "mood", "scene", "props", "subtitle_text")), chars)
    seen = R.falsy(F.col("visual_quality"), 3)
    given = F.coalesce(F.nullif(F.col("reject_reason"), F.lit("")), F.lit("无"))
    reason = (
        F.when(~F.coalesce("probe_usable", F.lit(True)) & (seen <= 2), F.coalesce("probe_reason", F.lit("低质量")))
        .when(R.any_word(blob, LICENCE), "片头")
        .when(R.any_word(blob, ENDING), "片尾")
        .when(R.any_word(blob, WHITE), "白屏")
        .when(R.any_word(blob, BLACK), "黑屏")
        .when((text("shot") == "空镜") | (text("event_subtype") == "空镜"), "空镜")
        .when((F.length(F.trim(text("subtitle_text"))) >= 12) & R.any_word(blob, CARD), "纯文字")
        .when((text("event_conf") == "模糊") & (seen <= 2), "模糊")
        .when((given == "低质量") & (seen >= 3), "无")
        .otherwise(given)
    )
    out = labels.withColumn("__given", F.col("event_subtype")).withColumn("__reason", reason)
    fine, action = F.col("__reason") == "无", F.trim(text("action_direction"))
    trend, left_out = F.trim(text("emotion_trend")), F.coalesce(F.col("__given"), F.lit("")) == ""
    action, trend = F.when(action.isin(*ACTION), action).otherwise("静止"), F.when(trend.isin(*TRENDS), trend).otherwise("稳定")
    emotion = F.create_map(*(F.lit(x) for (a, b), v in EMOTION.items() for x in (f"{a}|{b}", v)))
    level = F.create_map(*(F.lit(x) for kv in ACTION.items() for x in kv))
    quality = F.when(F.col("__reason").isin("白屏", "黑屏", "模糊", "低质量"), 1).when(F.col("__reason").isin("片头", "片尾", "纯文字", "空镜"), 2).otherwise(3)
    face = R.first_of(chars, FACES, F.when(F.trim(chars).isin("", "[]"), F.lit("无人")).otherwise(F.lit("模糊")))
    return out.withColumns(
        {
            "reject_reason": F.col("__reason"),
            "usable": F.coalesce("usable", F.lit(True)) & fine,
            "event_conf": F.when(~fine, "模糊").otherwise(F.coalesce("event_conf", F.lit("推测"))),
            "action_direction": action,
            "emotion_trend": trend,
            "emo": F.coalesce(emotion[F.concat_ws("|", trend, action)], F.lit(2)),
            "action_level": level[action],
            "visual_quality": F.coalesce("visual_quality", quality),
            "face_quality": F.coalesce("face_quality", face),
            "dialogue_visible": F.coalesce("dialogue_visible", R.any_word(F.concat(chars, text("hint")), SPEAKING)),
            "subtitle_text": text("subtitle_text"),
            "event_subtype": F.when(~left_out, F.col("__given")).when(F.col("__reason").isin(*FRAMES), F.col("__reason")).otherwise(R.first_of(blob, SUBTYPES, "无")),
        }
    ).drop("__given", "__reason")


def characters(chars: Column) -> Column:
    """An array of id, gender, face, action and emo as "id(gender,face,action,emo); ..."; a missing field is a question mark."""
    field = lambda c, k: F.coalesce(c[k].cast("string"), F.lit("?"))
    return F.array_join(F.transform(chars, lambda c: F.concat(field(c, "id"), F.lit("("), F.concat_ws(",", *(field(c, k) for k in ("gender", "face", "action", "emo"))), F.lit(")"))), "; ")


# Fields of a flat label in their order, their types and what stands where a label leaves one out.
FLAT = {
    "shot": ("string", "中景"), "event": ("string", "其他"), "event_subtype": ("string", "无"), "emo": ("int", 3), "action_level": ("int", 1), "visual_quality": ("int", 3), "face_quality": ("string", "模糊"), "dialogue_visible": ("boolean", False), "subtitle_text": ("string", ""),
    "audio_energy": ("int", 1), "speech_density": ("int", 1), "has_speech_peak": ("boolean", False), "beat_nearby": ("boolean", False), "transcript_excerpt": ("string", ""), "audio_event_conf": ("string", "low"), "dialogue_anchor": ("string", "none"), "speech_coverage": ("double", 0.0), "chars_per_second": ("double", 0.0),
    "usable": ("boolean", True), "reject_reason": ("string", "无"), "hint": ("string", ""), "props": ("string", "无"), "mood": ("string", ""), "scene": ("string", ""), "light": ("string", ""), "event_conf": ("string", "推测"), "action_direction": ("string", None), "emotion_trend": ("string", None),
}
FLAT_SCHEMA = ", ".join(f"{n} {t}" for n, (t, _) in FLAT.items()) + ", chars string, continuity string, timestamp double, time_pct double, aesthetic struct<composition_type: string, light_beauty: string>"


def frame_id(ep: Column, i: Column) -> Column:
    two = ep.cast("string")
    return F.concat(F.lit("ep"), F.when(F.length(two) < 2, F.lpad(two, 2, "0")).otherwise(two), F.lit("_f"), i.cast("string"))


def flat_line(label: dict[str, Column], chars: Column, ep: Column, seconds: Column, i: Column, before: Column, aesthetic: Column) -> Column:
    """A label as a line: frame, whole seconds, and its fields as JSON with defaults; the two trends and the looks are left out where a label has none."""
    named = [F.coalesce(label[n].cast(t), F.lit(d).cast(t)).alias(n) for n, (t, d) in FLAT.items()]
    rest = [characters(chars).alias("chars"), F.coalesce(before, F.lit("none")).alias("continuity"), F.round(seconds, 1).alias("timestamp"), F.round(seconds, 1).alias("time_pct"), aesthetic.alias("aesthetic")]
    return F.concat_ws(" ", frame_id(ep, i), F.concat(seconds.cast("int").cast("string"), F.lit("s")), F.to_json(F.struct(*named, *rest)))
