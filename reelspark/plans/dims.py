"""Fixed values of the domain (templates, weights, keyword lists, maps) and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Promotion templates. name: target seconds, clips min/max, clip seconds lo/hi, least emotion, events, shots, beats.
MOLECULES = {
    "hook_clash": (90, 15, 35, 3.0, 6.0, 4, ["冲突", "打斗", "威胁", "对峙"], [], {"hook": 0.4, "inciting": 0.4, "rising": 0.2}),
    "identity_twist": (100, 15, 40, 3.0, 5.5, 3, ["对峙", "跪地", "冲突"], [], {"setup": 0.2, "inciting": 0.3, "rising": 0.3, "climax": 0.2}),
    "emotional_resonance": (110, 15, 40, 3.0, 6.0, 2, ["悲伤", "日常"], [], {"setup": 0.3, "rising": 0.3, "climax": 0.2, "transition": 0.2}),
    "quote_rhythm": (90, 15, 35, 2.0, 5.0, 2, ["威胁", "对峙", "冲突"], [], {"inciting": 0.4, "rising": 0.3, "climax": 0.3}),
    "cinematic_beauty": (60, 8, 20, 4.0, 10.0, 2, [], ["全景", "特写"], {"setup": 0.4, "transition": 0.3, "rising": 0.3}),
    "suspense_hook": (90, 15, 35, 3.0, 6.0, 3, ["冲突", "威胁", "对峙"], [], {"hook": 0.4, "inciting": 0.3, "rising": 0.3}),
}
# Fusion weights by template: molecular, aesthetic, hook, promo.
FUSION = {
    "hook_clash": (0.15, 0.10, 0.45, 0.30),
    "identity_twist": (0.10, 0.25, 0.35, 0.30),
    "emotional_resonance": (0.10, 0.40, 0.20, 0.30),
    "quote_rhythm": (0.15, 0.15, 0.25, 0.45),
    "cinematic_beauty": (0.05, 0.60, 0.10, 0.25),
    "suspense_hook": (0.10, 0.15, 0.50, 0.25),
}
# Order of story stages by template.
FLOW = {
    "hook_clash": [1, 2, 3, 4, 5],
    "suspense_hook": [1, 3, 4, 5, 2],
    "identity_twist": [1, 3, 2, 4, 5],
    "emotional_resonance": [1, 3, 5, 2, 4],
    "quote_rhythm": [1, 2, 3, 4, 5],
    "cinematic_beauty": [2, 4, 1, 3, 5],
}
# Fixed values: (emotion trend, action direction) to promo and hook base.
TREND = {
    ("爆发", "增强"): (5, 5), ("爆发", "持续"): (4, 4), ("爆发", "静止"): (3, 3),
    ("上升", "增强"): (4, 4), ("上升", "持续"): (3, 3), ("上升", "静止"): (2, 2),
    ("稳定", "增强"): (3, 3), ("稳定", "持续"): (2, 2), ("稳定", "静止"): (1, 1),
    ("下降", "增强"): (2, 2), ("下降", "持续"): (2, 1), ("下降", "静止"): (1, 1),
}
# Keyword lists.
HIGH_CONFLICT = ["冲突", "打斗", "威胁", "对峙", "怒吼", "抓扯", "持械", "追逐", "奇幻爆发", "围攻"]
HIGH_ACTION = ["抓扯", "持械", "怒吼", "掐", "摔", "血", "刀", "剑", "拳"]
CLASH = ["冲突", "威胁", "打斗", "对峙", "怒吼", "抓扯", "持械", "奇幻爆发"]
SCORED_SUBTYPES = ["受伤", "倒地", "抓扯", "持械", "追逐", "怒吼", "哭泣", "奇幻爆发"]
# What a text holds decides its reject reason, event subtype and conflict side; the first that fits.
REJECT_WORDS = [("片头", ["许可证", "发行许可证", "网络剧片"]), ("片尾", ["剧终", "完结", "片尾"]), ("白屏", ["纯白", "白屏", "大面积过曝"]), ("黑屏", ["纯黑", "黑屏"])]
SUBTYPE_WORDS = [
    ("受伤", ["血", "伤", "痛苦", "伤口"]),
    ("倒地", ["倒地", "躺在", "仰面", "摔倒"]),
    ("抓扯", ["抓", "扯", "按住", "拉住"]),
    ("持械", ["持刀", "刀剑", "武器", "长条状物", "石锤"]),
    ("怒吼", ["怒吼", "张口怒", "呐喊"]),
    ("哭泣", ["泪", "流泪", "眼含泪"]),
    ("奇幻爆发", ["发光", "能量", "光束", "悬浮"]),
    ("被围堵", ["围观", "围住", "多人", "一群"]),
]
SIDE_WORDS = [("群体冲突", ["一群", "多人", "围住", "围观"]), ("双人对峙", ["两名", "另一名", "对峙", "对打"]), ("单人爆发", ["怒吼", "悬浮", "张口"]), ("情绪崩溃", ["泪", "痛苦", "悲伤"])]
# Event to narrative function, event rarity.
NARRATIVE = {"葬礼": "setup", "仪式": "setup", "日常": "setup", "悲伤": "setup", "跪地": "setup", "冲突": "inciting", "威胁": "inciting", "背叛": "inciting", "对峙": "rising", "战斗": "rising", "误会": "rising", "出征": "rising", "打斗": "climax", "反转": "climax", "表白": "climax", "复仇宣言": "climax", "惊恐": "hook", "诡异": "hook", "悬念": "hook", "回忆": "transition", "其他": "transition"}
RARITY = {"打斗": 2.0, "对峙": 1.2, "冲突": 1.3, "特写": 1.3, "日常": 0.5}
# Share of a cut by narrative role, in the order of the beats.
BEATS = {"hook": 0.15, "setup": 0.10, "inciting": 0.15, "rising": 0.30, "climax": 0.25, "transition": 0.05}
# Stage nodes of a story (name, first and last episode).
STAGES = [("序幕", 1, 10), ("局势", 11, 25), ("权谋高潮", 26, 45), ("生死反转", 46, 62), ("终局决战", 63, 76)]
# Stages of a story that count as peaks, those in which named characters count, key words of stages in their order.
PEAKS, NAMED, STAGE_WORDS = ["高潮", "决战", "反转"], ["高潮", "反转", "背叛"], ["序幕", "局势", "权谋", "生死", "终局"]
# Transition, overlay and subtitle profiles by template.
PROFILES = {
    "hook_clash": ("fast_xfade", "impact_hook", "bold_impact"),
    "identity_twist": ("rise_then_burst", "identity_reveal", "clean"),
    "emotional_resonance": ("slow_fade", "emotional_breath", "elegant"),
    "quote_rhythm": ("beat_cut", "karaoke_punch", "bold_impact"),
    "cinematic_beauty": ("soft_fade", "minimal_frame", "minimal"),
    "suspense_hook": ("hard_cut_to_black", "suspense_break", "clean"),
}
#: Characters of the stories made for the test tables, and the words of their key events.
CHARACTERS = [("阿青", ["对峙", "冲突"]), ("沈默", ["威胁", "怒吼"])]


def molecules(spark: SparkSession) -> DataFrame:
    """One row a template; six rows, so always broadcast."""
    rows = [(k, *v[:6], v[6], v[7], v[8], *FUSION[k], FLOW[k]) for k, v in MOLECULES.items()]
    return spark.createDataFrame(rows, "mol_type string, target_dur int, min_clips int, max_clips int, dur_lo double, dur_hi double, emo_min int, events array<string>, shots array<string>, beats map<string,double>, w_molecular double, w_aesthetic double, w_hook double, w_promo double, flow array<int>")


def stage_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in enumerate(STAGES)], "node_pos int, stage string, ep_lo int, ep_hi int")
