"""Editing directions: which clips each may use, and its weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base weights of a clip's score, and by how much a direction changes them.
BASE = {"emotion": 3.5, "scene_rare": 1.8, "dialogue": 2.5, "content": 1.5, "faces": 1.5, "desc_len": 0.3}
MODIFIERS = {
    "promo": {"emotion": 1.1, "scene_rare": 1.1, "faces": 1.1},
    "highlight_mix": {"emotion": 1.3, "scene_rare": 1.2, "dialogue": 0.7},
    "first_person": {"emotion": 1.2, "faces": 1.3, "dialogue": 1.1},
    "third_person": {"dialogue": 1.3, "content": 1.2, "emotion": 0.9},
    "role_cut": {"faces": 1.5, "dialogue": 1.2, "scene_rare": 0.8},
    "episode_split": {"emotion": 1.1, "scene_rare": 1.0},
    "emotion_focus": {"emotion": 1.4, "content": 1.1, "scene_rare": 0.9},
    "commentary": {"dialogue": 1.4, "content": 1.3, "emotion": 0.8},
}
# Scene types that a first-person cut takes without dialogue; points of the five emotion levels.
INNER = ["对峙", "惊恐", "诡异", "特写", "恐怖", "紧张", "冲突"]
EMOTION_POINTS = [0, 5, 15, 40, 70]


def directions() -> Column:
    """Every direction, to be exploded beside a clip."""
    return F.array(*map(F.lit, MODIFIERS))


def weight(direction: Column, component: str, base: dict[str, float] | None = None) -> Column:
    """The base weight times the direction's modifier, to two decimals; unknown directions change nothing."""
    changed = F.create_map(*(F.lit(x) for d, m in MODIFIERS.items() for x in (d, m.get(component, 1.0))))
    return F.round(F.lit((base or BASE)[component]) * F.coalesce(changed[direction], F.lit(1.0)), 2).cast("decimal(8,2)")


def weighted_score(direction: Column, rarity: Column, dialogue: Column, content: Column, faces: Column, desc_length: Column | None = None, base: dict[str, float] | None = None) -> Column:
    """A clip's score under a direction, to one decimal (half away from zero, in decimals); emotion comes from the clip.

    rarity: sum over its scene types, where a genre's bonus stands in for a type's own rarity; dialogue: lines; content: whether
    it is described.
    """
    parts = {
        "emotion": F.coalesce(F.get(F.array(*map(F.lit, EMOTION_POINTS)), F.col("emotion") - 1), F.lit(15)),
        "scene_rare": F.least(F.lit(30), rarity.cast("decimal(8,2)") * 5),
        "dialogue": F.least(F.lit(40), dialogue * 8),
        "content": F.when(content, 12).otherwise(0),
        "faces": F.least(F.lit(16), faces * 4),
        "desc_len": F.least(F.lit(5.0), F.ln(F.greatest(F.lit(1), F.lit(0) if desc_length is None else F.coalesce(desc_length, F.lit(0)))) * 1.5),
    }
    total = F.lit(0).cast("decimal(12,4)")
    for name, value in parts.items():
        total = total + value.cast("decimal(8,2)") * weight(direction, name, base)
    return F.round(total, 1).cast("double")


def allowed(direction: Column, emotion: Column, lines: Column, types: Column, described: Column, faces: Column, keyword: Column | None = None) -> Column:
    """Whether a direction may use a clip; promo and unknown directions take all. keyword: the description names a wanted role."""
    spoken = lines > 0
    return (
        F.when(direction == "first_person", (emotion >= 3) & (spoken | F.arrays_overlap(types, F.array(*map(F.lit, INNER)))))
        .when(direction == "third_person", described | spoken | (F.size(types) >= 2))
        .when(direction == "role_cut", (faces > 0) & (spoken if keyword is None else spoken | keyword))
        .when(direction == "episode_split", (emotion >= 3) & (F.size(types) >= 1))
        .when(direction == "highlight_mix", emotion >= 4)
        .when(direction == "emotion_focus", (emotion >= 3) & (described | spoken))
        .when(direction == "commentary", spoken | described)
        .otherwise(F.lit(True))
    )
