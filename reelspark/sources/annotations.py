"""Annotation lines: one frame a line, "ep01_f1 2s " and then a label, as JSON (maybe inside a reply's prose) or as a legacy sentence.

Lines that are null, blank or have fewer than three parts give no row; a time that is no number becomes 0; zero and null label
values become the defaults. Fractional times are kept, though the older readers made them 0.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R

LABEL = """shot string, event string, event_subtype string, mood string, emo int, action_level int, visual_quality int, audio_energy int, speech_density int,
 face_quality string, action_direction string, emotion_trend string, reject_reason string, usable boolean, hint string, transcript_excerpt string,
 promo_value int, hook_value int, cut_role string, best_cut string, pre_roll double, suggested_duration double"""
#: What label fields are where nothing is given.
NUMBERS = {"emo": 3, "action_level": 1, "visual_quality": 3, "audio_energy": 1, "speech_density": 1, "promo_value": 1, "hook_value": 1, "pre_roll": 1.0, "suggested_duration": 2.5}
TEXTS = {"event": "", "event_subtype": "无", "shot": "", "face_quality": "", "action_direction": "静止", "emotion_trend": "稳定", "reject_reason": "无", "transcript_excerpt": "", "cut_role": "unknown", "best_cut": "before_action"}
#: Guesses in a hint and what stands for them.
GUESSES = [("似乎在", ""), ("似在", ""), ("似乎", ""), ("可能", ""), ("大概", ""), ("仿佛", ""), ("看起来像", ""), ("意味着", ""), ("正在说话", "嘴唇微张"), ("在说话", "嘴唇微张")]


def lines(raw: DataFrame, value: str = "value") -> DataFrame:
    """frame_id, ep, time_s and body beside the other columns."""
    part = F.split(F.trim(value), " ", 3)
    head = F.element_at(part, 1)
    return (
        raw.where(F.size(part) == 3)
        .withColumns({"frame_id": head, "ep": R.number(F.regexp_extract(head, r"^(?:ep)?(\d+)", 1), "int"), "time_s": F.coalesce(R.number(F.replace(F.element_at(part, 2), F.lit("s"), F.lit("")), "double"), F.lit(0.0)), "body": F.element_at(part, 3)})
        .drop(value)
    )


#: What balances an object: braces, and quotes with what they escape.
_MARKS = re.compile(r'[{}"\\]')


def _balanced(text: str, quotes: bool) -> dict[int, int]:
    """Where balanced objects begin and end, inner ones too, in one pass. Braces in strings don't count if quotes are heeded within objects."""
    open_, out, inside, skip = [], {}, False, -1
    for m in _MARKS.finditer(text):
        at, c = m.start(), m[0]
        if at == skip:
            continue
        if c == "\\":
            skip = at + 1 if inside else -1
        elif c == '"':
            inside = quotes and bool(open_) and not inside
        elif inside:
            continue
        elif c == "{":
            open_.append(at)
        elif open_:
            out[open_.pop()] = at + 1
    return out


def first_shot(text: str | None) -> str | None:
    """The first object of a text that is JSON and has a shot; objects before it, inside it or never closed are passed over."""
    if text is None or '"shot"' not in text:
        return None
    spans = _balanced(text, False) | _balanced(text, True)
    last = text.rfind('"shot"')
    for begin in sorted(k for k in spans if k < last):
        if text.find('"shot"', begin, spans[begin]) < 0:
            continue
        try:
            found, end = json.JSONDecoder().raw_decode(text, begin)
        except (ValueError, RecursionError):
            continue
        if found.get("shot") is not None:
            return text[begin:end]
    return None


@F.pandas_udf(T.StringType())
def _first_shots(texts: pd.Series) -> pd.Series:
    return texts.map(first_shot)


def label(text: Column) -> Column:
    """The label object of a text with a shot: the one in a fence, else from the first brace to the last, else the first balanced one
    that has a shot; null where there is none. Only texts that neither try reads are scanned."""
    tries = [F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(text, r"(?s)\{.*\}", 0)]
    found = [F.from_json(t, LABEL) for t in tries]
    plain = F.coalesce(*(F.when(f["shot"].isNotNull(), f) for f in found))
    return F.coalesce(plain, F.from_json(_first_shots(F.when(plain.isNull() & F.contains(text, F.lit('"shot"')), text)), LABEL))


def typed(parsed: DataFrame) -> DataFrame:
    """Rows of lines() as clips: format, emotion, label fields with defaults, and scene_types in the order they were named."""
    v, legacy = F.col("__v"), F.col("__v").isNull()
    told = F.regexp_extract("body", r"情绪[评分：:]*\s*(\d+)", 1)
    number = {("emotion" if k == "emo" else k): R.falsy(v[k], d) for k, d in NUMBERS.items()}
    number["emotion"] = F.when(legacy, F.coalesce(R.number(told, "int"), F.lit(3))).otherwise(number["emotion"])
    number["action_level"] = F.when(legacy, R.clamp(number["emotion"])).otherwise(number["action_level"])
    text = {k: F.coalesce(F.nullif(v[k], F.lit("")), F.lit(d)) for k, d in TEXTS.items()}
    said = F.split(F.concat_ws("/", v["event"], v["event_subtype"], v["mood"], v["shot"]), r"[;；,，/]")
    listed = F.split(F.regexp_extract("body", r"情绪.*?类型[：:]\s*([^\s。，]+)", 1), "/")
    types = F.array_distinct(F.filter(F.transform(F.when(legacy, listed).otherwise(said), lambda x: F.trim(x)), lambda x: ~x.isin("", "无")))
    return parsed.withColumn("__v", label(F.col("body"))).withColumns({"format": F.when(legacy, "legacy").otherwise("v2"), "usable": F.coalesce(v["usable"], F.lit(True)), "hint": F.coalesce(v["hint"], F.lit("")), **number, **text, "scene_types": types}).drop("__v", "body")


def as_lines(clips: DataFrame, fields: list[str]) -> DataFrame:
    """The clips' label lines as value, for writing as text; fields: the columns that go into the label."""
    two = F.col("ep").cast("string")
    ep = F.when(F.length(two) < 2, F.lpad(two, 2, "0")).otherwise(two)
    return clips.select(F.format_string("ep%s_f%s %ss %s", ep, F.col("ingest_pos").cast("string"), F.col("time_s").cast("string"), F.to_json(F.struct(*fields))).alias("value"))


def cleaned_hint(hint: Column) -> Column:
    """Without bracketed tags and guesses, spaces collapsed."""
    plain = F.regexp_replace(hint, r"\[[^\]]+\]", "")
    plain = reduce(lambda out, g: F.replace(out, F.lit(g[0]), F.lit(g[1])), GUESSES, plain)
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def hint_tag(hint: Column, name: str) -> Column:
    """What a hint's [name: ...] says, else null."""
    return F.nullif(F.trim(F.regexp_extract(hint, rf"\[{name}[:：]\s*([^\]]+)\]", 1)), F.lit(""))


def usable(parsed: DataFrame) -> DataFrame:
    """Rows of lines() whose label is usable and has no reject reason; what a label leaves out counts as fine."""
    told = lambda k, d: F.coalesce(F.get_json_object("body", f"$.{k}"), F.lit(d))
    return parsed.where((F.lower(told("usable", "true")) != "false") & (told("reject_reason", "无") == "无"))
