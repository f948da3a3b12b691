"""Registered queries of what a selection leaves behind: timeline, quality and review documents, written and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import enrichment as E
from ..functions import selection as S
from ..sources import adapters as A
from ..sources import reviews as V
from . import dims, selection
from .catalogue import _any, query

_KEY = ["series_id", "mol_type"]
_CUTS = selection._CUTS
_PROFILE = "case mol_type " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in dims.PROFILES.items()) + " end"
_SUBTITLE = "case when transcript_excerpt <> '' then transcript_excerpt else subtitle_text end"


def timelines(spark, sf_dir):
    """One document a series and template: clips, subtitles and transitions in order, with the profiles of the template."""
    c = selection.cuts(spark, sf_dir)
    nxt = F.lead("cut_id").over(Window.partitionBy(*_KEY).orderBy("place"))
    said = F.when(E.text("transcript_excerpt") != "", F.col("transcript_excerpt")).otherwise(E.text("subtitle_text"))
    profile = lambda k: F.element_at(F.create_map(*(F.lit(x) for m, v in dims.PROFILES.items() for x in (m, v[k]))), F.col("mol_type"))
    end = F.round(F.col("offset_s") + F.col("cut_s"), 3)
    c = c.withColumns({"__next": nxt, "__said": said, "__end": end})
    clip = F.struct("place", F.col("cut_id").alias("id"), F.col("ep").alias("source_episode"), F.col("time_s").alias("source_time"), F.col("start_s").alias("cut_start"), F.col("cut_s").alias("cut_duration"), F.col("offset_s").alias("timeline_start"), F.col("__end").alias("timeline_end"), "cut_role", "cut_anchor", "best_cut", F.col("molecular").alias("score"), F.struct("event", "event_subtype", "face_quality", "dialogue_anchor", "has_speech_peak", "beat_nearby").alias("tags"))
    subtitle = F.when(F.col("__said") != "", F.struct("place", F.col("cut_id").alias("clip_id"), F.col("__said").alias("text"), F.col("offset_s").alias("start"), F.col("__end").alias("end"), profile(2).alias("style")))
    cross = F.when(F.col("__next").isNotNull(), F.struct("place", F.col("cut_id").alias("from"), F.col("__next").alias("to"), F.lit("xfade").alias("type"), F.lit(0.3).alias("duration"), profile(0).alias("profile")))
    listed = lambda x, name: F.array_sort(F.collect_list(x)).alias(name)  # noqa: E731  (nulls are left out)
    doc = c.groupBy(*_KEY).agg(listed(clip, "clips"), listed(subtitle, "subtitles"), listed(cross, "transitions"), F.round(F.max("__end"), 3).alias("duration"))
    return doc.select(F.lit("promo_timeline_v1").alias("schema"), *_KEY, profile(0).alias("transition_profile"), profile(1).alias("overlay_profile"), "duration", "clips", "subtitles", "transitions")


@query(f"""with recursive {_CUTS}, z as (select *, {_SUBTITLE} as said, lead(cut_id) over (partition by series_id, mol_type order by place) as nx, round(offset_s + cut_s, 3) as end_s from ue)
 select series_id, mol_type, {_PROFILE} as transition_profile, round(max(end_s), 3) as duration, count(*) as n_clips, count(*) filter (where said <> '') as n_subtitles, count(nx) as n_transitions,
 string_agg(cut_id, ',' order by place) as clip_ids, coalesce(string_agg(said, '|' order by place) filter (where said <> ''), '') as texts, round(sum(end_s), 2) as ends, string_agg(cut_anchor, ',' order by place) as anchors from z group by series_id, mol_type""")
def timeline_documents(spark, sf_dir):
    """The documents written as JSON, one line each, and what is read back from them."""
    there = A.new_folder(spark, "timelines")
    docs = timelines(spark, sf_dir)
    docs.write.json(there)
    d = spark.read.schema(docs.schema).json(there)
    pick = lambda c, f, sep: F.array_join(F.transform(c, lambda x: x[f]), sep)
    ends = F.round(F.aggregate(F.transform("clips", lambda x: x["timeline_end"]), F.lit(0.0), lambda a, x: a + x), 2)
    return d.select(*_KEY, "transition_profile", "duration", F.size("clips").cast("long").alias("n_clips"), F.size("subtitles").cast("long").alias("n_subtitles"), F.size("transitions").cast("long").alias("n_transitions"), pick("clips", "id", ",").alias("clip_ids"), pick("subtitles", "text", "|").alias("texts"), ends.alias("ends"), pick("clips", "cut_anchor", ",").alias("anchors"))


#: Checks of a selection: level, code, template (None: all) and condition over the counts of `counted`.
CHECKS = [
    ("error", "insufficient_clips", None, "n < need"), ("warn", "low_quality_clips", None, "low_q > 0"), ("warn", "ep_concentration", None, "top_ep > n * 0.6"),
    ("warn", "weak_hook", "hook_clash", "not first_high"), ("warn", "low_conflict_density", "hook_clash", "highs < 2"), ("info", "low_action_avg", "hook_clash", "action < 3"),
    ("warn", "no_transcript", "quote_rhythm", "quoted_n = 0"), ("info", "low_speech_density", "quote_rhythm", "density < 2"), ("info", "no_rhythm_anchor", "quote_rhythm", "rhythm = 0"),
    ("info", "flat_emotion", "emotional_resonance", "n >= 3 and emo_span < 1"), ("info", "no_tail_breath", "emotional_resonance", "last_action >= 4"), ("info", "low_audio_energy", "emotional_resonance", "energy < 2"),
    ("warn", "weak_dialogue_support", "identity_twist", "spoken < 2"), ("info", "no_twist_event", "identity_twist", "twists = 0"),
    ("warn", "weak_cliffhanger", "suspense_hook", "last_emotion < 3 and last_action < 3"), ("info", "low_tension", "suspense_hook", "tension < 3"),
    ("warn", "low_visual_avg", "cinematic_beauty", "looks < 3.5"), ("info", "monotone_shots", "cinematic_beauty", "shots < 2"),
]
_TWISTS = ["对峙", "跪地", "冲突", "反转"]
_COUNTED = f"""{_CUTS}, va as (select *, {selection._HIGH} as high, count(*) over (partition by series_id, mol_type, ep) as in_ep, row_number() over (partition by series_id, mol_type, ep, round_even(time_s / 5, 0) order by place) as in_window from ue),
 vb as (select series_id, mol_type, count(*) as n, min(min_clips) as need, count(*) filter (where visual_quality < 3) as low_q, max(in_ep) as top_ep, arg_min(high, place) as first_high, count(*) filter (where high) as highs, avg(action_level) as action,
  count(*) filter (where transcript_excerpt <> '') as quoted_n, avg(speech_density) as density, count(*) filter (where has_speech_peak or beat_nearby) as rhythm, max(emotion) - min(emotion) as emo_span, arg_max(action_level, place) as last_action, avg(audio_energy) as energy,
  count(*) filter (where dialogue_visible or speech_density >= 3) as spoken, count(*) filter (where {_any('ev', _TWISTS)}) as twists, arg_max(emotion, place) as last_emotion, avg(emotion) as tension, avg(visual_quality) as looks, count(distinct shot) as shots,
  count(*) filter (where not usable) as unusable, count(*) filter (where in_window > 1) as repeated, string_agg(distinct lpad(cast(ep as varchar), 3, '0'), ',' order by lpad(cast(ep as varchar), 3, '0')) as episodes from va group by series_id, mol_type)"""


def counted(spark, sf_dir):
    """What the checks look at, one row a series and template."""
    c = selection.cuts(spark, sf_dir).withColumn("_event", E.event_text()).withColumns({"high": S.high_conflict(F.col("_event")), "in_ep": F.count("*").over(Window.partitionBy(*_KEY, "ep")), "in_window": F.row_number().over(Window.partitionBy(*_KEY, "ep", F.bround(F.col("time_s") / 5, 0)).orderBy("place"))})
    twist = F.greatest(*(F.contains("_event", F.lit(t)) for t in _TWISTS))
    n = lambda cond: F.count_if(F.expr(cond))
    return c.groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.min("min_clips").alias("need"), n("visual_quality < 3").alias("low_q"), F.max("in_ep").alias("top_ep"), F.min_by("high", "place").alias("first_high"), F.count_if("high").alias("highs"), F.avg("action_level").alias("action"),
        n("transcript_excerpt <> ''").alias("quoted_n"), F.avg("speech_density").alias("density"), n("has_speech_peak or beat_nearby").alias("rhythm"), (F.max("emotion") - F.min("emotion")).alias("emo_span"), F.max_by("action_level", "place").alias("last_action"), F.avg("audio_energy").alias("energy"),
        n("dialogue_visible or speech_density >= 3").alias("spoken"), F.count_if(twist).alias("twists"), F.max_by("emotion", "place").alias("last_emotion"), F.avg("emotion").alias("tension"), F.avg("visual_quality").alias("looks"), F.count_distinct("shot").alias("shots"),
        n("not usable").alias("unusable"), n("in_window > 1").alias("repeated"), F.array_join(F.sort_array(F.collect_set(F.lpad(F.col("ep").cast("string"), 3, "0"))), ",").alias("episodes"),
    )


def findings():
    """The findings of a row of counted, as an array of level and code."""
    hit = lambda kind, cond: F.expr(cond) if kind is None else (F.col("mol_type") == kind) & F.expr(cond)
    return F.array_compact(F.array(*(F.when(hit(kind, cond), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, kind, cond in CHECKS)))


_FOUND = "list_filter([" + ", ".join("case when " + (f"mol_type = '{kind}' and " if kind else "") + f"({cond}) then struct_pack(level := '{level}', code := '{code}') end" for level, code, kind, cond in CHECKS) + "], lambda x: x is not null)"


@query(f"with recursive {_COUNTED} select series_id, mol_type, f.level as level, f.code as code from (select series_id, mol_type, unnest({_FOUND}) as f from vb)")
def full_findings(spark, sf_dir):
    """What the checks of all templates find."""
    return counted(spark, sf_dir).select(*_KEY, F.inline(findings()))


@query(f"""with recursive {_COUNTED}, vc as (select *, {_FOUND} as found from vb) select series_id, mol_type, n, unusable, low_q, repeated, top_ep, episodes, first_high, len(list_filter(found, lambda x: x.level = 'error')) = 0 as passed,
 len(list_filter(found, lambda x: x.level = 'error'))::bigint as errors, len(list_filter(found, lambda x: x.level = 'warn'))::bigint as warnings, array_to_string(list_transform(found, lambda x: x.code), ',') as codes from vc""")
def quality_documents(spark, sf_dir):
    """The quality report of each series and template, written as JSON and read back."""
    there = A.new_folder(spark, "quality")
    levels = lambda level: F.size(F.filter("found", lambda x: x["level"] == level)).cast("long")
    d = counted(spark, sf_dir).withColumn("found", findings())
    d = d.select(*_KEY, "n", "unusable", "low_q", "repeated", "top_ep", "episodes", "first_high", (levels("error") == 0).alias("passed"), levels("error").alias("errors"), levels("warn").alias("warnings"), F.array_join(F.transform("found", lambda x: x["code"]), ",").alias("codes"))
    d.write.json(there)
    return spark.read.schema(d.schema).json(there)


_SHEET = ["series_id", "mol_type", "keep", "ep", "time_s", "suggested_dur", "cut_role", "best_cut", "event", "subtype", "emo", "visual_quality", "face_quality", "hook_value", "promo_value", "description"]


@query(f"""with recursive {_CUTS} select series_id, mol_type, 'Y' as keep, ep, cast(time_s as int) as time_s, round(suggested_duration, 1) as suggested_dur, cut_role, best_cut, event, event_subtype as subtype, emotion as emo, visual_quality, face_quality, hook_value, promo_value,
 substr(desc_clean, 1, 80) as description from ue""")
def review_sheet(spark, sf_dir):
    """The sheet that reviewers fill in, all 14 columns, written as CSV with a header and read back."""
    there = A.new_folder(spark, "sheet")
    c = selection.cuts(spark, sf_dir).select(*_KEY, F.lit("Y").alias("keep"), "ep", F.col("time_s").cast("int").alias("time_s"), F.round("suggested_duration", 1).alias("suggested_dur"), "cut_role", "best_cut", "event", F.col("event_subtype").alias("subtype"), F.col("emotion").alias("emo"), "visual_quality", "face_quality", "hook_value", "promo_value", F.substring("desc_clean", 1, 80).alias("description"))
    c.write.csv(there, header=True, encoding="UTF-8", quoteAll=True)
    return spark.read.csv(there, header=True, schema=c.schema, encoding="UTF-8").select(*_SHEET)


@query(f"""with recursive {_CUTS}, d as (select doc_id, quality from labels), s as (select ue.*, d.quality from ue left join d on d.doc_id = ue.ingest_pos)
 select series_id, mol_type, cut_id, ep, time_s, hook_value, promo_value, case when quality = 1 then 'keep' when quality = 0 then 'reject' else 'unrated' end as decision from s""")
def decision_export(spark, sf_dir):
    """Reviewers' decisions beside what was shown; 'unrated' where there is none. Written as CSV and read back."""
    there = A.new_folder(spark, "decisions")
    d = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ingest_pos"), "quality")
    c = selection.cuts(spark, sf_dir).join(d, "ingest_pos", "left")
    c = c.select(*_KEY, "cut_id", "ep", "time_s", "hook_value", "promo_value", F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "reject").otherwise("unrated").alias("decision"))
    c.write.csv(there, header=True)
    return spark.read.csv(there, header=True, schema=c.schema)


@query(f"""with recursive {_CUTS}, d as (select doc_id, quality, toxic from labels), s as (select ue.*, d.quality, d.toxic from ue left join d on d.doc_id = ue.ingest_pos)
 select series_id, count(*) as total, count(*) filter (where quality = 1) as kept, count(*) filter (where quality = 0) as rejected, count(*) filter (where toxic = 1) as starred, round(100.0 * count(quality) / count(*), 1) as percent from s group by series_id""")
def review_progress(spark, sf_dir):
    d = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ingest_pos"), "quality", "toxic")
    c = selection.cuts(spark, sf_dir).join(d, "ingest_pos", "left")
    return c.groupBy("series_id").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("kept"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("toxic") == 1).alias("starred"), F.round(F.lit(100.0) * F.count("quality") / F.count("*"), 1).alias("percent"))


@query(f"""with recursive {_CUTS} select series_id, mol_type, cut_id, cast(row_number() over (partition by series_id, mol_type order by hook_value desc, emotion desc, ep, time_s, cut_id) as int) as by_hook, cast(row_number() over (partition by series_id, mol_type order by ep, time_s, cut_id) as int) as by_time from ue""")
def reviewer_order(spark, sf_dir):
    """The two orders in which a reviewer may go through a selection."""
    w = Window.partitionBy(*_KEY)
    return selection.cuts(spark, sf_dir).select(*_KEY, "cut_id", F.row_number().over(w.orderBy(F.desc("hook_value"), F.desc("emotion"), "ep", "time_s", "cut_id")).alias("by_hook"), F.row_number().over(w.orderBy("ep", "time_s", "cut_id")).alias("by_time"))


@query(f"""with recursive {_CUTS}, l as (select 'EP' || lpad(cast(ep as varchar), 2, '0') as source, cast(floor(start_s * 25 + 0.5) as bigint) as src_start, cast(floor(cut_s * 25 + 0.5) as bigint) as src_dur from ue)
 select source, max(src_start + src_dur) + 1 as source_frames, count(*) as entries from l group by source""")
def source_lengths(spark, sf_dir):
    """An edit list written as JSON lines and read back; the least number of frames each of its sources must have."""
    there = A.new_folder(spark, "edits")
    frames = lambda c: F.floor(F.col(c) * 25 + 0.5).cast("long")
    selection.cuts(spark, sf_dir).select(F.concat(F.lit("EP"), F.lpad(F.col("ep").cast("string"), 2, "0")).alias("source"), frames("start_s").alias("src_start"), frames("cut_s").alias("src_dur"), frames("offset_s").alias("rec_start"), F.col("cut_id").alias("label")).write.json(there)
    edits = V.edit_list(spark, there)
    return edits.groupBy("source").agg((F.max(F.col("src_start") + F.col("src_dur")) + 1).alias("source_frames"), F.count("*").alias("entries"))


_REMAIN = f"{_CUTS}, zz as (select series_id, mol_type, ingest_pos from rl except select series_id, mol_type, ingest_pos from ue)"


@query(f"with recursive {_REMAIN} select series_id, mol_type, count(*) as unused from zz group by series_id, mol_type")
def unused_candidates(spark, sf_dir):
    """How many ranked clips a selection leaves over."""
    r = selection.kept_ranking(spark, sf_dir)
    left = r.select(*_KEY, "ingest_pos").join(selection.selected(r).select(*_KEY, "ingest_pos"), [*_KEY, "ingest_pos"], "left_anti")
    return left.groupBy(*_KEY).agg(F.count("*").alias("unused"))


def _tc(x: str) -> str:
    f = f"cast(floor(greatest({x}, 0.0) * 25 + 0.5) as bigint)"
    return "||':'||".join(f"lpad(cast({p} as varchar), 2, '0')" for p in (f"{f} // 90000", f"({f} // 1500) % 60", f"({f} // 25) % 60", f"{f} % 25"))


#: Sources are named in several ways, some without a number.
_SOURCE = "(case ep % 3 when 0 then '第' || ep || '集.mp4' when 1 then 'Episode_' || ep || '.final.mp4' else '片头 title-card long name' end)"
_REEL = f"(case when regexp_matches({_SOURCE}, '[0-9]') then 'EP' || lpad(regexp_extract({_SOURCE}, '[0-9]+'), greatest(2, length(regexp_extract({_SOURCE}, '[0-9]+')))::int, '0') else coalesce(nullif(substr(trim(regexp_replace({_SOURCE}, '[^\\x20-\\x7E]', '', 'g')), 1, 12), ''), 'REEL') end)"


def reel(source):
    """A source's ASCII reel name: EP and its first digits, else its printable ASCII letters cut at twelve."""
    digits = F.regexp_extract(source, r"([0-9]+)", 1)
    number = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    plain = F.substring(F.trim(F.regexp_replace(source, r"[^\x20-\x7E]", "")), 1, 12)
    return F.when(digits != "", F.concat(F.lit("EP"), number)).otherwise(F.coalesce(F.nullif(plain, F.lit("")), F.lit("REEL")))


@query(f"""with recursive {_CUTS} select series_id, mol_type, cast(place as int) as event, {_REEL} as reel, {_tc('start_s')} as src_in, {_tc('start_s + cut_s')} as src_out, {_tc('offset_s')} as rec_in, {_tc('offset_s + cut_s')} as rec_out, cut_id as label from ue""")
def edit_list_file(spark, sf_dir):
    """The frame-accurate edit list, events in order within a series' file, with source and record times; written as CSV and read back."""
    from ..functions.rules import timecode

    there = A.new_folder(spark, "edl")
    source = F.when(F.col("ep") % 3 == 0, F.concat(F.lit("第"), "ep", F.lit("集.mp4"))).when(F.col("ep") % 3 == 1, F.concat(F.lit("Episode_"), "ep", F.lit(".final.mp4"))).otherwise("片头 title-card long name")
    end = lambda a: timecode(F.col(a) + F.col("cut_s"))
    c = selection.cuts(spark, sf_dir).select(*_KEY, F.col("place").alias("event"), reel(source).alias("reel"), timecode(F.col("start_s")).alias("src_in"), end("start_s").alias("src_out"), timecode(F.col("offset_s")).alias("rec_in"), end("offset_s").alias("rec_out"), F.col("cut_id").alias("label"))
    c.repartition("series_id").sortWithinPartitions("series_id", "mol_type", "event").write.csv(there, header=True)
    return spark.read.csv(there, header=True, schema=c.schema)
