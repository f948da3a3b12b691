"""Registered queries over full labels: decisions, roles after banding, what is rejected, frames and sampling times, files of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enrichment as E
from ..functions import rules as R
from ..operators import windows as W
from ..sources import adapters as A
from . import dims
from .catalogue import _any, _band, _case, query

_ALL = "(concat_ws(' ', event, event_subtype, desc_clean, mood, props, shot, scene, subtitle_text, event, event_subtype, mood, shot, chars_text))"


def _points(column: str, table: dict, default: int) -> str:
    return f"(case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end)"


def _trend(k: int) -> str:
    return "(case concat(emotion_trend, '|', action_direction) " + " ".join(f"when '{a}|{b}' then {v[k]}" for (a, b), v in dims.TREND.items()) + " else 2 end)"


def _int(condition: str, n: int = 1) -> str:
    return f"(case when {condition} then {n} else 0 end)"


def _five(value: str) -> str:
    return f"cast(greatest(1, least(5, {value})) as int)"


_ANCHORED, _LOUD = "dialogue_anchor in ('boundary', 'dense_speech')", "(has_speech_peak or beat_nearby)"
_STRONGER = f"(action_direction = '增强' and {_any('blob', dims.HIGH_ACTION)})"
#: The twin's steps: rich clips r, blob q, reject w, subtype v, values e with their first role, e1.
RICH = f"""r as ({A.RICH.format(events='events')}), q as (select *, {_ALL} as blob, length(trim(subtitle_text)) as sub_n from r),
 w as (select * exclude (reject_reason), case when reject_reason <> '无' and not ((reject_reason = '低质量' and visual_quality >= 3) or (reject_reason = '纯文字' and visual_quality >= 4 and sub_n < 12 and shot <> '空镜')) then reject_reason
   when {_case('blob', dims.REJECT_WORDS, "''")} <> '' then {_case('blob', dims.REJECT_WORDS, "''")} when shot = '空镜' and visual_quality <= 2 then '空镜' when sub_n >= 12 and {_any('blob', E.CARD_WORDS)} then '纯文字'
   when event_conf = '模糊' and visual_quality <= 2 then '模糊' when {_any('desc_clean', E.HEDGES)} then '推测污染' else '无' end as reject_reason from q),
 v as (select * exclude (event_subtype), case when event_subtype <> '无' then event_subtype when reject_reason in ('片头', '片尾', '纯文字', '白屏', '黑屏', '空镜') then reject_reason else {_case('blob', dims.SUBTYPE_WORDS, "'无'")} end as event_subtype from w),
 e as (select * exclude (event_conf, action_level), reject_reason = '无' as usable, case when reject_reason <> '无' then '模糊' else event_conf end as event_conf,
   {_five(f"{_trend(0)} + {_int(_any('blob', dims.HIGH_CONFLICT))} + {_int("face_quality in ('正脸', '半面')")} - {_int("reject_reason <> '无'", 4)}")} as promo_value,
   {_five(f"{_trend(1)} + {_int(_any('blob', dims.HIGH_CONFLICT))} + {_int(_STRONGER)} + {_int("face_quality in ('正脸', '半面')")} + {_int('sub_n >= 4')} + {_int(_LOUD)} - {_int("reject_reason <> '无'", 4)}")} as hook_value,
   {_five('emotion')} as emotion_value, {_five('action_level')} as action_value, {_five('visual_quality')} as visual_value, cast(least(5, action_level + {_int(_STRONGER)}) as int) as action_level,
   {_points('composition_type', E.COMPOSITION, 0)} + {_points('light_beauty', E.LIGHT, 1)} + {_points('color_palette', E.COLOUR, 1)} as aesthetic_score,
   {_five(f"speech_density + {_int("transcript_excerpt <> ''")} + {_int(_ANCHORED)}")} as dialogue_value, {_five(f"audio_energy + {_int('beat_nearby')} + {_int('has_speech_peak')}")} as rhythm_value,
   {_five(f"audio_energy + {_int('has_speech_peak', 2)} + {_int('beat_nearby')}")} as audio_hook_value,
   case when transcript_excerpt <> '' and {_ANCHORED} then 'dialogue' when {_LOUD} then 'impact_audio' else 'visual' end as cut_anchor, {_case('blob', dims.SIDE_WORDS, "'无'")} as conflict_side from v),
 e0 as (select *, {_five('aesthetic_score')} as cinematic_beauty, case when hook_value >= 4 then 'hook' when event = '打斗' or event_subtype in ('奇幻爆发', '怒吼', '倒地') then 'climax' when event in ('冲突', '威胁', '对峙') then 'rise'
   when event in ('跪地', '悲伤') or event_subtype in ('哭泣', '受伤') then 'setup' when promo_value <= 2 then 'ending' else 'rise' end as first_role from e),
 e1 as (select *, case first_role when 'hook' then 'on_action' when 'setup' then 'after_reaction' when 'ending' then 'after_reaction' else 'before_action' end as best_cut,
   case first_role when 'hook' then 0.5 when 'setup' then 1.5 when 'ending' then 0.5 else 1.0 end::double as pre_roll, case first_role when 'hook' then 2.0 when 'setup' then 3.5 when 'ending' then 1.5 else 2.5 end::double as post_roll,
   case first_role when 'hook' then 2.5 when 'setup' then 5.0 when 'ending' then 2.0 else 3.5 end::double as suggested_duration from e0)"""
DECISIONS = ["series_id", "ingest_pos", "reject_reason", "event_subtype", "usable", "event_conf", "promo_value", "hook_value", "emotion_value", "action_value", "visual_value", "action_level", "aesthetic_score", "cinematic_beauty", "dialogue_value", "rhythm_value", "audio_hook_value", "cut_anchor", "conflict_side", "first_role", "best_cut", "pre_roll", "post_roll", "suggested_duration"]
BANDED = f"{RICH}, bb as (select * exclude (hook_value, promo_value), hook_value as raw_hook, {_band('hook_value', 'series_id', 'ingest_pos')} as hook_value, {_band('promo_value', 'series_id', 'ingest_pos')} as promo_value from e1), b1 as (select *, case hook_value when 5 then 'hook' when 4 then 'climax' when 3 then 'rise' when 2 then 'setup' else 'ending' end as cut_role from bb)"


def decided(spark, sf_dir):
    return E.decided(A.rich(spark, sf_dir))


def banded(spark, sf_dir):
    """Decisions with hook and promo as bands within their series and the role that the hook band gives; the timing stays the first role's."""
    d = E.decided(A.rich(spark, sf_dir).repartition("series_id"))  # the windows' own exchange, made before the work on texts
    d = W.banded(d, "hook_value", ["series_id"], ["ingest_pos"], "__hook")
    d = W.banded(d, "promo_value", ["series_id"], ["ingest_pos"], "__promo")
    return d.withColumns({"raw_hook": F.col("hook_value"), "hook_value": F.col("__hook"), "promo_value": F.col("__promo")}).drop("__hook", "__promo").withColumn("cut_role", R.cut_role(F.col("hook_value")))


@query(f"with {RICH} select {', '.join(DECISIONS)} from e1")
def enriched_decisions(spark, sf_dir):
    """All decision columns of every clip, before banding."""
    return decided(spark, sf_dir).select(*DECISIONS)


@query(f"with {BANDED} select series_id, ingest_pos, raw_hook, hook_value, promo_value, first_role, cut_role, best_cut, pre_roll from b1")
def enriched_roles(spark, sf_dir):
    return banded(spark, sf_dir).select("series_id", "ingest_pos", "raw_hook", "hook_value", "promo_value", "first_role", "cut_role", "best_cut", "pre_roll")


@query(f"with {RICH} select series_id, count(*) as total, count(*) filter (where not usable) as rejected, count(*) filter (where usable) as kept, count(distinct ep) as episodes from e1 group by series_id")
def enrichment_totals(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("total"), F.count_if(~F.col("usable")).alias("rejected"), F.count_if("usable").alias("kept"), F.count_distinct("ep").alias("episodes"))


@query(f"with {RICH} select reject_reason, series_id, ingest_pos, ep, time_s from e1 where not usable")
def rejects_file(spark, sf_dir):
    """Rejected clips, written to a folder a reason and read back."""
    there = A.new_folder(spark, "rejects")
    decided(spark, sf_dir).where(~F.col("usable")).select("reject_reason", "series_id", "ingest_pos", "ep", "time_s").write.partitionBy("reject_reason").parquet(there)
    return spark.read.parquet(there)


_LINE_JSON = "concat('{\"event\":\"', event, '\",\"shot\":\"', shot, '\",\"chars\":\"', chars_text, '\",\"hint\":\"', desc_clean, '\",\"reject_reason\":\"', reject_reason, '\",\"hook_value\":', hook_value, ',\"promo_value\":', promo_value, ',\"cut_role\":\"', cut_role, '\"}')"


@query(f"with {BANDED} select concat('ep', lpad(cast(ep as varchar), 2, '0'), '_f', ingest_pos, ' ', printf('%.1f', time_s), 's ', {_LINE_JSON}) as line from b1")
def enriched_lines(spark, sf_dir):
    """The enriched clips as lines of frame, time and JSON, written as text and read back."""
    there = A.new_folder(spark, "lines")
    body = F.to_json(F.struct("event", "shot", F.col("chars_text").alias("chars"), F.col("desc_clean").alias("hint"), "reject_reason", "hook_value", "promo_value", "cut_role"))
    line = F.concat_ws(" ", F.concat(F.lit("ep"), F.lpad(F.col("ep").cast("string"), 2, "0"), F.lit("_f"), "ingest_pos"), F.concat(F.format_string("%.1f", "time_s"), F.lit("s")), body)
    banded(spark, sf_dir).select(line.alias("value")).write.text(there)
    return spark.read.text(there).withColumnRenamed("value", "line")


@query(f"with {RICH}, src as (select case when ingest_pos % 2 = 0 then 'v2' else 'v1' end as source, * from e1) select source, count(*) as rows_, count(distinct ep) as episodes, count(distinct series_id) as series from src group by source")
def load_statistics(spark, sf_dir):
    """Rows, episodes and series that each source gives."""
    src = decided(spark, sf_dir).withColumn("source", F.when(F.col("ingest_pos") % 2 == 0, "v2").otherwise("v1"))
    return src.groupBy("source").agg(F.count("*").alias("rows_"), F.count_distinct("ep").alias("episodes"), F.count_distinct("series_id").alias("series"))


@query("""with f as (select event_id, cast(event_id * 7 % 256 as double) as mean, cast(event_id % 40 as double) / 10 as spread, cast(event_id % 240 as double) as secs, cast((event_id * 37) % 180 as double) as t from events)
 select event_id, case when mean >= 245 then '白屏' when mean <= 8 then '黑屏' when spread <= 0.8 and (mean <= 20 or mean >= 235) then '低质量' else '无' end as exposure,
 case when secs < 90 then 'short' when secs < 180 then 'medium' else 'long' end as length_class, case when secs < 90 then 4 when secs < 180 then 7 else 10 end as frames,
 greatest(0.0, t - 1.5) as preview_start, greatest(0.0, t - 0.8) as montage_start from f""")
def frame_checks(spark, sf_dir):
    """Exposure class from brightness, episode class with its frame budget, and where previews (3 s) and montages (2.5 s) of a frame begin."""
    e = A.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % 256).cast("double").alias("mean"), ((F.col("event_id") % 40).cast("double") / 10).alias("spread"), (F.col("event_id") % 240).cast("double").alias("secs"), ((F.col("event_id") * 37) % 180).cast("double").alias("t"))
    name, frames = E.length_class(F.col("secs"))
    return e.select("event_id", E.exposure(F.col("mean"), F.col("spread")).alias("exposure"), name.alias("length_class"), frames.alias("frames"), F.greatest(F.lit(0.0), F.col("t") - 1.5).alias("preview_start"), F.greatest(F.lit(0.0), F.col("t") - 0.8).alias("montage_start"))


@query("""with t as (select user_id, event_id, unnest([greatest(0.5, cast((event_id * 37) % 180 as double) - 1.5), cast((event_id * 37) % 180 as double), cast((event_id * 37) % 180 as double) + 1.5]) as t_s, unnest([0, 1, 2]) as k from events)
 select user_id, count(*) as samples, round(sum(t_s), 1) as total_s, min(t_s) as first_s from t group by user_id""")
def neighbour_times(spark, sf_dir):
    """Each frame's own time and that 1.5 s before (0.5 at least) and after it: the samples a run would take."""
    t = ((F.col("event_id") * 37) % 180).cast("double")
    e = A.table(spark, sf_dir, "events").select("user_id", F.explode(F.array(F.greatest(F.lit(0.5), t - 1.5), t, t + 1.5)).alias("at"))
    return e.groupBy("user_id").agg(F.count("*").alias("samples"), F.round(F.sum("at"), 1).alias("total_s"), F.min("at").alias("first_s"))


@query("""with d as (select distinct user_id, cast(60 + user_id % 200 as double) as secs from events) select case when secs < 90 then 'short' when secs < 180 then 'medium' else 'long' end as length_class, count(*) as episodes,
 sum(case when secs < 90 then 4 when secs < 180 then 7 else 10 end)::bigint as frames from d group by 1""")
def sampling_estimate(spark, sf_dir):
    """How many frames a run over all episodes would take."""
    d = A.table(spark, sf_dir, "events").select("user_id", (60 + F.col("user_id") % 200).cast("double").alias("secs")).distinct()
    name, frames = E.length_class(F.col("secs"))
    return d.groupBy(name.alias("length_class")).agg(F.count("*").alias("episodes"), F.sum(frames).alias("frames"))
