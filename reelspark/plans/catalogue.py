"""The registered queries over the driver's tables, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import directions as D
from ..functions import labels as L
from ..functions import rules as R
from ..operators import joins as J
from ..operators import ranks as K
from ..operators import windows as W
from ..sources import adapters as A
from ..sources import annotations as N
from ..sources import profiles as P
from ..sources import reviews as V
from ..sources import subtitles as S
from ..streaming import ingest as I
from . import dims

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CLIPS = f"c as ({A.CLIPS.format(events='events')})"
_CUES = f"u as ({A.CUES.format(conversations='conversations')})"


def _q(s) -> str:
    return f"'{s}'" if isinstance(s, str) else str(s)


def _any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"{text} like '%{w}%'" for w in words) + ")"


def _case(text: str, table, default: str) -> str:
    return "case " + " ".join(f"when {_any(text, ws)} then '{k}'" for k, ws in table) + f" else {default} end"


_TEXT = "(event || ' ' || event_subtype || ' ' || shot)"
_BASE = [" ".join(f"when '{a}|{b}' then {v[k]}" for (a, b), v in dims.TREND.items()) for k in (0, 1)]
_PAIR = "emotion_trend || '|' || action_direction"
_BAD = "(case when reject_reason <> '无' then 4 else 0 end)"
_FACE = "(case when face_quality in ('正脸', '半面') then 1 else 0 end)"
_CONF = f"(case when {_any(_TEXT, dims.HIGH_CONFLICT)} then 1 else 0 end)"
_PROMO = f"greatest(1, least(5, (case {_PAIR} {_BASE[0]} else 2 end) + {_CONF} + {_FACE} - {_BAD}))"
_HOOK = f"greatest(1, least(5, (case {_PAIR} {_BASE[1]} else 2 end) + {_CONF} + (case when action_direction = '增强' and {_any(_TEXT, dims.HIGH_ACTION)} then 1 else 0 end) + {_FACE} - {_BAD}))"
_SCORED = f"{_CLIPS}, s as (select *, cast({_PROMO} as int) as promo_value, cast({_HOOK} as int) as hook_value from c)"


def _band(value: str, key: str, tie: str) -> str:
    rn, n = f"(row_number() over (partition by {key} order by {value} desc, {tie}) - 1)", f"count(*) over (partition by {key})"
    return "cast(case " + " ".join(f"when {rn} < greatest(1, floor({n} * {c})) then {b}" for b, c in zip((5, 4, 3, 2), W.CUTS, strict=True)) + " else 1 end as int)"


_BANDED = f"{_SCORED}, b as (select *, {_band('hook_value', 'series_id', 'ingest_pos')} as hook_band, {_band('promo_value', 'series_id', 'ingest_pos')} as promo_band from s)"
_MOLS = "m(mol_type, target_dur, min_clips, max_clips, dur_lo, dur_hi, emo_min, events, shots, w1, w2, w3, w4) as (values " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]}::double, {v[4]}::double, {v[5]}, {v[6]}::varchar[], {v[7]}::varchar[], {', '.join(f'{w}::double' for w in dims.FUSION[k])})" for k, v in dims.MOLECULES.items()) + ")"
_OWN = """case mol_type when 'quote_rhythm' then speech_density * 8 when 'identity_twist' then speech_density * 6 when 'emotional_resonance' then audio_energy * 7
 when 'hook_clash' then audio_energy * 5 when 'suspense_hook' then audio_energy * 5
 else aes * 15 + (case when shot in ('全景', '特写') then 15 else 0 end) + (case when face_quality = '无人' then 4 else 0 end) + least(4, audio_energy) end"""
_MOLECULAR = f"""cast(emotion * 12 + action_level * 10 + visual_quality * 8 + (case when face_quality in ('正脸', '侧脸', '半面') then 10 else 0 end)
 + 18 * len(list_filter(events, lambda e: contains({_TEXT}, e))) + {' + '.join(f"(case when {_TEXT} like '%{x}%' then 12 else 0 end)" for x in dims.SCORED_SUBTYPES)}
 + {_OWN} + (case when mol_type <> 'cinematic_beauty' then aes * 5 else 0 end) - (case when reject_reason <> '无' then 100 else 0 end) as int)"""
_FUSED = f"{_BANDED}, {_MOLS}, x as (select *, 1 + visual_quality as aes from b), f as (select *, {_MOLECULAR} as molecular from x cross join m), g as (select *, round((w1 * molecular / 250.0 + w2 * aes / 10.0 + w3 * hook_band / 5.0 + w4 * promo_band / 5.0) / (w1 + w2 + w3 + w4), 6) as fusion from f)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scored(spark, sf_dir):
    return A.clips(spark, sf_dir).withColumns({"promo_value": R.promo_value(), "hook_value": R.hook_value()})


def banded(spark, sf_dir):
    s = W.banded(scored(spark, sf_dir), "hook_value", ["series_id"], ["ingest_pos"], "hook_band")
    return W.banded(s, "promo_value", ["series_id"], ["ingest_pos"], "promo_band")


def fused(spark, sf_dir):
    b = banded(spark, sf_dir).withColumn("aesthetic_score", 1 + F.col("visual_quality"))
    f = b.crossJoin(F.broadcast(dims.molecules(spark))).withColumn("molecular", R.molecular_score())
    f = f.withColumn("hook_value", F.col("hook_band")).withColumn("promo_value", F.col("promo_band"))
    return f.withColumn("fusion", F.round(R.fusion_score(), 6))


@query(f"with {_SCORED} select series_id, ingest_pos, promo_value, hook_value from s")
def trend_scores(spark, sf_dir):
    """Promo and hook values from trend pair, conflict words, face and usability."""
    return scored(spark, sf_dir).select("series_id", "ingest_pos", "promo_value", "hook_value")


@query(f"with {_BANDED} select series_id, ingest_pos, hook_band, promo_band from b")
def percentile_bands(spark, sf_dir):
    return banded(spark, sf_dir).select("series_id", "ingest_pos", "hook_band", "promo_band")


@query(f"""with {_BANDED}, r as (select *, row_number() over (partition by series_id order by hook_band desc, hook_value desc, ingest_pos) as rank from b)
 select series_id, ingest_pos, ep, hook_band, case hook_band when 5 then 'hook' when 4 then 'climax' when 3 then 'rise' when 2 then 'setup' else 'ending' end as cut_role, cast(rank as int) as rank from r where rank <= 3""")
def band_roles(spark, sf_dir):
    """The three best hook clips of each series with the role their band gives."""
    t = W.top(banded(spark, sf_dir), ["series_id"], [F.desc("hook_band"), F.desc("hook_value"), "ingest_pos"], 3)
    return t.select("series_id", "ingest_pos", "ep", "hook_band", R.cut_role(F.col("hook_band")).alias("cut_role"), "rank")


@query(f"select l_orderkey, l_linenumber, l_suppkey, {_band('l_extendedprice', 'l_suppkey', 'l_orderkey, l_linenumber')} as band from lineitem")
def banding_large(spark, sf_dir):
    t = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return W.banded(t, "l_extendedprice", ["l_suppkey"], ["l_orderkey", "l_linenumber"]).drop("l_extendedprice")


@query(f"""with {_CLIPS} select ingest_pos, case when reject_reason <> '无' then reject_reason else {_case(_TEXT, dims.REJECT_WORDS, "'无'")} end as reason from c""")
def reject_rules(spark, sf_dir):
    return A.clips(spark, sf_dir).select("ingest_pos", R.reject_reason(R.event_text(), F.col("visual_quality"), F.col("shot"), F.col("reject_reason")).alias("reason"))


@query(f"""with {_CLIPS} select ingest_pos, case when event_subtype <> '无' then event_subtype when reject_reason in ('片头', '黑屏') then reject_reason else {_case("(event || ' ' || shot)", dims.SUBTYPE_WORDS, "'无'")} end as subtype from c""")
def subtype_rules(spark, sf_dir):
    return A.clips(spark, sf_dir).select("ingest_pos", R.event_subtype(F.concat_ws(" ", "event", "shot"), F.col("event_subtype"), F.col("reject_reason")).alias("subtype"))


@query(f"""with {_CLIPS} select series_id, {_case(_TEXT, dims.SIDE_WORDS, "'无'")} as side, count(*) as n from c group by 1, 2""")
def conflict_side(spark, sf_dir):
    return A.clips(spark, sf_dir).groupBy("series_id", R.conflict_side(R.event_text()).alias("side")).agg(F.count("*").alias("n"))


_NODES = "n(node_pos, stage, ep_lo, ep_hi) as (values " + ", ".join(f"({k}, {', '.join(map(_q, v))})" for k, v in enumerate(dims.STAGES)) + ")"


@query(f"with {_CLIPS}, {_NODES} select ingest_pos, coalesce((select stage from n where c.ep between ep_lo and ep_hi order by node_pos limit 1), '未知') as story_stage from c")
def stage_range_join(spark, sf_dir):
    return J.staged(A.clips(spark, sf_dir), dims.stage_nodes(spark)).select("ingest_pos", "story_stage")


@query(f"""with {_CLIPS}, v2 as (select * from c where ingest_pos % 2 = 0), v1 as (select * from c where ingest_pos % 2 = 1)
 select ingest_pos, 'v2' as source from v2 union all select ingest_pos, 'v1' from v1 where not exists (select 1 from v2 where v2.series_id = v1.series_id and v2.ep = v1.ep and abs(v2.time_s - v1.time_s) < 5)""")
def near_time_override(spark, sf_dir):
    """Clips of the newer format, and those of the older that have none near them."""
    c = A.clips(spark, sf_dir).select("series_id", "ep", "time_s", "ingest_pos")
    v2, v1 = c.where("ingest_pos % 2 = 0"), c.where("ingest_pos % 2 = 1")
    old = J.not_near(v1, v2, ["series_id", "ep"], "time_s", 5.0)
    return v2.select("ingest_pos", F.lit("v2").alias("source")).unionByName(old.select("ingest_pos", F.lit("v1").alias("source")))


@query(f"with {_CLIPS}, {_CUES} select ingest_pos from c where exists (select 1 from u where u.ep = c.ep and abs(u.start_s - c.time_s) <= 5 and u.chars >= 40)")
def quote_proximity(spark, sf_dir):
    """Clips within five seconds of a long line of their episode."""
    quotes = A.cues(spark, sf_dir).where("chars >= 40").select(F.col("ep").cast("int").alias("ep"), F.col("start_s").alias("time_s"))
    return J.near(A.clips(spark, sf_dir).select("ep", "time_s", "ingest_pos"), quotes, ["ep"], "time_s", 5.0).select("ingest_pos")


@query(f"""with {_CLIPS}, {_CUES}, w as (select *, greatest(0.0, time_s - 1.25) as lo, time_s + 1.25 as hi from c),
 h as (select ingest_pos, least(hi, end_s) - greatest(lo, start_s) as ov, chars * (least(hi, end_s) - greatest(lo, start_s)) / greatest(0.001, end_s - start_s) as part, abs(start_s - time_s) <= 0.45 or abs(end_s - time_s) <= 0.45 as edge
   from w join u on u.ep = w.ep and start_s < hi and end_s > lo),
 a as (select ingest_pos, sum(ov) as covered, sum(part) as total, max(part) as peak, bool_or(edge) as edge, count(*) as n from h group by 1),
 z as (select w.ingest_pos, w.ep, least(1.0, coalesce(covered, 0) / greatest(0.5, hi - lo)) as cov, coalesce(total, 0) / greatest(0.5, hi - lo) as cps, coalesce(total, 0) as total, coalesce(peak, 0) as peak, coalesce(edge, false) as edge, coalesce(n, 0) as n from w left join a using (ingest_pos))
 select ingest_pos, ep, round(cov, 3) as speech_coverage, round(cps, 3) as chars_per_second, cast(case when total > 0 then greatest(1, least(5, round_even(cps / 2.2, 0) + 1)) else 1 end as int) as speech_density,
 peak >= 14 as has_speech_peak, peak >= 14 or edge or cov >= 0.72 as beat_nearby, case when n = 0 then 'low' when n >= 2 or cov >= 0.55 then 'high' else 'medium' end as audio_event_conf,
 case when edge then 'boundary' when n > 0 then 'dense_speech' else 'none' end as dialogue_anchor from z""")
def speech_windows(spark, sf_dir):
    cues = A.cues(spark, sf_dir).withColumn("ep", F.col("ep").cast("int"))
    return J.speech(A.clips(spark, sf_dir), cues)


@query(f"with {_FUSED} select series_id, ingest_pos, mol_type, molecular from g")
def molecular_scores(spark, sf_dir):
    return fused(spark, sf_dir).select("series_id", "ingest_pos", "mol_type", "molecular")


@query(f"with {_FUSED} select series_id, ingest_pos, mol_type, round(fusion, 4) as fusion from g")
def fusion_scores(spark, sf_dir):
    return fused(spark, sf_dir).select("series_id", "ingest_pos", "mol_type", F.round("fusion", 4).alias("fusion"))


_RARE = " + ".join(f"(case {c} " + " ".join(f"when '{k}' then {v}" for k, v in dims.RARITY.items()) + " else 1.0 end)" for c in ("event", "event_subtype", "shot"))
_CLASSIC = f"round(cast((case emotion when 1 then 0 when 2 then 5 when 3 then 15 when 4 then 40 else 70 end) * 4.0 + least(30.0, ({_RARE}) * 5) * 2.0 + least(40, speech_density * 8) * 2.0 + 18.0 as double), 1)"


@query(f"with {_CLIPS} select ingest_pos, {_CLASSIC} as score from c")
def clip_scores(spark, sf_dir):
    return A.clips(spark, sf_dir).select("ingest_pos", R.clip_score().alias("score"))


def _strict():
    target = F.exists("events", lambda e: F.contains(R.event_text(), e)) | (F.size("events") == 0)
    shots = F.exists("shots", lambda s: F.col("shot") == s) | (F.size("shots") == 0)
    beauty = F.col("mol_type") == "cinematic_beauty"
    face = F.when(beauty, F.col("face_quality") != "模糊").otherwise(~F.col("face_quality").isin("模糊", "无人"))
    return (F.col("emotion") >= F.col("emo_min")) & R.usable() & (F.col("visual_quality") >= F.when(beauty, 4).otherwise(3)) & face & target & shots


_STRICT = f"""(emotion >= emo_min and reject_reason = '无' and visual_quality >= (case when mol_type = 'cinematic_beauty' then 4 else 3 end)
 and (case when mol_type = 'cinematic_beauty' then face_quality <> '模糊' else face_quality not in ('模糊', '无人') end)
 and (len(events) = 0 or len(list_filter(events, lambda e: contains({_TEXT}, e))) > 0) and (len(shots) = 0 or list_contains(shots, shot)))"""
_RELAXED = "(emotion >= greatest(2, emo_min - 1) and reject_reason = '无' and visual_quality >= (case when mol_type = 'cinematic_beauty' then 4 else 3 end))"


@query(f"""with {_CLIPS}, {_MOLS}, l as (select series_id, avg(case when audio_energy > 1 or speech_density > 1 then 1.0 else 0.0 end) < 0.2 as legacy from c group by 1),
 k as (select series_id, mol_type, min(min_clips) as need, count(*) filter (where {_STRICT}) as strict, count(*) filter (where {_RELAXED}) as relaxed from c cross join m group by 1, 2)
 select series_id, mol_type, strict, relaxed, legacy, case when strict < need and legacy and relaxed > strict then 'relaxed' else 'strict' end as tier from k join l using (series_id)""")
def molecule_filter_counts(spark, sf_dir):
    """Clips that pass each template's strict and relaxed filter, and which of the two a series gets."""
    c = A.clips(spark, sf_dir)
    legacy = c.groupBy("series_id").agg((F.avg(F.when((F.col("audio_energy") > 1) | (F.col("speech_density") > 1), 1.0).otherwise(0.0)) < 0.2).alias("legacy"))
    relaxed = (F.col("emotion") >= F.greatest(F.lit(2), F.col("emo_min") - 1)) & R.usable() & (F.col("visual_quality") >= F.when(F.col("mol_type") == "cinematic_beauty", 4).otherwise(3))
    k = c.crossJoin(F.broadcast(dims.molecules(spark))).groupBy("series_id", "mol_type").agg(F.min("min_clips").alias("need"), F.count_if(_strict()).alias("strict"), F.count_if(relaxed).alias("relaxed"))
    tier = F.when((F.col("strict") < F.col("need")) & F.col("legacy") & (F.col("relaxed") > F.col("strict")), "relaxed").otherwise("strict")
    return k.join(legacy, "series_id").select("series_id", "mol_type", "strict", "relaxed", "legacy", tier.alias("tier"))


@query(f"with {_SCORED} select series_id, ingest_pos from (select *, row_number() over (partition by series_id, ep, round_even(time_s / 5, 0) order by hook_value desc, ingest_pos) as k from s) where k = 1")
def window_dedup(spark, sf_dir):
    return W.first_in_window(scored(spark, sf_dir), ["series_id", "ep"], F.col("time_s"), [F.desc("hook_value"), "ingest_pos"], 5.0).select("series_id", "ingest_pos")


@query("select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey, round_even(cast(l_quantity as double) / 5, 0) order by l_orderkey, l_linenumber) as k from lineitem) where k = 1")
def window_dedup_lineitem(spark, sf_dir):
    t = A.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey", "l_linenumber")
    return W.first_in_window(t, ["l_suppkey"], F.col("l_quantity").cast("double"), ["l_orderkey", "l_linenumber"], 5.0).select("l_orderkey", "l_linenumber")


_RANKED = f"{_FUSED}, p as (select * from g where {_STRICT}), r as (select *, row_number() over (partition by series_id, mol_type order by fusion desc, ingest_pos) as rank from (select *, row_number() over (partition by series_id, mol_type, ep, round_even(time_s / 5, 0) order by fusion desc, ingest_pos) as k from p) where k = 1)"


def ranked(spark, sf_dir):
    """Each template's candidates of a series, one a time window, best first, cut at the template's size."""
    order = [F.desc("fusion"), "ingest_pos"]
    p = W.first_in_window(fused(spark, sf_dir).where(_strict()), ["series_id", "mol_type", "ep"], F.col("time_s"), order, 5.0)
    return W.top(p, ["series_id", "mol_type"], order, 40).where("rank <= max_clips")


@query(f"with {_RANKED} select series_id, mol_type, ingest_pos, cast(rank as int) as rank from r where rank <= max_clips")
def molecule_rank(spark, sf_dir):
    return ranked(spark, sf_dir).select("series_id", "mol_type", "ingest_pos", "rank")


_KEEP = ["series_id", "mol_type", "ingest_pos", "ep", "time_s", "shot", "hook_value", "dur_lo", "dur_hi", "rank"]


@query()
def diversity_selection(spark, sf_dir):
    """The ranked candidates under spacing and variety limits; where too few are left, under the relaxed ones."""
    r = ranked(spark, sf_dir)
    cut = r.select(*_KEEP, "min_clips")
    strict = W.diverse(cut, ["series_id", "mol_type"])
    loose = W.diverse(cut, ["series_id", "mol_type"], per_ep=6, same_shot=3, apart=3.0)
    enough = strict.groupBy("series_id", "mol_type").agg((F.count("*") >= F.min("min_clips")).alias("enough"))
    both = strict.withColumn("pass", F.lit("strict")).unionByName(loose.withColumn("pass", F.lit("relaxed"))).join(enough, ["series_id", "mol_type"])
    return both.where(F.col("enough") == (F.col("pass") == "strict")).select("series_id", "mol_type", "ingest_pos", "ep", "rank", "pass")


_STAGE = "case when ep <= 10 then 1 when ep <= 25 then 2 when ep <= 45 then 3 when ep <= 62 then 4 when ep <= 76 then 5 else 0 end"
_FLOW = "case mol_type " + " ".join(f"when '{k}' then list_position({v}, {_STAGE})" for k, v in dims.FLOW.items()) + " end"
_ORDER = f"row_number() over (partition by series_id, mol_type order by {_FLOW}, case when {_STAGE} = 1 then ep end, case when {_STAGE} = 1 then time_s end, -hook_band, rank)"
_STORY = f"{_RANKED}, o as (select *, {_ORDER} as pos from r where rank <= max_clips)"


def story(spark, sf_dir):
    stage = R.stage_index(F.col("ep"))
    one = stage == 1
    keys = [F.array_position("flow", stage), F.when(one, F.col("ep")).asc_nulls_last(), F.when(one, F.col("time_s")).asc_nulls_last(), -F.col("hook_band"), F.col("rank")]
    return ranked(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("series_id", "mol_type").orderBy(*keys)))


@query(f"with {_STORY} select series_id, mol_type, ingest_pos, cast(pos as int) as pos from o")
def story_order(spark, sf_dir):
    """Stages in the template's flow; in the first by time, in the others by hook."""
    return story(spark, sf_dir).select("series_id", "mol_type", "ingest_pos", "pos")


_CUT = f"{_STORY}, t as (select *, round(greatest(0.0, time_s - 1.0), 1) as start_s, round(least(dur_hi, greatest(dur_lo, case when hook_band = 5 then 2.5 else 3.5 end)), 1) as dur_s from o)"


def cut(spark, sf_dir):
    dur = F.least("dur_hi", F.greatest("dur_lo", F.when(F.col("hook_band") == 5, 2.5).otherwise(3.5)))
    return story(spark, sf_dir).withColumns({"start_s": F.round(F.greatest(F.lit(0.0), F.col("time_s") - 1.0), 1), "dur_s": F.round(dur, 1)})


@query(f"with {_CUT} select series_id, mol_type, cast(pos as int) as pos, ingest_pos, start_s, dur_s from t")
def cut_specs(spark, sf_dir):
    return cut(spark, sf_dir).select("series_id", "mol_type", "pos", "ingest_pos", "start_s", "dur_s")


_LINE = f"{_CUT}, e as (select *, round(coalesce(sum(greatest(0.0, dur_s - 0.5)) over (partition by series_id, mol_type order by pos rows between unbounded preceding and 1 preceding), 0.0), 3) as offset_s from t)"


def timeline(spark, sf_dir):
    t = W.running(cut(spark, sf_dir), ["series_id", "mol_type"], ["pos"], F.greatest(F.lit(0.0), F.col("dur_s") - 0.5), "offset_s")
    return t.withColumn("offset_s", F.round("offset_s", 3))


@query(f"with {_LINE} select series_id, mol_type, cast(pos as int) as pos, offset_s from e")
def timeline_offsets(spark, sf_dir):
    return timeline(spark, sf_dir).select("series_id", "mol_type", "pos", "offset_s")


@query("select l_orderkey, l_linenumber, coalesce(sum(cast(l_quantity as double)) over (partition by l_orderkey order by l_linenumber, l_quantity, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0.0) as offset_s from lineitem")
def order_timeline(spark, sf_dir):
    t = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    w = W.running(t, ["l_orderkey"], ["l_linenumber", "l_quantity", "l_partkey", "l_suppkey"], F.col("l_quantity").cast("double"), "offset_s")
    return w.select("l_orderkey", "l_linenumber", "offset_s")


def _tc(x: str) -> str:
    f = f"cast(floor(greatest({x}, 0.0) * 25 + 0.5) as bigint)"
    return "||':'||".join(f"lpad(cast({p} as varchar), 2, '0')" for p in (f"{f} // 90000", f"({f} // 1500) % 60", f"({f} // 25) % 60", f"{f} % 25"))


@query(f"with {_LINE} select series_id, mol_type, cast(pos as int) as pos, {_tc('start_s')} as src_in, {_tc('start_s + dur_s')} as src_out, {_tc('offset_s')} as rec_in, 'EP' || lpad(cast(ep as varchar), 2, '0') as reel from e")
def edit_list(spark, sf_dir):
    """Source and record timecodes at 25 frames a second."""
    t = timeline(spark, sf_dir)
    return t.select("series_id", "mol_type", "pos", R.timecode(F.col("start_s")).alias("src_in"), R.timecode(F.col("start_s") + F.col("dur_s")).alias("src_out"), R.timecode(F.col("offset_s")).alias("rec_in"), F.concat(F.lit("EP"), F.lpad(F.col("ep").cast("string"), 2, "0")).alias("reel"))


_CLASH = f"((emotion >= 5 or action_level >= 4) and {_any(_TEXT, dims.CLASH)} and visual_quality >= 3 and face_quality not in ('无人', '模糊') and reject_reason = '无')"
_QA = f"""{_STORY}, ep as (select series_id, mol_type, ep, count(*) as k from o group by 1, 2, 3), mx as (select series_id, mol_type, max(k) as top_ep from ep group by 1, 2),
 q as (select series_id, mol_type, count(*) as n, min(min_clips) as need, count(*) filter (where {_CLASH}) as clashes, avg(action_level) as action, avg(audio_energy) as energy, avg(visual_quality) as vq, count(distinct shot) as shots, count(distinct emotion) as emotions, arg_min({_CLASH}, pos) as first_clash from o group by 1, 2)"""
_CHECKS = [
    ("error", "insufficient_clips", "n < need"), ("warn", "ep_concentration", "top_ep > n * 0.6"), ("warn", "weak_hook", "mol_type = 'hook_clash' and not first_clash"),
    ("warn", "low_conflict_density", "mol_type = 'hook_clash' and clashes < 2"), ("info", "low_action_avg", "mol_type = 'hook_clash' and action < 3"),
    ("info", "low_audio_energy", "mol_type = 'emotional_resonance' and energy < 2"), ("warn", "flat_emotion", "mol_type = 'emotional_resonance' and emotions < 2"),
    ("warn", "low_visual_avg", "mol_type = 'cinematic_beauty' and vq < 3.5"), ("info", "monotone_shots", "mol_type = 'cinematic_beauty' and shots < 2"),
]


def _qa(spark, sf_dir):
    o = story(spark, sf_dir)
    by_ep = o.groupBy("series_id", "mol_type", "ep").agg(F.count("*").alias("k")).groupBy("series_id", "mol_type").agg(F.max("k").alias("top_ep"))
    clash = R.high_conflict()
    q = o.groupBy("series_id", "mol_type").agg(F.count("*").alias("n"), F.min("min_clips").alias("need"), F.count_if(clash).alias("clashes"), F.avg("action_level").alias("action"), F.avg("audio_energy").alias("energy"), F.avg("visual_quality").alias("vq"), F.count_distinct("shot").alias("shots"), F.count_distinct("emotion").alias("emotions"), F.min_by(clash, "pos").alias("first_clash"))
    return q.join(by_ep, ["series_id", "mol_type"])


@query(f"with {_QA} select series_id, mol_type, level, code from (" + " union all ".join(f"select series_id, mol_type, '{a}' as level, '{b}' as code from q join mx using (series_id, mol_type) where {c}" for a, b, c in _CHECKS) + ")")
def qa_findings(spark, sf_dir):
    found = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(a).alias("level"), F.lit(b).alias("code"))) for a, b, c in _CHECKS)))
    return _qa(spark, sf_dir).select("series_id", "mol_type", F.explode(found).alias("f")).select("series_id", "mol_type", "f.level", "f.code")


@query(f"with {_QA} select series_id, mol_type, n, top_ep, clashes, round(action, 3) as action, round(vq, 3) as vq from q join mx using (series_id, mol_type)")
def qa_summary(spark, sf_dir):
    return _qa(spark, sf_dir).select("series_id", "mol_type", "n", "top_ep", "clashes", F.round("action", 3).alias("action"), F.round("vq", 3).alias("vq"))


@query(f"""with {_BANDED}, r as (select *, {_STAGE} as stage, row_number() over (partition by series_id, {_STAGE} order by hook_band desc, hook_value desc, ingest_pos) as k from b),
 z as (select *, row_number() over (partition by series_id order by k, stage) as rank from r where k <= 50) select series_id, stage, ingest_pos, cast(rank as int) as rank from z where rank <= 50""")
def round_robin_review(spark, sf_dir):
    """Fifty clips a series, the stages taking turns, best hook first."""
    b = banded(spark, sf_dir).withColumn("stage", R.stage_index(F.col("ep")))
    k = W.top(b, ["series_id", "stage"], [F.desc("hook_band"), F.desc("hook_value"), "ingest_pos"], 50, "k")
    return W.top(k, ["series_id"], ["k", "stage"], 50).select("series_id", "stage", "ingest_pos", "rank")


@query(f"""with {_RANKED}, v as (select doc_id as ingest_pos, quality from labels), j as (select r.*, coalesce(quality, -1) as mark from r left join v using (ingest_pos) where rank <= max_clips)
 select series_id, mol_type, ingest_pos, cast(row_number() over (partition by series_id, mol_type order by case when mark = 1 then 0 else 1 end, rank) as int) as pos from j where mark <> 0""")
def review_override(spark, sf_dir):
    """What reviewers keep comes first, what they reject goes, the rest follows by rank."""
    marks = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ingest_pos"), F.col("quality").alias("mark"))
    j = ranked(spark, sf_dir).join(marks, "ingest_pos", "left").withColumn("mark", F.coalesce("mark", F.lit(-1))).where("mark <> 0")
    w = Window.partitionBy("series_id", "mol_type").orderBy(F.when(F.col("mark") == 1, 0).otherwise(1), "rank")
    return j.select("series_id", "mol_type", "ingest_pos", F.row_number().over(w).alias("pos"))


def _spoken(spark, sf_dir):
    """Cues with their line: [EPnn mm:ss] text."""
    c = A.cues(spark, sf_dir).where("text is not null")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    ep = F.col("ep").cast("string")
    number = F.when(F.length(ep) < 2, F.lpad(ep, 2, "0")).otherwise(F.substring(ep, 1, 2))
    return c.withColumn("line", F.concat(F.lit("[EP"), number, F.lit(" "), two(F.floor(F.col("start_s") / 60)), F.lit(":"), two(F.col("start_s") % 60), F.lit("] "), F.col("text")))


@query("select conv_id as ep, string_agg('[EP' || lpad(cast(conv_id as varchar), 2, '0') || ' ' || lpad(cast(turn * 6 // 60 as varchar), 2, '0') || ':' || lpad(cast(turn * 6 % 60 as varchar), 2, '0') || '] ' || text, chr(10) order by turn) as script from conversations group by conv_id")
def dialogue_merge(spark, sf_dir):
    """Each episode's lines in order, with their times."""
    c = _spoken(spark, sf_dir)
    return c.groupBy("ep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_pos", "line"))), lambda x: x["line"]), "\n").alias("script"))


@query(f"with {_CUES}, g as (select ep, cue_pos, lead(start_s) over (partition by ep order by cue_pos) - end_s as gap from u) select ep, cue_pos, round(gap, 3) as gap, case when gap > 0 and gap < 0.15 then 'overlap_risk' else 'long_silence' end as finding from g where (gap > 0 and gap < 0.15) or gap > 3")
def cue_gaps(spark, sf_dir):
    gap = F.lead("start_s").over(Window.partitionBy("ep").orderBy("cue_pos")) - F.col("end_s")
    g = A.cues(spark, sf_dir).select("ep", "cue_pos", gap.alias("gap"))
    risk = (F.col("gap") > 0) & (F.col("gap") < 0.15)
    return g.where(risk | (F.col("gap") > 3)).select("ep", "cue_pos", F.round("gap", 3).alias("gap"), F.when(risk, "overlap_risk").otherwise("long_silence").alias("finding"))


@query(f"""with {_CUES}, d as (select *, max(end_s) over (partition by ep order by cue_pos rows between unbounded preceding and 1 preceding) as before from u),
 i as (select *, sum(case when before is null or start_s > before + 0.2 then 1 else 0 end) over (partition by ep order by cue_pos rows unbounded preceding) as island from d)
 select ep, cast(island as bigint) as island, min(start_s) as duck_from, max(end_s) as duck_to from i group by ep, island""")
def duck_envelope(spark, sf_dir):
    """Stretches of speech, merged where less than 0.2 s lie between, in which the music is lowered."""
    w = Window.partitionBy("ep").orderBy("cue_pos")
    d = A.cues(spark, sf_dir).withColumn("before", F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("before").isNull() | (F.col("start_s") > F.col("before") + 0.2), 1).otherwise(0)
    i = d.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("ep", "island").agg(F.min("start_s").alias("duck_from"), F.max("end_s").alias("duck_to"))


# Genre lexicon over common tokens of the documents: strong, weak and opposing terms.
LEXICON = {"english": (["the ", " and "], [" of "], [" der "]), "french": ([" les ", " des "], [" la "], [" the "]), "german": ([" der ", " und "], [" die "], [" the "]), "spanish": ([" que ", " del "], [" la "], [" the "])}


def _share(words: list[str]) -> str:
    return "avg(case when " + " or ".join(f"contains(text, '{w}')" for w in words) + " then 1.0 else 0.0 end)"


_GENRE = "g as (" + " union all ".join(f"select source, '{k}' as genre, round(greatest(0.0, 3 * {_share(s)} + {_share(w)} - 2 * {_share(a)}), 6) as score from documents group by source" for k, (s, w, a) in LEXICON.items()) + ")"


def genres(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("source", "text")
    has = lambda words: F.avg(F.when(F.greatest(*(F.col("text").contains(w) for w in words)) if len(words) > 1 else F.col("text").contains(words[0]), 1.0).otherwise(0.0))
    scores = d.groupBy("source").agg(*(F.round(F.greatest(F.lit(0.0), 3 * has(s) + has(w) - 2 * has(a)), 6).alias(k) for k, (s, w, a) in LEXICON.items()))
    return scores.unpivot("source", list(LEXICON), "genre", "score")


@query(f"with {_GENRE} select source, genre, score from g")
def genre_coverage(spark, sf_dir):
    return genres(spark, sf_dir)


@query(f"with {_GENRE}, r as (select *, row_number() over (partition by source order by score desc, genre) as k from g) select source, max(case when k = 1 then genre end) as genre, max(case when k = 2 then genre end) as runner_up, round(case when max(case when k = 2 then score end) = 0 then 3.0 else least(5.0, max(case when k = 1 then score end) / greatest(0.01, max(case when k = 2 then score end))) end, 4) as confidence from r group by source")
def genre_winner(spark, sf_dir):
    r = W.top(genres(spark, sf_dir), ["source"], [F.desc("score"), "genre"], 2, "k")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    ratio = F.when(at(2, "score") == 0, 3.0).otherwise(F.least(F.lit(5.0), at(1, "score") / F.greatest(F.lit(0.01), at(2, "score"))))
    return r.groupBy("source").agg(at(1, "genre").alias("genre"), at(2, "genre").alias("runner_up"), F.round(ratio, 4).alias("confidence"))


_PASSES = [(1, 4, 2, 2), (2, 3, 3, 1), (3, 5, 1, 3)]
_PASS = f"""{_CLIPS}, w(pass, we, wa, ws) as (values {', '.join(map(str, _PASSES))}), y as (select pass, series_id, ep, ingest_pos, emotion * we + action_level * wa + speech_density * ws as score from c cross join w),
 k as (select *, row_number() over (partition by pass, series_id, ep order by score desc, ingest_pos) as n from y), r as (select *, row_number() over (partition by pass, series_id order by score desc, ingest_pos) as rank from k where n <= 2),
 a as (select series_id, ingest_pos, count(*) as passes, avg(rank) as mean_rank, stddev_samp(rank) as sd from r where rank <= 30 group by 1, 2)"""


def consensus(spark, sf_dir):
    """Ranks under several weightings, at most two clips an episode, thirty a series, as rows and not as loops."""
    w = spark.createDataFrame(_PASSES, "pass int, we int, wa int, ws int")
    y = A.clips(spark, sf_dir).crossJoin(F.broadcast(w)).withColumn("score", F.expr("emotion * we + action_level * wa + speech_density * ws"))
    r = W.capped_rank(y, ["pass", "series_id"], "ep", [F.desc("score"), "ingest_pos"], 2, 30)
    return r.groupBy("series_id", "ingest_pos").agg(F.count("*").alias("passes"), F.avg("rank").alias("mean_rank"), W.deviation("rank").alias("sd"))


@query(f"with {_PASS} select series_id, ingest_pos, passes, round(mean_rank, 4) as mean_rank, round(coalesce(sd, 0), 4) as sd, passes = 3 and coalesce(sd, 0) < 3 as stable from a")
def consensus_ranks(spark, sf_dir):
    sd = F.coalesce("sd", F.lit(0.0))
    return consensus(spark, sf_dir).select("series_id", "ingest_pos", "passes", F.round("mean_rank", 4).alias("mean_rank"), F.round(sd, 4).alias("sd"), ((F.col("passes") == 3) & (sd < 3)).alias("stable"))


@query(f"with {_PASS}, d as (select *, row_number() over (partition by series_id order by sd desc, ingest_pos) as k from a where passes >= 2 and sd > 2) select series_id, ingest_pos, round(sd, 4) as sd from d where k <= 10")
def divergent_clips(spark, sf_dir):
    d = consensus(spark, sf_dir).where("passes >= 2 and sd > 2")
    return W.top(d, ["series_id"], [F.desc("sd"), "ingest_pos"], 10).select("series_id", "ingest_pos", F.round("sd", 4).alias("sd"))


@query(f"with {_CLIPS}, p as (select *, (row_number() over (partition by series_id order by ep, time_s, ingest_pos) - 1) * 7.0 as place, count(*) over (partition by series_id) * 7.0 as total from c) select series_id, ingest_pos, round(cast(emotion * (case when place < 3 then 3.0 when place < 10 then 2.0 when place > total * 0.8 then 1.5 else 1.0 end) as double), 2) as weighted from p")
def time_weighted(spark, sf_dir):
    """Openings and endings weigh more: the place in the whole, seven seconds a clip."""
    c = A.clips(spark, sf_dir).select("series_id", "ingest_pos", "ep", "time_s", "emotion")
    p = K.numbered(c, ["series_id"], ["ep", "time_s", "ingest_pos"]).withColumns({"at": F.col("place") * 7.0, "total": F.col("n") * 7.0})
    weight = F.when(F.col("at") < 3, 3.0).when(F.col("at") < 10, 2.0).when(F.col("at") > F.col("total") * 0.8, 1.5).otherwise(1.0)
    return p.select("series_id", "ingest_pos", F.round(F.col("emotion") * weight, 2).alias("weighted"))


@query(f"with {_CLIPS}, p as (select *, emotion - lag(emotion) over (partition by series_id order by ep, time_s, ingest_pos) as jump from c), z as (select series_id, ingest_pos, (case when jump >= 2 then 30 else 0 end) + (case when event in ('对峙', '冲突') then 20 else 0 end) + (case when emotion >= 4 then 15 else 0 end) as score from p) select series_id, ingest_pos, score, case when score >= 60 then 'cliff' when score >= 45 then 'strong' else 'light' end as kind from z where score >= 30")
def episode_split_candidates(spark, sf_dir):
    jump = F.col("emotion") - F.lag("emotion").over(Window.partitionBy("series_id").orderBy("ep", "time_s", "ingest_pos"))
    z = A.clips(spark, sf_dir).withColumn("jump", jump).withColumn("score", R.flag(F.col("jump") >= 2, 30) + R.flag(F.col("event").isin("对峙", "冲突"), 20) + R.flag(F.col("emotion") >= 4, 15))
    kind = F.when(F.col("score") >= 60, "cliff").when(F.col("score") >= 45, "strong").otherwise("light")
    return z.where("score >= 30").select("series_id", "ingest_pos", "score", kind.alias("kind"))


@query(f"with {_CLIPS}, n as (select series_id, count(distinct ep) as eps from c group by 1), a as (select series_id, event as character, count(distinct ep) as n_ep, avg(emotion) as emo, count(distinct shot) as shots from c group by 1, 2), r as (select *, round(30.0 * n_ep / eps + greatest(0.0, least(30.0, (emo - 2) * 10)) + least(20, 4 * shots), 4) as score from a join n using (series_id)) select series_id, character, n_ep, score from (select *, row_number() over (partition by series_id order by score desc, character) as k from r) where k <= 5")
def protagonists(spark, sf_dir):
    """Who appears in most episodes, with most emotion and in most settings."""
    c = A.clips(spark, sf_dir)
    eps = c.groupBy("series_id").agg(F.count_distinct("ep").alias("eps"))
    a = c.groupBy("series_id", F.col("event").alias("character")).agg(F.count_distinct("ep").alias("n_ep"), F.avg("emotion").alias("emo"), F.count_distinct("shot").alias("shots"))
    score = 30.0 * F.col("n_ep") / F.col("eps") + F.greatest(F.lit(0.0), F.least(F.lit(30.0), (F.col("emo") - 2) * 10)) + F.least(F.lit(20), 4 * F.col("shots"))
    return W.top(a.join(eps, "series_id").withColumn("score", F.round(score, 4)), ["series_id"], [F.desc("score"), "character"], 5).select("series_id", "character", "n_ep", "score")


_DOCBAND = f"d as (select doc_id, lang, {_band('n_chars', 'lang', 'doc_id')} as band from documents), l as (select doc_id, quality + 1 - toxic as label from labels), j as (select * from d join l using (doc_id))"


def _calibrated(spark, sf_dir):
    d = W.banded(A.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", ["lang"], ["doc_id"])
    return d.join(A.table(spark, sf_dir, "labels").withColumn("label", F.expr("quality + 1 - toxic")), "doc_id")


@query(f"with {_DOCBAND} select least_band, count(*) as n, count(*) filter (where label = 2) as top, count(*) filter (where label = 0) as unusable, round(avg(case when label = 0 then 1.0 else 0.0 end), 4) as false_share from j cross join (values (4), (3), (1)) t(least_band) where band >= least_band group by 1")
def calibration_report(spark, sf_dir):
    """What people say of the rows at or over each band."""
    t = spark.createDataFrame([(4,), (3,), (1,)], "least_band int")
    j = _calibrated(spark, sf_dir).crossJoin(F.broadcast(t)).where("band >= least_band")
    return j.groupBy("least_band").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 2).alias("top"), F.count_if(F.col("label") == 0).alias("unusable"), F.round(F.avg(F.when(F.col("label") == 0, 1.0).otherwise(0.0)), 4).alias("false_share"))


@query(f"with {_DOCBAND} select lang, round(sum(case when band >= 4 and label = 2 then 1.0 else 0 end) / greatest(1, count(*) filter (where band >= 4)), 4) as precision_top, count(*) filter (where band <= 2 and label = 2) as missed from j group by lang")
def calibration_precision(spark, sf_dir):
    high = F.col("band") >= 4
    return _calibrated(spark, sf_dir).groupBy("lang").agg(F.round(F.count_if(high & (F.col("label") == 2)) / F.greatest(F.lit(1), F.count_if(high)), 4).alias("precision_top"), F.count_if((F.col("band") <= 2) & (F.col("label") == 2)).alias("missed"))


@query("select quality, toxic, count(*) as n, sum(case when quality > toxic then 1 else 0 end)::bigint as up, sum(case when quality = toxic then 1 else 0 end)::bigint as equal from labels group by 1, 2")
def label_comparison(spark, sf_dir):
    """Two labellings of the same rows, cell by cell."""
    return A.table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") > F.col("toxic")).alias("up"), F.count_if(F.col("quality") == F.col("toxic")).alias("equal"))


_TERMS = ["password", "token", "License", "http", "Apache", "Public"]


@query(f"with t(term) as (values {', '.join(f'({_q(x)})' for x in _TERMS)}) select doc_id, term from documents cross join t where contains(text, term) and not exists (select 1 from benchmark b where contains(b.text, term))")
def fact_check(spark, sf_dir):
    """Risk terms of a text that occur nowhere in the source."""
    terms = F.array(*map(F.lit, _TERMS))
    held = lambda df: df.select("*", F.explode(F.filter(terms, lambda t: F.contains(F.col("text"), t))).alias("term"))
    known = held(A.table(spark, sf_dir, "benchmark").select("text")).select("term").distinct()
    return held(A.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "term").join(known, "term", "left_anti").select("doc_id", "term")


@query("select doc_id from (select doc_id, md5(text) as h, lag(md5(text)) over (partition by lang order by md5(text), doc_id) as before from documents) where h = before")
def adjacent_duplicates(spark, sf_dir):
    h = A.table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    return h.where("h is not null").withColumn("k", F.row_number().over(Window.partitionBy("lang", "h").orderBy("doc_id"))).where("k > 1").select("doc_id")


@query("select conv_id, turn, coalesce(cast(lag(turn) over (partition by conv_id order by turn) as varchar), 'none') as continues from conversations")
def continuity(spark, sf_dir):
    t = A.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return t.select("conv_id", "turn", F.coalesce(F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).cast("string"), F.lit("none")).alias("continues"))


@query(f"with recursive {_CLIPS}, p as (select distinct series_id, ep, time_s from c), s as (select series_id, ep, min(time_s) as time_s from p group by 1, 2 union all select s.series_id, s.ep, (select min(p.time_s) from p where p.series_id = s.series_id and p.ep = s.ep and p.time_s > s.time_s + 3) from s where exists (select 1 from p where p.series_id = s.series_id and p.ep = s.ep and p.time_s > s.time_s + 3)) select series_id, ep, time_s from s")
def scene_thinning(spark, sf_dir):
    """Scene points more than three seconds after the last one kept."""
    return W.spaced(A.clips(spark, sf_dir).select("series_id", "ep", "time_s"), ["series_id", "ep"], "time_s", 3.0)


@query(f"with {_CLIPS} select ingest_pos from c where not exists (select 1 from c d where d.series_id = c.series_id and d.ep = c.ep and d.ingest_pos % 3 = 0)")
def resume_antijoin(spark, sf_dir):
    """Clips of episodes that have not been annotated."""
    c = A.clips(spark, sf_dir).select("series_id", "ep", "ingest_pos")
    return J.unknown(c, c.where("ingest_pos % 3 = 0"), ["series_id", "ep"]).select("ingest_pos")


@query("with k as (select doc_id, md5(coalesce(text, '') || '|v1') as key, lang from documents) select key, min(doc_id) as first_doc, count(*) as uses, count(*) - 1 as hits from k group by key")
def label_cache(spark, sf_dir):
    """One label call a content key; the others are answered from it."""
    k = A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("|v1"))).alias("key"))
    return k.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses")).withColumn("hits", F.col("uses") - 1)


_LABELS = ["shot", "event", "event_subtype", "emo", "action_level", "visual_quality", "audio_energy", "speech_density", "face_quality", "action_direction", "emotion_trend", "reject_reason"]


@query(f"""with {_CLIPS} select ingest_pos, ep, time_s, case ingest_pos % 4 when 0 then 'legacy' else 'v2' end as format, emotion,
 case ingest_pos % 4 when 0 then emotion else action_level end as action_level, case ingest_pos % 4 when 0 then 3 else visual_quality end as visual_quality,
 event || (case event_subtype when '无' then '' else '/' || event_subtype end) || (case ingest_pos % 4 when 0 then '' else '/' || shot end) as scene_types from c""")
def annotation_scan(spark, sf_dir):
    """Annotation lines of three dialects (JSON, JSON in a reply, legacy sentence), written as text and read back as clips."""
    c, at = A.clips(spark, sf_dir).withColumn("emo", F.col("emotion")), A.new_folder(spark, "annotations")
    body = F.regexp_extract("value", r"\{.*\}", 0)
    head = F.substring_index("value", " ", 2)
    plain = N.as_lines(c.where("ingest_pos % 4 >= 2"), _LABELS)
    fenced = N.as_lines(c.where("ingest_pos % 4 = 1"), _LABELS).select(F.concat(head, F.lit(" 结果如下 {见下} ```json "), body, F.lit(" ``` 完")).alias("value"))
    told = F.format_string("一段画面。情绪：%d。类型：%s/%s。", F.col("emotion"), F.col("event"), F.col("event_subtype"))
    legacy = N.as_lines(c.where("ingest_pos % 4 = 0").withColumn("told", told), ["told"]).select(F.concat(head, F.lit(" "), F.get_json_object(body, "$.told")).alias("value"))
    plain.unionByName(fenced).unionByName(legacy).write.text(at)
    t = N.typed(N.lines(spark.read.text(at)))
    pos = F.regexp_extract("frame_id", r"_f(\d+)$", 1).cast("long")
    return t.select(pos.alias("ingest_pos"), "ep", "time_s", "format", "emotion", "action_level", "visual_quality", F.array_join("scene_types", "/").alias("scene_types"))


_SAID = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"


@query(f"with {_CUES} select ep, cue_pos, round(start_s, 3) as start_s, round(end_s, 3) as end_s, {_SAID} as text, cast(length({_SAID}) as int) as chars, round(end_s - start_s, 3) as duration_s from u where {_SAID} <> ''")
def cue_scan(spark, sf_dir):
    """Subtitle blocks to cues."""
    u = A.cues(spark, sf_dir)
    return S.cues(u.select("ep", "cue_pos", S.block(F.col("start_s"), F.col("end_s"), F.col("text")).alias("value")))


_FEED = "(25000 - strpos(reverse(left(rest, 25000)), chr(10)))"
_SIZE = f"(case when length(rest) <= 25000 then length(rest) when strpos(left(rest, 25000), chr(10)) > 0 and {_FEED} > 12500 then {_FEED} + 1 else 25000 end)"


@query(f"""with recursive m as (select conv_id as ep, string_agg('[EP' || lpad(cast(conv_id as varchar), 2, '0') || ' ' || lpad(cast(turn * 6 // 60 as varchar), 2, '0') || ':' || lpad(cast(turn * 6 % 60 as varchar), 2, '0') || '] ' || text, chr(10) order by turn) as rest from conversations group by conv_id),
 r(ep, batch, text, rest) as (select ep, 0, left(rest, {_SIZE}), substr(rest, {_SIZE} + 1) from m where rest is not null union all select ep, batch + 1, left(rest, {_SIZE}), substr(rest, {_SIZE} + 1) from r where rest <> '') select ep, batch, text from r""")
def dialogue_batches(spark, sf_dir):
    """Each episode's merged dialogue in texts of at most 25,000 characters, cut at line ends where one is near."""
    return W.batches(_spoken(spark, sf_dir), "ep", ["cue_pos"], "line")


def _role(c: str) -> str:
    return f"(case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in dims.NARRATIVE.items()) + " else 'rising' end)"


_PER = "(case role " + " ".join(f"when '{k}' then {max(1, round(8 * s))}" for k, s in dims.BEATS.items()) + " else 1 end)"
_BEAT = f"list_position({list(dims.BEATS)}, role)"


@query(f"""with {_CLIPS}, a as (select series_id, ingest_pos, {_CLASSIC} as score, {_role('event')} as role from c),
 k as (select *, row_number() over (partition by series_id, role order by score desc, ingest_pos) as k from a),
 n as (select *, row_number() over (partition by series_id order by case when k = 1 then 0 when k <= {_PER} then 1 else 2 end, score desc, ingest_pos) as n from k)
 select series_id, ingest_pos, role, cast(row_number() over (partition by series_id order by {_BEAT}, score desc, ingest_pos) as int) as pos from n where n <= 8""")
def narrative_diversity(spark, sf_dir):
    """Eight clips a series that cover the narrative roles, in the order of the beats."""
    c = A.clips(spark, sf_dir).select("series_id", "ingest_pos", R.clip_score().alias("score"), R.narrative().alias("role"))
    return W.narrative_mix(c, ["series_id"], [F.desc("score"), "ingest_pos"], "role", dims.BEATS).select("series_id", "ingest_pos", "role", "pos")


@query(f"""with {_CLIPS}, p as (select series_id, ep, (50.0 + 2 * ep)::double as d, case when 50 + 2 * ep < 90 then 4 when 50 + 2 * ep < 180 then 7 else 10 end as most, case when ep % 9 <> 0 then time_s end as t from c),
 b as (select *, least(floor(t / (d / (most - 2))), most - 3)::int as b from p), f as (select series_id, ep, d, most, b, min(case when t > 1 and t < d - 1 then t end) as f, count(t) as n from b group by all),
 g as (select series_id, ep, d, most, sum(n) as n, list(struct_pack(b := b, f := f)) filter (where f is not null) as fs from f group by all),
 h as (select *, case when n > 0 then list_transform(range(0, most - 2), lambda k: round_even(coalesce(list_filter(fs, lambda x: x.b = k)[1].f, (k + 0.5) * (d / (most - 2))), 1))
   else list_transform(case when d < 90 then [0.25, 0.5, 0.75] when d < 180 then [0.15, 0.3, 0.5, 0.7, 0.85] else [0.1, 0.22, 0.35, 0.5, 0.6, 0.75, 0.9] end, lambda s: round_even(d * s::double, 1)) end as ts from g),
 i as (select *, list_sort(list_distinct(list_concat(case when d > 5 then [2.0::double, round_even(d - 2, 1)] else [2.0::double] end, list_filter(ts, lambda t: t > 1 and t < d - 1)))) as every from h),
 j as (select *, list_reduce(list_concat([[]::double[]], list_transform(every, lambda t: [t])), lambda acc, x: case when len(acc) = 0 or x[1] - acc[-1] >= 5 then list_append(acc, x[1]) else list_append(acc[1:len(acc) - 1], round_even((acc[-1] + x[1]) / 2, 1)) end) as m from i)
 select series_id, ep, unnest(m[1:most]) as time_s from j""")
def key_timestamps(spark, sf_dir):
    """The seconds at which an episode's frames are taken, from its scene points."""
    c = A.clips(spark, sf_dir).select("series_id", "ep", F.when(F.col("ep") % 9 != 0, F.col("time_s")).alias("at"), (50.0 + 2 * F.col("ep")).alias("duration_s"))
    return W.key_times(c, ["series_id", "ep"], "at", "duration_s")


_ADD = "(case when acc.need > 0 and x.need * 1.5 > x.out[1] then least(x.need * 1.5 - x.out[1], acc.need / len(ds) * 2) else 0.0 end)"


@query(f"""with {_CUT}, ub as (select series_id, mol_type, list(struct_pack(d := dur_s, hi := dur_hi) order by pos) as ds, sum(dur_s) as total, min(target_dur)::double as target from t group by all),
 uc as (select series_id, mol_type, list_reduce(list_concat([struct_pack(need := case when total < target * 0.8 then target * 0.9 - total else 0.0 end, out := []::double[])], list_transform(ds, lambda x: struct_pack(need := x.hi, out := [x.d]))),
   lambda acc, x: struct_pack(need := acc.need - {_ADD}, out := list_append(acc.out, round(x.out[1] + {_ADD}, 1)))).out as durs from ub)
 select series_id, mol_type, cast(pos as int) as pos, ingest_pos, dur_s, durs[pos] as stretched_s from t join uc using (series_id, mol_type)""")
def cut_stretch(spark, sf_dir):
    """Clip lengths after short cuts were stretched towards the template's length."""
    c = cut(spark, sf_dir).select("series_id", "mol_type", "pos", "ingest_pos", "dur_s", "dur_hi", "target_dur")
    return W.stretched(c, ["series_id", "mol_type"], "pos", "dur_s", "dur_hi", "target_dur").select("series_id", "mol_type", "pos", "ingest_pos", "dur_s", "stretched_s")


@query(f"with {_CLIPS} select ep, cast(time_s as int) as time_s, count(*) as n from c where emotion >= 2 group by 1, 2")
def review_round_trip(spark, sf_dir):
    """Marks of a review table, written as CSV and read back."""
    at = A.new_folder(spark, "review")
    mark = F.when(F.col("emotion") < 2, "N").when(F.col("emotion") == 2, " yes").otherwise("Y")
    V.write_review(A.clips(spark, sf_dir).select(mark.alias("keep"), "ep", "time_s"), at)
    return V.kept_keys(V.read_review(spark, at)).groupBy("ep", "time_s").agg(F.count("*").alias("n"))


@query(f"with {_CLIPS} select series_id, ep, count(*) as n, sum(emotion)::bigint as emotion from c group by 1, 2")
def stream_ingest(spark, sf_dir):
    """Events that arrive as a stream, annotated batch by batch; a second run with the same checkpoint adds nothing."""
    schema, to, state = A.table(spark, sf_dir, "events").schema, A.new_folder(spark, "ingested"), A.new_folder(spark, "ingest-state")
    annotate = lambda batch: batch.sparkSession.sql(A.CLIPS, events=batch)
    for _ in range(2):
        I.ingest(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"), annotate, to, state).awaitTermination()
    return spark.read.parquet(to).groupBy("series_id", "ep").agg(F.count("*").alias("n"), F.sum("emotion").alias("emotion"))


_DIRECTIONS = f"d as (select *, unnest({list(D.MODIFIERS)}) as direction from c)"


def _weight(part: str) -> str:
    changed = " ".join(f"when '{d}' then {m[part]}" for d, m in D.MODIFIERS.items() if part in m)
    return f"round({D.BASE[part]} * (case direction {changed} else 1.0 end), 2)"


_FACES = "(case when face_quality in ('无人', '模糊') then 0 else 1 end)"


@query(f"""with {_CLIPS}, {_DIRECTIONS} select ingest_pos, direction, cast(round((case emotion when 1 then 0 when 2 then 5 when 3 then 15 when 4 then 40 else 70 end) * {_weight('emotion')}
 + least(30.0, ({_RARE}) * 5) * {_weight('scene_rare')} + least(40, (speech_density - 1) * 8) * {_weight('dialogue')} + (case when event <> '日常' then 12 else 0 end) * {_weight('content')} + {_FACES} * 4 * {_weight('faces')}, 1) as double) as score from d""")
def weighted_scores(spark, sf_dir):
    """Each clip's score under the weights of every editing direction."""
    rarity = F.create_map(*(F.lit(x) for kv in dims.RARITY.items() for x in kv))
    rare = sum((F.coalesce(rarity[F.col(c)], F.lit(1.0)) for c in ("event", "event_subtype", "shot")), F.lit(0.0))
    faces = F.when(F.col("face_quality").isin("无人", "模糊"), 0).otherwise(1)
    c = A.clips(spark, sf_dir).withColumn("direction", F.explode(D.directions()))
    score = D.weighted_score(F.col("direction"), rare, F.col("speech_density") - 1, F.col("event") != "日常", faces)
    return c.select("ingest_pos", "direction", score.alias("score"))


_INNER = ", ".join(map(_q, D.INNER))


@query(f"""with {_CLIPS}, {_DIRECTIONS}, t as (select *, speech_density > 3 as spoken, event <> '日常' as described, event in ({_INNER}) or shot in ({_INNER}) as inward, {_FACES} > 0 as seen from d),
 a as (select *, case direction when 'first_person' then emotion >= 3 and (spoken or inward) when 'third_person' then true when 'role_cut' then seen and spoken when 'episode_split' then emotion >= 3
 when 'highlight_mix' then emotion >= 4 when 'emotion_focus' then emotion >= 3 and (described or spoken) when 'commentary' then spoken or described else true end as ok from t)
 select series_id, direction, count(*) filter (where ok) as n, count(*) as total from a group by 1, 2""")
def direction_prefilter_counts(spark, sf_dir):
    """How many clips of a series each editing direction may use."""
    c = A.clips(spark, sf_dir).withColumn("direction", F.explode(D.directions()))
    faces = F.when(F.col("face_quality").isin("无人", "模糊"), 0).otherwise(1)
    ok = D.allowed(F.col("direction"), F.col("emotion"), F.greatest(F.lit(0), F.col("speech_density") - 3), F.array("event", "shot"), F.col("event") != "日常", faces)
    return c.groupBy("series_id", "direction").agg(F.count_if(ok).alias("n"), F.count("*").alias("total"))


_LABELLED = """l as (select ingest_pos, nullif(event, '日常') as mood, shot as scene, event_subtype as props, case when speech_density >= 4 then '竖排的纯文字占满了整个画面' when emotion = 4 then '剧终' when emotion = 5 then '纯黑' end as subtitle_text,
 case face_quality when '正脸' then '一人可见' when '侧脸' then '一人半面' when '无人' then '[]' else '一人' end as chars, case when reject_reason = '黑屏' then '低质量' else reject_reason end as reject_reason, cast(null as varchar(9)) as event_subtype,
 case when action_level = 1 then '模糊' else '可见' end as event_conf, case when visual_quality = 5 then null else visual_quality end as visual_quality, action_direction, emotion_trend, audio_energy > 1 as probe_usable from c)"""
_LICENCES = f"({_any('blob', L.LICENCE)})"


@query(f"""with {_CLIPS}, {_LABELLED}, b as (select *, concat_ws(' ', coalesce(mood, ''), scene, props, coalesce(subtitle_text, ''), chars) as blob, coalesce(visual_quality, 3) as seen from l),
 r as (select *, case when not probe_usable and seen <= 2 then '低质量' when {_LICENCES} then '片头' when {_any('blob', L.ENDING)} then '片尾' when {_any('blob', L.WHITE)} then '白屏' when {_any('blob', L.BLACK)} then '黑屏'
 when length(coalesce(subtitle_text, '')) >= 12 and {_any('blob', L.CARD)} then '纯文字' when event_conf = '模糊' and seen <= 2 then '模糊' when reject_reason = '低质量' and seen >= 3 then '无' else reject_reason end as reason,
 case when action_direction = '' then '静止' else action_direction end as act from b)
 select ingest_pos, reason as reject_reason, reason = '无' as usable, case when reason <> '无' then '模糊' else event_conf end as event_conf,
 case emotion_trend || '|' || act {' '.join(f"when '{a}|{b}' then {v}" for (a, b), v in L.EMOTION.items())} else 2 end as emo, case act {' '.join(f"when '{k}' then {v}" for k, v in L.ACTION.items())} end as action_level,
 coalesce(visual_quality, case when reason in ('白屏', '黑屏', '模糊', '低质量') then 1 when reason in ('片头', '片尾', '纯文字', '空镜') then 2 else 3 end) as visual_quality,
 case when chars like '%可见%' then '正脸' when chars like '%半面%' then '侧脸' when chars = '[]' then '无人' else '模糊' end as face_quality,
 case when reason in ({', '.join(map(_q, L.FRAMES))}) then reason else {_case('blob', L.SUBTYPES, "'无'")} end as event_subtype from r""")
def label_quality(spark, sf_dir):
    """Labels made whole: reject reason, trends, levels and qualities that were left out."""
    c = A.clips(spark, sf_dir)
    said = F.when(F.col("speech_density") >= 4, "竖排的纯文字占满了整个画面").when(F.col("emotion") == 4, "剧终").when(F.col("emotion") == 5, "纯黑")
    face = F.col("face_quality")
    raw = c.select(
        "ingest_pos", F.lit("").alias("hint"), F.nullif("event", F.lit("日常")).alias("mood"), F.col("shot").alias("scene"), F.col("event_subtype").alias("props"), said.alias("subtitle_text"),
        F.when(face == "正脸", "一人可见").when(face == "侧脸", "一人半面").when(face == "无人", "[]").otherwise("一人").alias("chars"),
        F.when(F.col("reject_reason") == "黑屏", "低质量").otherwise(F.col("reject_reason")).alias("reject_reason"), F.lit(None).cast("string").alias("event_subtype"), "shot",
        F.when(F.col("action_level") == 1, "模糊").otherwise("可见").alias("event_conf"), F.nullif("visual_quality", F.lit(5)).alias("visual_quality"), F.lit(None).cast("string").alias("face_quality"),
        F.lit(None).cast("boolean").alias("dialogue_visible"), F.lit(None).cast("boolean").alias("usable"), "action_direction", "emotion_trend", (F.col("audio_energy") > 1).alias("probe_usable"), F.lit(None).cast("string").alias("probe_reason"),
    )
    return L.filled(raw).select("ingest_pos", "reject_reason", "usable", "event_conf", "emo", "action_level", "visual_quality", "face_quality", "event_subtype")


@query(f"""with {_CLIPS}, g as (select series_id, {_STAGE} as stage, min(ep) as ep_lo, max(ep) as ep_hi from c group by 1, 2), s as (select *, row_number() over (partition by series_id order by stage) - 1 as node_pos from g)
 select series_id, 'node' as kind, cast(node_pos as int) as pos, cast(stage as varchar) as name, ep_lo, ep_hi from s
 union all select series_id, 'quote', max(emotion), cast(ep as varchar), ep, cast(max(time_s) as int) from c group by series_id, ep""")
def story_profiles(spark, sf_dir):
    """Profiles of each series, written as JSON and read back as plot nodes and quotes."""
    c, at = A.clips(spark, sf_dir).withColumn("stage", R.stage_index(F.col("ep"))), A.new_folder(spark, "profiles")
    two = lambda x: F.when(x < 10, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    n = c.groupBy("series_id", "stage").agg(F.min("ep").alias("lo"), F.max("ep").alias("hi"))
    node = F.struct("stage", F.struct(F.concat(F.lit("EP"), two(F.col("lo")), F.lit("-EP"), two(F.col("hi"))).alias("集数范围"), F.col("stage").cast("string").alias("阶段")).alias("n"))
    n = n.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"]).alias("情节节点"))
    q = c.groupBy("series_id", "ep").agg(F.max("time_s").cast("int").alias("t"), F.max("emotion").alias("impact"))
    quote = F.struct(F.concat(F.lit("EP"), two(F.col("ep"))).alias("episode"), F.concat_ws(":", two(F.floor(F.col("t") / 60)), two(F.col("t") % 60)).alias("timestamp"), F.col("ep").cast("string").alias("text"), "impact")
    q = q.groupBy("series_id").agg(F.collect_list(quote).alias("golden_quotes"))
    P.write_rows(n.join(q, "series_id").select("series_id", F.to_json(F.struct("情节节点", "golden_quotes")).alias("value")), at)
    p = P.read_rows(spark, at)
    nodes = P.nodes(p).select("series_id", F.lit("node").alias("kind"), F.col("node_pos").alias("pos"), F.col("stage").alias("name"), "ep_lo", "ep_hi")
    return nodes.unionByName(P.quotes(p).select("series_id", F.lit("quote").alias("kind"), F.col("impact").alias("pos"), F.col("text").alias("name"), F.col("ep").alias("ep_lo"), F.col("time_s").cast("int").alias("ep_hi")))


_THIRD = "case when ep <= 0 then -1 when ep <= floor(mx * 0.33) then 0 when ep <= floor(mx * 0.66) then 1 else 2 end"
_CLIP = "struct_pack(rank := rank, role := role, third := third, ingest_pos := ingest_pos, ep := ep)"
_AT = "list_position(list_transform(kept, lambda x: x.role = s{k}.role and len(list_filter(kept, lambda y: y.third = x.third)) > 1), true)"
_SWAPS = ", ".join(
    f"w{k + 1} as (select series_id, s0, s1, s2, case when s{k} is not null and len(list_filter(kept, lambda x: x.third = {k})) = 0 and {_AT.format(k=k)} > 0 then list_append(list_concat(kept[1:{_AT.format(k=k)} - 1], kept[{_AT.format(k=k)} + 1:]), s{k}) else kept end as kept from w{k})"
    for k in range(3)
)


@query(f"""with {_CLIPS}, a0 as (select series_id, ingest_pos, ep, {_CLASSIC} as score, {_role('event')} as role from c), a as (select *, row_number() over (partition by series_id order by score desc, ingest_pos) as rank, max(ep) over (partition by series_id) as mx from a0),
 b as (select *, {_THIRD} as third, row_number() over (partition by series_id, role order by rank) as k from a), n as (select *, row_number() over (partition by series_id order by case when k = 1 then 0 when k <= {_PER} then 1 else 2 end, rank) as n from b),
 h as (select series_id, list({_CLIP} order by rank) as kept from n where n <= 8 group by series_id), sp as (select series_id, third, arg_min({_CLIP}, rank) as s from b where third >= 0 and mx > 50 group by all),
 w0 as (select h.series_id, kept, (select s from sp where sp.series_id = h.series_id and third = 0) as s0, (select s from sp where sp.series_id = h.series_id and third = 1) as s1, (select s from sp where sp.series_id = h.series_id and third = 2) as s2 from h), {_SWAPS},
 z as (select series_id, unnest(kept) as x from w3), y as (select series_id, x.ingest_pos as ingest_pos, x.ep as ep, x.role as role, x.rank as rank from z)
 select series_id, ingest_pos, ep, role, cast(row_number() over (partition by series_id order by {_BEAT}, rank) as int) as pos from y""")
def episode_spread(spark, sf_dir):
    """The clips of narrative_diversity, swapped so that each third of a long story is there."""
    c = A.clips(spark, sf_dir).select("series_id", "ingest_pos", "ep", R.clip_score().alias("score"), R.narrative().alias("role"))
    order = [F.desc("score"), "ingest_pos"]
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(*order)))
    chosen = W.narrative_mix(ranked, ["series_id"], ["rank"], "role", dims.BEATS).drop("pos")
    spread = W.episode_spread(chosen, ranked, ["series_id"], "role", "rank")
    return W.narrative_mix(spread, ["series_id"], ["rank"], "role", dims.BEATS).select("series_id", "ingest_pos", "ep", "role", "pos")
