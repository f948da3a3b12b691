"""Registered queries of template selection on full labels: boosts, scores, filter tiers, ranking, variety, order, cuts, timelines, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import selection as S
from ..operators import joins as J
from ..operators import ranking as K
from ..operators import windows as W
from ..sources import adapters as A
from . import catalogue, dims, enrichment
from .catalogue import _CUES, _NODES, ORACLES, _any, query

_EV = "concat_ws(' ', event, event_subtype, mood, shot, desc_clean)"
_NAMES_SAID = " + ".join(f"(case when contains(desc_clean, '{n}') then 1 else 0 end)" for n, _ in dims.CHARACTERS)
_NARRATIVE = " + ".join(
    f"(case when ep between {lo} and {hi} then {int(any(w in stage for w in dims.PEAKS))} * (1 + (case when {_any('ev', S.PEAK_EVENTS)} then 1 else 0 end)) + {0.5 if any(w in stage for w in dims.NAMED) else 0.0} * ({_NAMES_SAID}) else 0 end)"
    for stage, lo, hi in dims.STAGES
)
_CHARACTER = "least(4.0, " + " + ".join(f"(case when contains(concat(desc_clean, ' ', ev), '{n}') then (case when {_any('ev', ts)} then 1.5 else 0.5 end) else 0 end)" for n, ts in dims.CHARACTERS) + ")"
_TOLD = f"""{enrichment.BANDED}, {_CUES}, {_NODES}, sa as (select *, {_EV} as ev, coalesce((select stage from n where b1.ep between ep_lo and ep_hi order by node_pos limit 1), '未知') as story_stage,
 exists (select 1 from u where u.ep = b1.ep and abs(u.start_s - b1.time_s) <= 5 and u.chars >= 40) as quoted from b1), sb as (select *, ({_NARRATIVE})::double as narrative, {_CHARACTER}::double as characters from sa)"""
_M = "m(mol_type, target_dur, min_clips, max_clips, dur_lo, dur_hi, emo_min, events, shots, beats, w1, w2, w3, w4, flow) as (values " + ", ".join(
    f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]}::double, {v[4]}::double, {v[5]}, {v[6]}::varchar[], {v[7]}::varchar[], map {{{', '.join(f"'{b}': {x}::double" for b, x in v[8].items())}}}, {', '.join(f'{w}::double' for w in dims.FUSION[k])}, {dims.FLOW[k]})" for k, v in dims.MOLECULES.items()
) + ")"
_QUOTED, _ANCHORED = "transcript_excerpt <> ''", "dialogue_anchor in ('boundary', 'dense_speech')"
_OWN = f"""(case mol_type when 'quote_rhythm' then speech_density * 8 + (case when {_QUOTED} then 16 else 0 end) + (case when {_ANCHORED} then 10 else 0 end)
 when 'identity_twist' then speech_density * 6 + (case when {_QUOTED} then 12 else 0 end) + (case when dialogue_visible then 8 else 0 end) when 'emotional_resonance' then audio_energy * 7 + (case when {_QUOTED} then 10 else 0 end)
 when 'cinematic_beauty' then (case when aesthetic_score > 0 then aesthetic_score * 15 else visual_quality * 10 end) + (case when shot in ('全景', '特写') then 15 else 0 end) + (case when face_quality = '无人' then 4 else 0 end) + least(4, audio_energy)
 else audio_energy * 5 + (case when has_speech_peak then 12 else 0 end) + (case when beat_nearby then 8 else 0 end) end)"""
_SCORE = f"""cast(emotion * 12 + action_level * 10 + visual_quality * 8 + (case when face_quality in ('正脸', '侧脸', '半面') then 10 else 0 end) + (case when dialogue_visible then 8 else 0 end) + least(10, length(subtitle_text) // 2)
 + 18 * len(list_filter(events, lambda e: contains(ev, e))) + {' + '.join(f"(case when contains(ev, '{x}') then 12 else 0 end)" for x in dims.SCORED_SUBTYPES)} + {_OWN}
 + (case when aesthetic_score > 0 and mol_type <> 'cinematic_beauty' then aesthetic_score * 5 else 0 end) - (case when not usable then 100 else 0 end) - (case when event_conf = '模糊' then 50 else 0 end) as int)"""
_FUSED = f"""{_TOLD}, {_M}, xa as (select *, {_SCORE} as molecular from sb cross join m), xb as (select *, round((w1 * molecular / 250.0 + w2 * aesthetic_score / 10.0 + w3 * hook_value / 5.0 + w4 * promo_value / 5.0) / (w1 + w2 + w3 + w4)
 + 0.08 * narrative + (case when mol_type = 'quote_rhythm' and quoted then 0.15 else 0 end) + (case when mol_type = 'identity_twist' then 0.05 * characters else 0 end), 6) as fusion from xa)"""


def told(spark, sf_dir):
    """Banded clips with their stage, whether a long line is near, and what the story and its characters add."""
    c = enrichment.banded(spark, sf_dir)
    quotes = A.cues(spark, sf_dir).where("chars >= 40").select(F.col("ep").cast("int").alias("ep"), F.col("start_s").alias("time_s"))
    nodes = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(lo).alias("ep_lo"), F.lit(hi).alias("ep_hi")) for s, lo, hi in dims.STAGES))
    stage = F.get(F.filter(nodes, lambda n: F.col("ep").between(n["ep_lo"], n["ep_hi"])), F.lit(0))["stage"]  # nodes are in their order
    c = J.beside(c, quotes, ["ep"], "time_s", 5.0, "quoted").withColumns({"story_stage": F.coalesce(stage, F.lit("未知"))} | S.texts())
    people = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, ts)).alias("terms")) for n, ts in dims.CHARACTERS))
    return c.withColumns({"narrative": S.narrative_boost(nodes, F.transform(people, lambda p: p["name"])), "characters": S.character_boost(people)})


#: What S.texts() and S.prepared() add.
_PREPARED = ["_event", "_event_low", "_words", "_hits", "_shots", "_plain", "_fair", "_high"]


def fused(clips):
    """Clips of told() beside each template, with both scores."""
    f = clips.withColumns(S.prepared()).crossJoin(F.broadcast(dims.molecules(clips.sparkSession))).withColumn("molecular", S.molecular_score())
    return f.withColumn("fusion", F.round(S.fusion_score(), 6))


@query(f"with {_TOLD} select series_id, ingest_pos, story_stage, narrative, characters, quoted from sb")
def story_boosts(spark, sf_dir):
    return told(spark, sf_dir).select("series_id", "ingest_pos", "story_stage", "narrative", "characters", "quoted")


@query(f"with {_FUSED} select series_id, ingest_pos, mol_type, molecular, round(fusion, 4) as fusion from xb")
def full_fusion(spark, sf_dir):
    """Molecular and fused score of every clip under every template, with all terms and boosts."""
    return fused(told(spark, sf_dir)).select("series_id", "ingest_pos", "mol_type", "molecular", F.round("fusion", 4).alias("fusion"))


_DESC = "length(desc_clean) >= 30"
_SUB = "event_subtype not in ('', '无')"


def _fits(strict: bool) -> str:
    least = "emo_min" if strict else "greatest(2, emo_min - 1)"
    hard = f""" and (mol_type = 'cinematic_beauty' or face_quality not in ('模糊', '无人')) and (len(events) = 0 or len(list_filter(events, lambda e: contains(ev, e))) > 0) and (len(shots) = 0 or len(list_filter(shots, lambda e: contains(shot, e))) > 0)"""
    return f"""(emotion >= {least} and usable and not (event_conf = '模糊' and visual_quality <= 2) and (case when mol_type = 'cinematic_beauty' then visual_quality >= 4 or (visual_quality >= 3 and {_SUB} and {_DESC}) else visual_quality >= 3 end)
 and not {_any('desc_clean', S.HEDGES)} and not (mol_type = 'cinematic_beauty' and face_quality = '模糊') and {_DESC}{hard if strict else ''})"""


#: Every third series counts as one of older labels: no sound was measured.
_OLDER = f"""{_TOLD}, {_M}, od as (select * replace (case when cast(substr(series_id, 2) as int) % 3 = 0 then 1 else audio_energy end as audio_energy, case when cast(substr(series_id, 2) as int) % 3 = 0 then 1 else speech_density end as speech_density) from sb),
 ob as (select *, {_SCORE} as molecular, {_fits(True)} as s1, {_fits(False)} as s2, (visual_quality >= 3 and usable and {_SUB} and {_DESC}) as s3 from od cross join m),
 oc as (select *, count(*) filter (where s1) over w as n1, count(*) filter (where s2) over w as n2, count(*) filter (where s3) over w as n3, count(*) filter (where usable) over w as n4, avg(case when audio_energy > 1 or speech_density > 1 then 1.0 else 0.0 end) over w < 0.2 as legacy from ob window w as (partition by series_id, mol_type)),
 oe as (select *, case when n1 >= min_clips or not (legacy and n2 > n1) then 'strict' else 'relaxed' end as first_tier, case when n1 >= min_clips or not (legacy and n2 > n1) then n1 else n2 end as n0 from oc),
 og as (select *, case when n0 >= min_clips then first_tier when mol_type = 'cinematic_beauty' then (case when n3 > n0 then 'quality' else first_tier end) when legacy and n4 > n0 then 'best' else first_tier end as tier,
   row_number() over (partition by series_id, mol_type, usable order by molecular desc, ingest_pos) as best from oe)"""


@query(f"with {_OLDER} select series_id, mol_type, ingest_pos, tier from og where case tier when 'strict' then s1 when 'relaxed' then s2 when 'quality' then s3 else usable and best <= greatest(3 * min_clips, 20) end")
def filter_pools(spark, sf_dir):
    """Each template's pool: by the strict filter, the relaxed one for older labels, else by quality or, for older labels, by score."""
    older = F.substring("series_id", 2, 20).cast("int") % 3 == 0
    c = told(spark, sf_dir).withColumns({n: F.when(older, 1).otherwise(F.col(n)) for n in ("audio_energy", "speech_density")})
    d = c.withColumns(S.prepared()).crossJoin(F.broadcast(dims.molecules(spark)))
    return pools(d).select("series_id", "mol_type", "ingest_pos", "tier")


def pools(d):
    # counts and places over one order, usable clips first: one sort and one pass of six rows a clip
    o = Window.partitionBy("series_id", "mol_type").orderBy(F.desc("__4"), F.desc("molecular"), "ingest_pos")
    w = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"molecular": S.molecular_score(), "__1": S.fits(True), "__2": S.fits(False), "__3": S.quality_fits(), "__4": F.col("usable")})
    d = d.withColumns({f"__n{k}": F.count_if(f"__{k}").over(w) for k in range(1, 5)} | {"__old": F.avg(R.flag((F.col("audio_energy") > 1) | (F.col("speech_density") > 1))).over(w) < 0.2, "__best": F.row_number().over(o)})
    strict = (F.col("__n1") >= F.col("min_clips")) | ~(F.col("__old") & (F.col("__n2") > F.col("__n1")))
    d = d.withColumns({"__t": F.when(strict, "strict").otherwise("relaxed"), "__n0": F.when(strict, F.col("__n1")).otherwise(F.col("__n2"))})
    tier = F.when(F.col("__n0") >= F.col("min_clips"), F.col("__t")).when(F.col("mol_type") == "cinematic_beauty", F.when(F.col("__n3") > F.col("__n0"), "quality").otherwise(F.col("__t"))).when(F.col("__old") & (F.col("__n4") > F.col("__n0")), "best").otherwise(F.col("__t"))
    d = d.withColumn("tier", tier)
    inside = F.when(F.col("tier") == "strict", F.col("__1")).when(F.col("tier") == "relaxed", F.col("__2")).when(F.col("tier") == "quality", F.col("__3")).otherwise(F.col("__4") & (F.col("__best") <= F.greatest(F.col("min_clips") * 3, F.lit(20))))
    return d.where(inside).drop(*(c for c in d.columns if c.startswith("__")))


_BEAT = "case event " + " ".join(f"when '{k}' then '{v}'" for k, v in dims.NARRATIVE.items()) + " else 'rising' end"
_PLACE = "case nf " + " ".join(f"when '{b}' then {k}" for k, b in enumerate(("hook", "setup", "inciting", "rising", "climax", "transition"))) + " end"
_HIGH = f"((emotion >= 5 or action_level >= 4) and {_any('ev', dims.CLASH)} and visual_quality >= 3 and face_quality not in ('无人', '模糊') and event_conf <> '模糊' and usable)"
_RANKED = f"""{_FUSED}, ra as (select *, {_BEAT} as nf, {_HIGH} as high from xb where {_fits(True)}), rb as (select *, row_number() over (partition by series_id, mol_type order by fusion desc, ingest_pos) as r, least(max_clips, count(*) over (partition by series_id, mol_type)) as n from ra),
 rc as (select *, row_number() over (partition by series_id, mol_type, nf order by r) as k, coalesce(beats[nf], 0.0) as share from rb), rd as (select *, share > 0 and k <= greatest(1, round_even(n * share, 0)) as chosen from rc),
 re as (select *, sum(case when chosen then 1 else 0 end) over (partition by series_id, mol_type) as c, sum(case when chosen then 1 else 0 end) over (partition by series_id, mol_type, story_stage) as u from rd),
 rf as (select *, case when u > 0 then u else 99 end as used, coalesce(mol_type in ('hook_clash', 'quote_rhythm', 'suspense_hook') and r = min(case when high then r end) over (partition by series_id, mol_type), false) as head from re),
 rg as (select *, row_number() over (partition by series_id, mol_type, chosen order by used, r) as f from rf), rh as (select *, row_number() over (partition by series_id, mol_type order by case when head then 0 else 1 end, case when chosen then 0 else 1 end, case when chosen then {_PLACE} else used end, r) as p from rg where chosen or f <= n - c or head),
 ri as (select *, row_number() over (partition by series_id, mol_type, ep, round_even(time_s / 5, 0) order by p) = 1 as spread from rh), rj as (select *, row_number() over (partition by series_id, mol_type, ep, round_even(time_s / 3, 0), spread order by p) = 1 as spare from ri),
 rk as (select *, row_number() over (partition by series_id, mol_type order by case when spread then 0 else 1 end, p) as pos from rj where spread or spare), rl as (select * exclude (r), pos as rank from rk where pos <= n)"""


def ranked(spark, sf_dir):
    """Each template's ranking of a series: pos, the best of each beat first where nothing is forced."""
    p = fused(told(spark, sf_dir)).where(S.fits(True)).withColumn("nf", R.narrative())
    forced = F.col("mol_type").isin("hook_clash", "quote_rhythm", "suspense_hook") & F.col("_high")
    return K.by_beats(p, ["series_id", "mol_type"], "fusion", "ingest_pos", F.col("max_clips"), "nf", "story_stage", "ep", "time_s", ["hook", "setup", "inciting", "rising", "climax", "transition"], forced).withColumnRenamed("pos", "rank").drop(*_PREPARED)


@query(f"with {_RANKED} select series_id, mol_type, ingest_pos, nf, cast(rank as int) as rank from rl")
def beat_ranking(spark, sf_dir):
    """Quotas by beat, filling by stage, a forced opening and two rounds of spacing."""
    return ranked(spark, sf_dir).select("series_id", "mol_type", "ingest_pos", "nf", "rank")


def _fold(name: str, per_ep: int, same: int, apart: int) -> str:
    kind = "struct(rank bigint, ep int, t double, shot varchar, scene varchar, b bigint)[]"
    fits = f"""len(list_filter(s.kept, lambda o: o.ep = c.ep)) < {per_ep} and not (len(s.kept) >= {same} and len(list_filter(s.kept[-{same}:], lambda o: o.shot = c.shot)) = {same})
      and len(list_filter(s.kept, lambda o: o.ep = c.ep and abs(o.t - c.time_s) < {apart})) = 0 and (c.skey = '' or len(list_filter(s.kept, lambda o: o.scene = c.skey)) < 2)"""
    return f"""{name}(series_id, mol_type, k, kept) as (select distinct series_id, mol_type, 0::bigint, []::{kind} from cut union all
     select s.series_id, s.mol_type, s.k + 1, case when {fits} and (case when s.k < c.l then len(s.kept) < c.min_clips else len(list_filter(s.kept, lambda o: o.b = c.b)) = 0 end)
       then list_append(s.kept, struct_pack(rank := c.rank, ep := c.ep, t := c.time_s, shot := c.shot, scene := c.skey, b := c.b)) else s.kept end
     from {name} s join cut c on c.series_id = s.series_id and c.mol_type = s.mol_type and c.rank = s.k % c.l + 1 where s.k < 2 * c.l)"""


_LADDER = f"""{_RANKED}, lim as (select *, min(ep) over w as lo, greatest(1, (max(ep) over w - min(ep) over w + 1) // 6) as width, count(*) over w as l from rl window w as (partition by series_id, mol_type)),
 cut as (select *, substr(scene, 1, 10) as skey, least(5, (ep - lo) // width)::bigint as b from lim), {_fold('f1', 4, 2, 8)}, {_fold('f2', 6, 3, 3)},
 p1 as (select series_id, mol_type, arg_max(kept, k) as kept from f1 group by all), p2 as (select series_id, mol_type, arg_max(kept, k) as kept from f2 group by all),
 q1 as (select series_id, mol_type, unnest(kept).rank as rank, generate_subscripts(kept, 1) as taken from p1), q2 as (select series_id, mol_type, unnest(kept).rank as rank, generate_subscripts(kept, 1) as taken from p2),
 q3 as (select series_id, mol_type, rank, row_number() over (partition by series_id, mol_type order by rank) as taken from rl where aesthetic_score >= 3 and length(desc_clean) > 15), q4 as (select series_id, mol_type, rank, rank as taken from rl),
 need as (select series_id, mol_type, min(min_clips) as need, min(max_clips) as most, (select count(*) from q1 where q1.series_id = rl.series_id and q1.mol_type = rl.mol_type) as c1, (select count(*) from q2 where q2.series_id = rl.series_id and q2.mol_type = rl.mol_type) as c2, (select count(*) from q3 where q3.series_id = rl.series_id and q3.mol_type = rl.mol_type) as c3 from rl group by series_id, mol_type),
 rung as (select *, case when c1 >= need then 'strict' when c2 >= need then 'relaxed' when c3 >= need then 'quality' else 'top' end as rung from need),
 pick as (select 'strict' as rung, * from q1 union all select 'relaxed', * from q2 union all select 'quality', * from q3 union all select 'top', * from q4),
 sel as (select rl.*, pick.rung, pick.taken from pick join rung using (series_id, mol_type, rung) join rl using (series_id, mol_type, rank) where pick.taken <= most)"""

#: The twin of the plain variety query, which knows no scenes and no target.
ORACLES["diversity_selection"] = f"""with recursive {catalogue._RANKED}, lim as (select *, min(ep) over w as lo, greatest(1, (max(ep) over w - min(ep) over w + 1) // 6) as width, count(*) over w as l from r where rank <= max_clips window w as (partition by series_id, mol_type)),
 cut as (select * exclude (min_clips), min_clips as need, 1000000 as min_clips, '' as skey, least(5, (ep - lo) // width)::bigint as b from lim), {_fold('f1', 4, 2, 8)}, {_fold('f2', 6, 3, 3)},
 p1 as (select series_id, mol_type, arg_max(kept, k) as kept from f1 group by all), p2 as (select series_id, mol_type, arg_max(kept, k) as kept from f2 group by all), need as (select series_id, mol_type, min(need) as need from cut group by all),
 z as (select series_id, mol_type, case when len(p1.kept) >= need then 'strict' else 'relaxed' end as pass, unnest(case when len(p1.kept) >= need then p1.kept else p2.kept end).rank as rank from p1 join p2 using (series_id, mol_type) join need using (series_id, mol_type))
 select series_id, mol_type, cut.ingest_pos, cut.ep, cast(rank as int) as rank, pass from z join cut using (series_id, mol_type, rank)"""


def kept_ranking(spark, sf_dir):
    """The ranking, written and read back: a template's size of rows a series, and what selects from it reads it more than once."""
    at = A.new_folder(spark, "ranked")
    ranked(spark, sf_dir).write.parquet(at)
    return spark.read.parquet(at)


def selected(r):
    """The ranking r, which is read twice, under variety limits; where too few are left the looser limits, then those with looks and a description, then all. Adds rung and taken."""
    key = ["series_id", "mol_type"]
    looks = (F.col("aesthetic_score") >= 3) & (F.length("desc_clean") > 15)
    row = W.one_row(scene="scene").withField("looks", looks)
    g = r.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("__all"), F.min("min_clips").alias("__need"), F.min("max_clips").alias("__most"))
    g = g.withColumns({"__one": W.varied("__all", F.col("__need")), "__two": W.varied("__all", F.col("__need"), per_ep=6, same_shot=3, apart=3.0), "__three": F.filter("__all", lambda x: x["looks"])})
    rungs = [("strict", "__one"), ("relaxed", "__two"), ("quality", "__three")]
    choice = F
    for name, c in rungs:
        choice = choice.when(F.size(c) >= F.col("__need"), F.struct(F.lit(name).alias("rung"), F.col(c).alias("rows")))
    g = g.withColumn("__c", choice.otherwise(F.struct(F.lit("top").alias("rung"), F.col("__all").alias("rows"))))
    chosen = g.select(*key, F.col("__c.rung").alias("rung"), F.posexplode(F.slice("__c.rows", F.lit(1), F.col("__most"))).alias("__k", "__x"))
    return r.join(chosen.select(*key, "rung", (F.col("__k") + 1).alias("taken"), F.col("__x.rank").alias("rank")), [*key, "rank"])


@query(f"with recursive {_LADDER} select series_id, mol_type, ingest_pos, rung, cast(taken as int) as taken from sel")
def spread_selection(spark, sf_dir):
    return selected(kept_ranking(spark, sf_dir)).select("series_id", "mol_type", "ingest_pos", "rung", "taken")


_INDEX = "case when " + " when ".join(f"contains(story_stage, '{w}') then {k + 1}" for k, w in enumerate(dims.STAGE_WORDS)) + " when ep <= 10 then 1 when ep <= 25 then 2 when ep <= 45 then 3 when ep <= 62 then 4 when ep <= 76 then 5 else 0 end"
#: Clips of later episodes than the story's last stand at the end, so every ninth counts as such.
_ORDERED = f"""{_LADDER}, ta as (select * replace (case when ingest_pos % 9 = 0 then ep + 76 else ep end as ep, case when ingest_pos % 9 = 0 then '未知' else story_stage end as story_stage) from sel), tb as (select *, {_INDEX} as st, count(*) over (partition by series_id, mol_type) as nn from ta),
 tc as (select *, coalesce(list_position(flow, st), 0) as fp from tb), td as (select *, row_number() over (partition by series_id, mol_type order by case when nn < 3 then taken end, case when fp = 0 then 1 else 0 end, case when fp > 0 then fp else st end,
   case when st = 1 and fp > 0 then ep end, case when st = 1 and fp > 0 then time_s end, case when st <> 1 or fp = 0 then -hook_value end, taken) as a from tc),
 te as (select *, max(case when st = flow[-1] and a > nn - greatest(1, nn // 5) then 1 end) over w as held, max(case when st = flow[-1] and a <= nn - nn // 5 then a end) over w as mover from td window w as (partition by series_id, mol_type)),
 tf as (select *, case when nn >= 5 and held is null and mover is not null then (case when a = mover then nn when a > mover then a - 1 else a end) else a end as b2 from te),
 tg as (select *, first_value(case when ep = 1 and time_s < 60 and nn >= 3 then b2 end) over (partition by series_id, mol_type order by case when ep = 1 and time_s < 60 and nn >= 3 then 0 else 1 end, time_s, b2) as opener from tf),
 th as (select *, row_number() over (partition by series_id, mol_type order by case when b2 = opener then 0 else b2 end) as place from tg)"""


def ordered(spark, sf_dir):
    late = F.col("ingest_pos") % 9 == 0
    s = selected(kept_ranking(spark, sf_dir)).withColumns({"ep": F.when(late, F.col("ep") + 76).otherwise(F.col("ep")), "story_stage": F.when(late, "未知").otherwise(F.col("story_stage"))})
    return K.in_story_order(s.withColumn("st", S.stage_index()), ["series_id", "mol_type"], "st", "taken")


@query(f"with recursive {_ORDERED} select series_id, mol_type, ingest_pos, cast(st as int) as st, cast(place as int) as place from th")
def full_story_order(spark, sf_dir):
    """Stages in the template's flow, its last stage in the last fifth, the earliest opening first."""
    return ordered(spark, sf_dir).select("series_id", "mol_type", "ingest_pos", "st", "place")


_CUTS = f"""{_ORDERED}, ua as (select *, mol_type || '_' || lpad(cast(place as varchar), 2, '0') || '_EP' || lpad(cast(ep as varchar), 2, '0') as cut_id, round(greatest(0.0, time_s - pre_roll), 1) as start_s, round(case when mol_type = 'quote_rhythm' then least(3.0, least(dur_hi, greatest(dur_lo, suggested_duration))) else least(dur_hi, greatest(dur_lo, suggested_duration)) end, 1) as dur_s from th),
 ub as (select series_id, mol_type, list(struct_pack(d := dur_s, hi := dur_hi) order by place) as ds, sum(dur_s) as total, min(target_dur)::double as target from ua group by all),
 uc as (select series_id, mol_type, list_reduce(list_concat([struct_pack(need := case when total < target * 0.8 then target * 0.9 - total else 0.0 end, out := []::double[])], list_transform(ds, lambda x: struct_pack(need := x.hi, out := [x.d]))),
   lambda acc, x: struct_pack(need := acc.need - (case when acc.need > 0 and x.need * 1.5 > x.out[1] then least(x.need * 1.5 - x.out[1], acc.need / len(ds) * 2) else 0.0 end), out := list_append(acc.out, round(x.out[1] + (case when acc.need > 0 and x.need * 1.5 > x.out[1] then least(x.need * 1.5 - x.out[1], acc.need / len(ds) * 2) else 0.0 end), 1)))).out as durs from ub),
 ud as (select ua.*, durs[place] as cut_s from ua join uc using (series_id, mol_type)),
 ue as (select *, round(coalesce(sum(greatest(0.0, cut_s - 0.3)) over (partition by series_id, mol_type order by place rows between unbounded preceding and 1 preceding), 0.0), 3) as offset_s from ud)"""


def cuts(spark, sf_dir):
    """Cut specifications in story order: where a clip begins by its role's pre-roll, its length within the template's, stretched where all are too short, its offset under 0.3 s transitions."""
    dur = F.least("dur_hi", F.greatest("dur_lo", F.col("suggested_duration")))
    dur = F.round(F.when(F.col("mol_type") == "quote_rhythm", F.least(F.lit(3.0), dur)).otherwise(dur), 1)
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    c = ordered(spark, sf_dir).withColumns({"cut_id": F.concat("mol_type", F.lit("_"), two("place"), F.lit("_EP"), two("ep")), "start_s": F.round(F.greatest(F.lit(0.0), F.col("time_s") - F.col("pre_roll")), 1), "dur_s": dur})
    c = W.stretched(c.drop("beats"), ["series_id", "mol_type"], "place", "dur_s", "dur_hi", "target_dur").withColumnRenamed("stretched_s", "cut_s")
    c = W.running(c, ["series_id", "mol_type"], ["place"], F.greatest(F.lit(0.0), F.col("cut_s") - 0.3), "offset_s")
    return c.withColumn("offset_s", F.round("offset_s", 3))


@query(f"with recursive {_CUTS} select series_id, mol_type, cut_id, start_s, dur_s, cut_s, offset_s from ue")
def role_cuts(spark, sf_dir):
    return cuts(spark, sf_dir).select("series_id", "mol_type", "cut_id", "start_s", "dur_s", "cut_s", "offset_s")


_ASKED = "(30 + (cast(substr(series_id, 2) as int) * 37) % 150)"
_RATIO = f"({_ASKED} / target_dur::double)"
_FACTOR = f"(case when k in ('hook', 'inciting') then 1.0 + (1.0 - ratio) * 0.3 when k in ('climax', 'transition') then 1.0 + (ratio - 1.0) * 0.3 else 1.0 end)"


@query(f"""with {_M}, s as (select distinct 'S' || cast(floor(user_id / 15) as bigint) as series_id from events), a as (select *, {_ASKED} as asked, {_RATIO} as ratio from s cross join m),
 b as (select *, round_even(greatest(1.5, dur_lo * sqrt(ratio)), 1) as lo, round_even(least(12.0, dur_hi * sqrt(ratio)), 1) as hi, greatest(4, round_even(min_clips * ratio, 0))::int as mn from a),
 c as (select *, greatest(mn + 2, round_even(max_clips * ratio, 0))::int as mx from b), d as (select series_id, mol_type, unnest(map_keys(beats)) as k, unnest(map_values(beats)) as v, ratio from c),
 e as (select series_id, mol_type, k, case when ratio = 1 then v else round_even(greatest(0.05, least(0.7, v * {_FACTOR})), 2) end as v, ratio from d), f as (select series_id, mol_type, k, case when ratio = 1 then v else round_even(round_even(v * 100, 0) / sum(round_even(v * 100, 0)::bigint) over (partition by series_id, mol_type), 2) end as v from e)
 select c.series_id, c.mol_type, asked as target_dur, case when ratio = 1 then dur_lo when lo >= hi then hi - 1.0 else lo end as dur_lo, case when ratio = 1 then dur_hi else hi end as dur_hi, case when ratio = 1 then min_clips else mn end as min_clips,
 case when ratio = 1 then max_clips else mx end as max_clips, f.k as beat, round(f.v, 2) as share from c join f using (series_id, mol_type)""")
def scaled_templates(spark, sf_dir):
    """Templates for the length that each series asks for, one row a beat."""
    s = A.clips(spark, sf_dir).select("series_id").distinct().withColumn("asked", 30 + (F.substring("series_id", 2, 20).cast("int") * 37) % 150)
    t = S.scaled(s.crossJoin(F.broadcast(dims.molecules(spark))), "asked")
    return t.select("series_id", "mol_type", "target_dur", "dur_lo", "dur_hi", "min_clips", "max_clips", F.explode("beats").alias("beat", "share")).withColumn("share", F.round("share", 2))
