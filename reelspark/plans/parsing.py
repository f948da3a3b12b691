"""Registered queries of replies and legacy sentences read in full, facts without a source, names from speech, and what episode splitting leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources import adapters as A
from ..sources import annotations as N
from ..sources import legacy as L
from . import genres
from .catalogue import _any, _CLIPS, query
from .genres import _LINES, _PEOPLE, _SPLIT
from .series import _NUMBER, _SAID, series_cues

_FIELDS = ["shot", "event", "emo", "action_level", "event_subtype"]
_REPLY = "case ingest_pos % 4 when 0 then '先看 {\"note\": \"无\"} 再看 ' when 1 then '无结构 { 未闭合 \" ' when 2 then '```json {\"draft\": {\"shot\": null}} ``` 更正：' else '{\"a\": {\"b\": \"}{\"}} ' end"


@query(f"with {_CLIPS} select ingest_pos, ep, 'v2' as format, emotion, action_level, event || (case event_subtype when '无' then '' else '/' || event_subtype end) || '/' || shot as scene_types from c")
def mixed_replies(spark, sf_dir):
    """Labels behind other objects, unclosed braces and quotes of a reply, written as text and read back."""
    at = A.new_folder(spark, "replies")
    c = A.clips(spark, sf_dir).withColumn("emo", F.col("emotion"))
    line = N.as_lines(c.withColumn("before", F.expr(_REPLY)), ["before", *_FIELDS])
    head, body = F.substring_index("value", " ", 2), F.regexp_extract("value", r"\{.*\}", 0)
    label = F.to_json(F.from_json(body, "shot string, event string, emo int, action_level int, event_subtype string"))
    line.select(F.concat(head, F.lit(" "), F.get_json_object(body, "$.before"), label, F.lit(" 完 {}")).alias("value")).write.text(at)
    t = N.typed(N.lines(spark.read.text(at)))
    return t.select(F.regexp_extract("frame_id", r"_f(\d+)$", 1).cast("long").alias("ingest_pos"), "ep", "format", "emotion", "action_level", F.array_join("scene_types", "/").alias("scene_types"))


_TOLD = """case ingest_pos % 7 when 0 then desc_clean || '情绪：' || emotion || '。类型：' || event || '/' || shot || '。' when 1 then '夜里抬棺下葬，众人惊恐 情绪评分: ' || emotion || ' （诡异/对峙）(葬礼/诡异)'
 when 2 then '你到底是谁？情绪：' || emotion when 3 then '老人说他不知道，少年喊叫 情绪' || emotion || ' 类型:恐怖/对峙，(战斗)' when 4 then '群像凝视，一名男子回头' when 5 then '他走了' else '画面里没有我，情绪：' || emotion || '(日常)' end"""


def _kept(text: str, words: list[str]) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + f"], lambda w: contains({text}, w))"


_LEGACY = f"""{_LINES}, la as (select ingest_pos, {_TOLD} as told from c), lb as (select *, regexp_matches(told, '{L.SCORE}') as scored from la),
 lc as (select *, case when scored then regexp_extract(told, '^(.*?){L.SCORE}', 1) else told end as before from lb), ld as (select *, trim(before) as d, case when scored then substr(told, length(before) + 1) else '' end as s from lc),
 le as (select *, list_concat(string_split(regexp_extract(s, '类型[：:]\\s*([^\\s。，]+)', 1), '/'), flatten(list_transform(regexp_extract_all(s, '[（(]([^）)]+)[）)]', 1), lambda x: string_split(x, '/'))), {_kept('d', L.SCENES)}) as t, len({_kept('d', L.SPEECH)}) as said from ld),
 lf as (select *, list_filter(t, lambda x: x <> '') as u from le)"""


@query(f"""with {_LEGACY} select ingest_pos, case when scored then regexp_extract(told, '{L.SCORE}', 1)::int else 3 end as emotion, length(d) > 3 as has_content, d as desc_clean, length(d)::int as desc_length,
 array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), '/') as scene_types,
 (case when said > 0 then said when length(d) >= 3 and not {_any('d', L.DESCRIBING)} and (regexp_matches(d, '[{L.DIALOGUE_MARKS}]') or regexp_matches(d, '[{L.PRONOUNS}]') and length(d) <= 30) then 1 else 0 end)::int as dialogue_lines,
 least(5, len({_kept('d', L.PEOPLE)}))::int as faces from lf""")
def legacy_sentences(spark, sf_dir):
    """Legacy sentences of all forms, written as lines and read back with types, dialogue and faces."""
    at = A.new_folder(spark, "legacy")
    told = A.rich(spark, sf_dir).withColumn("told", F.expr(_TOLD))
    told.select(F.concat(F.lit("ep"), F.col("ep").cast("string"), F.lit("_f"), F.col("ingest_pos").cast("string"), F.lit(" 1s "), F.col("told")).alias("value")).write.text(at)
    t = N.lines(spark.read.text(at)).select(F.regexp_extract("frame_id", r"_f(\d+)$", 1).cast("long").alias("ingest_pos"), L.fields(F.col("body")).alias("x")).select("ingest_pos", "x.*")
    return t.withColumn("scene_types", F.array_join("scene_types", "/"))


# What descriptions tend to make up.
RISKS = ["亲子鉴定", "DNA", "遗嘱", "股权转让", "破产", "癌症", "绝症", "失忆", "车祸", "坠楼", "扇巴掌", "耳光", "下跪", "磕头"]


def risk_bits(*texts: Column) -> Column:
    """The risk terms in the texts as bits of a number, found in one pass over each text."""
    number = F.create_map(*(F.lit(x) for k, w in enumerate(RISKS) for x in (w, 1 << k)))
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("(" + "|".join(RISKS) + ")"), F.lit(1)) for t in texts)))
    return F.aggregate(F.array_distinct(found), F.lit(0), lambda bits, w: bits.bitwiseOR(number[w]))


def unsupported(clips: DataFrame, sources: DataFrame, key: str, texts: list[str], source: str) -> DataFrame:
    """Rows of clips with term, one for each risk term of their texts that no source text of their key has. Keys without a source pass.

    A clip and a source are a number of 14 bits each; a key's sources are OR-ed before anything is joined.
    """
    known = sources.groupBy(key).agg(F.bit_or(risk_bits(F.col(source))).alias("__known"))
    c = clips.withColumn("__bits", risk_bits(*(F.col(t) for t in texts))).where("__bits <> 0").join(known, key)
    left = F.col("__bits").bitwiseAND(F.bitwise_not("__known"))
    terms = F.filter(F.array(*(F.when(left.bitwiseAND(F.lit(1 << k)) != 0, F.lit(w)) for k, w in enumerate(RISKS))), lambda t: t.isNotNull())
    return c.withColumn("term", F.explode(terms)).drop("__bits", "__known")


_RISK_LIST = "[" + ", ".join(f"'{w}'" for w in RISKS) + "]"
_MADE = f"""f as (select series_id, ingest_pos, ep, time_s, desc_clean || coalesce({_RISK_LIST}[1 + ingest_pos % 41], '') as desc_, coalesce({_RISK_LIST}[1 + ingest_pos % 23], '') || subtitle_text as more from c),
 src as (select series_id, desc_clean || case when (ingest_pos % 211 + {_NUMBER}) % 3 = 0 then coalesce({_RISK_LIST}[1 + ingest_pos % 211], '') else '' end as text_ from c where {_NUMBER} % 4 <> 3)"""


@query(f"""with {_LINES}, {_MADE} select series_id, ingest_pos, ep, time_s, term from (select *, unnest({_RISK_LIST}) as term from f) x where (contains(desc_, term) or contains(more, term))
 and exists (select 1 from src where src.series_id = x.series_id) and not exists (select 1 from src where src.series_id = x.series_id and contains(text_, term))""")
def unsupported_facts(spark, sf_dir):
    """Risk terms of a clip's descriptions that its own series' annotations don't have."""
    term = lambda m: F.coalesce(F.get(F.array(*map(F.lit, RISKS)), (F.col("ingest_pos") % m).cast("int")), F.lit(""))
    r = A.rich(spark, sf_dir)
    clips = r.select("series_id", "ingest_pos", "ep", "time_s", F.concat("desc_clean", term(41)).alias("desc"), F.concat(term(23), "subtitle_text").alias("more"))
    number = F.substring("series_id", 2, 12).cast("long")
    told = F.when((F.col("ingest_pos") % 211 + number) % 3 == 0, term(211)).otherwise("")
    sources = r.where(number % 4 != 3).select("series_id", F.concat("desc_clean", told).alias("source"))
    return unsupported(clips, sources, "series_id", ["desc", "more"], "source").select("series_id", "ingest_pos", "ep", "time_s", "term")


_SAYS = "case cue_pos % 5 when 0 then '阿青说不许走' when 1 then '，沈默问是谁' when 2 then ' 阿青喊道快跑' when 3 then '他们说老人叫' else '' end"
_VERBS = "([\\w一-鿿]{1,3})(?:说|问|喊|道|叫|曰)"


def named_by_speech(lines: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """key, name, n: the name of two or three letters that most often stands before a verb of speech, of equals the one first heard; general words are no names.

    Names are counted where their lines are before they meet, so a frequent one is a row a task.
    """
    found = lines.select(key, F.struct(*order).alias("__line"), F.posexplode(F.regexp_extract_all(text, F.lit(_VERBS), F.lit(1))).alias("__at", "name"))
    some = found.where((F.length("name") >= 2) & ~F.col("name").isin(*genres.NO_NAMES))
    n = some.groupBy(key, "name").agg(F.count("*").alias("n"), F.min(F.struct("__line", "__at")).alias("first"))
    return W.top(n, [key], [F.desc("n"), "first"], 1).select(key, "name", "n")


@query(f"""with {_PEOPLE}, {_SAID}, sa as (select series_id, ep, cue_pos, unnest(regexp_extract_all(text || {_SAYS}, '{_VERBS}', 1)) as name, generate_subscripts(regexp_extract_all(text || {_SAYS}, '{_VERBS}', 1), 1) as at_ from u where text is not null),
 sb as (select series_id, name, count(*) as n, min(struct_pack(a := ep, b := cue_pos, c := at_)) as first_ from sa where length(name) >= 2 and name not in ({', '.join(repr(x) for x in genres.NO_NAMES)}) group by 1, 2), sc as (select *, row_number() over (partition by series_id order by n desc, first_) as k from sb)
 select hg.series_id, person, coalesce(name, person) as name, coalesce(n, 0) as heard, score from hg left join sc on sc.series_id = hg.series_id and sc.k = 1 where r = 1""")
def named_leads(spark, sf_dir):
    """The leading character of each series, by the name that its dialogue gives most, else as seen."""
    lines = series_cues(spark, sf_dir).where("text is not null").withColumn("text", F.concat("text", F.expr(_SAYS)))
    heard = named_by_speech(lines, "series_id", ["ep", "cue_pos"], "text")
    lead = genres.people(spark, sf_dir).where("rank = 1").select("series_id", "person", "score")
    return lead.join(heard, "series_id", "left").select("series_id", "person", F.coalesce("name", "person").alias("name"), F.coalesce("n", F.lit(0)).alias("heard"), "score")


def remainder(chosen: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """The runs of places that chosen stretches (first, last, disjoint) leave of each key's n places: key, first, last, total (of the key's runs).

    A key's stretches and its end are events in order; each leaves the run since the one before. Keys without a stretch leave all.
    """
    ends = sizes.select(key, F.col("n").alias("first"), F.col("n").alias("last"))
    w = Window.partitionBy(key)
    before = F.coalesce(F.lag("last").over(w.orderBy("first")) + 1, F.lit(0))
    runs = chosen.select(key, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).unionByName(ends).withColumn("__from", before).where(F.col("first") > F.col("__from"))
    runs = runs.select(key, F.col("__from").alias("first"), (F.col("first") - 1).alias("last"))
    return runs.withColumn("total", F.sum(F.col("last") - F.col("first") + 1).over(w))


_KIND = "case when score >= 60 then '情绪反转+悬念' when score >= 45 then '悬念节点' else '场景突变' end"


@query(f"""with recursive {_SPLIT}, nr(series_id, k, taken, lo, hi, hook, score) as (select distinct series_id, 0::bigint, []::bigint[], null::bigint, null::bigint, null::bigint, null::int from nc union all
 select x.series_id, x.k + 1, case when ok then list_concat(x.taken, range(x.nlo, x.nhi)) else x.taken end, case when ok then x.nlo end, case when ok then x.nhi - 1 end, case when ok then x.ni end, case when ok then x.nscore end
 from (select nr.*, greatest(0, nc.i - 4) as nlo, least(nc.n, nc.i + 4) as nhi, nc.i as ni, nc.score as nscore, not list_has_any(nr.taken, range(greatest(0, nc.i - 4), least(nc.n, nc.i + 4))) and least(nc.n, nc.i + 4) - greatest(0, nc.i - 4) >= 5 as ok from nr join nc on nc.series_id = nr.series_id and nc.k = nr.k + 1) x),
 ch as (select series_id, lo, hi, hook, score, row_number() over (partition by series_id order by score desc, hook) as episode from nr where hook is not null), nt as (select distinct series_id, n from na),
 lv as (select series_id, i, i - row_number() over (partition by series_id order by i) as island from na where not exists (select 1 from ch where ch.series_id = na.series_id and i between lo and hi)),
 lw as (select series_id, min(i) as first, max(i) as last, sum(count(*)) over (partition by series_id) as total from lv group by series_id, island)
 select series_id, episode, first, last, kind from (
  select series_id, episode, lo as first, hi as last, {_KIND} as kind from ch union all
  select series_id, 1 + coalesce((select max(episode) from ch where ch.series_id = lw.series_id), 0), first, last, case when exists (select 1 from nc where nc.series_id = lw.series_id) then '后续剧情' else '全剧精华' end from lw
  where total >= 3 or not exists (select 1 from nc where nc.series_id = lw.series_id))""")
def episode_parts(spark, sf_dir):
    """All episodes of a series: the stretches around its turning points, then one of what they leave if that is three clips or more; a series without a turning point is one episode."""
    chosen = genres.split_points(spark, sf_dir).withColumn("episode", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("score"), "hook")))
    c = genres.clips(spark, sf_dir)
    sizes = c.groupBy("series_id").agg(F.count("*").alias("n"))
    points = genres.split_candidates(spark, sf_dir).select("series_id").distinct().withColumn("pointed", F.lit(True))
    kind = F.when(F.col("score") >= 60, "情绪反转+悬念").when(F.col("score") >= 45, "悬念节点").otherwise("场景突变")
    picked = chosen.select("series_id", F.col("episode").cast("long").alias("episode"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), kind.alias("kind"))
    episodes = chosen.groupBy("series_id").agg(F.max("episode").alias("episodes"))
    rest = remainder(chosen, sizes, "series_id").join(points, "series_id", "left").join(episodes, "series_id", "left").where((F.col("total") >= 3) | F.col("pointed").isNull())
    rest = rest.select("series_id", (1 + F.coalesce("episodes", F.lit(0))).cast("long").alias("episode"), "first", "last", F.when(F.col("pointed").isNull(), "全剧精华").otherwise("后续剧情").alias("kind"))
    return picked.unionByName(rest)
