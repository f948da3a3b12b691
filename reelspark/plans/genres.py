"""Registered queries of genre detection, weighted passes, classic ranking, protagonists and episode splitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enrichment as E
from ..functions import rules as R
from ..functions import words as H
from ..operators import ranks as K
from ..operators import windows as W
from ..sources import adapters as A
from . import dims
from .catalogue import _any, query

# What tells a genre: strong, weak and opposing terms; bonus of scenes; weights of a clip's score.
GENRES = {
    "horror": (
        ["恐怖", "诡异", "阴森", "毛骨悚然", "渗人", "吓人", "瘆人", "阴灵", "纸人", "香火", "尸", "棺", "下葬", "回魂", "祭坛"],
        ["惊恐", "葬礼", "暗影", "黑", "鬼", "灵", "魂", "咒", "夜葬"], ["甜", "爱", "吻", "搞笑", "欢"],
        {"恐怖": 2.5, "诡异": 2.0, "葬礼": 1.8, "下葬": 2.0, "祭坛": 1.8, "对峙": 1.2, "独白": 1.0, "特写": 0.8}, (5.0, 2.5, 2.0, 1.5, 1.0, 0.3),
    ),
    "action_historical": (
        ["打斗", "战斗", "激烈交锋", "牢中", "囚室", "狱", "剑", "刀", "兵", "战", "刺", "权", "谋", "廷", "帝", "王", "将", "军", "气势逼人", "迅猛", "字幕"],
        ["对峙", "杀", "血", "死", "怒", "吼", "攻", "红", "衣", "逼人"], ["恐怖", "诡异", "甜", "搞笑"],
        {"战斗": 2.5, "打斗": 2.3, "对峙": 1.5, "特写": 1.2, "群像": 1.3, "独白": 1.2, "空镜": 0.6}, (3.5, 2.0, 2.5, 1.5, 1.5, 0.3),
    ),
    "romance": (
        ["吻", "拥抱", "依偎", "牵手", "甜", "甜蜜", "宠", "婚", "约", "爱意", "温柔对视", "谈恋爱", "心动"],
        ["笑", "暖", "花", "泪", "心", "靠近", "对视", "情侣"], ["打斗", "战斗", "恐怖", "诡异", "杀", "死", "血", "棺"],
        {"特写": 2.0, "对视": 2.5, "独白": 1.5, "对话": 1.3, "日常": 1.0, "空镜": 0.8, "群像": 0.6}, (3.0, 1.5, 3.5, 2.0, 2.5, 0.3),
    ),
    "comedy": (
        ["搞笑", "喜剧", "滑稽", "夸张表情", "鬼脸", "逗", "闹剧", "耍宝", "囧", "尬", "出糗", "整蛊"],
        ["笑", "乐", "欢", "趣", "逗", "闹"], ["恐怖", "诡异", "阴森", "杀", "死", "血"],
        {"特写": 1.8, "对话": 1.5, "日常": 1.2, "群像": 1.3, "空镜": 0.4, "对峙": 0.8}, (2.5, 1.0, 3.5, 1.5, 2.0, 0.3),
    ),
    "mystery": (
        ["悬疑", "谜", "线索", "查", "追踪", "秘密", "真相", "案", "证据", "审问", "探", "窥", "偷", "暗查"],
        ["隐", "藏", "问", "疑", "奇怪", "不对劲"], ["搞笑", "甜", "宠", "吻"],
        {"对峙": 2.0, "特写": 1.5, "独白": 1.8, "对话": 1.3, "日常": 0.8, "空镜": 1.0}, (3.0, 1.8, 3.0, 2.0, 1.5, 0.3),
    ),
}
COMPONENTS = ["emotion", "scene_rare", "dialogue", "content", "faces", "desc_len"]
UNIFIED = (3.5, 1.8, 2.5, 1.5, 1.5, 0.3)
# Rarity of scenes; directions of a genre, best first, and of an unknown one; its edit style: music, transition, pacing, least and most seconds.
RARITY = {
    "战斗": 2.0, "打斗": 2.0, "搏斗": 2.0, "下葬": 1.8, "入棺": 1.8, "活埋": 2.0, "祭坛": 1.7, "祭祀": 1.7, "作法": 1.8, "对峙": 1.2, "冲突": 1.3, "独白": 1.5, "特写": 1.3, "惊恐": 1.4,
    "夜葬": 1.6, "抬棺": 1.5, "诡异": 1.2, "恐怖": 1.2, "葬礼": 1.1, "仪式": 1.3, "空镜": 0.8, "日常": 0.5, "对话": 1.0, "群像": 1.1, "凝视": 1.2,
}
DIRECTIONS = {
    "horror": ["first_person", "promo", "highlight_mix", "emotion_focus"],
    "action_historical": ["promo", "highlight_mix", "third_person", "role_cut"],
    "romance": ["emotion_focus", "first_person", "role_cut", "promo"],
    "comedy": ["highlight_mix", "third_person", "episode_split", "role_cut"],
    "mystery": ["first_person", "third_person", "promo", "commentary"],
    "revenge": ["highlight_mix", "first_person", "promo", "role_cut"],
    "family": ["third_person", "emotion_focus", "episode_split", "commentary"],
    "urban": ["highlight_mix", "promo", "role_cut", "first_person"],
}
ANY_DIRECTION = ["promo", "third_person", "highlight_mix"]
STYLES = {
    "horror": ("dark_ambient", "hard_cut", "fast_then_slow", 3, 8),
    "action_historical": ("epic_orchestral", "hard_cut", "fast_throughout", 2, 5),
    "romance": ("sweet_piano", "soft_crossfade", "slow_build", 5, 10),
    "comedy": ("upbeat_funny", "hard_cut", "fast_punchy", 2, 4),
    "mystery": ("tense_mystery", "slow_fade", "steady_build", 4, 8),
    "revenge": ("tense_revenge", "hard_cut", "fast_aggressive", 2, 4),
    "family": ("emotional_family", "soft_crossfade", "slow_dramatic", 5, 10),
    "urban": ("epic_urban", "hard_cut", "fast_momentum", 2, 5),
}
# Descriptions of shots that bore; words of suspense; scenes that split episodes; what is no name before a verb of speech.
BORING = ["走路", "行走", "步行", "散步", "踱步", "吃饭", "用餐", "喝水", "喝茶", "发呆", "愣神", "出神", "呆滞看", "空镜", "远景空", "无人", "无人物", "睡觉", "躺", "休息", "收拾", "整理", "打扫"]
SUSPENSE = ["到底", "究竟", "没想到", "原来", "竟然", "居然", "怎么可能", "为什么", "是谁", "什么", "真相", "秘密"]
SPLITTERS = ["对峙", "冲突", "战斗", "惊恐", "诡异"]
NO_NAMES = ["老人", "男子", "女子", "有人", "谁", "什么", "怎么", "你", "我", "他", "她", "它", "你们", "我们", "他们", "这", "那", "哪", "啥", "咋", "这样", "那样"]
TIERS = ("strong", "weak", "against")


def scene_types():
    return F.array_distinct(F.filter(F.array("event", "event_subtype", "mood", "shot"), lambda x: ~x.isin("", "无")))


def clips(spark, sf_dir, users=15):
    c = A.rich(spark, sf_dir, users)
    said = F.concat_ws(" ", "event", "event_subtype", "shot", "desc_clean")
    return c.withColumns({"types": scene_types(), "said": said})


def lexicon(spark) -> DataFrame:
    """genre, tier, k (its place) and term: a fixed few hundred rows at most."""
    return spark.createDataFrame([(g, t, k, w) for g, v in GENRES.items() for t, ws in zip(TIERS, v[:3], strict=True) for k, w in enumerate(ws)], "genre string, tier string, k int, term string")


def genre_scores(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per key and genre: lines, lines with a strong, weak and opposing term, and score: three times the first share, the second, less twice the third; never under 0."""
    lists = [ws for v in GENRES.values() for ws in v[:3]]
    hit = lambda k: F.count_if(F.col("__held").bitwiseAND(F.lit(1 << k)) != 0)
    rows = texts.select(key, H.held(F.col(text), lists).alias("__held")).groupBy(key).agg(F.count("*").alias("lines"), *(hit(3 * i + k).alias(f"{g}_{t}") for i, g in enumerate(GENRES) for k, t in enumerate(TIERS)))
    one = F.array(*(F.struct(F.lit(g).alias("genre"), *(F.col(f"{g}_{t}").alias(t) for t in TIERS)) for g in GENRES))
    score = F.greatest(F.lit(0.0), (F.col("strong") * 3 + F.col("weak") - F.col("against") * 2) / F.greatest(F.lit(1), F.col("lines")))
    return rows.select(key, "lines", F.inline(one)).withColumn("score", score)


_LINES = f"""c as (select *, concat_ws(' ', event, event_subtype, shot, desc_clean) as said from ({A.RICH.format(events='events')}))"""
_SCORES = f"{_LINES}, gs as (" + " union all ".join(f"select series_id, '{g}' as genre, count(*) as lines, " + ", ".join(f"count(*) filter (where {_any('said', ws)}) as {t}" for t, ws in zip(TIERS, v[:3], strict=True)) + " from c group by series_id" for g, v in GENRES.items()) + "), gt as (select *, greatest(0.0, (strong * 3 + weak - against * 2) / greatest(1, lines)::double) as score from gs)"
_LEXICON = "lex(genre, tier, k, term) as (values " + ", ".join(f"('{g}', '{t}', {k}, '{w}')" for g, v in GENRES.items() for t, ws in zip(TIERS, v[:3], strict=True) for k, w in enumerate(ws)) + ")"


@query(f"""with {_SCORES}, {_LEXICON}, tc as (select series_id, genre, tier, k, term, count(*) as n from c join lex on contains(said, term) group by all), tr as (select *, row_number() over (partition by series_id, genre, tier order by n desc, k) as r from tc)
 select gt.series_id, gt.genre, lines, strong, weak, against, round(score, 3) as score, coalesce((select string_agg(term || ':' || n, ',' order by r) from tr where tr.series_id = gt.series_id and tr.genre = gt.genre and tier = 'strong' and r <= 5), '') as top_strong,
 coalesce((select string_agg(term || ':' || n, ',' order by r) from tr where tr.series_id = gt.series_id and tr.genre = gt.genre and tier = 'against' and r <= 3), '') as top_against from gt""")
def genre_fingerprints(spark, sf_dir):
    """Coverage and score of each genre in each series, with the terms that occur most."""
    c = clips(spark, sf_dir)
    terms = F.array(*(F.struct(F.lit(g).alias("genre"), F.lit(t).alias("tier"), F.lit(k).alias("k"), F.lit(w).alias("term")) for g, v in GENRES.items() for t, ws in zip(TIERS, v[:3], strict=True) for k, w in enumerate(ws) if t != "weak"))
    found = c.select("series_id", F.inline(F.filter(terms, lambda x: F.contains(F.col("said"), x["term"])))).groupBy("series_id", "genre", "tier", "k", "term").agg(F.count("*").alias("n"))
    top = W.top(found, ["series_id", "genre", "tier"], [F.desc("n"), "k"], 5, "r")
    text = lambda tier, n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("tier") == tier) & (F.col("r") <= n), F.struct("r", F.concat_ws(":", "term", F.col("n").cast("string")).alias("x"))))), lambda s: s["x"]), ",")
    best = top.groupBy("series_id", "genre").agg(text("strong", 5).alias("top_strong"), text("against", 3).alias("top_against"))
    g = genre_scores(c, "series_id", "said").join(best, ["series_id", "genre"], "left")
    return g.select("series_id", "genre", "lines", *TIERS, F.round("score", 3).alias("score"), *(F.coalesce(x, F.lit("")).alias(x) for x in ("top_strong", "top_against")))


_VERDICT = f"{_SCORES}, gr as (select *, row_number() over (partition by series_id order by score desc, case genre {' '.join(f'''when '{g}' then {k}''' for k, g in enumerate(GENRES))} end) as r from gt), gv as (select series_id, max(case when r = 1 then genre end) as genre, max(case when r = 1 then score end) as s1, max(case when r = 2 then genre end) as second, max(case when r = 2 then score end) as s2 from gr group by series_id)"


def verdict(spark, sf_dir, users=15):
    """Each series' genre, the runner-up and how sure that is."""
    order = F.create_map(*(F.lit(x) for k, g in enumerate(GENRES) for x in (g, k)))
    g = W.top(genre_scores(clips(spark, sf_dir, users), "series_id", "said"), ["series_id"], [F.desc("score"), order[F.col("genre")]], 2, "r")
    at = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    return g.groupBy("series_id").agg(at(1, "genre").alias("genre"), at(1, "score").alias("s1"), at(2, "genre").alias("second"), at(2, "score").alias("s2"))


_STYLE = lambda k: "case genre " + " ".join(f"when '{g}' then {repr(v[k])}" for g, v in STYLES.items()) + f" else {STYLES['action_historical'][k]!r} end"
_WEIGHT = lambda k: "case genre " + " ".join(f"when '{g}' then {v[4][k]}" for g, v in GENRES.items()) + f" else {UNIFIED[k]} end"


@query(f"""with {_VERDICT} select series_id, genre, second, round(s1, 3) as score, round(case when s2 > 0 then least(5.0, s1 / greatest(0.01, s2)) else 3.0 end, 2) as confidence, {', '.join(f'({_WEIGHT(k)})::double as w_{c}' for k, c in enumerate(COMPONENTS))},
 {_STYLE(0)} as bgm_style, {_STYLE(1)} as transition, {_STYLE(2)} as pacing, {_STYLE(3)} as dur_lo, {_STYLE(4)} as dur_hi from gv""")
def genre_verdict(spark, sf_dir):
    """The detected genre with its weights and its edit style; styles of unknown genres are those of action."""
    v = verdict(spark, sf_dir)
    kinds = dict(zip(("bgm_style", "transition", "pacing", "dur_lo", "dur_hi"), range(5), strict=True))
    style = lambda k: E.lookup("genre", {g: s[k] for g, s in STYLES.items()}, STYLES["action_historical"][k])
    weight = lambda k: E.lookup("genre", {g: x[4][k] for g, x in GENRES.items()}, UNIFIED[k])
    sure = F.when(F.col("s2") > 0, F.least(F.lit(5.0), F.col("s1") / F.greatest(F.lit(0.01), F.col("s2")))).otherwise(3.0)
    return v.select("series_id", "genre", "second", F.round("s1", 3).alias("score"), F.round(sure, 2).alias("confidence"), *(weight(k).alias(f"w_{c}") for k, c in enumerate(COMPONENTS)), *(style(k).alias(n) for n, k in kinds.items()))


@query(f"with {_VERDICT}, d(genre, ds) as (values {', '.join(f'''('{g}', {v})''' for g, v in DIRECTIONS.items())}) select series_id, genre, unnest(coalesce(ds, {ANY_DIRECTION})[1:3]) as direction, unnest([1, 2, 3]) as pos from (select series_id, case when substr(series_id, 2) = '0' then 'unknown' else genre end as genre from gv) left join d using (genre)")
def genre_directions(spark, sf_dir):
    """The three editing directions that suit a series' genre; the first series' genre counts as unknown."""
    v = verdict(spark, sf_dir).withColumn("genre", F.when(F.col("series_id") == "S0", "unknown").otherwise(F.col("genre")))
    table = F.create_map(*(x for g, ds in DIRECTIONS.items() for x in (F.lit(g), F.array(*map(F.lit, ds)))))
    ds = F.slice(F.coalesce(table[F.col("genre")], F.array(*map(F.lit, ANY_DIRECTION))), 1, 3)
    return v.select("series_id", "genre", F.posexplode(ds).alias("pos", "direction")).withColumn("pos", F.col("pos") + 1)


_SPREAD = "(('0x' || substr(md5(series_id || '|' || p || '|' || comp), 1, 8))::bigint / 4294967295.0)"
_CONFIGS = f"""{_VERDICT}, pa as (select series_id, genre, unnest(range(1, 6)) as p from gv), pb as (select series_id, genre, p, unnest({COMPONENTS}) as comp, unnest([{', '.join(_WEIGHT(k) for k in range(6))}]::double[]) as own, unnest({list(UNIFIED)}::double[]) as flat from pa),
 pc as (select series_id, genre, p, comp, round(case when p = 1 then own when p = 2 then flat else own * (1 + 0.15 * (2 * {_SPREAD} - 1)) end, 2) as w from pb)"""


def weight_configs(spark, sf_dir, users=15):
    """Five weightings a series: its genre's, the unified one and three that differ from the first by up to 15 % (by a hash, so that runs agree)."""
    own = F.array(*(E.lookup("genre", {g: x[4][k] for g, x in GENRES.items()}, UNIFIED[k]) for k in range(6)))
    one = F.arrays_zip(F.array(*map(F.lit, COMPONENTS)).alias("comp"), own.alias("own"), F.array(*map(F.lit, UNIFIED)).alias("flat"))
    c = verdict(spark, sf_dir, users).select("series_id", "genre", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p"), one.alias("x")).select("series_id", "genre", "p", F.inline("x"))
    spread = F.conv(F.substring(F.md5(F.concat_ws("|", "series_id", F.col("p").cast("string"), "comp")), 1, 8), 16, 10).cast("double") / 4294967295.0
    w = F.when(F.col("p") == 1, F.col("own")).when(F.col("p") == 2, F.col("flat")).otherwise(F.col("own") * (1 + 0.15 * (2 * spread - 1)))
    return c.select("series_id", "genre", "p", "comp", F.round(w, 2).alias("w"))


@query(f"with {_CONFIGS} select series_id, genre, cast(p as int) as p, comp, w from pc")
def genre_weights(spark, sf_dir):
    return weight_configs(spark, sf_dir)


_D = "decimal(12,2)"
_TYPES = "list_filter([event, event_subtype, mood, shot], lambda x: x not in ('', '无'))"
_RARE_OF = "case x " + " ".join(f"when '{k}' then {v}" for k, v in RARITY.items()) + " else 1.0 end"
_BONUS = "case genre " + " ".join(f"when '{g}' then case x " + " ".join(f"when '{k}' then {b}" for k, b in v[3].items()) + f" else {_RARE_OF} end" for g, v in GENRES.items()) + f" else {_RARE_OF} end"
_PASSES = f"""{_CONFIGS}, pw as (select series_id, genre, p, {', '.join(f"max(case when comp = '{c}' then w end)::{_D} as w_{c}" for c in COMPONENTS)} from pc group by series_id, genre, p),
 px as (select c.series_id, c.ingest_pos, c.ep, p, round((case emotion when 1 then 0 when 2 then 5 when 3 then 15 when 4 then 40 when 5 then 70 else 15 end)::{_D} * w_emotion
   + least(30, 5 * list_sum(list_transform(list_transform(list_distinct({_TYPES}), lambda x: case when p = 2 then {_RARE_OF} else {_BONUS} end), lambda y: y::{_D})))::{_D} * w_scene_rare + least(40, dialogue_lines * 8)::{_D} * w_dialogue + (case when has_content then 12 else 0 end)::{_D} * w_content + least(16, faces * 4)::{_D} * w_faces
   + least(5.0, ln(greatest(1, length(desc_clean))) * 1.5)::{_D} * w_desc_len, 1) as score from c join pw using (series_id)),
 py as (select *, row_number() over (partition by series_id, p, ep order by score desc, ingest_pos) as k from px), pz as (select *, row_number() over (partition by series_id, p order by score desc, ingest_pos) as rank from py where k <= 2),
 pq as (select series_id, ingest_pos, count(*) as appearances, avg(rank) as mean_rank, coalesce(stddev_samp(rank), 0) as sd, max(rank) as worst from pz where rank <= 30 group by series_id, ingest_pos)"""


def with_parts(c: DataFrame, genre: DataFrame) -> tuple[DataFrame, dict]:
    """Clips with the rarity of their scene types, by their series' genre (__own) and plain (__plain), and the six parts of a score, as they don't depend on weights."""
    plain = F.create_map(*(F.lit(x) for kv in RARITY.items() for x in kv))
    bonus = F.create_map(*(x for g, v in GENRES.items() for x in (F.lit(g), F.create_map(*(F.lit(y) for kv in v[3].items() for y in kv)))))
    rare = lambda genre: F.aggregate(F.transform("types", lambda x: F.coalesce(*([genre[x]] if genre is not None else []), plain[x], F.lit(1.0)).cast(_D)), F.lit(0).cast("decimal(14,2)"), lambda a, x: (a + x).cast("decimal(14,2)"))
    c = c.repartition("series_id").join(genre, "series_id").withColumn("__bonus", bonus[F.col("genre")])
    c = c.withColumns({"__own": rare(F.col("__bonus")), "__plain": rare(None)}).drop("__bonus")
    rarity = lambda total: F.least(F.lit(30).cast("decimal(14,2)"), (total * 5).cast("decimal(14,2)"))
    return c, {
        "emotion": F.coalesce(F.get(F.array(*map(F.lit, (0, 5, 15, 40, 70))), F.col("emotion") - 1), F.lit(15)), "scene_rare": rarity,
        "dialogue": F.least(F.lit(40), F.col("dialogue_lines") * 8), "content": F.when(F.col("has_content"), 12).otherwise(0), "faces": F.least(F.lit(16), F.col("faces") * 4), "desc_len": F.least(F.lit(5.0), F.ln(F.greatest(F.lit(1), F.length("desc_clean"))) * 1.5),
    }


def weighted(parts: dict, total: Column) -> Column:
    """The sum of the parts, each times its weight w_..., to one decimal; total: the rarity that counts."""
    return F.round(sum(((v(total) if c == "scene_rare" else v).cast(_D) * F.col(f"w_{c}") for c, v in parts.items()), F.lit(0).cast(_D)), 1)


def passes(spark, sf_dir, users=15):
    """Ranks of each series' clips under its five weightings (at most two clips an episode, thirty in all), summed up a clip."""
    w = weight_configs(spark, sf_dir, users).groupBy("series_id", "genre", "p").agg(*(F.max(F.when(F.col("comp") == c, F.col("w"))).cast(_D).alias(f"w_{c}") for c in COMPONENTS))
    c, parts = with_parts(clips(spark, sf_dir, users), w.groupBy("series_id").agg(F.first("genre").alias("genre")))
    score = weighted(parts, F.when(F.col("p") != 2, F.col("__own")).otherwise(F.col("__plain")))
    r = W.capped_rank(c.join(w.drop("genre"), "series_id").withColumn("score", score), ["series_id", "p"], "ep", [F.desc("score"), "ingest_pos"], 2, 30)
    return r.groupBy("series_id", "ingest_pos").agg(F.count("*").alias("appearances"), F.avg("rank").alias("mean_rank"), F.coalesce(W.deviation("rank"), F.lit(0.0)).alias("sd"), F.max("rank").alias("worst"))


@query(f"with {_PASSES} select series_id, ingest_pos, round(mean_rank, 1) as mean_rank, round(sd, 1) as sd, case when round(sd, 1) < 3 then 'high' else 'medium' end as stability from pq where appearances >= 5 and worst <= 40")
def genre_consensus(spark, sf_dir):
    """Clips that all five weightings rank, and how stable their rank is."""
    sd = F.round("sd", 1)
    return passes(spark, sf_dir).where("appearances >= 5 and worst <= 40").select("series_id", "ingest_pos", F.round("mean_rank", 1).alias("mean_rank"), sd.alias("sd"), F.when(sd < 3, "high").otherwise("medium").alias("stability"))


@query(f"with {_PASSES}, dv as (select *, row_number() over (partition by series_id order by sd desc, ingest_pos) as k from pq where round(sd, 1) > 5 and appearances >= 3) select series_id, ingest_pos, round(sd, 1) as sd, appearances from dv where k <= 10")
def genre_divergence(spark, sf_dir):
    """The ten clips of a series on which the weightings differ most."""
    d = passes(spark, sf_dir).where((F.round("sd", 1) > 5) & (F.col("appearances") >= 3))
    return W.top(d, ["series_id"], [F.desc("sd"), "ingest_pos"], 10).select("series_id", "ingest_pos", F.round("sd", 1).alias("sd"), "appearances")


_CLASSIC = f"""{_LINES}, ka as (select *, list_distinct({_TYPES}) as types, round((case emotion when 1 then 0 when 2 then 5 when 3 then 15 when 4 then 40 when 5 then 70 else 15 end)::{_D} * 4.0::{_D} + least(30, 5 * list_sum(list_transform(list_transform(list_distinct({_TYPES}), lambda x: {_RARE_OF}), lambda y: y::{_D})))::{_D} * 2.0::{_D}
 + least(40, dialogue_lines * 8)::{_D} * 2.0::{_D} + (case when has_content then 12 else 0 end)::{_D} * 1.5::{_D} + least(16, faces * 4)::{_D} * 1.0::{_D} + least(5.0, ln(greatest(1, length(desc_clean))) * 1.5)::{_D} * 0.3::{_D}, 1)::double as score from c)"""


def scored(spark, sf_dir):
    """Clips with the classic score."""
    plain = F.create_map(*(F.lit(x) for kv in RARITY.items() for x in kv))
    total = F.aggregate(F.transform("types", lambda x: F.coalesce(plain[x], F.lit(1.0)).cast(_D)), F.lit(0).cast("decimal(14,2)"), lambda a, x: (a + x).cast("decimal(14,2)"))
    parts = [
        (F.coalesce(F.get(F.array(*map(F.lit, (0, 5, 15, 40, 70))), F.col("emotion") - 1), F.lit(15)), 4.0), (F.least(F.lit(30).cast("decimal(14,2)"), (total * 5).cast("decimal(14,2)")), 2.0),
        (F.least(F.lit(40), F.col("dialogue_lines") * 8), 2.0), (F.when(F.col("has_content"), 12).otherwise(0), 1.5), (F.least(F.lit(16), F.col("faces") * 4), 1.0), (F.least(F.lit(5.0), F.ln(F.greatest(F.lit(1), F.length("desc_clean"))) * 1.5), 0.3),
    ]
    score = sum((v.cast(_D) * F.lit(w).cast(_D) for v, w in parts), F.lit(0).cast(_D))
    return clips(spark, sf_dir).withColumn("score", F.round(score, 1).cast("double"))


def best_of(clips: DataFrame, key: str, n: int = 20, per_ep: int = 2) -> DataFrame:
    """Per key the n best by score: at most per_ep an episode, and from the sixth on only clips with a scene type that none before had. Adds pos.

    Rows stream by in order of key and score; a task holds what it has chosen of one key.
    """
    names = [key, "score", "ingest_pos", "ep", "types"]

    def pick(frames):
        now, chosen, eps, used = None, 0, {}, set()
        for f in frames:
            out = []
            for k, score, i, ep, types in f[names].itertuples(index=False):
                if k != now:
                    now, chosen, eps, used = k, 0, {}, set()
                if chosen >= n or eps.get(ep, 0) >= per_ep or (len(types) and chosen >= 5 and used.issuperset(types)):
                    continue
                chosen += 1
                eps[ep] = eps.get(ep, 0) + 1
                used.update(types)
                out.append((k, i, ep, score, chosen))
            yield pd.DataFrame(out, columns=[key, "ingest_pos", "ep", "score", "pos"])

    rows = clips.select(*names).repartition(key).sortWithinPartitions(key, F.desc("score"), "ingest_pos")
    return rows.mapInPandas(pick, f"{key} string, ingest_pos long, ep int, score double, pos int")


@query(f"""with recursive {_CLASSIC}, kb as (select *, row_number() over (partition by series_id order by score desc, ingest_pos) as k from ka),
 kr(series_id, k, kept, eps, used, hit) as (select distinct series_id, 0::bigint, 0, []::int[], []::varchar[], null::bigint from kb union all
  select r.series_id, r.k + 1, case when ok then r.kept + 1 else r.kept end, case when ok then list_append(r.eps, r.ep) else r.eps end, case when ok then list_distinct(list_concat(r.used, r.types)) else r.used end, case when ok then r.ingest_pos end
  from (select kr.*, b.ep, b.types, b.ingest_pos, kr.kept < 20 and len(list_filter(kr.eps, lambda e: e = b.ep)) < 2 and not (len(b.types) > 0 and kr.kept >= 5 and list_has_all(kr.used, b.types)) as ok from kr join kb b on b.series_id = kr.series_id and b.k = kr.k + 1 where kr.kept < 20) r)
 select kr.series_id, hit as ingest_pos, kb.ep, kb.score, kept as pos from kr join kb on kb.series_id = kr.series_id and kb.ingest_pos = hit where hit is not null""")
def classic_ranking(spark, sf_dir):
    return best_of(scored(spark, sf_dir), "series_id")


_DULL = f"((not has_content and dialogue_lines = 0) or {_any('desc_clean', BORING)})"


@query(f"with {_LINES} select series_id, count(*) filter (where desc_clean <> '' and {_DULL}) as boring, count(*) filter (where not (desc_clean <> '' and {_DULL})) as kept from c group by series_id")
def boring_shots(spark, sf_dir):
    """Shots that show nothing: by their description, or labels without content or speech."""
    return clips(spark, sf_dir).groupBy("series_id").agg(F.count_if(boring()).alias("boring"), F.count_if(~boring()).alias("kept"))


def boring():
    return (E.text("desc_clean") != "") & ((~F.col("has_content") & (F.col("dialogue_lines") == 0)) | R.any_word(E.text("desc_clean"), BORING))


_PEOPLE = f"""{_LINES}, ha as (select series_id, ep, emotion, {_TYPES} as types, unnest(string_split(chars_text, ';')) as person from c), hb as (select series_id, substr(trim(person), 1, 30) as person, ep, emotion, types from ha where trim(person) <> ''),
 hc as (select series_id, person, count(distinct ep) as eps, avg(emotion) as emo from hb group by all), hd as (select series_id, person, count(distinct t) as kinds from (select series_id, person, unnest(types) as t from hb) group by all),
 he as (select *, max(eps) over (partition by series_id) as most from hc join hd using (series_id, person)), hf as (select *, round(30.0 * eps / greatest(1, most) + least(30.0, (emo - 2) * 10) + least(20, 4 * kinds), 1) as score from he), hg as (select *, row_number() over (partition by series_id order by score desc, person) as r from hf)"""


def people(spark, sf_dir):
    """The five characters of a series that most speaks for, by episodes, emotion and scene types."""
    one = F.explode(F.filter(F.transform(F.split("chars_text", ";"), lambda x: F.substring(F.trim(x), 1, 30)), lambda x: x != "")).alias("person")
    p = clips(spark, sf_dir).select("series_id", "ep", "emotion", "types", one)
    a = p.groupBy("series_id", "person").agg(F.count_distinct("ep").alias("eps"), F.avg("emotion").alias("emo"), F.size(F.array_distinct(F.flatten(F.collect_set("types")))).alias("kinds"))
    a = a.withColumn("most", F.max("eps").over(Window.partitionBy("series_id")))
    score = F.lit(30.0) * F.col("eps") / F.greatest(F.lit(1), F.col("most")) + F.least(F.lit(30.0), (F.col("emo") - 2) * 10) + F.least(F.lit(20), F.col("kinds") * 4)
    return W.top(a.withColumn("score", F.round(score, 1)), ["series_id"], [F.desc("score"), "person"], 5)


@query(f"with {_PEOPLE} select series_id, person, eps, round(emo, 1) as emotion, score, cast(r as int) as rank from hg where r <= 5")
def leading_characters(spark, sf_dir):
    return people(spark, sf_dir).select("series_id", "person", "eps", F.round("emo", 1).alias("emotion"), "score", "rank")


def spoken_names(lines: DataFrame, key: str, text: str) -> DataFrame:
    """Per key the name that most often stands before a verb of speech (name, n); general words are no names."""
    found = lines.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"([\w一-鿿]{1,3})(?:说|问|喊|道|叫|曰)"), F.lit(1))).alias("name"))
    n = found.where((F.length("name") >= 2) & ~F.col("name").isin(*NO_NAMES)).groupBy(key, "name").agg(F.count("*").alias("n"))
    return W.top(n, [key], [F.desc("n"), "name"], 1).drop("rank")


@query(f"""with {_PEOPLE}, hh as (select c.*, contains(chars_text, substr(person, 1, 15)) as lead_ from c join hg on hg.series_id = c.series_id and r = 1), hi as (select *, row_number() over (partition by series_id, lead_ order by md5('keep|' || ingest_pos), ingest_pos) as k, count(*) over (partition by series_id, lead_) as n from hh)
 select series_id, ingest_pos, lead_ as protagonist from hi where lead_ or k <= floor(n * 0.7)""")
def protagonist_cut(spark, sf_dir):
    """The leading character's clips and seven tenths of the others, these chosen by a hash."""
    lead = people(spark, sf_dir).where("rank = 1").select("series_id", F.substring("person", 1, 15).alias("__p"))
    c = clips(spark, sf_dir).join(lead, "series_id").withColumn("protagonist", F.contains("chars_text", "__p"))
    w = Window.partitionBy("series_id", "protagonist")
    c = c.withColumns({"__k": F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("keep|"), F.col("ingest_pos").cast("string"))), "ingest_pos")), "__n": F.count("*").over(w)})
    return c.where(F.col("protagonist") | (F.col("__k") <= W.part_of(F.col("__n"), 0.7))).select("series_id", "ingest_pos", "protagonist")


@query(f"""with {_CLASSIC}, la as (select *, (row_number() over (partition by series_id order by ep, time_s, ingest_pos) - 1)::double as i, count(*) over (partition by series_id) as n from ka), lb as (select *, i / greatest(1, n - 1) * (n * 7) as est, n * 7 as total from la),
 lc as (select *, case when est < 3 then 3.0 when est < 10 then 2.0 when est > total * 0.8 then 1.5 else 1.0 end as boost from lb) select series_id, ingest_pos, round(score::decimal(12,1) * boost::decimal(3,1), 1)::double as score, boost::double as boost from lc""")
def golden_weights(spark, sf_dir):
    """The classic score, tripled in the first three seconds, doubled in the first ten, raised by half in the last fifth."""
    c = K.numbered(scored(spark, sf_dir).select("series_id", "ingest_pos", "ep", "time_s", "score"), ["series_id"], ["ep", "time_s", "ingest_pos"], "__i", "__n").withColumn("__at", F.col("__i") / F.greatest(F.lit(1), F.col("__n") - 1) * (F.col("__n") * 7))
    boost = F.when(F.col("__at") < 3, 3.0).when(F.col("__at") < 10, 2.0).when(F.col("__at") > F.col("__n") * 7 * 0.8, 1.5).otherwise(1.0)
    return c.withColumn("boost", boost).select("series_id", "ingest_pos", F.round(F.col("score").cast("decimal(12,1)") * F.col("boost").cast("decimal(3,1)"), 1).cast("double").alias("score"), "boost")


_SPLIT = f"""{_LINES}, na as (select *, {_TYPES} as types, row_number() over w - 1 as i, count(*) over (partition by series_id) as n, abs(emotion - lag(emotion) over w) as jump from c window w as (partition by series_id order by ep, time_s, ingest_pos)),
 nb as (select *, (case when jump >= 2 then 30 else 0 end) + (case when {_any('desc_clean', SUSPENSE)} then 25 else 0 end) + (case when len(list_filter(types, lambda x: x in ({', '.join(repr(s) for s in SPLITTERS)}))) > 0 then 20 else 0 end) + (case when emotion >= 4 and len(types) >= 1 then 15 else 0 end) as score from na),
 nc as (select series_id, i, n, score, row_number() over (partition by series_id order by score desc, i) as k from nb where score >= 30)"""


def split_candidates(spark, sf_dir):
    """Clips at which an episode may break: series_id, score, i (its place), n (of so many), lo and hi of the stretch around it."""
    w = Window.partitionBy("series_id")
    o = w.orderBy("ep", "time_s", "ingest_pos")
    c = clips(spark, sf_dir).withColumns({"i": F.row_number().over(o) - 1, "n": F.count("*").over(w), "jump": F.abs(F.col("emotion") - F.lag("emotion").over(o))})
    set_ = F.exists("types", lambda x: x.isin("scene_change", *SPLITTERS))
    score = R.flag(F.coalesce(F.col("jump") >= 2, F.lit(False)), 30) + R.flag(R.any_word(E.text("desc_clean"), SUSPENSE), 25) + R.flag(set_, 20) + R.flag((F.col("emotion") >= 4) & (F.size("types") >= 1), 15)
    return c.withColumn("score", score).where("score >= 30").select("series_id", "score", "i", "n", F.greatest(F.lit(0), F.col("i") - 4).alias("lo"), F.least(F.col("n"), F.col("i") + 4).cast("int").alias("hi"))


def split_points(spark, sf_dir):
    """The stretches of clips that a greedy choice of the best breaks makes: series_id, first, last, hook, score."""
    best = split_candidates(spark, sf_dir)

    def choose(frames):
        now, taken = None, set()
        for f in frames:
            out = []
            for s, score, i, lo, hi in f[["series_id", "score", "i", "lo", "hi"]].itertuples(index=False):
                if s != now:
                    now, taken = s, set()
                if i in taken or hi - lo < 5 or any(x in taken for x in range(lo, hi)):
                    continue
                taken.update(range(lo, hi))
                out.append((s, lo, hi - 1, i, score))
            yield pd.DataFrame(out, columns=["series_id", "first", "last", "hook", "score"])

    rows = best.repartition("series_id").sortWithinPartitions("series_id", F.desc("score"), "i")
    return rows.mapInPandas(choose, "series_id string, first int, last int, hook int, score int")


@query(f"""with recursive {_SPLIT}, nr(series_id, k, taken, lo, hi, hook, score) as (select distinct series_id, 0::bigint, []::bigint[], null::bigint, null::bigint, null::bigint, null::int from nc union all
 select x.series_id, x.k + 1, case when ok then list_concat(x.taken, range(x.nlo, x.nhi)) else x.taken end, case when ok then x.nlo end, case when ok then x.nhi - 1 end, case when ok then x.ni end, case when ok then x.nscore end
 from (select nr.*, greatest(0, nc.i - 4) as nlo, least(nc.n, nc.i + 4) as nhi, nc.i as ni, nc.score as nscore, not list_has_any(nr.taken, range(greatest(0, nc.i - 4), least(nc.n, nc.i + 4))) and least(nc.n, nc.i + 4) - greatest(0, nc.i - 4) >= 5 as ok from nr join nc on nc.series_id = nr.series_id and nc.k = nr.k + 1) x)
 select series_id, lo::int as first, hi::int as last, hook::int as hook, score from nr where hook is not null""")
def episode_split(spark, sf_dir):
    return split_points(spark, sf_dir)
