"""Clip and cue tables derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLIPS = """select concat('S', cast(cast(floor(user_id / 15) as bigint) as varchar(12))) as series_id, event_id as ingest_pos,
 cast(1 + event_id % 76 as int) as ep, cast((event_id * 37) % 180 as double) as time_s,
 cast(least(5, 1 + floor(value / 60)) as int) as emotion, cast(1 + k % 5 as int) as action_level,
 cast(1 + (k + user_id) % 5 as int) as visual_quality, cast(1 + (k + event_id) % 5 as int) as audio_energy,
 cast(1 + (k * 3 + event_id) % 5 as int) as speech_density,
 case event_type when 'error' then '冲突' when 'purchase' then '威胁' when 'signup' then '对峙' when 'view' then '悲伤' else '日常' end as event,
 case k % 6 when 0 then '持械' when 1 then '怒吼' when 2 then '哭泣' when 3 then '倒地' else '无' end as event_subtype,
 case (k + event_id) % 4 when 0 then '特写' when 1 then '近景' when 2 then '中景' else '全景' end as shot,
 case k % 4 when 0 then '增强' when 1 then '持续' when 2 then '静止' else '减弱' end as action_direction,
 case event_id % 4 when 0 then '爆发' when 1 then '上升' when 2 then '稳定' else '下降' end as emotion_trend,
 case (k + user_id) % 5 when 0 then '模糊' when 1 then '无人' when 2 then '侧脸' else '正脸' end as face_quality,
 case when k % 17 = 0 then '片头' when k % 19 = 0 then '黑屏' else '无' end as reject_reason
from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}) e"""

#: Clips with the fields that full labels have besides: descriptions, people, light, sound, subtitles.
RICH = f"""select c.*, concat('series', cast(ingest_pos % 23 as varchar(4))) as scene, case ingest_pos % 3 when 0 then '紧张' when 1 then '平静' else '悲伤' end as mood,
 case ingest_pos % 5 when 0 then '长剑' when 1 then '灯笼' else '' end as props,
 concat(case ingest_pos % 8 when 0 then '两名男子在院中对峙，怒目而视，谁也不肯先退半步' when 1 then '一群人围住马车，阿青按住刀柄，随时准备动手' when 2 then '女子眼含泪光，似乎在回忆多年以前的往事'
  when 3 then '沈默扶着同伴的肩膀，血从伤口慢慢流下' when 4 then '空荡的街道上灯笼高挂，远处传来脚步声' when 5 then '老人独自在桌前发呆，桌上放着一封信' when 6 then '少年与师父并肩站在山顶，阿青望向远方' else case when ingest_pos % 5 = 0 then '字幕缓缓滚动，全剧终' else '殿前烛火通明，沈默低声说出真相' end end,
  case when ingest_pos % 7 = 0 then '' else '，镜头缓缓推近，人物神情凝重，背景中烛火摇曳不定' end) as desc_clean,
 case ingest_pos % 4 when 0 then '' when 1 then '你敢' when 2 then '你怎么会在这里' else '今日之事我一定会讨个说法给你看' end as subtitle_text,
 case ingest_pos % 4 when 0 then '阿青(男,正脸,说话,怒)' when 1 then '沈默(男,侧脸,站立,冷); 阿青(男,正脸,说话,怒)' when 2 then '' else '老人(男,背影,坐,平静)' end as chars_text,
 ingest_pos % 3 = 0 as dialogue_visible, cast(ingest_pos % 4 as int) as faces, cast(ingest_pos % 6 as int) as dialogue_lines, ingest_pos % 10 <> 0 as has_content,
 case ingest_pos % 5 when 0 then '对称' when 1 then '引导线' when 2 then '三分法' when 3 then '中心对称' else '无' end as composition_type,
 case ingest_pos % 4 when 0 then '电影级' when 1 then '良好' when 2 then '普通' else '差' end as light_beauty,
 case ingest_pos % 6 when 0 then '暖' when 1 then '冷' when 2 then '高饱和' when 3 then '低饱和' else '自然' end as color_palette,
 ingest_pos % 7 = 0 as has_speech_peak, ingest_pos % 5 = 0 as beat_nearby, case when ingest_pos % 4 = 2 then '你怎么会在这里' else '' end as transcript_excerpt,
 case ingest_pos % 3 when 0 then 'none' when 1 then 'boundary' else 'dense_speech' end as dialogue_anchor,
 case when ingest_pos % 11 = 0 then '模糊' when ingest_pos % 2 = 0 then '可见' else '推测' end as event_conf
from ({CLIPS}) c"""

CUES = """select conv_id as ep, cast(turn as int) as cue_pos, role as speaker, text, cast(length(text) as int) as chars,
 cast(turn * 6.0 as double) as start_s, cast(turn * 6.0 + least(5.9, 0.5 + length(text) / 40.0) as double) as end_s
from {conversations}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLIPS, events=table(spark, sf_dir, "events"))


def rich(spark: SparkSession, sf_dir: str, users: int = 15) -> DataFrame:
    """Full clips; users: how many users' events make one series."""
    return spark.sql(RICH.replace("user_id / 15", f"user_id / {users}"), events=table(spark, sf_dir, "events"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CUES, conversations=table(spark, sf_dir, "conversations"))


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path where driver and executors both see it: under spark.checkpoint.dir; on one machine its own folder will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file:" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
