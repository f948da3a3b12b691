"""Registered queries over tables that grow: bands that follow arriving clips, labels answered from a cache, first arrivals of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks as K
from ..sources import adapters as A
from ..sources import label_cache as C
from ..streaming import ingest as I
from ..streaming import rebanding as B
from .catalogue import _BANDED, _CLIPS, query, scored

_NAMES = ["series_id", "ingest_pos", "hook_value", "promo_value"]


def rebanded(df):
    """Hook and promo bands of whole series."""
    n = K.largest(df, ["series_id"])
    hook = K.banded(df, "hook_value", ["series_id"], ["ingest_pos"], "hook_band", largest_key=n)
    return K.banded(hook, "promo_value", ["series_id"], ["ingest_pos"], "promo_band", largest_key=n).select(*_NAMES, "hook_band", "promo_band")


@query(f"with {_BANDED} select series_id, ingest_pos, hook_band, promo_band from b")
def growing_bands(spark, sf_dir):
    """Bands after three batches of arriving clips and a repeated one: as if all had come at once."""
    came, to, state = (A.new_folder(spark, n) for n in ("arriving", "bands", "bands-state"))
    rows = scored(spark, sf_dir).select(*_NAMES)
    store = B.BandStore(spark, to, ["series_id"], ["ingest_pos"], rebanded)
    for k in range(3):  # what has come since the last run is one batch, in however many files, so there are as many batches at any size
        rows.where(F.pmod(F.xxhash64("ingest_pos"), F.lit(3)) == k).write.parquet(f"{came}/part={k}")
        store.follow(spark.readStream.schema(rows.schema).parquet(f"{came}/part=*"), state).awaitTermination()
    last = max(store._manifest().values(), default=0)
    store.apply(spark.read.parquet(f"{came}/part=2"), last + 1)  # rows that are there already
    return store.read(rebanded(rows.limit(0)).schema).select("series_id", "ingest_pos", "hook_band", "promo_band")


_CONTENT = ["event", "event_subtype", "shot", "face_quality", "emotion"]
_LABEL = "event || '/' || shot || '/' || emotion"


@query(f"""with {_CLIPS}, k as (select *, event || '|' || event_subtype || '|' || shot || '|' || face_quality || '|' || emotion as content from c),
 a as (select *, ep <= 38 as first_ from k), f as (select distinct content from a where first_)
 select ingest_pos, 1 as run, false as hit, {_LABEL} as label from a where first_ union all
 select ingest_pos, 2, exists (select 1 from f where f.content = a.content), {_LABEL} from a union all
 select ingest_pos, 3, true, {_LABEL} from a""")
def cached_labels(spark, sf_dir):
    """Three runs over a persisted cache: half of the episodes, all of them, and all again, this time with hits only."""
    cache = C.LabelCache(spark, A.new_folder(spark, "labels"))
    frames = A.clips(spark, sf_dir).select("ingest_pos", "ep", *_CONTENT).withColumn("content_key", C.content_key(_CONTENT, "v1"))
    call = lambda missed: missed.withColumn("label", F.concat_ws("/", "event", "shot", F.col("emotion").cast("string")))
    out = None
    for run, some in ((1, frames.where("ep <= 38")), (2, frames), (3, frames)):
        at = A.new_folder(spark, "labelled")
        cache.label(some, call, run).select("ingest_pos", F.lit(run).alias("run"), "hit", "label").write.parquet(at)
        got = spark.read.parquet(at)
        out = got if out is None else out.unionByName(got)
    return out


@query("select distinct event_type, props, user_id, cast(1 as bigint) as n from events")
def first_arrivals(spark, sf_dir):
    """Of a stream of events, one row of each content, remembered by the stream's state while the watermark holds; a second run adds nothing."""
    schema, to, state = A.table(spark, sf_dir, "events").schema, A.new_folder(spark, "first"), A.new_folder(spark, "first-state")
    for _ in range(2):
        arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_type", "props", "user_id", "ts")
        first = I.first_arrivals(arriving, ["event_type", "props", "user_id"], "ts", "3650 days")
        first.writeStream.format("parquet").option("path", to).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(to).groupBy("event_type", "props", "user_id").agg(F.count("*").alias("n"))
