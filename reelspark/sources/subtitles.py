"""Subtitle cues, a block at a time: files are split at blank lines, so no file is held whole.

spark.read.option("lineSep", "\\n\\n").text(...) gives the blocks. Blocks without an arrow or text (header, notes) give no cue;
times have an optional hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def seconds(stamp: Column) -> Column:
    """'01:02:03.5' or '02:03.5' in seconds; null where it is no time."""
    part = F.reverse(F.split(F.trim(stamp), ":"))
    at = lambda k: R.number(F.get(part, F.lit(k)), "double")
    return at(0) + 60 * at(1) + 3600 * F.when(F.size(part) > 2, at(2)).otherwise(0.0)


def cues(blocks: DataFrame, value: str = "value") -> DataFrame:
    """start_s, end_s, text, chars and duration_s of each cue beside the other columns."""
    rows = F.transform(F.split(value, "\n"), lambda r: F.trim(r))
    arrow = F.array_position(F.transform(rows, lambda r: F.contains(r, F.lit("-->"))), True)
    times = F.split(F.get(rows, F.col("__arrow") - 1), " --> ")
    text = F.array_join(F.filter(F.slice(rows, F.col("__arrow") + 1, F.size(rows)), lambda r: r != ""), " ")
    out = blocks.withColumn("__arrow", arrow.cast("int")).where("__arrow > 0").withColumns({"start_s": F.round(seconds(F.get(times, F.lit(0))), 3), "end_s": F.round(seconds(F.get(times, F.lit(1))), 3), "text": text})
    out = out.where("text <> '' and start_s is not null and end_s is not null")
    return out.withColumns({"chars": F.length("text"), "duration_s": F.round(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")), 3)}).drop(value, "__arrow")


def stamp(at: Column) -> Column:
    """Seconds as HH:MM:SS.mmm."""
    ms = F.floor(at * 1000 + 0.5).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def block(start: Column, end: Column, text: Column) -> Column:
    """One cue as a block; blank lines in the text, which would end it, are left out."""
    return F.concat(stamp(start), F.lit(" --> "), stamp(end), F.lit("\n"), F.regexp_replace(text, r"\n\s*\n", "\n"))
