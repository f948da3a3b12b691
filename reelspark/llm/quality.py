"""Quality rules whose cutoffs are chosen with a guarantee: few good documents are rejected, in every stratum.

For each stratum (a language), sets of cutoffs, at most one a rule, are tried against labelled good documents of that
stratum. A set is admitted only if the exact (Clopper-Pearson) upper bound on the rate at which it falsely rejects stays
under ALPHA. DELTA is split evenly over the strata with good labels. Half of a stratum's share goes to nested sets, from the
laxest to the strictest, tested in this fixed sequence up to the first that fails; half to all sets of CUTS, equally
(Bonferroni). So every admitted set holds at once, and the one that rejects most labelled bad documents is used (then the one
that rejects fewest good ones, then the strictest). With four strata and no rejection, 99 good labels admit the sequence and
267 any set; a stratum in which none is admitted has no cutoffs, which is logged.

Null and empty texts have no words (base_failed holds). Strata without labels use base rules alone (as do those with too few, above); null strata are one
stratum; labels with null quality or doc_id are ignored, as are labels without a document; repeated labels count once,
and documents labelled both good and bad count as bad; extra columns, whatever their names, are kept by `kept_documents`
and ignored by `judge`; an empty table gives no rows; texts are read whole. The bound is on the good documents that pass
the base rules: what those reject was never the method's to keep. There may be any number of strata: their counts meet on
Spark, one group a stratum, and their cutoffs are a table, joined by stratum.
"""

from __future__ import annotations

import bisect
import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, saved, written

ALPHA, DELTA = 0.05, 0.05
#: Candidate cutoffs of each rule, strictest first; rejected is what exceeds (or, for least, falls under) the cutoff.
CUTS = {
    "symbol_share": [0.02, 0.05, 0.1, 0.2, 0.3],
    "dup_line_share": [0.1, 0.2, 0.3, 0.5],
    "repeat_share": [0.1, 0.2, 0.3, 0.4],
    "long_words": [9.0, 10.0, 11.0, 12.0, 14.0],
    "short_words": [-5.0, -4.5, -4.0, -3.5, -3.0],
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def measures(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The counts of _COUNTS in a UTF-8 text."""
    t = text or b""
    words = t.split()
    n = len(words)
    chars = sum(map(len, words)) if t.isascii() else len(b"".join(words).decode())
    symbols = len(t) - len(t.translate(None, b"#*$%&|<>"))
    seen, dup, lines = set(), 0, 0
    for line in t.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, n)
        k = len(number)
        pair = w[:-1] * k + w[1:]
        if k**3 >= 1 << 62:  # numbers of pairs, not of words, where three words don't fit into 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, where, count = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[where] > 1)
        hit = np.zeros(n, bool)
        for d in range(3):
            hit[twice + d] = True
        repeat = int(hit.sum())
    return n, chars, symbols, dup, lines, repeat


def measured(docs: DataFrame, keep: list[str], stratum: str = "lang") -> DataFrame:
    """doc (the columns to keep), doc_id, stratum and the counts of each row."""
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), "doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), *([] if "text" in keep else [F.col("text").alias("text")]))
    names = ["doc", "doc_id", "stratum"]

    def rows(batches):
        for b in batches:
            texts = b["doc"].field(keep.index("text")) if "text" in keep else b["text"]  # once, whichever it is
            got = [measures(t) for k in range(0, len(texts), 512) for t in texts.slice(k, 512).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *(pa.array(c, pa.int64()) for c in zip(*got, strict=True))], [*names, *_COUNTS])

    schema = given.select(*names, *(F.lit(0).cast("long").alias(c) for c in _COUNTS)).schema
    return given.mapInArrow(rows, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "long_words": mean,
        "short_words": -mean,
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k >= n:
        return 1.0
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def admitted(rejected: int, n: int, alpha: float, level: float) -> bool:
    """The exact upper bound at this level is at most alpha: so few rejections would be too unlikely at a rate of alpha."""
    return n > 0 and rejected < n * alpha and binomial_cdf(rejected, n, alpha) <= level


def most_rejected(n: int, alpha: float, level: float) -> int:
    """The largest admitted number of rejections among n; -1 if even none is not admitted."""
    return bisect.bisect_left(range(n), True, key=lambda k: not admitted(k, n, alpha, level)) - 1


def nested() -> list[tuple[int, ...]]:
    """The fixed sequence: places in CUTS (its length: the rule is off), rule after rule one step stricter, in turns."""
    at, out = [len(c) for c in CUTS.values()], []
    for _ in range(max(at)):
        for r in range(len(at)):
            if at[r]:
                at[r] -= 1
                out.append(tuple(at))
    return out


def chosen(passing: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> tuple[int, ...] | None:
    """Places in CUTS of the set that one stratum uses. passing: a row for each kind of document, the strictest places that it passes; good, bad: how many."""
    shape = [len(c) + 1 for c in CUTS.values()]
    left = np.zeros((2, *shape), np.int64)  # documents of either label that a set keeps
    for k, n in enumerate((good, bad)):
        np.add.at(left[k], tuple(passing.T), n)
    for axis in range(1, left.ndim):
        np.cumsum(left, axis=axis, out=left)
    n = int(good.sum())
    rejected = n - left[0]
    fine = rejected <= most_rejected(n, alpha, delta / 2 / (rejected.size - 1))
    limit = most_rejected(n, alpha, delta / 2)
    for at in nested():
        if rejected[at] > limit:
            break
        fine[at] = True
    fine[(-1,) * len(shape)] = False  # no rule at all
    sets = np.argwhere(fine)
    if not len(sets):
        return None
    at = tuple(sets.T)
    return tuple(sets[np.lexsort((sets.sum(axis=1), rejected[at], left[1][at]))[0]].tolist())


_CUT = [f"cut_{r}" for r in CUTS]


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, good (labels) and a cutoff a rule (null: the rule is off). labelled: counts with quality; only those that pass the base rules count.

    A stratum's group has at most one row for each combination of places in CUTS.
    """
    places = [sum((v > c).cast("int") for c in CUTS[r]).alias(r) for r, v in rule_values().items()]
    kinds = labelled.where(F.col("quality").isin(0, 1) & ~base_failed()).select("stratum", "quality", *places).groupBy("stratum", *CUTS)
    marks = [F.sum((F.col("quality") == q).cast("long")).alias(name) for q, name in ((1, "good"), (0, "bad"))]
    kinds = saved(kinds.agg(*marks))
    strata = kinds.where("good > 0").agg(F.count_distinct("stratum")).first()[0]

    def choose(t: pa.Table) -> pa.Table:
        v = np.column_stack([t[c].to_numpy() for c in [*CUTS, "good", "bad"]])
        good = int(v[:, -2].sum())
        at = chosen(v[:, :-2], v[:, -2], v[:, -1], alpha, delta / strata) if good else None
        cuts = [None] * len(CUTS) if at is None else [c[k] if k < len(c) else None for c, k in zip(CUTS.values(), at, strict=True)]
        return pa.table({"stratum": t["stratum"][:1], "good": pa.array([good], pa.int64())} | {n: pa.array([c], pa.float64()) for n, c in zip(_CUT, cuts, strict=True)})

    out = saved(kinds.groupBy("stratum").applyInArrow(choose, "stratum string, good long, " + ", ".join(f"{c} double" for c in _CUT)))
    none = out.where(F.coalesce(*map(F.col, _CUT)).isNull()).agg(F.count("*"), F.min("stratum"), F.max("stratum")).first()
    if none[0]:
        logging.getLogger(__name__).warning("too few good labels for cutoffs, base rules alone: %d strata, from %r to %r", *none)
    return out


def passes() -> Column:
    """The method's verdict; a rule without a cutoff rejects nothing."""
    out = F.lit(True)
    for rule, value in rule_values().items():
        out = out & F.coalesce(value <= F.col(f"cut_{rule}"), F.lit(True))
    return out


def with_verdict(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of measured() with base_failed and kept. Each text is measured once; of what is then written only the counts go to the labels."""
    rows = written(measured(docs, keep), "measured")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cuts = cutoffs(rows.select("doc_id", "stratum", *_COUNTS).join(marks, "doc_id"))
    return rows.join(few(cuts), "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return with_verdict(docs, labels, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "stratum")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are kept."""
    return with_verdict(docs, labels, docs.columns).where("kept").select("doc.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
