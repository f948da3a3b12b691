"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query: a conjunction of clauses, each a choice between literal
strings that any match must hold one of, each string being the conjunction of its trigrams. The index has a posting list
(keys of documents, a block of BLOCK_DOCS keys a list) for every trigram that a query names; a query is answered by
intersecting and uniting its lists. Only documents that it names are verified with the expression itself; rules without a
mandatory trigram scan every text. So that no text is shuffled, the answers go back to the texts as one bitmap of keys a
rule, whose size is bounded by FILTER_BITS whatever the table's size; keys that share a bit only add verifications.

Null and empty texts have no spans; spans of different kinds may overlap and are all reported, ordered by start, then by
kind as listed; repeated rows keep a row each, and null doc_ids stay null; extra columns, whatever their names but for
those that begin with "__", are kept by `redacted` and ignored by `find`; an empty table gives no rows. Texts are read
whole; places are running totals in two levels, so a text of n spans takes n^1.5 small steps and copies itself once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_bits, is_set, piece_and_bit


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    base: bool = False


ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    Rule("assign", ASSIGN, 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    # up to the end line, or where it is missing all lines of the body; possessive, so that the engine loops and does not recurse
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=:, \t\r\n-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/=]{16,})*+)"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("lab_token", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("chat_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("package_token", r"(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,})"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}"),
    Rule("bearer", r"[bB]earer [A-Za-z0-9._~+/=-]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!*-]{3,64}@"),
]
_MANY = 64


def _exact(node) -> set[str] | None:
    """All lower-cased strings that a parsed expression matches, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        chars = {chr(x[1]).lower() for x in arg if str(x[0]) == "LITERAL"}
        return chars if len(chars) <= 8 and all(str(x[0]) == "LITERAL" for x in arg) else None
    if op == "SUBPATTERN":
        return _all(arg[-1])
    if op == "BRANCH":
        parts = [_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and arg[1] <= 8:
        one = _all(arg[2])
        sets = None if one is None else [{"".join(x) for x in product(one, repeat=k)} for k in range(int(arg[0]), int(arg[1]) + 1)]
        return None if sets is None or sum(map(len, sets)) > _MANY else set().union(*sets)
    return None


def _all(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        e = _exact(n)
        if e is None or len(e) * len(out) > _MANY:
            return None
        out = {a + b for a in out for b in e}
    return out


def _clauses(nodes) -> list[list[set[str]]]:
    clauses, now = [], {""}

    def flush():
        if all(len(s) >= 3 for s in now):
            clauses.append([{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(now)])

    for n in nodes:
        e = _exact(n)
        if e is not None and len(e) * len(now) <= _MANY and "" not in e:
            now = {a + b for a in now for b in e}
            continue
        flush()
        now = {""}
        if str(n[0]) == "SUBPATTERN":
            clauses += _clauses(n[1][-1])
        elif str(n[0]) == "BRANCH":
            each = [_clauses(x) for x in n[1][1]]
            if all(each):  # a match takes one of the branches, and so holds what that one's first clause asks
                clauses.append([terms for c in each for terms in c[0]])
    flush()
    return clauses


def trigram_query(pattern: str) -> list[list[set[str]]]:
    """Clauses that all hold in a text with a match; each is a choice of trigram sets. Empty: nothing is mandatory."""
    from re import _parser

    return _clauses(_parser.parse(pattern))


#: Keys of documents in one block of the index on average, and so in one posting list at most about as many.
BLOCK_DOCS = 16_384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPANS = "array<struct<start:int,ord:int,stop:int,kind:string>>"


def _key() -> Column:
    """A document's key in the index; equal rows share it, and a meeting of hashes only adds a verification."""
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """block, term and its posting list: the keys of the block's documents that hold the trigram, in either case."""
    low = F.translate("text", UPPER, LOWER)
    terms = let(low, lambda body: F.filter(F.array(*map(F.lit, grams)), lambda t: F.contains(body, t)))
    held = docs.select(_key().alias("key"), F.explode(terms).alias("term"))
    return held.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "term").agg(F.collect_set("key").alias("docs"))


def answers(postings: DataFrame, queries: list[list[list[set[str]]]]) -> DataFrame:
    """rule (a place in queries) and key of each document that answers its query: lists intersected, alternatives united."""
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "docs"))).alias("lists"))
    held = lambda t: F.coalesce(F.col("lists")[t], F.array().cast("array<long>"))
    fold = lambda xs, one, join: F.aggregate(F.slice(xs, 2, F.size(xs)), one(F.get(xs, F.lit(0))), lambda acc, x: join(acc, one(x)))
    every = lambda terms: fold(terms, held, F.array_intersect)
    some = lambda clause: fold(clause, every, F.array_union)
    asked = F.from_json(F.lit(json.dumps([{"rule": k, "query": [[sorted(terms) for terms in clause] for clause in q]} for k, q in enumerate(queries) if q])), "array<struct<rule:int,query:array<array<array<string>>>>>")
    got = F.transform(asked, lambda q: F.struct(q["rule"].alias("rule"), fold(q["query"], some, F.array_intersect).alias("keys")))
    return lists.select(F.inline(got)).select("rule", F.explode("keys").alias("key"))


def candidates(docs: DataFrame, rules: list[Rule]) -> tuple[DataFrame | None, int]:
    """piece and maps: for each rule with a query a piece of its bitmap of keys; and the bitmap's size in bits. None if no rule has a query."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({t for q in queries for clause in q for terms in clause for t in terms})
    n = docs.count()
    bits = filter_bits(n)
    if not grams:
        return None, bits
    piece, bit = piece_and_bit(F.col("key"), bits)
    got = answers(index(docs, grams, max(1, -(-n // BLOCK_DOCS))), queries)
    pieces = got.groupBy("rule", piece.alias("__piece")).agg(F.bitmap_construct_agg(bit).alias("map"))
    return pieces.groupBy("__piece").agg(F.map_from_entries(F.collect_list(F.struct("rule", "map"))).alias("__maps")), bits


def let(value: Column, body) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join) -> Column:
    """Running totals of an array under join, in two levels: totals of blocks of about sqrt(n), then within each block."""

    def within(blocks: Column, sums: Column) -> Column:
        one = lambda b, k: let(F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), join), lambda head: F.transform(b, lambda _, j: join(head, F.aggregate(F.slice(b, F.lit(1), j + 1), F.lit(0), join))))
        return F.flatten(F.transform(blocks, one))

    def split(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: F.slice(v, k * w + 1, w)))
        return let(cut, lambda blocks: let(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join)), lambda sums: within(blocks, sums)))

    return let(values, lambda v: F.when(F.size(v) > 0, split(v)).otherwise(F.array().cast("array<int>")))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(text: Column, rule: Rule, order: int, measure) -> Column:
    """Leftmost non-overlapping matches as (start, ord, stop, kind), in units of measure; what split() leaves lies between them."""

    def placed(gaps: Column, hits: Column) -> Column:
        ends = running(F.transform(hits, lambda h, i: measure(F.get(gaps, i)) + measure(h)), _add)
        value = lambda h: F.regexp_extract(h, rule.pattern, rule.group) if rule.group else h
        span = lambda h, e: F.struct((e - measure(h)).alias("start"), F.lit(order).alias("ord"), e.alias("stop"), F.when(F.char_length(value(h)) >= rule.least, F.lit(rule.kind)).alias("kind"))
        return F.filter(F.zip_with(hits, ends, span), lambda s: s["kind"].isNotNull())

    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.split(text, rule.pattern, -1), lambda gaps: placed(gaps, h))).otherwise(F.array().cast(_SPANS)))


def with_spans(docs: DataFrame, rules: list[Rule] = RULES, measure=F.char_length) -> DataFrame:
    """All columns of docs and __spans: (start, ord, stop, kind), ordered; offsets are code points or what measure counts, stops exclusive."""
    found, bits = candidates(docs, rules)
    piece, bit = piece_and_bit(_key(), bits)
    out = docs.withColumns({"__piece": piece, "__bit": bit})
    if found is not None:  # at most 2 ** (FILTER_BITS - PIECE) rows of 4 KB a rule
        out = out.join(F.broadcast(found), "__piece", "left")
    none, all_spans = F.array().cast(_SPANS), []
    for k, r in enumerate(rules):
        if trigram_query(r.pattern):
            maybe = is_set(F.col("__maps")[k], F.col("__bit"))
        else:
            maybe = F.coalesce(F.col("text").rlike(r.pattern), F.lit(False))
        all_spans.append(F.when(maybe, _spans(F.col("text"), r, k, measure)).otherwise(none))
    return out.withColumn("__spans", F.array_sort(F.concat(*all_spans))).drop("__piece", "__bit", "__maps")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    s, base = F.col("__spans"), [k for k, r in enumerate(rules) if r.base]
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return with_spans(docs.select("doc_id", "text"), rules).select("doc_id", *(count(rules[k].kind) for k in base), F.sha2(_joined(F.filter(s, lambda x: x["ord"].isin(*base))), 256).alias("base_sha256"), _joined(s).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: list[Rule] = RULES) -> DataFrame:
    """docs with each run of overlapping spans in text replaced by the mark; other columns stay."""

    def cut(body: Column, spans: Column, stops: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(stops, i - 1))
        heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), new)
        end = lambda i: F.when(i > 0, F.get(stops, i - 1)).otherwise(0)
        piece = lambda i: F.substring(body, end(i) + 1, F.get(spans, i)["start"] - end(i)).cast("string")
        last = F.substring(body, F.element_at(stops, -1) + 1, F.octet_length(body)).cast("string")
        return F.array_join(F.concat(F.transform(heads, piece), F.array(last)), mark)

    stops = running(F.transform("__spans", lambda x: x["stop"]), _larger)
    text = let(F.col("text").cast("binary"), lambda body: let(stops, lambda s: cut(body, F.col("__spans"), s)))
    out = with_spans(docs, rules, F.octet_length)
    return out.select(*(F.when(F.size("__spans") > 0, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(rules: list[Rule] = RULES) -> str:
    q = lambda p: "'" + p.replace("'", "''").replace("*+", "*") + "'"  # noqa: E731  (an engine without backtracking needs no possessives)
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    parts = []
    for k, r in enumerate(rules):
        parts.append(f"""SELECT doc_id, {k} AS ord, '{r.kind}' AS kind, s AS start, s + length(hit) AS stop FROM (
          SELECT doc_id, hits[i] AS hit, vals[i] AS val, ({total('gaps[1:i]')} + {total('hits[1:i-1]')})::BIGINT AS s FROM (
            SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
              SELECT doc_id, string_split_regex(text, {q(r.pattern)}) AS gaps, regexp_extract_all(text, {q(r.pattern)}) AS hits, regexp_extract_all(text, {q(r.pattern)}, {r.group}) AS vals
              FROM documents WHERE regexp_matches(text, {q(r.pattern)})))) WHERE length(val) >= {r.least}""")
    base = [k for k, r in enumerate(rules) if r.base]
    text = "kind || ':' || start || ':' || stop"
    return f"""WITH s AS ({' UNION ALL '.join(parts)}),
    a AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE ord = {k}) AS n_{rules[k].kind}" for k in base)},
      coalesce(string_agg({text}, ',' ORDER BY start, ord) FILTER (WHERE ord IN ({', '.join(map(str, base))})), '') AS base, string_agg({text}, ',' ORDER BY start, ord) AS spans FROM s GROUP BY doc_id)
    SELECT doc_id, {', '.join(f"coalesce(n_{rules[k].kind}, 0)::BIGINT AS n_{rules[k].kind}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN a USING (doc_id)"""
