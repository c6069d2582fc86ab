"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds are found by patterns: `assign` (a keyword, = or :, a value of 8 characters or more), `access` (access
identifiers) and `hex`. Two weak kinds are parts that mean little alone: `key` (40 characters of base 64, as secret
keys have) and `endpoint` (a URL). Weak parts are reported only next to a complementary part: a key with an access
identifier, an endpoint with an access identifier or an assignment, within SCOPE code points of each other in one
document. Parts are joined as intervals: each is dealt to the blocks of SCOPE code points that it may reach, and pairs
that meet in a block are compared exactly.

Positions are code points, ends exclusive. The text between matches comes from splitting at the pattern, so that a
match begins at the summed lengths of what stands before it; those are summed in stretches, so that the work for a text
of n matches grows with n and its square root, not with its square. Very long texts are read whole. Columns other than doc_id and text are not read. Null and empty texts have no spans. Every row gives one
row; rows that repeat give equal rows, and a null doc_id is an id like others. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslink.llm.common import materialize, pick

SCOPE = 200
#: Pattern, the group whose length counts, its least length. The order is the order of kinds.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]+)", 1, 32),
}
WEAK = {"key": (r"([A-Za-z0-9+/]+)", 1, 40), "endpoint": (r"(https?://[A-Za-z0-9.-]+)", 1, 11)}
#: A cheap test of whether a text can hold a match at all.
MAY = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "key": r"[A-Za-z0-9+/]{40}", "endpoint": r"https?://"}
#: A weak kind and the kinds that complete it.
COMPLETE = {"key": ("access",), "endpoint": ("access", "assign")}
ORDER = [*BASE, *WEAK]


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, end) of a kind's matches, those that fail its length dropped."""
    pattern, group, least = (BASE | WEAK)[kind]
    if kind != "assign":  # one run of characters: the shorter ones need not be listed first
        pattern = pattern.replace("]+)", f"]{{{least - 4 if kind == 'access' else least},}})") if kind != "endpoint" else pattern
    gaps = F.split(text, pattern, -1)
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    found = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(MAY[kind]), _let(found, lambda rows: _placed(rows, least, empty))).otherwise(empty)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(found: Column, least: int, empty: Column) -> Column:
    """Spans of matches from the lengths of gaps and matches, in stretches of about the square root of their number.

    A fold copies the array that it appends to. Here no array grows beyond a stretch, or the number of stretches.
    """
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))
    width = F.ceil(F.sqrt(F.size(found))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / width).cast("int")), lambda k: F.slice(found, k * width + 1, width))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        hit = F.coalesce(F.length(x["part"]) >= least, F.lit(False))
        span = F.struct(start.alias("start"), (state["at"] + size(x)).alias("end"))
        return F.struct((state["at"] + size(x)).alias("at"), F.when(hit, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def joined(cut: Column) -> Column:
        sums = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + size(x)))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
        bases = F.aggregate(sums, none, lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["list"], F.array(state["at"])).alias("list")))["list"]
        return _let(bases, lambda at: F.flatten(F.transform(cut, lambda b, k: F.aggregate(b, F.struct(F.get(at, k).alias("at"), empty.alias("spans")), add)["spans"])))

    return _let(blocks, joined)


def find_parts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and one array of spans for each kind, weak ones included."""
    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text_key", *[_spans(F.col("text"), kind).alias(kind) for kind in ORDER])


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, kind, start, end of weak parts that have a complementary part within the scope."""
    long = parts.where(reduce(lambda a, b: a | b, [(F.size(k) > 0) & reduce(lambda x, y: x | y, [F.size(c) > 0 for c in COMPLETE[k]]) for k in WEAK]))
    long = long.select("doc_id", "text_key", F.explode(F.concat(*[_named(k, F.lit(k).alias("kind")) for k in ORDER if k != "hex"])).alias("p")).select("doc_id", "text_key", "p.*")
    block = lambda c: F.floor(c / scope)
    weak = long.where(F.col("kind").isin(*WEAK)).withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("start") - scope, F.lit(0))), block(F.col("end") + scope))))
    strong = long.where(F.col("kind").isin(*sorted({c for v in COMPLETE.values() for c in v}))).select(F.col("doc_id").alias("d2"), F.col("text_key").alias("t2"), F.col("kind").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), block(F.col("start")).alias("b2"))
    fits = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("k2").isin(*v) for k, v in COMPLETE.items()])
    near = (F.col("s2") - F.col("end") <= scope) & (F.col("start") - F.col("e2") <= scope)
    apart = (F.col("s2") >= F.col("end")) | (F.col("e2") <= F.col("start"))
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2")) & (F.col("block") == F.col("b2"))
    # A strong part stands in the block of its start; a long one may reach further, so blocks are wide enough for both ends.
    far = strong.withColumn("b2", F.explode(F.array_distinct(F.array("b2", block(F.col("e2"))))))
    return weak.join(far, same & fits & near & apart, "left_semi").select("doc_id", "text_key", "kind", "start", "end").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (arrays of kind, start, end in order)."""
    # Written once: the base spans and both sides of the join read them, and the texts are scanned a single time.
    parts = materialize(find_parts(docs), "parts")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    linked = link(parts, scope).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", _rank(F.col("kind")).alias("rank"), "end")).alias("linked")).select(F.col("doc_id").alias("d3"), F.col("text_key").alias("t3"), "linked")
    base = F.array_sort(F.concat(*[F.transform(k, _ranked(ORDER.index(k))) for k in BASE]))
    narrow = parts.select("doc_id", "text_key", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE], base.alias("base"))
    joined = narrow.join(linked, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("text_key") == F.col("t3")), "left")
    return joined.select("doc_id", *[f"n_{k}" for k in BASE], "base", F.array_sort(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def _named(kind: str, name: Column) -> Column:
    return F.transform(kind, lambda s: F.struct(name, s["start"].alias("start"), s["end"].alias("end")))


def _ranked(rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))


def _rank(kind: Column) -> Column:
    return reduce(lambda other, k: F.when(kind == k, ORDER.index(k)).otherwise(other), ORDER, F.lit(-1)).cast("int")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    def cte(kind: str) -> str:
        pattern, group, least = (BASE | WEAK)[kind]
        quoted = pattern.replace("'", "''")
        return f"""
{kind}_m AS (SELECT doc_id, string_split_regex(text, '{quoted}') AS g, regexp_extract_all(text, '{quoted}', 0) AS m, regexp_extract_all(text, '{quoted}', {group}) AS p FROM d),
{kind}_u AS (SELECT doc_id, unnest(generate_series(1, len(m))) AS i, g, m, p FROM {kind}_m),
{kind} AS (SELECT doc_id, '{kind}' AS kind, {ORDER.index(kind)} AS rank, pos AS s, pos + length(m[i]) AS e
  FROM (SELECT *, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM {kind}_u) WHERE length(p[i]) >= {least})"""

    links = " UNION ".join(f"SELECT w.* FROM {w} w JOIN {c} c ON w.doc_id IS NOT DISTINCT FROM c.doc_id AND c.s - w.e <= {SCOPE} AND w.s - c.e <= {SCOPE} AND (c.s >= w.e OR c.e <= w.s)" for w, cs in COMPLETE.items() for c in cs)
    base = " UNION ALL ".join(f"SELECT * FROM {k}" for k in BASE)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{",".join(map(cte, ORDER))},
base AS ({base}), every AS (SELECT * FROM base UNION ALL ({links})),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {joined} AS j FROM base GROUP BY doc_id),
e AS (SELECT doc_id, {joined} AS j FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.j, '')) AS base_sha256, coalesce(e.j, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)"""


ORACLE = _oracle()
