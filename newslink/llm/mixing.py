"""Mixing sources to target weights: hierarchical budgeting over a domain - language - source tree.

Capacity of a leaf: its tokens (words) times the epochs allowed; of an inner node: the sum of its children's. From the
root down, a node's budget goes to its children by weight. A child that has less than its share gets its capacity and
what it leaves is shared by its siblings; only what a whole family cannot use goes back to the family's siblings, as the
family's capacity bounds its own share. With the children in order of capacity / weight, those that fall short are a
prefix, so shares come from running sums over siblings. Rounding down leaves a few tokens, which go one each to the
first siblings that have room.

A leaf's tokens are taken from epochs: epoch e is all its documents in order of a hash of the seed, e and doc_id. Whole
epochs are taken as often as they fit, the last one up to the budget: its documents are dealt into ranges of the hash,
whole ranges are taken by their sums, and only within the range that the budget ends in are documents summed one by
one. The last document is cut after the token at which the budget is used up (the prefix).

Null lang or source count as the value "none"; null and empty texts have no tokens and are never taken. Rows that repeat
are further documents (ties in order of the hash are broken by the text). Without tokens or budget there is no row.
Weights and budgets are whole numbers; weights times budget must stay below 2^63.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.llm.common import materialize

LEVELS = ("domain", "lang", "source")
#: Documents that a hash range of a leaf holds on average.
RANGE_ROWS = 2000
_SPACES = r"[\t\n\x0B\f\r ]+"


def _words(text: Column) -> Column:
    """Words between white space; an empty text is one empty word."""
    return F.split(F.trim(F.regexp_replace(text, _SPACES, " ")), " ")


def domain_of(source: Column) -> Column:
    """The domain of a source: its number's last two bits, or "none" without a number."""
    number = F.regexp_extract(source, r"([0-9]{1,6})$", 1)
    return F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("d"), (F.try_to_number(number, F.lit("999999")).cast("bigint") % 4).cast("string")))


def prepare(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, text_key, row (a column of docs that numbers its rows, else null), tokens and the levels of each document."""
    number = F.col(row) if row else F.lit(None)
    rows = docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"))], number.cast("bigint").alias("row"))
    rows = rows.withColumns({"lang": F.coalesce("lang", F.lit("none")), "source": F.coalesce("source", F.lit("none"))})
    tokens = F.size(F.filter(_words(F.coalesce("text", F.lit(""))), lambda w: w != "")).cast("bigint")
    return rows.select("doc_id", F.md5("text").alias("text_key"), "row", tokens.alias("tokens"), domain_of(F.col("source")).alias("domain"), "lang", "source").where("tokens > 0")


def _share(children: DataFrame, family: list[str]) -> DataFrame:
    """children(family, name, weight, capacity, given): adds `budget`, each child's part of what the family is given."""
    ratio = F.col("capacity") / F.col("weight")
    after = W.partitionBy(*family).orderBy(F.desc("ratio"), F.desc("name"))
    up = W.partitionBy(*family).orderBy("ratio", "name").rowsBetween(W.unboundedPreceding, -1)
    x = children.withColumn("ratio", ratio).withColumns({"used": F.coalesce(F.sum("capacity").over(up), F.lit(0)), "open_weight": F.sum("weight").over(after)})
    # Short: its share of what is left for it and all later siblings exceeds its capacity.
    x = x.withColumn("short", F.col("capacity") * F.col("open_weight") <= (F.col("given") - F.col("used")) * F.col("weight"))
    whole = W.partitionBy(*family)
    x = x.withColumns({"rest": F.col("given") - F.coalesce(F.sum(F.when(F.col("short"), F.col("capacity"))).over(whole), F.lit(0)), "rest_weight": F.sum(F.when(~F.col("short"), F.col("weight"))).over(whole)})
    floor = F.when(F.col("short"), F.col("capacity")).otherwise(F.expr("(weight * rest) div rest_weight"))
    x = x.withColumn("floor", floor)
    left = F.col("given") - F.sum("floor").over(whole)
    room = F.when(F.col("floor") < F.col("capacity"), 0).otherwise(1)
    x = x.withColumns({"left": left, "place": F.row_number().over(W.partitionBy(*family).orderBy(room, "name"))})
    one = ((F.col("place") <= F.col("left")) & (F.col("floor") < F.col("capacity"))).cast("bigint")
    return x.withColumn("budget", F.col("floor") + one)


def budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]] | None = None, epochs: int = 2) -> DataFrame:
    """leaves(domain, lang, source, docs, tokens): adds `budget`. Weights by level and name; 1 where none is given."""

    def weight(level: str) -> Column:
        known = (weights or {}).get(level, {})
        return reduce(lambda otherwise, kv: F.when(F.col(level) == kv[0], kv[1]).otherwise(otherwise), known.items(), F.lit(1)).cast("bigint")

    caps = leaves.withColumn("capacity", F.col("tokens") * epochs)
    sums = [caps.groupBy(*LEVELS[: k + 1]).agg(F.sum("capacity").alias("capacity")) for k in range(3)]
    given: DataFrame | None = None
    for k, level in enumerate(LEVELS):
        family = list(LEVELS[:k])
        children = sums[k].select(*LEVELS[: k + 1], F.col(level).alias("name"), weight(level).alias("weight"), "capacity")
        if given is None:
            children = children.withColumn("root", F.lit(0)).withColumn("given", F.least(F.lit(total).cast("bigint"), F.sum("capacity").over(W.partitionBy("root"))))
        else:
            children = children.join(given.withColumnRenamed("budget", "given"), family)
        given = _share(children, family or ["root"]).select(*LEVELS[: k + 1], "budget")
    return leaves.join(given, list(LEVELS))


#: Target weights of the registered query, and the share of all tokens that the mixture has.
WEIGHTS = {"domain": {"d0": 4, "d1": 2}, "lang": {"en": 3}}
PERCENT, EPOCHS, SEED = 60, 2, 7


def mix(docs: DataFrame, percent: int = PERCENT, weights: dict[str, dict[str, int]] | None = None, epochs: int = EPOCHS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, text_key, row, domain, lang, source, epoch, taken, tokens: the documents and token prefixes that make the mixture.

    The total budget is `percent` of all tokens of docs.
    """
    rows = materialize(prepare(docs, row), "mixture")
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "leaves")
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    plan = materialize(budgets(leaves, total, weights, epochs).where("budget > 0").select(*LEVELS, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("part"), F.expr(f"docs div {RANGE_ROWS} + 1").alias("ranges")), "budgets")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # The first seven hex digits of the key, in order, dealt into the leaf's ranges.
    bucket = F.expr("cast(conv(substring(key, 1, 7), 16, 10) as bigint) * ranges div 268435456")
    placed = rows.join(plan, list(LEVELS)).withColumn("key", key).withColumn("bucket", bucket)
    leaf = list(LEVELS)
    sums = placed.where("part > 0").groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("held"), F.first("part").alias("part"))
    ordered = W.partitionBy(*leaf).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("held").over(ordered), F.lit(0))).where("before < part").select(*leaf, "bucket", "before", (F.col("before") + F.col("held") <= F.col("part")).alias("inside"))
    partial = placed.where("part > 0").join(before, [*leaf, "bucket"])
    own = ["doc_id", "text_key", "row", *leaf]
    whole = partial.where("inside").select(*own, F.col("full").alias("epoch"), F.col("tokens").alias("taken"), "tokens")
    inner = W.partitionBy(*leaf, "bucket").orderBy("key", "text_key", "row").rowsBetween(W.unboundedPreceding, -1)
    cut = partial.where("not inside").withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).where("start < part")
    cut = cut.select(*own, F.col("full").alias("epoch"), F.least("tokens", F.col("part") - F.col("start")).alias("taken"), "tokens")
    repeated = placed.where("full > 0").select(*own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("epoch"), F.col("tokens").alias("taken"), "tokens")
    return repeated.unionByName(whole).unionByName(cut)


def apply_mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are in the mixture, once for each epoch, texts cut after the last token taken.

    A cut text keeps its white space before and between those tokens. Rows are numbered in a table of their own, so that
    repeated rows are taken one by one and columns of any name can be among them. Null and empty texts are never taken;
    an empty table gives no row.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, row="__row", **options).select(F.col("row").alias("__row"), F.col("taken").alias("__taken"), F.col("tokens").alias("__tokens"))
    words = F.regexp_extract_all("text", F.lit(r"([\t\n\x0B\f\r ]*[^\t\n\x0B\f\r ]+)"), F.lit(1))
    prefix = F.array_join(F.slice(words, 1, F.least("__taken", F.lit(2**31 - 1)).cast("int")), "")
    met = numbered.join(taken, "__row").withColumn("text", F.when(F.col("__taken") < F.col("__tokens"), prefix).otherwise(F.col("text")))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns])


def _oracle() -> str:
    spaces = "'[\\t\\n\\x0B\\f\\r ]+'"
    words = f"string_split(trim(regexp_replace(coalesce(text, ''), {spaces}, ' ', 'g')), ' ')"
    steps = []
    given, family = "root AS (SELECT 0 AS root, least(CAST(total AS BIGINT), (SELECT sum(capacity) FROM leaf)) AS budget FROM total)", ["root"]
    for k, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: k + 1])
        known = WEIGHTS.get(level, {})
        weight = "CASE " + " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in known.items()) + " ELSE 1 END" if known else "1"
        by = ", ".join(family)
        above = LEVELS[k - 1] if k else "root"
        steps.append(f"""
{level}_c AS (SELECT {keys}{", 0 AS root" if not k else ""}, {level} AS name, CAST({weight} AS BIGINT) AS weight, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaf GROUP BY {keys}),
{level}_x AS (SELECT c.*, p.budget AS given, capacity / weight AS ratio FROM {level}_c c JOIN {above + "_b" if k else "root"} p USING ({by})),
{level}_y AS (SELECT *, capacity * sum(weight) OVER (PARTITION BY {by} ORDER BY ratio DESC, name DESC) <=
  (given - coalesce(sum(capacity) OVER (PARTITION BY {by} ORDER BY ratio, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS short FROM {level}_x),
{level}_z AS (SELECT *, CASE WHEN short THEN capacity ELSE (weight * (given - coalesce(sum(CASE WHEN short THEN capacity END) OVER (PARTITION BY {by}), 0)))
  // sum(CASE WHEN NOT short THEN weight END) OVER (PARTITION BY {by}) END AS lower FROM {level}_y),
{level}_b AS (SELECT {keys}, CAST(lower + CASE WHEN lower < capacity AND row_number() OVER (PARTITION BY {by} ORDER BY CASE WHEN lower < capacity THEN 0 ELSE 1 END, name)
  <= given - sum(lower) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS BIGINT) AS budget FROM {level}_z)""")
        family = list(LEVELS[: k + 1])
    return f"""
WITH d0 AS (SELECT doc_id, md5(text) AS text_key, len(list_filter({words}, lambda w: w <> '')) AS tokens, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents),
d AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]{{1,6}})$', 1) = '' THEN 'none' ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain FROM d0 WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS capacity FROM d GROUP BY ALL),
total AS (SELECT sum(tokens) * {PERCENT} // 100 AS total FROM leaf),
{given},{",".join(steps)},
plan AS (SELECT l.domain, l.lang, l.source, budget // tokens AS full_epochs, budget % tokens AS part FROM leaf l JOIN source_b USING (domain, lang, source) WHERE budget > 0),
epochs AS (SELECT d.*, p.part, p.full_epochs, unnest(generate_series(0, p.full_epochs)) AS epoch FROM d JOIN plan p USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5(concat_ws('|', {SEED}, epoch, coalesce(CAST(doc_id AS VARCHAR), ''))), text_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM epochs)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(CASE WHEN epoch < full_epochs THEN tokens ELSE least(tokens, part - start) END AS BIGINT) AS taken
FROM placed WHERE epoch < full_epochs OR start < part"""


ORACLE = _oracle()
