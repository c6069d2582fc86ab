"""Benchmark decontamination: a prefix-filtered set join with exact checks, in DataFrame operations only.

The windows of an item are its stretches of WINDOW words (an item of fewer words is one window). A window is contained
in a document if all its words stand there in its order, so one shingle is a sufficient prefix: the one that is rarest in
all documents. Document shingles are joined with these prefixes; a pair is dropped if the window would begin before
the document's first word or end after its last one (positional and length bounds), and else its words are compared
with the document's words at that place.

Words are matched by a pattern after A-Z are lower-cased. Null and empty texts have no words and are not contaminated.
Items without an id or words are ignored. Rows that repeat each give one row with the same values; a null doc_id is an
id like others. Without items, no document is contaminated. Empty documents give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslink.llm.common import materialize, pick, scratch

WINDOW = 10
#: Words of a shingle; windows of fewer words are searched by shingles of their own size.
SHINGLE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a table built from the benchmark up to which it is broadcast (about 64 MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (array), items (ids as text): one row for each different window."""
    items = pick(benchmark, item_id="string", text="string").where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("words")).groupBy("words").agg(F.collect_set("item_id").alias("items"))


def _sized(small: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is known to be small."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def _shingles(texts: DataFrame, size: int) -> DataFrame:
    """The rows of texts with pos and shingle (a hash of `size` words) for every place in the word array w."""
    # The outer form: else Spark filters by the array's size first and cuts every text twice.
    placed = texts.select("*", F.posexplode_outer("w").alias("pos", "word"))
    return placed.withColumn("shingle", F.xxhash64("word", *[F.get("w", F.col("pos") + i) for i in range(1, size)]))


def prefix_shingles(texts: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """prefix, at, n, window, items: each window with the shingle that is rarest in all documents and its place.

    Hashes only find candidates; words are compared afterwards.
    """
    each = _shingles(windows.withColumnRenamed("words", "w"), size).where(F.col("pos") <= F.size("w") - size)
    wanted = each.select("shingle").distinct()
    counts = _shingles(texts.select("w"), size).select("shingle").join(_sized(wanted), "shingle", "left_semi").groupBy("shingle").agg(F.count(F.lit(1)).alias("count"))
    ranked = each.select("w", "items", "pos", "shingle").join(counts, "shingle", "left")
    best = ranked.groupBy("w").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "pos", "shingle")).alias("first"), F.first("items").alias("items"))
    return best.select(F.col("first.shingle").alias("prefix"), F.col("first.pos").alias("at"), F.size("w").alias("n"), F.col("w").alias("window"), "items")


def cut_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, w (the words of the text), n_words: written once, as every pass over the documents reads it."""
    texts = pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    return materialize(texts.withColumn("n_words", F.size("w").cast("bigint")), "words")


def occurrences(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, start, size (in words), items: every occurrence of a window in the words of cut_words."""
    windows = item_windows(benchmark, window)
    sizes = [r.n for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect()]
    found = [_matches(texts, windows.where(F.least(F.size("words"), F.lit(SHINGLE)) == n), n) for n in sorted(sizes) or [SHINGLE]]
    return reduce(DataFrame.unionByName, found)


def _matches(texts: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    # Written once: it is used to learn its size and to join with, and its own plan reads all documents.
    prefixes = materialize(prefix_shingles(texts, windows, size), "prefixes")
    start = F.col("pos") - F.col("at")
    inside = (F.col("shingle") == F.col("prefix")) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    if prefixes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # The checks are part of the join, so that no row with a whole document's words leaves it.
        fits = inside & (F.slice("w", start + 1, F.col("n")) == F.col("window"))
        joined = _shingles(texts.select("doc_id", "text_key", "w", "n_words"), size).join(F.broadcast(prefixes), fits)
        return joined.select("doc_id", "text_key", start.alias("start"), F.col("n").alias("size"), "items")
    # Both sides are shuffled: places travel without their document's words, which only documents with candidates join again.
    places = _shingles(texts, size).select("doc_id", "text_key", "n_words", "pos", "shingle")
    place = F.struct(start.alias("start"), "n", "window", "items")
    met = places.join(prefixes, inside).groupBy("doc_id", "text_key").agg(F.collect_set(place).alias("places"))
    met = met.select(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key"), "places")
    both = texts.join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_key") == F.col("met_key")))
    exact = F.filter("places", lambda p: F.slice("w", p["start"] + 1, p["n"]) == p["window"])
    return both.select("doc_id", "text_key", F.explode(exact).alias("p")).select("doc_id", "text_key", "p.start", F.col("p.n").alias("size"), "p.items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted ids as text), contaminated; one row for each row of docs."""
    texts = cut_words(docs)
    per_doc = (
        occurrences(texts, benchmark, window)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "size")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "items", F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1))))).alias("n_hit"))
    )
    joined = texts.select("doc_id", "text_key", "n_words").join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs.

    Null and empty texts stay; repeated rows stay or go together; columns of any name may be among them.
    """
    with scratch():
        found = occurrences(cut_words(docs), benchmark).select(F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_key")).distinct()
        hits = materialize(found, "hits", keep=True)
    return docs.join(_sized(hits), docs["doc_id"].cast("bigint").eqNullSafe(F.col("__hit_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hit_key")), "left_anti")


ORACLE = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS k, least(len(w), 10) AS size
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dwin AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS k
         FROM (SELECT doc_id, size, w, unnest(generate_series(1, len(w) - size + 1)) AS s FROM dw, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT d.doc_id, d.s, d.size, i.item_id FROM dwin d JOIN win i ON d.k = i.k AND d.size = i.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""
