"""Texts and titles of clusters: samples, chunks, extractive summaries, candidate and validated titles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.functions.scalars import sentences, word_count
from newslink.operators.events import ENTITY
from newslink.operators.tfidf import tokens
from newslink.operators.vectors import best_by_frequency
from newslink.sources.storage import materialize

#: Clusters, and best sentences of theirs, up to which they are broadcast.
BROADCAST_TERMS = 300_000
NO_SUMMARY = "Keine Zusammenfassung verfügbar."


def sample(members: DataFrame, size: int, seed: int) -> DataFrame:
    """`size` members of each cluster, chosen by a seeded hash."""
    order = F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}")))
    return members.withColumn("__k", F.row_number().over(W.partitionBy("leader").orderBy(order, "id"))).where(F.col("__k") <= size).drop("__k")


def chunks(texts: DataFrame, key: str, words: int, limit: int | None = None) -> DataFrame:
    """(key, chunk, words, text): sentences packed in order up to so many words; a longer sentence stands alone.

    All chunks of a text, or the first `limit` (5 for the summary step).
    """
    cut = texts.select(key, sentences(F.coalesce("text", F.lit(""))).alias("s")).withColumn("n", F.transform("s", word_count))
    placed = cut.withColumn("chunk", _packing(words)(F.col("n")))
    each = placed.select(key, F.posexplode(F.arrays_zip("chunk", "n", "s")).alias("place", "x")).select(key, "x.chunk", "place", "x.n", "x.s")
    taken = each if limit is None else each.where(F.col("chunk") < limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]), " ")
    return taken.groupBy(key, "chunk").agg(F.sum("n").alias("words"), joined.alias("text"))


def _packing(words: int):
    """A function of arrays of word counts: the chunk of each sentence, in one pass over them."""

    def place(column: pa.Array) -> pa.Array:
        out = []
        for counts in column.to_pylist():
            chunk, filled, chunks = -1, words + 1, []
            for n in counts:
                chunk, filled = (chunk + 1, n) if chunk < 0 or filled + n > words else (chunk, filled + n)
                chunks.append(chunk)
            out.append(chunks)
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(place, "array<bigint>")


def summaries(clusters: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(leader, summary): the sentences whose terms stand in most sentences of the cluster, best first."""
    leaders = materialize(clusters.select("leader").distinct().withColumn("block", F.monotonically_increasing_id().cast("string")), "leaders")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    # Written once; neither terms nor the names of clusters go with the sentences.
    found = members.join(small(leaders), "leader").select("block", F.explode_outer(sentences(F.col("content"))).alias("sentence")).where("sentence is not null").distinct()
    found = materialize(found.withColumn("number", F.monotonically_increasing_id()), "sentences")
    best = best_by_frequency(found.select("block", F.col("number").alias("id"), "sentence"), F.array_distinct(tokens(F.col("sentence"))), size)
    # Where too few sentences have terms, those without any count.
    several = best.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    few = materialize(leaders.join(several, "block", "left_anti").select("block", F.lit(True).alias("few")), "few")
    scored = found.join(small(best.select(F.col("id").alias("number"), "score")), "number", "left").join(small(few), "block", "left").where("score is not null or few")
    scored = scored.join(small(leaders), "block").select("leader", "sentence", F.coalesce("score", F.lit(0)).alias("score"))
    top = scored.withColumn("k", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("score"), "sentence"))).where(F.col("k") <= size)
    joined = top.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))
    return clusters.join(joined, "leader", "left").select("leader", F.coalesce("summary", F.lit(NO_SUMMARY)).alias("summary"))


def candidates(clusters: DataFrame, members: DataFrame, entities: DataFrame, size: int) -> DataFrame:
    """(leader, titles): the heaviest entities of each cluster; clusters(leader, fallback) without any keep theirs."""
    total = members.join(entities, "id").groupBy("leader", "entity").agg(F.sum("weight").alias("weight"))
    top = total.withColumn("k", F.row_number().over(W.partitionBy("leader").orderBy(F.desc("weight"), "entity"))).where(F.col("k") <= size)
    named = top.groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "entity"))), lambda x: x["entity"]).alias("titles"))
    return clusters.join(named, "leader", "left").select("leader", F.coalesce("titles", "fallback").alias("titles"))


def validate(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """(cluster, title): the exact title, else the first title that redirects from it, else the first that has its last word."""
    exact = titles.select(F.col("title").alias("exact")).distinct()
    first = titles.groupBy("redirect_to").agg(F.min_by("title", "title_id").alias("target"))
    index = titles.select(F.explode(F.split("title", " ")).alias("word"), "title").groupBy("word").agg(F.min("title").alias("hit"))
    word = F.element_at(F.split(F.lower("title"), " "), -1)
    found = asked.withColumn("word", word).join(exact, F.col("title") == F.col("exact"), "left").join(first, F.col("title") == F.col("redirect_to"), "left").join(index, "word", "left")
    return found.select("cluster", F.coalesce("exact", "target", "hit").alias("title")).where("title is not null").distinct()


def relevant(titles: DataFrame, summaries: DataFrame) -> DataFrame:
    """Titles that share a word with their cluster's summary; all of a cluster's titles if none does."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    joined = titles.join(summaries, "cluster").withColumn("fits", F.arrays_overlap(words("title"), words("summary")))
    some = F.max("fits").over(W.partitionBy("cluster"))
    return joined.withColumn("some", some).where("fits or not some").select("cluster", "title")


def chunk_titles(chunks: DataFrame, key: str, size: int) -> DataFrame:
    """chunks(key, chunk, text) to (key, n, titles): the first `size` capitalised words of every chunk, flattened in order."""
    found = F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(1))), 1, size)
    ordered = F.array_sort(F.collect_list(F.struct("chunk", found.alias("titles"))))
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.flatten(F.transform(ordered, lambda x: x["titles"])).alias("titles"))


def pieces(texts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, chunk, text): a text's pieces of `size` characters; an empty text has none."""
    count = F.ceil(F.length("text") / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring("text", k * size + 1, F.lit(size)))
    return texts.where("length(text) > 0").select(key, F.posexplode(cut).alias("chunk", "text"))


def gather(texts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, joined): all pieces of `size` characters numbered and gathered again in order; an empty text has none."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"])
    joined = pieces(texts, key, size).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(ordered, "").alias("joined"))
    empty = texts.where("length(text) = 0").select(key, F.lit(0).cast("bigint").alias("n"), F.lit("").alias("joined"))
    return joined.unionByName(empty)
