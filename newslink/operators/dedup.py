"""Deduplication of articles: by ids, links, versions and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslink.functions.scalars import base_link, url_last_segment, version_key
from newslink.operators.tfidf import arcs_of, content_vectors, distinct_texts, pairs_of
from newslink.sources.storage import discard, materialize


def keep_first(df: DataFrame, keys: list, order: Column) -> DataFrame:
    """One row for each combination of keys (nulls are equal): the one with the least order.

    An aggregate, so that the rows of a frequent key are reduced before they are shuffled.
    """
    named = [(k if isinstance(k, Column) else F.col(k)).alias(f"__key{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("__row")).select("__row.*")


def first_ids(df: DataFrame, keys: list, by_time: bool = False) -> DataFrame:
    """The id of one row for each combination of keys (nulls are equal): the largest id, or, by_time, the newest (see `newest`).

    Order and id are one number, so this is a hash aggregate over ids and keys, whatever else the rows hold.
    """
    named = [(k if isinstance(k, Column) else F.col(k)).alias(f"__key{i}") for i, k in enumerate(keys)]
    if not by_time:
        return df.groupBy(*named).agg(F.max("id").alias("id")).select("id")
    late = F.coalesce(-F.unix_micros(F.col("pubtime").cast("timestamp")), F.lit(4 * 10**18)).cast("decimal(19,0)")
    # Ids take part as numbers from 0 on, below the factor of the time.
    order = late * F.lit("20000000000000000000").cast("decimal(20,0)") + (F.col("id").cast("decimal(19,0)") + F.lit(str(2**63)).cast("decimal(19,0)"))
    least = df.groupBy(*named).agg(F.min(order.cast("decimal(38,0)")).alias("least"))
    return least.select((F.pmod("least", F.lit("20000000000000000000").cast("decimal(20,0)")) - F.lit(str(2**63)).cast("decimal(19,0)")).cast("bigint").alias("id"))


def by_content_id(art: DataFrame) -> DataFrame:
    return art.join(first_ids(art, ["content_id"]), "id", "left_semi")


def by_head_and_link(art: DataFrame) -> DataFrame:
    return art.join(first_ids(art, ["head", "article_link"]), "id", "left_semi")


def newest() -> Column:
    """The latest pubtime first, null ones last, ties by id."""
    return F.struct(F.coalesce(-F.unix_micros(F.col("pubtime").cast("timestamp")), F.lit(2**63 - 1)), "id")


def _segment(url: Column) -> Column:
    return F.coalesce(F.nullif(url_last_segment(url), F.lit("")), F.concat(F.lit("row:"), F.col("id").cast("string")))


def by_url_segment(art: DataFrame, url: Column) -> DataFrame:
    """The newest of articles with the same last URL part; articles without one are all kept."""
    return art.join(first_ids(art, [_segment(url)], by_time=True), "id", "left_semi")


def by_version(art: DataFrame, url: Column) -> DataFrame:
    """The newest of each version family within site and head."""
    return art.join(first_ids(art, ["base_link", "head", version_key(url)], by_time=True), "id", "left_semi")


def by_content(art: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Drops an article if a newer one of its group has a TF-IDF cosine similarity of at least the threshold.

    Null and blank contents are always kept. "Newer" is a later pubtime, at equal times a smaller id.
    """
    block = F.concat_ws("|", *group) if group else F.lit("all")
    valid = _valid(art, block)
    texts, members = distinct_texts(valid.select("id", "block", "text"))
    arcs = _similar_texts(texts, threshold)
    dated = members.join(valid.select("id", newest().alias("order")), "id")
    best = dated.groupBy("rep").agg(F.min("order").alias("best"))
    first = arcs.join(best, F.col("j") == F.col("rep")).groupBy("i").agg(F.min("best").alias("first"))
    older = dated.join(first, F.col("rep") == F.col("i")).where(F.col("order") > F.col("first")).select("id")
    return art.join(older, "id", "left_anti")


def _valid(art: DataFrame, block: Column) -> DataFrame:
    return art.where(F.length(F.trim(F.coalesce("content", F.lit("")))) > 0).select("id", block.alias("block"), "pubtime", F.col("content").alias("text"))


def _similar_texts(texts: DataFrame, threshold: float) -> DataFrame:
    """Arcs between similar ones of different texts, and from each text that has terms to itself."""
    w = content_vectors(texts)
    arcs = materialize(arcs_of(w, pairs_of(w, threshold, strict=False, sublinear=True)), "arcs")
    discard(w)
    return arcs


def by_reachability(art: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """The articles reached from the newest of a group along pairs that are less similar than the threshold.

    An article is left out if it is at least that similar to all reached ones. Starting from the newest alone, the
    excluded are recounted against the reached until none is added; only pairs above the threshold are joined.
    """
    block = F.concat_ws("|", *group) if group else F.lit("all")
    valid = _valid(art, block)
    texts, members = distinct_texts(valid.select("id", "block", "text"))
    arcs = _similar_texts(texts, threshold)
    start = valid.groupBy("block").agg(F.min_by("id", newest()).alias("first"))
    state = valid.join(members, "id").join(start, "block").select("id", "block", "rep", (F.col("id") == F.col("first")).alias("in"))
    state = materialize(state, "reach")
    reached = state.where("in").count()
    while True:
        counts = state.where("in").groupBy("rep").agg(F.count(F.lit(1)).alias("reached")).withColumnRenamed("rep", "j")
        close = arcs.join(counts, "j").groupBy("i").agg(F.sum("reached").alias("close"))
        sizes = state.where("in").groupBy("block").agg(F.count(F.lit(1)).alias("size"))
        step = state.join(sizes, "block").join(close, F.col("rep") == F.col("i"), "left")
        old, state = state, materialize(step.select("id", "block", "rep", (F.col("in") | (F.coalesce("close", F.lit(0)) < F.col("size"))).alias("in")), "reach")
        discard(old)
        now = state.where("in").count()
        if now == reached:
            break
        reached = now
    return art.join(state.where("not in").select("id"), "id", "left_anti")


def dedup_articles(art: DataFrame, threshold: float = 0.98, version_policy: str = "newest_only") -> DataFrame:
    """Cheap steps first: content ids, head and link, last URL part, versions, then content within site and head.

    Articles without a link are grouped by their head instead. The cheap steps see ids and keys only; contents are joined
    to the articles that are left.

    version_policy "newest_only" keeps the newest of a version family and compares what is left by content. "reference"
    is the described system's rule: in a group of site and head, the versions that are not the newest are compared among
    themselves, and those reached from the newest of them by dissimilarity (by_reachability) come back; the kept ones are
    not compared. So a family of two keeps both, and a family of over four equal texts keeps all, as their terms fall out
    of the vocabulary's bounds.
    """
    if version_policy not in ("newest_only", "reference"):
        raise ValueError(f"unknown version_policy {version_policy}")
    url = F.coalesce("article_link", F.concat(F.lit("head:/"), F.col("head")), F.lit(""))
    keys = materialize(art.select("id", "content_id", "head", "article_link", "pubtime", url.alias("url")), "keys")
    x = keep_first(keep_first(keys, ["content_id"], -F.col("id")), ["head", "article_link"], -F.col("id"))
    linked = x.where("article_link is not null").select("id", "head", "pubtime", base_link(F.col("url")).alias("base_link"), version_key(F.col("url")).alias("version"), _segment(F.col("url")).alias("segment"))
    linked = keep_first(linked, ["segment"], newest())
    loose = keep_first(x.where("article_link is null"), [F.coalesce("head", F.col("id").cast("string"))], newest())
    if version_policy == "reference":
        linked = materialize(linked, "linked")
    versioned = keep_first(linked, ["base_link", "head", "version"], newest())
    kept = versioned.select("id", "base_link", F.coalesce("head", F.lit("")).alias("head_key")).unionByName(loose.select("id", F.lit("").alias("base_link"), F.coalesce("head", F.lit("")).alias("head_key")))
    kept = materialize(kept, "kept")
    if version_policy == "newest_only":
        return by_content(art.join(kept, "id"), ["base_link", "head_key"], threshold).drop("base_link", "head_key")
    gone = linked.join(kept.select("id"), "id", "left_anti").select("id", "base_link", F.coalesce("head", F.lit("")).alias("head_key"))
    back = by_reachability(materialize(art.join(gone, "id"), "removed"), ["base_link", "head_key"], threshold).select("id")
    return art.join(kept.select("id").unionByName(back), "id", "left_semi")
