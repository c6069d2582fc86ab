"""Time-ordered lookups: ranges, nearest and snapped revisions, network prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.functions.scalars import ip_bits
from newslink.sources.storage import materialize


def revision_range(revisions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request, article_id, rev_a, rev_b): all revisions between the times of the two, in either order.

    A request of which either revision does not exist has none.
    """
    times = revisions.select("article_id", F.col("revid").alias("r"), F.col("ts").alias("t"))
    ends = requests.join(times, (requests["article_id"] == times["article_id"]) & F.col("r").isin(F.col("rev_a"), F.col("rev_b")))
    there = F.bool_or(F.col("r") == F.col("rev_a")) & F.bool_or(F.col("r") == F.col("rev_b"))
    bounds = ends.groupBy("request", requests["article_id"]).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), there.alias("there")).where("there").drop("there")
    return revisions.join(bounds, "article_id").where("ts between lo and hi")


def ranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df in ranges of (key, *order), each with its number as column `part`: a frequent key has many ranges, in order.

    Written once, so that a row's range stays what it is.
    """
    return materialize(df.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "ranged")


def between_marks(points: DataFrame, marks: DataFrame, key: str, at: str) -> DataFrame:
    """points with `before`, the last mark at or before `at`, and `after`, the first at or after it, of the same key.

    marks(key, at). Both are sorted together within ranges of (key, at), by running frames in either direction. What a
    range needs from those before and after it are their last and first marks, one row for each key and range, which
    are carried from range to range: a frequent key is never one task. Points without a key or place have neither.
    """
    have = marks.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at).distinct().withColumn("mark", F.col(at))
    both = ranged(points.withColumns({"mark": F.lit(None).cast(marks.schema[at].dataType), "asked": F.lit(True)}).unionByName(have.withColumn("asked", F.lit(False)), allowMissingColumns=True), key, at)
    edges = both.groupBy(key, "part").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    w = W.partitionBy(key).orderBy("part")
    carried = edges.select(F.col(key).alias("edge_key"), F.col("part").alias("edge_part"), F.max("high").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("carried_before"), F.min("low").over(W.partitionBy(key).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)).alias("carried_after"))
    inner = W.partitionBy("part", key)
    running = inner.orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow), inner.orderBy(F.desc(at)).rangeBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumns({"before": F.max("mark").over(running[0]), "after": F.min("mark").over(running[1])}).where("asked")
    out = near.join(carried, (F.col(key) == F.col("edge_key")) & (F.col("part") == F.col("edge_part")), "left")
    there = F.col(key).isNotNull() & F.col(at).isNotNull()
    found = {c: F.when(there, F.coalesce(c, f"carried_{c}")) for c in ("before", "after")}
    return out.withColumns(found).select(*points.columns, "before", "after")


def as_of(points: DataFrame, revisions: DataFrame) -> DataFrame:
    """points(point, article_id, v): adds `before` (last time at or before v) and `after` (first at or after v)."""
    return between_marks(points.select("article_id", "point", "v"), revisions.select("article_id", F.col("ts").alias("v")), "article_id", "v")


def nearest(points: DataFrame, revisions: DataFrame) -> DataFrame:
    """The closest revision time of each point; at equal distance the earlier."""
    gap = lambda c: F.abs(F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col("v").cast("timestamp")))
    near = F.when(F.col("before").isNull() | (gap("after") < gap("before")), F.col("after")).otherwise(F.col("before"))
    return as_of(points, revisions).withColumn("nearest", near)


def flat_networks(networks: DataFrame) -> DataFrame:
    """(family, low, cells): disjoint stretches of addresses, each from `low` up to the next one's, with the network that holds when.

    networks(prefix, since, until, asn, org). Addresses are hexadecimal digits of the family's length, so that they sort as
    text. The bounds of all prefixes cut a family's addresses into stretches. A prefix covers the stretches that begin within
    it; prefixes lie within one another or apart, so a stretch has as many as there are prefix lengths at most, apart from
    periods. Their periods cut time likewise: cells(from, plen, asn, org) in order of time hold from `from` on (null: ever
    since), with the longest prefix that is valid then, of equal ones the largest (asn, org), or none.
    """
    parts = F.split("prefix", "/")
    bits = ip_bits(parts[0])
    plen = parts[1].cast("int")
    nets = networks.select(F.length(bits).alias("family"), plen.alias("plen"), F.substring(bits, F.lit(1), plen).alias("net"), bits.alias("bits"), "since", "until", "asn", "org").where("bits is not null and plen between 0 and family and (since is null or until is null or since < until)")
    # Of networks with the same prefix and period the largest (asn, org) holds throughout; the others are never found.
    held = nets.groupBy("family", "plen", "net", "since", "until").agg(F.max(F.struct("asn", "org")).alias("held"))
    nets = materialize(held.select("family", "plen", "net", "since", "until", "held.asn", "held.org"), "networks")
    # After its last address a prefix ends: the next one's bits, if there are any.
    ones = F.length(F.regexp_extract("net", "1*$", 0))
    after = F.when(ones < F.col("plen"), F.rpad(F.concat(F.substring("net", F.lit(1), F.col("plen") - ones - 1), F.lit("1")), F.col("family"), F.lit("0")))
    bounds = nets.select("family", F.explode(F.array(F.rpad("net", F.col("family"), F.lit("0")), after)).alias("low")).where("low is not null").distinct()
    lengths = nets.groupBy("family").agg(F.collect_set("plen").alias("lengths"))
    keyed = bounds.join(F.broadcast(lengths), "family").select("family", "low", F.explode("lengths").alias("plen")).withColumn("net", F.substring("low", F.lit(1), F.col("plen")))
    covers = materialize(keyed.join(nets, ["family", "plen", "net"]).select("family", "low", "plen", "asn", "org", "since", "until"), "covers")
    times = covers.select("family", "low", F.explode(F.array("since", "until")).alias("from")).unionByName(covers.select("family", "low", F.lit(None).cast("timestamp_ntz").alias("from"))).distinct()
    valid = F.when(F.col("from").isNull(), F.col("since").isNull()).otherwise((F.col("since").isNull() | (F.col("since") <= F.col("from"))) & (F.col("until").isNull() | (F.col("from") < F.col("until"))))
    best = times.join(covers, ["family", "low"]).where(valid).groupBy("family", "low", "from").agg(F.max(F.struct("plen", "asn", "org")).alias("best"))
    cells = times.select(F.col("family").alias("f"), F.col("low").alias("l"), F.col("from").alias("t"))
    cells = cells.join(best, (F.col("f") == F.col("family")) & (F.col("l") == F.col("low")) & F.col("t").eqNullSafe(F.col("from")), "left").groupBy("f", "l").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("from"), F.col("best.plen"), F.col("best.asn"), F.col("best.org")))).alias("cells"))
    rest = bounds.join(cells, (F.col("family") == F.col("f")) & (F.col("low") == F.col("l")), "left")
    return rest.select("family", "low", "cells")


def enrich_ips(log: DataFrame, networks: DataFrame) -> DataFrame:
    """log(revid, user_name, ts): the longest network that covers each IPv4 or IPv6 editor at the time of the edit.

    networks(prefix, since, until, asn, org): prefixes as text, of any length, valid from since until before until (null:
    no bound). They are flattened to disjoint stretches of addresses (flat_networks); each different address finds its
    stretch by one ordered lookup, and each edit the cell of its time.
    """
    flat = materialize(flat_networks(networks), "flat")
    edits = log.where(F.col("user_name").contains(".") | F.col("user_name").contains(":")).select("revid", "user_name", "ts")
    names = edits.select("user_name").distinct().select("user_name", ip_bits(F.col("user_name")).alias("low")).where("low is not null").withColumn("family", F.length("low"))
    found = between_marks(names, flat.select("family", "low"), "family", "low").where("before is not null").select("user_name", "family", "before")
    held = found.join(flat.where("cells is not null"), (found["family"] == flat["family"]) & (F.col("before") == flat["low"])).select("user_name", "cells")
    last = F.element_at(F.filter("cells", lambda c: c["from"].isNull() | (c["from"] <= F.col("ts"))), -1)
    met = edits.join(held, "user_name").select("revid", "user_name", F.when(F.col("ts").isNull(), F.get("cells", F.lit(0))).otherwise(last).alias("m"))
    return met.select("revid", "user_name", "m.plen", "m.asn", "m.org").where("plen is not null")
