"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch time.

A list is a log of dated entries (key, at, action): a key is a host with all its subdomains, or a host with a path
prefix. The entries of a key in order of time make intervals: each holds until the next one. Of entries at the same
time the last by action name holds. A capture's URL has one key for each of its host's parent domains and for each
part of its path; it is judged by the entry in force, at its fetch time, for its most specific key: paths before hosts,
longer keys before shorter ones. `block` blocks, `allow` allows what a wider entry blocks, `remove` ends an entry.

The keys of a capture are joined with the intervals on the key, with the time as a further condition, so that captures
of a very frequent host can be split among tasks. URLs without a host, null URLs and null times are never blocked. Rows
that repeat give one row each with equal values. Empty lists block nothing, empty captures give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.llm.common import materialize

#: The host, without user information before it and a port or a dot after it.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:]*[^/?#:.])"
#: Hosts that are addresses: they have no parent domains.
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def url_keys(url: Column) -> Column:
    """Array of (specificity, key) of a URL: parent domains with two parts or more, and path prefixes of the host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = F.when(host.rlike(ADDRESS), 1).otherwise(F.greatest(n - 1, F.lit(1)))
    none = F.array().cast("array<struct<rank:int,key:string>>")
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct((n - i + 1).cast("int").alias("rank"), F.array_join(F.slice(labels, i, n), ".").alias("key")))
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda p: p != "")
    paths = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.struct((i + 1000).cast("int").alias("rank"), F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")).alias("key")))).otherwise(none)
    return F.when(host != "", F.concat(domains, paths)).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until): each entry holds until the key's next one; null is without end."""
    one = entries.where("key is not null and at is not null").groupBy("key", "at").agg(F.max("action").alias("action"))
    until = F.lead("at").over(W.partitionBy("key").orderBy("at"))
    return one.select("key", "action", F.col("at").alias("since"), until.alias("until")).where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(capture_id, url, fetched): adds blocked, action and key of the deciding entry (null if none is in force)."""
    keyed = captures.where("fetched is not null").select("url", "fetched").distinct().select("url", "fetched", F.explode(url_keys(F.col("url"))).alias("k")).select("url", "fetched", "k.rank", "k.key")
    # Written, so that the join reads both sides from shuffles and can split the captures of a frequent host among tasks.
    met = keyed.join(materialize(intervals(entries), "intervals"), "key").where("since <= fetched and (until is null or fetched < until)")
    best = met.groupBy("url", "fetched").agg(F.max(F.struct("rank", "key", "action")).alias("m")).select(F.col("url").alias("__url"), F.col("fetched").alias("__at"), "m.key", "m.action")
    joined = captures.select("capture_id", "url", "fetched").join(best, (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__at")), "left")
    return joined.select("capture_id", "url", "fetched", "key", "action", (F.coalesce("action", F.lit("")) == "block").alias("blocked"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures, fetched one minute after each other."""
    minute = (F.col("page_id") % 100000).cast("int")
    return pages.select(F.col("page_id").alias("capture_id"), "url", (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=minute)).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts, parent domains and path prefixes that the pages have, by a hash of the key."""
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("k")).select("k.key", F.col("k.rank").alias("rank")).distinct()
    h = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")
    at = lambda n: F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=(h * n) % 5000)
    first = keys.where(h % 3 != 0).select("key", at(1).alias("at"), F.when(F.col("rank") >= 1000, "allow").otherwise("block").alias("action"))
    second = keys.where(h % 2 == 0).select("key", at(7).alias("at"), F.lit("remove").alias("action"))
    third = keys.where(h % 5 == 0).select("key", at(11).alias("at"), F.lit("block").alias("action"))
    return first.unionByName(second).unionByName(third)


_TS = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST({0} AS INT)"
ORACLE = f"""
WITH cap AS (SELECT page_id AS capture_id, url, {_TS.format('page_id % 100000')} AS fetched, lower(regexp_extract(url, '{HOST}', 1)) AS host,
  list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda p: p <> '') AS parts FROM pages),
lab AS (SELECT *, string_split(host, '.') AS l FROM cap WHERE host <> ''),
keys AS (SELECT capture_id, fetched, len(l) - i + 1 AS rank, array_to_string(l[i:], '.') AS key FROM (SELECT *, unnest(generate_series(1, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN 1 ELSE greatest(len(l) - 1, 1) END)) AS i FROM lab)
  UNION ALL SELECT capture_id, fetched, 1000 + i, host || '/' || array_to_string(parts[:i], '/') FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM lab WHERE len(parts) > 0)),
k AS (SELECT DISTINCT key, rank, CAST('0x' || left(md5(key), 6) AS INT) AS h FROM keys),
log AS (SELECT key, {_TS.format('h % 5000')} AS t, CASE WHEN rank >= 1000 THEN 'allow' ELSE 'block' END AS action FROM k WHERE h % 3 <> 0
  UNION ALL SELECT key, {_TS.format('(CAST(h AS BIGINT) * 7) % 5000')}, 'remove' FROM k WHERE h % 2 = 0 UNION ALL SELECT key, {_TS.format('(CAST(h AS BIGINT) * 11) % 5000')}, 'block' FROM k WHERE h % 5 = 0),
one AS (SELECT key, t, max(action) AS action FROM log GROUP BY ALL),
state AS (SELECT q.capture_id, q.rank, q.key, arg_max(o.action, o.t) AS action FROM keys q JOIN one o ON o.key = q.key AND o.t <= q.fetched GROUP BY ALL),
best AS (SELECT capture_id, key, action FROM state WHERE action <> 'remove' QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY rank DESC, key DESC) = 1)
SELECT cap.capture_id, url, fetched, key, action, coalesce(action, '') = 'block' AS blocked FROM cap LEFT JOIN best USING (capture_id)"""
