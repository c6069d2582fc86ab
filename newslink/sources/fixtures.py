"""Article, revision and cluster tables over the given base tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
#: Rows of (id, url) up to which they are broadcast, so that texts are not shuffled.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(**parts: Column) -> Column:
    """The start time plus days, mins or secs."""
    return F.expr(START) + F.make_dt_interval(**parts)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw news articles: every tenth has no link, exact copies share content_id."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    n = pages.count()
    urls = pages.select("page_id", "url")
    joined = docs.join(F.broadcast(urls) if n <= BROADCAST_ROWS else urls, F.col("page_id") == F.col("doc_id") % n)
    return joined.select(
        F.col("doc_id").alias("id"),
        _at(days=(F.col("doc_id") % 5).cast("int"), secs=((F.col("doc_id") * 61) % 86400).cast("int")).alias("pubtime"),
        F.col("source").alias("medium_name"), "lang", F.col("n_chars").alias("char_count"),
        F.regexp_extract("text", r"^[^\n.!?]*", 0).alias("head"),
        F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("url")).alias("article_link"),
        F.md5("text").alias("content_id"), F.col("text").alias("content"),
    )


def version_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose links come in versions (-0 to -3) with a `preview` part."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    number = (F.col("doc_id") % 97).cast("string")
    return docs.join(pages.select("page_id", "url"), F.col("page_id") == F.col("doc_id") % 20).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://"), host, F.lit("/preview/artikel-"), number, F.lit("-"), (F.col("doc_id") % 4).cast("string")).alias("url"),
        host.alias("base_link"), F.concat(F.lit("head "), number).alias("head"), _at(secs=((F.col("doc_id") * 7919) % 86400).cast("int")).alias("pubtime"), F.col("text").alias("content"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text revisions of articles."""
    revid = F.col("conv_id") * 100 + F.col("turn")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("article_id"), revid.alias("revid"), _at(mins=revid.cast("int")).alias("ts"), F.concat("role", F.lit("-"), (F.col("conv_id") % 7).cast("string")).alias("user_name"), F.col("text").alias("content"))


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision metadata by named, IPv4 and IPv6 editors."""
    e = F.col("event_id")
    part = lambda n: (e % n).cast("string")
    user = F.when(e % 5 == 0, F.concat(F.lit("10."), part(100), F.lit("."), part(4), F.lit("."), part(250))).when(e % 5 == 1, F.concat(F.lit("2001:db8::"), part(1000))).otherwise(F.concat(F.lit("user"), part(40)))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("article_id"), e.alias("revid"), F.col("ts").cast("timestamp_ntz").alias("ts"), user.alias("user_name"), F.col("event_type").alias("comment"))


def page_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML revisions: pages as versions of 25 articles."""
    p = F.col("page_id")
    return read(spark, sf_dir, "pages").select((p % 25).alias("article_id"), p.alias("revid"), _at(hours=p.cast("int")).alias("ts"), "url", F.col("html").alias("content"))


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 networks of 16, 23, 24 and 32 bits and IPv6 networks of 32, 118 and 128, some of them for a time only."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    v4 = F.concat(F.lit("10."), text(k % 100), F.lit("."), text(k % 4), F.lit("."))
    plen = F.expr("case s_suppkey % 7 when 0 then 16 when 1 then 24 when 2 then 23 when 3 then 32 when 4 then 32 when 5 then 118 else 128 end")
    address = F.when(k % 7 < 3, F.concat(v4, F.lit("0"))).when(k % 7 == 3, F.concat(v4, text(k % 250))).when(k % 7 == 4, F.lit("2001:db8::")).otherwise(F.concat(F.lit("2001:db8::"), text(k % 1000)))
    until = F.when(k % 3 == 0, _at(days=(k % 25).cast("int")))
    return s.select(F.concat(address, F.lit("/"), text(plen)).alias("prefix"), F.when(k % 2 == 0, _at(days=(k % 11).cast("int"))).alias("since"), until.alias("until"), k.alias("asn"), F.col("s_name").alias("org"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title dictionary with a redirect target each."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("title_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("redirect_to"))


def clusters(art: DataFrame) -> DataFrame:
    """One cluster for each day and medium."""
    days = art.groupBy(F.to_date("pubtime").alias("date"), "medium_name").agg(F.count(F.lit(1)).alias("size"))
    rank = F.row_number().over(W.partitionBy("date").orderBy("medium_name")) - 1
    ranked = days.withColumn("cluster_rank", rank.cast("bigint"))
    summary = F.when(F.col("cluster_rank") % 4 == 3, None).otherwise(F.concat(F.lit("Zusammenfassung "), "medium_name"))
    return ranked.select(F.sha2(F.concat(F.col("cluster_rank").cast("string"), F.col("date").cast("string")), 256).alias("cluster_id"), "date", "medium_name", "cluster_rank", "size", summary.alias("summary_text"))


#: DuckDB text of the same tables.
ART = """art AS (SELECT d.doc_id AS id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(d.doc_id % 5 AS INT) + INTERVAL 1 SECOND * CAST((d.doc_id * 61) % 86400 AS INT) AS pubtime,
 d.source AS medium_name, d.lang AS lang, d.n_chars AS char_count, regexp_extract(d.text, '^[^\\n.!?]*', 0) AS head,
 CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE p.url END AS article_link, md5(d.text) AS content_id, d.text AS content
 FROM documents d JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages))"""
#: The same, computed once in queries that read it several times.
ART_ONCE = ART.replace("art AS (", "art AS MATERIALIZED (", 1)
ART_V = """art_v AS (SELECT d.doc_id AS id, concat('https://', regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1), '/preview/artikel-', CAST((d.doc_id % 97) AS STRING), '-', CAST(d.doc_id % 4 AS STRING)) AS url,
 regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1) AS base_link, concat('head ', CAST(d.doc_id % 97 AS STRING)) AS head, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * CAST((d.doc_id * 7919) % 86400 AS INT) AS pubtime, d.text AS content
 FROM documents d JOIN pages p ON p.page_id = d.doc_id % 20)"""
REV = """rev AS (SELECT conv_id AS article_id, conv_id * 100 + turn AS revid, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(conv_id * 100 + turn AS INT) AS ts,
 concat(role, '-', CAST(conv_id % 7 AS STRING)) AS user_name, text AS content FROM conversations)"""
REVM = """revm AS (SELECT user_id AS article_id, event_id AS revid, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 5 = 0 THEN concat('10.', CAST(event_id % 100 AS STRING), '.', CAST(event_id % 4 AS STRING), '.', CAST(event_id % 250 AS STRING)) WHEN event_id % 5 = 1 THEN concat('2001:db8::', CAST(event_id % 1000 AS STRING)) ELSE concat('user', CAST(event_id % 40 AS STRING)) END AS user_name, event_type AS comment FROM events)"""
PAGE_REV = """page_rev AS (SELECT page_id % 25 AS article_id, page_id AS revid, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(page_id AS INT) AS ts, url, html AS content FROM pages)"""
#: Bits of IPv4 addresses, and of IPv6 addresses 2001:db8::<one group>, as strings of 0 and 1.
V4_BITS = "array_to_string(list_transform(string_split({0}, '.'), lambda o: lpad(bin(CAST(o AS INT)), 8, '0')), '')"
V6_BITS = "lpad(bin(CAST('0x2001' AS INT)), 16, '0') || lpad(bin(CAST('0xdb8' AS INT)), 16, '0') || repeat('0', 80) || lpad(bin(CAST('0x0' || split_part({0}, '::', 2) AS INT)), 16, '0')"
BITS = f"CASE WHEN contains({{0}}, '::') THEN {V6_BITS} ELSE {V4_BITS} END"
NETWORKS = f"""net0 AS (SELECT s_suppkey AS asn, s_name AS org, CASE s_suppkey % 7 WHEN 0 THEN 16 WHEN 1 THEN 24 WHEN 2 THEN 23 WHEN 3 THEN 32 WHEN 4 THEN 32 WHEN 5 THEN 118 ELSE 128 END AS plen,
 CASE WHEN s_suppkey % 7 < 3 THEN concat('10.', s_suppkey % 100, '.', s_suppkey % 4, '.0') WHEN s_suppkey % 7 = 3 THEN concat('10.', s_suppkey % 100, '.', s_suppkey % 4, '.', s_suppkey % 250) WHEN s_suppkey % 7 = 4 THEN '2001:db8::' ELSE concat('2001:db8::', s_suppkey % 1000) END AS address,
 CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(s_suppkey % 11 AS INT) END AS since, CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(s_suppkey % 25 AS INT) END AS until FROM supplier),
 networks AS (SELECT asn, org, plen, since, until, {BITS.format('address')} AS bits FROM net0)"""
TITLES = "titles AS (SELECT p_partkey AS title_id, p_name AS title, p_brand AS redirect_to FROM part)"
CLUSTERS = ART + """,
 cl AS (SELECT sha256(concat(CAST(cluster_rank AS VARCHAR), CAST(date AS VARCHAR))) AS cluster_id, *, CASE WHEN cluster_rank % 4 = 3 THEN NULL ELSE concat('Zusammenfassung ', medium_name) END AS summary_text
  FROM (SELECT CAST(pubtime AS DATE) AS date, medium_name, row_number() OVER (PARTITION BY CAST(pubtime AS DATE) ORDER BY medium_name) - 1 AS cluster_rank, count(*) AS size FROM art GROUP BY 1, 2))"""
