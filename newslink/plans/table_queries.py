"""Registered queries: table maintenance, the read side, scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.functions import scalars as S
from newslink.operators import tables as T
from newslink.registry import query
from newslink.sources import events_json, keyed
from newslink.sources import fixtures as X
from newslink.sources.storage import shared_dir

DAY = "2024-01-03"


@query(f"WITH {X.ART} SELECT id, pubtime, medium_name, char_count, head, article_link, content_id FROM art WHERE medium_name IN ('src1', 'src2', 'src3', 'src5') AND CAST(pubtime AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-04' AND lang = 'de' ORDER BY pubtime, id LIMIT 50000")
def source_query(spark: SparkSession, d: str) -> DataFrame:
    found = T.source_query(X.articles(spark, d), ["src1", "src2", "src3", "src5"], "2024-01-02", "2024-01-04", "de", 50_000)
    return found.select("id", "pubtime", "medium_name", "char_count", "head", "article_link", "content_id")


@query(f"WITH {X.CLUSTERS} SELECT c.cluster_id, CAST(c.date AS VARCHAR) AS date, c.medium_name AS title, c.summary_text, a.id AS article_id, strftime(a.pubtime, '%Y-%m-%dT%H:%M:%S') AS pubtime, a.head FROM cl c JOIN art a ON CAST(a.pubtime AS DATE) = c.date AND a.medium_name = c.medium_name")
def event_json(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    documents = events_json.to_documents(X.clusters(art), art)
    return events_json.from_documents(documents).select("cluster_id", "date", F.explode("titles").alias("title"), "summary_text", "article_id", "pubtime", "head")


@query(f"WITH {X.CLUSTERS} SELECT CAST(date AS VARCHAR) AS date, count(DISTINCT cl.cluster_id) AS n_clusters, CAST(sum(size) AS BIGINT) AS n_articles FROM cl GROUP BY date")
def load_event_json(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    rows = events_json.from_documents(events_json.to_documents(X.clusters(art), art).select(F.to_json("document").alias("json")))
    return rows.groupBy("date").agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("article_id").alias("n_articles"))


@query(f"WITH {X.REV}, src AS (SELECT *, row_number() OVER (PARTITION BY article_id, revid ORDER BY ts) AS k FROM rev WHERE revid % 3 IN (1, 2)) SELECT article_id, revid, ts, user_name, content FROM src WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM rev t WHERE t.revid % 3 IN (0, 1) AND t.article_id = src.article_id AND t.revid = src.revid)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rev = X.revisions(spark, d)
    return T.insert_ignore(rev.where("revid % 3 in (0, 1)"), rev.where("revid % 3 in (1, 2)"), ["article_id", "revid"], ["ts"])


UPSERT = """u AS (SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.head ELSE t.head END AS head, CASE WHEN s.id IS NOT NULL THEN s.lang ELSE t.lang END AS lang, CASE WHEN s.id IS NOT NULL THEN s.last_updated ELSE t.last_updated END AS last_updated
 FROM (SELECT id, head, lang, pubtime AS last_updated FROM art WHERE id % 3 IN (0, 1)) t FULL JOIN (SELECT id, 'neu: ' || head AS head, lang, TIMESTAMP '2024-02-01 00:00:00' AS last_updated FROM art WHERE id % 3 IN (1, 2)) s ON s.id = t.id)"""


@query(f"WITH {X.ART_ONCE}, {UPSERT} SELECT * FROM u")
def upsert_article(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    target = art.where("id % 3 in (0, 1)").select("id", "head", "lang", F.col("pubtime").alias("last_updated"))
    source = art.where("id % 3 in (1, 2)").select("id", F.concat(F.lit("neu: "), "head").alias("head"), "lang", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'").alias("last_updated"))
    return T.upsert(target, source, "id", ["head", "lang", "last_updated"])


@query(f"WITH {X.ART_ONCE}, {UPSERT} SELECT * FROM u")
def upsert_keyed(spark: SparkSession, d: str) -> DataFrame:
    """upsert_article into a stored table in buckets of the id, in two steps."""
    art = X.articles(spark, d)
    values = ["head", "lang", "last_updated"]
    target = art.where("id % 3 in (0, 1)").select("id", "head", "lang", F.col("pubtime").alias("last_updated"))
    source = art.where("id % 3 in (1, 2)").select("id", F.concat(F.lit("neu: "), "head").alias("head"), "lang", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'").alias("last_updated"))
    path = shared_dir(spark, "keyed")
    keyed.write_keyed(target, path, ["id"], 16)
    for step in (0, 1):
        keyed.upsert_keyed(path, source.where(F.col("id") % 2 == step), "id", values, 16)
    return keyed.read_keyed(spark, path, target.schema)


@query(f"WITH {X.CLUSTERS}, gone AS (SELECT cluster_id FROM cl WHERE date = DATE '{DAY}'), m AS (SELECT c.cluster_id, a.id FROM cl c JOIN art a ON CAST(a.pubtime AS DATE) = c.date AND a.medium_name = c.medium_name) SELECT 'clusters' AS kind, count(*) AS kept, (SELECT count(*) FROM gone) AS deleted FROM cl WHERE cluster_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'articles', count(*) FILTER (cluster_id NOT IN (SELECT * FROM gone)), count(*) FILTER (cluster_id IN (SELECT * FROM gone)) FROM m")
def delete_date(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    clusters = X.clusters(art)
    members = events_json.members(clusters, art).select("cluster_id", "article_id")
    gone = clusters.where(F.col("date") == DAY)
    sides = []
    for kind, df in (("clusters", clusters), ("articles", members)):
        kept = T.delete_where_key_in(df, gone, "cluster_id").agg(F.count(F.lit(1)).alias("kept"))
        deleted = df.join(gone.select("cluster_id"), "cluster_id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
        sides.append(kept.withColumn("kind", F.lit(kind)).join(deleted.withColumn("kind", F.lit(kind)), "kind"))
    return sides[0].unionByName(sides[1])


@query(f"WITH {X.REV} SELECT article_id, revid FROM rev WHERE article_id NOT IN (SELECT article_id FROM rev WHERE content LIKE '%ing%')")
def delete_article(spark: SparkSession, d: str) -> DataFrame:
    rev = X.revisions(spark, d)
    return T.delete_where_key_in(rev, rev.where(F.col("content").contains("ing")), "article_id").select("article_id", "revid")


@query(f"WITH {X.CLUSTERS} SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, CAST(sum(CASE WHEN date = DATE '{DAY}' THEN 1 ELSE size END) AS BIGINT) AS total FROM cl GROUP BY date")
def replace_day(spark: SparkSession, d: str) -> DataFrame:
    return events_json.replace_day(spark, X.clusters(X.articles(spark, d)), DAY).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))


WORK = "lines AS (SELECT CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '  ' WHEN 2 THEN p_name || ',en' ELSE p_name END AS value, p_partkey FROM part)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    return X.read(spark, d, "part").select(F.when(k == 0, F.concat(F.lit("# "), "p_name")).when(k == 1, "  ").when(k == 2, F.concat("p_name", F.lit(",en"))).otherwise(F.col("p_name")).alias("value"))


@query(f"WITH {WORK} SELECT split_part(value, ',', 1) AS title, CASE WHEN value LIKE '%,%' THEN split_part(value, ',', 2) ELSE 'de' END AS lang FROM lines WHERE trim(value) <> '' AND trim(value) NOT LIKE '#%'")
def worklist(spark: SparkSession, d: str) -> DataFrame:
    return T.parse_worklist(_lines(spark, d))


@query(f"WITH {X.REV} SELECT article_id, revid, CAST(row_number() OVER (PARTITION BY article_id ORDER BY ts DESC, revid DESC) AS BIGINT) AS newest_rank, CAST(row_number() OVER (PARTITION BY article_id ORDER BY ts, revid) AS BIGINT) AS oldest_rank FROM rev")
def history_read(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("article_id")
    return X.revisions(spark, d).select("article_id", "revid", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("revid"))).cast("bigint").alias("newest_rank"), F.row_number().over(w.orderBy("ts", "revid")).cast("bigint").alias("oldest_rank"))


@query(f"WITH {X.CLUSTERS} SELECT DISTINCT cluster_id, unnest([medium_name, 'Tag ' || CAST(date AS VARCHAR)]) AS title FROM cl")
def title_worklist(spark: SparkSession, d: str) -> DataFrame:
    c = X.clusters(X.articles(spark, d))
    return c.select("cluster_id", F.explode(F.array("medium_name", F.concat(F.lit("Tag "), F.col("date").cast("string")))).alias("title")).distinct()


@query(f"WITH {X.CLUSTERS} SELECT 'unique_content' AS \"check\", content_id AS key, count(*) AS n FROM art GROUP BY content_id HAVING count(*) > 1 UNION ALL SELECT 'unique_head_lang', head || '|' || lang, count(*) FROM art GROUP BY head, lang HAVING count(*) > 1 UNION ALL SELECT 'orphan_article', medium_name, count(*) FROM art WHERE medium_name NOT IN (SELECT medium_name FROM cl WHERE cluster_rank < 15) GROUP BY medium_name")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    parents = X.clusters(art).where("cluster_rank < 15").select("medium_name")
    return T.duplicate_keys(art, ["content_id"], "unique_content").unionByName(T.duplicate_keys(art, ["head", "lang"], "unique_head_lang")).unionByName(T.orphans(art, parents, "medium_name", "orphan_article"))


@query(f"WITH {X.REV}, upd AS (SELECT article_id, max(ts) AS last_updated FROM rev GROUP BY article_id), wl AS (SELECT DISTINCT conv_id + 3 AS article_id FROM conversations) SELECT wl.article_id, last_updated FROM wl LEFT JOIN upd USING (article_id) WHERE last_updated IS NULL OR last_updated <= TIMESTAMP '2024-01-12 00:00:00' - INTERVAL 7 DAY")
def stale_articles(spark: SparkSession, d: str) -> DataFrame:
    updated = X.revisions(spark, d).groupBy("article_id").agg(F.max("ts").alias("last_updated"))
    items = X.read(spark, d, "conversations").select((F.col("conv_id") + 3).alias("article_id")).distinct()
    return T.stale(items, updated, "article_id", "2024-01-12 00:00:00")


@query(f"WITH {X.CLUSTERS} SELECT a.id AS article_id, c.cluster_id, a.pubtime, a.medium_name, a.head, a.article_link FROM art a JOIN cl c ON CAST(a.pubtime AS DATE) = c.date AND a.medium_name = c.medium_name JOIN events e ON e.event_id = a.id WHERE e.event_type = 'error'")
def article_info(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    asked = X.read(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("article_id"))
    return events_json.members(X.clusters(art), art).join(asked, "article_id", "left_semi").select("article_id", "cluster_id", "pubtime", "medium_name", "head", "article_link")


@query(f"WITH {X.CLUSTERS} SELECT CAST(c.date AS VARCHAR) AS date, c.cluster_id, coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.pubtime DESC, a.id DESC), '') AS articles FROM cl c LEFT JOIN art a ON CAST(a.pubtime AS DATE) = c.date AND a.medium_name = c.medium_name AND a.article_link IS NOT NULL GROUP BY ALL")
def clusters_per_date(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    linked = art.where("article_link is not null").select(F.to_date("pubtime").alias("date"), "medium_name", "pubtime", "id")
    nested = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pubtime", "id"))), asc=False)
    return X.clusters(art).join(linked, ["date", "medium_name"], "left").groupBy("date", "cluster_id").agg(F.array_join(F.transform(nested, lambda x: x["id"].cast("string")), ",").alias("articles")).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {X.REV}, req AS (SELECT DISTINCT conv_id + 2 AS article_id FROM conversations) SELECT req.article_id, rev.revid, rev.ts, CASE WHEN rev.revid IS NULL THEN 'not found' ELSE 'ok' END AS status FROM req LEFT JOIN rev USING (article_id)")
def article_history(spark: SparkSession, d: str) -> DataFrame:
    asked = X.read(spark, d, "conversations").select((F.col("conv_id") + 2).alias("article_id")).distinct()
    return asked.join(X.revisions(spark, d), "article_id", "left").select("article_id", "revid", "ts", F.when(F.col("revid").isNull(), "not found").otherwise("ok").alias("status"))


@query("SELECT p_partkey, len(list_filter([p_name, 'x, ' || p_brand, p_type], lambda x: trim(x) <> '')) AS n, array_to_string([p_name, 'x, ' || p_brand, p_type], ';') AS elements FROM part")
def parse_array_literal(spark: SparkSession, d: str) -> DataFrame:
    literal = F.concat(F.lit("{"), "p_name", F.lit(',"x, '), "p_brand", F.lit('",'), "p_type", F.lit("}"))
    parsed = S.parse_array_literal(literal)
    return X.read(spark, d, "part").select("p_partkey", F.size(parsed).cast("bigint").alias("n"), F.array_join(parsed, ";").alias("elements"))


@query(f"WITH {X.CLUSTERS} SELECT coalesce(CAST(min(date) AS VARCHAR), '') AS first_date, coalesce(CAST(max(date) AS VARCHAR), '') AS last_date FROM cl")
def date_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = X.clusters(X.articles(spark, d))
    return c.agg(*[F.coalesce(f("date").cast("string"), F.lit("")).alias(n) for f, n in ((F.min, "first_date"), (F.max, "last_date"))])


@query(f"WITH {X.REVM} SELECT article_id, count(*) AS n FROM revm GROUP BY article_id")
def revision_count(spark: SparkSession, d: str) -> DataFrame:
    return X.revision_log(spark, d).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.CLUSTERS} SELECT cluster_id, size FROM cl")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    return events_json.members(X.clusters(art), art).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


@query("SELECT 'q' || CAST(user_id % 10 AS VARCHAR) AS queue, count(*) FILTER (event_type = 'view') AS pending, count(*) FILTER (event_type = 'click') AS running, count(*) FILTER (event_type NOT IN ('view', 'click')) AS completed FROM events GROUP BY 1")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return X.read(spark, d, "events").groupBy(F.concat(F.lit("q"), (F.col("user_id") % 10).cast("string")).alias("queue")).agg(F.count_if(kind == "view").alias("pending"), F.count_if(kind == "click").alias("running"), F.count_if(~kind.isin("view", "click")).alias("completed"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') / count(*) AS ratio FROM events GROUP BY user_id")
def worklist_success(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).alias("ratio"))


@query("(SELECT * FROM ((SELECT 'fetch' AS job, event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50) UNION ALL (SELECT 'diff', event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50)) ORDER BY ts DESC, event_id DESC LIMIT 50)")
def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = X.read(spark, d, "events")
    newest = [F.desc("ts"), F.desc("event_id")]
    logs = [e.where(F.col("event_type") == kind).orderBy(*newest).limit(50).select(F.lit(job).alias("job"), "event_id", "ts") for kind, job in (("view", "fetch"), ("click", "diff"))]
    return logs[0].unionByName(logs[1]).orderBy(*newest).limit(50)


@query(f"WITH {X.CLUSTERS} SELECT CAST(date AS VARCHAR) AS date, cluster_id, summary_text FROM cl WHERE cluster_rank = 2")
def nth_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.clusters(X.articles(spark, d)).where("cluster_rank = 2").select(F.col("date").cast("string").alias("date"), "cluster_id", "summary_text")


@query("WITH " + X.CLUSTERS + ", b AS (SELECT min(date) AS lo, max(date) + 2 AS hi FROM cl), days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b) SELECT CAST(day AS VARCHAR) AS day, count(cluster_id) AS n FROM days LEFT JOIN cl ON cl.date = days.day GROUP BY day")
def date_calendar(spark: SparkSession, d: str) -> DataFrame:
    c = X.clusters(X.articles(spark, d))
    days = c.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(F.explode(F.sequence("lo", F.date_add("hi", 2))).alias("day"))
    return days.join(c, F.col("day") == F.col("date"), "left").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("cluster_id").alias("n"))


URL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(f"WITH u AS (SELECT page_id, url, {URL} AS base_link, trim(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/') AS url_path FROM pages) SELECT page_id, base_link, url_path, string_split(url_path, '/')[-1] AS last_segment FROM u")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return X.read(spark, d, "pages").select("page_id", S.base_link(u).alias("base_link"), S.url_path(u).alias("url_path"), S.url_last_segment(u).alias("last_segment"))


@query(f"WITH {X.ART_V}, p AS (SELECT id, url, list_filter(string_split(trim(url, '/'), '/'), lambda x: x <> 'preview') AS parts FROM art_v) SELECT id, array_to_string(parts[:-2], '/') || '/' || regexp_replace(parts[-1], '(-[0-9]+)+$', '') AS version_key FROM p")
def url_version_key(spark: SparkSession, d: str) -> DataFrame:
    return X.version_articles(spark, d).select("id", S.version_key(F.col("url")).alias("version_key"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://[^ \\t\\n\\r]+', ' ', 'g'), '&[A-Za-z]+;', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "pages").select("page_id", S.clean_text(F.col("html")).alias("text"))


@query(f"WITH {X.CLUSTERS} SELECT cluster_id, cluster_rank, CAST(date AS VARCHAR) AS date FROM cl")
def cluster_hash(spark: SparkSession, d: str) -> DataFrame:
    return X.clusters(X.articles(spark, d)).select(S.cluster_hash(F.col("cluster_rank"), F.col("date")).alias("cluster_id"), "cluster_rank", F.col("date").cast("string").alias("date"))


@query(f"WITH {X.REVM} SELECT DISTINCT user_name, '#' || left(md5(user_name), 6) AS color, CASE WHEN regexp_matches(user_name, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN 'ipv4' WHEN regexp_matches(user_name, '^[0-9a-fA-F:]+$') AND contains(user_name, ':') THEN 'ipv6' ELSE 'registered' END AS kind FROM revm")
def user_color(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_name")
    return X.revision_log(spark, d).select(u, S.user_color(u).alias("color"), S.editor_type(u).alias("kind")).distinct()


@query(f"WITH {X.REVM} SELECT article_id, CASE WHEN regexp_matches(user_name, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN 'ipv4' WHEN regexp_matches(user_name, '^[0-9a-fA-F:]+$') AND contains(user_name, ':') THEN 'ipv6' ELSE 'registered' END AS editor_type, count(*) AS n FROM revm GROUP BY 1, 2")
def editor_type(spark: SparkSession, d: str) -> DataFrame:
    return X.revision_log(spark, d).groupBy("article_id", S.editor_type(F.col("user_name")).alias("editor_type")).agg(F.count(F.lit(1)).alias("n"))


_UML = "h"
for _a, _b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
    _UML = f"replace({_UML}, '{_a}', '{_b}')"


@query(f"WITH {X.ART}, t AS (SELECT id AS doc_id, head, coalesce(TRY(url_decode(head)), head) AS h FROM art), s AS (SELECT doc_id, head, lower(trim(regexp_replace({_UML}, '[^a-zA-Z0-9_.-]', '-', 'g'), '-')) AS s FROM t) SELECT doc_id, CASE WHEN regexp_matches(s, '^[0-9]*$') THEN 'container-' || left(md5(head), 8) ELSE s END AS slug FROM s")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return X.articles(spark, d).select(F.col("id").alias("doc_id"), S.slug(F.col("head")).alias("slug"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_from_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Antwort: "), "props", F.lit(" Ende"))
    return X.read(spark, d, "events").select("event_id", S.json_from_text(text, "k BIGINT")["k"].alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_skip_comments(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# reply\n# of a server\n"), "props", F.lit("\n"))
    return X.read(spark, d, "events").select("event_id", F.from_json(S.without_comments(text), "k BIGINT")["k"].alias("k"))


@query("SELECT s_suppkey, '10.' || CAST(s_suppkey % 100 AS VARCHAR) || '.0.0/16' AS prefix, 'AS' || CAST(s_suppkey AS VARCHAR) || ', AS0' AS asns, s_name AS org, CASE WHEN s_nationkey % 2 = 0 THEN 'CC' || CAST(s_nationkey AS VARCHAR) ELSE 'Unknown' END AS country FROM supplier")
def whois_flatten(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    country = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("CC"), F.col("s_nationkey").cast("string")))
    reply = F.to_json(F.struct(F.struct(F.concat(F.lit("10."), (F.col("s_suppkey") % 100).cast("string"), F.lit(".0.0/16")).alias("prefix"), F.array(F.concat(F.lit("AS"), k), F.lit("AS0")).alias("asns"), F.array(F.struct(F.struct(F.col("s_name").alias("ASORG"), country.alias("CC")).alias("org"))).alias("as2org")).alias("results")))
    schema = "results STRUCT<prefix: STRING, asns: ARRAY<STRING>, as2org: ARRAY<STRUCT<org: STRUCT<ASORG: STRING, CC: STRING>, ASNAME: STRING>>>"
    r = F.from_json(reply, schema)["results"]
    org = r["as2org"][0]["org"]
    return X.read(spark, d, "supplier").select("s_suppkey", r["prefix"].alias("prefix"), F.array_join(r["asns"], ", ").alias("asns"), F.coalesce(org["ASORG"], F.lit("Unknown")).alias("org"), F.coalesce(org["CC"], F.lit("Unknown")).alias("country"))


@query(f"WITH {X.ART} SELECT id, strftime(pubtime, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(pubtime, '%Y-%m-%d') AS day FROM art")
def ts_format(spark: SparkSession, d: str) -> DataFrame:
    return X.articles(spark, d).select("id", F.date_format("pubtime", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("pubtime", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events")
def ts_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return X.read(spark, d, "events").select("event_id", F.date_format(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT doc_id, CAST(len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) AS BIGINT) AS words, left(text, 1500) AS prefix FROM documents")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents").select("doc_id", S.word_count(F.col("text")).alias("words"), F.left("text", F.lit(1500)).alias("prefix"))
