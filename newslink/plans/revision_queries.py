"""Registered queries: revision histories, changes and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.operators import revisions as R
from newslink.operators import timeline as L
from newslink.registry import query
from newslink.sources import fixtures as X

LAG = "lg AS (SELECT *, lag(content) OVER w AS prev_content, lag(revid) OVER w AS prev_revid FROM rev WINDOW w AS (PARTITION BY article_id ORDER BY ts, revid))"


@query(f"WITH {X.REV}, {LAG} SELECT article_id, revid, prev_revid, md5(prev_content) AS prev_md5 FROM lg")
def revision_lag(spark: SparkSession, d: str) -> DataFrame:
    return R.with_previous(X.revisions(spark, d)).select("article_id", "revid", "prev_revid", F.md5("prev_content").alias("prev_md5"))


@query(f"WITH {X.REV}, {LAG} SELECT article_id, revid, content IS DISTINCT FROM prev_content AS changed, prev_revid IS NULL AS first FROM lg")
def revision_changed(spark: SparkSession, d: str) -> DataFrame:
    return R.with_previous(X.revisions(spark, d)).select("article_id", "revid", (~F.col("content").eqNullSafe(F.col("prev_content"))).alias("changed"), F.col("prev_revid").isNull().alias("first"))


@query(f"WITH {X.REV} SELECT article_id, revid, ts, user_name FROM rev QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY ts DESC, revid DESC) = 1")
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    return X.revisions(spark, d).groupBy("article_id").agg(F.max_by(F.struct("revid", "ts", "user_name"), F.struct("ts", "revid")).alias("r")).select("article_id", "r.revid", "r.ts", "r.user_name")


@query(f"WITH {X.REVM}, k AS (SELECT article_id, revid, row_number() OVER (PARTITION BY article_id ORDER BY ts, revid) AS up, row_number() OVER (PARTITION BY article_id ORDER BY ts DESC, revid DESC) AS down, count(*) OVER (PARTITION BY article_id) AS n FROM revm) SELECT article_id, max(revid) FILTER (up = 1) AS first, max(revid) FILTER (down = 1) AS last, max(revid) FILTER (down = least(10, n)) AS tenth FROM k GROUP BY article_id")
def key_revisions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("article_id")
    k = X.revision_log(spark, d).withColumns({"up": F.row_number().over(w.orderBy("ts", "revid")), "down": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("revid"))), "n": F.count(F.lit(1)).over(w)})
    pick = lambda c: F.max(F.when(c, F.col("revid")))
    return k.groupBy("article_id").agg(pick(F.col("up") == 1).alias("first"), pick(F.col("down") == 1).alias("last"), pick(F.col("down") == F.least(F.lit(10), "n")).alias("tenth"))


@query(f"WITH {X.REVM} SELECT article_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, string_agg(CAST(revid AS VARCHAR), ',' ORDER BY ts, revid) AS revids FROM revm GROUP BY ALL")
def revisions_by_day(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "revid"))), lambda x: x["revid"].cast("string")), ",")
    return X.revision_log(spark, d).groupBy("article_id", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), listed.alias("revids"))


BOUND = "2024-01-10 12:00:00"


@query(f"WITH {X.REVM} SELECT article_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (ts < TIMESTAMP '{BOUND}') >= 1 AS has_one, count(*) FILTER (ts < TIMESTAMP '{BOUND}') > 1 AS has_more FROM revm GROUP BY ALL")
def valid_days(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{BOUND}'"))
    return X.revision_log(spark, d).groupBy("article_id", F.to_date("ts").cast("string").alias("day")).agg((n >= 1).alias("has_one"), (n > 1).alias("has_more"))


REQ = "req AS (SELECT article_id AS request, article_id, max(revid) AS rev_a, min(revid) + 0 AS rev_b FROM (SELECT article_id, revid, row_number() OVER (PARTITION BY article_id ORDER BY revid) AS k FROM revm) WHERE k BETWEEN 3 AND 12 GROUP BY article_id)"
RANGE = "rng AS (SELECT r.request, m.article_id, m.revid, m.ts FROM req r JOIN revm a ON a.article_id = r.article_id AND a.revid = r.rev_a JOIN revm b ON b.article_id = r.article_id AND b.revid = r.rev_b JOIN revm m ON m.article_id = r.article_id AND m.ts BETWEEN least(a.ts, b.ts) AND greatest(a.ts, b.ts))"


def _range(spark: SparkSession, d: str) -> DataFrame:
    log = X.revision_log(spark, d)
    k = F.row_number().over(W.partitionBy("article_id").orderBy("revid"))
    asked = log.withColumn("k", k).where("k between 3 and 12").groupBy("article_id").agg(F.max("revid").alias("rev_a"), F.min("revid").alias("rev_b")).withColumn("request", F.col("article_id"))
    return L.revision_range(log, asked)


@query(f"WITH {X.REVM}, {REQ}, {RANGE} SELECT request, article_id, revid, ts FROM rng")
def revision_range(spark: SparkSession, d: str) -> DataFrame:
    return _range(spark, d).select("request", "article_id", "revid", "ts")


@query(f"WITH {X.REVM}, {REQ}, {RANGE} SELECT request, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM rng GROUP BY request")
def revision_range_summary(spark: SparkSession, d: str) -> DataFrame:
    return _range(spark, d).groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


PTS = "pts AS (SELECT o_orderkey AS point, o_orderkey % 150 AS article_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST((o_orderkey * 37) % 43200 AS INT) AS v FROM orders)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return X.read(spark, d, "orders").select(o.alias("point"), (o % 150).alias("article_id"), (F.expr(X.START) + F.make_dt_interval(mins=((o * 37) % 43200).cast("int"))).alias("v"))


AS_OF = "b AS (SELECT pts.*, (SELECT max(ts) FROM revm WHERE revm.article_id = pts.article_id AND ts <= v) AS bf, (SELECT min(ts) FROM revm WHERE revm.article_id = pts.article_id AND ts >= v) AS af FROM pts)"


@query(f"WITH {X.REVM}, {PTS}, {AS_OF} SELECT point, CASE WHEN bf IS NULL OR epoch_us(af) - epoch_us(v) < epoch_us(v) - epoch_us(bf) THEN af ELSE bf END AS nearest FROM b")
def nearest_revision(spark: SparkSession, d: str) -> DataFrame:
    return L.nearest(_points(spark, d), X.revision_log(spark, d)).select("point", "nearest")


@query(f"WITH {X.REVM}, {PTS}, lim AS (SELECT * FROM revm WHERE ts < TIMESTAMP '{BOUND}'), {AS_OF.replace('FROM revm', 'FROM lim').replace('revm.article_id', 'lim.article_id')} SELECT point, CASE WHEN bf IS NULL OR epoch_us(af) - epoch_us(v) < epoch_us(v) - epoch_us(bf) THEN af ELSE bf END AS nearest FROM b")
def nearest_revision_bounded(spark: SparkSession, d: str) -> DataFrame:
    log = X.revision_log(spark, d).where(F.col("ts") < F.expr(f"TIMESTAMP_NTZ '{BOUND}'"))
    return L.nearest(_points(spark, d), log).select("point", "nearest")


@query(f"WITH {X.REVM}, {PTS}, {AS_OF} SELECT point, coalesce(af, bf) AS ts FROM b")
def snap_forward(spark: SparkSession, d: str) -> DataFrame:
    return L.as_of(_points(spark, d), X.revision_log(spark, d)).select("point", F.coalesce("after", "before").alias("ts"))


@query(f"WITH {X.REVM}, {PTS}, {AS_OF} SELECT point, coalesce(bf, af) AS ts FROM b")
def snap_backward(spark: SparkSession, d: str) -> DataFrame:
    return L.as_of(_points(spark, d), X.revision_log(spark, d)).select("point", F.coalesce("before", "after").alias("ts"))


@query(f"""WITH {X.REVM}, {X.NETWORKS}, ip AS (SELECT revid, user_name, ts, {X.BITS.format('user_name')} AS bits FROM revm WHERE user_name LIKE '10.%' OR user_name LIKE '2001:%')
 SELECT revid, user_name, plen, asn, org FROM ip JOIN networks n ON length(n.bits) = length(ip.bits) AND left(n.bits, n.plen) = left(ip.bits, n.plen) AND (since IS NULL OR since <= ts) AND (until IS NULL OR ts < until)
 QUALIFY row_number() OVER (PARTITION BY revid ORDER BY plen DESC, asn DESC) = 1""")
def ip_enrich(spark: SparkSession, d: str) -> DataFrame:
    return L.enrich_ips(X.revision_log(spark, d), X.networks(spark, d))


BLOCKS = ", blk AS (" + " UNION ALL ".join(f"SELECT article_id, revid, '{t}' AS tag, unnest(generate_series(1, len(x))) AS idx, unnest(x) AS text FROM (SELECT article_id, revid, regexp_extract_all(content, '(?is)<{t}(?:\\s[^>]*)?>(.*?)</{t}>', 1) AS x FROM page_rev)" for t in R.BLOCKS) + ")"


@query(f"WITH {X.PAGE_REV}{BLOCKS} SELECT article_id, revid, tag, idx, text FROM blk")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.blocks(X.page_revisions(spark, d)).select("article_id", "revid", "tag", "idx", "text")


@query(f"WITH {X.PAGE_REV}{BLOCKS} SELECT n.article_id, n.revid, n.tag, n.idx, n.text = o.text AS same FROM blk n JOIN blk o ON o.article_id = n.article_id AND o.revid = n.revid - 25 AND o.tag = n.tag AND o.idx = n.idx")
def block_align(spark: SparkSession, d: str) -> DataFrame:
    return R.align(X.page_revisions(spark, d)).select("article_id", "revid", "tag", "idx", (F.col("text") == F.col("old_text")).alias("same"))


BAG = "bag AS (SELECT article_id, revid, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}_]+')) AS token, 1 AS d FROM lg UNION ALL SELECT article_id, revid, unnest(regexp_extract_all(coalesce(prev_content, ''), '[\\p{L}\\p{N}_]+')), -1 FROM lg), dl AS (SELECT article_id, revid, token, CAST(sum(d) AS BIGINT) AS d FROM bag GROUP BY ALL HAVING sum(d) <> 0)"


@query(f"WITH {X.REV}, {LAG}, {BAG} SELECT article_id, revid, token, greatest(d, 0) AS added, greatest(-d, 0) AS removed FROM dl")
def token_delta(spark: SparkSession, d: str) -> DataFrame:
    return R.token_delta(X.revisions(spark, d))


@query(f"WITH {X.REV}, {LAG}, {BAG} SELECT article_id, user_name, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM dl JOIN rev USING (article_id, revid) GROUP BY ALL")
def edit_contribution(spark: SparkSession, d: str) -> DataFrame:
    rev = X.revisions(spark, d)
    return R.token_delta(rev).join(rev.select("article_id", "revid", "user_name"), ["article_id", "revid"]).groupBy("article_id", "user_name").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


REPORT = "['NewPP', 'Cache expiry', 'CPU time usage', 'Real time usage', 'Preprocessor visited node count', 'Post-expand', 'Unstrip', 'RevisionOutputCache', 'Transclusion expansion time report', 'Saved in parser cache', 'Complications', 'Transclusion of']"


@query(f"WITH {X.PAGE_REV}, l AS (SELECT revid, CASE WHEN revid % 13 = 12 THEN url ELSE concat(upper({REPORT}[revid % 13 + 1]), ' ', url) END AS line FROM page_rev) SELECT revid, line FROM l WHERE revid % 13 >= 10")
def report_line_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("revid") % 13
    kinds = F.array(*[F.lit(x) for x in (*R.REPORT_LINES, "Complications", "Transclusion of")])
    lines = X.page_revisions(spark, d).select("revid", F.when(k == 12, F.col("url")).otherwise(F.concat(F.upper(F.get(kinds, k.cast("int"))), F.lit(" "), "url")).alias("line"))
    return lines.where(~R.is_report_line(F.col("line")))


@query()
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return R.rewritten(X.page_revisions(spark, d).select("article_id", "revid", "content"), strip=True)


@query()
def unwrap_links(spark: SparkSession, d: str) -> DataFrame:
    wiki = F.regexp_replace("content", r'href="/', 'href="/wiki/')
    return R.rewritten(X.page_revisions(spark, d).select("article_id", "revid", wiki.alias("content")), strip=False)


@query()
def diff_ops(spark: SparkSession, d: str) -> DataFrame:
    changed = R.align(X.page_revisions(spark, d)).where("text <> old_text")
    return changed.select("article_id", "revid", "tag", "idx", F.explode(R.diff_ops("old_text", "text")).alias("o")).select("article_id", "revid", "tag", "idx", "o.op", "o.text", "o.tokens")


@query()
def revision_diff(spark: SparkSession, d: str) -> DataFrame:
    return R.revision_diff(X.revisions(spark, d)).select("article_id", "revid", "user_name", F.explode("ops").alias("o")).select("article_id", "revid", "user_name", "o.op", "o.text", "o.tokens")


@query(f"WITH {X.REV}, {LAG} SELECT article_id, revid, md5(coalesce(prev_content, '')) AS old_md5, md5(coalesce(content, '')) AS new_md5 FROM lg WHERE content IS DISTINCT FROM prev_content")
def revision_diff_sides(spark: SparkSession, d: str) -> DataFrame:
    """Both whole texts of each diff as its runs give them back: kept and removed ones the old, kept and added ones the new."""
    return R.revision_diff(X.revisions(spark, d)).select("article_id", "revid", F.md5(R.side_of("ops", "-")).alias("old_md5"), F.md5(R.side_of("ops", "+")).alias("new_md5"))


@query()
def html_diff(spark: SparkSession, d: str) -> DataFrame:
    pages = X.page_revisions(spark, d).withColumn("user_name", F.concat(F.lit("user"), (F.col("revid") % 7).cast("string")))
    return R.html_diffs(pages)


@query()
def change_view(spark: SparkSession, d: str) -> DataFrame:
    pages = X.page_revisions(spark, d).withColumn("user_name", F.concat(F.lit("user"), (F.col("revid") % 7).cast("string")))
    asked = pages.groupBy("article_id").agg(F.max("revid").alias("rev_a"), F.min("revid").alias("rev_b")).withColumn("request", F.col("article_id"))
    return R.change_view(asked, R.html_diffs(pages, whole=False), pages)


@query(f"""WITH {X.PAGE_REV}, c AS (SELECT *, content IS DISTINCT FROM lag(content) OVER (PARTITION BY article_id ORDER BY ts, revid) AS changed FROM page_rev),
 req AS (SELECT article_id, max(revid) AS rev_a, min(revid) + 50 AS rev_b FROM page_rev GROUP BY article_id)
 SELECT r.article_id AS request, count(*) AS revisions, count(*) FILTER (c.changed) AS changed, arg_max(c.revid, (c.ts, c.revid)) AS last FROM req r JOIN page_rev a ON a.article_id = r.article_id AND a.revid = r.rev_a JOIN page_rev b ON b.article_id = r.article_id AND b.revid = r.rev_b
 JOIN c ON c.article_id = r.article_id AND c.ts BETWEEN least(a.ts, b.ts) AND greatest(a.ts, b.ts) GROUP BY r.article_id""")
def change_view_range(spark: SparkSession, d: str) -> DataFrame:
    """What a merged view goes over: the revisions between the times of two, the changed ones, and the last, whose page it marks."""
    pages = X.page_revisions(spark, d)
    changed = R.with_previous(pages).select("article_id", "revid", "ts", (~F.col("content").eqNullSafe(F.col("prev_content"))).alias("changed"))
    asked = pages.groupBy("article_id").agg(F.max("revid").alias("rev_a"), (F.min("revid") + 50).alias("rev_b")).withColumn("request", F.col("article_id"))
    n = lambda c: F.count_if(c) if c is not None else F.count(F.lit(1))
    return L.revision_range(changed, asked).groupBy("request").agg(n(None).alias("revisions"), n(F.col("changed")).alias("changed"), F.max_by("revid", F.struct("ts", "revid")).alias("last"))
