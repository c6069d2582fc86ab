"""Registered queries: streams over the article and revision tables, run once over what is there; and the TSV scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslink.operators.revisions import side_of
from newslink.registry import query
from newslink.sources import fixtures as X
from newslink.sources import tsv
from newslink.streaming import streams
from newslink.sources.storage import materialize, shared_dir


def _stream(table: DataFrame, files: int | None = None) -> tuple[DataFrame, str]:
    """The table written as files and read as a stream, so many files a micro-batch; a path for the result."""
    stored = materialize(table, "stream")
    reader = table.sparkSession.readStream.schema(stored.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(stored.stored_at), shared_dir(table.sparkSession, "stream-out")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return X.articles(spark, d).select("id", F.col("pubtime").cast("timestamp").alias("pubtime"), "medium_name", "content_id")


@query(f"WITH {X.ART} SELECT DISTINCT content_id FROM art")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    source, path = _stream(_articles(spark, d).repartition(6, "id"), files=2)
    return streams.ingest_once(source, path, ["content_id"], ["id"]).select("content_id")


@query(f"WITH {X.ART} SELECT DISTINCT content_id FROM art")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    source, path = _stream(_articles(spark, d))
    return streams.run_once(streams.deduplicated(source, "10 days"), path).select("content_id")


@query(f"WITH {X.ART} SELECT strftime(pubtime, '%Y-%m-%d') AS day, medium_name, count(*) AS n FROM art WHERE CAST(pubtime AS DATE) + INTERVAL 1 DAY <= (SELECT max(pubtime) - INTERVAL 2 DAY FROM art) GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    source, path = _stream(_articles(spark, d))
    return streams.run_once(streams.daily_counts(source), path).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "medium_name", "n")


@query(f"WITH {X.REV}, lg AS (SELECT *, lag(content) OVER (PARTITION BY article_id ORDER BY ts, revid) AS prev FROM rev) SELECT article_id, revid FROM lg WHERE content IS DISTINCT FROM prev AND content <> coalesce(prev, '')")
def stream_revision_diff(spark: SparkSession, d: str) -> DataFrame:
    source, path = _stream(X.revisions(spark, d).select("article_id", "revid", "ts", "content"))
    return streams.run_once(streams.incremental_diffs(source), path).select("article_id", "revid")


@query(f"WITH {X.REV}, lg AS (SELECT *, lag(content) OVER (PARTITION BY article_id ORDER BY ts, revid) AS prev FROM rev) SELECT article_id, revid, user_name, md5(coalesce(prev, '')) AS old_md5, md5(content) AS new_md5 FROM lg WHERE content <> coalesce(prev, '')")
def stream_late_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revisions come in three micro-batches that have nothing to do with their times; both texts as each diff gives them back."""
    source, path = _stream(X.revisions(spark, d).repartition(6, "revid"), files=2)
    diffs = streams.history_diffs(source, path)
    return diffs.select("article_id", "revid", "user_name", F.md5(side_of("ops", "-")).alias("old_md5"), F.md5(side_of("ops", "+")).alias("new_md5"))


GAP = "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM revm WINDOW w AS (PARTITION BY article_id ORDER BY ts, revid)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY article_id ORDER BY ts, revid) AS run FROM g)"


@query(f"WITH {X.REVM}, {GAP} SELECT article_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS edits FROM s GROUP BY article_id, run HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM revm)")
def stream_edit_sessions(spark: SparkSession, d: str) -> DataFrame:
    log = X.revision_log(spark, d).select("article_id", "revid", F.col("ts").cast("timestamp").alias("ts"))
    source, path = _stream(log)
    return streams.run_once(streams.edit_sessions(source), path).select("article_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "edits")


@query(f"""WITH {X.REVM}, w AS (SELECT article_id, unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 50 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts), INTERVAL 10 MINUTE)) AS start FROM revm)
 SELECT article_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS edits FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM revm) GROUP BY ALL""")
def stream_edit_rate(spark: SparkSession, d: str) -> DataFrame:
    source, path = _stream(X.revision_log(spark, d).select("article_id", "revid", F.col("ts").cast("timestamp").alias("ts")))
    return streams.run_once(streams.edit_rate(source), path).select("article_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "edits")


@query("SELECT e.event_id, CASE WHEN event_type = 'view' THEN 'start' ELSE 'die' END AS action, 'c' || CAST(user_id AS VARCHAR) AS name FROM events e WHERE event_type IN ('view', 'error') AND event_id % 2 = 0 AND user_id IN (SELECT s_suppkey FROM supplier)")
def stream_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "view", "start").when(kind == "error", "die").otherwise("pause")
    log = X.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "container").otherwise("network").alias("type"), action.alias("action"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("name"))
    source, path = _stream(log)
    pending = X.read(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("name"))
    return streams.run_once(streams.lifecycle(source, pending), path).select("event_id", "action", "name")


@query(f"WITH {X.ART} SELECT id, medium_name, article_link, content_id FROM art")
def scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    art = X.articles(spark, d)
    folder = tsv.write_xz(art.select("id", F.date_format("pubtime", "yyyy-MM-dd HH:mm:ss").alias("pubtime"), F.lit("M").alias("medium_code"), "medium_name", "char_count", "head", "article_link", "content_id", "content"))
    return tsv.read_xz(spark, folder).select(F.col("id").cast("bigint").alias("id"), "medium_name", "article_link", "content_id")
