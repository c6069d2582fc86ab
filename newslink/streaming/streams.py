"""Structured Streaming versions of ingest, counts and diffs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newslink.operators.revisions import OPS, OPS_TYPE, diff_ops, diff_tokens, with_previous
from newslink.sources.keyed import append_new, read_buckets, read_keyed, write_batch
from newslink.sources.storage import materialize, scratch


def deduplicated(articles: DataFrame, delay: str = "2 days") -> DataFrame:
    """A stream of articles without repeated content ids within the watermark."""
    return articles.withWatermark("pubtime", delay).dropDuplicatesWithinWatermark(["content_id"])


def ingest_once(articles: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 16) -> DataFrame:
    """Append what is there now to the table at path but for keys that it has; of repeated keys the first in order.

    The table lies in buckets of the keys: each micro-batch is compared with the buckets that it touches (insert-ignore)
    and has folders of its own, which are written again if the batch is: a restart neither loses nor doubles rows.
    """
    spark: SparkSession = articles.sparkSession
    schema = articles.schema

    def add(batch: DataFrame, number: int) -> None:
        append_new(path, batch, number, keys, order, buckets)

    articles.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return read_keyed(spark, path, schema)


def edit_rate(log: DataFrame, width: str = "1 hour", step: str = "10 minutes", delay: str = "1 day") -> DataFrame:
    """Edits of each article in sliding windows; a window is given once the watermark has passed its end."""
    return log.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "article_id").agg(F.count(F.lit(1)).alias("edits"))


def daily_counts(articles: DataFrame, delay: str = "2 days") -> DataFrame:
    """Articles for each day and medium; a day is given once the watermark has passed its end, and then forgotten."""
    return articles.withWatermark("pubtime", delay).groupBy(F.window("pubtime", "1 day"), "medium_name").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "medium_name", "n")


def edit_sessions(log: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Runs of edits of an article without a gap; a run is given once the watermark has passed its end, and then forgotten."""
    return log.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "article_id").agg(F.count(F.lit(1)).alias("edits"))


def lifecycle(events: DataFrame, pending: DataFrame) -> DataFrame:
    """Starts and ends of containers that a static table waits for."""
    return events.where("type = 'container' and action in ('start', 'die')").join(pending, "name")


def incremental_diffs(revisions: DataFrame) -> DataFrame:
    """Token changes of each new revision against the article's last content, which is kept as state.

    For revisions that come in order: a late one is compared with what came before it. See history_diffs for any order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "revid"])
        last = state.get[0] if state.exists else ""
        out = []
        for revid, content in zip(rows["revid"], rows["content"], strict=True):
            if content != last:
                out.append((key[0], revid, diff_tokens(last, content)))
            last = content
        state.update((last,))
        yield pd.DataFrame(out, columns=["article_id", "revid", "ops"])

    return revisions.groupBy("article_id").applyInPandasWithState(step, f"article_id bigint, revid bigint, ops {OPS}", "content string", "append", GroupStateTimeout.NoTimeout)


def history_diffs(revisions: DataFrame, path: str, buckets: int = 16) -> DataFrame:
    """(article_id, revid, user_name, ops) of every changed revision against its predecessor, in whatever order they came.

    revisions(article_id, revid, ts, user_name, content) is a stream; what is there now is added to the tables below path:
    `revisions`, of which the first of each (article_id, revid) counts, and `diffs`, both in buckets of the article. A batch
    reads the ids of the buckets that it touches, and the contents of those revisions only that are new or follow a new one.
    So a late revision is compared with its predecessor and its successor is compared again; no content is held as
    state. A revision's diff is the one of the last batch that made one. Each batch has folders of its own, so a restart
    changes nothing. Revisions without an article or an id belong to no history and are left out; null contents are empty.
    """
    spark: SparkSession = revisions.sparkSession
    columns = revisions.select("article_id", "revid", "ts", "user_name", "content")

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.where("article_id is not null and revid is not null").withColumn("content", F.coalesce("content", F.lit("")))
        touched = append_new(f"{path}/revisions", batch, number, ["article_id", "revid"], ["ts", "content"], buckets, ["article_id"])
        if not touched:
            return
        with scratch():
            write_batch(f"{path}/diffs", _new_diffs(read_buckets(batch, f"{path}/revisions", touched), number), number, ["article_id"], buckets)

    columns.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    made = read_keyed(spark, f"{path}/diffs", columns.select("article_id", "revid", "user_name").schema.add("ops", OPS_TYPE).add("batch", T.LongType()))
    last = made.groupBy("article_id", "revid").agg(F.max("batch").alias("batch"))
    return made.join(last, ["article_id", "revid", "batch"]).where(F.size("ops") > 0).select("article_id", "revid", "user_name", "ops")


def _new_diffs(stored: DataFrame, number: int) -> DataFrame:
    """Diffs of a batch's revisions and of those that follow one of them; an unchanged revision has a diff without runs."""
    order = with_previous(stored.select("article_id", "revid", "ts", "batch", F.lit("").alias("content"))).select("article_id", "revid", "prev_revid", "batch")
    order = materialize(order, "order")
    fresh = order.where(F.col("batch") == number).select("article_id", F.col("revid").alias("prev_revid"))
    due = order.where(F.col("batch") == number).unionByName(order.where(F.col("batch") != number).join(fresh, ["article_id", "prev_revid"], "left_semi"))
    old = stored.select("article_id", F.col("revid").alias("prev_revid"), F.col("content").alias("prev_content"))
    pairs = due.drop("batch").join(stored.select("article_id", "revid", "user_name", "content"), ["article_id", "revid"]).join(old, ["article_id", "prev_revid"], "left")
    changed = F.coalesce("prev_content", F.lit("")) != F.col("content")
    pairs = pairs.repartition("article_id", "revid").select("article_id", "revid", "user_name", F.when(changed, F.col("prev_content")).alias("old"), F.when(changed, F.col("content")).alias("new"))
    return pairs.select("article_id", "revid", "user_name", diff_ops("old", "new").alias("ops"))


def run_once(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet table at path (with its checkpoint beside it) and read it."""
    spark: SparkSession = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
