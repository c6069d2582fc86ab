"""Event documents: clusters with their articles as JSON, and tables partitioned by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from newslink.sources.storage import materialize


ARTICLE = "STRUCT<article_id: BIGINT, cluster_id: STRING, pubtime: STRING, medium_name: STRING, head: STRING, article_link: STRING>"
CLUSTER = "STRUCT<cluster_id: STRING, wikipedia_article_names: ARRAY<STRING>, date: STRING, summary_text: STRING>"
DOCUMENT = f"artikel ARRAY<{ARTICLE}>, cluster ARRAY<{CLUSTER}>"


def members(clusters: DataFrame, art: DataFrame) -> DataFrame:
    """Articles with the cluster of their day and medium."""
    named = art.select(F.to_date("pubtime").alias("date"), "medium_name", F.col("id").alias("article_id"), "pubtime", "head", "article_link")
    return named.join(clusters.select("date", "medium_name", "cluster_id"), ["date", "medium_name"])


def to_documents(clusters: DataFrame, art: DataFrame) -> DataFrame:
    """One document for each cluster, so that no array grows with the day."""
    article = F.struct("article_id", "cluster_id", F.date_format("pubtime", "yyyy-MM-dd'T'HH:mm:ss").alias("pubtime"), "medium_name", "head", "article_link")
    nested = members(clusters, art).groupBy("cluster_id").agg(F.collect_list(article).alias("artikel"))
    head = F.struct("cluster_id", F.array("medium_name").alias("wikipedia_article_names"), F.col("date").cast("string").alias("date"), "summary_text")
    return clusters.join(nested, "cluster_id", "left").select(F.struct(F.coalesce("artikel", F.array().cast(f"ARRAY<{ARTICLE}>")).alias("artikel"), F.array(head).alias("cluster")).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Rows of article and cluster from documents (structs, or JSON text in column `json`); missing arrays are empty."""
    if "json" in documents.columns:
        documents = documents.select(F.from_json("json", DOCUMENT).alias("document"))
    cluster = documents.select("document.artikel", F.explode_outer("document.cluster").alias("c"))
    return cluster.select("c.cluster_id", "c.date", F.col("c.wikipedia_article_names").alias("titles"), "c.summary_text", F.explode_outer("artikel").alias("a")).select("cluster_id", "date", "titles", "summary_text", "a.article_id", "a.pubtime", "a.medium_name", "a.head", "a.article_link")


def replace_day(spark: SparkSession, clusters: DataFrame, day: str) -> DataFrame:
    """Write a table partitioned by date, write one day again with size 1, and read the table."""
    base = materialize(clusters.select("cluster_id", "size", F.col("date").cast("string").alias("date")), "day-source")
    path = base.inputFiles()[0].rsplit("/", 1)[0] + "-table"
    base.write.partitionBy("date").parquet(path)
    fresh = base.where(F.col("date") == day).withColumn("size", F.lit(1).cast("bigint"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return spark.read.schema("cluster_id string, size bigint, date string").parquet(path)
