"""Registered queries: deduplication, terms and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslink.functions.scalars import STOP_WORDS, normalise_text
from newslink.operators import dedup, tfidf
from newslink.registry import query
from newslink.sources import fixtures as X

STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def tf_cte(source: str, block: str, ident: str, text: str) -> str:
    return f"""tok AS (SELECT {block} AS block, {ident} AS id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source}),
 tf AS (SELECT block, id, term, count(*) AS tf FROM tok WHERE term NOT IN {STOPS} GROUP BY ALL)"""


W_CTE = """nd AS (SELECT block, count(DISTINCT id) AS n FROM tf GROUP BY block), dfr AS (SELECT block, term, count(*) AS df FROM tf GROUP BY ALL),
 raw AS (SELECT block, id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS r FROM tf JOIN dfr USING (block, term) JOIN nd USING (block)),
 w AS (SELECT block, id, term, r / sqrt(sum(r * r) OVER (PARTITION BY block, id)) AS w FROM raw)"""


def sims_cte(least: str) -> str:
    return f"sims AS (SELECT a.block, a.id AS i, b.id AS j, sum(a.w * b.w) AS sim FROM w a JOIN w b ON a.block = b.block AND a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) {least})"


def content_cte(source: str, block: str) -> str:
    """Weights w of whole contents: sublinear tf of words and bigrams, with df bounded by the block's size n."""
    words = f"list_filter(string_split_regex(regexp_replace(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), '[0-9]+', ' ', 'g'), ' +'), lambda x: length(x) > 1 AND x NOT IN {STOPS})"
    return f"""cs AS MATERIALIZED (SELECT block, id, n, {words} AS w FROM (SELECT {block} AS block, id, content, count(*) OVER (PARTITION BY {block}) AS n FROM {source} WHERE trim(content) <> '')),
 tm AS (SELECT block, id, n, unnest(w) AS term FROM cs UNION ALL SELECT block, id, n, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM cs WHERE n > 3 AND len(w) > 1)),
 tf AS MATERIALIZED (SELECT block, id, n, term, count(*) AS tf FROM tm GROUP BY ALL), dfr AS (SELECT block, n, term, count(*) AS df FROM tf GROUP BY ALL),
 voc AS (SELECT block, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfr WHERE n <= 3 OR df BETWEEN least(2, greatest(1, n // 10)) AND least(0.95, (n - 1) / n) * n),
 raw AS (SELECT block, id, term, (1 + ln(tf)) * idf AS r FROM tf JOIN voc USING (block, term)),
 w AS MATERIALIZED (SELECT block, id, term, r / sqrt(sum(r * r) OVER (PARTITION BY block, id)) AS w FROM raw)"""


SEG = "string_split(trim(regexp_replace(regexp_replace(article_link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/'), '/')[-1]"
NEW = "ORDER BY pubtime DESC NULLS LAST, id"
KEY = "(SELECT array_to_string(p[:-2], '/') || '/' || regexp_replace(p[-1], '(-[0-9]+)+$', '') FROM (SELECT list_filter(string_split(trim({0}, '/'), '/'), lambda x: x <> 'preview') AS p))"


@query(f"WITH {X.ART} SELECT id, content_id FROM art QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY id DESC) = 1")
def dedup_content_id(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_content_id(X.articles(spark, d)).select("id", "content_id")


@query(f"WITH {X.ART} SELECT id, head, article_link FROM art QUALIFY row_number() OVER (PARTITION BY head, article_link ORDER BY id DESC) = 1")
def dedup_head_link(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_head_and_link(X.articles(spark, d)).select("id", "head", "article_link")


@query(f"WITH {X.ART} SELECT id FROM art QUALIFY row_number() OVER (PARTITION BY coalesce(nullif({SEG}, ''), 'row:' || CAST(id AS VARCHAR)) {NEW}) = 1")
def dedup_url_segment(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_url_segment(X.articles(spark, d), F.col("article_link")).select("id")


@query(f"WITH {X.ART_V} SELECT id FROM art_v QUALIFY row_number() OVER (PARTITION BY base_link, head, {KEY.format('url')} {NEW}) = 1")
def dedup_versions(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_version(X.version_articles(spark, d), F.col("url")).select("id")


NEWER = "(SELECT s.block, CASE WHEN a.pubtime > b.pubtime OR (a.pubtime = b.pubtime AND s.i < s.j) THEN s.j ELSE s.i END AS older FROM sims s JOIN art a ON a.id = s.i JOIN art b ON b.id = s.j)"


@query(f"WITH {X.ART_ONCE}, {content_cte('art', 'medium_name')}, {sims_cte('>= 0.85')} SELECT id FROM art WHERE id NOT IN (SELECT older FROM {NEWER})")
def content_dedup_strict(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_content(X.articles(spark, d), ["medium_name"], 0.85).select("id")


@query(f"WITH {X.ART_ONCE}, {content_cte('art', 'CAST(pubtime AS DATE)')}, {sims_cte('>= 0.85')} SELECT id FROM art WHERE id NOT IN (SELECT older FROM {NEWER})")
def content_dedup_per_day(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_content(X.articles(spark, d).withColumn("day", F.to_date("pubtime")), ["day"], 0.85).select("id")


@query(f"""WITH RECURSIVE {X.ART}, {content_cte('art', 'medium_name')}, {sims_cte('>= 0.85')},
 near AS (SELECT i, j FROM sims UNION ALL SELECT j, i FROM sims),
 reach AS (SELECT medium_name, id FROM (SELECT medium_name, id, row_number() OVER (PARTITION BY medium_name {NEW}) AS k FROM art) WHERE k = 1
  UNION SELECT a.medium_name, a.id FROM reach r JOIN art a ON a.medium_name = r.medium_name AND a.id <> r.id WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.i = r.id AND near.j = a.id))
 SELECT id FROM reach""")
def content_dedup_ref(spark: SparkSession, d: str) -> DataFrame:
    return dedup.by_reachability(X.articles(spark, d), ["medium_name"], 0.85).select("id")


@query(f"""WITH {X.ART}, s1 AS (SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY id DESC) = 1),
 s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY head, article_link ORDER BY id DESC) = 1),
 s3 AS (SELECT * FROM s2 WHERE article_link IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coalesce(nullif({SEG}, ''), 'row:' || CAST(id AS VARCHAR)) {NEW}) = 1),
 s3b AS (SELECT * FROM s2 WHERE article_link IS NULL QUALIFY row_number() OVER (PARTITION BY coalesce(head, CAST(id AS VARCHAR)) {NEW}) = 1),
 s4 AS (SELECT * FROM s3 QUALIFY row_number() OVER (PARTITION BY regexp_extract(article_link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), head, {KEY.format('article_link')} {NEW}) = 1),
 al AS (SELECT *, regexp_extract(article_link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) || '|' || head AS grp FROM s4 UNION ALL SELECT *, '|' || head FROM s3b),
 {content_cte('al', 'grp')}, {sims_cte('>= 0.98')} SELECT id FROM al WHERE id NOT IN (SELECT older FROM {NEWER})""")
def dedup_articles(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_articles(X.articles(spark, d)).select("id")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return X.articles(spark, d).select("id", F.date_format("pubtime", "yyyy-MM-dd").alias("block"), F.col("content").alias("text"))


TF = f"WITH {X.ART}, {tf_cte('art', chr(39).join(['strftime(pubtime, ', '%Y-%m-%d', ')']), 'id', 'content')}"


@query(f"{TF} SELECT block, id, term, tf FROM tf")
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_frequency(_blocks(spark, d))


@query(f"WITH {X.ART}, ws AS (SELECT id, strftime(pubtime, '%Y-%m-%d') AS block, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {STOPS}) AS w FROM art), p AS (SELECT id, block, w, unnest(generate_series(1, len(w) - 1)) AS i FROM ws) SELECT block, id, w[i] || ' ' || w[i + 1] AS term, count(*) AS tf FROM p GROUP BY ALL")
def bigram_freq(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.bigram_frequency(_blocks(spark, d))


@query(f"{TF}, t AS (SELECT block, term, CAST(sum(tf) AS BIGINT) AS frequency, count(*) AS df FROM tf GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY block ORDER BY frequency DESC, term) AS BIGINT) AS rank FROM t QUALIFY rank <= 5000")
def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.top_terms(tfidf.term_frequency(_blocks(spark, d)), 5000).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"{TF}, {W_CTE} SELECT block, id, term, round(w, 5) AS w FROM w", name="tfidf")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    # Not written: cut again from the texts, a document's terms are together where its weights are made.
    return tfidf.tfidf(tfidf.term_frequency(_blocks(spark, d))).withColumn("w", F.round("w", 5))


@query(f"{TF}, {W_CTE}, {sims_cte('> 0.35')} SELECT block, i, j, round(sim, 4) AS sim FROM sims")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.similar_pairs(_blocks(spark, d), 0.35).withColumn("sim", F.round("sim", 4))


@query(f"WITH t AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), '[0-9]+', ' ', 'g'), ' +') AS w FROM documents) SELECT doc_id, array_to_string(list_filter(w, lambda x: x <> '' AND x NOT IN {STOPS}), ' ') AS text FROM t")
def preprocess_text(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents").select("doc_id", normalise_text(F.col("text")).alias("text"))
