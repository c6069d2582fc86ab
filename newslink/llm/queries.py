"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newslink.llm import alignment, decontam, jaccard, langid, media, mixing, quality, runs, secrets, substrings, tokens, toxicity, urlfilter
from newslink.llm.common import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(table(spark, sf_dir, "documents")))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=mixing.WEIGHTS).drop("text_key", "row", "tokens")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(spark, table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(urlfilter.captures_of(pages), urlfilter.entries_of(pages))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), change=runs.repeated)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_toxicity, op3_mixture, op4_decontaminate, op5_token_ids, op6_secrets, op7_language_id, op8_substring_dedup, op9_url_filter, op10_jaccard_join, op11_periodic_runs, op12_quality, op13_token_alignment)}
ORACLES: dict[str, str] = {"op3_mixture": mixing.ORACLE, "op4_decontaminate": decontam.ORACLE, "op6_secrets": secrets.ORACLE, "op9_url_filter": urlfilter.ORACLE, "op10_jaccard_join": jaccard.ORACLE}
