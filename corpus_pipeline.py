"""From raw documents to token files: five stages, each written as Parquet before the next one reads it.

1. Language: documents without a language (no letters, or no language clearly ahead) go.
2. Near copies: one document of each group of linked shingle sets stays, the one with the least doc_id.
3. Decontamination: documents that hold a window of a benchmark item go.
4. Mixture: documents and token prefixes by target weights and seeded epochs.
5. Token output: Arrow files of equal-length sequences; the result has each document's place in them.

The token files stay when the session ends: below spark.newslink.output.dir if that is set, else in `outputs` below
spark.checkpoint.dir. The tables between the stages go.

Every stage but the last returns the columns of its documents. Null and empty texts go in stage 1, as they have no
language; repeated rows of a document that stays stay in stages 1 to 3 and are taken one by one in stage 4. Columns of other
names, also such as the operators use, pass through; texts of any length are read whole; without documents there is no row.

The model of stage 1 learns from the documents themselves, so no SQL gives the pipeline's rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newslink.llm import decontam, jaccard, langid, mixing, tokens
from newslink.llm.common import materialize, table
from newslink.sources.storage import discard, output_dir

#: A language is clear if its mean probability over the words is at least this much (an even share of four is 0.25).
CLEAR = 0.3
#: Near copies share at least this percentage of their shingles of so many words. op10_jaccard_join has its own values.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.learn(docs), CLEAR)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mixture(docs, weights=mixing.WEIGHTS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_output(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), output_dir(spark, "pipeline-tokens"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("decontaminate", drop_benchmark),
    ("mixture", mix_sources),
    ("token_output", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
