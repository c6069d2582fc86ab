"""Language identification: a linear-chain conditional random field labels every word of code-switched text.

It learns from the documents' language as the label of all their words; the learned transitions let short foreign
passages keep their own language. A document's language is the one with the largest mean probability over its words,
its score that mean.

Null texts and texts without a letter are "und" with score 0. Documents without a language do not teach. Every row
gives one row (repeated rows the same one); null doc_ids count as not held out. If nothing can be learned from, all
documents are "und". Texts of any length are read whole, a long one in a step of its
own. Columns other than those named are not read. Empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslink.llm import crf
from newslink.llm.common import STEP_CHARS, give_back, held_out, pick, releasing, sample_texts, slices, texts_of

FEATURES = {"bits": 18, "prefixes": (2, 3), "suffixes": (2, 3), "grams": (2, 3)}
#: Documents of each language that the model is fitted on at most (chosen by a hash of doc_id).
MAX_ROWS = 400
#: Bytes of text that the sample of each language has at most (see sample_texts for longer texts).
MAX_BYTES = 8_000_000
UNKNOWN = "und"


def learn(docs: DataFrame, max_rows: int = MAX_ROWS, epochs: int = 4) -> crf.Model | None:
    """Fit on at most max_rows whole documents of each language that are not held out."""
    known = pick(docs, doc_id="bigint", lang="string").where("lang is not null").where(~held_out(F.col("doc_id")))
    found = sample_texts(docs, known.select("doc_id", F.col("lang").alias("label")), max_rows, MAX_BYTES)
    if not found:
        return None
    labels = sorted({r.label for r in found})
    batches = []
    for k in range(0, len(found), 64):
        part = found[k : k + 64]
        words = crf.Words([r.text for r in part], **FEATURES)
        gold = np.array([labels.index(r.label) for r in part])[words.doc]
        batches.append((words, gold, np.ones(len(gold), np.float32)))
    del found
    give_back()  # the driver holds the steps' arrays no longer than it must
    model = crf.train(batches, labels, FEATURES, epochs) if labels else None
    del batches
    give_back()
    return model


def predict(docs: DataFrame, model: crf.Model | None) -> DataFrame:
    """doc_id, text_key (a hash of the text), lang_pred, score and the number of words of each language."""

    @releasing
    def label(batches):
        for batch in slices(batches, "text", STEP_CHARS):
            texts = texts_of(batch.column("text"))
            langs, scores, switched = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            if model is not None:
                words = model.words(texts)
                if len(words.doc):
                    p = model.marginals(words)
                    sums = np.stack([np.bincount(words.doc, p[:, y], minlength=len(texts)) for y in range(len(model.labels))], axis=1)
                    some = words.per_doc > 0
                    best = sums.argmax(axis=1)
                    scores[some] = np.clip(sums.max(axis=1)[some] / words.per_doc[some], 0, 1)
                    langs = [model.labels[y] if s else UNKNOWN for y, s in zip(best, some, strict=True)]
                    switched = np.bincount(words.doc, p.argmax(axis=1) != best[words.doc], minlength=len(texts)).astype(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores), "n_switched": pa.array(switched)})

    return pick(docs, doc_id="bigint", text="string").mapInArrow(label, "doc_id bigint, lang_pred string, score double, n_switched bigint")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from docs, then label all of them."""
    return predict(docs, learn(docs)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "n_switched")


def keep_identified(docs: DataFrame, model: crf.Model | None, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with a score of at least `least`.

    Null texts and texts without a letter go, and all rows if there is no model; repeated rows go or stay together. Only
    texts are sent to Python, in steps of STEP_CHARS bytes; further columns of any name stay where they are.
    """

    @releasing
    def sure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            flags = []
            for batch in slices([pa.record_batch({"text": column})], "text", STEP_CHARS):
                clear = np.zeros(batch.num_rows, bool)
                words = model.words(texts_of(batch.column("text"))) if model is not None else None
                if words is not None and len(words.doc):
                    p = model.marginals(words)
                    sums = np.stack([np.bincount(words.doc, p[:, y], minlength=batch.num_rows) for y in range(len(model.labels))], axis=1)
                    clear = (words.per_doc > 0) & (sums.max(axis=1) >= least * words.per_doc)
                flags.append(clear)
            yield pa.array(np.concatenate(flags) if flags else np.zeros(0, bool))

    return docs.where(F.arrow_udf(sure, "boolean")(F.col("text").cast("string")))
