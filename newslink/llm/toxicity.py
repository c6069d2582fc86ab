"""Toxicity: a linear-chain conditional random field tags toxic words; their marginals make a document's score.

Only documents carry labels. Words are labelled from them first: a feature of words (a word or a prefix) is toxic if
it stands in several toxic training documents and next to none of the others; a word of a toxic document with such a
feature is labelled 1, all other words 0. The field learns from these words with affix and lexicon features, so that
unseen forms are tagged too. A document's score comes from the largest and the summed marginals of its words by a
logistic function that is fitted on training documents that the field has not seen.

Null and empty texts are scored like any text without words. Documents without a label do not teach. Rows that repeat
get equal values. If no document is labelled, or none of one kind, every score is the share of toxic labels (0 where
there is no label). Texts of any length are read whole, a long one in a step of its
own. Columns other than those named are not read. Empty tables give no row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslink.llm import crf
from newslink.llm.common import STEP_CHARS, held_out, mix, pick, releasing, sample_texts, slices, texts_of

FEATURES = {"bits": 18, "prefixes": (3, 4, 5, 6, 7), "suffixes": (3, 5), "grams": ()}
#: Labelled documents of each kind that the model is fitted on at most (chosen by a hash of doc_id).
MAX_ROWS = 2500
#: Bytes of text that the sample of each kind has at most (see sample_texts for longer texts).
MAX_BYTES = 50_000_000
#: A feature is toxic from so many toxic documents, and so many times as frequent in them as in the others.
LEAST_DOCS, LEAST_RATIO = 6, 30.0
SPAN = 0.5
#: Texts that the model learns from in one step.
TEXTS = 64


@dataclass
class Toxicity:
    field: crf.Model | None
    scale: np.ndarray  # of 1, largest marginal, log of summed marginals
    prior: float

    def of(self, texts: list[str]) -> tuple[np.ndarray, crf.Words | None, np.ndarray]:
        """Scores of texts, their words and each word's probability of being toxic."""
        if self.field is None:
            return np.full(len(texts), self.prior), None, np.zeros(0)
        words = self.field.words(texts)
        p = self.field.marginals(words)[:, 1]
        return 1 / (1 + np.exp(-_evidence(words, p) @ self.scale)), words, p


def _evidence(words: crf.Words, p: np.ndarray) -> np.ndarray:
    most = np.zeros(len(words.per_doc))
    np.maximum.at(most, words.doc, p)
    total = np.bincount(words.doc, p, minlength=len(most))
    return np.stack([np.ones(len(most)), most, np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, slightly ridged."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (p - y)) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = 6) -> Toxicity:
    """Fit on at most max_rows whole documents of each label that are not held out."""
    known = pick(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Toxicity(None, np.zeros(3), prior)
    found = sample_texts(docs, known.select("doc_id", F.col("toxic").alias("label")), max_rows, MAX_BYTES)
    found = [found[i] for i in _without_copies([r.text for r in found])]
    y = np.array([r.label for r in found], np.int64)
    if len(set(y.tolist())) < 2:
        return Toxicity(None, np.zeros(3), prior)
    # Every fourth document is left for the logistic function: on those it learned from, the field is too sure.
    for_field = np.arange(len(found)) % 4 != 3
    if min(len(set(y[part].tolist())) for part in (for_field, ~for_field)) < 2:
        for_field[:] = True
    own, y_own = [r.text for r, f in zip(found, for_field, strict=True) if f], y[for_field]
    batches = [crf.Words(own[k : k + TEXTS], **FEATURES) for k in range(0, len(own), TEXTS)]
    golds = _word_labels(batches, y_own)
    field = crf.train([(w, g, 1 + 4 * g.astype(np.float32)) for w, g in zip(batches, golds, strict=True)], [0, 1], FEATURES, epochs)
    rest = ~for_field if not for_field.all() else for_field
    texts, y = [r.text for r, f in zip(found, rest, strict=True) if f], y[rest]
    checks = [field.words(texts[k : k + TEXTS]) for k in range(0, len(texts), TEXTS)]
    evidence = np.concatenate([_evidence(w, field.marginals(w)[:, 1]) for w in checks])
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum()) * len(y)
    return Toxicity(field, _logistic(evidence, y, weight), prior)


def _without_copies(texts: list[str], hashes: int = 8, most: int = 3) -> list[int]:
    """Indices of texts that share at most `most` of their word sets' least hashes with an earlier one.

    Copies of one toxic text would make all its words look toxic.
    """
    seen: dict[tuple[int, int], int] = {}
    out = []
    for k in range(0, len(texts), TEXTS):
        words = crf.Words(texts[k : k + TEXTS], **FEATURES)
        ends = np.cumsum(words.per_doc)
        for d, (begin, end) in enumerate(zip(ends - words.per_doc, ends, strict=True)):
            own = words.keys[words.which[begin:end]]
            least = [(i, int(mix(own ^ np.uint64(i * 0x5851F42D4C957F2D & (1 << 64) - 1)).min())) for i in range(1, hashes + 1)] if len(own) else []
            shared = Counter(seen[x] for x in least if x in seen)
            if max(shared.values(), default=0) <= most:
                out.append(k + d)
                for x in least:
                    seen.setdefault(x, k + d)
    return out


def _word_labels(batches: list[crf.Words], y: np.ndarray) -> list[np.ndarray]:
    """Label 1 for words of toxic documents that have a toxic feature."""
    size = 1 << FEATURES["bits"]
    counts = np.zeros((2, size))
    for k, words in enumerate(batches):
        pair = np.unique(words.doc * len(words.keys) + words.which) if len(words.keys) else np.zeros(0, np.int64)
        doc, word = pair // max(1, len(words.keys)), pair % max(1, len(words.keys))
        n = np.diff(np.append(words.first, len(words.features)))[word]
        flat = words.features[np.repeat(words.first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        each = np.unique(np.repeat(doc, n) * size + flat)
        kind = y[TEXTS * k + each // size]
        for t in (0, 1):
            counts[t] += np.bincount(each[kind == t] % size, minlength=size)
    share = (counts[1] / max(1, (y == 1).sum())) / ((counts[0] + 0.5) / max(1, (y == 0).sum()))
    toxic = (counts[1] >= LEAST_DOCS) & (share >= LEAST_RATIO)
    out = []
    for k, words in enumerate(batches):
        own = np.bincount(words.owner, toxic[words.features], minlength=len(words.keys)) > 0
        out.append((own[words.which] & (y[TEXTS * k + words.doc] == 1)).astype(np.int64))
    return out


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score, and the toxic spans (start, end in code points, probability) of every text."""

    @releasing
    def tag(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in slices(batches, "text", STEP_CHARS):
            texts = texts_of(batch.column("text"))
            scores, words, p = model.of(texts)
            spans: list = [[] for _ in texts]
            if words is not None:
                at = np.flatnonzero(p >= SPAN)
                starts, ends = words.spans(at)
                for d, s, e, x in zip(words.doc[at].tolist(), starts.tolist(), ends.tolist(), p[at].tolist(), strict=True):
                    spans[d].append({"start": s, "end": e, "p": x})
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, kind)})

    return pick(docs, doc_id="bigint", text="string").mapInArrow(tag, "doc_id bigint, score double, spans array<struct<start: bigint, end: bigint, p: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Learn from the labelled documents that are not held out, then score all documents."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), F.coalesce(F.get("spans", F.lit(0))["start"], F.lit(-1).cast("bigint")).alias("first_offset"))
