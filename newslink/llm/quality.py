"""Quality: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE tokens (a longer text is cut into pieces of PIECE characters first, whose
passages start anew). Every passage is encoded: the mean of learned vectors of its tokens' hashed features (the token, its
ends, its kinds of characters) together with measures of the passage (shares of letters, capitals and signs, repeated
tokens, lengths) through one layer. Gated attention weighs the passages, w . (tanh(V h) * sigmoid(U h)), by a softmax over
the document; the weighted sum of the encodings gives the score by a logistic function. Only documents have labels: all of
it, attention included, is learned from them, by gradient steps in numpy on a bounded sample.

Passages of a long text are encoded piece by piece, and only their encodings are kept for the attention, so memory follows
PIECE, not the text. Null and empty texts have no passage and are scored with the share of label 1 among the labelled.
Documents without a label do not teach; a doc_id with several labels counts as its largest. If no document is labelled,
every score is 0.5; if all have one label, every score is that label. Rows that repeat get equal values. Null doc_ids count
as not held out. Further columns are not read. Empty tables give no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslink.llm.common import EDGE, LETTER, NUMBER, OTHER, SPACE, STEP_CHARS, CodePoints, SegmentHasher, held_out, lower_case, mix, pick, releasing, sample_texts, slices, texts_of

#: Tokens of a passage, and characters of a piece of a text.
PASSAGE, PIECE = 48, 200_000
#: Labelled documents of each kind that the model is fitted on at most (chosen by a hash of doc_id), and their bytes together.
MAX_ROWS, MAX_BYTES = 2500, 20_000_000
#: Tokens of a passage that is trusted by half.
SHORT = 6
BITS, WIDTH, HIDDEN, GATE = 15, 12, 24, 12
MEASURES = 11
#: Of every three doc_ids by crc32, the one kept from learning.
FOLDS, HELD = 3, 1


def pieces(text: str) -> list[str]:
    """A text in parts of PIECE characters, each cut after the last white space if there is any in its second half."""
    out = []
    while len(text) > PIECE:
        cut = max(text.rfind(c, PIECE // 2, PIECE) for c in " \n\t") + 1 or PIECE
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


class Passages:
    """The passages of several texts: their tokens' features and their measures."""

    def __init__(self, texts: list[str]):
        cp = CodePoints(texts)
        token = (cp.classes != SPACE) & (cp.classes != EDGE)
        padded = np.zeros(len(token) + 2, np.int8)
        padded[1:-1] = token
        step = np.diff(padded)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        doc = np.searchsorted(cp.ends, starts, side="right")
        per_doc = np.bincount(doc, minlength=len(texts))
        place = np.arange(len(starts)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        new = np.ones(len(starts), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] % PASSAGE == 0)
        self.first = np.flatnonzero(new)
        self.passage = np.cumsum(new) - 1
        self.doc = doc[self.first]
        self.size = np.diff(np.append(self.first, len(starts)))
        self.trust = (self.size / (self.size + SHORT)).astype(np.float32)
        lowered = lower_case()[cp.points]
        upper = lowered != cp.points
        of = lambda flags: (lambda s: (s[ends] - s[starts]).astype(np.float32))(np.append(0, np.cumsum(flags)))
        length = (ends - starts).astype(np.float32)
        kinds = [of(cp.classes == LETTER), of(upper), of(cp.classes == NUMBER), of(cp.classes == OTHER)]
        hasher = SegmentHasher(lowered)
        keys = hasher.of(starts, ends)
        shape = np.minimum(length, 12).astype(np.uint64)
        for n in kinds:
            shape = shape << np.uint64(2) | np.where(n == 0, 0, np.where(n == length, 2, 1)).astype(np.uint64)
        exact = mix(keys ^ mix(shape))  # the token as written, so that one has one shape
        self.keys, at, self.which = np.unique(exact, return_index=True, return_inverse=True)
        s, e = starts[at], ends[at]
        features = [keys[at], mix(hasher.of(s, np.minimum(s + 3, e)) + np.uint64(1)), mix(hasher.of(np.maximum(e - 3, s), e) + np.uint64(2)), mix(shape[at] + np.uint64(3))]
        self.features = (mix(np.stack(features, axis=1)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        self.measures = self._measures(length, kinds, cp.classes[ends - 1] == OTHER, exact)

    def _measures(self, length: np.ndarray, kinds: list[np.ndarray], signed: np.ndarray, exact: np.ndarray) -> np.ndarray:
        if not len(self.first):
            return np.zeros((0, MEASURES), np.float32)
        total = lambda x: np.add.reduceat(x.astype(np.float32), self.first)
        again = np.zeros(len(exact), bool)
        again[1:] = (exact[1:] == exact[:-1]) & (self.passage[1:] == self.passage[:-1])
        different = np.bincount(np.unique(self.passage * np.int64(len(self.keys)) + self.which) // len(self.keys), minlength=len(self.first))
        chars, n = total(length), self.size.astype(np.float32)
        letters, capitals, numbers, signs = (total(k) for k in kinds)
        columns = [letters / chars, capitals / np.maximum(letters, 1), numbers / chars, signs / chars, chars / n / 8, total(again) / n, different / n, total(signed) / n, total(kinds[0] == 0) / n, n / PASSAGE, total(kinds[1] == length) / n]
        return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray  # of hashed features
    dense: dict[str, np.ndarray]
    prior: float
    usual: np.ndarray  # mean and deviation of each measure

    def inputs(self, p: Passages) -> np.ndarray:
        """For each passage the mean vector of its tokens and the deviations of its measures, less of either in short ones."""
        if not len(p.first):
            return np.zeros((0, WIDTH + MEASURES), np.float32)
        words = self.vectors[p.features].mean(axis=1)
        both = np.concatenate([np.add.reduceat(words[p.which], p.first, axis=0) / p.size[:, None], (p.measures - self.usual[0]) / self.usual[1]], axis=1)
        return both * p.trust[:, None]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.dense["W"] + self.dense["b"])

    def attend(self, h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Attention of each passage within its document (in order), the gates, and the weighted encoding of each document."""
        t, g = np.tanh(h @ self.dense["V"]), 1 / (1 + np.exp(-h @ self.dense["U"]))
        s = (t * g) @ self.dense["w"]
        most = np.full(docs, -np.inf, s.dtype)
        np.maximum.at(most, doc, s)
        a = np.exp(s - most[doc])
        a /= np.bincount(doc, a, minlength=docs)[doc]
        z = np.stack([np.bincount(doc, a * h[:, i], minlength=docs) for i in range(h.shape[1])], axis=1)
        return a, t, g, z

    def scores(self, h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        a, _, _, z = self.attend(h, doc, docs)
        score = 1 / (1 + np.exp(-(z @ self.dense["c"] + self.dense["d"][0])))
        return np.where(np.bincount(doc, minlength=docs) > 0, score, self.prior), a


def gradients(model: Model, p: Passages, docs: int, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the weighted log loss: of the dense parameters, and of the vectors of each different token."""
    m = model.dense
    x = model.inputs(p)
    h = model.encode(x)
    a, t, g, z = model.attend(h, p.doc, docs)
    score = 1 / (1 + np.exp(-(z @ m["c"] + m["d"][0])))
    some = np.bincount(p.doc, minlength=docs) > 0
    error = np.where(some, weight * (score - y), 0) / max(1, some.sum())
    out = {"c": z.T @ error, "d": np.array([error.sum()])}
    dz = (error[:, None] * m["c"])[p.doc]
    da = (h * dz).sum(axis=1)
    ds = a * (da - np.bincount(p.doc, a * da, minlength=docs)[p.doc])
    out["w"] = (t * g).T @ ds
    gated = ds[:, None] * m["w"]
    dt, dg = gated * g * (1 - t * t), gated * t * g * (1 - g)
    out["V"], out["U"] = h.T @ dt, h.T @ dg
    du = (a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    out["W"], out["b"] = x.T @ du, du.sum(axis=0)
    de = (du @ m["W"].T)[:, :WIDTH] * (p.trust / p.size)[:, None]
    words = np.stack([np.bincount(p.which, de[p.passage, i], minlength=len(p.keys)) for i in range(WIDTH)], axis=1) / p.features.shape[1]
    return out, words, score


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, prior: float, epochs: int = 12, rate: float = 0.02, seed: int = 7) -> Model:
    """Steps of 32 documents: Adam for the dense parameters, AdaGrad for the vectors."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    dense = {"W": small(WIDTH + MEASURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": small(HIDDEN, GATE), "U": small(HIDDEN, GATE), "w": small(GATE), "c": small(HIDDEN), "d": np.array([np.log(prior / (1 - prior))], np.float32)}
    squares = np.full((1 << BITS, WIDTH), 1e-6, np.float32)
    first, second = ({k: np.zeros(v.shape) for k, v in dense.items()} for _ in range(2))
    steps = []
    for k in range(0, len(texts), 32):
        parts = [(i, piece) for i, t in enumerate(texts[k : k + 32]) for piece in pieces(t)]
        p = Passages([piece for _, piece in parts])
        p.doc = np.array([i for i, _ in parts])[p.doc]
        steps.append((p, len(texts[k : k + 32]), y[k : k + 32], weight[k : k + 32]))
    measures = np.concatenate([p.measures for p, *_ in steps])
    usual = np.stack([measures.mean(axis=0), measures.std(axis=0) + 1e-2]) if len(measures) else np.stack([np.zeros(MEASURES), np.ones(MEASURES)])
    model = Model((rng.standard_normal((1 << BITS, WIDTH)) * 0.05).astype(np.float32), dense, prior, usual.astype(np.float32))
    n = 0
    for _ in range(epochs):
        for at in rng.permutation(len(steps)):
            p, docs, gold, own = steps[at]
            if not len(p.first):
                continue
            n += 1
            found, words, _ = gradients(model, p, docs, gold, own)
            for k, g in found.items():
                g = g + 1e-4 * dense[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                dense[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
            for i in range(WIDTH):
                g = np.bincount(p.features.ravel(), np.repeat(words[:, i], p.features.shape[1]), minlength=1 << BITS).astype(np.float32)
                squares[:, i] += g * g
                model.vectors[:, i] -= 0.05 * g / np.sqrt(squares[:, i])
    return model


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | float:
    """A model fitted on at most max_rows whole documents of each label that are not held out, or the only score there is."""
    known = pick(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"), FOLDS, HELD))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if len(sizes) < 2:
        return prior
    found = sample_texts(docs, known, max_rows, MAX_BYTES)
    y = np.array([r.label for r in found], np.float64)
    if len(set(y.tolist())) < 2:
        return prior
    # Both kinds count as much as among all labelled documents, not as much as in the sample.
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return fit([r.text for r in found], y, weight, prior)


def score_texts(model: Model | float, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts; of each the number of passages, the largest attention and its passage (-1: none)."""
    n = len(texts)
    none = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1)
    if not isinstance(model, Model):
        return np.full(n, float(model)), *none
    codes, owners, step, size = [], [], [], 0
    parts = [(i, piece) for i, t in enumerate(texts) for piece in pieces(t)]
    for k, (i, piece) in enumerate(parts):
        step.append((i, piece))
        size += len(piece)
        if size >= STEP_CHARS or k + 1 == len(parts):
            p = Passages([x for _, x in step])
            codes.append(model.encode(model.inputs(p)))
            owners.append(np.array([x for x, _ in step])[p.doc])
            step, size = [], 0
    h, doc = np.concatenate(codes), np.concatenate(owners)
    score, a = model.scores(h, doc, n)
    count = np.bincount(doc, minlength=n)
    order = np.lexsort((np.arange(len(a)), -a, doc))
    top = order[np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1]))] if len(a) else order
    largest, at = none[1], none[2]
    largest[doc[top]], at[doc[top]] = a[top], top - (np.cumsum(count) - count)[doc[top]]
    return score, count, largest, at


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score, number of passages, largest attention weight and its passage."""

    @releasing
    def step(batches):
        for batch in slices(batches, "text", STEP_CHARS):
            values, count, largest, at = score_texts(model, texts_of(batch.column("text")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(values, pa.float64()), "n_passages": pa.array(count, pa.int64()), "attention": pa.array(largest, pa.float64()), "passage": pa.array(at, pa.int64())})

    return pick(docs, doc_id="bigint", text="string").mapInArrow(step, "doc_id bigint, score double, n_passages bigint, attention double, passage bigint")


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Learn from the labelled documents that are not held out, then score all documents."""
    return score(docs, learn(docs, labels)).select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_passages", "attention", "passage")
