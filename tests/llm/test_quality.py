"""Quality by attention over passages: gradients by differences, scores by a plain version, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslink.llm import quality
from newslink.llm.common import sample_texts


def bags(rng, n=8):
    words = ["alpha", "Beta", "GAMMA", "d%%", "e", "12", "straße", "x.y"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def fitted():
    rng = random.Random(1)
    texts = bags(rng, 40)
    y = np.array([float("%%" in t[:8]) for t in texts])
    return quality.fit(texts, y, np.ones(40), 0.5, epochs=2), texts


def test_gradients(fitted):
    model, texts = fitted
    model.dense = {k: v.astype(np.float64) for k, v in model.dense.items()}
    model.vectors = model.vectors.astype(np.float64)
    p = quality.Passages(texts[:6])
    y, weight = np.array([1.0, 0, 1, 0, 1, 0]), np.array([1.0, 2, 1, 1, 0.5, 1])

    def loss():
        s, _ = model.scores(model.encode(model.inputs(p)), p.doc, 6)
        return float(-(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean())

    found, words, _ = quality.gradients(model, p, 6, y, weight)
    rng = np.random.default_rng(3)
    for name, g in found.items():
        for _ in range(6):
            at = tuple(rng.integers(0, k) for k in g.shape)
            old = model.dense[name][at]
            sides = []
            for step in (1e-5, -1e-5):
                model.dense[name][at] = old + step
                sides.append(loss())
            model.dense[name][at] = old
            assert math.isclose(g[at], (sides[0] - sides[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-7), name
    whole = np.zeros_like(model.vectors)
    np.add.at(whole, p.features, words[:, None, :])
    for row, col in [(int(f), 3) for f in p.features.ravel()[:6]]:
        old = model.vectors[row, col]
        sides = []
        for step in (1e-5, -1e-5):
            model.vectors[row, col] = old + step
            sides.append(loss())
        model.vectors[row, col] = old
        assert math.isclose(whole[row, col], (sides[0] - sides[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-7)


def test_scores_one_by_one(fitted, monkeypatch):
    """Each document alone, passage by passage, in plain loops; pieces and steps change nothing."""
    model, texts = fitted
    long = " ".join(texts) + "\n" + "word " * 500
    monkeypatch.setattr(quality, "PIECE", 400)
    monkeypatch.setattr(quality, "STEP_CHARS", 1000)
    rows = [*texts[:10], "", long, "x" * 3000]
    scores, counts, largest, at = quality.score_texts(model, rows)
    for text, score, count, top, where in zip(rows, scores, counts, largest, at, strict=True):
        encoded = []
        for piece in quality.pieces(text):
            tokens = piece.split()
            for k in range(0, len(tokens), quality.PASSAGE):
                p = quality.Passages([" ".join(tokens[k : k + quality.PASSAGE])])
                encoded.append(model.encode(model.inputs(p))[0])
        assert count == len(encoded)
        if not encoded:
            assert score == model.prior and where == -1
            continue
        e = [math.exp(float(np.tanh(h @ model.dense["V"]) * (1 / (1 + np.exp(-h @ model.dense["U"]))) @ model.dense["w"])) for h in encoded]
        z = sum(x / sum(e) * h for x, h in zip(e, encoded, strict=True))
        assert math.isclose(score, 1 / (1 + math.exp(-(z @ model.dense["c"] + model.dense["d"][0]))), abs_tol=1e-5)
        assert math.isclose(top, max(e) / sum(e), abs_tol=1e-5) and math.isclose(e[where], max(e), rel_tol=1e-5)


def test_pieces_lose_nothing(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 10)
    for text in ["", "a", "a b c d e f g h", "x" * 35, "ab\ncd ef\tgh " * 9]:
        assert "".join(quality.pieces(text)) == text and max(map(len, quality.pieces(text))) <= 10


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, quality int, score string, label string"
    docs = spark.createDataFrame([(2, None, 0, "a", "b"), (3, "", 0, "a", "b"), (6, " \n", 0, "a", "b"), (1, "one two", 0, "a", "b"), (7, "bad %% text", 0, "a", "b"), (None, "one", 0, "a", "b"), (4, "one", 0, "a", "b"), (4, "one", 0, "a", "b"), (5, "long " * 60_000, 0, "a", "b")], schema)
    none = spark.createDataFrame([(None, 1), (4, None)], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    assert [i for i in range(1, 8) if zlib.crc32(str(i).encode()) % 3 == 1] == [2, 3, 4, 5, 6]
    one = spark.createDataFrame([(i, 1) for i in range(1, 8)], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 8)], "doc_id bigint, quality int")
    rows = quality.quality(docs, both).orderBy("doc_id").collect()
    assert len(rows) == 9 and {r.score for r in rows if r.doc_id in (2, 3, 6)} == {0.5} and len({r.score for r in rows}) > 2
    assert len({(r.score, r.held_out) for r in rows if r.doc_id == 4}) == 1 and not rows[0].held_out
    assert quality.quality(docs.limit(0), both).collect() == []


def test_sample_keeps_every_label(spark):
    """One long text neither ends the sample of its label nor, if it is alone, loses the label."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.concat(F.lit("l"), (F.col("id") % 2).cast("string")).alias("label"))
    least = docs.where("label = 'l1'").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).first().doc_id
    docs = docs.withColumn("text", F.when(F.col("doc_id") == least, F.expr("repeat('x', 10000000)")).otherwise(F.col("text")))
    docs = docs.unionByName(spark.sql("select 1000L doc_id, repeat('y', 9000000) text, 'l2' label"))
    found = sample_texts(docs, docs.select("doc_id", "label"), 1000, 8_000_000)
    counts = {x: sum(r.label == x for r in found) for x in ("l0", "l1", "l2")}
    assert counts == {"l0": 200, "l1": 199, "l2": 1}
    bounded = sample_texts(docs, docs.select("doc_id", "label"), 1000, 100)
    assert sum(len(r.text) for r in bounded if r.label == "l0") <= 100 and {r.label for r in bounded} == {"l0", "l1", "l2"}
