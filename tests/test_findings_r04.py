"""Each test fails on the code that the findings of round 4 were written on."""

import random
import time
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslink.operators import cosine, events, revisions, tfidf, titles, vectors


@pytest.mark.parametrize("most", [2, 30])
@pytest.mark.parametrize("room", [1 << 28, 50])
def test_long_edit_scripts_are_whole(monkeypatch, room, most):
    """beyond MOST edits the shortest script is still found, also where the sides are split and where it is traced first."""
    monkeypatch.setattr(revisions, "MOST", most)
    monkeypatch.setattr(revisions, "ROOM", room)
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 40))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = revisions._traced(a, b)
        assert sum(n for *_, n in found) == best[-1][-1]
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found) and all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(found, found[1:]))


def test_texts_without_anchors_keep_what_is_common():
    """3,000 words of two kinds on either side, over 500 edits, have no stretch that occurs once."""
    rng = random.Random(2)
    old, new = (" ".join(rng.choice(["a", "b"]) for _ in range(3000)) for _ in range(2))
    kept = sum(r["tokens"] for r in revisions.diff_tokens(old, new) if r["op"] == " ")
    assert kept > 4500


def test_marks_are_looked_for_from_where_they_stood():
    """the same few texts, marked again and again, are not searched for in all that was marked before."""
    page = revisions._Page.of("<p>" + " ".join(f"w{k}x" for k in range(200)) + "</p>")
    began = time.process_time()
    for k in range(20000):
        assert page.put("+", f"w{199 - k % 200}x", "u", "c") and not page.put("-", "wx", "u", "c")
    assert time.process_time() - began < 3
    again = revisions._Page.load(page.dump())
    assert again.parts == page.parts and again.html() == page.html() and page.html().count("<span") == 20000


@pytest.mark.parametrize("most", [32_000_000, 300])
def test_leaders_write_no_pairs(spark, monkeypatch, most):
    """50 articles of a day that are all alike have 1,225 pairs, none of which is in a table that is written."""
    rows, real = [], events.materialize
    monkeypatch.setattr(events, "materialize", lambda df, name, keep=False: (out := real(df, name, keep), rows.append((out.count(), name)))[0])
    monkeypatch.setattr(events, "GROUP_ARCS", most, raising=False)
    art = [(i, datetime(2024, 1, 1), "", f"Haus Baum Wald eins zwei drei vier sechs sieben acht neun zehn elf w{i}a") for i in range(50)] + [(50, datetime(2024, 1, 1), "", "Ganz Allein")]
    art = spark.createDataFrame(art, "id bigint, pubtime timestamp_ntz, head string, content string")
    led = {r.id: r.leader for r in events.leader_clusters(art, events.entity_weights(art).select("id", "entity", F.col("weight").cast("bigint")), 0.35, 3, vocabulary=None).collect()}
    assert led == dict.fromkeys(range(50), 0) and max(rows)[0] <= 51


@pytest.mark.parametrize("threshold", [0.6, 0.85])
@pytest.mark.parametrize("weights", [True, False])
def test_large_blocks_are_compared_by_rare_terms_first(spark, monkeypatch, threshold, weights):
    """all pairs are found, and only documents that may have a similar one are compared by all terms."""
    written, real = {}, cosine.materialize
    monkeypatch.setattr(cosine, "materialize", lambda df, name, keep=False: (out := real(df, name, keep), written.update({name: out}))[0])
    for name, value in (("CHUNK", 400), ("LEAST", 100), ("CELLS", 700)):
        monkeypatch.setattr(cosine, name, value)
    rng = random.Random(5)
    texts = [[f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(25)] for _ in range(150)]
    texts += [[w if rng.random() < 0.85 else f"x{k}" for w in texts[k % 30]] + ["w1"] * (k % 3) for k in range(60)]
    docs = [(f"b{i % 2}", i, " ".join(x)) for i, x in enumerate(texts)] + [("small", 900, "w1 w2 w3"), ("small", 901, "w1 w2 w3")]
    df = spark.createDataFrame(docs, "block string, id bigint, text string").repartition(5)
    w = tfidf.tfidf(tfidf.term_frequency(df))
    bags = {}
    for r in w.collect():
        bags.setdefault((r.block, r.id), {})[r.term] = r.w
    exact = {(a[0], a[1], b[1]): sum(x * bags[b].get(t, 0) for t, x in bags[a].items()) for a in bags for b in bags if a[0] == b[0] and a[1] < b[1]}
    found = tfidf.pairs_of(w, threshold, False) if weights else tfidf.similar_pairs(df, threshold, strict=False)
    got = {(r.block, r.i, r.j): r.sim for r in found.collect()}
    assert set(got) == {k for k, v in exact.items() if v >= threshold} and all(abs(got[k] - exact[k]) < 1e-9 for k in got) and len(got) > 5
    assert written["chosen"].selectExpr("sum(size(ids))").first()[0] < 180


@pytest.mark.parametrize("step", [2_000_000, 9])
def test_summaries_send_no_terms(spark, monkeypatch, step):
    """Terms are neither written nor shuffled as strings; sentences are chosen as by counting them, with ties and few terms."""
    written, real = [], titles.materialize
    for module in (titles, vectors):
        monkeypatch.setattr(module, "materialize", lambda df, name, keep=False: (out := real(df, name, keep), written.append(out))[0])
    monkeypatch.setattr(vectors, "STEP", step)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)] + ["a", "b"]
    members = [(f"c{k % 4}", k, ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(5))) for k in range(20)]
    members += [("few", 90, "a. b. c. w1 a."), ("none", 91, None), ("none", 92, "")]
    clusters = spark.createDataFrame([(c,) for c in ("c0", "c1", "c2", "c3", "few", "none")], "leader string")
    out = titles.summaries(clusters, spark.createDataFrame(members, "leader string, id bigint, content string").repartition(3), 3)
    got = {r.leader: r.summary for r in out.collect()}
    for leader in got:
        found = {s.strip() for c, _, text in members if c == leader for s in (text or "").replace(".", ".|").split("|") if s.strip()}
        terms = {s: {w for w in s.replace(".", "").split() if len(w) > 1} for s in found}
        often = Counter(w for x in terms.values() for w in x)
        best = sorted(found, key=lambda s: (-sum(often[w] for w in terms[s]), s))[:3]
        assert got[leader] == (" ".join(best) if found else titles.NO_SUMMARY), leader
    assert written and not any("term" in df.columns for df in written)


def test_many_small_rows_are_gathered(spark, monkeypatch):
    """a block of more than ROWS rows meets in rows of CHUNK postings, with the same pairs."""
    written, real = {}, cosine.materialize
    monkeypatch.setattr(cosine, "materialize", lambda df, name, keep=False: (out := real(df, name, keep), written.update({name: out}))[0])
    rng = random.Random(7)
    texts = [("b", i, " ".join(f"w{int(rng.expovariate(0.05))}a" for _ in range(30))) for i in range(120)]
    docs = spark.createDataFrame(texts, "block string, id bigint, text string").repartition(2)
    for name, value in (("LEAST", 100), ("CHUNK", 700)):
        monkeypatch.setattr(cosine, name, value)
    monkeypatch.setattr(vectors, "ROW", 100)
    found = []
    for most in (1000, 8):
        monkeypatch.setattr(cosine, "ROWS", most, raising=False)
        found.append({(r.i, r.j): round(r.sim, 9) for r in tfidf.similar_pairs(docs, 0.35).collect()})
    assert found[0] == found[1] and len(found[0]) > 100 and 1 < written["gathered"].count() < 10


@pytest.mark.parametrize("strict", [True, False])
def test_single_precision_decides_nothing(strict):
    """pairs at the threshold, or off it by less than single precision tells, are as in double precision."""
    n, threshold = 40, 0.5
    rng = np.random.default_rng(1)
    a = np.zeros((n, 60))
    a[:, 0] = np.sqrt(threshold) * (1 + rng.integers(-2, 3, n) * 1e-9)  # common to all
    a[np.arange(n), 1 + np.arange(n)] = np.sqrt(threshold)
    rows, terms = np.nonzero(a)
    part = cosine._Part(np.arange(n), rows, terms, a[rows, terms])
    exact = part.matrix(np.arange(60), 60) @ part.matrix(np.arange(60), 60).T
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if (exact[i, j] > threshold if strict else exact[i, j] >= threshold)}
    for sims in (True, False):
        got = {(int(i), int(j)) for x in cosine.similar(part, part, 60, threshold, strict, sims) for i, j in zip(x[0], x[1], strict=True)}
        assert got == want and 0 < len(want) < n * (n - 1) // 2
