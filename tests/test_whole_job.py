"""Queries and operators do their whole job: every row and all of a text, against brute force in Python."""

import hashlib
import json
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from newslink import registry
from newslink.functions import scalars
from newslink.operators import dedup, graph, titles

SF = "/root/testdata/sf0.001"


def packed(text, words):
    """Words and text of each chunk."""
    out, last, filled = [], [], 0
    for s in filter(None, (x.strip(" ") for x in re.findall(r"[^.!?]+[.!?]*", text))):
        n = len(re.sub(r"[ \t\n\r]+", " ", s).strip(" ").split(" "))
        if last and filled + n > words:
            out.append((filled, " ".join(last)))
            last, filled = [], 0
        last, filled = [*last, s], filled + n
    return [*out, (filled, " ".join(last))] if last else out


def test_chunks_hold_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {(d.doc_id, k, *c) for d in docs for k, c in enumerate(packed(d.text, 1000))}
    assert {tuple(r) for r in registry.queries()["sentence_chunks"](spark, SF).collect()} == want
    long = " ".join(f"Satz {i} hat fünf Wörter." for i in range(60))
    rows = titles.chunks(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), "doc_id", 10).collect()
    assert len(rows) == 30 and " ".join(r.text for r in sorted(rows, key=lambda r: r.chunk)) == long


def test_gather_joins_every_piece(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = {r.doc_id: r for r in registry.queries()["chunk_join"](spark, SF).collect()}
    assert {d.doc_id: d.text for d in docs} == {k: r.joined for k, r in rows.items()}
    assert all(rows[d.doc_id].n == -(-len(d.text) // 1500) for d in docs)
    texts = [(1, "äbc" * 4000), (2, ""), (3, "x" * 1500)]
    got = {r.doc_id: (r.n, r.joined) for r in titles.gather(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", 1500).collect()}
    assert got == {1: (8, "äbc" * 4000), 2: (0, ""), 3: (1, "x" * 1500)}


def test_comments_are_skipped_in_all_events(spark):
    want = {(e.event_id, json.loads(e.props)["k"]) for e in spark.read.parquet(f"{SF}/events.parquet").collect()}
    got = [tuple(r) for r in registry.queries()["json_skip_comments"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and any(i % 2 for i, _ in got)


def slug_of(title):
    x = unquote(title or "")
    for a, b in zip("äöüÄÖÜß", ("ae", "oe", "ue", "Ae", "Oe", "Ue", "ss"), strict=True):
        x = x.replace(a, b)
    x = re.sub(r"[^a-zA-Z0-9_.-]", "-", x).strip("-").lower()
    return "container-" + hashlib.md5((title or "").encode()).hexdigest()[:8] if re.fullmatch("[0-9]*", x) else x


def test_slugs_of_all_whole_heads(spark):
    heads = {d.doc_id: re.match(r"[^\n.!?]*", d.text)[0] for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [tuple(r) for r in registry.queries()["slug"](spark, SF).collect()]
    assert len(got) == len(heads) and dict(got) == {k: slug_of(h) for k, h in heads.items()}
    titles = ["Z%C3%BCrich%20Stadt", "a%20b 100% c", "1+1", "%", "+", "%31%32", "", None, "x" * 90 + "%41", "50%zz%41"]
    rows = spark.createDataFrame(list(enumerate(titles)), "k int, t string").select("k", scalars.slug(F.col("t")).alias("s")).collect()
    assert [r.s for r in sorted(rows, key=lambda r: r.k)] == [slug_of(t) for t in titles]


def content_sims(texts):
    """Cosine similarities by sublinear tf over words and bigrams with bounds of df by the number of texts."""
    n, bags = len(texts), []
    for text in texts:
        w = [x for x in re.sub(r"[0-9]+", " ", re.sub(r"[^\w]", " ", text.lower())).split() if x not in scalars.STOP_WORDS and len(x) > 1]
        bags.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])] * (n > 3)))
    df = Counter(t for b in bags for t in b)
    low, high = (min(2, max(1, int(n * 0.1))), min(0.95, (n - 1) / n) * n) if n > 3 else (1, n)
    rows = [{t: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in b.items() if low <= df[t] <= high} for b in bags]
    norms = [math.sqrt(sum(x * x for x in r.values())) or 1 for r in rows]
    return [[sum(x * b.get(t, 0) for t, x in a.items()) / p / q for b, q in zip(rows, norms)] for a, p in zip(rows, norms)]


def brute_strict(times, texts, threshold):
    sims, order = content_sims(texts), sorted(range(len(texts)), key=lambda i: (-times[i].timestamp(), i))
    return {i for k, i in enumerate(order) if all(sims[i][j] < threshold for j in order[:k])}


def brute_reached(times, texts, threshold):
    sims = content_sims(texts)
    reached = todo = {min(range(len(texts)), key=lambda i: (-times[i].timestamp(), i))}
    while todo:
        todo = {i for i in range(len(texts)) if i not in reached and any(sims[i][j] < threshold for j in reached)}
        reached = reached | todo
    return reached


def test_content_is_compared_by_words_and_bigrams(spark):
    rng = random.Random(3)
    words = [f"wort{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(4)]
    shuffled = rng.sample(base[0], 40)
    for size in (3, 5, 26):
        texts = [" ".join(base[0]), " ".join(shuffled)]
        for _ in range(size - 2):
            copy = list(rng.choice(base))
            copy[rng.randrange(40)] = rng.choice(words)
            texts.append(" ".join(copy))
        times = [datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(9)) for _ in texts]
        art = spark.createDataFrame([(i, t, x, "g") for i, (t, x) in enumerate(zip(times, texts))], "id bigint, pubtime timestamp_ntz, content string, g string")
        for threshold in (0.5, 0.85):
            assert {r.id for r in dedup.by_content(art, ["g"], threshold).collect()} == brute_strict(times, texts, threshold)
            assert {r.id for r in dedup.by_reachability(art, ["g"], threshold).collect()} == brute_reached(times, texts, threshold)
    times, texts = [datetime(2024, 1, 1, h) for h in range(5)], [" ".join(base[0]), " ".join(shuffled), *(" ".join(b) for b in base[1:])]
    art = spark.createDataFrame([(i, t, x, "g") for i, (t, x) in enumerate(zip(times, texts))], "id bigint, pubtime timestamp_ntz, content string, g string")
    assert dedup.by_content(art, ["g"], 0.85).count() == 5


def test_copies_are_compared_once(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"wort{chr(97 + k)}" for k in range(26)]
    base = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)] + ["1 2", " "]
    texts = [rng.choice(base) for _ in range(40)]
    times = [datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(9)) for _ in texts]
    rows = [(i, t, x, "g") for i, (t, x) in enumerate(zip(times, texts, strict=True))]
    art = spark.createDataFrame(rows, "id bigint, pubtime timestamp_ntz, content string, g string")
    valid = [i for i, x in enumerate(texts) if x.strip()]
    blank, times, texts = set(range(40)) - set(valid), [times[i] for i in valid], [texts[i] for i in valid]
    for threshold in (0.4, 0.9):
        assert {r.id for r in dedup.by_content(art, ["g"], threshold).collect()} == blank | {valid[i] for i in brute_strict(times, texts, threshold)}
        assert {r.id for r in dedup.by_reachability(art, ["g"], threshold).collect()} == blank | {valid[i] for i in brute_reached(times, texts, threshold)}


def test_reachability_takes_many_rounds_over_different_texts(spark, monkeypatch):
    n = 24
    pairs = spark.createDataFrame([(i, j) for j in range(n) for i in range(j - 1)], "i bigint, j bigint")
    monkeypatch.setattr(dedup, "pairs_of", lambda *a, **k: pairs)
    rows = [(i, datetime(2024, 1, 2) - timedelta(minutes=i), f"text{chr(97 + i)}") for i in range(n)]
    assert dedup.by_reachability(spark.createDataFrame(rows, "id bigint, pubtime timestamp_ntz, content string"), [], 0.85).count() == n


def test_reachability_goes_on_until_nothing_is_added(spark, monkeypatch):
    n = 24
    pairs = spark.createDataFrame([(i, j) for j in range(n) for i in range(j - 1)], "i bigint, j bigint")
    monkeypatch.setattr(dedup, "pairs_of", lambda *a, **k: pairs)
    art = spark.createDataFrame([(i, datetime(2024, 1, 2) - timedelta(minutes=i), "text") for i in range(n)], "id bigint, pubtime timestamp_ntz, content string")
    assert dedup.by_reachability(art, [], 0.85).count() == n


def test_components_do_not_end_early(spark):
    with pytest.raises(RuntimeError, match="converge"):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a bigint, b bigint"), max_rounds=2)
