"""Periodic runs against a scan of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from newslink.llm import runs


def plain(words):
    """(start, length, period) of every run, by looking at each period from small to large."""
    n, spans, out = len(words), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(6, 4 * q) and (start, end) not in spans:
                spans.add((start, end))
                out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sample(rng):
    kind, n = rng.randrange(6), rng.randint(0, 300)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:
        return fibonacci(n + 1)
    if kind == 2:
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 60))]
        return [9] * rng.randint(0, 5) + (unit * 20)[:n] + [rng.randint(0, 3) for _ in range(20)]
    if kind == 3:
        m = rng.randint(1, 60)
        return (([1] * m + [2]) * 12)[rng.randint(0, m) : n]
    if kind == 4:
        unit = ([1] * rng.randint(1, 30) + [2]) * rng.randint(1, 7) + [3] * rng.randint(0, 4)
        return (unit * 8)[rng.randint(0, 9) : n + 200]
    out = []
    for _ in range(12):
        out += [rng.randint(0, 3) for _ in range(rng.randint(1, 12))] * rng.randint(1, 7)
    return out * rng.randint(1, 5)


def test_all_runs():
    rng = random.Random(5)
    for _ in range(60):
        texts = [sample(rng) for _ in range(rng.randint(1, 8))]
        assert runs.find_runs([np.array(t, dtype=np.int64) for t in texts]) == [plain(t) for t in texts]


def test_equal_hashes_of_different_words(monkeypatch):
    """A hash that calls all stretches of a length alike: the exact comparison must undo what bisection claims."""

    class Blind(runs.SegmentHasher):
        def of(self, starts, ends):
            return (ends - starts).astype(np.uint64)

    rng = random.Random(6)
    monkeypatch.setattr(runs, "SegmentHasher", Blind)
    for _ in range(20):
        text = [rng.randint(0, 5) for _ in range(80)]
        found = runs.find_runs([np.array(text)])[0]
        assert set(found) <= set(plain(text))


@pytest.mark.parametrize("big", [[0] * 300_000, ([1] * 30_000 + [2]) * 8, [1] * 29 + [2]])
def test_long_texts(big):
    big = big if len(big) > 1000 else big * 8000
    found = runs.find_runs([np.array(big)])[0]
    longest = max(found, key=lambda r: r[1])
    assert longest[:2] == (0, len(big)) and len(found) < 10_000


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_table(spark):
    rng = random.Random(7)
    texts = [" ".join(map(str, sample(rng))) for _ in range(120)] + [None, "", " \t\n", "a", "a a a a a a", "ä b " * 9, "x y z\n" * 50]
    rows = [(i if i != 3 else None, t, 5, "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id bigint, text string, n_runs int, start string, words int").repartition(3)
    got = [tuple(r)[:8] for r in runs.periodic_runs(df, change=runs.repeated).collect()]
    assert sorted(got, key=str) == sorted((expected(i, t) for i, t, *_ in [*rows, rows[-1]]), key=str)
    collapsed = runs.periodic_runs(df.where("text like 'x y z%'"), with_text=True).first()
    assert bytes(collapsed.collapsed) == b"x y z" and collapsed.n_kept == 3 and collapsed.period == 3
    assert runs.periodic_runs(df.limit(0)).collect() == []
