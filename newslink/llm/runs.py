"""Periodic runs: stretches of words that repeat with a period, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, of max(LEAST, TIMES * q) words at least, that no
neighbouring word extends with period q. Periods under SHORT come from a scan of each lag. Larger ones are found scale
by scale, for P = SHORT, 2 * SHORT, ...: periods from P up to 2 * P - 1.

At a scale every window of P grams (of P words each, 2 * P - 1 words together) has a minimizer, its leftmost gram of
least hash. A window is a seed where the minimizer changes from the window before. Within a run of period q a window and
the one q later have the same words, so their minimizers lie q apart and both are seeds. Windows that lie in a run of a
quarter of their length or less, found at an earlier scale, are no seeds (the first window after them is one): else text
of a short period would make a seed of every word. Equal windows that are left stand more than a quarter of their length
apart, so of the seeds with the same words only the next PARTNERS need to be looked at, and there are as many pairs as
seeds, not their square. Pairs are extended to both sides by bisection over hashes of stretches; what is long enough is
compared word for word, and a text where that fails (hashes of different words that are equal) has that lag scanned.
Equal words have equal hashes, so nothing is missed.

A document is one row throughout: there is no shuffle, and the work is proportional to its words at each scale.
Null and empty texts and texts of blanks have no words and no runs. Repeated rows give equal rows; a null doc_id is
not made periodic by `repeated`. Very long texts are read whole; texts go through numpy in steps of STEP_CHARS bytes,
a longer one alone. Bytes that are no UTF-8 are words like others. Further columns are not read. Empty tables give no row.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from newslink.llm.common import STEP_CHARS, SegmentHasher, mix, pick, raw_texts, releasing, slices

#: Words that a run has at least, and how many times its period.
LEAST, TIMES = 6, 4
#: Periods below are scanned lag by lag; also the first scale.
SHORT = 4
#: Following seeds of equal words that a seed is compared with: equal seeds stand over a quarter of 2 * P - 1 words apart.
PARTNERS = 4


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of true values."""
    padded = np.zeros(len(same) + 2, np.int8)
    padded[1:-1] = same
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _scan(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """(start, end, lag) of the stretches with this period, long enough for a run."""
    if len(words) <= lag:
        return []
    starts, ends = _stretches(words[lag:] == words[:-lag])
    some = ends - starts + lag >= max(LEAST, TIMES * lag)
    return [(s, e, lag) for s, e in zip(starts[some].tolist(), (ends[some] + lag).tolist(), strict=True)]


def _least_in_windows(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `size` values (a power of two) its least value and the leftmost place of it."""
    value, place, width = x, np.arange(len(x)), 1
    while width < size:
        left = value[:-width] <= value[width:]
        place = np.where(left, place[:-width], place[width:])
        value = np.where(left, value[:-width], value[width:])
        width *= 2
    return value, place


def _common(hasher: SegmentHasher, a: np.ndarray, b: np.ndarray, limit: np.ndarray, forward: bool) -> np.ndarray:
    """How many words follow (or precede) places a and b alike, up to limit."""
    got = np.zeros(len(a), np.int64)
    step = 1 << max(0, int(limit.max(initial=0)).bit_length())
    while step:
        some = np.flatnonzero(got + step <= limit)
        at = got[some]
        if forward:
            x, y = (hasher.of(p[some] + at, p[some] + at + step) for p in (a, b))
        else:
            x, y = (hasher.of(p[some] - at - step, p[some] - at) for p in (a, b))
        got[some] += np.where(x == y, step, 0)
        step //= 2
    return got


def _seeds(words: np.ndarray, hasher: SegmentHasher, size: int, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose minimizer is new, in order, and the hash of each one's words."""
    width, n = 2 * size - 1, len(words)
    at = np.arange(n - size + 1)
    _, place = _least_in_windows(mix(hasher.of(at, at + size) ^ np.uint64(size)), size)
    windows = n - width + 1
    place = place[:windows]
    periodic = np.zeros(windows + 1, np.int32)
    for s, e, q in runs:
        if e <= n and 4 * q <= width <= e - s:
            periodic[s] += 1
            periodic[e - width + 1] -= 1
    open_ = np.cumsum(periodic[:windows]) == 0
    new = np.ones(windows, bool)
    new[1:] = (place[1:] != place[:-1]) | ~open_[:-1]
    seeds = np.flatnonzero(open_ & new)
    return seeds, hasher.of(seeds, seeds + width)


def _at_scale(words: np.ndarray, edges: np.ndarray, size: int, runs: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Stretches with a period from size to 2 * size - 1 that are long enough; edges: the ends of the texts in words."""
    hasher = SegmentHasher(words)
    seeds, keys = _seeds(words, hasher, size, runs)
    order = np.argsort(keys, kind="stable")
    seeds, keys = seeds[order], keys[order]
    found: set[tuple[int, int, int]] = set()
    for k in range(1, PARTNERS + 1):
        near = np.flatnonzero((keys[k:] == keys[:-k]) & (seeds[k:] - seeds[:-k] >= size) & (seeds[k:] - seeds[:-k] < 2 * size))
        a, b = seeds[near], seeds[near + k]
        text = np.searchsorted(edges, a, side="right")
        inside = text == np.searchsorted(edges, b, side="right")
        a, b, text = a[inside], b[inside], text[inside]
        if not len(a):
            continue
        begin = np.append(0, edges)[text]
        back = _common(hasher, a, b, a - begin, False)
        ahead = _common(hasher, a, b, edges[text] - b, True)
        lag = b - a
        some = back + ahead + lag >= np.maximum(LEAST, TIMES * lag)
        found.update(zip((a - back)[some].tolist(), (b + ahead)[some].tolist(), lag[some].tolist(), strict=True))
    return found


def _is_exact(words: np.ndarray, run: tuple[int, int, int], begin: int, end: int) -> bool:
    """Whether a stretch has the period word for word and no neighbour extends it."""
    s, e, q = run
    extends = (s > begin and words[s - 1] == words[s - 1 + q]) or (e < end and words[e] == words[e - q])
    return not extends and bool(np.array_equal(words[s : e - q], words[s + q : e]))


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, given as word numbers (equal words, equal numbers), in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= LEAST), key=lambda i: -len(texts[i]))
    if not order:
        return out
    # Longest first: the texts that have enough words for a scale are the first ones. Each is followed by a word of its own.
    lengths = np.array([len(texts[i]) for i in order])
    edges = np.cumsum(lengths + 1)
    begins = edges - lengths - 1
    words = np.full(int(edges[-1]), -1, np.int64)
    for i, b, n in zip(order, begins.tolist(), lengths.tolist(), strict=True):
        words[b : b + n] = texts[i]
    words[edges - 1] = -1 - np.arange(len(order))
    runs: list[tuple[int, int, int]] = []
    whole: set[tuple[int, int]] = set()

    def keep(stretches: list[tuple[int, int, int]]) -> None:
        for s, e, q in stretches:
            if (s, e) not in whole:  # else it has a smaller period
                whole.add((s, e))
                runs.append((s, e, q))

    for lag in range(1, SHORT):
        keep(_scan(words, lag))
    size = SHORT
    while (long := int(np.searchsorted(-lengths, -TIMES * size, side="right"))) > 0:
        part, ends = words[: int(edges[long - 1])], edges[:long] - 1
        found = _at_scale(part, ends, size, runs)
        sound = set()
        for run in sorted(found):
            k = int(np.searchsorted(ends, run[0], side="right"))
            if _is_exact(part, run, int(begins[k]), int(ends[k])):
                sound.add(run)
            else:
                sound.update((s + int(begins[k]), e + int(begins[k]), q) for s, e, q in _scan(part[int(begins[k]) : int(ends[k])], run[2]))
        keep(sorted(sound, key=lambda x: x[2]))
        size *= 2
    for s, e, q in sorted(runs, key=lambda x: (x[0], x[2])):
        k = int(np.searchsorted(edges, s, side="right"))
        out[order[k]].append((s - int(begins[k]), e - s, q))
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.cumsum(step[:n]) > 0


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text (by the crc32 of its doc_id) with its tail replaced by repetitions, as op11's contract has it."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space."""
    return text.split()


_SCHEMA = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "n_kept": pa.int64(), "collapsed": pa.large_binary()}


def _rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    numbers, _ = pd.factorize(np.array([w for t in texts for w in t] + [None], object)[:-1])
    found = find_runs(np.split(numbers.astype(np.int64), np.cumsum([len(t) for t in texts])[:-1]))
    rows = []
    for doc_id, words, runs in zip(ids, texts, found, strict=True):
        if runs:
            s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
            first = (s, length, q, 1000 * length // q)
            gone = dropped(len(words), runs)
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        else:
            first = (None,) * 4
        text = b" ".join(words)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        rows.append((doc_id, len(runs), *first, sha256(listed.encode()).hexdigest(), sha256(text).hexdigest(), len(words), text))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.values(), strict=True)], names=list(_SCHEMA))


def periodic_runs(docs: DataFrame, change=None, with_text: bool = False) -> DataFrame:
    """Each document's number of runs, its longest run (ties: smallest start, then period), digests of all runs and of the collapsed text.

    The collapsed text keeps a run's first period; its words are joined by one blank. change(doc_id, words) may give other
    words to look at. With with_text, the collapsed text comes as column `collapsed` (bytes).
    """
    names = [c for c in _SCHEMA if with_text or c != "collapsed"]

    @releasing
    def step(batches):
        for batch in slices(batches, "text", STEP_CHARS):
            ids = batch.column("doc_id").to_pylist()
            texts = [words_of(t) for t in raw_texts(batch.column("text"))]
            if change:
                texts = [change(i, t) for i, t in zip(ids, texts, strict=True)]
            yield _rows(ids, texts).select(names) if with_text else _rows(ids, texts).drop_columns(["collapsed"])

    kinds = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_kept bigint"
    return pick(docs, doc_id="bigint", text="string").mapInArrow(step, kinds + (", collapsed binary" if with_text else ""))
