"""Helpers that the operators share: column selection, the shared folder, code point arrays."""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.sources.storage import materialize, scratch, shared_dir

__all__ = ["materialize", "scratch", "shared_dir"]

#: Text characters that one numpy step handles at most (a single longer text makes a step of its own).
STEP_CHARS = 500_000


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns with the given types, so that further columns of any name cannot clash."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in types.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """The bytes of each text as they are stored, whether or not they are UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    """The texts; null is empty, and what is no UTF-8 becomes replacement characters."""
    return [x.decode("utf-8", "replace") for x in raw_texts(column)]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `limit` bytes at most; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker function that gives freed memory back to the system at its end, as Spark keeps idle workers for later tasks."""

    @wraps(step)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


LETTER, NUMBER, OTHER, SPACE, EDGE = 0, 1, 2, 3, 4
#: The code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    out[list(WHITE_SPACE)] = SPACE
    return out


@lru_cache(1)
def lower_case() -> np.ndarray:
    """The code point of each character's lower case where that is one character, else the character."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


class CodePoints:
    """Several texts as one array of code points, each followed by an EDGE position that belongs to no text."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        self.text = joined
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.ends = np.cumsum(lengths)  # exclusive, with the edge
        self.starts = self.ends - lengths
        self.classes = char_classes()[self.points]
        if len(texts):
            self.classes[self.ends - 1] = EDGE


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class SegmentHasher:
    """64-bit hashes of stretches of an array, independent of where they stand."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(16, int(len(values)).bit_length())
        self.inverse = _powers(size, int(_INVERSE))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * _powers(size, int(_BASE))[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def word_runs(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of letters."""
    letter = np.zeros(len(classes) + 2, dtype=np.int8)
    letter[1:-1] = classes == LETTER
    step = np.diff(letter)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def held_out(doc_id, folds: int = 4, fold: int = 2) -> object:
    """Whether a document is kept from learning: crc32 of its doc_id as text leaves `fold` when divided by `folds`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample_texts(docs: DataFrame, labelled: DataFrame, max_rows: int, max_bytes: int) -> list:
    """Rows (doc_id, label, text) to fit a model on: at most max_rows documents of each label, by a hash of doc_id.

    A label's texts have max_bytes together at most: first those of up to a sixteenth of that, in order of the hash, then
    longer ones, shortest first. The first of them is taken whatever its size, so that no label is lost. Null and empty
    texts and repeated rows are left out. The order is that of another hash, so that labels are mixed.
    """
    known = labelled.where("doc_id is not null")
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # Of a label's documents, those with the least hashes alone are ranked: some four times as many as are taken.
    share = F.lit(4.0 * max_rows) / F.col("size")
    near = known.join(F.broadcast(sizes), "label").where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53)) < share)
    ranked = near.select("doc_id", "label").distinct().withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id")))
    chosen = ranked.where(F.col("place") <= max_rows).select(F.col("doc_id").alias("chosen_id"), "label", "place")
    texts = pick(docs, doc_id="bigint", text="string").where("length(text) > 0").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    # Sizes are summed without the texts, which are joined to the rows that stay.
    keyed = texts.select("doc_id", "label", "place", F.octet_length("text").cast("bigint").alias("bytes"), F.xxhash64("text").alias("key")).distinct()
    long = F.when(F.col("bytes") * 16 > max_bytes, F.col("bytes")).otherwise(0)
    order = W.partitionBy("label").orderBy(long, "place", "doc_id", "key")
    kept = keyed.withColumns({"summed": F.sum("bytes").over(order), "turn": F.row_number().over(order)}).where((F.col("turn") == 1) | (F.col("summed") <= max_bytes))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("label").alias("kept_label"), F.col("key").alias("kept_key"))
    rows = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(kept), (F.col("doc_id") == F.col("kept_id")) & (F.col("label") == F.col("kept_label")) & (F.col("key") == F.col("kept_key")))
    rows = rows.select("doc_id", "label", F.make_valid_utf8("text").alias("text")).dropDuplicates(["doc_id", "label", "text"])
    return sorted(rows.collect(), key=lambda r: (r.doc_id * 2654435761 % 4294967291, r.text))
