"""Token-ID output: equal-length sequences and masks in Arrow IPC files, read back without copying.

Texts are encoded with a byte-level BPE of the tokenizers library. Each distinct word (as its pre-tokenizer
cuts texts) is encoded once per Python worker and looked up afterwards.

A shard holds the tokens of a range of doc_id in ascending order, cut into sequences of `seq_len` ids:

    part-00000.arrow  ids  fixed_size_list<uint16 or uint32>[seq_len]   mask fixed_size_list<bool>[seq_len]
    part-00000.index  doc_id, start (within the shard), n_tokens

The last sequence of a shard is filled with id 0 and mask false. As every record batch but the last has ROWS
sequences, token k of a shard stands in batch k // (seq_len * ROWS): random access needs no scan, and a memory
map gives the ids as a numpy view.

Null texts count as empty. An empty text has its end id alone. Repeated rows and rows with equal doc_id each get
their own stretch, ordered by text; rows with a null doc_id come first. Texts of any length are encoded whole, a long one in
a step of its own. Columns other than doc_id and text are not read. An empty table gives no row.
"""

from __future__ import annotations

import os
import posixpath
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newslink.llm.common import LETTER, SPACE, STEP_CHARS, CodePoints, SegmentHasher, pick, releasing, shared_dir, slices, texts_of

ROWS = 256
SEQ_LEN = 2048
END_ID = 2
#: Words that a Python worker remembers, some 30 bytes each; beyond it the memory is emptied.
MEMORY = 1_000_000
_QUOTE, _NEWLINE, _BLANK = 39, 10, 32
#: What may follow an apostrophe as one word in the pre-tokenizer's pattern.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: A text with every kind of cut, to compare a tokenizer's pre-tokenizer with.
PROBE = "Don't we'll  12ab  \n x_y's\t\u00e9\u00df\u4e2d, '9 %%A   "


def word_spans(cp: CodePoints) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token, by the pattern of byte-level BPE:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    kind, point = cp.classes, cp.points
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    # The last character of a white-space run before other characters stands alone, or, if a blank, joins them.
    last = np.zeros(n, dtype=bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] < SPACE)
    at = np.flatnonzero(last)
    first[at] = True
    joined = at[point[at] == _BLANK] + 1
    first[joined] = False
    # An apostrophe alone, not after a blank, takes a few endings along.
    quotes = np.flatnonzero((point == _QUOTE) & first)
    quotes = quotes[(quotes + 1 < n) & (kind[np.minimum(quotes + 1, n - 1)] == LETTER)]
    for q in quotes.tolist():
        for ending in _ENDINGS:
            if cp.text.startswith(ending, q + 1) and (kind[q + 1 : q + 1 + len(ending)] == LETTER).all():
                first[q + 1] = False
                first[q + 1 + len(ending)] = True
                break
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    inside = kind[starts] <= SPACE
    return starts[inside], ends[inside]


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of sorted keys and their values as one."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


class Encoder:
    """Token ids of whole texts; equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._check_cuts()
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._forget()

    def _check_cuts(self) -> None:
        """The tokenizer must cut texts as word_spans does."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(PROBE) if self.tokenizer.pre_tokenizer else None
        starts, ends = word_spans(CodePoints([PROBE]))
        if self.tokenizer.normalizer is not None or cut is None or [span for _, span in cut] != list(zip(starts.tolist(), ends.tolist(), strict=True)):
            raise ValueError("the tokenizer does not cut texts by the pattern of byte-level BPE")

    def _forget(self) -> None:
        # Keys in order with the slots they have; new ones wait in a small table until they are worth a merge.
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.old, self.new, self.count = none, none, 0
        self.offsets, self.lengths = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.pool, self.used = np.zeros(1 << 14, self.dtype), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for those not seen before."""
        out = np.full(len(keys), -1, np.int32)
        for known, slots in (self.old, self.new):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[at] == keys, slots[at], out)
        return out

    def _remember(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode words that were not seen before: joined by line breaks, which never merge with what is not white space."""
        solid = [i for i, w in enumerate(words) if not w.isspace()]
        pieces: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(words)
        for k in range(0, len(solid), 4000):
            part = solid[k : k + 4000]
            ids = np.array(self.tokenizer.encode("\n".join(words[i] for i in part), add_special_tokens=False).ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer does not cut at line breaks; byte-level BPE is needed")
            for i, piece in zip(part, np.split(ids, cuts), strict=True):
                pieces[i] = piece
            for i in part[1:]:
                pieces[i] = pieces[i][1:]
        seen = set(solid)
        for i, w in enumerate(words):
            if i not in seen:
                pieces[i] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype=self.dtype)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.concatenate(pieces)
        base = self.count
        if base + len(words) > len(self.offsets):
            more = max(base + len(words), 2 * len(self.offsets))
            self.offsets, self.lengths = np.resize(self.offsets, more), np.resize(self.lengths, more)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.used + len(flat), 2 * len(self.pool)))
        self.lengths[base : base + len(words)] = lengths
        self.offsets[base : base + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.count += len(words)
        self.new = _merged(self.new, (keys, np.arange(base, self.count, dtype=np.int32)))
        if 8 * len(self.new[0]) > len(self.old[0]):
            self.old, self.new = _merged(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)} if self.special else set()
        cp = CodePoints(["" if i in odd else t for i, t in enumerate(texts)])
        starts, ends = word_spans(cp)
        keys, at, which = np.unique(SegmentHasher(cp.points).of(starts, ends), return_index=True, return_inverse=True)
        if self.count + len(keys) > MEMORY:
            self._forget()
        new = np.flatnonzero(self._slots(keys) < 0)
        if len(new):
            self._remember(keys[new], [cp.text[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        slots = self._slots(keys)[which]
        lengths = self.lengths[slots].astype(np.int64)
        total = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.offsets[slots] - (total - lengths), lengths) + np.arange(int(lengths.sum()))]
        bounds = np.append(0, total)[np.searchsorted(starts, cp.ends)]
        counts = np.diff(bounds, prepend=0)
        if odd:
            parts = np.split(ids, bounds[:-1])
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=self.dtype)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if urlsplit(uri).scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), urlsplit(uri).path
    return pa.fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Takes token arrays and writes them as sequences of equal length."""

    def __init__(self, sink, dtype, seq_len: int):
        self.seq_len = seq_len
        kind = pa.uint16() if dtype == np.uint16 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        size = ROWS * self.seq_len
        if self.held >= size:
            flat = np.concatenate(self.waiting)
            for k in range(0, len(flat) - size + 1, size):
                self._write(flat[k : k + size], size)
            self.waiting = [flat[len(flat) // size * size :]]
            self.held = len(self.waiting[0])

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.waiting)
            self._write(np.pad(flat, (0, -len(flat) % self.seq_len)), len(flat))
        self.out.close()


class SequenceFile:
    """Random access to the tokens of one shard; local files are memory-mapped."""

    def __init__(self, uri: str):
        fs, path = _files(uri)
        source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self._at, self._ids = -1, np.zeros(0)

    def batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._ids = k, self.reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self._ids

    def tokens(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Views of the stretch [start, start + count), one for each record batch it touches."""
        size = ROWS * self.seq_len
        while count:
            k, at = divmod(start, size)
            view = self.batch(k)[at : at + count]
            yield view
            start, count = start + len(view), count - len(view)


def write_sequences(docs: DataFrame, out_dir: str, tokenizer_file: str, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Write shards below out_dir in doc_id order; returns one row per shard: shard, name, n_docs, n_tokens.

    Documents are range-partitioned on doc_id, so shards are in order and no task sees more than its range.
    A retried task writes the same bytes under a name of its own and renames them, so shards are never half written.
    """

    @releasing
    def shard(batches):
        context = TaskContext.get()
        fs, root = _files(out_dir)
        fs.create_dir(root, recursive=True)
        k = context.partitionId()
        name, mine = f"part-{k:05d}", f".{context.taskAttemptId()}"
        enc, writer, sink, index, total = encoder(tokenizer_file), None, None, [], 0
        for batch in slices(batches, "text", STEP_CHARS):
            if writer is None:
                sink = fs.open_output_stream(posixpath.join(root, name + mine))
                writer = SequenceWriter(sink, enc.dtype, seq_len)
            ids, counts = enc.encode(texts_of(batch.column("text")))
            ids = np.insert(ids, np.cumsum(counts), enc.dtype(end_id))
            counts = counts + 1
            writer.add(ids)
            index.append(pa.record_batch({"doc_id": batch.column("doc_id"), "start": pa.array(total + np.cumsum(counts) - counts), "n_tokens": pa.array(counts)}))
            total += int(counts.sum())
        if writer is not None:
            writer.close()
            sink.close()
            with fs.open_output_stream(posixpath.join(root, name + mine + "i")) as out, pa.ipc.new_file(out, index[0].schema) as file:
                for part in index:
                    file.write_batch(part)
            fs.move(posixpath.join(root, name + mine), posixpath.join(root, name + ".arrow"))
            fs.move(posixpath.join(root, name + mine + "i"), posixpath.join(root, name + ".index"))
            yield pa.record_batch({"shard": pa.array([k], pa.int64()), "name": [name], "n_docs": pa.array([sum(len(p) for p in index)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    ordered = pick(docs, doc_id="bigint", text="string").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(shard, "shard bigint, name string, n_docs bigint, n_tokens bigint")
    manifest.write.parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{out_dir}/manifest")


def read_documents(manifest: DataFrame, out_dir: str) -> DataFrame:
    """Each document's place in the whole stream and the checksum of its ids, from the files that the manifest names."""

    @releasing
    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, root = _files(out_dir)
                file = SequenceFile(posixpath.join(out_dir, name + ".arrow"))
                with fs.open_input_file(posixpath.join(root, name + ".index")) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        crcs = []
                        for start, count in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for view in file.tokens(start, count):
                                crc = zlib.crc32(view.astype("<u4"), crc)
                            crcs.append(crc)
                        yield pa.record_batch({"doc_id": part.column("doc_id"), "start": pc.add(part.column("start"), base), "n_tokens": part.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64())})

    # One row per shard: the running total is over as many rows as there are files.
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "name", before.cast("bigint").alias("base"))
    # With a number given, Spark does not put the few small rows in one task: each stands for a whole file.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(tasks, "shard").select("name", "base").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_file: str, out_dir: str | None = None) -> DataFrame:
    """Write docs as token sequences below out_dir and read them back; without out_dir, in a folder that goes with the session."""
    out_dir = out_dir or shared_dir(spark, "tokens")
    return read_documents(write_sequences(docs, out_dir, tokenizer_file), out_dir)
