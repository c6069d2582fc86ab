"""Exact substring deduplication over a partitioned collection of suffixes that are refined in buckets.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Suffixes are
put in buckets by two grams of GRAM bytes, the second one STEP bytes on. Three things keep the buckets small:

* Of the suffixes in each stretch of LENGTH bytes, the one whose gram has the least hash stands for all strings that
  share it (a segment). Equal strings have the same representative, so equal segments meet in one bucket.
* A batch of documents (a range of doc_id) sends each different segment of a bucket once, with an identifier of its whole
  content. A segment that an earlier batch has sent is repeated as a whole and is not refined.
* Only segments of buckets with several contents that are not repeated as a whole are refined to all their strings of
  LENGTH bytes. Their bytes go to their bucket's task, which sorts all suffixes of a bucket's segments: first by their
  q-gram, then, as long as a bucket has several suffixes, by the bucket pointer of the suffix as many bytes on as the
  buckets already agree on. Pointers refined in one pass are the keys of the next, so 8, 16, 32 and LENGTH bytes take
  three passes (bucket-pointer refinement, ended at LENGTH bytes: longer order has no use here).

Single strings are so compared byte for byte. Whole segments match by 64 bits of the content and 64 bits of the bucket
together, without a look at their bytes. Batches get back one flag for each segment and one bit for each refined string
that they have sent, in the order sent; they compute the same list again from their documents. A task sorts the segments
of whole buckets in steps of CHUNK bytes, unless one bucket has more.

Null and empty texts, and texts under LENGTH bytes, lose nothing. Rows with the same doc_id do not repeat each other.
A null doc_id counts as smaller than all others. An empty table gives no row. Bytes need not be UTF-8; columns beside
doc_id and text are not looked at. Batches are cut by bytes, BATCH_BYTES and one more text at most, so there are more of
them and of parts when the table grows; a very long text is one batch's, whatever its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslink.llm.common import SegmentHasher, give_back, mix, pick, raw_texts

LENGTH = 50
GRAM = 16
STEP = GRAM + 1
#: Bytes of the grams that suffixes are first put in buckets by.
FIRST = 8
#: Bytes whose identifiers are computed in one go, unless one document has more.
CHUNK = 1 << 20
#: Partitions for each batch, so that few batches fall into one by their hash.
SPREAD = 4
#: Bytes of text of a batch, beside its last text.
BATCH_BYTES = 1 << 25
#: Segments whose strings are marked in one go.
STRETCH = 1 << 16
MATCHED, MIXED = 1, 2
_FIRST, _SECOND, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_NULL = -(1 << 63)


class Batch:
    """Documents of a batch and their segments: bucket, content, document, first string and number of strings."""

    def __init__(self, table: pa.Table):
        order = np.argsort(np.asarray(table.column("doc_id").fill_null(_NULL)), kind="stable")
        self.rows = table.take(pa.array(order))
        self.ids = np.asarray(self.rows.column("doc_id").fill_null(_NULL))
        raw = raw_texts(self.rows.column("text").combine_chunks())
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        parts, begin = [], 0
        while begin < len(raw):
            end = max(begin + 1, int(np.searchsorted(self.ends, self.starts[begin] + CHUNK, side="right")))
            if self.ends[end - 1] - self.starts[begin] >= LENGTH:
                parts.append(self._segments(begin, end))
            begin = end
        columns = list(zip(*parts, strict=True)) if parts else [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.bucket, self.content, self.doc, self.first, self.count = (np.concatenate(c) for c in columns)

    def _segments(self, begin: int, end: int):
        base = int(self.starts[begin])
        data = np.append(self.data[base : self.ends[end - 1]], np.zeros(8, np.uint8))
        n = len(data) - 8
        eight = np.ndarray((n - 7,), "<u8", data, strides=(1,))
        gram = mix(eight[:-8] * _FIRST ^ (eight[8:] * _SECOND)) if n > 15 else np.zeros(0, np.uint64)
        strings = n - LENGTH + 1
        bits = max(21, int(n).bit_length())
        low = np.uint64((1 << bits) - 1)
        least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        width, span = 1, LENGTH - GRAM + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least[:strings] & low).astype(np.int64)
        doc = np.repeat(np.arange(begin, end), self.ends[begin:end] - self.starts[begin:end])[:strings]
        index = np.arange(strings)
        inside = index + LENGTH <= (self.ends[doc] - base)
        right = index > at - STEP
        new = np.ones(strings, bool)
        new[1:] = (at[1:] != at[:-1]) | (right[1:] != right[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        edge = np.flatnonzero(new)
        count = np.diff(np.append(edge, strings))
        keep = inside[edge]
        edge, count = edge[keep], count[keep]
        place = np.where(right[edge], at[edge], at[edge] - STEP)
        bucket = mix(gram[place] * _PAIR + gram[place + STEP])
        content = SegmentHasher(data[:n]).of(edge, edge + count - 1 + LENGTH)
        return bucket, content, doc[edge], edge + base, count

    def sent(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments in the order of sending; where each different one begins there; part of each different one."""
        part = (self.bucket % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((self.ids[self.doc], self.content, self.bucket, part))
        b, c = self.bucket[order], self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        heads = np.flatnonzero(new)
        return order, heads, part[order[heads]]

    def judged(self, parts: int, flags: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each segment: repeated as a whole; to be refined."""
        order, heads, part = self.sent(parts)
        flag = np.zeros(len(heads), np.uint8)
        for p, f in flags.items():
            a, b = np.searchsorted(part, [p, p + 1])
            flag[a:b] = np.frombuffer(f, np.uint8)
        which = np.zeros(len(order), np.int64)
        which[heads[1:]] = 1
        which = np.cumsum(which)
        least = self.ids[self.doc[order[heads]]]
        repeated, refine = np.zeros(len(order), bool), np.zeros(len(order), bool)
        repeated[order] = (flag[which] & MATCHED > 0) | (self.ids[self.doc[order]] > least[which])
        refine[order] = flag[which] & MIXED > 0
        return repeated, refine & ~repeated

    def refined(self, parts: int, flags: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments whose bytes are sent, in the order of sending, and their parts; all segments with these bytes in the
        same document, and which of the sent ones has their bytes."""
        order, heads, part = self.sent(parts)
        chosen = self.judged(parts, flags)[1][order]
        sent = chosen[heads]
        like = np.cumsum(sent)[np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))] - 1
        return order[heads[sent]], part[sent], order[chosen], like[chosen]

    def bytes_of(self, segments: np.ndarray) -> np.ndarray:
        """The bytes of segments, one after the other."""
        return self.data[runs(self.first[segments], self.count[segments] - 1 + LENGTH)]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def bucket_pointers(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each suffix with length bytes or more, where its bucket begins in the order of the first length bytes.

    Two such suffixes have the same pointer only if they begin with the same length bytes.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64)
    gram = np.ndarray((n - FIRST + 1,), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    order = np.argsort(gram, kind="stable")
    pointer = np.empty(len(gram), np.int64)
    new = np.append(True, gram[order[1:]] != gram[order[:-1]])
    pointer[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    agreed = FIRST
    while agreed < length:
        step = min(agreed, length - agreed)
        size = np.bincount(pointer, minlength=len(gram))
        several = np.flatnonzero(size[pointer[: n - agreed - step + 1]] > 1)
        own, later = pointer[several], pointer[several + step]
        order = np.lexsort((later, own))
        own, later, several = own[order], later[order], several[order]
        bucket = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
        new = bucket | np.append(True, later[1:] != later[:-1]) if len(own) else bucket
        at = np.arange(len(own))
        begins = np.maximum.accumulate(np.where(bucket, at, 0))
        pointer[several] = own + np.maximum.accumulate(np.where(new, at, 0)) - begins
        agreed += step
    return pointer[: n - length + 1]


_REPLY = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("round", pa.int64()), ("flags", pa.binary())])
_REPLY_DDL = "batch bigint, part bigint, round bigint, flags binary"
_NAMED = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("buckets", pa.binary()), ("contents", pa.binary())])
_NAMED_DDL = "part bigint, batch bigint, buckets binary, contents binary"
_RAW = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("buckets", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())])
_RAW_DDL = "part bigint, batch bigint, buckets binary, ids binary, counts binary, data binary"


def _by_part(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, begin, end) of each run of equal parts."""
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return [(int(part[a]), int(a), int(b)) for a, b in zip(edges, np.append(edges[1:], len(part))[: len(edges)], strict=True)]


def _answer_segments(table: pa.Table) -> pa.Table:
    """A part's segments of all batches to one flag for each: sent by an earlier batch, in a bucket of several contents."""
    table = table.sort_by("batch")
    buckets = [np.frombuffer(x, np.uint64) for x in table.column("buckets").to_pylist()]
    bucket = np.concatenate(buckets)
    content = np.frombuffer(b"".join(table.column("contents").to_pylist()), np.uint64)
    order = np.lexsort((content, bucket))  # stable: segments of earlier batches come first
    b, c = bucket[order], content[order]
    new_bucket = np.append(True, b[1:] != b[:-1])
    new = new_bucket | np.append(True, c[1:] != c[:-1])
    group = np.cumsum(new_bucket) - 1
    mixed = np.bincount(group, new)[group] > 1
    flags = np.zeros(len(order), np.uint8)
    flags[order] = np.where(new, 0, MATCHED) | np.where(mixed, MIXED, 0)
    return _replies(table, 1, [f.tobytes() for f in np.split(flags, np.cumsum([len(x) for x in buckets])[:-1])])


def _answer_strings(table: pa.Table) -> pa.Table:
    """A part's segments with their bytes to one bit for each string: it starts in a document with a smaller id, too."""
    column = {c: table.column(c).to_pylist() for c in ("buckets", "ids", "counts", "data")}
    bucket, ids, count = (np.frombuffer(b"".join(column[c]), t) for c, t in (("buckets", np.uint64), ("ids", np.int64), ("counts", np.int64)))
    data = np.frombuffer(b"".join(column["data"]), np.uint8)
    size = count - 1 + LENGTH
    start, first = np.cumsum(size) - size, np.cumsum(count) - count
    order = np.argsort(bucket, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, bucket[order[1:]] != bucket[order[:-1]])), len(order))
    before = np.append(0, np.cumsum(size[order]))[edges]
    gone = np.zeros(int(count.sum()), bool)
    begin = 0
    while begin < len(edges) - 1:
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + CHUNK, side="right")) - 1)
        x = order[edges[begin] : edges[end]]
        pointer = bucket_pointers(data[runs(start[x], size[x])])[runs(np.cumsum(size[x]) - size[x], count[x])]
        owner = np.repeat(ids[x], count[x])
        least = np.full(int(pointer.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, pointer, owner)
        gone[runs(first[x], count[x])] = owner > least[pointer]
        begin = end
    cuts = np.cumsum([int(np.frombuffer(c, np.int64).sum()) for c in column["counts"]])[:-1]
    return _replies(table, 2, [np.packbits(g).tobytes() for g in np.split(gone, cuts)])


def _replies(table: pa.Table, rounds: int, flags: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([table.column("batch"), table.column("part"), pa.array([rounds] * len(flags), pa.int64()), pa.array(flags, pa.binary())], schema=_REPLY)


def _flags(replies: pa.Table, rounds: int) -> dict[int, bytes]:
    return {r["part"]: r["flags"] for r in replies.to_pylist() if r["round"] == rounds}


def _batch_ends(docs: DataFrame, least: int, limit: int) -> list[int]:
    """The last doc_id of each batch, in ascending order: ranges of doc_id of `limit` bytes and one row at most.

    Only ids and sizes are shuffled; the driver gets one number for each batch.
    """

    def ends(batches):
        total, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sums = np.asarray(batch.column("doc_id")), total + np.cumsum(np.asarray(batch.column("size")))
            full = sums // limit > np.append(total, sums[:-1]) // limit
            yield pa.record_batch({"last": pa.array(ids[full], pa.int64())})
            total, last = int(sums[-1]), int(ids[-1])
        if last is not None:
            yield pa.record_batch({"last": pa.array([last], pa.int64())})

    sizes = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"))
    found = sizes.repartitionByRange(least, "doc_id").sortWithinPartitions("doc_id").mapInArrow(ends, "last bigint").distinct()
    return sorted(r.last for r in found.collect())


def _number(value: Column, ends: list[int]) -> Column:
    """How many of the ascending ends are below value, by binary search in one literal array; null counts as below all."""
    table = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k).cast("bigint") for k in reversed(range(len(ends).bit_length()))])
    found = F.aggregate(steps, F.lit(0).cast("bigint"), lambda at, step: F.when(F.coalesce(F.get(table, (at + step - 1).cast("int")) < value, F.lit(False)), at + step).otherwise(at))
    return F.coalesce(F.when(value.isNotNull(), found), F.lit(0).cast("bigint"))


def substring_dedup(spark: SparkSession, docs: DataFrame, batches: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; batches is the least number of batches."""
    least = batches or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = pick(docs, doc_id="bigint", text="string")
    ends = _batch_ends(docs, least, batch_bytes)
    parts = max(least, len(ends))
    dealt = docs.withColumn("batch", _number(F.col("doc_id"), ends) if ends else F.lit(0).cast("bigint")).repartition(SPREAD * parts, "batch")

    def send(table: pa.Table) -> pa.Table:
        give_back()  # what the group before has left
        x = Batch(table)
        order, heads, part = x.sent(parts)
        first = order[heads]
        batch = table.column("batch")[0].as_py()
        rows = [(p, batch, x.bucket[first[a:b]].tobytes(), x.content[first[a:b]].tobytes()) for p, a, b in _by_part(part)]
        return pa.Table.from_pylist([dict(zip(_NAMED.names, r, strict=True)) for r in rows], schema=_NAMED)

    def refine(left: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()  # what the group before has left
        if not left.num_rows:
            return _RAW.empty_table()
        x = Batch(left)
        first, part, _, _ = x.refined(parts, _flags(replies, 1))
        batch = left.column("batch")[0].as_py()
        rows = []
        for p, a, b in _by_part(part):
            s = first[a:b]
            rows.append((p, batch, x.bucket[s].tobytes(), x.ids[x.doc[s]].tobytes(), x.count[s].tobytes(), x.bytes_of(s).tobytes()))
        return pa.Table.from_pylist([dict(zip(_RAW.names, r, strict=True)) for r in rows], schema=_RAW)

    def finish(left: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()  # what the group before has left
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        if not left.num_rows:
            return schema.empty_table()
        x = Batch(left)
        repeated = x.judged(parts, _flags(replies, 1))[0]
        first, part, segments, like = x.refined(parts, _flags(replies, 1))
        bits, counts = _flags(replies, 2), x.count[first]
        found = [np.unpackbits(np.frombuffer(bits[p], np.uint8), count=int(counts[a:b].sum())) for p, a, b in _by_part(part)]
        found = np.concatenate([np.zeros(0, np.uint8), *found])
        begins = np.cumsum(counts) - counts
        cover = np.zeros(len(x.data) + 1, np.int32)
        np.add.at(cover, x.first[repeated], 1)
        np.add.at(cover, x.first[repeated] + x.count[repeated] - 1 + LENGTH, -1)
        for k in range(0, len(segments), STRETCH):  # places are eight bytes for each string
            s = segments[k : k + STRETCH]
            gone = runs(x.first[s], x.count[s])[found[runs(begins[like[k : k + STRETCH]], x.count[s])] > 0]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + LENGTH, -1)
        removed = np.cumsum(cover[:-1], dtype=np.int32) > 0
        del cover, found
        rows = []
        for a, b in zip(x.starts.tolist(), x.ends.tolist(), strict=True):
            r = removed[a:b]
            n = int(r.sum())
            spans = int(r[0]) + int((r[1:] & ~r[:-1]).sum()) if n else 0
            rows.append((b - a, n, spans, hashlib.sha256(x.data[a:b][~r].tobytes() if n else x.data[a:b].tobytes()).hexdigest()))
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([x.rows.column("doc_id").combine_chunks(), *[pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True)]], schema=schema)

    first = dealt.groupBy("batch").applyInArrow(send, _NAMED_DDL).groupBy("part").applyInArrow(_answer_segments, _REPLY_DDL)
    second = dealt.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(refine, _RAW_DDL).groupBy("part").applyInArrow(_answer_strings, _REPLY_DDL)
    replies = first.unionByName(second)
    return dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
