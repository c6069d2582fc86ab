"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers over the same bytes.

A document is the bytes of a blank and its text. Tokenizer A is a byte-level BPE of the tokenizers library, B a BPE model
of sentencepiece with byte fallback. Where tokens of both end at the same byte, they cut the document into groups; every
A token and B token whose bytes overlap are linked. The count of a pair of ids is the number of documents that hold it
linked.

Neither tokenizer has a token that goes on over a blank after a character that is no white space. Texts are cut into
segments there; a worker encodes and aligns each different segment once, by its text. A document's groups and links are
those of its segments.

A document of more than `chunk` bytes is dealt out as byte ranges to many tasks. Ranges may end within characters,
tokens and groups. A range is read with its bytes up to the next cut on either side, and its fragment is what its
tokens are by their ends: an open prefix (up to the first common end), closed groups, and an open suffix (after the last
one); without a common end all is open. Fragments compose associatively, suffix and prefix to one more group, so they are
reduced as a tree, FAN neighbours at a time, in Spark groups. Closed groups stay where they were made: only open ends
and the groups that close between fragments travel.

Counts: the documents of a task are gathered to blocks of BLOCK_CHARS characters. A block holds its different pairs once, with
the number of its documents for each, so a pair makes one row for a block, not one for each document. Summed counts are
joined back to the blocks by pair. No pair can be a hot key, as there are as many rows of any pair as blocks at most.

Texts that are null, empty, or whose tokens do not give the bytes back have no tokens: zeros, and '' for the digest.
That is so for every text with U+2581, which B takes for a blank. Repeated rows and equal doc_ids are documents of their
own. Null doc_ids stay null. Bytes that are no UTF-8 become replacement characters first. Texts of any length are read
whole; one without a blank is a single segment of one task. Further columns are not read. Empty tables give no row.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslink.llm.common import STEP_CHARS, materialize, pick, releasing, slices, texts_of

#: Documents of more bytes are dealt out in ranges of so many.
CHUNK = 1 << 16
#: Fragments that one step of the tree composes.
FAN = 8
#: Characters of the documents whose pairs are counted together.
BLOCK_CHARS = 4_000_000
#: Segments that a worker remembers, and their characters; beyond either, those that only one text had are forgotten
#: before the next step (all, if too many others are left).
MEMORY, MEMORY_CHARS = 300_000, 6_000_000
#: A blank, and what follows up to a blank after a character that is no white space.
SEGMENT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")
_BLANK = "▁"
#: Segments that are learned at once.
STEP = 5000
_TENS = 10 ** np.arange(1, 5)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character stands for in byte-level BPE: printable Latin-1 itself, others from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids and end bytes of consecutive tokens of A and B."""

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
        self.a, self.ends_a, self.b, self.ends_b = a, ends_a, b, ends_b

    def common(self) -> np.ndarray:
        return np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)

    def links(self, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ends of all links, and their codes, A id << 16 | B id: one for each end of a token, by the tokens that cover the byte before it.

        Only ends after byte low, up to byte high; the tokens may go on beyond.
        """
        ends = np.union1d(self.ends_a, self.ends_b)
        ends = ends[(ends > low) & (ends <= (ends[-1] if high is None else high))] if len(ends) else ends
        return ends, (self.a[np.searchsorted(self.ends_a, ends)] << 16 | self.b[np.searchsorted(self.ends_b, ends)]).astype(np.uint32)

    def part(self, low: int, high: int) -> Tokens:
        """The tokens that end after byte low, up to byte high."""
        x = np.searchsorted(self.ends_a, [low, high], side="right")
        y = np.searchsorted(self.ends_b, [low, high], side="right")
        return Tokens(self.a[slice(*x)], self.ends_a[slice(*x)], self.b[slice(*y)], self.ends_b[slice(*y)])

    def rendered(self) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;` for each group, all in one, and where each group ends there; the last token of both must end together."""
        cuts = self.common()
        last_a, last_b = np.isin(self.ends_a, cuts, assume_unique=True), np.isin(self.ends_b, cuts, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        # A group's A tokens stand before its B tokens, after all tokens of the groups before it.
        at_a = np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(n_a)[group_b]
        ids, signs = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        signs[at_a], signs[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        digits = 1 + np.searchsorted(_TENS, ids, side="right")
        stops = np.cumsum(digits + 1)
        out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
        for k in range(len(_TENS) + 1):
            some = np.flatnonzero(digits > k)
            out[stops[some] - 2 - k] = ids[some] // 10**k % 10 + ord("0")
        out[stops - 1] = signs
        return out.tobytes(), stops[at_b[last_b]]


def group(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


class Aligner:
    """Both tokenizers, and what the segments that were seen before give: links, groups as text, counts."""

    def __init__(self, file_a: str, file_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.one = Tokenizer.from_file(file_a)
        self.one.encode_special_tokens = True  # their strings in a text are ordinary text
        self.two = sentencepiece.SentencePieceProcessor(model_file=file_b)
        pieces = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        if any(_BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError("the second tokenizer has pieces that go on over a blank")
        bytes_of, vocabulary = byte_alphabet(), self.one.get_vocab(with_added_tokens=True)
        if max(*vocabulary.values(), len(pieces)) >= 1 << 16:
            raise ValueError("ids of more than 16 bits do not fit into a pair's code")
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            if all(c in bytes_of for c in t):
                self.bytes_a[i] = bytes(bytes_of[c] for c in t)
        self.bytes_b = [bytes([int(m[1], 16)]) if self.two.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.blank = self.two.piece_to_id(_BLANK)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.held = 0
        self.text: list[bytes | None] = []  # None: the tokens do not give the segment back
        self.counts = np.zeros((1 << 12, 3), np.int64)
        self.offsets, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0
        self.texts = np.zeros(1 << 12, np.int64)

    def _renew(self) -> None:
        """Keep the segments that several texts had."""
        kept = np.flatnonzero(self.texts[: len(self.text)] > 1)
        names = [s for s, k in self.slots.items() if self.texts[k] > 1]
        if 2 * len(kept) > MEMORY or 2 * (held := sum(map(len, names))) > MEMORY_CHARS:
            self._forget()
            return
        n = self.lengths[kept]
        starts = np.cumsum(n) - n
        pool = self.pool[np.repeat(self.offsets[kept] - starts, n) + np.arange(int(n.sum()))]
        self.slots, self.held = dict(zip(names, range(len(names)), strict=True)), held
        self.text = [self.text[k] for k in kept.tolist()]
        self.counts, self.lengths, self.offsets, self.texts = self.counts[kept], n, starts, np.ones(len(kept), np.int64)
        self.pool, self.used = pool, len(pool)

    def _ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.one.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.two.encode([s[1:] for s in segments], num_threads=1)
        return a, [ids if len(s) > 1 else [self.blank] for s, ids in zip(segments, b, strict=True)]

    def _sound(self, segments: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether both sides' tokens give each segment's bytes, none of them empty."""
        sizes, sound = np.fromiter(map(len, segments), np.int64, len(segments)), np.ones(len(segments), bool)
        for side, table, bytes_of in ((a, self.bytes_a, self.sizes_a), (b, self.bytes_b, self.sizes_b)):
            flat = list(chain.from_iterable(side))
            each = bytes_of[flat] if flat else np.zeros(0, np.int64)
            stops = np.cumsum(np.fromiter(map(len, side), np.int64, len(side)))
            total = np.append(0, np.cumsum(each))[stops]
            if (each > 0).all() and np.array_equal(total, np.cumsum(sizes)) and b"".join([table[i] for i in flat]) == b"".join(segments):
                continue  # the same bytes, cut at the same places
            sound &= [all(bytes_of[ids] > 0) and b"".join([table[i] for i in ids]) == s if ids else False for s, ids in zip(segments, side, strict=True)]
        return sound

    def _learn(self, segments: list[str]) -> None:
        """Align new segments, all in one pass over their bytes put one after the other: every segment's end is a common end."""
        a, b = self._ids(segments)
        raw = [s.encode() for s in segments]
        sound = self._sound(raw, a, b)
        base = len(self.text)
        self.held += sum(map(len, segments))
        self.slots.update(zip(segments, range(base, base + len(segments)), strict=True))
        if base + len(segments) > len(self.offsets):
            more = max(base + len(segments), 2 * len(self.offsets), 1 << 12)
            self.offsets, self.lengths, self.texts = (np.resize(x, more) for x in (self.offsets, self.lengths, self.texts))
            self.counts = np.resize(self.counts, (more, 3))
        rows = np.flatnonzero(sound)
        kept = rows.tolist()
        flat_a, flat_b = (np.fromiter(chain.from_iterable(side[i] for i in kept), np.int64) for side in (a, b))
        ends = np.cumsum([len(raw[i]) for i in kept])
        tokens = Tokens(flat_a, np.cumsum(self.sizes_a[flat_a]), flat_b, np.cumsum(self.sizes_b[flat_b]))
        of = lambda at: np.bincount(np.searchsorted(ends, at), minlength=len(kept))
        at, codes = tokens.links()
        links, groups = of(at), of(tokens.common())
        n_a, n_b = (np.fromiter((len(side[i]) for i in kept), np.int64, len(kept)) for side in (a, b))
        here = slice(base, base + len(segments))
        self.counts[here], self.lengths[here], self.offsets[here], self.texts[here] = 0, 0, 0, 0
        self.counts[base + rows] = np.stack([n_a, n_b, groups], axis=1)
        self.lengths[base + rows] = links
        self.offsets[base + rows] = self.used + np.cumsum(links) - links
        if self.used + len(codes) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.used + len(codes), 2 * len(self.pool)))
        self.pool[self.used : self.used + len(codes)] = codes
        self.used += len(codes)
        whole, cuts = tokens.rendered()
        stops = cuts[np.cumsum(groups) - 1].tolist() if len(kept) else []
        texts: list[bytes | None] = [None] * len(segments)
        for i, begin, stop in zip(kept, [0, *stops[:-1]], stops, strict=True):
            texts[i] = whole[begin : stop - 1]
        self.text += texts

    def documents(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, digest, codes of all links) of each text, None where it has no tokens. Texts come with their blank."""
        if len(self.slots) > MEMORY or self.held > MEMORY_CHARS:
            self._renew()
        cut = [SEGMENT.findall(t) for t in texts]
        new = list(dict.fromkeys(s for segments in cut for s in segments if s not in self.slots))
        for k in range(0, len(new), STEP):
            self._learn(new[k : k + STEP])
        out: list[tuple | None] = []
        for segments in cut:
            slots = [self.slots[s] for s in segments]
            parts = [self.text[k] for k in slots]
            if not slots or None in parts:
                out.append(None)
                continue
            at = np.array(slots)
            self.texts[at] += 1
            n = self.lengths[at]
            places = np.repeat(self.offsets[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((*self.counts[at].sum(axis=0).tolist(), sha256(b";".join(parts)).hexdigest(), self.pool[places]))
        return out

    def tokens(self, text: str) -> Tokens | None:
        """All tokens of a stretch between two cuts, None if they do not give its bytes back."""
        a, b = self._ids([text])
        if not self._sound([text.encode()], a, b)[0]:
            return None
        x, y = np.array(a[0]), np.array(b[0])
        return Tokens(x, np.cumsum(self.sizes_a[x]), y, np.cumsum(self.sizes_b[y]))


@lru_cache(2)
def aligner(file_a: str, file_b: str) -> Aligner:
    return Aligner(file_a, file_b)


@dataclass
class Fragment:
    """What a byte range knows of its document's groups; an associative monoid under `then`, with `Fragment()` as its unit."""

    head_a: list[int] = field(default_factory=list)
    head_b: list[int] = field(default_factory=list)
    tail_a: list[int] = field(default_factory=list)
    tail_b: list[int] = field(default_factory=list)
    first: int = -1  # range of the first common end; -1: there is none, all is head
    closed: int = 0  # groups between common ends
    joined: list[tuple[int, str]] = field(default_factory=list)  # those that close between ranges, by the range of their end

    def then(self, other: Fragment) -> Fragment:
        if self.first < 0:
            return Fragment(self.head_a + other.head_a, self.head_b + other.head_b, other.tail_a, other.tail_b, other.first, other.closed, other.joined)
        if other.first < 0:
            return Fragment(self.head_a, self.head_b, self.tail_a + other.head_a, self.tail_b + other.head_b, self.first, self.closed, self.joined)
        between = (other.first, group(self.tail_a + other.head_a, self.tail_b + other.head_b))
        return Fragment(self.head_a, self.head_b, other.tail_a, other.tail_b, self.first, self.closed + 1 + other.closed, [*self.joined, between, *other.joined])

    def whole(self) -> Fragment:
        """Of a whole document, whose head is a group as well: its first byte is a cut."""
        return Fragment(tail_a=[], tail_b=[], first=0).then(self)


def fragment(tokens: Tokens, k: int) -> tuple[Fragment, str]:
    """Range k's fragment, and its closed groups."""
    cuts = tokens.common()
    if not len(cuts):
        return Fragment(tokens.a.tolist(), tokens.b.tolist()), ""
    low, high = int(cuts[0]), int(cuts[-1])
    head, inner, tail = tokens.part(-1, low), tokens.part(low, high), tokens.part(high, 1 << 62)
    text, stops = inner.rendered()
    return Fragment(head.a.tolist(), head.b.tolist(), tail.a.tolist(), tail.b.tolist(), k, len(stops)), text[:-1].decode()


def ranges(cuts: np.ndarray, chunk: int) -> list[tuple[int, int, int, int]]:
    """(low, high, from, to): byte ranges of about `chunk`, and the cuts around each. cuts: first 0, last the size.

    A range ends at any byte that has a cut within `chunk` bytes on both sides, else at the next cut.
    """
    size, out, low = int(cuts[-1]), [], 0
    while low < size:
        high = min(low + chunk, size)
        at = int(np.searchsorted(cuts, high))
        if cuts[at] - high > chunk or (cuts[at] > high and high - cuts[at - 1] > chunk):
            high = int(cuts[at])
        begin = cuts[np.searchsorted(cuts, low, side="right") - 1]
        out.append((low, high, int(begin), int(cuts[at])))
        low = high
    return out


class _Block:
    """Aligned documents of a task until they are written as one row."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, found: tuple | None, chars: int) -> None:
        self.chars += chars + 1
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, ""))
            codes, times = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        else:
            self.rows.append((doc_id, *found[:4]))
            codes, times = np.unique(found[4], return_counts=True)
        self.codes.append(codes)
        self.times.append(times.astype(np.uint32))

    def row(self, block: int) -> dict:
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        self.codes, sizes = [], [len(c) for c in self.codes]
        columns = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "digest"), map(list, zip(*self.rows, strict=True)), strict=True))
        places = at.astype(np.uint16 if len(codes) <= 1 << 16 else np.uint32)
        return {
            "block": block,
            **columns,
            "pairs": sizes,
            "places": places.tobytes(),
            "times": np.concatenate(self.times).tobytes(),
            "codes": codes.astype(np.int64),
            "n_docs": np.bincount(at, minlength=len(codes)),
        }


_LISTS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "digest": pa.string(), "pairs": pa.int64(), "codes": pa.int64(), "n_docs": pa.int64()}
_DEALT = pa.schema(
    [("block", pa.int64()), *((n, pa.list_(t)) for n, t in _LISTS.items()), ("places", pa.binary()), ("times", pa.binary()), ("row", pa.int64()), ("row_doc", pa.int64()), ("k", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("text", pa.string())]
)
_DDL = "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, digest array<string>, pairs array<bigint>, codes array<bigint>, n_docs array<bigint>, places binary, times binary, row bigint, row_doc bigint, k bigint, low bigint, high bigint, text string"


def _deal(docs: DataFrame, files: tuple[str, str], chunk: int, block_chars: int) -> DataFrame:
    """A row for each block of aligned documents, and one for each byte range of a longer document, not yet aligned."""

    def filled(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in _DEALT], schema=_DEALT)

    @releasing
    def step(batches):
        task, n, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in slices(batches, "text", STEP_CHARS):
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
            # A text with the blank's own sign never gives its bytes back.
            spaced = [" " + t if t and _BLANK not in t else "" for t in texts]
            sizes = [len(t.encode()) for t in spaced]
            short = [i for i, z in enumerate(sizes) if z <= chunk]
            found = aligner(*files).documents([spaced[i] for i in short])
            for i, f in zip(short, found, strict=True):
                block.add(ids[i], f, len(texts[i]))
            for i in (i for i, z in enumerate(sizes) if z > chunk):
                data = spaced[i].encode()
                cuts = np.append(0, np.cumsum([len(s.encode()) for s in SEGMENT.findall(spaced[i])]))
                for k, (low, high, begin, end) in enumerate(ranges(cuts, chunk)):
                    yield filled([{"row": task + n, "row_doc": ids[i], "k": k, "low": low - begin, "high": high - begin, "text": data[begin:end].decode()}])
                n += 1
            if block.chars > block_chars:
                yield filled([block.row(task + n)])
                n, block = n + 1, _Block()
        if block.rows:
            yield filled([block.row(task + n)])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(step, _DDL)


_FRAGMENT = "head_a array<bigint>, head_b array<bigint>, tail_a array<bigint>, tail_b array<bigint>, first bigint, closed bigint, joined array<struct<at: bigint, text: string>>"


def _fragments(ranges_: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Each range's fragment, closed groups, numbers of tokens and links, and its different pairs."""

    @releasing
    def step(batches):
        for batch in slices(batches, "text", 1):
            row = batch.to_pylist()[0]
            tokens = aligner(*files).tokens(row["text"])
            if tokens is None:
                own, codes, times = (Fragment(), ""), np.zeros(0, np.int64), np.zeros(0, np.int64)
                n_a = n_b = 0
            else:
                part = tokens.part(row["low"], row["high"])
                own, n_a, n_b = fragment(part, row["k"]), len(part.a), len(part.b)
                codes, times = np.unique(tokens.links(row["low"], row["high"])[1], return_counts=True)
            f = own[0]
            yield pa.RecordBatch.from_pylist(
                [{"row": row["row"], "row_doc": row["row_doc"], "k": row["k"], "sound": tokens is not None, "n_a": n_a, "n_b": n_b, "n_links": int(times.sum()), "text": own[1], "codes": codes.astype(np.int64), "times": times, **vars(f)}], schema=kinds
            )

    ints = pa.list_(pa.int64())
    kinds = pa.schema(
        [("row", pa.int64()), ("row_doc", pa.int64()), ("k", pa.int64()), ("sound", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("text", pa.string()), ("codes", ints), ("times", ints), ("head_a", ints), ("head_b", ints), ("tail_a", ints), ("tail_b", ints), ("first", pa.int64()), ("closed", pa.int64()), ("joined", pa.list_(pa.struct([("at", pa.int64()), ("text", pa.string())])))]
    )
    ddl = "row bigint, row_doc bigint, k bigint, sound boolean, n_a bigint, n_b bigint, n_links bigint, text string, codes array<bigint>, times array<bigint>, " + _FRAGMENT
    return ranges_.mapInArrow(step, ddl)


def _compose(parts: DataFrame, most: int) -> DataFrame:
    """(row, fragment of the whole document): neighbours are composed FAN at a time, in as many rounds as the longest needs."""
    names = ["head_a", "head_b", "tail_a", "tail_b", "first", "closed", "joined"]

    def fold(key: tuple, group_: pd.DataFrame) -> pd.DataFrame:
        whole = Fragment()
        for r in group_.sort_values("k").itertuples():
            whole = whole.then(Fragment(list(r.head_a), list(r.head_b), list(r.tail_a), list(r.tail_b), r.first, r.closed, [(x["at"], x["text"]) for x in r.joined]))
        values = vars(whole) | {"joined": [{"at": at, "text": text} for at, text in whole.joined]}
        return pd.DataFrame({"row": [key[0]], "k": [key[1]], **{n: [values[n]] for n in names}})

    tree = parts.select("row", "k", *names)
    while most > 0:
        most //= FAN
        tree = tree.groupBy("row", F.floor(F.col("k") / FAN).alias("step")).applyInPandas(fold, "row bigint, k bigint, " + _FRAGMENT)

    def close(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                w = Fragment(list(r.head_a), list(r.head_b), list(r.tail_a), list(r.tail_b), r.first, r.closed, [(x["at"], x["text"]) for x in r.joined]).whole()
                # The group that begins the document closes in the range of the first common end.
                out.append((r.row, w.closed, [{"at": at, "text": text} for at, text in w.joined], r.first >= 0 and not w.tail_a and not w.tail_b))
            yield pd.DataFrame(out, columns=["row", "n_groups", "joined", "complete"])

    return tree.mapInPandas(close, "row bigint, n_groups bigint, joined array<struct<at: bigint, text: string>>, complete boolean")


def _digests(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(row, digest): the groups of a document pass in order, those that close between ranges before the range they end in."""
    between = whole.select("row", F.explode("joined").alias("j")).select("row", F.col("j.at").alias("k"), F.lit(0).alias("turn"), "j.text")
    pieces = parts.select("row", "k", F.lit(1).alias("turn"), "text").where("text <> ''").unionByName(between)

    @releasing
    def step(batches):
        row, digest = None, None
        for batch in batches:
            for key, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != row:
                    if row is not None:
                        yield pa.record_batch({"row": pa.array([row], pa.int64()), "digest": [digest.hexdigest()]})
                    row, digest = key, sha256(text.encode())
                else:
                    digest.update(b";" + text.encode())
        if row is not None:
            yield pa.record_batch({"row": pa.array([row], pa.int64()), "digest": [digest.hexdigest()]})

    return pieces.repartition("row").sortWithinPartitions("row", "k", "turn").select("row", "text").mapInArrow(step, "row bigint, digest string")


_RESULT = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(), "groups_sha256": pa.string()}


def _sums(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the counts of their links summed."""
    row = block.to_pylist()[0]
    order = np.argsort(counts.column("code").to_numpy(), kind="stable")
    count, best = counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
    pairs = np.array(row["pairs"], np.int64)
    owner = np.repeat(np.arange(len(pairs)), pairs)
    total, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    if len(owner):
        at = np.frombuffer(row["places"], np.uint16 if len(row["codes"]) <= 1 << 16 else np.uint32)
        times = np.frombuffer(row["times"], np.uint32).astype(np.int64)
        np.add.at(total, owner, times * count[at])
        np.add.at(top, owner, times * best[at])
    n_a, n_b, n_groups = (np.array(row[c], np.int64) for c in ("n_a", "n_b", "n_groups"))
    values = (row["doc_id"], n_a, n_b, n_groups, n_a + n_b - n_groups, top, total, row["digest"])
    return pa.table([pa.array(v, t) for v, t in zip(values, _RESULT.values(), strict=True)], names=list(_RESULT))


def align(docs: DataFrame, file_a: str, file_b: str, chunk: int = CHUNK, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document's numbers of tokens, groups and links, its links' counts, and the digest of its groups."""
    files = (file_a, file_b)
    dealt = materialize(_deal(docs, files, chunk, block_chars), "dealt")
    blocks = dealt.where("block is not null").select("block", *_LISTS, "places", "times")
    own = blocks.select("block", F.explode(F.arrays_zip("codes", "n_docs")).alias("p")).select("block", F.col("p.codes").alias("code"), F.col("p.n_docs").alias("n"))
    most = dealt.agg(F.max("k")).first()[0]
    held = own.select("code", "n")
    if most is not None:
        split = dealt.where("row is not null").select("row", "row_doc", "k", "low", "high", "text").repartition("row", "k")
        parts = materialize(_fragments(split, files), "parts")
        whole = materialize(_compose(parts, most), "whole")
        sums = parts.groupBy("row").agg(F.first("row_doc").alias("doc_id"), F.min("sound").alias("sound"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("n_links").alias("n_links"))
        sums = materialize(sums.join(whole.select("row", "n_groups", "complete"), "row").withColumn("sound", F.col("sound") & F.col("complete")), "sums")
        pairs = parts.join(sums.where("sound").select("row"), "row", "left_semi").select("row", F.explode(F.arrays_zip("codes", "times")).alias("p"))
        pairs = materialize(pairs.groupBy("row", F.col("p.codes").alias("code")).agg(F.sum("p.times").alias("times")), "pairs")
        held = held.unionByName(pairs.select("code", F.lit(1).cast("bigint").alias("n")))
    counts = materialize(held.groupBy("code").agg(F.sum("n").alias("count")), "counts")
    most_of = counts.groupBy(F.shiftright("code", 16).alias("a")).agg(F.max("count").alias("most"))
    scored = counts.join(most_of, F.shiftright("code", 16) == F.col("a")).select("code", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))
    scored = materialize(scored, "scored")
    answers = own.select(F.col("block").alias("asking"), "code").join(scored, "code")
    ddl = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    out = blocks.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(_sums, ddl)
    if most is None:
        return out
    linked = pairs.join(scored, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    long = sums.join(linked, "row", "left").join(_digests(parts, whole), "row", "left")
    number = lambda c: F.when(F.col("sound"), F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c)
    digest = F.when(F.col("sound"), F.col("digest")).otherwise(F.lit("")).alias("groups_sha256")
    return out.unionByName(long.select("doc_id", *[number(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], digest))
