"""N-gram Jaccard join with set-relation skipping: exact links between texts whose shingle sets are alike.

A document's set are its distinct shingles of so many words, as 64-bit hashes. Two sets link if their Jaccard
similarity is at least a percentage; a document's component is the least doc_id that links reach. Shingle size and
percentage are arguments; SHINGLE and PERCENT are those of op10_jaccard_join.

1. Documents with equal sets form a class, which is one set from then on.
2. Prefixes: the least hashes of a set, as many percent as similarity may lack (15 % at 85), and another 5 %. Linked
   sets share at least 5 % of the smaller set there (4 % of their size at 85), so a set that shares fewer tokens with
   others has no links. Of those that remain, each set's most frequent tokens are
   left away as far as at least one shared token is still sure.
3. Pools: sets that share a token meet in the pool of the token's least set. Near copies share nearly all tokens, so a
   set is in few pools. A token's least set and frequency are partially aggregated and joined back, so that the sets of
   a frequent token need not meet in one task.
4. Large pools are first compared with one set each, the pivot: sets linked with it are in one component and need no
   comparison with each other. That goes on with the next pivot for as long as it halves what is left. Only sets outside
   of their pool's component are then compared with all blocks of the pool.
5. In a pool or a pair of blocks, index lists hold the sets of each shingle in order of size, with a pointer for each
   block of postings. A set's overlaps are counted from the lists, whose blocks are skipped up to the first set whose
   size can fit; or they are derived from the counts of a similar set before it by the lists of those shingles alone in
   which the two differ. Sets that are linked already are skipped. Only links that join two components leave the pool, so
   no pairs within groups are listed.
6. Components of these links by star steps on tables.

Words are stretches without white space after A-Z are lower-cased. A text of fewer words than a shingle is one shingle;
null texts and texts without words have an empty set and no links. Rows that repeat are in the same component. Rows
with a null doc_id have the component of the others, null if there is none. An empty table gives no row. Very long texts
make blocks of fewer sets; bytes that are no UTF-8 are parts of words. Columns beside doc_id and text are not looked at.
Shingles are compared by 64-bit hashes, whole sets by their size and 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslink.llm.common import STEP_CHARS, SegmentHasher, materialize, mix, pick, raw_texts, releasing, scratch, slices
from newslink.operators.graph import components

SHINGLE = 4
PERCENT = 85
#: Sets and shingles that a block of a pool has on average at most.
BLOCK, BLOCK_TOKENS = 512, 500_000
#: Postings between two pointers into the index lists.
SKIP = 64
#: Documents up to which their ids are broadcast to choose them; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t + b"\n" for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    step = np.diff(np.concatenate(([0], (~_GAP[data]).astype(np.int8), [0])))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    words = SegmentHasher(data).of(starts, stops)
    bounds = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))).tolist()
    rolled = words.copy()
    for k in range(1, size):
        rolled[: len(words) - k] = mix(rolled[: len(words) - k] * _MULTIPLIER + words[k:])
    out, begin = [], 0
    for end in bounds:
        if end - begin >= size:
            out.append(np.unique(rolled[begin : end - size + 1]))
        elif end > begin:
            short = np.array([end - begin], np.uint64)
            for k in range(begin, end):
                short = mix(short * _MULTIPLIER + words[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def _name(values: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _least(n, percent: int):
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def _prefix_length(n, percent: int):
    """Hashes in the prefix of a set of n; at most n, as n is at least 1 and percent some tens."""
    return n - _least(n, percent) + 1 + n // 20


def _named(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], dict]:
    """The sets of a batch, and the columns that name them."""
    sets = shingle_sets(raw_texts(batch.column("text")), size)
    names = [_name(s) for s in sets]
    columns = {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "name": [x for x, _ in names], "check": [y for _, y in names]}
    return sets, {k: v if k == "doc_id" else pa.array(v, pa.int64()) for k, v in columns.items()}


def _with_sets(rows: DataFrame, size: int) -> DataFrame:
    """rows without their column text, with the set's hashes as bytes; rows of empty sets go."""
    names = [c for c in rows.columns if c != "text"]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("tokens", T.BinaryType())])

    @releasing
    def make(batches):
        for batch in slices(batches, "text", STEP_CHARS):
            texts = raw_texts(batch.column("text"))
            # A document's rows come one after the other: its set is made once.
            new = [i for i, t in enumerate(texts) if not i or t != texts[i - 1]]
            sets = [s.tobytes() for s in shingle_sets([texts[i] for i in new], size)]
            tokens = pa.array([sets[k] for k in np.searchsorted(new, np.arange(len(texts)), side="right") - 1], pa.binary())
            out = pa.record_batch([*(batch.column(c) for c in names), tokens], names=[*names, "tokens"])
            yield out.filter(pc.greater(pc.binary_length(tokens), 0))

    return rows.mapInArrow(make, schema)


def _prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, name, check, and each set's prefix, once for equal sets that come together (else null)."""

    @releasing
    def make(batches):
        for batch in slices(batches, "text", STEP_CHARS):
            sets, columns = _named(batch, size)
            seen, lengths = set(), np.full(len(sets), -1)
            for i, s in enumerate(sets):
                key = columns["name"][i].as_py()
                if len(s) and key not in seen:
                    seen.add(key)
                    lengths[i] = _prefix_length(len(s), percent)
            offsets = pa.array(np.append(0, np.cumsum(np.maximum(lengths, 0))), pa.int32(), mask=np.append(lengths < 0, False))
            flat = np.concatenate([s[: max(0, k)] for s, k in zip(sets, lengths, strict=True)])
            yield pa.record_batch(columns | {"prefix": pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))})

    return docs.mapInArrow(make, "doc_id bigint, n bigint, name bigint, check bigint, prefix array<bigint>")


def pools(prefixes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pool, name, n: which sets must be compared with each other; and share, how much of a set's prefix others have.

    The prefixes of linked sets share 1 + m // 20 tokens at least, m being the smaller size; a partner of a set of n has
    n * percent / 100 or more, so `sure` holds for any partner.
    """
    rows = prefixes.select("name", "n", F.explode("prefix").alias("token"))
    shared = rows.groupBy("token").agg(F.min("name").alias("pool"), F.max("name").alias("high"), F.count(F.lit(1)).alias("often")).where("pool <> high").drop("high")
    # Written, so that the join reads both sides from shuffles and can split a frequent token's rows among tasks.
    shared = materialize(shared, "tokens")
    # Under another name and value, the token's rows can be split among tasks: nothing after the join asks for them together.
    live = rows.join(shared, "token").select("pool", "often", F.bitwise_not("token").alias("other"), "name", "n").distinct()
    by_set = W.partitionBy("name", "n")
    sure: Column = F.lit(1) + F.floor(F.lit(percent) * F.col("n") / 2000)
    ranked = live.withColumns({"own": F.count(F.lit(1)).over(by_set), "rank": F.row_number().over(by_set.orderBy("often", "other"))})
    share = F.col("own") / F.expr(f"n - (({percent} * n + 99) div 100) + 1 + n div 20")
    return ranked.where((F.col("own") >= sure) & (F.col("rank") <= F.col("own") - sure + 1)).select("pool", "name", "n", share.alias("share")).distinct()


def pool_links(names: list[int], sets: list[np.ndarray], percent: int = PERCENT, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links within a pool that join two components, as pairs of names; groups are the components known before."""
    groups = groups or list(range(len(sets)))
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i]))
    sets, names = [sets[i] for i in order], [names[i] for i in order]
    group = np.unique([groups[i] for i in order], return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.append(0, np.cumsum(sizes))
    own = [token[bounds[i] : bounds[i + 1]] for i in range(len(sets))]
    # Postings in order of token, then of set; every SKIP-th one is a pointer to its block.
    postings = np.sort(token * len(sets) + np.repeat(np.arange(len(sets)), sizes))
    pointers = postings[::SKIP]
    lists = postings % len(sets)
    at = np.append(0, np.cumsum(np.bincount(token)))

    def count(tokens: np.ndarray, low: int) -> np.ndarray:
        """How many of the tokens each set from `low` on has; blocks of postings before it are skipped."""
        begin, end = at[tokens], at[tokens + 1]
        if low:
            block = np.searchsorted(pointers, tokens * len(sets) + low, side="right") - 1
            begin = np.minimum(np.maximum(begin, block * SKIP), end)
        lengths = end - begin
        where = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return np.bincount(lists[where], minlength=len(sets))

    links: list[tuple[int, int]] = []
    last, base, base_low = -1, np.zeros(0, np.int64), 0
    lows = np.searchsorted(sizes, _least(sizes, percent))
    for i in range(1, len(sets)):
        low = int(lows[i])
        if low >= i or (group[low:i] == group[i]).all():
            continue
        if last >= 0 and base_low <= low and 2 * base[i] > sizes[i]:
            gone, come = np.setdiff1d(own[last], own[i], assume_unique=True), np.setdiff1d(own[i], own[last], assume_unique=True)
            now = base - count(gone, base_low) + count(come, base_low)
        else:
            base_low = low
            now = count(own[i], low)
        last, base = i, now
        both = now[low:i]
        hits = low + np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[low:i] - both))
        for j in hits.tolist():
            if group[i] != group[j]:
                links.append((names[i], names[j]))
                group[group == max(group[i], group[j])] = min(group[i], group[j])
    return links


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_KEYS = ["pool", "first", "second"]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], []))], schema=_PAIRS)


def _pool_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b: class ids) of all pools and pairs of blocks; rows of one come one after the other."""

    @releasing
    def link(batches: Iterator[pa.RecordBatch]):
        key, sets, groups = None, {}, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_KEYS, "class_id", "component", "tokens")]
            for *k, ident, component, tokens in zip(*columns, strict=True):
                if k != key:
                    if len(sets) > 1:
                        yield _pairs(pool_links([i for i, _ in sets], list(sets.values()), percent, list(groups.values())))
                    key, sets, groups = k, {}, {}
                sets[ident, tokens], groups[ident, tokens] = np.frombuffer(tokens, np.uint64), component
        if len(sets) > 1:
            yield _pairs(pool_links([i for i, _ in sets], list(sets.values()), percent, list(groups.values())))

    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS).select(*_KEYS, "class_id", "component", "tokens").mapInArrow(link, "a bigint, b bigint")


def _pivot_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Links of each pool's pivot, which comes first in every block, with the sets of the block."""

    @releasing
    def link(batches: Iterator[pa.RecordBatch]):
        key, ident, pivot = None, 0, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for pool, first, own, tokens in zip(*(batch.column(c).to_pylist() for c in ("pool", "first", "class_id", "tokens")), strict=True):
                values = np.frombuffer(tokens, np.uint64)
                if (pool, first) != key:
                    key, ident, pivot = (pool, first), own, values
                else:
                    both = int((pivot[np.minimum(np.searchsorted(pivot, values), len(pivot) - 1)] == values).sum())
                    if 100 * both >= percent * (len(pivot) + len(values) - both):
                        found.append((ident, own))
            yield _pairs(found)

    return rows.repartition("pool", "first").sortWithinPartitions("pool", "first", "rank").select("pool", "first", "class_id", "tokens").mapInArrow(link, "a bigint, b bigint")


def _central(among: Column | None = None) -> Column:
    """The set of a group that shares most of its prefix with others, as the original of near copies does."""
    order = F.struct("share", -F.col("class_id"))
    return F.max_by("class_id", order if among is None else F.when(among, order))


class _Linker:
    """The pools of one join with the class ids of their sets; tokens are made again from the documents when needed."""

    def __init__(self, texts: DataFrame, classes: DataFrame, members: DataFrame, size: int, percent: int):
        self.texts, self.size, self.percent = texts, size, percent
        found = materialize(members.join(classes.where("class_id is not null").select("name", "n", "class_id"), ["name", "n"]).select("pool", "class_id", "n", "share"), "found")
        sizes = found.groupBy("pool").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"), _central().alias("pivot")).where("size > 1")
        sizes = materialize(sizes, "sizes")
        blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
        self.pools = materialize(found.join(sizes, "pool").select("pool", "class_id", "share", "pivot", blocks.alias("blocks")), "pools")

    def with_tokens(self, rows: DataFrame) -> DataFrame:
        """The rows of a written table with their sets' hashes; a doc_id with several texts has a row for each."""
        few = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        met = self.texts.join(F.broadcast(rows) if few else rows, F.col("doc_id") == F.col("class_id")).drop("doc_id")
        return _with_sets(met, self.size)

    def small(self) -> DataFrame:
        rows = self.pools.where("blocks = 1").select("pool", F.lit(0).alias("first"), F.lit(0).alias("second"), "class_id", F.col("class_id").alias("component"))
        return _pool_edges(self.with_tokens(rows), self.percent)

    def large(self) -> DataFrame | None:
        """Links of pools of several blocks: rounds of pivots, then what lies outside of their components."""
        state = self.pools.where("blocks > 1").withColumn("component", F.col("class_id"))
        left = state.count()
        if not left:
            return None
        edges, ids = None, state.select("class_id").distinct()
        while True:
            block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
            rest = state.where("class_id <> pivot").select("pool", block.alias("first"), "class_id", F.lit(1).alias("rank"))
            pivots = state.where("class_id = pivot").select("pool", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("first"), "class_id", F.lit(0).alias("rank"))
            found = _pivot_edges(self.with_tokens(materialize(rest.unionByName(pivots), "pivots")), self.percent)
            edges = materialize(found if edges is None else edges.unionByName(found), "pivot-links")
            label = components(edges)
            named = ids.join(label, F.col("class_id") == F.col("id"), "left").select("class_id", F.coalesce("component", "class_id").alias("component"))
            named = materialize(named, "named")
            homes = state.where("class_id = pivot").select("pool", "class_id").join(named, "class_id").select("pool", F.col("component").alias("home"))
            state = materialize(state.drop("component").join(named, "class_id").join(materialize(homes, "homes"), "pool"), "labelled")
            outside = F.col("component") != F.col("home")
            nexts = state.groupBy("pool").agg(_central(outside).alias("next"), F.count_if(outside).alias("outside"), F.count(F.lit(1)).alias("all"))
            state = materialize(state.join(materialize(nexts.where("outside > 0"), "nexts"), "pool"), "outside")
            before, left = left, state.where("component <> home").count()
            if not left:
                return edges
            if 2 * left > before:
                break
            state = state.select("pool", "class_id", "share", F.col("next").alias("pivot"), "blocks", "component")
        # Blocks of the component's sets come before those of the others; pairs of two of the former are not made.
        state = state.withColumn("out", F.ceil(F.col("blocks") * F.col("outside") / F.col("all")).cast("int"))
        hashed = F.xxhash64("class_id")
        inner = state.where("component = home").select("pool", "class_id", "component", F.pmod(hashed, F.col("blocks")).cast("int").alias("first"), F.explode(F.sequence(F.col("blocks"), F.col("blocks") + F.col("out") - 1)).alias("second"))
        own = F.col("blocks") + F.pmod(hashed, F.col("out")).cast("int")
        outer = state.where("component <> home").select("pool", "class_id", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") + F.col("out") - 1)).alias("other"))
        outer = outer.select("pool", "class_id", "component", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
        return edges.unionByName(_pool_edges(self.with_tokens(materialize(inner.unionByName(outer), "blocks")), self.percent))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id; one row for each row of docs."""
    texts = pick(docs, doc_id="bigint", text="string")
    named = materialize(_prefixes(texts, size, percent), "prefixes")
    names = named.select("doc_id", "n", "name", "check")
    classes = names.where("n > 0").groupBy("name", "check", "n").agg(F.min("doc_id").alias("class_id"))
    linker = _Linker(texts, classes, materialize(pools(named.where("prefix is not null"), percent), "members"), size, percent)
    edges, large = linker.small(), linker.large()
    linked = components(edges if large is None else edges.unionByName(large))
    owned = names.join(classes, ["name", "check", "n"], "left").join(linked, F.col("class_id") == F.col("id"), "left")
    return owned.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, but only those of the least doc_id of each component.

    Rows with a null doc_id stay, as do all rows of a doc_id that stays; null and empty texts stay. Columns of any name may
    be among them; an empty table gives no row.
    """
    with scratch():
        found = jaccard_components(docs, size, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__copy_id")).distinct()
        copies = materialize(found, "copies", keep=True)
    few = copies.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(copies) if few else copies, docs["doc_id"].cast("bigint") == F.col("__copy_id"), "left_anti")


ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 3], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
arcs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM arcs UNION SELECT r.doc_id, a.y FROM reach r JOIN arcs a ON r.other = a.x)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(m, words.doc_id), words.doc_id) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)"""
