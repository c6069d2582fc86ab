"""Change analytics over HTML and text revisions: cleaning, blocks, token diffs, merged change views."""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newslink.operators.timeline import ranged, revision_range
from newslink.sources.storage import discard, materialize

#: Classes (one, or a whole attribute), ids (their first element) and tags that are stripped from article
#: HTML; void elements; elements that are diffed; beginnings of lines that a wiki parser reports about itself.
DROP_CLASSES = ("mw-editsection", "sisterproject", "coordinates plainlinks-print", "references", "NavFrame erweiterte-navigationsleiste navigation-not-searchable erw-nav-farbschema-blau")
DROP_IDS = ("Weblinks", "Einzelnachweise", "Vorlage_Begriffsklärungshinweis", "Literatur", "normdaten")
DROP_TAGS = ("li", "sup")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("title", "h1", "p", "th")
REPORT_LINES = ("NewPP", "Cache expiry", "CPU time usage", "Real time usage", "Preprocessor visited node count", "Post-expand", "Unstrip", "RevisionOutputCache", "Transclusion expansion time report", "Saved in parser cache")
TOKEN = re.compile(r"\w+|[^\w\s]|\s+")


class _Rewriter(HTMLParser):
    """Copies HTML, leaving elements out or unwrapping internal links."""

    def __init__(self, strip: bool):
        super().__init__(convert_charrefs=False)
        self.strip, self.out, self.skipping, self.seen_ids, self.links = strip, [], [], set(), []
        self.hidden = 0  # depth of skipping from which on nothing has an id any more

    def _by_class(self, attrs: dict) -> bool:
        names = (attrs.get("class") or "").split()
        return any(c in names or c == " ".join(names) for c in DROP_CLASSES)

    def _drops(self, tag: str, attrs: dict) -> bool:
        """Classes go first, then the first element left of each id (which may be in an element that goes by its tag)."""
        if not self.strip:
            return False
        if self._by_class(attrs):
            self.hidden = self.hidden or len(self.skipping) + 1
            return True
        ident = attrs.get("id")
        if not self.hidden and ident in DROP_IDS and ident not in self.seen_ids:
            self.seen_ids.add(ident)
            self.hidden = len(self.skipping) + 1
            return True
        return tag in DROP_TAGS

    def handle_starttag(self, tag, attrs):
        drops = self._drops(tag, dict(attrs))
        if self.skipping or drops:
            if tag not in VOID:
                self.skipping.append(tag)
            elif self.hidden > len(self.skipping):
                self.hidden = 0
            return
        href = dict(attrs).get("href") or ""
        if tag == "a":
            self.links.append((len(self.out), href.startswith("/wiki/") and not href.startswith("/wiki/File:") or href.startswith("/w/") and "File:" not in href))
        self.out.append(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        if self._drops(tag, dict(attrs)):
            if self.hidden > len(self.skipping):
                self.hidden = 0
        elif not self.skipping:
            self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
                if self.hidden > len(self.skipping):
                    self.hidden = 0
            return
        if tag == "a" and self.links:
            at, internal = self.links.pop()
            if internal and not any(x.startswith("<img") for x in self.out[at + 1 :]):
                self.out[at] = ""
                return
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skipping:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def handle_comment(self, data):
        self.handle_data(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.handle_data(f"<!{decl}>")


def rewrite_html(text: str | None, strip: bool) -> str:
    parser = _Rewriter(strip)
    parser.feed(text or "")
    parser.close()
    return "".join(parser.out)


@F.pandas_udf(T.StringType())
def clean_html(content: pd.Series) -> pd.Series:
    """Unwanted elements and line breaks removed, internal links replaced by their text."""
    return content.map(lambda x: rewrite_html(x, True).replace("\n", ""))


@F.pandas_udf(T.StringType())
def unwrap_links(content: pd.Series) -> pd.Series:
    return content.map(lambda x: rewrite_html(x, False))


def rewritten(pages: DataFrame, strip: bool) -> DataFrame:
    """pages(article_id, revid, content) with clean_html's (strip) or unwrap_links' contents, few pages a slice."""
    schema = pages.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [rewrite_html(x, strip) for x in batch.column("content").to_pylist()]
            content = pa.array([x.replace("\n", "") for x in done] if strip else done, pa.string())
            yield pa.RecordBatch.from_arrays([content if c == "content" else batch.column(c) for c in schema.names], names=schema.names)

    return pages.mapInArrow(rewrite, schema)


def blocks(pages: DataFrame) -> DataFrame:
    """(article_id, revid, ts, tag, idx, text): the k-th title, h1, p and th of each revision, counted from 1 for each tag.

    Elements within those of another tag count (a p within a th is a block, and part of the th's text); one within an
    element of its own tag is part of that. An element that is not closed is none. Pages without content have none.
    """
    found = [F.struct(F.lit(t).alias("tag"), F.regexp_extract_all("content", F.lit(rf"(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}>"), F.lit(1)).alias("texts")) for t in BLOCKS]
    rows = pages.select("article_id", "revid", "ts", F.explode(F.array(*found)).alias("b"))
    rows = rows.select("article_id", "revid", "ts", "b.tag", F.posexplode("b.texts").alias("idx", "text"))
    return rows.withColumn("idx", (F.col("idx") + 1).cast("bigint"))


def with_previous(revisions: DataFrame) -> DataFrame:
    """Each revision with the predecessor's content and id (null for the first, and for revisions without an article).

    The order is that of (ts, revid), of equal ones that of a hash of the content. Revisions are compared within ranges of
    (article, time). A range's first revision of an article has its predecessor in an earlier range: the ranges' last ones
    are found by their ids, and the contents of those needed, fewer than there are ranges, are joined. So an article with
    most of the revisions is many tasks.
    """
    order = ["ts", "revid", "__hash"]
    rows = ranged(revisions.withColumn("__hash", F.xxhash64("content")), "article_id", *order)
    w = W.partitionBy("part", "article_id").orderBy(*order)
    near = rows.withColumns({"prev_content": F.lag("content").over(w), "prev_revid": F.lag("revid").over(w), "__turn": F.row_number().over(w)})
    last = rows.where("article_id is not null").groupBy("article_id", "part").agg(F.max(F.struct(*order, "part")).alias("__last"))
    before = F.lag("__last").over(W.partitionBy("article_id").orderBy("part"))
    carried = last.select(F.col("article_id").alias("__article"), F.col("part").alias("__part"), before.alias("__last")).where("__last is not null")
    found = rows.select("article_id", F.struct(*order, "part").alias("__last"), F.col("revid").alias("__revid"), F.col("content").alias("__content"))
    # Only the first article of a range can have earlier ranges, so these ids are at most one row for each range.
    carried = F.broadcast(carried).join(found, (F.col("article_id") == F.col("__article")) & carried["__last"].eqNullSafe(found["__last"]))
    carried = carried.select("__article", "__part", "__revid", "__content").dropDuplicates(["__article", "__part"])
    out = near.join(carried, (F.col("article_id") == F.col("__article")) & (F.col("part") == F.col("__part")), "left")
    there = F.col("article_id").isNotNull()
    prev = {c: F.when(there, F.when(F.col("__turn") == 1, F.col(f"__{c}")).otherwise(F.col(f"prev_{c}"))).alias(f"prev_{c}") for c in ("content", "revid")}
    return out.select(*revisions.columns, *prev.values())


def align(pages: DataFrame) -> DataFrame:
    """Blocks of a revision beside the same block (tag, index) of its predecessor; others are left out."""
    order = with_previous(pages.select("article_id", "revid", "ts", F.lit("").alias("content"))).where("prev_revid is not null").select("article_id", "revid", "prev_revid")
    found = blocks(pages).select("article_id", "revid", "tag", "idx", "text")
    old = found.select("article_id", F.col("revid").alias("prev_revid"), "tag", "idx", F.col("text").alias("old_text"))
    return found.join(order, ["article_id", "revid"]).join(old, ["article_id", "prev_revid", "tag", "idx"])


#: Sides whose lengths multiply to so much at most are compared by longest matching blocks as they are.
SMALL = 256 * 256
#: Widths of the anchors tried in larger ones, and the most edits that are traced one by one where there is no anchor.
WIDTHS, MOST = (12, 4, 1), 500


def _anchors(a: list[int], b: list[int], width: int) -> list[tuple[int, int]]:
    """Places of stretches of `width` tokens that occur once on either side, those that keep their order (longest such chain)."""

    def single(x: list[int]) -> dict:
        found: dict = {}
        for i, key in enumerate(zip(*(x[k:] for k in range(width)), strict=False)):
            found[key] = -1 if key in found else i
        return found

    there = single(b)
    pairs = [(i, j) for key, i in single(a).items() if i >= 0 and (j := there.get(key, -1)) >= 0]
    pairs.sort()
    tails: list[int] = []  # least end of an increasing chain of each length
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        back[k] = at[place - 1] if place else -1
        tails[place : place + 1], at[place : place + 1] = [j], [k]
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _traced(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Matching blocks by the shortest edit script: found in rows of bits, of sides of over ROOM cells traced up to MOST edits (Myers).

    All diagonals of an edit number are extended at once. What was reached on diagonal k is at place k + MOST + 2.
    """
    n, m, middle, trace = len(a), len(b), MOST + 2, []
    if n * m <= ROOM:
        return _subsequence(a, b)
    left, right = np.asarray(a), np.asarray(b)
    ends = np.zeros(2 * middle + 1, np.int64)
    for d in range(min(MOST, n + m) + 1):
        trace.append(ends[middle - d - 1 : middle + d + 2].copy())
        ks = np.arange(-d, d + 1, 2)
        below, above = ends[middle - d + 1 : middle + d + 2 : 2], ends[middle - d - 1 : middle + d : 2]
        down = above < below
        down[-1] = False
        down[0] = True
        x = np.where(down, below, above + 1)
        going = np.arange(len(x))
        while len(going):
            at, to = x[going], x[going] - ks[going]
            inside = (at < n) & (to < m)
            going = going[inside][left[at[inside]] == right[to[inside]]]
            x[going] += 1
        ends[middle - d : middle + d + 1 : 2] = x
        if ((x >= n) & (x - ks >= m)).any():
            return _blocks_of(trace, n, m)
    return _subsequence(a, b)


def _blocks_of(trace: list[np.ndarray], x: int, y: int) -> list[tuple[int, int, int]]:
    """The matching blocks of a shortest edit script that ends at (x, y), from what was reached before each edit.

    trace[d] has diagonals -d - 1 to d + 1.
    """
    out = []
    for d in range(len(trace) - 1, 0, -1):
        reached, k = trace[d], x - y
        down = k == -d or (k != d and reached[k + d] < reached[k + d + 2])
        before = k + 1 if down else k - 1
        came = int(reached[before + d + 1])
        start = came + (not down)
        if x > start:
            out.append((start, start - k, x - start))
        x, y = came, came - before
    return [(0, 0, x)] * bool(x) + out[::-1]


#: Cells (lengths multiplied) whose rows of bits are held at once; larger sides are split.
ROOM = 1 << 28


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each token of a, an integer whose bit j is 0 where b's token j adds one to the longest common subsequence so far (Hyyrö)."""
    places: dict[int, bytearray] = {}
    for j, t in enumerate(b):
        places.setdefault(t, bytearray(len(b) // 8 + 1))[j >> 3] |= 1 << (j & 7)
    there = {t: int.from_bytes(places[t], "little") for t in set(a) & places.keys()}
    whole = (1 << len(b)) - 1
    row = whole
    for t in a:
        met = row & there.get(t, 0)
        row = ((row + met) | (row - met)) & whole
        yield row


def _common(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and of the first 0, 1, ... tokens of b."""
    row = 0
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _subsequence(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Matching blocks of a longest common subsequence, which is what a shortest edit script keeps, whatever its length.

    Rows of bits take the work of a 64th of the cells; sides of over ROOM cells are split where a's halves meet (Hirschberg).
    """
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        if (j - i) * (m - k) > ROOM and j - i > 1:
            half = (i + j) // 2
            at = k + int((_common(a[i:half], b[k:m]) + _common(a[half:j][::-1], b[k:m][::-1])[::-1]).argmax())
            todo += [(i, half, k, at), (half, j, at, m)]
            continue
        rows = list(_rows(a[i:j], b[k:m]))
        x, y = j - i, m - k
        while x and y:
            if rows[x - 1] >> (y - 1) & 1:
                y -= 1
                continue
            x -= 1
            if not x or rows[x - 1] >> (y - 1) & 1:
                y -= 1
                pairs.append((i + x, k + y))
    out: list[tuple[int, int, int]] = []
    for x, y in sorted(pairs):
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((x, y, 1))
    return out


#: Sides whose lengths multiply to so much at most are compared by difflib itself.
TINY = 400


def longest_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """What difflib's get_matching_blocks gives without junk: the longest common stretch, of equal ones the first in a, then in b, and so on either side.

    The lengths of all common stretches are a table; a search within bounds is one look at its part.
    """
    if len(a) * len(b) <= TINY:
        return [x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x[2]]
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    same = np.asarray(a)[:, None] == np.asarray(b)[None, :]
    if len(a) <= len(b):
        for i in range(len(a)):
            np.multiply(table[i, :-1] + 1, same[i], out=table[i + 1, 1:])
    else:
        for j in range(len(b)):
            np.multiply(table[:-1, j] + 1, same[:, j], out=table[1:, j + 1])
    runs = table[1:, 1:]
    most = np.minimum(np.arange(1, len(a) + 1, dtype=np.int32)[:, None], np.arange(1, len(b) + 1, dtype=np.int32)[None, :])
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        part = np.minimum(runs[i:j, k:m], most[: j - i, : m - k])
        x, y = divmod(int(part.argmax()), m - k)
        n = int(part[x, y])
        if not n:
            continue
        x, y = i + x - n + 1, k + y - n + 1
        found.append((x, y, n))
        if x > i and y > k:
            todo.append((i, x, k, y))
        if x + n < j and y + n < m:
            todo.append((x + n, j, y + n, m))
    out: list[tuple[int, int, int]] = []
    for x, y, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((x, y, n))
    return out


def matching_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of what two token sequences have in common, in order.

    Small sides by longest matching blocks. Larger ones lose their common ends and are cut at anchors, stretches of WIDTHS
    tokens that occur once on either side, as far as they keep their order and extended while tokens agree; what lies
    between is compared likewise. Without any anchor the shortest edit script is found, whatever its length, in rows of
    bits, 64 cells a step; of very large sides it is traced as far as MOST edits first.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= SMALL:
            out += [(i + x, k + y, n) for x, y, n in longest_blocks(a[i:j], b[k:m])]
            continue
        n = 0
        while i + n < j and k + n < m and a[i + n] == b[k + n]:
            n += 1
        if n:
            out.append((i, k, n))
            i, k = i + n, k + n
        n = 0
        while j - n > i and m - n > k and a[j - n - 1] == b[m - n - 1]:
            n += 1
        if n:
            out.append((j - n, m - n, n))
            j, m = j - n, m - n
        if (j - i) * (m - k) <= SMALL:
            todo.append((i, j, k, m))
            continue
        left, right = a[i:j], b[k:m]
        for width in WIDTHS:
            if found := _anchors(left, right, width):
                x = y = 0
                for p, q in found:
                    if p < x or q < y:
                        continue
                    n = width
                    while p > x and q > y and left[p - 1] == right[q - 1]:
                        p, q, n = p - 1, q - 1, n + 1
                    while p + n < len(left) and q + n < len(right) and left[p + n] == right[q + n]:
                        n += 1
                    out.append((i + p, k + q, n))
                    todo.append((i + x, i + p, k + y, k + q))
                    x, y = p + n, q + n
                todo.append((i + x, j, k + y, m))
                break
        else:
            out += [(i + x, k + y, n) for x, y, n in _traced(left, right)]
    return sorted(out)


def diff_tokens(old: str | None, new: str | None) -> list[dict]:
    """Runs of kept (' '), added ('+') and removed ('-') text."""
    a, b = TOKEN.findall(old or ""), TOKEN.findall(new or "")
    numbers: dict[str, int] = {}
    runs: list[dict] = []

    def add(op: str, tokens: list[str]) -> None:
        if tokens and runs and runs[-1]["op"] == op:
            runs[-1] = {"op": op, "text": runs[-1]["text"] + "".join(tokens), "tokens": runs[-1]["tokens"] + len(tokens)}
        elif tokens:
            runs.append({"op": op, "text": "".join(tokens), "tokens": len(tokens)})

    i = j = 0
    numbered = [[numbers.setdefault(t, len(numbers)) for t in side] for side in (a, b)]
    for x, y, n in [*matching_blocks(*numbered), (len(a), len(b), 0)]:
        add("-", a[i:x])
        add("+", b[j:y])
        add(" ", a[x : x + n])
        i, j = x + n, y + n
    return runs


OPS = "array<struct<op: string, text: string, tokens: bigint>>"
#: The same as a type: a string needs a running session when the module is imported.
OPS_TYPE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tokens", T.LongType())]))


@F.pandas_udf(OPS_TYPE)
def diff_ops(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([diff_tokens(a, b) for a, b in zip(old, new, strict=True)])


def side_of(ops: str, op: str) -> Column:
    """The whole text of one side of a diff: the old one with op '-', the new one with '+'."""
    return F.array_join(F.transform(F.filter(ops, lambda r: r["op"].isin(" ", op)), lambda r: r["text"]), "")


def revision_diff(revisions: DataFrame) -> DataFrame:
    """(article_id, revid, user_name, ops) for every changed revision; the first revision is one addition.

    Unchanged revisions are left out before the Python function sees them.
    """
    changed = with_previous(revisions).where(~F.col("content").eqNullSafe(F.col("prev_content")))
    # Diffs of one article are independent once each row has its predecessor: they are dealt to all tasks.
    changed = changed.repartition("article_id", "revid")
    return changed.select("article_id", "revid", "user_name", diff_ops(F.coalesce("prev_content", F.lit("")), "content").alias("ops"))


def token_delta(revisions: DataFrame) -> DataFrame:
    """(article_id, revid, token, added, removed): bags of words against the predecessor."""
    words = lambda c: F.explode(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    both = with_previous(revisions)
    new = both.select("article_id", "revid", words("content").alias("token"), F.lit(1).alias("d"))
    old = both.select("article_id", "revid", words("prev_content").alias("token"), F.lit(-1).alias("d"))
    d = new.unionByName(old).groupBy("article_id", "revid", "token").agg(F.sum("d").alias("d")).where("d <> 0")
    return d.select("article_id", "revid", "token", F.greatest("d", F.lit(0)).alias("added"), F.greatest(-F.col("d"), F.lit(0)).alias("removed"))


def is_report_line(text: Column) -> Column:
    """Whether a text begins with one of REPORT_LINES, in upper or lower case."""
    return F.coalesce(text, F.lit("")).rlike("(?i)^(?:" + "|".join(REPORT_LINES) + ")")


class _Nodes(HTMLParser):
    """HTML as a list of nodes (kind, value, tag): text is unescaped, everything else as it stands."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, str, str]] = []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.nodes.append(("start", self.get_starttag_text(), tag))

    def handle_startendtag(self, tag, attrs):
        self.nodes.append(("void", self.get_starttag_text(), tag))

    def handle_endtag(self, tag):
        self.nodes.append(("end", f"</{tag}>", tag))

    def handle_data(self, data):
        self.nodes.append(("raw" if self.cdata_elem else "text", data, ""))

    def handle_comment(self, data):
        self.nodes.append(("comment", f"<!--{data}-->", ""))

    def handle_decl(self, decl):
        self.nodes.append(("decl", f"<!{decl}>", ""))


class _Element:
    """An element of a page: its start and end as they stand (unclosed: no end), and nodes and elements between."""

    def __init__(self, tag: str, start: str):
        self.tag, self.start, self.end, self.children = tag, start, "", []

    def walk(self) -> Iterator:
        """Everything below in order: elements, nodes, and ends as texts of kind `end`."""
        todo = [iter(self.children)]
        opened: list[_Element] = []
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
                if opened:
                    done = opened.pop()
                    yield ("end", done.end, done.tag)
            elif isinstance(x, _Element):
                yield x
                todo.append(iter(x.children))
                opened.append(x)
            else:
                yield x

    def find(self, tag: str) -> list[_Element]:
        return [x for x in self.walk() if isinstance(x, _Element) and x.tag == tag]

    def text(self) -> str:
        return " ".join(x[1] for x in self.walk() if not isinstance(x, _Element) and x[0] == "text")

    def nodes(self) -> list[tuple[str, str, str]]:
        return [("start", x.start, x.tag) if isinstance(x, _Element) else x for x in self.walk()]


def _tree(text: str) -> _Element:
    """Elements by their tags alone: an end closes the last open element of its name and those within; others stand as they are."""
    root = _Element("", "")
    opened, names = [root], Counter()
    for node in _Nodes(text).nodes:
        kind, value, tag = node
        if kind == "start" and tag not in VOID:
            opened[-1].children.append(_Element(tag, value))
            opened.append(opened[-1].children[-1])
            names[tag] += 1
        elif kind == "end" and names[tag]:
            while True:
                done = opened.pop()
                names[done.tag] -= 1
                if done.tag == tag:
                    done.end = value
                    break
        else:
            opened[-1].children.append(node)
    return root


def _html(nodes: list) -> str:
    return "".join(html.escape(value, quote=False) if kind == "text" else value for kind, value, *_ in nodes)


def _span(op: str, text: str, user: str, color: str = "orange") -> list[tuple[str, str, str]]:
    style = f"background-color: {color};" if op == "+" else f"text-decoration: line-through; text-decoration-color: {color};"
    name = html.escape(user, quote=True)
    return [("start", f'<span style="{style}" user-{"add" if op == "+" else "del"}="{name}">', "span"), ("text", text, ""), ("end", "</span>", "span")]


def splice_diff(old: str | None, new: str | None, user: str | None, whole: bool = True) -> dict:
    """The new page (if whole) with the changes of each title, h1, p and th marked in spans, and the marks alone, in order.

    The k-th element of a tag is compared with the old page's k-th, by their texts joined by blanks, all titles first, then
    h1, p and th; a changed one has the marked text instead of what was in it. Elements within others count too: a p within a th
    is marked first, and the th, whose text then has both sides of the p, is marked over it. Elements that are not
    closed reach as far as what is around them. Elements without a counterpart stay as they are.
    """
    page, before = _tree(new or ""), _tree(old or "")
    for tag in BLOCKS:
        for then, now in zip(before.find(tag), page.find(tag), strict=False):
            a, b = then.text(), now.text()
            if a != b:
                now.children = [n for run in diff_tokens(a, b) for n in ([("text", run["text"], "")] if run["op"] == " " else _span(run["op"], run["text"], user or ""))]
    nodes = page.nodes()
    spans = [{"op": "+" if " user-add=" in value else "-", "text": nodes[i + 1][1]} for i, (kind, value, _) in enumerate(nodes) if kind == "start" and value.startswith("<span style=") and (" user-add=" in value or " user-del=" in value)]
    return {"html": _html(nodes) if whole else None, "spans": spans}


_SPLICED = T.StructType([T.StructField("html", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])))])


def html_diffs(pages: DataFrame, whole: bool = True) -> DataFrame:
    """(article_id, revid, user_name, html, spans) of every changed HTML revision against its predecessor; html is null unless whole.

    Few pages a slice are Python objects at a time: their marks take many times the room of the pages.
    """
    changed = with_previous(pages).where(~F.col("content").eqNullSafe(F.col("prev_content"))).repartition("article_id", "revid")
    changed = changed.select("article_id", "revid", "user_name", "prev_content", "content")
    schema = T.StructType([changed.schema[c] for c in ("article_id", "revid", "user_name")] + _SPLICED.fields)
    spliced = pa.schema([("html", pa.string()), ("spans", pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())])))])

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [splice_diff(*x, whole) for x in zip(*(batch.column(c).to_pylist() for c in ("prev_content", "content", "user_name")), strict=True)]
            made = pa.RecordBatch.from_pylist(done, schema=spliced)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("article_id", "revid", "user_name")] + made.columns, names=schema.names)

    return changed.mapInArrow(splice, schema)


#: Pages that are Python objects at a time.
PAGES = 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of PAGES rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            yield batch.slice(at, PAGES)


class _Piece:
    """A stretch of a text node: the nodes right before it, its text, the nodes right after it (last one first), the next piece."""

    __slots__ = ("before", "text", "after", "next")

    def __init__(self, before: list, text: str, after: list, following: _Piece | None = None):
        self.before, self.text, self.after, self.next = before, text, after, following


class _Page:
    """A page under marks: each text node may be cut into several pieces. Text nodes are found by the signs they began with.

    Pieces only become smaller, so the first one that has a text is never before the one that had it last: each text is
    looked for from there on, and the work follows marks and pieces, not their product.
    """

    GRAM = 3

    def __init__(self, parts: list[list[tuple[str, str, str]]]):
        """parts: the page's nodes, each with what it has become."""
        self.first: list[_Piece | None] = []
        self.tails: list[list[tuple[str, str, str]]] = []
        self.grams: dict[str, list[int]] = {}
        self.at: dict[str, list] = {}  # of each text looked for: its nodes, the place among them, the piece
        for i, nodes in enumerate(parts):
            first, last, held = None, None, []
            for node in nodes:
                if node[0] != "text":
                    held.append(node)
                    continue
                piece, held = _Piece(held, node[1], []), []
                if last is None:
                    first = piece
                else:
                    last.next = piece
                last = piece
            self.first.append(first)
            self.tails.append(held)
            if first is not None:
                text = "".join(value for kind, value, _ in nodes if kind == "text")
                for gram in {text[k : k + n] for n in range(1, self.GRAM + 1) for k in range(len(text) - n + 1)}:
                    self.grams.setdefault(gram, []).append(i)

    @classmethod
    def of(cls, html_: str) -> _Page:
        return cls([[n] for n in _Nodes(html_).nodes if n[0] != "comment"])

    @property
    def parts(self) -> list[list[tuple[str, str, str]]]:
        out = []
        for piece, tail in zip(self.first, self.tails, strict=True):
            nodes: list[tuple[str, str, str]] = []
            while piece is not None:
                nodes += piece.before
                nodes.append(("text", piece.text, ""))
                nodes += reversed(piece.after)
                piece = piece.next
            out.append(nodes + tail)
        return out

    def dump(self) -> str:
        """Texts as they are, other nodes by their number among the different ones."""
        kinds: dict[tuple[str, str, str], int] = {}
        parts = [[n[1] if n[0] == "text" else kinds.setdefault(n, len(kinds)) for n in nodes] for nodes in self.parts]
        return json.dumps([list(kinds), parts])

    @classmethod
    def load(cls, state: str) -> _Page:
        kinds, parts = json.loads(state)
        kinds = [tuple(n) for n in kinds]
        return cls([[kinds[n] if isinstance(n, int) else ("text", n, "") for n in nodes] for nodes in parts])

    def _nodes_with(self, text: str) -> list[int]:
        keys = [text] if len(text) <= self.GRAM else [text[k : k + self.GRAM] for k in range(len(text) - self.GRAM + 1)]
        return min((self.grams.get(k, []) for k in keys), key=len)

    def put(self, op: str, text: str, user: str, color: str) -> bool:
        """Mark the first piece that holds text; only nodes with its rarest sign sequence are looked at, in order."""
        if not text:
            return False
        place = self.at.get(text)
        if place is None:
            nodes = self._nodes_with(text)
            place = self.at[text] = [nodes, 0, self.first[nodes[0]] if nodes else None]
        nodes, k, piece = place
        while True:
            while piece is not None and text not in piece.text:
                piece = piece.next
            if piece is not None or k + 1 >= len(nodes):
                break
            k += 1
            piece = self.first[nodes[k]]
        place[1:] = k, piece
        if piece is None:
            return False
        before, after = piece.text.split(text, 1)
        start, _, end = _span(op, text, user, color)
        if after:
            piece.next, piece.after = _Piece([], after, piece.after, piece.next), []
        if before:
            piece.text, piece.next, piece.after = before, _Piece([start], text, [*piece.after, end], piece.next), []
        else:
            piece.text = text
            piece.before.append(start)
            piece.after.append(end)
        return True

    def html(self) -> str:
        return _html([n for nodes in self.parts for n in nodes if n[0] != "text" or not REPORT.match(n[1])])


def _put_marks(page: _Page, marks: list[tuple[str, list[dict]]]) -> int:
    put = 0
    for user, spans in marks:
        color = "#" + hashlib.md5((user or "").encode()).hexdigest()[:6]
        for span in sorted(spans, key=lambda x: x["op"] != "+"):
            put += page.put(span["op"], span["text"], user or "", color)
    return put


def merge_marks(base: str | None, marks: list[tuple[str, list[dict]]]) -> tuple[int, str]:
    """The base page with each mark put where its text first stands in a text node; how many were put.

    marks: user and spans, oldest first; of one user's spans additions come before deletions. A mark whose text stands
    nowhere is left out. Comments and lines that a wiki parser reports go; spans get the colour of their user.
    """
    page = _Page.of(base or "")
    put = _put_marks(page, marks)
    return put, page.html()


REPORT = re.compile("|".join(REPORT_LINES), re.IGNORECASE)


#: Revisions whose marks are put on a page in one step of a merged view.
STEP = 500


def change_view(requests: DataFrame, diffs: DataFrame, revisions: DataFrame, step: int = STEP) -> DataFrame:
    """requests(request, article_id, rev_a, rev_b): the last page between the times of the two, with every change in between.

    Gives request, number of marks put, html; the ends may be given in either order, revisions go by time, then revid. A
    mark depends on those before it, so a request's marks are put in order; but `step` revisions at a time: each round
    takes all requests' pages as the round before left them (a written snapshot) together with their next marks, so no
    group holds more than a page and the marks of `step` revisions. Requests go side by side.
    """
    within = revision_range(revisions.select("article_id", "revid", "ts"), requests).select("request", "article_id", "revid", "ts")
    turn = F.row_number().over(W.partitionBy("request").orderBy("ts", "revid")) - 1
    marked = within.withColumn("round", F.floor(turn / step).cast("bigint"))
    last = within.groupBy("request", "article_id").agg(F.max(F.struct("ts", "revid")).alias("last")).select("request", "article_id", F.col("last.revid").alias("revid"))
    base = last.join(revisions.select("article_id", "revid", F.col("content").alias("base")), ["article_id", "revid"])
    marks = materialize(marked.join(diffs.select("article_id", "revid", "user_name", "spans"), ["article_id", "revid"]).select("request", "round", "ts", "revid", "user_name", "spans"), "marks")
    kinds = "request bigint, marks bigint, parts string"

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"request": f["request"], "marks": 0, "parts": [_Page.of(x or "").dump() for x in f["base"]]})

    def merge(pages: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(more) or not len(pages):
            return pages[["request", "marks", "parts"]]
        page = _Page.load(pages["parts"].iloc[0])
        more = more.sort_values(["ts", "revid"])
        put = _put_marks(page, list(zip(more["user_name"], more["spans"], strict=True)))
        return pd.DataFrame({"request": pages["request"], "marks": pages["marks"] + put, "parts": [page.dump()]})

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"request": f["request"], "marks": f["marks"], "html": [_Page.load(x).html() for x in f["parts"]]})

    state = materialize(base.select("request", "base").mapInPandas(begin, kinds), "pages")
    rounds = marks.agg(F.max("round")).first()[0]
    for k in range(-1 if rounds is None else rounds + 1):
        old, state = state, materialize(state.groupBy("request").cogroup(marks.where(F.col("round") == k).groupBy("request")).applyInPandas(merge, kinds), "pages")
        discard(old)
    return state.mapInPandas(finish, "request bigint, marks bigint, html string")
