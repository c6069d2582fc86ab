"""Histories whose revisions come late, twice or in parts, and blocks of all tags, against plain versions."""

import os
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newslink.operators import revisions
from newslink.sources import keyed
from newslink.streaming import streams

START = datetime(2024, 1, 1)
SCHEMA = "article_id bigint, revid bigint, ts timestamp_ntz, user_name string, content string"


def diffs_by_hand(rows):
    """Each article's revisions in order of (ts, revid), changed ones with their runs."""
    found, last = {}, {}
    for article, revid, _, user, content in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        old, new = last.get(article, ""), content or ""
        if old != new:
            found[article, revid] = user, [(r["op"], r["text"], r["tokens"]) for r in revisions.diff_tokens(old, new)]
        last[article] = new
    return found


def result(df):
    rows = [((r.article_id, r.revid), (r.user_name, [tuple(o) for o in r.ops])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def add(spark, rows, source, path, buckets=4):
    if rows is not None:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return streams.history_diffs(spark.readStream.schema(SCHEMA).parquet(source), path, buckets)


def test_late_revisions_are_put_in_their_place(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        article = 1 if k % 3 else rng.randint(2, 5)  # article 1 holds most
        text = " ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) if rng.random() < 0.9 else None
        rows.append((article, k, START + timedelta(hours=rng.randint(0, 20)), f"u{k % 3}", text))
    rng.shuffle(rows)
    source, path, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for cut in (0, 25, 50):
        part = rows[cut : cut + 25 if cut < 50 else None]
        seen += part
        assert result(add(spark, part, source, path)) == diffs_by_hand(seen)
    stored = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(f"{path}/diffs") for f in files}
    assert result(add(spark, None, source, path)) == diffs_by_hand(rows)
    assert stored == {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(f"{path}/diffs") for f in files}


def test_late_revisions_change_what_follows_only(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda h: START + timedelta(hours=h)
    add(spark, [(1, 10, at(1), "u", "a b"), (1, 30, at(3), "u", "a b"), (1, 40, at(4), "u", "a b d"), (2, 5, at(1), "u", "z")], source, path)
    # Late: before an unchanged revision, which becomes a change; the same id again does not count, nor do rows without a place.
    late = [(1, 20, at(2), "v", "a c"), (1, 10, at(9), "w", "other"), (None, 7, at(1), "w", "x"), (2, None, at(1), "w", "x")]
    got = result(add(spark, late, source, path))
    assert got == diffs_by_hand([(1, 10, at(1), "u", "a b"), (1, 20, at(2), "v", "a c"), (1, 30, at(3), "u", "a b"), (1, 40, at(4), "u", "a b d"), (2, 5, at(1), "u", "z")])
    made = keyed.read_keyed(spark, f"{path}/diffs", spark.createDataFrame([], "article_id bigint, revid bigint, batch bigint").schema)
    assert sorted(r.revid for r in made.where("batch = 1").collect()) == [20, 30]
    # And back: a late revision with the text of its successor leaves that unchanged again.
    got = result(add(spark, [(1, 25, at(2) + timedelta(minutes=5), "x", "a b")], source, path))
    assert (1, 30) not in got and got[1, 25][0] == "x" and (1, 40) in got


def test_histories_without_rows(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    assert result(add(spark, [], source, path)) == {}
    assert result(add(spark, [(None, 1, START, "u", "a")], source, path)) == {}
    assert keyed.read_keyed(spark, str(tmp_path / "none"), spark.createDataFrame([], SCHEMA).schema).count() == 0


def test_both_sides_of_diffs_are_whole(spark):
    rows = [(1, k, START + timedelta(hours=k), "u", text) for k, text in enumerate(["Zwei Wörter,  ein\nAbsatz\t!", "", "a  b", None, "b c"])]
    both = revisions.revision_diff(spark.createDataFrame(rows, SCHEMA))
    got = sorted(both.select("revid", revisions.side_of("ops", "-"), revisions.side_of("ops", "+")).collect())
    texts = [r[4] or "" for r in rows]
    assert [tuple(r) for r in got] == [(k, texts[k - 1] if k else "", texts[k]) for k in range(5) if k != 3 or texts[2] != texts[3]]


PAGES = [
    "<title>T</title><H1 class='x'>A</H1><table><tr><th>one <p>in</p></th><th\n>two</th></tr></table><p>first</p><pre>no</pre><p>sec\nond</p>",
    "<p>open <p>again</p><thead>no</thead><param>",
    "",
    None,
]


def test_blocks_of_all_tags(spark):
    df = spark.createDataFrame([(1, k, START, "u", page) for k, page in enumerate(PAGES)], SCHEMA)
    got = sorted((r.revid, r.tag, r.idx, r.text) for r in revisions.blocks(df).collect())
    want = [(k, tag, i, m) for k, page in enumerate(PAGES) for tag in revisions.BLOCKS for i, m in enumerate(re.findall(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", page or ""), 1)]
    assert got == sorted(want)
    assert (0, "p", 1, "in") in got and (0, "th", 1, "one <p>in</p>") in got and (0, "th", 2, "two") in got and not [r for r in got if r[3] == "no"]


def test_aligned_blocks_of_all_tags(spark):
    pages = [(1, 1, START, "u", PAGES[0]), (1, 2, START + timedelta(hours=1), "u", PAGES[0].replace("two", "2").replace("<p>first</p>", ""))]
    got = {(r.tag, r.idx): (r.text, r.old_text) for r in revisions.align(spark.createDataFrame(pages, SCHEMA)).where(F.col("text") != F.col("old_text")).collect()}
    assert got == {("th", 2): ("2", "two"), ("p", 2): ("sec\nond", "first")}
