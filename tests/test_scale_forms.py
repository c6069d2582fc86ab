"""Forms that spread a hot key or a long text: against plain versions, and by how their work grows."""

import difflib
import ipaddress
import os
import random
import subprocess
import sys
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newslink.operators import dedup, events, revisions, tables, tfidf, timeline
from newslink.sources import keyed

START = datetime(2024, 1, 1)


def test_traced_blocks_are_longest_in_sum():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = revisions._traced(a, b)
        assert sum(n for *_, n in found) == best[-1][-1]
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found) and all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(found, found[1:]))


def sides(rng, n, share, words=None):
    words = words or [f"w{k}" for k in range(3000)]
    old = [rng.choice(words) for _ in range(n)]
    new = []
    for w in old:
        kind = rng.random()
        if kind < share / 3:
            continue
        new += [rng.choice(words)] if kind < 2 * share / 3 else [w, rng.choice(words)] if kind < share else [w]
    return " ".join(old), " ".join(new)


def check(runs, old, new):
    assert "".join(r["text"] for r in runs if r["op"] != "+") == old and "".join(r["text"] for r in runs if r["op"] != "-") == new
    assert all(r["tokens"] == len(revisions.TOKEN.findall(r["text"])) for r in runs) and all(x["op"] != y["op"] for x, y in zip(runs, runs[1:]))
    return sum(r["tokens"] for r in runs if r["op"] != " ")


@pytest.mark.parametrize("words", [None, ["a", "b"], ["x"]])
def test_large_diffs(monkeypatch, words):
    """Cut at anchors or traced, they rebuild both sides and mark about as much as longest matching blocks do."""
    rng = random.Random(2)
    for share in (0.0, 0.05, 0.5):
        old, new = sides(rng, 120, share, words)
        small = check(revisions.diff_tokens(old, new), old, new)
        with monkeypatch.context() as m:
            m.setattr(revisions, "SMALL", 30)
            assert check(revisions.diff_tokens(old, new), old, new) <= 1.5 * small + 8
    moved = " ".join(old.split()[60:] + old.split()[:60])
    monkeypatch.setattr(revisions, "SMALL", 30)
    check(revisions.diff_tokens(old, moved), old, moved)
    monkeypatch.setattr(revisions, "MOST", 3)
    check(revisions.diff_tokens("a b " * 40, "b b a " * 40), "a b " * 40, "b b a " * 40)


def test_small_diffs_are_longest_matching_blocks():
    rng = random.Random(3)
    for _ in range(50):
        old, new = sides(rng, rng.randint(0, 60), 0.3, [f"w{k}" for k in range(9)])
        a, b = revisions.TOKEN.findall(old), revisions.TOKEN.findall(new)
        want = [(op, text) for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() for op, text in ([(" ", "".join(a[i:j]))] if kind == "equal" else [("-", "".join(a[i:j])), ("+", "".join(b[k:m]))]) if text]
        assert [(r["op"], r["text"]) for r in revisions.diff_tokens(old, new)] == want


def test_long_pages_are_compared_in_seconds():
    old, new = sides(random.Random(4), 20_000, 0.05)
    began = time.time()
    changed = check(revisions.diff_tokens(old, new), old, new)
    assert time.time() - began < 5 and changed < 0.3 * 40_000
    worst = " ".join(random.Random(5).choice("ab") for _ in range(20_000))
    began = time.time()
    check(revisions.diff_tokens(worst, worst[::-1]), worst, worst[::-1])
    assert time.time() - began < 20


def test_as_of_with_a_hot_article(spark):
    rng = random.Random(6)
    times = [START + timedelta(minutes=rng.randint(0, 900)) for _ in range(400)]
    marks = [(1 if rng.random() < 0.7 else rng.randint(2, 6), t) for t in times] + [(None, START), (3, None)]
    points = [(k, 1 if rng.random() < 0.6 else rng.randint(2, 8), START + timedelta(minutes=rng.randint(-50, 950))) for k in range(300)] + [(900, None, START), (901, 1, None), (902, 7, START)]
    p = spark.createDataFrame(points, "point bigint, article_id bigint, v timestamp_ntz")
    r = spark.createDataFrame(marks, "article_id bigint, ts timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {x.point: (x.before, x.after) for x in timeline.as_of(p, r).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(points)
    for k, article, v in points:
        own = [t for a, t in marks if a == article and t is not None and article is not None and v is not None]
        assert got[k] == (max((t for t in own if t <= v), default=None), min((t for t in own if t >= v), default=None)) if own else got[k] == (None, None)
    assert timeline.as_of(p, r.limit(0)).where("before is not null").count() == 0 and timeline.as_of(p.limit(0), r).count() == 0


def test_networks_by_brute_force(spark):
    rng = random.Random(7)
    nets = []
    for k in range(120):
        if rng.random() < 0.6:
            plen = rng.choice([0, 4, 8, 9, 16, 23, 24, 31, 32])
            base = ipaddress.ip_network((rng.choice([10, 255, 0]) << 24 | rng.randint(0, 3) << 16 | rng.choice([0, 255]) << 8 | rng.randint(250, 255), plen), strict=False)
        else:
            base = ipaddress.ip_network((rng.choice([0x20010DB8 << 96, (1 << 128) - 1]) ^ rng.randint(0, 7), rng.choice([0, 3, 32, 125, 127, 128])), strict=False)
        since, until = (START + timedelta(days=rng.randint(0, 9)) if rng.random() < 0.5 else None for _ in range(2))
        nets.append((str(base), since, until, k % 50, f"org{k}"))
    names = ["10.0.0.255", "10.1.255.250", "255.255.255.255", "0.0.0.0", "9.9.9.9", "2001:db8::1", "2001:db8::", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "user", "1.2.3", "300.1.1.1", None]
    log = [(i, rng.choice(names) if i > len(names) else names[i % len(names)], START + timedelta(days=rng.randint(-1, 10), hours=rng.choice([0, 5]))) for i in range(150)]
    got = {r.revid: (r.plen, r.asn, r.org) for r in timeline.enrich_ips(spark.createDataFrame(log, "revid bigint, user_name string, ts timestamp_ntz"), spark.createDataFrame(nets, "prefix string, since timestamp_ntz, until timestamp_ntz, asn bigint, org string")).collect()}
    want = {}
    for revid, name, ts in log:
        try:
            address = ipaddress.ip_address(name or "")
        except ValueError:
            continue
        fits = [(n.prefixlen, asn, org) for text, since, until, asn, org in nets if address in (n := ipaddress.ip_network(text)) and (since is None or since <= ts) and (until is None or ts < until)]
        if fits:
            want[revid] = max(fits)
    assert got == want


@pytest.mark.parametrize("step", [1, 3, 500])
def test_merged_view_goes_by_time(spark, step):
    """Revision 15 is older than both ends of the request, 25 has no time between them."""
    at = {20: 5, 15: 1, 10: 3, 30: 9, 25: 12, 12: 7, 11: 7}
    pages = spark.createDataFrame([(1, r, START + timedelta(hours=h), f"<p>base {r} one two three</p>") for r, h in at.items()], "article_id bigint, revid bigint, ts timestamp_ntz, content string")
    texts = {20: "one", 15: "two", 10: "three", 30: "30", 25: "base", 12: "one", 11: "two"}
    diffs = spark.createDataFrame([(1, r, f"u{r}", [("+", t)]) for r, t in texts.items()], "article_id bigint, revid bigint, user_name string, spans array<struct<op: string, text: string>>")
    asked = spark.createDataFrame([(1, 1, 10, 30), (2, 1, 30, 10), (3, 1, 15, 15), (4, 1, 99, 10)], "request bigint, article_id bigint, rev_a bigint, rev_b bigint")
    rows = {r.request: r for r in revisions.change_view(asked, diffs, pages, step).collect()}
    put, page = revisions.merge_marks("<p>base 30 one two three</p>", [(f"u{r}", [{"op": "+", "text": texts[r]}]) for r in (10, 20, 11, 12, 30)])
    assert (rows[1].marks, rows[1].html) == (rows[2].marks, rows[2].html) == (put, page) and put == 5
    assert rows[3].marks == 1 and "u15" in rows[3].html and 4 not in rows  # there is no revision 99


def test_page_index_finds_the_first_node():
    """The same as looking through all nodes."""
    rng = random.Random(8)
    for _ in range(60):
        base = "".join(rng.choice(["<p>", "</p>", "a", "ab", " ", "ba&amp;", "<!--c-->", "x"]) for _ in range(40))
        marks = [("".join(rng.choice("ab &x") for _ in range(rng.randint(1, 5))), rng.choice("+-")) for _ in range(12)]
        nodes = [n for n in revisions._Nodes(base).nodes if n[0] != "comment"]
        page = revisions._Page.of(base)
        for text, op in marks:
            hit = next((i for i, n in enumerate(nodes) if n[0] == "text" and text in n[1]), None)
            assert page.put(op, text, "u", "c") == (hit is not None)
            if hit is not None:
                before, after = nodes[hit][1].split(text, 1)
                nodes[hit : hit + 1] = [("text", before, "")] * bool(before) + revisions._span(op, text, "u", "c") + [("text", after, "")] * bool(after)
        assert [n for part in page.parts for n in part] == nodes


def added(text):
    return f'<span style="background-color: orange;" user-add="u">{text}</span>'


def removed(text):
    return f'<span style="text-decoration: line-through; text-decoration-color: orange;" user-del="u">{text}</span>'


def test_blocks_within_blocks_and_unclosed_ones():
    splice = lambda old, new: revisions.splice_diff(old, new, "u")["html"]
    # An unclosed block reaches as far as what is around it; what follows it is in it.
    assert splice("<div><p>one two</div><p>x", "<div><p>one three</div><p>x") == f"<div><p>one {removed('two')}{added('three')}</div><p>x"
    # A p within a p belongs to the outer one, which is marked as a whole.
    assert splice("<p>a<p>b</p></p>", "<p>a<p>c</p></p>") == f"<p>a {removed('b')}{added('c')}</p>"
    # A th is marked over its p, whose text has both sides then.
    got = revisions.splice_diff("<table><th><p>red</p></th></table>", "<table><th><p>blue</p></th></table>", "u")
    assert got["html"] == f"<table><th>red{added(' blue')}</th></table>" and got["spans"] == [{"op": "+", "text": " blue"}]
    # The k-th of a tag is compared, wherever it stands; ends without a start stay.
    assert splice("<h1>t</h1><p>a</p>", "</i><div><p>a</p></div><h1>u</h1></p>") == f"</i><div><p>a</p></div><h1>{removed('t')}{added('u')}</h1></p>"
    assert splice("<p>" * 3000 + "a", "<p>" * 3000 + "a") == "<p>" * 3000 + "a"


def test_folders_go_with_the_session(tmp_path):
    """Materialised tables are deleted when the session's JVM ends, also those outside of scratch; outputs stay."""
    code = f"""
from pyspark.sql import SparkSession
from newslink.sources.storage import materialize, output_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert materialize(spark.range(9), "nine").count() == 9
spark.range(5).write.parquet(output_dir(spark, "kept"))
import os
assert any(x.startswith("session-") for x in os.listdir("{tmp_path}"))
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=120)
    left = [os.path.join(d, f) for d, _, files in os.walk(tmp_path) for f in files]
    assert left and all("/outputs/kept-" in x for x in left) and not [x for x in os.listdir(tmp_path) if x.startswith("session-")]


def test_latest_source_row_wins(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 0)], "k bigint, v string, at int")
    source = spark.createDataFrame([(2, "x", 3), (2, "y", 5), (2, "z", 4), (3, "p", None), (3, "q", 1), (None, "m", 9)], "k bigint, v string, at int")
    got = sorted(((r.k, r.v, r.at) for r in tables.upsert(target, source, "k", ["v", "at"]).collect()), key=str)
    assert got == sorted([(1, "a", 1), (2, "y", 5), (3, "q", 1), (None, "n", 0), (None, "m", 9)], key=str)


def test_first_ids_by_number(spark):
    rng = random.Random(9)
    rows = [(i - 5, rng.choice(["a", "b", None]), rng.choice([None, START, START - timedelta(days=30_000), START + timedelta(days=1)])) for i in range(40)] + [(2**63 - 1, "c", START), (-(2**63), "c", START), (7_000, "d", None), (6_999, "d", None)]
    df = spark.createDataFrame(rows, "id bigint, k string, pubtime timestamp_ntz")
    want = {min((r for r in rows if r[1] == k), key=lambda r: (r[2] is None, -(r[2] - START).total_seconds() if r[2] else 0, r[0]))[0] for k in {r[1] for r in rows}}
    assert {r.id for r in dedup.first_ids(df, ["k"], by_time=True).collect()} == want
    assert {r.id for r in dedup.first_ids(df, ["k"]).collect()} == {max(r[0] for r in rows if r[1] == k) for k in {r[1] for r in rows}}
    plan = dedup.first_ids(df, ["k"], by_time=True)._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_version_policy(spark):
    """A family of two keeps both; of four equal texts two stay, of six all; different texts come back."""
    rows = []
    for family, texts in enumerate([["same words here now"] * 2, ["same words here now"] * 4, ["same words here now"] * 6, ["alpha beta gamma", "delta iota kappa", "rho sigma tau", "phi chi psi"]]):
        rows += [(len(rows) + i, f"https://s.ch/x/f{family}-{i}", f"head {family}", f"c{len(rows) + i}", t, START + timedelta(hours=i)) for i, t in enumerate(texts)]
    art = spark.createDataFrame(rows, "id bigint, article_link string, head string, content_id string, content string, pubtime timestamp_ntz")
    kept = lambda policy: {f: sum(r.head == f"head {f}" for r in dedup.dedup_articles(art, 0.85, policy).collect()) for f in range(4)}
    assert kept("reference") == {0: 2, 1: 2, 2: 6, 3: 4}
    assert kept("newest_only") == {0: 1, 1: 1, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        dedup.dedup_articles(art, 0.85, "other")


def test_vocabulary_changes_a_cluster(spark):
    """Two articles share rare words only: with the two most frequent terms of the day they are no longer alike."""
    texts = ["common usual rarely seldom", "common rarely seldom", "common usual usual usual", "usual common common"]
    art = spark.createDataFrame([(i, START + timedelta(hours=i), "", t) for i, t in enumerate(texts)], "id bigint, pubtime timestamp_ntz, head string, content string")
    entities = spark.createDataFrame([], "id bigint, entity string, weight bigint")
    groups = lambda n: {(r.leader, r.id) for r in events.leader_clusters(art, entities, 0.6, vocabulary=n).collect()}
    assert (0, 1) in groups(5000) and groups(5000) != groups(2)


def test_predecessors_of_a_hot_article(spark):
    """Half of all revisions are of one article, over many ranges, with equal times, repeated rows, nulls and other columns."""
    rng = random.Random(10)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 30), k, START + timedelta(minutes=rng.randint(0, 200)), None if k % 17 == 0 else f"text {k}", k) for k in range(400)]
    rows += [(1, 7000, START, "same", 0)] * 3 + [(None, 8000, START, "none", 0), (None, 8001, START, "none", 0), (99, 9000, None, "", 1)]
    df = spark.createDataFrame(rows, "article_id bigint, revid bigint, ts timestamp_ntz, content string, __other bigint").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = revisions.with_previous(df)
    got = sorted(((r.article_id, r.revid, r.prev_revid, r.prev_content, r["__other"]) for r in out.collect()), key=str)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = [], {}
    for a, r, ts, text, other in sorted(rows, key=lambda x: (x[0] or 0, x[2] is not None, x[2] or START, x[1])):
        want.append((a, r, *((last.get(a) or (None, None)) if a is not None else (None, None)), other))
        last[a] = (r, text)
    assert got == sorted(want, key=str) and out.columns == [*df.columns, "prev_content", "prev_revid"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("content" not in line or "part" in line.split("[", 2)[-1] for line in plan.splitlines() if "Window [" in line)
    assert revisions.with_previous(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.85])
def test_bounds_lose_no_pair_and_leave_few(spark, threshold):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(25)) for _ in range(120)]
    texts += [t + " extra" for t in texts[:10]] + texts[:3]
    docs = spark.createDataFrame([(f"b{i % 2}", i, t) for i, t in enumerate(texts)], "block string, id bigint, text string")
    w = tfidf.tfidf(tfidf.term_frequency(docs))
    bags = {}
    for r in w.collect():
        bags.setdefault((r.block, r.id), {})[r.term] = r.w
    exact = {(a[1], b[1]): sum(x * bags[b].get(t, 0) for t, x in bags[a].items()) for a in bags for b in bags if a[0] == b[0] and a[1] < b[1]}
    want = {p for p, sim in exact.items() if sim > threshold}
    found = {(r.i, r.j): r.sim for r in tfidf.pairs_of(w, threshold).collect()}
    assert set(found) == want and all(abs(found[p] - exact[p]) < 1e-9 for p in want)
    shared = tfidf.shared_terms(w)
    verified = tfidf.candidates(shared, threshold).count()
    prefix = shared.where(F.col("suffix") >= threshold * threshold).select("block", "term", "id")
    sharing = prefix.join(prefix.withColumnRenamed("id", "j"), ["block", "term"]).where("id < j").select("id", "j").distinct().count()
    assert len(want) <= verified < sharing


def folders(path):
    return {d: os.stat(os.path.join(path, d)).st_mtime_ns for d in os.listdir(path) if d.startswith("bucket=")}


def test_keyed_upsert_touches_few_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "keyed"), "k bigint, v string, at int"
    target = spark.createDataFrame([(i, f"v{i}", 0) for i in range(500)] + [(None, "n", 0)], schema)
    keyed.write_keyed(target, path, ["k"], 32)
    before = folders(path)
    source = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (900, "new", 1), (None, "m", 1)], schema)
    numbers = keyed.upsert_keyed(path, source, "k", ["v", "at"], 32)
    after = folders(path)
    assert len(numbers) <= 3 and -1 in numbers and {d for d in after if after[d] != before.get(d)} == {f"bucket={k}" for k in numbers}
    got = sorted((tuple(r) for r in keyed.read_keyed(spark, path, target.schema).collect()), key=str)
    assert got == sorted([(i, f"v{i}", 0) for i in range(500) if i != 3] + [(3, "y", 2), (900, "new", 1), (None, "n", 0), (None, "m", 1)], key=str)
    assert keyed.upsert_keyed(path, source.where("k is not null"), "k", ["v", "at"], 32) == [k for k in numbers if k >= 0]
    assert sorted((tuple(r) for r in keyed.read_keyed(spark, path, target.schema).collect()), key=str) == got
    assert keyed.upsert_keyed(path, source.limit(0), "k", ["v", "at"], 32) == []
    read = keyed.read_buckets(source, path, numbers)
    assert {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()} == {str(k) for k in numbers}


def test_batches_written_again_double_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id bigint, c string"
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], schema)
    second = spark.createDataFrame([(5, "b"), (6, "c"), (7, "c")], schema)
    for number, batch in ((0, first), (1, second), (1, second), (0, first)):
        keyed.append_new(path, batch, number, ["c"], ["id"], 8)
    got = sorted(tuple(r) for r in keyed.read_keyed(spark, path, first.schema).collect())
    assert got == [(1, "a"), (3, "b"), (4, None), (6, "c")]
