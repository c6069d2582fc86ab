"""What the findings of round 3 ask for: work and shuffles that follow the input."""

import difflib
import random
import re
from datetime import datetime

import pyarrow as pa
import pytest

from newslink import registry
from newslink.operators import cosine, events, revisions, tfidf, timeline
from newslink.operators import titles as T
from newslink.sources import tsv


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summaries_shuffle_numbers_of_sentences(spark):
    """a sentence's text goes neither with each of its terms nor through their joins."""
    members = spark.createDataFrame([("c", 1, "Rain falls. Rain stops. Sun."), ("c", 2, "Rain falls again."), ("d", 3, None)], "leader string, id bigint, content string")
    clusters = spark.createDataFrame([("c",), ("d",)], "leader string")
    out = T.summaries(clusters, members, 2)
    assert not re.search(r"hashpartitioning\([^)]*sentence", plan_of(out))
    assert {r["leader"]: r["summary"] for r in out.collect()} == {"c": "Rain falls again. Rain falls.", "d": T.NO_SUMMARY}


def test_summaries_beyond_the_broadcast(spark, monkeypatch):
    """more terms than are broadcast give the same."""
    members = spark.createDataFrame([("c", 1, "Rain falls. Rain stops. Sun."), ("c", 2, "Rain falls again.")], "leader string, id bigint, content string")
    clusters = spark.createDataFrame([("c",)], "leader string")
    there = T.summaries(clusters, members, 3).collect()
    monkeypatch.setattr(T, "BROADCAST_TERMS", 0)
    assert T.summaries(clusters, members, 3).collect() == there


@pytest.mark.parametrize("strict", [True, False])
def test_tiles_give_all_pairs(spark, monkeypatch, strict):
    """Blocks of many chunks, of one, and of single documents, against brute force, in small steps."""
    for name, value in (("CHUNK", 300), ("LEAST", 100), ("CELLS", 500)):
        monkeypatch.setattr(cosine, name, value)
    rng = random.Random(3)
    texts = [(f"b{0 if i < 90 else i % 7}", i, " ".join(f"w{min(50, int(rng.expovariate(0.1)))}" for _ in range(15))) for i in range(130)]
    texts += [("b0", 200 + i, texts[i][2]) for i in range(5)] + [("alone", 300, "w1 w2"), ("empty", 301, ""), ("empty", 302, None)]
    w = tfidf.tfidf(tfidf.term_frequency(spark.createDataFrame(texts, "block string, id bigint, text string").repartition(5)))
    bags = {}
    for r in w.collect():
        bags.setdefault((r.block, r.id), {})[r.term] = r.w
    exact = {(*a, b[1]): sum(x * bags[b].get(t, 0) for t, x in bags[a].items()) for a in bags for b in bags if a[0] == b[0] and a[1] < b[1]}
    got = {(r.block, r.i, r.j): r.sim for r in tfidf.pairs_of(w, 0.4, strict).collect()}
    assert set(got) == {k for k, v in exact.items() if v > 0.4} and all(abs(got[k] - exact[k]) < 1e-9 for k in got)
    assert len({k[0] for k in got}) > 3


def test_similar_pairs_make_no_rows_of_common_terms(spark):
    """F8: documents meet in tiles; no join has a row for each two documents with a common term."""
    docs = spark.createDataFrame([("b", i, f"usual common w{i % 3}") for i in range(30)], "block string, id bigint, text string")
    plan = plan_of(tfidf.similar_pairs(docs, 0.35))
    assert "FlatMapGroupsInArrow" in plan and not re.search(r"hashpartitioning\([^)]*term", plan)


def test_leader_clusters_of_all_terms(spark):
    """the query has no cut of the vocabulary, neither in its SQL nor in its code."""
    assert "5000" not in registry.oracle_sql()["leader_clusters"]
    texts = ["common usual rarely seldom", "common rarely seldom", "common usual usual usual", "usual common common"]
    art = spark.createDataFrame([(i, datetime(2024, 1, 1, i), "", t) for i, t in enumerate(texts)], "id bigint, pubtime timestamp_ntz, head string, content string")
    entities = spark.createDataFrame([], "id bigint, entity string, weight bigint")
    groups = lambda n: {(r.leader, r.id) for r in events.leader_clusters(art, entities, 0.6, vocabulary=n).collect()}
    assert groups(None) == groups(5000)


def test_terms_are_counted_where_texts_are(spark):
    """texts are shuffled once, terms are not; expressions are not evaluated again as a filter."""
    docs = spark.createDataFrame([("b", 1, "one two one two three"), ("b", 2, "the one"), ("c", 3, None), ("c", 4, "two")], "block string, id bigint, text string")
    for df, want in (
        (tfidf.term_frequency(docs), {(1, "one"): 2, (1, "two"): 2, (1, "three"): 1, (2, "one"): 1, (4, "two"): 1}),
        (tfidf.bigram_frequency(docs), {(1, "one two"): 2, (1, "two one"): 1, (1, "two three"): 1}),
    ):
        plan = plan_of(df)
        assert not re.search(r"hashpartitioning\([^)]*term", plan) and "regexp_extract_all" not in "".join(x for x in plan.splitlines() if "Filter" in x)
        assert {(r.id, r.term): r.tf for r in df.collect()} == want


def test_longest_blocks_are_those_of_difflib():
    """blocks of a table of common stretches, the same as difflib's."""
    rng = random.Random(4)
    for k in range(150):
        a, b = ([rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.choice((0, 1, 30, 120, 250)))] for _ in "ab")
        if k % 3 == 0:
            b = a[:40] + b[:50] + a[60:]
        want = [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x[2]]
        assert [tuple(x) for x in revisions.longest_blocks(a, b)] == want


def test_pages_are_few_objects_at_a_time():
    """a batch of many pages is cut before its pages become Python objects."""
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(revisions.slices(iter([batch])))
    assert max(x.num_rows for x in parts) <= revisions.PAGES and [v for x in parts for v in x.column(0).to_pylist()] == list(range(1000))


def test_networks_of_the_same_prefix_and_period_are_one(spark):
    """stretches are covered by different prefixes and periods, however many networks there are."""
    rows = [("10.0.0.0/16", None, None, k, f"o{k}") for k in range(50)] + [("10.0.0.0/16", datetime(2024, 1, 2), None, 7, "late"), ("10.0.1.0/24", None, None, 1, "near")]
    networks = spark.createDataFrame(rows, "prefix string, since timestamp_ntz, until timestamp_ntz, asn bigint, org string")
    written = []
    real = timeline.materialize
    timeline.materialize = lambda df, name: written.append((name, out := real(df, name))) or out
    try:
        log = spark.createDataFrame([(1, "10.0.0.9", datetime(2024, 1, 3)), (2, "10.0.1.9", datetime(2024, 1, 3))], "revid bigint, user_name string, ts timestamp_ntz")
        got = {(r.revid, r.plen, r.asn, r.org) for r in timeline.enrich_ips(log, networks).collect()}
    finally:
        timeline.materialize = real
    assert got == {(1, 16, 49, "o49"), (2, 24, 1, "near")}
    assert next(df for name, df in written if name == "networks").count() == 3


def test_rewritten_pages_are_those_of_the_functions(spark):
    """cleaned in slices, the same contents."""
    pages = spark.createDataFrame([(1, 2, '<p>a\n<sup>x</sup><a href="/wiki/B">b</a></p>'), (1, 3, None)], "article_id bigint, revid bigint, content string")
    for strip, function in ((True, revisions.clean_html), (False, revisions.unwrap_links)):
        out = revisions.rewritten(pages, strip)
        assert "MapInArrow" in plan_of(out) and set(out.collect()) == set(pages.withColumn("content", function("content")).collect())


def test_tsv_is_written_with_little_effort(spark):
    """F16: xz's default effort takes most of the query's time; rows come back as they were."""
    assert tsv.PRESET <= 1
    df = spark.createDataFrame([("1", "a\tb", 'c"\nd'), ("2", None, "é")], "id string, head string, content string")
    got = {(r.id, r.head, r.content, r.medium_name) for r in tsv.read_xz(spark, tsv.write_xz(df)).collect()}
    assert got == {("1", "a\tb", 'c"\nd', None), ("2", None, "é", None)}
