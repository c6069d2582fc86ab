"""Small cases with known answers, and properties."""

import random
from collections import Counter
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newslink.functions import scalars as S
from newslink.operators import dedup, events, graph, revisions, tables, tfidf, timeline
from newslink.streaming import streams


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_dedup_of_equal_heads_and_segments(spark):
    rows = [
        (0, "https://www.one.ch/a/story", "Head A", "c0", "some words about a first topic here", datetime(2024, 1, 1, 8)),
        (1, "https://www.one.ch/b/other-story", "Head B", "c1", "entirely different material on sport", datetime(2024, 1, 1, 9)),
        (2, "https://www.one.ch/a/story", "Head A", "c2", "some words about a first topic there", datetime(2024, 1, 1, 10)),
        (3, "https://www.two.ch/c/third", "Head C", "c3", "weather and rain in the mountains", datetime(2024, 1, 1, 11)),
        (4, "https://www.three.ch/d/story", "Head D", "c4", "politics of a far away country", datetime(2024, 1, 1, 12)),
    ]
    art = spark.createDataFrame(rows, "id bigint, article_link string, head string, content_id string, content string, pubtime timestamp_ntz")
    assert sorted(r.id for r in dedup.dedup_articles(art, 0.85).collect()) == [1, 3, 4]


@pytest.mark.parametrize("url", ["art-810941-0", "art-810941-1", "art-810941", "art-5", "art"])
def test_version_key(spark, url):
    assert one(spark, S.version_key, f"https://x.ch/preview/{url}") == one(spark, S.version_key, "https://x.ch/art-1")


@pytest.mark.parametrize(("text", "want"), [("{Bern,\"Kanton, Stadt\"}", ["Bern", "Kanton, Stadt"]), ("{}", [])])
def test_array_literal(spark, text, want):
    assert one(spark, S.parse_array_literal, text) == want


def test_scalars(spark):
    assert one(spark, S.clean_text, None) == ""
    assert one(spark, S.clean_text, "<p>A&amp;B https://x.y/z c</p>") == "A B c"
    assert one(spark, S.base_link, "no url") == "" and one(spark, S.base_link, None) == ""
    assert one(spark, S.url_last_segment, "https://a.ch/x/y;p?q=1#f") == "y"
    assert one(spark, S.slug, "Zürich%20(Stadt)") == "zuerich--stadt"
    assert one(spark, S.slug, "123").startswith("container-")
    colors = {one(spark, S.user_color, u) for u in ("Alice", "Bob")}
    assert len(colors) == 2 and all(len(c) == 7 for c in colors)
    assert [one(spark, S.editor_type, u) for u in ("1.2.3.4", "2001:db8::1", "Alice", "abc")] == ["ipv4", "ipv6", "registered", "registered"]


def test_date_parameter():
    today = date(2024, 3, 10)
    assert [tables.date_parameter(t, today) for t in ("latest", "2024-03-01", "2025-01-01", None)] == [date(2024, 3, 8), date(2024, 3, 1), date(2024, 3, 8), date(2024, 3, 8)]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="head"):
        tables.require_columns(spark.range(1), ["id", "head"])


def test_links_are_unwrapped():
    text = 'see <a href="/wiki/Bern">Bern</a>, <a href="/wiki/File:X.png"><img src="x"></a> <a href="https://e.org">e</a>'
    assert revisions.rewrite_html(text, False) == 'see Bern, <a href="/wiki/File:X.png"><img src="x"></a> <a href="https://e.org">e</a>'


def test_unwanted_elements_go():
    kept = '<div id="toc">a</div><p class="navbox">b</p><i id="Literatur">second</i><!--c--><b class="coordinates">d</b>'
    for c in revisions.DROP_CLASSES:
        assert revisions.rewrite_html(f'x<div class="{c}"><b>gone</b><br></div>y', True) == "xy"
    for i in revisions.DROP_IDS:
        assert revisions.rewrite_html(f'x<h2 id="{i}">gone</h2>y<i id="{i}">stays</i>', True) == f'xy<i id="{i}">stays</i>'
    assert revisions.rewrite_html(f'<i id="Literatur">first</i>{kept}<ul><li>e<li>f</li></li></ul><sup>1</sup>', True) == f"{kept}<ul></ul>"
    # An id within an element that goes by its tag is the first one; within one that goes by its class it is not.
    assert revisions.rewrite_html('<li><b id="Weblinks">x</b></li><b id="Weblinks">y</b>', True) == '<b id="Weblinks">y</b>'
    assert revisions.rewrite_html('<p class="references"><b id="Weblinks">x</b></p><b id="Weblinks">y</b>', True) == ""


def test_report_lines(spark):
    lines = [*revisions.REPORT_LINES, "newpp limit report", " NewPP", "Complications of the treaty", "Transclusion of a painting", "", None]
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", revisions.is_report_line(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [True] * (len(revisions.REPORT_LINES) + 1) + [False] * 5


@pytest.mark.parametrize(
    ("old", "new", "added", "removed"),
    [("Die Sonne scheint!", "Die helle warme Sonne scheint!", "helle warme ", ""), ("Ein sehr alter Baum.", "Ein Baum.", "", "sehr alter "), ("Rot, blau, gelb.", "Rot, lila, gelb.", "lila", "blau"), ("Am Rand?", "Am oberen Rand?", "oberen ", "")],
)
def test_token_diff(old, new, added, removed):
    runs = revisions.diff_tokens(old, new)
    bag = lambda op: Counter(t for r in runs if r["op"] == op for t in revisions.TOKEN.findall(r["text"]))
    assert bag("+") == Counter(revisions.TOKEN.findall(added)) and bag("-") == Counter(revisions.TOKEN.findall(removed))


def plain_text(page):
    return "".join(v for k, v, _ in revisions._Nodes(page).nodes if k == "text")


def test_diffs_are_spliced_into_the_page():
    old = "<html><title>T</title><h1>Eins</h1><p class='a'>Rot <b>und</b> blau.</p><div>x</div><p>gleich &amp; gut</p></html>"
    new = "<html><title>T</title><h1>Eins</h1><p class='a'>Rot <b>und</b> gelb.</p><div>y</div><p>gleich &amp; gut</p><p>neu</p></html>"
    got = revisions.splice_diff(old, new, 'u"1')
    assert got["html"] == "<html><title>T</title><h1>Eins</h1><p class='a'>Rot  und  " + '<span style="text-decoration: line-through; text-decoration-color: orange;" user-del="u&quot;1">blau</span><span style="background-color: orange;" user-add="u&quot;1">gelb</span>.</p><div>y</div><p>gleich &amp; gut</p><p>neu</p></html>'
    assert got["spans"] == [{"op": "-", "text": "blau"}, {"op": "+", "text": "gelb"}]
    assert revisions.splice_diff(new, new, "u") == {"html": new, "spans": []} and revisions.splice_diff(None, new, "u")["html"] == new


def test_marks_are_put_into_text_nodes():
    base = "<p title='user'>the user said user &lt;b&gt;</p><!--NewPP--><div>NewPP limit report</div>"
    put, page = revisions.merge_marks(base, [("u", [{"op": "+", "text": "user"}]), ("v", [{"op": "-", "text": "span"}, {"op": "+", "text": "user"}]), (None, [{"op": "-", "text": "<b>"}])])
    assert put == 3 and plain_text(page) == "the user said user <b>" and "NewPP" not in page
    assert page.startswith("<p title='user'>the <span style=") and page.count("<span ") == page.count("</span>") == 3
    assert '<span style="background-color: #7b774e;" user-add="u"><span' in page or page.count('user-add="v">user</span></span>') == 1


def test_longest_network_at_the_time_of_the_edit(spark):
    at = lambda day: datetime(2024, 1, day)
    nets = [("10.0.0.0/8", None, None, 1), ("10.1.0.0/23", None, at(5), 2), ("10.1.1.7/32", at(3), None, 3), ("2001:db8::/32", None, None, 4), ("2001:db8:0:0:0:0:0:ff/128", None, None, 5), ("::/0", None, None, 6), ("bad/9", None, None, 7)]
    networks = spark.createDataFrame([(*n, f"org{n[3]}") for n in nets], "prefix string, since timestamp_ntz, until timestamp_ntz, asn bigint, org string")
    edits = [("10.1.1.7", 1, 2), ("10.1.1.7", 4, 3), ("10.1.1.8", 4, 2), ("10.1.1.8", 6, 1), ("2001:db8::ff", 1, 5), ("2001:DB8::fe", 1, 4), ("fe80::1", 1, 6), ("11.0.0.1", 1, None), ("300.1.1.1", 1, None), ("Alice", 1, None), ("1::2::3", 1, None), (None, 1, None)]
    log = spark.createDataFrame([(k, u, at(day)) for k, (u, day, _) in enumerate(edits)], "revid bigint, user_name string, ts timestamp_ntz")
    got = {r.revid: r.asn for r in timeline.enrich_ips(log, networks).collect()}
    assert got == {k: asn for k, (_, _, asn) in enumerate(edits) if asn}


def test_ingest_ignores_known_keys_and_goes_on(spark, tmp_path):
    schema, source, out = "id bigint, content_id string", str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = streams.ingest_once(spark.readStream.schema(schema).parquet(source), out, ["content_id"], ["id"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (3, "b"), (5, "c")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c.\n", max_size=40), st.text(alphabet="ab c.\n", max_size=40))
def test_diff_reconstructs_both_sides(old, new):
    runs = revisions.diff_tokens(old, new)
    assert "".join(r["text"] for r in runs if r["op"] != "+") == old
    assert "".join(r["text"] for r in runs if r["op"] != "-") == new


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(5, k) for k in (6, 7, 8)] + [(9, 9)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(found[i] == 20 for i in range(20, 41)) and all(found[k] == 5 for k in (5, 6, 7, 8)) and 9 not in found


def test_leader_keeps_its_place_when_its_group_fails(spark):
    text = "Haus Baum Wald Wiese See"
    rows = [(i, datetime(2024, 1, 1), "", f"{text} {extra}") for i, extra in enumerate(["Berg Tal", "Berg", "Tal"])]
    art = spark.createDataFrame(rows, "id bigint, pubtime timestamp_ntz, head string, content string")
    entities = events.entity_weights(art)
    led = {r.id: r.leader for r in events.leader_clusters(art, entities, 0.3).collect()}
    assert set(led.values()) == {0}
    assert events.leader_clusters(art, entities, 0.3, min_entity=4).count() == 0
    assert events.leader_clusters(art, entities, 0.3, min_entity=3).count() == 3


@pytest.mark.parametrize("least", [0, 7])
def test_large_components_are_led_in_rounds(spark, monkeypatch, least):
    rng = random.Random(least)
    words = [f"Wort{chr(97 + k)}" for k in range(12)]
    rows = [(i, datetime(2024, 1, 1 + i % 2), "", " ".join(rng.choice(words) for _ in range(6))) for i in range(60)]
    art = spark.createDataFrame(rows, "id bigint, pubtime timestamp_ntz, head string, content string")
    entities = events.entity_weights(art)
    want = {tuple(r) for r in events.leader_clusters(art, entities, 0.35, least).collect()}
    monkeypatch.setattr(events, "GROUP_ARCS", 0)
    assert {tuple(r) for r in events.leader_clusters(art, entities, 0.35, least).collect()} == want and len(want) > 20


@pytest.mark.parametrize("least", [0, 5, 9])
@pytest.mark.parametrize("arcs", [200_000, 0])
def test_copies_are_led_one_by_one(spark, monkeypatch, least, arcs):
    rng = random.Random(least)
    words = [f"Wort{chr(97 + k)}" for k in range(9)]
    texts = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(14)] + ["", "Ganz allein"]
    rows = [(i, datetime(2024, 1, 1), "", rng.choice(texts)) for i in range(70)]
    art = spark.createDataFrame(rows, "id bigint, pubtime timestamp_ntz, head string, content string")
    entities = events.entity_weights(art)
    docs = art.select("id", F.lit("d").alias("block"), "content").withColumnRenamed("content", "text")
    near = {i: set() for i in range(70)}
    for p in tfidf.similar_pairs(docs, 0.35).collect():  # the join of all articles, copies included
        near[p.i].add(p.j)
        near[p.j].add(p.i)
    bags = {i: {} for i in range(70)}
    for e in entities.collect():
        bags[e.id][e.entity] = e.weight
    used, want = set(), set()
    for leader in sorted(near, key=lambda i: (-len(bags[i]), i)):
        if leader in used:
            continue
        group = [leader, *(near[leader] - used)]
        used.add(leader)
        if max((sum(bags[m].get(x, 0) for m in group) for x in words + ["Ganz"]), default=0) >= least:
            used.update(group)
            want |= {(leader, m) for m in group}
    monkeypatch.setattr(events, "GROUP_ARCS", arcs)
    assert {(r.leader, r.id) for r in events.leader_clusters(art, entities, 0.35, least).collect()} == want and want


def test_incremental_diffs_keep_state_between_runs(spark, tmp_path):
    schema = "article_id bigint, revid bigint, ts timestamp_ntz, content string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, text in enumerate(["a b", "a b c", "a b c", "c"]):
        spark.createDataFrame([(1, k, datetime(2024, 1, 1, k), text)], schema).write.mode("append").parquet(source)
        streams.run_once(streams.incremental_diffs(spark.readStream.schema(schema).parquet(source)), out)
    assert sorted(r.revid for r in spark.read.parquet(out).collect()) == [0, 1, 3]
