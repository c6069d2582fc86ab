"""Odd bytes, odd columns, repeated rows, shuffled plans and pipeline stages, each with its defined values."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from newslink.llm import decontam, jaccard, langid, media, mixing, substrings, tokens, toxicity, urlfilter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def odd_documents(spark):
    """Nulls, empty and repeated rows, a long text, and columns named like those that the operators make."""
    rng = random.Random(1)
    words = ["the", "house", "und", "das", "Haus", "la", "casa", "river", "stone", "w1"]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    texts = [None, "", " \n", "one two three four five six", "one two three four five six", long, long + " end", "1 2 3", "a\tb\n c"]
    rows = [(i, t, "en", "src1", 0, 1, "x", "y", 2, 3) for i, t in enumerate(texts)] + [(None, "no id here", "en", None, 0, 1, "x", "y", 2, 3)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, epoch int, words string, token string, row int, `a.b` int"
    df = spark.createDataFrame(rows, schema)
    return df.unionByName(df.where("doc_id = 3"))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13


def test_bytes_that_are_no_utf8(spark):
    raw = bytes.fromhex("616263ff") * 20
    docs = spark.createDataFrame([(1, raw), (2, raw)], "doc_id bigint, b binary").select("doc_id", F.col("b").cast("string").alias("text"), F.lit("en").alias("lang"))
    rows = media.media_features(media.store_media(docs)).collect()
    assert {(r.n_bytes, r.payload_sha256) for r in rows} == {(80, hashlib.sha256(raw.ljust(128, b"\0")).hexdigest())}
    cut = {r.doc_id: r for r in substrings.substring_dedup(spark, docs).collect()}
    assert (cut[1].n_removed, cut[2].n_bytes, cut[2].n_removed) == (0, 80, 80)
    assert [r.component_id for r in jaccard.jaccard_components(docs).collect()] == [1, 1]
    assert langid.identify(docs).count() == tokens.token_output(spark, docs, TOKENIZER).count() == 2
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 2


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    empty = docs.limit(0)
    benchmark = decontam.drop_contaminated(docs, spark.createDataFrame([(1, "Four five SIX"), (None, "one"), (2, "")], "item_id bigint, text string"))
    assert sorted(r.doc_id for r in benchmark.collect() if r.doc_id is not None) == [0, 1, 2, 5, 6, 7, 8] and benchmark.columns == docs.columns
    near = jaccard.drop_near_copies(docs, 5, 80)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in near.collect()) == [-1, 0, 1, 2, 3, 3, 5, 7, 8] and near.columns == docs.columns
    model = langid.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    kept = langid.keep_identified(docs, model, 0.0)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 3, 3, 4, 5, 6, 8] and kept.columns == docs.columns
    assert langid.keep_identified(docs, None, 0.0).count() == 0
    mixed = mixing.apply_mixture(docs, percent=100, epochs=1)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in mixed.collect()) == [-1, 3, 3, 4, 5, 6, 7, 8] and mixed.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and out.columns == docs.columns, name


def test_mixture_takes_repeated_rows_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a  b\tc d e f g h i j", "en", "s1", 9)] * 20 + [(2, None, "en", "s1", 9), (3, "", "en", "s1", 9)], "doc_id bigint, text string, lang string, source string, epoch int")
    for percent in (1, 33, 100, 130):
        rows = mixing.apply_mixture(docs, percent=percent, epochs=2).collect()
        assert sum(len(r.text.split()) for r in rows) == 200 * percent // 100
        assert all("a  b\tc d e f g h i j".startswith(r.text) for r in rows)


def test_decontamination_with_shuffled_prefixes(spark, monkeypatch):
    rng = random.Random(7)
    words = ["rot", "blau", "grün", "gelb", "a1"]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((1, 2, 4, 11, 12))]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 50)))) for k in range(40)] + [(99, items[4][1].upper()), (99, items[4][1].upper()), (None, items[3][1])]
    docs, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(str, decontam.digest(decontam.decontaminate(docs, bench)).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontam.digest(decontam.decontaminate(docs, bench)).collect())) == want


def test_hosts_of_urls(spark):
    entries = spark.createDataFrame([("evil.com", 0, "block"), ("0.0.1", 0, "block"), ("10.0.0.1", 0, "block"), ("[::1]", 0, "block")], "key string, at int, action string")
    urls = ["http://user@evil.com/x", "http://u:p@evil.com:8080/x", "http://evil.com./x", "http://EVIL.com", "http://evil.com@good.com/", "http://9.0.0.1/", "http://10.0.0.1:80/a", "http://[::1]:80/", "http://notevil.com/", "http://", "http://.", None]
    captures = spark.createDataFrame([(i, u, 1, "k", "x") for i, u in enumerate(urls)], "capture_id int, url string, fetched int, key string, action string")
    rows = urlfilter.judge(captures.unionByName(captures.where("capture_id = 0")), entries).orderBy("capture_id").collect()
    assert [r.blocked for r in rows] == [True, True, True, True, True, False, False, True, True, False, False, False, False]
    assert urlfilter.judge(captures.limit(0), entries).count() == 0
    assert urlfilter.judge(captures, entries.limit(0)).where("blocked").count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="cut"):
        tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_masks_of_sequence_files(spark):
    out = tokens.shared_dir(spark, "masks")
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id bigint, text string")
    (shard,) = tokens.write_sequences(docs.coalesce(1), out, TOKENIZER, seq_len=8).where("n_docs > 0").limit(1).collect()
    file = tokens.SequenceFile(f"{out}/{shard.name}.arrow")
    batch = file.reader.get_batch(0)
    mask = batch.column("mask").flatten().to_pylist()
    assert mask == [True] * shard.n_tokens + [False] * (len(mask) - shard.n_tokens) and len(mask) % 8 == 0


def test_blocks_of_a_large_group(spark, monkeypatch):
    """A group whose sets do not all link with one pivot, and sets of its pools that link with none."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(100)] = f"x{rng.randrange(60)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(97)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(jaccard.jaccard_components(docs).collect())
    assert [r.component_id for r in rows] == label and len(set(label)) > 10
