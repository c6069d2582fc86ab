"""The corpus operators do their whole job, against brute force in Python."""

import random

import corpus_pipeline
from newslink.llm import urlfilter

SF = "/root/testdata/sf0.001"


def first_of_copies(texts, size, percent):
    """The least index of each text's component, by all pairs."""
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_pipeline_drops_near_copies_by_five_words_from_80_percent(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(words[:1004])]
    for n in (21, 23, 30):
        copy = words[:1004]
        for k in range(n):
            copy[20 + k * 32] = f"x{n}-{k}"
        texts.append(" ".join(copy))
    base = [[rng.choice(words) for _ in range(n)] for n in (2, 5, 40, 150)]
    for _ in range(150):
        copy = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(copy) // 30))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    label = first_of_copies(texts, 5, 80)
    assert label[1] == 0 and label != first_of_copies(texts, 4, 85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.join_near_copies(spark, docs, SF).collect()}
    assert kept == {i for i, x in enumerate(label) if i == x}


def test_url_lists_match_deep_paths(spark):
    deep = "/".join(f"p{k}" for k in range(1, 13))
    entries = spark.createDataFrame([("x.org/" + "/".join(deep.split("/")[:9]), 0, "block"), ("x.org/" + deep, 5, "allow")], "key string, at int, action string")
    captures = spark.createDataFrame([(1, f"http://x.org/{deep}", 1), (2, f"http://x.org/{deep}", 6), (3, f"http://x.org/{deep}/q", 2), (4, "http://x.org/p1", 6)], "capture_id int, url string, fetched int")
    assert [r.blocked for r in urlfilter.judge(captures, entries).orderBy("capture_id").collect()] == [True, False, True, False]
