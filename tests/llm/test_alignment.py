"""Cross-tokenizer alignment against a plain version that encodes whole texts, with and without byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newslink.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, code string, row string, `count` int, block string"


def encoded(text, one, two, back):
    """(A ids with their bytes, B ids with their bytes), or nothing."""
    if not text:
        return None
    a = [(i, bytes(back[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def plain(rows):
    one, two, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_alphabet()
    one.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc_id, text in rows:
        both = encoded(text, one, two, back)
        if both is None:
            docs.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        groups, now, links = [], ([], []), Counter()
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in both]
        i = j = 0
        while i < len(both[0]) and j < len(both[1]):
            links[both[0][i][0], both[1][j][0]] += 1
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                now[0].append(both[0][i][0])
                i += 1
            if y <= x:
                now[1].append(both[1][j][0])
                j += 1
            if x == y:
                groups.append("|".join(",".join(map(str, side)) for side in now))
                now = ([], [])
        counts.update(links.keys())
        docs.append((doc_id, len(both[0]), len(both[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(
        ((d, a, b, g, sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), digest) for d, a, b, g, links, digest in docs), key=str
    )


def texts():
    rng = random.Random(11)
    signs = [" ", " ", " ", "\n", "\t", "a", "the", "é", " ", "　", "'s", "1", "42", ".", "中文", "<s>", "<|endoftext|>", "\0", "\x1c", "\x85", "😀", "don't", "Hello", "World", "​", "ſ", "ﬁ", "<0x41>"]
    mixed = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return [None, "", " ", "  ", "a ", "a  ", "\n", "x▁y", "x" * 5000, "<|endoftext|>", *mixed, mixed[3], " ".join(mixed)]


@pytest.mark.parametrize(("chunk", "block"), [(alignment.CHUNK, alignment.BLOCK_CHARS), (1, 50), (7, 300), (64, 1000)])
def test_against_whole_texts(spark, chunk, block):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, "c", "r", 1, "b") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df, A, B, chunk, block).collect()), key=str)
    assert got == plain(rows)


def test_fragments_are_associative():
    rng = random.Random(2)
    for _ in range(200):
        parts = []
        for k in range(5):
            ends = [np.array(sorted(rng.sample(range(1, 9), rng.randint(0, 4)))) for _ in range(2)]
            tokens = alignment.Tokens(np.arange(len(ends[0])), ends[0].astype(int), np.arange(len(ends[1])) + 10, ends[1].astype(int))
            parts.append(alignment.fragment(tokens, k)[0])
        left = alignment.Fragment()
        for p in parts:
            left = left.then(p)
        right = parts[0].then(parts[1].then(parts[2])).then(parts[3].then(parts[4]))
        assert left == right == alignment.Fragment().then(right) == right.then(alignment.Fragment())


def test_ranges_have_a_cut_close_by():
    rng = random.Random(4)
    for _ in range(100):
        cuts = np.append(0, np.cumsum([rng.choice([3, 5, 8, 200]) for _ in range(30)]))
        found = alignment.ranges(cuts, 20)
        assert found[0][0] == 0 and found[-1][1] == cuts[-1] and all(x[1] == y[0] for x, y in zip(found, found[1:]))
        assert all(b <= low < high <= e and low - b <= 20 and e - high <= 20 and b in cuts and e in cuts for low, high, b, e in found)


def test_memory_is_renewed(monkeypatch):
    """Forgetting what one text had, or all, changes no result."""
    rows = [" " + t for t in texts() if t and "▁" not in t] * 2
    fresh = alignment.Aligner(A, B)
    want = [fresh.documents([t])[0] for t in rows]
    for memory, chars in ((30, 10**9), (400, 10**9), (10**9, 500), (0, 0)):
        monkeypatch.setattr(alignment, "MEMORY", memory)
        monkeypatch.setattr(alignment, "MEMORY_CHARS", chars)
        one = alignment.Aligner(A, B)
        for k in range(0, len(rows), 3):
            for got, should in zip(one.documents(rows[k : k + 3]), want[k : k + 3], strict=True):
                assert (got is None) == (should is None) and (got is None or (got[:4] == should[:4] and np.array_equal(got[4], should[4])))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
