"""A linear-chain conditional random field over words with hashed features, in numpy.

A word's emission scores are sums of learned weights of its features; transitions between labels are learned with
them. Forward-backward runs over all texts of a batch at once, one position of each text at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from newslink.llm.common import CodePoints, SegmentHasher, lower_case, mix, word_runs


class Words:
    """The words (runs of letters, lower-cased) of several texts, and the features of each different word.

    Features are hashed to `bits` bits: the word itself (lexicon), its prefixes and suffixes of the given lengths
    (affixes), and its n-grams with the edges marked.
    """

    def __init__(self, texts: list[str], bits: int, prefixes: tuple, suffixes: tuple, grams: tuple):
        cp = CodePoints(texts)
        lowered = lower_case()[cp.points]
        self.starts, self.ends = word_runs(cp.classes)
        self.base = cp.starts
        self.doc = np.searchsorted(cp.ends, self.starts, side="right")
        self.per_doc = np.bincount(self.doc, minlength=len(texts))
        lowered[cp.classes != 0] = 0  # what is no letter marks the edges of words
        hasher = SegmentHasher(lowered)
        self.keys, at, self.which = np.unique(hasher.of(self.starts, self.ends), return_index=True, return_inverse=True)
        starts, ends = self.starts[at], self.ends[at]
        length, owner = ends - starts, np.arange(len(at))
        owners, hashes = [owner], [self.keys]
        for salt, size in enumerate(prefixes, 1):
            own = owner[length > size]
            owners.append(own)
            hashes.append(mix(hasher.of(starts[own], starts[own] + size) + np.uint64(salt)))
        for salt, size in enumerate(suffixes, 101):
            own = owner[length > size]
            owners.append(own)
            hashes.append(mix(hasher.of(ends[own] - size, ends[own]) + np.uint64(salt)))
        for salt, size in enumerate(grams, 201):
            begin, end = np.maximum(starts - 1, 0), np.minimum(ends + 1, len(lowered))
            count = np.maximum(end - begin - size + 1, 0)
            own = np.repeat(owner, count)
            place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + begin[own]
            owners.append(own)
            hashes.append(mix(hasher.of(place, place + size) + np.uint64(salt)))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        # Four bytes each: all batches of a training are held at once, in the driver.
        self.owner = owner[order].astype(np.int32)
        self.features = (np.concatenate(hashes)[order] & np.uint64((1 << bits) - 1)).astype(np.int32)
        self.first = np.searchsorted(self.owner, np.arange(len(at)))

    def spans(self, texts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of words (by index) in code points of their texts."""
        base = self.base[self.doc[texts_at]]
        return self.starts[texts_at] - base, self.ends[texts_at] - base


@dataclass
class Model:
    labels: list
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # from label x to label
    begin: np.ndarray
    features: dict

    def words(self, texts: list[str]) -> Words:
        return Words(texts, **self.features)

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.keys):
            return np.zeros((0, len(self.labels)), np.float32)
        return np.add.reduceat(self.weights[words.features], words.first, axis=0)[words.which]

    def marginals(self, words: Words) -> np.ndarray:
        """Probability of each label at each word, by forward-backward."""
        return chains(self.emissions(words), words.per_doc, self.moves, self.begin)[0]


def chains(emissions: np.ndarray, per_doc: np.ndarray, moves: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Marginals of every word and, if asked for, the expected count of each move and of each first label.

    Texts are ordered by length so that those that reach a position are the first ones, and the words laid out by
    position: a step works on one stretch of each array.
    """
    if not len(emissions):
        return emissions, np.zeros_like(moves), np.zeros_like(begin)
    docs = np.argsort(-per_doc, kind="stable")
    docs = docs[: np.count_nonzero(per_doc)]
    lengths = per_doc[docs]
    starts = (np.cumsum(per_doc) - per_doc)[docs]
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    offsets = np.append(0, np.cumsum(alive))
    position = np.repeat(np.arange(longest), alive)
    place = starts[np.arange(len(position)) - offsets[position]] + position
    e = emissions[place]
    e = np.exp(e - e.max(axis=1, keepdims=True)) + np.float32(1e-20)
    step, first = np.exp(moves), np.exp(begin)
    forward, backward = np.empty_like(e), np.ones_like(e)
    scale = np.empty((len(e), 1), e.dtype)
    bounds = offsets.tolist()
    now = e[: bounds[1]] * first
    for t in range(longest):
        a, b = bounds[t], bounds[t + 1]
        if t:
            now = (now[: b - a] @ step) * e[a:b]
        s = now.sum(axis=1, keepdims=True)
        now = now / s
        forward[a:b], scale[a:b] = now, s
    e /= scale
    back = step.T.copy()
    for t in range(longest - 1, 0, -1):
        a, b = bounds[t], bounds[t + 1]
        backward[bounds[t - 1] : bounds[t - 1] + b - a] = (e[a:b] * backward[a:b]) @ back
    both = forward * backward
    both /= both.sum(axis=1, keepdims=True)
    out = np.empty_like(both)
    out[place] = both
    if not pairs:
        return out, None, None
    later = np.arange(bounds[1], len(e))
    earlier = later - alive[position[later] - 1]
    return out, (forward[earlier].T @ (e * backward)[later]) * step, both[: bounds[1]].sum(axis=0)


def train(batches: list, labels: list, features: dict, epochs: int, rate: float = 0.3, decay: float = 1e-6) -> Model:
    """Fit weights and transitions by the likelihood of labelled words.

    batches: (Words, label index of each word, weight of each word). Steps are AdaGrad on batches of texts.
    """
    n = len(labels)
    size = 1 << features["bits"]
    model = Model(labels, np.zeros((size, n), np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32), features)
    squares, move_squares, begin_squares = np.full((size, n), 1e-8, np.float32), np.full((n, n), 1e-8, np.float32), np.full(n, 1e-8, np.float32)
    for _ in range(epochs):
        for words, gold, weight in batches:
            if not len(gold):
                continue
            p, expected, begun = chains(model.emissions(words), words.per_doc, model.moves, model.begin, pairs=True)
            error = p.copy()
            error[np.arange(len(gold)), gold] -= 1
            error *= weight[:, None]
            docs = words.doc
            inner = np.flatnonzero(docs[1:] == docs[:-1])
            observed = np.zeros((n, n), np.float32)
            np.add.at(observed, (gold[inner], gold[inner + 1]), 1)
            heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            total = np.float32(1 / len(gold))
            for y in range(n):
                by_word = np.bincount(words.which, error[:, y], minlength=len(words.keys))
                g = (np.bincount(words.features, by_word[words.owner], minlength=size) * total).astype(np.float32) + decay * model.weights[:, y]
                squares[:, y] += g * g
                model.weights[:, y] -= rate * g / np.sqrt(squares[:, y])
            for value, square, g in ((model.moves, move_squares, (expected - observed) * total), (model.begin, begin_squares, (begun - np.bincount(gold[heads], minlength=n)) / len(heads))):
                g = g.astype(np.float32)
                square += g * g
                value -= 0.1 * rate * g / np.sqrt(square)
    return model
