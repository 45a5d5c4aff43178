"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: lexicon hits (count, distinct, per word, most within a window), the same after
undoing obfuscation (digits and signs for letters, letters set apart, letters drawn out), words that share a
stem with the lexicon, second-person words near hits, share of capitals, of punctuation, of obfuscated
words, exclamation marks, length. The lexicon is a short fixed list and the words, and stems of four to eight
letters, that the training rows show to be tied to the label (binomial tail). Trees are depth-3 regression trees on
32 quantile bins with logistic loss. Scores go through an isotonic map fitted on out-of-fold scores, where a
fold's features come from a lexicon learned without that fold.

Features are computed for a whole Arrow batch at once, on its bytes: words are runs of letters, known by
hashes of their spans; no Python code runs for a word. A text longer than a slice is taken in pieces that end
at white space, and its hits and counts are put together before windows are looked at.

Training rows: at most ``TRAIN_ROWS`` labelled rows whose texts have ``TRAIN_BYTES`` bytes together at most,
in a hash order of their ids, none of the held-out fold; the text that reaches the bound is the last, and is taken whole. That
bound is what the driver holds. Scoring covers every whole text, one batch at a time.

Nulls: a null text scores as an empty one; null labels don't train; a doc_id labelled more than once
trains with its largest label, and of texts under one doc_id the first in order; a null doc_id is scored and
never trains. Without any label every score is 0. Rows that repeat are scored each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import lgamma
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import crc_fold, table
from girder.llm.op2_quality_cnn import training_rows
from girder.llm.textkit import hash_spans, runs, slices, span_sums

TRAIN_ROWS, TRAIN_BYTES = 8000, 24 << 20
THRESHOLD = 0.7
WINDOW, NEAR = 20, 5
TREES, DEPTH, BINS, RATE, LEAST = 80, 3, 32, 0.15, 8
FOLDS = 3

#: Seed words and second-person words.
SEED_WORDS = frozenset("idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting dumb imbecile filth vermin".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous votre ton ta usted ustedes tú ti vosotros".split())
#: Signs that stand for letters or between them.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
SIGNS, LEADING, APART = "0123456789@$!|*+.-_", "0123456789@$!|", " .-_*"

_WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7, 8)
NAMES = ("hits", "distinct", "stems", "stem_density", "density", "window", "hidden", "hidden_density", "second_near", "second_density", "capitals", "punctuation", "exclaims", "length")
SLICE = 1 << 18


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_ASCII_LETTER = _table("abcdefghijklmnopqrstuvwxyz")
_SIGN, _LEADING, _APART, _SPACE = _table(SIGNS), _table(LEADING), _table(APART), _table(" \t\n\v\f\r")
_ALNUM = _table("abcdefghijklmnopqrstuvwxyz0123456789_")
_TO_LETTER = np.arange(256, dtype=np.uint8)
_TO_LETTER[[ord(c) for c in LEET]] = [ord(c) for c in LEET.values()]


def _hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return np.unique(hash_spans(span_sums(np.frombuffer(b"".join(raw), np.uint8)), ends - [len(w) for w in raw], ends)) if raw else np.empty(0, np.uint64)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Lexicon:
    """Words, stems (written with a leading ^) and second-person words as sorted hashes."""

    def __init__(self, words: frozenset[str]):
        self.words = _hashes([w for w in words if w[0] != "^"])
        self.stems = _hashes([w[1:] for w in words if w[0] == "^"])
        self.second = _hashes(list(SECOND_PERSON))


def _gather(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the bytes of spans, one after the other, and the span of each."""
    n = e - s
    span = np.repeat(np.arange(len(s)), n)
    return np.arange(n.sum()) + np.repeat(s - (np.cumsum(n) - n), n), span


def _joined(raw: np.ndarray, span: np.ndarray, keep: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` spans of bytes after only the bytes to keep are left."""
    left = np.bincount(span[keep], minlength=n)
    e = np.cumsum(left)
    return hash_spans(span_sums(raw[keep]), e - left, e) if n else np.empty(0, np.uint64)


def _slice_features(raw: np.ndarray, off: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a slice: sums a text (words, stems, hidden, second, capitals, punctuation, exclaims, characters); hits (text, word, hash); second-person words (text, word)."""
    n, m = len(raw), len(off) - 1
    doc_of = lambda at: np.searchsorted(off, at, "right") - 1
    count = lambda at: np.bincount(doc_of(at), minlength=m)
    if not n:
        return np.zeros((m, 8)), np.empty((0, 3), np.int64), np.empty((0, 2), np.int64)
    # lower case of ASCII and of Latin-1's letters
    upper = (raw >= 65) & (raw <= 90)
    low = np.where(upper, raw + 32, raw).astype(np.uint8)
    at = np.flatnonzero(raw[:-1] == 0xC3)
    at = at[(raw[at + 1] >= 0x80) & (raw[at + 1] <= 0x9E) & (raw[at + 1] != 0x97)]
    low[at + 1] += 0x20
    # letters: a to z and all beyond ASCII but signs and symbols
    wide = raw >= 0x80
    odd = np.zeros(n + 3, bool)
    for lead, size in ((0xC2, 2), (0xE2, 3), (0xF0, 4)):
        x = np.flatnonzero(raw == lead)
        for k in range(size):
            odd[x + k] = True
    symbol = odd[:n] & wide
    letter = _ASCII_LETTER[low] | (wide & ~symbol)
    char = (raw & 0xC0) != 0x80
    chars = np.append(0, np.cumsum(char))
    sums = np.zeros((m, 8))
    s, e = runs(letter, off[:-1])
    spans = span_sums(low)
    h = hash_spans(spans, s, e)
    doc = doc_of(s)
    first = np.searchsorted(s, off)  # the first word of each text
    word = np.arange(len(s)) - first[doc]
    size = chars[e] - chars[s]
    hit = _among(h, lex.words)
    sums[:, 0] = np.diff(first)
    # stems
    begins, akin = np.append(np.flatnonzero(char), n), np.zeros(len(s), bool)
    for k in STEMS if len(lex.stems) else ():
        long = np.flatnonzero((size >= k) & ~hit & ~akin)
        akin[long] = _among(hash_spans(spans, s[long], begins[chars[s[long]] + k]), lex.stems)
    sums[:, 1] = np.bincount(doc[akin], minlength=m)
    second = np.flatnonzero(_among(h, lex.second))
    sums[:, 3] = np.bincount(doc[second], minlength=m)
    sums[:, 4] = count(np.concatenate([np.flatnonzero(upper), at]))
    sums[:, 5] = count(np.flatnonzero(char & ((~_ALNUM[low] & ~_SPACE[low] & ~wide) | symbol)))
    sums[:, 6] = count(np.flatnonzero(raw == 33))
    sums[:, 7] = np.diff(chars[off])
    # drawn out: a letter three times or more counts once
    same = np.zeros(n + 1, bool)
    same[1:n] = (low[1:] == low[:-1]) & letter[1:] & letter[:-1]
    a, b = runs(same[:n], off[:-1])
    a, b = a[b - a >= 2], b[b - a >= 2]
    w = np.unique(np.searchsorted(s, a, "right") - 1)
    w = w[(size[w] > 5) & ~hit[w]] if len(w) else w
    drawn = np.empty(0, np.int64)
    if len(w):
        more = np.zeros(n, bool)
        more[_gather(raw, a, b)[0]] = True
        at, span = _gather(raw, s[w], e[w])
        drawn = w[_among(_joined(low[at], span, ~more[at], len(w)), lex.words)]
    hidden = [doc[drawn]]
    # letters set apart
    alone = size == 1
    if alone.any():
        link = np.zeros(len(s), bool)
        link[:-1] = alone[:-1] & alone[1:] & (s[1:] - e[:-1] == 1) & _APART[low[np.minimum(e[:-1], n - 1)]] & (doc[1:] == doc[:-1])
        a, b = runs(link, np.zeros(1, np.int64))
        a, b = a[b - a >= 3], b[b - a >= 3] + 1
        if len(a):
            at, span = _gather(raw, s[a], e[b - 1])
            hidden.append(doc[a][_among(_joined(low[at], span, letter[at], len(a)), lex.words)])
    # signs between letters, one or two at a time
    sign = _SIGN[low]
    a, b = runs(sign, off[:-1])
    a, b = a[b - a >= 3], b[b - a >= 3]
    solid = letter | sign
    if len(a):
        solid[_gather(raw, a, b)[0]] = False
    a, b = runs(solid, off[:-1])
    marks = np.append(0, np.cumsum(sign & solid))
    some = marks[b] > marks[a]
    a, b = a[some], b[some]
    if len(a):
        place = np.arange(n)
        last = np.maximum.accumulate(np.where(letter, place, -1))
        after = np.minimum.accumulate(np.where(letter, place, n)[::-1])[::-1]
        z, f = last[b - 1] + 1, after[a]
        some = (f < z) & (z > a)
        a, z, f = a[some], z[some], f[some]
        some = marks[z] > marks[f]
        a, z, f = a[some], z[some], f[some]
        lead = (f > a) & _LEADING[low[np.maximum(f - 1, 0)]]
        a = np.where(lead, f - 1, f)
        at, span = _gather(raw, a, z)
        told, plain = _TO_LETTER[low[at]], low[at]
        found = _among(_joined(told, span, _ASCII_LETTER[told] | letter[at], len(a)), lex.words) | _among(_joined(plain, span, letter[at], len(a)), lex.words)
        hidden.append(doc_of(a[found]))
    sums[:, 2] = np.bincount(np.concatenate(hidden), minlength=m)
    hits = np.union1d(np.flatnonzero(hit), drawn).astype(np.int64)
    return sums, np.column_stack([doc[hits], word[hits], h[hits].view(np.int64)]), np.column_stack([doc[second], word[second]])


def feature_matrix(texts: pa.Array, lex: Lexicon) -> np.ndarray:
    """A row of NAMES for each text."""
    m = len(texts)
    sums, hits, seconds = np.zeros((m, 8)), [np.empty((0, 3), np.int64)], [np.empty((0, 2), np.int64)]
    for first, n, raw, off in slices(texts, _SPACE, SLICE):
        part, hit, second = _slice_features(raw, off, lex)
        before = int(sums[first, 0])  # words of the text's earlier pieces
        sums[first : first + n] += part
        hits.append(hit + [first, before, 0])
        seconds.append(second + [first, before])
    hit, second = np.concatenate(hits), np.concatenate(seconds)
    words, chars = np.maximum(sums[:, 0], 1), np.maximum(sums[:, 7], 1)
    each = np.bincount(hit[:, 0], minlength=m)
    kinds = np.unique(hit[:, [0, 2]], axis=0) if len(hit) else hit[:, [0, 2]]
    far = 1 << 40  # keeps texts apart on one line of word numbers
    key, other = np.sort(hit[:, 0] * far + hit[:, 1]), np.sort(second[:, 0] * far + second[:, 1])
    window = np.zeros(m)
    np.maximum.at(window, key // far, np.arange(len(key)) - np.searchsorted(key, key - WINDOW + 1) + 1)
    near = np.searchsorted(other, key + NEAR, "right") > np.searchsorted(other, key - NEAR)
    out = [
        each, np.bincount(kinds[:, 0], minlength=m), sums[:, 1], sums[:, 1] / words, each / words, window, sums[:, 2], sums[:, 2] / words,
        np.bincount(key[near] // far, minlength=m), sums[:, 3] / words, sums[:, 4] / chars, sums[:, 5] / chars, sums[:, 6] / chars, np.log1p(sums[:, 0]),
    ]
    return np.column_stack(out).astype(np.float64)


def features(text: str, lexicon: frozenset[str]) -> list[float]:
    """The features of one text."""
    return feature_matrix(pa.array([text], pa.string()), Lexicon(lexicon))[0].tolist()


def _tail(t: int, n: int, share: float) -> float:
    """log10 of the binomial chance of t or more of n."""
    terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * np.log(share) + (n - k) * np.log1p(-share) for k in range(t, min(n, t + 40) + 1)]
    top = max(terms)
    return (top + np.log(sum(np.exp(x - top) for x in terms))) / np.log(10)


def _keys(words: set[str]) -> set[str]:
    """Words and their stems, which are written with a leading ^."""
    return words | {"^" + x[:k] for x in words for k in STEMS if len(x) >= k}


def learn_lexicon(words: list[set[str]], labels: np.ndarray) -> frozenset[str]:
    """Words and stems tied to the label. Only those that enough toxic texts hold are counted in the clean ones."""
    toxic, clean = Counter(), Counter()
    for w, y in zip(words, labels, strict=True):
        if y:
            toxic.update(_keys(w))
    toxic = {w: t for w, t in toxic.items() if t >= 4 and len(w) > 2}
    for w, y in zip(words, labels, strict=True):
        if not y:
            clean.update(toxic.keys() & _keys(w))
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    found = {w for w, t in toxic.items() if t > 3 * clean[w] * share / (1 - share) and t >= 0.6 * (t + clean[w]) and _tail(t, t + clean[w], share) < -5}
    return SEED_WORDS | found


class Trees:
    """Boosted trees; each is (feature, bin) of 2**DEPTH - 1 nodes in heap order and 2**DEPTH leaf values."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.base, self.trees = 0.0, []

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]) if len(x) else np.empty((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, BINS)[1:-1]), np.quantile(c[c > 0], np.linspace(0, 1, 6)[:-1]) * 0.999 if (c > 0).any() else []])) for c in x.T]
        b = self._bins(x)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for depth in range(DEPTH):
                new = node.copy()
                for k in range(2**depth):
                    rows = np.flatnonzero(node == k)
                    best = (1e-6, 0, 1 << 20)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(x.shape[1]) if len(rows) >= 2 * LEAST else ():
                        m = len(self.edges[j]) + 1
                        gl, hl, cl = (np.cumsum(np.bincount(b[rows, j], w, m))[:-1] for w in (g[rows], h[rows], None))
                        ok = (cl >= LEAST) & (len(rows) - cl >= LEAST)
                        if ok.any():
                            gain = np.where(ok, gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1)
                            i = int(gain.argmax())
                            if gain[i] > best[0]:
                                best = (float(gain[i]), j, i)
                    splits.append(best[1:])
                    new[rows] = 2 * k + (b[rows, best[1]] > best[2])
                node = new
            leaves = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            self.trees.append((splits, leaves))
            z += leaves[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, z = self._bins(x), np.full(len(x), self.base)
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for depth in range(DEPTH):
                level = np.array(splits[2**depth - 1 : 2 ** (depth + 1) - 1])
                node = 2 * node + (b[np.arange(len(x)), level[node, 0]] > level[node, 1])
            z += leaves[node]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their values."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([z[i], z[i], y[i], 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    # one pseudo-row at the mean keeps the ends off 0 and 1
    mean = float(y.mean())
    return np.array([x for b in blocks for x in (b[0], b[1])]), np.array([v for b in blocks for v in [(b[2] + mean) / (b[3] + 1)] * 2])


class Model:
    def __init__(self, lexicon: frozenset[str], trees: Trees, knots: np.ndarray, values: np.ndarray):
        self.lexicon, self.trees, self.knots, self.values = lexicon, trees, knots, np.maximum.accumulate(values)
        self.hashed = Lexicon(lexicon)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        z = self.trees.raw(feature_matrix(texts, self.hashed))
        # the least share of the raw score keeps the order within a step
        return np.clip(np.interp(z, self.knots, self.values) * 0.999 + 0.001 / (1 + np.exp(-z)), 0, 1)


def fit(texts: list[str], y: np.ndarray) -> Model | None:
    if not len(y) or y.min() == y.max():
        return None
    words = [set(map(intern, _WORD.findall(t.lower()))) for t in texts]
    column = pa.array(texts, pa.large_string())
    fold = np.random.Generator(np.random.PCG64(5)).integers(0, FOLDS, len(y))
    x, z = np.empty((len(y), len(NAMES))), np.full(len(y), np.nan)
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(own):
            x[own] = feature_matrix(column.take(pa.array(own)), Lexicon(learn_lexicon([words[i] for i in rest], y[rest])))
    for k in range(FOLDS):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own) and len(rest) and y[rest].min() != y[rest].max():
            z[own] = Trees().fit(x[rest], y[rest]).raw(x[own])
    ok = ~np.isnan(z)
    trees = Trees().fit(x, y)
    if not ok.any():
        z, ok = trees.raw(x), np.ones(len(y), bool)
    return Model(learn_lexicon(words, y), trees, *isotonic(z[ok], y[ok]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    return fit(*training_rows(docs, labels, label, TRAIN_ROWS, TRAIN_BYTES))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(b.column(1)) if model else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
