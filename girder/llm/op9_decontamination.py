"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items become passages of 32 words, 16 apart, as TF-IDF rows; document frequencies are counted over
   all documents (a word of more than half of them carries no weight, unless an item has no other).
2. A distributed randomised SVD of those rows gives a latent space: partitions return A'(A X) for a
   random X, twice, with orthonormalisation between.
3. Every passage of every document is folded into that space. Passages whose benchmark words have a squared
   TF-IDF weight of less than a share of the lightest item passage's are passed over; the rest are compared
   with all item passages by cosine; the part of the item passage's length that they cover must be COVER.
4. A candidate stands if the longest common subsequence of the item's words and the text around the passage
   covers 80 % of the item, or 60 % where the item's answer (its last fifth) is there too, or 90 % of
   one full 32-word passage of a longer item. Order counts, gaps are free, so light paraphrases stay found.

The latent space is that of the benchmark: factorising the corpus instead would keep its function words and
lose the rare words that tell one item from another. Words ignore case and ASCII punctuation. The
benchmark is dealt into blocks of at most ``BLOCK_WORDS`` words, each with a pass of its own, so that the
model that goes to the executors has a bounded size; the documents are never gathered.

Nulls: null texts hold nothing; items without words are ignored; a null doc_id or item_id is kept as such.
Rows that repeat give a result each; equal items are items each. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import Scratch, fresh, table
from girder.llm.textkit import word_hashes

WIDTH, STRIDE = 32, 16
RANK, ROUNDS = 128, 2
#: A block's model has as many terms at most, 512 bytes each in its basis: 50 MB go to the executors.
BLOCK_WORDS = 100_000
COMMON = 0.5
LEAST_MASS, COSINE, COVER = 0.5, 0.5, 0.4
WHOLE, WITH_ANSWER, ANSWER, PASSAGE = 0.8, 0.6, 0.8, 0.9
PARTS = 16
_U = np.uint64


def starts(n: int) -> list[int]:
    """Where the passages of n words begin; the last ends with the text."""
    return [0] if n <= WIDTH else [*range(0, n - WIDTH, STRIDE), n - WIDTH]


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; masks: where each word stands in the first text."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Model:
    """What a block of the benchmark sends to the executors."""

    vocabulary: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    basis: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    latent: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.float32))
    length: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    passage: list[tuple[int, int, int]] = field(default_factory=list)  # (item, first word, words)
    items: list[list[int]] = field(default_factory=list)
    ids: list[int | None] = field(default_factory=list)
    least: float = 0.0
    seen: np.ndarray = field(init=False)

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary >> _U(48)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of benchmark words and their terms."""
        at = np.flatnonzero(self.seen[(h >> _U(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[k] == h[at]
        return at[ok], k[ok]


def _split(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words): the word hashes of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [h[o:e].view(np.int64) for _, off, h in word_hashes(b.column(1), plain=True) for o, e in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), F.lower(text_col)).mapInArrow(run, "item_id long, words array<long>").where("size(words) > 0")


def document_frequencies(docs: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """In how many documents each benchmark word stands, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(len(model.vocabulary), np.int64), 0, len(model.vocabulary)
        for b in batches:
            n += b.num_rows
            for _, off, h in word_hashes(b.column(0), plain=True):
                at, term = model.terms(h)
                doc = np.searchsorted(off, at, "right")
                df += np.bincount(np.unique(doc * size + term) % size, minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], n), pa.int64())], ["term", "n"])

    rows = docs.select(F.lower("__text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(model.vocabulary), np.int64)
    real = rows[rows["term"] >= 0]
    df[real["term"].to_numpy()] = real["n"].to_numpy()
    return df, int(rows.loc[rows["term"] < 0, "n"].sum())


def _row(words: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Terms and normalised TF-IDF weights of a passage."""
    at, term = model.terms(words)
    terms, tf = np.unique(term, return_counts=True)
    w = tf * model.weights[terms]
    norm = np.sqrt((w**2).sum())
    return terms, (w / norm if norm > 0 else w).astype(np.float32)


def randomised_svd(items: DataFrame, model: Model, rank: int) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the leading right singular space of the passages' TF-IDF rows."""
    x = np.random.Generator(np.random.PCG64(17)).normal(size=(len(model.vocabulary), rank)).astype(np.float32)
    for _ in range(ROUNDS):
        x, _ = np.linalg.qr(x)
        x = x.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], x: np.ndarray = x) -> Iterator[pa.RecordBatch]:
            z = np.zeros_like(x)
            for b in batches:
                for words in b.column(0).to_pylist():
                    h = np.array(words, np.int64).view(_U)
                    for s in starts(len(h)):
                        terms, w = _row(h[s : s + WIDTH], model)
                        z[terms] += w[:, None] * (w @ x[terms])
            yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary())], ["z"])

        # PARTS products of the block's bounded size
        parts = items.select("words").repartition(PARTS).mapInArrow(run, "z binary").toLocalIterator()
        z = np.zeros_like(x)
        for p in parts:
            z += np.frombuffer(p["z"], np.float32).reshape(x.shape)
        x = z
    q, r = np.linalg.qr(x)
    live = np.abs(np.diag(r)) > 1e-6 * max(np.abs(np.diag(r)).max(), 1e-12)
    return np.ascontiguousarray(q[:, live], np.float32)


def fit(docs: DataFrame, items: DataFrame) -> Model | None:
    """The model of one block of items (item_id, words)."""
    held = sorted(((r["item_id"] is None, r["item_id"] or 0, r["words"]) for r in items.collect()), key=lambda r: r[:2])
    if not held:
        return None
    sets = [np.array(w, np.int64).view(_U) for _, _, w in held]
    model = Model(np.unique(np.concatenate(sets)))
    df, n = document_frequencies(docs, model)
    weights = np.maximum(np.log((n + 1) / (df + 1)), 0.01).astype(np.float32)
    weights[df > max(COMMON * n, 2)] = 0
    for h in sets:
        for s in starts(len(h)):
            term = model.terms(h[s : s + WIDTH])[1]
            if not weights[term].any():
                weights[term] = 0.01
    model.weights = weights
    model.basis = randomised_svd(items, model, min(RANK, len(model.vocabulary)))
    latent, least, length = [], [], []
    for i, h in enumerate(sets):
        for s in starts(len(h)):
            terms, w = _row(h[s : s + WIDTH], model)
            v = w @ model.basis[terms]
            norm = np.sqrt((v**2).sum())
            mass = float((weights[model.terms(h[s : s + WIDTH])[1]] ** 2).sum())
            if norm > 0:
                latent.append(v / norm)
                least.append(mass)
                tf = np.unique(model.terms(h[s : s + WIDTH])[1], return_counts=True)[1]
                length.append(norm * np.sqrt(((tf * weights[terms]) ** 2).sum()))
                model.passage.append((i, s, min(WIDTH, len(h))))
    if not latent:
        return None
    model.latent, model.length = np.array(latent, np.float32), np.array(length, np.float32)
    model.least = LEAST_MASS * min(least)
    model.items = [h.tolist() for h in sets]
    model.ids = [None if none else k for none, k, _ in held]
    return model


class Judge:
    """The checks of candidates, with the masks of items and passages kept."""

    def __init__(self, model: Model):
        self.m, self.whole, self.tail, self.part = model, {}, {}, {}

    def __call__(self, p: int, words: np.ndarray, begin: int) -> tuple[int, int, float] | None:
        """(item, common words, share) if the text around the passage that begins at ``begin`` holds the item."""
        i, s, n = self.m.passage[p]
        item = self.m.items[i]
        size = len(item)
        near = words[max(0, begin - size) : begin + WIDTH + size].tolist()
        if i not in self.whole:
            self.whole[i] = masks_of(item)
            self.tail[i] = (item[-max(1, size // 5) :], masks_of(item[-max(1, size // 5) :]))
        common = lcs(self.whole[i], size, near)
        if common >= WHOLE * size:
            return i, common, common / size
        if common >= WITH_ANSWER * size:
            tail, masks = self.tail[i]
            if lcs(masks, len(tail), near) >= ANSWER * len(tail):
                return i, common, common / size
        if size > WIDTH:
            if p not in self.part:
                self.part[p] = masks_of(item[s : s + n])
            close = words[max(0, begin - WIDTH) : begin + 2 * WIDTH].tolist()
            if lcs(self.part[p], n, close) >= PASSAGE * n:
                return i, common, common / size
        return None


def _leaks(model: Model, h: np.ndarray, off: np.ndarray, judge: Judge) -> dict[tuple[int, int], tuple[int, float, float]]:
    """(text, item) -> (common words, share, cosine) for a run of texts; h: their words, off: where each begins."""
    at, term = model.terms(h)
    w = model.weights[term]
    at, term, w = at[w > 0], term[w > 0], w[w > 0]
    mass = np.append(0, np.cumsum(w**2, dtype=np.float64))
    size = np.diff(off)
    inner = np.maximum(-(-(size - WIDTH) // STRIDE), 0)  # passages before the last, which ends with the text
    doc = np.repeat(np.arange(len(size)), inner)
    begins = off[doc] + STRIDE * (np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner))
    doc, begins = np.append(doc, np.arange(len(size))), np.append(begins, off[1:] - np.minimum(size, WIDTH))
    lo, hi = np.searchsorted(at, begins), np.searchsorted(at, np.minimum(begins + WIDTH, off[doc + 1]))
    keep = (mass[hi] - mass[lo] >= model.least * 0.999) & (hi > lo)
    doc, begins, lo, hi = doc[keep], begins[keep], lo[keep], hi[keep]
    out: dict[tuple[int, int], tuple[int, float, float]] = {}
    for k in range(0, len(doc), 2048):
        _judged(model, h, off, judge, term, w, doc[k : k + 2048], begins[k : k + 2048], lo[k : k + 2048], hi[k : k + 2048], out)
    return out


def _judged(model: Model, h, off, judge: Judge, term, w, doc, begins, lo, hi, out: dict) -> None:
    """Folds passages into the latent space, and checks those near an item passage."""
    n = hi - lo
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    v = np.add.reduceat(model.basis[term[rows]] * w[rows, None], np.cumsum(n) - n, axis=0)
    along = v @ model.latent.T
    cosine = along / np.maximum(np.sqrt((v**2).sum(1)), 1e-9)[:, None]
    for k, p in zip(*np.nonzero((cosine >= COSINE) & (along >= COVER * model.length)), strict=True):
        d, i = int(doc[k]), model.passage[p][0]
        if (d, i) in out and out[d, i][1] >= 1:
            continue
        found = judge(int(p), h[off[d] : off[d + 1]], int(begins[k] - off[d]))
        if found and ((d, i) not in out or found[1] > out[d, i][0]):
            out[d, i] = (found[1], found[2], float(cosine[k, p]))


def search(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, item_id, common_words, item_words, share, cosine) for each document that holds an item."""
    schema = "doc_id long, th long, item_id long, common_words int, item_words int, share double, cosine double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for b in batches:
            rows: list[tuple] = []
            for first, off, h in word_hashes(b.column(2), plain=True):
                for (d, i), (common, share, cosine) in _leaks(model, h, off, judge).items():
                    rows.append((b.column(0)[first + d].as_py(), b.column(1)[first + d].as_py(), model.ids[i], common, len(model.items[i]), share, cosine))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "th", "item_id", "common_words", "item_words", "share", "cosine"])

    return docs.select("__id", F.xxhash64("__text"), F.lower("__text")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, item_id, common_words, item_words, share, cosine) for each document that holds a benchmark item."""
    scratch = Scratch(docs.sparkSession, "op9")
    items = scratch.save(_split(benchmark, "item_id", "text"), "items")
    words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    blocks, out = max(1, -(-words // BLOCK_WORDS)), None
    for k in range(blocks):
        model = fit(docs, items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k))
        if model is not None:
            found = search(docs, model)
            out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, th long, item_id long, common_words int, item_words int, share double, cosine double")
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th", "cosine")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    key, digest = fresh(docs, "__id", "__th")
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(key), F.col("th").alias(digest)).distinct()
    found = Scratch(docs.sparkSession, "op9").save(found, "found")
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(digest))
    return docs.join(found, same, "left_anti")

