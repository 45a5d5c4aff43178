"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded (a learned table); one more input plane marks bytes that end a repetition, that is whose last
SAME bytes stood up to LAG bytes earlier too: a window of 12 bytes can't see that. Learned filters, 12 bytes
wide and 4 bytes apart, run over overlapping chunks that cover the whole document, and give what one pass over the
whole text would give, whatever the chunk size: scoring takes the parameters as multiples of 2**-GRID in float64, where all
sums of a window are exact, so their order can't matter; each filter's responses are max-pooled over all chunks, and one logistic unit combines the
maxima into a probability. Training follows the maxima back to their windows (Adam, fixed seed).

Training rows: at most ``TRAIN_ROWS`` labelled rows whose texts have ``TRAIN_BYTES`` bytes together at most,
in a hash order of their ids, none of the held-out fold; the text that reaches the bound is the last, and is taken whole
however long it is. That bound and one text are what the driver holds; scoring covers every byte of every document, one batch at a time.

Nulls: a null text scores as an empty one; labels that are null don't train; a doc_id labelled more than
once trains with its largest label; a null doc_id is scored and never trains (its fold is null: not held
out). Without any label every score is 0.5. Rows that repeat are scored each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import crc_fold, table
from girder.llm.textkit import SLICE, utf8

TRAIN_ROWS, TRAIN_BYTES = 2000, 16 << 20
EMBED, FILTERS, STEP, TAPS = 4, 16, 4, 3
OVERLAP = STEP * (TAPS - 1)
EPOCHS, BATCH, RATE = 10, 32, 0.01
SAME, LAG = 6, 32
PLANES = STEP * EMBED + 1
#: Parameters of up to 2**4 on this grid make products of 36 bits after the point, and sums of fewer than 53 bits.
GRID, LARGEST = 18, 16.0


def repeats(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """1 for each byte whose last SAME bytes stood 2 to LAG bytes earlier in its text as well; place: its place there."""
    out = np.zeros(len(raw), bool)
    for lag in range(2, min(LAG, len(raw) - SAME) + 1):
        one = raw[lag:] == raw[:-lag]
        two = one[1:] & one[:-1]
        run = two[4:] & two[2:-2] & two[:-4]  # ends six equal bytes
        out[lag + SAME - 1 :] |= run & (place[lag + SAME - 1 :] >= lag + SAME - 1)
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first block, windows, bytes, repeats) of each buffer of chunks.

    A chunk holds OVERLAP bytes more than its windows begin in, so every window that a whole text has lies in
    one of its chunks; only where the text ends is it filled up with zeros.
    """
    raw, off = utf8(texts)
    size = SLICE // 4
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        if off[j] - off[i] <= size:
            spans = [(np.arange(i, j), off[i:j], off[i + 1 : j + 1], -(-(off[i + 1 : j + 1] - off[i:j]) // STEP))]
        else:
            spans = []
            for a in range(int(off[i]), int(off[j]), size):
                b = min(a + size + OVERLAP, int(off[j]))
                spans.append((np.array([i]), np.array([a]), np.array([b]), np.array([min(size // STEP, -(-(int(off[j]) - a) // STEP))])))
        for docs, s, e, windows in spans:
            blocks = windows + TAPS - 1
            first = np.cumsum(blocks) - blocks
            back = min(int(s[0] - off[docs[0]]), LAG + SAME)  # what a later chunk looks back on
            part = raw[s[0] - back : e[-1]]
            place = np.arange(len(part)) - back + np.repeat(s[0] - off[docs] if len(docs) == 1 else s[0] - s, np.append(e[0] - s[0] + back, e[1:] - s[1:]))
            to = np.repeat(first * STEP - (s - s[0]), e - s) + np.arange(len(part) - back)
            buf, again = np.zeros(int(blocks.sum()) * STEP, np.uint8), np.zeros(int(blocks.sum()) * STEP, np.float32)
            buf[to], again[to] = part[back:], repeats(part, place)[back:]
            yield docs, first, windows, buf, again
        i = j


class Network:
    """The parameters and what they compute."""

    def __init__(self, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "w": r.normal(0, 0.25, (TAPS, PLANES, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": r.normal(0, 0.3, FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0

    def blocks(self, buf: np.ndarray, again: np.ndarray) -> np.ndarray:
        x = np.empty((len(buf) // STEP, PLANES), self.p["embed"].dtype)
        x[:, :-1] = self.p["embed"][buf].reshape(-1, STEP * EMBED)
        x[:, -1] = again.reshape(-1, STEP).mean(1)
        return x

    def exact(self) -> Network:
        """The same network with parameters on the grid, in float64."""
        out = Network.__new__(Network)
        out.p = {k: np.clip(np.rint(x.astype(np.float64) * 2**GRID) / 2**GRID, -LARGEST, LARGEST) for k, x in self.p.items()}
        return out

    def responses(self, x: np.ndarray) -> np.ndarray:
        """One row a block; the last TAPS - 1 rows of a chunk would run into the next and stay out."""
        out = x @ self.p["w"][0] + self.p["b"]
        for k in range(1, TAPS):
            out[:-k] += x[k:] @ self.p["w"][k]
        return out

    def pooled(self, texts: pa.Array) -> np.ndarray:
        net = self.exact()
        best = np.zeros((len(texts), FILTERS))
        for docs, first, windows, buf, again in chunks(texts):
            out = net.responses(net.blocks(buf, again))
            some = windows > 0
            if some.any():
                edges = np.column_stack([first[some], first[some] + windows[some]]).ravel()
                top = np.maximum.reduceat(np.vstack([out, np.zeros((1, FILTERS))]), edges, axis=0)[::2]
                np.maximum.at(best, docs[some], top)
        return best

    def score(self, texts: pa.Array) -> np.ndarray:
        z = (self.pooled(texts) * self.p["v"]).sum(1) + self.p["c"]  # not a matrix product, whose order of sums follows the batch
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 3) -> None:
        share = np.clip(labels.mean(), 0.02, 0.98)
        self.p["c"][:] = np.log(share / (1 - share))
        r = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        held = [[(buf, again, int(windows[0])) for _, _, windows, buf, again in chunks(pa.array([t], pa.large_string()))] if t else [] for t in texts]
        each = np.arange(FILTERS)
        t = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / (EPOCHS + 1))
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                some = order[at : at + BATCH]
                for i in some:
                    # each filter's largest response, and the blocks and bytes of its window
                    top, rows, bytes_ = np.zeros(FILTERS, np.float32), np.zeros((TAPS, FILTERS, PLANES), np.float32), np.zeros((TAPS, FILTERS, STEP), np.uint8)
                    for buf, again, windows in held[i]:
                        x = self.blocks(buf, again)
                        out = self.responses(x)[:windows]
                        win = out.argmax(0)
                        up = np.flatnonzero(out[win, each] > top)
                        top[up] = out[win[up], up]
                        for k in range(TAPS):
                            rows[k, up], bytes_[k, up] = x[win[up] + k], buf.reshape(-1, STEP)[win[up] + k]
                    z = float(top @ self.p["v"] + self.p["c"][0])
                    d = np.float32((1 / (1 + np.exp(-z)) - labels[i]) / len(some))
                    g["c"] += d
                    g["v"] += d * top
                    dz = d * self.p["v"] * (top > 0)
                    if not dz.any():
                        continue
                    g["b"] += dz
                    for k in range(TAPS):
                        g["w"][k] += rows[k].T * dz
                        back = (self.p["w"][k][:-1] * dz).T.reshape(FILTERS * STEP, EMBED)
                        np.add.at(g["embed"], bytes_[k].ravel(), back)
                t += 1
                for k in self.p:
                    if k in ("w", "v"):
                        g[k] += 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
                self.p["embed"][0] = 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts of ``most_bytes`` together, outside the held-out fold, in a hash order of their ids, on the driver.

    Sizes are looked at first, a number a row; the row that reaches the bound is the last, whatever its size. Of several texts
    under one doc_id the first in order trains.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & (crc_fold("doc_id") != 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).alias("__y"))
    picked = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    # the pick has a stated bound, and so may be broadcast
    sizes = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).groupBy("__id", "__y").agg(F.min(F.struct(F.md5(F.col("__text").cast("binary")).alias("md5"), F.octet_length("__text").alias("n"))).alias("t"))
    left, taken = most_bytes, []
    for r in sizes.orderBy(F.xxhash64("__id"), "__id").collect():
        if left > 0:
            left -= r["t"]["n"]
            taken.append((r["__id"], r["t"]["md5"], float(r["__y"] > 0)))
    wanted = spark.createDataFrame(taken, "__id long, __md5 string, __y double")
    same = (F.col("doc_id") == F.col("__id")) & (F.md5(F.col("__text").cast("binary")) == F.col("__md5"))
    got = texts.join(F.broadcast(wanted), same).dropDuplicates(["__id"]).select("__id", "__text", "__y").collect()
    got.sort(key=lambda r: r["__id"])
    return [r["__text"] for r in got], np.array([r["__y"] for r in got])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network | None:
    texts, y = training_rows(docs, labels, label, TRAIN_ROWS, TRAIN_BYTES)
    if not texts:
        return None
    net = Network()
    net.fit(texts, y)
    return net


def scored(docs: DataFrame, net: Network | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id by default) and score of every row."""
    keep = keep or ["doc_id"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep, F.col("text").alias("__t")).schema) + ", score double"
    schema = schema.replace("`__t` string, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = net.score(b.column(len(keep))) if net else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col("text").alias("__t")).mapInArrow(run, schema)


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` that the network does not reject (all of them where nothing could be learned)."""
    if net is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = net.score(b.column(b.schema.get_field_index("text"))) >= 0.5
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

