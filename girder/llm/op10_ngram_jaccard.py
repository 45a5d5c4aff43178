"""N-gram Jaccard self-join by multiple-global-order filtering, with its classes.

Two documents link when the Jaccard similarity of their sets of distinct 5-word shingles is at least
0.8. In any global order of the shingles, two linked sets share one of their first
``n - ceil(0.8 n) + 1`` shingles, and their first common shingle has so many after it in both sets as they must
share. Order 1 puts shingles that repeat within a partition last (the order comes from a sketch of fixed
size; any order gives whole results, a good one gives few candidates); orders 2 and 3 are random. Candidates
share a prefix shingle in order 1 at a place that still allows a link; a candidate is verified only when its
sizes and parity bits allow a link and it also shares a prefix shingle in orders 2 and 3.

Steps:

1. one scan for a row a document (set size, set digest, parity bits) and the sketch; one scan for the
   order-1 prefixes, packed by hash range;
2. equal sets are one node from here on (their digest);
3. nodes that share a prefix shingle form a run with one pivot; the pairs (pivot, node) that sizes and parity
   bits can't exclude are verified: first one a node, a star instead of all pairs, then those whose two sides
   are still in different components. A run of two is its pair, and so is done;
4. runs of more that still hold several components are searched in blocks of fixed size: ROUNDS times the
   nearest pairs that would join components (a forest, so fewer than nodes), then every cross-component pair
   that the length and parity-bit filters (both exact) can't exclude. All are verified. No candidate pair
   between components stays untested, so no link is lost.

Parity bits: a shingle flips one of B bits, so two sets differ in as many bits at most as in shingles, and
linked sets in a ninth of both sizes at most. B grows with the set, and a longer row of bits folds onto a shorter.

Nulls: a null text, an empty one or one of white space has no shingles, links with nothing and is its
own class. A null doc_id takes part; a class's id is its smallest doc_id that isn't null. Rows that
repeat stay and share a class. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import Scratch, fresh, is_empty, shuffle_partitions, table
from girder.llm.graph import components
from girder.llm.textkit import mix, shingle_sets

SKETCH_BITS = 20
SKETCH_FLUSH = 4_000_000
LEAST_BITS, MOST_BITS = 64, 2048
BLOCK = 512
HUB_TEXTS = 128
ROUNDS = 2
#: Rows of at most five numbers each, so 40 bytes: what is broadcast has 16 MB at most.
BROADCAST_ROWS = 400_000
#: Bytes of prefixes that one task gathers, on average.
GATHERED = 16 << 20
_U = np.uint64


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def linked(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= 80 * (n + m - shared)


def _digest(s: np.ndarray) -> int:
    """A set's digest, never the same for sets of other sizes but by a 64-bit chance."""
    x = mix(s, 11)
    return int(mix(np.array([x.sum() + _U(len(s))], _U) ^ np.bitwise_xor.reduce(mix(s, 12)), 13).view(np.int64)[0])


def _order_key(s: np.ndarray, order: int, classes: np.ndarray | None) -> np.ndarray:
    key = mix(s, 100 + order)
    if classes is not None:
        key = (classes[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(_U) << _U(58)) | (key >> _U(6))
    return key


def _prefix(s: np.ndarray, order: int, classes: np.ndarray | None = None) -> np.ndarray:
    """The first shingles in an order; sorted in it for order 1."""
    p, key = prefix_length(len(s)), _order_key(s, order, classes)
    first = np.arange(len(s)) if p >= len(s) else np.argpartition(key, p - 1)[:p]
    return s[first[np.argsort(key[first])]] if order == 1 else s[first]


def _parity(s: np.ndarray) -> bytes:
    bits = min(max(LEAST_BITS, 1 << (len(s) - 1).bit_length()), MOST_BITS)
    at = (mix(s, 14) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


class Bits:
    """Parity bits of sets, by the length of their rows."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(x) for x in rows], np.int64)
        self.place, self.held = np.empty(len(rows), np.int64), {}
        for n in np.unique(self.size):
            at = np.flatnonzero(self.size == n)
            self.place[at] = np.arange(len(at))
            self.held[n] = np.frombuffer(b"".join([rows[i] for i in at]), np.uint64).reshape(len(at), n // 8)

    def folded(self, at: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(at), size // 8), np.uint64)
        for n in np.unique(self.size[at]):
            own = np.flatnonzero(self.size[at] == n)
            out[own] = np.bitwise_xor.reduce(self.held[n][self.place[at[own]]].reshape(len(own), n // size, size // 8), axis=1)
        return out

    def apart(self, x: np.ndarray, y: np.ndarray, other: Bits | None = None) -> np.ndarray:
        """In how many bits rows x differ from rows y (of ``other``): as many shingles as that only one of both holds, or fewer."""
        other = other or self
        least, out = np.minimum(self.size[x], other.size[y]), np.zeros(len(x), np.int64)
        for n in np.unique(least):
            at = np.flatnonzero(least == n)
            for k in range(0, len(at), 1 << 16):
                some = at[k : k + (1 << 16)]
                out[some] = np.bitwise_count(self.folded(x[some], n) ^ other.folded(y[some], n)).sum(1, dtype=np.int64)
        return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document, and how often shingles of a cell repeat within this task over sets that differ."""
    cells, held, size, seen = np.zeros(1 << SKETCH_BITS, np.int64), [], 0, set()

    def flush() -> None:
        if held:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            more = counts > 1
            np.add.at(cells, (tokens[more] >> _U(64 - SKETCH_BITS)).astype(np.int64), counts[more])
            held.clear()

    def rows(ids, hashes, ns, sigs, bits, cell, count) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, hashes, ns, sigs, bits, cell, count), kinds, strict=True)], ["doc_id", "th", "n", "sig", "bits", "cell", "count"])

    for batch in batches:
        ns, sigs, bits = [], [], []
        for s in shingle_sets(batch.column(1)):
            d = _digest(s) if len(s) else None
            new = d is not None and d not in seen
            ns.append(len(s))
            sigs.append(d)
            bits.append(_parity(s) if new else None)
            if new:
                seen.add(d)
                held.append(s)
                size += len(s)
                if size >= SKETCH_FLUSH:
                    flush()
                    size = 0
        none = [None] * len(ns)
        yield rows(batch.column(0), batch.column(2), ns, sigs, bits, none, none)
    flush()
    at = np.flatnonzero(cells)
    none = [None] * len(at)
    yield rows(none, none, none, none, none, at, cells[at])


def frequency_classes(counts: DataFrame) -> np.ndarray:
    """A class from 0 (rare) to 63 for each cell of the sketch; 2**SKETCH_BITS bytes, whatever the input."""
    rows = counts.groupBy("cell").agg(F.sum("count").alias("count")).where("count > 3").toPandas()
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    classes[rows["cell"].to_numpy(np.int64)] = np.minimum(2 * np.log2(np.maximum(rows["count"].to_numpy(np.float64), 1)), 63).astype(np.uint8)
    return classes


#: A shingle of a prefix: part of its hash, its place in the set's order in parts of PLACES of the set's size, the class of its set's size, its set's digest.
RECORD = [("tok", "<u4"), ("place", "u1"), ("size", "u1"), ("sig", "<i8")]
SIZE_BASE = 1.05
#: Classes so far apart are of sizes under the threshold: 1.05**5 > 1 / 0.8.
SIZE_GAP = 6
PLACES = 200


def _size_class(n: int) -> int:
    return min(int(np.log(n) / np.log(SIZE_BASE) + 1e-9), 255)


def _allowed(place: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether a set's first common shingle with a set of another size class may stand at ``place``.

    Linked sets of sizes n and m share 4/9 (n + m) shingles at least, all of them at or after the first; m is
    taken as small as the classes and the threshold let it be.
    """
    ratio = np.where(own >= 255, 0.8, np.maximum(0.8, SIZE_BASE ** (other.astype(np.float64) - own - 1)))
    return place <= PLACES * (1 - 4 / 9 * (1 + ratio)) + 1e-6


def _prefixes(docs: DataFrame, classes: np.ndarray, parts: int) -> DataFrame:
    """(p, payload): the order-1 prefixes, each set once a task, packed by hash range."""
    packed = classes.tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, seen = np.frombuffer(packed, np.uint8), set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def blobs() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            lens = np.array([len(x[0]) for x in held])
            tok = mix(np.concatenate([x[0] for x in held]), 15)
            rec = np.empty(len(tok), RECORD)
            rec["tok"], rec["sig"] = tok & _U(0xFFFFFFFF), np.repeat(np.array([x[1] for x in held], np.int64), lens)
            rec["size"] = np.repeat(np.array([_size_class(x[2]) for x in held], np.uint8), lens)
            rank = np.arange(len(tok)) - np.repeat(np.cumsum(lens) - lens, lens)
            rec["place"] = (PLACES * rank // np.repeat(np.array([x[2] for x in held]), lens)).astype(np.uint8)
            p = ((tok >> _U(32)) % _U(parts)).astype(np.int32)
            order = np.argsort(p, kind="stable")
            rec, p = rec[order], p[order]
            ids, at = np.unique(p, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([rec[a:b].tobytes() for a, b in zip(at, [*at[1:], len(p)], strict=True)], pa.binary())], ["p", "payload"])
            held.clear()

        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    pre = _prefix(s, 1, cls)
                    held.append((pre, d, len(s)))
                    size += len(pre)
            if size > 2_000_000:
                yield from blobs()
                size = 0
        yield from blobs()

    return docs.select("__text").mapInArrow(scan, "p int, payload binary")


def _cuts(tok: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where runs begin: at another shingle, or at a gap of sizes that no link can span."""
    cut = np.ones(len(tok), bool)
    cut[1:] = (tok[1:] != tok[:-1]) | (size[1:] - size[:-1] >= SIZE_GAP)
    return np.flatnonzero(cut)


def _runs(t: pa.Table) -> pa.Table:
    """Nodes that share a prefix shingle, split where sizes leave a gap that no link can span; pivot: the run's first node in a random order."""
    rec = np.concatenate([np.frombuffer(x.as_buffer(), RECORD) for x in t.column("payload")])
    # only shingles that two rows hold
    order = np.argsort(rec["tok"], kind="stable")
    tok = rec["tok"][order]
    same = np.zeros(len(tok) + 1, bool)
    same[1:-1] = tok[1:] == tok[:-1]
    rec = rec[order[same[1:] | same[:-1]]]
    # a node once, at its first place
    rec = rec[np.lexsort((rec["place"], rec["sig"], rec["size"], rec["tok"]))]
    keep = np.ones(len(rec), bool)
    keep[1:] = (rec["tok"][1:] != rec["tok"][:-1]) | (rec["sig"][1:] != rec["sig"][:-1])
    rec = rec[keep]
    for _ in range(2):  # without nodes that can't begin a link here with any other of their run
        if not len(rec):
            break
        size = rec["size"].astype(np.int64)
        at = _cuts(rec["tok"], size)
        m = np.diff(np.append(at, len(rec)))
        run = np.repeat(np.arange(len(at)), m)
        # the run's smallest set, or its second smallest for that one itself
        least = size[np.minimum(at[run] + (np.arange(len(rec)) == at[run]), len(rec) - 1)]
        rec = rec[np.repeat(m > 1, m) & _allowed(rec["place"], size, least)]
    size, sig = rec["size"].astype(np.int64), rec["sig"].copy()
    at = _cuts(rec["tok"], size) if len(rec) else np.empty(0, np.int64)
    m = np.diff(np.append(at, len(rec)))
    whole = np.repeat(m > 1, m)
    tok, size, sig = rec["tok"][whole], size[whole], sig[whole]
    if not len(sig):
        return pa.table({"run": pa.array([], pa.int64()), "sig": pa.array([], pa.int64()), "pivot": pa.array([], pa.int64()), "near": pa.array([], pa.bool_()), "m": pa.array([], pa.int32())})
    at = _cuts(tok, size)
    m = np.diff(np.append(at, len(sig)))
    h = mix(sig.view(_U), 16)
    # runs of the same nodes count once
    digest = np.add.reduceat(mix(h, 17), at) ^ mix(np.bitwise_xor.reduceat(h, at))
    one = np.zeros(len(at), bool)
    one[np.unique(digest, return_index=True)[1]] = True
    k = np.repeat(np.arange(len(at)), m)
    lead = np.flatnonzero(h == np.minimum.reduceat(h, at)[k])
    lead = lead[np.unique(k[lead], return_index=True)[1]]
    keep = one[k]
    k = k[keep]
    near = np.abs(size[lead][k] - size[keep]) < SIZE_GAP
    return pa.table({"run": digest.view(np.int64)[k], "sig": sig[keep], "pivot": sig[lead][k], "near": near, "m": m[k].astype(np.int32)})


RUNS = "run long, sig long, pivot long, near boolean, m int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, role): the hub's text comes before the texts to hold against it."""
    hub, s, pre = None, np.empty(0, _U), []
    for batch in batches:
        a, b = [], []
        cols = batch.to_pydict()
        for i, x in enumerate(shingle_sets(batch.column("text"))):
            sig = cols["sig"][i]
            if not len(x) or _digest(x) != sig:
                continue  # another text under the same doc_id
            if cols["role"][i] == 0:
                hub, s, pre = cols["hub"][i], x, [_prefix(x, k) for k in (2, 3)]
                continue
            if hub != cols["hub"][i] or 5 * min(len(x), len(s)) < 4 * max(len(x), len(s)):
                continue
            if all(np.isin(_prefix(x, k), q).any() for k, q in zip((2, 3), pre, strict=True)) and linked(len(np.intersect1d(x, s, assume_unique=True)), len(x), len(s)):
                a.append(hub)
                b.append(sig)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _spread(big: DataFrame, small: DataFrame, on: list, rows: int) -> DataFrame:
    """A join whose small side is broadcast if it has at most BROADCAST_ROWS rows, else both are shuffled."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on)


class Texts:
    """The texts of nodes, fetched from the documents when a pair first asks for them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, scratch: Scratch):
        self.docs, self.nodes, self.scratch = docs, nodes, scratch
        self.held: list[DataFrame] = []

    def of(self, sigs: DataFrame, name: str) -> DataFrame:
        """(sig, text) of at least the nodes ``sigs``; any text with the node's set is as good as another."""
        for t in self.held:
            sigs = sigs.join(t.select("sig"), "sig", "left_anti")
        heads = self.scratch.save(sigs.join(self.nodes, "sig").select("sig", F.col("rep").alias("__rep"), F.col("th").alias("__th"), "many"), f"{name}-heads")
        n, many = heads.agg(F.count("*"), F.count_if("many")).first()
        if n:
            same = F.col("__id").eqNullSafe(F.col("__rep")) & (F.xxhash64("__text") == F.col("__th"))
            texts = _spread(self.docs, heads, [same], n).select("sig", "many", F.col("__text").alias("text"))
            if many:  # a text once, however many rows are equal to its head
                texts = texts.where("not many").union(texts.where("many").dropDuplicates(["sig"]))
            self.held.append(self.scratch.save(texts.select("sig", "text"), f"{name}-texts"))
        out = self.held[0]
        for t in self.held[1:]:
            out = out.union(t)
        return out


def verify(texts: Texts, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of the pairs (hub, sig) those that link. A hub with many partners is dealt out in groups of about HUB_TEXTS."""
    pairs = scratch.save(pairs, f"{name}-pairs")
    if is_empty(pairs):
        return pairs.select(F.col("hub").alias("a"), F.col("sig").alias("b"))
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_TEXTS).cast("int").alias("salts")).where("salts > 1")
    dealt = pairs.join(salts, "hub", "left").select("hub", "sig", F.expr("if(salts is null, 0, pmod(xxhash64(sig), salts))").cast("int").alias("salt"))
    wanted = dealt.withColumn("role", F.lit(1)).union(dealt.select("hub", F.col("hub").alias("sig"), "salt", F.lit(0)).distinct())
    wanted = scratch.save(wanted, f"{name}-wanted")
    held = texts.of(wanted.select("sig").distinct(), name)
    rows = _spread(held, wanted, ["sig"], wanted.count()).select("hub", "salt", "role", "sig", "text")
    parts = shuffle_partitions(held.sparkSession)
    return rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", "role").mapInArrow(_verify, "a long, b long").distinct()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (hub, sig, n, m, x, y) the pairs that sizes and parity bits can't exclude."""
    for b in batches:
        n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
        at = np.flatnonzero(5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
        apart = Bits(b.column("x").to_pylist()).apart(at, at, Bits(b.column("y").to_pylist()))
        at = pa.array(at[9 * apart <= n[at] + m[at]])
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("hub", "sig")], ["hub", "sig"])


def close_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (hub, sig) those that may link; sets: (sig, n, bits)."""
    x = sets.select(F.col("sig").alias("hub"), "n", F.col("bits").alias("x"))
    y = sets.select("sig", F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(x, "hub").join(y, "sig").select("hub", "sig", "n", "m", "x", "y").mapInArrow(_close, "hub long, sig long")


def _blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, x, y, apart): of the block pairs of a table the pairs of other components that sizes and parity bits let pass, as row numbers."""
    run, i, j, block, sig, n, root = (t.column(c).to_numpy() for c in ("run", "i", "j", "block", "sig", "n", "root"))
    n = n.astype(np.int64)
    order = np.lexsort((sig, block, j, i, run))
    edge = np.append(True, (np.diff(run[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(order))
    group = np.cumsum(edge) - 1
    left = (block == i)[order]
    split = begin + np.add.reduceat(left.astype(np.int64), begin) if len(begin) else begin  # where the right block begins
    place = np.arange(len(order))
    inner = (i == j)[order]
    first = np.where(inner, place + 1, np.where(left, split[group], end[group]))
    partners = end[group] - first
    bits, out = Bits(t.column("bits").to_pylist()), []
    cuts = np.searchsorted(np.cumsum(partners), np.arange(0, int(partners.sum()) + 1, 1 << 20))
    for a, b in zip([0, *cuts[1:]], [*cuts[1:], len(order)], strict=True):
        x = np.repeat(place[a:b], partners[a:b])
        if not len(x):
            continue
        y = np.arange(len(x)) - np.repeat(np.cumsum(partners[a:b]) - partners[a:b], partners[a:b]) + first[x]
        g, x, y = group[x], order[x], order[y]
        ok = (root[x] != root[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])) & (sig[x] != sig[y])
        g, x, y = g[ok], x[ok], y[ok]
        apart = bits.apart(x, y)
        ok = 9 * apart <= n[x] + n[y]  # a link's symmetric difference is a ninth of both sizes at most
        out.append((g[ok], x[ok], y[ok], apart[ok]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.empty(0, np.int64),) * 4


def _named(t: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    sig = t.column("sig").to_numpy()
    both = np.unique(np.column_stack([np.maximum(sig[x], sig[y]), np.minimum(sig[x], sig[y])]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["hub", "sig"])


def _forest(t: pa.Table) -> pa.RecordBatch:
    """Of each block pair the nearest pairs that would join its components, one less than components at most."""
    root = t.column("root").to_numpy()
    g, x, y, apart = _blocks(t)
    up: dict[int, int] = {}

    def find(k: int) -> int:
        while (p := up.get(k, k)) != k:
            up[k] = k = up.get(p, p)
        return k

    keep, now = [], -1
    for k in np.lexsort((apart, g)):
        if g[k] != now:
            now = g[k]
            up.clear()
        p, q = find(int(root[x[k]])), find(int(root[y[k]]))
        if p != q:
            up[p] = q
            keep.append(k)
    return _named(t, x[keep], y[keep])


def _cross(t: pa.Table) -> pa.RecordBatch:
    """All pairs of each block pair."""
    _, x, y, _ = _blocks(t)
    return _named(t, x, y)


def _searched(pick):
    """``pick`` over whole block pairs of rows sorted by (run, i, j); holds one batch and the block pair that goes on after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = np.column_stack([t.column(c).to_numpy().astype(np.int64) for c in ("run", "i", "j")])
            other = np.flatnonzero((key != key[-1]).any(1))
            done = int(other[-1]) + 1 if len(other) else 0
            held = t.slice(done)
            if done:
                yield pick(t.slice(0, done))
        if held is not None and held.num_rows:
            yield pick(held)

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row (doc_id, th, n, sig) for each document, (sig, root, component_id) for each node, and the verified links."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "op10")
    docs = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    scanned = docs.select("__id", "__text", F.xxhash64("__text")).mapInArrow(_digests, "doc_id long, th long, n int, sig long, bits binary, cell int, count long")
    scanned = scratch.save(scanned, "scan")
    rows = scanned.where("cell is null").select("doc_id", "th", "n", "sig")
    # a node's head is the row with its smallest doc_id (null last) and then text hash; ``many``: rows are equal to it
    each = rows.where("sig is not null").groupBy("sig", "doc_id", "th").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rows"))
    nodes = each.groupBy("sig").agg(head.alias("h"), F.max("n").alias("n")).select("sig", F.col("h.doc_id").alias("rep"), F.col("h.th").alias("th"), (F.col("h.rows") > 1).alias("many"), "n")
    nodes = scratch.save(nodes, "nodes")
    tokens = (nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0) / 5
    parts = max(4 * shuffle_partitions(spark), int(tokens * np.dtype(RECORD).itemsize / GATHERED))
    prefixes = _prefixes(docs, frequency_classes(scanned.where("cell is not null").select("cell", "count")), parts)
    runs = scratch.save(prefixes.groupBy("p").applyInArrow(_runs, RUNS), "runs")
    bits = scanned.where("bits is not null").join(runs.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.max("bits").alias("bits"))
    sets = scratch.save(nodes.select("sig", "n").join(bits, "sig"), "sets")
    texts = Texts(docs, nodes, scratch)

    # pairs with pivots: first one a node, the first in a random order
    pairs = runs.where("sig <> pivot and near").select(F.col("pivot").alias("hub"), "sig").distinct()
    pairs = scratch.save(close_pairs(pairs, sets), "close")
    stars = pairs.groupBy("sig").agg(F.min(F.struct(F.xxhash64("hub").alias("h"), "hub")).alias("p")).select(F.col("p.hub").alias("hub"), "sig")
    edges = scratch.save(verify(texts, stars, scratch, "star"), "star-links")
    comps = scratch.save(components(edges, scratch, "star-cc"), "star-comps")

    def merged(more: DataFrame, name: str) -> DataFrame:
        return scratch.save(components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch, f"{name}-cc"), f"{name}-comps")

    # then those between components; the star's own pairs that don't link are among them, and are left out
    a, b = comps.select(F.col("node").alias("hub"), F.col("root").alias("p")), comps.select(F.col("node").alias("sig"), F.col("root").alias("q"))
    apart = pairs.join(a, "hub", "left").join(b, "sig", "left").where("coalesce(p, hub) <> coalesce(q, sig)").select("hub", "sig")
    rest = scratch.save(apart.join(stars, ["hub", "sig"], "left_anti"), "rest")
    if not is_empty(rest):
        found = scratch.save(verify(texts, rest, scratch, "rest"), "rest-links")
        edges, comps = edges.union(found), merged(found, "rest")
    tested = pairs.select(F.greatest("hub", "sig").alias("hub"), F.least("hub", "sig").alias("sig"))

    def open_blocks(k: int) -> DataFrame | None:
        """The rows of runs that hold several components, dealt into blocks of about BLOCK nodes, for each pair of blocks."""
        named = runs.where("m > 2").join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("run", "sig", "m", F.coalesce("root", "sig").alias("root"))
        named = scratch.save(named, f"named-{k}")
        mixed = named.groupBy("run").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("run")
        members = scratch.save(named.join(mixed, "run", "left_semi"), f"open-{k}")
        scratch.drop(f"named-{k}")
        if is_empty(members):
            return None
        dealt = members.withColumn("blocks", F.expr(f"int(ceil(m / {BLOCK}))")).withColumn("block", F.expr("int(pmod(xxhash64(sig), blocks))"))
        dealt = dealt.join(sets, "sig").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = dealt.select("run", F.expr("least(block, other)").alias("i"), F.expr("greatest(block, other)").alias("j"), "block", "sig", "n", "root", "bits")
        return dealt.repartition(parts, "run", "i", "j").sortWithinPartitions("run", "i", "j")

    # in larger runs first the nearest pairs between components, as long as they link; then every pair that is left
    for k in range(ROUNDS + 1):
        dealt = open_blocks(k)
        if dealt is None:
            break
        last = k == ROUNDS
        more = dealt.mapInArrow(_searched(_cross if last else _forest), "hub long, sig long").distinct()
        more = scratch.save(more.join(tested, ["hub", "sig"], "left_anti"), f"pairs-{k}")
        if is_empty(more):
            continue
        tested = tested.union(more)
        found = scratch.save(verify(texts, more, scratch, f"round-{k}"), f"links-{k}")
        edges, comps = edges.union(found), merged(found, f"round-{k}")

    labelled = nodes.select("sig", "rep").join(comps.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows, labelled.join(ids, "root").select(F.col("sig").alias("__sig"), "root", "component_id"), edges


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    rows, ids, _ = _classes(docs, id_col, text_col)
    own = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(ids, F.col("sig") == F.col("__sig"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The verified links between nodes (a, b), enough to connect every class, and each row's node (doc_id, sig)."""
    rows, _, edges = _classes(docs, id_col, text_col)
    return edges, rows.select("doc_id", "sig")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id (null last), then the smallest text hash.

    Rows equal in doc_id and text count once. Documents without words all stay.
    """
    rows, ids, _ = _classes(docs, "doc_id", "text")
    heads = rows.where("sig is not null").join(ids, F.col("sig") == F.col("__sig")).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("h"))
    key, digest, bare = fresh(docs, "__id", "__th", "__bare")
    heads = heads.select(F.col("h.doc_id").alias(key), F.col("h.th").alias(digest), F.lit(False).alias(bare))
    heads = heads.union(rows.where("sig is null").select("doc_id", "th", F.lit(True)).distinct())
    heads = Scratch(docs.sparkSession, "op10").save(heads, "heads")
    repeated = rows.where("sig is not null").groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th")
    kept = docs.join(heads, docs["doc_id"].eqNullSafe(heads[key]) & (F.xxhash64(docs["text"]) == heads[digest]))
    if is_empty(repeated):
        return kept.select(*[docs[c] for c in docs.columns])
    once = kept.where(~F.col(bare)).dropDuplicates([key, digest])
    return once.union(kept.where(F.col(bare))).select(*docs.columns)
