"""The cores of the trained models against plain versions: gradients, trees, isotonic maps, latent spaces."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from girder.llm import op2_quality_cnn as op2
from girder.llm import op3_toxicity as op3
from girder.llm import op9_decontamination as op9


def loss(p, texts, labels):
    """Mean cross-entropy of the network with parameters p, in float64, and the penalty that training puts on w and v."""
    net = op2.Network()
    net.p, total = p, 0.0
    for t, y in zip(texts, labels, strict=True):
        top = np.zeros(op2.FILTERS)
        for _, _, windows, buf, again in op2.chunks(pa.array([t], pa.large_string())) if t else ():
            top = np.maximum(top, net.responses(net.blocks(buf, again))[: int(windows[0])].max(0))
        z = top @ p["v"] + p["c"][0]
        total += np.logaddexp(0, z) - y * z
    return total / len(texts) + 0.5e-4 * ((p["w"] ** 2).sum() + (p["v"] ** 2).sum())


class _NoScaling:
    """numpy, but a square root is 1, so that a first step of training is the plain gradient."""

    def __getattr__(self, name):
        return getattr(np, name)

    def sqrt(self, x):
        return np.ones_like(x)


def test_op2_gradients_against_differences(monkeypatch):
    texts = ["Der Hund lief weg.", "abc abc abc abc abc abc abc abc", "", "schön, sehr schön, wirklich", "x", "one two three four " * 30]
    labels = np.array([1.0, 0.0, 1.0, 1.0, 0.0, 0.0])
    net = op2.Network(5)
    monkeypatch.setattr(op2, "EPOCHS", 1)
    monkeypatch.setattr(op2, "np", _NoScaling())
    share = labels.mean()
    before = {k: x.astype(np.float64) for k, x in net.p.items()} | {"c": np.array([np.log(share / (1 - share))])}
    net.fit(texts, labels)
    monkeypatch.setattr(op2, "np", np)
    rng, most = np.random.default_rng(1), 0.0
    for name, x in before.items():
        got = (x - net.p[name]) / op2.RATE
        at = [tuple(rng.integers(0, n) for n in x.shape) for _ in range(60)]
        # bytes that the texts hold, so that most of the drawn parameters have a gradient
        at += [(b, k) for b in b"schn abcDert" for k in range(op2.EMBED)] if name == "embed" else []
        for i in at:
            if name == "embed" and i[0] == 0:
                continue  # what fills up a text's end stays zero
            ends = []
            for step in (1e-6, -1e-6):
                p = {k: v.copy() for k, v in before.items()}
                p[name][i] += step
                ends.append(loss(p, texts, labels))
            want = (ends[0] - ends[1]) / 2e-6
            most = max(most, abs(want))
            assert abs(got[i] - want) < 2e-4, (name, i, got[i], want)
    assert most > 0.05


def plain_trees(x, y, edges, trees):
    """The boosting of op3 by recursion over rows, without bins, histograms or heaps."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    z = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows, depth, g=g, h=h, step=step):
            if depth == op3.DEPTH:
                step[rows] = op3.RATE * g[rows].sum() / (h[rows].sum() + 1)
                return
            best = (1e-6, None, None)
            if len(rows) >= 2 * op3.LEAST:
                for j in range(x.shape[1]):
                    for e in edges[j]:
                        left, right = rows[x[rows, j] <= e], rows[x[rows, j] > e]
                        if min(len(left), len(right)) >= op3.LEAST:
                            gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + 1) for s, r in ((1, left), (1, right), (-1, rows)))
                            if gain > best[0] + 1e-12:
                                best = (gain, left, right)
            for part in best[1:] if best[1] is not None else (rows,):
                grow(part, depth + 1)

        grow(np.arange(len(y)), 0)
        z += step
    return z


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op3_trees_against_plain_ones(monkeypatch, seed):
    monkeypatch.setattr(op3, "TREES", 6)
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=150), rng.integers(0, 4, 150).astype(float), np.maximum(rng.normal(size=150), 0)])
    y = (x[:, 0] + (x[:, 1] > 2) + rng.normal(0, 0.7, 150) > 0.8).astype(float)
    fitted = op3.Trees().fit(x, y)
    assert np.allclose(fitted.raw(x), plain_trees(x, y, fitted.edges, 6), atol=1e-9)
    # rows that training did not see go by the same thresholds
    near = np.column_stack([np.clip(x[:, 0] + 1e-12, None, x[:, 0].max()), x[:, 1], x[:, 2]])
    assert np.allclose(fitted.raw(near), fitted.raw(x)) and len(fitted.raw(x[:0])) == 0


@pytest.mark.parametrize("seed", range(5))
def test_op3_isotonic_against_min_max(seed):
    r = random.Random(seed)
    n = r.randint(1, 60)
    z, y = np.array([r.choice(range(20)) + i * 1e-6 for i in range(n)], float), [r.randint(0, 1) for _ in range(n)]
    knots, values = op3.isotonic(z, np.array(y, float))
    order = np.argsort(z)
    s = [y[i] for i in order]
    mean = lambda a, b: Fraction(sum(s[a : b + 1]), b + 1 - a)
    level = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    want = []
    for i in range(n):
        block = [k for k in range(n) if level[k] == level[i]]
        want.append((sum(s[k] for k in block) + np.mean(y)) / (len(block) + 1))
    assert np.allclose(np.interp(z[order], knots, values), want)


def passages(model):
    """The dense TF-IDF rows of the items' passages."""
    rows = []
    for item in model.items:
        for s in op9.starts(len(item)):
            terms, w = op9._row(np.array(item[s : s + op9.WIDTH], np.uint64), model)
            rows.append(np.zeros(len(model.vocabulary)))
            rows[-1][terms] = w
    return np.array(rows)


@pytest.mark.parametrize("rank", [128, 8])
def test_op9_space_against_an_exact_svd(spark, monkeypatch, rank):
    monkeypatch.setattr(op9, "RANK", rank)
    r = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    topics = [r.sample(words, 12) for _ in range(8)]
    items = [" ".join(r.choice(topics[i % 8]) if r.random() < 0.9 else r.choice(words) for _ in range(r.randint(10, 60))) for i in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(" ".join(r.choices(words, k=20)),) for _ in range(40)], "__text string")
    model = op9.fit(docs, op9._split(bench, "item_id", "text"))
    a, basis = passages(model), model.basis.astype(np.float64)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    values = np.linalg.svd(a, compute_uv=False)
    k = min(rank, int((values > 1e-5).sum()))
    best, held = (values[:k] ** 2).sum(), ((a @ basis) ** 2).sum()
    assert held <= best * 1.0001 and held >= (0.9999 if rank == 128 else 0.97) * best


def test_op9_items_without_an_id(spark):
    r = random.Random(6)
    item, other = (" ".join(f"{x}{r.randrange(500)}" for _ in range(24)) for x in "ab")
    docs = spark.createDataFrame([(1, f"so {item} so"), (None, f"{other} so"), (3, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, item), (7, other)], "item_id long, text string")
    got = [(x["doc_id"], x["item_id"]) for x in op9.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (1, None), (None, 7)], key=str)
