"""Word and shingle hashes of whole Arrow batches of texts, without a Python loop over words.

A word's hash is a polynomial over its bytes modulo 2**64, with a random 64-bit value for each byte
(A-Z share the values of a-z), read off prefix sums over a slice of the batch and then mixed. Texts
longer than a slice are taken in pieces that end at white space, so memory is bounded by the slice
plus eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: For plain words ASCII punctuation separates too.
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LANES = _rng.integers(1, 2**63, 5, dtype=np.int64).astype(_U) | _U(1)
_powers: list[np.ndarray] = []
WIDTH = 5


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; each seed gives another random order of the values."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        up, down = np.empty(n, _U), np.empty(n, _U)
        up[0] = down[0] = 1
        up[1:], down[1:] = _U(_BASE), _U(_INVERSE)
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers


def runs(solid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true bytes begin and end; none crosses one of ``starts``, the first bytes of the texts of a slice."""
    n = len(solid)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_sums(raw: np.ndarray) -> np.ndarray:
    """What the hashes of all spans of a slice are read off."""
    up, _ = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, _U)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * up[: len(raw)], out=sums[1:])
    return sums


def hash_spans(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the spans [s, e) of a slice; equal bytes (but for the case of A-Z) have equal hashes."""
    return mix((sums[e] - sums[s]) * _power_tables(len(sums))[1][s] + (e - s).astype(_U))


def _words(raw: np.ndarray, starts: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a slice, and where they start and end; ``starts``: first bytes of its texts."""
    s, e = runs(~space[raw], starts)
    return hash_spans(span_sums(raw), s, e) if len(s) else np.empty(0, _U), s, e


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its texts (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), off


def slices(texts: pa.Array, space: np.ndarray = _SPACE, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Run after run of texts as (first text, texts, bytes, offsets); a text longer than ``most`` bytes comes in several pieces, which end at white space."""
    raw, off = utf8(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        if off[j] - off[i] <= most:
            yield i, j - i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        else:
            at, end = int(off[i]), int(off[j])
            while at < end:
                to = min(at + most, end)
                while to < end and not space[raw[to - 1]]:  # never cut a word
                    more = np.flatnonzero(space[raw[to : min(to + 65536, end)]])
                    to = to + int(more[0]) + 1 if len(more) else min(to + 65536, end)
                yield i, 1, raw[at:to], np.array([0, to - at])
                at = to
        i = j


def word_hashes(texts: pa.Array, plain: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For run after run of texts: the index of the first, word offsets of each text, word hashes."""
    space = _BREAK if plain else _SPACE
    held: list[np.ndarray] = []  # pieces of text i
    i = 0
    for first, n, raw, off in slices(texts, space):
        h, s, _ = _words(raw, off[:-1], space)
        if held and first == i:
            held.append(h)
            continue
        if held:
            yield i, np.array([0, sum(map(len, held))]), np.concatenate(held)
            held = []
        if n == 1:
            i, held = first, [h]
        else:
            yield first, np.searchsorted(s, off), h
    if held:
        yield i, np.array([0, sum(map(len, held))]), np.concatenate(held)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 5-word shingle hashes; fewer words make one shingle, none make none."""
    for _, off, h in word_hashes(texts):
        if len(h) >= WIDTH:
            k = len(h) - WIDTH + 1
            rolled = h[:k] * _LANES[0]
            for lane in range(1, WIDTH):
                rolled += h[lane : lane + k] * _LANES[lane]
            rolled = mix(rolled)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                yield np.unique(rolled[a : b - WIDTH + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _LANES[: b - a]).sum() + _U(b - a)], _U), 7)
            else:
                yield np.empty(0, _U)
