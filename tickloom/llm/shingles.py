"""Word shingles of whole texts as arrays of 64-bit hashes.

Words are runs of anything but the six ASCII space characters, with A-Z lower-cased. A word's hash is a polynomial
over a random table of its bytes, got for all words of a batch from one running sum; a shingle's hash mixes five word
hashes. Equal shingles have equal hashes everywhere; different ones differ but for a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tickloom.llm.collide import GOLD, mix64

WIDTH = 5
#: Bytes of text that are turned into arrays at once.
BYTES = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)
_BASE = 0x5851F42D4C957F2D
_PLACES = mix64(np.arange(11, 11 + WIDTH, dtype=np.uint64) * GOLD) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of an array of bytes."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * GOLD), start


def words_of(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of each text, in order. Texts are hashed together up to BYTES; a longer one is hashed in
    slices that end at a space."""
    at = 0
    while at < len(raws):
        if len(raws[at]) > BYTES:
            yield at, long_words(raws[at])
            at += 1
            continue
        to, size = at, 0
        while to < len(raws) and size + len(raws[to]) + 1 <= BYTES + 1:
            size += len(raws[to]) + 1
            to += 1
        hashes, start = word_hashes(np.frombuffer(b"\n".join(raws[at:to]).lower(), np.uint8))
        ends = np.cumsum([len(r) + 1 for r in raws[at:to]])
        cuts = np.searchsorted(start, ends, side="left")
        for i, (a, b) in enumerate(zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True)):
            yield at + i, hashes[a:b]
        at = to


def long_words(raw: bytes) -> np.ndarray:
    raw, parts, at = raw.lower(), [], 0
    while at < len(raw):
        to = min(len(raw), at + BYTES)
        while to < len(raw) and not _SPACE[raw[to]]:
            to += 1
        parts.append(word_hashes(np.frombuffer(raw[at:to], np.uint8))[0])
        at = to
    return np.concatenate(parts)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct shingles, ascending; a text with fewer words than a shingle is one shingle; none without words."""
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        total = np.r_[words * _PLACES[:n], np.array([n], np.uint64) * GOLD].sum(dtype=np.uint64)
        return mix64(np.array([total], np.uint64))
    total = words[: n - WIDTH + 1] * _PLACES[0]
    for i in range(1, WIDTH):
        total = total + words[i : n - WIDTH + 1 + i] * _PLACES[i]
    return np.unique(mix64(total))


def set_id(shingles: np.ndarray) -> int:
    """A non-negative 63-bit name of a set."""
    total = np.r_[mix64(shingles + GOLD), np.array([len(shingles)], np.uint64)].sum(dtype=np.uint64)
    return int(mix64(np.array([total], np.uint64))[0] >> np.uint64(1))


def level(sizes: np.ndarray) -> np.ndarray:
    """The sketch size of sets of these sizes, as a power of two: at least a bit for each element."""
    return np.maximum(8, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """The parity of the number of elements in each of 2^level parts. Two sets differ in at least as many elements as
    their sketches differ in bits; a larger sketch folds to a smaller one by combining its halves."""
    bits = 1 << int(level(np.array([len(shingles)]))[0])
    part = (mix64(shingles) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=bits).astype(np.uint8) & 1).tobytes()


def fold(sketches: np.ndarray) -> np.ndarray:
    """Rows of sketches (as 64-bit words) one level smaller."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def far_apart(a: bytes, b: bytes) -> int:
    """The bits in which two sketches differ, at the smaller one's size: no more than their sets differ."""
    x, y = (np.frombuffer(v, np.uint64)[None, :] for v in ((a, b) if len(a) <= len(b) else (b, a)))
    while y.shape[1] > x.shape[1]:
        y = fold(y)
    return int(np.bitwise_count(x ^ y).sum())
