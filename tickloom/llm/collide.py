"""Keys shared by at least two items, and work on the items that share them, in packed arrays.

Map tasks pack (key, item) pairs into one binary row for each shard, so a hundred million pairs are a few thousand
rows to the shuffle. A shard holds a bounded number of pairs, as the number of shards follows the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

PACKED = "shard int, keys binary, items binary"
#: Pairs of a shard that a task handles at once, about 30 MB of arrays.
PER_SHARD = 500_000

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shards_for(pairs: float) -> int:
    return max(1, int(-(-pairs // PER_SHARD)))


def pack(keys: np.ndarray, items: np.ndarray, shards: int, narrow: int = 0) -> pd.DataFrame:
    """Rows of PACKED; keys are uint64, items int64. `narrow`: only the lower half of a key is shipped (the shard follows
    from the upper one) and so many of the lower bytes of an item, for users that take a few false meetings."""
    shard = (keys >> np.uint64(32 if narrow else 17)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    keys, items, shard = keys[order], items[order], shard[order]
    if narrow:
        keys = keys.astype(np.uint32)
        items = items.view(np.uint8).reshape(-1, 8)[:, :narrow]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(keys)][: len(cuts)]
    return pd.DataFrame({"shard": shard[cuts].astype(np.int32), "keys": [keys[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], "items": [items[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})


def shared(pdf: pd.DataFrame, narrow: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: the keys with at least two distinct items, the start of each in the items, and the items."""
    keys = np.frombuffer(b"".join(pdf["keys"]), np.uint32 if narrow else np.uint64)
    if narrow:
        wide = np.zeros((len(keys), 8), np.uint8)
        wide[:, :narrow] = np.frombuffer(b"".join(pdf["items"]), np.uint8).reshape(-1, narrow)
        items = wide.view(np.int64).ravel()
    else:
        items = np.frombuffer(b"".join(pdf["items"]), np.int64)
    order = np.argsort(items, kind="stable")
    order = order[np.argsort(keys[order], kind="stable")]
    keys, items = keys[order], items[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])] if len(keys) else np.zeros(0, bool)
    keys, items = keys[fresh], items[fresh]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(keys)])
    use = np.repeat(size > 1, size)
    size = size[size > 1]
    return keys[use][np.cumsum(size) - size] if len(size) else keys[:0], np.cumsum(size) - size, items[use]


def cells(size: int, block: int) -> list[tuple[int, int]]:
    """Pairs of blocks (i <= j) that cover all pairs of `size` items; a small group is the one cell (0, 0)."""
    n = -(-size // block)
    return [(i, j) for i in range(n) for j in range(i, n)]
