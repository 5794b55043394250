"""Near-duplicate embeddings: Euclidean p-stable hashing in several tables, then exact cosines.

Vectors are scaled to length 1, so cosine c is distance sqrt(2 - 2c). A table's key is K quantised Gaussian
projections floor((a.v + b) / w). K grows with the logarithm of the number of vectors, so that random vectors seldom
meet; the number of tables follows from the wanted recall at the threshold itself, and is higher above it. Vectors
that share a key are compared exactly, in double precision, by blocks of a matrix product; only each vector's count
of links and its local component leave the task, never pairs. A pair is counted in the first table where it meets.

Identical vectors are first folded into one representative with a multiplicity, so a very common vector is one row.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of different lengths never link; repeated rows (same id, same vector) are one vector; of different vectors with one id
the one that counts is a valid one, and of these the one with the least hash; rows without an id are left out; the component of a vector without links is itself; an empty table gives no rows. Labels are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.collide import GOLD, PACKED, cells, mix64, pack, shared, shards_for
from tickloom.llm.components import components
from tickloom.session import cut

#: Width of the quantisation, and the members of a block of vectors that are compared at once.
WIDTH, BLOCK = 2.0, 2048


def collision(distance: float, width: float) -> float:
    """The chance that one quantised projection of two vectors at this distance is equal."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float = 0.995, width: float = WIDTH) -> tuple[int, int]:
    """K projections a table and L tables for n vectors: random vectors meet in a table about n / 20 times in all,
    and a pair exactly at the threshold meets in some table with chance `recall`."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2) * 20) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Hasher:
    def __init__(self, dim: int, k: int, tables: int, seed: int, width: float = WIDTH):
        rng = np.random.default_rng([seed, dim])
        self.k, self.tables, self.width = k, tables, width
        self.axes, self.shift = rng.standard_normal((dim, k * tables)), rng.random(k * tables) * width
        self.salt = rng.integers(1, 2**63, (tables, k), dtype=np.uint64) | np.uint64(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows by tables: 64-bit keys whose lowest two bytes are the table (`plan` gives 6,730 for 10^15 vectors)."""
        cell = np.floor((x @ self.axes + self.shift) / self.width).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.k)
        key = mix64((cell * self.salt).sum(2, dtype=np.uint64) + np.arange(self.tables, dtype=np.uint64) * GOLD + np.uint64(x.shape[1]))
        return key & ~np.uint64(0xFFFF) | np.arange(self.tables).astype(np.uint64)


def local_components(near: np.ndarray) -> np.ndarray:
    """The lowest index reachable over the links of a block, of each member."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, seed: int = 11, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    own = vectors.select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v")).where("_id IS NOT NULL")
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce((F.size("_v") > 0) & ~bad & F.exists("_v", lambda x: x != 0), F.lit(False))
    own = own.select("_id", "_v", valid.alias("_ok"), F.xxhash64("_v").alias("_h1"), F.xxhash64("_v", F.lit(5)).alias("_h2"))
    names = own.groupBy("_id").agg(F.min(F.struct((~F.col("_ok")).alias("_bad"), "_h1", "_h2")).alias("_s")).select("_id", (~F.col("_s._bad")).alias("_ok"), "_s._h1", "_s._h2")
    names = cut(names)
    groups = cut(names.where("_ok").groupBy("_h1", "_h2").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n")))
    at = groups.select(F.col("_rep").alias("_id"), "_h1", "_h2", "_n")
    reps = cut(own.where("_ok").join(at, ["_id", "_h1", "_h2"]).select("_id", "_v", "_n").dropDuplicates(["_id"]))
    n = reps.count()
    k, tables = plan(n, threshold, recall)
    shards = shards_for(n * tables)
    hashers: dict[int, Hasher] = {}

    def hashed(batch: pd.DataFrame):
        """(rows, keys) of the vectors of each length."""
        size = batch["_v"].map(len)
        for dim, part in batch.groupby(size):
            if dim not in hashers:
                hashers[dim] = Hasher(int(dim), k, tables, seed)
            for i in range(0, len(part), 1000):
                some = part.iloc[i : i + 1000]
                yield some, hashers[dim].keys(unit(some["_v"].tolist()))

    def hash_rows(batches):
        for pdf in batches:
            for some, keys in hashed(pdf):
                yield pack(keys.ravel(), np.repeat(some["_id"].to_numpy(np.int64), tables), shards)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, start, items = shared(pdf)
        ends = np.r_[start[1:], len(items)]
        cell, who, left, right, table = [], [], [], [], []
        for key, a, b in zip(keys.tolist(), start.tolist(), ends.tolist(), strict=True):
            for i, j in cells(b - a, BLOCK):
                parts = [items[a + i * BLOCK : min(b, a + (i + 1) * BLOCK)]] + ([items[a + j * BLOCK : min(b, a + (j + 1) * BLOCK)]] if i != j else [])
                name = int(mix64(np.array([key + (i * 1_000_003 + j) * int(GOLD) & (1 << 64) - 1], np.uint64))[0] >> np.uint64(1))
                for side, part in enumerate(parts):
                    who.append(part)
                    cell.append(np.full(len(part), name))
                    left.append(np.full(len(part), side == 0))
                    right.append(np.full(len(part), side == 1 or i == j))
                    table.append(np.full(len(part), key & 0xFFFF))
        flat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        return pd.DataFrame({"cell": flat(cell, np.int64), "_id": flat(who, np.int64), "left": flat(left, bool), "right": flat(right, bool), "tab": flat(table, np.int32)})

    met = cut(reps.select("_id", "_v").mapInPandas(hash_rows, PACKED).groupBy("shard").applyInPandas(meet, "cell long, _id long, left boolean, right boolean, tab int"))
    rows = met.count()
    buckets = max(1, -(-rows // 10_000))

    def prints(batches):
        """Each representative with 32-bit fingerprints of its keys, to tell in which table two of them first meet."""
        for pdf in batches:
            for some, keys in hashed(pdf):
                out = some[["_id", "_v", "_n"]].copy()
                out["prints"] = [x.tobytes() for x in (keys >> np.uint64(32)).astype(np.uint32)]
                yield out

    involved = reps.join(met.select("_id").distinct(), "_id", "left_semi")
    vec_type = reps.schema["_v"].dataType.simpleString()
    known = involved.mapInPandas(prints, f"_id long, _v {vec_type}, _n long, prints binary")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "_id"], kind="stable")
        cell = pdf["cell"].to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ids, mult = pdf["_id"].to_numpy(), pdf["_n"].to_numpy()
        left, right, tab = pdf["left"].to_numpy(), pdf["right"].to_numpy(), pdf["tab"].to_numpy()
        vectors, marks = pdf["_v"].tolist(), pdf["prints"].tolist()
        out_id, out_links, out_low = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            if len({len(v) for v in vectors[a:b]}) != 1:
                continue
            x = unit(vectors[a:b])
            mark = np.frombuffer(b"".join(marks[a:b]), np.uint32).reshape(b - a, tables)
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            near &= left[a:b, None] & right[None, a:b] | right[a:b, None] & left[None, a:b]
            if not near.any():
                continue
            i, j = np.nonzero(near)
            first = np.empty(len(i), np.int64)
            for s in range(0, len(i), 100_000):
                first[s : s + 100_000] = (mark[i[s : s + 100_000]] == mark[j[s : s + 100_000]]).argmax(1)
            mine = first == tab[a]  # else counted in an earlier table
            links = np.bincount(i[mine], weights=mult[a:b][j[mine]], minlength=b - a).astype(np.int64)
            low = local_components(near)
            some = near.any(1)
            out_id.append(ids[a:b][some])
            out_links.append(links[some])
            out_low.append(ids[a:b][low][some])
        flat = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64)
        return pd.DataFrame({"_id": flat(out_id), "links": flat(out_links), "low": flat(out_low)})

    wide = met.join(known, "_id").withColumn("bucket", F.pmod("cell", F.lit(buckets)).cast("int"))
    linked = cut(wide.groupBy("bucket").applyInPandas(compare, "_id long, links long, low long"))
    counts = linked.groupBy("_id").agg(F.sum("links").alias("_links"))
    comps = components(linked, "_id", "low").select(F.col("node").alias("_id"), F.col("component").alias("_comp"))
    per_rep = groups.select(F.col("_rep").alias("_id"), "_h1", "_h2", "_n").join(counts, "_id", "left").join(comps, "_id", "left")
    per_rep = per_rep.select("_h1", "_h2", (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("_total"), F.coalesce("_comp", "_id").alias("_comp"))
    good = names.where("_ok").join(per_rep, ["_h1", "_h2"]).select(F.col("_id").alias(key), F.col("_total").cast("long").alias("n_links"), F.col("_comp").alias("component_id"))
    rest = names.where("NOT _ok").select(F.col("_id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col(key) == F.col("component_id"))
