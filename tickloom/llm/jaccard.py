"""N-gram Jaccard join with PartEnum signatures; components of documents whose shingle sets are alike.

Sets fall into size bands that grow by the inverse of the threshold at least, so a set's partners are in its band or a
neighbour; a set signs its own band, and the next one if that may hold partners. In a band, sets that link differ in at most k elements, k being
a share of the band's largest size. The feature domain is partitioned by hash on two levels: into parts, and each of
these into `SECOND` smaller ones. In a part, every subset of all but `OUT` of the smaller parts is enumerated, and what
a set holds in that subset is a signature. Among more than k / (OUT + 1) parts, two sets that link have one in which
they differ in at most OUT elements, hence one subset in which they are equal. A part counts if the set holds elements
in more than OUT of its smaller parts, so that no subset of it is empty; the first level has a tenth more parts than
the guarantee needs. A set signs its parts in order until enough of them count: of two sets that link, the one that
stops first shares a signature with the other. A set that has too few parts that count signs all, and its first k + 1
elements besides (a pair needs these only if both sets are short, and then shares one). A signature stands for about four shingles. Their number grows
with k, as it must: with k or fewer signatures, k changes could break every one.

Equal sets are one item from the start (an item is the hash of a set), so copies never multiply. Items that share a
signature are candidates, in rounds that never emit the pairs of a group. First each item is compared with the one
item at the head of a group that it shares most signatures with. Then, if the groups' pairs are more than `PER_ITEM` for
each of their rows, those that still span several components are covered by leaders, a part of the groups after another
while this finds links: an item that fewer than `LEADERS` took becomes one, and takes those that may link with it and
that fewer took. This connects early what is alike, also where only some of a family link. Last, every pair across components in all groups
that may link and was not checked yet is tried; so the rounds before only save work. "May link" is told by sizes and
by a parity sketch, which can only understate a difference; links are decided on the sets of 64-bit hashes. So
components are exact: a pair that shares a signature is ruled out by its sketch, checked, or already connected.

A group is handled in cells of at most two blocks of `BLOCK` items. In a group of more, the items of its largest
component are never compared with each other, so once that is connected, cells are few.

Defined results: a null text, or one without words, has no shingle and links with nothing; fewer than five words are
one shingle; rows with the same text link (if they have words); a null id is carried and never a component's id
unless all its members lack one; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.collide import GOLD, PACKED, mix64, pack, shared, shards_for
from tickloom.llm.components import components
from tickloom.llm.memory import lean, lean_group
from tickloom.llm.shingles import far_apart, fold, level, set_id, shingle_set, sketch, words_of
from tickloom.session import cut

PERCENT = 75
#: Smaller parts of a part, and how many of them a subset leaves out; items of a block of a group.
SECOND, OUT, BLOCK = 3, 1, 2048
#: Places (8 to 16 bytes each) of carriers up to which they are broadcast to the texts instead of shuffling the texts.
BROADCAST_PLACES = 500_000
#: Groups fall into PARTS by hash; at most COVERS of these are covered, one after another, and LEADERS may take an item.
PARTS, COVERS, LEADERS = 32, 3, 8
#: The first groups of an item that its rows carry, to try a pair that meets in many groups in one of them.
MARKS = 8
#: Pairs of groups for each of their rows up to which all are tried at once.
PER_ITEM = 16
#: Rows of a task that compares the items of groups.
CELL_ROWS = 2000
#: Signatures that a task packs at once: with many shards, few would make rows that are mostly headers.
AT_ONCE = 200_000
#: What the sizes of a band may differ by, as a factor: a wider band has fewer sets that sign twice, but less selective signatures.
WIDTH = 1.5
#: Distinct items that a task remembers to sign each only once.
REMEMBERED = 500_000
LEAST = -(2**63)


def most_different(s: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """The most elements in which sets of sizes s and t may differ when they link."""
    return (s + t) * (100 - percent) // (100 + percent)


def bands(largest: int, percent: int) -> np.ndarray:
    """The largest sizes of the bands that hold sizes up to `largest`: a set's partners are in its band or a neighbour.
    Bands are wider than that needs, so that many sets have no partners in the next one and sign only their own."""
    tops, low = [], 1
    while not tops or tops[-1] < largest:
        tops.append(max(low, low * 100 // percent, int(low * WIDTH)))
        low = tops[-1] + 1
    return np.array(tops, np.int64)


def signatures(sets: list[np.ndarray], percent: int = PERCENT, second: int = SECOND, out: int = OUT) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of non-empty sets, and the set of each. Sets that only link with equal ones have none."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    largest = size * 100 // percent
    tops = bands(int(largest.max(initial=1)) + 1, percent)
    band = np.searchsorted(tops, size)
    keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    kept = [sum(1 << i for i in c) for c in combinations(range(second), second - out)]
    for up in (0, 1):
        tag = np.minimum(band + up, len(tops) - 1)
        top = tops[tag]
        k = most_different(size, np.minimum(top, largest), percent)
        use = np.flatnonzero((k > 0) & ((largest > tops[band]) if up else True))
        if not len(use):
            continue
        mine, n, k, salt = [sets[i] for i in use], size[use], k[use], (tag[use].astype(np.uint64) + np.uint64(1)) * GOLD
        needed = most_different(top[use], top[use], percent) // (out + 1) + 1
        first = np.where(needed == 1, 1, needed + -(-needed // 10) + 1)  # some parts are too empty to count
        flat, doc = np.concatenate(mine), np.repeat(np.arange(len(use)), n)
        name = mix64(flat + salt[doc])
        part = (name >> np.uint64(20)) % first[doc].astype(np.uint64)
        base = np.cumsum(first) - first
        slot = (base[doc] + part.astype(np.int64)) * second + (name & np.uint64(0xFFFFF)).astype(np.int64) % second
        total = np.zeros(int(first.sum()) * second, np.uint64)
        np.add.at(total, slot, name)
        full = (np.bincount(slot, minlength=len(total)) > 0).reshape(-1, second)
        total = total.reshape(-1, second)
        held = (full << np.arange(second)).sum(1)
        doc = np.repeat(np.arange(len(use)), first)
        place = (np.arange(len(doc)) - base[doc]).astype(np.uint64) * GOLD + salt[doc]
        counts = np.cumsum(full.sum(1) > out)
        before = np.r_[0, counts][base]  # parts that count before each set's own
        counted = np.r_[0, counts][base + first] - before
        needless = np.r_[0, counts[:-1]] - before[doc] > (k // (out + 1))[doc]
        for c, keep in enumerate(kept):
            rest = held & keep
            fresh = (rest > 0) & ~needless
            for other in kept[:c]:
                fresh &= held & other != rest  # the same elements, left over by another choice
            some = np.flatnonzero(fresh)
            content = total[some][:, [i for i in range(second) if keep >> i & 1]].sum(1, dtype=np.uint64)
            keys.append(mix64(content + place[some]))
            owner.append(use[doc[some]])
        for i in np.flatnonzero(counted <= k // (out + 1)).tolist():
            keys.append(mix64(mine[i][: k[i] + 1] ^ salt[i]))
            owner.append(np.full(min(k[i] + 1, n[i]), use[i]))
    return np.concatenate(keys), np.concatenate(owner)


def sets_of(texts) -> list[np.ndarray]:
    return [shingle_set(w) for _, w in words_of([x.encode() if isinstance(x, str) else b"" for x in texts])]


def chunks(pdf: pd.DataFrame, text: str = "_text", rows: int = 250, chars: int = 500_000):
    """Parts of a batch with bounded text."""
    start = total = 0
    sizes = [len(x) if isinstance(x, str) else 0 for x in pdf[text]]
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or total + n > chars):
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield pdf.iloc[start:]


def describe(docs: DataFrame, text: str, key: str) -> DataFrame:
    """_id, _doc, _hash, n_shingles, _item and the item's sketch, of each row."""

    def run(batches):
        for batch in batches:
            for pdf in chunks(batch):
                sets = sets_of(pdf["_text"])
                out = pdf[["_id", "_doc", "_hash"]].copy()
                out["n_shingles"] = [len(s) for s in sets]
                out["_item"] = pd.array([set_id(s) if len(s) else None for s in sets], dtype="Int64")
                out["_sketch"] = [sketch(s) if len(s) else None for s in sets]
                yield out

    return keyed(docs, text, key).mapInPandas(lean(run), "_id long, _doc long, _hash long, n_shingles long, _item long, _sketch binary")


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("_id"), F.coalesce(docs[key].cast("long"), F.lit(LEAST)).alias("_doc"), F.xxhash64(docs[text]).alias("_hash"), docs[text].alias("_text"))


def tag_bytes(items: int) -> int:
    """What is shipped of an item's name beside a signature, its tag: so much that at most one item in 128 shares its
    tag. Two items with one tag only add candidates: they are taken for each other, and compared (`twins`)."""
    return max(4, -(-(max(items, 1).bit_length() + 7) // 8))


def twins(items: DataFrame) -> DataFrame:
    """The pairs (a < b) of items with one tag, which don't meet in groups."""
    same = items.groupBy("_tag").agg(F.sort_array(F.collect_list("_item")).alias("_all")).where("size(_all) > 1")
    return same.select("_all", F.posexplode("_all").alias("_at", "a")).select("a", F.explode(F.expr("slice(_all, _at + 2, size(_all))")).alias("b"))


def groups_of(docs: DataFrame, text: str, key: str, shards: int, percent: int, width: int) -> DataFrame:
    """_group, _block, _head, _tags (ascending) and _weight: the tags of items that share a signature, in blocks of at
    most BLOCK, each with the group's first tag, and in how many signatures they meet."""

    def sign(batches):
        seen: set = set()
        held, n = [], 0
        for batch in batches:
            for pdf in chunks(batch):
                fresh = {}
                for s in sets_of(pdf["_text"]):
                    if len(s) and (name := set_id(s)) not in seen:
                        fresh[name] = s
                if len(seen) + len(fresh) > REMEMBERED:
                    seen.clear()
                seen.update(fresh)
                if fresh:
                    keys, owner = signatures(list(fresh.values()), percent)
                    held.append((keys, np.array(list(fresh), np.int64)[owner]))
                    n += len(keys)
                if n >= AT_ONCE:
                    yield pack(*map(np.concatenate, zip(*held, strict=True)), shards, width)
                    held, n = [], 0
        if held:
            yield pack(*map(np.concatenate, zip(*held, strict=True)), shards, width)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        _, start, items = shared(pdf, width)
        if not len(start):
            return pd.DataFrame({"_group": [], "_block": [], "_head": [], "_tags": [], "_weight": []}, dtype=object)
        size = np.diff(np.r_[start, len(items)])
        name = mix64(np.add.reduceat(mix64(items.view(np.uint64)), start) + size.astype(np.uint64)) >> np.uint64(1)
        name, at, weight = np.unique(name, return_index=True, return_counts=True)
        rows = [(g, i // BLOCK, items[a], items[a + i : a + min(n, i + BLOCK)], w) for g, a, n, w in zip(name.astype(np.int64).tolist(), start[at].tolist(), size[at].tolist(), weight.tolist(), strict=True) for i in range(0, n, BLOCK)]
        return pd.DataFrame(rows, columns=["_group", "_block", "_head", "_tags", "_weight"])

    packed = keyed(docs, text, key).mapInPandas(lean(sign), PACKED)
    found = packed.groupBy("shard").applyInPandas(lean_group(meet), "_group long, _block int, _head long, _tags array<long>, _weight long")
    return cut(found.groupBy("_group", "_block").agg(F.first("_head").alias("_head"), F.first("_tags").alias("_tags"), F.sum("_weight").alias("_weight")))


def verified(pairs: DataFrame, items: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link. The texts of one carrier of each item are read and hashed again;
    a pair is checked where its first item's set is, and an item with many partners is spread over salts."""
    pairs = cut(pairs)
    buckets = max(1, -(-pairs.count() // 1500))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 500).cast("int").alias("_salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int").alias("_salt"))
    need = salted.select(F.col("b").alias("_item"), F.col("a").alias("_lead"), "_salt").unionByName(salted.select(F.col("a").alias("_item"), F.col("a").alias("_lead"), "_salt").distinct())
    place = F.struct("_lead", F.pmod(F.xxhash64("_lead", "_salt"), F.lit(buckets)).cast("int").alias("bucket"))
    carriers = cut(need.join(items.select("_item", "_doc", "_hash"), "_item").groupBy("_doc", "_hash", "_item").agg(F.collect_set(place).alias("_places")))
    places = carriers.agg(F.sum(F.size("_places"))).first()[0] or 0
    side = F.broadcast(carriers) if places <= BROADCAST_PLACES else carriers
    texts = keyed(docs, text, key).join(side, ["_doc", "_hash"]).select("_item", "_places", "_text")

    def ship(batches):
        for batch in batches:
            for pdf in chunks(batch):
                sets = [s.tobytes() for s in sets_of(pdf["_text"])]
                yield pd.DataFrame([(int(p["bucket"]), int(p["_lead"]), i, s) for i, ps, s in zip(pdf["_item"], pdf["_places"], sets, strict=True) for p in ps], columns=["bucket", "lead", "item", "data"])

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        lead_of = {i: np.frombuffer(d, np.uint64) for i, lead, d in zip(pdf["item"], pdf["lead"], pdf["data"], strict=True) if i == lead}
        out, seen = [], set()
        for i, lead, data in zip(pdf["item"], pdf["lead"], pdf["data"], strict=True):
            if i == lead or (i, lead) in seen:
                continue
            seen.add((i, lead))
            x, y = lead_of[lead], np.frombuffer(data, np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                out.append((lead, i))
        return pd.DataFrame(out, columns=["a", "b"])

    return cut(texts.mapInPandas(lean(ship), "bucket int, lead long, item long, data binary").groupBy("bucket").applyInPandas(lean_group(check), "a long, b long"))


def plausible(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches don't rule out."""
    side = lambda c: items.select(F.col("_item").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("_sketch").alias(f"s_{c}"))
    wide = pairs.join(side("a"), "a").where("n_a IS NOT NULL").join(side("b"), "b")
    wide = wide.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches):
        for pdf in batches:
            far = np.array([far_apart(x, y) for x, y in zip(pdf["s_a"], pdf["s_b"], strict=True)], np.int64)
            yield pdf.loc[far <= most_different(pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy(), percent), ["a", "b"]]

    return wide.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInPandas(lean(run), "a long, b long")


def close_pairs(item: np.ndarray, comp: np.ndarray, half: np.ndarray, size: np.ndarray, sketches: list[bytes], marks: np.ndarray, percent: int, cover: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's items across components, and across halves if it has two (0 and 1; -1: it has one), that
    sizes and sketches don't rule out: those of leaders with the items that they take (`cover`), or all. All but those
    whose marks (the first groups of an item, as far as they come before this one) say that they meet in an earlier group."""
    order = np.argsort(size, kind="stable")
    item, comp, half, size, marks = item[order], comp[order], half[order], size[order], marks[order]
    lev = level(size)
    rows = {x: np.frombuffer(b"".join(sketches[i] for i in order[lev == x]), np.uint64).reshape(int((lev == x).sum()), -1) for x in np.unique(lev).tolist()}
    folded = {x - 1: fold(m) for x, m in rows.items() if m.shape[1] > 1}
    first = {x: int(np.searchsorted(lev, x)) for x in rows}
    most = np.searchsorted(size, size * 100 // percent, side="right")
    left, right = [item[:0]], [item[:0]]
    taken = np.zeros(len(item), np.int64)
    for i in range(len(item) - 1):
        if cover and taken[i] >= LEADERS:
            continue
        mine = rows[int(lev[i])][i - first[int(lev[i])]]
        for x, table in ((int(lev[i]), rows), (int(lev[i]) + 1, folded)):
            if x not in first:
                continue
            lo, hi = max(i + 1, first[x]), min(int(most[i]), first[x] + len(rows[x]))
            if lo >= hi:
                continue
            other = (comp[lo:hi] != comp[i]) & ((half[lo:hi] != half[i]) | (half[i] < 0)) & (taken[lo:hi] < LEADERS)
            j = lo + np.flatnonzero(other)
            if not len(j):
                continue
            far = np.bitwise_count(table[x if table is rows else x - 1][j - first[x]] ^ mine).sum(1, dtype=np.int64)
            j = j[far <= most_different(size[j], size[i], percent)]
            if cover:
                taken[j] += 1
            else:
                j = j[~(marks[j][:, :, None] == marks[i][None, None, :]).any((1, 2))]
            left.append(np.full(len(j), item[i]))
            right.append(item[j])
    return np.concatenate(left), np.concatenate(right)


def split_groups(members: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items of the groups with their components, and of each group that spans several: its size, its largest
    component and how many it has of it."""
    rows = members.select("_group", "_item").join(comps.select(F.col("node").alias("_item"), "component"), "_item", "left").withColumn("component", F.coalesce("component", "_item"))
    per = rows.groupBy("_group", "component").agg(F.count("*").alias("_c"))
    split = per.groupBy("_group").agg(F.sum("_c").alias("_n"), F.max_by("component", F.struct("_c", "component")).alias("_top"), F.max("_c").alias("_most"), F.count("*").alias("_comps"))
    return rows, cut(split.where("_comps > 1").drop("_comps"))


def in_cells(rows: DataFrame) -> DataFrame:
    """The items of split groups, joined to what is known of these, in cells (_group, _cell) with their _half: a group of up to two blocks is one cell. In
    a larger one, blocks of the largest component (T) meet those of the others (O), and those of the others each other."""
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    tops, others = blocks(F.col("_most")), blocks(F.col("_n") - F.col("_most"))
    is_top = F.col("component") == F.col("_top")
    rows = rows.withColumn("_t", tops).withColumn("_o", others).withColumn("_b", F.pmod(F.xxhash64("_item"), F.when(is_top, tops).otherwise(others)).cast("int"))
    place = lambda x, y, half: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), half.cast("int").alias("half"))
    b, minus = F.col("_b"), F.lit(-1)
    meets_others = F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda j: F.when(is_top, place(j, F.col("_o") + b, F.lit(1))).otherwise(place(F.least(b, j), F.greatest(b, j), F.when(b < j, 0).when(b > j, 1).otherwise(minus))))
    meets_tops = F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda j: place(b, F.col("_o") + j, F.lit(0)))
    cells = F.when(F.col("_n") <= 2 * BLOCK, F.array(place(F.lit(0), F.lit(0), minus))).when(is_top, meets_others).otherwise(F.concat(meets_others, meets_tops))
    return rows.select("_group", "_item", "component", F.explode(cells).alias("_c")).select("_group", "_item", "component", F.struct("_c.x", "_c.y").alias("_cell"), F.col("_c.half").alias("_half"))


def across(rows: DataFrame, split: DataFrame, items: DataFrame, percent: int, cover: bool, tried: DataFrame) -> DataFrame:
    """Pairs (a < b) of groups' items in different components that may link and were not tried: all, or a cover."""
    rows = rows.join(split, "_group")
    full = cut(in_cells(rows))
    buckets = max(1, -(-full.count() // CELL_ROWS))
    known = items.select("_item", "n_shingles", "_sketch")
    if cover:
        known = known.withColumn("_marks", F.array().cast("array<long>"))
    else:
        known = known.join(rows.groupBy("_item").agg(F.slice(F.sort_array(F.collect_set("_group")), 1, MARKS).alias("_marks")), "_item")
    known = full.join(known, "_item").withColumn("_marks", F.filter("_marks", lambda m: m < F.col("_group")))  # none other rules a pair out
    wide = known.withColumn("bucket", F.pmod(F.xxhash64("_group", "_cell"), F.lit(buckets)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_group", "_x", "_y", "_item"], kind="stable")
        cell = pdf[["_group", "_x", "_y"]].to_numpy()
        item, comp, half = pdf["_item"].to_numpy(), pdf["component"].to_numpy(), pdf["_half"].to_numpy()
        size, sketches = pdf["n_shingles"].to_numpy(), pdf["_sketch"].tolist()
        marks = -1 - np.arange(len(pdf) * MARKS, dtype=np.int64).reshape(-1, MARKS)  # what is missing is like nothing else
        for row, known in zip(marks, pdf["_marks"], strict=True):
            row[: len(known)] = known
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
        left, right = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
            x, y = close_pairs(item[a:b], comp[a:b], half[a:b], size[a:b], sketches[a:b], marks[a:b], percent, cover)
            left.append(np.minimum(x, y))
            right.append(np.maximum(x, y))
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()

    wide = wide.select("_group", F.col("_cell.x").alias("_x"), F.col("_cell.y").alias("_y"), "_item", "component", "_half", "n_shingles", "_sketch", "_marks", "bucket")
    return wide.groupBy("bucket").applyInPandas(lean_group(run), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")


def join(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: _id, _doc, _hash, n_shingles, component_id, and _first: whether it is the first of its
    component in order of (id, hash of the text)."""
    known = cut(describe(docs, text, key))
    sizes, with_words = known.agg(F.sum("n_shingles"), F.count("_item")).first()
    width = tag_bytes(with_words)
    place = F.struct("_doc", "_hash")
    items = cut(known.where("_item IS NOT NULL").groupBy("_item").agg(F.min(place).alias("_at"), F.first("n_shingles").alias("n_shingles"), F.first("_sketch").alias("_sketch")).select("_item", "_at._doc", "_at._hash", "n_shingles", "_sketch", F.col("_item").bitwiseAND(F.lit((1 << 8 * width) - 1)).alias("_tag")))
    groups = groups_of(docs, text, key, shards_for(sizes or 0), percent, width)
    tags = items.select("_tag", "_item")
    members = cut(groups.select("_group", "_head", "_weight", F.explode("_tags").alias("_tag")).join(tags, "_tag"))
    stars = members.where("_head <> _tag").groupBy("_head", "_item").agg(F.sum("_weight").alias("_w"))
    best = stars.groupBy("_item").agg(F.max_by("_head", F.struct("_w", -F.col("_head"))).alias("_tag")).withColumnRenamed("_item", "b").join(tags.withColumnRenamed("_item", "a"), "_tag")
    checked = lambda pairs: verified(pairs, items, docs, text, key, percent)
    first = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(twins(items))
    tried = cut(plausible(first, items, percent))
    links = checked(tried)
    comps = cut(components(links, "a", "b"))
    part = F.pmod(F.shiftright("_group", 3), F.lit(PARTS))
    total = members.groupBy("_group").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.pow("n", F.lit(2.0)))).first()
    covers, few = (COVERS if (total[1] or 0) / 2 > PER_ITEM * (total[0] or 0) else 0), items.count() / 100
    for i in range(covers + 1):
        cover = i < covers
        rows, split = split_groups(members.where(part == i) if cover else members, comps)
        pairs = cut(across(rows, split, items, percent, cover, tried))
        tried = tried.unionByName(pairs)
        new = checked(pairs)
        found = new.count()
        if found:
            links = links.unionByName(new)
            comps = cut(components(links, "a", "b"))
        if cover and found < few:  # families are connected: try all pairs left
            rows, split = split_groups(members, comps)
            links = links.unionByName(checked(cut(across(rows, split, items, percent, False, tried))))
            comps = cut(components(links, "a", "b"))
            break
    named = known.join(comps.select(F.col("node").alias("_item"), "component"), "_item", "left").withColumn("component", F.coalesce("component", "_item"))
    heads = named.where("component IS NOT NULL").groupBy("component").agg(F.min("_id").alias("_least"), F.min(place).alias("_head"))
    out = named.select("_id", "_doc", "_hash", "n_shingles", "component").join(heads, "component", "left")
    lone = F.col("component").isNull()
    return out.select("_id", "_doc", "_hash", "n_shingles", F.when(lone, F.col("_id")).otherwise(F.col("_least")).alias("component_id"), (lone | (place == F.col("_head"))).alias("_first"))


def dedup(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first document of each component, and every document without words; repeated rows of it go as well."""
    kept = join(docs, percent, text, key).where("_first").select("_doc", "_hash").distinct()
    rows = docs.withColumn("_doc", F.coalesce(F.col(key).cast("long"), F.lit(LEAST))).withColumn("_hash", F.xxhash64(text))
    return rows.join(kept, ["_doc", "_hash"], "left_semi").dropDuplicates(["_doc", "_hash"]).drop("_doc", "_hash")
