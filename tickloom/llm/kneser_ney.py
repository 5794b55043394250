"""Quality classifier: the perplexity of an interpolated modified Kneser-Ney model, against quantiles by language.

The model is over characters, order N = 4, trained on trusted text. Characters are numbered by how often the corpus has
them; beyond 65,534 different ones, the rarest share a number. Trusted documents are dealt into two folds by a hash of
their ids, and all documents likewise: a document is scored by the model trained on the other fold's trusted text, so
no document is judged by a model that has seen it, and the limits, quantiles of the trusted documents' own scores, hold
for unseen text as well.

Counting is one pass over all documents: a task counts the distinct N-grams of its texts in arrays, so what is shuffled
are counts summed per task, for trusted text by fold and for the corpus's other N-grams alike. Lower orders are
continuation counts, got from the distinct N-grams by group-bys; discounts come from counts of counts. The
probabilities of all N-grams that occur anywhere in the corpus then follow from count joins, sharded by N-gram, context
and suffix, order by order, for both models at once.

Scoring looks up the log-probabilities of a document's N-grams. While the table has at most `BROADCAST_GRAMS` rows (16
bytes each), it is broadcast, as packed arrays, and scoring is one map. Beyond that, documents are dealt out by hash
into blocks of bounded text, each block's distinct N-grams are joined to the table, and come back to the block's
documents: the same numbers, with one shuffle of the text, and nothing that must fit a machine.

An N-gram model finds nothing wrong with one word or line repeated, so a document's repetition is measured too: the
share of its runs of RUN characters that it holds already. Nothing is trained for it.

A document is kept if its perplexity is at most its threshold: the `quantile` of the perplexity of the trusted documents
of its language, or 0 where its repetition is above the same quantile of theirs. Quantiles come from exact counts in
narrow bins and are the upper edge of a bin, so they don't depend on how rows were merged. Of few documents a high
quantile is hardly more than the largest value seen, so limits are raised by SLACK over the root of their number.

Defined results: null and empty texts have no perplexity and are rejected; a language without trusted documents, a
null one included, uses the quantiles over all trusted documents; without any trusted document everything with text
is kept; a perplexity or repetition exactly at its limit is kept; texts of at most RUN characters repeat nothing. Rows
with equal id and text fare alike. Very long texts are counted and scored in parts. Extra columns are carried along by
`keep`.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.collide import GOLD, mix64
from tickloom.llm.memory import lean
from tickloom.llm.sides import attach
from tickloom.session import cut

ORDER, BITS, FOLDS = 4, 16, 2
#: Numbers of the start of a text and of characters beyond the alphabet; characters follow.
START, RARE, FIRST = 0, 1, 2
BROADCAST_GRAMS = 2_000_000
#: Characters that are turned into arrays at once, and characters of a block in the sharded scoring.
CHARS, BLOCK_CHARS = 250_000, 12_000_000
#: N-grams whose counts a task holds for each kind of text before it sums them.
HELD = 500_000
LEAST = -(2**63)
#: Bins of a unit of log-perplexity, or of repetition, in the quantiles.
BINS = 10_000
#: What limits are raised by, times the root of the number of trusted documents: log-perplexity, and repetition.
SLACK = 0.5
#: Characters of a run in the measure of repetition, a power of 2.
RUN = 16


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """The number of every code point, as an array, and how many numbers a character may have."""

    def run(batches):
        total = np.zeros(0x110000, np.int64)
        for pdf in batches:
            texts = [x for x in pdf["_text"] if isinstance(x, str) and x]
            for a, b in slices(texts):
                joined = texts[a] if b == a + 1 else "".join(texts[a:b])
                for i in range(0, len(joined), CHARS):
                    n = np.bincount(points_of(joined[i : i + CHARS]))
                    total[: len(n)] += n
        found = np.flatnonzero(total)
        yield pd.DataFrame({"point": found.astype(np.int32), "n": total[found]})

    counts = docs.select(F.col(text).alias("_text")).mapInPandas(lean(run), "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.col("n").desc(), "point").limit((1 << BITS) - FIRST).collect()  # bounded by Unicode
    number = np.full(0x110000, RARE, np.uint16)
    number[[r.point for r in ranked]] = np.arange(FIRST, FIRST + len(ranked), dtype=np.uint16)
    return number, len(ranked) + 1


def grams(texts: list[str], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The N-gram that ends at each character of the texts, and the length of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = "\0" * (ORDER - 1)
    sym = number[points_of(pad + pad.join(texts))].astype(np.int64)
    first = np.arange(len(texts)) * (ORDER - 1) + np.cumsum(size) - size
    sym[(first[:, None] + np.arange(ORDER - 1)).ravel()] = START
    code = sym[: len(sym) - ORDER + 1].copy()
    for i in range(1, ORDER):
        code = code << BITS | sym[i : len(sym) - ORDER + 1 + i]
    own = np.repeat(np.arange(len(texts)) * (ORDER - 1), size) + np.arange(int(size.sum()))
    return code[own], size


def run_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the RUN characters from each position on."""
    h, width = mix64(points), 1
    while width < RUN:
        h = mix64(h[:-width] * GOLD + h[width:])
        width *= 2
    return h


def repetition(texts: list[str]) -> np.ndarray:
    """The share of each text's runs of RUN characters that the text holds at an earlier place too."""
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        if len(t) > RUN:
            h = np.sort(run_hashes(points_of(t)))
            out[i] = np.count_nonzero(h[1:] == h[:-1]) / len(h)
    return out


def slices(texts: list[str]):
    """(first, end): runs of texts with about CHARS characters; a longer text is on its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > CHARS:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def pieces(texts: list[str], number: np.ndarray):
    """Arrays of N-grams and lengths for a run of texts; one long text comes in parts, each with its own length. A part
    carries the ORDER - 1 characters before it, so that its N-grams are those of the whole text."""
    if len(texts) > 1 or len(texts[0]) <= 2 * CHARS:
        yield grams(texts, number)
        return
    text = texts[0]
    for a in range(0, len(text), CHARS):
        part = text[max(0, a - ORDER + 1) : a + CHARS]
        code, _ = grams([part], number)
        code = code[min(a, ORDER - 1) :]
        yield code, np.array([len(code)])


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    named = docs.withColumn("_doc", F.coalesce(F.col(key).cast("long"), F.lit(LEAST))).withColumn("_hash", F.xxhash64(text))
    return named.withColumn("_fold", F.pmod(F.xxhash64("_doc", F.lit(3)), F.lit(FOLDS)).cast("int"))


def marked(docs: DataFrame, trusted: DataFrame, key: str) -> DataFrame:
    """docs with _trusted: whether their id is among those of `trusted`."""
    ids = trusted.select(F.col(key).cast("long").alias("_tid")).where("_tid IS NOT NULL").distinct().withColumn("_yes", F.lit(True))
    rows = docs.withColumn("_tid", F.col(key).cast("long"))
    side = cut(ids)
    found = attach(rows, side, "_tid") if side.count() <= 1_000_000 else rows.join(side, "_tid", "left")
    return found.withColumn("_trusted", F.coalesce("_yes", F.lit(False))).drop("_yes", "_tid")


def count_grams(docs: DataFrame, text: str, spread) -> DataFrame:
    """code, n0, n1: every N-gram of the corpus and its counts in the trusted text of either fold (0: it only occurs
    elsewhere)."""
    names = [f"n{i}" for i in range(FOLDS)]

    def run(batches):
        held = [[] for _ in range(FOLDS + 1)]  # (codes, counts) of the trusted text of either fold, and of the rest
        sizes = [0] * (FOLDS + 1)
        for pdf in batches:
            fold = pdf["_fold"].where(pdf["_trusted"], FOLDS).to_numpy()
            for f in range(FOLDS + 1):
                texts = [x for x in pdf["_text"][fold == f] if isinstance(x, str) and x]
                for a, b in slices(texts):
                    for code, _ in pieces(texts[a:b], spread.value[0]):
                        held[f].append(np.unique(code, return_counts=True))
                        sizes[f] += len(held[f][-1][0])
                        if sizes[f] > HELD:
                            held[f] = [summed(held[f])]
                            sizes[f] = len(held[f][0][0])
                            if sizes[f] > HELD // 2:  # hardly anything repeats: go on without
                                yield from told(f, *held[f].pop())
                                sizes[f] = 0
        for f, found in enumerate(held):
            if found:
                yield from told(f, *summed(found))

    def told(f, codes, counts):
        for i in range(0, len(codes), 100_000):
            none = np.zeros(len(codes[i : i + 100_000]), np.int64)
            yield pd.DataFrame({"code": codes[i : i + 100_000]} | {name: counts[i : i + 100_000] if j == f else none for j, name in enumerate(names)})

    schema = ", ".join(f"{c} long" for c in ("code", *names))
    return docs.select(F.col(text).alias("_text"), "_trusted", "_fold").mapInPandas(lean(run), schema).groupBy("code").agg(*(F.sum(c).alias(c) for c in names))


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    c, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return c, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(c)).astype(np.int64)


def suffix(code, order: int):
    """An N-gram of `order` symbols without its first symbol."""
    return code.bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, from the numbers of N-grams that occur once to four times."""
    n1, n2 = n.get(1, 0), n.get(2, 0)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return tuple(min(i + 0.0, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n.get(i) and n.get(i + 1) else 0.5 * i for i in (1, 2, 3))


def train(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(m, o, code, p0: the discounted share) and (m, o, context, gamma) of model m and order o. Model m is trained on
    the folds other than m. The interpolated probability is p0 + gamma(context) * that of the suffix one order below."""
    models = [counts.select(F.lit(m).alias("m"), "code", sum((F.col(f"n{i}") for i in range(FOLDS) if i != m), F.lit(0)).alias("c")) for m in range(FOLDS)]
    table = reduce(DataFrame.unionByName, models).where("c > 0")
    orders = [table.withColumn("o", F.lit(ORDER))]
    for order in range(ORDER, 1, -1):
        table = table.groupBy("m", suffix(F.col("code"), order).alias("code")).agg(F.count("*").alias("c"))
        orders.append(table.withColumn("o", F.lit(order - 1)))
    levels = cut(reduce(DataFrame.unionByName, orders))
    many: dict[tuple[int, int], dict[int, int]] = {(m, o): {} for m in range(FOLDS) for o in range(1, ORDER + 1)}
    for r in levels.where("c <= 4").groupBy("m", "o", "c").count().collect():
        many[r["m"], r["o"]][r["c"]] = r["count"]
    off = F.array(*(F.lit(float(d)) for m in range(FOLDS) for o in range(1, ORDER + 1) for d in discounts(many[m, o])))
    at = (F.col("m") * ORDER + F.col("o") - 1) * 3 + F.least(F.col("c"), F.lit(3)) - 1
    rows = levels.select("m", "o", "code", "c", F.get(off, at.cast("int")).alias("less"), F.shiftrightunsigned("code", BITS).alias("context"))
    gammas = cut(rows.groupBy("m", "o", "context").agg(F.sum("c").alias("total"), (F.sum("less") / F.sum("c")).alias("gamma")))
    shares = rows.join(gammas.drop("gamma"), ["m", "o", "context"]).select("m", "o", "code", ((F.col("c") - F.col("less")) / F.col("total")).alias("p0"))
    return cut(shares), gammas.drop("total")


def probabilities(codes: DataFrame, shares: DataFrame, gammas: DataFrame, characters: int, order: int = ORDER) -> DataFrame:
    """m, code, p: the interpolated probability of each of the distinct (m, code), backing off where counts are missing."""
    if order == 1:
        lower = codes.withColumn("below", F.lit(1.0 / characters))
    else:
        short = suffix(F.col("code"), order)
        less = probabilities(codes.select("m", short.alias("code")).distinct(), shares, gammas, characters, order - 1)
        lower = codes.withColumn("_short", short).join(less.select("m", F.col("code").alias("_short"), F.col("p").alias("below")), ["m", "_short"]).drop("_short")
    own = lambda table: table.where(F.col("o") == order).drop("o")
    both = lower.withColumn("context", F.shiftrightunsigned("code", BITS)).join(own(gammas), ["m", "context"], "left").join(own(shares), ["m", "code"], "left")
    return both.select("m", "code", (F.coalesce("p0", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p"))


def log_table(counts: DataFrame, characters: int) -> DataFrame:
    """code, l0, l1: the log-probability of every N-gram of the corpus under either model."""
    shares, gammas = train(counts)
    asked = counts.select("code", F.explode(F.array(*map(F.lit, range(FOLDS)))).alias("m"))
    logs = probabilities(asked, shares, gammas, characters).select("code", "m", F.log("p").alias("l"))
    return cut(logs.groupBy("code").agg(*(F.max(F.when(F.col("m") == m, F.col("l"))).cast("float").alias(f"l{m}") for m in range(FOLDS))))


def log_sums(texts: list[str], number: np.ndarray, codes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The sum of the log-probabilities of each text's N-grams; codes ascending."""
    out = np.zeros(len(texts))
    for a, b in slices(texts):
        for code, size in pieces(texts[a:b], number):
            some, at = np.unique(code, return_inverse=True)
            total = np.r_[0.0, np.cumsum(logs[np.searchsorted(codes, some)][at], dtype=np.float64)]
            ends = np.cumsum(size)
            if len(size) == b - a:
                out[a:b] += total[ends] - total[ends - size]
            else:
                out[a] += total[-1]
    return out


def gathered(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a small table, ascending, and its log-probabilities by model: packed in the tasks, so that the
    driver handles a few byte strings."""

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"codes": [pdf["code"].to_numpy(np.int64).tobytes()], "logs": [pdf[[f"l{m}" for m in range(FOLDS)]].to_numpy(np.float32).tobytes()]})

    rows = table.mapInPandas(pack, "codes binary, logs binary").collect()
    codes = np.frombuffer(b"".join(r.codes for r in rows), np.int64)
    order = np.argsort(codes)
    return codes[order], np.frombuffer(b"".join(r.logs for r in rows), np.float32).reshape(-1, FOLDS)[order].T.copy()


def scored(docs: DataFrame, table: DataFrame, text: str, lang: str, spread, most: int = BROADCAST_GRAMS) -> DataFrame:
    """_doc, _hash, _lang, _trusted, _fold, n_chars, perplexity, repetition of each row of marked, keyed documents."""
    own = ["_doc", "_hash", "_lang", "_trusted", "_fold"]
    rows = docs.select("_doc", "_hash", F.col(lang).alias("_lang"), "_trusted", "_fold", F.col(text).alias("_text"))
    lang_type = docs.schema[lang].dataType.simpleString()
    schema = f"_doc long, _hash long, _lang {lang_type}, _trusted boolean, _fold int, n_chars long, perplexity double, repetition double"

    def score(pdf: pd.DataFrame, codes: np.ndarray, logs: np.ndarray) -> pd.DataFrame:
        texts = [x if isinstance(x, str) else "" for x in pdf["_text"]]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        out, mean, fold = pdf[own].copy(), np.zeros(len(texts)), pdf["_fold"].to_numpy()
        out["n_chars"] = n
        for m in range(FOLDS):
            at = np.flatnonzero(fold == m)
            mean[at] = log_sums([texts[i] for i in at], spread.value[0], codes, logs[m]) / np.maximum(n[at], 1)
        out["perplexity"] = pd.array([float(np.exp(-m)) if k else None for m, k in zip(mean, n, strict=True)], dtype="Float64")
        out["repetition"] = repetition(texts)
        return out

    if table.count() <= most:
        small = docs.sparkSession.sparkContext.broadcast(gathered(table))

        def run(batches):
            for pdf in batches:
                yield score(pdf, *small.value)

        return rows.mapInPandas(lean(run), schema)

    blocks = max(1, -(-(docs.agg(F.sum(F.length(text))).first()[0] or 0) // BLOCK_CHARS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_doc", "_hash", F.lit(9)), F.lit(blocks)).cast("int"))

    def vocabulary(batches):
        now, kept = None, []
        for pdf in batches:
            for block, part in pdf.groupby("_block"):
                if block != now:
                    yield from told(now, kept)
                    now, kept = block, []
                texts = [x for x in part["_text"] if isinstance(x, str) and x]
                kept += [np.unique(c) for a, b in slices(texts) for c, _ in pieces(texts[a:b], spread.value[0])]
        yield from told(now, kept)

    def told(block, kept):
        if kept:
            yield pd.DataFrame({"_block": block, "code": np.unique(np.concatenate(kept))})

    sorted_rows = rows.select("_block", "_text").repartition("_block").sortWithinPartitions("_block")
    asked = sorted_rows.mapInPandas(lean(vocabulary), "_block int, code long")
    answered = cut(asked.join(table, "code"))

    def run_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("code")
        return score(left, right["code"].to_numpy(np.int64), [right[f"l{m}"].to_numpy(np.float32) for m in range(FOLDS)])

    return rows.groupBy("_block").cogroup(answered.groupBy("_block")).applyInPandas(run_block, schema)


def quantiles(rows: DataFrame, value: str, by: list[str], quantile: float, name: str) -> DataFrame:
    """by, name: the upper edge of the bin (1 / BINS wide) that the quantile of a value falls into, and the slack."""
    bins = rows.groupBy(*by, F.ceil(F.col(value) * BINS).alias("_bin")).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by)
    upto = bins.withColumn("_upto", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    return upto.where(F.col("_upto") >= quantile * F.col("_all")).groupBy(*by).agg((F.min("_bin") / BINS + SLACK / F.sqrt(F.max("_all"))).alias(name))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, text: str = "text", key: str = "doc_id", lang: str = "lang", most: int = BROADCAST_GRAMS) -> DataFrame:
    """Per row: _doc, _hash (of its text), _lang, _trusted, _fold, n_chars, perplexity, repetition, threshold, kept.

    `trusted`: a table with the ids of the documents whose text is trusted.
    """
    rows = marked(keyed(docs, text, key), trusted, key)
    number = alphabet(docs, text)
    spread = docs.sparkSession.sparkContext.broadcast(number)
    counts = cut(count_grams(rows, text, spread))
    scores = cut(scored(rows, log_table(counts, number[1]), text, lang, spread, most))
    good = scores.where("_trusted AND perplexity IS NOT NULL").withColumn("_log", F.log("perplexity"))
    of = good.where("_lang IS NOT NULL")
    limits = quantiles(of, "_log", ["_lang"], quantile, "_limit").join(quantiles(of, "repetition", ["_lang"], quantile, "_most"), "_lang")
    limits = cut(limits.withColumn("_limit", F.exp("_limit")))
    whole = good.withColumn("_one", F.lit(1))
    overall = quantiles(whole, "_log", ["_one"], quantile, "_all").join(quantiles(whole, "repetition", ["_one"], quantile, "_all_most"), "_one")
    overall = overall.agg(F.exp(F.max("_all")).alias("_all"), F.max("_all_most").alias("_all_most"))
    out = attach(scores, limits, "_lang").crossJoin(F.broadcast(overall))
    repeats = F.col("repetition") > F.coalesce("_most", "_all_most", F.lit(float("inf")))
    limit = F.when(repeats, 0.0).otherwise(F.coalesce("_limit", "_all", F.lit(float("inf"))))
    return out.withColumn("threshold", limit).withColumn("kept", F.coalesce(F.col("perplexity") <= limit, F.lit(False))).drop("_limit", "_all", "_most", "_all_most")


def keep(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The documents that the classifier keeps, as they came."""
    kept = classify(docs, trusted, quantile, text, key, lang).where("kept").select("_doc", "_hash").distinct()
    return keyed(docs, text, key).join(kept, ["_doc", "_hash"], "left_semi").drop("_doc", "_hash", "_fold")
