"""Quality rules: word and line counts, then zstandard ratios held against limits by length.

A text is compressed whole and, if it is longer than CHUNK bytes, in chunks of that size, the last one as long as it
comes. Too small a ratio means repetition, too large a ratio means noise. Short pieces compress badly whatever they say,
so limits depend on the length of a piece, whole or chunk: the median logarithm of the ratio is a line through half
octaves of length, and each octave of length has the quantiles of the distance from that line, a little widened. Both
are learnt from the pieces of all trusted texts. A text is rejected if its whole ratio is outside the limits, or chunks
with more than CHUNK_SHARE of its bytes are.

Texts are read once: `measure` is a map that leaves a few numbers of each, and learning and the verdict work on these.
Learning joins them to the trusted ids and counts pieces by their two lengths. Quantiles are exact: counts by bin tell
which bin holds one, and only that bin's values are put in order.

Defined results: a null text has no words and fails the base rules, as does an empty one; ratios of such texts are
null. A text exactly at a limit is kept. Without trusted text that passes the base rules, limits are the fixed PRIOR.
A length with too few trusted pieces uses the nearest that has enough. Repeated rows get equal results. Very long
texts are compressed as a whole in one piece of memory of their size. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import cut

#: Bytes of a chunk, and the share of a text in chunks beyond the limits that rejects it.
CHUNK, CHUNK_SHARE = 2048, 0.25
#: The quantile at either end, and what limits are widened by: a fixed part, and one that shrinks with the root of the
#: number of pieces.
QUANTILE, SLACK, SLACK_N = 0.002, 0.01, 0.1
#: Pieces that a half octave (for its median) and an octave (for its limits) must have.
LEAST_MEDIAN, LEAST_LIMIT = 8, 100
#: Bins of a unit that values are counted by, to find quantiles.
BINS = 1024
LEVEL = 3
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean"
MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, _bytes long, _whole long, _parts array<long>"


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode().split()  # bytes split at exactly the six ASCII space characters
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < len(windows) else ()
    if twice:
        covered = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if w in twice:
                repeats += i + 3 - max(covered, i)
                covered = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def chunks(raw: bytes, chunk: int = CHUNK) -> Iterator[bytes]:
    """The chunks of a text that has more than one."""
    return (raw[i : i + chunk] for i in range(0, len(raw), chunk)) if len(raw) > chunk else iter(())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def octaves_of(size: np.ndarray, parts: int = 1) -> np.ndarray:
    """The octave, or part of one, of each length."""
    return np.floor(parts * np.log2(size)).astype(np.int64)


@dataclass(frozen=True)
class Limits:
    """log2 of lengths with the median log ratio there, and (log2 of length, lowest, highest distance) by octave."""

    line: tuple[tuple[float, float], ...]
    octaves: tuple[tuple[int, float, float], ...]

    def distance(self, size: np.ndarray, log_ratio: np.ndarray) -> np.ndarray:
        return log_ratio - np.interp(np.log2(size), *zip(*self.line, strict=True))

    def outside(self, size: np.ndarray, log_ratio: np.ndarray) -> np.ndarray:
        octave, low, high = map(np.array, zip(*self.octaves, strict=True))
        nearest = np.abs(octave[None, :] - octaves_of(size)[:, None]).argmin(1)  # the lower one of two
        far = self.distance(size, log_ratio)
        return (far < low[nearest]) | (far > high[nearest])


#: Limits without trusted text: 1 / 1.4 to 1.4 times what prose in Latin script compresses to.
PRIOR = Limits(((4.0, math.log(1.6)), (6.0, math.log(1.05)), (8.0, math.log(0.66)), (11.0, math.log(0.49)), (16.0, math.log(0.38))), ((10, -math.log(1.4), math.log(1.4)),))


def limits_from(medians: list[tuple[int, float, float]], quantiles: list[tuple[int, int, float, float]]) -> Limits:
    """From (pieces, log2 of length, median) by half octave and (octave, pieces, lowest, highest distance)."""
    enough = [q for q in quantiles if q[1] >= LEAST_LIMIT] or quantiles
    slack = lambda n: SLACK + SLACK_N / math.sqrt(n)
    return Limits(tuple(sorted(m[1:] for m in line_of(medians))), tuple(sorted((o, low - slack(n), high + slack(n)) for o, n, low, high in enough)))


def line_of(medians: list[tuple[int, float, float]]) -> list[tuple[int, float, float]]:
    return [m for m in medians if m[0] >= LEAST_MEDIAN] or medians


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """`key`, the counts, base_failed, and the bytes of each text, of it compressed and of its chunks compressed."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for pdf in batches:
            rows = []
            for x in pdf["_text"]:
                x = x if isinstance(x, str) else ""
                n, chars, symbols, dups, repeats = counts(x)
                raw = x.encode()
                rows.append((n, chars, symbols, dups, repeats, base_failed(n, repeats), len(raw), len(packer.compress(raw)), [len(packer.compress(c)) for c in chunks(raw, chunk)]))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return docs.select(key, docs[text].alias("_text")).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {MEASURED}")


def quantiles(rows: DataFrame, by: str, value: str, weight: str, shares: tuple[float, ...]) -> dict[int, tuple]:
    """Of each group: the sum of weights, and the quantiles of the values, each as often as its weight says, on a line
    between neighbours. Bins are counted first; no task puts more than a bin's values in order."""
    rows = rows.select(by, value, weight, F.floor(F.col(value) * BINS).alias("_bin"))
    bins: dict[int, list] = {}
    for g, b, n in rows.groupBy(by, "_bin").agg(F.sum(weight)).collect():
        bins.setdefault(g, []).append((b, n))
    ranks, wanted = {}, set()
    for g, found in bins.items():
        found.sort()
        ends = np.cumsum([n for _, n in found])
        ranks[g] = [(int(ends[-1]) - 1) * share for share in shares]
        for at in {f(r) for r in ranks[g] for f in (math.floor, math.ceil)}:
            i = int(np.searchsorted(ends, at, side="right"))
            wanted.add((g, found[i][0], at, at - int(ends[i]) + found[i][1]))
    if not wanted:
        return {}
    wanted = F.broadcast(rows.sparkSession.createDataFrame(sorted(wanted), f"{by} long, _bin long, _at long, _within long"))
    some = rows.join(wanted, [by, "_bin"], "left_semi").groupBy(by, "_bin", value).agg(F.sum(weight).alias("_n"))
    some = some.withColumn("_end", F.sum("_n").over(Window.partitionBy(by, "_bin").orderBy(value))).join(wanted, [by, "_bin"])
    held = {(g, at): v for g, at, v in some.where("_within < _end AND _within >= _end - _n").select(by, "_at", value).collect()}
    between = lambda g, r: held[g, math.floor(r)] + (r - math.floor(r)) * (held[g, math.ceil(r)] - held[g, math.floor(r)])
    return {g: (sum(n for _, n in bins[g]), *(between(g, r) for r in rs)) for g, rs in ranks.items()}


def learn_measured(measured: DataFrame, trusted: DataFrame, key: str = "doc_id", chunk: int = CHUNK) -> Limits:
    """The limits from all rows of `measure` whose id is in `trusted` and that pass the base rules."""
    ids = trusted.select(F.col(key).cast("long").alias("_tid")).where("_tid IS NOT NULL").distinct()
    some = measured.where("NOT base_failed").join(ids, measured[key].cast("long") == ids["_tid"], "left_semi")
    piece = lambda size, packed: F.struct(size.cast("long").alias("size"), packed.cast("long").alias("packed"))
    parts = F.transform("_parts", lambda c, i: piece(F.least(F.lit(chunk), F.col("_bytes") - i * chunk), c))
    pieces = some.select(F.explode(F.concat(F.array(piece(F.col("_bytes"), F.col("_whole"))), parts)).alias("_p"))
    pairs = pieces.groupBy("_p.size", "_p.packed").agg(F.count("*").alias("n"))

    def lengths(batches):
        for pdf in batches:
            size, packed = pdf["size"].to_numpy(), pdf["packed"].to_numpy()
            yield pd.DataFrame({"half": octaves_of(size, 2), "octave": octaves_of(size), "size": np.log2(size), "log": np.log(packed / size), "n": pdf["n"]})

    pairs = cut(pairs.mapInPandas(lengths, "half long, octave long, size double, log double, n long"))
    sizes, logs = (quantiles(pairs, "half", c, "n", (0.5,)) for c in ("size", "log"))
    medians = sorted((n, size, logs[half][1]) for half, (n, size) in sizes.items())
    if not medians:
        return PRIOR
    line = sorted(m[1:] for m in line_of(medians))

    def normalise(batches):
        for pdf in batches:
            yield pd.DataFrame({"octave": pdf["octave"], "z": pdf["log"] - np.interp(pdf["size"], *zip(*line, strict=True)), "n": pdf["n"]})

    far = cut(pairs.mapInPandas(normalise, "octave long, z double, n long"))
    return limits_from(medians, [(o, *q) for o, q in quantiles(far, "octave", "z", "n", (QUANTILE, 1 - QUANTILE)).items()])


def judge(measured: DataFrame, limits: Limits = PRIOR, key: str = "doc_id", chunk: int = CHUNK, share: float = CHUNK_SHARE) -> DataFrame:
    """The verdict on each row of `measure`: `key`, the counts, the ratios, base_failed and kept."""

    def run(batches):
        for pdf in batches:
            size, parts = pdf["_bytes"].to_numpy(np.int64), pdf.pop("_parts").tolist()
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            owner, has = np.repeat(np.arange(len(parts)), n), np.flatnonzero(size)
            part = np.minimum(chunk, size[owner] - chunk * (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]))
            wide = np.concatenate([np.zeros(0), *parts])
            bad = np.bincount(owner, part * limits.outside(part, np.log(wide / part)), len(parts)) / np.maximum(size, 1)
            ratio, fits = pdf["_whole"].to_numpy(np.float64) / np.maximum(size, 1), np.zeros(len(parts), bool)
            fits[has] = ~limits.outside(size[has], np.log(ratio[has])) & (bad[has] <= share)
            pdf["ratio"] = pd.array(np.where(size > 0, ratio, 0.0), dtype="Float64")
            pdf.loc[size == 0, "ratio"] = pd.NA
            pdf["bad_chunks"], pdf["kept"] = bad, fits & ~pdf["base_failed"].to_numpy(bool)
            yield pdf[[key, *(c.split()[0] for c in COLUMNS.split(", "))]]

    return measured.mapInPandas(run, f"{key} {measured.schema[key].dataType.simpleString()}, {COLUMNS}")


def learn(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> Limits:
    """The limits from all texts of `docs` whose id is in `trusted` and that pass the base rules."""
    return learn_measured(measure(docs, text, key, chunk), trusted, key, chunk)


def apply_rules(docs: DataFrame, limits: Limits = PRIOR, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, share: float = CHUNK_SHARE) -> DataFrame:
    """One row per document: `key`, the counts, the ratios, base_failed and kept."""
    return judge(measure(docs, text, key, chunk), limits, key, chunk, share)


def learn_and_apply(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, share: float = CHUNK_SHARE) -> DataFrame:
    """`apply_rules` with the limits of `learn`, measuring each text once."""
    measured = cut(measure(docs, text, key, chunk))
    return judge(measured, learn_measured(measured, trusted, key, chunk), key, chunk, share)
