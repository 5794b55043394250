"""Line dedup: repeated runs of lines across documents, by a suffix array over line ids; later copies go.

A document is a sequence of lines. Suffixes (document, line number) are ranked by prefix doubling: rank 0 orders
lines, and rank k+1 orders the pairs (rank k here, rank k 2^k lines on), so it orders suffixes by their first 2^(k+1)
lines. Ranks come from a distributed sort of the distinct pairs; suffixes whose rank is unique drop out, so a round
handles only what is still repeated. Doubling stops at the depth that any verdict needs.

A run counts when it has `min_words` words. For each start, the least number of lines L that reaches them (and for
each end likewise) is a window; two windows are equal if their two overlapping blocks of 2^k lines have equal ranks.
Suffixes with an equal first L lines form the LCP interval at depth L; all its members but the first in order of
(doc_id, line) start a later copy, and the union of these windows is exactly the union of all maximal repeated runs
that count, minus first copies. Everything is DataFrame operations, and every group is pre-aggregated before its
shuffle: what comes back to a group's members is one row, over a join that adaptive execution can split.

Defined results: lines are split at newlines; a line without a word belongs to the line before it and shares its
fate. Null and empty texts stay as they are. Rows with the same id and the same text are one document and fare
alike; other rows with the same id are ordered by the hash of their text. A null id comes first. An empty table
gives no rows. Extra columns are carried along; clashes are not possible, as working columns start with `_`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.session import cut

#: A newline before a line that has a word.
BREAK = r"\n(?=[^\S\n]*+\S)"
LEAST = -(2**63)
DOC = ["_doc", "_hash"]


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.withColumn("_doc", F.coalesce(F.col(key).cast("long"), F.lit(LEAST))).withColumn("_hash", F.xxhash64(text))


def ranked(table: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct keys that occur at least twice, with a number `name` in the order of the keys.

    The ids of a sorted, range-partitioned table ascend with it; the table is written, so that they can't change.
    """
    groups = table.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    return cut(groups.orderBy(*keys).withColumn(name, F.monotonically_increasing_id()))


def repeated_lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rank 0: _doc, _hash, _i, _rank and _words of the lines that occur at least twice."""
    lines = keyed(docs, text, key).where(F.col(text).isNotNull()).select(*DOC, F.posexplode(F.split(text, BREAK)).alias("_i", "_line"))
    lines = lines.withColumn("_line", F.substring_index("_line", "\n", 1))
    lines = lines.select(*DOC, "_i", F.xxhash64("_line").alias("_a"), F.hash("_line").alias("_b"), F.regexp_count("_line", F.lit(r"\S+")).alias("_words"))
    return cut(lines.join(ranked(lines, ["_a", "_b"], "_rank"), ["_a", "_b"]).select(*DOC, "_i", "_rank", "_words"))


def windows(first: DataFrame, min_words: int) -> DataFrame:
    """_doc, _hash, _i, _len: the shortest runs of repeated lines, from each start and to each end, with min_words words."""
    by_line = W.partitionBy(*DOC).orderBy("_i")
    run = first.withColumn("_run", F.col("_i") - F.row_number().over(by_line))  # neighbours share _run
    inside = [*DOC, "_run"]
    upto = F.sum("_words").over(W.partitionBy(*inside).orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    run = run.withColumn("_end", upto.cast("long")).withColumn("_start", F.col("_end") - F.col("_words"))
    run = run.withColumn("_to", F.max("_i").over(W.partitionBy(*inside).orderBy("_start").rangeBetween(0, min_words - 1)))
    run = run.withColumn("_to_end", F.max("_end").over(W.partitionBy(*inside).orderBy("_start").rangeBetween(0, min_words - 1)))
    run = run.withColumn("_from", F.min("_i").over(W.partitionBy(*inside).orderBy("_end").rangeBetween(-(min_words - 1), 0)))
    run = run.withColumn("_from_start", F.min("_start").over(W.partitionBy(*inside).orderBy("_end").rangeBetween(-(min_words - 1), 0)))
    ahead = F.when(F.col("_to_end") - F.col("_start") >= min_words, F.struct(F.col("_i").alias("_i"), (F.col("_to") - F.col("_i") + 1).alias("_len")))
    back = F.when(F.col("_end") - F.col("_from_start") >= min_words, F.struct(F.col("_from").alias("_i"), (F.col("_i") - F.col("_from") + 1).alias("_len")))
    both = F.array_distinct(F.array_compact(F.array(ahead, back)))
    return run.select(*DOC, F.explode(both).alias("_w")).select(*DOC, "_w._i", "_w._len").distinct()


def double(ranks: DataFrame, step: int) -> DataFrame:
    """From ranks by `step` lines to ranks by 2 * step lines."""
    on = ranks.select(*DOC, (F.col("_i") - step).alias("_i"), F.col("_rank").alias("_next"))
    pairs = cut(ranks.select(*DOC, "_i", "_rank").join(on, [*DOC, "_i"]))
    names = ranked(pairs, ["_rank", "_next"], "_new")
    return cut(pairs.join(names, ["_rank", "_next"]).select(*DOC, "_i", F.col("_new").alias("_rank")))


def later_copies(docs: DataFrame, min_words: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """_doc, _hash and _gone (the line numbers to delete) of the documents that lose lines."""
    ranks = repeated_lines(docs, text, key)
    wanted = cut(windows(ranks, min_words))
    deepest = wanted.agg(F.max("_len")).first()[0] or 0
    found, k = [], 0
    while 1 << k <= deepest:
        here = wanted.where((F.col("_len") >= 1 << k) & (F.col("_len") < 2 << k))
        left = ranks.select(*DOC, "_i", F.col("_rank").alias("_left"))
        right = ranks.select(*DOC, F.col("_i").alias("_at"), F.col("_rank").alias("_right"))
        found.append(here.join(left, [*DOC, "_i"]).withColumn("_at", F.col("_i") + F.col("_len") - (1 << k)).join(right, [*DOC, "_at"]).select(*DOC, "_i", "_len", "_left", "_right"))
        k += 1
        if 1 << k <= deepest:
            ranks = double(ranks, 1 << (k - 1))
    if not found:
        return wanted.select(*DOC, F.array(F.lit(0)).alias("_gone")).limit(0)
    members = cut(reduce(DataFrame.unionByName, found))
    interval = ["_len", "_left", "_right"]
    place = F.struct("_doc", "_hash", "_i")
    firsts = members.groupBy(*interval).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = members.join(firsts, interval).where(place != F.col("_first"))
    gone = later.select(*DOC, F.explode(F.sequence("_i", F.col("_i") + F.col("_len") - 1)).alias("_i"))
    return gone.groupBy(*DOC).agg(F.collect_set("_i").alias("_gone"))


def dedup(docs: DataFrame, min_words: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without later copies of repeated runs, with n_lines and n_removed."""
    gone = later_copies(docs, min_words, text, key)
    whole = keyed(docs, text, key).join(gone, DOC, "left")
    split = F.split(text, BREAK)
    kept = F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull())
    out = whole.withColumn("n_lines", F.coalesce(F.size(split), F.lit(0))).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)))
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_doc", "_hash", "_gone")


#: DuckDB's statement of `dedup` with min_words 20: pairs of equal lines, joined to runs along their diagonals.
ORACLE = r"""
WITH parts AS (
  SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS n FROM parts
), placed AS (
  SELECT *, sum(CASE WHEN n > 0 AND regexp_matches(line, '\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS i FROM lines
), segs AS (
  SELECT doc_id, i, arg_min(line, n) AS line, len(regexp_extract_all(arg_min(line, n), '\S+')) AS words FROM placed GROUP BY doc_id, i
), pairs AS (
  SELECT a.doc_id, a.i, a.words, b.doc_id AS other, a.i - b.i AS shift,
    a.i - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.i - b.i ORDER BY a.i) AS run
  FROM segs a JOIN segs b ON a.line = b.line AND (b.doc_id, b.i) < (a.doc_id, a.i)
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, sum(words) OVER (PARTITION BY doc_id, other, shift, run) AS total FROM pairs) WHERE total >= 20
), rebuilt AS (
  SELECT p.doc_id, count(DISTINCT p.i) AS n_lines, count(DISTINCT g.i) AS n_removed,
    coalesce(string_agg(p.line, chr(10) ORDER BY p.n) FILTER (WHERE g.i IS NULL), '') AS text
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(r.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(r.n_removed, 0) AS INTEGER) AS n_removed, r.text
FROM documents d LEFT JOIN rebuilt r ON r.doc_id = d.doc_id
"""
