"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Every source gets a mean repetition rate: its target share of the mix over its own size. A document's number of
copies is a Poisson variable with that mean, got by inverting the distribution at a uniform number hashed from the
seed and the document's id, so it needs no state and comes out alike on any cluster. Copies are then dealt out by
another hash and sorted by it, which shuffles the whole mix. A mean beyond `SPLIT` is the sum of equal smaller ones,
each drawn at a number of its own, so that a distribution is an array of less than 200 numbers whatever the rate.

The only aggregation is one row per source, with partial sums before its shuffle, so a source with a third of all
rows costs no more than another. The table of sources is broadcast while it has at most `BROADCAST_SOURCES` rows;
(at most 1.6 kB each); beyond that it is joined on the source and a salt, so that a hot source is spread over `SALTS` parts.

Defined results: a null source is a source of its own; a null id hashes as the word null; rows with the same id get
the same number of copies; a null or empty text counts as one character; a source whose weight is 0 or missing from
given weights gets no copy; an empty table gives no rows. Extra columns are carried along; copy and slot are added, in
place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut

BROADCAST_SOURCES, SALTS, SPLIT = 10_000, 64, 64


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the seed and the parts joined by colons."""
    named = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *named)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """_source and rate: the mean number of copies of a document of each source.

    `weights`: target share of each source (any scale). Without them a source's share is its size to the power
    `temperature`. Sizes are characters. `total`: characters of the mix; those of the input by default.
    """
    sizes = docs.groupBy(docs[source].alias("_source")).agg(F.sum(F.greatest(F.lit(1), F.coalesce(F.length(docs[text]), F.lit(0)))).cast("double").alias("_size"))
    if weights is None:
        sizes = sizes.withColumn("_weight", F.pow("_size", F.lit(temperature)))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else F.lit(None).cast("map<string,double>")
        sizes = sizes.withColumn("_weight", F.coalesce(given[F.col("_source")], F.lit(0.0)))
    sums = sizes.agg(F.sum("_weight").alias("_weights"), F.sum("_size").alias("_sizes"))  # one row
    want = F.lit(float(total)) if total is not None else F.col("_sizes")
    return sizes.crossJoin(F.broadcast(sums)).select("_source", F.round(F.coalesce(F.try_divide(F.col("_weight") * want, F.col("_weights") * F.col("_size")), F.lit(0.0)), 9).alias("rate"))


def distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, for X Poisson with this mean, as far as 52 bits can tell.

    The terms are kept as logarithms, so a large mean doesn't underflow.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(state, k):
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, step, lambda s: s["all"])).otherwise(F.array(F.lit(1.0)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix: every document `copies` times, in random order, with copy (from 1) and slot (its place's hash)."""
    docs = docs.drop("copy", "slot")
    table = cut(rates(docs, weights, temperature, total, source, text).withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int")))
    table = table.select("_source", "_draws", distribution(F.col("rate") / F.col("_draws")).alias("_cdf"))
    if table.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(table), docs[source].eqNullSafe(table["_source"]))
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        joined = docs.join(salted, docs[source].eqNullSafe(salted["_source"]) & (F.col("_part") == F.col("_salt"))).drop("_part", "_salt")
    drawn = lambda u: F.size(F.filter("_cdf", lambda c: c <= u))
    more = F.when(F.col("_draws") > 1, F.aggregate(F.sequence(F.lit(1), F.col("_draws") - 1), F.lit(0), lambda n, i: n + drawn(uniform(seed, key, i)))).otherwise(0)
    counted = joined.withColumn("_copies", drawn(uniform(seed, key)) + more).where("_copies > 0").drop("_cdf", "_source", "_draws")
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    return rows.withColumn("slot", uniform(seed + 1, key, "copy")).repartition("slot").sortWithinPartitions("slot", "copy")


#: DuckDB's statement of the default mix (temperature 0.5, seed 17).
ORACLE = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(greatest(1, coalesce(length(text), 0))) AS DOUBLE) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, round(sqrt(size) * (SELECT sum(size) FROM sizes) / ((SELECT sum(sqrt(size)) FROM sizes) * size), 9) AS rate FROM sizes
), drawn_rates AS (
  SELECT source, greatest(1, CAST(ceil(rate / 64) AS INTEGER)) AS draws, rate / greatest(1, CAST(ceil(rate / 64) AS INTEGER)) AS rate FROM rates
), cdf AS (
  SELECT source, rate, 0 AS k, -rate AS lg, exp(-rate) AS total FROM drawn_rates
  UNION ALL
  SELECT source, rate, k + 1, lg + ln(rate) - ln(CAST(k + 1 AS DOUBLE)), total + exp(lg + ln(rate) - ln(CAST(k + 1 AS DOUBLE)))
  FROM cdf WHERE k < ceil(rate + 10 * sqrt(rate) + 30)
), named AS (
  SELECT row_number() OVER () AS row, d.*, unnest(range(r.draws)) AS draw, '17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS name
  FROM documents d JOIN drawn_rates r ON d.source IS NOT DISTINCT FROM r.source
), drawn AS (
  SELECT * EXCLUDE (draw, name), CAST(CAST('0x' || substr(md5(name || CASE WHEN draw > 0 THEN ':' || draw ELSE '' END), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM named
), counted AS (
  SELECT d.row, d.doc_id, d.source, d.lang, d.text, d.n_chars, count(*) AS copies FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.total <= d.u GROUP BY ALL
), copied AS (
  SELECT * EXCLUDE (copies, row), CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy FROM counted
)
SELECT doc_id, text, lang, source, n_chars, copy,
  CAST(CAST('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS slot
FROM copied
"""
