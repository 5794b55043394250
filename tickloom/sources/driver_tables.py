"""The tape that stands in for recorded data: `events` rows turned into venue events, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import table

HOUR = 3_600_000


def tape_from_events(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """venue, timestamp, side, price, quantity, arrival (and k). `coarse` floors time to hours, which makes ties."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("int")
    ms = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000).cast("long")
    if coarse:
        ms = (F.floor(ms / HOUR) * HOUR).cast("long")
    venue = F.element_at(F.array(*map(F.lit, ("cc", "bj", "um", "bs"))), (F.col("user_id") % 4 + 1).cast("int"))
    kind = F.col("event_type")
    side = F.when(kind == "purchase", 2).when((kind == "signup") & (F.col("k") % 10 == 0), 3).when((kind == "error") & (F.col("k") % 10 == 0), 4).when(kind.isin("view", "signup"), 0).otherwise(1).cast("byte")
    half = F.lit(0.5).cast("double")
    price = F.when(F.col("side").isin(0, 3), 100.0 - half * (F.col("k") % 10)).when(F.col("side") == 2, 100.0 + half * (F.col("k") % 2)).otherwise(100.5 + half * (F.col("k") % 10)).cast("double")
    qty = F.when(F.col("side").isin(0, 1) & (F.col("k") % 7 == 0), 0.0).when((F.col("side") == 2) & (F.col("k") % 2 == 1), -F.col("value")).otherwise(F.col("value")).cast("double")
    rows = e.select(F.col("event_id").alias("arrival"), ms.alias("timestamp"), venue.alias("venue"), k.alias("k"), "event_type", "value")
    rows = rows.withColumn("side", side)
    return rows.select("venue", "timestamp", "side", price.alias("price"), qty.alias("quantity"), "arrival", "k")


def tape_sql(coarse: bool = False) -> str:
    """The same in DuckDB, as common table expressions that end in `tape` (with seq by venue)."""
    ms = "epoch_us(ts) // 1000"
    ms = f"({ms} // {HOUR}) * {HOUR}" if coarse else ms
    return f"""raw AS (
  SELECT event_id AS arrival, CAST({ms} AS BIGINT) AS timestamp, (['cc','bj','um','bs'])[CAST(user_id % 4 + 1 AS INTEGER)] AS venue,
    CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS INTEGER) AS k, event_type, value FROM events
), sided AS (
  SELECT *, CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'signup' AND k % 10 = 0 THEN 3 WHEN event_type = 'error' AND k % 10 = 0 THEN 4
    WHEN event_type IN ('view', 'signup') THEN 0 ELSE 1 END AS side FROM raw
), tape AS (
  SELECT venue, timestamp, CAST(side AS TINYINT) AS side, arrival, k,
    CAST(CASE WHEN side IN (0, 3) THEN 100.0 - 0.5 * (k % 10) WHEN side = 2 THEN 100.0 + 0.5 * (k % 2) ELSE 100.5 + 0.5 * (k % 10) END AS DOUBLE) AS price,
    CAST(CASE WHEN side IN (0, 1) AND k % 7 = 0 THEN 0.0 WHEN side = 2 AND k % 2 = 1 THEN -value ELSE value END AS DOUBLE) AS quantity,
    row_number() OVER (PARTITION BY venue ORDER BY timestamp, side DESC, arrival) AS seq FROM sided
)"""
