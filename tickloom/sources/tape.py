"""The tape: one row per market event, and how rows get their order.

Columns: timestamp (ms), side (0 bid update, 1 ask update, 2 trade with signed quantity, 3 bid snapshot, 4 ask
snapshot), price, quantity. Venue, market, symbol and day are partition columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BID, ASK, TRADE, BID_SNAP, ASK_SNAP = 0, 1, 2, 3, 4
TAPE = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("side", T.ByteType()), T.StructField("price", T.DoubleType()), T.StructField("quantity", T.DoubleType())])
#: A file name of the landing zone: symbol, RAW, day or start, and DAILY for compacted ones.
NAME = r"(?i)([A-Z0-9_]+?)_RAW_(\d{8})(_DAILY|\d*)\.parquet$"


def read_tape(spark: SparkSession, *paths: str) -> DataFrame:
    """Tape files, whatever their folder layout, with symbol, day, and arrival order (_file, _row).

    The layout is parsed from file names, so flat and partitioned folders read alike; a narrower integer type of
    `side` in some files is cast to one type.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*paths)
    name = F.col("_metadata.file_name")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TAPE.fields]
    return raw.select(*cols, F.regexp_extract(name, NAME, 1).alias("symbol"), F.regexp_extract(name, NAME, 2).alias("day"), name.alias("_file"), F.col("_metadata.row_index").alias("_row"))


def tape_order(arrival: list[str]) -> list[Column]:
    """Time, then side descending (snapshots, trades, updates), then arrival. Sorting is never left to stability."""
    return [F.col("timestamp").asc(), F.col("side").desc(), *(F.col(a).asc() for a in arrival)]


def sequenced(tape: DataFrame, by: list[str], arrival: list[str]) -> DataFrame:
    """tape with seq: 1, 2, ... in tape order within each `by` group (venue, and day or segment at scale)."""
    return tape.withColumn("seq", F.row_number().over(W.partitionBy(*by).orderBy(*tape_order(arrival))).cast("long"))


def merged(tape: DataFrame, tie: Column, arrival: list[str]) -> list[Column]:
    """The order of several venues on one tape; `tie` decides between venues at the same time and side."""
    return [F.col("timestamp").asc(), F.col("side").desc(), tie.asc(), *(F.col(a).asc() for a in arrival)]


def epoch_ms(value: Column, largest: Column) -> Column:
    """Milliseconds from seconds, milliseconds or microseconds; the unit follows from the file's largest value."""
    return F.when(largest < 1e11, value * 1000).when(largest < 1e14, value).otherwise(F.floor(value / 1000)).cast("long")
