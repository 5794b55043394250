"""The landing zone as data: listings, checksums, unreadable files, preview and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.scalars import human_size
from tickloom.sources.tape import NAME, TAPE


def listing(spark: SparkSession, *paths: str, pattern: str = "*.parquet") -> DataFrame:
    """path, file, size, modified, symbol, day and whether it is a compacted day; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(list(paths)).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file"), F.col("length").alias("size"), human_size(F.col("length")).alias("human"), F.col("modificationTime").alias("modified"), F.upper(F.regexp_extract(name, NAME, 1)).alias("symbol"), F.regexp_extract(name, NAME, 2).alias("day"), (F.upper(F.regexp_extract(name, NAME, 3)) == "_DAILY").alias("daily"))


def between(files: DataFrame, first: str, last: str, symbol: str | None = None) -> DataFrame:
    out = files.where(F.col("day").between(first, last))
    return out if symbol is None else out.where(F.col("symbol") == symbol.upper())


def verify(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """file, ok: contents against digests (file, digest), MD5 or SHA-256 by the digest's length."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    own = F.when(F.length("digest") == 32, F.md5("content")).when(F.length("digest") == 64, F.sha2("content", 256))
    return digests.join(files, "file", "left").select("file", F.coalesce(own == F.lower("digest"), F.lit(False)).alias("ok"))


def unreadable(spark: SparkSession, *paths: str) -> DataFrame:
    """path of tape files that give no row (cut short, overwritten or empty), for quarantine. Only footers are read:
    no column is asked for, and what can't be opened is passed over."""
    rows = spark.read.schema(TAPE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").parquet(*paths)
    fine = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    return listing(spark, *paths).select("path").join(fine, "path", "left_anti")


def first_rows(tape: DataFrame, by: list[str]) -> DataFrame:
    """Times of the first and the last row in the order of the file, which need not be the least and the greatest."""
    at = F.struct("_file", "_row")
    return tape.groupBy(*by).agg(F.min_by("timestamp", at).alias("first_ts"), F.max_by("timestamp", at).alias("last_ts"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))


def sync_cycles(log: DataFrame, now: Column) -> DataFrame:
    """One row about a log of (line): cycles of `syncing` and `done (rc=N)`, the last one's code and age, and health."""
    at = F.unix_timestamp(F.try_to_timestamp(F.substring("line", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    rows = log.select(at.alias("at"), F.contains("line", F.lit("syncing")).alias("starts"), F.regexp_extract("line", r"done \(rc=(\d+)\)", 1).try_cast("int").alias("rc")).where("at IS NOT NULL AND (starts OR rc IS NOT NULL)")
    w = W.partitionBy(F.lit(0)).orderBy("at", "starts")
    ends = rows.withColumn("_began", F.when(F.lag("starts").over(w), F.lag("at").over(w)))
    last_line = F.max_by("starts", F.struct("at", "starts"))
    done = F.col("rc").isNotNull() & F.col("_began").isNotNull()
    per = ends.agg(F.count_if(done).alias("n_cycles"), F.max_by("rc", F.when(done, F.col("at"))).alias("last_rc"), (now - F.max(F.when(done, F.col("at")))).alias("last_done_age"), F.max_by(F.col("at") - F.col("_began"), F.when(done, F.col("at"))).alias("last_dur_sec"), F.coalesce(last_line, F.lit(False)).alias("in_progress"), F.coalesce(F.max(done & (F.col("rc") == 0)), F.lit(False)).alias("any_ok"))
    rc, late = F.col("last_rc"), F.col("last_done_age") > 3600
    health = F.when(rc.isNull(), F.when(F.col("in_progress"), "ok").otherwise("unknown")).when(rc.isin(137, 143), F.when(F.col("in_progress") | F.col("any_ok"), "ok").otherwise("stale")).when(rc != 0, "bad").when(late & ~F.col("in_progress"), "stale").otherwise("ok")
    return per.withColumn("health", health).drop("any_ok")
