"""Data-quality scans over tapes and file listings. Each is one or two grouped passes; none collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import scalars as S

MINUTE, DAY = 60_000, 86_400_000


def stream() -> Column:
    """The stream of a row for gap detection; injected snapshots belong to neither."""
    return F.when(F.col("side").isin(0, 1), "depth").when(F.col("side") == 2, "trade")


def gaps(tape: DataFrame, by: list[str], threshold_sec: float) -> DataFrame:
    """by, stream, start_ms, end_ms, gap_sec: silences strictly longer than the threshold inside a stream."""
    rows = tape.withColumn("stream", stream()).where("stream IS NOT NULL")
    before = F.lag("timestamp").over(W.partitionBy(*by, "stream").orderBy("timestamp"))
    out = rows.select(*by, "stream", before.alias("start_ms"), F.col("timestamp").alias("end_ms"))
    return out.where(F.col("end_ms") - F.col("start_ms") > threshold_sec * 1000).withColumn("gap_sec", S.rounded((F.col("end_ms") - F.col("start_ms")) / 1000.0, 3))


def gap_stats(tape: DataFrame, by: list[str], threshold_sec: float) -> DataFrame:
    """Per stream: events, gaps, longest and total gap, span, coverage (100 with fewer than two events)."""
    rows = tape.withColumn("stream", stream()).where("stream IS NOT NULL")
    step = F.col("timestamp") - F.lag("timestamp").over(W.partitionBy(*by, "stream").orderBy("timestamp"))
    gap = F.when(F.col("_step") > threshold_sec * 1000, S.rounded(F.col("_step") / 1000.0, 3))
    per = rows.withColumn("_step", step).groupBy(*by, "stream").agg(
        F.count("*").alias("n_events"),
        F.count(gap).alias("n_gaps"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap_sec"),
        S.rounded(F.coalesce(F.sum(gap), F.lit(0.0)), 3).alias("total_gap_sec"),
        S.rounded((F.max("timestamp") - F.min("timestamp")) / 1000.0, 3).alias("span_sec"),
    )
    cover = F.when(F.col("span_sec") > 0, S.rounded(100.0 * (1 - F.col("total_gap_sec") / F.col("span_sec")), 3)).otherwise(100.0)
    return per.withColumn("coverage_pct", cover)


def gap_report(tape: DataFrame, by: list[str], threshold_sec: float) -> DataFrame:
    """One row per group with all streams nested: gaps in order and stats, ready for a JSON sink."""
    listed = gaps(tape, by, threshold_sec).groupBy(*by, "stream").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "gap_sec"))).alias("gaps"))
    stats = gap_stats(tape, by, threshold_sec)
    both = stats.join(listed, [*by, "stream"], "left")
    each = F.struct("stream", F.coalesce("gaps", F.array().cast(listed.schema["gaps"].dataType)).alias("gaps"), *[c for c in stats.columns if c not in (*by, "stream")])
    return both.groupBy(*by).agg(F.sort_array(F.collect_list(each)).alias("streams"), F.sum("n_gaps").alias("total_gaps"))


def minute_counts(tape: DataFrame, by: list[str], width_ms: int = MINUTE) -> DataFrame:
    """by, minute, n: book updates in each minute from the group's first event on, empty minutes included."""
    first = tape.groupBy(*by).agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    spine = first.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_first")) / width_ms).cast("long"))).alias("minute"))
    seen = tape.where("side IN (0, 1)").join(first, by).groupBy(*by, F.floor((F.col("timestamp") - F.col("_first")) / width_ms).cast("long").alias("minute")).agg(F.count("*").alias("n"))
    return spine.join(seen, [*by, "minute"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def dead_intervals(counts: DataFrame, by: list[str], least: int) -> DataFrame:
    """by, start_min, end_min: maximal half-open runs of minutes with fewer than `least` events."""
    dead = counts.where(F.col("n") < least)
    run = F.col("minute") - F.row_number().over(W.partitionBy(*by).orderBy("minute"))
    return dead.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("minute").alias("start_min"), (F.max("minute") + 1).alias("end_min")).drop("_run")


def side_distribution(tape: DataFrame, by: list[str]) -> DataFrame:
    return tape.groupBy(*by, "side").agg(F.count("*").alias("n"))


def max_gap(tape: DataFrame, by: list[str]) -> DataFrame:
    step = F.col("timestamp") - F.lag("timestamp").over(W.partitionBy(*by).orderBy("timestamp"))
    return tape.select(*by, step.alias("_s")).groupBy(*by).agg(F.coalesce(F.max("_s"), F.lit(0)).alias("max_gap_ms"))


def health_report(tape: DataFrame, by: list[str], least: int) -> DataFrame:
    """Per group: totals, side counts as a map, minute counts as an array, dead intervals, longest gap."""
    sides = side_distribution(tape, by).groupBy(*by).agg(F.sum("n").alias("n_events"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("side", "n")))).alias("side_dist"))
    per_min = minute_counts(tape, by)
    listed = per_min.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("minute", "n"))), lambda x: x["n"]).alias("per_minute"))
    dead = dead_intervals(per_min, by, least).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start_min", "end_min"))).alias("dead"))
    return sides.join(listed, by).join(dead, by, "left").join(max_gap(tape, by), by)


def daily_integrity(tape: DataFrame, by: list[str], gap_ms: int = 60_000, pattern: tuple[int, int] = (1_797_000, 1_807_000)) -> DataFrame:
    """Per group and UTC day: head and tail silence, gaps, outage, coverage, the longest gap and where it starts."""
    day = F.floor(F.col("timestamp") / DAY).cast("long")
    rows = tape.withColumn("day", day)
    before = F.lag("timestamp").over(W.partitionBy(*by, "day").orderBy("timestamp", "seq"))
    rows = rows.withColumn("_from", before).withColumn("_step", F.col("timestamp") - F.col("_from"))
    long = F.when(F.col("_step") >= gap_ms, F.col("_step"))
    start = F.col("day") * DAY
    per = rows.groupBy(*by, "day").agg(
        F.count("*").alias("events_in_day"),
        F.count_if(F.col("side") == 2).alias("trades"),
        F.min("timestamp").alias("_lo"),
        F.max("timestamp").alias("_hi"),
        F.count(long).alias("n_gaps"),
        F.coalesce(F.sum(long), F.lit(0)).alias("_gap"),
        F.count_if(F.col("_step").between(*pattern)).alias("n_pattern"),
        F.max(F.struct(F.col("_step"), -F.col("_from"))).alias("_top"),
    )
    outage = F.col("_lo") - start + (start + DAY - F.col("_hi")) + F.col("_gap")
    return per.select(
        *by, "day", "events_in_day", "trades", "n_gaps", "n_pattern",
        ((F.col("_lo") - start) / 60000.0).alias("head_min"), ((start + DAY - F.col("_hi")) / 60000.0).alias("tail_min"),
        (outage / 60000.0).alias("outage_min"), (100 * (1 - outage / float(DAY))).alias("coverage_pct"),
        F.coalesce(F.floor(F.col("_top._step") / 1000), F.lit(0)).cast("long").alias("top_gap_sec"), (-F.col("_top.col2")).alias("top_gap_start"),
    )


def coverage_rollup(days: DataFrame, by: list[str]) -> DataFrame:
    """Totals over days; coverage weighted by the days that have data."""
    return days.groupBy(*by).agg(F.sum("trades").alias("trades"), F.sum("n_gaps").alias("n_gaps"), F.sum("n_pattern").alias("n_pattern"), F.count("*").alias("days"), (100 * (1 - F.sum("outage_min") / 60 / 24 / F.count("*"))).alias("coverage_pct"))


def validate(frame: DataFrame, by: list[str], price: str, timestamp: str, day: Column) -> DataFrame:
    """Per group (a file, a venue): rows, faults (bad price, unit, date) and stats; `day` is the expected UTC date."""
    unit = F.when(F.max(timestamp) < 1e11, 1000.0).when(F.max(timestamp) < 1e14, 1.0).otherwise(0.001)
    per = frame.groupBy(*by).agg(F.count("*").alias("row_count"), F.count_if(F.col(price) <= 0).alias("bad_price"), (F.min(timestamp) * unit).cast("long").alias("start_ms"), S.rounded(F.avg(price), 2).alias("avg_price"))
    per = per.withColumn("start_day", F.to_date(F.timestamp_millis("start_ms")))
    return per.withColumn("date_ok", F.col("start_day") == day).withColumn("is_valid", (F.col("bad_price") == 0) & F.col("date_ok") & (F.year("start_day") <= 3000))


def freshness(shards: DataFrame, by: list[str], at: str, now: Column, stale_sec: float, parked_sec: float) -> DataFrame:
    """Per group: the latest shard, its age, count and status."""
    per = shards.groupBy(*by).agg(F.max(at).alias("last_ts"), F.count("*").alias("n_shards"))
    age = (now - F.col("last_ts")) / 1000.0
    status = F.when(age > parked_sec, "parked").when(age > stale_sec, "stale").otherwise("fresh")
    return per.withColumn("age_sec", age).withColumn("status", status)


def status_order(status: Column) -> Column:
    """Worst first."""
    return F.when(status == "stale", 0).when(status == "unknown", 1).when(status == "fresh", 2).otherwise(3)


def bitmap(marks: DataFrame, by: list[str], bucket: str, n: int, flag: Column) -> DataFrame:
    """Per group a string of n characters, one for each bucket: 'x' if any row is bad (it sticks), '1' if any, else '0'."""
    per = marks.groupBy(*by, bucket).agg(F.when(F.max(flag), "x").otherwise("1").alias("_c"))
    found = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(bucket).cast("int"), "_c"))).alias("_m"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit("0")))
    return found.select(*by, F.array_join(bits, "").alias("bitmap"))


def landing_history(days: DataFrame, by: list[str], today: int, n: int, parked: Column) -> DataFrame:
    """Per group, a string for the n days up to `today` (day numbers): x corrupted, 1 landed, p parked, - before the
    first landing, ? today or yesterday, 0 missing. `days`: by, day, bad."""
    per = days.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("int"), "bad"))).alias("_m"), F.min(F.when(~F.col("bad"), F.col("day"))).alias("_first"), F.max(parked).alias("_p"))

    def char(i):
        d = F.lit(today - n + 1) + i
        bad = F.try_element_at("_m", d.cast("int"))
        return F.when(bad, "x").when(~bad, "1").when(F.col("_p"), "p").when(F.col("_first").isNotNull() & (d < F.col("_first")), "-").when(d >= today - 1, "?").otherwise("0")

    return per.select(*by, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), char), "").alias("history"))


def cold_status(latest: DataFrame, today: int) -> DataFrame:
    """latest (group..., latest_day, parked) with days_behind and status, yesterday being the newest to expect."""
    behind = F.lit(today - 1) - F.col("latest_day")
    status = F.when(F.col("parked"), "parked").when(F.col("latest_day").isNull(), "missing").when(behind <= 0, "ok").when(behind == 1, "lag").otherwise("stale")
    return latest.withColumn("days_behind", F.when(~F.col("parked"), behind)).withColumn("status", status)


def fleet_summary(rows: DataFrame) -> DataFrame:
    """One row of counts by status, and the colour that follows: RED with a stale or missing one, and so on."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    per = rows.agg(F.count("*").alias("n"), n("fresh"), n("stale"), n("parked"))
    return per.withColumn("overall", F.when(F.col("n") == 0, "EMPTY").when(F.col("n_stale") * 2 > F.col("n"), "RED").when(F.col("n_stale") > 0, "DEGRADED").otherwise("GREEN"))
