"""Session logs: decisions, fills and cancellations of a trading session, as tables with fixed schemas.

`read` brings shards into one ordered table, `split_valid` sends rows that break the schema to a table of their own,
`write` lays a session out by kind and symbol, `to_lines` merges a session with its tape for the replay kernel, and
`calibration` compares what was recorded with what the simulation makes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import scalars as S
from tickloom.operators import recon

#: Column, type and NOT NULL of each kind of event.
DECISIONS = "ts_ns bigint not null, ts_wall_ns bigint not null, event_type string not null, client_oid string not null, symbol string not null, mid_price double not null, best_bid double not null, best_ask double not null, top1_bid_qty double not null, top1_ask_qty double not null, spread_bps double not null, alpha_pred_bps double, alpha_features_hash string not null, alpha_source string not null, side string not null, price double, qty double, estimated_queue_position int not null, estimated_queue_ahead_qty double, place_oid string not null, reason string not null"
FILLS = "ts_ns bigint not null, ts_wall_ns bigint not null, exchange_ts_ms bigint not null, client_oid string not null, exchange_oid string not null, symbol string not null, side string not null, fill_price double not null, fill_qty double not null, is_maker boolean not null, place_ts_ns bigint not null, quote_age_ms double not null, mid_at_place double not null, mid_at_fill double not null, spread_at_fill_bps double not null, mid_t_plus_500ms double, mid_t_plus_1s double, mid_t_plus_5s double, mid_t_plus_30s double, estimated_queue_at_place int not null, estimated_queue_at_fill int not null, inventory_before double not null, inventory_after double not null, alpha_pred_bps_at_place double, alpha_realized_bps_post double"
CANCELS = "ts_ns_request bigint not null, ts_wall_ns_request bigint not null, ts_ns_ack bigint not null, cancel_latency_ms double not null, client_oid string not null, exchange_oid string not null, symbol string not null, place_ts_ns bigint not null, quote_age_at_cancel_ms double not null, cancel_reason string not null, final_state string not null, qty_filled_before_cancel double not null, mid_at_cancel double not null"
KINDS = {"decisions": (DECISIONS, "ts_ns"), "fills": (FILLS, "ts_ns"), "cancels": (CANCELS, "ts_ns_request")}
META = "session_id string, schema_version string, exchange string, symbols array<string>, trade_symbols array<string>"


def schema(kind: str) -> T.StructType:
    return T._parse_datatype_string(KINDS[kind][0])


def read(spark: SparkSession, session: str, kind: str) -> DataFrame:
    """The shards of a kind of event, ordered by time."""
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema(kind)])
    return spark.read.schema(nullable).option("recursiveFileLookup", "true").parquet(f"{session}/{kind}").orderBy(KINDS[kind][1])


def read_meta(spark: SparkSession, session: str) -> DataFrame:
    """The session's description; Spark raises if the file is missing."""
    return spark.read.schema(META).option("multiLine", "true").option("mode", "FAILFAST").json(f"{session}/meta.json")


def split_valid(events: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rows that don't with `fault`: the first required column that is missing or null)."""
    fault = F.coalesce(*[F.when(F.col(f.name).isNull() if f.name in events.columns else F.lit(True), F.lit(f.name)) for f in schema(kind) if not f.nullable])
    marked = events.withColumn("fault", fault)
    fields = [f.name for f in schema(kind)]
    return marked.where("fault IS NULL").select(*[c for c in fields if c in events.columns]), marked.where("fault IS NOT NULL")


def write(events: DataFrame, session: str, kind: str) -> None:
    """Append a shard of valid rows under the session, by symbol; the file commit is atomic."""
    events.withColumn("_symbol", F.col("symbol")).write.mode("append").partitionBy("_symbol").parquet(f"{session}/{kind}")


def counts(spark: SparkSession, session: str) -> DataFrame:
    """Rows of each kind."""
    out = [read(spark, session, k).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in KINDS]
    return out[0].unionByName(out[1]).unionByName(out[2])


def to_lines(tape: DataFrame, decisions: DataFrame, cancels: DataFrame, by: list[str], clock: str = "ts_ns") -> DataFrame:
    """Market rows, placements, reprice triggers and cancellations on one line, as `kernels.replay` takes them.

    `clock`: the decisions' time to merge on; the tape's is wall-clock ms, so `ts_wall_ns` fits real sessions.
    """
    market = tape.select(*by, (F.col("timestamp") * 1_000_000).alias("ts_ns"), F.col("seq").alias("arrival"), F.col("side").alias("tape_side"), "price", "quantity")
    told = decisions.select(*by, F.col(clock).alias("ts_ns"), F.col("ts_ns").alias("arrival"), "event_type", "client_oid", F.col("side").alias("order_side"), "price", F.col("qty").alias("quantity"), "reason", F.col("alpha_pred_bps").alias("alpha"))
    at = "ts_wall_ns_request" if clock == "ts_wall_ns" else "ts_ns_request"
    stop = cancels.select(*by, F.col(at).alias("ts_ns"), F.col("ts_ns_request").alias("arrival"), "client_oid", F.col("cancel_reason").alias("reason"))
    pick = lambda kind: told.where(F.col("event_type") == kind).drop("event_type")
    return recon.tagged_merge({"L2": market, "PLACE": pick("PLACE"), "REPRICE": pick("REPRICE_TRIGGER"), "CANCEL": stop}, by)


def calibration(fills: DataFrame, matches: DataFrame, simulated: DataFrame, cancels: DataFrame, adverse: DataFrame, by: list[str], sim_cancel_ms: float, adverse_1s: float) -> DataFrame:
    """One row per session: match rate, timing offsets, cancel latencies by index, adverse selection, issues, verdict.

    fills: recorded; matches: of `kernels.match_fills`; simulated: events of the replay; adverse: by, adverse_bps at 1 s.
    """
    real = fills.groupBy(*by).agg(F.count("*").alias("n_real"))
    sim = simulated.where("event = 'FILL'").groupBy(*by).agg(F.count("*").alias("n_sim"))
    pairs = matches.where("sim_ts_ns IS NOT NULL").withColumn("offset_ms", F.abs(F.col("ts_ns") - F.col("sim_ts_ns")) / 1e6)
    got = pairs.groupBy(*by).agg(F.count("*").alias("n_matched"), F.sort_array(F.collect_list("offset_ms")).alias("_o"))
    got = got.select(*by, "n_matched", recon.index_percentile(F.col("_o"), 0.5).alias("offset_p50_ms"), recon.index_percentile(F.col("_o"), 0.95).alias("offset_p95_ms"))
    late = recon.index_percentiles(cancels, by, "cancel_latency_ms").select(*by, F.col("p50").alias("cancel_p50_ms"), F.col("p95").alias("cancel_p95_ms"), F.col("p99").alias("cancel_p99_ms"))
    out = real.join(sim, by, "left").join(got, by, "left").join(late, by, "left").join(adverse, by, "left").na.fill(0, ["n_sim", "n_matched"])
    out = out.withColumn("match_rate", F.col("n_matched") / F.col("n_real")).withColumn("adverse_delta_1s_bps", F.col("adverse_bps") - adverse_1s).withColumn("cancel_delta_p50_ms", F.col("cancel_p50_ms") - sim_cancel_ms)
    ratio = (F.col("n_real") > 5) & ((F.col("n_sim") < F.col("n_real") * 0.5) | (F.col("n_sim") > F.col("n_real") * 2.0))
    issues = F.array_compact(F.array(F.when(F.col("match_rate") < 0.7, "fill_match_rate"), F.when(ratio, "fill_count_ratio"), F.when(F.abs("adverse_delta_1s_bps") > 0.3, "adverse_1s"), F.when(F.abs("cancel_delta_p50_ms") > sim_cancel_ms * 0.5, "cancel_latency")))
    scale = F.when((F.col("n_sim") > 0) & (F.col("n_real") > 0), F.col("n_real") / F.col("n_sim")).otherwise(1.0)
    return out.withColumn("issues", issues).withColumn("verdict", recon.verdict(F.size("issues"))).withColumn("queue_scaling", F.when(F.abs(scale - 1.0) > 0.05, S.rounded(scale, 3)).otherwise(1.0))
