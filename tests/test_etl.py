"""Adapters, vendor files, compaction, quality scans and session logs on small inputs."""

import hashlib
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import models
from tickloom.operators import etl, quality, recon
from tickloom.plans import registry
from tickloom.sources import files, session_logs
from tickloom.sources.tape import read_tape, sequenced

NS = 1_000_000


def rows_of(spark, adapter, messages):
    df = spark.createDataFrame([(json.dumps(m) if not isinstance(m, str) else m,) for m in messages], "message string")
    return sorted((r.timestamp, r.side, r.price, r.quantity) for r in adapter(df).collect())


def test_binance(spark):
    depth = {"e": "depthUpdate", "E": 1700, "b": [["100.5", "2.0"], ["100.0", "1.0"], ["bad"]], "a": [["101.0", "1.5"]]}
    trade = {"stream": "btcusdt@aggTrade", "data": {"e": "aggTrade", "E": 1701, "p": "100.5", "q": "0.3", "m": True}}
    got = rows_of(spark, etl.binance_rows, [depth, trade, {"result": None}, "garbage"])
    assert got == [(1700, 0, 100.0, 1.0), (1700, 0, 100.5, 2.0), (1700, 1, 101.0, 1.5), (1701, 2, 100.5, -0.3)]


def test_coincheck(spark):
    book = ["btc_jpy", {"bids": [["100", "1"]], "asks": [["101", "0"]], "last_update_at": "1700000000"}]
    trades = [["1700000001", "i", "btc_jpy", "100.5", "0.3", "buy"], ["1700000002", "i", "btc_jpy", "100.6", "0.2", "sell"], ["bad"], ["x", "i", "btc_jpy", "no", "0.1", "buy"]]
    got = rows_of(spark, etl.coincheck_rows, [book, trades])
    assert got == [(1700000000000, 0, 100.0, 1.0), (1700000000000, 1, 101.0, 0.0), (1700000001000, 2, 100.5, 0.3), (1700000002000, 2, 100.6, -0.2)]


def test_bitbank_bitflyer_gmo(spark):
    assert rows_of(spark, etl.bitbank_rows, [{"t": 5, "b": [["10", "1"]], "a": []}, {"timestamp": 6, "bids": [["9", "1"]], "asks": [["11", "2"]]}, {"transactions": [{"executed_at": 7, "price": "10", "amount": "2", "side": "buy"}]}]) == [(5, 0, 10.0, 1.0), (6, 3, 9.0, 1.0), (6, 4, 11.0, 2.0), (7, 2, 10.0, -2.0)]
    snap = {"channel": "lightning_board_snapshot_BTC_JPY", "time": "2024-01-01T00:00:00.5Z", "message": {"bids": [{"price": 10, "size": 1}], "asks": []}}
    done = {"channel": "lightning_executions_BTC_JPY", "message": [{"exec_date": "2024-01-01T00:00:01Z", "price": 10.0, "size": 2.0, "side": "BUY"}]}
    assert rows_of(spark, etl.bitflyer_rows, [snap, done]) == [(1704067200500, 3, 10.0, 1.0), (1704067201000, 2, 10.0, -2.0)]
    assert rows_of(spark, etl.gmo_rows, [{"channel": "orderbooks", "timestamp": "2024-01-01T00:00:00Z", "bids": [{"price": "10", "size": "1"}], "asks": [{"price": "11", "size": "1"}]}, {"channel": "trades", "timestamp": "2024-01-01T00:00:00Z", "price": "10", "size": "1", "side": "SELL"}]) == [(1704067200000, 2, 10.0, 1.0), (1704067200000, 3, 10.0, 1.0), (1704067200000, 4, 11.0, 1.0)]


@pytest.mark.parametrize("factor", [0.001, 1, 1000])
def test_agg_trades_csv_units_and_headers(spark, tmp_path, factor):
    at = int(1_700_000_000_000 * factor)
    (tmp_path / "a.csv").write_text(f"agg_trade_id,price,quantity,first,last,time,maker,best\n1,100.5,2,1,1,{at},true,true\n2,100.6,3,2,2,{at},false,true\n")
    got = etl.agg_trades_to_tape(etl.read_agg_trades(spark, str(tmp_path / "a.csv"))).orderBy("arrival").collect()
    assert [(r.timestamp, r.side, r.quantity) for r in got] == [(1_700_000_000_000, 2, -2.0), (1_700_000_000_000, 2, 3.0)]


def test_quotes_with_other_names_and_missing_columns(spark):
    q = spark.createDataFrame([(1, 10.0, 1.0, 11.0, 2.0, 5)], "updateId long, bestBidPrice double, bestBidQty double, bestAskPrice double, bestAskQty double, eventTime long")
    assert [(r.side, r.price) for r in etl.quotes_to_tape(q).orderBy("part").collect()] == [(3, 10.0), (4, 11.0)]
    with pytest.raises(ValueError, match="best_bid_price"):
        etl.quotes_to_tape(q.drop("bestBidPrice"))


def test_timed_json(spark, tmp_path):
    (tmp_path / "x").write_text('2024\t{"e":"depthUpdate","E":1,"b":[["1","2"]],"a":[]}\nno tab\n')
    assert etl.binance_rows(etl.timed_json(spark, str(tmp_path / "x"))).count() == 1


def test_compaction_layouts_and_types(spark, tmp_path):
    tape = "timestamp long, side {}, price double, quantity double"
    spark.createDataFrame([(2, 0, 1.0, 1.0), (1, 1, 1.0, 1.0)], tape.format("int")).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1, 4, 1.0, 1.0)], tape.format("int")).coalesce(1).write.parquet(str(tmp_path / "b"))
    (tmp_path / "in" / "20240101").mkdir(parents=True)
    for folder, name in (("a", "in/BTC_JPY_RAW_20240101120000.parquet"), ("b", "in/20240101/BTC_JPY_RAW_20240101130000.parquet")):
        next((tmp_path / folder).glob("*.parquet")).rename(tmp_path / name)
    t = read_tape(spark, str(tmp_path / "in"))
    assert {(r.symbol, r.day) for r in t.collect()} == {("BTC_JPY", "20240101")}
    c = etl.compacted(t, ["symbol", "day"], ["_file", "_row"])
    assert [(r.timestamp, r.side) for r in c.collect()] == [(1, 4), (1, 1), (2, 0)]
    for _ in range(2):
        etl.write_day(c.select("symbol", "day", "timestamp", "side", "price", "quantity"), str(tmp_path / "out"), ["symbol", "day"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    first = files.first_rows(t, ["symbol"]).first()
    assert (first.first_ts, first.min_ts) == (2, 1)


def test_landing_zone(spark, tmp_path):
    for name, data in (("BTC_RAW_20240101_DAILY.parquet", b"PAR1 middle PAR1"), ("BTC_RAW_20240102.parquet", b"PAR1 cut short xx")):
        (tmp_path / name).write_bytes(data)
    got = files.listing(spark, str(tmp_path)).orderBy("day").collect()
    assert [(r.symbol, r.day, r.daily, r.size) for r in got] == [("BTC", "20240101", True, 16), ("BTC", "20240102", False, 17)]
    assert files.between(files.listing(spark, str(tmp_path)), "20240102", "20240103", "btc").count() == 1
    spark.createDataFrame([(1, 0, 1.0, 1.0)], "timestamp long, side byte, price double, quantity double").coalesce(1).write.parquet(str(tmp_path / "good"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.unreadable(spark, str(tmp_path)).collect()) == ["BTC_RAW_20240101_DAILY.parquet", "BTC_RAW_20240102.parquet"]
    digests = spark.createDataFrame([("BTC_RAW_20240102.parquet", hashlib.md5(b"PAR1 cut short xx").hexdigest()), ("BTC_RAW_20240101_DAILY.parquet", "0" * 64), ("none", "0" * 32)], "file string, digest string")
    assert {r.file: r.ok for r in files.verify(spark, str(tmp_path), digests).collect()} == {"BTC_RAW_20240102.parquet": True, "BTC_RAW_20240101_DAILY.parquet": False, "none": False}


@pytest.mark.parametrize(("tail", "health"), [("done (rc=0)", "ok"), ("done (rc=124)", "bad"), ("done (rc=143)", "ok"), ("noise", "ok")])
def test_sync_log(spark, tail, health):
    lines = ["2024-01-01T00:00:00Z [s] syncing...", "2024-01-01T00:01:00Z [s] done (rc=0)", "junk", "2024-01-01T00:10:00Z [s] syncing...", f"2024-01-01T00:11:30Z [s] {tail}"]
    r = files.sync_cycles(spark.createDataFrame([(x,) for x in lines], "line string"), F.lit(1704067900)).first()
    assert r.health == health and r.n_cycles == (1 if tail == "noise" else 2) and r.in_progress == (tail == "noise")


def tape(spark, rows):
    return sequenced(spark.createDataFrame([("v", *r, i) for i, r in enumerate(rows)], "venue string, timestamp long, side byte, price double, quantity double, arrival long"), ["venue"], ["arrival"])


def test_gaps(spark):
    depth = [(1_000_000 + 100 * i, 0, 1.0, 1.0) for i in range(10)] + [(1_100_000, 0, 1.0, 1.0)]
    got = quality.gaps(tape(spark, depth), ["venue"], 30).collect()
    assert [(g.start_ms, g.end_ms, g.gap_sec) for g in got] == [(1_000_900, 1_100_000, 99.1)]
    silent = [(0, 0, 1.0, 1.0), (40_000, 3, 1.0, 1.0), (80_000, 4, 1.0, 1.0), (120_000, 1, 1.0, 1.0)]
    assert [g.gap_sec for g in quality.gaps(tape(spark, silent), ["venue"], 30).collect()] == [120.0]
    s = quality.gap_stats(tape(spark, [(0, 0, 1.0, 1.0), (100_000, 0, 1.0, 1.0), (200_000, 0, 1.0, 1.0)]), ["venue"], 30).first()
    assert (s.total_gap_sec, s.coverage_pct) == (200.0, 0.0)
    one = quality.gap_stats(tape(spark, [(0, 0, 1.0, 1.0)]), ["venue"], 30).first()
    assert (one.n_gaps, one.coverage_pct) == (0, 100.0)
    edge = quality.gaps(tape(spark, [(0, 0, 1.0, 1.0), (30_000, 0, 1.0, 1.0)]), ["venue"], 30)
    assert edge.count() == 0 and quality.gap_report(tape(spark, silent), ["venue"], 30).count() == 1


def session(spark):
    """A small session: one order that fills, one cancellation after 187 ms."""
    book = [(1000, 3, p, 0.5) for p in (99.0, 98.0, 97.0)] + [(1000, 4, p, 0.5) for p in (101.0, 102.0, 103.0)]
    trades = [(1500, 2, 99.0, 0.4), (2000, 2, 101.0, -0.3)]
    later = [(2500, 0, 99.0, 0.0)] + [(4000 + 1000 * i, 0, 97.0, 0.5) for i in range(31)]
    return tape(spark, book + trades + later)


def event(kind, **given):
    out = {}
    for f in session_logs.schema(kind):
        out[f.name] = given.get(f.name, {"string": "x", "boolean": True}.get(f.dataType.simpleString(), 0 if f.dataType.simpleString() in ("bigint", "int") else 0.0))
    return tuple(out.values())


def test_session_calibration(spark, tmp_path):
    place = event("decisions", ts_ns=1100 * NS, event_type="PLACE", client_oid="A", side="BUY", price=99.0, qty=0.05, symbol="S")
    fill = event("fills", ts_ns=2600 * NS, client_oid="A", side="BUY", fill_price=99.0, fill_qty=0.05, mid_at_fill=100.0, symbol="S")
    stop = event("cancels", ts_ns_request=6000 * NS, client_oid="B", cancel_latency_ms=187.0, symbol="S")
    for kind, row in (("decisions", place), ("fills", fill), ("cancels", stop)):
        session_logs.write(spark.createDataFrame([row], session_logs.schema(kind)), str(tmp_path), kind)
    (tmp_path / "meta.json").write_text(json.dumps({"session_id": "s1", "exchange": "cc", "symbols": ["S"]}))
    assert session_logs.read_meta(spark, str(tmp_path)).first().session_id == "s1"
    assert {r.kind: r.n for r in session_logs.counts(spark, str(tmp_path)).collect()} == {"decisions": 1, "fills": 1, "cancels": 1}
    from tickloom.operators import kernels

    own = {k: session_logs.read(spark, str(tmp_path), k).withColumn("venue", F.lit("v")) for k in session_logs.KINDS}
    sim = kernels.replay(session_logs.to_lines(session(spark), own["decisions"], own["cancels"], ["venue"]), ["venue"], tick=1.0)
    assert [r.queue_ahead for r in sim.where("event = 'PLACE'").collect()] == [0.5]
    both = own["fills"].select("venue", F.lit("real").alias("source"), "ts_ns", "client_oid", "side", F.col("fill_price").alias("price")).unionByName(sim.where("event = 'FILL'").select("venue", F.lit("sim").alias("source"), "ts_ns", "client_oid", "side", "price"))
    match = kernels.match_fills(both, ["venue"], 2000)
    adverse = spark.createDataFrame([("v", 0.1)], "venue string, adverse_bps double")
    r = session_logs.calibration(own["fills"], match, sim, own["cancels"], adverse, ["venue"], 187.0, 0.0).first()
    assert r.cancel_p50_ms == 187.0 and r.n_real == 1 and r.match_rate in (0.0, 1.0) and r.verdict == ("HEALTHY" if r.match_rate else "ACCEPT_WITH_TUNING")


def test_invalid_events_are_set_aside(spark):
    rows = spark.createDataFrame([event("fills"), event("fills")[:3] + (None,) + event("fills")[4:]], [f.name for f in session_logs.schema("fills")])
    good, bad = session_logs.split_valid(rows, "fills")
    assert good.count() == 1 and bad.first().fault == "client_oid"
    assert session_logs.split_valid(rows.drop("symbol"), "fills")[1].count() == 2


def test_models(spark):
    text = {"model_kind": "OLS", "weights_filename": "w", "feature_names": ["r_um", "hour_sin"], "features_version": "v6", "input_shape": "sequence:60s,1s"}
    m = models.Manifest.load(json.dumps(text))
    w = {"beta": np.array([2.0, -1.0]), "mu_x": np.array([0.1, 0.0]), "mu_y": 0.5}
    df = spark.createDataFrame([(1.1, 0.5), (None, 0.5), (float("nan"), 1.0)], "r_um double, hour_sin double")
    assert [r.s for r in df.select(models.score(m, w).alias("s")).collect()] == [20000.0, None, None]
    assert m.sequence() == (60, 1) and len(models.FEATURE_NAMES) == 38
    with pytest.raises(ValueError, match="v5"):
        models.score(models.Manifest.load(json.dumps(text | {"features_version": "v5"})), w)
    with pytest.raises(ValueError, match="2s"):
        models.Manifest.load(json.dumps(text | {"sampling_mode": "2s"}))
    with pytest.raises(ValueError, match="mid_2s"):
        models.Manifest.load(json.dumps(text | {"target_kind": "mid_2s_log_return"}))
    longer = {k: v for k, v in text.items() if k != "features_version"} | {"model_kind": "Ridge", "own_features_version_required": "v6", "model_output_unit": "bps", "target_kind": "mid_1s_log_return"}
    m = models.Manifest.load(json.dumps(longer))
    assert (m.features_version, m.output_unit, m.extra) == ("v6", "bps", {})
    assert df.select(models.score(m, w).alias("s")).first().s == 20000.0
    with pytest.raises(ValueError, match="unknown model"):
        models.score(models.Manifest.load(json.dumps(text | {"model_kind": "gbm"})), w)


def test_index_percentiles_need_more_than_a_hundred(spark):
    rows = [("a", float(i)) for i in range(1, 102)] + [("b", float(i)) for i in range(1, 11)]
    got = {r.k: (r.p50, r.p95, r.p99) for r in recon.index_percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert got == {"a": (51.0, 96.0, 100.0), "b": (6.0, 10.0, 10.0)}


def test_packed_depth_holds_every_order_to_its_depth(spark):
    """Against SQL over all lines: only the depth of 4 limits the levels."""
    sf = "/root/testdata/sf0.001"
    levels = ", ".join(f"max(p) FILTER (i = {i}), max(q) FILTER (i = {i})" for i in range(4))
    want = duckdb.sql(f"""WITH l AS (
      SELECT l_orderkey, l_linenumber::DOUBLE AS p, floor(min(l_quantity)) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM '{sf}/lineitem.parquet' GROUP BY l_orderkey, l_linenumber
    ) SELECT l_orderkey, {levels} FROM l GROUP BY l_orderkey""").fetchall()
    got = [tuple(r) for r in registry.queries()["packed_depth"](spark, sf).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert any(r[7] is not None for r in got)


def test_agg_trades_unit_is_told_by_file(spark, tmp_path):
    for name, at in (("ms", 1_700_000_000_000), ("us", 1_700_000_001_000_000), ("s", 1_700_000_002)):
        (tmp_path / f"{name}.csv").write_text(f"1,100.0,1.0,1,1,{at},True,True\n")
    got = sorted(r.timestamp for r in etl.read_agg_trades(spark, str(tmp_path)).collect())
    assert got == [1_700_000_000_000, 1_700_000_001_000, 1_700_000_002_000]
