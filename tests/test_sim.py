"""Worked cases of the queue simulation, the strategy loop, replay and matching."""

import math
from types import SimpleNamespace

import pytest

from tickloom.operators import kernels as K
from tickloom.plans import registry
from tickloom.plans.book_plans import tape

NS = 1_000_000


def broker(**params):
    b = K.Broker(tick=1.0, **params)
    for p in (100.0, 99.0, 98.0):
        b.market(1000 * NS, 3, p, 0.5)
    for p in (101.0, 102.0, 103.0):
        b.market(1000 * NS, 4, p, 0.5)
    return b


def events(b, name):
    return [x for x in b.log if x[0] == name]


def test_queue_then_fill():
    b = broker(top1_median=0.02)
    assert b.place(1001 * NS, "A", "BUY", 99.0, 0.1)
    assert b.orders["A"].ahead == 0.5 and b.orders["A"].rank == 25
    b.market(1002 * NS, 2, 99.0, 0.4)
    assert b.orders["A"].ahead == pytest.approx(0.1) and b.inventory == 0
    b.market(1003 * NS, 2, 99.0, 0.2)
    assert "A" not in b.orders and b.inventory == pytest.approx(0.1) and b.cash == pytest.approx(-9.9)


def test_rejections():
    b = broker()
    assert not b.place(1, "A", "BUY", 101.0, 0.1)
    assert not b.place(1, "B", "SELL", 101.0, 0.1)
    assert not b.place(1, "C", "BUY", 99.5, 0.1)
    assert [x[6] for x in events(b, "PLACE_REJECT")] == ["WOULD_CROSS_ASK", "INVENTORY_INSUFFICIENT", "SPEC:TICK"]
    b.inventory = 0.1
    assert b.place(1, "D", "SELL", 102.0, 0.1) and not b.place(1, "E", "SELL", 103.0, 0.1)


def test_penetration_fills_at_own_price():
    b = broker()
    b.place(1, "A", "BUY", 99.0, 0.1)
    b.market(2, 2, 98.0, 1.0)
    assert events(b, "FILL")[0][4] == 99.0


def test_level_shrinking_moves_the_queue_and_growing_does_not():
    b = broker()
    b.place(1, "A", "BUY", 99.0, 0.1)
    b.market(2, 0, 99.0, 0.2)
    assert b.orders["A"].ahead == pytest.approx(0.2)
    b.market(3, 0, 99.0, 5.0)
    assert b.orders["A"].ahead == pytest.approx(0.2)


def test_cancel_latency_and_fill_in_between():
    b = broker(cancel_ms=100)
    b.place(0, "A", "BUY", 99.0, 0.1)
    b.place(0, "B", "BUY", 98.0, 0.1)
    assert b.cancel(10 * NS, "A", "X") and not b.cancel(11 * NS, "A", "X") and b.cancel(10 * NS, "B", "X")
    b.market(50 * NS, 2, 98.5, 0.2)
    b.market(200 * NS, 0, 90.0, 1.0)
    assert sorted(x[6] for x in events(b, "CANCEL")) == ["X:CANCELLED", "X:FILLED_DURING_CANCEL"]
    assert events(b, "CANCEL")[0][13] == 100.0 and not b.orders


def run_strategy(spark, alphas, **options):
    """Trades one second apart at 100 after a book of 100 / 101."""
    rows = [("s", 0, 1000, 3, 100.0, 10.0, True, math.nan), ("s", 1, 1000, 4, 101.0, 10.0, True, math.nan)]
    rows += [("s", i + 2, 1000 + 1000 * i, 2, 100.0, 0.01, True, a) for i, a in enumerate(alphas)]
    t = spark.createDataFrame(rows, "session string, line long, timestamp long, side byte, price double, quantity double, own boolean, alpha double")
    args = {"threshold": 0.5, "size": 1.0, "lifetime_ms": 60_000, "warmup_ms": 0, "strategy": "join_back"} | options
    return K.backtest(t, ["session"], **args).collect()


def test_warm_up_only_predicts(spark):
    out = run_strategy(spark, [1.0, 1.0, 1.0], warmup_ms=1500)
    assert [r.event for r in out] == ["PLACE", "REPORT"] and (out[-1].qty, out[-1].price) == (3.0, 2.0)


def test_threshold_and_missing_alpha(spark):
    assert [r.event for r in run_strategy(spark, [0.1, math.nan, -0.2])] == ["REPORT"]


def test_quote_expires_and_is_replaced(spark):
    out = run_strategy(spark, [1.0, math.nan, math.nan, 1.0, 1.0], lifetime_ms=2000)
    told = [(r.event, r.reason.split(":")[0]) for r in out]  # the last cancellation has no later event to come due at
    assert told == [("PLACE", ""), ("CANCEL", "QUOTE_TTL_EXPIRED"), ("PLACE", ""), ("PLACE", ""), ("REPORT", "3")]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        run_strategy(spark, [1.0], strategy="cross")


def test_matching_is_greedy_and_one_to_one(spark):
    rows = [("s", "real", 1000 * NS, "A", "BUY", 99.0), ("s", "real", 2000 * NS, "B", "BUY", 99.0), ("s", "sim", 1500 * NS, "A", "BUY", 99.0), ("s", "sim", 2600 * NS, "Z", "BUY", 99.0), ("s", "sim", 1900 * NS, "Y", "SELL", 99.0)]
    f = spark.createDataFrame(rows, "session string, source string, ts_ns long, client_oid string, side string, price double")
    got = {r.client_oid: r.sim_ts_ns for r in K.match_fills(f, ["session"], 2000).collect()}
    assert got == {"A": 1500 * NS, "B": 2600 * NS}


def test_backtest_is_one_session_over_all_days(spark):
    """The registered query against one strategy fed the whole merged tape in order."""
    sf, hour = "/root/testdata/sf0.001", 3_600_000
    rows = tape(spark, sf).collect()
    rows.sort(key=lambda r: (r.timestamp, -r.side, r.venue, r.arrival))
    assert len({r.timestamp // (24 * hour) for r in rows}) > 1
    machine, flow, want = K.Strategy(0.1, 1.0, 4 * hour, hour, "improve_1_tick", tick=0.5, cancel_ms=50.0), [], []
    for r in rows:
        flow = [x for x in flow if x[0] >= r.timestamp - 6 * hour]
        if r.venue == "bj" and r.side == 2:
            flow.append((r.timestamp, -r.quantity))
        alpha = round(math.fsum(q for _, q in flow), 6) / 20.0 if r.venue == "cc" and r.side == 2 else math.nan
        want += machine.feed(SimpleNamespace(timestamp=r.timestamp, side=r.side, price=r.price, quantity=r.quantity, own=r.venue == "cc", alpha=alpha))
    want += machine.close()
    got = registry.queries()["maker_backtest"](spark, sf).drop("session").collect()
    cell = lambda v: "nan" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    assert [[cell(v) for v in r] for r in got] == [[cell(v) for v in r] for r in want] and len(got) > 10


def test_book_metric_means_equal_a_plain_mean(spark):
    from tickloom.plans import registry
    from tickloom.sources.driver_tables import HOUR

    sf = "/root/testdata/sf0.001"
    samples = registry.queries()["book_metrics_throttled"](spark, sf).collect()
    got = {(r.venue, r.seq): r for r in registry.queries()["book_metric_means"](spark, sf).collect()}
    assert got.keys() == {(r.venue, r.seq) for r in samples} and got
    for r in samples:
        for name in ("top1_imb", "topn_imb", "micro_dev_bps"):
            inside = [s[name] for s in samples if s.venue == r.venue and s.seq <= r.seq and s.timestamp >= r.timestamp - 12 * HOUR]
            assert abs(got[r.venue, r.seq][f"{name}_mean"] - sum(inside) / len(inside)) < 5e-6


def test_trailing_mean_skips_what_is_missing(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import windows as win

    rows = spark.createDataFrame([("v", 0, 1, None), ("v", 10, 2, float("nan")), ("v", 20, 3, 2.0), ("v", 30, 4, 4.0), ("v", 90, 5, None)], "venue string, timestamp long, seq long, x double")
    got = [r.m for r in rows.select("seq", win.trailing_mean(F.col("x"), ["venue"], 50).alias("m")).orderBy("seq").collect()]
    assert got == [None, None, 2.0, 3.0, None]
