"""The feature row against a plain recomputation of every sample from the whole history, and its sequences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.models import FEATURE_NAMES
from tickloom.operators import features
from tickloom.operators import windows as win

SECOND, LOOKBACK = 100, 30


def random_tape(seed, n=1500):
    """Four venues, ties in time, deleted levels, snapshots, and a silence longer than the look-back."""
    rng, ts, rows = random.Random(seed), 1_000_000, []
    for i in range(n):
        ts += rng.choice([0, 0, 1, 3, 20, 60]) + (3 * LOOKBACK * SECOND if i == n // 2 else 0)
        venue = rng.choice(["cc", "bj", "um", "bs"])
        if rng.random() < 0.02:
            ts += 1
            rows += [(ts, venue, 3, 100.0 - j, float(rng.randint(1, 9))) for j in range(3)] + [(ts, venue, 4, 101.0 + j, float(rng.randint(1, 9))) for j in range(3)]
            continue
        side = rng.choice([0, 1, 2, 2])
        price = {0: 100.0 - rng.randint(0, 8), 1: 101.0 + rng.randint(0, 8), 2: 100.0 + rng.random()}[side]
        qty = 0.0 if side != 2 and rng.random() < 0.3 else rng.randint(1, 9) * (rng.choice([-1.0, 1.0]) if side == 2 else 1.0)
        rows.append((ts, venue, side, price, qty))
    return [("g", i + 1, *r, i % 7 == 0 or r[2] == 2 and r[1] == "cc") for i, r in enumerate(rows)]


def book_of(rows):
    """Levels, readiness and the time of an open snapshot batch, by replaying one venue's rows."""
    levels, snap, ready, batch = ({}, {}), [None, None], False, None
    for _, _, ts, _, side, price, qty, _ in rows:
        if side < 3:
            batch = None
        if side == 2:
            continue
        ask = side in (1, 4)
        if side > 2:
            if snap[ask] != ts:
                levels[ask].clear()
            snap[ask] = batch = ts
        levels[ask].pop(price, None)
        if qty:
            levels[ask][price] = qty
        ready = ready or side > 2 or min(map(len, levels)) >= 5
    return levels, ready, batch


def shown(rows, n=5):
    levels, ready, _ = book_of(rows)
    if not ready or not all(levels):
        return None
    bids, asks = sorted(levels[0].items(), reverse=True)[:n], sorted(levels[1].items())[:n]
    (b, bq), (a, aq) = bids[0], asks[0]
    mid, bn, an = (a + b) / 2, sum(q for _, q in bids), sum(q for _, q in asks)
    return {"mid": mid, "i1": (bq - aq) / (bq + aq), "i5": (bn - an) / (bn + an), "spread": (a - b) / mid * 1e4, "dev": ((b * aq + a * bq) / (bq + aq) / mid - 1) * 1e4}


def metrics_of(rows):
    out, last = [], None
    for i, r in enumerate(rows):
        if r[4] == 2 or last is not None and r[2] < last + SECOND // 2:
            continue
        levels, ready, batch = book_of(rows[: i + 1])
        if ready and all(levels) and batch is None:
            last = r[2]
            out.append((r[2], {"line": r[1], **shown(rows[: i + 1])}))
    return out


def expected(rows, k, metrics):
    now, past = rows[k][2], rows[: k + 1]
    trades = {v: [(r[2], r[5], r[6]) for r in past if r[3] == v and r[4] == 2] for v in ("cc", "bj", "um", "bs")}
    kept = {v: [x for x in t if x[0] >= t[-1][0] - LOOKBACK * SECOND] for v, t in trades.items()}
    tops = {v: shown([r for r in past if r[3] == v]) for v in kept}
    inside = lambda v, s: [x for x in kept[v] if x[0] >= now - int(s * SECOND)]

    def moved(v, s, lag=0):
        then = [p for t, p, _ in kept[v] if t <= now - (s + lag) * SECOND]
        return math.log(kept[v][-1][1] / then[-1]) if then else None

    flow = lambda v, s: -sum(q for _, _, q in inside(v, s))

    def imbalance(v, s):
        total = sum(abs(q) for _, _, q in inside(v, s))
        return flow(v, s) / total if total else 0.0

    def mean(c):
        got = [m[c] for t, m in metrics if now - 5 * SECOND <= t <= now and m["line"] <= rows[k][1]]
        return sum(got) / len(got) if got else None

    get = lambda v, c: tops[v] and tops[v][c]
    ratio = lambda x, y: math.log(x / y) * 1e4 if x and y else None
    um, basis = kept["um"], ratio(get("cc", "mid"), get("bj", "mid"))
    hour = now // 1000 % 86400 / 3600
    out = {
        "r_um": moved("um", 1), "r_um_2s": moved("um", 2), "r_um_5s": moved("um", 5), "r_um_10s": moved("um", 10), "um_imb_1s": imbalance("um", 1),
        "um_imb_30s_norm": imbalance("um", 30), "um_n_5s": len(inside("um", 5)),
        "um_vol_5s": sum(abs(math.log(b[1] / a[1])) for a, b in zip(um, um[1:], strict=False) if b[0] >= now - 5 * SECOND),
        "um_flow_50ms": flow("um", 0.05), "um_flow_100ms": flow("um", 0.1), "um_flow_500ms": flow("um", 0.5), "um_flow_5s": flow("um", 5),
        "r_bj": moved("bj", 1), "bj_imb_1s": imbalance("bj", 1), "bj_flow_5s": flow("bj", 5),
        "trade_intensity_burst_50ms": sum(t > now - int(0.05 * SECOND) for t, _, _ in kept["cc"]), "r_cc_lag1": moved("cc", 1, 1), "r_cc_lag2": moved("cc", 1, 2),
        "cc_imb_1s": imbalance("cc", 1), "basis_bj_bps": basis, "basis_um_bps": ratio(get("um", "mid"), get("bs", "mid")),
        "basis_um_bps_trade_proxy": ratio(get("um", "mid"), kept["bs"] and kept["bs"][-1][1]), "hour_sin": math.sin(math.tau * hour / 24), "hour_cos": math.cos(math.tau * hour / 24),
        "cc_flow_5s": flow("cc", 5), "cc_flow_30s": flow("cc", 30), "cc_imb_30s_norm": imbalance("cc", 30), "cc_l2_top1_imb": get("cc", "i1"),
        "cc_l2_top5_imb": get("cc", "i5"), "cc_l2_imb_top1_5s": mean("i1"), "cc_l2_imb_top5_5s": mean("i5"), "cc_l2_micro_dev_bps": get("cc", "dev"),
        "cc_micro_dev_5s": mean("dev"), "cc_l2_spread_bps": get("cc", "spread"), "bj_l2_top1_imb": get("bj", "i1"), "bj_l2_top5_imb": get("bj", "i5"),
        "l2_imb_diff": get("cc", "i1") - get("bj", "i1") if tops["cc"] and tops["bj"] else None,
    }
    out["um_x_basis"] = None if out["r_um"] is None or basis is None else out["r_um"] * basis
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_feature_row_is_what_the_whole_history_gives(spark, seed):
    rows = random_tape(seed)
    metrics = metrics_of([r for r in rows if r[3] == "cc"])
    df = spark.createDataFrame(rows, "g string, seq long, timestamp long, venue string, side int, price double, quantity double, sample boolean").repartition(5)
    got = {r.seq: r for r in features.feature_rows(df, ["g"], [], SECOND, LOOKBACK).collect()}
    assert sorted(got) == [r[1] for r in rows if r[7]]
    for k in [k for k, r in enumerate(rows) if r[7]][::5]:
        want, row = expected(rows, k, metrics), got[rows[k][1]]
        assert want.keys() == set(FEATURE_NAMES)
        for name in FEATURE_NAMES:
            assert (row[name] is None) == (want[name] is None), (k, name, row[name], want[name])
            assert want[name] is None or row[name] == pytest.approx(want[name], abs=1e-7), (k, name)


def test_feature_row_of_an_empty_tape(spark):
    df = spark.createDataFrame([], "g string, seq long, timestamp long, venue string, side int, price double, quantity double, sample boolean")
    assert features.feature_rows(df, ["g"], []).collect() == []
    with pytest.raises(ValueError, match="30 s"):
        features.feature_rows(df, ["g"], [], lookback_s=29)


def test_sequence_needs_history_for_every_step(spark):
    rows = [("a", t, t, float(t)) for t in (0, 1000, 1500, 3000)] + [("b", t, t, float(t)) for t in (2000, 3000)]
    df = spark.createDataFrame(rows, "g string, timestamp long, seq long, x double")
    got = features.feature_sequence(df, ["g"], ["seq"], 3000, 1000, ["x"]).orderBy("step").collect()
    assert [(r.g, r.step, r.x) for r in got] == [("a", 0, 3000.0), ("a", 1, 1500.0), ("a", 2, 1000.0)]


def test_at_or_before_takes_the_last_row_of_a_tie(spark):
    rows = [("a", 10, i, float(i)) for i in range(50)] + [("a", 20, 50, 99.0)]
    for n in (1, 7):
        df = spark.createDataFrame(rows[::-1], "g string, timestamp long, seq long, x double").repartition(n)
        got = df.select("seq", win.at_or_before(F.col("x"), ["g"], 5).alias("y")).where("seq = 50").first()
        assert got.y == 49.0
