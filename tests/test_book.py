"""The book as intervals against a plain replay, and the kernel's special cases."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import book
from tickloom.operators.interval_join import join_points
from tickloom.operators.kernels import Book, book_metrics, throttled, top_at_trades
from tickloom.sources.tape import sequenced


def random_tape(seed, n=600, gap=3):
    rng, ts, out, batch = random.Random(seed), 1000, [], 0
    for i in range(n):
        ts += rng.randint(0, gap)
        if i % 150 == 149:
            ts += 1
            out += [("v", ts, 3, 100.0 - j, float(rng.randint(1, 9)), len(out) + j) for j in range(4)]
            out += [("v", ts, 4, 101.0 + j, float(rng.randint(1, 9)), len(out) + 10 + j) for j in range(4)]
            continue
        side = rng.choice([0, 0, 1, 1, 2])
        price = 100.0 - rng.randint(0, 10) if side == 0 else (101.0 + rng.randint(0, 10) if side == 1 else 100.5)
        qty = 0.0 if side != 2 and rng.random() < 0.35 else float(rng.randint(1, 9)) * (rng.choice([-1, 1]) if side == 2 else 1)
        out.append(("v", ts, side, price, qty, len(out)))
    return [(*r[:5], i) for i, r in enumerate(out)]


def frame(spark, rows):
    return sequenced(spark.createDataFrame(rows, "venue string, timestamp long, side byte, price double, quantity double, arrival long"), ["venue"], ["arrival"])


def naive(rows, clear):
    """(seq -> top) by replaying rows in tape order."""
    order = sorted(rows, key=lambda r: (r[1], -r[2], r[5]))
    maps, snap, out = ({}, {}), [None, None], {}
    for seq, (_, ts, side, price, qty, _) in enumerate(order, 1):
        if side == 2:
            if maps[0] and maps[1] and max(maps[0]) < min(maps[1]):
                out[seq] = (max(maps[0]), maps[0][max(maps[0])], min(maps[1]), maps[1][min(maps[1])])
            continue
        a = side in (1, 4)
        if side in (3, 4) and snap[a] != ts:
            if clear:
                maps[a].clear()
            snap[a] = ts
        if qty:
            maps[a][price] = qty
        else:
            maps[a].pop(price, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("clear", [True, False])
def test_intervals_equal_replay(spark, seed, clear):
    rows = random_tape(seed)
    t = frame(spark, rows)
    top = book.top1(t.where("side = 2").select("venue", "timestamp", "seq"), book.intervals(t, ["venue"], clear), ["venue"])
    got = {r.seq: (r.best_bid, r.bid_qty, r.best_ask, r.ask_qty) for r in top.collect()}
    assert got == naive(rows, clear)


def test_kernel_equals_intervals(spark):
    rows = random_tape(3)
    got = {r.seq: (r.best_bid, r.bid_qty, r.best_ask, r.ask_qty) for r in top_at_trades(frame(spark, rows), ["venue"], threshold=1).collect()}
    assert got == naive(rows, True)


def test_interval_join_finds_all_pairs(spark):
    rng = random.Random(5)
    spans = [(i, a := rng.randint(0, 5000), a + rng.choice([1, 3, 70, 900, 4000])) for i in range(200)]
    points = [(i, rng.randint(0, 9000)) for i in range(200)]
    got = join_points(spark.createDataFrame([("k", *p) for p in points], "k string, p int, at long"), spark.createDataFrame([("k", *s) for s in spans], "k string, s int, st long, en long"), ["k"], "at", "st", "en", 16)
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((p, s) for p, x in points for s, a, b in spans if a <= x < b)


def feed(rows, **options):
    b = Book(**options)
    for r in rows:
        b.apply(*r)
    return b


def test_all_sides_case():
    t0 = 1000
    rows = [(t0, 3, 100.0, 0.5), (t0, 3, 99.0, 0.5), (t0, 3, 98.0, 0.5), (t0, 4, 101.0, 0.4), (t0, 4, 102.0, 0.4), (t0, 4, 103.0, 0.4), (t0 + 1, 0, 99.5, 0.3), (t0 + 2, 1, 101.0, 0.1), (t0 + 4, 0, 98.0, 0.0), (t0 + 5, 1, 100.5, 0.2)]
    assert feed(rows).top()[:4] == (100.0, 0.5, 100.5, 0.2)


def test_readiness_by_levels():
    rows = [(1, 0, 100.0 - i, 1.0) for i in range(5)] + [(1, 1, 101.0 + i, 1.0) for i in range(4)]
    assert feed(rows).top() is None
    assert feed([*rows, (2, 1, 110.0, 1.0)]).top() is not None
    assert feed([*rows, (2, 1, 110.0, 1.0)], threshold=0).top() is None


def test_crossed_top_skips_the_smaller_side():
    b = feed([(1, 3, 102.0, 0.1), (1, 3, 100.0, 5.0), (1, 4, 101.0, 2.0)])
    assert b.top()[:4] == (100.0, 5.0, 101.0, 2.0)
    assert feed([(1, 3, 102.0, 1.0), (1, 4, 101.0, 1.0), (1, 4, 103.0, 1.0)]).top() is None  # a tie skips the bid


def test_stale_top_ages_out():
    rows = [(1000, 3, 100.0, 1.0), (1000, 4, 101.0, 1.0)]
    b = feed(rows, stale_ms=500)
    b.top()
    b.apply(1300, 1, 101.0, 0.0)
    assert b.top() == (100.0, 1.0, 101.0, 1.0, 300)
    b.apply(1600, 0, 99.0, 1.0)
    assert b.top() is None


def test_prune_at_the_end_of_a_batch():
    b = feed([(1, 3, 103.0, 0.1), (1, 3, 100.0, 5.0), (1, 4, 101.0, 2.0), (2, 0, 99.0, 1.0)], prune=True)
    assert set(b.levels[0]) == {100.0, 99.0}


def test_throttle_and_metrics(spark):
    rows = [("v", 1000, 3, 100.0, 1.0, 0), ("v", 1000, 4, 101.0, 3.0, 1), ("v", 1100, 0, 99.0, 1.0, 2), ("v", 1300, 0, 99.0, 2.0, 3), ("v", 1700, 1, 102.0, 2.0, 4)]
    t = frame(spark, rows)
    assert [r.timestamp for r in throttled(t, ["venue"], 500).collect()] == [1000, 1700]
    m = book_metrics(t, ["venue"], ms=500).collect()
    assert [r.timestamp for r in m] == [1100, 1700] and m[0].top1_imb == -0.5


def test_grid_takes_the_first_at_or_after_a_boundary(spark):
    t = frame(spark, [("v", ts, 0, 1.0, 1.0, i) for i, ts in enumerate([1000, 1050, 1099, 1100, 1110, 1200])])
    assert [r.timestamp for r in book.grid_samples(t, ["venue"], 100).orderBy("seq").collect()] == [1000, 1100, 1200]


def test_empty_tape(spark):
    t = frame(spark, [])
    assert book.top1(t.where("side = 2").select("venue", "timestamp", "seq"), book.intervals(t, ["venue"]), ["venue"]).count() == 0
    assert top_at_trades(t, ["venue"]).count() == 0
    assert t.select(F.max("seq")).first()[0] is None
