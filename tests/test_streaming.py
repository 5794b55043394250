"""Streaming equals batch on the same tape, and the stateful operators' worked cases."""

import json
import os

from tickloom.streaming import tape_stream as ts


def land(path, batches):
    path.mkdir(parents=True, exist_ok=True)
    for i, rows in enumerate(batches):
        lines = [json.dumps({"venue": "v", "symbol": "S", "ts_ms": t, "side": s, "price": p, "qty": q, "u_first": a, "u_last": b}) for t, s, p, q, a, b in rows]
        (path / f"{i:03d}.json").write_text("\n".join(lines) + "\n")
        os.utime(path / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by age


def drain(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_top_of_book_across_batches(spark, tmp_path):
    land(tmp_path / "in", [[(1, 3, 100.0, 1.0, 0, 0), (1, 4, 101.0, 1.0, 0, 0)], [(2, 0, 100.5, 2.0, 0, 0), (3, 2, 100.5, 1.0, 0, 0)], [(4, 0, 100.5, 0.0, 0, 0), (5, 2, 100.0, 1.0, 0, 0)]])
    rows = drain(spark, ts.tops(ts.read_live(spark, str(tmp_path / "in"), 1)), tmp_path, "tops")
    assert sorted((r.ts_ms, r.best_bid) for r in rows) == [(3, 100.5), (5, 100.0)]


def test_alignment_waits_for_the_snapshot_and_drops_old_ids(spark, tmp_path):
    land(tmp_path / "in", [[(1, 0, 99.0, 1.0, 5, 6)], [(2, 0, 98.0, 1.0, 7, 9)], [(3, 3, 100.0, 1.0, 8, 8)], [(4, 0, 97.0, 1.0, 10, 12), (4, 0, 96.0, 1.0, 5, 6)]])
    rows = drain(spark, ts.aligned(ts.read_live(spark, str(tmp_path / "in"), 1)), tmp_path, "aligned")
    assert sorted((r.event, r.price) for r in rows) == [("ROW", 97.0), ("ROW", 98.0), ("ROW", 100.0)]


def test_a_hole_asks_for_a_snapshot(spark, tmp_path):
    land(tmp_path / "in", [[(1, 3, 100.0, 1.0, 5, 5)], [(2, 0, 99.0, 1.0, 9, 10)]])
    rows = drain(spark, ts.aligned(ts.read_live(spark, str(tmp_path / "in"), 1)), tmp_path, "hole")
    assert sorted(r.event for r in rows) == ["RESNAPSHOT", "ROW"]


def test_snapshots_are_injected_at_boundaries(spark, tmp_path):
    land(tmp_path / "in", [[(100, 0, 99.0, 1.0, 0, 0), (200, 1, 101.0, 2.0, 0, 0)], [(1100, 0, 98.0, 1.0, 0, 0)]])
    rows = drain(spark, ts.with_snapshots(ts.read_live(spark, str(tmp_path / "in"), 1), 1000), tmp_path, "snaps")
    assert sorted((r.ts_ms, r.side, r.price) for r in rows) == [(100, 0, 99.0), (200, 1, 101.0), (1000, 3, 99.0), (1000, 4, 101.0), (1100, 0, 98.0)]


def test_a_snapshot_over_two_batches_stays_whole(spark, tmp_path):
    """Both halves of a snapshot are in the book that is injected later, and in the top of the book."""
    halves = [[(100, 3, 99.0, 1.0, 0, 0), (100, 4, 101.0, 1.0, 0, 0)], [(100, 3, 98.0, 2.0, 0, 0), (100, 4, 102.0, 2.0, 0, 0)], [(1100, 2, 99.0, 1.0, 0, 0)]]
    land(tmp_path / "in", halves)
    rows = drain(spark, ts.with_snapshots(ts.read_live(spark, str(tmp_path / "in"), 1), 1000), tmp_path, "halves")
    assert sorted((r.side, r.price, r.qty) for r in rows if r.ts_ms == 1000) == [(3, 98.0, 2.0), (3, 99.0, 1.0), (4, 101.0, 1.0), (4, 102.0, 2.0)]
    tops = drain(spark, ts.tops(ts.read_live(spark, str(tmp_path / "in"), 1)), tmp_path, "halftops")
    assert [(r.best_bid, r.best_ask) for r in tops] == [(99.0, 101.0)]


def test_fan_out_writes_every_row_once(spark, tmp_path):
    land(tmp_path / "in", [[(1, 0, 99.0, 1.0, 0, 0)], [(2, 0, 98.0, 1.0, 0, 0)]])
    seen = []
    q = ts.fan_out(ts.read_live(spark, str(tmp_path / "in"), 1), lambda df, epoch: seen.append([json.loads(r.value)["price"] for r in df.collect()]), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(sum(seen, [])) == [98.0, 99.0]


def test_watchdog_tells_of_a_silent_channel_once(spark, tmp_path):
    land(tmp_path / "in", [[(1, 0, 99.0, 1.0, 0, 0), (2, 2, 99.0, 1.0, 0, 0)]])
    q = ts.watchdog(ts.read_live(spark, str(tmp_path / "in"), 1), depth_ms=500, trade_ms=600_000).writeStream.format("memory").queryName("dog").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if spark.table("dog").count():
                break
    finally:
        q.stop()
    assert [(r.channel, r.last_ts_ms) for r in spark.table("dog").collect()] == [("depth", 1)]


def test_windows_and_restart(spark, tmp_path):
    land(tmp_path / "in", [[(1_000, 2, 1.0, -2.0, 0, 0), (2_000, 2, 1.0, 1.0, 0, 0)], [(60_000, 2, 1.0, 1.0, 0, 0)], [(200_000, 2, 1.0, 1.0, 0, 0)]])
    rows = drain(spark, ts.windows(ts.read_live(spark, str(tmp_path / "in"), 1), "10 seconds"), tmp_path, "win")
    assert [(r.n, r.buy, r.sell) for r in rows][0] == (2, 2.0, 1.0)


def test_sink_is_exactly_once_over_a_restart(spark, tmp_path):
    land(tmp_path / "in", [[(1, 0, 99.0, 1.0, 0, 0)]])
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(2):
        q = ts.sink_days(ts.read_live(spark, str(tmp_path / "in")), out, cp, None)
        q.awaitTermination(120)
        if i == 0:
            (tmp_path / "in" / "900.json").write_text(json.dumps({"venue": "v", "symbol": "S", "ts_ms": 2, "side": 0, "price": 98.0, "qty": 1.0}) + "\n")
    assert spark.read.parquet(out).count() == 2
