"""The live tape in Structured Streaming.

Micro-batches with a checkpoint take the place of a write-ahead log: a restart goes on where the last committed batch
ended, and the file sink's commit log makes output exactly-once. Order-dependent state (alignment, monotone
deduplication, snapshots, watchdogs) lives in arbitrary stateful operators keyed by venue and symbol; the book in
them is the machine that batch queries use.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.kernels import Book

LIVE = "venue string, symbol string, ts_ms long, side byte, price double, qty double, u_first long, u_last long"
KEY = ["venue", "symbol"]


def read_live(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """JSON lines that land in a folder, at most `files_per_batch` files a batch (back-pressure)."""
    return spark.readStream.schema(LIVE).option("maxFilesPerTrigger", files_per_batch).json(path)


def windows(live: DataFrame, width: str, slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Trade count and taker volumes per venue and window; rows later than the watermark are left out."""
    at = F.timestamp_millis("ts_ms").alias("at")
    rows = live.where("side = 2").select(*KEY, at, F.greatest(-F.col("qty"), F.lit(0.0)).alias("buy"), F.greatest(F.col("qty"), F.lit(0.0)).alias("sell")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width, slide) if slide else F.window("at", width), *KEY).agg(F.count("*").alias("n"), F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))


def sessions(live: DataFrame, gap: str, late: str = "10 seconds") -> DataFrame:
    """Runs of trades without a pause longer than `gap`."""
    rows = live.where("side = 2").select(*KEY, F.timestamp_millis("ts_ms").alias("at"), "qty").withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("session"), *KEY).agg(F.count("*").alias("n"), F.sum(F.abs("qty")).alias("volume"))


def sink_days(live: DataFrame, path: str, checkpoint: str, trigger: str | None = "2 seconds"):
    """Append the tape as Parquet by venue, symbol and day."""
    rows = live.select(*KEY, F.date_format(F.timestamp_millis("ts_ms"), "yyyyMMdd").alias("day"), F.col("ts_ms").alias("timestamp"), "side", "price", F.col("qty").alias("quantity"))
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*KEY, "day").outputMode("append")
    return writer.trigger(processingTime=trigger).start() if trigger else writer.trigger(availableNow=True).start()


ALIGNED = "venue string, symbol string, event string, ts_ms long, side byte, price double, qty double, u_last long"


def _bundles(pdfs: Iterator[pd.DataFrame]) -> list[tuple]:
    """The rows of a micro-batch, in order of update id and arrival."""
    rows = pd.concat(list(pdfs)).reset_index(drop=True)
    return list(rows.sort_values(["u_last", "ts_ms"], kind="stable").itertuples(index=False))


def aligned(live: DataFrame, most: int = 2000, retries: int = 10) -> DataFrame:
    """Depth rows joined to a snapshot without a hole, by update ids.

    A row with side 3 or 4 is a snapshot with its last id in u_last. Diffs wait (at most `most` of them) until one
    covers the snapshot's next id; older ones are dropped, later ones follow if their ids go on. A buffer whose oldest
    diff starts beyond the snapshot asks for a new one (event RESNAPSHOT); after `retries` of these in a row the key
    is BROKEN until a snapshot fits. An update id that was seen is dropped.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"last": None, "live": False, "tries": 0, "wait": []}
        out = []
        tell = lambda event, r: out.append((*key, event, r[0], r[1], r[2], r[3], r[5]))
        for r in _bundles(pdfs):
            row = [int(r.ts_ms), int(r.side), float(r.price), float(r.qty), int(r.u_first), int(r.u_last)]
            if row[1] in (3, 4):
                if held["last"] is None or row[5] > held["last"]:
                    held.update(last=row[5], live=False)
                tell("ROW", row)
            elif row[1] == 2:
                tell("ROW", row)
            else:
                held["wait"] = (held["wait"] + [row])[-most:]
        if held["last"] is not None:
            wait, held["wait"] = sorted(held["wait"], key=lambda x: (x[5], x[4])), []
            base = held["last"]  # rows of one update share its ids
            for i, row in enumerate(wait):
                first, last = row[4], row[5]
                if last <= held["last"] and not (held["live"] and last == held["last"] and last > base):
                    continue
                if held["live"] or first <= held["last"] + 1 <= last:
                    held.update(live=True, last=last, tries=0)
                    tell("ROW", row)
                else:
                    held["tries"] += 1
                    held["wait"] = wait[i:]
                    tell("BROKEN" if held["tries"] >= retries else "RESNAPSHOT", row)
                    break
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALIGNED.split(", ")])

    return live.groupBy(*KEY).applyInPandasWithState(run, ALIGNED, "held string", "append", GroupStateTimeout.NoTimeout)


SHARD = "venue string, symbol string, ts_ms long, side byte, price double, qty double"


def with_snapshots(live: DataFrame, every_ms: int) -> DataFrame:
    """The tape with a whole book injected (sides 3 and 4) whenever event time passes a multiple of `every_ms`, so that
    each shard of output can be replayed on its own. Event time drives it, so a replay gives the same rows."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"bids": [], "asks": [], "cell": None, "snap": [None, None]}
        book = Book(clear=True)
        book.snap_ts = held["snap"]  # a snapshot may go on in the next micro-batch
        book.levels[0].update(dict(map(tuple, held["bids"])))
        book.levels[1].update(dict(map(tuple, held["asks"])))
        rows = pd.concat(list(pdfs)).reset_index(drop=True).assign(_s=lambda d: -d["side"].astype(int)).sort_values(["ts_ms", "_s"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            cell = int(r.ts_ms) // every_ms
            if held["cell"] is not None and cell > held["cell"]:
                at = cell * every_ms
                out += [(*key, at, 4, p, q) for p, q in sorted(book.levels[1].items())] + [(*key, at, 3, p, q) for p, q in sorted(book.levels[0].items(), reverse=True)]
            held["cell"] = cell if held["cell"] is None else max(cell, held["cell"])
            book.apply(int(r.ts_ms), int(r.side), float(r.price), float(r.qty))
            out.append((*key, int(r.ts_ms), int(r.side), float(r.price), float(r.qty)))
        held.update(bids=list(book.levels[0].items()), asks=list(book.levels[1].items()), snap=book.snap_ts)
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SHARD.split(", ")])

    return live.groupBy(*KEY).applyInPandasWithState(run, SHARD, "held string", "append", GroupStateTimeout.NoTimeout)


TOP = "venue string, symbol string, ts_ms long, best_bid double, bid_qty double, best_ask double, ask_qty double"


def tops(live: DataFrame) -> DataFrame:
    """The top of the book at every trade, by the same machine as in batch; the state is the book's levels."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book(threshold=1)
        if state.exists:
            held = json.loads(state.get[0])
            book.levels[0].update(dict(map(tuple, held["bids"])))
            book.levels[1].update(dict(map(tuple, held["asks"])))
            book.best, book.snap_ts, book.batch, book.ready = held["best"], held["snap"], held["batch"], held["ready"]
        rows = pd.concat(list(pdfs)).reset_index(drop=True).assign(_s=lambda d: -d["side"].astype(int)).sort_values(["ts_ms", "_s"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            book.apply(int(r.ts_ms), int(r.side), float(r.price), float(r.qty))
            if r.side == 2 and (t := book.top()):
                out.append((*key, int(r.ts_ms), *t[:4]))
        state.update((json.dumps({"bids": list(book.levels[0].items()), "asks": list(book.levels[1].items()), "best": book.best, "snap": book.snap_ts, "batch": book.batch, "ready": book.ready}),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOP.split(", ")])

    return live.groupBy(*KEY).applyInPandasWithState(run, TOP, "held string", "append", GroupStateTimeout.NoTimeout)


def watchdog(live: DataFrame, depth_ms: int = 180_000, trade_ms: int = 1_800_000) -> DataFrame:
    """An alert for each venue, symbol and channel that stays silent longer than its limit (processing time)."""
    channel = F.when(F.col("side") == 2, "trade").otherwise("depth").alias("channel")

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["venue", "symbol", "channel", "last_ts_ms"]
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(*key, last)], columns=cols)
            return
        last = max(int(p["ts_ms"].max()) for p in pdfs)
        state.update((max(last, state.get[0]) if state.exists else last,))
        state.setTimeoutDuration(trade_ms if key[2] == "trade" else depth_ms)
        yield pd.DataFrame([], columns=cols)

    rows = live.select(*KEY, channel, "ts_ms")
    return rows.groupBy(*KEY, "channel").applyInPandasWithState(run, "venue string, symbol string, channel string, last_ts_ms long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fan_out(live: DataFrame, write, checkpoint: str):
    """Each micro-batch as JSON lines to `write(DataFrame, epoch)`; a consumer that is slow only slows its own query."""
    lines = live.select(F.to_json(F.struct(*live.columns)).alias("value"))
    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
