"""Operators whose result depends on the path: the book with crossings and stale reads, throttling, passive-order
simulation, greedy matching. Each is a small state machine fed with rows in order.

`ordered` runs one machine per group over a shuffled and sorted stream of batches: a group is never gathered, so a
venue with a third of all events needs no more memory than another, and the same machines serve streaming queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def ordered(rows: DataFrame, by: list[str], order: list[Column], make: Callable, schema: str) -> DataFrame:
    """rows through make() machines: `feed(row)` and `close()` yield tuples in the columns of `schema` after `by`."""
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]
    names = by + [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine = None, None
        for pdf in batches:
            out = []
            keys = list(zip(*(pdf[c] for c in by), strict=True))
            for key, row in zip(keys, pdf.itertuples(index=False), strict=True):
                if key != now:
                    if machine is not None:
                        out += [(*now, *x) for x in machine.close()]
                    now, machine = key, make()
                out += [(*key, *x) for x in machine.feed(row)]
            yield pd.DataFrame(out, columns=names)
        if machine is not None:
            yield pd.DataFrame([(*now, *x) for x in machine.close()], columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, ", ".join([*kinds, schema]))


class Book:
    """Two price maps with a cached best on either side.

    clear: a snapshot at a new time empties its side. threshold: levels on both sides that make the book ready
    without a snapshot (0: never). prune: at the end of a snapshot batch, levels across the resolved top go.
    stale_ms: how old a last valid top may be returned. Reading a crossed top resolves it and keeps the result as the
    cached best, so what later reads see depends on when it was read; `observe=False` leaves no trace.
    """

    def __init__(self, clear: bool = True, threshold: int = 5, prune: bool = False, stale_ms: int = 0, observe: bool = True):
        self.clear, self.threshold, self.prune, self.stale_ms, self.observe = clear, threshold, prune, stale_ms, observe
        self.levels: tuple[dict, dict] = ({}, {})  # bids, asks
        self.best: list = [None, None]
        self.snap_ts: list = [None, None]
        self.batch: int | None = None  # time of the snapshot batch that is open
        self.ready, self.ts = False, 0
        self.valid: tuple | None = None
        self.read: tuple | None = None  # the last levels that `state` returned, with their time

    def apply(self, ts: int, side: int, price: float, qty: float) -> None:
        if side in (0, 1, 2) and self.batch is not None:
            if self.prune:
                self.drop_dust()
            self.batch = None
        self.ts = ts
        if side == 2:
            return
        ask, snap = side in (1, 4), side in (3, 4)
        own = self.levels[ask]
        if snap:
            if self.clear and self.snap_ts[ask] != ts:
                own.clear()
                self.best[ask] = None
            self.snap_ts[ask] = self.batch = ts
        better = min if ask else max
        if qty == 0:
            own.pop(price, None)
            if price == self.best[ask]:
                self.best[ask] = better(own, default=None)
        else:
            own[price] = qty
            self.best[ask] = price if self.best[ask] is None else better(self.best[ask], price)
        if snap or self.threshold and min(map(len, self.levels)) >= self.threshold:
            self.ready = True

    def resolve(self) -> tuple | None:
        """The first pair that isn't crossed, walking inwards and skipping the side with less quantity (ties: bids)."""
        bids, asks = sorted(self.levels[0].items(), reverse=True), sorted(self.levels[1].items())
        i = j = 0
        while i < len(bids) and j < len(asks):
            if bids[i][0] < asks[j][0]:
                return bids[i][0], asks[j][0]
            i, j = (i + 1, j) if bids[i][1] <= asks[j][1] else (i, j + 1)
        return None

    def drop_dust(self) -> None:
        top = self.resolve()
        if top:
            for own, gone in ((self.levels[0], lambda p: p >= top[1] and p != top[0]), (self.levels[1], lambda p: p <= top[0] and p != top[1])):
                for p in [p for p in own if gone(p)]:
                    del own[p]
            self.best = list(top)

    def top(self) -> tuple | None:
        """(bid, bid qty, ask, ask qty, age in ms), the age above 0 if it is an earlier one; None without any."""
        bids, asks = self.levels
        if self.ready and bids and asks:
            b, a = self.best
            if b is None or a is None or b >= a:
                found = self.resolve()
                b, a = found or (None, None)
                if found and self.observe:
                    self.best = [b, a]
            if b is not None:
                now = (b, bids[b], a, asks[a])
                self.valid = (self.ts, now)
                return (*now, 0)
        if self.stale_ms and self.valid and 0 <= self.ts - self.valid[0] <= self.stale_ms:
            return (*self.valid[1], self.ts - self.valid[0])
        return None

    def depth(self, n: int) -> tuple[list, list] | None:
        """The n best levels of either side; None if not ready or crossed."""
        bids, asks = heapq.nlargest(n, self.levels[0].items()), heapq.nsmallest(n, self.levels[1].items())
        return (bids, asks) if self.ready and bids and asks and bids[0][0] < asks[0][0] else None

    def state(self, n: int) -> tuple[list, list] | None:
        """`depth`, or where there is none the levels last read, if they are at most `stale_ms` old."""
        if now := self.depth(n):
            self.read = (self.ts, now)
            return now
        return self.read[1] if self.stale_ms and self.read and 0 <= self.ts - self.read[0] <= self.stale_ms else None


@dataclass
class TopAtTrade:
    """The top of the book at every trade."""

    book: Book

    def feed(self, r):
        self.book.apply(r.timestamp, r.side, r.price, r.quantity)
        if r.side == 2 and (t := self.book.top()):
            yield (r.timestamp, r.seq, *t)

    def close(self):
        return ()


def top_at_trades(tape: DataFrame, by: list[str], **options) -> DataFrame:
    """by, timestamp, seq, best_bid, bid_qty, best_ask, ask_qty, age_ms at trades, with crossings resolved."""
    cols = tape.select(*by, "timestamp", "side", "price", "quantity", "seq")
    return ordered(cols, by, [F.col("seq")], lambda: TopAtTrade(Book(**options)), "timestamp long, seq long, best_bid double, bid_qty double, best_ask double, ask_qty double, age_ms long")


@dataclass
class Throttle:
    """Rows at least `ms` after the last one taken."""

    ms: int
    last: int | None = None

    def feed(self, r):
        if self.last is None or r.timestamp >= self.last + self.ms:
            self.last = r.timestamp
            yield (r.timestamp, r.seq)

    def close(self):
        return ()


def throttled(rows: DataFrame, by: list[str], ms: int) -> DataFrame:
    return ordered(rows.select(*by, "timestamp", "seq"), by, [F.col("seq")], lambda: Throttle(ms), "timestamp long, seq long")


def share(x: float, y: float) -> float:
    return (x - y) / (x + y) if x + y > 0 else 0.0


def deviation(bid: float, bid_qty: float, ask: float, ask_qty: float) -> float:
    """How far the microprice is from the mid, in bps."""
    mid = (bid + ask) / 2
    micro = (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty) if bid_qty + ask_qty > 0 else mid
    return (micro - mid) / mid * 1e4


@dataclass
class BookMetrics:
    """Top-1 and top-n imbalance and microprice deviation after book events, throttled. A sample is due only when both
    sides are there and no snapshot batch is open, so half a snapshot is never sampled and never uses up the throttle."""

    ms: int
    n: int
    book: Book = field(default_factory=Book)
    last: int | None = None

    def feed(self, r):
        book = self.book
        book.apply(r.timestamp, r.side, r.price, r.quantity)
        due = r.side != 2 and (self.last is None or r.timestamp >= self.last + self.ms)
        if due and book.ready and all(book.levels) and book.batch is None:
            self.last = r.timestamp
            if found := book.state(self.n):
                bids, asks = found
                yield r.timestamp, r.seq, share(bids[0][1], asks[0][1]), share(sum(q for _, q in bids), sum(q for _, q in asks)), deviation(*bids[0], *asks[0])

    def close(self):
        return ()


def book_metrics(tape: DataFrame, by: list[str], ms: int = 500, n: int = 5, **options) -> DataFrame:
    cols = tape.select(*by, "timestamp", "side", "price", "quantity", "seq")
    return ordered(cols, by, [F.col("seq")], lambda: BookMetrics(ms, n, Book(**options)), "timestamp long, seq long, top1_imb double, topn_imb double, micro_dev_bps double")


SEEN = ("cc_mid", "bj_mid", "um_mid", "bs_mid", "cc_top1", "cc_spread_bps", "cc_dev_bps", "cc_topn", "bj_top1", "bj_topn")
METRICS = ("cc_top1_metric", "cc_topn_metric", "cc_dev_metric")


@dataclass
class MarketRows:
    """One merged tape of the venues cc, bj, um and bs, cut down to what windows need: trades, rows where `sample` is
    true (with what the books show there) and throttled metrics of cc's book. Book updates, most of a tape, go no further."""

    ms: int
    n: int
    keep: list[str]
    options: dict
    venues: dict = field(default_factory=dict)

    def feed(self, r):
        venue = self.venues.setdefault(r.venue, BookMetrics(self.ms, self.n, Book(**self.options)))
        metric = next(iter(venue.feed(r)), None) if r.venue == "cc" else venue.book.apply(r.timestamp, r.side, r.price, r.quantity)
        if r.side == 2 or r.sample or metric:
            seen = self.look() if r.sample else [None] * len(SEEN)
            trade = (r.price, r.quantity) if r.side == 2 else (None, None)
            yield (r.timestamp, r.seq, *(getattr(r, c) for c in self.keep), r.venue, *trade, r.sample, *seen, *(metric[2:] if metric else [None] * len(METRICS)))

    def look(self) -> list:
        tops, sums = {}, {}
        for v in ("cc", "bj", "um", "bs"):
            book = self.venues[v].book if v in self.venues else None
            tops[v] = book and book.top()
            both = book.state(self.n) if book and v in ("cc", "bj") else None
            sums[v] = both and share(*(sum(q for _, q in side) for side in both))
        mids = [t and (t[0] + t[2]) / 2 for t in tops.values()]
        cc, bj = tops["cc"], tops["bj"]
        own = (share(cc[1], cc[3]), (cc[2] - cc[0]) / mids[0] * 1e4, deviation(*cc[:4])) if cc else (None, None, None)
        return [*mids, *own, sums["cc"], bj and share(bj[1], bj[3]), sums["bj"]]

    def close(self):
        return ()


def market_rows(tape: DataFrame, by: list[str], keep: list[str], ms: int = 500, n: int = 5, **options) -> DataFrame:
    """by, timestamp, seq, keep, venue, price and quantity of trades, sample, SEEN, METRICS. `tape` is in the order of
    seq within `by` and has a boolean `sample`."""
    cols = tape.select(*by, *keep, "timestamp", "venue", "side", "price", "quantity", "seq", "sample")
    kept = [f"{c} {tape.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join(["timestamp long, seq long", *kept, "venue string, price double, quantity double, sample boolean", *(f"{c} double" for c in SEEN + METRICS)])
    return ordered(cols, by, [F.col("seq")], lambda: MarketRows(ms, n, keep, options), schema)


@dataclass
class Order:
    oid: str
    side: str
    price: float
    qty: float
    left: float
    ahead: float
    placed: int
    mid: float
    alpha: float
    rank: int
    asked: int = 0
    due: int | None = None
    why: str = ""


SIM = "event string, ts_ns long, client_oid string, side string, price double, qty double, reason string, queue_ahead double, queue_rank int, mid double, spread_bps double, inventory double, cash double, latency_ms double, alpha double"
EPS = 1e-12


class Broker:
    """Passive orders in a simulated queue.

    A new order stands behind what its level holds (times `queue_scaling`). A level that shrinks moves the queue on; a
    trade at the price eats the queue and then fills; a trade beyond the price fills at the order's own price. A
    cancellation takes `cancel_ms`, during which fills go on. Sales need inventory that other sales don't reserve.
    A positive trade quantity is an aggressive seller here, who hits bids. Times are ns.
    """

    def __init__(self, tick: float = 1.0, lot: float = 1e-8, least: float = 0.0, tolerance: float = 1e-7, cancel_ms: float = 0.0, queue_scaling: float = 1.0, top1_median: float = 0.0):
        self.spec, self.cancel_ms, self.queue_scaling, self.top1_median = (tick, lot, least, tolerance), cancel_ms, queue_scaling, top1_median
        self.book = Book(prune=True)
        self.orders: dict[str, Order] = {}
        self.inventory = self.cash = 0.0
        self.log: list[tuple] = []

    def tell(self, event: str, ts: int, oid: str = "", side: str = "", price: float = NAN, qty: float = NAN, reason: str = "", ahead: float = NAN, rank: int = -1, latency: float = NAN, alpha: float = NAN) -> None:
        t = self.book.top()
        mid, spread = ((t[0] + t[2]) / 2, (t[2] - t[0]) / ((t[0] + t[2]) / 2) * 1e4) if t else (NAN, NAN)
        self.log.append((event, ts, oid, side, price, qty, reason, ahead, rank, mid, spread, self.inventory, self.cash, latency, alpha))

    def fault(self, side: str, price: float, qty: float) -> str | None:
        tick, lot, least, tol = self.spec
        off = lambda x, step: abs(x / step - round(x / step)) > tol
        if side not in ("BUY", "SELL"):
            return "BAD_SIDE"
        for bad, name in ((qty <= 0, "QTY"), (price <= 0, "PRICE"), (price > 0 and off(price, tick), "TICK"), (off(qty, lot), "LOT"), (least > 0 and price * qty < least - tol, "NOTIONAL")):
            if bad:
                return f"SPEC:{name}"
        if side == "SELL" and self.inventory - sum(o.left for o in self.orders.values() if o.side == "SELL") + EPS < qty:
            return "INVENTORY_INSUFFICIENT"
        if t := self.book.top():
            if side == "BUY" and price >= t[2]:
                return "WOULD_CROSS_ASK"
            if side == "SELL" and price <= t[0]:
                return "WOULD_CROSS_BID"
        return None

    def place(self, ts: int, oid: str, side: str, price: float, qty: float, alpha: float = NAN) -> bool:
        side = side.upper()
        if why := self.fault(side, price, qty):
            self.tell("PLACE_REJECT", ts, oid, side, price, qty, why, alpha=alpha)
            return False
        ahead = self.book.levels[side == "SELL"].get(price, 0.0) * self.queue_scaling
        rank = int(ahead / self.top1_median) if self.top1_median > 0 else -1
        t = self.book.top()
        self.orders[oid] = Order(oid, side, price, qty, qty, ahead, ts, (t[0] + t[2]) / 2 if t else NAN, alpha, rank)
        self.tell("PLACE", ts, oid, side, price, qty, "", ahead, rank, alpha=alpha)
        return True

    def cancel(self, ts: int, oid: str, why: str) -> bool:
        o = self.orders.get(oid)
        if o is None or o.due is not None or o.left <= EPS:
            return False
        o.asked, o.due, o.why = ts, ts + int(self.cancel_ms * 1_000_000), why
        return True

    def acknowledge(self, ts: int) -> None:
        for o in [o for o in self.orders.values() if o.due is not None and ts >= o.due]:
            state = "FILLED_DURING_CANCEL" if o.qty - o.left > EPS else "CANCELLED"
            del self.orders[o.oid]
            self.tell("CANCEL", o.due, o.oid, o.side, o.price, o.qty - o.left, f"{o.why}:{state}", latency=(o.due - o.asked) / 1e6, alpha=o.alpha)

    def market(self, ts: int, side: int, price: float, qty: float) -> None:
        """One market event: queues see a level before and after it, due cancellations come before fills."""
        own = None if side == 2 else ("SELL" if side in (1, 4) else "BUY")
        mine = [o for o in self.orders.values() if o.side == own and o.price == price]
        before = self.book.levels[own == "SELL"].get(price, 0.0) if mine else 0.0
        self.book.apply(ts, side, price, qty)
        self.acknowledge(ts)
        if mine:
            gone = before - self.book.levels[own == "SELL"].get(price, 0.0)
            for o in mine:
                if gone > 0 and o.oid in self.orders:
                    o.ahead = max(0.0, o.ahead - gone)
        if side == 2 and qty:
            self.trade(ts, price, abs(qty), "BUY" if qty > 0 else "SELL")

    def trade(self, ts: int, price: float, rest: float, hit: str) -> None:
        for o in [o for o in self.orders.values() if o.side == hit and o.left > EPS]:
            if rest <= EPS:
                return
            if o.price == price:
                eaten = min(rest, o.ahead)
                o.ahead -= eaten
                rest -= eaten
                if rest <= EPS or o.ahead > EPS:
                    continue
            elif not (price < o.price if hit == "BUY" else price > o.price):
                continue
            else:
                o.ahead = 0.0
            done = min(rest, o.left)
            rest -= done
            o.left -= done
            sign = 1 if hit == "BUY" else -1
            self.inventory += sign * done
            self.cash -= sign * done * o.price
            self.tell("FILL", ts, o.oid, o.side, o.price, done, "", 0.0, o.rank, latency=(ts - o.placed) / 1e6, alpha=o.alpha)
            if o.left <= EPS and o.due is None:
                del self.orders[o.oid]

    def drain(self) -> list[tuple]:
        out, self.log = self.log, []
        return out


class Replay:
    """Recorded decisions driven through the broker: rows have kind L2, PLACE, REPRICE or CANCEL, in one order."""

    def __init__(self, **params):
        self.broker, self.ts = Broker(**params), None

    def feed(self, r):
        b, self.ts = self.broker, r.ts_ns
        if r.kind == "L2":
            b.market(r.ts_ns, int(r.tape_side), r.price, r.quantity)
        elif r.kind == "PLACE":
            b.place(r.ts_ns, r.client_oid, r.order_side, r.price, r.quantity, r.alpha)
        elif r.kind == "CANCEL":
            b.cancel(r.ts_ns, r.client_oid, r.reason)
        else:
            b.tell("REPRICE_TRIGGER", r.ts_ns, reason=r.reason, alpha=r.alpha)
        return b.drain()

    def close(self):
        if self.ts is not None:  # what is pending is acknowledged by a last empty event
            self.broker.market(self.ts + 60_000_000_000, 0, 0.0, 0.0)
        return self.broker.drain()


def replay(lines: DataFrame, by: list[str], **params) -> DataFrame:
    """Simulated events of merged lines (line, kind, ts_ns, tape_side, price, quantity, client_oid, order_side, reason, alpha)."""
    cols = lines.select(*by, "line", "kind", "ts_ns", "tape_side", F.coalesce("price", F.lit(NAN)).alias("price"), F.coalesce("quantity", F.lit(NAN)).alias("quantity"), F.coalesce("client_oid", F.lit("")).alias("client_oid"), F.coalesce("order_side", F.lit("")).alias("order_side"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("alpha", F.lit(NAN)).alias("alpha"))
    cols = cols.withColumn("tape_side", F.coalesce("tape_side", F.lit(-1).cast("byte")))
    return ordered(cols, by, [F.col("line")], lambda: Replay(**params), SIM)


class Strategy:
    """One passive quote at a time: at each trade with |alpha| at the threshold or more, after the warm-up, cancel and
    quote anew on alpha's side; a quote expires after its lifetime. Rows carry alpha (NaN: no prediction)."""

    def __init__(self, threshold: float, size: float, lifetime_ms: int, warmup_ms: int, strategy: str, **params):
        self.threshold, self.size, self.lifetime, self.warmup, self.strategy = threshold, size, lifetime_ms * 1_000_000, warmup_ms * 1_000_000, strategy
        self.broker, self.tick = Broker(**params), params.get("tick", 1.0)
        self.live: str | None = None
        self.expires = self.start = self.ts = self.n = 0
        self.seen = self.early = 0

    def price(self, side: str, bid: float, ask: float) -> float:
        if self.strategy == "join_back":
            return bid if side == "BUY" else ask
        inside = bid + self.tick if side == "BUY" else ask - self.tick
        return inside if bid < inside < ask else (bid if side == "BUY" else ask)

    def feed(self, r):
        b, ts = self.broker, int(r.timestamp) * 1_000_000
        self.start = self.start or ts + self.warmup
        self.ts = ts
        if r.own:
            b.market(ts, r.side, r.price, r.quantity)
        if self.live is not None and ts >= self.expires:
            b.cancel(ts, self.live, "QUOTE_TTL_EXPIRED")
            self.live = None
        if r.own and r.side == 2 and math.isfinite(r.alpha):
            self.seen += 1
            top = b.book.top()
            if ts < self.start:
                self.early += 1
            elif abs(r.alpha) >= self.threshold and top:
                if self.live is not None:
                    b.cancel(ts, self.live, "STRATEGY_REPRICE")
                    self.live = None
                side = "BUY" if r.alpha > 0 else "SELL"
                oid = f"bt_{int(r.timestamp)}_{self.n}"
                if b.place(ts, oid, side, self.price(side, top[0], top[2]), self.size, r.alpha):
                    self.live, self.expires, self.n = oid, ts + self.lifetime, self.n + 1
        return b.drain()

    def close(self):
        b = self.broker
        if self.live is not None:
            b.cancel(self.ts, self.live, "SESSION_END")
        b.tell("REPORT", self.ts, qty=float(self.seen), price=float(self.early), reason=str(self.n))
        return b.drain()


def backtest(lines: DataFrame, by: list[str], threshold: float, size: float, lifetime_ms: int, warmup_ms: int, strategy: str = "improve_1_tick", **params) -> DataFrame:
    """Simulated events of a merged tape (line, timestamp, side, price, quantity, own, alpha)."""
    if strategy not in ("join_back", "improve_1_tick"):
        raise ValueError(f"unknown strategy {strategy!r}")
    cols = lines.select(*by, "line", "timestamp", "side", "price", "quantity", "own", F.coalesce("alpha", F.lit(NAN)).alias("alpha"))
    return ordered(cols, by, [F.col("line")], lambda: Strategy(threshold, size, lifetime_ms, warmup_ms, strategy, **params), SIM)


def backtest_report(events: DataFrame, by: list[str]) -> DataFrame:
    """Per group: quotes, fills, cancellations, fill rate, cash, inventory, profit at the last mid, edge in bps."""
    n = lambda e: F.count_if(F.col("event") == e)
    fill = F.col("event") == "FILL"
    last = F.max(F.when(F.col("event") == "REPORT", F.struct("mid", "inventory", "cash", "qty", "price")))
    per = events.groupBy(*by).agg(n("PLACE").alias("n_quotes"), n("PLACE_REJECT").alias("n_rejects"), n("FILL").alias("n_fills"), n("CANCEL").alias("n_cancels"), F.sum(F.when(fill, F.abs(F.col("price") * F.col("qty")))).alias("notional"), last.alias("_l"))
    mid = F.coalesce(F.nanvl(F.col("_l.mid"), F.lit(0.0)), F.lit(0.0))
    pnl = F.col("_l.cash") + F.col("_l.inventory") * mid
    return per.select(*by, "n_quotes", "n_rejects", "n_fills", "n_cancels", F.try_divide("n_fills", "n_quotes").alias("fill_rate"), F.col("_l.inventory").alias("inventory"), F.col("_l.cash").alias("cash"), pnl.alias("pnl"), F.when(F.col("notional") > 0, pnl / F.col("notional") * 1e4).alias("edge_bps"), F.col("_l.qty").cast("long").alias("n_predictions"), F.col("_l.price").cast("long").alias("n_early"))


def match_fills(pairs_of: DataFrame, by: list[str], tolerance_ms: float) -> DataFrame:
    """Greedy one-to-one matching of real and simulated fills (source 'real' or 'sim', ts_ns, client_oid, side, price).

    Real fills in time order take the nearest free simulated fill of their client id within the tolerance; what is
    left takes the nearest free one of the same side and price. One row per real fill: ts_ns, client_oid, sim_ts_ns.
    """
    tol = tolerance_ms * 1e6

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ns", "client_oid"], kind="stable")
        real, sim = (pdf[pdf["source"] == s] for s in ("real", "sim"))
        free = list(sim.itertuples(index=False))
        got: dict[int, int] = {}
        for same in (lambda r, s: s.client_oid == r.client_oid, lambda r, s: s.side == r.side and abs(s.price - r.price) <= 1e-6):
            for i, r in enumerate(real.itertuples(index=False)):
                fits = [s for s in free if i not in got and same(r, s) and abs(s.ts_ns - r.ts_ns) <= tol]
                if fits:
                    best = min(fits, key=lambda s: abs(s.ts_ns - r.ts_ns))
                    free.remove(best)
                    got[i] = best.ts_ns
        out = real[[*by, "ts_ns", "client_oid"]].copy()
        out["sim_ts_ns"] = pd.array([got.get(i) for i in range(len(real))], dtype="Int64")
        return out

    kinds = [f"{c} {pairs_of.schema[c].dataType.simpleString()}" for c in by]
    return pairs_of.select(*by, "source", "ts_ns", "client_oid", "side", "price").groupBy(*by).applyInPandas(run, ", ".join([*kinds, "ts_ns long, client_oid string, sim_ts_ns long"]))
