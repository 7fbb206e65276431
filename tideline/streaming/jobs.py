"""Structured Streaming forms of the recurring jobs. Each equals its batch twin on the same data."""
from __future__ import annotations

import bisect
import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline import schemas
from tideline.session import shared_dir
from tideline.sources import sinks

# the processors travel by value: the streaming runner does not see files added to the session
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_stream(spark: SparkSession, directory: str, glob: str = "events.parquet", max_files: int = 64) -> DataFrame:
    """``max_files`` bounds a micro-batch, and with it what a stateful key handles at once."""
    d = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(directory)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant; the session is UTC


def replay(rows: DataFrame, arrival: Column, path: str, first: int, last: int, files: int = 1) -> None:
    """Writes the rows in the order of their arrival number, `files` files for each number from `first` to `last`, so
    that a stream with as many files a trigger sees one micro-batch for each number."""
    for k in range(first, last + 1):
        rows.where(arrival == k).coalesce(files).write.mode("append").parquet(path)


def drain(stream: DataFrame, mode: str = "append", name: str = "out", base: str | None = None) -> DataFrame:
    """Runs the stream over everything available into Parquet and reads the result. A second run on the same `base`
    goes on from its checkpoint."""
    base = base or f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/data")


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], name: str = "each", mode: str = "update") -> None:
    base = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (stream.writeStream.foreachBatch(each).option("checkpointLocation", base).outputMode(mode).trigger(availableNow=True).start()).awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def candles(stream: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Fixed or sliding buckets, emitted once the watermark has closed them."""
    at = F.struct("ts", "event_id")
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("event_type").alias("symbol"), F.col("w.start").cast("timestamp_ntz").alias("ts"), F.col("w.end").cast("timestamp_ntz").alias("ts_end"), "open", "high", "low", "close", "n", "total")


def totals(stream: DataFrame, width: str, delay: str, slide: str) -> DataFrame:
    """Count and sum of overlapping buckets, emitted once the watermark has closed them. Both are numbers of fixed size, so
    a task folds the copies of its rows into one entry a bucket and sorts nothing."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("event_type").alias("symbol"), F.col("w.start").cast("timestamp_ntz").alias("ts"), F.col("w.end").cast("timestamp_ntz").alias("ts_end"), "n", "total")


def late_upsert(stream: DataFrame, table: str, keys: list[str], version: str, partition: list[str], recompute: Callable[[DataFrame], DataFrame]) -> None:
    """Each micro-batch recomputes the rows its keys affect and replaces them by key."""

    def each(batch: DataFrame, _id: int) -> None:
        sinks.upsert(recompute(batch), table, keys, version, partition)

    drain_batches(stream, each, "late", "append")


def sessions(stream: DataFrame, keys: list[str], gap: str | Column, delay: str) -> DataFrame:
    """Runs of rows of a key that lie less than `gap` apart (a column may set it per row). Open sessions are merged in
    the state across micro-batches, late rows within `delay` may join two of them, and a session is emitted once the
    watermark is past its end. Rows of a task are merged before the shuffle, so a frequent key sends its sessions only."""
    stream.sparkSession.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", delay).groupBy(*keys, w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts")).drop("w")


MICROS = 1_000_000


class Outcomes(StatefulProcessor):
    """One outcome for every signal: the first price at or after its target time, within the tolerance; null if there is
    none. A key holds a bucket of target times. Its signals and prices wait in list states; an event-time timer behind
    the bucket settles them all at once, when no earlier row can come any more, so late rows change nothing."""

    columns = ["symbol", "event_id", "out_id", "out_value"]

    def __init__(self, bucket_s: int, tolerance_s: int):
        self.bucket_s, self.tolerance_s = bucket_s, tolerance_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signals = handle.getListState("signals", "at long, event_id long")
        self.prices = handle.getListState("prices", "at long, event_id long, value double")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for kind, state, columns in (("signal", self.signals, ["at", "event_id"]), ("price", self.prices, ["at", "event_id", "value"])):
                own = pdf.loc[pdf["kind"] == kind, columns]
                if len(own):
                    state.appendList(list(own.itertuples(index=False, name=None)))
        self.handle.registerTimer((int(key[1]) + self.bucket_s + self.tolerance_s) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        prices = sorted(tuple(p) for p in self.prices.get()) if self.prices.exists() else []
        at, out = [p[0] for p in prices], []
        for target, event_id in self.signals.get() if self.signals.exists() else ():
            k = bisect.bisect_left(at, target)
            found = k < len(at) and at[k] < target + self.tolerance_s * MICROS
            out.append((key[0], event_id, prices[k][1] if found else None, prices[k][2] if found else None))
        self.signals.clear()
        self.prices.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns).astype({"out_id": "Int64", "out_value": "Float64"})

    def close(self) -> None:
        pass


def outcomes(stream: DataFrame, hours: int, delay: str, tolerance_s: int = 3600, bucket_s: int = 6 * 3600) -> DataFrame:
    """(symbol, event_id, out_id, out_value): every row's value `hours` later, once that time has passed.

    A row is a signal for the bucket of its target time and a price for its own bucket, and also for the bucket before,
    if it is within reach of a target there. Keys are (symbol, bucket): a frequent symbol is spread over its buckets,
    and the state of a bucket goes when it is settled."""
    micros = F.unix_micros("ts")
    bucket = lambda at: F.floor(at / F.lit(bucket_s * MICROS)) * bucket_s
    parts = [F.struct(F.lit("signal").alias("kind"), bucket(micros + hours * 3600 * MICROS).alias("bucket"), (micros + hours * 3600 * MICROS).alias("at")),
             F.struct(F.lit("price").alias("kind"), bucket(micros).alias("bucket"), micros.alias("at")),
             F.struct(F.when(bucket(micros - tolerance_s * MICROS) < bucket(micros), "price").alias("kind"), (bucket(micros) - bucket_s).alias("bucket"), micros.alias("at"))]
    rows = stream.withWatermark("ts", delay).select("symbol", "ts", "event_id", "value", F.explode(F.array(*parts)).alias("x")).select("symbol", "ts", "event_id", "value", "x.*").where("kind is not null")
    return rows.groupBy("symbol", "bucket").transformWithStateInPandas(Outcomes(bucket_s, tolerance_s), "symbol string, event_id long, out_id long, out_value double", "Append", "eventTime")


class _Ordered(StatefulProcessor):
    """Handles rows in time order whatever the micro-batch they come in: rows wait in a list state until an
    event-time timer, at the end of their hour, says that no earlier one can come. A key needs one timer, for its earliest
    hour: it handles all hours that have ended by then at once. A key holds many books, and its rows wait as a few packed
    arrays: a call of the state costs as much as thousands of rows."""

    columns_in = ["book", "at", "event_id", "asset", "value"]
    step_ms = 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def due(self, at):
        return (at // 1000 // self.step_ms + 1) * self.step_ms

    def handleInputRows(self, key, rows, timerValues):
        packed, earliest = [], []
        for pdf in rows:
            pdf = pdf if "book" in pdf else pdf.assign(book=key[0])  # a key of one book
            if len(pdf):
                packed.append((pickle.dumps([pdf[c].to_numpy() for c in self.columns_in]),))
                earliest.append(int(pdf["at"].min()))
        if packed:
            self.waiting.appendList(packed)
            self.handle.registerTimer(self.due(min(earliest)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        parts = [pickle.loads(x) for (x,) in self.waiting.get()] if self.waiting.exists() else []
        if not parts:
            return
        book, at, event_id, asset, value = rows = [np.concatenate(x) for x in zip(*parts)]
        ready = self.due(at) <= now
        if not ready.all():
            if ready.any():
                self.waiting.put([(pickle.dumps([x[~ready] for x in rows]),)])
            self.handle.registerTimer(self.due(int(at[~ready].min())))
        else:
            self.waiting.clear()
        if not ready.any():
            return
        order = np.lexsort((value, pd.factorize(asset, sort=True)[0], event_id, at, book))
        order = order[ready[order]]
        out = list(self.steps(*(x[order] for x in rows)))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def steps(self, book, at, event_id, asset, value) -> Iterator[tuple]:
        """What the rows, ordered by book and time, make; the state is read and written once."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class GridRebalance(_Ordered):
    """First row of each period rebalances the book to equal weights of all assets seen; a missed grid day is caught up,
    never re-anchored. The state holds of each book its last period and of each of its assets the last price and, since the last
    rebalance, its weight and price then; the turnover is measured against the weights as they have drifted."""

    columns = ["book", "event_id", "period", "catch_up", "assets", "turnover"]

    def __init__(self, anchor: str, days: int = 7):
        self.anchor, self.days = pd.Timestamp(anchor).value // 86_400_000_000_000, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.books = handle.getValueState("books", "held binary")

    def steps(self, book, at, event_id, asset, value):
        books = pickle.loads(self.books.get()[0]) if self.books.exists() else {}
        days = at // (86_400 * MICROS) - self.anchor
        first = np.flatnonzero(np.concatenate([[True], book[1:] != book[:-1]]))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(book)]):
            own = book[lo].item()
            last, held = books.get(own, (None, {}))
            for k, day, price, name in zip(range(lo, hi), days[lo:hi].tolist(), value[lo:hi].tolist(), asset[lo:hi]):
                weight, base = held[name][1:] if name in held else (0.0, price)
                held[name] = (price, weight, base)
                period = day // self.days
                if last is not None and period <= last:
                    continue
                drift = {k: w * now / b for k, (now, w, b) in held.items()}
                total = sum(drift.values()) or 1.0
                target = 1.0 / len(held)
                turnover = sum(abs(target - d / total) for d in drift.values())
                held = {k: (now, target, now) for k, (now, _, _) in held.items()}
                last = period
                yield own, event_id[k].item(), period, day % self.days != 0, len(held), turnover
            books[own] = (last, held)
        self.books.update((pickle.dumps(books),))


#: Keys that the books of a stream are dealt to.
BOOK_KEYS = 1024


def rebalances(stream: DataFrame, anchor: str, delay: str, days: int = 7) -> DataFrame:
    """stream(book, ts, event_id, asset, value) as one row for each rebalance of a book. Rows without a book or time make none."""
    d = stream.where("book is not null and ts is not null").withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).withColumn("part", F.pmod(F.xxhash64("book"), F.lit(BOOK_KEYS)).cast("int"))
    return d.groupBy("part").transformWithStateInPandas(GridRebalance(anchor, days), "book long, event_id long, period long, catch_up boolean, assets long, turnover double", "Append", "eventTime")


class Staleness(StatefulProcessor):
    """A hold row for every entry that no other one follows within the limit. With event-time timers the entries of the
    last `limit` wait in a list state, so that entries of one micro-batch and late ones are judged by their own times; a
    key's timer stands for its earliest entry and judges all that are due by then.
    With processing-time timers the clock of the cluster counts: the newest entry holds unless another one has come by
    then, and the row appears without any new input."""

    columns = ["symbol", "newest", "hold_from"]

    def __init__(self, limit_s: int, by_clock: bool):
        self.limit_s, self.by_clock = limit_s, by_clock

    def due(self, at: int) -> int:
        return -(-at // 1000) + self.limit_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "at long")

    def handleInputRows(self, key, rows, timerValues):
        new = sorted({int(x) for pdf in rows for x in pdf["at"]})
        if self.by_clock:
            seen = max([x for (x,) in self.entries.get()], default=new[-1]) if self.entries.exists() else new[-1]
            self.entries.put([(max(seen, new[-1]),)])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit_s * 1000)
        else:
            self.entries.appendList([(x,) for x in new])
            self.handle.registerTimer(self.due(new[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = sorted(x for (x,) in self.entries.get()) if self.entries.exists() else []
        out = []
        if self.by_clock:
            out = [(held[-1], held[-1] + self.limit_s * MICROS)] if held else []
        else:
            held = sorted(set(held))
            now, limit = timerValues.getCurrentWatermarkInMs(), self.limit_s * MICROS
            ready = [x for x in held if self.due(x) <= now]
            out = [(x, x + limit) for x, y in zip(ready, [*held[1:], None]) if y is None or y > x + limit]
            later = held[len(ready):]
            if later:
                if ready:
                    self.entries.put([(x,) for x in later])
                self.handle.registerTimer(self.due(later[0]))
            else:
                self.entries.clear()
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=self.columns)

    def close(self) -> None:
        pass


def holds(stream: DataFrame, limit_s: int, delay: str, by_clock: bool = False) -> DataFrame:
    """stream(symbol, ts) as (symbol, newest, hold_from): from when on a symbol holds, as its newest entry is too old."""
    d = stream.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    found = d.groupBy("symbol").transformWithStateInPandas(Staleness(limit_s, by_clock), "symbol string, newest long, hold_from long", "Append", "processingTime" if by_clock else "eventTime")
    return found.select("symbol", *(F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("newest", "hold_from")))


class _Keyed(StatefulProcessor):
    """One value state per key; rows of a micro-batch are handled in time order. Of a key's rows only three numbers each
    are held at once; their results leave in parts."""

    schema = "x double"
    part_rows = 8192

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, key, row) -> tuple[tuple, tuple | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        parts = [(pdf["ts"].to_numpy("datetime64[ns]").copy(), pdf["event_id"].to_numpy("int64").copy(), pdf["value"].to_numpy("float64").copy()) for pdf in rows]
        at, ident, value = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((ident, at))
        state = tuple(self.state.get()) if self.state.exists() else self.start()
        for k in range(0, len(order), self.part_rows):
            part = order[k:k + self.part_rows]
            out = []
            for row in pd.DataFrame({"ts": at[part], "event_id": ident[part], "value": value[part]}).itertuples(index=False):
                state, emit = self.step(state, key, row)
                if emit is not None:
                    out.append(emit)
            yield pd.DataFrame(out, columns=self.columns)
        self.state.update(state)

    def close(self) -> None:
        pass


class EwmaVariance(_Keyed):
    """v = lam*v + (1-lam)*x^2 from the last of the first 20 values on, seeded by their population variance; null before.
    The state holds the seed's count, sum and sum of squares."""

    schema, columns = "v double, n long, s double, q double", ["symbol", "event_id", "v"]
    seed_rows = 20

    def start(self):
        return (0.0, 0, 0.0, 0.0)

    def step(self, state, key, row):
        v, n, s, q = state
        n, x = n + 1, row.value
        if n <= self.seed_rows:
            s, q = s + x, q + x * x
            v = q / n - (s / n) ** 2
        if n >= self.seed_rows:
            v = 0.94 * v + 0.06 * x * x
        return (v, n, s, q), (key[0], row.event_id, v if n >= self.seed_rows else None)


class RunningSpend(_Keyed):
    """Running sum per key and calendar month against a cap; a new month starts from 0."""

    schema, columns = "s double, month long", ["symbol", "event_id", "spent", "braked"]
    cap = 5000.0

    def start(self):
        return (0.0, 0)

    def step(self, state, key, row):
        month = row.ts.year * 12 + row.ts.month
        s = (state[0] if state[1] == month else 0.0) + row.value
        return (s, month), (key[0], row.event_id, s, s > self.cap)


class DrawdownAlert(_Keyed):
    """Alert when the value stands 3 % or more below its peak, at most one per UTC day."""

    schema, columns = "peak double, day string", ["symbol", "event_id", "drop"]

    def start(self):
        return (0.0, "")

    def step(self, state, key, row):
        value = row.value + 1000
        peak = max(state[0], value)
        day = str(row.ts)[:10]
        if value / peak - 1 <= -0.03 and day != state[1]:
            return (peak, day), (key[0], row.event_id, value / peak - 1)
        return (peak, state[1]), None


def keyed(stream: DataFrame, processor: _Keyed, schema: str, delay: str = "1 hour") -> DataFrame:
    d = stream.select(F.col("event_type").alias("symbol"), "ts", "event_id", "value").withWatermark("ts", delay)
    return d.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "None")


def stale(entries: DataFrame, now, days: int = 2) -> DataFrame:
    """Hold flag per key when its newest entry is older than the limit."""
    return entries.groupBy("symbol").agg(F.max("ts").alias("newest")).withColumn("hold", F.col("newest") < now - F.expr(f"interval {days} days"))
