"""Keyed start/end pairing over an event stream, and its batch twin.

The stream keeps for each key the events that the watermark has not passed yet and
the span that is open.  Events are paired in the order of their times, not of
their arrival: a timer fires when the watermark passes the last one kept.  Spans that are still
open when the input ends, and events that no watermark has passed, are read
from the state (:func:`still_open`), so nothing stays inside; the state itself
stays as it is and the stream can go on.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SPAN = "key string, started timestamp, ended timestamp, retries int, status string"
#: All that is held of a key: the open span, the time of its timer, and the kept events as JSON, [at, o, kind] each.
HELD = "started long, o long, retries int, due long, kept string"
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
#: What the state of the stream is kept in: transformWithState needs it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Pairing(StatefulProcessor):
    """Start, retries and end of each key, in the order of (time, order, kind)."""

    def __init__(self, start: str, end: str, retry: str):
        self.start, self.end, self.retry = start, end, retry

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", HELD)

    def _advance(self, key, events: list[tuple], mark: int) -> Iterator[Row]:
        """Pairs the events up to the watermark ``mark`` (milliseconds) and keeps the others.

        Each call of the state is a message to the JVM, so one reads and one writes all of a key.
        """
        was = self.held.get()
        started, o, retries, due, kept = was or (None,) * 5
        span = None if started is None else (started, o, retries)
        events += map(tuple, json.loads(kept or "[]"))
        ready = sorted(e for e in events if e[0] <= mark * 1000)
        rest = [e for e in events if e[0] > mark * 1000]
        for at, o, kind in ready:
            if kind == self.start:
                if span:
                    yield self._row(key, span, None, "failed")
                span = (at, o, 0)
            elif span and kind == self.retry:
                span = (span[0], span[1], span[2] + 1)
            elif span and kind == self.end:
                yield self._row(key, span, at, "succeeded")
                span = None
        # One timer a key: when it fires, the watermark has passed all that is kept.
        then = -(-max(e[0] for e in rest) // 1000) if rest else None
        if then != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if then is not None:
                self.handle.registerTimer(then)
        now = (*(span or (None,) * 3), then, json.dumps(rest) if rest else None) if span or rest else None
        if now is None and was is not None:
            self.held.clear()
        elif now != was:
            self.held.update(now)

    @staticmethod
    def _row(key, span, ended, status) -> Row:
        moment = lambda us: None if us is None else EPOCH + datetime.timedelta(microseconds=us)
        return Row(key=key[0], started=moment(span[0]), ended=moment(ended), retries=span[2], status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parts = (r.event.split(" ", 2) for r in rows)
        yield from self._advance(key, [(int(us), int(o), kind) for us, o, kind in parts], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def pair_spans(events: DataFrame, key: str, kind: str, at: str, order: str, start: str, end: str, retry: str, delay: str = "1 hour") -> DataFrame:
    """Spans that a stream has closed: by an end, or failed by the next start.  Events later than ``delay`` are late (:mod:`dedup` parts them)."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(kind).alias("kind"), F.col(at).cast("timestamp").alias("at"), F.col(order).cast("long").alias("o"))
    # Python takes rows value by value, so an event is one value beside the time that tells whether it is late.
    event = F.concat_ws(" ", F.unix_micros("at"), "o", "kind").alias("event")
    rows = rows.filter(F.col("kind").isin(start, end, retry)).select("key", "at", event).withWatermark("at", delay)
    return rows.groupBy("key").transformWithState(Pairing(start, end, retry), SPAN, "append", "eventTime")


def still_open(spark: SparkSession, checkpoint: str, start: str, end: str, retry: str) -> DataFrame:
    """The spans that the state of an ended stream still holds, its kept events paired as a table's are."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load().select("key.key", "value.*")
    opened = held.filter("started is not null").select("key", F.timestamp_micros("started").alias("at"), "o", F.lit(start).alias("kind"), F.col("retries").alias("before"))
    e = F.explode(F.from_json("kept", "array<array<string>>")).alias("e")
    kept = held.select("key", e).select("key", F.timestamp_micros(F.col("e")[0].cast("long")).alias("at"), F.col("e")[1].cast("long").alias("o"), F.col("e")[2].alias("kind"))
    rest = spans(kept.unionByName(opened.drop("before")), "key", "kind", "at", "o", start, end, retry)
    first = opened.select(F.col("key").alias("k"), F.col("at").alias("a"), "before")
    joined = rest.join(first, (F.col("key") == F.col("k")) & (F.col("started") == F.col("a")), "left")
    return joined.select("key", "started", "ended", (F.col("retries") + F.coalesce("before", F.lit(0))).cast("int").alias("retries"), "status")


def spans(events: DataFrame, key: str, kind: str, at: str, order: str, start: str, end: str, retry: str) -> DataFrame:
    """The same of a table, in windows: each start opens a span that the first end before the next start closes."""
    w = Window.partitionBy("key").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    e = events.select(F.col(key).cast("string").alias("key"), F.col(kind).alias("kind"), F.col(at).alias("at"), F.col(order).alias("o")).filter(F.col("kind").isin(start, end, retry))
    e = e.withColumn("n", F.sum((F.col("kind") == start).cast("int")).over(w)).filter("n > 0")
    ended = F.min(F.when(F.col("kind") == end, F.struct("at", "o")))
    per = e.groupBy("key", "n").agg(F.min(F.when(F.col("kind") == start, F.col("at"))).alias("started"), ended.alias("e"), F.collect_list(F.when(F.col("kind") == retry, F.struct("at", "o"))).alias("r"))
    retries = F.size(F.filter("r", lambda x: F.col("e").isNull() | (x < F.col("e"))))
    return per.select("key", "started", F.col("e.at").alias("ended"), retries.alias("retries"), F.when(F.col("e").isNull(), "failed").otherwise("succeeded").alias("status"))


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows with a watermark; works on streams and tables."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
