"""Streams over the events table, in several turns of arrival, with the SQL of their ends."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.queries import ORACLES, query
from ledgerlark.session import shared_dir, table
from ledgerlark.streaming import dedup, revisions, spans
from ledgerlark.streaming.publish import Published, as_they_come, publish

#: Turns of arrival; between two of them the stream stops and starts again.
TURNS = 3


@contextlib.contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """Session settings for the streams that are started inside."""
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _turn(spark: SparkSession, sf: str) -> Column:
    """The turn in which an event arrives: by its number, in equal shares."""
    n = table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    return F.expr(f"cast(event_id * {TURNS} div {n + 1} as int)")


def in_turns(frame: DataFrame, turn: Column, go: Callable[[DataFrame, str], object]) -> object:
    """Writes the rows of each turn to a folder and lets ``go`` read the folder as a stream, to its end, after each; the last result."""
    spark = frame.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = None
    with settings(spark, spans.STORE):
        for k in range(TURNS):
            frame.filter(turn == k).write.mode("append").parquet(f"{folder}/in")
            out = go(spark.readStream.schema(frame.schema).parquet(f"{folder}/in"), folder)
    return out


@query(ORACLES["span_pairing"])
def span_pairing_stream(spark, sf):
    """Spans that the stream has closed and those that its state still holds at the end."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    names = ("signup", "purchase", "error")

    def go(stream: DataFrame, folder: str) -> DataFrame:
        publish(spans.pair_spans(stream, "user_id", "event_type", "ts", "event_id", *names, "2 days"), f"{folder}/spans", as_they_come)
        done = Published(spark, f"{folder}/spans").read("rows", spark.createDataFrame([], spans.SPAN).schema)
        return done.drop("batch").unionByName(spans.still_open(spark, f"{folder}/spans/checkpoint", *names))

    return in_turns(events, _turn(spark, sf), go)


#: Every third event is delivered again in its turn, every ninth of them in the next one; every 40th comes ten days late.
_COPIES = f"""n AS (SELECT coalesce(max(event_id), 0) + 1 AS n FROM events),
copies AS (SELECT event_id, user_id, c, least({TURNS - 1}, event_id * {TURNS} // n + CASE WHEN c = 1 AND event_id % 9 = 0 THEN 1 ELSE 0 END) AS turn,
    ts - CASE WHEN event_id % 40 = 7 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END + c * INTERVAL 1 MINUTE AS ts FROM events, n, (VALUES (0), (1)) v(c) WHERE c = 0 OR event_id % 3 = 0),
marks AS (SELECT turn, max(epoch_us(ts)) AS top FROM copies GROUP BY turn),
mark AS (SELECT t.turn, max(m.top) // 1000 * 1000 - 2 * 86400000000 AS mark FROM (SELECT DISTINCT turn FROM copies) t LEFT JOIN marks m ON m.turn < t.turn GROUP BY t.turn),
judged AS (SELECT c.*, coalesce(epoch_us(ts) <= mark, false) AS late FROM copies c JOIN mark USING (turn))"""


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    c = F.col("c")
    each = events.select("*", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("c"))
    days = F.when(F.col("event_id") % 40 == 7, 10).otherwise(0)
    moved = F.expr("ts - make_dt_interval(__d) + make_dt_interval(0, 0, c)")
    turn = F.least(F.lit(TURNS - 1), _turn(spark, sf) + ((c == 1) & (F.col("event_id") % 9 == 0)).cast("int"))
    return each.withColumn("__d", days).withColumn("turn", turn).withColumn("ts", moved.cast("timestamp")).drop("__d")


@query(f"""WITH {_COPIES}
SELECT event_id, user_id, 'unique' AS verdict, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM judged WHERE NOT late) GROUP BY ALL
UNION ALL SELECT event_id, user_id, 'late', count(*) FROM judged WHERE late GROUP BY ALL""")
def event_dedup_stream(spark, sf):
    """Unique events and late ones of a stream with repeated deliveries."""
    copies = _copies(spark, sf)
    unique, late = in_turns(copies, F.col("turn"), lambda stream, folder: dedup.deduplicate(stream, ["event_id"], "ts", "2 days", f"{folder}/dedup"))
    count = lambda f, verdict: f.groupBy("event_id", "user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("verdict", F.lit(verdict))
    return count(unique, "unique").unionByName(count(late, "late"))


@query(f"""WITH {_COPIES},
ordered AS (SELECT user_id::VARCHAR AS chain, event_id AS revision, epoch_us(ts) AS at_us, row_number() OVER w AS number, lag(event_id) OVER w AS previous,
    epoch_us(ts) < max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY turn, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM copies WHERE c = 0 WINDOW w AS (PARTITION BY user_id ORDER BY turn, ts, event_id))
SELECT chain, number, revision, previous, at_us, coalesce(late, false) AS late FROM ordered""")
def revision_chain_stream(spark, sf):
    """Late revisions at the end of their chains, published once although the stream stops and starts between its turns."""
    first = _copies(spark, sf).filter("c = 0")

    def go(stream: DataFrame, folder: str) -> DataFrame:
        publish(revisions.append_revisions(stream, "user_id", "event_id", "ts"), f"{folder}/chains", as_they_come)
        return Published(spark, f"{folder}/chains").read("rows", spark.createDataFrame([], revisions.LINK).schema).drop("batch")

    return in_turns(first, F.col("turn"), go)
