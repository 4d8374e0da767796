"""Dedup of a stream over keyed state, with late rows kept in a table of their own.

Spark drops rows behind the watermark without a word.  So a first stream parts
them: a row is late if its time is not after the latest time of earlier batches less
``delay`` (the rule of Spark's own watermark).  The rest is published, and a second
stream over it keeps the first row of each key with ``dropDuplicatesWithinWatermark``.
That stream's watermark is never ahead of the first one's, as its batches hold whole
batches of the first, so it drops nothing on its part.

Results: a key seen again within ``delay`` of its first row's time is a repeat and goes; a later one counts as new; a
null key is a key; a row without a time is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.streaming.publish import Notes, Published, as_they_come, micros, publish


def split_late(stream: DataFrame, at: str, delay: str, folder: str) -> Published:
    """Publishes the tables ``ontime`` and ``late`` of a stream."""
    spark = stream.sparkSession
    wait = spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {delay})")).first()[0]

    def work(frame: DataFrame, notes: Notes) -> tuple[dict[str, DataFrame], Notes]:
        seen = notes.get("latest")
        # Spark's watermark has whole milliseconds.
        mark = None if seen is None else (seen // 1000 - wait // 1000) * 1000
        late = micros(at).isNull() if mark is None else F.coalesce(micros(at) <= mark, F.lit(True))
        newest = frame.agg(F.max(micros(at))).first()[0]
        latest = max((x for x in (seen, newest) if x is not None), default=None)
        return {"ontime": frame.filter(~late), "late": frame.filter(late)}, {"latest": latest}

    publish(stream, folder, work)
    return Published(spark, folder)


def first_within(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key, by state that lasts ``delay``."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def published_stream(spark: SparkSession, done: Published, name: str, schema) -> DataFrame:
    """The published table as a stream; unpublished attempts lie elsewhere."""
    return spark.readStream.schema(schema).parquet(f"{done.folder}/data/{name}")


def deduplicate(stream: DataFrame, keys: list[str], at: str, delay: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Unique rows and late rows of all input so far; call it again when more has come."""
    spark, schema, folder = stream.sparkSession, stream.schema, folder.rstrip("/")
    parted = split_late(stream, at, delay, f"{folder}/parted")
    late = parted.read("late", schema)
    if parted.batches():
        publish(first_within(published_stream(spark, parted, "ontime", schema), keys, at, delay), f"{folder}/unique", as_they_come)
    return Published(spark, f"{folder}/unique").read("rows", schema), late
