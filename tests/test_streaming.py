"""Streams: restarts, crashes, late rows, and what the state holds at the end."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from ledgerlark.stream_queries import settings
from ledgerlark.streaming import dedup, publish, revisions, spans
from ledgerlark.streaming.publish import Published, as_they_come

SCHEMA = "k string, kind string, t timestamp, o long"
NAMES = ("start", "end", "retry")


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    with settings(spark, spans.STORE | {"spark.sql.shuffle.partitions": "2"}):
        yield


def feed(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_spans_by_time_across_restarts(spark, tmp_path):
    """Rows come out of order; the stream stops and goes on; nothing stays in the state unseen."""
    folder = f"file://{tmp_path}"

    def turn(rows):
        stream = feed(spark, folder, rows)
        publish.publish(spans.pair_spans(stream, "k", "kind", "t", "o", *NAMES, "10 minutes"), f"{folder}/out", as_they_come)
        done = Published(spark, f"{folder}/out").read("rows", spark.createDataFrame([], spans.SPAN).schema)
        left = spans.still_open(spark, f"{folder}/out/checkpoint", *NAMES)
        row = lambda r: (r.key, r.started and (r.started - at(0)).seconds // 60, r.ended and (r.ended - at(0)).seconds // 60, r.retries, r.status)
        return sorted(map(row, done.collect()), key=str), sorted(map(row, left.collect()), key=str)

    first = [("a", "end", at(5), 3), ("a", "start", at(1), 1), ("a", "retry", at(2), 2), ("b", "start", at(20), 4), ("a", "end", at(7), 5)]
    done, left = turn(first)
    assert sorted(done + left, key=str) == [("a", 1, 5, 1, "succeeded"), ("b", 20, None, 0, "failed")]
    # Before the time of the last turn's rows, but not late.
    done, left = turn([("b", "retry", at(25), 7), ("a", "start", at(15), 6), ("c", "end", at(60), 8)])
    assert sorted(done + left, key=str) == [("a", 1, 5, 1, "succeeded"), ("a", 15, None, 0, "failed"), ("b", 20, None, 1, "failed")]
    done, left = turn([("b", "end", at(61), 9), ("c", "start", at(62), 10)])
    assert sorted(done + left, key=str) == [("a", 1, 5, 1, "succeeded"), ("a", 15, None, 0, "failed"), ("b", 20, 61, 1, "succeeded"), ("c", 62, None, 0, "failed")]


def test_a_key_is_read_and_written_once_a_call():
    """Each call of the state is a message to the JVM: with many keys they are what a stream takes its time for."""

    class Store:
        def __init__(self):
            self.value, self.timers, self.calls = None, set(), []

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name in ("get", "exists"):
                    return self.value if name == "get" else self.value is not None
                if name in ("update", "clear"):
                    self.value = args[0] if args else None
                elif name == "registerTimer":
                    self.timers.add(args[0])
                elif name == "deleteTimer":
                    self.timers.discard(args[0])
                return self

            return call

    store, pairing = Store(), spans.Pairing(*NAMES)
    pairing.init(store)

    def advance(events, mark):
        store.calls.clear()
        rows = [(r.status, r.retries) for r in pairing._advance(("k",), events, mark)]
        return rows, sorted(store.calls), store.timers

    assert advance([(5_000_500, 2, "retry"), (1_000_000, 1, "start")], 0) == ([], ["get", "registerTimer", "update"], {5001})
    assert advance([(4_000_000, 3, "retry")], 1000) == ([], ["get", "update"], {5001})
    assert advance([(9_000_000, 4, "end")], 2000) == ([], ["deleteTimer", "get", "registerTimer", "update"], {9000})
    assert advance([], 9000) == ([("succeeded", 2)], ["clear", "deleteTimer", "get"], set())


@pytest.mark.parametrize("where", ["before the rename", "before the manifest"])
def test_a_killed_batch_is_published_once(spark, tmp_path, monkeypatch, where):
    folder, schema = f"file://{tmp_path}", "k string, n long"
    stream = feed(spark, folder, [("a", 1), ("b", 2)], schema)

    def killed(*_, **__):
        raise RuntimeError("killed")

    def work(frame, notes):
        return {"rows": frame}, {"sum": notes.get("sum", 0) + sum(r.n for r in frame.collect())}

    target = (Published, "_at") if where == "before the rename" else (publish, "write_text")
    real, calls = getattr(*target), []

    def some(self, *args):
        calls.append(args)
        return killed() if where == "before the manifest" or args[0].startswith("attempts/") else real(self, *args)

    monkeypatch.setattr(*target, some)
    with pytest.raises(StreamingQueryException):
        publish.publish(stream, f"{folder}/out", work)
    monkeypatch.undo()
    assert calls
    done = Published(spark, f"{folder}/out")
    assert done.read("rows", stream.schema).collect() == []
    publish.publish(stream, f"{folder}/out", work)
    publish.publish(feed(spark, folder, [("c", 5)], schema), f"{folder}/out", work)
    rows = done.read("rows", stream.schema).collect()
    assert sorted((r.k, r.n) for r in rows) == [("a", 1), ("b", 2), ("c", 5)]
    assert done.notes(99) == {"sum": 8}
    # A batch that comes again is no new one.
    assert not done.put(done.batches()[0], {"rows": spark.createDataFrame([("x", 9)], schema)}, {})
    assert done.read("rows", stream.schema).count() == 3


def test_repeats_go_and_late_rows_are_kept_apart(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "k long, t timestamp"

    def turn(rows):
        unique, late = dedup.deduplicate(feed(spark, folder, rows, schema), ["k"], "t", "10 minutes", f"{folder}/d")
        return sorted((r.k is None, r.k or 0) for r in unique.collect()), [(r.k, (r.t - at(0)).seconds // 60 if r.t else None) for r in late.collect()]

    assert turn([(1, at(0)), (1, at(3)), (None, at(4)), (None, at(4)), (2, at(60)), (5, None)]) == ([(False, 1), (False, 2), (True, 0)], [(5, None)])
    # 2 is a repeat, 3 is new, 4 is behind the watermark (minute 50), 1 is long forgotten.
    unique, late = turn([(2, at(61)), (3, at(51)), (4, at(50)), (1, at(70))])
    assert unique == [(False, 1), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert sorted(late, key=str) == [(4, 50), (5, None)]


def test_revisions_are_linked_in_the_order_they_come(spark, tmp_path):
    folder, schema = f"file://{tmp_path}", "c string, r long, t timestamp"

    def turn(rows):
        publish.publish(revisions.append_revisions(feed(spark, folder, rows, schema), "c", "r", "t"), f"{folder}/out", as_they_come)
        done = Published(spark, f"{folder}/out").read("rows", spark.createDataFrame([], revisions.LINK).schema)
        return sorted((r.chain, r.number, r.revision, r.previous, r.late) for r in done.collect())

    assert turn([("a", 2, at(2)), ("a", 1, at(1)), ("b", 3, at(9))]) == [("a", 1, 1, None, False), ("a", 2, 2, 1, False), ("b", 1, 3, None, False)]
    assert turn([("a", 4, at(0)), ("b", 5, at(9)), ("a", 6, at(3))])[2:4] + turn([])[4:] == [("a", 3, 4, 2, True), ("a", 4, 6, 4, False), ("b", 1, 3, None, False), ("b", 2, 5, 3, False)]
