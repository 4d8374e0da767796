"""Roll-ups by partial sums, redaction in linear time, and files replaced in one step."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import nested
from ledgerlark.operators import aggregates, joins
from ledgerlark.sources import runs


def test_rollup_by_partial_sums_equals_the_direct_one(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([*aggregates.STATES, None] if i % 2 else list(aggregates.STATES)), rng.random() < 0.3, f"c{i}") for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, m string, verdict string, critical boolean, claim_id string")
    sets, names = [("k", "m"), ("k",), ("m",), ()], ["both", "k", "m", "all"]
    for f in (frame, frame.filter("verdict is not null"), frame.filter("not critical"), frame.limit(0)):
        want = aggregates.rollup(f, sets, aggregates.claim_counts(), names)
        got = aggregates.three_state_rollup(f, sets, names).select(*want.columns)
        # Without a row there are no groups, but for the whole, which has no claims.
        assert sorted(map(repr, got.fillna(0).collect())) == sorted(map(repr, want.fillna(0).collect()))


def test_redaction_takes_linear_time():
    def took(n):
        raw = "[" + ", ".join(['{"name": "v", "k": "w"}'] * n) + "]"
        began = time.perf_counter()
        assert nested.redacted_json(raw) == raw
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * took(10_000)


def test_a_document_is_written_without_secrets_and_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/d.json"
    runs.write_json(spark, path, {"a": {"api_key": {"x": 1}, "list": ["Bearer q.r", 1.5, None]}, "text": 'say "sk-abcdefghijklmnopqrstuv"\n'})
    assert spark.read.option("multiLine", True).json(path).select(F.col("a.api_key").alias("k"), F.col("a.list")[0].alias("b"), "text").first() == ("[REDACTED]", "Bearer [REDACTED]", 'say "[REDACTED]"\n')
    runs.write_json(spark, path, {"b": 2}, replace=True)
    assert runs.read_text(spark, path).split() == ["{", '"b":', "2", "}"]
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["d.json"]


def test_records_are_compared_whole(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.choice([1, 2, None]), rng.choice(["a", None]), [rng.choice([0.5, None])]) for _ in range(n)] + [(9, "hot", [])] * n
    left, right = make(60), make(12)
    schema = "x int, y string, z array<double>"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    key = lambda rows: collections.Counter(map(repr, rows))
    got = lambda f: key((r.x, r.y, r.z) for r in f.collect())
    assert got(joins.record_difference(a, b, every=False)) == key(left) - key(right)
    assert got(joins.record_difference(a, b)) == collections.Counter({k: n for k, n in key(left).items() if k not in key(right)})
    assert got(joins.record_difference(a, b.limit(0))) == key(left)
    assert joins.record_difference(a.limit(0), b).collect() == []
    with pytest.raises(ValueError, match="columns"):
        joins.record_difference(a, b.drop("z"))
