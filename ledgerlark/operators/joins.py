"""Joins with the semantics that plain equality does not give."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.session import cut

#: Rows of a side that may be broadcast, after they have been counted.
BROADCAST_ROWS = 200_000


def sized(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` with a broadcast hint if it has few rows (one look at the first ``most``)."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def pair(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join in which null keys are equal; pair_status tells the unpaired."""
    a = before.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(v).alias(f"before_{v}") for v in values], F.lit(True).alias("__a"))
    b = after.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(v).alias(f"after_{v}") for v in values], F.lit(True).alias("__b"))
    on = reduce(Column.__and__, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    status = F.when(F.col("__a") & F.col("__b"), "paired").otherwise("unpaired")
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], *[f"{s}_{v}" for v in values for s in ("before", "after")], status.alias("pair_status"))


def set_gap(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key the items of either side that the other lacks, those that repeat, and whether the sets are equal.

    Columns: missing (only left), extra (only right), repeated (more than once on a side), same.
    """
    count = lambda f, c: f.groupBy(*keys, item).agg(F.count(F.lit(1)).alias(c))
    both = count(left, "__l").join(count(right, "__r"), [*keys, item], "full_outer").fillna(0, ["__l", "__r"])
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(item))))
    out = both.groupBy(*keys).agg(some(F.col("__r") == 0).alias("missing"), some(F.col("__l") == 0).alias("extra"), some((F.col("__l") > 1) | (F.col("__r") > 1)).alias("repeated"))
    return out.withColumn("same", (F.size("missing") == 0) & (F.size("extra") == 0) & (F.size("repeated") == 0))


def by_member(left: DataFrame, array: str, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Each left row with the right rows whose key its array has (each member once)."""
    each = left.withColumn("__m", F.explode(F.array_distinct(array))) if how == "inner" else left.withColumn("__m", F.explode_outer(F.array_distinct(array)))
    return each.join(right, F.col("__m") == right[key], how).drop("__m")


def record_difference(left: DataFrame, right: DataFrame, every: bool = True) -> DataFrame:
    """Rows of ``left`` without the records of ``right``, all columns compared and nulls equal.

    ``every``: one record in ``right`` takes all its copies out of ``left``; else
    as many copies as it has itself.  Equal records of a side are counted first,
    so copies never meet one by one; sides meet by a hash of the record, and the
    records themselves decide.
    """
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    record = F.struct(*[F.col(c) for c in left.columns])

    def counted(side: DataFrame, of: str, n: str, h: str) -> DataFrame:
        return side.select(record.alias(of)).groupBy(of).agg(F.count(F.lit(1)).alias(n)).withColumn(h, F.xxhash64(of))

    a, b = counted(left, "__l", "__n", "__h"), counted(right, "__r", "__m", "__k")
    same = (F.col("__h") == F.col("__k")) & F.col("__l").eqNullSafe(F.col("__r"))
    if every:
        kept = a.join(b, same, "left_anti").withColumn("__rest", F.col("__n"))
    else:
        kept = a.join(b, same, "left").withColumn("__rest", F.col("__n") - F.coalesce("__m", F.lit(0))).filter("__rest > 0")
    return kept.select("__l", F.explode(F.sequence(F.lit(1), F.col("__rest")))).select("__l.*")


def subset(part: Column, whole: Column) -> Column:
    """Every element of ``part`` is in ``whole``; null arrays are empty."""
    empty = lambda c: F.coalesce(c, F.array())
    return F.size(F.array_except(empty(part), empty(whole))) == 0


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str, ident: str) -> DataFrame:
    """(rule, row, value): non-null references without a row in the parent."""
    refs = child.filter(F.col(child_key).isNotNull())
    gone = refs.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(child_key) == F.col("__p"), "left_anti")
    return gone.select(F.lit(rule).alias("rule"), F.col(ident).cast("string").alias("row"), F.col(child_key).cast("string").alias("value"))


def violations(frame: DataFrame, table: str, ident: str, rules: dict[str, str]) -> DataFrame:
    """One row for each rule (an SQL predicate) that a row does not meet; null counts as unmet."""
    checks = F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(name)) for name, p in rules.items()])
    return frame.select(F.lit(table).alias("table"), F.col(ident).cast("string").alias("row"), F.explode(F.array_compact(checks)).alias("rule"))


#: Bytes of needles that one automaton may hold.
NEEDLE_BYTES = 16 << 20


def contained(needles: DataFrame, hay: DataFrame, needle: str, text: str, gram: int = 5, block_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """Rows of ``hay`` whose text has a needle as a substring; null and empty needles match nothing.

    Few needles (their bytes are counted) make an automaton that reads each text
    once.  Beyond that, word grams of the needles meet the texts' grams in an
    equality join and only such pairs are tested; needles of fewer words go in
    blocks, each with its own automaton.
    """
    n = needles.filter(F.col(needle) != "")
    if _bytes(n, needle) <= block_bytes:
        return _found(n, hay, needle, text, block_bytes)
    n = n.withColumn("__w", F.split(F.btrim(F.regexp_replace(needle, r"\s+", " ")), " "))
    # Inner words only: the outer ones may be parts of longer words in the text.
    long = n.filter(F.size("__w") >= gram + 2).withColumn("__k", F.xxhash64(F.array_join(F.slice("__w", 2, gram), " "))).drop("__w")
    words = F.split(F.btrim(F.regexp_replace(text, r"\s+", " ")), " ")
    h = hay.select(F.xxhash64(*hay.columns).alias("__r"), words.alias("__hw")).filter(F.size("__hw") >= gram)
    grams = F.transform(F.sequence(F.lit(1), F.size("__hw") - gram + 1), lambda i: F.xxhash64(F.array_join(F.slice("__hw", i, gram), " ")))
    # Hits carry a hash of the row, not its text; equal rows share their hits.
    hits = h.select("__r", F.explode(F.array_distinct(grams)).alias("__k")).join(long, "__k").drop("__k").distinct()
    found = hay.withColumn("__r", F.xxhash64(*hay.columns)).join(hits, "__r").drop("__r").filter(F.contains(text, needle))
    short = n.filter(F.size("__w") < gram + 2).drop("__w")
    return found.unionByName(_found(short, hay, needle, text, block_bytes).select(*found.columns))


def _bytes(frame: DataFrame, column: str) -> int:
    return frame.agg(F.sum(F.octet_length(column))).first()[0] or 0


def _found(needles: DataFrame, hay: DataFrame, needle: str, text: str, block_bytes: int) -> DataFrame:
    """``hay`` joined with the needles its text holds, a block of needles a branch."""
    spark, kept = hay.sparkSession, F.struct(*needles.columns)
    blocks = max(1, -(-_bytes(needles, needle) // block_bytes))
    schema = T.StructType([T.StructField("__n", T.ArrayType(T.IntegerType())), *hay.schema.fields])
    out = None
    for b in range(blocks):
        rows = [r[0] for r in needles.filter(F.pmod(F.xxhash64(needle), F.lit(blocks)) == b).select(kept).collect()]
        held = spark.sparkContext.broadcast([r[needle] for r in rows])

        def run(batches, held=held):
            import ahocorasick

            words = held.value
            places: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
            automaton = ahocorasick.Automaton()
            for w, at in places.items():
                automaton.add_word(w, at)
            automaton.make_automaton()
            for batch in batches:
                hits = [sorted({i for _, at in automaton.iter(t) for i in at}) if t and places else [] for t in batch.column(text).to_pylist()]
                some = pa.array([bool(x) for x in hits])
                yield pa.RecordBatch.from_arrays([pa.array([x for x in hits if x], pa.list_(pa.int32())), *(c.filter(some) for c in batch.columns)], names=["__n", *batch.schema.names])

        table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("__i", T.IntegerType()), *needles.schema.fields]))
        hit = hay.mapInArrow(run, schema).select(*hay.columns, F.explode("__n").alias("__i"))
        part = hit.join(F.broadcast(table), "__i").drop("__i")
        out = part if out is None else out.unionByName(part)
    return out


def aliases(frame: DataFrame, columns: list[str], ident: str) -> DataFrame:
    """(alias, ident): every non-blank form under which a row may be cited."""
    return frame.select(ident, F.explode(F.array_compact(F.array(*columns))).alias("alias")).filter("trim(alias) <> ''").distinct()


def multiset(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per key and item: counts of both sides, common and surplus parts."""
    a = left.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__l"))
    b = right.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__r"))
    both = a.join(b, [*keys, name], "full_outer").fillna(0, ["__l", "__r"])
    return both.select(*keys, name, F.col("__l").alias("n_left"), F.col("__r").alias("n_right"), F.least("__l", "__r").alias("n_common"), F.greatest(F.col("__l") - F.col("__r"), F.lit(0)).alias("n_missing"), F.greatest(F.col("__r") - F.col("__l"), F.lit(0)).alias("n_extra"))


def table_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, is new or is gone."""
    p = pair(before, after, [key], [value])
    status = F.when(F.col(f"before_{value}").isNull(), "added").when(F.col(f"after_{value}").isNull(), "removed").otherwise("changed")
    return p.filter(~F.col(f"before_{value}").eqNullSafe(F.col(f"after_{value}"))).select(key, f"before_{value}", f"after_{value}", status.alias("change"))


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth): every pair once, with its shortest way, at any depth.

    Reach doubles with each round: what is exactly as far as the last rounds
    went is joined with all that is known.  Rounds are the logarithm of the
    depth; a cycle gives no new pairs at last, and ends it too.
    """
    known = cut(edges.filter(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct())
    step = 1
    while True:
        far = known.filter(F.col("depth") == step).select("node", F.col("ancestor").alias("via"))
        on = known.select(F.col("node").alias("via"), "ancestor", (F.col("depth") + step).alias("depth"))
        more = far.join(on, "via").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        more = cut(more.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if more.isEmpty():
            return known
        known, step = cut(known.unionByName(more)), step * 2
