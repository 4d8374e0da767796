"""Operators whose result depends on an order.  The order is always explicit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.session import cut


def first_per(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.  An aggregate of one struct: combines on the map side, sorts nothing."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(frame.columns)])
    best = frame.groupBy(*keys).agg(F.min(rank).alias("best"))
    return best.select(*[F.col(f"best.c{i}").alias(c) for i, c in enumerate(frame.columns)])


def ranked(frame: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def global_rank(frame: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """A rank over the whole table without gathering it in one task.

    Rows are range-partitioned by the order and numbered within partitions;
    only the partitions' row counts (one row each) go through one place.
    """
    part, n = "__part", "__n"
    ranged = cut(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(part).alias("__p"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(n, within).join(F.broadcast(offsets), F.col(part) == F.col("__p")).withColumn(name, (F.col("__before") + F.col(n)).cast("long")).drop(part, n, "__p", "__before")


def order_statistics(frame: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at given ranks (from 1) of each group's known values: keys, n (known values), and a column for each of ``ranks``, which make a rank of n.

    No group is buffered.  Equal values of a group are counted first; ranges of
    (group, value) are sorted apart and summed up in order; what meets in one
    place is one row for each range and group.  A rank outside 1 to n gives null.
    """
    group = F.struct(*[F.col(k) for k in keys])
    counts = frame.filter(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranged = cut(counts.repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("g", "part").agg(F.sum("c").alias("size"))
    whole = Window.partitionBy("g")
    ahead = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cut(parts.select("g", "part", "size", ahead.alias("ahead"), F.sum("size").over(whole).alias("n")))
    n = F.col("n")
    # Only the ranges that hold a wanted rank are summed up row by row.
    wanted = parts.select("g", "part", "ahead", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(n).cast("long").alias("rank")) for name, rank in ranks.items()])).alias("w"), "size")
    wanted = wanted.filter((F.col("w.rank") > F.col("ahead")) & (F.col("w.rank") <= F.col("ahead") + F.col("size"))).select(F.col("g").alias("wg"), F.col("part").alias("wp"), "w.name", (F.col("w.rank") - F.col("ahead")).alias("rank"))
    upto = F.sum("c").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = ranged.join(wanted.select(F.col("wg").alias("g"), F.col("wp").alias("part")).distinct(), ["g", "part"], "left_semi").withColumn("upto", upto)
    hit = held.join(wanted, (F.col("g") == F.col("wg")) & (F.col("part") == F.col("wp")) & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
    values = hit.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    totals = parts.groupBy(F.col("g").alias("t")).agg(F.max("n").alias("n"))
    return totals.join(values, F.col("t") == F.col("g"), "left").select("t.*", "n", *ranks)


def top_k(frame: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of the whole table, numbered.  Each task sends k rows at most."""
    return frame.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_k_per(frame: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each key before the shuffle."""
    return ranked(frame, by, order, name).filter(F.col(name) <= k)


def carried(frame: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value so far."""
    return frame.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str], strict: bool = False, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the values of the newest right row not after it (null if none).

    Both sides are sorted once by key and time and the last right row is carried
    along: no pair of rows is ever formed.  With ``bucket`` (a monotone function
    of the time, such as the day) a hot key is split: rows are sorted within key
    and bucket, and only one row for each bucket, the newest, is carried from
    bucket to bucket.
    """
    time, side, part = "__t", "__s", "__b"
    of = bucket or (lambda c: F.lit(0))
    a = left.select(*[F.col(k) for k in keys], F.col(at).alias(time), F.lit(0 if strict else 1).alias(side), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(right_at, *values).alias("r")).schema["r"].dataType).alias("__r"))
    b = right.select(*[F.col(k) for k in keys], F.col(right_at).alias(time), F.lit(1 if strict else 0).alias(side), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(right_at, *values).alias("__r"))
    both = a.unionByName(b).withColumn(part, of(F.col(time)))
    order = Window.partitionBy(*keys, part).orderBy(time, side).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__r", F.last("__r", ignorenulls=True).over(order))
    if bucket:
        newest = both.groupBy(*keys, part).agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct(time, side))).alias("__n"))
        before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        newest = newest.select(*keys, part, F.last("__n", ignorenulls=True).over(before).alias("__before"))
        both = both.join(newest, [*keys, part]).withColumn("__r", F.coalesce("__r", "__before"))
    return both.filter("__l is not null").select("__l.*", *[F.col(f"__r.{v}").alias(v) for v in [right_at, *values]])


def first_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the oldest right row not before it (null if none); the mirror of :func:`latest_before`."""
    # Time runs backwards: the newest before becomes the oldest after.
    turned = lambda f, c: f.withColumn("__turned", -F.unix_micros(F.col(c).cast("timestamp")))
    back = latest_before(turned(left, at), turned(right, right_at).withColumnRenamed("__turned", "__right_turned"), keys, "__turned", "__right_turned", [right_at, *values])
    return back.drop("__turned", "__right_turned")


def last_matching(frame: DataFrame, by: list[str], matches: Column, order: list[Column]) -> DataFrame:
    """The last row of each key that meets a condition."""
    return first_per(frame.filter(matches), by, order)


def printed(key: Column) -> Column:
    """A key as the text it is sorted by; null reads None."""
    return F.coalesce(key.cast("string"), F.lit("None"))


def merge_occurrences(frame: DataFrame, keys: list[str], order: str, text: str, place: str, flag: str) -> DataFrame:
    """One row for each key: first text, all places in order, whether any row is flagged."""
    return frame.groupBy(*keys).agg(F.min_by(text, order).alias(text), F.transform(F.array_sort(F.collect_list(F.struct(order, place))), lambda x: x[place]).alias("places"), F.bool_or(flag).alias(flag))


def same_content(frame: DataFrame, identity: Column, name: str, ident: str, member: str) -> DataFrame:
    """One row for each content: its identity, the least id, the sorted distinct members (as <member>s) and the number of rows."""
    return frame.groupBy(identity.alias(name)).agg(F.min(ident).alias(ident), F.array_sort(F.collect_set(member)).alias(f"{member}s"), F.count(F.lit(1)).alias("n"))


def chain_breaks(frame: DataFrame, by: list[str], order: str, own: str, previous: str, at: str) -> DataFrame:
    """Rows whose link to the previous revision or whose time is out of order."""
    w = Window.partitionBy(*by).orderBy(order)
    bad = ~F.col(previous).eqNullSafe(F.lag(own).over(w)) | F.coalesce(F.col(at) < F.lag(at).over(w), F.lit(False))
    return frame.withColumn("__bad", bad).filter("__bad").drop("__bad")
