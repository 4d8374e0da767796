"""Sharding along a Hilbert curve, in DataFrame operations only (no Python on the executors).

Several metadata columns are quantised to ``BITS`` bits each and joined into the
index of a Hilbert curve through that grid, so rows that are near each other in
all dimensions are near each other on the curve.  The rows are sorted by the
index (ranges of it apart, then numbered: ``ranks.numbered``), and the curve is
cut into runs.  A shard, and each file of it, then covers a small box of every
dimension, not of the first sort key alone, and a reader can leave out files by
any of the dimensions: :func:`write` keeps each file's least and largest values
in a manifest, :func:`read` opens only files that a query's ranges can meet.

Scales of a dimension:

* ``linear``: an integer column, cut into 2^bits equal steps between its least and
  largest value;
* ``log``: the same over the number of bits of the value and the ten bits after
  the first, for sizes;
* ``rank``: any sortable column, by the place of its value among the distinct
  values.

Laws of the cut: ``rows`` (counts of two shards differ by one at most) and
``bytes`` (each shard ends at the row whose middle byte passes its share).

The index is computed level by level from the highest bit: the curve's state
(entry corner and direction of the sub-cube) and the dimensions' bits select the
sub-cube's place on the curve and the next state, from a table that
:func:`states` builds by the Gray code rule.

Defined results: a null comes first in a ``rank`` and lies in the first step of
the other scales; rows with equal index follow each other by the columns of
``ties``, nulls last, and rows equal in these too in any order; an empty table
gives an empty one; with fewer rows than shards some shards have no row; extra
columns pass through, and the added __curve, __shard and __slot replace columns of
these names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.ranks import numbered
from ledgerlark.llm.rows import unused
from ledgerlark.llm.shared import stored

#: Bits of a dimension; the index has as many times the number of dimensions.
BITS = 8
SHARDS = 24
#: Bits after the first that the log scale looks at.
MANTISSA = 10


@dataclass(frozen=True)
class Dimension:
    column: str
    scale: str = "linear"


@cache
def states(n: int) -> tuple[int, ...]:
    """For (state, bits of the n dimensions): next state and place on the curve, as one number.

    A state is the entry corner (n bits) and the direction (0 to n - 1) of a
    sub-cube.  Place w of its Gray code walk is the corner w ^ (w >> 1); the
    walk through the sub-cube at w enters at the corner of the last even step
    and leaves along the bit that the next step changes.
    """
    full = (1 << n) - 1

    def turned(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & full

    def ones(x: int) -> int:
        return ((x + 1) & ~x).bit_length() - 1

    out = []
    for entry in range(1 << n):
        for direction in range(n):
            for bits in range(1 << n):
                corner = turned(bits ^ entry, n - (direction + 1) % n)
                w = corner
                for shift in range(1, n):
                    w ^= corner >> shift
                even = 2 * ((w - 1) // 2) if w else 0
                enter = even ^ (even >> 1)
                step = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
                entry2 = entry ^ turned(enter, direction + 1)
                direction2 = (direction + step + 1) % n
                out.append((entry2 * n + direction2) << n | w)
    return tuple(out)


def curve_index(codes: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of integer codes of ``bits`` bits."""
    n = len(codes)
    room = (n << n).bit_length()
    if n < 2 or n > 6 or n * bits + room + n > 62:
        raise ValueError("two to six dimensions, and an index of at most 62 bits with its state")
    table, low, low_state = F.lit(list(states(n))), (1 << n) - 1, (1 << room) - 1

    def level(acc: Column, k: Column) -> Column:
        corner = F.lit(0)
        for i, code in enumerate(codes):
            corner = corner + F.shiftleft(F.getbit(code.cast("long"), k).cast("int"), i)
        found = F.element_at(table, (acc.bitwiseAND(low_state) * (1 << n) + corner + 1).cast("int")).cast("long")
        place = F.shiftleft(F.shiftright(acc, room), n).bitwiseOR(found.bitwiseAND(low))
        return F.shiftleft(place, room).bitwiseOR(F.shiftright(found, n))

    return F.shiftright(F.aggregate(F.lit(list(range(bits - 1, -1, -1))), F.lit(0).cast("long"), level), room)


def logarithm(x: Column) -> Column:
    """Bits of a positive integer, then the ten bits after its first; 0 for 0 and less."""
    x = x.cast("long")
    above = F.length(F.bin(x)) - 1
    down = F.call_function("shiftright", x, F.greatest(above - MANTISSA, F.lit(0)))
    up = F.call_function("shiftleft", down, F.greatest(MANTISSA - above, F.lit(0)))
    return F.when(x > 0, (above + 1) * (1 << MANTISSA) + up.bitwiseAND((1 << MANTISSA) - 1)).otherwise(F.lit(0)).cast("long")


def quantised(frame: DataFrame, dims: list[Dimension], bits: int = BITS) -> DataFrame:
    """``frame`` with __c0, __c1, ...: the dimensions' codes.  One pass over the columns, and one count of each ranked one's values."""
    values = {}
    for i, d in enumerate(dims):
        if d.scale not in ("linear", "log", "rank"):
            raise ValueError(f"unknown scale {d.scale!r}")
        if d.scale != "rank":
            if not isinstance(frame.schema[d.column].dataType, T.IntegralType):
                raise TypeError(f"{d.column} must be an integer column for the scale {d.scale}")
            values[i] = logarithm(frame[d.column]) if d.scale == "log" else frame[d.column].cast("long")
    edges = frame.agg(*[f(v).alias(f"{n}{i}") for i, v in values.items() for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count(F.lit(1)).alias("n")).first()
    codes, out = {}, frame
    for i, v in values.items():
        lo, hi = edges[f"lo{i}"] or 0, edges[f"hi{i}"] or 0
        wide = (v.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")).cast("decimal(38,0)") * F.lit(1 << bits)
        codes[i] = F.coalesce(F.call_function("div", wide, F.lit(hi - lo + 1).cast("decimal(20,0)")), F.lit(0)).cast("int")
    out = out.select("*", *[c.alias(f"__c{i}") for i, c in codes.items()])
    for i, d in enumerate(dims):
        if d.scale == "rank":
            distinct = frame.select(F.col(d.column).alias("__v")).distinct()
            places = stored(numbered(distinct, [F.col("__v").asc_nulls_first()]))
            n = max(1, places.count())
            places = places.select(F.col("__v").alias(f"__v{i}"), F.expr(f"cast(__place * {1 << bits} div {n} as int)").alias(f"__c{i}"))
            out = out.join(places, F.col(d.column).eqNullSafe(F.col(f"__v{i}"))).drop(f"__v{i}")
    return out


def shards(frame: DataFrame, dims: list[Dimension], n: int = SHARDS, law: str = "rows", ties: list[str] | None = None, size: str | None = None, bits: int = BITS) -> DataFrame:
    """``frame`` with __curve (index), __shard and __slot (place in the shard)."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    if law == "bytes" and size is None:
        raise ValueError("the law bytes needs the column of sizes")
    own = [c for c in frame.columns if c not in ("__curve", "__shard", "__slot")]
    # As a struct: no column name can clash with those made here.
    row = frame.select(F.struct(*[frame[c] for c in own]).alias("__row"), *[frame[d.column].alias(f"__d{i}") for i, d in enumerate(dims)], (frame[size] if size else F.lit(1)).cast("long").alias("__size"))
    inner = [Dimension(f"__d{i}", d.scale) for i, d in enumerate(dims)]
    coded = quantised(row, inner, bits).withColumn("__curve", curve_index([F.col(f"__c{i}") for i in range(len(dims))], bits))
    order = [F.col("__curve"), *[F.col("__row")[t].asc_nulls_last() for t in ties or []]]
    placed = numbered(coded.select("__row", "__size", "__curve"), order)
    place = F.col("__place")
    if law == "rows":
        total = max(1, placed.agg(F.count(F.lit(1))).first()[0])
        shard = F.expr(f"cast(__place * {n} div {total} as int)")
        first = F.expr(f"(cast(__shard as bigint) * {total} + {n - 1}) div {n}")
        out = placed.withColumn("__shard", shard).withColumn("__slot", place - first)
    else:
        out = _by_bytes(placed, n)
    return out.select("__row.*", "__curve", "__shard", "__slot")


#: Rows whose sizes are summed one by one.
STRETCH = 1 << 16


def _by_bytes(placed: DataFrame, n: int) -> DataFrame:
    """Cut by the running sum of sizes: within stretches of equal row counts, and one sum for each stretch."""
    placed = placed.withColumn("__stretch", F.expr(f"__place div {STRETCH}"))
    sums = placed.groupBy("__stretch").agg(F.sum("__size").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.select(F.col("__stretch").alias("__s"), ahead.alias("__ahead"), F.col("__n")))
    total = max(1, sums.agg(F.sum("__n")).first()[0] or 1)
    within = F.sum("__size").over(Window.partitionBy("__stretch").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("__upto", within).join(sums.select("__s", "__ahead"), F.col("__stretch") == F.col("__s"))
    middle = "(__ahead + __upto) * 2 - __size"
    out = stored(out.withColumn("__shard", F.expr(f"cast(least({n - 1}, cast({middle} as decimal(38,0)) * {n} div {2 * total}) as int)")))
    first = out.groupBy("__shard").agg(F.min("__place").alias("__first")).withColumnRenamed("__shard", "__of")
    return out.join(F.broadcast(first), F.col("__shard") == F.col("__of")).withColumn("__slot", F.col("__place") - F.col("__first"))


def write(frame: DataFrame, folder: str, dims: list[Dimension], n: int = SHARDS, law: str = "rows", ties: list[str] | None = None, size: str | None = None, files: int = 1) -> DataFrame:
    """The shards as Parquet, one folder each, ``files`` runs of the curve in each; the manifest of the files is returned.

    The manifest (folder/manifest) has a row for each file: its path, rows, and
    least and largest value of each dimension.
    """
    placed = shards(frame, dims, n, law, ties, size)
    name = unused(frame, "shard")
    counts = stored(placed).withColumnRenamed("__shard", name)
    last = F.broadcast(counts.groupBy(F.col(name).alias("__of")).agg(F.count(F.lit(1)).alias("__rows")))
    run = F.expr(f"cast(__slot * {files} div __rows as int)")
    ready = counts.join(last, F.col(name) == F.col("__of")).withColumn("__run", run)
    # One range of (shard, run) is one task's; a task opens one file for each shard it meets.
    ready = ready.repartitionByRange(n * files, name, "__run", "__slot").sortWithinPartitions(name, "__run", "__slot").drop("__of", "__rows", "__run", "__slot", "__curve")
    data = f"{folder.rstrip('/')}/data-{uuid.uuid4().hex}"
    ready.write.partitionBy(name).parquet(data)
    spark = frame.sparkSession
    written = spark.read.parquet(data)
    bounds = [f(d.column).alias(f"{n_}_{d.column}") for d in dims for f, n_ in ((F.min, "min"), (F.max, "max"))]
    holes = [F.count_if(F.col(d.column).isNull()).alias(f"nulls_{d.column}") for d in dims]
    manifest = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), *bounds, *holes)
    manifest.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest")


def files_for(manifest: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The manifest's files that can hold a row within all ``ranges`` (column: least and largest wanted, both included)."""
    for column, (lo, hi) in ranges.items():
        manifest = manifest.filter((F.col(f"max_{column}") >= F.lit(lo)) & (F.col(f"min_{column}") <= F.lit(hi)))
    return manifest


def read(spark: SparkSession, folder: str, ranges: dict[str, tuple]) -> DataFrame:
    """The rows within all ``ranges``, from the files that can hold them."""
    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    paths = [r.path for r in files_for(manifest, ranges).select("path").toLocalIterator()]
    some = paths or [r.path for r in manifest.select("path").take(1)]
    if not some:
        raise ValueError(f"{folder} has no rows")
    base = some[0].split("/data-")[0] + "/data-" + some[0].split("/data-")[1].split("/")[0]
    out = spark.read.option("basePath", base).parquet(*some)
    for column, (lo, hi) in ranges.items():
        out = out.filter(F.col(column).between(F.lit(lo), F.lit(hi)))
    return out
