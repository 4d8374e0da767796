"""Places of rows in a sorted table, without gathering the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.shared import stored

#: monotonically_increasing_id() keeps the place in the partition in its low bits.
PLACE_BITS = 33


def numbered(frame: DataFrame, order: list[Column], groups: list[Column] | None = None) -> DataFrame:
    """``frame`` with __place (long, from 0 in the order) and, with ``groups``, __within (place in its group) and __total (the group's rows).

    Ranges of the order are sorted apart; what meets in one place is one row for
    each range and group.  ``groups`` must lead the order, so that a group is
    consecutive.  Rows that are equal in all of the order differ by the input
    partition they come from, so that a hot one can be split too; which of them
    comes first is not defined.
    """
    groups = groups or []
    slim = frame.select("*", *[g.alias(f"__g{i}") for i, g in enumerate(groups)], F.spark_partition_id().alias("__from"))
    names = [f"__g{i}" for i in range(len(groups))]
    keys = [*order, F.col("__from")]
    ranged = stored(slim.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__from").withColumn("__at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__at", PLACE_BITS))
    counts = ranged.groupBy("__part", *names).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    parts = counts.groupBy("__part").agg(F.sum("__n").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("__part").alias("__p"), ahead.alias("__ahead"))
    own = F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1)
    out = ranged.join(parts, F.col("__part") == F.col("__p")).withColumn("__place", F.col("__ahead") + own)
    if groups:
        whole = Window.partitionBy(*names)
        mine = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select(
            F.col("__part").alias("__q"), *[F.col(g).alias(f"__h{i}") for i, g in enumerate(names)], F.col("__first"), mine.alias("__start"), F.sum("__n").over(whole).alias("__total")
        )
        same = F.col("__part") == F.col("__q")
        for i, g in enumerate(names):
            same &= F.col(g).eqNullSafe(F.col(f"__h{i}"))
        out = out.join(starts, same).withColumn("__within", F.col("__start") + F.col("__at") - F.col("__first"))
    added = ["__place", "__within", "__total"] if groups else ["__place"]
    return out.select(*frame.columns, *added)
