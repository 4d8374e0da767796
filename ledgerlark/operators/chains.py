"""Walks along parent links by pointer jumping: as many rounds as the logarithm of the longest chain, one row a node in each.

No pair of a node and an ancestor is formed.  A parent with many children is one row
on its side of a round's join, so Spark may split the children.

Before round r a walk goes on if it has 2^r links at least.  The nodes of a walk that
ends have all smaller numbers of links too, so a round in which no walk ends is the
last: all that go on then are endless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import kept


def _rounds(n: int) -> int:
    """After so many rounds a chain of n nodes has ended; what goes on is a loop."""
    return max(1, n).bit_length() + 1


def nearest_above(nodes: DataFrame, ident: str, parent: str, value: Column) -> DataFrame:
    """(ident, value, endless): the value of the nearest node upwards that has one, itself first.

    A link to an unknown node ends the walk without a value; a walk that never
    ends (a loop without a value) is endless.  Identifiers must be unique.
    """
    state = nodes.select(F.col(ident).alias("node"), value.alias("val"), F.col(parent).alias("up"))
    state = kept(state.withColumn("up", F.when(F.col("val").isNull(), F.col("up"))))
    going = state.filter("up is not null").count()
    for _ in range(_rounds(state.count())):
        if not going:
            break
        above = state.select(F.col("node").alias("n"), F.col("val").alias("v"), F.col("up").alias("u"))
        state = kept(state.join(above, F.col("up") == F.col("n"), "left").select("node", F.coalesce("val", "v").alias("val"), F.col("u").alias("up")))
        before, going = going, state.filter("up is not null").count()
        if going == before:
            break
    return state.select(F.col("node").alias(ident), F.col("val").alias("value"), F.col("up").isNotNull().alias("endless"))


def endless(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """Nodes whose walk along the parents never ends: those of a loop and those that lead into one."""
    state = kept(nodes.select(F.col(ident).alias("node"), F.col(parent).alias("up")).filter("up is not null"))
    going = state.count()
    for _ in range(_rounds(going)):
        # A walk that has ended has no row any more, and ends those that come to it.
        above = state.select(F.col("node").alias("n"), F.col("up").alias("u"))
        state = kept(state.join(above, F.col("up") == F.col("n")).select("node", F.col("u").alias("up")))
        before, going = going, state.count()
        if going in (0, before):
            break
    return state.select(F.col("node").alias(ident))


def ranked_chains(nodes: DataFrame, ident: str, follows: str) -> DataFrame:
    """(ident, chain, place): the first node of each node's chain and the steps to it.

    ``follows`` is the node before it in its chain, null at the start; no node
    is followed by two.  The nodes of a loop are chains of their own.
    """
    state = kept(nodes.select(F.col(ident).alias("node"), F.coalesce(F.col(follows), F.col(ident)).alias("head"), F.when(F.col(follows).isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col(follows).alias("up")))
    going = state.filter("up is not null").count()
    for _ in range(_rounds(state.count())):
        if not going:
            break
        above = state.select(F.col("node").alias("n"), F.col("head").alias("h"), F.col("steps").alias("s"), F.col("up").alias("u"))
        on = state.join(above, F.col("up") == F.col("n"), "left")
        state = kept(on.select("node", F.coalesce("h", "head").alias("head"), (F.col("steps") + F.coalesce("s", F.lit(0))).alias("steps"), F.col("u").alias("up")))
        before, going = going, state.filter("up is not null").count()
        if going == before:
            break
    loop = F.col("up").isNotNull()
    return state.select(F.col("node").alias(ident), F.when(loop, F.col("node")).otherwise(F.col("head")).alias("chain"), F.when(loop, 0).otherwise(F.col("steps")).cast("long").alias("place"))
