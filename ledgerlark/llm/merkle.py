"""Merkle manifest of a dataset, by supersteps of vertices that message each other.

Leaves (a hash of each row) are numbered in their group's order.  ``ARITY``
consecutive nodes become their hash until one is left, the group's root; the
groups' roots in the groups' order are the leaves of the dataset's tree.

A vertex is a block: the subtree of height ``HEIGHT`` over consecutive nodes, so a
superstep is one exchange of one message for each node of its level, and a tree
over n leaves needs log(n) / (HEIGHT log(ARITY)) of them.  No vertex holds more
than ARITY**HEIGHT nodes.

* Up: nodes are messages to their block.  A block that has its messages is
  complete: it hashes its levels and forwards its root to its parent block.
* Down: the top block knows the path from its root to the dataset's root; each
  block sends every child block the siblings on the way through itself and
  then its own path.  A leaf block gives each leaf its siblings, which with the
  path are its proof.

Blocks and paths of a superstep are tables in the shared folder, so a lost
executor costs its running tasks only.

Defined results: a null group is a group of its own and comes first; null ids
come last, rows of one id follow each other by their leaf; equal rows have equal
leaves and each its own place and proof; a group of one row is its leaf; an empty table
gives an empty one; a last run of fewer than ARITY nodes, even one, is hashed like
the others; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.ranks import numbered
from ledgerlark.llm.shared import stored

ARITY, HEIGHT = 2, 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A block: its group, place, the nodes of its group at this height, its own nodes and what follows them.
BLOCK = "grp long, block long, total long, nodes array<string>, tags array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, fields: list[str], changed: dict[str, Column] | None = None) -> Column:
    """The hash of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*[field((changed or {}).get(f, docs[f])) for f in fields]), 256)


def block_levels(nodes: list[str], total: int, arity: int, height: int) -> list[list[str]]:
    """A block's nodes and what they become: down to one node if it is its group's only block, else ``height`` steps."""
    out, alone = [nodes], total <= arity**height
    while len(out[-1]) > 1 if alone else len(out) <= height:
        last = out[-1]
        out.append([digest("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return out


def siblings(tree: list[list[str]], at: int, arity: int) -> list[tuple[list[str], list[str]]]:
    """For each level below the block's root: the siblings before and after the node."""
    out = []
    for level in tree[:-1]:
        first = at - at % arity
        out.append((level[first:at], level[at + 1 : first + arity]))
        at //= arity
    return out


#: A step of a path, as text: the siblings before, a bar, the siblings after.
def step(before: list[str], after: list[str]) -> str:
    return "".join(before) + "|" + "".join(after)


def fold(node: str, path: list[str]) -> str:
    """The root that a node has by its path."""
    for s in path:
        before, after = s.split("|")
        node = digest(before + node + after)
    return node


def proof(path: list[str]) -> str:
    return digest("".join(path).replace("|", ""))


@dataclass
class Tree:
    """The blocks of each superstep, lowest first, and the roots: (grp, total, root)."""

    blocks: list[DataFrame]
    roots: DataFrame
    arity: int
    height: int


def _frame(rdd: RDD, schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame(rdd, schema, verifySchema=False)


def _parts(frame: DataFrame) -> int:
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), frame.rdd.getNumPartitions())


def _gathered(messages: DataFrame) -> DataFrame:
    """Blocks from (grp, block, total, place, node, tag): at most ARITY**HEIGHT messages each."""
    keyed = messages.rdd.map(lambda r: ((r.grp, r.block), (r.place, r.node, r.tag, r.total)))

    def complete(item):
        (grp, block), values = item
        rows = sorted(values, key=lambda v: v[0])
        return grp, block, rows[0][3], [v[1] for v in rows], [v[2] for v in rows]

    return _frame(keyed.groupByKey(_parts(messages)).map(complete), BLOCK)


def grow(leaves: DataFrame, arity: int = ARITY, height: int = HEIGHT) -> Tree:
    """The upward supersteps, from leaves (grp, place, total, node, tag)."""
    width, blocks, roots = arity**height, [], None
    level = leaves.select("grp", (F.col("place") / width).cast("long").alias("block"), "total", "place", "node", "tag")
    while True:
        done = stored(_gathered(level))
        blocks.append(done)

        def forward(rows) -> Iterator[tuple]:
            for r in rows:
                yield r.grp, r.block, r.total, block_levels(r.nodes, r.total, arity, height)[-1][0]

        sent = done.rdd.mapPartitions(forward)
        up = stored(_frame(sent, "grp long, place long, below long, node string"))
        ended = up.filter(F.col("below") <= width).select("grp", F.col("node").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        up = up.filter(F.col("below") > width)
        if up.isEmpty():
            return Tree(blocks, roots, arity, height)
        total = F.ceil(F.col("below") / F.lit(width)).cast("long")
        level = up.select("grp", (F.col("place") / width).cast("long").alias("block"), total.alias("total"), "place", "node", F.lit(None).cast("string").alias("tag"))


def paths(tree: Tree, seeds: RDD) -> RDD:
    """The downward supersteps: (grp, place, node, tag, path) of each leaf.

    ``seeds``: (grp, path), the way from a group's root on.
    """
    arity, height, width = tree.arity, tree.height, tree.arity**tree.height

    def send(items) -> Iterator[tuple]:
        for (grp, block), (r, path) in items:
            whole = block_levels(r.nodes, r.total, arity, height)
            for at, node in enumerate(r.nodes):
                way = [step(*s) for s in siblings(whole, at, arity)] + list(path)
                yield grp, block * width + at, node, r.tags[at], way

    told = seeds.map(lambda r: ((r[0], 0), r[1]))
    inner = None
    for i, blocks in reversed(list(enumerate(tree.blocks))):
        vertices = blocks.rdd.map(lambda r: ((r.grp, r.block), r))
        tops = vertices.filter(lambda kv: kv[1].total <= width).join(told, _parts(blocks))
        if inner is not None:
            tops = tops.union(vertices.filter(lambda kv: kv[1].total > width).join(inner, _parts(blocks)))
        sent = tops.mapPartitions(send)
        if i == 0:
            return sent
        sent = stored(_frame(sent.map(lambda m: (m[0], m[1], m[4])), "grp long, block long, path array<string>"))
        inner = sent.rdd.map(lambda r: ((r.grp, r.block), list(r.path)))
    raise ValueError("a tree has a block at least")


@dataclass
class Manifest:
    """(grp, value, subroot, n) of the groups, the dataset's root (null without rows), and each leaf's (grp, place, node, tag, path)."""

    groups: DataFrame
    root: str | None
    leaves: RDD

    def proofs(self) -> DataFrame:
        """Each leaf with its path: a step is the siblings before the node, a bar, and those after it."""
        return _frame(self.leaves, "grp long, place long, node string, tag string, path array<string>")

    def verified(self, claim: Callable[[str], str | None] | None = None) -> DataFrame:
        """Each leaf with the hash of its siblings, the root folded from it and its path, and whether it is the dataset's.

        ``claim`` makes from a row's tag what is folded instead of the stored
        leaf, such as a leaf of data that may have changed; none: the stored one.
        """
        root = self.root

        def run(rows) -> Iterator[tuple]:
            for grp, place, node, tag, path in rows:
                folded = fold((claim(tag) if claim else None) or node, path)
                yield grp, place, node, tag, proof(path), folded, folded == root

        return _frame(self.leaves.mapPartitions(run), "grp long, place long, leaf string, tag string, proof string, folded string, verified boolean")


def manifest(rows: DataFrame, group: str, order: str, node: str, tag: str, arity: int = ARITY, height: int = HEIGHT) -> Manifest:
    """The tree over ``rows``: columns group (null: a group of its own), order, node (hex digest) and tag (a text that follows the row)."""
    base = rows.select(F.col(group).alias("value"), F.col(order).alias("key"), F.col(node).alias("node"), F.col(tag).cast("string").alias("tag"))
    first, rest = F.col("value").asc_nulls_first(), [F.col("key").asc_nulls_last(), F.col("node"), F.col("tag")]
    placed = numbered(base, [first, *rest], [F.col("value")])
    heads = placed.filter("__within = 0").select("value", F.col("__total").alias("n"))
    groups = stored(numbered(heads, [first]).withColumnRenamed("__place", "grp"))
    named = groups.select(F.col("value").alias("v"), "grp")
    leaves = placed.join(named, F.col("value").eqNullSafe(F.col("v"))).select("grp", F.col("__within").alias("place"), F.col("__total").alias("total"), "node", "tag")
    tree = grow(leaves, arity, height)
    roots = stored(groups.join(tree.roots, "grp").select("grp", "value", F.col("root").alias("subroot"), "n"))
    # The groups' roots are the leaves of the last tree, the only group of it.
    size = roots.count()
    top = roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.lit(size).cast("long").alias("total"), F.col("subroot").alias("node"), F.lit("").alias("tag"))
    last = grow(top, arity, height)
    root = next((r.root for r in last.roots.collect()), None)
    start = rows.sparkSession.sparkContext.parallelize([(0, [])], 1)
    seeds = stored(_frame(paths(last, start).map(lambda m: (m[1], m[4])), "grp long, path array<string>"))
    return Manifest(roots, root, paths(tree, seeds.rdd.map(lambda r: (r.grp, list(r.path)))))
