"""Tables in the folder that all machines share, and connected components on DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.rows import apart


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in local mode only, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared folder and read back: no lineage, and lost executors lose nothing."""
    path = f"{shared_folder(frame.sparkSession).rstrip('/')}/t-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _grouped_min(edges: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the least of u and u's neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = least.select(apart(F.col("u")).alias("k"), "m")
    return edges.select("u", "v", apart(F.col("u")).alias("k")).join(least, "k").select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``links`` (a, b): label is the least node of the component.

    Alternating large and small stars: a node's larger neighbours, then its
    smaller ones, are hung on the least node seen.  A node's neighbours are
    never gathered; only their minimum is, with map-side combining.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _grouped_min(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each u > v hangs on the least smaller neighbour of u.
        small = _grouped_min(large).select("u", "v", "m")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small)
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    # Stable: every u has one v, the label, and labels have no v of their own.
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
