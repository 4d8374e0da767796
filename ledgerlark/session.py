"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows, or groups, that one task of :func:`dealt` gets on average.
ROWS_A_TASK = 250_000


def tasks_of(frame: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """How many tasks get about ``rows`` rows of ``frame`` each; its rows are counted."""
    return 1 + frame.count() // rows


def dealt(frame: DataFrame, tasks: int, key: str) -> DataFrame:
    """``frame`` by its key in as many partitions as its size asks for, so a task's memory does not grow with the table; grouping and joining by the key need no other exchange."""
    return frame.repartition(tasks, key)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def kept(frame: DataFrame, compression: str | None = None) -> DataFrame:
    """``frame`` written once to the shared folder as a table and read back: its lineage is cut and its size is known to later joins."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)
