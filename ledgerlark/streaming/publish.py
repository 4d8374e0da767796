"""Tables that a stream fills, each micro-batch exactly once.

A batch's rows are written to a folder of its own beside the table and get
their name by one rename; then a manifest of the batch is created.  A batch
that runs again after a crash finds what it had finished and does not write it twice.
Readers see the folders that a manifest names.  The manifest also keeps what later
batches need to know (``notes``), such as the latest time seen.

The stores must rename a folder as a whole, as a distributed file system does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.sources.runs import write_text

Notes = dict[str, object]


class Published:
    """The tables of one stream in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that are done, in order."""
        path, fs = self._at("batches")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))

    def manifest(self, batch: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/batches/{batch:012d}.json", wholetext=True).first()[0])

    def notes(self, before: int) -> Notes:
        """The notes of the last batch before a batch; a batch that is done does not change those it saw."""
        done = [b for b in self.batches() if b < before]
        return self.manifest(done[-1])["notes"] if done else {}

    def put(self, batch: int, tables: dict[str, DataFrame], notes: Notes) -> bool:
        """Publishes a batch; false if it had been published."""
        if batch in self.batches():
            return False
        for name, frame in tables.items():
            final, fs = self._at(f"data/{name}/batch={batch}")
            if fs.exists(final):
                continue
            near = f"attempts/{name}-{batch}-{uuid.uuid4().hex}"
            frame.write.parquet(f"{self.folder}/{near}")
            path, _ = self._at(near)
            fs.mkdirs(final.getParent())
            if not fs.rename(path, final):
                raise RuntimeError(f"{final} has another writer")
        write_text(self.spark, f"{self.folder}/batches/{batch:012d}.json", json.dumps({"batch": batch, "tables": sorted(tables), "notes": notes}))
        return True

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The published rows of a table, with their batch."""
        paths = [f"{self.folder}/data/{name}/batch={b}" for b in self.batches() if name in self.manifest(b)["tables"]]
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.folder}/data/{name}").parquet(*paths)


Work = Callable[[DataFrame, Notes], tuple[dict[str, DataFrame], Notes]]


def publish(stream: DataFrame, folder: str, work: Work, output: str = "append") -> None:
    """Runs a stream over all input there is; ``work`` makes of a batch's rows and the last notes its tables and notes."""
    spark = stream.sparkSession
    into = Published(spark, folder)

    def each(frame: DataFrame, batch: int) -> None:
        if batch in into.batches():
            return
        frame.persist()
        try:
            into.put(batch, *work(frame, into.notes(batch)))
        finally:
            frame.unpersist()

    stream.writeStream.foreachBatch(each).outputMode(output).option("checkpointLocation", f"{into.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def as_they_come(frame: DataFrame, notes: Notes) -> tuple[dict[str, DataFrame], Notes]:
    """All rows to the table ``rows``."""
    return {"rows": frame}, {}


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))
