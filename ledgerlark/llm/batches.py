"""Bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded(frame: DataFrame) -> DataFrame:
    """``frame``; from now on the session hands Python at most so many rows or bytes of text at once.

    The usual 10,000 rows of long texts would not fit a worker's memory.
    Results do not depend on it.
    """
    conf = frame.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows, "10000")) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if conf.get(size, None) is None:
        conf.set(size, str(BATCH_BYTES))
    return frame
