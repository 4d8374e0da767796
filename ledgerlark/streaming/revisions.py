"""Chains of revisions over a stream: each revision is linked to the one before it.

State holds each chain's last revision.  What comes is appended in the order of
(time, id) within its batch; a revision older than its chain's last one comes too
late for its place: it is appended at the end and marked, never dropped and never
put between published ones.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LINK = "chain string, number long, revision long, previous long, at_us long, late boolean"
HEAD = "number long, revision long, latest long"


class Appending(StatefulProcessor):
    def init(self, handle) -> None:
        self.head = handle.getValueState("head", HEAD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        number, last, latest = self.head.get() if self.head.exists() else (0, None, None)
        for at, revision in sorted((r.us, r.revision) for r in rows):
            number += 1
            late = latest is not None and at < latest
            yield Row(chain=key[0], number=number, revision=revision, previous=last, at_us=at, late=late)
            last, latest = revision, at if latest is None else max(latest, at)
        self.head.update((number, last, latest))

    def close(self) -> None:
        pass


def append_revisions(events: DataFrame, chain: str, revision: str, at: str) -> DataFrame:
    """(chain, number, revision, previous, at_us, late) of a stream of revisions; a repeated delivery is to be parted before."""
    rows = events.select(F.col(chain).cast("string").alias("chain"), F.col(revision).cast("long").alias("revision"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    return rows.groupBy("chain").transformWithState(Appending(), LINK, "append", "none")
