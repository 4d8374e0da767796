"""Work that goes on where it stopped: a journal of steps, and JSON lines that may be appended to."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.files import append_lines, exists
from ledgerlark.sources.runs import read_text, write_json


def line_problems(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """(file, problem): files whose last line has no end, or that hold a line that is no JSON.

    The lines of a file and their ends are as many bytes as the file has, or one
    more if its last end is missing; so files are read in splits like any other, and
    no task needs a whole one.  ``since`` (a time stamp) leaves out files that were
    checked before.  Empty files are fine.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
    if since:
        reader = reader.option("modifiedAfter", since)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), "value")
    per = lines.groupBy("file", "size").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count_if(F.try_parse_json("value").isNull()).alias("broken"))
    problem = F.when(F.col("bytes") > F.col("size"), "last line not ended").when(F.col("broken") > 0, "line is no JSON")
    return per.select("file", problem.alias("problem")).filter("problem is not null")


def append_checked(frame: DataFrame, path: str, since: str | None = None) -> None:
    """Appends JSON lines after a check of those that are there; nothing is appended to a broken log."""
    spark = frame.sparkSession
    if exists(spark, path):
        bad = line_problems(spark, path, since).limit(5).collect()
        if bad:
            raise ValueError(f"not appended to: {[tuple(r) for r in bad]}")
    append_lines(frame, path)


class Journal:
    """A small document that says which of a few named steps are done, and with what result.

    ``plan`` is what the work depends on (versions, hashes, runs); a journal of another
    plan is refused.  Each step's result is on disk before the next step begins, so a
    killed or failed run repeats the step it was in and none before it.  Going on
    needs a reason, which is kept.  A step that may have been half done must itself
    be safe to repeat, as create-once tables of a fresh name are.
    """

    def __init__(self, spark: SparkSession, path: str, plan: dict, reason: str | None = None):
        self.spark, self.path = spark, path
        if exists(spark, path):
            self.state = json.loads(read_text(spark, path))
            if self.state["plan"] != json.loads(json.dumps(plan)):
                changed = sorted(k for k in {*plan, *self.state["plan"]} if plan.get(k) != self.state["plan"].get(k))
                raise ValueError(f"{path} is of another plan: {changed}")
            if self.state["status"] == "completed":
                raise FileExistsError(f"{path} is completed")
            if not reason:
                raise ValueError(f"{path} is not finished: a reason is needed to go on")
            self.state["resumed"].append(reason)
            self.state["status"], self.state["error"] = "running", None
        else:
            self.state = {"plan": plan, "status": "running", "done": {}, "resumed": [], "error": None}
        self._save()

    def _save(self) -> None:
        write_json(self.spark, self.path, self.state, replace=True)

    def run(self, steps: dict[str, Callable[[], str]]) -> dict[str, str]:
        """Runs the steps that are not done, in order; returns all results by name."""
        strange = sorted(self.state["done"].keys() - steps.keys())
        if strange:
            raise ValueError(f"done steps that are not asked for: {strange}")
        try:
            for name, step in steps.items():
                if name not in self.state["done"]:
                    self.state["done"][name] = step()
                    self._save()
            self.state["status"] = "completed"
        except BaseException as error:
            self.state["status"], self.state["error"] = "failed", f"{type(error).__name__}: {error}"
            raise
        finally:
            self._save()
        return dict(self.state["done"])
