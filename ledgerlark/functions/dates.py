"""Time stamps as text and their order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})$"


def utc(text: Column) -> Column:
    """The moment of a time stamp with an offset; null for text without one, or that is no time."""
    with_colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(OFFSET), F.try_to_timestamp(with_colon))


def timing_problem(started: Column, ended: Column, duration: Column) -> Column:
    """What is wrong with a start, an end and a duration; null if nothing is."""
    return (
        F.when(ended.isNotNull() & started.isNull(), "end without start")
        .when(ended < started, "end before start")
        .when(duration.isNotNull() & started.isNull(), "duration without start")
        .when(duration < 0, "negative duration")
    )


def future(published: Column, stated: Column, as_of: Column) -> Column:
    """A source that is dated, or speaks, after the as-of date."""
    return F.coalesce(published > as_of, F.lit(False)) | F.coalesce(stated > as_of, F.lit(False))


def output_name(stem: str, at: datetime, suffix: str) -> str:
    return f"{stem}_{at:%Y%m%d_%H%M%S}{suffix}"
