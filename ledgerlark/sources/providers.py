"""Seams for what lies outside: models and searches.  Offline, recorded replies stand in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.numeric import cost, token_counts
from ledgerlark.session import cut


class Provider(Protocol):
    """Answers a request text; raising means failure.  Must be picklable."""

    def __call__(self, request: str) -> str | None: ...


class Recorded:
    """Replies from a table of recorded ones; unknown requests fail."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def __call__(self, request: str) -> str | None:
        return self.replies[request]


def ask(requests: DataFrame, column: str, provider: Callable[[str], str | None], retries: int = 2, wait: float = 0.0) -> DataFrame:
    """``requests`` with reply, status (ok, empty, error), reason, attempts and seconds.

    A failure is a row, never a lost one; persist the result before analysing it.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", reply string, status string, reason string, attempts int, seconds double"

    def run(pages: Iterator[pd.DataFrame]):
        for page in pages:
            out = []
            for r in page[column]:
                began, reply, reason, n = time.monotonic(), None, None, 0
                while n <= retries:
                    n += 1
                    try:
                        reply, reason = provider(r), None
                        break
                    except Exception as e:  # noqa: BLE001
                        reason = f"{type(e).__name__}: {e}"
                        time.sleep(wait)
                out.append((reply, "error" if reason else "ok" if reply else "empty", reason, n, time.monotonic() - began))
            yield page.assign(**dict(zip(("reply", "status", "reason", "attempts", "seconds"), map(list, zip(*out, strict=True)), strict=True)) if out else dict.fromkeys(("reply", "status", "reason", "attempts", "seconds"), []))

    return requests.mapInPandas(run, schema)


def structured(replies: DataFrame, column: str, schema: str) -> DataFrame:
    """Replies read as a fixed structure: value, and status error where the text is none (never a lost row)."""
    value = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    some = F.try_parse_json(F.col(column)).isNotNull() & value.isNotNull()
    return replies.withColumn("value", F.when(some, value)).withColumn("status", F.when(F.col("status") == "ok", F.when(some, "ok").otherwise("error")).otherwise(F.col("status")))


def measured(results: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scores of a metric provider: only finite ones in range are completed; else the status is error, with the reason."""
    v = F.col(value).cast("double")
    odd = F.when(F.col("status") != "ok", F.coalesce("reason", F.lit("no reply"))).when(v.isNull() | F.isnan(v), "not a number").when(~v.between(low, high), "out of range")
    return results.withColumns({"evaluation_status": F.when(odd.isNull(), "completed").otherwise("error"), "error": odd, value: F.when(odd.isNull(), v)})


class Timed:
    """A provider that must answer within a time; a later answer counts as a failure."""

    def __init__(self, provider: Callable[[str], str | None], seconds: float):
        self.provider, self.seconds = provider, seconds

    def __call__(self, request: str) -> str | None:
        from concurrent.futures import ThreadPoolExecutor

        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.provider, request).result(self.seconds)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)


def usage_records(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with token counts, cost and the reason of an unknown cost.

    calls(provider, kind, model, cached, ok, usage as JSON); prices as from
    :func:`ledgerlark.sources.runs.prices` (one row a provider, kind and model).
    """
    t = token_counts(F.col("usage"))
    p = F.broadcast(prices.select("provider", "kind", "model", "per_call", F.col("input").alias("__i"), F.col("cached").alias("__c"), F.col("output").alias("__o")))
    j = calls.withColumn("tokens", t).join(p, ["provider", "kind", "model"], "left")
    c = cost(F.col("cached"), F.col("provider"), F.col("kind"), F.col("ok"), F.col("per_call"), F.col("tokens.input"), F.col("tokens.cached"), F.col("tokens.output"), F.col("__i"), F.col("__c"), F.col("__o"))
    reason = F.when(c.isNotNull(), None).when(F.coalesce("per_call", "__i").isNull(), "no price").when(F.col("kind") == "llm", "token counts unknown").otherwise("call failed")
    return j.withColumns({"cost": c, "cost_reason": reason}).drop("per_call", "__i", "__c", "__o")


def observed(requests: DataFrame, column: str, provider: Callable[[str], str | None], operation: str, **more) -> tuple[DataFrame, DataFrame]:
    """Replies as from :func:`ask`, computed once, and the call log that goes with them (operation, request hash, status, seconds)."""
    replies = cut(ask(requests, column, provider, **more))
    log = replies.select(F.lit(operation).alias("operation"), F.sha2(column, 256).alias("request_sha256"), "status", "reason", "attempts", "seconds")
    return replies, log
