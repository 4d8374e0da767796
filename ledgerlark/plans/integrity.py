"""All references of a run checked in one exchange.

Every key that is somewhere defined or referred to is a pair of its kind and itself.
Definitions set the first bit of the pair and count; each rule that refers to it sets
a bit of its own.  Bits combine on the map side, so what is exchanged is a row for
each pair, however many references there are.  Pairs without the first bit are broken; only if there
are any, their references are read again to name the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.operators.chains import endless
from ledgerlark.session import kept


@dataclass
class Keys:
    """Where a kind's keys are defined."""

    kind: str
    frame: DataFrame
    key: str
    unique: bool = True


@dataclass
class Refers:
    """A rule: the column (a value or an array of them; null refers to nothing) of each row must be a key of the kind."""

    rule: str
    kind: str
    frame: DataFrame
    ident: str
    column: str

    def rows(self) -> DataFrame:
        """(row, key)"""
        kind = self.frame.select(self.column).schema[0].dataType
        value = F.explode(self.column) if isinstance(kind, T.ArrayType) else F.col(self.column)
        return self.frame.select(F.col(self.ident).cast("string").alias("row"), value.alias("key")).select("row", F.col("key").cast("string").alias("key")).filter("key is not null")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def marks(keys: list[Keys], rules: list[Refers]) -> DataFrame:
    """(kind, key, bits, defined): one row for each key; bit 0: defined, bit i: used by the i-th rule."""
    if len(rules) > 62:
        raise ValueError("at most 62 rules have a bit")
    unknown = {r.kind for r in rules} - {k.kind for k in keys}
    if unknown:
        raise ValueError(f"kinds without keys: {sorted(unknown)}")
    row = lambda f, kind, key, bit, n: f.select(F.lit(kind).alias("kind"), key.alias("key"), F.lit(bit).cast("long").alias("bits"), F.lit(n).cast("long").alias("n"))
    defined = [row(k.frame, k.kind, F.col(k.key).cast("string"), 1, 1) for k in keys]
    used = [row(r.rows(), r.kind, F.col("key"), 1 << (i + 1), 0) for i, r in enumerate(rules)]
    return _union(defined + used).groupBy("kind", "key").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("defined"))


def broken(keys: list[Keys], rules: list[Refers]) -> DataFrame:
    """(rule, row, value): references to nothing, and (``duplicate <kind>``, key, number) of keys defined twice."""
    all_ = kept(marks(keys, rules))
    lost = all_.filter("bits & 1 = 0").select(F.col("kind").alias("k"), F.col("key").alias("lost"), "bits")
    out = [all_.filter(F.col("kind").isin([k.kind for k in keys if k.unique]) & (F.col("defined") > 1)).select(F.concat(F.lit("duplicate "), "kind").alias("rule"), F.col("key").alias("row"), F.col("defined").cast("string").alias("value"))]
    bits = lost.agg(F.bit_or("bits")).first()[0] or 0
    for i in range(len(rules)):
        if bits >> (i + 1) & 1:
            r = rules[i]
            mine = lost.filter((F.col("k") == r.kind) & (F.col("bits").bitwiseAND(1 << (i + 1)) != 0)).select("lost")
            out.append(r.rows().join(mine, F.col("key") == F.col("lost"), "left_semi").select(F.lit(r.rule).alias("rule"), "row", F.col("key").alias("value")))
    return _union(out)


def unequal(rule: str, frame: DataFrame, ident: str, value: str, expected: Column) -> DataFrame:
    """Rows whose value is not as expected."""
    return frame.filter(~F.col(value).eqNullSafe(expected)).select(F.lit(rule).alias("rule"), F.col(ident).cast("string").alias("row"), F.col(value).cast("string").alias("value"))


def loops(invocations: DataFrame) -> DataFrame:
    """Calls whose chain of parents never ends."""
    found = endless(invocations, "invocation_id", "parent_id")
    return found.select(F.lit("parent cycle").alias("rule"), F.col("invocation_id").cast("string").alias("row"), F.lit(None).cast("string").alias("value"))


def _pair(path: Column, digest: Column) -> Column:
    return F.concat_ws(" ", path, digest)


def validate(run: dict[str, DataFrame], run_id: str) -> DataFrame:
    """(rule, row, value): all that is wrong with a run.

    Tables: invocations(invocation_id, run_id, parent_id, previous_id,
    evidence_ids, context_ids), events(event_id, run_id, invocation_id),
    outputs(output_id, run_id, invocation_id, evidence_ids, context_ids),
    contexts(context_id, run_id, invocation_id, text, sha256, evidence_ids, retrieval_ids,
    upstream_ids), retrievals(invocation_id, run_id, candidates: array of (evidence_id,
    source_id, text, sha256)), evidence(evidence_id, source_id), research(
    research_id, invocation_id, reevaluation_id, new_evidence_ids, duplicate_evidence_ids,
    search_ids), checks(check_id, run_id, invocation_id), snapshots(owner, path, sha256: all
    that the tables above refer to), files(path, sha256: what is there).
    """
    t = dict(run)
    t["candidates"] = t["retrievals"].select("invocation_id", F.explode("candidates").alias("c")).select("invocation_id", "c.*")
    t["snapshots"] = t["snapshots"].withColumn("pair", _pair(F.col("path"), F.col("sha256")))
    t["files"] = t["files"].withColumn("pair", _pair(F.col("path"), F.col("sha256")))
    keys = [
        Keys("invocation", t["invocations"], "invocation_id"),
        Keys("evidence", t["evidence"], "evidence_id"),
        Keys("context", t["contexts"], "context_id"),
        Keys("retrieval", t["retrievals"], "invocation_id", unique=False),
        Keys("file", t["files"], "path", unique=False),
        Keys("content", t["files"], "pair", unique=False),
    ]
    rules = [
        Refers(rule, kind, t[name], ident, column)
        for rule, kind, name, ident, column in (
            ("parent", "invocation", "invocations", "invocation_id", "parent_id"),
            ("previous", "invocation", "invocations", "invocation_id", "previous_id"),
            ("invocation evidence", "evidence", "invocations", "invocation_id", "evidence_ids"),
            ("invocation context", "context", "invocations", "invocation_id", "context_ids"),
            ("event invocation", "invocation", "events", "event_id", "invocation_id"),
            ("output invocation", "invocation", "outputs", "output_id", "invocation_id"),
            ("output evidence", "evidence", "outputs", "output_id", "evidence_ids"),
            ("output context", "context", "outputs", "output_id", "context_ids"),
            ("context invocation", "invocation", "contexts", "context_id", "invocation_id"),
            ("delivered evidence", "evidence", "contexts", "context_id", "evidence_ids"),
            ("delivered retrieval", "retrieval", "contexts", "context_id", "retrieval_ids"),
            ("upstream", "invocation", "contexts", "context_id", "upstream_ids"),
            ("retrieval invocation", "invocation", "retrievals", "invocation_id", "invocation_id"),
            ("retrieved evidence", "evidence", "candidates", "invocation_id", "evidence_id"),
            ("research invocation", "invocation", "research", "research_id", "invocation_id"),
            ("research reevaluation", "invocation", "research", "research_id", "reevaluation_id"),
            ("research new evidence", "evidence", "research", "research_id", "new_evidence_ids"),
            ("research known evidence", "evidence", "research", "research_id", "duplicate_evidence_ids"),
            ("research search", "retrieval", "research", "research_id", "search_ids"),
            ("rule invocation", "invocation", "checks", "check_id", "invocation_id"),
            ("snapshot file", "file", "snapshots", "owner", "path"),
            ("snapshot hash", "content", "snapshots", "owner", "pair"),
        )
    ]
    sources = t["evidence"].groupBy(F.col("evidence_id").alias("e")).agg(F.min("source_id").alias("expected"))
    retrieved = t["candidates"].join(sources, F.col("evidence_id") == F.col("e"))
    scoped = [unequal(f"{n} run", t[n], i, "run_id", F.lit(run_id)) for n, i in (("invocations", "invocation_id"), ("events", "event_id"), ("outputs", "output_id"), ("contexts", "context_id"), ("retrievals", "invocation_id"), ("checks", "check_id"))]
    return _union([
        broken(keys, rules),
        loops(t["invocations"]),
        *scoped,
        unequal("context text", t["contexts"], "context_id", "sha256", F.sha2("text", 256)),
        unequal("retrieval source", retrieved, "invocation_id", "source_id", F.col("expected")),
        unequal("retrieved text", t["candidates"], "invocation_id", "sha256", F.sha2("text", 256)),
    ])
