"""Hashes and stable identifiers."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


@F.pandas_udf(T.StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """Sorted keys, compact, non-ASCII kept, numbers as written; null for text that is not JSON."""

    def one(s):
        try:
            return None if s is None else json.dumps(json.loads(s), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        except ValueError:
            return None

    return x.map(one)


def canonical_texts(texts: Column) -> Column:
    """:func:`canonical_json` of an array of texts, without Python: Spark writes them so, but for capitals in the escapes of control characters."""
    json = F.to_json(texts)
    # A pair of backslashes begins no escape; JSON has no raw control characters, so one can stand for it.
    lower = F.replace(json, F.lit("\\\\"), F.lit("\x01"))
    for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        lower = F.replace(lower, F.lit(f"\\u{c:04X}"), F.lit(f"\\u{c:04x}"))
    return F.when(F.contains(json, F.lit("\\u00")), F.replace(lower, F.lit("\x01"), F.lit("\\\\"))).otherwise(json)


def stable_id(prefix: str, *values: Column) -> Column:
    """prefix_ and 24 digits of the hash of the JSON array of the values."""
    ident = F.concat(F.lit(prefix + "_"), F.left(sha256(canonical_texts(F.array(*[v.cast("string") for v in values]))), F.lit(24)))
    # Never null, and said to be so: else a join by it would compute it once more to look for nulls.
    return F.coalesce(ident, F.lit(""))


def fingerprint(parts: Column) -> Column:
    """Hash of an array of strings in sorted order."""
    return sha256(F.array_join(F.array_sort(parts), "\n"))


def evidence_id(source: Column, text: Column) -> Column:
    return sha256(F.concat(source, F.lit("\n"), text))


def dataset_hash(manifest: str, own: str = "sha256") -> str:
    """Hash of a dataset's canonical JSON without its own hash (in ``manifest``)."""
    data = json.loads(manifest)
    data["manifest"] = {k: v for k, v in data.get("manifest", {}).items() if k != own}
    return hashlib.sha256(json.dumps(data, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def chained(parts: list[str]) -> str:
    """One hash of several configurations, each folded into the one before; empty for none."""
    value = ""
    for p in parts:
        value = hashlib.sha256(f"{value}\n{p}".encode()).hexdigest()
    return value


def content_identity(parts: Column) -> Column:
    """Hash of a group's rows as sorted canonical JSON of their contents: order, paths and times do not count."""
    return sha256(F.array_join(F.array_sort(F.collect_list(parts)), "\n"))
