"""Row identity: the key by which results find their way back to a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.batches import bounded

#: Stands for a null id; larger than every id in comparisons.
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` as (__id, __rid, __text): id without nulls, 64-bit hash of id and text, text without nulls.

    Rows with the same id and text share a key; they are equal, so they share
    their results too.  Ids must be integers: their order decides which copy
    stays.  (``NO_ID`` itself counts as null.)
    """
    bounded(docs)
    id_, rid = row_key(docs, text, doc_id)
    return docs.select(id_.alias("__id"), rid.alias("__rid"), F.coalesce(docs[text], F.lit("")).alias("__text"))


def row_key(docs: DataFrame, text: str, doc_id: str) -> tuple[Column, Column]:
    """The id and hash of :func:`keyed` as columns of ``docs``."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer column, not {docs.schema[doc_id].dataType.simpleString()}")
    number = F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID))
    return number, F.xxhash64(number, F.coalesce(docs[text], F.lit("")))


def packed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(__row, __k, __h): the rows as structs, so that no name of theirs can clash, and their keys."""
    id_, rid = row_key(docs, text, doc_id)
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), id_.alias("__k"), rid.alias("__h"))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column."""
    while name in docs.columns:
        name = "_" + name
    return name


def real_id(column: Column) -> Column:
    """The id that :func:`keyed` took, null again where it was null."""
    return F.nullif(column, F.lit(NO_ID))


def apart(column: Column) -> Column:
    """A bijection of a long that hides its partitioning from the planner.

    A side that comes from an aggregation by the join key would otherwise keep
    the aggregation's exchange, and then a skewed partition of the other side
    could not be split.
    """
    return column.bitwiseXOR(F.lit(0x5DEECE66D))
