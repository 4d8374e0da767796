"""Line dedup in DataFrame operations only (no Python on the executors).

Lines become 128-bit hashes.  Each document's distinct hashes are counted per
hash and salt, combined on the map side, so a line that a third of all documents
hold is a few rows.  These are range-partitioned by hash with the document as
secondary sort; reading a range in order gives each key's number of documents
and its first occurrence.  The keys meet the line occurrences in a merge join
whose skewed partitions Spark may split.  What returns to a document is a bitmap
of its lines (64 lines a word, words without a dropped line left out), never
text; the document applies it to its own lines, in their positions.

``rule="common"``: all lines of a key found in ``min_docs`` documents go.
``rule="repeat"``: of each key, the first occurrence (by document id, then
position) stays and all later ones go.

Defined results: null or empty text is one empty line; a key of less than
``min_chars`` code points is never dropped; every row is a document of its own
(repeated rows count repeatedly and get equal results under "common"; under
"repeat" rows of equal id and text are treated as one); null ids sort last; an
empty table gives an empty one; extra columns pass through under any name but
the two that are added, which replace the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.rows import apart, keyed, packed

#: What is stripped from both ends of a line: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"
#: Parts of a key that are counted apart.
SALTS = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; pure ASCII takes the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def key_table(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, first): keys of at least ``min_docs`` documents and their first document.

    Counted per key and salt first, so a hot key is a few rows; then ranges of
    hashes, sorted by document within a key, are read once in order.
    """
    once = F.array_distinct(F.filter(line_keys(F.col("__text")), lambda k: F.char_length(k) >= min_chars))
    salted = (
        docs.select("__id", F.pmod("__rid", F.lit(SALTS)).alias("salt"), F.explode(once).alias("k"))
        .select("__id", "salt", *hashed(F.col("k")))
        .groupBy("h1", "h2", "salt")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
    )
    ranges = salted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first", "salt")
    key = Window.partitionBy("h1", "h2").orderBy("first", "salt")
    whole = F.sum("n").over(key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranges.select("h1", "h2", "first", whole.alias("n"), F.row_number().over(key).alias("place")).filter((F.col("place") == 1) & (F.col("n") >= min_docs)).select("h1", "h2", "first")


def dropped_bitmaps(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, rule: str = "common") -> DataFrame:
    """(__id, __rid, bits): for each document that loses lines a map from word number to 64 bits."""
    if rule not in ("common", "repeat"):
        raise ValueError(f"unknown rule {rule!r}")
    keys = key_table(docs, min_chars, min_docs if rule == "common" else 1)
    keys = keys.select(apart(F.col("h1")).alias("g1"), apart(F.col("h2")).alias("g2"), "first")
    lines = docs.select("__id", "__rid", F.posexplode(line_keys(F.col("__text"))).alias("pos", "k"))
    lines = lines.filter(F.char_length("k") >= min_chars).select("__id", "__rid", "pos", *hashed(F.col("k")))
    lines = lines.select("__id", "__rid", "pos", apart(F.col("h1")).alias("g1"), apart(F.col("h2")).alias("g2"))
    if rule == "repeat":
        # The place in the document at which a key is first seen, then the first document.
        lines = lines.groupBy("__id", "__rid", "g1", "g2").agg(F.min("pos").alias("head"), F.sort_array(F.collect_set("pos")).alias("all"))
        lines = lines.select("*", F.explode("all").alias("pos"))
    found = lines.join(keys, ["g1", "g2"])
    if rule == "repeat":
        found = found.filter((F.col("__id") > F.col("first")) | (F.col("pos") > F.col("head")))
    word, bit = F.shiftright("pos", 6), F.expr("shiftleft(1L, pos & 63)")
    return (
        found.select("__id", "__rid", "pos")
        .repartition("__id", "__rid")
        .groupBy("__id", "__rid", word.alias("w"))
        .agg(F.bit_or(bit).alias("b"))
        .groupBy("__id", "__rid")
        .agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("bits"))
    )


def kept_lines(text: Column, bits: Column) -> Column:
    """The lines of ``text`` whose bit is not set."""
    lines = F.split(text, "\n", -1)
    words = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(lines), 6)), lambda w: F.coalesce(F.element_at(bits, w), F.lit(0)))
    # One array access for each line, whatever the document's length.
    apply = F.transform(F.array(words), lambda ws: F.filter(lines, lambda _, i: F.getbit(F.get(ws, F.shiftright(i, 6)), i.bitwiseAND(63)) == 0))
    return F.element_at(apply, 1)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 1, min_docs: int = 10, rule: str = "common") -> DataFrame:
    """``docs`` with its kept text, __n_lines (before) and __n_dropped.

    A null text stays null, with one line and none dropped.
    """
    base = keyed(docs, text, doc_id)
    bits = dropped_bitmaps(base, min_chars, min_docs, rule).toDF("__i", "__r", "__bits")
    joined = packed(docs, text, doc_id).join(bits, (F.col("__k") == F.col("__i")) & (F.col("__h") == F.col("__r")), "left")
    old = F.col("__row")[text]
    body = F.coalesce(old, F.lit(""))
    kept = F.when(F.col("__bits").isNull(), old).otherwise(F.array_join(kept_lines(body, F.col("__bits")), "\n"))
    lost = F.coalesce(F.aggregate(F.map_values("__bits"), F.lit(0), lambda a, b: a + F.bit_count(b).cast("int")), F.lit(0))
    n = F.char_length(body) - F.char_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    own = [c for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    return joined.select(*[(kept if c == text else F.col("__row")[c]).alias(c) for c in own], n.cast("long").alias("__n_lines"), lost.cast("long").alias("__n_dropped"))
