"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a passage by k = floor(n * budget) words
(inserted, lost or replaced).  Cut into k + 1 pieces, at least one piece stands
unchanged in any such passage: so exact piece hits (rolling word hashes looked
up in a bitmap, then in the sorted piece hashes) miss nothing, and each hit is
verified with Myers' bit-parallel distance of the item's words to the document
words around it.

Benchmark items are taken in blocks of at most ``BLOCK_BYTES`` of text; each
block is broadcast (a proven bound) and meets all documents in a map of its own,
so documents are never shuffled and a larger benchmark costs more passes, not
more memory in a task.

Words are runs of letters and digits, ASCII letters lower-cased; in scripts
without blanks (Chinese, Japanese, Thai) each character is a word.  Items of
less than 1 / budget words are sought exactly (k = 0).  ``min_words`` leaves
shorter items out; by default only items without any word are.

Defined results: null or empty texts match nothing; repeated documents each get
their own rows; repeated items each count as an item; ties in distance go to the
first place; an empty benchmark matches nothing; null ids and extra columns pass
through, and an input column ``__leaks`` is replaced by :func:`find_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.batches import bounded
from ledgerlark.llm import kernels as K
from ledgerlark.llm.rows import apart

BUDGET = 0.2
MIN_WORDS = 1
BLOCK_BYTES = 16 << 20
SEED = 2


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words, and the rows' word offsets; characters of scripts without blanks stand alone."""
    second = np.append(data[1:], np.uint8(0))
    # By their first two bytes: U+0E00-0E7F, U+3040-9FFF, U+F900-FAFF; each has three bytes.
    alone = np.flatnonzero(((data == 0xE0) & ((second == 0xB8) | (second == 0xB9))) | ((data == 0xE3) & (second >= 0x81)) | ((data >= 0xE4) & (data <= 0xE9)) | ((data == 0xEF) & (second >= 0xA4) & (second <= 0xAB)))
    return K.words(data, offsets, K.WORD, np.concatenate([alone, np.minimum(alone + 3, len(data))]) if len(alone) else None)


def myers(item: list[bytes], text: list[bytes], most: int) -> tuple[int, int] | None:
    """(least distance of ``item`` to a stretch of ``text``, end of the first such stretch), or None beyond ``most``."""
    n = len(item)
    peq: dict[bytes, int] = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best = full, 0, n, None
    for at, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a stretch may begin anywhere: no carry in
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 pieces of n words."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Block:
    """Items and the piece hashes of each piece length, sorted, with their (item, start)."""

    ids: list
    words: list[list[bytes]]
    errors: list[int]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, items: list[tuple[object, str]], budget: float, min_words: int = MIN_WORDS) -> Block:
        ids, words, errors = [], [], []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for number, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            offsets = np.array([0, len(data)])
            start, end, _ = words_of(data, offsets)
            n = len(start)
            if n < max(1, min_words):
                continue
            k = int(n * budget)
            low = K.LOWER[data].tobytes()
            sums = K.running(K.word_hashes(data, start, end, SEED, lower=True))
            for a, size in pieces(n, k):
                value = K.spans_hash(sums, np.array([a]), np.array([a + size]))[0]
                found.setdefault(size, []).append((int(value), len(ids), a))
            ids.append(number)
            words.append([low[a:b] for a, b in zip(start, end, strict=True)])
            errors.append(k)
        tables = {}
        for size, rows in found.items():
            rows.sort()
            value = np.array([r[0] for r in rows], np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[value >> np.uint64(44)] = True
            tables[size] = (bits, value, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return cls(ids, words, errors, tables)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, words) of the best match of each item in each row."""
        data, offsets = K.columns_bytes(column)
        start, end, at = words_of(data, offsets)
        if not len(start):
            return
        sums = K.running(K.word_hashes(data, start, end, SEED, lower=True))
        seen: dict[tuple[int, int], set[int]] = {}
        for size, (bits, value, item, begin) in self.tables.items():
            hashes = K.rolling_hash(sums, size)
            maybe = np.flatnonzero(bits[hashes >> np.uint64(44)])
            lo = np.searchsorted(value, hashes[maybe], "left")
            hi = np.searchsorted(value, hashes[maybe], "right")
            sure = hi > lo
            maybe, lo, hi = maybe[sure], lo[sure], hi[sure]
            row = np.searchsorted(at, maybe, "right") - 1
            inside = maybe + size <= at[row + 1]
            for p, r, a, b in zip(maybe[inside], row[inside], lo[inside], hi[inside], strict=True):
                for x in range(a, b):
                    # Where the item would begin in the batch's words.
                    seen.setdefault((int(r), int(item[x])), set()).add(int(p - begin[x]))
        for (r, i), origins in sorted(seen.items()):
            best = None
            for a, b in merged(sorted(origins), len(self.words[i]), self.errors[i]):
                a, b = max(a, int(at[r])), min(b, int(at[r + 1]))
                low = K.LOWER[data[start[a] : end[b - 1]]].tobytes()
                base = start[a]
                got = myers(self.words[i], [low[s - base : e - base] for s, e in zip(start[a:b], end[a:b], strict=True)], self.errors[i])
                if got and (best is None or got[0] < best[0]):
                    n = len(self.words[i])
                    best = (got[0], max(0, a + got[1] - n - int(at[r])), n)
            if best:
                yield r, i, *best


def merged(origins: list[int], n: int, k: int) -> Iterator[tuple[int, int]]:
    """Stretches of words that hold every match near the origins, overlapping ones joined."""
    low = high = None
    for o in origins:
        a, b = o - k, o + n + k
        if high is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


def blocks(benchmark: DataFrame, text: str, item_id: str, budget: float, block_bytes: int, min_words: int) -> Iterator[Block]:
    items = benchmark.select(benchmark[item_id].alias("i"), benchmark[text].alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield Block.build([(r.i, r.t) for r in part.collect()], budget, min_words)


def searched(rows: DataFrame, block: Block, kind: T.DataType) -> DataFrame:
    """``rows`` (with ``__text``) and ``__leaks``, the matches of one block."""
    match = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("distance", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("n_item_words", T.IntegerType())]))
    held, names = rows.sparkSession.sparkContext.broadcast(block), rows.columns

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        block, arrow = held.value, to_arrow_type(match)
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                found: list[list[dict]] = [[] for _ in range(j - i)]
                for r, item, distance, first, n in block.matches(column.slice(i, j - i)):
                    found[r].append({"item_id": block.ids[item], "distance": distance, "first_word": first, "n_item_words": n})
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, arrow)], names=[*names, "__leaks"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__leaks", match)]))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document and item it holds; each block of items is a branch of its own."""
    slim = bounded(docs).select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"))
    kind, found = benchmark.schema[item_id].dataType, None
    for block in blocks(benchmark, item_text, item_id, budget, block_bytes, min_words):
        part = searched(slim, block, kind).select("doc_id", F.explode("__leaks").alias("m")).select("doc_id", "m.*")
        found = part if found is None else found.unionByName(part)
    return found


def _packed(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, budget: float, block_bytes: int, min_words: int) -> DataFrame:
    """(__row, __leaks) of the rows of ``docs``.

    The matches of several blocks come back to the documents by a 128-bit hash
    of the text: equal texts have equal matches.
    """
    rows = bounded(docs).select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[text].alias("__text"))
    kind, parts = benchmark.schema[item_id].dataType, list(blocks(benchmark, item_text, item_id, budget, block_bytes, min_words))
    if len(parts) == 1:
        return searched(rows, parts[0], kind).select("__row", "__leaks")
    body = F.coalesce("__text", F.lit(""))
    rows = rows.withColumns({"__h1": F.xxhash64(body), "__h2": F.xxhash64(body, F.lit(1))})
    found = None
    for block in parts:
        part = searched(rows.select("__h1", "__h2", "__text"), block, kind).select("__h1", "__h2", F.explode("__leaks").alias("m"))
        found = part if found is None else found.unionByName(part)
    per = found.groupBy("__h1", "__h2").agg(F.sort_array(F.collect_set("m")).alias("__leaks"))
    per = per.select(apart(F.col("__h1")).alias("__h1"), apart(F.col("__h2")).alias("__h2"), "__leaks")
    rows = rows.select("__row", apart(F.col("__h1")).alias("__h1"), apart(F.col("__h2")).alias("__h2"))
    joined = rows.join(per, ["__h1", "__h2"], "left")
    return joined.select("__row", F.coalesce("__leaks", F.array().cast(per.schema["__leaks"].dataType)).alias("__leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``__leaks``: an array of (item_id, distance, first_word, n_item_words), empty for clean rows."""
    own = docs.drop("__leaks")
    return _packed(own, benchmark, text, item_id, item_text, budget, block_bytes, min_words).select("__row.*", "__leaks")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", budget: float = BUDGET, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that hold no item, unchanged."""
    return _packed(docs, benchmark, text, item_id, item_text, budget, block_bytes, min_words).filter(F.size("__leaks") == 0).select("__row.*")
