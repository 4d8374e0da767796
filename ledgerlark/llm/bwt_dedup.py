"""Exact substring dedup of bytes by merging Burrows-Wheeler transforms.

A byte goes if it is covered by a ``WINDOW``-byte string that also starts
anywhere else, in the same document or another.

Fragments.  Consecutive windows that share their anchor (the least hash among
their ``ANCHOR``-byte grams) form a fragment, so equal windows lie either in
equal fragments at equal places, or in different fragments of one anchor.  An
anchor that occurs once is of no further interest; a fragment whose content
occurs twice is repeated as a whole; what remains are anchors with different
contents, of which one copy each is looked at.

Merging.  The contents of whole anchor groups are brought together in bounded
batches.  A content is read as a string of 8-byte symbols in phase with its
anchor, so equal windows have equal symbols.  A batch is dealt to ``SHARDS``
shards; each shard sorts its suffixes and forms its transform, and the shards
are merged by interleave refinement: an interleave vector says from which shard
each merged suffix comes; one pass reads the shards' transforms in its order
and distributes the entries stably by symbol, which sorts the merged suffixes by
one symbol more.  ``WINDOW // 8 - 1`` passes sort them as far as a window
reaches; no suffix of the union is sorted again.  Beside the vector runs the
length of the common prefix of neighbours, and from it the intervals of
suffixes that share all whole symbols of a window.  The at most 7 + 8 bytes of a
window outside its whole symbols are compared as they are, so a window is
repeated exactly if an entry of its interval has the same outer bytes.

Hot anchors (more than ``MOST`` different contents) do not fit a batch: their
contents are cut into fragments with longer anchors (``FINER``), which go
through the same steps, and those still hot with whole windows as anchors,
where equal content is all there is.

Defined results: null text is empty; repeated rows repeat each other; null ids
pass through; a text shorter than a window stays whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import kernels as K
from ledgerlark.llm.rows import apart, keyed, real_id
from ledgerlark.llm.shared import stored

WINDOW, ANCHOR = 200, 32
#: Anchor lengths for hot groups; the last is the window itself.
FINER = (120, 200)
MOST = 200
SHARDS = 4
BATCH_BYTES = 1 << 20
SYMBOL = 8
SEED = 6


# --- transforms ---------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of strings, each ended by a 0, sorted by ``depth`` symbols at least (prefix doubling).

    Ends differ from each other, in the order of the strings.
    """
    end = text == 0
    rank = np.where(end, np.cumsum(end) - 1, text + int(end.sum()))
    have = 1
    while True:
        ahead = np.zeros(len(text), np.int64)
        if have < depth:
            ahead[: len(text) - have] = rank[have:] + 1
        pair = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(pair, kind="stable")
        if have >= depth:
            return order
        step = pair[order]
        new = np.append(0, np.cumsum(step[1:] != step[:-1]))
        if new[-1] == len(text) - 1:
            return order
        rank = np.empty(len(text), np.int64)
        rank[order] = new
        have *= 2


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix; 0 before a string's first."""
    return np.where(order > 0, text[order - 1], 0)


def merge(parts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges shards' transforms by interleave refinement.

    Returns for the merged suffixes, in the order of their first ``depth``
    symbols: the shard, the place in the shard's order, and the length of the
    prefix shared with the suffix before (``depth`` at most).
    """
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate(parts)
    n, ends = len(flat), [int((p == 0).sum()) for p in parts]
    low = sum(ends)
    vector = np.repeat(np.arange(len(parts)), sizes)
    #: The suffixes that are an end alone stand first, in the order of the shards.
    first = np.repeat(np.arange(len(parts)), ends)
    common, block = np.zeros(n, np.int16), np.zeros(n, np.int64)
    place = np.empty(n, np.int64)

    def locate() -> None:
        for s, b in enumerate(begin):
            mine = np.flatnonzero(vector == s)
            place[mine] = np.arange(b, b + len(mine))

    for h in range(1, depth + 1):
        locate()
        symbol = flat[place]
        order = np.argsort(symbol, kind="stable")
        vector = np.concatenate([first, vector[order[low:]]])
        c, old = symbol[order], block[order]
        fresh = np.ones(n, bool)
        fresh[low + 1 :] = (c[low + 1 :] != c[low:-1]) | (old[low + 1 :] != old[low:-1])
        # A boundary is as deep as when it first showed.
        before = common[fresh]
        common[fresh] = np.where(before == 0, 0, np.minimum(before, h - 1))
        common[~fresh] = h
        block = np.cumsum(fresh)
        if block[-1] == n:
            break
    locate()
    return vector, place - begin[vector], common


def repeated_windows(texts: list[bytes], phases: np.ndarray, window: int = WINDOW, shards: int = SHARDS) -> list[np.ndarray]:
    """For each content the windows (a mask) that another content of the batch has too, in the same phase."""
    inner = (window - SYMBOL) // SYMBOL
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts) + bytes(SYMBOL), np.uint8)
    count = (size - phases) // SYMBOL
    total = int(count.sum())
    string = np.repeat(np.arange(len(texts)), count)
    number = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at = start[string] + phases[string] + SYMBOL * number
    raw = data[at[:, None] + np.arange(SYMBOL)].copy().view(">u8").ravel()
    symbols = np.unique(raw, return_inverse=True)[1] + 1
    # Strings with their ends; suffix (string, number) stands at base[string] + number.
    base = np.cumsum(count + 1) - count - 1
    whole = np.zeros(total + len(texts), np.int64)
    whole[base[string] + number] = symbols
    edges = np.unique(np.linspace(0, len(texts), shards + 1).astype(int))
    cut = [int(base[e]) if e < len(texts) else len(whole) for e in edges]
    arrays = [suffix_array(whole[a:b], inner) for a, b in zip(cut, cut[1:], strict=False)]
    vector, place, common = merge([transform(whole[a:b], sa) for (a, b), sa in zip(zip(cut, cut[1:], strict=False), arrays, strict=True)], inner)
    flat = np.concatenate([sa + a for a, sa in zip(cut, arrays, strict=False)])
    first = np.cumsum([0, *(len(x) for x in arrays)])
    suffix = flat[first[vector] + place]
    interval = np.empty(len(whole), np.int64)
    interval[suffix] = np.cumsum(common < inner)
    # Windows: interval of the first whole symbol, and the bytes outside the whole symbols.
    windows = np.maximum(size - window + 1, 0)
    own = np.repeat(np.arange(len(texts)), windows)
    i = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    lead = (phases[own] - i) % SYMBOL
    symbol = (i + lead - phases[own]) // SYMBOL
    column = np.arange(SYMBOL)
    byte = np.where(column < lead[:, None], i[:, None] + column, i[:, None] + inner * SYMBOL + column)
    outer = data[start[own][:, None] + byte].copy().view(">u8").ravel()
    key = np.empty(len(own), [("i", np.int64), ("o", np.uint64)])
    key["i"], key["o"] = interval[base[own] + symbol] * SYMBOL + lead, outer
    order = np.lexsort((key["o"], key["i"]))
    k = key[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(own), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return np.split(hit, np.cumsum(windows)[:-1])


# --- the flow -----------------------------------------------------------------

PRINT = "__id long, __rid long, __off int, anchor long, content long, start int, count int, phase tinyint"
FILTER_BITS = 24


def bitmap(frame: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits of a long column's low bits: one size at every scale.

    It only spares rows that cannot match; a full one spares none.
    """
    h = F.col(column).bitwiseAND((1 << FILTER_BITS) - 1) + 1
    rows = frame.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    out = np.zeros(1 << FILTER_BITS, bool)
    for r in rows:
        out[(r.b - 1) * 32768 : r.b * 32768] = np.unpackbits(np.frombuffer(bytes(r.m), np.uint8), bitorder="little")
    return out


def fragments(source: DataFrame, window: int, anchor: int, wanted: np.ndarray | None = None) -> DataFrame:
    """The fragments of (__id, __rid, __off, __text binary); ``wanted``: only anchors in the bitmap."""
    table = K.seeded(256, SEED)
    held = None if wanted is None else source.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        bits = None if held is None else np.unpackbits(held.value).view(bool)
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                data, offsets = K.columns_bytes(column.slice(i, j - i))
                got = K.fragments(table[data], offsets, window, anchor)
                if bits is not None:
                    keep = bits[got["anchor"] & ((1 << FILTER_BITS) - 1)]
                    got = {k: v[keep] for k, v in got.items()}
                pick = pa.array(got["row"] + i)
                off = batch.column("__off").take(pick)
                begin = got["start"] + np.asarray(off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(pick), batch.column("__rid").take(pick), off, pa.array(got["anchor"]), pa.array(got["content"]), pa.array(begin.astype(np.int32)), pa.array(got["count"].astype(np.int32)), pa.array((got["offset"] % SYMBOL).astype(np.int8))],
                    names=[c.split()[0] for c in PRINT.split(", ")],
                )

    return source.mapInArrow(run, PRINT)


CONTENT = "__id long, __rid long, __off int, anchor long, n long, hot boolean, phase tinyint, __text binary"


def contents(source: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The asked fragments' bytes."""
    bits = bitmap(asked, "__rid")
    held = source.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def likely(batches):
        bits = np.unpackbits(held.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[np.asarray(batch.column("__rid")) & ((1 << FILTER_BITS) - 1)]))

    place = F.struct("start", "count", "phase", "anchor", "n", "hot")
    asked = asked.groupBy(F.col("__id").alias("i"), F.col("__rid").alias("r"), F.col("__off").alias("o")).agg(F.collect_list(place).alias("asked"))
    some = source.mapInArrow(likely, source.schema)
    joined = some.join(asked, (F.col("__id") == F.col("i")) & (F.col("__rid") == F.col("r")) & (F.col("__off") == F.col("o"))).select("__id", "__rid", "__off", "__text", "asked").dropDuplicates(["__id", "__rid", "__off"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                lists, inner = part.column("asked"), part.column("asked").flatten()
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                f = {c: inner.field(c) for c in ("start", "count", "phase", "anchor", "n", "hot")}
                texts, off = part.column("__text"), np.asarray(part.column("__off"))
                begin, size = np.asarray(f["start"]) - off[row], np.asarray(f["count"]) + window - 1
                body = [texts[r].as_buffer() for r in range(part.num_rows)]
                cut = [body[r].slice(int(b), int(s)).to_pybytes() for r, b, s in zip(row, begin, size, strict=True)]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("__id").take(pick), part.column("__rid").take(pick), f["start"], f["anchor"], f["n"], f["hot"], f["phase"], pa.array(cut, pa.binary())], names=[c.split()[0] for c in CONTENT.split(", ")])

    return joined.mapInArrow(run, CONTENT)


def merged_spans(groups: DataFrame, window: int) -> DataFrame:
    """(__id, __rid, a, b): runs of repeated windows of contents, anchor groups whole."""

    def run(batches):
        held: list[tuple] = []
        weight = 0

        def flush():
            hits = repeated_windows([r[5] for r in held], np.array([r[4] for r in held], np.int64), window)
            out: list[tuple] = []
            for (id_, rid, off, _, _, _, n), hit in zip(held, hits, strict=True):
                if n > 1 or not hit.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                out += [(id_, rid, off + int(a), off + int(b)) for a, b in edge.reshape(-1, 2)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["__id", "__rid", "a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("__id", "__rid", "__off", "anchor", "phase", "__text", "n")), strict=True):
                if weight > BATCH_BYTES and r[3] != held[-1][3]:
                    yield flush()
                    held, weight = [], 0
                held.append(r)
                weight += len(r[5])
        if held:
            yield flush()

    return groups.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "__id long, __rid long, a int, b int")


def repeated(source: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, finer: tuple[int, ...] = FINER, most: int = MOST) -> DataFrame:
    """(__id, __rid, a, b): runs of window starts whose window also starts elsewhere in ``source``."""
    found = fragments(source, window, anchor).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    twice = stored(found.filter("n > 1").select(apart(F.col("anchor")).alias("ka"), "anchor", (F.col("lo") != F.col("hi")).alias("mixed")))
    again = fragments(source, window, anchor, bitmap(twice, "anchor")).withColumn("ka", apart(F.col("anchor")))
    live = stored(again.join(twice.select("ka", "mixed"), "ka").drop("ka"))
    span = ["__id", "__rid", F.col("start").alias("a"), (F.col("start") + F.col("count")).alias("b")]
    out = live.filter("not mixed").select(*span)
    mixed = live.filter("mixed")
    place = F.struct("__id", "__rid", "__off", "start", "count", "phase")
    owners = stored(mixed.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("own")))
    # Repeated contents: all but those with one place.  Joined by place, which no hot content can gather.
    at = ["__id", "__rid", "__off", "start"]
    once = owners.filter("n = 1").select(*[F.col(f"own.{c}").alias(c) for c in at])
    out = out.unionByName(mixed.join(once, at, "left_anti").select(*span))
    groups = owners.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select(apart(F.col("anchor")).alias("ka"), (F.col("c") > most).alias("hot"))
    asked = stored(owners.withColumn("ka", apart(F.col("anchor"))).join(groups, "ka").select("anchor", "n", "hot", "own.*"))
    parts = stored(contents(source, asked, window))
    out = out.unionByName(merged_spans(parts.filter("not hot"), window))
    if finer:
        hot = parts.filter("hot")
        if not hot.isEmpty():
            out = out.unionByName(repeated(hot.select("__id", "__rid", "__off", "__text"), window, finer[0], finer[1:], most))
    return out


KEPT = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def dedup_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept bytes (null with ``digest``) and their SHA-256."""
    base = keyed(docs, text, doc_id).withColumn("__text", F.col("__text").cast("binary"))
    source = base.select("__id", "__rid", F.lit(0).alias("__off"), "__text")
    spans = stored(repeated(source, window, anchor, tuple(x for x in FINER if anchor < x < window) + (window,)))
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(spans, "__rid")))

    def part(inside: bool):
        def run(batches):
            bits = np.unpackbits(held.value).view(bool)
            for batch in batches:
                yield batch.filter(pa.array(bits[np.asarray(batch.column("__rid")) & ((1 << FILTER_BITS) - 1)] == inside))

        return base.mapInArrow(run, base.schema)

    per = spans.groupBy(F.col("__id").alias("i"), F.col("__rid").alias("r")).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("runs"))
    joined = part(True).join(per, (F.col("__id") == F.col("i")) & (F.col("__rid") == F.col("r")), "left").select("__id", "__text", "runs")

    def cut(batches):
        for whole in batches:
            for i, j in K.slices(whole.column("__text")):
                batch = whole.slice(i, j - i)
                rows = []
                for body, runs in zip(batch.column("__text"), batch.column("runs"), strict=True):
                    data = np.frombuffer(body.as_buffer(), np.uint8)
                    gone = np.zeros(len(data), bool)
                    if runs.is_valid:
                        a, b = (np.asarray(runs.values.field(f)).astype(np.int64) for f in ("a", "b"))
                        gone = K.covered(a, b + window - 1, len(data))
                    kept = data[~gone].tobytes()
                    n_runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1))
                    rows.append((len(data), int(gone.sum()), n_runs, None if digest else kept, hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["__id", *(c.split()[0] for c in KEPT.split(", "))])

    touched = joined.mapInArrow(cut, f"__id long, {KEPT}")
    n = F.octet_length("__text").cast("long")
    whole = part(False).select("__id", n.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(None).cast("binary").alias("kept") if digest else F.col("__text").alias("kept"), F.sha2("__text", 256).alias("kept_sha256"))
    return touched.unionByName(whole).withColumn("doc_id", real_id(F.col("__id"))).select("doc_id", *(c.split()[0] for c in KEPT.split(", ")))
