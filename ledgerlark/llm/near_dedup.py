"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (all words of a shorter document).  Its
weight is its count in the document times its IDF, the mean IDF of its words;
word document frequencies are counted over all documents in a table of
``SLOTS`` hashed slots, so what is broadcast has one size at every scale.

Each document is sampled ``BANDS * ROWS`` times by improved consistent weighted
sampling: two documents agree in a sample with a probability equal to their
weighted Jaccard similarity.  ``ROWS`` samples make a band; documents that
agree in a band meet in a bucket, and each link is verified by the exact
weighted Jaccard similarity of the texts.

Copies (equal word sequences) are grouped first and only one of them goes on.
Within a bucket all pairs are never formed:

1. every member meets the bucket's leader, the one that meets the most documents
   over all its buckets; most pairs are met many times and verified once;
2. after the components of these links are known, every member meets up to
   ``LEADERS`` of the next leaders and ``OTHERS`` members drawn for each band
   anew, as far as they lie in other components.  Buckets of more than ``LARGE``
   members are also cut finer, by the samples of neighbouring bands, and meet
   the leaders of the finer buckets;
3. all pairs of different components that a bucket still holds are compared, in
   blocks of members that carry their shingles.  Steps 1 and 2 only spare pairs
   of this step; it alone would find the same classes.

Texts are compared only where the samples leave a similarity of the threshold
possible (``LEAST_AGREEING`` of all samples agree: four deviations below it).

The result is the connected components of all verified links.

Defined results: documents without words (null, empty) are classes of their
own; repeated rows are copies of each other; the class id is the least document
id of the class, nulls last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm import kernels as K
from ledgerlark.llm.rows import apart, keyed, packed, real_id
from ledgerlark.llm.shared import components, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 3
LEADERS, OTHERS, LARGE, FINER = 6, 1, 64, 3
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
SLOTS = 1 << 16
SEED = 10
#: Samples that must agree for a pair of the second step to be verified: four deviations below the threshold.
LEAST_AGREEING = int(BANDS * ROWS * (THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5))


def word_table(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Document frequencies of the word slots, and the number of documents."""

    def run(batches):
        counts, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            column = batch.column(text)
            n += len(column)
            for i, j in K.slices(column):
                data, offsets = K.columns_bytes(column.slice(i, j - i))
                start, end, at = K.words(data, offsets, K.WORD)
                slot = (K.word_hashes(data, start, end, SEED, lower=True) >> np.uint64(48)).astype(np.int64)
                pair = np.unique(K.row_of(at) * SLOTS + slot)
                counts += np.bincount(pair % SLOTS, minlength=SLOTS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], names=["slot", "n"])

    rows = docs.select(text).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    table, total = np.zeros(SLOTS, np.int64), 0
    for slot, n in rows:
        if slot < 0:
            total = n
        else:
            table[slot] = n
    return table, total


def idf(table: np.ndarray, total: int) -> np.ndarray:
    return (np.log((1 + total) / (1 + table)) + 1).astype(np.float32)


def shingles(data: np.ndarray, offsets: np.ndarray, idf_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the rows of a slice.

    Returns the row offsets, hashes and weights of the shingles, and two
    64-bit hashes of each row's whole word sequence.
    """
    start, end, at = K.words(data, offsets, K.WORD)
    word = K.word_hashes(data, start, end, SEED, lower=True)
    sums = K.running(word)
    n = np.diff(at)
    whole = K.spans_hash(sums, at[:-1], at[1:])
    other = K.mix(K.spans_hash(K.running(K.mix(word ^ np.uint64(0x5851F42D4C957F2D))), at[:-1], at[1:]) ^ n.astype(np.uint64))
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    to = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(len(n)), count)
    first = at[row] + np.arange(to[-1]) - to[row]
    last = np.minimum(first + SHINGLE, at[row + 1])
    value = K.spans_hash(sums, first, last)
    weight = np.append(0, np.cumsum(idf_[(word >> np.uint64(48)).astype(np.int64)], dtype=np.float64))
    weight = ((weight[last] - weight[first]) / np.maximum(last - first, 1)).astype(np.float32)
    # Sum differences depend on what stands before in the slice: round, so that equal shingles weigh the same.
    weight = np.round(weight * 256) / 256
    order = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    value, weight, row = value[order], weight[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(value)))
    return np.searchsorted(row[begin], np.arange(len(n) + 1)), value[begin], weight[begin] * times.astype(np.float32), whole, other


class Sampler:
    """Improved consistent weighted sampling with tabled random variates.

    A sample's variates (r and c of Gamma(2, 1), uniform b) come from three
    tables, each indexed by 16 bits of its own of a hash of the shingle and the
    sample's number: 2^48 combinations, so that a text of any length is sampled
    by its shingles.  The sample is identified by the shingle of the least ln a
    and by that value, which holds the step t of the weight.
    """

    def __init__(self, samples: int):
        u = [(K.seeded(1 << 16, 100 + i) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2**-54 for i in range(5)]
        r, lnc, b = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
        self.inverse, self.shift, self.r, self.lnc = (1 / r).astype(np.float32), b.astype(np.float32), r.astype(np.float32), lnc.astype(np.float32)
        self.odd = K.seeded(samples, 77) | np.uint64(1)

    def signature(self, at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(rows, samples) of int32; rows without shingles hold zeros."""
        out = np.zeros((len(at) - 1, len(self.odd)), np.int32)
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            return out
        lnw = np.log(weight)
        # A few rows at a time keep the arrays in the cache.
        i = 0
        while i < len(full):
            j = i + 1
            while j < len(full) and at[full[j] + 1] - at[full[i]] <= 1 << 15:
                j += 1
            a, b = at[full[i]], at[full[j - 1] + 1]
            v, w, starts = value[a:b], lnw[a:b], at[full[i:j]] - a
            size = np.diff(np.append(starts, b - a))
            for k, odd in enumerate(self.odd):
                # The high bits of a product mix well; the halves are folded so that all index bits do.
                h = v * odd
                h = (h ^ (h >> np.uint64(32))) * odd
                x, y, z = (h >> np.uint64(48)).view(np.int64), ((h >> np.uint64(32)) & np.uint64(0xFFFF)).view(np.int64), ((h >> np.uint64(16)) & np.uint64(0xFFFF)).view(np.int64)
                r, shift = self.r[x], self.shift[z]
                t = np.floor(w * self.inverse[x] + shift)
                low = self.lnc[y] - r * (t + 1 - shift)
                least = np.minimum.reduceat(low, starts)
                # The first place of each row's least value (equal values: the least hash, as shingles are sorted by it).
                place = np.flatnonzero(low == np.repeat(least, size))
                place = place[np.searchsorted(place, starts)]
                out[full[i:j], k] = (K.mix(v[place] ^ least.view(np.uint32)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            i = j
        return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) of uint64."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            h = K.mix(h * np.uint64(K.BASE) + sig[:, k].view(np.uint32).astype(np.uint64))
        keys[:, b] = h
    return keys


SKETCH = "__id long, __rid long, t1 long, t2 long, n int, sig array<tinyint>, bands array<long>"


def sketches(base: DataFrame, idf_: np.ndarray) -> DataFrame:
    """One row for each document: hashes of its words, number of shingles, a byte of each sample, and band keys."""
    shared = base.sparkSession.sparkContext.broadcast(idf_)

    def run(batches):
        sampler = Sampler(BANDS * ROWS)
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                at, value, weight, whole, other = shingles(*K.columns_bytes(column.slice(i, j - i)), shared.value)
                sig = sampler.signature(at, value, weight)
                keys = band_keys(sig)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                short = (K.mix(sig.view(np.uint32).astype(np.uint64)) & np.uint64(255)).astype(np.uint8).view(np.int8)
                short = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS * ROWS, pa.int32()), pa.array(short.ravel()))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), part.column("__rid"), pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), pa.array(np.diff(at), pa.int32()), short, lists],
                    names=[c.split()[0] for c in SKETCH.split(", ")],
                )

    return base.mapInArrow(run, SKETCH)


def similarity(left: pa.Array, right: pa.Array, idf_: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts, row by row."""

    def keyed_(column):
        at, value, weight, _, _ = shingles(*K.columns_bytes(column), idf_)
        row = K.row_of(at)
        return row, (row.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)), weight

    (row, a, wa), (_, b, wb) = keyed_(left), keyed_(right)
    n = len(left)
    if not len(a) or not len(b):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    both = np.bincount(row[same], np.minimum(wa[same], wb[at[same]]), n)
    total = np.bincount(row, wa, n) + np.bincount((b >> np.uint64(44)).astype(np.int64), wb, n)
    return both / np.maximum(total - both, 1e-12)


def verified(pairs: DataFrame, texts: DataFrame, idf_: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, with their similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf_)

    def run(batches):
        for batch in batches:
            size = np.maximum(np.diff(K.columns_bytes(batch.column("ta"))[1]), np.diff(K.columns_bytes(batch.column("tb"))[1])).cumsum()
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + (1 << 20), "right")))
                part = batch.slice(i, j - i)
                s = similarity(part.column("ta"), part.column("tb"), shared.value)
                good = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good), pa.array(s[s >= threshold])], names=["a", "b", "similarity"])
                i = j

    first = texts.select(F.col("node").alias("a"), F.col("__text").alias("ta"))
    second = texts.select(F.col("node").alias("b"), F.col("__text").alias("tb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def rank(*columns) -> F.Column:
    return F.xxhash64(*columns, F.lit("rank"))


def buckets(members: DataFrame) -> DataFrame:
    """Members (key, band, node) of buckets with more than one, with the bucket's size and the node's weight.

    The weight is the sum of the sizes of the node's buckets: what lies in the
    middle of a group of near copies meets the most of them.
    """
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(apart(F.col("key")).alias("k"), "size")
    mates = stored(members.withColumn("k", apart(F.col("key"))).join(size, "k").select("key", "band", "node", "size"))
    weight = mates.groupBy("node").agg(F.sum("size").alias("weight")).select(apart(F.col("node")).alias("n"), "weight")
    return mates.withColumn("n", apart(F.col("node"))).join(weight, "n").drop("n")


def leader_pairs(mates: DataFrame) -> DataFrame:
    """(a, b): each member with its bucket's leader, the member of the largest weight."""
    head = mates.groupBy("key").agg(F.min(F.struct(-F.col("weight"), rank("node"), "node")).alias("head"))
    head = head.select(apart(F.col("key")).alias("k"), F.col("head.node").alias("leader"))
    met = mates.select("node", apart(F.col("key")).alias("k")).join(head, "k").filter("node <> leader")
    return met.select(*ordered("node", "leader")).distinct()


def ordered(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def unsettled(members: DataFrame) -> DataFrame:
    """Members (key, node, label) of buckets that hold more than one component."""
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(apart(F.col("key")).alias("k"))
    return members.withColumn("k", apart(F.col("key"))).join(mixed, "k", "left_semi").drop("k")


def further(members: DataFrame) -> DataFrame:
    """(node, others): members (key, node, label, weight, sig) with the bucket's further leaders in other components whose samples agree enough."""
    # The first of a bucket in two orders, first within salted parts of it.
    part = members.select("key", "node", "label", "sig", F.struct(-F.col("weight"), rank("node")).alias("r"), rank("key", "node").alias("q"), F.pmod(F.xxhash64("node"), F.lit(32)).alias("salt"))
    for x in ("r", "q"):
        part = part.withColumn(f"n_{x}", F.row_number().over(Window.partitionBy("key", "salt").orderBy(x)))
    part = part.filter((F.col("n_r") <= LEADERS) | (F.col("n_q") <= OTHERS))
    first = lambda x, n: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(x, "node", "label", "sig"))), 1, n), lambda h: F.struct(h["node"].alias("node"), h["label"].alias("label"), h["sig"].alias("sig")))
    heads = part.groupBy("key").agg(F.array_union(first("r", LEADERS), first("q", OTHERS)).alias("heads")).select(apart(F.col("key")).alias("k"), "heads")
    met = members.select("node", "label", "sig", apart(F.col("key")).alias("k")).join(heads, "k")
    agree = lambda h: F.size(F.filter(F.zip_with("sig", h["sig"], lambda x, y: x == y), lambda x: x))
    good = F.filter("heads", lambda h: (h["label"] != F.col("label")) & (agree(h) >= LEAST_AGREEING))
    return met.select("node", F.transform(good, lambda h: h["node"]).alias("others")).filter(F.size("others") > 0)


def profiles(texts: DataFrame, idf_: np.ndarray) -> DataFrame:
    """(node, shingles, weights): the distinct shingles of each text, by hash."""
    shared = texts.sparkSession.sparkContext.broadcast(idf_)

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                at, value, weight, _, _ = shingles(*K.columns_bytes(column.slice(i, j - i)), shared.value)
                # In the order of the unsigned hashes; shingles come in that of their high bits.
                row = K.row_of(at)
                order = np.lexsort((value, row))
                to = pa.array(at, pa.int32())
                lists = [pa.ListArray.from_arrays(to, pa.array(x)) for x in (value[order].view(np.int64), weight[order].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), *lists], names=["node", "shingles", "weights"])

    return texts.mapInArrow(run, "node long, shingles array<long>, weights array<float>")


def lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and n + 1 offsets."""
    whole = column.combine_chunks()
    return np.asarray(whole.flatten()), np.append(0, np.cumsum(np.asarray(whole.value_lengths()), dtype=np.int64))


def remaining(members: DataFrame, profiles_: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): the links among all pairs of members (key, band, node, label, n, sig, bands) of a bucket in different components.

    What lies outside the bucket's largest component meets the whole bucket, in
    blocks of ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles.  A pair whose
    samples agree enough is compared by its shingles within the block, in the
    first bucket that both share; only links leave it.
    """
    size = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).groupBy("key")
    size = size.agg(F.max(F.struct("c", "label", "n")).alias("main"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    size = size.select(apart(F.col("key")).alias("k"), F.col("main.label").alias("main"), blocks(F.col("c") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("rows"), blocks(F.col("c"), F.col("n")).alias("columns"))
    met = members.withColumn("k", apart(F.col("key"))).join(size, "k")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "band", "node", "label", "sig", "bands"]
    outer = met.filter("label <> main").select(*kept, F.lit(True).alias("outer"), place("rows").alias("i"), each("columns").alias("j"))
    whole = met.select(*kept, F.lit(False).alias("outer"), each("rows").alias("i"), place("columns").alias("j"))
    found = profiles_.withColumn("m", apart(F.col("node"))).drop("node")
    cells = outer.unionByName(whole).withColumn("m", apart(F.col("node"))).join(found, "m").drop("m")

    def run(cell: pa.Table) -> pa.Table:
        node, label, outer = (cell.column(c).to_numpy() for c in ("node", "label", "outer"))
        sig, bands = (lists_of(cell.column(c))[0].reshape(len(node), -1) for c in ("sig", "bands"))
        value, at = lists_of(cell.column("shingles"))
        value = value.view(np.uint64)
        weight = lists_of(cell.column("weights"))[0].astype(np.float64)
        total = np.add.reduceat(weight, at[:-1])
        band = int(cell.column("band")[0].as_py())
        y = np.flatnonzero(~outer)
        out = [np.zeros((2, 0), np.int64)], [np.zeros(0)]
        for i in np.flatnonzero(outer):
            good = y[((sig[y] == sig[i]).sum(axis=1) >= LEAST_AGREEING) & (label[y] != label[i])]
            good = good[(bands[good] == bands[i]).argmax(axis=1) == band]
            own, own_weight = value[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
            step = 0
            while step < len(good):
                # So many partners at a time that their shingles fit the cache.
                part = good[step : step + max(1, (1 << 17) // max(1, len(own)))]
                step += len(part)
                length = at[part + 1] - at[part]
                edge = np.append(0, np.cumsum(length))
                place = np.arange(edge[-1]) + np.repeat(at[part] - edge[:-1], length)
                where = np.minimum(np.searchsorted(own, value[place]), len(own) - 1)
                shared = np.where(own[where] == value[place], np.minimum(own_weight[where], weight[place]), 0.0)
                both = np.add.reduceat(shared, edge[:-1])
                s = both / np.maximum(total[i] + total[part] - both, 1e-12)
                links = part[s >= threshold]
                out[0].append(np.stack([np.minimum(node[links], node[i]), np.maximum(node[links], node[i])]))
                out[1].append(s[s >= threshold])
        (a, b), s = np.concatenate(out[0], axis=1), np.concatenate(out[1])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "similarity": pa.array(s)})

    # Two members that both lie outside the largest component meet twice.
    return cells.groupBy("key", "i", "j").applyInArrow(run, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def agreeing(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """The pairs whose samples (node, sig) agree often enough for the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            good = pa.array((x == y).sum(axis=1) >= LEAST_AGREEING)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    first, second = samples.select(F.col("node").alias("a"), F.col("sig").alias("sa")), samples.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def finer(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Members of large buckets under finer keys, made of the key and neighbouring bands."""
    large = members.filter(F.col("size") > LARGE).join(heads.select("node", "bands"), "node")
    steps = F.array(*[F.xxhash64("key", F.lit(s), F.get("bands", (F.col("band") + s) % BANDS)) for s in range(1, FINER + 1)])
    return large.select(F.explode(steps).alias("key"), "node", "label", "weight", "sig")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_size, and the keys of the row and of its class's first row.

    __node is a number of the row, __first whether the row is the one of its
    class that a dedup keeps (least id, then least number).
    """
    base = keyed(docs, text, doc_id)
    table = idf(*word_table(base, "__text"))
    rows = stored(sketches(base, table).withColumn("node", F.monotonically_increasing_id()))
    copies = rows.filter("n > 0").groupBy("t1", "t2").agg(F.min("node").alias("head"))
    heads = rows.join(copies.select(F.col("head").alias("node")), "node", "left_semi")
    mates = stored(buckets(heads.select("node", F.posexplode("bands").alias("band", "key"))))
    wanted = mates.select("node").distinct()
    heads = stored(heads.join(wanted, "node", "left_semi").select("node", "__id", "__rid", "n", "sig", "bands"))
    found = heads.select("node", F.col("__id").alias("i"), F.col("__rid").alias("r"))
    texts = stored(base.join(found, (F.col("__id") == F.col("i")) & (F.col("__rid") == F.col("r"))).select("node", "__text").dropDuplicates(["node"]))
    met = agreeing(leader_pairs(mates), heads.select("node", "sig"))
    links = stored(verified(met, texts, table, threshold))
    label = components(links)
    named = mates.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = stored(unsettled(named).join(heads.select("node", "sig"), "node"))
    # A node meets the same leaders in many buckets: list each once before pairs are made.
    met = further(open_).unionByName(further(unsettled(finer(open_, heads)))).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    pairs = stored(met.select("node", F.explode("others").alias("other")).select(*ordered("node", "other")).distinct())
    links = stored(links.unionByName(verified(pairs, texts, table, threshold)))
    label = components(links.select("a", "b"))
    # Up to LEADERS + 1 members have all met by now.
    named = mates.filter(F.col("size") > LEADERS + 1).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = stored(unsettled(named).join(heads.select("node", "n", "sig", "bands"), "node").select("key", "band", "node", "label", "n", "sig", "bands"))
    shapes = stored(profiles(texts.join(rest.select("node").distinct(), "node", "left_semi"), table))
    more = stored(remaining(rest, shapes, threshold))
    if not more.isEmpty():
        label = components(links.unionByName(more).select("a", "b"))
    label = label.withColumnRenamed("node", "head")
    # From the copies' heads to all rows.
    copies = copies.select(apart(F.col("t1")).alias("k1"), apart(F.col("t2")).alias("k2"), "head")
    named = rows.select("__id", "__rid", "node", "n", apart(F.col("t1")).alias("k1"), apart(F.col("t2")).alias("k2")).join(copies, ["k1", "k2"], "left")
    named = named.withColumn("head", F.coalesce(F.when(F.col("n") > 0, F.col("head")), F.col("node")))
    named = named.join(label, "head", "left").withColumn("class", F.coalesce("label", "head"))
    named = stored(named.select("__id", "__rid", "node", "class"))
    summary = named.groupBy("class").agg(F.min(F.struct("__id", "node")).alias("first"), F.count(F.lit(1)).alias("class_size")).select(apart(F.col("class")).alias("c"), "first", "class_size")
    out = named.withColumn("c", apart(F.col("class"))).join(summary, "c")
    return out.select(real_id(F.col("__id")).alias("doc_id"), real_id(F.col("first.__id")).alias("class_id"), "class_size", F.col("node").alias("__node"), "__id", "__rid", (F.col("node") == F.col("first.node")).alias("__first"))


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, unchanged.

    Rows of equal id and text cannot be told apart; of those that stay, one does.
    """
    found = near_duplicates(docs, text, doc_id, threshold)
    per = stored(found.groupBy("__id", "__rid").agg(F.max("__first").alias("stays"), F.count(F.lit(1)).alias("rows")))
    gone = per.filter("not stays").select(F.col("__id").alias("__i"), F.col("__rid").alias("__r"))
    left = packed(docs, text, doc_id).join(gone, (F.col("__k") == F.col("__i")) & (F.col("__h") == F.col("__r")), "left_anti")
    many = per.filter("stays and rows > 1").select(F.col("__id").alias("__i"), F.col("__rid").alias("__r"), F.lit(True).alias("__many"))
    if many.isEmpty():
        return left.select("__row.*")
    marked = left.join(many, (F.col("__k") == F.col("__i")) & (F.col("__h") == F.col("__r")), "left")
    once = marked.filter("__many").dropDuplicates(["__k", "__h"])
    return marked.filter("__many is null").unionByName(once).select("__row.*")
