"""Substring dedup with a log-structured fingerprint index.

Fingerprints.  Windows of ``WINDOW`` consecutive words are never listed one by
one.  Consecutive windows that share their anchor (the least hash among their
``ANCHOR``-word grams) form a fragment; equal windows have equal anchors, so
two equal windows lie either in equal fragments or in different fragments of
one anchor.  A fingerprint is a fragment: anchor hash, content hash, owner.

Index.  History is kept as immutable runs of fingerprints, sorted by anchor and
content, one for each batch, in a folder with a manifest: each state of the index
is a manifest of its own that names its runs, written whole and renamed, so the
index can be opened again by a later job and a lost job leaves the last state.
Of the runs only fingerprints whose anchor the batch may have (a bitmap of one
size) meet the batch, so the rest of the history is read but never shuffled:

* a fragment whose content has an owner with a smaller document id is covered
  as a whole;
* an anchor with different contents is contested: the windows of the first
  owner of each content (history's and the batch's), and of the content's other
  places in documents of the owner's id, are hashed one by one, and a window is
  covered if its 128-bit hash has a smaller owner.  This is the verification of
  anchor hits: whole windows are compared.

Then the batch becomes a run.  When there are more than ``MAX_RUNS`` runs they
are compacted into one that keeps the first owner of each content; the runs that
it replaces are deleted once the manifest names it.

Batches are ranges of document ids, so history always holds smaller ids; a
single batch gives the same result.  All joins by hash have one row for each
hash on one side, so Spark may split skewed partitions of the other; counts
combine on the map side; no group is gathered.

Defined results: null text has no words; null ids are larger than every id and
equal to each other; a window repeated in one document, or in rows of one id,
is not removed on their account; repeated rows get equal results; an empty table
gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import kernels as K
from ledgerlark.llm.bwt_dedup import FILTER_BITS, bitmap
from ledgerlark.llm.rows import apart, keyed, real_id
from ledgerlark.llm.shared import shared_folder, stored

WINDOW, ANCHOR = 50, 10
MAX_RUNS = 4
BATCHES = 2
SEED = 8
PRINT = "__id long, __rid long, anchor long, content long, start int, count int"


def fingerprints(base: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The fragments of (__id, __rid, __text)."""

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                data, offsets = K.columns_bytes(column.slice(i, j - i))
                start, end, at = K.words(data, offsets, ~K.SPACE)
                got = K.fragments(K.strong_hashes(data, start, end, SEED), at, window, anchor)
                pick = pa.array(got["row"] + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(pick), batch.column("__rid").take(pick), pa.array(got["anchor"]), pa.array(got["content"]), pa.array(got["start"].astype(np.int32)), pa.array(got["count"].astype(np.int32))],
                    names=["__id", "__rid", "anchor", "content", "start", "count"],
                )

    return base.mapInArrow(run, PRINT)


def window_hashes(asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__id, __rid, new, pos, w1, w2) of the windows in the stretches ``asked`` of (__id, __rid, __text, new, asked)."""

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                data, offsets = K.columns_bytes(column.slice(i, j - i))
                start, end, at = K.words(data, offsets, ~K.SPACE)
                words = K.strong_hashes(data, start, end, SEED)
                other = K.mix(words ^ np.uint64(0x94D049BB133111EB))
                asked_ = batch.column("asked").slice(i, j - i)
                inner = asked_.flatten()
                row = np.repeat(np.arange(j - i), np.diff(np.asarray(asked_.offsets)))
                first, n = (np.asarray(inner.field(f)).astype(np.int64) for f in ("start", "count"))
                from_ = np.repeat(at[row] + first - np.cumsum(n) + n, n) + np.arange(n.sum())
                # Overlapping or repeated requests of one row count once.
                from_ = np.unique(from_)
                row = np.searchsorted(at, from_, "right") - 1
                w1 = K.spans_hash(K.running(words), from_, from_ + window)
                w2 = K.spans_hash(K.running(other), from_, from_ + window)
                pick = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(pick), batch.column("__rid").take(pick), batch.column("new").take(pick), pa.array((from_ - at[row]).astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))],
                    names=["__id", "__rid", "new", "pos", "w1", "w2"],
                )

    return asked.mapInArrow(run, "__id long, __rid long, new boolean, pos int, w1 long, w2 long")


RUN = "anchor long, content long, __id long, __rid long, start int, count int"


def likely(history: DataFrame, prints: DataFrame) -> DataFrame:
    """The fingerprints of ``history`` whose anchor ``prints`` may have; a full bitmap spares none."""
    held = history.sparkSession.sparkContext.broadcast(np.packbits(bitmap(prints, "anchor")))

    def run(batches):
        bits = np.unpackbits(held.value).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[np.asarray(batch.column("anchor")) & ((1 << FILTER_BITS) - 1)]))

    return history.mapInArrow(run, history.schema)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints and the manifests that name them, in one folder that all machines share.

    A folder with a manifest is opened, another one is begun; window and anchor
    must be those it was begun with.  One job at a time may append: a second one
    fails when it commits.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, max_runs: int = MAX_RUNS, folder: str | None = None):
        self.spark, self.window, self.anchor, self.max_runs = spark, window, anchor, max_runs
        self.folder = (folder or f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}").rstrip("/")
        self.version, self.runs = 0, []
        path, fs = self._at("")
        if fs.exists(path):
            names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("manifest-"))
            if names:
                state = json.loads(spark.read.text(f"{self.folder}/{names[-1]}", wholetext=True).first()[0])
                if (state["window"], state["anchor"]) != (window, anchor):
                    raise ValueError(f"the index has windows of {state['window']} words and anchors of {state['anchor']}")
                self.version, self.runs = state["version"], state["runs"]

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commit(self, runs: list[str]) -> None:
        """The next state; fails if another job has committed it."""
        version = self.version + 1
        near, fs = self._at(f"next-{uuid.uuid4().hex}")
        out = fs.create(near, False)
        out.write(bytearray(json.dumps({"version": version, "window": self.window, "anchor": self.anchor, "runs": runs}).encode()))
        out.close()
        final, _ = self._at(f"manifest-{version:08d}.json")
        if fs.exists(final) or not fs.rename(near, final):
            fs.delete(near, False)
            raise RuntimeError(f"{self.folder} has another writer")
        self.version, self.runs = version, runs

    @staticmethod
    def owners(prints: DataFrame) -> DataFrame:
        """The first owner of each content and its number of places: one row for each (anchor, content)."""
        place = F.struct("__id", "__rid", "start", "count", "new")
        return prints.groupBy("anchor", "content").agg(F.min(place).alias("own"), F.count(F.lit(1)).alias("places"))

    def write(self, prints: DataFrame) -> str:
        """A run: first owners only, sorted, each file a range of anchors."""
        name = f"run-{uuid.uuid4().hex}"
        run = self.owners(prints).select("anchor", "content", "own.__id", "own.__rid", "own.start", "own.count")
        run.repartitionByRange("anchor", "content").sortWithinPartitions("anchor", "content").write.parquet(f"{self.folder}/{name}")
        return name

    def append(self, prints: DataFrame) -> None:
        self.commit([*self.runs, self.write(prints)])
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        old = self.runs
        self.commit([self.write(self.history())])
        for name in old:
            path, fs = self._at(name)
            fs.delete(path, True)

    def history(self) -> DataFrame | None:
        """All runs' fingerprints, none of them new."""
        if not self.runs:
            return None
        return self.spark.read.schema(RUN).parquet(*[f"{self.folder}/{r}" for r in self.runs]).withColumn("new", F.lit(False))

    def covered(self, batch: DataFrame, texts: DataFrame, keep: bool = True) -> DataFrame:
        """(__id, __rid, spans) of the batch's words that an earlier document has; then, with ``keep``, the batch is history.

        ``batch`` and ``texts`` are (__id, __rid, __text); ``texts`` also has the
        documents of the history.
        """
        prints = fingerprints(batch, self.window, self.anchor)
        prints = stored(prints)
        history = self.history()
        mine = prints.select("anchor", "content", "__id", "__rid", "start", "count", F.lit(True).alias("new"))
        both = mine if history is None else mine.unionByName(likely(history, prints).select(*mine.columns))
        owners = stored(self.owners(both))
        per_anchor = owners.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(apart(F.col("anchor")).alias("ka"))
        # Equal content, smaller owner: covered as a whole.
        key = owners.select(apart(F.col("anchor")).alias("ka"), apart(F.col("content")).alias("kc"), F.col("own.__id").alias("first"))
        whole = prints.withColumns({"ka": apart(F.col("anchor")), "kc": apart(F.col("content"))}).join(key, ["ka", "kc"]).filter(F.col("__id") > F.col("first"))
        whole = whole.select("__id", "__rid", F.col("start").alias("a"), (F.col("start") + F.col("count")).alias("b"))
        # Different contents of one anchor: their first owners' windows, one by one.
        # (Equal rows give them twice, which changes no minimum and no cover.)
        contested = owners.withColumn("ka", apart(F.col("anchor"))).join(per_anchor, "ka", "left_semi")
        # A content's further places under its owner's id are not covered as a whole: ask for them too.
        twice = contested.filter("own.new and places > 1").select("ka", apart(F.col("content")).alias("kc"), F.col("own.__id").alias("first"))
        again = prints.withColumns({"ka": apart(F.col("anchor")), "kc": apart(F.col("content"))}).join(twice, ["ka", "kc"]).filter(F.col("__id") == F.col("first"))
        asked = contested.select("own.*").unionByName(again.select("__id", "__rid", "start", "count", F.lit(True).alias("new")))
        asked = asked.groupBy(F.col("__id").alias("i"), F.col("__rid").alias("r")).agg(F.max("new").alias("new"), F.collect_set(F.struct("start", "count")).alias("asked"))
        asked = texts.join(asked, (F.col("__id") == F.col("i")) & (F.col("__rid") == F.col("r"))).select("__id", "__rid", "__text", "new", "asked")
        windows = stored(window_hashes(asked, self.window))
        first = windows.groupBy("w1", "w2").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).filter("first < last")
        first = first.select(apart(F.col("w1")).alias("k1"), apart(F.col("w2")).alias("k2"), "first")
        single = windows.withColumns({"k1": apart(F.col("w1")), "k2": apart(F.col("w2"))}).join(first, ["k1", "k2"]).filter(F.col("new") & (F.col("__id") > F.col("first")))
        single = single.select("__id", "__rid", F.col("pos").alias("a"), (F.col("pos") + 1).alias("b"))
        spans = whole.unionByName(single).groupBy("__id", "__rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("windows"))
        if keep:
            self.append(mine)
        return spans


KEPT = "n_words long, n_removed long, kept string, kept_sha256 string"


def removed(docs: DataFrame, spans: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(__id, __rid, n_words, n_removed, kept text or its SHA-256) of (__id, __rid, __text)."""
    spans = spans.select(F.col("__id").alias("i"), F.col("__rid").alias("r"), "windows")
    joined = docs.join(spans, (F.col("__id") == F.col("i")) & (F.col("__rid") == F.col("r")), "left").select("__id", "__rid", "__text", "windows")

    def run(batches):
        for batch in batches:
            column = batch.column("__text")
            for i, j in K.slices(column):
                data, offsets = K.columns_bytes(column.slice(i, j - i))
                start, end, at = K.words(data, offsets, ~K.SPACE)
                inner = batch.column("windows").slice(i, j - i)
                size = np.asarray(inner.value_lengths().fill_null(0)).astype(np.int64)
                row = np.repeat(np.arange(j - i), size)
                flat = inner.flatten()
                a, b = (np.asarray(flat.field(f)).astype(np.int64) for f in ("a", "b"))
                keep = ~K.covered(at[row] + a, at[row] + b + window - 1, len(start))
                # Kept words joined by one space: each word's bytes and a space, the last space of a row cut.
                s, e = start[keep], end[keep]
                to = np.append(0, np.cumsum(e - s + 1))
                buffer = np.append(data, np.uint8(32))
                index = np.repeat(s - to[:-1], e - s + 1) + np.arange(to[-1])
                index[to[1:] - 1] = len(data)
                body = buffer[index].tobytes()
                before = np.append(0, np.cumsum(keep))[at]
                n = np.diff(at)
                kept = np.diff(before)
                texts = [body[to[x] : max(to[x], to[y] - 1)] for x, y in zip(before, before[1:], strict=False)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), part.column("__rid"), pa.array(n), pa.array(n - kept), pa.array([None if digest else t.decode() for t in texts], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    names=["__id", "__rid", *(c.split()[0] for c in KEPT.split(", "))],
                )

    return joined.mapInArrow(run, f"__id long, __rid long, {KEPT}")


def bounds(base: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into about equal batches."""
    if batches < 2:
        return []
    cuts = base.filter(F.col("__id") < (1 << 63) - 1).stat.approxQuantile("__id", [k / batches for k in range(1, batches)], 0.01)
    return sorted({int(c) for c in cuts})


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept, kept_sha256 (kept null with ``digest``)."""
    base = keyed(docs, text, doc_id)
    index = FingerprintIndex(docs.sparkSession, window, anchor)
    cuts = bounds(base.select("__id"), batches)
    spans = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = base
        if low is not None:
            part = part.filter(F.col("__id") > low)
        if high is not None:
            part = part.filter(F.col("__id") <= high)
        seen = base if high is None else base.filter(F.col("__id") <= high)
        # Nothing comes after the last batch: its run would not be read.
        got = stored(index.covered(part, seen, keep=high is not None))
        spans = got if spans is None else spans.unionByName(got)
    return removed(base, spans, window, digest).select(real_id(F.col("__id")).alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")
