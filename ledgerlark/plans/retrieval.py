"""Retrieval: chunks, sparse and dense similarity, rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.text import REFERENCE_HEADINGS, section_of
from ledgerlark.operators.ordered import top_k_per
from ledgerlark.session import cut, kept
from ledgerlark.sources.files import exists


def pieces(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that occurs, with overlap."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s in text), "")
    if not sep:
        step = size - overlap
        return [c for i in range(0, max(1, len(text) - overlap), step) if (c := text[i : i + size]).strip()]
    parts = text.split(sep)
    parts = [parts[0], *[sep + p for p in parts[1:]]]
    rest = separators[separators.index(sep) + 1 :]
    out: list[str] = []
    held: list[str] = []
    width = 0

    def flush() -> None:
        if held and (joined := "".join(held)).strip():
            out.append(joined.strip())

    for p in parts:
        if len(p) > size:
            flush()
            held, width = [], 0
            out += pieces(p, size, overlap, rest)
            continue
        if width + len(p) > size:
            flush()
            while held and (width > overlap or width + len(p) > size):
                width -= len(held.pop(0))
        held.append(p)
        width += len(p)
    flush()
    return out


def chunks(docs: DataFrame, text: str, size: int = 1200, overlap: int = 150, separators: tuple[str, ...] = ("\n## ", "\n### ", "\n", " ")) -> DataFrame:
    """``docs`` without its text, one row a chunk: page (from 1), content.  Overlap must be less than size."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the chunk size")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pieces(x or "", size, overlap, separators))

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(cut(text)).alias("page", "content")).withColumn("page", F.col("page") + 1)


def terms(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, term, tf): lower-cased words of two characters or more, and their bigrams."""
    less = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    grams = lambda w: F.concat(w, F.zip_with(F.slice(w, 1, less(w)), F.slice(w, 2, less(w)), lambda a, b: F.concat(a, F.lit(" "), b)))
    # Texts are dealt by document, so that their many terms need not be.
    # Inside a lambda the words are found once, however often they are named.
    both = docs.select(ident, text).repartition(ident).select(ident, F.explode(F.flatten(F.transform(F.array(_words(text)), grams))).alias("term"))
    return both.groupBy(ident, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, ident: str, text: str, features: int = 50_000) -> DataFrame:
    """(ident, term, weight): smoothed IDF, L2-normalised; the ``features`` most frequent terms of the corpus."""
    tf = cut(terms(docs, ident, text))
    n = docs.select(ident).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    vocabulary = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(features)
    weighted = tf.join(F.broadcast(vocabulary), "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1))
    norm = weighted.groupBy(ident).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, ident).select(ident, "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Counters that bound the totals of the terms that fall into them; they only spare terms that cannot be among the features.
SLOTS = 1 << 20
#: Terms that a task counts at once, and how many of the most frequent of them it tells.
COUNTED, TOLD = 1 << 22, 1 << 16
#: Bytes that Python gets at once, and words that it takes of them.
BATCH_BYTES, WORDS = 16 << 20, 1 << 19


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def _bigram(a: Column, b: Column) -> Column:
    """The hash of two words that follow each other, from theirs; :func:`_terms_of` makes the same."""
    return F.shiftleft(a, 1).bitwiseOR(F.shiftrightunsigned(a, 63)).bitwiseXOR(b)


def _pieces(batches: Iterator) -> Iterator:
    """Parts of the batches whose words and their order fit a core's cache, by their average; a longer text is held alone."""
    for batch in batches:
        step = max(1, batch.num_rows * WORDS // max(1, len(batch.column("texts").flatten().flatten())))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each value of an ordered array begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _terms_of(batch) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each word and each bigram of a batch, as hashes; no bigram crosses from a text to the next one of the same id."""
    texts = batch.column("texts")
    each = texts.flatten()
    words = np.asarray(each.flatten())
    text = np.repeat(np.arange(len(each), dtype=np.int32), np.asarray(each.value_lengths()))
    row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.asarray(texts.value_lengths()))[text]
    first = words[:-1].view(np.uint64)
    follows = text[1:] == text[:-1]
    grams = (((first << np.uint64(1)) | (first >> np.uint64(63))).view(np.int64) ^ words[1:])[follows]
    return np.concatenate([row, row[1:][follows]]), np.concatenate([words, grams])


def _hashed_words(docs: DataFrame, ident: str, text: str) -> tuple[DataFrame, int]:
    """((ident, texts), number of ids): the hashes of the words of each id's texts, kept as a table."""
    conf, size = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(size, None) is None or not 0 < int(conf.get(size)) <= BATCH_BYTES:
        conf.set(size, str(BATCH_BYTES))
    rows, ids = docs.agg(F.count(F.lit(1)), F.countDistinct(ident)).first()
    # One file may hold all texts: they are dealt before they are read word by word.
    own = F.coalesce(F.transform(_words(text), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>")).alias("words")
    each = docs.select(ident, text).repartition(ident).select(ident, own)
    each = each.select(ident, F.array("words").alias("texts")) if rows == ids else each.groupBy(ident).agg(F.collect_list("words").alias("texts"))
    return kept(each, "zstd"), ids


def _reached(totals: DataFrame, features: int) -> tuple[int, int, int] | None:
    """The total that ``features`` rows reach, the number of rows above it and of those that have it; none if there are fewer rows.  Only numbers of rows by total meet in one place."""
    above = 0
    for total, n in sorted(map(tuple, totals.groupBy("total").agg(F.count(F.lit(1))).collect()), reverse=True):
        if above + n >= features:
            return total, above, n
        above += n
    return None


def _bounds(words: DataFrame, features: int) -> tuple[np.ndarray, int]:
    """(slots, least): the sum of the totals of the terms of each slot, and a total that ``features`` terms reach at least."""
    pieces = 64

    def run(batches):
        slots, held, counted = np.zeros(SLOTS, np.int64), [], 0

        def told():
            term, total = np.unique(np.concatenate(held), return_counts=True)
            if len(term) > TOLD:
                most = np.argpartition(-total, TOLD)[:TOLD]
                term, total = term[most], total[most]
            nothing = [pa.nulls(len(term), t) for t in (pa.int32(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(total.astype(np.int64)), *nothing], names=["term", "total", "piece", "slots"])

        def sums():
            part = [x.astype(np.int32).tobytes() for x in np.split(slots, pieces)]
            nothing = [pa.nulls(pieces, pa.int64()) for _ in range(2)]
            return pa.RecordBatch.from_arrays([*nothing, pa.array(range(pieces), pa.int32()), pa.array(part, pa.binary())], names=["term", "total", "piece", "slots"])

        for batch in _pieces(batches):
            _, term = _terms_of(batch)
            if slots.max() + len(term) >= 1 << 31:
                yield sums()
                slots[:] = 0
            slots += np.bincount(term & (SLOTS - 1), minlength=SLOTS)
            held, counted = [*held, term], counted + len(term)
            if counted >= COUNTED:
                yield told()
                held, counted = [], 0
        if counted:
            yield told()
        yield sums()

    def added(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, x in zip(batch.column("piece").to_pylist(), batch.column("slots")):
                out[piece] = out.get(piece, 0) + np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["piece", "slots"])

    found = kept(words.mapInArrow(run, "term long, total long, piece int, slots binary"), "zstd")
    slots = np.zeros((pieces, SLOTS // pieces), np.int64)
    for r in found.filter("piece is not null").select("piece", "slots").repartition(16, "piece").mapInArrow(added, "piece int, slots binary").collect():
        slots[r.piece] += np.frombuffer(r.slots, np.int64)
    # What tasks have told of a term is a part of its total.
    last = _reached(found.filter("term is not null").groupBy("term").agg(F.sum("total").alias("total")), features)
    return slots.reshape(-1), last[0] if last else 1


def _named(docs: DataFrame, ident: str, text: str, tied: DataFrame, some: int) -> DataFrame:
    """(term, name) of tied terms (term, ident), by the texts of the one id that each was seen in; ``some``: how many they are."""
    ids = tied.select(F.col(ident).alias("__id")).distinct()
    docs = docs.select(ident, text).join(F.broadcast(ids) if some <= 100_000 else ids, F.col(ident).eqNullSafe(F.col("__id")), "left_semi")
    one = lambda w: F.struct(w.alias("name"), F.xxhash64(w).alias("term"))
    two = lambda a, b: F.struct(F.concat(a["name"], F.lit(" "), b["name"]).alias("name"), _bigram(a["term"], b["term"]).alias("term"))
    less = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    both = lambda w: F.concat(w, F.zip_with(F.slice(w, 1, less(w)), F.slice(w, 2, less(w)), two))
    each = docs.select(F.explode(F.flatten(F.transform(F.array(F.transform(_words(text), one)), both))).alias("t")).select("t.term", "t.name")
    return each.join(tied.select("term"), "term", "left_semi").distinct()


def _chosen(docs: DataFrame, ident: str, text: str, words: DataFrame, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(term, df) of the ``features`` most frequent terms, of equal totals those first by name; the most widespread first."""
    slots, least = _bounds(words, features)
    able = np.packbits(slots >= least)

    def run(batches):
        may = np.unpackbits(able).astype(bool)
        for batch in _pieces(batches):
            row, term = _terms_of(batch)
            some = may[term & (SLOTS - 1)]
            known, at = np.unique(term[some], return_inverse=True)
            # The pairs of a term and a row; np.unique would hash them, which takes much longer.
            pair = np.sort(at * np.int64(batch.num_rows) + row[some])
            of, row = np.divmod(pair[_runs(pair)], batch.num_rows)
            first = np.searchsorted(of, np.arange(len(known)))
            columns = [pa.array(known), pa.array(np.bincount(at, minlength=len(known))), pa.array(np.bincount(of, minlength=len(known))), batch.column(ident).take(pa.array(row[first]))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "total", "df", ident])

    of = words.schema[ident].dataType.simpleString()
    counts = words.mapInArrow(run, f"term long, total long, df long, `{ident}` {of}").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"), F.min(ident).alias(ident))
    counts = kept(counts.filter(F.col("total") >= least))
    found, last = counts, _reached(counts, features)
    if last and last[1] + last[2] > features:
        total, above, some = last
        tied = counts.filter(F.col("total") == total)
        names = _named(docs, ident, text, tied, some).orderBy("name").limit(features - above)
        found = counts.filter(F.col("total") > total).unionByName(tied.join(F.broadcast(names.select("term")), "term", "left_semi").select(*counts.columns))
    elif last:
        found = counts.filter(F.col("total") >= last[0])
    found = found.select("term", "df").toArrow()
    term, df = found.column("term").to_numpy(), found.column("df").to_numpy()
    order = np.lexsort((term, -df))
    return term[order], df[order]


def places(terms: np.ndarray, bits: int = 20):
    """A function that gives the place of each value among the distinct ``terms``, or -1."""
    mask = (1 << bits) - 1
    table = np.full(1 << bits, -1, np.int32)
    table[terms & mask] = np.arange(len(terms))
    lost = np.flatnonzero(table[terms & mask] != np.arange(len(terms)))
    lost = lost[np.argsort(terms[lost])]
    names = terms[lost]

    def find(t: np.ndarray) -> np.ndarray:
        if not len(terms):
            return np.full(len(t), -1, np.int32)
        at = table[t & mask]
        out = np.where((at >= 0) & (terms[at] == t), at, -1)
        if len(lost):
            miss = np.flatnonzero(out < 0)
            k = np.minimum(np.searchsorted(names, t[miss]), len(lost) - 1)
            here = names[k] == t[miss]
            out[miss[here]] = lost[k[here]]
        return out

    return find


def term_counts(docs: DataFrame, ident: str, text: str, features: int = 50_000) -> tuple[DataFrame, np.ndarray]:
    """((ident, terms, counts), idf): the terms of :func:`tfidf` by their place, the most widespread first, and the smoothed IDF of each.

    Terms are told apart by 64-bit hashes of their words, and only those that may be among
    the features are counted one by one; a table keeps one row a document.
    """
    words, n = _hashed_words(docs, ident, text)
    term, df = _chosen(docs, ident, text, words, features)

    def run(batches):
        find = places(term)
        for batch in _pieces(batches):
            row, t = _terms_of(batch)
            at = find(t)
            pair = np.sort(row[at >= 0] * np.int64(max(1, len(term))) + at[at >= 0])
            start = _runs(pair)
            row, at = np.divmod(pair[start], max(1, len(term)))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (at, np.diff(np.append(start, len(pair))))]
            found = pa.RecordBatch.from_arrays([batch.column(ident), *lists], names=[ident, "terms", "counts"])
            yield found.filter(pa.array(np.diff(ends) > 0))

    of = words.schema[ident].dataType.simpleString()
    found = words.filter(F.col(ident).isNotNull()).mapInArrow(run, f"`{ident}` {of}, terms array<int>, counts array<int>")
    return kept(found, "zstd"), np.log((1.0 + n) / (1.0 + df)) + 1


#: Queries of a block, whose matrix meets rows at once; queries and terms of a pass over all rows, which are broadcast.
BLOCK, QUERIES, TERMS = 2048, 1 << 14, 6 << 20
#: Rows that meet a block at once, and rows that a task gathers for it.
ROWS, GATHERED = 1024, 8192
#: Groups of like queries; it makes their blocks share few terms with the rows of other groups.
GROUPS, HEADS = 4, 512


class Best:
    """The k best rows of each query so far, by similarity (rounded to nine digits) and id; a row is not its own neighbour, nor one whose similarity is not above the floor."""

    def __init__(self, queries: np.ndarray, k: int, floor: float = -np.inf):
        self.queries, self.k, self.floor = queries, k, floor
        self.least = np.full(len(queries), floor)
        self.found: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def add(self, sims: np.ndarray, ids: np.ndarray, exact=None, off: float = 0.0) -> None:
        """``sims`` are right up to ``off`` (and zero if they are); ``exact`` gives those of (row, query)."""
        # Rows that cannot be among the best go by their similarity as it is; only the others are rounded.
        off = off + 2e-9
        least = self._from(self.least - off, sims)
        if np.count_nonzero(sims >= least) > 4 * self.k * len(least) and len(sims) > self.k + 1:
            # One of the rows may be the query itself.
            least = np.fmax(least, self._from(np.partition(sims, -self.k - 1, axis=0)[-self.k - 1] - 2 * off, sims))
        i, j = np.nonzero(sims >= least)
        own = ids[i] == self.queries[j]
        i, j = i[~own], j[~own]
        s = sims[i, j] if exact is None else exact(i, j)
        some = s > self.floor
        if not some.any():
            return
        i, j, s = i[some], j[some], np.round(s[some], 9)
        q, r, s = (np.concatenate(pair) for pair in zip(self.found, (j, ids[i], s)))
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.searchsorted(q, q)
        held = np.arange(len(q)) - first < self.k
        last = np.arange(len(q)) - first == self.k - 1
        self.least[q[last]] = s[last]
        self.found = q[held], r[held], s[held]

    def _from(self, least: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """The bounds in the type of ``sims``, above the floor."""
        return np.maximum(least, np.nextafter(sims.dtype.type(self.floor), sims.dtype.type(np.inf))).astype(sims.dtype)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, similarity)."""
        q, r, s = self.found
        return self.queries[q], r, s


def _passes(queries: DataFrame, ident: str, n: int) -> Iterator[pa.Table]:
    """The queries in ``n`` parts."""
    for b in range(n):
        yield queries.filter(F.pmod(F.xxhash64(ident), F.lit(n)) == b).orderBy(ident).toArrow()


def _gathered(batches: Iterator) -> Iterator:
    """Batches of more rows, so that a block's matrix is not made for a few."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHERED or size >= 2 * BATCH_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search(vectors: DataFrame, passes: Iterator, ident: str, k: int, similar, floor: float = -np.inf) -> DataFrame:
    """Each pass takes its blocks of queries over all rows; a task gives its k best of each query, then the k best of all.

    A pass is the ids of each block and what ``similar`` needs of all blocks; of that and a batch, ``similar``
    yields (ids of rows, number of a block, similarities, and what :meth:`Best.add` takes besides).
    """
    spark, found = vectors.sparkSession, None
    for blocks, matrix in passes:
        held = spark.sparkContext.broadcast((blocks, matrix))

        def run(batches, held=held):
            blocks, matrix = held.value
            best, ready = [Best(ids, k, floor) for ids in blocks], similar(matrix)
            for batch in _gathered(batches):
                for ids, b, *sims in ready(batch):
                    best[b].add(sims[0], ids, *sims[1:])
            for each in best:
                q, i, s = each.rows()
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query", ident, "similarity"])

        part = vectors.mapInArrow(run, f"query long, {ident} long, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query long, {ident} long, similarity double")
    return top_k_per(found, ["query"], [F.desc("similarity"), F.col(ident)], k)


#: A term of more than this share of a block's queries may be cheaper in the dense product; it is if this many of a row's and a query's meet.
FREQUENT, MEET = 0.02, 0.003
#: Pairs of a row's and a query's weights that are laid out at once: their sums stay in a core's cache.
PAIRS = 1 << 17


def query_matrix(terms: list[np.ndarray], weights: list[np.ndarray], known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """A block's queries by term: the terms (or those of all blocks), the start and count of each, those that may be frequent, and all (query, weight) by term; the queries' number last."""
    every = np.concatenate(terms)
    query = np.repeat(np.arange(len(terms), dtype=np.int32), [len(x) for x in terms])
    known = np.unique(every) if known is None else known
    at = np.searchsorted(known, every)
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=len(known)).astype(np.int32)
    return known, (np.cumsum(count) - count).astype(np.int32), np.flatnonzero(count > FREQUENT * len(terms)), count, query[order], np.concatenate(weights)[order], len(terms)


def _laid(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of runs of ``count`` from ``start`` on, one after the other."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _products(row: np.ndarray, at: np.ndarray, weight: np.ndarray, rows: int, matrix: tuple, kind=np.float64) -> tuple:
    """(sums, exact, off) of rows (in order of row) whose terms are places among the matrix's: terms frequent on both sides by a dense product of that kind, pairs of the others one by one."""
    _, start, often, count, query, qweight, n = matrix
    place = np.full(len(count), -1, np.int32)
    dense = often[np.bincount(at, minlength=len(count))[often] * count[often].astype(float) > MEET * rows * n]
    place[dense] = np.arange(len(dense))
    some, own = place[at] >= 0, (count[at] > 0) & (place[at] < 0)
    to = _laid(start[dense], count[dense])
    sides = (row[some], place[at[some]], weight[some], rows), (query[to], np.repeat(np.arange(len(dense), dtype=np.int32), count[dense]), qweight[to], n)

    def laid(line, term, x, lines, kind):
        side = np.zeros((lines, len(dense)), kind)
        side[line, term] = x
        return side

    out = laid(*sides[0], kind) @ laid(*sides[1], kind).T
    row, at, weight = row[own], at[own], weight[own]
    pairs = np.concatenate([[0], np.cumsum(count[at], dtype=np.int64)])
    rest, i = np.zeros((rows, n)), 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(pairs, pairs[i] + PAIRS, "right")) - 1)
        each = count[at[i:j]]
        to = _laid(start[at[i:j]], each)
        base = row[i]
        sums = np.bincount(np.repeat((row[i:j] - base) * n, each) + query[to], np.repeat(weight[i:j], each) * qweight[to], minlength=(row[j - 1] - base + 1) * n)
        rest[base : row[j - 1] + 1] += sums.reshape(-1, n)
        i = j
    out += rest

    def lines(side, some):
        # The wanted lines of a side in double precision, and where each is among them.
        line, term, x, n = side
        wanted = np.zeros(n, bool)
        wanted[some] = True
        at, own = np.cumsum(wanted) - 1, wanted[line]
        return laid(at[line[own]], term[own], x[own], int(wanted.sum()), np.float64), at[some]

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (left, a), (right, b) = lines(sides[0], i), lines(sides[1], j)
        step = max(1, (1 << 18) // max(1, len(dense)))
        sums = [np.einsum("ij,ij->i", left[a[x : x + step]], right[b[x : x + step]]) for x in range(0, len(i), step)]
        return np.concatenate([np.empty(0), *sums]) + rest[i, j]

    # The error of a sum of products in that kind, by the lengths of both sides.
    length = lambda side: np.sqrt(np.bincount(side[0], side[2] * side[2]).max(initial=0))
    off = (len(dense) + 8) * np.finfo(kind).eps * (length(sides[0]) * length(sides[1]) + rest.max(initial=0))
    return out, exact, off


def sparse_products(row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, matrix: tuple) -> np.ndarray:
    """The sums of products of sparse rows (in order of row) with a :func:`query_matrix`."""
    at = places(matrix[0])(term)
    return _products(row[at >= 0], at[at >= 0], weight[at >= 0], rows, matrix)[0]


def _heads(row: np.ndarray, place: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """The weights of the terms by which rows are told apart."""
    out = np.zeros((rows, HEADS), np.float32)
    out[row[place >= 0], place[place >= 0]] = weight[place >= 0]
    return out


def _centres(heads: np.ndarray, groups: int) -> np.ndarray:
    """The middles of groups of like rows: the first and those least like the ones before, moved some times.  No result depends on them."""
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)
    heads = unit(heads)
    middle = heads[:1]
    while len(middle) < groups:
        middle = np.vstack([middle, heads[[np.argmin((heads @ middle.T).max(axis=1))]]])
    for _ in range(8):
        own = np.argmax(heads @ middle.T, axis=1)
        middle = unit(np.vstack([heads[own == g].sum(axis=0) if (own == g).any() else middle[g] for g in range(groups)]))
    return middle


def _sparse_passes(queries: DataFrame, ident: str, weigh) -> Iterator:
    """Passes of :func:`_search`: queries in blocks of like ones, with all that tells a row's group."""
    count, size = queries.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    for part in _passes(queries, ident, max(-(-count // QUERIES), -(-(size or 0) // TERMS))):
        part = part.combine_chunks().to_batches()
        if not part or not part[0].num_rows:
            continue
        row, term, weight = weigh(part[0])
        ids, n = np.asarray(part[0].column(ident)), part[0].num_rows
        known, at = np.unique(term, return_inverse=True)
        place = np.full(len(known), -1, np.int32)
        most = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")[:HEADS]
        place[most] = np.arange(len(most))
        heads = _heads(row, place[at], weight, n)
        middle = _centres(heads[:: max(1, n // BLOCK)], max(1, min(GROUPS, n // 64)))
        group = np.argmax(heads @ middle.T, axis=1)
        ends = np.searchsorted(row, np.arange(n + 1))
        blocks, matrices = [], []
        for g in range(len(middle)):
            own = np.flatnonzero(group == g)
            for some in np.array_split(own, -(-len(own) // BLOCK)) if len(own) else []:
                blocks.append(ids[some])
                lists = [[x[ends[i] : ends[i + 1]] for i in some] for x in (term, weight)]
                matrices.append(query_matrix(*lists, known)[1:])
        yield blocks, (known, place, middle, matrices)


def _sparse_search(vectors: DataFrame, queries: DataFrame, ident: str, k: int, weigh) -> DataFrame:
    """(query, ident, similarity, rank) of sparse vectors, of which ``weigh`` gives (row, term, weight) of a batch, with a similarity above zero.

    A block's queries become a matrix over their own terms; terms that no query
    of the block has cost nothing, rare ones only the pairs that share them.  Dense products
    are made in single precision, and what may be among the best by them once more in double.
    """

    def similar(matrix):
        known, place, middle, matrices = matrix
        find = places(known)
        positive = all(x.min(initial=1) > 1e-15 for *_, x, _ in matrices)

        def ready(batch):
            row, term, weight = weigh(batch)
            ids, at = np.asarray(batch.column(ident)), find(term)
            row, at, weight = row[at >= 0], at[at >= 0], weight[at >= 0]
            group = np.argmax(_heads(row, place[at], weight, len(ids)) @ middle.T, axis=1)
            ends = np.searchsorted(row, np.arange(len(ids) + 1))
            kind = np.float32 if positive and weight.min(initial=1) > 1e-15 else np.float64
            for g in range(len(middle)):
                own = np.flatnonzero(group == g)
                for a in range(0, len(own), ROWS):
                    some = own[a : a + ROWS]
                    size = ends[some + 1] - ends[some]
                    to = _laid(ends[some], size)
                    part = np.repeat(np.arange(len(some)), size), at[to], weight[to]
                    for b, block in enumerate(matrices):
                        yield ids[some], b, *_products(*part, len(some), (known, *block), kind)

        return ready

    return _search(vectors, _sparse_passes(queries, ident, weigh), ident, k, similar, 0.0)


def _flat(batch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten())


def sparse_top(weights: DataFrame, queries: DataFrame, ident: str, k: int) -> DataFrame:
    """(query, ident, similarity, rank) of sparse vectors (ident, term, weight) with a similarity above zero."""

    def weigh(batch):
        return np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("terms").value_lengths())), _flat(batch, "terms"), _flat(batch, "weights")

    rows, of = (x.groupBy(ident).agg(F.collect_list(F.xxhash64("term")).alias("terms"), F.collect_list("weight").alias("weights")) for x in (weights, queries))
    return _sparse_search(cut(rows), of, ident, k, weigh)


def tfidf_top(docs: DataFrame, ident: str, text: str, queries: Column, k: int) -> DataFrame:
    """(query, ident, similarity, rank): the texts most like each of the texts that ``queries`` marks, by :func:`tfidf`."""
    vectors, idf = term_counts(docs, ident, text)

    def weigh(batch):
        row, term = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("terms").value_lengths())), _flat(batch, "terms")
        weight = _flat(batch, "counts") * idf[term]
        return row, term, weight / np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))[row]

    return _sparse_search(vectors, vectors.filter(queries), ident, k, weigh)


def dense_top(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(query, ident, similarity, rank) by cosine, of a stated query set against all rows."""

    def unit(batch):
        m = _flat(batch, vector).astype(np.float64).reshape(batch.num_rows, -1)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def passes():
        of = queries.select(ident, vector)
        for part in _passes(of, ident, -(-of.count() // QUERIES)):
            blocks = [x for x in part.combine_chunks().to_batches(BLOCK) if x.num_rows]
            if blocks:
                yield [np.asarray(x.column(ident)) for x in blocks], [unit(x).T for x in blocks]

    def similar(matrices):
        def ready(batch):
            own, ids = unit(batch), np.asarray(batch.column(ident))
            for a in range(0, len(ids), ROWS):
                for b, matrix in enumerate(matrices):
                    yield ids[a : a + ROWS], b, own[a : a + ROWS] @ matrix

        return ready

    return _search(vectors.select(ident, vector), passes(), ident, k, similar)


def fuse(lists: list[DataFrame], ident: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, ident, rank)."""
    every = None
    for x in lists:
        part = x.select("query", ident, (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("r"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query", ident).agg(F.round(F.sum("r"), 9).alias("score"))
    return top_k_per(fused, ["query"], [F.desc("score"), F.col(ident)], k)


def markdown_units(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """One row a line with its offsets, kind, heading and table header.

    A table header is the first table line of a block; it ends with the block.
    The offsets are half-open character positions in the text.
    """
    from pyspark.sql import Window

    lines = docs.select(ident, F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    w = Window.partitionBy(ident).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.sum(F.length("content") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = F.col("content").rlike(r"^\s*\|")
    kind = F.when(F.col("content").rlike(r"^#{1,6}\s"), "heading").when(F.col("content").rlike(r"^\s*\|[\s:|-]+$"), "separator").when(table, "table").when(F.trim("content") == "", "blank").otherwise("text")
    out = lines.withColumns({"kind": kind, "start": before, "end": before + F.length("content"), "is_table": table})
    out = out.withColumn("block", F.sum((~F.col("is_table")).cast("int")).over(upto))
    heading = F.last(F.when(F.col("kind") == "heading", F.regexp_replace("content", r"^#{1,6}\s+", "")), ignorenulls=True).over(upto)
    header = F.first(F.when(F.col("is_table"), F.col("content")), ignorenulls=True).over(Window.partitionBy(ident, "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumns({"heading": heading, "header": F.when(F.col("is_table"), header)}).drop("block", "is_table")


def scoped_markdown_units(docs: DataFrame, ident: str, text: str, companies: list[str], section: str = "report", company: str | None = None) -> DataFrame:
    """:func:`markdown_units` without blank lines, with company, section and the reason why a line is no claim text.

    A heading that names one company opens its scope, one of level 1 or 2
    without a name closes it; a table row that has one company as a cell is
    that company's.  A heading with a section's words changes the section; a
    list of sources excludes its lines, and so do headings and table headers.
    """
    from pyspark.sql import Window

    u = markdown_units(docs, ident, text)
    names = F.array(*map(F.lit, companies)).cast("array<string>")
    heading = F.col("kind") == "heading"
    own = F.regexp_replace("content", r"^#{1,6}\s+", "")
    word = lambda c: F.regexp_count(own, F.concat(F.lit(r"(?<![\w])\Q"), c, F.lit(r"\E(?![\w])"))) > 0
    in_heading = F.filter(names, word)
    high = F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1)) <= 2
    w = Window.partitionBy(ident).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    # A scope opens or closes at such a line; else the last one holds.
    at = F.when(heading & (F.size(in_heading) == 1), F.struct(F.get(in_heading, 0).alias("c"))).when(heading & high, F.struct(F.lit(company).alias("c")))
    scope = F.last(at, ignorenulls=True).over(w)
    cells = F.transform(F.split(F.regexp_replace(F.trim("content"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    in_row = F.array_intersect(names, cells)
    titled = F.exists(cells, lambda c: F.lower(c).isin("company", "회사", "기업", "company name"))
    table = F.col("kind") == "table"
    head = F.when(heading & F.lower(own).contains("executive summary") & section_of(own).isNull(), "business").when(heading, section_of(own))
    sources = F.last(F.when(heading, F.lower(own).isin(*REFERENCE_HEADINGS)), ignorenulls=True).over(w)
    out = u.withColumns({"company_id": F.when(table & (F.size(in_row) == 1), F.get(in_row, 0)).otherwise(F.coalesce(scope["c"], F.lit(company))), "section_id": F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(section)), "__r": sources})
    reason = F.when(F.coalesce("__r", F.lit(False)), "reference_listing").when(heading | (F.col("kind") == "separator") | (table & titled), "heading_or_table_header")
    return out.filter("kind <> 'blank'").withColumn("exclusion_reason", reason).drop("__r")


def index_fingerprint(docs: DataFrame, content: str, metadata: str) -> str:
    """One hash of a corpus whatever its order: the sum and the exclusive or of its rows' hashes, and their number."""
    h = F.sha2(F.concat_ws("::", content, metadata), 256)
    half = lambda a: F.conv(F.substr(h, F.lit(a), F.lit(15)), 16, 10).cast("decimal(38,0)")
    x = docs.agg(F.count(F.lit(1)), F.sum(half(1)), F.sum(half(16)), F.bit_xor(half(31).cast("long"))).first()
    return hashlib.sha256(repr(tuple(map(str, x))).encode()).hexdigest()


def index_once(docs: DataFrame, content: str, metadata: str, folder: str, build) -> tuple[DataFrame, bool]:
    """The index in ``folder`` and whether it was built now: it is built again only if the corpus has changed.

    ``build`` makes the table from ``docs``.  Each state of the corpus has its
    own subfolder, so a reader never sees a half-written index.
    """
    spark = docs.sparkSession
    path = f"{folder.rstrip('/')}/{index_fingerprint(docs, content, metadata)}"
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path), False
    build(docs).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), True


def vocabulary(docs: DataFrame, ident: str, text: str, features: int = 50_000) -> DataFrame:
    """(term, total, df, n_docs) of the ``features`` most frequent terms: the fitted state, kept as a table."""
    n = docs.select(ident).distinct().agg(F.count(F.lit(1)).alias("n_docs"))
    found = terms(docs, ident, text).groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(features)
    return found.crossJoin(F.broadcast(n))


def transformed(docs: DataFrame, ident: str, text: str, fitted: DataFrame) -> DataFrame:
    """(ident, term, weight) of texts under a fitted :func:`vocabulary`; unknown terms count nothing."""
    weighted = terms(docs, ident, text).join(fitted, "term").withColumn("w", F.col("tf") * (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1))
    norm = weighted.groupBy(ident).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, ident).select(ident, "term", (F.col("w") / F.col("norm")).alias("weight"))
