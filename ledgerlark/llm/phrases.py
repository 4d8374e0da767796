"""Collocations: frequent phrases of up to ``LONGEST`` words, by pivot partitioning.

Counting.  A first pass counts words by language.  Their counts give every word
a rarity: the largest count of the words in its slot of a table of 2**SLOT_BITS
(so the table that the tasks get has one size whatever the vocabulary), then its hash.
Any order that all tasks share gives the right counts; this one sends a phrase to
a rare word.

A second pass writes, for each place of a word that may be frequent, the fragment
around it: up to ``LONGEST`` - 1 words to either side, ended by the piece, by a word
that cannot be frequent, and by a rarer word (on the left also by the word
itself).  A phrase's place lies in one such fragment, that of the first of its
rarest words, its pivot.  Fragments are routed to their pivot, equal ones of a
buffer as one with a count; a pivot's phrases are counted where its fragments
are and only phrases that contain it at its place are emitted.  A pivot of
more than ``GROUP`` places is dealt over several parts, whose counts are summed
by phrase afterwards; the others are complete and lose their infrequent
phrases on the spot.

Scores.  A candidate (2 words or more, ``least`` places or more) of a places is cut
after its first k words into parts of l and r places: score floor(2000000 a / (l + r)),
the lowest cut counts.  A candidate goes if a longer one that contains it has at least
80 percent of its places.

Defined results: a null text has no words; a null language is ``und``; repeated
rows count repeatedly; an empty table gives an empty one; a long text is worked
on piece by piece in stretches (a single piece as a whole); other columns do not
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import kernels as K
from ledgerlark.llm.batches import bounded
from ledgerlark.llm.ranks import numbered
from ledgerlark.llm.shared import stored

LONGEST, LEAST, BEST = 4, 30, 2000
#: A longer phrase with so many percent of a phrase's places takes its stead.
SHARE = 80
SLOT_BITS = 22
#: Places of a pivot that one part holds.
GROUP = 1 << 18
#: Bytes of text whose fragments or words a task sorts at once, and of fragments that it counts at once.
BUFFER = 3 << 20
#: Bytes that are hashed at once.
BLOCK = 1 << 20
SEED = 13
#: [.,;:!?\x0A-\x0D] end a piece; these, blanks and tabs end a word.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~ENDS
WORD[[32, 9]] = False
BREAK = 10

U = np.uint64


def _stretches(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that end where a piece ends."""
    a = 0
    while a < len(data):
        b = a + most
        if b >= len(data):
            b = len(data)
        else:
            ends = np.flatnonzero(ENDS[data[a:b]])
            if len(ends):
                b = a + int(ends[-1]) + 1
            else:
                after = np.flatnonzero(ENDS[data[b:]])
                b = b + int(after[0]) + 1 if len(after) else len(data)
        yield a, b
        a = b


class Tokens:
    """The words of some bytes of lower-cased text: spans, hashes with their language, pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.data = data
        self.start, self.end, at = K.words(data, offsets, WORD)
        self.row = K.row_of(at)
        plain = _word_hashes(data, self.start, self.end)
        self.hash = K.mix(plain ^ langs[self.row]) if len(plain) else plain
        ended = np.append(0, np.cumsum(ENDS[data]))[self.start] if len(data) else self.start
        self.new = np.ones(len(self.start), bool)
        self.new[1:] = (self.row[1:] != self.row[:-1]) | (ended[1:] != ended[:-1])


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words, block by block."""
    out, i = np.empty(len(start), U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK)))
        a, b = int(start[i]), int(end[j - 1])
        out[i:j] = K.strong_hashes(data[a:b], start[i:j] - a, end[i:j] - a, SEED)
        i = j
    return out


def _tokens(batches, most: int = BLOCK) -> Iterator[tuple[Tokens, list[str]]]:
    """Tokens of (lang, text) batches in stretches, with the languages of their rows."""
    for batch in batches:
        column, langs = batch.column("text"), batch.column("lang").to_pylist()
        for i, j in K.slices(column, most):
            data, offsets = K.columns_bytes(column.slice(i, j - i))
            some = langs[i:j]
            named = {x: k for k, x in enumerate(dict.fromkeys(some))}
            codes = _lang_hashes(list(named))[[named[x] for x in some]]
            for a, b in _stretches(data, most):
                yield Tokens(K.LOWER[data[a:b]], np.clip(offsets, a, b) - a, codes), some


def _lang_hashes(langs: list[str]) -> np.ndarray:
    data, offsets = K.columns_bytes(pa.array(langs, pa.string()))
    return K.mix(K.strong_hashes(data, offsets[:-1], offsets[1:], SEED + 1) + U(1))


def _gather(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans in a row (each followed by the byte ``last``) and their n + 1 offsets."""
    extra = last is not None
    to = np.append(0, np.cumsum(end - start + extra))
    out, i = np.empty(to[-1], np.uint8), 0
    while i < len(start):
        # As many spans as make a block: an index takes eight bytes for each of theirs.
        j = max(i + 1, int(np.searchsorted(to, to[i] + BLOCK)) - 1)
        size, a, b = np.diff(to[i : j + 1]), to[i], to[j]
        index = np.repeat(start[i:j] - to[i:j], size) + np.arange(a, b)
        if extra:
            index[to[i + 1 : j + 1] - 1 - a] = 0
        out[a:b] = buffer[index]
        i = j
    if extra:
        out[to[1:] - 1] = last
    return out, to


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if len(data) >= 1 << 31:
        raise ValueError("a buffer of strings of 2 GB")
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def corpus(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return bounded(docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text")))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, hash, n): all words of (lang, text); a task counts some megabytes at once."""

    def flush(held):
        if not held:
            return
        every = np.concatenate([h[0] for h in held])
        hashes, first, back = np.unique(every, return_index=True, return_inverse=True)
        n = np.bincount(back, np.concatenate([h[1] for h in held])).astype(np.int64)
        part = lambda k: pa.concat_arrays([h[k] for h in held]).take(pa.array(first))
        yield pa.RecordBatch.from_arrays([part(2), part(3), pa.array(hashes.view(np.int64)), pa.array(n)], names=["lang", "word", "hash", "n"])

    def run(batches):
        held, size = [], 0
        for tokens, langs in _tokens(batches):
            if len(tokens.hash):
                hashes, first, n = np.unique(tokens.hash, return_index=True, return_counts=True)
                words = _strings(*_gather(tokens.data, tokens.start[first], tokens.end[first]))
                held.append((hashes, n, pa.array([langs[r] for r in tokens.row[first]], pa.string()), words))
                size += words.nbytes
            if size >= BUFFER:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    return texts.mapInArrow(run, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def rarities(words: DataFrame, least: int) -> np.ndarray:
    """For each slot of hashes the largest count of its words that are frequent, 0 if none is: one size, whatever the words."""
    slots = words.filter(F.col("n") >= least).groupBy(F.col("hash").bitwiseAND((1 << SLOT_BITS) - 1).alias("slot")).agg(F.max("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint32)
    out[slots["slot"].to_numpy()] = np.minimum(slots["n"].to_numpy(), (1 << 32) - 1)
    return out


def _fragments_of(tokens: Tokens, counts: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """Of each place with neighbours it owns phrases with: the place, words to its left and right, its count."""
    n = len(tokens.hash)
    count = counts[(tokens.hash & U(len(counts) - 1)).astype(np.int64)]
    often = count > 0
    # Larger is rarer.
    key = (U((1 << 32) - 1) - count.astype(U)) << U(32) | tokens.hash >> U(32)
    run = tokens.new | ~often
    run[1:] |= ~often[:-1]
    run = np.cumsum(run)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    more, on = often.copy(), often.copy()
    for j in range(1, longest):
        more[:j] = False
        more[j:] &= (run[j:] == run[:-j]) & (key[:-j] < key[j:])
        left += more
        on[n - j :] = False
        on[: n - j] &= (run[:-j] == run[j:]) & (key[j:] <= key[:-j])
        right += on
    place = np.flatnonzero(left + right)
    return place, left[place], right[place], count[place]


FRAGMENTS = "lang string, pivot long, part int, fragments string, lefts binary, counts array<int>"


def fragments(texts: DataFrame, counts, longest: int = LONGEST, group: int = GROUP) -> DataFrame:
    """For each buffer of a task and each pivot: its fragments (each ended by a line feed), words left of the pivot, and counts.

    ``part`` is -1 for a pivot whose fragments all meet.
    """

    def flush(held):
        if not held:
            return
        pivot, part, ident, left, row_lang = (np.concatenate([h[k] for h in held]) for k in ("pivot", "part", "ident", "left", "lang"))
        base = np.cumsum([0, *[len(h["buffer"]) for h in held]])
        start, end = (np.concatenate([h[k] + b for h, b in zip(held, base, strict=False)]) for k in ("start", "end"))
        buffer = np.concatenate([h["buffer"] for h in held])
        names = list(held[0]["names"])
        group_key = K.mix(pivot + part.astype(np.int64).view(U) * U(0x9FB21C651E98DF25))
        # Pivots that share these bits only make more rows.
        order = np.argsort(group_key & ~U((1 << 32) - 1) | ident >> U(32))
        g, i, p = group_key[order], ident[order], pivot[order]
        size = (end - start)[order]
        same = np.zeros(len(order), bool)
        same[1:] = (g[1:] == g[:-1]) & (i[1:] == i[:-1]) & (size[1:] == size[:-1]) & (p[1:] == p[:-1])
        first = np.flatnonzero(~same)
        number = np.diff(np.append(first, len(order)))
        pick = order[first]
        g, p = g[first], p[first]
        head = np.ones(len(first), bool)
        head[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
        rows = np.flatnonzero(head)
        stop = np.append(rows, len(first))
        data, to = _gather(buffer, start[pick], end[pick], BREAK)
        lefts = left[pick]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[k] for k in row_lang[pick[rows]]], pa.string()),
                pa.array(p[rows].view(np.int64)),
                pa.array(part[pick[rows]].astype(np.int32)),
                _strings(data, to[stop]),
                pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(stop.astype(np.int32)), pa.py_buffer(lefts)]),
                pa.ListArray.from_arrays(pa.array(stop.astype(np.int32)), pa.array(number.astype(np.int32))),
            ],
            names=[c.split()[0] for c in FRAGMENTS.split(", ")],
        )

    def run(batches):
        held, size, codes = [], 0, {}
        for tokens, langs in _tokens(batches):
            if len(tokens.hash):
                place, left, right, count = _fragments_of(tokens, counts.value, longest)
                text, to = _gather(tokens.data, tokens.start, tokens.end, 32)
                sums = K.running(tokens.hash)
                ident = K.spans_hash(sums, place - left, place + right + 1) ^ left.astype(U)
                parts = count.astype(np.int64) // group + 1
                part = np.where(parts > 1, (ident % parts.astype(U)).astype(np.int64), -1)
                for x in langs:
                    codes.setdefault(x, len(codes))
                lang = np.array([codes[x] for x in langs], np.int32)[tokens.row[place]]
                # A fragment is its words with one blank between them.
                held.append({"pivot": tokens.hash[place], "part": part.astype(np.int32), "ident": ident, "left": left.astype(np.uint8), "lang": lang, "buffer": text, "start": to[place - left], "end": to[place + right + 1] - 1, "names": codes})
                size += len(tokens.data)
            if size >= BUFFER:
                yield from flush(held)
                held, size, codes = [], 0, {}
        yield from flush(held)

    return texts.mapInArrow(run, FRAGMENTS)


PHRASES = "lang string, phrase string, words int, n long"


def _counted(rows: pa.Table, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The phrases that the pivots of ``rows`` own; the infrequent ones of complete pivots are left out."""
    column = rows.column("fragments").combine_chunks()
    data, offsets = K.columns_bytes(column)
    start, end, at = K.words(data, offsets, WORD)
    if not len(start):
        return
    plain = _word_hashes(data, start, end)
    sums, others = K.running(plain), K.running(K.mix(plain ^ U(0x94D049BB133111EB)))
    lists = rows.column("counts").combine_chunks()
    number = np.asarray(lists.flatten()).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()))
    left = np.frombuffer(b"".join(rows.column("lefts").to_pylist()), np.uint8).astype(np.int64)
    # Fragments end with a line feed: the first word of each.
    place = np.append(0, np.flatnonzero(data == BREAK)[:-1] + 1)
    head = np.searchsorted(start, place)
    right = np.diff(np.append(head, len(start))) - left - 1
    salt = np.asarray(rows.column("pivot").combine_chunks()).view(U)[owner]
    part = np.asarray(rows.column("part").combine_chunks())[owner]
    key, other, first, size, n, of = [], [], [], [], [], []
    for words in range(2, longest + 1):
        for before in range(words):
            pick = np.flatnonzero((left >= before) & (right >= words - 1 - before))
            a = head[pick] + left[pick] - before
            key.append(K.spans_hash(sums, a, a + words) ^ salt[pick])
            other.append(K.spans_hash(others, a, a + words))
            first.append(a)
            size.append(np.full(len(pick), words, np.int32))
            n.append(number[pick])
            of.append(pick)
    key, other, first, size, n, of = (np.concatenate(x) for x in (key, other, first, size, n, of))
    if not len(key):
        return
    order = np.argsort(key)
    k, o = key[order], other[order]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    if np.any(o[1:][~new[1:]] != o[:-1][~new[1:]]):
        # Two phrases of one hash: both hashes order them.
        order = np.lexsort((other, key))
        k, o = key[order], other[order]
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order], at)
    pick = order[at]
    keep = (total >= least) | (part[of[pick]] >= 0)
    pick, total = pick[keep], total[keep]
    text, to = _gather(data, start[first[pick]], end[first[pick] + size[pick] - 1])
    yield pa.RecordBatch.from_arrays([rows.column("lang").combine_chunks().take(pa.array(owner[of[pick]])), _strings(text, to), pa.array(size[pick]), pa.array(total)], names=[c.split()[0] for c in PHRASES.split(", ")])


def mined(parts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, n) of 2 words or more, counted where their pivot's fragments meet."""
    routed = parts.repartition("lang", "pivot", "part").sortWithinPartitions("lang", "pivot", "part")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < BUFFER:
                continue
            table = pa.Table.from_batches(held)
            # The last pivot may go on in the next batch.
            ident = [np.asarray(table.column(c).combine_chunks()) for c in ("pivot", "part")]
            differs = np.flatnonzero((ident[0] != ident[0][-1]) | (ident[1] != ident[1][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if cut:
                yield from _counted(table.slice(0, cut), least, longest)
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield from _counted(pa.Table.from_batches(held), least, longest)

    return routed.mapInArrow(run, PHRASES).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _part(first: Column | int, words: Column | int) -> Column:
    return F.array_join(F.slice("w", first, words), " ")


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the candidates that no longer one stands for; ``counted`` has all frequent phrases and words."""
    several = counted.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(1, F.col("k")).alias("lp"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rp"))
    known = lambda as_, n: counted.select(F.col("lang").alias(f"lang_{n}"), F.col("phrase").alias(as_), F.col("n").alias(n))
    for as_, n in (("lp", "l"), ("rp", "r")):
        right = known(f"{as_}_", n)
        cuts = cuts.join(right, (F.col("lang") == F.col(f"lang_{n}")) & (F.col(as_) == F.col(f"{as_}_"))).drop(f"lang_{n}", f"{as_}_")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", (wide("a") * F.lit(2000000)).cast("decimal(38,0)"), wide("l") + wide("r"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inner = several.filter("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("s"))
    longer = inner.groupBy(F.col("lang").alias("g"), F.array_join(F.slice("w", F.col("s"), F.col("m")), " ").alias("p")).agg(F.max("a").alias("most"))
    out = best.join(longer, (F.col("lang") == F.col("g")) & (F.col("phrase") == F.col("p")), "left")
    hidden = F.coalesce(wide("most") * 100 >= wide("a") * SHARE, F.lit(False))
    return out.filter(~hidden).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int | None = BEST, group: int = GROUP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``best`` phrases (None: all)."""
    texts = corpus(docs, text, lang)
    words = stored(word_counts(texts))
    held = docs.sparkSession.sparkContext.broadcast(rarities(words, least))
    found = mined(fragments(texts, held, longest, group), least, longest)
    single = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    counted = stored(found.unionByName(single))
    placed = numbered(scored(counted), [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], [F.col("lang")])
    if best is not None:
        placed = placed.filter(F.col("__within") < best)
    whole = words.groupBy(F.col("lang").alias("g")).agg(F.sum("n").alias("n"))
    return placed.join(whole, F.col("lang") == F.col("g")).select("lang", (F.col("__within") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
