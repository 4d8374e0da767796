"""Sharding, the Merkle manifest and phrases against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import hilbert, kernels, merkle, phrases, substring_dedup
from ledgerlark.llm.hilbert import Dimension
from ledgerlark.llm.ranks import numbered

ROWS = [(i, random.Random(i).choice(["en", "de", None]), f"s{i % 7}", 8 + i * i % 5000) for i in range(400)]
SCHEMA = "doc_id long, lang string, source string, size long"
DIMS = [Dimension("lang", "rank"), Dimension("source", "rank"), Dimension("size", "log"), Dimension("doc_id")]


# --- places -------------------------------------------------------------------


def test_numbered(spark):
    rows = [(g, random.Random(i).randrange(50)) for i, g in enumerate([None, "a", "b", "a"] * 60)]
    frame = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = numbered(frame, [F.col("g").asc_nulls_first(), F.col("x")], [F.col("g")]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.g, r.x) for r in sorted(got, key=lambda r: r["__place"])] == want
    sizes = collections.Counter(g for g, _ in rows)
    assert all(r["__total"] == sizes[r.g] for r in got)
    for g in sizes:
        assert sorted(r["__within"] for r in got if r.g == g) == list(range(sizes[g]))


# --- 11 -----------------------------------------------------------------------


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2), (5, 1)])
def test_curve_visits_every_cell_in_unit_steps(spark, n, bits):
    cells = spark.range(1 << n * bits).select(*[F.expr(f"cast((id >> {i * bits}) & {(1 << bits) - 1} as int)").alias(f"x{i}") for i in range(n)])
    got = sorted((r.h, tuple(r[:n])) for r in cells.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(n)], bits)).collect())
    assert [h for h, _ in got] == list(range(1 << n * bits))
    assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in zip(got, got[1:], strict=False))


def test_logarithm_is_monotone(spark):
    values = [-5, 0, *range(1, 3000), *[2**k + d for k in range(12, 62) for d in (-1, 0, 1)]]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).select(hilbert.logarithm(F.col("v")).alias("x")).collect()]
    assert got[0] == got[1] == 0
    assert got[1:] == sorted(got[1:])


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_runs_of_the_curve(spark, law):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    rows = sorted(hilbert.shards(frame, DIMS, 24, law, ["doc_id"], "size").collect(), key=lambda r: (r["__curve"], r.doc_id))
    assert {tuple(r[:4]) for r in rows} == set(ROWS)
    assert len(rows) == len(ROWS)
    assert [r["__shard"] for r in rows] == sorted(r["__shard"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["__shard"]].append(r)
    assert all([r["__slot"] for r in v] == list(range(len(v))) for v in by.values())
    if law == "rows":
        counts = [len(by[s]) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    else:
        sizes = [sum(r["size"] for r in by[s]) for s in range(24)]
        assert max(abs(s - sum(sizes) / 24) for s in sizes) <= max(r[3] for r in ROWS)


def test_shards_edges(spark):
    rows = [(1, None, None, 8), (1, None, None, 8), (None, "en", "a", None), (2**62, "en", "b", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("__shard", "__row", "c0", "shard", "n", "value")})
    got = hilbert.shards(frame, DIMS, 24, ties=["doc_id"])
    assert {"__row", "c0", "shard", "n", "value"} <= set(got.columns)
    assert len(set(got.columns)) == len(got.columns)
    assert sorted(r["__slot"] for r in got.collect()) == [0] * 4
    assert hilbert.shards(frame.limit(0), DIMS, 24).collect() == []
    assert hilbert.shards(frame.limit(0), DIMS, 24, "bytes", size="size").collect() == []
    with pytest.raises(TypeError, match="integer"):
        hilbert.shards(frame, [Dimension("lang", "log"), Dimension("doc_id")])
    with pytest.raises(ValueError, match="law"):
        hilbert.shards(frame, DIMS, law="key")


def test_files_are_pruned_by_any_dimension(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"l{i * 7 % 8}", f"s{i * 13 % 16}", 8 + i * 31 % 4096) for i in range(4096)], SCHEMA)
    folder = f"file://{tmp_path}/shards"
    manifest = hilbert.write(frame, folder, DIMS, 24, ties=["doc_id"], files=4)
    assert manifest.agg(F.sum("rows")).first()[0] == 4096
    whole = manifest.count()
    for ranges in ({"lang": ("l3", "l3")}, {"source": ("s2", "s2")}, {"size": (8, 300)}, {"doc_id": (1000, 1400)}, {"lang": ("l1", "l2"), "doc_id": (0, 600)}):
        want = frame
        for c, (lo, hi) in ranges.items():
            want = want.filter(F.col(c).between(lo, hi))
        got = hilbert.read(spark, folder, ranges)
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
        assert hilbert.files_for(manifest, ranges).count() < 0.7 * whole


# --- 12 -----------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def way(levels, at, arity):
    out = []
    for level in levels[:-1]:
        first = at - at % arity
        out.append((level[first:at], level[at + 1 : first + arity]))
        at //= arity
    return out


@pytest.mark.parametrize(("arity", "height"), [(2, 1), (2, 2), (2, 10), (3, 2)])
def test_manifest_against_brute_force(spark, arity, height):
    rng = random.Random(arity * 10 + height)
    rows = [(rng.choice(["a"] * 9 + ["b", "c", "", None]), rng.choice([None, *range(60)]), sha(str(i)), f"{i}|{sha('x') if i % 5 == 0 else ''}") for i in range(97)] + [("z", 1, sha("lone"), "97|")]
    frame = spark.createDataFrame(rows, "g string, k long, h string, t string").repartition(5)
    made = merkle.manifest(frame, "g", "k", "h", "t", arity, height)
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, g or ""))
    trees = []
    for g in groups:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
        trees.append((mine, tree([r[2] for r in mine], arity)))
    top = tree([t[-1][0] for _, t in trees], arity)
    assert made.root == top[-1][0]
    assert {r.grp: (r.value, r.subroot, r.n) for r in made.groups.collect()} == {i: (g, trees[i][1][-1][0], len(trees[i][0])) for i, g in enumerate(groups)}
    got = {r.tag: r for r in made.verified(lambda t: t.split("|")[1] or None).collect()}
    assert len(got) == len(rows)
    for i, (mine, levels) in enumerate(trees):
        for at, row in enumerate(mine):
            path = way(levels, at, arity) + way(top, i, arity)
            r = got[row[3]]
            assert (r.grp, r.place, r.leaf) == (i, at, row[2])
            assert r.proof == sha("".join("".join(b) + "".join(a) for b, a in path))
            cur = row[3].split("|")[1] or row[2]
            for before, after in path:
                cur = sha("".join(before) + cur + "".join(after))
            assert r.folded == cur
            assert r.verified == (not row[3].split("|")[1])
    assert all(r.verified for r in made.verified().collect())
    assert all(merkle.fold(r.node, list(r.path)) == made.root for r in made.proofs().collect())


def test_leaves_and_empty_manifest(spark):
    docs = spark.createDataFrame([(1, None, "en", 3, "añb"), (None, "s", None, None, "")], "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("value", "key", "grp", "__place")})
    got = {r[0] for r in docs.select(merkle.leaf(docs, merkle.FIELDS)).collect()}
    assert got == {sha("1:1-2:en1:34:añb"), sha("-1:s--0:")}
    rows = docs.select("*", merkle.leaf(docs, merkle.FIELDS).alias("leaf"))
    assert merkle.manifest(rows, "lang", "doc_id", "leaf", "text").verified().count() == 2
    made = merkle.manifest(rows.limit(0), "lang", "doc_id", "leaf", "text")
    assert made.root is None
    assert made.verified().collect() == []
    # Equal rows have places and proofs of their own.
    twice = merkle.manifest(rows.unionByName(rows), "lang", "doc_id", "leaf", "text").verified().collect()
    assert len(twice) == 4
    assert len({(r.grp, r.place) for r in twice}) == 4


# --- 13 -----------------------------------------------------------------------


def brute_phrases(rows, least, best):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    hidden = collections.Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                hidden[lang, p[i : i + k]] = max(hidden[lang, p[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if 100 * hidden[lang, p] >= 80 * a:
            continue
        s, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-s, -a, " ".join(p).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:best], 1)}


def phrase_rows(n=300):
    rng, rows = random.Random(5), []
    for i in range(n):
        # Repeated words, doubled blanks, capitals, marks, and letters of several bytes.
        words = [rng.choice(["the", "The", "of", "a", "é", "日本", "x1", "the the", "b\tc", f"w{rng.randrange(12)}", f"r{rng.randrange(400)}"]) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" "] * 8 + ["  ", ", ", "\n", "!?", ".", "\r"]) for w in words)
        rows.append((i, rng.choice(["en", "en", "de", None, "und"]), rng.choice([text] * 20 + [None, ""])))
    return rows + [(1000 + i, "en", "one fixed passage of words that repeats") for i in range(40)]


@pytest.mark.parametrize("group", [phrases.GROUP, 50])
def test_collocations_against_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER", 4000)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    got = phrases.collocations(docs, least=10, best=25, group=group)
    want = brute_phrases([(lang, t) for _, lang, t in rows], 10, 25)
    assert len(want) > 60
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want


def test_collocations_edges(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "en", ""), (2, "en", ".,;\n"), (3, None, "a b " * 40)], "doc_id long, lang string, text string").withColumns({c: F.lit(1) for c in ("n", "word", "phrase", "hash")})
    assert phrases.collocations(docs.limit(0)).collect() == []
    got = phrases.collocations(docs).collect()
    assert {(r.lang, r.phrase, r.a) for r in got} == {x[:1] + x[2:4] for x in brute_phrases([("und", "a b " * 40)], 30, 2000)}


def test_stretches_end_where_pieces_end():
    data = np.frombuffer(b"aa bb. cc dd\nee ff gg hh ii jj kk! ll", np.uint8)
    for most in (3, 8, 20, 100):
        cuts = list(phrases._stretches(data, most))
        assert b"".join(data[a:b].tobytes() for a, b in cuts) == data.tobytes()
        assert all(phrases.ENDS[data[b - 1]] for _, b in cuts[:-1])


def test_strong_hashes_part_patterned_words():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    data = np.frombuffer((a + b).encode(), np.uint8)
    start, end = np.array([0, len(a)]), np.array([len(a), 2 * len(a)])
    weak, strong = kernels.word_hashes(data, start, end, 8), kernels.strong_hashes(data, start, end, 8)
    assert weak[0] == weak[1]
    assert strong[0] != strong[1]
    same = kernels.strong_hashes(np.frombuffer(b"xx ab ab", np.uint8), np.array([3, 6]), np.array([5, 8]), 8)
    assert same[0] == same[1]


def test_substring_dedup_parts_patterned_words(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words[:30], x, *words[30:]])) for i, x in enumerate((a, b))], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()} == {(0, 0), (1, 0)}
