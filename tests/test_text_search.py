"""Search of texts by TF-IDF: the features, the vectors, and what a pass takes."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from ledgerlark.plans import retrieval


@pytest.mark.parametrize("name", ["tfidf_topk", "rrf_fusion"])
def test_no_row_for_each_document_and_term(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "terms", None)
    got = sorted(map(tuple, entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())


def test_more_queries_share_a_pass(spark):
    rows = [(i, f"t{i % 700}", 1.0) for i in range(2100)]
    w = spark.createDataFrame(rows, "k long, term string, weight double")
    found = retrieval.sparse_top(w, w, "k", 3)
    # They went in passes of 2,048.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r["query"], r.k) for r in found.collect()} == {(i, j) for i in range(2100) for j in range(i % 700, 2100, 700) if i != j}


DOCS = [(1, "aa bb aa bb cc"), (1, "bb Dd"), (2, "éé aa, x bb!"), (3, None), (4, "zz yy xx ww vv zz"), (None, "yy aa bb"), (5, "cc cc_1 ９９ 二二"), (6, "")]


def _expected(features):
    tf, ids = Counter(), set()
    for k, x in DOCS:
        ids.add(k)
        words = duckdb.execute(r"SELECT regexp_extract_all(lower(?), '[\p{L}\p{N}_][\p{L}\p{N}_]+')", [x or ""]).fetchone()[0]
        tf.update((k, t) for t in [*words, *map(" ".join, zip(words, words[1:]))])
    total, df = Counter(), Counter()
    for (k, t), n in tf.items():
        total[t] += n
        df[t] += 1
    vocabulary = sorted(total, key=lambda t: (-total[t], t.encode()))[:features]
    n = len(ids - {None})
    out = {}
    for (k, t), c in tf.items():
        if k is not None and t in vocabulary:
            out.setdefault(k, []).append((c, round(math.log((1 + n) / (1 + df[t])) + 1, 12)))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("features", [3, 7, 10, 14, 100])
def test_features_of_equal_totals(spark, monkeypatch, features):
    # Few counters, and a table told in parts, so that the bounds are loose.
    for name, n in {"SLOTS": 64, "COUNTED": 4, "TOLD": 2}.items():
        monkeypatch.setattr(retrieval, name, n)
    docs = spark.createDataFrame(DOCS, "k long, x string")
    found, idf = retrieval.term_counts(docs, "k", "x", features)
    assert {r.k: sorted((c, round(float(idf[t]), 12)) for t, c in zip(r.terms, r.counts)) for r in found.collect()} == _expected(features)


def test_places_of_hashes_that_share_a_slot():
    terms = np.array([5, 5 + 64, 5 + 128, 9, -3, 64 - 3], np.int64)
    find = retrieval.places(terms, bits=6)
    assert find(np.array([9, 5, 7, 133, 69, -3, 61, 73])).tolist() == [3, 0, -1, 2, 1, 4, 5, -1]
    assert retrieval.places(terms[:0])(terms).tolist() == [-1] * 6


def test_what_single_precision_leaves_open():
    rng = np.random.default_rng(6)
    near = 0.5 + rng.integers(0, 9, (300, 20)) * 1e-8
    exact = lambda i, j: near[i, j]
    one, other = (retrieval.Best(np.arange(1000, 1020), 3, 0.0) for _ in range(2))
    for a in (0, 100, 200):
        ids = np.arange(a, a + 100)
        one.add(near[a : a + 100], ids)
        other.add(near[a : a + 100].astype(np.float32), ids, lambda i, j, a=a: exact(i + a, j), 1e-6)
    assert all(np.array_equal(x, y) for x, y in zip(one.rows(), other.rows()))
