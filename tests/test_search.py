"""Sparse search: products by term, the best rows of a task, passes over the rows."""

import numpy as np

from ledgerlark.plans import retrieval


def _vectors(rng, n):
    terms = [np.unique((rng.random(60) ** 3 * 900).astype(np.int64)) for _ in range(n)]
    return terms, [rng.random(len(t)) for t in terms]


def test_products_of_frequent_and_rare_terms(monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 500)
    rng = np.random.default_rng(3)
    (qt, qw), (rt, rw) = _vectors(rng, 90), _vectors(rng, 40)
    rt[7], rw[7] = np.array([5000]), np.array([1.0])
    matrix = retrieval.query_matrix(qt, qw)
    assert 0 < len(matrix[2]) < len(matrix[0])
    got = retrieval.sparse_products(np.repeat(np.arange(40), [len(t) for t in rt]), np.concatenate(rt), np.concatenate(rw), 40, matrix)
    want = [[sum(dict(zip(a, x)).get(t, 0.0) * y for t, y in zip(b, z)) for b, z in zip(qt, qw)] for a, x in zip(rt, rw)]
    assert np.allclose(got, want) and not got[7].any()


def test_best_rows_with_ties_over_slices():
    rng = np.random.default_rng(4)
    sims, ids = rng.random((200, 30)).round(1), rng.permutation(200)
    best = retrieval.Best(np.arange(30), 5)
    for at in range(0, 200, 33):
        best.add(sims[at : at + 33], ids[at : at + 33])
    got = {}
    for q, i, s in zip(*best.rows()):
        got.setdefault(q, []).append((-s, i))
    assert got == {j: sorted((-s, i) for i, s in zip(ids, sims[:, j]) if i != j)[:5] for j in range(30)}


def test_queries_share_a_pass(spark):
    rng = np.random.default_rng(5)
    terms, weights = _vectors(rng, 300)
    rows = [(i, str(t), float(w)) for i in range(300) for t, w in zip(terms[i], weights[i])]
    w = spark.createDataFrame(rows, "k long, term string, weight double")
    found = retrieval.sparse_top(w, w, "k", 3)
    # 300 queries went in three passes of 128 over all rows.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    dense = np.zeros((300, 900))
    for i in range(300):
        dense[i, terms[i]] = weights[i]
    sims = (dense @ dense.T).round(9)
    want = {(j, i) for j in range(300) for i in sorted((i for i in range(300) if i != j and sims[i, j] > 0), key=lambda i: (-sims[i, j], i))[:3]}
    assert {(r["query"], r.k) for r in found.collect()} == want
