"""Nearest neighbours of vectors of unequal norms and other lengths against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphspan.llm import ann


def _vectors(kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 768 if kind == "768 dimensions" else 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 0.5, (len(x), 1))
    if kind == "one outlier":
        x[17] *= 20
    return x


@pytest.mark.parametrize("kind", ["unit", "lognormal", "one outlier", "768 dimensions"])
def test_recall_of_unequal_norms_and_lengths(spark, kind):
    x = _vectors(kind)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20).toPandas().groupby("query_id")["vec_id"].agg(set)
    hits = 0
    for at in range(0, len(x), 20):
        score = x @ x[at]
        score[at] = -np.inf
        assert len(got[at]) == 20
        hits += len(got[at] & set(np.argsort(-score)[:20].tolist()))
    print(kind, hits / (20 * len(got)))
    assert hits / (20 * len(got)) >= 0.95


def test_queries_that_find_nothing_at_first_get_full_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 64))
    x *= rng.uniform(0.9, 1.1, (200, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.lit(True), k=5, share=0.001, recall=0.001).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(200), 5)


def _many_vectors_of_an_id():
    """One id with 40 vectors near the query, 30 other ids, all of one norm."""
    rng = np.random.default_rng(5)
    q = rng.normal(size=16)
    near = [(1, (q + 0.05 * rng.normal(size=16))) for _ in range(40)]
    far = [(10 + i, rng.normal(size=16)) for i in range(30)]
    return [(0, q), *near, *far]


@pytest.mark.parametrize("how", [{}, {"hashes": 2}, {"tile": 7}])
def test_ids_of_many_vectors_count_once(spark, how):
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in _many_vectors_of_an_id()]
    rng = np.random.default_rng(6)
    rows += [(i % 25 + 50, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(200, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id").isin(0, 55), k=20, share=1.0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for query in (0, 55):
        best = {}
        for mine in (np.array(v) for i, v in rows if i == query):
            for i, v in rows:
                if i != query:
                    best[i] = max(best.get(i, -2.0), float((np.array(v) * mine).sum()))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        mine = sorted(got[query])
        assert [r[0] for r in mine] == list(range(1, 21))
        assert [r[1] for r in mine] == [i for i, _ in want] and np.allclose([r[2] for r in mine], [s for _, s in want])


@pytest.mark.parametrize("hashes, width, n", [(2, 64, 6000), (2, 768, 1500)])
def test_recall_of_two_hashes(spark, hashes, width, n):
    x = np.random.default_rng(width).normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    step = n // 60
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % step == 0, k=20, hashes=hashes).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    right = 0
    for q in range(0, n, step):
        s = x @ x[q]
        s[q] = -np.inf
        right += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert all(len(v) == 20 for v in got.values()) and right / (20 * len(got)) >= 0.9


def test_probes_are_the_best_sums():
    x = np.random.default_rng(3).normal(size=(5, 8))
    for n in (1, 7, 100, 256):
        got = ann.probes(x, 1, 2, n)
        z = [ann.rotate(x, 1, f) for f in range(2)]
        a, b = (np.stack([y, -y], axis=2).reshape(5, -1) for y in z)
        for i in range(5):
            sums = (a[i][:, None] + b[i][None, :]).ravel()
            assert len(set(got[i].tolist())) == n
            assert np.allclose(np.sort(sums[got[i]])[::-1], np.sort(sums)[::-1][:n])
