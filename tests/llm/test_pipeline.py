"""The pipeline's near-duplicate stage against comparing every pair of texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphspan.llm import minhash


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _kept(rows):
    """Ids that stay when every pair is compared."""
    sets, root = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def _edited(seed, edits, n=200):
    words = [f"w{x}" for x in random.Random(seed).sample(range(100_000), n)]
    for e in range(edits):
        words[10 + 20 * e] = f"new{seed}x{e}"
    return " ".join(words)


def _stage(spark, rows):
    return corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()


def test_near_duplicates_as_all_pairs(spark, docs):
    rows = [(10 * s + e, _edited(s, e)) for s in range(20) for e in (0, 1, 4, 9)]  # 4 edits lie at 0.81, 9 below 0.8 of all others
    rows += [(1000 + i, t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)]
    want = _kept(rows)
    assert {0, 9, 190, 199} <= set(want) and not {1, 4, 191, 194} & set(want)
    assert sorted(r["doc_id"] for r in _stage(spark, rows)) == want


def test_large_blocks_are_dealt_into_shards(spark):
    rows = [(10 * s + e, _edited(s, e)) for s in range(5) for e in range(9)]
    df = spark.createDataFrame([(d, d, t) for d, t in rows], "row long, doc_id long, text string")
    assert sorted(r["row"] for r in minhash.kept_rows(df, "row", tile=300).collect()) == _kept(rows)


@pytest.fixture(scope="module")
def docs(sf):
    import pandas as pd

    return pd.read_parquet(f"{sf}/documents.parquet")


def test_one_row_of_a_group_stays_with_repeated_and_null_ids(spark):
    a, b, c, d = (_edited(s, 0) for s in range(4))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, d)]
    kept = sorted(((r["doc_id"], r["text"]) for r in _stage(spark, rows)), key=str)
    assert kept == sorted([(1, a), (None, b), (2, c), (2, d)], key=str)


def test_simhash_links_are_candidates(spark, monkeypatch):
    """What SimHash links meets even where no key of MinHash is shared; the exact similarity decides."""
    from glyphspan.llm import simhash

    rows = [(0, 1, "a b c d e f g"), (1, 2, "h i j k l m n"), (2, 3, "o p q r s t u")]
    df = spark.createDataFrame(rows, "row long, doc_id long, text string")
    alike = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "row long, group long")
    kept = lambda **how: sorted(r["row"] for r in minhash.kept_rows(df, "row", **how).collect())
    assert kept(similarity=0.0) == [0, 1, 2]
    assert kept(similarity=0.0, alike=alike) == [0, 2]
    assert kept(alike=alike) == [0, 1, 2]
    called, real = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: called.append(1) or real(*a, **k))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df.select("doc_id", "text"), "").collect()} == {1, 2, 3}
    assert called


def test_pairs_that_share_no_key_are_not_lost(spark):
    """These lie at 0.8, share no key of MinHash and differ in more than three bits of SimHash."""
    from glyphspan.llm import simhash

    rows = []
    for seed in (4528, 19906, 54771):
        words = [f"w{seed}x{i}" for i in range(13)]
        a, b = " ".join(words), " ".join([*words[:-1], "end"])
        assert not (minhash.band_keys(minhash.shingle_set(a)) == minhash.band_keys(minhash.shingle_set(b))).any()
        assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > simhash.RADIUS
        rows += [(2 * seed, a), (2 * seed + 1, b)]
    assert _kept(rows) == [2 * 4528, 2 * 19906, 2 * 54771]
    assert sorted(r["doc_id"] for r in _stage(spark, rows)) == _kept(rows)


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_unmet_pairs_hold_all_pairs_of_different_components(spark, similarity):
    """Without MinHash, too, for families about the limit, common phrases, one component in parts, and whatever the order of shingles."""
    rng = random.Random(3)
    texts, phrase = [], "such words as these stand in very many texts"
    for family in range(12):
        n = rng.randrange(30, 150)
        words = [f"w{family}x{i}" for i in range(n)]
        for member in range(8):
            own = [w if rng.random() > 0.003 * member else f"n{family}m{member}x{i}" for i, w in enumerate(words)]
            texts.append(" ".join([*own, phrase] if rng.random() < 0.5 else own))
    texts = sorted({tuple(sorted(_shingles(t))): t for t in texts}.values())
    sets = [_shingles(t) for t in texts]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9}
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    nodes = df.select(F.col("row").alias("node"))
    for some in (set(), {i for i in range(len(texts)) if rng.random() < 0.5}):
        roots = spark.createDataFrame([(i, min(some)) for i in sorted(some)], "node long, root long")
        got = {tuple(r) for r in minhash.unmet_pairs(df, "row", "text", nodes, roots, similarity=similarity).collect()}
        want = {(i, j) for i, j in alike if not {i, j} <= some}
        assert len(want) > 30 and want <= got
        assert not any({i, j} <= some for i, j in got) and len(got) < len(texts) * (len(texts) - 1) / 8
    common = minhash.commonness(df)
    hot = minhash.shingle_set(phrase)
    assert (common[minhash._bucket(hot)] >= 3).all()
    assert not set(hot) & set(minhash.prefix(minhash.shingle_set("a b c d e f g h i j " + phrase), common, 0.8))
