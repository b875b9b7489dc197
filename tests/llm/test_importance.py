"""Importance resampling against plain Python: features, gains, noise, the exact last key and the ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from glyphspan.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def _plain_buckets(text, n=3, buckets=10_000):
    words = WORD.findall((text or "").translate(SMALL))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def _plain(docs, target, share=Fraction(5, 100), least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(_plain_buckets(text)[1])
    for text in target:
        t.update(_plain_buckets(text)[1])
    n, m, rows = sum(s.values()), sum(t.values()), []
    for at, (doc_id, text) in enumerate(docs):
        words, found = _plain_buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words, at])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], 2**63 if r[0] is None else r[0], r[5]))
    ranks = {r[5]: i for i, r in enumerate(able[: int(share * len(able))], 1)}
    return [(*r[:4], ranks.get(r[5])) for r in rows]


def _told(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_whole_query_against_plain_python(spark, sf):
    from glyphspan.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, sf)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert _told(got) == sorted(_plain(docs, target), key=str)


def test_pieces_of_a_text_join_up(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices(["A", "b", "é", "漢", " ", "\n", "-", "\x00", "7", "  "], k=5000))
    for piece in (1, 2, 3, 7, 50, 1 << 22):
        monkeypatch.setattr(importance, "PIECE", piece)
        for n in (1, 2, 3, 4):
            parts = list(importance.feature_buckets(text, 997, n))
            words, want = _plain_buckets(text, n, 997)
            assert sum(p[0] for p in parts) == words
            assert Counter(np.concatenate([p[1] for p in parts]).tolist()) == Counter(want)


@pytest.mark.parametrize("digit", [5, 12])
def test_last_key_is_exact(spark, digit):
    rng = random.Random(digit)
    ends = [-(2**63), 2**63 - 1, 0, -1, 1, 2**40]
    rows = list({(rng.choice(ends), rng.choice([*ends, rng.randrange(-50, 50)]), i) for i in range(60)})
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, len(rows) // 2, len(rows)):
        assert tuple(importance.last_key(df, ["a", "b", "c"], k, digit)) == sorted(rows)[k - 1]
    assert importance.last_key(df, ["a"], 0) is None and importance.last_key(df, ["a", "b", "c"], len(rows) + 1) is None


def test_cases(spark):
    long = " ".join(random.Random(1).choices(["River", "sea", "BOAT", "été", "x1"], k=100_000))
    docs = [(1, long), (1, long), (1, long), (None, long), (None, long), (2, None), (3, ""), (4, "a"), (5, " ".join("ab" * 20)), (9, "sea " * 19), (-7, "sea " * 20)]
    target = ["river sea", None, "", "river sea boat"]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, note string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for share in (Fraction(1), Fraction(1, 100), Fraction(3, 7)):
        out = importance.resample(df, aim, share=share)
        assert out.columns == ["doc_id", "text", "note", "n_features", "weight", "score", "rank"]
        assert _told(out) == sorted(_plain(docs, target, share), key=str)
    assert importance.resample(df.limit(0), aim).collect() == []
    nothing = importance.resample(df, aim.limit(0), share=Fraction(1))
    assert _told(nothing) == sorted(_plain(docs, [], Fraction(1)), key=str)
    with pytest.raises(ValueError):
        importance.resample(df.withColumn("Rank", df["doc_id"]), aim)
    assert importance.resample(df.withColumn("Rank", df["doc_id"]).withColumn("__order", df["doc_id"]), aim, keep=["doc_id", "__order"]).count() == len(docs)


def test_equal_rows_share_what_is_drawn(spark):
    df = spark.createDataFrame([(7, "sea " * 25)] * 50 + [(8, "sea " * 25)] * 50, "doc_id long, text string")
    out = importance.resample(df, df, share=Fraction(60, 100)).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 61))
    assert sorted(sum(r["rank"] is not None for r in out if r["doc_id"] == d) for d in (7, 8)) == [10, 50]
