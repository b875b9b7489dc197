"""The quality query against plain Python: features of every line recomputed, learning from whole texts, scores by enumeration-free recursion."""

import math
import zlib

import numpy as np
import pandas as pd

from glyphspan.llm import quality
from glyphspan.llm.queries import QUERIES


def _kind(c):
    if c.isalpha():
        return "upper" if c.isupper() else "lower" if c.islower() else "letter"
    if c.isspace():
        return "space"
    if c.isdigit():
        return "digit"
    return "stop" if c in ".,;:" else "shout" if c in "!?" else "bar" if c == "|" else "quiet" if c in "'\"-()’“”«»–—" else "symbol"


def _words(line):
    out = [""]
    for c in line:
        if _kind(c) == "space":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def _features(text):
    """The features of each line, counted one by one."""
    rows, before = [], set()
    for line in text.split("\n"):
        n, words, kinds = len(line), _words(line), [_kind(c) for c in line]
        count = kinds.count
        letters = count("upper") + count("lower") + count("letter")
        at, some = max(n, 1), max(len(words), 1)
        rows.append([
            math.log1p(n), count("upper") / max(letters, 1), letters / at, count("digit") / at, count("symbol") / at, count("shout") / at, count("bar") / at, count("stop") / some, letters / some / 10,
            len(set(words)) / some, sum(a == b for a, b in zip(words, words[1:])) / some, n > 0 and kinds[-1] in ("stop", "shout"), n > 0 and kinds[0] == "upper",
            sum(len(w) <= 3 for w in words) / some, bool(words) and tuple(words) in before, math.log1p(len(words)),
        ])
        before.add(tuple(words))
    return np.array(rows, float)


def _score(text, model):
    """P(good) of each line by sums over both labels from either end, weighted by length."""
    x = _features(text)
    n, k = x.shape
    u = []
    for i in range(n):
        wide = np.concatenate([x[i], x[i - 1] if i else np.zeros(k), x[i + 1] if i + 1 < n else np.zeros(k), [i == 0, i + 1 == n, 1]])
        u.append(float((wide - model.mean) / model.scale @ model.weights))
    add = np.logaddexp
    ahead = [(0.0, u[0])]
    for i in range(1, n):
        ahead.append(tuple(add(ahead[-1][0] + model.trans[0, j], ahead[-1][1] + model.trans[1, j]) + (u[i] if j else 0) for j in (0, 1)))
    back = [(0.0, 0.0)]
    for i in range(n - 1, 0, -1):
        back.append(tuple(add(model.trans[j, 0] + back[-1][0], model.trans[j, 1] + u[i] + back[-1][1]) for j in (0, 1)))
    back.reverse()
    good = [1 / (1 + math.exp(min(700, (ahead[i][0] + back[i][0]) - (ahead[i][1] + back[i][1])))) for i in range(n)]
    size = [max(len(x), 1) for x in text.split("\n")]
    return sum(g * s for g, s in zip(good, size)) / sum(size)


def test_whole_query_against_plain_python(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    taught = sorted(i for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5 and q in (0, 1) and i in docs)
    rows = []
    for i in taught:
        x = _features(docs[i]).astype(np.float32)
        size = np.array([len(line) for line in docs[i].split("\n")], float)
        rows.append((labels[i], x.tobytes(), size.tobytes(), 0, 0, 1.0))
    model = quality.fit_runs(pd.DataFrame(rows, columns=["good", "x", "size", "before", "behind", "weight"]))
    got = {r["doc_id"]: r for r in QUERIES["op3_quality_crf"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        want = _score(text, model)
        assert abs(got[i]["score"] - want) < 1e-4 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_lines_behind_the_first_thousand_teach(spark):
    """A good text, and the same with junk behind it: only what stands behind tells them apart."""
    good = "\n".join(f"The house number {i} stands by the river." for i in range(1000))
    junk = "\n".join("BUY NOW!!! ||| $$$ 100% ###" for _ in range(3000))
    docs = spark.createDataFrame([(i, good if i % 2 else good + "\n" + junk) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.with_quality(docs, model).collect()}
    assert scores[1] > 0.8 and scores[0] < 0.5


def test_runs_are_drawn_from_the_whole_text():
    assert quality.drawn_runs(1000) == [(0, 1000)]
    runs = quality.drawn_runs(100_007)
    assert len(runs) == 50 and all(b - a <= 20 for a, b in runs) and runs[0][0] < 20_000 and runs[-1][0] > 80_000
    text = "\n".join(f"line {i}." + "x" * (i % 7) for i in range(2011))
    x = _features(text).astype(np.float32)
    for (a, b), (some, size, before, behind, weight) in zip(quality.drawn_runs(2011), quality.taught_rows(text), strict=True):
        assert np.allclose(some, x[a - before : b + behind], atol=1e-5) and len(size) == b - a and weight == 1 / 50
        assert before == (a > 0) and behind == (b < 2011)
