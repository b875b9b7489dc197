"""Line dedup against a plain Python version of its rule, and its edge cases."""

import random

import pytest

from glyphspan.llm import linededup

SCHEMA = "doc_id long, text string"


def _line(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def _without_repeats(rows, least=30):
    """Lines in a row that stand, in a row, at an earlier place go, where they have ``least`` words or more."""
    order = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None})
    filled = {k: [(i, x) for i, x in enumerate(k[2].split("\n")) if x.strip()] for k in order}
    out, seen_pairs, seen_lines = {}, set(), set()
    for key in order:
        lines = filled[key]
        gone = set()
        pairs = [(lines[i][1], lines[i + 1][1]) for i in range(len(lines) - 1)]
        for i, p in enumerate(pairs):
            if p in seen_pairs:
                gone |= {i, i + 1}
            seen_pairs.add(p)
        for i, (_, x) in enumerate(lines):
            if x in seen_lines and len(x.split()) >= least:
                gone.add(i)
            seen_lines.add(x)
        every, drop, run = key[2].split("\n"), set(), []
        for i in [*sorted(gone), None]:
            if run and i != run[-1] + 1:
                if sum(len(lines[j][1].split()) for j in run) >= least:
                    drop |= set(range(lines[run[0]][0], lines[run[-1]][0] + 1))
                run = []
            if i is not None:
                run.append(i)
        out[key] = "\n".join(x for i, x in enumerate(every) if i not in drop)
    return sorted(((d, None if t is None else out[(d is not None, d or 0, t)]) for d, t in rows), key=str)


def _got(spark, rows, **how):
    got = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), **how).collect()
    return sorted(((r["doc_id"], r["text"]) for r in got), key=str)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    passages = [[_line(rng, n) for _ in range(k)] for k, n in ((1, 60), (2, 26), (3, 18), (4, 13), (5, 11), (12, 5), (2, 8))]
    passages.append([passages[0][0][:-1], "", _line(rng, 40)])
    common = _line(rng, 9)
    rows = []
    for d in range(60):
        parts = [[_line(rng, rng.randrange(3, 12)) for _ in range(rng.randrange(1, 4))] for _ in range(3)]
        parts.insert(1, passages[d % len(passages)])
        if d % 3 == 0:
            parts.insert(0, [common])
        rows.append((d, "\n".join(x for part in parts for x in part)))
    return rows


def test_planted_passages_go_from_end_to_end(spark, planted):
    want = _without_repeats(planted)
    assert _got(spark, planted) == want
    assert _got(spark, planted, hot=2) == want  # all are dealt into shares
    assert sum(a != b for a, b in zip(sorted(planted, key=str), want, strict=True)) == 60 - 7 - 7  # seven passages stay once, the one of 16 words in all its seven documents


def test_lines_that_share_a_hash_are_told_apart(spark, planted):
    got = {d: t for d, t in _got(spark, planted, mask=0x3F)}
    assert got == dict(planted)  # of 64 hashes each has different lines, so no line is known to be a copy
    long = [(i, t) for i, t in enumerate([planted[0][1], planted[0][1], "other " * 30])]
    assert _got(spark, long, mask=-1) == _without_repeats(long)


def test_documents_as_plain_python(spark, sf):
    import pandas as pd

    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
    assert _got(spark, rows) == _without_repeats(rows)


def test_cases(spark):
    rng = random.Random(4)
    a, b, c = (_line(rng, 40) for _ in range(3))
    long = "\n".join(_line(rng, 6) for _ in range(20_000))
    rows = [(None, a), (None, a), (1, a + "\n\n" + b), (1, c), (8, b + "\n" + c), (2, None), (3, ""), (4, "\n \n"), (5, long), (6, "x\n" + long), (7, a + "\n" + a)]
    got = dict(enumerate(sorted(_got(spark, rows), key=str)))
    assert list(got.values()) == _without_repeats(rows)
    assert (6, "x") in got.values() and (None, a) in got.values() and (7, "") in got.values()
    df = spark.createDataFrame([(1, a, 5, "u"), (2, a, 6, "v")], "doc_id long, text string, __gone long, h string")
    out = linededup.dedup_lines(df, removed="id").orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, a, 5, "u", 0), (2, "", 6, "v", 1)]
    assert linededup.dedup_lines(df.limit(0), removed="n").columns == [*df.columns, "n"]
    assert linededup.dedup_lines(df.limit(0)).count() == 0
