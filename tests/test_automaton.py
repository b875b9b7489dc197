"""Automata over lines dealt in blocks, and articles out of a stream of lines, against plain Python that walks the lines."""

import random
import re

import pytest

from glyphspan.operators import automaton as A
from glyphspan.plans import registry

MARKS = A.ArticleMarks(start="^==START", key=r"^<b>[^<>]+</b>:", joined=("goes on",), end="THE END")


def _states(lines, machine, kinds):
    state, out = machine.start, []
    for line, kind in zip(lines, kinds, strict=True):
        after, action = machine.steps.get((state, kind), (state, "error"))
        out.append((line, kind, state, action))
        state = after
    return out


def _kind(line, marks=MARKS):
    if re.search(marks.start, line):
        return A.START
    if not line.strip(" "):
        return A.BLANK
    if re.search(marks.key, line):
        return A.KEY
    if re.search(marks.bold, line) or re.search(marks.mark, line):
        return A.MARK
    if line in marks.joined:
        return A.JOINED
    return A.LETTER if re.search(marks.letter, line) else A.SENSE if re.search(marks.sense, line) else A.OTHER


def _lines(spark, files):
    return A.numbered_lines(spark.createDataFrame(list(files.items()), "f string, t string"), "f", "t")


def test_states_of_any_block_size(spark):
    rng = random.Random(6)
    states, classes = ["p", "q", "r"], ["x", "y", "z"]
    steps = {(s, c): (rng.choice(states), f"{s}{c}") for s in states for c in classes if rng.random() < 0.9}
    machine = A.Automaton(states, classes, steps, "q")
    files = {f"f{i}": "\n".join(rng.choices(classes, k=n)) for i, n in enumerate((1, 2, 7, 8, 9, 63, 64, 65, 200))}
    lines = _lines(spark, files | {"none": None})
    want = {f: _states(t.split("\n"), machine, t.split("\n")) for f, t in files.items()}
    for block in (2, 4, 512):
        told = A.with_states(lines, machine, A.F.col("text"), block).orderBy("file", "line").collect()
        got = {}
        for r in told:
            got.setdefault(r["file"], []).append((r["text"], r["kind"], r["state"], r["action"]))
        assert got == want
        run = A.counted(lines, A.F.col("text") == "x", "n", block).collect()
        assert {(r["file"], r["line"]): r["n"] for r in run} == {(f, i): t.split("\n")[: i + 1].count("x") for f, t in files.items() for i in range(len(t.split("\n")))}
    with pytest.raises(Exception, match="no class"):
        A.with_states(lines, machine, A.F.lit("w")).collect()
    assert A.with_states(lines.limit(0), machine, A.F.col("text")).collect() == []


def _articles(text, marks=MARKS):
    """The lines of each article, by a walk over a file's lines."""
    lines, torn = [], None
    for line in text.split("\n"):
        if torn is not None and line.startswith("*"):
            line = torn + line[1:]
        m = re.search(r" ([^ ]+)-\*$", line)
        torn = m[1] if m else None
        lines.append(line[: m.start()] if m else line)
    if marks.end in lines:
        lines = lines[: lines.index(marks.end)]
    lines = [x for x in lines if not (marks.note and re.search(marks.note, x))]
    out = []
    for line, _, _, action in _states(lines, A.ARTICLES, [_kind(x, marks) for x in lines]):
        if action == "error":
            raise ValueError(line)
        if action == "open":
            out.append([])
        if action == "join":
            out[-1].pop()
        if action in ("open", "add", "join"):
            out[-1].append(line)
    return out


DICTIONARY = """front
<b>no</b>: entry
==START
A.

<b>abandon</b>: to leave; see also for-*
*sake, 1.
[**a note]
1. sense

2. more

<b>abase</b>: humble

goes on
here


I. apart


----<b>ment</b>: state


B.
/*
a list
*/

<b>babe</b>
THE END
<b>behind</b>: not read"""


def test_articles(spark):
    lines = _lines(spark, {"d": DICTIONARY})
    want = _articles(DICTIONARY)
    assert [a[0] for a in want] == ["<b>abandon</b>: to leave; see also", "<b>abase</b>: humble", "----<b>ment</b>: state", "/*"]
    assert want[0][1] == "forsake, 1." and want[1] == ["<b>abase</b>: humble", "goes on", "here", "", "", "I. apart", "", ""]
    for block in (2, 3, 512):
        got = A.article_texts(A.articles(lines, MARKS, block)).orderBy("article").collect()
        assert [r["lines"] for r in got] == want and [r["article"] for r in got] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="opens none"):
        A.articles(_lines(spark, {"d": "==START\n\nloose words"}), MARKS).collect()


def test_articles_of_random_streams(spark):
    rng = random.Random(7)
    pool = ["", "", "", "<b>k</b>: x", "<b>bold</b>", "----dash", "/*", "goes on", "words", "C.", "1. sense", "[**note]", "tail for-*", "*ward", " "]
    files = {}
    while len(files) < 40:
        text = "\n".join(["==START", "", "<b>k</b>: first", *rng.choices(pool, k=rng.randrange(60))])
        try:
            _articles(text)
        except ValueError:
            continue
        files[f"f{len(files)}"] = text
    got = {}
    for r in A.article_texts(A.articles(_lines(spark, files), MARKS, 4)).orderBy("file", "article").collect():
        got.setdefault(r["file"], []).append(r["lines"])
    assert got == {f: _articles(t) for f, t in files.items()}


def test_keys(spark):
    df = spark.createDataFrame([("for-sake, to",), ("----ment",), ("well -being",), ("a",)], "key string")
    assert [r[0] for r in df.select(A.key_parts(A.F.col("key"))).collect()] == [["for", "-", "sake", ",", "to"], ["----", "ment"], ["well", "-", "being"], ["a"]]
    rows = [("f", i, k) for i, k in enumerate(["----x", "abandon", "----ment", "---- of", "abase, to", "----ment", "for-sake", "----n"])] + [("g", 0, "----y")]
    for block in (2, 512):
        got = sorted(map(tuple, A.whole_keys(spark.createDataFrame(rows, "file string, article long, key string"), block).collect()))
        assert [k for f, _, k in got if f == "f"] == ["x", "abandon", "abandonment", "abandon of", "abase, to", "abasement", "for-sake", "forn"] and got[-1] == ("g", 0, "y")
    assert [r[0] for r in spark.createDataFrame([("<b>key </b> x",), ("x",)], "t string").select(A.first_key(A.F.col("t"))).collect()] == ["key", None]


def test_articles_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", "doc_id", "text").collect()
    marks = registry.PARAGRAPHS
    lines = {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        lines.setdefault(r["source"], []).extend([*(r["text"].split("\n") if r["text"] is not None else []), ""])
    want = []
    for source, some in lines.items():
        kinds = [A.BLANK if not x.strip(" ") else A.KEY if re.search(marks.key, x) else A.OTHER for x in some]
        state = A.IN
        n = -1
        for x, kind in zip(some, kinds, strict=True):
            state, action = registry.STREAM.steps[(state, kind)]
            n += action == "open"
            want.append((source, n, action, x))
    from collections import Counter

    count = Counter((s, n) for s, n, action, _ in want if action in ("open", "add") and n >= 0)
    got = {(r["source"], r["article"]): r["lines"] for r in registry.QUERIES["source_articles"](spark, sf).collect()}
    assert got == dict(count) and len(got) > 50
