"""Works recombined from poems: like titles, runs over blocks, shapes, ids, pages and faults."""

import random

from pyspark.sql import functions as F

from glyphspan.operators import recombine as W

SCHEMA = "file string, ord long, author string, title string, subtitle string, poem_title string, poem_number string, lines array<struct<line:string,text:string>>"


def _poems(spark, rows):
    return spark.createDataFrame([(*r[:7], [(str(i + 1), t) for i, t in enumerate(r[7])]) for r in rows], SCHEMA)


def test_like_titles(spark):
    pairs = [("Odes 1", "odes 2", True), ("Odes: 1", "Odes  7", True), ("Odes", "ODES ", True), ("Odes 1", "Odes", False), ("Odes 1", "Odes a 1", False), ("1", "2", True), (":1", "2", False), ("Odes -1", "Odes 12", True), ("Odes 1a", "Odes 2a", False), ("", "", True), ("a 1\n", "a 2", True), ("Ode1", "Ode2", False)]
    df = spark.createDataFrame(pairs, "a string, b string, alike boolean")
    wrong = df.where((W.title_key(F.col("a")) == W.title_key(F.col("b"))) != F.col("alike")).collect()
    assert wrong == []


def test_runs_go_on_over_blocks(spark):
    rng = random.Random(3)
    rows = [(f, o, rng.choice(["a", "b", None]) if rng.random() < 0.3 else "a") for f in ("x", "y", None) for o in sorted(rng.sample(range(-50, 400), 150))]
    got = {(r["f"], r["o"]): r["run"] for r in W.runs(spark.createDataFrame(rows, "f string, o long, k string"), "f", "o", F.col("k"), block=7).collect()}
    want, last = {}, None
    for f, o, k in rows:
        if last is None or last[:2] != (f, k):
            last = (f, k, o)
        want[f, o] = last[2]
    assert got == want


def test_shapes_ids_and_pages(spark):
    rows = [
        ("c", 0, "Cal", "Eclogues", "poems", "", "1", ["a", "b"]), ("c", 1, "Cal", "Eclogues", "poems", "", "2", ["c", "d"]),
        ("h", 0, "Hor", "Odes", "Odes 1", "", "1", ["e"]), ("h", 1, "Hor", "Odes", "Odes 1", "", "2", ["f"]),
        ("o", 0, "Ov", "Metamorphoses", "Metamorphoses 1", "", "", ["g", "h"]), ("o", 1, "Ov", "Metamorphoses", "Metamorphoses 2", "", "", ["i", "j"]),
        ("o", 2, "Ov", "Ibis", "poems", "Ibis", "9", ["k"]),
    ]
    works = W.recombined(_poems(spark, rows), block=1)
    lines = {}
    for r in sorted(W.work_lines(works, block=1).collect(), key=lambda r: (r["file"], r["work"], r["row"])):
        lines.setdefault((r["file"], r["work"]), []).append((r["row"], "/".join(r["id"]), r["text"]))
    assert lines == {
        ("c", 0): [(0, "1/1", "a"), (1, "1/2", "b"), (2, "2/1", "c"), (3, "2/2", "d")],
        ("h", 0): [(0, "1/1/1", "e"), (1, "1/2/1", "f")],
        ("o", 0): [(0, "1/1", "g"), (1, "1/2", "h"), (2, "2/1", "i"), (3, "2/2", "j")],
        ("o", 2): [(0, "1/1", "k")],
    }
    pages = sorted((r["file"], r["work"], "/".join(r["id"]), r["first"], r["behind"]) for r in W.work_pages(works).collect())
    assert pages[:4] == [("c", 0, "1", 0, 2), ("c", 0, "2", 2, 4), ("h", 0, "1/1", 0, 1), ("h", 0, "1/2", 1, 2)]
    told = {(r["file"], r["work"]): (r["title"], r["author"], r["parts"], r["poems"]) for r in W.catalogue(works, {"Ov": "P. Ovidius Naso"}).collect()}
    assert told["o", 0] == ("Metamorphoses", "P. Ovidius Naso", ["book", "line"], 2) and told["h", 0] == ("Odes", "Hor", ["book", "poem", "line"], 2)
    assert told["c", 0][2] == ["poem", "line"] and told["o", 2][2] == ["poem", "line"]
    assert W.faults(works).count() == 0


def test_faults_nulls_and_empty_tables(spark):
    rows = [
        ("a", 0, "x", "Odes 1", "Odes 1 1", "", "1", ["s"]), ("a", 1, "x", "Odes 2", "Odes 2 2", "", "1", ["t"]),
        ("b", 0, "x", "Odes", "Epodes 1", "", "1", ["s"]), ("b", 1, "x", "Odes", "Odes x", "", "1", ["t"]), ("b", 2, "x", "Odes", "Odes 3", "", " ", ["t"]), ("b", 3, "x", "Odes", "Odes 3", "", "2", ["t"]),
        (None, 0, None, None, None, None, None, []), (None, 1, None, None, None, None, None, ["u"]),
    ]
    works = W.recombined(_poems(spark, rows))
    got = {(r["file"], r["ord"]): r["fault"] for r in W.faults(works).collect()}
    assert got.pop((None, 0)) and got.pop((None, 1))  # two poems without a title are a work that fits no shape
    assert got == {("a", 1): "title is not the work's", ("b", 0): "not called like the work", ("b", 1): "no number of a book", ("b", 2): "no number of a poem"}
    empty = W.recombined(_poems(spark, []))
    assert W.work_lines(empty).count() == W.catalogue(empty).count() == W.work_pages(empty).count() == 0
