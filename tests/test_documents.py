"""Markup, language and evaluation operators on small tables, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphspan.functions.inflection import mask_of
from glyphspan.operators import evaluate as E
from glyphspan.operators import language as N
from glyphspan.operators import markup as M
from glyphspan.operators import search as S


def _table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_nodes_and_navigation(spark):
    docs = _table(spark, "doc_id long, xml string", (1, '<a x="1"><b>one <i>two</i></b>three<b/></a>'), (2, "<a>"), (3, None))
    with pytest.raises(Exception, match="document 2"):
        M.nodes(docs, "doc_id", "xml").collect()
    tree = M.nodes(docs, "doc_id", "xml", strict=False).cache()
    got = [(r["node"], r["last"], r["parent"], r["depth"], r["ord"], r["name"], r["text"]) for r in tree.orderBy("node").collect()]
    assert got == [(0, 6, None, 0, 0, "a", None), (1, 4, 0, 1, 0, "b", None), (2, 2, 1, 2, 0, None, "one "), (3, 4, 1, 2, 1, "i", None), (4, 4, 3, 3, 0, None, "two"), (5, 5, 0, 1, 1, None, "three"), (6, 6, 0, 1, 2, "b", None)]
    top = tree.where("parent IS NULL")
    assert [r["node"] for r in M.children(tree, top, "b").orderBy("node").collect()] == [1, 6]
    assert [r["node"] for r in M.descendants(tree, top, "i").collect()] == [3]
    assert {r["node"]: r["text"] for r in M.text_of(tree, tree.where("name = 'b' OR name = 'a'")).collect()} == {0: "one twothree", 1: "one two"}
    assert {r["name"]: (r["children"], r["attrs"]) for r in M.child_profile(tree).collect()} == {"a": (["b"], ["x"]), "b": (["i"], []), "i": ([], [])}


def test_html_text(spark):
    page = "<html><head><title>no</title></head><body>A &amp; B<p>one<br>two &#228;&nbsp;x</p><script>no()</script><div>three<span> four</span></div>end</body></html>"
    got = [r[0] for r in _table(spark, "html string", (page,), (None,), ("<p>open",)).select(M.html_text("html")).collect()]
    assert got == ["A & B\none\ntwo ä x\n\nthree four\nend", None, "\nopen\n"]


def test_sections_pages_and_navigation(spark):
    xml = '<body><div><l n="1">a</l><l n="2">b<i>c</i></l></div><p><m n="3"/>d<m n="4"/>e</p></body>'
    tree = M.nodes(_table(spark, "doc_id long, xml string", (1, xml)), "doc_id", "xml")
    marks = tree.where("attrs['n'] IS NOT NULL").select("doc_id", "node", F.col("attrs")["n"].alias("section"))
    got = sorted((r["section"], r["node"]) for r in M.sections(tree, marks).collect())
    texts = {r["node"]: r["text"] or r["name"] for r in tree.collect()}
    assert [(s, texts[n]) for s, n in got] == [("1", "l"), ("2", "l"), ("3", "m"), ("3", "d"), ("4", "m"), ("4", "e")]
    rows = _table(spark, "doc_id long, row int, id array<string>", *[(1, i, x.split(".")) for i, x in enumerate(["1.1", "1.2", "2.1", "2.2", "2.3", "3.1"])])
    pages = M.pages(rows, 2)
    assert sorted((r["page"][0], r["first"], r["last"]) for r in pages.collect()) == [("1", 0, 1), ("2", 2, 4), ("3", 5, 5)]
    deep = M.pages(_table(spark, "doc_id long, row int, id array<string>", (1, 0, ["1", "1", "1"]), (1, 1, ["1", "2", "1"]), (1, 2, ["1"])), 3)
    assert sorted((r["id"], r["parent"]) for r in M.nav_tree(deep).collect()) == [(["1"], []), (["1", "1"], ["1"]), (["1", "2"], ["1"])]


def test_lines_merge_over_dashes(spark):
    lines = [("1", "arma vi-"), ("1", "rumque"), ("1", "cano tro-"), ("2", "iae. qui primus"), ("2", ""), ("2", "ab"), ("3", "end")]
    got = M.merged_lines(_table(spark, "doc_id long, row int, section string, text string", *[(1, i, s, t) for i, (s, t) in enumerate(lines)]))
    assert [(r["section"], r["text"]) for r in got.orderBy("ord").collect()] == [("1", "arma virumque cano troiae."), ("2", "qui primus ab"), ("3", "end")]


def test_longest_abbreviations(spark):
    table = {"Cic.": "Cicero", "Cic. Att.": "Cicero to Atticus", "A.": "Aulus"}
    df = _table(spark, "t string", ("Cic. Att. 1, xCic. (Cic. A.)",), (None,))
    got = [[tuple(x) for x in r["expansions"]] for r in M.abbreviations(df, "t", table).collect()]
    assert got == [[(0, 9, "Cicero to Atticus"), (20, 4, "Cicero"), (25, 2, "Aulus")], []]
    assert [x[2] for x in M.abbreviations(df, "t", table, ignore_case=True).first()["expansions"]] == [x[2] for x in got[0]]


def test_char_tokens_sentences_gaps(spark):
    text = "Ab3 cd, e. F\n!"
    tokens = N.char_tokens(_table(spark, "k long, text string", (1, text), (2, None), (3, "")), ["k"])
    got = [(r["text"], r["start"], r["stop"], r["kind"]) for r in tokens.orderBy("i").collect()]
    assert "".join(x[0] for x in got) == text and all(text[a:b] == t for t, a, b, _ in got)
    assert [t for t, _, _, k in got if k == "word"] == ["Ab3", "cd", "e", "F"] and [k for t, _, _, k in got if t == "\n"] == ["other"]
    assert [r["words"] for r in N.sentences(tokens, ["k"]).orderBy("sentence").collect()] == [["Ab3", "cd", ",", "e", "."], ["F", "!"]]
    texts = _table(spark, "k long, text string", (1, "ab cd ef"), (2, "x"))
    spans = _table(spark, "k long, start int, stop int", (1, 0, 2), (1, 3, 5))
    assert [tuple(r) for r in N.with_gaps(spans, texts, "k").orderBy("k", "start").collect()] == [(1, 0, 2, "ab", True), (1, 2, 3, " ", False), (1, 3, 5, "cd", True), (1, 5, 8, " ef", False), (2, 0, 1, "x", False)]


def test_suggested_forms(spark):
    sg, pl = mask_of("case:abl", "number:sg"), mask_of("case:nom", "number:sg")
    forms = _table(spark, "word string, form string, lemma string, mask int", ("porta", "portā", "porta", sg), ("porta", "porta", "porta", pl), ("mala", "māla", "malum#2", pl), ("mala", "mala", "malus", pl))
    tokens = _table(spark, "token long, word string, lemma string, mask int", (1, "porta", "porta", sg), (2, "portā", "x", 0), (3, "mala", "malum", mask_of("case:nom")), (4, "mala", "other", pl), (5, "măla", "malum", pl))
    got = {r["token"]: (r["options"], r["suggested"]) for r in N.suggested_forms(tokens, forms).collect()}
    assert got == {1: (["porta", "portā"], "portā"), 2: (["portā"], None), 3: (["mala", "māla"], "māla"), 4: (["mala", "māla"], "mala"), 5: (["mala"], None)}


def test_evaluation(spark):
    gold = _table(spark, "s long, words array<string>", (1, "a b c d e f g".split()), (2, ["x"]))
    own = _table(spark, "s long, processor string, words array<string>", (1, "p", "a b c d E f G".split()), (2, "p", ["x"]), (2, "q", ["y"]))
    got = sorted(tuple(r) for r in E.errors_in_context(gold, own, "s").collect())
    assert got == [(1, 4, "e", "p", "E", "a b c d *e* f g"), (1, 6, "g", "p", "G", "c d e f *g*"), (2, 0, "x", "q", "y", "*x*")]
    compared = _table(spark, "doc string, correct long, incorrect long, total long", ("a", 3, 1, 4), ("b", 1, 1, 2))
    assert {r["doc"]: r["accuracy"] for r in E.accuracy(compared, "doc").collect()} == {"a": 0.75, "b": 0.5, None: 4 / 6}
    rng = random.Random(7)
    rows = [("m", i % 2 == 1, rng.gauss(10 + (i % 2), 2)) for i in range(40)] + [("few", False, 1.0)]
    r = E.t_test(_table(spark, "m string, b boolean, v double", *rows), "m", "b", "v").where("m = 'm'").first()
    a, b = ([v for m, g, v in rows if m == "m" and g == x] for x in (False, True))
    mean = lambda x: sum(x) / len(x)
    pooled = (sum((v - mean(a)) ** 2 for v in a) + sum((v - mean(b)) ** 2 for v in b)) / 38
    assert math.isclose(r["t"], (mean(b) - mean(a)) / math.sqrt(pooled * 2 / 20), rel_tol=1e-9)
    # the share of Student's distribution beyond t, by summing its density
    density = lambda x: math.gamma(19.5) / (math.sqrt(38 * math.pi) * math.gamma(19)) * (1 + x * x / 38) ** -19.5
    steps = 200_000
    inside = sum(density(abs(r["t"]) * (i + 0.5) / steps) for i in range(steps)) * abs(r["t"]) / steps
    assert math.isclose(r["p_value"], 1 - 2 * inside, abs_tol=1e-7)
    dup = _table(spark, "k string, v long", ("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 1))
    assert sorted(tuple(r) for r in E.duplicates(dup, "k").collect()) == [("a", 2, True), ("b", 2, False)]
    lines = lambda *x: _table(spark, "k long, line int, text string", *[(1, i, t) for i, t in enumerate(x)])
    assert sorted(tuple(r) for r in E.line_differences(lines("a", "b", "c"), lines("a", "x"), "k").collect()) == [(1, 1, "b", "x"), (1, 2, "c", None)]
    assert S.estimate(50, 100, 1000) == 500


def test_titles_as_they_are_written(spark, tmp_path):
    """As the query's SQL has it: ampersands alone are resolved, a cut entity stays, an empty title has a row."""
    from glyphspan.plans import registry

    pages = [(1, "u", "<title> A &amp; B &quot;c&quot; &amp</title><p>x"), (2, "u", "<title></title>"), (3, "u", "<p>none"), (4, "u", None)]
    _table(spark, "page_id long, url string, html string", *pages).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["title"] for r in registry.QUERIES["page_titles"](spark, str(tmp_path)).collect()}
    assert got == {1: "A & B &quot;c&quot; &amp", 2: ""}


def test_documents_of_one_group_of_rows_are_dealt(spark):
    """Files may hold all documents in one group of rows, which one task reads: parsing is dealt out anew."""
    docs = spark.range(3 * M.DOCUMENTS_A_TASK).coalesce(1).selectExpr("id", "'<a>x</a>' AS x")
    dealt = M.dealt(docs, "id")
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 2 * M.DOCUMENTS_A_TASK
    assert M.nodes(dealt, "id", "x").count() == 6 * M.DOCUMENTS_A_TASK
