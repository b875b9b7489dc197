"""Brackets, commands as nodes and trees told by levels, against plain Python."""

import random

import pytest

from glyphspan.operators import brackets as B
from glyphspan.operators import markup as M
from glyphspan.plans import registry


def _plain_pairs(text):
    open_, out = [], []
    for i, c in enumerate(text):
        if c == "{":
            open_.append(i)
        elif c == "}" and open_:
            start = open_.pop()
            out.append((start, i, len(open_) + 1))
    return sorted([*out, *((start, None, k + 1) for k, start in enumerate(open_))])


def test_pairs_of_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("{{}}ab\n") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, "{" * 500 + "}" * 501, "}}{", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in B.bracket_pairs(df, "id", "text").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["depth"]))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == _plain_pairs(text or ""), text
    assert B.bracket_pairs(df.limit(0), "id", "text").count() == 0


def _tree(spark, text, **how):
    """A text's nodes as nested (name, unit, children) and texts."""
    df = spark.createDataFrame([(7, text)], "id long, text string")
    rows = sorted(B.command_nodes(df, "id", "text", **how).collect(), key=lambda r: r["node"])
    assert [r["node"] for r in rows] == list(range(len(rows)))
    below = {}
    for r in rows:
        made = r["text"] if r["name"] is None else (r["name"], r["attrs"].get("unit"), below.setdefault(r["node"], []))
        siblings = below.setdefault(r["parent"], [])
        assert r["ord"] == len(siblings)
        siblings.append(made)
        inside = [x["node"] for x in rows if x["node"] > r["node"] and x["depth"] > r["depth"] and all(y["depth"] > r["depth"] for y in rows if r["node"] < y["node"] <= x["node"])]
        assert r["last"] == max([r["node"], *inside])
    return below.get(None, [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("plain text", ["plain text"]),
        ("plain <! gone -->text", ["plain text"]),
        (r"\kern-0.2emwhatever", [("kern", "0.2em", []), "whatever"]),
        (r"\kern0.2em~whateve$r$", [("kern", "0.2em", []), " whatever"]),
        (r"\lat{hello \aut{content} hi}", [("lat", None, ["hello ", ("aut", None, ["content"]), " hi"])]),
        (r"\lat{a}\aut{b}", [("lat", None, ["a"]), ("aut", None, ["b"])]),
        (r"x \F \lat{t} y", ["x ", ("F", None, []), " ", ("lat", None, ["t"]), " y"]),
        (r"\lat{a}{b}", [("lat", None, ["a"]), ("nameless", None, ["b"])]),
        (r"a{{}}b{\comm{x \lat{y}}}c\comm{{z}}", ["a", "b", "c"]),
        (r"\lat{}{\par}", [("lat", None, []), ("nameless", None, [("par", None, [])])]),
        ("a}b}{c}", ["a}b}", ("nameless", None, ["c"])]),
        ("{ÿ}\\", [("nameless", None, ["ў"]), "\\"]),
        ("", []),
        (None, []),
    ],
)
def test_commands(spark, text, want):
    assert _tree(spark, text) == want


@pytest.mark.parametrize("text", [r"\lat{content", r"\nothing{x}", r"\kern x"])
def test_faults_of_commands(spark, text):
    with pytest.raises(Exception, match="document 7: (opening without closing|unknown command)"):
        _tree(spark, text)
    assert _tree(spark, text, strict=False) == []


def test_parents_by_levels_of_any_block(spark):
    rng = random.Random(5)
    rows = [(k, 3 * i, rng.randrange(5)) for k in "ab" for i in range(300)] + [("c", 0, 4)]
    df = spark.createDataFrame(rows, "key string, at long, level int")
    want = {}
    for key in "abc":
        open_ = []
        for _, at, level in (r for r in rows if r[0] == key):
            open_ = [x for x in open_ if x[1] < level]
            want[key, at] = [x[0] for x in open_]
            open_.append((at, level))
    for block in (1, 7, 4096):
        got = {(r["key"], r["at"]): (r["line"], r["parent"]) for r in B.nearest_smaller(df, "key", "at", "level", 5, block).collect()}
        assert got == {k: (v, v[-1] if v else None) for k, v in want.items()}
    assert B.nearest_smaller(df.limit(0), "key", "at", "level", 5).count() == 0
    with pytest.raises(Exception, match="no level"):
        B.nearest_smaller(df, "key", "at", "level", 4).collect()


def test_senses(spark):
    texts = [
        (1, r"\entree{A} \gen{f.} \Rub{I} one \aut{Cic.} \pp{1} \qq{a)} x\qq{b)}y \pp{2} \Rub{II} two"),
        (2, "no senses"),
        (3, r"\pp{I}\Rub{1}"),
        (4, r"\lat{\pp{1}} \rub{ }"),
        (5, None),
    ]
    tree = B.command_nodes(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    rows = {}
    for r in sorted(B.sense_tree(tree).collect(), key=lambda r: (r["doc_id"], r["sense"])):
        rows.setdefault(r["doc_id"], []).append((tuple(r["path"]), r["level"], r["text"].strip()))
    assert rows[1] == [((B.BLURB,), -2, "A f."), (("I",), 0, "one Cic."), (("I", "1"), 2, ""), (("I", "1", "a)"), 3, "x"), (("I", "1", "b)"), 3, "y"), (("I", "2"), 2, ""), (("II",), 0, "two")]
    assert rows[2] == [((B.BLURB,), -2, "no senses")] and rows[3] == [((B.BLURB,), -2, ""), (("I",), 2, ""), (("1",), 0, "")]
    assert 5 not in rows
    faults = {(r["doc_id"], r["fault"]) for r in B.sense_faults(tree).collect()}
    assert faults == {(3, "siblings of another level"), (4, "inside another node"), (4, "no label")}
    assert M.text_of(tree, tree.where("name = 'lat'")).first()["text"] == "1"


def test_page_brackets_against_a_stack(spark, sf):
    """All brackets of all pages as a stack pairs them."""
    import re

    import pandas as pd

    pages, want = pd.read_parquet(f"{sf}/pages.parquet"), []
    for page_id, html in zip(pages["page_id"], pages["html"], strict=True):
        open_ = []
        for m in re.finditer(r"<(/?)(?:nav|ul|li|a|article|div|p|b)(?:\s[^>]*)?>", html or ""):
            if m[1] and open_:
                start = open_.pop()
                want.append((page_id, start, m.start(), len(open_) + 1))
            elif not m[1]:
                open_.append(m.start())
        want += [(page_id, start, None, k + 1) for k, start in enumerate(open_)]
    got = [tuple(r) for r in registry.QUERIES["page_brackets"](spark, sf).select("page_id", "start", "stop", "depth").collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 100
