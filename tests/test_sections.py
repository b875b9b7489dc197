"""Reference patterns, sections and rows of documents, ancestors, against plain Python over trees."""

import random

import pytest

from glyphspan.operators import markup as M
from glyphspan.operators import sections as S
from glyphspan.plans import registry

PATH = "#xpath(/tei:TEI/tei:text//tei:div[@n='$1']/tei:l[@n='$2'])"


def _tree(spark, *texts):
    return M.nodes(spark.createDataFrame(list(enumerate(texts)), "id long, x string"), "id", "x").cache()


def test_patterns_are_read():
    assert S.compile_pattern(PATH) == (S.Step("TEI"), S.Step("text"), S.Step("div", "n", 1, True), S.Step("l", "n", 2))
    assert S.compile_pattern("#xpath(/tei:a[@type='book'])") == (S.Step("a"),)
    assert S.parts_of(r"(\w+).(\w+)") == 2
    for bad in ("/tei:a", "#xpath(/a)", "#xpath(/tei:a[@n='$x'])", "#xpath()", "#xpath(/tei:a[n='1'])", "#xpath(tei:a)"):
        with pytest.raises(S.PatternError):
            S.compile_pattern(bad)


def _plain_id(chain, steps):
    """The parts of a chain of nodes by a walk along both, or None."""
    if not chain or not steps:
        return [] if not chain and not steps else None
    node, step = chain[0], steps[0]
    fits = node["name"] == step.name and (step.key is None or step.key in node["attrs"])
    if not fits and not step.deeper:
        return None
    rest = _plain_id(chain[1:], steps[1:] if fits else steps)
    return None if rest is None else ([(step.part, node["attrs"][step.key])] if fits and step.key else []) + rest


def _chains(rows):
    by = {(r["doc_id"], r["node"]): r for r in rows}
    for r in rows:
        chain, at = [], r
        while at is not None:
            chain.insert(0, at)
            at = by.get((at["doc_id"], at["parent"]))
        yield r, chain


def _random_xml(rng, depth=0):
    if depth > 6 or rng.random() < 0.2:
        return rng.choice(["word ", " ", "x"])
    name = rng.choice("abc")
    n = f' n="{rng.randrange(3)}"' if rng.random() < 0.7 else ""
    return f"<{name}{n}>" + "".join(_random_xml(rng, depth + 1) for _ in range(rng.randrange(4))) + f"</{name}>"


PATTERNS = ["/tei:r/tei:a[@n='$1']", "/tei:r//tei:a[@n='$1']//tei:b[@n='$2']", "//tei:b[@n='$1']/tei:c", "/tei:r//tei:a/tei:b[@n='$2']//tei:c[@n='$1']", "//tei:a//tei:a//tei:a[@n='$1']", "/tei:b"]


def test_patterns_over_random_trees(spark):
    rng = random.Random(8)
    tree = _tree(spark, *(f"<r>{''.join(_random_xml(rng) for _ in range(4))}</r>" for _ in range(60)))
    chains = list(_chains(tree.collect()))
    some = 0
    for pattern in (f"#xpath({p})" for p in PATTERNS):
        steps = S.compile_pattern(pattern)
        want = {(r["doc_id"], r["node"]): [v for _, v in sorted(x)] for r, chain in chains if r["name"] and (x := _plain_id(chain, steps)) is not None}
        got = {(r["doc_id"], r["node"]): r["section"] for r in S.numbered(tree, [pattern]).collect()}
        assert got == want
        some += len(want)
    assert some > 100
    above = {(r["doc_id"], r["node"]): [tuple(x) for x in r["above"]] for r in M.ancestors(tree, tree).collect()}
    assert above == {(r["doc_id"], r["node"]): [(x["node"], x["name"]) for x in chain[:-1]] for r, chain in chains}
    inside = {(r["doc_id"], r["ancestor"], r["node"]) for r in M.descendants(tree, tree.where("name = 'a'")).collect()}
    assert inside == {(r["doc_id"], x["node"], r["node"]) for r, chain in chains for x in chain[:-1] if x["name"] == "a"}


def test_rows_over_random_trees(spark):
    rng = random.Random(9)
    tree = _tree(spark, *(f"<r>{''.join(_random_xml(rng) for _ in range(4))}</r>" for _ in range(40)))
    marks = S.numbered(tree, ["#xpath(/tei:r/tei:a[@n='$1'])", "#xpath(/tei:r/tei:a[@n='$1']//tei:b[@n='$2'])"])
    marked = {(r["doc_id"], r["node"]): r["section"] for r in marks.collect()}
    rows = tree.collect()
    sid = {(r["doc_id"], r["node"]): next((marked[(x["doc_id"], x["node"])] for x in reversed(chain) if (x["doc_id"], x["node"]) in marked), []) for r, chain in _chains(rows)}
    children = {}
    for r in rows:
        children.setdefault((r["doc_id"], r["parent"]), []).append(r)

    def numbers(r):
        return {tuple(sid[(r["doc_id"], r["node"])])}.union(*(numbers(c) for c in children.get((r["doc_id"], r["node"]), [])))

    def walk(r):
        if r["name"] is None:
            return [(r["doc_id"], r["node"], sid[(r["doc_id"], r["node"])])] if r["text"].strip() else []
        if len(numbers(r)) == 1:
            return [(r["doc_id"], r["node"], sid[(r["doc_id"], r["node"])])]
        return [x for c in children.get((r["doc_id"], r["node"]), []) for x in walk(c)]

    want = sorted(x for r in rows if r["parent"] is None for x in walk(r))
    got = sorted((r["doc_id"], r["node"], r["section"]) for r in S.section_rows(tree, marks).collect())
    assert got == want and len(want) > 60


def test_declared_patterns_and_errors(spark):
    header = "<teiHeader><encodingDesc><refsDecl n='CTS'><cRefPattern n='line' matchPattern='(\\w+).(\\w+)' replacementPattern=\"{}\"/></refsDecl></encodingDesc></teiHeader>"
    texts = [f"<TEI>{header.format(p)}<text><div n='1'><l n='1'>a</l><l n='2'>b</l></div><lg n='7'><l n='x'/></lg></text></TEI>" for p in (PATH, PATH.replace("//tei:div", "/tei:lg"))]
    tree = _tree(spark, *texts, "<TEI><text/></TEI>")
    assert sorted(map(tuple, S.declared_patterns(tree).collect())) == [(0, "line", PATH, 2), (1, "line", PATH.replace("//tei:div", "/tei:lg"), 2)]
    assert sorted((r["doc_id"], r["section"]) for r in S.numbered_as_declared(tree).collect()) == [(0, ["1", "1"]), (0, ["1", "2"]), (1, ["7", "x"])]
    assert S.numbered_as_declared(tree.where("doc_id = 2")).collect() == []
    with pytest.raises(Exception, match="two patterns"):
        S.numbered(tree, ["#xpath(//tei:l[@n='$1'])", "#xpath(//tei:lg/tei:l[@n='$1'])"]).collect()


def test_pages_against_plain_python(spark, sf):
    rows = M.nodes(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html", kind="html").collect()
    steps = S.compile_pattern(registry.LINKS)
    want = sorted((r["doc_id"], r["node"], "/".join(v for _, v in sorted(x))) for r, chain in _chains(rows) if r["name"] and (x := _plain_id(chain, steps)) is not None)
    got = sorted((r["page_id"], r["node"], r["section"]) for r in registry.QUERIES["page_links"](spark, sf).collect())
    assert got == want and len(want) > 100
