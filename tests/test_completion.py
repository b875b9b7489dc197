"""Half-typed queries: tokens, what may come next, faults, and suggestions that always lead to a query."""

import random

import pytest

from glyphspan.plans import completion as P
from glyphspan.plans.language import QueryError, parse, with_author_mark
from glyphspan.sources import corpus as C
from glyphspan.sources import sinks


def test_tokens_have_places():
    assert [(t.text, t.start, t.kind) for t in P.tokens(" a (@case:x  and)#b 5~>")] == [
        (" ", 0, "space"), ("a", 1, "word"), (" ", 2, "space"), ("(", 3, "("), ("@case:x", 4, "word"), ("  ", 11, "space"), ("and", 13, "and"), (")", 16, ")"), ("#b", 17, "author"), (" ", 19, "space"), ("5~>", 20, "near")
    ]
    assert P.tokens("") == []


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("", ["author", "(", "word"]), ("#a", ["(", "word"]), ("a", ["word", "and", "or", "near", "("]), ("a ~", ["(", "word"]), ("(", ["word"]), ("(a", ["and", "or", ")"]), ("(a and b", ["and", ")"]),
        ("(a or b)", ["word", "near", "("]), ("a and", ["word"]), ("a and b", ["and", "near", "word", "("]), ("(a and b) ~ (c or d", ["or", ")"]), ("a and b ~ (c or d", ["or", ")"]),
    ],
)
def test_what_comes_next(text, kinds):
    assert P.walk(P.tokens(text))[0] == kinds


@pytest.mark.parametrize("text", ["a #b", "#a #b", "(a and b or c", "~", "a ~ ~", "and", "()", "(a (b", "a )", "(a b"])
def test_what_may_not_come(text):
    with pytest.raises(QueryError):
        P.walk(P.tokens(text))


def test_terms():
    assert [[t.text for t in term] for term in P.walk(P.tokens("#x a b ~ (c and d) e"))[1]] == [["#x"], ["a"], ["b"], ["~"], ["(", "c", "and", "d", ")"], ["e"]]


@pytest.mark.parametrize("text", ["@cas:x a ", "case:x ", "@case: ", "@case:x ", "16~ a ", "a 16~ ", "a 5~>> ", "@nothing", "@case:q", "@foo:"])
def test_faults(text):
    with pytest.raises(QueryError):
        P.options(text)


def test_every_way_leads_to_a_query():
    """Walks that take suggestions at random, then close what is open, give texts that the engine reads."""
    rng, seen = random.Random(5), set()
    for _ in range(400):
        text = ""
        for _ in range(rng.randrange(1, 9)):
            o = rng.choice(P.options(text))
            seen.add(o.kind)
            text = o.becomes + {"author": "src_1 ", "lemma": "do ", "word": "arma "}.get(o.kind, "") if o.lookup or o.kind in ("word", "author") else o.becomes
            if text.endswith("@"):
                text = text + rng.choice(["case:dat ", "lemma:do ", ""])
            elif text.endswith(":"):
                text = text + ("do " if text.endswith("@lemma:") else "")
        for _ in range(4):
            kinds = {o.kind: o for o in P.options(text)}
            if text.endswith((":", "@")):
                text = next(iter(kinds.values())).becomes
            elif ")" in kinds:
                text = kinds[")"].becomes
            elif not P.tokens(text) or P.tokens(text.rstrip())[-1].kind in ("and", "or", "near", "(", "author"):
                text += "arma "
        parse(with_author_mark(text.strip()))
    assert {"author", "feature", "word", "near", "and", "or", ")", "value"} <= seen


def test_values_from_the_lists(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Caesar B", "arma virumque cano Arma"), (2, "Cato", "arx"), (3, None, "")], "doc_id long, source string, text string")
    analyses = spark.createDataFrame([("arma", "arma", 1), ("arx", "arx", 1), ("cano", "Cano", 1)], "word string, lemma string, mask int")
    sinks.put_lists(C.build(docs, str(tmp_path / "c"), analyses), str(tmp_path / "l"))
    lists = spark.read.parquet(str(tmp_path / "l"))
    of = lambda text, **how: sorted((r["kind"], r["becomes"]) for r in P.completions(lists, text, **how).collect())
    assert of("#ca") == [("author", "#Caesar_B "), ("author", "#Cato ")] and of("#Caesar_b") == [("author", "#Caesar_B ")] and of("#x") == []
    assert of("cano @lemma:aR") == [("lemma", "cano @lemma:arma "), ("lemma", "cano @lemma:arx ")] and of("@l:C") == [("lemma", "@l:Cano ")]
    assert of("AR") == [("word", "arma "), ("word", "arx ")] and of("ar", most=1) == [("word", "arma ")]
    assert of("@vo") == [("feature", "@voice:"), ("value", "@case:vocative ")] and of("a #b")[0][0] == "fault"
    assert of("arma ") == sorted([("word", "arma "), ("feature", "arma @"), ("near", "arma ~ "), ("and", "(arma and "), ("or", "(arma or ")])
    assert "StartsWith" in P.completions(lists, "#ca")._jdf.queryExecution().executedPlan().toString()
