"""The query language: what it reads, what it refuses, and results against a matcher that looks at every token."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphspan.functions import text as T
from glyphspan.plans import language as Q
from glyphspan.plans import search as S
from glyphspan.sources import corpus as C


def test_reading():
    q = Q.parse("[A. B., C] @lemma:do#2 oscula 7~> (@case:dat and @n=pl) ~ !(a or @w:b)")
    assert q.authors == ("A. B.", "C")
    assert [t.relation for t in q.terms] == [Q.Relation(), Q.Relation(), Q.Relation(7, True), Q.Relation(5)]
    assert q.terms[0].constraint == Q.Lemma("do#2") and isinstance(q.terms[3].constraint, Q.Not)
    assert [len(t) for _, t in q.spans()] == [2, 1, 1]
    assert Q.parse("((a))").terms[0].constraint == Q.Word("a")
    assert Q.parse("a 999~ b").terms[1].relation.distance == 5 and Q.parse("a +7~ b").terms[1].relation.distance == 7
    assert Q.with_author_mark("#Julius_Caesar of the") == "[Julius Caesar] of the" and Q.with_author_mark("of") == "of"


@pytest.mark.parametrize("text", ["", "(a", "a)", "(a and b or c)", "[ ] a", "[A a", "a ~", "@case:none", "@lemma:", "@lemma:a1", "@word:1", "a1b", "()", "a - b", "a 0~ b", "1 a"])
def test_refusing(text):
    with pytest.raises(Q.QueryError):
        Q.parse(text)


@pytest.mark.parametrize("text", ["!a", "((a or b) and c)", "[A, B] a", "a 16~ b", " ~ ".join("abcdefghijk")])
def test_unsupported(text):
    with pytest.raises(Q.QueryError):
        Q.check(Q.parse(text))


def test_contradictions():
    impossible = ["@l:a and @l:b", "@case:nom and @tense:pres", "@case:nom and @case:acc", "@mood:subj and @tense:fut", "@mood:sup and @case:acc", "@mood:sup and @gender:m", "@mood:part and @person:1", "@mood:inf and @number:pl", "@mood:imp and @tense:perf", "@gender:m and @mood:ind"]
    possible = ["@case:nom and @case:nom", "@mood:part and @case:dat", "@mood:sup and @case:dat", "@mood:imp and @tense:fut", "@l:a and @case:nom", "a and b", "@mood:inf and @tense:pres", "@degree:comp and @case:nom"]
    assert all(Q.impossible(Q.parse(f"({x})").terms[0].constraint) for x in impossible)
    assert not any(Q.impossible(Q.parse(f"({x})").terms[0].constraint) for x in possible)
    assert not Q.impossible(Q.parse("(@case:nom or @case:acc)").terms[0].constraint)


def test_cursors():
    assert Q.Cursor.read(str(Q.Cursor(50, 7, 3))) == Q.Cursor(50, 7, 3)
    assert Q.Cursor.read("x") is None and Q.Cursor.read(None) is None


MEANINGS = {"a": [("la", 1)], "b": [("lb", 2), ("la", 3)], "c": [("lc", 1 | 1 << 7)], "d": [], "e": [("la", 1 << 7), ("lb", 1)]}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(9)
    docs = [(i, "AB"[i % 2], " ".join(rng.choice("aabbcde") + rng.choice(["", "", "", "."]) for _ in range(40))) for i in range(12)]
    table = spark.createDataFrame([*docs, (99, "A", None), (98, "B", "")], "doc_id long, source string, text string")
    analyses = spark.createDataFrame([(w, lemma, m) for w, some in MEANINGS.items() for lemma, m in some], "word string, lemma string, mask int")
    corpus = C.build(table, f"file://{tmp_path_factory.mktemp('corpus')}", analyses)
    return corpus, {i: (s, [(w.strip("."), w.endswith(".") or k == 39) for k, w in enumerate(t.split(" "))]) for i, s, t in docs}


def _meets(c, word, strict):
    some = MEANINGS[word]
    if isinstance(c, Q.Word):
        return word == c.value.lower()
    parts = c.parts if isinstance(c, (Q.All, Q.Any)) else (c,)
    plain = [p for p in parts if not isinstance(p, Q.Word)]
    if any(isinstance(p, Q.Inflection) and p.feature.category == "degree" for p in plain):
        return False  # degrees are not recorded
    words = [word == p.value.lower() for p in parts if isinstance(p, Q.Word)]
    masks = [p.feature.bit for p in plain if isinstance(p, Q.Inflection)]
    lemmata = {p.value for p in plain if isinstance(p, Q.Lemma)}
    wanted, named = sum(set(masks)), 0
    for p in plain:
        named |= S.category_mask(p.feature.category) if isinstance(p, Q.Inflection) else 0

    def one(lemma, mask):
        if isinstance(c, Q.Any):
            return bool(mask & wanted and not (strict and mask & named & ~wanted)) or lemma in lemmata
        return (mask & (named if strict else wanted)) == wanted and (not lemmata or lemmata == {lemma})

    if plain:
        words.append(bool(some) and (all if strict else any)(one(*a) for a in some))
    return any(words) if isinstance(c, Q.Any) else all(words)


def _naive(docs, text, strict):
    query, out = Q.parse(text), []
    spans = query.spans()
    for doc_id, (source, words) in docs.items():
        if query.authors and source not in query.authors:
            continue
        starts = [
            [p for p in range(len(words) - len(terms) + 1) if all(_meets(c, words[p + i][0], strict) for i, c in enumerate(terms)) and not any(words[p + i][1] for i in range(len(terms) - 1))]
            for _, terms in spans
        ]
        last = None
        for anchor in starts[0]:
            for path in itertools.product([anchor], *starts[1:]):
                near = all((q - p if r.directed else abs(q - p)) in range(r.distance + 1) for (r, _), p, q in zip(spans[1:], path, path[1:], strict=False))
                taken = [(p, p + len(t)) for p, (_, t) in zip(path, spans, strict=True)]
                if near and all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(taken, 2)) and sorted(path) != last:
                    last = sorted(path)
                    out.append((doc_id, anchor, last))
                    break
    return sorted(out)


SHAPES = ["a", "a b", "@lemma:la", "(a or c)", "(@lemma:la and @case:nom)", "(@case:acc or @lemma:lc)", "@case:nom b", "a ~ b", "a 3~> b", "a 2~ a", "a b 4~ c", "a 3~ b 2~> a", "a 4~ b 4~ a", "[B] a 2~ (b or d)", "(@case:nom and @number:sg) 6~ e", "@case:nom 3~ @case:nom 3~ @case:nom", "zzz", "@degree:comp"]


@pytest.mark.parametrize("strict", [False, True])
def test_results_as_of_looking_at_every_token(small, strict):
    corpus, docs = small
    for text in SHAPES:
        got = sorted((r["doc_id"], r["pos"], [s["pos"] for s in r["spans"]]) for r in S.matches(corpus, text, strict=strict).collect())
        assert got == _naive(docs, text, strict), text


def test_pages_and_texts(small):
    corpus, docs = small
    every, cursor = [], None
    while True:
        page, cursor = S.search(corpus, "a b", cursor and str(cursor), size=3, context=2)
        every += [(r["doc_id"], r["pos"], [(c["text"], c["is_match"]) for c in r["chunks"]]) for r in page.collect()]
        if cursor is None:
            break
    assert [(d, p) for d, p, _ in every] == [(d, p) for d, p, _ in _naive(docs, "a b", False)]
    for d, p, chunks in every:
        assert [t for t, m in chunks if m] == ["a b"]
        words = docs[d][1]
        assert "".join(t for t, _ in chunks).replace(".", "").split() == [w for w, _ in words[max(0, p - 2) : p + 4]]
    with pytest.raises(Q.QueryError):
        S.search(corpus, "a" * 101)


def test_postings(small):
    corpus, docs = small
    got = {(r["attr"], r["key"], r["doc_id"]): r["positions"] for r in C.postings(corpus).collect()}
    for d, (_, words) in docs.items():
        assert got.get(("word", "a", d), []) == [i for i, (w, _) in enumerate(words) if w == "a"]
        assert got.get(("lemma", "la", d), []) == [i for i, (w, _) in enumerate(words) if any(x == "la" for x, _ in MEANINGS[w])]
        assert got.get(("case", "accusative", d), []) == [i for i, (w, _) in enumerate(words) if any(m & 2 for _, m in MEANINGS[w])]


def test_only_what_must_hold_together_is_a_contradiction():
    from glyphspan.plans.language import impossible, parse

    of = lambda text: impossible(parse(text).terms[0].constraint)
    for text in ("(@case:nom and !@case:acc)", "(@case:nom and (@case:acc or @lemma:x))", "(@lemma:a and (@lemma:b or c))", "(@case:nom or @case:acc)", "(@lemma:a and @lemma:a)"):
        assert not of(text)
    for text in ("(@case:nom and @case:acc)", "(@lemma:a and (@lemma:b and c))", "(@lemma:a and !@lemma:a)", "(a and ((@case:nom and @case:acc) or (@lemma:a and @lemma:b)))"):
        assert of(text)


def test_parts_of_a_corpus_are_written_when_asked_for(spark, tmp_path):
    """One part at a time, each as a whole build has it; texts of one group of rows are dealt out, and a common word to several files."""
    texts = ["", None, " ‘Of the’ sēa—†the \U0001d4d0b. end", "the. the,the", "...", "x y the"] + ["the " * 50] * 200
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").coalesce(1)
    whole = C.build(docs, str(tmp_path / "whole"))
    parts = C.Parts(docs, str(tmp_path / "parts"))
    rows = lambda df: sorted(map(repr, df.collect()))
    for name in ("words", "blocks", "tokens"):
        assert not (tmp_path / "parts" / name).exists()
        assert rows(getattr(parts, name)) == rows(getattr(whole, name))
    plain = {i: [w for w in re.split(f"[{re.escape(T.BREAKS)}]+", t or "") if w] for i, t in enumerate(texts)}
    got = {}
    for r in whole.tokens.orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: ws for i, ws in plain.items() if ws}
    assert whole.tokens.where("norm = 'the'").select(F.input_file_name()).distinct().count() > 1
    plan = S.tokens_of(whole, Q.Lemma("the"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_lists_of_words_are_made_where_texts_are_read(spark, tmp_path, monkeypatch):
    """No token is stored or shuffled for the index; repeated and missing ids, texts over several batches and empty ones count as ever."""
    from glyphspan.operators import tokens as K
    from glyphspan.plans import registry

    rng = random.Random(4)
    texts = [(i % 30, " ".join(rng.choices("abcd", k=rng.randrange(12)))) for i in range(40)]
    texts += [(100, "a b " * 30_000), (101, None), (102, ""), (None, "a a c"), (None, "c a."), (103, "the. ‘The")]
    analyses = spark.createDataFrame([(w, lemma, mask) for w, found in MEANINGS.items() for lemma, mask in found], "word string, lemma string, mask int")
    rows = lambda df: sorted(map(repr, df.select("attr", "key", "doc_id", "positions").collect()))
    for name, some in (("repeated", texts), ("single", [t for i, t in enumerate(texts) if t[0] is not None and (i < 30 or i >= 40)])):
        docs = spark.createDataFrame([(d, "s", t) for d, t in some], "doc_id long, source string, text string")
        docs.repartition(5).write.parquet(str(tmp_path / name / "docs"))
        docs = spark.read.parquet(str(tmp_path / name / "docs"))
        whole = C.build(docs, str(tmp_path / name / "whole"), analyses)
        parts = C.Parts(docs, str(tmp_path / name / "parts"), analyses)
        got = {tuple(r) for r in C.posting_sizes(parts).select("attr", "key", "n", "docs").collect()}
        assert not (tmp_path / name / "parts" / "tokens").exists()
        want = {}
        for r in C.postings(whole).collect():
            n, d = want.get((r["attr"], r["key"]), (0, 0))
            want[r["attr"], r["key"]] = (n + len(r["positions"]), d + (r["doc_id"] is not None))
        assert got == {(*k, *v) for k, v in want.items()}
        assert rows(C.postings(parts)) == rows(C.postings(whole))
        assert rows(C.postings(parts)) == rows(C.postings(parts))
    monkeypatch.setattr(K, "TEXT_AT_ONCE", 1 << 30)  # these files are small: they lie evenly enough
    plan = K.word_lists(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    called = []
    monkeypatch.setattr(C, "write_tokens", lambda *a: called.append(a))
    assert registry.QUERIES["postings_index"](spark, "/root/testdata/sf0.001").count() and not called
