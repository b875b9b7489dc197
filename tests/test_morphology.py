"""Consolidated analyses, preverbs, corrections, cross-references and comparisons against plain Python on small tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphspan.functions import checks
from glyphspan.functions import inflection as I
from glyphspan.functions import text as T
from glyphspan.operators import corrections as P
from glyphspan.operators import dictionary as D
from glyphspan.operators import evaluate as E
from glyphspan.operators import lexicon as L
from glyphspan.operators import morphology as H
from glyphspan.operators import references as R
from glyphspan.operators import tokens as K
from glyphspan.plans import registry


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_analyses_are_consolidated(spark):
    m = I.mask_of
    base = m("number:sg", "mood:part")
    rows = [("w", "l", base | m("case:abl", "gender:m")), ("w", "l", base | m("case:dat", "gender:m")), ("w", "l", base | m("gender:m")), ("w", "l", base | m("case:abl", "case:dat", "gender:n")), ("w", "l", base | m("case:nom", "gender:f")), ("w", "k", base)]
    got = _rows(H.consolidated(spark.createDataFrame(rows + rows[:1], "word string, lemma string, mask int"), ["word", "lemma"]))
    assert got == sorted([("w", "l", base | m("case:abl", "case:dat", "gender:m", "gender:n")), ("w", "l", base | m("case:nom", "gender:f")), ("w", "k", base)])


def test_consolidation_as_plain_python(spark):
    rng, rows, want = random.Random(2), [], []
    bits = [I.mask_of(f) for f in ("case:nom", "case:abl", "case:dat", "gender:m", "gender:f", "gender:n", "gender:adv", "number:sg", "number:pl")]
    for w in range(60):
        masks = {sum(rng.sample(bits, rng.randrange(1, 5))) for _ in range(rng.randrange(1, 7))}
        rows += [(f"w{w}", x) for x in masks]
        kept = [x for x in masks if not any(x != y and x & y == x for y in masks)]
        for name, some in (("case", ("case:abl", "case:dat")), ("gender", ("gender:m", "gender:f", "gender:n"))):
            whole, groups, out = I.category_mask(name), {}, []
            for x in kept:
                if x & whole & ~I.mask_of(*some):
                    out.append(x)
                else:
                    groups[x & ~whole] = groups.get(x & ~whole, 0) | x
            kept = out + list(groups.values())
        want += [(f"w{w}", x) for x in kept]
    assert _rows(H.consolidated(spark.createDataFrame(rows, "word string, mask int"), ["word"])) == sorted(want)


def test_preverbs(spark):
    prefixes = spark.createDataFrame([("im", "in"), ("in", "in"), ("ab", "ab")], "preverb string, prefix string")
    words = spark.createDataFrame([(w,) for w in ("impono", "immitto", "inferō", "ab", "", None, "cano")], "word string")
    splits = H.preverb_splits(words, prefixes)
    assert _rows(splits) == [("immitto", "im", "in", "mitto"), ("impono", "im", "in", "pono"), ("inferō", "in", "in", "ferō")]
    verbs = spark.createDataFrame([("mitto", "mitto"), ("pono", "pono"), ("ferō", "fero_")], "word string, form string")
    assert {r["word"] for r in H.preverbed(splits, verbs).collect()} == {"immitto", "inferō"}  # im before p is no assimilation


def test_numerals_stem_index_and_order(spark):
    forms = spark.createDataFrame([(2, "duo", ["card", "arabic2"]), (1, "bini", ["dist", "arabic2"]), (3, "secundus", ["ord", "arabic2"]), (4, "canis", [])], "ord int, lemma string, tags array<string>")
    assert _rows(H.numerals(forms)) == [(2, "duo", "secundus")]
    entries = spark.createDataFrame([("vb", "am-a_", "amo", ["x"]), ("no", "ros", "rosa", ["f"]), ("no", "-", "y", ["f"]), ("no", "ros", "rosa", ["f"])], "code string, stem string, lemma string, features array<string>")
    assert _rows(H.stem_index(entries)) == [("*", [":y:f"]), ("1ama", ["ama_:amo:x"]), ("ros", [":rosa:f"])]
    table = spark.createDataFrame([(1, "a"), (2, "c"), (3, "b"), (4, "b")], "n int, k string")
    assert _rows(H.out_of_order(table, "k", "n")) == [(3, "b")]


def test_patches(spark):
    texts = spark.createDataFrame([("w", "1", 0, "thathat cat"), ("w", "1", 1, "dog"), ("w", "2", 0, None), ("v", "1", 0, "dog")], "work string, location string, part int, text string")
    patch = lambda *rows: spark.createDataFrame(rows, "work string, location string, target string, replacement string")
    good = patch(("w", "1", "cat", "c"), ("w", "1", "dog", "doggy"), ("w", "1", "thatha", "tata"))
    assert _rows(P.patched(texts.na.fill(""), good)) == [("v", "1", 0, "dog"), ("w", "1", 0, "tatat c"), ("w", "1", 1, "doggy"), ("w", "2", 0, "")]
    assert {tuple(r) for r in P.patched(texts, patch()).collect()} == {tuple(r) for r in texts.collect()}
    assert P.patch_faults(texts, good).count() == 0
    bad = patch(("w", "1", "that", "x"), ("w", "1", "hat c", "x"), ("w", "2", "a", "b"), ("w", "9", "a", "b"))
    assert _rows(P.patch_faults(texts, bad)) == sorted([("w", "1", "that", "used twice"), ("w", "2", "a", "unused"), ("w", "9", "a", "unused")])
    assert _rows(P.patch_faults(texts, patch(("w", "1", "thatha", "x"), ("w", "1", "hat c", "y")))) == [("w", "1", "hat c", "overlapping"), ("w", "1", "thatha", "overlapping")]
    with pytest.raises(Exception, match="twice or overlapping"):
        P.patched(texts, patch(("w", "1", "that", "x"))).collect()


def test_checks(spark):
    spans = "array<struct<start:int,stop:int>>"
    df = spark.createDataFrame([(1, [(5, 7), (0, 4)]), (2, [(0, 4), (4, 6)]), (3, [(0, 5), (4, 6)]), (4, [])], f"i int, s {spans}")
    assert _rows(df.select("i", checks.disjoint(F.col("s")), checks.disjoint(F.col("s"), touching=True))) == [(1, True, True), (2, False, True), (3, False, False), (4, True, True)]
    maps = spark.createDataFrame([({"a": 1}, {"b": 2}, {"a": 2})], "a map<string,int>, b map<string,int>, c map<string,int>")
    assert maps.select(checks.merged_maps(F.col("a"), F.col("b"))).first()[0] == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="key in both maps: a"):
        maps.select(checks.merged_maps(F.col("a"), F.col("c"))).collect()


def test_names_and_short_vowels(spark):
    df = spark.createDataFrame([("Gallic War",), ("X",)], "n string")
    assert [r[0] for r in df.select(T.slug(F.col("n"), {"X": "ten"})).collect()] == ["gallic_war", "ten"]
    words = ["infans", "īnfāns", "īnfāns", "nsa", "cōnsul", "consul", "ab"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.short_before(F.col("w"), "nf", "ns"))
    assert {r[0] for r in got.collect() if r[1]} == {"infans", "consul"}


def _plain_resolve(term, keys, fillers, special=None, depth=0):
    """The rules of cross-references, one term at a time."""
    forms = [(k.lower(), k) for k in keys if k]
    forms = [f for n, k in forms for f in ([(n, k), (n.replace("-", ""), k)] if k.find("-") > 0 else [(n, k)])]

    def one(text):
        if special and text in special:
            return special[text]
        text = text.removeprefix("TO ")
        ing, text = text.endswith("ING"), text.removesuffix("ING")
        low = text.lower()
        near = [(n, k) for n, k in forms if low and (n.startswith(low) or low.startswith(n))]
        if not near:
            for a, b in R.ENDINGS:
                if text.endswith(a):
                    return _plain_resolve(text[: -len(a)] + b, keys, fillers, special, depth + 1) if depth == 0 else None
            return None
        for target in [low + "ing" * ing] + [low + "e"] * ing + [low[:-1]] * low.endswith("s"):
            for n, k in near:
                if n == target:
                    return k
        longer = [(n, k) for n, k in near if n.startswith(low)]
        return min(longer, key=lambda x: len(x[0]))[1] if longer else None

    plain, inside = "", False
    for c in term.replace("-*", "-").split(",")[0]:
        inside = True if c in "([" else False if c in ")]" else inside
        plain += "" if inside else c
    plain = plain.replace("  ", " ").strip(" ").removesuffix(".")
    undashed = plain.replace("-", "")
    kept = " ".join(w for w in term.split(" ") if w not in fillers and w[:1] not in ("(", "["))
    for text in [term, plain] + [undashed] * ("-" in plain) + [undashed[:-2]] * undashed.endswith("LY") + [kept]:
        if (found := one(text)) is not None:
            return found
    return None


def test_references_as_plain_python(spark):
    keys = ["Realize", "Bake", "Baker", "Cat", "Well-known", "City", "Happy", "go up", "Go", "Run", "Cat", "-ly", "Flying"]
    terms = ["REALISE", "TO BAKE", "BAKING", "CATS", "CITIES", "WELLKNOWN", "WELL-KNOWN", "WELL-*KNOWN", "HAPPYLY", "TO GO UP", "GO (see) UP", "GO [x", "RUNNING", "BAK", "ZZZ", "", "THE CAT.", "CAT, or dog", "FLYING", "(CAT)", "-LY", "CATISE", "ODD", "FOO.", "TO", "ING", "WELL-KNOWNLY"]
    frame = spark.createDataFrame([(t,) for t in [*terms, "CATS", None]], "term string")
    table = spark.createDataFrame(list(enumerate(keys)), "ord int, key string")
    fillers, special = ["THE", "UP"], {"ODD": "Even"}
    got = {r["term"]: r["key"] for r in R.resolved(frame, table, fillers, special).collect()}
    assert got == {t: _plain_resolve(t, keys, fillers, special) for t in terms}
    assert R.resolved(frame, table.limit(0), fillers).where("key IS NOT NULL").count() == 0


def test_references_of_all_parts(spark, sf):
    parts = pd.read_parquet(f"{sf}/part.parquet").sort_values("p_partkey")
    keys = list(parts["p_name"])
    rows = registry.QUERIES["cross_references"](spark, sf).collect()
    assert len(rows) >= len(set(keys))
    for r in rows[::7]:
        assert r["key"] == _plain_resolve(r["term"], keys, registry.FILLERS), r["term"]


def test_runs_are_compared_and_reported(spark):
    rng = random.Random(3)
    rows = lambda shift: spark.createDataFrame([(t, m, 100 + rng.random() + (shift if t == "slow" else 0)) for t in ("slow", "same") for m in ("time", "size") for _ in range(20)], "test string, metric string, value double")
    a, b = rows(0), rows(5)
    out = E.compare_runs(a, b)
    assert {(r["test"], r["metric"]) for r in out.where("p_value < 0.001 AND diff_percent > 4").collect()} == {("slow", "time"), ("slow", "size")}
    assert _rows(E.report(out, ["time"])) == [("time", "regressed", 1)]
    assert _rows(E.report(E.compare_runs(b, a), ["time"])) == [("time", "improved", 1)]
    assert _rows(E.unmatched_tests(a, b.union(spark.createDataFrame([("new", "time", 1.0)], b.schema)))) == [("new",)]


def test_ordinals_and_sections(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "k") for i in range(25)], "i int, k string")
    got = {r["i"]: r["ordinal"] for r in E.ordinals(df, "k", "i", block=4).collect()}
    assert got == {i: sum(1 for j in range(i) if (j % 3 == 0) == (i % 3 == 0)) for i in range(25)}
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (3, "a")], "s int, norm string")
    assert _rows(K.holding_all(tokens, ["A", "b"], ["s"])) == [(1,), (3,)]


def test_spellings_meet_and_complete(spark):
    words = spark.createDataFrame([(w,) for w in ("iuvat", "juuat", "juvat", "amat")], "word string")
    groups = words.groupBy(L.spelling_key(F.col("word")).alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    assert _rows(groups) == [("iuuat", 3)]
    orths = D.headwords(spark.createDataFrame([(1, "Iulius"), (2, "jam"), (3, "ut"), (4, "vt")], "id int, key string"), "d", "id", "key")
    assert _rows(D.completions(orths, "j")) == [("d", "Iulius"), ("d", "jam")]
    assert _rows(D.completions(orths, "ut")) == [("d", "ut"), ("d", "vt")]


def test_beginnings_of_references_are_not_sorted(spark):
    """Every reading has as many beginnings as letters: they pass by hashed keys, and a reading that meets several keys is one row."""
    from glyphspan.operators import references as R

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = spark.createDataFrame([(i, "a" * i) for i in range(1, 9)], "ord long, key string")
        found = R.resolved(spark.createDataFrame([("aaaaz",), ("zz",)], "term string"), keys, [])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") >= 2
        assert {r["term"]: r["key"] for r in found.collect()} == {"aaaaz": None, "zz": None}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
