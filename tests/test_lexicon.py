"""The analyser, its source files, and dictionaries on small tables."""

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from glyphspan.functions import inflection as I
from glyphspan.functions import text as T
from glyphspan.operators import dictionary as D
from glyphspan.operators import lexicon as L
from glyphspan.operators import morphology as H


def _words(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def test_case_and_consonant_variants(spark):
    got = {(r["variant"], r["relaxed"]) for r in L.case_variants(_words(spark, "VT")).collect()}
    assert got == {("Vt", False), ("Ut", True), ("vt", True), ("ut", True)}

    def plain(word):
        low = word.lower()
        at = [k for k, c in enumerate(low) if c in "iu" and any(0 <= j < len(low) and low[j] in "aeiouy" for j in (k - 1, k + 1))]
        at = [k for k in at if not (low[k] == "i" and "j" in low) and not (low[k] == "u" and ("v" in word or (k and low[k - 1] == "q")))]
        out = set()
        for some in itertools.chain.from_iterable(itertools.combinations(at, n) for n in range(1, len(at) + 1)):
            out.add("".join(c.translate(str.maketrans("iuIU", "jvJV")) if k in some else c for k, c in enumerate(word)))
        return out

    words = ["iuuenis", "quia", "uia", "Iulius", "vius", "jaiu", "abc", "u"]
    got = {}
    for r in L.consonant_variants(_words(spark, *words)).collect():
        got.setdefault(r["word"], set()).add(r["variant"])
    assert got == {w: plain(w) for w in words if plain(w)}


def test_features_merge_by_category(spark):
    rng = random.Random(1)
    pick = lambda: sum(rng.choice([0, rng.randrange(I.category_mask(c) + 1) & I.category_mask(c)]) for c in I.CATEGORIES)
    pairs = [(pick(), pick()) for _ in range(300)]

    def merged(a, b):
        out = 0
        for c in I.CATEGORIES:
            x, y = a & I.category_mask(c), b & I.category_mask(c)
            if x and y and not x & y:
                return None
            out |= x & y if x and y else x | y
        return out

    def narrowed(s, e):
        out = e
        for c in I.CATEGORIES:
            m = I.category_mask(c)
            if (s & e & m) != (s & m) and not (c == "gender" and not e & m):
                return None
            if c in ("case", "gender") and s & m:
                out = out & ~m | s & m
        return out

    df = spark.createDataFrame(pairs, "a int, b int")
    for r in df.select("*", I.merged(F.col("a"), F.col("b")).alias("m"), I.narrowed(F.col("a"), F.col("b")).alias("n")).collect():
        assert (r["m"], r["n"]) == (merged(r["a"], r["b"]), narrowed(r["a"], r["b"]))
    assert I.mask_of("case:abl", "n=pl") == 1 << 4 | 1 << 8 and I.parse_feature("d:comp").bit == 0
    got = spark.range(1).select(I.values_of(F.lit(I.mask_of("case:dat", "case:abl")), "case").alias("v"), I.mask_from_tags(F.array(F.lit("abl/dat"), F.lit("masc"), F.lit("xyz"))).alias("m")).first()
    assert got["v"] == ["dative", "ablative"] and got["m"] == I.mask_of("case:dat", "case:abl", "gender:masc")
    with pytest.raises(ValueError):
        I.parse_feature("case:none")


def test_files_to_analyses(spark):
    templates = spark.createDataFrame([("x/decl1.end", "# first\na nom sg\nam acc sg\nis\tdat/abl pl\n"), ("x/both.end", "*@decl1 fem\nr@decl1 sg\n")], "path string, text string")
    endings, uses = L.template_lines(templates)
    table = L.expanded(endings, uses)
    got = {(r["infl"], r["ending"], r["end_mask"]) for r in table.collect()}
    fem, sg = I.mask_of("gender:fem"), I.mask_of("number:sg")
    assert ("both", "am", I.mask_of("case:acc", "number:sg") | fem) in got and ("both", "ram", I.mask_of("case:acc") | sg) in got
    assert not any(e == "ris" for _, e, _ in got)  # singular and plural exclude each other
    files = spark.createDataFrame([("f", ":le:via\n:no:ui decl1 fem\n\n# no\n:le:sum\nest 3rd sg pres\n\n:le:rosa\nros@decl1 dat pl\n")], "path string, text string")
    lines = L.lexicon_lines(files)
    stems, irregular = L.stems_from(lines, ["decl1", "both"])
    assert sorted((r["lemma"], r["stem"], r["infl"]) for r in stems.collect()) == [("rosa", "ros", "decl1"), ("via", "ui", "decl1")]
    stems = stems.withColumn("stem", F.when(F.col("stem") == "ui", "vi").otherwise(F.col("stem")))
    found = L.crunch(_words(spark, "Uiam", "uiamque", "est", "ROSIS", "rosam", "xx"), stems, table, irregular)
    got = {(r["word"], r["form"], r["lemma"], r["enclitic"], r["relaxed"]) for r in found.collect()}
    assert ("Uiam", "viam", "via", "", True) in got and ("uiamque", "viam", "via", "que", False) in got
    assert ("est", "est", "sum", "", False) in got and ("ROSIS", "rosis", "rosa", "", True) in got
    assert not any(w in ("rosam", "xx") for w, *_ in got)  # the stem names a plural, the ending a singular
    mask = next(r["mask"] for r in found.collect() if r["word"] == "ROSIS")
    assert mask == I.mask_of("case:dat", "number:pl")
    assert [r["forms"][0]["form"] for r in L.by_lemma(found).where("word = 'est'").collect()] == ["est"]
    assert {r["ending"]: r["tables"] for r in L.ending_index(table).collect()}["am"] == ["both", "decl1"]
    with pytest.raises(ValueError):
        L.expanded(endings, uses.union(spark.createDataFrame([("p", "", "q", 0), ("q", "", "p", 0)], uses.schema)))
    with pytest.raises(ValueError):
        L.expanded(endings, uses.union(spark.createDataFrame([("p", "", "none", 0)], uses.schema)))


def test_unicode_keys_and_lengths(spark):
    words = ["Amō", "ămō", "Straße", "d'Être", "ÿ́", "āē̆ī", "naïve", "Ångström", "abc"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r for r in df.select("w", T.clean_key(F.col("w")).alias("key"), T.normal(F.col("w")).alias("norm"), T.marked_positions(F.col("w")).alias("marks")).collect()}
    for w in words:
        plain = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
        assert got[w]["key"] == plain.lower().replace("ß", "ss").replace("'", "")
        lengths = "".join(c for c in unicodedata.normalize("NFD", w.lower()) if c not in "̄̆")
        assert unicodedata.normalize("NFC", got[w]["norm"]) == unicodedata.normalize("NFC", lengths)
    assert [tuple(x) for x in got["ămō"]["marks"]] == [(0, "short"), (2, "long")]
    pairs = [("amō", "amo", True), ("amō", "amŏ", False), ("amō", "amō̆", True), ("amo", "ammo", False), ("ămō", "āmō", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r["ok"] for r in df.select(T.compatible_lengths(F.col("a"), F.col("b")).alias("ok")).collect()] == [p[2] for p in pairs]
    assert [r[0] for r in spark.createDataFrame([("12",), ("-3",), ("1x",), ("",), (None,)], "t string").select(T.whole_number(F.col("t"))).collect()] == [12, -3, None, None, None]


def test_dictionary_entries_senses_and_inflection(spark):
    raw = spark.createDataFrame(
        [("LS", "n1", ["amō", "a-b"], [("s1", ["amor"])], "to love", None), ("LS", "n2", ["occido"], [], "to fall", 1), ("LS", "n3", ["occīdo"], [], "to kill", 2), ("GA", "g1", ["Amo"], [], "aimer", None)],
        "dict string, id string, keys array<string>, derived array<struct<sense_id:string,orths:array<string>>>, entry string, number int",
    )
    entries, orths = D.build(raw)
    got = {(r["word"], r["dict"], r["id"]): (r["include_main"], [x["id"] for x in r["subsections"]]) for r in D.entries_for(_words(spark, "AMO", "amor", "amŏ", "A-b", "occĭdo"), entries, orths).collect()}
    assert got == {("AMO", "LS", "n1"): (True, []), ("AMO", "GA", "g1"): (True, []), ("amor", "LS", "n1"): (False, ["s1"]), ("amŏ", "GA", "g1"): (True, []), ("A-b", "LS", "n1"): (True, []), ("occĭdo", "LS", "n2"): (True, [])}
    analyses = spark.createDataFrame([("amo", "amo", 1), ("amas", "amo", 2), ("occidit", "occido#2", 4)], "word string, lemma string, mask int")
    how = {(r["word"], r["id"]): r["how"] for r in D.by_inflection(analyses, entries, orths, _words(spark, "amo", "amor", "amas", "occidit")).collect()}
    assert how == {("amo", "n1"): 1, ("amo", "g1"): 1, ("amor", "n1"): 2, ("amas", "n1"): 3, ("amas", "g1"): 3, ("occidit", "n3"): 3}
    assert {r["orth"] for r in D.by_prefix(orths, "AM").collect()} == {"amō", "amor", "Amo"} and {r["orth"] for r in D.by_prefix(orths, "-DO").collect()} == {"occido", "occīdo"}
    assert [r["orth"] for r in D.completions(orths, "am", 1).where("dict = 'LS'").collect()] == ["amō"]


def test_cut_words_are_never_broadcast(spark, tmp_path):
    """A stored vocabulary looks small beside tables that Spark cannot measure; cut at every place it is many times larger."""
    _words(spark, "hating", "andy", "inhat", "zzz").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    stems, endings = L.stems(spark, [("hat", "hat", "y", 2)]), L.endings(spark, [("y", "ing", 2), ("y", "", 1)])
    entries, orths = D.build(spark.createDataFrame([("S", "e0", ["hat"], [], "an entry", None)], "dict string, id string, keys array<string>, derived array<struct<sense_id:string,orths:array<string>>>, entry string, number int"))
    plain = [spark.createDataFrame(t.rdd, t.schema) for t in (stems, endings)]
    frames = [L.analyse(words, stems, endings), L.analyse(words, *plain), L.crunch(words, *plain), D.entries_for(words, entries, orths), H.preverb_splits(words, spark.createDataFrame([("in", "in")], "preverb string, prefix string"))]
    for df in frames:
        assert "BuildLeft" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["word"], r["lemma"]) for r in frames[0].collect()} == {(r["word"], r["lemma"]) for r in frames[1].collect()} == {("hating", "hat")}


def test_places_are_looked_for_in_words_that_met_a_form(spark, capsys):
    words = spark.createDataFrame([("uia",), ("via",), ("iacio",)], "word string")
    stems = L.stems(spark, [("via", "vi", "n", 0), ("iacio", "jaci", "v", 0)])
    out = L.crunch(words, stems, L.endings(spark, [("n", "a", 1), ("v", "o", 2)]))
    out.explain()
    looked = [line for line in capsys.readouterr().out.splitlines() if "transform(" in line]
    assert looked and all("SortMergeJoin" in line for line in looked)
    assert {(r["word"], r["form"]) for r in out.collect()} == {("uia", "via"), ("via", "via"), ("iacio", "jacio")}
