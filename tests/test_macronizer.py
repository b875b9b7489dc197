"""Vowel lengths from text to text."""

from pyspark.sql import functions as F

from glyphspan.operators import macronizer as M

FORMS = [
    ("panthia", "Panthia", "Panthia", 1, None),
    ("panthia", "Panthia_", "Panthia", 2, None),
    ("acclinat", "accli_nat", "acclino", 8, None),
    ("eos", "E_os", "Eos", 1, None),
    ("eos", "eo_s", "is", 2, None),
    ("gallus", "gallus", "gallus", 1, None),
    ("gallus", "Gallus", "Gallus", 1, None),
    ("virumque", "viru^m", "vir", 2, "que"),
    ("atque", "atque", "atque", 0, None),
    ("atque", "a_t", "at", 0, "que"),
]
SCHEMA = "word string, form string, lemma string, mask int, enclitic string"


def _forms(spark):
    return spark.createDataFrame(FORMS, SCHEMA)


def _tagged(spark, rows):
    return spark.createDataFrame([(d, j, t, lemma, mask) for d, j, t, lemma, mask in rows], "doc_id long, j int, text string, lemma string, mask int")


def test_texts_come_back_with_lengths(spark):
    texts = [(1, "Panthia, acclinat!"), (2, "EOS eos Eōs"), (3, "Virumque atque eos."), (4, ""), (5, None), (6, "... 12"), (7, "Panthia"), (8, "Gallus")]
    df = spark.createDataFrame(texts, "id long, text string")
    tagged = _tagged(spark, [(1, 0, "Panthia", "Panthia", 2), (1, 2, "acclinat", "acclino", 8), (2, 0, "EOS", "Eos", 1), (2, 2, "eos", "nothing", 2), (3, 0, "Virum", "vir", 2), (3, 1, "que", "que", 0), (3, 3, "atque", "atque", 0), (3, 5, "eos", "is", 2), (7, 0, "wrong", "Panthia", 2)])
    got = {r["doc_id"]: r["text"] for r in M.macronised(df, _forms(spark), tagged, "id").collect()}
    m = "̄"
    assert got == {1: f"Panthia{m}, accli{m}nat!", 2: f"E{m}OS eo{m}s Eo{m}s", 3: f"Virumque atque eo{m}s.", 4: "", 5: None, 6: "... 12", 7: "Panthia", 8: "Gallus"}
    assert M.macronised(df.limit(0), _forms(spark), tagged, "id").count() == 0
    same = M.macronised(df, _forms(spark).limit(0), tagged.limit(0), "id").collect()
    assert {r["doc_id"]: r["text"] for r in same} == dict(texts)


def test_what_a_tagger_is_given(spark):
    df = spark.createDataFrame([(1, "Virumque, atque"), (2, None)], "id long, text string")
    parts = M.placed(M.pieces(df, "id"), _forms(spark))
    given = sorted(M.given(parts).collect(), key=lambda r: r["j"])
    assert [(r["j"], r["text"], r["space"]) for r in given] == [(0, "Virum", False), (1, "que", False), (2, ", ", True), (3, "atque", False)]
    tagged = _tagged(spark, [(1, 0, "Virum", "vir", 2), (1, 1, "ve", "ve", 0), (1, 2, ", ", None, None), (1, 9, "x", None, None)])
    assert sorted((r["j"], r["text"], r["tagged"]) for r in M.misaligned(parts, tagged).collect()) == [(1, "que", "ve"), (3, "atque", None), (9, None, "x")]


def test_options(spark):
    df = spark.createDataFrame([(1, "EOS"), (2, "Gallus"), (3, "Virumque"), (4, "ignotus"), (5, "Ĕos")], "id long, text string")
    rows = M.words_with_forms(M.placed(M.pieces(df, "id"), _forms(spark)), _forms(spark), _tagged(spark, [])).collect()
    got = {r["doc_id"]: (r["options"], r["suggested"]) for r in rows}
    assert {k: (sorted(o), s) for k, (o, s) in got.items()} == {1: (["EŌS", "ĒOS"], None), 2: (["Gallus"], None), 3: (["Virumque"], None), 4: ([], None), 5: (["Eōs"], None)}


def test_a_form_of_another_length_is_none(spark):
    rows = spark.createDataFrame([("a_b", "AB"), ("a_bc", "AB"), ("+a^-b_", "xy"), (None, "x")], "form string, word string")
    assert [r[0] for r in rows.select(M.displayed(F.col("form"), F.col("word"))).collect()] == ["ĀB", None, "xȳ", None]
