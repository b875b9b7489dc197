"""Works of rows, tagged features, numerals and readings of tokens."""

import pytest
from pyspark.sql import functions as F

from glyphspan.functions import inflection as I
from glyphspan.functions import text as T
from glyphspan.operators import works as W


def test_tokens_of_rows(spark):
    rows = ["(arma virumque.", "", "cano, Trōiae", "qui primus", "ab oris?"]
    ids = [["1", "1"], ["1", "2"], ["1", "3"], ["2", "1"], ["2"]]
    works = spark.createDataFrame([("w", rows, ids), ("v", ["x"], [["1"]]), ("u", [""], [["1"]])], "work string, rows array<string>, row_ids array<array<string>>")
    got = [tuple(r) for r in W.work_tokens(works).where("work = 'w'").orderBy("pos").select("row", "in_row", "text", "norm", "brk", "hard_break").collect()]
    assert got == [
        (0, 0, "arma", "arma", " ", False), (0, 1, "virumque", "virumque", ".\n\n", True), (2, 0, "cano", "cano", ", ", False), (2, 1, "Trōiae", "troiae", "\n", True),
        (3, 0, "qui", "qui", " ", False), (3, 1, "primus", "primus", "\n", True), (4, 0, "ab", "ab", " ", False), (4, 1, "oris", "oris", "?", True),
    ]
    assert [tuple(r) for r in W.work_tokens(works).where("work <> 'w'").select("work", "text", "hard_break").collect()] == [("v", "x", True)]


def test_catalogue(spark):
    works = spark.createDataFrame([("1", "B", "Livy", None), ("2", "A", "Livy", False), ("3", "C", "Livy", True), ("4", "D", "Two Words", False), ("5", "E", "Ovid", False)], "id string, name string, author string, is_translation boolean")
    got = [(r["id"], r["author_code"]) for r in W.originals(works, {"Two Words": "tw"}, ["5"]).collect()]
    assert got == [("2", "Livy"), ("1", "Livy"), ("4", "tw")]
    with pytest.raises(Exception, match="no code"):
        W.originals(works, {}).collect()
    order = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("c", 5)], "author_code string, ord int")
    assert [tuple(r) for r in W.scattered_authors(order).collect()] == [("a", 2)]


def test_treebank_features(spark):
    tags = {
        "Case=Nom|Number=Sing|Gender=Masc|InflClass=x": I.mask_of("case:nom", "number:sg", "gender:m"),
        "Mood=Ind|Tense=Past|Aspect=Imp|Person=3": I.mask_of("mood:ind", "tense:impf", "person:3"),
        "Tense=Past|Aspect=Perf": I.mask_of("tense:plup"),
        "Tense=Fut|VerbForm=Part|Number[psor]=Sing": I.mask_of("tense:fut", "mood:part"),
        "": 0,
    }
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert [r[0] for r in df.select(I.mask_from_treebank(F.col("t"))).collect()] == list(tags.values())
    with pytest.raises(Exception, match="unknown feature"):
        spark.createDataFrame([("Case=Xyz",)], "t string").select(I.mask_from_treebank(F.col("t"))).collect()


def test_numerals_both_ways(spark):
    numbers = spark.range(1, 4000).select("id", T.roman(F.col("id")).alias("r")).withColumn("back", T.from_roman(F.lower("r")))
    assert numbers.where("back IS NULL OR back <> id").count() == 0
    bad = spark.createDataFrame([("IVX",), ("A",), ("IXI",), ("VX",), ("XIVI",)], "r string").select("r", T.from_roman(F.col("r")).alias("n")).collect()
    assert {r["r"]: r["n"] for r in bad} == {"IVX": None, "A": None, "IXI": 10, "VX": 5, "XIVI": 15}


def test_readings(spark):
    words = ["visust", "bonast", "tu’s", "virumque", "mecum", "amo", "'st"]
    got = {r["w"]: r["d"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", W.decomposed(F.col("w")).alias("d")).collect()}
    assert got["visust"] == [["visust"], ["visus", "est"]] and got["bonast"] == [["bonast"], ["bona", "est"]]
    assert got["tu’s"] == [["tu", "es"]] and got["'st"] == [["est"]] and got["amo"] == [["amo"]]
    assert got["virumque"] == [["virumque"], ["virum", "que"]] and got["mecum"] == [["mecum"], ["me", "cum"]]
