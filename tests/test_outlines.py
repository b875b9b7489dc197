"""Trees written as markup, outlines, batches, processes and translations on small tables."""

from pyspark.sql import functions as F

from glyphspan.functions import text as T
from glyphspan.operators import language as N
from glyphspan.operators import lexicon as L
from glyphspan.operators import markup as M
from glyphspan.operators import works as W


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_trees_are_written_and_read_again(spark):
    texts = ['<a x="1 &amp; &quot;2&quot;" b="">t<b/>u &lt; v<c><d>w</d></c></a>', "<r><s><t/></s></r>", "<x>only</x>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tree = M.nodes(df, "id", "text")
    roots = tree.where("parent IS NULL")
    again = M.markup_of(tree, roots).select(F.col("doc_id").alias("id"), F.col("markup").alias("text"))
    assert again.where("id = 1").first()["text"] == texts[1]
    plain = lambda t: sorted((*r[:7], sorted((r["attrs"] or {}).items()), r["text"]) for r in t.collect())
    assert plain(M.nodes(again, "id", "text")) == plain(tree)
    inner = M.markup_of(tree, tree.where("name IN ('c', 'b')"))
    assert sorted(r["markup"] for r in inner.collect()) == ["<b/>", "<c><d>w</d></c>"]


def test_brackets(spark):
    def plain(text):
        out, open_ = "", []
        for c in text:
            if c in "([":
                open_.append(")" if c == "(" else "]")
            elif open_ and open_[0] == c:
                open_.pop()
            elif not open_:
                out += c
        return out

    texts = ["a (b) c", "(a [b) c] d", "[x", "a) b", "((a) b) c", "", "(a [b] c) d", "]a("]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(M.without_brackets(F.col("t"))).collect()] == [plain(t) for t in texts]
    assert spark.sql("SELECT CAST(NULL AS STRING) t").select(M.without_brackets(F.col("t"))).first()[0] is None


def test_blurbs(spark):
    text = "<e><sense>one <etym>from x</etym>(two) three: four</sense><sense>" + "a" * 30 + "<i>bbbbbb</i>cc<i>dd</i></sense><sense/></e>"
    tree = M.nodes(spark.createDataFrame([(7, text)], "id int, text string"), "id", "text")
    got = [r["blurb"] for r in M.blurbs(tree, tree.where("name = 'sense'")).orderBy("node").collect()]
    assert got == ["one  three", "a" * 30 + "bbbbbb ..."]


def test_batches_and_processes(spark):
    rows = spark.createDataFrame([(1, i, None if i == 2 else f"s{i}") for i in range(6)] + [(2, 0, "x")], "doc int, n int, text string")
    assert _rows(N.batches(rows, "doc", "n", 2)) == [(1, 0, "s0\ns1"), (1, 1, "s3\ns4"), (1, 2, "s5"), (2, 0, "x")]
    docs = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id int, text string")
    got = N.processed(docs, "id", {"upper": str.upper, "first": lambda t: t[0]})
    assert _rows(got.select("id", "processor", F.coalesce("output", F.lit("-")), F.substring_index(F.coalesce("error", F.lit("-")), ":", 1))) == [
        (1, "first", "a", "-"), (1, "upper", "AB", "-"), (2, "first", "-", "IndexError"), (2, "upper", "", "-"), (3, "first", "-", "-"), (3, "upper", "-", "-"),
    ]
    assert got.where("seconds < 0 OR seconds IS NULL").count() == 0


def test_translations_letters_and_enclitics(spark):
    works = spark.createDataFrame([("w", "W", None, False, "t"), ("t", "T", "Ann", True, None), ("v", "V", None, False, "w"), ("u", "U", None, False, None)], "id string, title string, translator string, is_translation boolean, translation_id string")
    assert {r["id"]: r["translation"] and tuple(r["translation"]) for r in W.with_translations(works).collect()} == {"w": ("t", "Ann", "T"), "t": None, "v": None, "u": None}
    df = spark.createDataFrame([("",), ("12",), ("ä1",), ("ω",), ("я",)], "t string")
    assert [r[0] for r in df.select(T.has_letters(F.col("t"))).collect()] == [True, False, True, True, False]
    analyses = spark.createDataFrame([("bene", "bonus", ""), ("bene", "be", "ne"), ("bene", "bonus", "ne")], "word string, lemma string, enclitic string")
    assert _rows(L.standing_alone(analyses)) == [("bene", "bonus", ""), ("bene", "bonus", "ne")]


def test_matches_run_across_elements(spark):
    text = "<a>one <b>tw<c>o</c></b> three<b>!</b> <d/>two</a>"
    tree = M.nodes(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    texts = {r["node"]: r["text"] for r in tree.where("name IS NULL").collect()}
    got = M.text_matches(tree, tree.where("parent IS NULL"), r"two( three)?|!").collect()
    assert [r["match"] for r in got] == ["two three", "!", "two"]
    for r in got:
        assert "".join(texts[p["node"]][p["start"] : p["stop"]] for p in r["parts"]) == r["match"]
    assert len(got[0]["parts"]) == 3
    assert M.text_matches(tree, tree.where("name = 'd'"), "two").count() == 0


def test_token_starts(spark):
    df = spark.createDataFrame([("a bab b", ["a", "b", "x", "b", "b"]), ("", ["a"]), ("ab", [])], "t string, w array<string>")
    assert [r[0] for r in df.select(N.token_starts(F.col("t"), F.col("w"))).collect()] == [[0, 2, None, 4, 6], [None], []]
