"""Large entry files read by ranges of bytes, their faults, and what dictionaries are built of."""

import random

import pytest
from pyspark.errors import PySparkException

from glyphspan.operators import dictionary as D
from glyphspan.sources import entries as R


def _plain(text):
    out, at = [], 0
    while (a := text.find(R.OPENING, at)) >= 0:
        b = text.index(R.CLOSING, a) + len(R.CLOSING)
        out.append(text[a:b])
        at = b
    return out


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_files_are_read_in_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    files = {}
    for name in ("a.xml", "b.xml"):
        files[name] = "<head>\nv\n</head>\n" + "\n".join(f'<entryFree id="{name}{i}">\n{rng.choice(["", "</entry", "ä</", "<", "</entryFree"]) * rng.randrange(4)} {"x" * rng.randrange(90)}\n</entryFree>' for i in range(40)) + rng.choice(["", "\n", "\n</body>\n"])
        (tmp_path / name).write_text(files[name], encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size * 10))
    try:
        found = R.records(spark, str(tmp_path))
        assert spark.read.option("lineSep", R.CLOSING).text(str(tmp_path)).rdd.getNumPartitions() > 1
        got = {}
        for r in sorted(R.entries(found).collect(), key=lambda r: (r["file"], r["at"], r["row"])):
            got.setdefault(r["file"][-5:], []).append(r["entry"])
        assert got == {k: _plain(v) for k, v in files.items()}
        assert R.faults(found).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ('<entryFree id="1">a</entryFree>', None), ('h\n<entryFree id="1">\na</entryFree>\n \n', None), ("", None), ("no entries\n", None),
        ('<entryFree id="1">a</entryFree>\n<entryFree id="2">', "never closed"), ('<entryFree id="1">a', "never closed"), ("a</entryFree>", "never opened"), ('<entryFree id="1">a</entryFree>\nb\n</entryFree>\n', "never opened"),
        ('<entryFree id="1">\n<entryFree id="2">a</entryFree>', "opened twice"), ('<entryFree id="1">a</entryFree> x\n', "text behind a closing"), ('<entryFree id="1">a</entryFree><entryFree id="1">a</entryFree>', None),
        ('x <entryFree id="1">a</entryFree>\n', "text before an opening"), ('<entryFree id="1">a</entryFree>\ny <entryFree id="1">a</entryFree>\n', "text before an opening"),
    ],
)
def test_faults(spark, tmp_path, text, fault):
    (tmp_path / "f.xml").write_text(text)
    assert [r["fault"] for r in R.faults(R.records(spark, str(tmp_path))).collect()] == ([fault] if fault else [])


def test_dictionaries_of_entries(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<body>\n<entryFree id="e1" n="2"><orth>ā-mo</orth>, <orth> amo </orth><def>x</def><sense id="e1.1" level="1" n="I">to love<sense id="e1.2" level="2" n="A"><orth>amans</orth><b><orth>amatus</orth></b></sense></sense></entryFree>\n'
        '<entryFree id="e2"><b><orth>not a key</orth></b><orth>bos &amp; c</orth><orth/></entryFree>\n</body>\n',
        encoding="utf-8",
    )
    found = R.entries(R.records(spark, str(tmp_path)))
    raw = R.raw_entries(found, "ls", regular="^[^-]*$")
    one, two = sorted(raw.collect(), key=lambda r: r["id"])
    assert (one["id"], one["number"], one["keys"]) == ("e1", "2", ["amo"]) and (two["keys"], two["number"], two["senses"], two["derived"]) == (["bos & c"], None, [], [])
    assert [tuple(s) for s in one["senses"]] == [("e1.1", 1, "I"), ("e1.2", 2, "A")] and [(d["sense_id"], d["orths"]) for d in one["derived"]] == [("e1.2", ["amans", "amatus"])]
    assert [r["keys"] for r in R.raw_entries(found, "ls").where("id = 'e1'").collect()] == [["ā-mo", "amo"]]
    entries, orths = D.build(raw)
    assert entries.count() == 2 and sorted((r["id"], r["orth"], r["sense_id"]) for r in orths.collect()) == [("e1", "amans", "e1.2"), ("e1", "amatus", "e1.2"), ("e1", "amo", None), ("e2", "bos & c", None)]
    (tmp_path / "d.xml").write_text('<entryFree id="e3"><def>no key</def></entryFree>')
    with pytest.raises(PySparkException, match="without a key"):
        R.raw_entries(R.entries(R.records(spark, str(tmp_path))), "ls").collect()


def test_entries_between_empty_lines(spark, tmp_path):
    (tmp_path / "p.txt").write_text("\n\na\n* b \n\n\n\nc\n \nd\r\n\r\ne\n")
    rows = sorted(R.paragraphs(spark, str(tmp_path)).collect(), key=lambda r: (r["at"], r["row"]))
    assert [r["lines"] for r in rows] == [["a", "* b"], ["c"], ["d"], ["e"]]
