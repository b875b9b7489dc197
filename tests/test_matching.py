"""Longest matches with contexts and citations, against plain Python that walks along each text."""

import random

from glyphspan.operators import matching as G
from glyphspan.plans import registry


def _fits(text, at, key, prefix, postfix):
    end = at + len(key)
    return (prefix is None or (at >= len(prefix) and text[at - len(prefix) : at] == prefix)) and (postfix is None or text[end : end + len(postfix)] == postfix)


def _best(text, at, keys, low=False):
    """(length, meanings) of the longest key at a place, or None."""
    if at and text[at - 1] not in G.STARTS:
        return None
    t = text.lower() if low else text
    found = [k for k in keys if t.startswith(k[0].lower() if low else k[0], at) and _fits(text, at, k[0], k[2], k[3])]
    if not found:
        return None
    size = max(len(k[0]) for k in found)
    return size, sorted({(k[0], k[1], k[4]) for k in found if len(k[0]) == size})


def _expansions(text, keys, low=False):
    out, at = [], 0
    while at < len(text):
        best = _best(text, at, keys, low)
        if best:
            out.append((at, *best))
            at += best[0]
        else:
            at += 1
    return out


KEYS = [
    ("a", "A1", None, None, False), ("ab", "A2", None, None, False), ("ab", "A3", None, None, False), ("abcdef", "A4", None, None, False), ("ab c", "A5", None, "d", False),
    ("ab", "A6", "(", None, True), ("c", "C1", "b ", None, False), ("é", "E1", None, None, False), ("bcd", "B1", None, " a", False), ("B", "B2", None, None, False), ("abcd", "A7", None, ".", True),
]
COLUMNS = "key string, value string, prefix string, postfix string, replace boolean"


def test_expansions_over_random_texts(spark):
    rng = random.Random(11)
    texts = [None, "", "a", "ab", *("".join(rng.choices(["a", "b", "c", "d", "ab", "abc", "abcdef", " ", "(", ")", "-", ";", "é", ".", "B"], k=rng.randrange(1, 25))) for _ in range(500))]
    df, keys = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(KEYS, COLUMNS)
    for low in (False, True):
        got = {}
        for r in G.expansions(df, keys, ignore_case=low).collect():
            got.setdefault(r["doc_id"], []).append((r["at"], r["size"], [tuple(v) for v in r["values"]]))
        want = {i: e for i, t in enumerate(texts) if (e := _expansions(t or "", KEYS, low))}
        assert {i: sorted(v) for i, v in got.items()} == want and len(want) > 300
    plain = {}
    for i, t in enumerate(texts):
        out, at = "", 0
        for start, size, values in _expansions(t or "", KEYS):
            if len(values) == 1:
                own = t[start : start + size]
                out += t[at:start] + (values[0][1] if values[0][2] else f"{own} [{values[0][1]}]")
                at = start + size
        plain[i] = None if t is None else out + t[at:]
    assert {r["doc_id"]: r["expanded"] for r in G.expanded_texts(df, keys).collect()} == plain
    assert G.expansions(df, keys.limit(0)).collect() == []


AUTHORS = [("Cic.", "Cicero"), ("C.", "Caesar"), ("C.", "Cicero"), ("V. Max.", "Valerius"), ("V.", "Vergil")]
WORKS = [("Cicero", "Or.", "Orator"), ("Cicero", "Off.", "De Officiis"), ("Caesar", "B. G.", "De Bello Gallico"), ("Vergil", "A.", "Aeneis"), ("Vergil", "A. 1", "Aeneis I"), ("Valerius", "A.", "Facta"), ("Cicero", "A.", "Academica")]


def test_citations(spark):
    texts = ["Cic. Or. 1, 2; Off. 3; id. A.", "C. B. G. 7, C. Or. 2, C. A. 9", "A. 4; V. A. 1, 1; V. Max. A. 2; A. 3; B. G. 1", "nothing; id. x", None, "V. Or. 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = G.citations(df, spark.createDataFrame(AUTHORS, "key string, author string"), spark.createDataFrame(WORKS, "author string, key string, work string"), carry=("id.",))
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["at"], texts[r["doc_id"]][r["at"] : r["at"] + r["size"]], r["author"], r["work"], r["carried"]))
    got = {k: [x[1:] for x in sorted(v)] for k, v in got.items()}
    assert got[0] == [("Cic. Or.", "Cicero", "Orator", False), ("Off.", "Cicero", "De Officiis", True), ("id. A.", "Cicero", "Academica", True)]
    assert got[1] == [("C. B. G.", "Caesar", "De Bello Gallico", False), ("C. Or.", "Cicero", "Orator", False), ("C. A.", "Cicero", "Academica", False)]
    assert got[2] == [("V. A. 1", "Vergil", "Aeneis I", False), ("V. Max. A.", "Valerius", "Facta", False), ("A.", "Valerius", "Facta", True)]
    assert got[3] == [("id.", None, None, True)] and 4 not in got
    assert got[5] == [("V.", "Vergil", None, False)]


def test_keys_in_all_turns(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    keys = [(k, v, p, q, False) for k, v, p, q in registry.SHORT_FORMS]
    want = sorted((r["conv_id"], r["turn"], at, size, ",".join(v[1] for v in values)) for r in rows for at, size, values in _expansions(r["text"] or "", keys))
    got = sorted(map(tuple, registry.QUERIES["short_forms"](spark, sf).select("conv_id", "turn", "place", "size", "meanings").collect()))
    assert got == want and len(want) > 100
