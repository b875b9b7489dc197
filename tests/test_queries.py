"""Every registered query against its DuckDB SQL, and the search rules against a plain Python matcher."""

import os

import duckdb
import pandas as pd
import pytest

from glyphspan.operators import lexicon, search
from glyphspan.plans import registry


def _rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else round(float(x), 9) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)
    return sorted(tuple(map(str, map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_as_sql(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.split('.')[0]} as select * from '{sf}/{file}'")
    want, got = con.execute(registry.ORACLE_SQL[name]).df(), registry.QUERIES[name](spark, sf).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert _rows(want) == _rows(got)


@pytest.fixture
def small(spark):
    rows = [(1, "A", "b a b. a a b a"), (2, "B", "a\nb, a b a b"), (3, "A", None), (4, "B", "")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_spans_stop_at_sentences_and_lines_do_not(small):
    got = search.spans(small, [search.word("a"), search.word("b")]).select("doc_id", "pos").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 4), (2, 0), (2, 2), (2, 4)]


def test_author_and_proximity(small):
    a, b = (search.spans(small, [search.word(x)], author="A") for x in "ab")
    assert sorted(r["pos"] for r in search.near(a, b, 1, directed=True).collect()) == [1, 4]
    assert sorted(r["pos"] for r in search.near(a, b, 1).collect()) == [1, 3, 4, 6]
    with pytest.raises(ValueError):
        search.near(a, b, 16)


def test_near_same_takes_the_next_partner_of_a_repeated_pair(spark):
    docs = spark.createDataFrame([(1, "A", "a x a x a")], "doc_id long, source string, text string")
    got = search.near_same(search.spans(docs, [search.word("a")]), 2).orderBy("pos").collect()
    assert [(r["pos"], r["other"]) for r in got] == [(0, 2), (2, 4)]


def test_templates():
    assert lexicon.expand_templates({"t": [("p", "base")]}, {"base": [("e", 1)]})["t"] == [("pe", 1)]
    with pytest.raises(ValueError):
        lexicon.expand_templates({"t": [("p", "t")]}, {})


def test_stream_appends_wanted_events(spark, sf, tmp_path):
    import shutil

    from glyphspan.streaming import events

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    events.append_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), batch.schema).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.wanted(batch).count()


def test_unknown_words_of_every_beginning(spark, sf):
    words = {r["word"] for r in registry.QUERIES["lexicon_unknown_words"](spark, sf).collect()}
    assert len({w[:2] for w in words}) > 1 and {r["word"] for r in registry.QUERIES["lexicon_anti_join"](spark, sf).collect()} == words


def test_near_same_over_all_documents(spark, sf):
    """A term near itself: anchors ascend and take the first partner whose pair was not the one before."""
    import re

    from glyphspan.functions import text as T

    docs, want = pd.read_parquet(f"{sf}/documents.parquet"), []
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = [w.lower() for w in re.findall(f"[^{T._SET}]+", text or "")]
        at, last = [i for i, w in enumerate(words) if w == "the"], None
        for p in at:
            for q in (q for q in at if q != p and abs(q - p) <= 5):
                if {p, q} != last:
                    last = {p, q}
                    want.append((doc_id, p, q))
                    break
    got = sorted(tuple(r) for r in registry.QUERIES["prox_self"](spark, sf).select("doc_id", "pos", "other").collect())
    assert got == sorted(want)
    spans = registry._found(spark, sf, "the 5~ the").select("doc_id", "pos", "spans").collect()
    assert sorted((r["doc_id"], r["pos"], next(s["pos"] for s in r["spans"] if s["pos"] != r["pos"])) for r in spans) == sorted(want)


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    """The stored corpus belongs to the files that it was built from, not to their path."""
    path = str(tmp_path)
    for words in ("one two three", "one two three four five six"):
        spark.createDataFrame([(1, "A", words)], "doc_id long, source string, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
        assert registry.QUERIES["token_stats"](spark, path).first()["total_words"] == len(words.split())


def test_phases_of_requests_and_repeated_files(spark, tmp_path):
    import datetime

    from glyphspan.streaming import events

    start = datetime.datetime(2024, 1, 1)
    rows = [(1, "search", 0), (1, "write", 2), (1, "end", 5), (2, "search", 1), (2, "end", 2), (1, "search", 10_000), (3, "search", 3)]
    marks = spark.createDataFrame([(r, p, start + datetime.timedelta(seconds=s)) for r, p, s in rows], "request long, phase string, ts timestamp")
    got = {r["phase"]: (r["requests"], r["mean_ms"], r["most_ms"]) for r in events.phase_durations(marks).collect()}
    assert got == {"search": (2, 1500.0, 2000.0), "write": (1, 3000.0, 3000.0)}
    sent = [(i, "Googlebot/2.1" if i == 3 else "Firefox", start + datetime.timedelta(seconds=i)) for i in range(6)]
    schema = "event_id long, agent string, ts timestamp"
    folders = [str(tmp_path / n) for n in ("in", "out", "state")]
    for _ in range(2):  # the same events come in two files
        spark.createDataFrame(sent, schema).coalesce(1).write.mode("append").parquet(folders[0])
        events.append_stream(spark, *folders, spark.createDataFrame([], schema).schema).awaitTermination()
    out = spark.read.parquet(folders[1]).collect()
    assert sorted(r["event_id"] for r in out) == [0, 1, 2, 4, 5] and all(r["received"] is not None for r in out)


def test_walks_of_several_spans_as_all_combinations():
    """The first combination, in order of places, that holds and is not the set before; repeated terms do not make it slow."""
    import itertools
    import random

    from glyphspan.plans.search import _paths

    def plain(leaders, lengths, reach):
        last, out = None, []
        for anchor in leaders[0]:
            for rest in itertools.product(*leaders[1:]):
                path = [anchor, *rest]
                near = all((0 if d else -k) <= b - a <= k for a, b, (k, d) in zip(path, rest, reach[1:], strict=False))
                spans = sorted((p, p + n) for p, n in zip(path, lengths, strict=True))
                if near and all(a[1] <= b[0] for a, b in itertools.pairwise(spans)) and sorted(path) != last:
                    last = sorted(path)
                    out.append((anchor, path))
                    break
        return out

    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(2, 5)
        some = [sorted(rng.sample(range(14), rng.randrange(0, 7))) for _ in range(n)]
        leaders = [some[0]] * n if rng.random() < 0.4 else some
        lengths, reach = [rng.randrange(1, 3) for _ in range(n)], [(rng.randrange(1, 6), rng.random() < 0.4) for _ in range(n)]
        assert list(_paths(leaders, lengths, reach)) == plain(leaders, lengths, reach)
    assert len(list(_paths([list(range(10))] * 10, [1] * 10, [(15, False)] * 10))) == 1
    assert not list(_paths([list(range(9))] * 10, [1] * 10, [(15, False)] * 10))


def test_negated_terms_take_away_from_the_others(spark):
    """Negations first, between and last, with authors and sentence ends, against a plain matcher."""
    import itertools

    from glyphspan.operators import tokens
    from glyphspan.plans import search as plans
    from glyphspan.sources import corpus as stored

    texts = [(1, "A", "a b c. a c b a"), (2, "B", "b a. c b b"), (3, "A", "c a b. b"), (4, "B", None), (5, "A", ""), (6, "A", "a")]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    analyses = lexicon.analyse(tokens.vocabulary(docs).withColumnRenamed("norm", "word"), lexicon.stems(spark, [("a", "a", "x", 0)]), lexicon.endings(spark, [("x", "", 0)]))
    c = stored.build(docs, stored.shared_folder(spark), analyses)
    for terms in [*itertools.product(["a", "!b", "!(a or c)", "!@lemma:a"], repeat=2), ("!a", "b", "!c"), ("!c", "!a", "b"), ("a", "!a", "!a")]:
        means = {"a": lambda w: w == "a", "b": lambda w: w == "b", "!a": lambda w: w != "a", "!b": lambda w: w != "b", "!c": lambda w: w != "c", "!(a or c)": lambda w: w == "b", "!@lemma:a": lambda w: w != "a"}
        for author in ("", "A"):
            want = []
            for doc_id, source, text in texts:
                words = [(w.strip("."), "." in w) for w in (text or "").split()]
                for p in range(len(words) - len(terms) + 1):
                    cut = any(end for _, end in words[p : p + len(terms) - 1])
                    if (not author or source == author) and not cut and all(means[t](words[p + i][0]) for i, t in enumerate(terms)):
                        want.append((doc_id, p))
            found = plans.matches(c, (f"[{author}] " if author else "") + " ".join(terms), extended=True)
            assert sorted(map(tuple, found.select("doc_id", "pos").collect())) == sorted(want), (terms, author)


def test_tasks_follow_the_size_of_texts(spark, tmp_path, monkeypatch):
    from glyphspan.operators import tokens as K
    from glyphspan.sources import corpus as C

    docs = spark.range(64).selectExpr("id AS doc_id", "'s' AS source", "repeat('the w' || id || ' of. ', 200) AS text").coalesce(1)
    one = K.tasks_for(docs)
    monkeypatch.setattr(K, "TEXT_AT_ONCE", 2_000)  # one piece of 160 kB: as many tasks as its size asks for
    assert one == spark.sparkContext.defaultParallelism and 64 <= K.tasks_for(docs) <= 90
    parts = C.Parts(docs, str(tmp_path / "corpus"))
    told = sorted(map(tuple, parts.told().select("doc_id", "pos", "norm", "hard_break").collect()))
    assert not (tmp_path / "corpus/tokens").exists()  # all tokens once: nothing is sorted and stored
    assert told == sorted(map(tuple, parts.tokens.select("doc_id", "pos", "norm", "hard_break").collect())) and len(told) == 64 * 600
    assert len(parts.tokens.inputFiles()) > 40  # those of `the` are in no 16 files alone
    assert parts.tokens.where("norm = 'the'").select("_metadata.file_path").distinct().count() > 8
