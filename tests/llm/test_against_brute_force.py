"""The operators over a small table, held against plain Python versions written from the definitions."""

import base64
import hashlib
import itertools
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

queries = pytest.importorskip("glyphspan.llm.queries")


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def test_bpe_as_tiktoken(spark, sf, docs):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = queries.op6_bpe(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        row = got.loc[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_merges_as_spark_functions(spark):
    from glyphspan.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    words = [w.encode() for w in (" schbeauß", "a", " ¿qué", "xxxxxxxxxxxxxxx", "漢字", "\n\n", " the")]
    table = spark.createDataFrame([(w,) for w in words], "word binary")
    got = {bytes(r["word"]): r["ids"] for r in bpe.encode_words(table, ranks).collect()}
    assert got == {w: bpe.merge(w, ranks) for w in words} == {w: bpe.merge_long(w, ranks) for w in words}


def test_packing_holds_every_token_once(spark, sf, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op7_packing(spark, sf).toPandas()
    pieces = got.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert set(got["doc_id"]) == set(docs["doc_id"])
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = pieces.get_group(doc_id)
        assert (own["doc_tokens"] == len(ids)).all()
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == len(ids)
        for a, n, crc in zip(own["start"], own["length"], own["ids_crc32"], strict=True):
            assert zlib.crc32(ids[a : a + n].tobytes()) == crc
    by = got.sort_values("offset").groupby("sequence_id")
    assert by["length"].sum().max() <= 2048
    assert all(g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] for _, g in by)
    total = by["length"].sum()
    padding = sum(2048 - n for n in total if n & (n - 1))
    assert padding <= 0.01 * total.sum()


def _fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fingerprints):
    """Least id reachable over links of at most three bits, by looking at all pairs."""
    root = {i: i for i in fingerprints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations(fingerprints.items(), 2):
        if (x ^ y).bit_count() <= 3:
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return {i: find(i) for i in fingerprints}


def test_simhash_links(spark, sf, docs):
    got = queries.op4_simhash(spark, sf).toPandas().set_index("doc_id")
    want = {d: _fingerprint(t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert {d: f"{f:016x}" for d, f in want.items()} == got["fingerprint"].to_dict()
    assert _components(want) == got["component_id"].to_dict()


def test_nearest_neighbours_recall(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    got = queries.op5_ann_cross_polytope(spark, sf).toPandas()
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        exact = (x * x[at]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -exact)) if j != at][:20]
        own = got[got["query_id"] == ids[at]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own["score"].is_monotonic_decreasing
        place = {int(i): n for n, i in enumerate(ids)}
        assert np.allclose(own["score"], [exact[place[v]] for v in own["vec_id"]], atol=1e-12, rtol=0)
        hits += len(set(own["vec_id"]) & set(ids[order].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_languages_and_quality_of_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    got = queries.op2_language_id(spark, sf).toPandas().merge(docs, on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    held = got[got["held_out"] & got["lang"].notna() & got["text"].fillna("").str.contains("[A-Za-z]{3}")]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    scored = queries.op3_quality_crf(spark, sf).toPandas().merge(labels, on="doc_id")
    held = scored[scored["held_out"]]
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.9
    assert ((scored["score"] >= 0.3) == (scored["predicted"] == 1)).all() and scored["score"].between(0, 1).all()


def test_media_keep_every_byte(spark, sf, docs):
    got = queries.op9_progressive_jpeg(spark, sf).toPandas().set_index("doc_id")
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        data = (text or "").encode()
        stored = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        row = got.loc[doc_id]
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(data), len(stored), zlib.crc32(stored[-32:]))
        assert row["payload_sha256"] == hashlib.sha256(stored).hexdigest()


def test_chat_and_warc_as_sql(spark, sf):
    import duckdb

    for name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for table in ("conversations", "pages"):
            con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
        want = con.execute(queries.ORACLE_SQL[name]).df()
        got = queries.QUERIES[name](spark, sf).toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False)))
        whole = lambda d: d.assign(**{c: d[c].astype("Int64") for c in d.columns if c in ("refers_to", "page_id", "conv_id")})
        assert rows(whole(got)) == rows(whole(want))
