"""Alignment of two tokenizers against plain Python that compares all ranges of tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glyphspan.llm import alignment
from glyphspan.llm.queries import QUERIES

A, B, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _ranges(both, text):
    """(tokens of A, tokens of B) as (id, start, end), or two empty lists."""
    a, b = both
    if not text:
        return [], []
    sides, plain = [], [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    for ids, told in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(value[c] for c in a.id_to_token(i))), (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
        tokens, at, whole = [], 0, b""
        for i in ids:
            tokens.append((i, at, at + len(told(i))))
            at += len(told(i))
            whole += told(i)
        if whole != (" " + text).encode():
            return [], []
        sides.append(tokens)
    return sides


def _plain(both, texts):
    every, count = [], Counter()
    for text in texts:
        ta, tb = _ranges(both, text)
        links = [(x[0], y[0]) for x in ta for y in tb if x[1] < y[2] and y[1] < x[2]] if len(ta) < 3000 else None
        if links is None:  # the same by walking along both
            links, j = [], 0
            for x in ta:
                while tb[j][2] <= x[1]:
                    j += 1
                k = j
                while k < len(tb) and tb[k][1] < x[2]:
                    links.append((x[0], tb[k][0]))
                    k += 1
        every.append((ta, tb, links))
        count.update(links)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for ta, tb, links in every:
        cuts = sorted({x[2] for x in ta} & {y[2] for y in tb})
        groups, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(ta) and ta[i][2] <= c:
                ga.append(str(ta[i][0]))
                i += 1
            while j < len(tb) and tb[j][2] <= c:
                gb.append(str(tb[j][0]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else ""
        out.append((len(ta), len(tb), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out


def _pieces():
    return ["a", "the", " ", " ", "  ", "\n", "\t", " ", " ", "é", "漢字", "\U0001f600", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", "123", "...", "ing", "\x00", "\x1c", "\r\n", "ﬁ", "é", "﻿", "Ω", "x" * 30]


def test_texts_of_all_kinds(spark, both):
    rng = random.Random(5)
    texts = [None, "", " ", "  ", "\n", "a ", " a", "a  ", "\n ", " \n", "a \n b", "a▁b", "▁", "the " * 20_000, *("".join(rng.choices(_pieces(), k=rng.randrange(1, 30))) for _ in range(800))]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((r[0], *w) for r, w in zip(rows, _plain(both, texts), strict=True)), key=str)
    assert sum(w[1] > 0 for w in want) > 400
    for how in ({"hot": 10**6}, {"hot": 20}, {"hot": 0}, {"a_ranks": RANKS, "pattern": public_tokenizers.PATTERN}):
        got = alignment.align(df, A, B, keep=["doc_id"], **how)
        assert tuple(got.columns) == ("doc_id", *COLUMNS)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_few_words_are_kept(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 10)
    pair = alignment.Pair(A, B, RANKS, public_tokenizers.PATTERN)
    assert pair.by_word
    texts = [f"some words{i} and the  same \n again " * 3 for i in range(30)]
    for by_word, some in ((True, texts[:1]), (True, texts[1:3]), (True, texts[3:]), (True, texts), (False, texts)):
        pair.by_word = by_word
        words, (n_a, n_b, places) = pair.block(some)
        words = words.to_pylist()
        for i, t in enumerate(some):
            for side, n, want in zip("ab", (n_a, n_b), _ranges(both, t), strict=True):
                got, at = [], 0
                for w in (words[j] for j in places[i].as_py()):
                    got += [(x, at + e) for x, e in zip(w[side], w[side + "_ends"], strict=True)]
                    at = got[-1][1]
                assert got == [(x[0], x[2]) for x in want] and n[i].as_py() == len(want)


def test_other_ranks_are_refused(spark):
    with pytest.raises(ValueError):
        alignment.align(spark.createDataFrame([(1, "a")], "doc_id long, text string"), A, B, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_cases(spark):
    df = spark.createDataFrame([(1, "a house"), (1, "a house"), (None, "a house"), (2, None)], "doc_id long, text string")
    out = alignment.align(df, A, B)
    assert tuple(out.columns) == ("doc_id", "text", *COLUMNS)
    rows = sorted(map(tuple, out.collect()), key=str)
    assert len(rows) == 4 and rows[0][2:] == rows[1][2:] == rows[3][2:] and rows[2][2:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.align(df.limit(0), A, B).collect() == []
    with pytest.raises(ValueError):
        alignment.align(df.withColumn("N_A", df["doc_id"]), A, B)
    odd = df.withColumn("__row", df["doc_id"]).withColumn("__a", df["doc_id"]).withColumn("n_a", df["text"])
    assert alignment.align(odd, A, B, keep=["doc_id", "__row", "__a"]).count() == 4


def test_whole_query(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_alignment"](spark, sf).collect()}
    assert got == {d["doc_id"]: w for d, w in zip(docs, _plain(both, [d["text"] for d in docs]), strict=True)}


def test_words_are_aligned_in_the_tasks_that_tokenise(spark, both, capsys):
    pair = alignment.Pair(A, B, RANKS, public_tokenizers.PATTERN)
    texts = ["the house", "", "a▁b", "the house of é", "   漢字 "]
    words, (_, _, places) = pair.block(texts)
    links, digests = alignment.linked(words, places)
    for t, found, digest, want in zip(texts, links.to_pylist(), digests.to_pylist(), _plain(both, texts), strict=True):
        ta, tb = _ranges(both, t)
        assert found == [x[0] << 32 | y[0] for x in ta for y in tb if x[1] < y[2] and y[1] < x[2]] and digest == want[6]
    told = alignment.linked_texts(spark.createDataFrame([(1, "a house")], "doc_id long, text string"), (A, B, RANKS, public_tokenizers.PATTERN), "text", ["doc_id"])
    told.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "lambda" not in plan  # no function over arrays is interpreted
