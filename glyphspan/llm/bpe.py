"""Byte-level BPE: encoding by ranked merges, decoding by concatenation.

Each distinct word of a task is cut into pieces and folded once: the adjacent pair of least rank is merged, leftmost
first, until none is left; documents are then put together from their words' ids.  All is narrow: nothing is shuffled,
the vocabulary is the only thing broadcast and no dictionary of the corpus is gathered anywhere.

``fold_merges`` is the same fold as Spark higher-order functions over the bytes of a column of words, ranks looked up in a
literal map (``encode_words`` applies it).  Spark interprets such folds step by step; over all documents they passed the
limits of memory and CPU (figures in the README), so ``encode`` folds inside Arrow tasks.

Cases: null text is empty and has no ids; pieces longer than ``LONG`` bytes (texts without any break) are merged by a
heap, exactly as the fold does; at most ``KEPT`` words are remembered, then all are forgotten, a bound of memory without
effect on results; rows repeating an id stay apart; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspan.llm.common import let, unused

BUCKETS = 1 << 16
LONG = 200
KEPT = 300_000
CHARS = 4_000_000
#: White space as Unicode defines it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=8)
def _class_of(major: str) -> str:
    """The characters of a Unicode major category as ranges of a regular expression's set."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == major
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


@functools.lru_cache(maxsize=8)
def compiled(pattern: str) -> re.Pattern:
    r"""A tokenizer's pattern with \p{L}, \p{N}, \s and \S spelt out, so that Python's own engine takes it."""
    sets = {r"\p{L}": _class_of("L"), r"\p{N}": _class_of("N"), r"\s": _SPACE}
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = next((k for k in (*sets, r"\S") if pattern.startswith(k, i)), pattern[i])
        if token == "[" or token == "]":
            inside = token == "["
        out.append(f"[^{_SPACE}]" if token == r"\S" else token if token not in sets else sets[token] if inside else f"[{sets[token]}]")
        i += len(token)
    return re.compile("".join(out))


_lone = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def words_of(text: str) -> list[str]:
    """The text cut before each blank that stands alone between two other characters; no piece of a pattern crosses such a place."""
    words = text.split(" ")
    if all(w and not w[0].isspace() and not w[-1].isspace() for w in words):
        return [words[0], *map(" ".__add__, words[1:])] if len(words) > 1 else words
    cuts = [m.start() for m in _lone.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges with a heap over a linked list: least rank first, leftmost first among equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if end[i] != middle or middle >= n or end[middle] != stop:
            continue  # one of the two has changed since
        end[i], end[middle] = stop, -1
        after[i] = stop
        if stop < n:
            before[stop] = i
        for a in (before[i], i):
            if a >= 0 and (b := end[a]) < n and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _rank_lookup(ranks: dict[bytes, int]):
    """Function from a Column of byte text to its rank, or null."""
    table: list[dict[str, int] | None] = [None] * BUCKETS
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        slot = xxhash.xxh64_intdigest(key.encode(), 42) & (BUCKETS - 1)
        table[slot] = (table[slot] or {}) | {key: rank}
    literal = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<map<string,int>>")
    return lambda b: F.try_element_at(F.get(literal, F.xxhash64(b).bitwiseAND(BUCKETS - 1).cast("int")), b)


def fold_merges(word: Column, rank) -> Column:
    """Array of ids of one word of bytes: a fold that merges the adjacent pair of least rank, leftmost first, until none is left."""

    def pairs(parts: Column) -> Column:
        return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: rank(F.concat(p, F.get(parts, i + 1))))

    def step(parts: Column, ranks: Column) -> Column:
        def merged(at: Column) -> Column:
            return F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(F.get(parts, at - 1), F.get(parts, at))), F.slice(parts, at + 2, F.size(parts)))

        return let(F.array_position(ranks, F.array_min(ranks)).cast("int"), merged)

    def turn(state: Column, _: Column) -> Column:
        go = F.when(F.size(state["parts"]) < 2, F.lit(None)).otherwise(pairs(state["parts"]))
        work = let(
            F.struct(go.alias("r")),
            lambda x: F.when(F.array_min(x["r"]).isNull(), F.struct(state["parts"].alias("parts"), F.lit(True).alias("done"))).otherwise(
                F.struct(step(state["parts"], x["r"]).alias("parts"), F.lit(False).alias("done"))
            ),
        )
        return F.when(state["done"], state).otherwise(work)

    size = F.char_length(word)
    parts = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(word, i, F.lit(1)))
    start = F.struct(parts.alias("parts"), F.lit(False).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), size), start, turn, lambda s: F.transform(s["parts"], rank))
    return let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded))


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", ids: str = "ids") -> DataFrame:
    """Add ``ids`` to a table of words given as bytes: the fold by Spark's own functions, without Python."""
    return words.withColumn(ids, fold_merges(F.decode(F.col(word), "ISO-8859-1"), _rank_lookup(ranks)))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: a fold that merges the adjacent pair of least rank, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n > LONG:
        return merge_long(piece, ranks)
    rank, none = ranks.get, len(ranks) + 1_000_000
    cuts = list(range(n + 1))
    pairs = [rank(piece[i : i + 2], none) for i in range(n - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i:
            pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], none)
        if i < len(pairs):
            pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], none)
    return [ranks[piece[a:b]] for a, b in itertools.pairwise(cuts)]


class Words:
    """Ids of the distinct words a task has met, one after another in one array."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, compiled(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts = array("i"), array("q", [0])

    def learn(self, words: Iterable[str]) -> None:
        for word in words:
            self.at[word] = len(self.at)
            for piece in self.find(word):
                self.flat.extend(merge(piece.encode("utf-8", "surrogatepass"), self.ranks))
            self.starts.append(len(self.flat))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > KEPT:
            self.forget()
        cut = [words_of(t) if t else [] for t in texts]
        self.learn({w: None for words in cut for w in words if w not in self.at})
        flat, starts = np.array(self.flat, np.int32), np.array(self.starts, np.int64)
        out = []
        for words in cut:
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            index, _ = gather(starts[at], starts[at + 1] - starts[at])
            out.append(flat[index])
        return out


def _some(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, about ``CHARS`` characters at a time."""
    now, size = [], 0
    for t in texts:
        now.append(t or "")
        size += len(now[-1])
        if size > CHARS:
            yield now
            now, size = [], 0
    if now:
        yield now


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, each match of the pattern merged by itself, without special tokens."""
    kind = df.schema[doc_id].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value, pattern)
        for batch in batches:
            at = 0
            for texts in _some(batch.column(1).to_pylist()):
                ids = words.ids(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], ["doc_id", "ids"])
                at += len(texts)

    out = df.select(F.col(doc_id), F.col(text)).mapInArrow(encoded, f"doc_id {kind}, ids array<int>")
    return out.select(F.col("doc_id").alias(doc_id), "ids")


def gather(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Indices of the runs start, start + 1, ... of the given sizes, one run after another."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total), total


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (a name ``df`` has not), the bytes of each row's ids one after another; an id without a token is an error."""
    unused(df, out)
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = df.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("binary")
    def concatenated(rows: pd.Series) -> pd.Series:
        piece = shared.value.__getitem__
        return pd.Series([None if r is None else b"".join(map(piece, r.tolist())) for r in rows], dtype=object)

    return df.withColumn(out, concatenated(F.col(ids)))
