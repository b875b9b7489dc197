"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, in every text and over the corpus.

Tokenising gives each text's ids and the byte offsets where its tokens end, for a byte-level BPE (A) and a SentencePiece
model with byte fallback (B).  The offsets where both end cut the tokens into groups; between two neighbouring offsets where
either ends lies exactly one overlap of an A and a B token, so each such stretch is one link.  Which token covers an offset is
found by a sorted search over the ends of a block's tokens, in Numpy inside the Arrow tasks that tokenise.

Tokenising cuts texts into words (from a space after a non-space up to the next such place; neither tokenizer's tokens cross
these places: that this holds for the vocabularies is checked, otherwise a text is one word).  A worker looks up the tokens
of words that it met before, up to ``WORDS`` of them, and takes texts in blocks of about ``BLOCK`` characters: each different
word of a block once, with its tokens, and each text as places of words.  So words are aligned once in a block.

Counts of linked id pairs are added up over the corpus.  To give each link its pair's count, the commonest pairs, up to
``HOT`` of them, are broadcast, and the links of the rest are joined by their pair: so no frequent pair is dealt to one task,
and what is broadcast is bounded whatever the corpus.

Scale: texts are read once and not shuffled; stored are links as arrays of pairs of ids (dictionary-encoded) and a digest of the
groups.  Shuffled are counts of pairs, the links of uncommon pairs, and a row for each text.

Cases: a text that is null or empty, or whose joined token bytes are not its own (as where B reads U+2581 as a space, or
changes what it reads), has no tokens: zeros and an empty digest; special tokens' strings are ordinary text; repeated rows
and rows without id are each aligned; an empty table gives none; columns of ``keep`` pass through, and an existing name of
a new column is an error; a text must fit in a task (about 50 bytes for each of its bytes while it is aligned).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from glyphspan.llm.common import fresh, stored, unused

#: Words whose tokens a worker keeps.
WORDS = 200_000
#: Pairs of ids that are broadcast.
HOT = 400_000
#: Characters of texts that are handed over at once.
BLOCK = 2_000_000
#: A space after what is no white space: no token of either tokenizer reaches over it.
_CUT = re.compile(r"(?<=\S)(?= )")
_LOOSE = re.compile(r"\s ")
#: What is told of a word: ids, sizes in bytes and byte ends of the tokens of both.
TOKENS = ("a", "a_sizes", "a_ends", "b", "b_sizes", "b_ends")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a SentencePiece piece."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Words:
    """Tokens of the words met so far: ids and byte ends of all, one after another."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]):
        self.encode, self.token_bytes = encode, token_bytes
        self.size_of = np.array([len(b) for b in token_bytes], np.int32)
        self.clear()

    def clear(self) -> None:
        self.ids, self.start, self.many, self.right = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.used = self.words = 0

    @staticmethod
    def _put(array: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
        """The array with ``more`` from a place on, in a copy of twice the room where it lacks room."""
        if at + len(more) > len(array):
            array = np.concatenate([array[:at], np.empty(at + 2 * len(more) + 4096, array.dtype)])
        array[at : at + len(more)] = more
        return array

    def add(self, words: list[str]) -> None:
        """Append the tokens of words, each with the space before it; which of them give their own bytes back is kept, too."""
        found = self.encode(words)
        many = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(many.sum()))
        name = self.token_bytes.__getitem__
        right = np.fromiter((b"".join(map(name, x)) == w.encode() for x, w in zip(found, words, strict=True)), bool, len(words))
        self.ids = self._put(self.ids, self.used, ids)
        self.start, self.many, self.right = self._put(self.start, self.words, self.used + np.cumsum(many) - many), self._put(self.many, self.words, many), self._put(self.right, self.words, right)
        self.used, self.words = self.used + len(ids), self.words + len(words)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words at these places, one after another; how many of each word)."""
        many = self.many[at]
        first = np.cumsum(many) - many
        return self.ids[np.repeat(self.start[at] - first, many) + np.arange(many.sum())], many


def json_vocabulary(path: str) -> list[bytes]:
    """The bytes of each entry of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocabulary, alphabet = json.load(f)["model"]["vocab"], byte_alphabet()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


def rank_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None, pattern: str | None):
        if a_ranks is not None:
            ranks = rank_vocabulary(a_ranks)
            a_bytes = sorted(ranks, key=ranks.__getitem__)
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            encode_a = lambda words: [fast.encode_ordinary(w) for w in words]
        else:
            from tokenizers import Tokenizer  # its memory is spared where ranks are given

            whole, a_bytes = Tokenizer.from_file(a_path), json_vocabulary(a_path)
            whole.encode_special_tokens = True
            encode_a = lambda words: [e.ids for e in whole.encode_batch(words, add_special_tokens=False)]
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        self.a = Words(encode_a, a_bytes)
        space = [pieces.piece_to_id("▁")]  # a lone space is the one that B puts before a text, even where none follows
        encode_b = lambda words: [e if w != " " else space for w, e in zip(words, pieces.encode([w[1:] for w in words], num_threads=1), strict=True)]
        self.b = Words(encode_b, [piece_bytes(p) for p in names])
        tokens = [*(b.decode("utf-8", "ignore") for b in a_bytes), *(p.replace("▁", " ") for p in names)]
        self.by_word = not any(_CUT.search(t) for t in tokens)
        self.at: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """A text with the space before it, cut where no token reaches over."""
        if not self.by_word:
            return [" " + text]
        if _LOOSE.search(" " + text):
            return _CUT.split(" " + text)
        return [" " + w for w in text.split(" ")]

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all words, how many of each text)."""
        if len(self.at) > WORDS:
            self.at.clear()
            self.a.clear()
            self.b.clear()
        each = [self.words(t) for t in texts]
        at, have = self.at, len(self.at)
        places = np.array([at.setdefault(w, len(at)) for words in each for w in words], np.int64)
        new = list(islice(at, have, None))
        self.a.add(new)
        self.b.add(new)
        return places, np.array([len(w) for w in each], np.int64)

    def block(self, texts: list[str]) -> tuple[pa.StructArray, list[pa.Array]]:
        """(tokens of the block's different words; n_a, n_b and the places of the words of each text, none if a text is not given back)."""
        at, words = self.look_up(texts)
        text_of = np.repeat(np.arange(len(texts)), words)
        right = np.array([t != "" for t in texts], bool)
        right[text_of[~(self.a.right[at] & self.b.right[at])]] = False
        at, text_of = at[right[text_of]], text_of[right[text_of]]
        different, place = np.unique(at, return_inverse=True)
        tokens, counts = [], []
        for side in (self.a, self.b):
            ids, many = side.of(different)
            stop = np.cumsum(many)
            run = np.cumsum(side.size_of[ids], dtype=np.int64)
            ends = run - np.repeat(np.concatenate([[0], run])[stop - many], many)
            offsets = pa.array(np.concatenate([[0], stop]).astype(np.int32))
            tokens += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, side.size_of[ids], ends)]
            counts.append(pa.array(np.bincount(text_of, side.many[at], len(texts)).astype(np.int64)))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(texts)))]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))
        return pa.StructArray.from_arrays(tokens, names=list(TOKENS)), [*counts, places]


@functools.lru_cache(maxsize=2)
def _pair(*how) -> Pair:
    return Pair(*how)


def _runs(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places of runs, one after another: ``many`` places from each ``start`` on."""
    first = np.cumsum(many) - many
    return np.repeat(start - first, many) + np.arange(many.sum())


@functools.lru_cache(maxsize=8)
def _told(most: int, mark: str) -> pa.Array:
    """Each id as text, with a mark behind it."""
    return pa.array([f"{i}{mark}" for i in range(most)])


def aligned(words: pa.StructArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(links of all words, in order of their bytes; how many of each word; the groups of each as text, a semicolon behind each).

    A link holds A's id in the upper and B's in the lower half of a number.  Ends of tokens are counted from the first word's
    start on, so one sorted search over all words tells which token covers the bytes before an end.
    """
    flat = lambda name: words.field(name).flatten().to_numpy()
    (a, a_ends), (b, b_ends) = ((flat(side).astype(np.int64), flat(f"{side}_ends").astype(np.int64)) for side in "ab")
    many_a, many_b = (np.diff(words.field(side).offsets.to_numpy()) for side in "ab")
    size = a_ends[np.cumsum(many_a) - 1] if len(words) else np.empty(0, np.int64)
    stop = np.cumsum(size)
    a_ends, b_ends = a_ends + np.repeat(stop - size, many_a), b_ends + np.repeat(stop - size, many_b)
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two ordered runs
    ends = ends[np.diff(ends, prepend=-1) > 0]
    at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    links = (a[at_a] << 32) | b[at_b]
    until = np.searchsorted(ends, stop, "right")
    common = (a_ends[at_a] == ends) & (b_ends[at_b] == ends)
    # groups: A's tokens, then B's; behind a token stands a comma, or the mark of its side's last
    last_a, last_b = at_a[common], at_b[common]
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    from_a = np.cumsum(in_a + in_b) - in_a - in_b
    spelled = np.empty(len(a) + len(b), np.int64)  # places in a table of all ids with each mark
    most = int(max(a.max(initial=0), b.max(initial=0))) + 1
    most = 1 << (most - 1).bit_length() if most > 1 else 1
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = most, 2 * most
    spelled[_runs(from_a, in_a)] = a + mark_a
    spelled[_runs(from_a + in_a, in_b)] = b + mark_b
    table = pa.concat_arrays([_told(most, m) for m in ",|;"])
    each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many_a + many_b)]).astype(np.int32)), table.take(pa.array(spelled)))
    return links, np.diff(until, prepend=0), pc.binary_join(each, "")


def linked(words: pa.StructArray, places: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """(links, digest of the groups) of each text, a text being places of words; no links and an empty digest for one without words."""
    links, many, groups = aligned(words)
    at, offsets = places.flatten().to_numpy(), places.offsets.to_numpy()
    found = links[_runs((np.cumsum(many) - many)[at], many[at])]
    ends = np.concatenate([[0], np.cumsum(many[at])])[offsets]
    texts = pc.binary_join(pa.ListArray.from_arrays(places.offsets, groups.take(pa.array(at))), "").cast(pa.binary())
    cut, letters = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1], memoryview(texts.buffers()[2] or b"")
    digests = [hashlib.sha256(letters[i : j - 1]).hexdigest() if j > i else "" for i, j in pairwise(cut.tolist())]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found)), pa.array(digests, pa.string())


def linked_texts(df: DataFrame, how: tuple, text: str, keep: list[str]) -> DataFrame:
    """(the columns of ``keep`` as ``row``, n_a, n_b, links, groups_sha256) of each text."""
    kept = df.select(F.struct(*keep).alias("row"), F.col(text).alias("text")) if keep else df.select(F.struct(F.lit(0).alias("_")).alias("row"), F.col(text).alias("text"))
    told = [StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("links", ArrayType(LongType())), StructField("groups_sha256", StringType())]
    names = ["row", *(f.name for f in told)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*how)
        for batch in batches:
            values, start, size = [], 0, 0
            for i, t in enumerate(batch.column("text")):
                values.append(t.as_py() or "")
                size += len(values[-1])
                if size >= BLOCK or i + 1 == len(batch):
                    words, (n_a, n_b, places) = pair.block(values)
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(start, len(values)), n_a, n_b, *linked(words, places)], names=names)
                    values, start, size = [], i + 1, 0

    return kept.mapInArrow(encode, StructType([kept.schema["row"], *told]))


def align(
    df: DataFrame,
    a_path: str,
    b_path: str,
    a_ranks: str | None = None,
    pattern: str | None = None,
    text: str = "text",
    keep: list[str] | None = None,
    hot: int = HOT,
) -> DataFrame:
    """The columns of ``keep`` (all, if none is named), n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    ``a_ranks`` and ``pattern`` may name the same vocabulary as A's in the form of ranks, which is encoded faster."""
    keep = df.columns if keep is None else keep
    unused(df.select(keep), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    if a_ranks is not None:
        names = json_vocabulary(a_path)
        if any(r >= len(names) or names[r] != t for t, r in rank_vocabulary(a_ranks).items()):
            raise ValueError(f"{a_ranks} holds another vocabulary than {a_path}")
    row, links = fresh(df, "__row"), fresh(df, "__links")
    size = lambda c: F.size(c).cast("long")
    told = linked_texts(df, (a_path, b_path, a_ranks, pattern), text, keep)
    # each group of n and m tokens has n + m - 1 links, as no end inside it is common
    groups = F.col("n_a") + F.col("n_b") - size("links")
    told = told.select(*(F.col("row")[c].alias(c) for c in keep), "n_a", "n_b", groups.alias("n_groups"), F.col("links").alias(links), "groups_sha256", F.monotonically_increasing_id().alias(row))
    texts = stored(told, "links", "zstd", **{"parquet.dictionary.page.size": 1 << 24})
    each = texts.select(row, F.explode(links).alias("pair"))
    counts = stored(each.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs").withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary
    pairs = stored(counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "counts")
    # the commonest pairs, as many halvings of the count down as stay within the bound
    bits = F.floor(F.log2("n")).cast("int")
    least, within = 64, 0
    for r in pairs.groupBy(bits.alias("bits")).count().orderBy(F.desc("bits")).collect():  # 64 rows at most
        within += r["count"]
        if within > hot:
            break
        least = r["bits"]
    common, rest = pairs.where(bits >= least), pairs.where(bits < least)
    sums = [F.sum("n").alias("count_sum"), F.sum("best").alias("n_best")]
    found = each.join(F.broadcast(common), "pair").groupBy(row).agg(*sums)
    if not rest.isEmpty():
        left = each.join(F.broadcast(common.select("pair")), "pair", "left_anti").groupBy(row, "pair").agg(F.count(F.lit(1)).alias("times"))
        seldom = left.join(rest.hint("merge"), "pair").select(row, (F.col("n") * F.col("times")).alias("n"), (F.col("best") * F.col("times")).alias("best"))
        found = found.unionByName(seldom.groupBy(row).agg(*sums)).groupBy(row).agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = texts.select(*keep, "n_a", "n_b", "n_groups", size(links).alias("n_links"), "groups_sha256", row).join(found, row, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(*keep, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
