"""Packing instruction data into sequences: vector bin packing with the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence has a limit in each.  The next example put
into a sequence is, of those that fit, the one whose vector has the largest weighted dot product with what is left of
the limits; a dimension weighs what the waiting examples demand of it on average.  When none fits, the best one is cut.
A sequence that cannot be filled (its segment limit is reached, or no example is left) is divided at powers of two, whose
lengths need no padding.

Each task packs its own rows in windows of ``WINDOW`` examples; what is open is carried on to the next window.  Nothing is
shuffled, and sequence numbers come from the partition's number, so a task that runs again gives the same rows.

Cases: null text is empty and has only its final id; long texts fill sequences by themselves and only their rest waits;
rows repeating an id are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspan.llm.bpe import compiled, gather

WINDOW = 2048
_KEPT = 1_000_000
_workers: dict = {}


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Numbers(dict):
    """Numbers its keys from 0 in the order in which they are first asked for; ``new`` holds those not yet worked on."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class WordIds:
    """Ids of a text by a tokenizer that normalizes to NFC and lower case, drops white space and merges within pieces.

    A word (what stands between blanks) is cut into pieces by the tokenizer's own pattern once, a piece is merged by the
    tokenizer's own model once.  All words of a batch are looked up in one pass, and those met for the first time are cut
    together.  At most ``_KEPT`` words are kept, then all are forgotten: a bound of memory, without effect on results.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.find = compiled(pattern + "| ").findall  # no piece holds a blank, so a blank found parts two words
        self.model = Tokenizer.from_file(path).model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = _Numbers(), _Numbers()
        self.flat, self.starts = array("I"), array("I", [0])
        self.piece_flat, self.piece_starts = array("I"), array("I", [0])
        self.blank = self.pieces[" "]

    def _learn_pieces(self) -> None:
        for piece in self.pieces.new:
            if piece != " ":
                mapped = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
                self.piece_flat.extend([t.id for t in self.model.tokenize(mapped)])
            self.piece_starts.append(len(self.piece_flat))
        self.pieces.new = []

    def _learn_words(self) -> None:
        if not (new := self.words.new):
            return
        found = self.find(" ".join(new))
        at = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        self._learn_pieces()
        starts = np.array(self.piece_starts, np.int64)
        sizes = starts[at + 1] - starts[at]
        index, total = gather(starts[at], sizes)
        ends = np.append(np.cumsum(sizes)[at == self.blank], total) + len(self.flat)
        self.flat.frombytes(np.array(self.piece_flat, np.uint32)[index].tobytes())
        self.starts.frombytes(ends.astype(np.uint32).tobytes())
        self.words.new = []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > _KEPT:
            self.forget()
        number = self.words.__getitem__
        cut = (_lowered(t).split(" ") for t in texts)
        rows = [np.fromiter(map(number, words), np.int64, len(words)) for words in cut]
        self._learn_words()
        flat, starts = np.array(self.flat, np.uint32), np.array(self.starts, np.int64)
        return [flat[gather(starts[at], starts[at + 1] - starts[at])[0]] for at in rows]


def _lowered(text: str) -> str:
    """NFC and lower case; the tokenizer lowers letter by letter, so a capital sigma never becomes a final one."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


class Packer:
    """Places the examples of one task.  ``add`` and ``finish`` return pieces (example, start, stop, sequence, offset)."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.next = limits, first_sequence
        self.limit = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.waiting: list[list] = []  # [example, start, stop, start of loss]
        self.open: list[list] = []
        self.left = self.limit.copy()
        self.done: list[tuple] = []

    def _need(self, piece: list) -> tuple[int, int, int]:
        _, a, b, loss = piece
        return b - a, 1, max(0, b - max(a, loss))

    def add(self, example, tokens: int, loss_start: int = 0) -> None:
        a, step = 0, min(self.limits.tokens, self.limits.loss)
        while tokens - a >= step == self.limits.tokens:
            self._emit([[example, a, a + step, loss_start]])
            a += step
        while tokens - a > step:
            self.waiting.append([example, a, a + step, loss_start])
            a += step
        if tokens > a:
            self.waiting.append([example, a, tokens, loss_start])
        if len(self.waiting) >= WINDOW:
            self._place(last=False)

    def finish(self) -> None:
        self._place(last=True)

    def _emit(self, pieces: list[list]) -> None:
        offset = 0
        for example, a, b, _ in pieces:
            self.done.append((example, a, b, self.next, offset))
            offset += b - a
        self.next += 1

    def _close(self) -> None:
        """Emit the open sequence; one that is not full is divided into lengths that are powers of two."""
        pieces, total = self.open, int(sum(b - a for _, a, b, _ in self.open))
        size = self.limits.tokens
        while total:
            while size > total:
                size = size // 2 if size & (size - 1) == 0 else 1 << (total.bit_length() - 1)
            part, rest, room = [], [], size
            for example, a, b, loss in pieces:
                take = min(room, b - a)
                if take:
                    part.append([example, a, a + take, loss])
                if take < b - a:
                    rest.append([example, a + take, b, loss])
                room -= take
            self._emit(part)
            pieces, total = rest, total - size
        self.open, self.left = [], self.limit.copy()

    def _place(self, last: bool) -> None:
        if not self.waiting:
            if last and self.open:
                self._close()
            return
        items, self.waiting = self.waiting, []
        need = np.array([self._need(p) for p in items], np.float64)
        weight = need.mean(axis=0) / self.limit**2
        value = need * weight
        free = np.ones(len(items), bool)
        n = len(items)
        while n:
            fits = free & (need <= self.left).all(axis=1)
            if fits.any():
                at = int(np.where(fits, value @ self.left, -1).argmax())
                self._put(items[at], need[at])
                free[at] = False
                n -= 1
            else:
                if self.left[0] < 1 or self.left[1] < 1 or self.left[2] < 1:
                    self._close()
                    continue
                at = int(np.where(free, value @ self.left, -1).argmax())
                example, a, b, loss = items[at]
                most = min(int(self.left[0]), max(loss - a, 0) + int(self.left[2]))
                self._put(part := [example, a, a + most, loss], np.array(self._need(part), np.float64))
                items[at] = [example, a + most, b, loss]
                need[at] = self._need(items[at])
                value[at] = need[at] * weight
            if self.left[0] < 1:
                self._close()
        if last and self.open:
            self._close()

    def _put(self, piece: list, need: np.ndarray) -> None:
        self.open.append(piece)
        self.left = self.left - need


PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def pack(df: DataFrame, tokenizer: str, final_id: int, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", loss_start: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_length.

    ``tokenizer``: path of a tokenizer file, the same on all machines; ``final_id`` ends every text; ``loss_start``: column with
    the number of a row's first token that bears loss (0 if none is given).
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _workers.get(tokenizer) or _workers.setdefault(tokenizer, WordIds(tokenizer))
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        held: dict[int, tuple] = {}
        count = 0

        def rows() -> pd.DataFrame:
            done, packer.done = packer.done, []
            sizes: dict[int, int] = {}
            for _, a, b, sequence, offset in done:
                sizes[sequence] = offset + b - a
            out = [(held[e][0], a, b - a, held[e][1][a:b].tobytes(), len(held[e][1]), sequence, offset, sizes[sequence]) for e, a, b, sequence, offset in done]
            waiting = {p[0] for p in packer.waiting} | {p[0] for p in packer.open}
            for e in [e for e in held if e not in waiting]:
                del held[e]
            return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"])

        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                some = pdf.iloc[i : i + 1024]
                texts = [t or "" for t in some["text"]]
                for at, ids, loss in zip(some["doc_id"], words.ids(texts), some["loss"], strict=True):
                    held[count] = (at, np.append(ids, np.uint32(final_id)).astype("<u4"))
                    packer.add(count, len(ids) + 1, int(loss))
                    count += 1
                if packer.done:
                    yield rows()
        packer.finish()
        if packer.done:
            yield rows()

    loss = F.coalesce(F.col(loss_start), F.lit(0)).cast("long") if loss_start else F.lit(0).cast("long")
    rows = df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), loss.alias("loss"))
    out = rows.mapInPandas(packed, f"doc_id string, {PIECES}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", doc_id)
