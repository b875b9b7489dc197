"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of the lines around it; the forward-backward
algorithm gives each line's probability of being good, and a document's quality is their mean weighted by line length.

Learning takes a bounded sample of labelled rows (``max_docs``, those with the least hash of their id, drawn from all of
them) and of each its whole first text; where that has over ``MAX_LINES`` lines, runs of ``RUN`` neighbouring lines are
drawn by a hash of their places in the whole text, so what stands at a text's end teaches as what stands at its beginning.
Line features are computed by tasks, of all lines, and only these numbers, of at most ``max_docs * MAX_LINES`` lines and
their neighbours, reach the driver.  A line of a labelled document bears the document's label unless a first fit without
transitions contradicts it, see ``line_labels``, so the field sees good and bad lines follow each other.
Scoring covers every row and whole texts.

Cases: null text scores as the empty text, which is one empty line; a document's score is defined for any text; several
labels of one id count as their minimum, of several texts of one labelled id the one of the least hash is learned from; null
labels or ids teach nothing; with fewer than one row of either label all scores are the share of good labels (0.5 without
any); an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspan.llm.common import unused

MAX_DOCS = 3000
MAX_LINES = 1000
RUN = 20
_CHARS = 1_000_000
FEATURES = (
    "log_chars upper letters digits symbols shouts bars stops word_length distinct stutter ends starts short seen log_words".split()
)
_UPPER, _LOWER, _LETTER, _DIGIT, _SPACE, _STOP, _SHOUT, _BAR, _QUIET, _SYMBOL = range(10)
_classes = np.full(0x110000, 255, np.uint8)
_mix = np.random.default_rng(7).integers(1, 2**63, 1024, np.uint64) | np.uint64(1)


def _class(code: int) -> int:
    c = chr(code)
    if c.isalpha():
        return _UPPER if c.isupper() else _LOWER if c.islower() else _LETTER
    if c.isspace():
        return _SPACE
    if c.isdigit():
        return _DIGIT
    return _STOP if c in ".,;:" else _SHOUT if c in "!?" else _BAR if c == "|" else _QUIET if c in "'\"-()’“”«»–—" else _SYMBOL


def _chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Whole texts together, about a million characters at a time."""
    now, size = [], 0
    for t in texts:
        now.append(t or "")
        size += len(now[-1])
        if size > _CHARS:
            yield now
            now, size = [], 0
    if now:
        yield now


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x FEATURES, lines of each text, characters of each line) of texts taken together."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lines_of = np.array([t.count("\n") + 1 for t in texts], np.int64)
    kinds = _classes[codes]
    for c in np.unique(codes[kinds == 255]):
        _classes[c] = _class(int(c))
    kinds = _classes[codes]
    breaks = np.flatnonzero(codes == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, len(codes))
    n, size = len(starts), (ends - starts).astype(np.float64)
    at_least = np.maximum(size, 1)

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    count = {k: per_line(kinds == k) for k in range(10)}
    letters = count[_UPPER] + count[_LOWER] + count[_LETTER]
    in_word = np.concatenate([[False], kinds != _SPACE, [False]])
    first = np.flatnonzero(in_word[1:-1] & ~in_word[:-2])
    last = np.flatnonzero(in_word[1:-1] & ~in_word[2:]) + 1
    line = np.searchsorted(starts, first, "right") - 1
    words = np.bincount(line, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes)))) if len(first) and first[0] == 0 else None
    if place is None:
        place = np.arange(len(codes))
        if len(first):
            place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(codes))))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * _mix[place & 1023], dtype=np.uint64)])
    hashes = sums[last] - sums[first]
    same = np.zeros(len(first), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashes, line))
    new = np.ones(len(first), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=n)
    word_at = np.arange(len(first)) - np.concatenate([[0], np.cumsum(words).astype(np.int64)])[line]
    mixed = np.zeros(n, np.uint64)
    np.add.at(mixed, line, hashes * _mix[(word_at + 511) & 1023])
    doc = np.repeat(np.arange(len(texts)), lines_of)
    again = np.lexsort((np.arange(n), mixed, doc))
    seen = np.zeros(n)
    seen[again[1:]] = (mixed[again][1:] == mixed[again][:-1]) & (doc[again][1:] == doc[again][:-1]) & (words[again][1:] > 0)
    tail = kinds[np.maximum(ends - 1, 0)] if len(codes) else np.zeros(n, np.uint8)
    head = kinds[np.minimum(starts, max(len(codes) - 1, 0))] if len(codes) else np.zeros(n, np.uint8)
    full = size > 0
    columns = [
        np.log1p(size), count[_UPPER] / np.maximum(letters, 1), letters / at_least, count[_DIGIT] / at_least, count[_SYMBOL] / at_least,
        count[_SHOUT] / at_least, count[_BAR] / at_least, count[_STOP] / some, letters / some / 10, distinct / some,
        np.bincount(line[same], minlength=n) / some, full & np.isin(tail, (_STOP, _SHOUT)), full & (head == _UPPER),
        np.bincount(line[last - first <= 3], minlength=n) / some, seen, np.log1p(words),
    ]
    return np.stack(columns, axis=1).astype(np.float32), lines_of, size


def with_neighbours(x: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Own features, the previous line's, the next line's, flags of the first and last line, and 1."""
    n, k = x.shape
    ends = np.cumsum(lines_of)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends - lines_of], last[ends - 1] = True, True
    out = np.zeros((n, 3 * k + 3), np.float32)
    out[:, :k] = x
    out[1:, k : 2 * k] = x[:-1]
    out[:-1, 2 * k : 3 * k] = x[1:]
    out[first, k : 2 * k] = 0
    out[last, 2 * k : 3 * k] = 0
    out[:, 3 * k], out[:, 3 * k + 1], out[:, 3 * k + 2] = first, last, 1
    return out


def forward_backward(u: np.ndarray, lines_of: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each of the four transitions of each document.

    ``u``: a line's score of good over bad; ``trans[i, j]``: score of going from i to j (0 bad, 1 good).  Documents are
    taken together, step by step, longest first, so a step touches those that still have a line.
    """
    docs = len(lines_of)
    order = np.argsort(-lines_of, kind="stable")
    start, length = (np.cumsum(lines_of) - lines_of)[order], lines_of[order]
    live = np.searchsorted(-length, -np.arange(int(length[0]) if docs else 0), "left")  # documents with more than t lines
    node = np.zeros((len(u), 2))
    node[:, 1] = u
    alpha, beta = np.zeros((len(u), 2)), np.zeros((len(u), 2))
    for t, m in enumerate(live):
        at = start[:m] + t
        if t:
            before = alpha[at - 1]
            now = np.stack([np.logaddexp(before[:, 0] + trans[0, j], before[:, 1] + trans[1, j]) for j in (0, 1)], axis=1) + node[at]
        else:
            now = node[at]
        alpha[at] = now - now.max(axis=1, keepdims=True)
    expected = np.zeros((docs, 2, 2))
    for t in range(len(live) - 2, -1, -1):
        m = live[t + 1]
        at = start[:m] + t
        after = node[at + 1] + beta[at + 1]
        back = np.stack([np.logaddexp(trans[i, 0] + after[:, 0], trans[i, 1] + after[:, 1]) for i in (0, 1)], axis=1)
        beta[at] = back - back.max(axis=1, keepdims=True)
        joint = alpha[at][:, :, None] + trans[None] + after[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        expected[order[:m]] += joint / joint.sum(axis=(1, 2), keepdims=True)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), expected


@dataclass
class Crf:
    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def lines(self, x: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        wide = (with_neighbours(x, lines_of) - self.mean) / self.scale
        return forward_backward(wide @ self.weights, lines_of, self.trans)[0]

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        out = []
        for some in _chunks(texts):
            if self.constant is not None:
                out.append(np.full(len(some), self.constant))
                continue
            x, lines_of, size = line_features(some)
            weight = np.maximum(size, 1.0)
            first = np.cumsum(lines_of) - lines_of
            out.append(np.add.reduceat(self.lines(x, lines_of) * weight, first) / np.add.reduceat(weight, first))
        return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def drawn_runs(lines: int, most: int = MAX_LINES, run: int = RUN) -> list[tuple[int, int]]:
    """(first, stop) of the runs of lines that a text of so many lines teaches by: the whole text, or runs from all over it."""
    if lines <= most:
        return [(0, lines)]
    starts = range(0, lines, run)
    chosen = sorted(starts, key=lambda i: (zlib.crc32(f"{lines}:{i}".encode()), i))[: most // run]
    return [(i, min(i + run, lines)) for i in sorted(chosen)]


def _climb(wide: np.ndarray, lines_of: np.ndarray, y: np.ndarray, chain: bool, steps: int, rate: float, ridge: float, weight: np.ndarray) -> np.ndarray:
    """Weights and transitions (zero without ``chain``) of the largest conditional likelihood of line labels ``y``, by Adam.

    ``weight``: of each run of lines; a run weighs the same however many lines it has.
    """
    docs, total = len(lines_of), weight.sum()
    doc = np.repeat(np.arange(docs), lines_of)
    share = (weight / lines_of)[doc]
    seen = np.zeros((docs, 2, 2))
    inside = doc[1:] == doc[:-1]
    np.add.at(seen, (doc[1:][inside], y[:-1][inside], y[1:][inside]), 1)
    theta = np.zeros(wide.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        p, expected = forward_backward(wide @ theta[:-4], lines_of, theta[-4:].reshape(2, 2)) if chain else (1 / (1 + np.exp(-np.clip(wide @ theta[:-4], -700, 700))), seen)
        grad = np.concatenate([wide.T @ ((y - p) * share), ((seen - expected) * (weight / lines_of)[:, None, None]).sum(axis=0).ravel()]) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def line_labels(u: np.ndarray, lines_of: np.ndarray, size: np.ndarray, good: np.ndarray) -> np.ndarray:
    """A label for each line: its document's, but for lines whose own score ``u`` says otherwise; these have less than half
    of the document's characters, those that contradict most first, so the document's label holds."""
    doc = np.repeat(np.arange(len(good)), lines_of)
    against = np.where(good[doc] == 1, -u, u)
    order = np.lexsort((-against, doc))
    weight = np.maximum(size, 1.0)[order]
    run = np.cumsum(weight)
    first = np.cumsum(lines_of) - lines_of
    before = np.where(first > 0, run[first - 1], 0.0)
    whole = np.add.reduceat(weight, first)
    flip = (against[order] > 0) & (2 * (run - before[doc]) < whole[doc])
    y = good[doc].copy()
    y[order[flip]] ^= 1
    return y


def fit(wide: np.ndarray, lines_of: np.ndarray, good: np.ndarray, size: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """A field from runs of lines (``wide`` features, each run's document's label, its weight): a first fit without transitions
    tells which lines contradict their document, and the field learns from these labels of lines."""
    if not len(good) or good.min() == good.max():
        share = float(good.mean()) if len(good) else 0.5
        return Crf(np.zeros(0), np.zeros((2, 2)), np.zeros(0), np.ones(0), share)
    mean, scale = wide.mean(axis=0), wide.std(axis=0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    wide = (wide - mean) / scale
    how = (steps, rate, ridge, weight)
    alone = _climb(wide, lines_of, good[np.repeat(np.arange(len(good)), lines_of)], False, *how)
    y = line_labels(wide @ alone[:-4], lines_of, size, good)
    theta = _climb(wide, lines_of, y, True, *how)
    return Crf(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)


def taught_rows(text: str | None, most: int = MAX_LINES, run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, float]]:
    """(features of a run's lines with the lines beside it, characters of its own lines, 1 if a line stands before, 1 if one behind, weight)."""
    x, _, size = line_features([text or ""])
    runs = drawn_runs(len(x), most, run)
    for first, stop in runs:
        before, behind = int(first > 0), int(stop < len(x))
        yield x[first - before : stop + behind], size[first:stop], before, behind, 1 / len(runs)


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Crf:
    """A field from labelled rows (``labels``: id and 0/1); at most ``max_docs`` of them, whole texts."""
    marks = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(quality).cast("int").alias("good"))
    drawn = marks.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    drawn = drawn.select("id", "good")
    # of texts that repeat an id one is taken, added up in tasks
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(drawn, "id")
    rows = own.groupBy("id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, text, good in zip(pdf["id"], pdf["text"], pdf["good"], strict=True):
                told = [(at, good, i, x.tobytes(), size.tobytes(), before, behind, weight) for i, (x, size, before, behind, weight) in enumerate(taught_rows(text))]
                yield pd.DataFrame(told, columns=["id", "good", "run", "x", "size", "before", "behind", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInPandas(features, f"id {kind}, good int, run int, x binary, size binary, before int, behind int, weight double").toPandas()
    return fit_runs(got.sort_values(["id", "run"]).reset_index(drop=True))


def fit_runs(got: pd.DataFrame) -> Crf:
    """A field from rows of (good, x, size, before, behind, weight); the lines beside a run give its features and then go."""
    x, size = (np.frombuffer(b"".join(got[c]), kind) for c, kind in (("x", np.float32), ("size", np.float64)))
    x, lines_of = x.reshape(-1, len(FEATURES)), (got["size"].map(len) // 8).to_numpy(np.int64)
    before, behind = got["before"].to_numpy(np.int64), got["behind"].to_numpy(np.int64)
    held = lines_of + before + behind
    wide, stop = with_neighbours(x, held), np.cumsum(held)
    own = np.ones(len(x), bool)
    own[(stop - held)[before == 1]] = False
    own[(stop - 1)[behind == 1]] = False
    return fit(wide[own], lines_of, got["good"].to_numpy(np.int64), size, got["weight"].to_numpy(np.float64))


def with_quality(df: DataFrame, model: Crf, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score`` (a name ``df`` has not), the probability-like quality from 0 to 1, to every row."""
    unused(df, score)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts), dtype="float64")

    return df.withColumn(score, quality(F.col(text)))
