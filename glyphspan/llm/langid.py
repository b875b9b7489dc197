"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is a list of the most frequent n-grams (n = 1..3, inside padded lower-case words) in order of frequency.  A
document's own profile is compared to each language's by summing how far every n-gram is out of place.

Learning counts n-grams of all learnable documents: each task adds up its documents per language, Spark sums the
partial counts and a window keeps ``size`` n-grams of each language.  What reaches the driver is ``size`` rows for each
of at most ``max_languages`` languages (more raise an error); that bounded table is what is broadcast.

Cases: null text or text without a letter gives ``und`` with score 0; ties in frequency go to the smaller n-gram, ties
in distance to the alphabetically first language; an n-gram missing from a profile costs ``size``; rows with null
language or null id teach nothing; with no learnable row every document is ``und``; other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.llm.common import fresh, unused

SIZE = 400
MAX_LANGUAGES = 2000
_FLUSH = 2_000_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_keys(text: str | None) -> np.ndarray:
    """All 1- to 3-grams of the padded words of a text, each packed into one integer of 21 bits a character."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    letter, c = letter[keep], codes[keep].astype(np.int64)
    c[~letter] = 32
    if len(c) < 3:
        return np.empty(0, np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[letter], two, three[letter[1:-1]]])


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        keys.sort()
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(keys) else weights


def top_ngrams(text: str | None, size: int) -> np.ndarray:
    """A document's most frequent n-grams, most frequent first, ties by the smaller key."""
    keys, counts = _counted(ngram_keys(text))
    if len(keys) > 4 * size:  # only what can be among the first `size` need be sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:size]


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, group in pdf.groupby("lang", sort=True):
            waiting, held, sums = [], 0, []
            for text in group["text"]:
                waiting.append(k := ngram_keys(text))
                held += len(k)
                if held > _FLUSH:
                    sums.append(_counted(np.concatenate(waiting)))
                    waiting, held = [], 0
            if waiting:
                sums.append(_counted(np.concatenate(waiting)))
            keys, counts = _counted(np.concatenate([k for k, _ in sums]), np.concatenate([n for _, n in sums]))
            yield pd.DataFrame({"lang": lang, "ngram": keys, "n": counts})


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, ngram, rank) of the rows given, rank from 0; counts cover all rows."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInPandas(_count_batches, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "ngram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """All profiles as one sorted list of n-grams and a matrix of their ranks, one column a language."""

    def __init__(self, rows: pd.DataFrame, size: int):
        self.size = size
        self.langs = sorted(rows["lang"].unique())
        self.grams = np.unique(rows["ngram"].to_numpy(np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {x: i for i, x in enumerate(self.langs)}
        at = np.searchsorted(self.grams, rows["ngram"].to_numpy(np.int64))
        self.ranks[at, rows["lang"].map(column).to_numpy(np.int64)] = rows["rank"].to_numpy(np.int32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and how near: 1 minus the distance over the largest possible one."""
        own = top_ngrams(text, self.size)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(out.argmin())
        return self.langs[best], 1.0 - float(out[best]) / (len(own) * self.size)


def collect_profiles(profiles: DataFrame, size: int = SIZE, max_languages: int = MAX_LANGUAGES) -> Profiles:
    """The bounded table of profiles on the driver: at most ``size * max_languages`` rows, or an error."""
    rows = profiles.limit(size * max_languages + 1).toPandas()
    if rows["lang"].nunique() > max_languages or len(rows) > size * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return Profiles(rows, size)


def identify(df: DataFrame, model: Profiles, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (names ``df`` has not) to every row; all other columns stay."""
    unused(df, lang_pred, score)
    told = fresh(df, "__told")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])

    got = df.select("*", nearest(F.col(text)).alias(told))
    return got.select(*df.columns, F.col(f"{told}.lang").alias(lang_pred), F.col(f"{told}.score").alias(score))
