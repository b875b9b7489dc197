"""Target-distribution importance resampling: documents are drawn in proportion to how likely a target set makes their word n-grams.

Features are all runs of 1 to ``MOST_WORDS`` words, each filed under one of ``BUCKETS`` buckets by its CRC-32.  A bucket's
gain is the logarithm of how much commoner it is in the target than in the corpus; the gains lie in one array, and a
document's weight is the sum of what its features find there.  Gumbel noise from a hash of the id is added, so the
highest scores are a sample without replacement in proportion to the weights, the same in every run.

How many are drawn is exact, without sorting the corpus: the key (score descending, id, row) of the last one drawn is found
digit by digit.  Each round counts the rows of each value of the next ``DIGIT`` bits below the prefix found so far, and the
value in whose rows the k-th lies extends the prefix.  Only the rows up to that key are sorted by range and ranked.

Scale: texts are read twice, for the counts and for the scores, and never shuffled.  A task adds its counts up in one array
and passes on a row for each bucket.  To the driver go ``BUCKETS`` gains and ``2 ** DIGIT`` counts a round, however large the
corpus is.  A text is cut into pieces of ``PIECE`` bytes while its features are taken, so its length bounds no memory.  Row
numbers make all keys differ, so repeated rows and ties are dealt evenly, too.

Cases: a null text has no words; a text of fewer words than ``least_words`` is scored and never drawn; a null id is hashed as
empty text and comes last among equal scores; of rows equal in score and id as many are drawn as the number asks for;
empty tables draw nothing, and an empty target leaves all to the corpus' counts; a share that comes to less than one
row draws none; other columns pass through if ``keep`` names them, and an existing name of a new column is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspan.llm.common import fresh, stored, unused

MOST_WORDS = 3
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = Fraction(5, 100)
SEED = 42
#: Bits of a key that a round of the selection looks at.
DIGIT = 12
#: Bytes of a text whose words are held at once.
PIECE = 1 << 22

#: Letters A-Z become small, digits, small letters and all bytes of other characters stay, the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SIGN = -(1 << 63)


def word_pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, in order, in lists of about ``PIECE`` bytes."""
    folded = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(folded):
        stop = at + PIECE
        if stop < len(folded):
            stop = folded.find(b" ", stop)
            stop = len(folded) if stop < 0 else stop
        yield folded[at:stop].split()
        at = stop


def feature_buckets(text: str | None, buckets: int, most_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them) of each piece of a text."""
    before: list[list[int]] = []  # CRCs of the runs of 1, 2, ... words that end in the last word so far
    for words in word_pieces(text or ""):
        if not words:
            continue
        joined, ends, found = [b" " + w for w in words], list(map(zlib.crc32, words)), []
        last = [ends[-1]]
        for n in range(1, most_words + 1):
            found.append(np.fromiter(ends, np.uint32, len(ends)))
            if n == most_words:
                break
            # a run of n + 1 words is a run of n, a space and a word; the first word here continues the piece before
            carried = before[n - 1] if len(before) >= n else []
            starts = carried + ends[:-1]
            ends = list(map(zlib.crc32, islice(joined, len(joined) - len(starts), None), starts))
            if not ends:
                break
            last.append(ends[-1])
        before = [[c] for c in last]
        yield len(words), np.concatenate(found) % buckets


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                for _, found in feature_buckets(t, buckets, most_words):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    rows = df.select(F.col(text).alias("text")).where("text is not null").mapInPandas(add_up, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how many times commoner each bucket is in the target), with one more count in every bucket."""
    n, ratio = len(corpus), (target + 1.0) * (float(corpus.sum()) + len(corpus))
    return np.floor(1000 * np.log(ratio / ((corpus + 1.0) * (float(target.sum()) + n)))).astype(np.int64)


def noise(doc_id: str, seed: int = SEED) -> Column:
    """floor(1000 * standard Gumbel noise), from the first 32 bits of a digest of the seed and the id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def with_weight(df: DataFrame, array: np.ndarray, text: str = "text", most_words: int = MOST_WORDS, words: str = "n_words", features: str = "n_features", weight: str = "weight") -> DataFrame:
    """The rows with their numbers of words and features and the sum of their features' gains."""
    buckets = len(array)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 3), np.int64)
        for i, t in enumerate(texts):
            for n, found in feature_buckets(t, buckets, most_words):
                out[i] += n, len(found), array[found].sum()
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    at = fresh(df, "__scored")
    scored = df.withColumn(at, score(F.col(text)))
    return scored.select(*df.columns, F.col(at)["n_words"].alias(words), F.col(at)["n_features"].alias(features), F.col(at)["weight"].alias(weight))


def last_key(df: DataFrame, columns: list[str], k: int, digit: int = DIGIT) -> list[int] | None:
    """The k-th least key of long columns whose keys all differ, found by counting digits; null for k of 0 or beyond the rows.

    A long's digits are those of its distance from the least long, so they order as the longs do."""
    if k < 1:
        return None
    have, key, left = df, [], k
    for name in columns:
        bits = lambda shift, name=name: F.shiftrightunsigned(F.col(name).bitwiseXOR(F.lit(_SIGN)), shift)
        low, high, n = have.agg(F.min(name), F.max(name), F.count(name)).first()
        if left > n:
            return None
        differ = ((low - _SIGN) ^ (high - _SIGN)).bit_length()
        prefix, shift = (low - _SIGN) >> differ, differ
        while shift:
            width = min(digit, shift)
            shift -= width
            counted = have.groupBy(bits(shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
            for r in sorted(counted.collect()):  # 2 ** digit rows at most
                if left <= r["n"]:
                    break
                left -= r["n"]
            prefix = prefix << width | r["d"]
            have = have.where(bits(shift) == F.lit(prefix if prefix < 1 << 63 else prefix - (1 << 64)))
            if r["n"] == 1:
                return key + list(have.select(columns[len(key) :]).first())
        key.append(prefix + _SIGN)
        have = have.where(F.col(name) == key[-1])
    return key


def ranked(df: DataFrame, columns: list[str], rank: str) -> DataFrame:
    """The rows with their places (from 1) in the order of ``columns``: sorted by range, then numbered from what lies before each part."""
    part, at = fresh(df, "__part"), fresh(df, "__at")
    parts = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    parts = stored(parts.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(at)), "ranked")
    before, starts = 0, []
    for r in sorted(parts.groupBy(part).count().collect()):  # a row for each part
        starts.append((r[part], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(starts, f"{part} int, __before long")
    return parts.join(F.broadcast(starts), part).withColumn(rank, F.col("__before") + F.col(at) + 1).select(*df.columns, rank)


def resample(
    df: DataFrame,
    target: DataFrame,
    share: Fraction = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    most_words: int = MOST_WORDS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns of ``keep`` (all, if none is named), n_features, weight, score and rank of every row; rank is null where it is not drawn."""
    keep = df.columns if keep is None else keep
    unused(df.select(keep), "n_features", "weight", "score", "rank")
    array = gains(bucket_counts(df, text, buckets, most_words), bucket_counts(target, target_text, buckets, most_words))
    some = df.select(*[c for c in df.columns if c in {*keep, doc_id, text}])
    words, order, number, row = (fresh(some, c) for c in ("__words", "__order", "__number", "__row"))
    scored = with_weight(some, array, text, most_words, words)
    scored = scored.withColumn("score", F.col("weight") + noise(doc_id, seed))
    number_of = F.coalesce(F.col(doc_id).cast("long"), F.lit(-_SIGN - 1))  # no id stands last
    scored = scored.select(*keep, "n_features", "weight", "score", words, (-F.col("score")).alias(order), number_of.alias(number), F.monotonically_increasing_id().alias(row))
    scored = stored(scored, "scored")
    key = [order, number, row]
    able = scored.where(F.col(words) >= least_words)
    drawn = int(share * able.count())
    last = last_key(able.select(key), key, drawn)
    out = [*keep, "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    o, n, r = (F.lit(x) for x in last)
    before = (F.col(order) < o) | (F.col(order) == o) & ((F.col(number) < n) | (F.col(number) == n) & (F.col(row) <= r))
    mine = (F.col(words) >= least_words) & before
    rest = scored.where(~mine).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(mine), key, "rank").select(*out, "rank").unionByName(rest)
