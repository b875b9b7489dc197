"""SimHash near-duplicates: bit-sliced comparison inside blocks, then connected components.

Fingerprints of 64 bits come from XXH64 of word shingles.  Two fingerprints that differ in at most ``RADIUS`` bits
agree on at least two of five blocks of bits, so each distinct fingerprint is filed under its ten pairs of blocks and
only fingerprints in one bucket are compared.  In a bucket the fingerprints are stored as vertical bit planes; a query
adds up differing planes with carry-save counters for 64 candidates at a time and a slice of candidates is abandoned as
soon as all have exceeded the radius.  A bucket is walked breadth-first: every fingerprint is a query once, against those
not yet reached, so a bucket of n like fingerprints costs about n and gives n - 1 links, never all its pairs.

Scale: equal documents are one fingerprint before anything is compared.  Buckets above ``TILE`` fingerprints are dealt
into shards and every two shards meet in a task of their own, so no task holds more than two shards.  Links and labels
stay in Spark tables; components are found by alternating large-star and small-star steps on tables.

Cases: null or wordless text has fingerprint zero and is linked like any other; a text of fewer words than a shingle is
one shingle; rows repeating a doc_id share its component; a null doc_id is never the smallest unless all are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspan.llm.common import stored

SEED = 42
RADIUS = 3
WORDS = 3
TILE = 16384
#: First bit and width of the five blocks of a fingerprint.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_ONE = np.uint64(1)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of all word shingles, repeats included.  bytes.lower and bytes.split know exactly A-Z and the six ASCII spaces."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(parts), min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit integer whose bits are set where over half the shingle hashes have them."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", name: str = "fp", words: int = WORDS) -> DataFrame:
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return df.withColumn(name, fingerprints(F.col(text)))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of bit words; bit j of plane b is bit b of value j."""
    n = -len(values) % 64
    padded = np.concatenate([values, np.zeros(n, np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64).reshape(64, -1)


def within(planes: np.ndarray, query: int, radius: int, step: int = 8) -> np.ndarray:
    """Bit words marking the values within ``radius`` (at most 3) of the query.

    ``low`` and ``high`` are a two-bit counter for each value, ``over`` marks counts of four and more.  After each
    ``step`` planes the words in which all values are over are abandoned.
    """
    width = planes.shape[1]
    low, high, over = (np.zeros(width, np.uint64) for _ in range(3))
    live = np.arange(width)
    for first in range(0, 64, step):
        some = planes[first : first + step] if len(live) == width else planes[first : first + step, live]
        for b in range(step):
            differs = ~some[b] if (query >> (first + b)) & 1 else some[b]
            carry = low & differs
            low = low ^ differs
            over = over | (high & carry)
            high = high ^ carry
        go = over != ~np.uint64(0)
        if not go.all():
            low, high, over, live = low[go], high[go], over[go], live[go]
            if not len(live):
                break
    bad = over.copy()
    if radius < 3:
        bad |= high if radius < 2 else high & low
    if radius < 1:
        bad |= low
    out = np.zeros(width, np.uint64)
    out[live] = ~bad
    return out


def bucket_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect all of a bucket's components; with two sides only links across them are sought."""
    if len(right) == 0:
        return _walk(left, radius)
    planes, links = bit_planes(right), []
    for q in left:
        hits = np.flatnonzero(np.unpackbits(within(planes, int(q), radius).view(np.uint8), bitorder="little")[: len(right)])
        if len(hits):  # links of one query share it; those inside a side are found where that side meets itself
            links += [(int(q), int(right[h])) for h in _roots(right, hits, radius)]
    return links


def _roots(values: np.ndarray, hits: np.ndarray, radius: int) -> list[int]:
    """One of each group of hits that are linked among themselves."""
    left, out = list(hits), []
    while left:
        out.append(root := left[0])
        near = [root]
        left = left[1:]
        while near and left:
            d = np.bitwise_count(values[left] ^ values[near.pop()])
            near += [h for h, x in zip(left, d, strict=True) if x <= radius]
            left = [h for h, x in zip(left, d, strict=True) if x > radius]
    return out


def _walk(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    n = len(values)
    if n <= 48:  # too few for planes to pay
        links, open_ = [], np.arange(n)
        while len(open_) > 1:
            queue, open_ = [open_[0]], open_[1:]
            while queue and len(open_):
                q = queue.pop()
                near = np.bitwise_count(values[open_] ^ values[q]) <= radius
                links += [(int(values[q]), int(values[x])) for x in open_[near]]
                queue += list(open_[near])
                open_ = open_[~near]
        return links
    order, links, planes = np.arange(n), [], bit_planes(values)
    alive = np.ones(n, bool)
    first = 0
    while first < n:
        if not alive[first]:
            first += 1
            continue
        alive[first] = False
        queue = [first]
        while queue:
            if alive.sum() * 2 < len(order) and len(order) > 128:  # fewer are left: slice them anew
                order = np.flatnonzero(alive)
                planes = bit_planes(values[order])
            q = queue.pop()
            hit = np.unpackbits(within(planes, int(values[q]), radius).view(np.uint8), bitorder="little")[: len(order)].astype(bool)
            near = order[hit & alive[order]]
            alive[near] = False
            links += [(int(values[q]), int(values[x])) for x in near]
            queue += near.tolist()
    return links


def _block_keys(fp: str) -> list:
    """For each pair of blocks, its number and the fingerprint with all other bits cleared."""
    keys = []
    for n, pair in enumerate(itertools.combinations(BLOCKS, 2)):
        mask = sum(((1 << width) - 1) << at for at, width in pair)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("pair"), F.col(fp).bitwiseAND(F.lit(mask)).alias("key")))
    return keys


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (pair, key, tile); a bucket may continue in the next batch."""
    held: pd.DataFrame | None = None
    for pdf in itertools.chain(batches, [None]):
        rows = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if rows is None or not len(rows):
            held = None if pdf is None else held
            continue
        ids = [rows[c].to_numpy() for c in ("pair", "key", "tile")]
        new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in ids], axis=0)]))
        ends = np.append(new[1:], len(rows))
        if pdf is not None:
            held, new, ends = rows.iloc[new[-1] :], new[:-1], ends[:-1]
        fps, side = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["side"].to_numpy()
        many = ends - new > 1
        out: list[tuple[int, int]] = []
        for a, b in zip(new[many].tolist(), ends[many].tolist(), strict=True):
            if b - a == 2 and side[a] == side[a + 1]:
                if int(fps[a] ^ fps[a + 1]).bit_count() <= RADIUS:
                    out.append((int(fps[a]), int(fps[a + 1])))
                continue
            one = side[a:b] == 0
            out += bucket_links(fps[a:b][one], fps[a:b][~one])
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def fingerprint_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b) links whose components are those of all pairs of distinct fingerprints within the radius."""
    filed = fps.select("fp", F.explode(F.array(*_block_keys("fp"))).alias("k")).select("fp", "k.pair", "k.key")
    large = filed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    large = stored(large.select("pair", "key", F.ceil(F.col("n") / tile).cast("int").alias("shards")), "large_buckets")
    small_key = filed.join(large.select("pair", "key"), ["pair", "key"], "left_anti") if not large.isEmpty() else filed
    plain = small_key.select("pair", "key", F.lit(0).alias("tile"), F.lit(0).alias("side"), "fp")
    if not large.isEmpty():
        dealt = filed.join(large, ["pair", "key"]).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
        # shards i <= j meet in tile i * shards + j + 1; the row is side 0 where it is i and side 1 where it is j
        met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("t"))
        low, high = F.least("s", "t"), F.greatest("s", "t")
        met = met.select("pair", "key", (low * F.col("shards") + high + 1).alias("tile"), F.when(F.col("s") <= F.col("t"), 0).otherwise(1).alias("side"), "fp")
        plain = plain.unionByName(met)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartition(n, "pair", "key", "tile").sortWithinPartitions("pair", "key", "tile", "fp")
    return ordered.mapInPandas(_linked, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node reachable over the links, for every node that has one.

    Each round joins the links to the least neighbour of their ends (large star, then small star) and writes them as a
    table; it ends when a round changes nothing.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        near = both.join(least, "a")
        out = near.where(F.col("b") > F.col("a") if large else F.col("b") < F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now, before = stored(links.where("a <> b").select("a", "b").distinct(), "links"), None
    for i in range(max_rounds):
        now = stored(star(star(now, True), False), f"round_{i}")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable, itself included."""
    docs = stored(with_fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "fingerprints")
    fps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = stored(components(fingerprint_links(fps.select("fp"))), "roots")
    joined = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    own = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    # a chain of copies can pass through ids that repeat under several fingerprints; components are those of fingerprints
    return docs.join(joined.join(own, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
