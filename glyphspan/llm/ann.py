"""Nearest neighbours by largest inner product: cross-polytope hashing with multiprobe tables and exact reranking.

A table turns vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and files each
under the signed axis it comes nearest to; one or two rotations together make a bucket's code.  A query looks into the
most promising buckets of each of ``TABLES`` tables, and what it finds there is ranked by exact inner products in double
precision.  Vectors of like norm (within ``RATIO``) form a band that is searched by itself.  Where a band's norms differ,
its vectors get one more coordinate, sqrt(M * M - |x| * |x|) with the band's largest norm M, by which the order of inner
products becomes the order of angles; queries have zero there.

The number of buckets looked into is measured, not fixed: ``SAMPLE`` queries of each length are compared with all vectors,
and for each band so many are taken that ``RECALL`` of the sample's nearest in it are found, ``SHARE`` of them at least.
Where this were over half of the buckets, the band is compared whole, as hashing saves nothing there.

Scale: equal vectors are searched once, with the ``k + 1`` least of their ids (added up in tasks, so a common vector is a
few rows).  Buckets are gathered into groups of about ``TILE`` vectors and a larger bucket is dealt into shards, as are
its queries, so a task holds at most a tile of each; a query's results of a task are merged into ``k + 1`` before they are
dealt out, however many it met, for up to ``HELD`` queries at a time.
The index covers every row; fitted are only the bands and the numbers of buckets.  ``hashes`` of 2 squares the number of
buckets: a query looks into fewer vectors, but into many more buckets, each with its own overhead, so it is not the default.
Measured recall of the 20 nearest: see the README.

Cases: vectors null, empty, zero or with null or non-finite components and rows without id take no part; vectors of
another length than the query's are none of its candidates; equal scores go to the smaller id; a row repeating id and
vector counts once; of an id with several vectors the best counts, and as a query all are asked; a query whose buckets
hold fewer than k others is asked again against all buckets, so small tables give all candidates; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.llm.common import stored

TABLES = 4
SHARE = 0.25
RECALL = 0.97
SAMPLE = 64
RATIO = 1.25
BANDS = 16
#: Lengths of vectors whose number of buckets is measured; of further lengths all vectors are compared.
LENGTHS = 8
#: Most buckets of a table that are put in order for a query while measuring.
ORDERED = 4096
HASHES = 1
#: Queries whose buckets are put in order at once.
PROBED = 64
TILE = 2048
#: Queries whose results a task holds before it passes them on.
HELD = 50_000
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (length a power of two), scaled to keep norms."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@functools.lru_cache(maxsize=256)
def _signs(size: int, table: int, function: int) -> np.ndarray:
    return np.random.default_rng([SEED, size, table, function]).choice([-1.0, 1.0], (3, size))


def rotate(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Pseudo-rotation of rows, padded with zeros to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    z = np.zeros((len(x), size))
    z[:, : x.shape[1]] = x
    for signs in _signs(size, table, function):
        z = hadamard(z * signs)
    return z


def codes(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """Rows x tables: the signed axis nearest to each row (2 * axis, plus 1 if negative), ``hashes`` of them in one number."""
    out = np.zeros((len(x), tables), np.int64)
    for t in range(tables):
        for f in range(hashes):
            z = rotate(x, t, f)
            axis = np.abs(z).argmax(axis=1)
            out[:, t] = out[:, t] * (2 * z.shape[1]) + 2 * axis + (z[np.arange(len(z)), axis] < 0)
    return out


def _leading(n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of two descending lists, of n and ``width`` entries, whose sums can be among the n largest."""
    j = np.arange(min(n, width))
    many = n // (j + 1)
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), np.repeat(j, many)


def probes(x: np.ndarray, table: int, hashes: int, n: int) -> np.ndarray:
    """Rows x n: codes of the most promising buckets, those whose axes' coordinates have the largest sum."""
    out = []
    for start in range(0, len(x), PROBED):
        part = x[start : start + PROBED]
        score, code = np.zeros((len(part), 1)), np.zeros((len(part), 1), np.int64)
        for f in range(hashes):
            z = rotate(part, table, f)
            signed = np.stack([z, -z], axis=2).reshape(len(part), -1)  # by code of this function
            some = np.argsort(-signed, axis=1, kind="stable")[:, :n]
            i, j = _leading(n, some.shape[1])
            i, j = i[i < score.shape[1]], j[i < score.shape[1]]
            score = score[:, i] + np.take_along_axis(signed, some, 1)[:, j]
            code = code[:, i] * signed.shape[1] + some[:, j]
            order = np.argsort(-score, axis=1, kind="stable")[:, :n]
            score, code = np.take_along_axis(score, order, 1), np.take_along_axis(code, order, 1)
        out.append(code)
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def best_by_id(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids, each with the best of its scores, ties to smaller ids."""
    order = np.lexsort((-scores, ids))
    ids, scores = ids[order], scores[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else order
    ids, scores = ids[first], scores[first]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _matrix(vectors: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def _by_length(vectors: pd.Series) -> Iterator[np.ndarray]:
    lengths = vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def best_of(q: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int, once: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of q the k best (ids, scores) of the rows of x, each of which stands for several ids; an id counts once, with
    its best row; ``once``: no id belongs to two rows."""
    for first in range(0, len(q), 256):
        rough = q[first : first + 256] @ x.T
        for i, row in enumerate(rough):
            at = np.arange(len(row))
            if once and len(row) > k:  # all that can be among the first k by the exact product
                least = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
            exact = (x[at] * q[first + i]).sum(axis=1)
            every = np.concatenate([ids[a] for a in at])
            score = np.repeat(exact, [len(ids[a]) for a in at])
            if once:
                order = np.lexsort((every, -score))[:k]
                yield first + i, every[order], score[order]
            else:
                yield first + i, *best_by_id(every, score, k)


def valid(vector: str | Column) -> Column:
    """True for vectors that take part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _distinct(rows: DataFrame, k: int, kind: str) -> DataFrame:
    """(k1, k2, vec, norm, asked, ids): equal vectors once, with their k + 1 least ids."""

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values(["k1", "k2", "id"], kind="stable").reset_index(drop=True)
            k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            stop = np.append(first[1:], len(pdf))
            ids, asked = pdf["id"].to_numpy(), pdf["asked"].to_numpy(bool)
            vecs = [np.asarray(v, kind) for v in pdf["vector"].iloc[first]]
            yield pd.DataFrame(
                {
                    "k1": k1[first],
                    "k2": k2[first],
                    "vec": [v.tobytes() for v in vecs],
                    "norm": [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in vecs],
                    "asked": np.logical_or.reduceat(asked, first),
                    "ids": [np.unique(ids[a:b])[: k + 1] for a, b in zip(first, stop, strict=True)],
                }
            )

    some = rows.mapInPandas(in_task, "k1 long, k2 long, vec binary, norm double, asked boolean, ids array<long>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return some.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.first("norm").alias("norm"), F.max("asked").alias("asked"), least.alias("ids"))


def _lifted(x: np.ndarray, most: np.ndarray | None, query: bool) -> np.ndarray:
    if most is None:
        return x
    more = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(most[:, None] ** 2 - (x * x).sum(axis=1, keepdims=True), 0))
    return np.concatenate([x, more], axis=1)


def _kinds(vectors: pd.Series, lifts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places of vectors of one length, with or without the additional coordinate, and their largest norms."""
    lift = lifts.to_numpy(np.float64, na_value=np.nan)
    for at in _by_length(vectors):
        for some, plain in ((at[np.isnan(lift[at])], True), (at[~np.isnan(lift[at])], False)):
            if len(some):
                yield some, None if plain else lift[some]


def _buckets(width: int, hashes: int) -> int:
    return (2 << max(1, (width - 1).bit_length())) ** hashes


def _banded(distinct: DataFrame) -> DataFrame:
    """The rows with size (octets), band (0 holds the largest norms) and lift (its largest norm, or null where all are equal)."""
    sized = distinct.withColumn("size", F.octet_length("vec"))
    span = sized.groupBy("size").agg(F.max("norm").alias("top"), F.min("norm").alias("low"))
    band = F.least(F.lit(BANDS - 1), F.floor(F.log(F.col("top") / F.col("norm")) / F.log(F.lit(RATIO)))).cast("int")
    sized = sized.join(span, "size").withColumn("band", F.when(F.col("top") - F.col("low") <= 1e-3 * F.col("top"), 0).otherwise(band)).drop("top", "low")
    lift = sized.groupBy("size", "band").agg(F.max("norm").alias("top"), F.min("norm").alias("low"))
    lift = lift.select("size", "band", F.when(F.col("top") - F.col("low") > 1e-3 * F.col("top"), F.col("top")).alias("lift"))
    return sized.join(lift, ["size", "band"])


def _measured(distinct: DataFrame, k: int, kind: str, tables: int, hashes: int, share: float, recall: float) -> DataFrame:
    """(size, band, lift, n): the number of buckets to look into, null for all."""
    bands = distinct.groupBy("size", "band", "lift").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("many")).collect()
    needed: dict[tuple[int, int], list[int]] = {}
    seen = list(dict.fromkeys(r["size"] for r in bands))[:LENGTHS]
    for size in seen:
        some = distinct.where((F.col("size") == size) & F.col("asked")).orderBy("k1", "k2").limit(SAMPLE).select("k1", "k2", "vec").collect()
        if not some:
            continue
        own, q = {(r["k1"], r["k2"]): i for i, r in enumerate(some)}, np.stack([np.frombuffer(r["vec"], kind) for r in some]).astype(np.float64)

        def scan(batches: Iterator[pd.DataFrame], own: dict = own, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            """The best of each batch for each query, and how many buckets a query looks into before it finds them."""
            place: dict[bool, list[np.ndarray]] = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _matrix(pdf["vec"], kind)
                score = q @ x.T
                for j, key in enumerate(zip(pdf["k1"].tolist(), pdf["k2"].tolist(), strict=True)):
                    if key in own:
                        score[own[key], j] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                at, row = np.repeat(np.arange(len(q)), best.shape[1]), best.ravel()
                rank = np.empty(len(row), np.int64)
                lift = pdf["lift"].to_numpy(np.float64, na_value=np.nan)[row]
                for plain in (True, False):
                    mine = np.flatnonzero(np.isnan(lift) == plain)
                    if not len(mine):
                        continue
                    if plain not in place:
                        asked = _lifted(q, None if plain else np.ones(len(q)), True)
                        every = _buckets(asked.shape[1], hashes)
                        place[plain] = []
                        for t in range(tables):  # only the buckets in order are held: (query, code) in one number, and the place
                            order = probes(asked, t, hashes, min(every, ORDERED))
                            coded = (np.arange(len(q))[:, None] * every + order).ravel()
                            by = np.argsort(coded)
                            place[plain].append((coded[by], by % order.shape[1]))
                    code = codes(_lifted(x[row[mine]], None if plain else lift[mine], False), tables, hashes)
                    every, ranks = _buckets(x.shape[1] + (not plain), hashes), []
                    for t in range(tables):
                        coded, rank_of = place[plain][t]
                        wanted = at[mine] * every + code[:, t]
                        found_at = np.minimum(np.searchsorted(coded, wanted), len(coded) - 1)
                        ranks.append(np.where(coded[found_at] == wanted, rank_of[found_at], every))
                    rank[mine] = np.min(ranks, axis=0)
                out = pd.DataFrame({"q": at, "score": score[at, row], "k1": pdf["k1"].to_numpy()[row], "band": pdf["band"].to_numpy()[row], "rank": rank})
                yield out[out["score"] > -np.inf]

        found = distinct.where(F.col("size") == size).select("k1", "k2", "vec", "band", "lift").mapInPandas(scan, "q int, score double, k1 long, band int, rank long")
        first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k1"))
        for r in found.withColumn("r", first).where(F.col("r") <= k).collect():
            needed.setdefault((size, r["band"]), []).append(r["rank"])
    rows = []
    for r in bands:
        width = r["size"] // np.dtype(kind).itemsize + (r["lift"] is not None)
        every, ranks = _buckets(width, hashes), sorted(needed.get((r["size"], r["band"]), [0]))
        n = max(math.ceil(share * _buckets(width, 1)), ranks[math.ceil(recall * len(ranks)) - 1] + 1)
        rows.append((r["size"], r["band"], r["lift"], None if n > every // 2 or n > ORDERED or not any(s == r["size"] for s, _ in needed) else n))
    return distinct.sparkSession.createDataFrame(rows, "size int, band int, lift double, n int")


def _round(distinct: DataFrame, asked: DataFrame, plan: DataFrame, k: int, kind: str, tables: int, hashes: int, tile: int) -> DataFrame:
    """(k1, k2, found array of (score, id)) of each vector asked that finds any, best first; where the plan's n is null: all buckets of one table."""

    @F.pandas_udf("array<long>")
    def file_under(vectors: pd.Series, lifts: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        for at, lift in _kinds(vectors, lifts):
            for i, row in zip(at, codes(_lifted(_matrix(vectors.iloc[at], kind), lift, False), tables, hashes), strict=True):
                out[i] = row.tolist()
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<array<long>>")
    def look_into(vectors: pd.Series, lifts: pd.Series, many: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        for at, lift in _kinds(vectors, lifts):
            x, n = _lifted(_matrix(vectors.iloc[at], kind), lift, True), many.iloc[at].to_numpy()
            each = np.stack([probes(x, t, hashes, int(n.max())) for t in range(tables)], axis=1)
            for i, rows, m in zip(at, each, n, strict=True):
                out[i] = list(rows[:, :m])
        return pd.Series(out, dtype=object)

    spark, plan = distinct.sparkSession, F.broadcast(plan)
    data = distinct.select("k1", "k2", "vec", "ids", "size", "band", F.posexplode(file_under("vec", "lift")).alias("t", "code"))
    data = data.join(plan.select("size", "band", "n"), ["size", "band"]).where("t = 0 or n is not null").drop("n")
    # buckets are gathered into groups of about a tile; the number of groups follows the number of vectors
    groups = max(1, -(-distinct.count() // tile))
    data = data.withColumn("g", F.pmod("code", F.lit(groups)))
    wanted = asked.select("k1", "k2", "vec", "size").join(plan, "size")  # a query is asked of every band
    spread = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
    whole = wanted.where("n is null").select("k1", "k2", "vec", "size", "band", F.lit(0).alias("t"), F.explode(spread).alias("g"), F.lit(None).cast("array<long>").alias("codes"))
    seek = wanted.where("n is not null").select("k1", "k2", "vec", "size", "band", F.posexplode(look_into("vec", "lift", "n")).alias("t", "all"))
    mine = F.filter("all", lambda c: F.pmod(c, F.lit(groups)) == F.col("g"))
    seek = seek.select("*", F.explode(F.array_distinct(F.transform("all", lambda c: F.pmod(c, F.lit(groups))))).alias("g"))
    seek = seek.select("k1", "k2", "vec", "size", "band", "t", "g", mine.alias("codes")).unionByName(whole)
    key = ["t", "g", "size", "band"]
    shards = lambda d, name: d.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    # one row for each table, group, length of vectors and band: bounded by tables * buckets, and by tables * rows / tile
    sizes = stored(shards(data, "ds").join(shards(seek, "qs"), key), "groups")
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    deal = lambda n: F.pmod(F.col("k1"), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(sizes, key).select(*key, deal("ds").alias("d"), over("qs").alias("q"), F.lit(False).alias("ask"), "k1", "k2", "vec", "code", "ids", F.lit(None).cast("array<long>").alias("codes"))
    right = seek.join(sizes, key).select(*key, over("ds").alias("d"), deal("qs").alias("q"), F.lit(True).alias("ask"), "k1", "k2", "vec", F.lit(None).cast("long").alias("code"), F.lit(None).cast("array<long>").alias("ids"), "codes")

    def match(pdf: pd.DataFrame, best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
        """One group's results, merged into what the task has found so far."""
        ask = pdf["ask"].to_numpy(bool)
        have, want = pdf[~ask], pdf[ask]
        if not len(have) or not len(want):
            return
        x, q = _matrix(have["vec"], kind), _matrix(want["vec"], kind)
        ids, keys = have["ids"].tolist(), list(zip(want["k1"].tolist(), want["k2"].tolist(), strict=True))
        found: list[list] = [[best[key]] if key in best else [] for key in keys]
        code = have["code"].to_numpy(np.int64, na_value=0)
        if want["codes"].isna().all():
            pairs = [(np.arange(len(q)), np.arange(len(x)))]
        else:
            who: dict[int, list[int]] = {}
            for i, some in enumerate(want["codes"]):
                for c in some:
                    who.setdefault(int(c), []).append(i)
            pairs = [(np.array(who[int(c)]), np.flatnonzero(code == c)) for c in np.unique(code) if int(c) in who]
        every = np.concatenate(ids)
        once = len(np.unique(every)) == len(every)
        for qs, xs in pairs:
            for i, found_ids, scores in best_of(q[qs], x[xs], [ids[j] for j in xs], k + 1, once):
                found[qs[i]].append((found_ids, scores))
        for key, parts in zip(keys, found, strict=True):
            if parts:
                best[key] = best_by_id(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k + 1)

    place = [*key, "d", "q"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by group; a group may go on in the next batch.  A query's result of a task is one row."""
        best: dict = {}
        held: list[pd.DataFrame] = []

        def told() -> Iterator[pd.DataFrame]:
            rows = [(*key, ids, scores) for key, (ids, scores) in best.items()]
            best.clear()
            for i in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[i : i + 10_000], columns=["k1", "k2", "id", "score"])

        for pdf in batches:
            at = pdf[place].to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            if held and (held[-1][place].iloc[-1].to_numpy() != at[0]).any():
                match(pd.concat(held, ignore_index=True), best)
                held = []
            for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                held.append(pdf.iloc[a:b])
                if b < len(pdf):
                    match(pd.concat(held, ignore_index=True), best)
                    held = []
            if len(best) > HELD:
                yield from told()
        if held:
            match(pd.concat(held, ignore_index=True), best)
        yield from told()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(partitions, *place).sortWithinPartitions(*place)
    found = dealt.mapInPandas(walk, "k1 long, k2 long, id array<long>, score array<double>")
    each = found.select("k1", "k2", F.explode(F.arrays_zip("score", "id")).alias("f")).select("k1", "k2", "f.score", "f.id")
    # an id may be found in several tables and by several of its vectors: its best score counts
    once = each.repartition(partitions, "k1", "k2").groupBy("k1", "k2", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "id")
    near = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    listed = near.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("found"))
    return stored(listed, "found")


def nearest(
    df: DataFrame,
    asked: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    share: float = SHARE,
    recall: float = RECALL,
    hashes: int = HASHES,
    tile: int = TILE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``asked`` holds, its k nearest other rows found, nearest first."""
    kind = "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    rows = df.where(valid(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked")
    )
    rows = rows.select("id", "asked", "vector", F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2"))
    distinct = stored(_banded(stored(_distinct(rows, k, kind), "vectors")), "bands")
    plan = _measured(distinct, k, kind, tables, hashes, share, recall)
    how = (k, kind, tables, hashes, tile)
    found = _round(distinct, distinct.where("asked"), plan, *how)
    total = rows.select("id").distinct().limit(k + 1).count()
    all_asked = distinct.where("asked")
    enough = found.where(F.size("found") >= total).select("k1", "k2")
    again = all_asked.join(enough, ["k1", "k2"], "left_anti")  # those that found nothing, too
    if not again.isEmpty():
        found = found.where(F.size("found") >= total).unionByName(_round(distinct, again, plan.withColumn("n", F.lit(None).cast("int")), *how))
    queries = rows.where("asked").select(F.col("id").alias("query_id"), "k1", "k2").distinct()
    pairs = queries.join(found, ["k1", "k2"]).select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.id").alias("vec_id"), (-F.col("f.minus")).alias("score"))
    best = pairs.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
