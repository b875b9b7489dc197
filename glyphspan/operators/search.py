"""Queries over token positions: terms, spans, proximity, context, leaders, pages.

A term is a function of a word (struct of text, norm, brk, hard) giving a Boolean Column; terms are combined with
``all_of``, ``any_of`` and ``none_of``.  Spans are sought inside each document's array of words, so a scan finds them
without a shuffle; proximity works on the positions found, by windows over each document's own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.functions import text as T
from glyphspan.operators.tokens import with_words

Term = Callable[[Column], Column]
MOST_DISTANCE = 15


def word(value: str) -> Term:
    return lambda w: w["norm"] == value.lower()


def all_of(*terms: Term) -> Term:
    def both(w: Column) -> Column:
        out = terms[0](w)
        for t in terms[1:]:
            out = out & t(w)
        return out

    return both


def any_of(*terms: Term) -> Term:
    def either(w: Column) -> Column:
        out = terms[0](w)
        for t in terms[1:]:
            out = out | t(w)
        return out

    return either


def none_of(term: Term) -> Term:
    return lambda w: ~term(w)


def spans(docs: DataFrame, terms: list[Term], author: str | None = None) -> DataFrame:
    """(doc_id, source, pos): leaders of contiguous matches that no sentence end cuts."""
    if author is not None:
        docs = docs.where(F.col("source") == author)
    ws = F.col("words")

    def here(i: Column) -> Column:
        ok = terms[0](F.get(ws, i))
        for k, term in enumerate(terms[1:], 1):
            ok = ok & ~F.get(ws, i + (k - 1))["hard"] & F.coalesce(term(F.get(ws, i + k)), F.lit(False))
        return ok

    places = F.filter(F.transform(ws, lambda _, i: i), here)
    return with_words(docs).select("doc_id", "source", F.explode(places).alias("pos"))


def near(left: DataFrame, right: DataFrame, distance: int = 5, directed: bool = False, lengths: tuple[int, int] = (1, 1)) -> DataFrame:
    """Leaders of ``left`` with a leader of ``right`` within ``distance`` tokens that does not overlap; directed: after it."""
    if not 1 <= distance <= MOST_DISTANCE:
        raise ValueError(f"distance must lie between 1 and {MOST_DISTANCE}")
    both = left.select("doc_id", "source", "pos", F.lit(True).alias("asks")).unionByName(right.select("doc_id", "source", "pos", F.lit(False).alias("asks")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    other = F.when(~F.col("asks"), 1)
    found = F.count(other).over(w.rangeBetween(lengths[0], distance)) if lengths[0] <= distance else F.lit(0)
    if not directed and lengths[1] <= distance:
        found = found + F.count(other).over(w.rangeBetween(-distance, -lengths[1]))
    return both.withColumn("found", found).where("asks AND found > 0").select("doc_id", "source", "pos")


def near_same(leaders: DataFrame, distance: int = 5) -> DataFrame:
    """(doc_id, pos, other): a term near itself.  Anchors ascend; each takes its first partner whose pair was not the one
    emitted just before, so the outcome depends on order and is folded over each document's sorted positions."""

    @F.pandas_udf("array<struct<pos:int,other:int>>")
    def fold(places: pd.Series) -> pd.Series:
        out = []
        for ps in places:
            ps, last, pairs = [int(p) for p in ps], None, []
            for i, p in enumerate(ps):
                lo = i
                while lo and p - ps[lo - 1] <= distance:
                    lo -= 1
                for q in ps[lo:]:
                    if q - p > distance:
                        break
                    if q != p and (pair := (min(p, q), max(p, q))) != last:
                        last = pair
                        pairs.append((p, q))
                        break
            out.append(pairs)
        return pd.Series(out, dtype=object)

    # one document's matches are one array, as its words are
    each = leaders.groupBy("doc_id").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    return each.select("doc_id", F.explode(fold("places")).alias("m")).select("doc_id", F.col("m.pos").alias("pos"), F.col("m.other").alias("other"))


def context(docs: DataFrame, terms: list[Term], size: int = 5) -> DataFrame:
    """(doc_id, pos, before, matched, after): each match with ``size`` words on both sides, inside its document."""
    n, ws = len(terms), F.col("words")
    text = lambda part: F.array_join(F.transform(part, lambda w: w["text"]), " ")
    first = lambda m: F.greatest(m - size, F.lit(0))

    def here(i: Column) -> Column:
        ok = terms[0](F.get(ws, i))
        for k, term in enumerate(terms[1:], 1):
            ok = ok & ~F.get(ws, i + (k - 1))["hard"] & F.coalesce(term(F.get(ws, i + k)), F.lit(False))
        return ok

    shown = F.transform(
        F.filter(F.transform(ws, lambda _, i: i), here),
        lambda i: F.struct(i.alias("pos"), text(F.slice(ws, first(i) + 1, i - first(i))).alias("before"), text(F.slice(ws, i + 1, F.lit(n))).alias("matched"), text(F.slice(ws, i + 1 + n, F.lit(size))).alias("after")),
    )
    return with_words(docs).select("doc_id", F.explode(shown).alias("m")).select("doc_id", "m.*")


def page(matches: DataFrame, after: tuple[int, int] | None, size: int) -> DataFrame:
    """The next ``size`` matches in order of (doc_id, pos) behind a key, and one more if there is a further page."""
    if after is not None:
        d, p = after
        matches = matches.where((F.col("doc_id") > d) | ((F.col("doc_id") == d) & (F.col("pos") > p)))
    return matches.orderBy("doc_id", "pos").limit(size + 1)


def leaders(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, pos, row_idx, in_row): the line and the place in it of each match's first word; lines of other documents are not read into words."""
    docs = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("row_idx", "text"))
    sized = rows.select("doc_id", "row_idx", F.size(T.word_list(F.col("text"))).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).where("n > 0")
    # rows and matches meet by document; each match falls into the one row whose interval holds it
    joined = found.join(starts, "doc_id").where("pos >= start AND pos < start + n")
    return joined.select("doc_id", "pos", "row_idx", (F.col("pos") - F.col("start")).alias("in_row"))


def estimate(results: int, candidates_seen: int, candidates: int) -> int:
    """Estimated number of results when ``results`` were found among the candidates seen so far."""
    return results + int((candidates - candidates_seen) * (results / candidates_seen) + 0.99)
