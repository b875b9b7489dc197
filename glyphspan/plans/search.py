"""Query trees as DataFrame plans over the stored corpus.

Each term becomes the tokens that meet it: words are a filter the scan takes over, anything else is decided on the
vocabulary, where a word's analyses lie, and the words that are left select the tokens.  A span joins its terms' tokens
on (document, position minus place in the span), so only what a scan has found is dealt out; no token that meets no term
is ever moved.  Spans near each other are found by windows over the leaders of a document.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspan.functions.inflection import category_mask
from glyphspan.operators.search import near
from glyphspan.plans.language import All, Any, Constraint, Cursor, Inflection, Lemma, MOST_CHARS, Not, Query, QueryError, Word, atoms, check, impossible, parse
from glyphspan.sources.corpus import BLOCK, Corpus

CONTEXT, MOST_CONTEXT = 25, 100
PAGE = 50


def _words_of(c: Constraint) -> list[str] | None:
    """The words that meet a constraint of words alone, or None for other constraints."""
    if isinstance(c, Word):
        return [c.value.lower()]
    if isinstance(c, Any):
        parts = [_words_of(p) for p in c.parts]
        return None if None in parts else sorted({w for p in parts for w in p})
    return None


def _met(c: Constraint, strict: bool) -> Column:
    """Whether a word of the vocabulary meets a constraint.

    Lemmata and features of one `and` must hold for one analysis; ``strict`` demands them of all analyses, and that these
    allow no other value of the categories named.
    """
    if isinstance(c, Not):
        return ~_met(c.inner, strict)
    if isinstance(c, Word):
        return F.col("norm") == c.value.lower()
    parts = c.parts if isinstance(c, (All, Any)) else (c,)
    plain = [p for p in parts if isinstance(p, (Lemma, Inflection))]
    others = [_met(p, strict) for p in parts if not isinstance(p, (Lemma, Inflection))]
    both = not isinstance(c, Any)
    if plain:
        others.append(_analysed(plain, both, strict))
    return reduce(lambda a, b: a & b if both else a | b, others)


def _analysed(parts: list, both: bool, strict: bool) -> Column:
    features = [p.feature for p in parts if isinstance(p, Inflection)]
    lemmata = [p.value for p in parts if isinstance(p, Lemma)]
    if both and (len(set(lemmata)) > 1 or any(f.category == "degree" for f in features)):
        return F.lit(False)  # masks hold no degrees
    mask = reduce(lambda m, f: m | f.bit, features, 0)
    named = reduce(lambda m, f: m | category_mask(f.category), features, 0)

    def holds(a: Column) -> Column:
        bits = a["mask"].bitwiseAND(F.lit(named if strict else mask))
        if both:
            return (bits == mask) & (a["lemma"] == lemmata[0] if lemmata else F.lit(True))
        some = (a["mask"].bitwiseAND(F.lit(mask)) != 0) & (bits.bitwiseAND(F.lit(~mask)) == 0 if strict else F.lit(True))
        return some | a["lemma"].isin(lemmata) if lemmata else some

    found = F.forall("analyses", holds) & (F.size("analyses") > 0) if strict else F.exists("analyses", holds)
    return found


def tokens_of(corpus: Corpus, c: Constraint, authors: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """The tokens (source, doc_id, pos, hard_break) that meet a constraint."""
    rows = corpus.tokens.where(F.col("source").isin(*authors)) if authors else corpus.tokens
    if (words := _words_of(c)) is not None:
        rows = rows.where(F.col("norm").isin(words) if len(words) > 1 else F.col("norm") == words[0])
    else:
        # words are hashed, far fewer than tokens, which so need not be sorted
        rows = rows.join(corpus.words.where(_met(c, strict)).select("norm").hint("shuffle_hash"), "norm", "left_semi")
    return rows.select("source", "doc_id", "pos", "hard_break")


def _without(corpus: Corpus, c: Not, authors: tuple[str, ...], strict: bool, breaks: bool) -> DataFrame:
    """(doc_id, pos) of the tokens that do not meet a negated constraint and, with ``breaks``, of those that end a sentence."""
    rows = corpus.tokens.where(F.col("source").isin(*authors)) if authors else corpus.tokens
    if (words := _words_of(c.inner)) is not None:
        out = rows.where(F.col("norm").isin(words))
    else:
        unmet = corpus.words.where(~F.coalesce(_met(c, strict), F.lit(False))).select("norm")
        out = rows.join(unmet.hint("shuffle_hash"), "norm", "left_semi")
    out = out.select("doc_id", "pos")
    return out.unionByName(rows.where("hard_break").select("doc_id", "pos")) if breaks else out


def span_leaders(corpus: Corpus, terms: list[Constraint], authors: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """(source, doc_id, pos) of the first tokens of contiguous matches that no sentence end cuts.

    A negated term takes away from what the others found: that a token stands in its place is told by the one before, as a
    text's last token ends a sentence.  Only a span of negated terms alone looks at nearly all tokens.
    """
    out, negated = None, [isinstance(t, Not) for t in terms]
    if all(negated):
        negated = [False] * len(terms)
    for i, term in enumerate(terms):
        if negated[i]:
            continue
        found = tokens_of(corpus, term, authors, strict)
        if i + 1 < len(terms):
            found = found.where(~F.col("hard_break"))
        found = found.withColumn("pos", F.col("pos") - i).drop("hard_break")
        out = found if out is None else out.join(found.drop("source"), ["doc_id", "pos"])
    for i, term in enumerate(terms):
        if negated[i]:
            gone = _without(corpus, term, authors, strict, breaks=i + 1 < len(terms))
            out = out.where("pos >= 0").join(gone.withColumn("pos", F.col("pos") - i), ["doc_id", "pos"], "left_anti")
    return out.select("source", "doc_id", "pos")


def compiled(query: str | Query, extended: bool = False) -> Query:
    """A query that was read and checked."""
    if isinstance(query, str):
        if len(query) > MOST_CHARS:
            raise QueryError(f"more than {MOST_CHARS} characters")
        query = parse(query)
    check(query, extended)
    return query


def matches(corpus: Corpus, query: str | Query, strict: bool = False, extended: bool = False) -> DataFrame:
    """(source, doc_id, pos, spans array of (pos, length) in order of the text) of each match.

    A match of several spans begins at a leader of the first one; of the combinations in which each span lies near the one
    before, the first is taken in which none overlap and that is not the combination emitted just before.
    """
    query = compiled(query, extended)
    spans = query.spans()
    lengths = [len(terms) for _, terms in spans]
    if any(impossible(t.constraint) for t in query.terms):
        empty = corpus.tokens.where(F.lit(False)).select("source", "doc_id", "pos")
        return empty.withColumn("spans", F.array().cast("array<struct<pos:int,length:int>>"))
    leaders = [span_leaders(corpus, terms, query.authors, strict) for _, terms in spans]
    if len(spans) == 1:
        return leaders[0].withColumn("spans", F.array(F.struct("pos", F.lit(lengths[0]).alias("length"))))
    # leaders without a partner in the next span are left out before any document is looked at
    reach = [(r.distance, r.directed) for r, _ in spans]
    for i in range(len(spans) - 2, -1, -1):
        distance, directed = reach[i + 1]
        leaders[i] = near(leaders[i], leaders[i + 1], distance, directed, (lengths[i], lengths[i + 1]))
    each = reduce(DataFrame.unionByName, (d.withColumn("span", F.lit(i)) for i, d in enumerate(leaders)))

    @F.pandas_udf("array<struct<pos:int,leaders:array<int>>>")
    def paths(places: pd.Series) -> pd.Series:
        return pd.Series([list(_paths([[int(p["pos"]) for p in doc if p["span"] == i] for i in range(len(lengths))], lengths, reach)) for doc in places], dtype=object)

    # a document's leaders are one array, as its words are
    docs = each.groupBy("source", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "span"))).alias("places"))
    found = docs.select("source", "doc_id", F.explode(paths("places")).alias("m")).select("source", "doc_id", "m.pos", "m.leaders")
    pairs = F.transform("leaders", lambda p, i: F.struct(p.alias("pos"), F.element_at(F.array(*map(F.lit, lengths)), i + 1).alias("length")))
    return found.select("source", "doc_id", "pos", F.array_sort(pairs).alias("spans"))


def _paths(leaders: list[list[int]], lengths: list[int], reach: list[tuple[int, bool]]) -> Iterator[tuple[int, list[int]]]:
    """(anchor, leaders in order of the spans) of a document's matches; leaders are in order of position.

    What a walk can still reach depends on its last leader and on the places taken, whatever the order they were taken in, so
    places from which no way led on are not walked again; an anchor with fewer places around it than spans is not walked at all.
    """
    last: list[int] | None = None
    n = len(leaders)
    # how far a walk can go from its anchor to either side
    ahead = sum(d for d, _ in reach[1:])
    back = sum(d for d, directed in reach[1:] if not directed)
    every = sorted({q for some in leaders for q in some})

    def first(path: list[int], used: frozenset[tuple[int, int]], dead: set) -> list[int] | None:
        """The first whole path that begins so and whose set of places is not the one before."""
        i = len(path)
        if i == n:
            return path if sorted(path) != last else None
        if (path[-1], used) in dead:
            return None
        distance, directed = reach[i]
        low = path[-1] if directed else path[-1] - distance
        for k in range(bisect_left(leaders[i], low), bisect_right(leaders[i], path[-1] + distance)):
            q = leaders[i][k]
            if all(q + lengths[i] <= a or b <= q for a, b in used) and (whole := first([*path, q], used | {(q, q + lengths[i])}, dead)):
                return whole
        dead.add((path[-1], used))
        return None

    for anchor in leaders[0]:
        if bisect_right(every, anchor + ahead) - bisect_left(every, anchor - back) < n:
            continue
        if path := first([anchor], frozenset({(anchor, anchor + lengths[0])}), set()):
            last = sorted(path)
            yield anchor, path


def around(corpus: Corpus, found: DataFrame, size: int) -> DataFrame:
    """(doc_id, pos, spans, words array of (pos, text, brk)): each match's words and ``size`` more on both sides, inside its document."""
    last = F.array_max(F.transform("spans", lambda s: s["pos"] + s["length"]))
    first = F.greatest(F.array_min(F.transform("spans", lambda s: s["pos"])) - size, F.lit(0))
    rows = found.withColumns({"__from": first, "__to": last + size})
    blocks = F.explode(F.sequence(F.floor(F.col("__from") / BLOCK).cast("int"), F.floor((F.col("__to") - 1) / BLOCK).cast("int")))
    met = rows.select("doc_id", "pos", "spans", "__from", "__to", blocks.alias("block")).join(corpus.blocks, ["doc_id", "block"])
    at = F.col("block") * BLOCK
    begin = F.greatest(F.col("__from") - at, F.lit(0))
    some = F.slice("words", begin + 1, F.greatest(F.least(F.col("__to") - at, F.size("words")) - begin, F.lit(0)))
    part = F.transform(some, lambda w, i: F.struct((at + begin + i).alias("pos"), w["text"].alias("text"), w["brk"].alias("brk")))
    return met.groupBy("doc_id", "pos", "spans").agg(F.array_sort(F.flatten(F.collect_list(part))).alias("words"))


def keyword_in_context(corpus: Corpus, found: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, pos, before, matched, after): words of matches of one span and around them, with a blank between."""
    rows, length = around(corpus, found, size), F.col("spans")[0]["length"]
    part = lambda test: F.array_join(F.transform(F.filter("words", test), lambda w: w["text"]), " ")
    inside = lambda w: (w["pos"] >= F.col("pos")) & (w["pos"] < F.col("pos") + length)
    return rows.select("doc_id", "pos", part(lambda w: w["pos"] < F.col("pos")).alias("before"), part(inside).alias("matched"), part(lambda w: w["pos"] >= F.col("pos") + length).alias("after"))


def with_text(corpus: Corpus, found: DataFrame, size: int = CONTEXT) -> DataFrame:
    """``found`` with ``chunks``: array of (text, is_match) of each match and ``size`` words around, inside its document."""
    whole = around(corpus, found, max(1, min(size, MOST_CONTEXT)))
    inside = lambda p: F.exists("spans", lambda s: (s["pos"] <= p) & (p < s["pos"] + s["length"]))

    def chunk(now: Column, w: Column) -> Column:
        """The words' text; the break behind a word belongs to a match if the match's next word does."""
        joined = F.exists("spans", lambda s: (s["pos"] <= w["pos"]) & (w["pos"] + 1 < s["pos"] + s["length"]))
        return _append(_append(now, w["text"], inside(w["pos"])), w["brk"], joined)

    chunks = F.aggregate("words", F.array().cast("array<struct<text:string,is_match:boolean>>"), chunk)
    return whole.select("doc_id", "pos", "spans", chunks.alias("chunks"))


def _append(now: Column, text: Column, matched: Column) -> Column:
    """Text added to the last chunk where that is of the same kind."""
    tail = F.try_element_at(now, F.lit(-1))
    grown = F.concat(F.slice(now, 1, F.size(now) - 1), F.array(F.struct(F.concat(tail["text"], text).alias("text"), matched.alias("is_match"))))
    new = F.concat(now, F.array(F.struct(text.alias("text"), matched.alias("is_match"))))
    return F.when(text == "", now).when((F.size(now) > 0) & (tail["is_match"] == matched), grown).otherwise(new)


def page(found: DataFrame, cursor: Cursor | str | None = None, size: int = PAGE) -> tuple[list, Cursor | None]:
    """The next ``size`` matches behind a cursor, in order of (doc_id, pos), and the cursor of the page after, if there is one."""
    cursor = Cursor.read(cursor) if isinstance(cursor, str) else cursor
    if cursor:
        found = found.where((F.col("doc_id") > cursor.doc_id) | ((F.col("doc_id") == cursor.doc_id) & (F.col("pos") > cursor.pos)))
    rows = found.orderBy("doc_id", "pos").limit(size + 1).collect()  # a page is what a reader asked for
    if len(rows) <= size:
        return rows, None
    return rows[:size], Cursor((cursor.results if cursor else 0) + size, rows[size - 1]["doc_id"], rows[size - 1]["pos"])


def search(corpus: Corpus, query: str, cursor: Cursor | str | None = None, size: int = PAGE, context: int = CONTEXT, strict: bool = False) -> tuple[DataFrame, Cursor | None]:
    """A page of matches with their texts, and the cursor of the next."""
    rows, after = page(matches(corpus, query, strict), cursor, size)
    spark = corpus.tokens.sparkSession
    some = spark.createDataFrame(rows, "source string, doc_id long, pos int, spans array<struct<pos:int,length:int>>")
    return with_text(corpus, some, context).orderBy("doc_id", "pos"), after
