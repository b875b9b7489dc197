"""Longest matches of a table of keys in texts, with what must stand before and behind them, and citations built from them.

A key matches at the beginning of a text or behind one of ``STARTS``, wherever it ends; of the keys that match at a place the
longest one counts, and matches are taken from left to right without overlap.  A key may demand a prefix that the text has
directly before it and a postfix that it has behind it; several rows of one key are its several meanings.

Keys are joined to places of texts by their first signs: every place of a text where a key may begin gives the first
``HEAD`` characters of what follows there, and a key shorter than that is joined by as many as it has.  So a table of any size
is dealt by its keys and texts by their places; only places whose first signs some key has carry their text's stretch on.  The
choice without overlap is a fold over a text's few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signs behind which a key may begin.
STARTS = " ()[];—-"
HEAD = 4


def key_table(keys: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(key, value, prefix, postfix, replace, match, size, head) of keys (key, value and, if there, prefix, postfix, replace)."""
    has = lambda c, kind: F.col(c) if c in keys.columns else F.lit(None).cast(kind)
    rows = keys.select("key", "value", has("prefix", "string").alias("prefix"), has("postfix", "string").alias("postfix"), F.coalesce(has("replace", "boolean"), F.lit(False)).alias("replace")).where("key <> ''")
    match = F.lower("key") if ignore_case else F.col("key")
    return rows.select("*", match.alias("match"), F.char_length(match).alias("size")).withColumn("head", F.substring("match", 1, HEAD))


def places(df: DataFrame, doc_id: str, text: str, longest: int, before: int, behind: int, ignore_case: bool = False) -> DataFrame:
    """(doc_id, at, left, right): every place where a key may begin, with what stands before it and from it on, as far as any key looks."""
    body = F.col("text")
    start = F.array_union(F.array(F.lit(0)), F.filter(F.transform(F.split(body, ""), lambda c, i: F.when(F.contains(F.lit(STARTS), c) & (c != ""), i + 1)), lambda i: i.isNotNull()))
    each = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text <> ''").select("doc_id", "text", F.explode(start).alias("at")).where(F.col("at") < F.char_length("text"))
    right = F.substr(body, F.col("at") + 1, F.lit(longest + behind))
    left = F.substr(body, F.greatest(F.col("at") - before, F.lit(0)) + 1, F.least(F.col("at"), F.lit(before)))
    return each.select("doc_id", "at", left.alias("left"), right.alias("right"), (F.lower(right) if ignore_case else right).alias("match"))


def candidates(df: DataFrame, keys: DataFrame, doc_id: str = "doc_id", text: str = "text", ignore_case: bool = False) -> DataFrame:
    """(doc_id, at, size, values): at each place the longest key that matches there, with all its meanings in order."""
    table = key_table(keys, ignore_case)
    longest, before, behind = table.agg(F.max("size"), F.max(F.char_length("prefix")), F.max(F.char_length("postfix"))).first()
    at = places(df, doc_id, text, longest or 0, before or 0, behind or 0, ignore_case)
    sizes = F.sequence(F.lit(1), F.least(F.char_length("match"), F.lit(HEAD)))
    heads = at.select("*", F.explode(F.transform(sizes, lambda n: F.substr("match", F.lit(1), n))).alias("head"))
    # a key as long as a head or longer has that head, a shorter one is its own
    found = heads.join(table.select("head", F.col("match").alias("key_match"), "key", "value", "prefix", "postfix", "replace", "size"), "head").where(F.startswith("match", F.col("key_match")))
    fits_left = F.col("prefix").isNull() | F.endswith("left", F.col("prefix"))
    fits_right = F.col("postfix").isNull() | F.startswith(F.substr("right", F.col("size") + 1), F.col("postfix"))
    good = found.where(fits_left & fits_right)
    meaning = F.struct("key", "value", "replace")
    each = good.groupBy("doc_id", "at", "size").agg(F.array_sort(F.collect_set(meaning)).alias("values"))
    best = each.groupBy("doc_id", "at").agg(F.max(F.struct("size", "values")).alias("b"))
    return best.select("doc_id", "at", "b.size", "b.values")


def expansions(df: DataFrame, keys: DataFrame, doc_id: str = "doc_id", text: str = "text", ignore_case: bool = False) -> DataFrame:
    """(doc_id, at, size, values): the matches of each text from left to right, none of which overlaps the one before."""
    found = candidates(df, keys, doc_id, text, ignore_case)
    each = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "size", "values"))).alias("all"))
    begin = F.struct(F.lit(0).alias("stop"), F.slice("all", 1, 0).alias("taken"))

    def take(now: Column, m: Column) -> Column:
        free = m["at"] >= now["stop"]
        stop = F.when(free, m["at"] + m["size"]).otherwise(now["stop"])
        return F.struct(stop.alias("stop"), F.when(free, F.concat(now["taken"], F.array(m))).otherwise(now["taken"]).alias("taken"))

    taken = F.aggregate("all", begin, take, lambda now: now["taken"])
    return each.select("doc_id", F.explode(taken).alias("m")).select("doc_id", "m.at", "m.size", "m.values")


def expanded_texts(df: DataFrame, keys: DataFrame, doc_id: str = "doc_id", text: str = "text", ignore_case: bool = False) -> DataFrame:
    """(doc_id, text, expanded): texts whose matches with one meaning are written out, in brackets behind the key, or, where
    the meaning says so, in its place; a match with several meanings stays as it is."""
    found = expansions(df, keys, doc_id, text, ignore_case).where(F.size("values") == 1)
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "size", F.col("values")[0]["value"].alias("value"), F.col("values")[0]["replace"].alias("replace")))).alias("spans"))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id", "left")
    begin = F.struct(F.lit(0).alias("stop"), F.lit("").alias("out"))

    def write(now: Column, m: Column) -> Column:
        gap = F.substr("text", now["stop"] + 1, m["at"] - now["stop"])
        own = F.substr("text", m["at"] + 1, m["size"])
        told = F.when(m["replace"], m["value"]).otherwise(F.concat(own, F.lit(" ["), m["value"], F.lit("]")))
        return F.struct((m["at"] + m["size"]).alias("stop"), F.concat(now["out"], gap, told).alias("out"))

    whole = F.aggregate("spans", begin, write, lambda now: F.concat(now["out"], F.substr("text", now["stop"] + 1)))
    return rows.select("doc_id", "text", F.coalesce(whole, F.col("text")).alias("expanded"))


def citations(df: DataFrame, authors: DataFrame, works: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, at, size, author, work, carried): places that name an author, an author and one of the author's works behind a
    blank, or a work alone, which is one of the author named last before it.

    ``authors``: (key, author), ``works``: (author, key, work); keys match as in ``expansions``.  Of readings that begin at one
    place the longest holds (an author with a work before the author alone).  Where a key names several authors, the one that
    has the work is meant; where none or several have it, the author is left open (null).  A work alone is looked up with the
    last author that is known, which an ordered window over a document's places carries on; ``carry`` are keys that stand for
    that author (such as ``id.``).  A document's places are its own task's work, no more than its text."""
    who = authors.select("key", F.concat(F.lit("a:"), "author").alias("value"))
    again = df.sparkSession.createDataFrame([(k, "=") for k in carry], "key string, value string")
    what = works.select("key", F.concat(F.lit("w:"), "author", F.lit("\n"), "work").alias("value"))
    names = candidates(df, who.unionByName(again), doc_id, text).withColumn("people", F.transform("values", lambda v: v["value"])).select("doc_id", "at", "size", "people")
    titles = candidates(df, what, doc_id, text).withColumn("titles", F.transform("values", lambda v: F.substr(v["value"], F.lit(3)))).select("doc_id", "at", F.col("size").alias("title_size"), "titles")
    # an author's places with the work that stands one blank behind, and works that no author stands before
    joined = names.withColumn("then", F.col("at") + F.col("size") + 1).join(titles.select("doc_id", F.col("at").alias("then"), "title_size", "titles"), ["doc_id", "then"], "left")
    alone = titles.join(joined.where("titles IS NOT NULL").select("doc_id", F.col("then").alias("at")), ["doc_id", "at"], "left_anti").join(names.select("doc_id", "at"), ["doc_id", "at"], "left_anti")
    rows = joined.select("doc_id", "at", "size", "people", "title_size", "titles").unionByName(alone.select("doc_id", "at", F.lit(0).alias("size"), F.lit(None).cast("array<string>").alias("people"), "title_size", "titles"))
    told = F.filter("people", lambda p: F.startswith(p, F.lit("a:")))
    told = F.transform(told, lambda p: F.substr(p, F.lit(3)))
    of = lambda t: F.substring_index(t, "\n", 1)
    having = F.filter(told, lambda p: F.exists(F.coalesce("titles", F.array().cast("array<string>")), lambda t: of(t) == p))
    known = F.when(F.size(told) == 1, told[0]).when(F.size(having) == 1, having[0])
    rows = rows.withColumn("known", known)
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last("known", ignorenulls=True).over(before))
    stands = F.col("people").isNull() | F.array_contains("people", "=")
    author = F.when(stands, F.col("last")).otherwise(F.col("known"))
    rows = rows.withColumns({"carried": stands, "author": author})
    mine = F.transform(F.filter("titles", lambda t: of(t) == F.col("author")), lambda t: F.substr(t, F.instr(t, "\n") + 1))
    work = F.when(F.size(mine) == 1, mine[0])
    rows = rows.withColumn("work", work)
    size = F.when(F.col("work").isNull(), F.col("size")).otherwise(F.when(F.col("people").isNull(), F.col("title_size")).otherwise(F.col("size") + 1 + F.col("title_size")))
    return rows.where("people IS NOT NULL OR work IS NOT NULL").select("doc_id", "at", size.alias("size"), "author", "work", "carried")
