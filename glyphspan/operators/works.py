"""Works of several rows, each with an id, as tokens of a corpus: which works count, where rows break, what lies between words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.functions import text as T


def author_code(author: Column, codes: dict[str, str]) -> Column:
    """An author of one word is its own code; others have one in ``codes``, or the row is an error."""
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]) if codes else F.create_map().cast("map<string,string>")
    code = F.try_element_at(known, author)
    return F.when(~F.contains(author, F.lit(" ")), author).otherwise(F.coalesce(code, F.raise_error(F.concat(F.lit("no code for author "), author)).cast("string")))


def originals(works: DataFrame, codes: dict[str, str], skipped: list[str] | None = None) -> DataFrame:
    """Works (id, name, author, is_translation) but for translations and ``skipped`` ones, with ``author_code``, in order of code and name."""
    kept = works.where(~F.coalesce("is_translation", F.lit(False)) & ~F.col("id").isin(skipped or []))
    return kept.withColumn("author_code", author_code(F.col("author"), codes)).orderBy("author_code", "name")


def scattered_authors(works: DataFrame) -> DataFrame:
    """(author_code, runs) of authors whose works (author_code, ord) do not follow each other; a sound corpus has none."""
    w = Window.orderBy("ord")  # one row a work: a list of works, not of texts
    new = (~F.col("author_code").eqNullSafe(F.lag("author_code").over(w))).cast("int")
    return works.withColumn("new", new).groupBy("author_code").agg(F.sum("new").alias("runs")).where("runs > 1")


def row_kinds(rows: DataFrame) -> DataFrame:
    """Rows (work, row, id array) with ``kind``: none for a work's first row, hard where the id's length or any part but the
    last differs from the row before, else soft."""
    before = F.lag("id").over(Window.partitionBy("work").orderBy("row"))
    head = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
    same = (F.size(before) == F.size("id")) & (head(before) == head(F.col("id")))
    return rows.withColumn("kind", F.when(before.isNull(), "none").when(same, "soft").otherwise("hard"))


def work_tokens(works: DataFrame) -> DataFrame:
    """(work, row, in_row, pos, text, norm, brk, hard_break) of works (work, rows array, row_ids array of arrays).

    ``brk`` is all text up to the next word of the work, line ends between rows included.  A sentence ends where that text has a
    full stop, at a hard row break and at the work's end.
    """
    rows = works.select("work", F.posexplode(F.arrays_zip(F.col("rows").alias("text"), F.col("row_ids").alias("id"))).alias("row", "r")).select("work", "row", "r.text", "r.id")
    rows = row_kinds(rows)
    lead = F.regexp_extract("text", f"^([{T._SET}]*)", 1)  # before the first word
    words = rows.select("work", "row", "kind", lead.alias("lead"), T.word_list(F.col("text")).alias("w"), T.breaks(F.col("text")).alias("b"))
    each = words.select("work", "row", "kind", "lead", F.posexplode_outer(F.arrays_zip("w", "b")).alias("in_row", "p"))
    # what a row puts before its own first word belongs to the word before; rows without words pass it on
    begin = F.when(F.coalesce("in_row", F.lit(0)) == 0, F.concat(F.when(F.col("kind") == "none", "").otherwise("\n"), "lead")).otherwise("")
    order = Window.partitionBy("work").orderBy("row", "in_row")
    marked = each.select("work", "row", "in_row", "kind", begin.alias("begin"), F.col("p.w").alias("text"), F.coalesce("p.b", F.lit("")).alias("own"))
    number = F.sum(F.col("text").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("number", number)
    hard_row = (F.col("kind") == "hard") & (F.coalesce("in_row", F.lit(0)) == 0)
    # text behind word n: its own break, and what rows without words and the next word's row begin with
    parts = marked.select("work", (F.col("number") - F.col("text").isNotNull().cast("int")).alias("behind"), "row", "in_row", "begin", hard_row.alias("hard_row"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "in_row", "begin"))), lambda x: x["begin"]), "")
    behind = parts.groupBy("work", "behind").agg(joined.alias("more"), F.bool_or("hard_row").alias("hard_row"))
    tokens = marked.where(F.col("text").isNotNull()).join(behind.withColumnRenamed("behind", "number"), ["work", "number"], "left")
    last = F.col("number") == F.max("number").over(Window.partitionBy("work"))
    brk = F.concat("own", F.coalesce("more", F.lit("")))
    hard = F.contains(brk, F.lit(".")) | F.coalesce("hard_row", F.lit(False)) | last
    return tokens.select("work", "row", "in_row", (F.col("number") - 1).cast("int").alias("pos"), "text", T.normal(F.col("text")).alias("norm"), brk.alias("brk"), hard.alias("hard_break"))


# Enclitics cut from words, apostrophes, and what a swallowed vowel stood for.
CUT_ENCLITICS = ("que", "ne", "ve", "ue", "met", "cum", "dum")


def decomposed(token: Column) -> Column:
    """Array of the ways to read a token as words: with a swallowed ``est`` restored, and with one enclitic cut off."""
    t = F.regexp_replace(F.btrim(token), "[’‘`]", "'")
    first, rest = F.substring_index(t, "'", 1), F.concat(F.lit("e"), F.substring_index(t, "'", -1))
    est = F.lit("est")
    less = lambda n: F.substr(t, F.lit(1), F.char_length(t) - n)
    base = (
        F.when(F.contains(t, F.lit("'")), F.when(first == "", F.array(F.array(rest))).otherwise(F.array(F.array(first, rest))))
        .when(F.endswith(t, F.lit("ust")), F.array(F.array(t), F.array(less(1), est)))
        .when(F.endswith(t, F.lit("st")), F.array(F.array(t), F.array(less(2), est)))
        .otherwise(F.array(F.array(t)))
    )

    def readings(words: Column) -> Column:
        splits = [_without(words, e) for e in CUT_ENCLITICS]
        return F.array_compact(F.array(words, *[F.when(F.size(x) > F.size(words), x) for x in splits]))

    return F.flatten(F.transform(base, readings))


def _without(words: Column, enclitic: str) -> Column:
    """The words, those that end in the enclitic cut in two."""

    def cut(w: Column) -> Column:
        ends = F.endswith(w, F.lit(enclitic)) & (~F.endswith(w, F.lit("que")) if enclitic == "ue" else F.lit(True))
        return F.when(ends, F.array(F.substr(w, F.lit(1), F.char_length(w) - len(enclitic)), F.lit(enclitic))).otherwise(F.array(w))

    return F.flatten(F.transform(words, cut))


def with_translations(works: DataFrame) -> DataFrame:
    """Works (id, title, translator, is_translation, translation_id) with ``translation``: (id, translator, title) of the work named
    by ``translation_id``, if that is a translation; else null."""
    told = works.where("is_translation").select(F.col("id").alias("translation_id"), F.struct("id", "translator", "title").alias("translation"))
    return works.join(told, "translation_id", "left").select(*works.columns, "translation")
