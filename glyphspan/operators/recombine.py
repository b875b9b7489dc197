"""Works put together again from the poems of a file: neighbours with like titles are one work, and its lines get ids.

Poems are rows (file, ord, author, title, subtitle, poem_title, poem_number, lines array of (line, text)), in order of ``ord``, a
whole number that no two poems of a file share.  What goes on from poem to poem is found by blocks of the order first, so a
file with a large part of all poems is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000
POEM = ("file", "ord", "author", "title", "subtitle", "poem_title", "poem_number", "lines")
#: Shapes of works by the parts of their lines' ids.
SHAPES = {"book, poem, line": ("book", "poem", "line"), "poem, line": ("poem", "line"), "lines": ("poem", "line"), "book, line": ("book", "line")}


def title_key(title: Column) -> Column:
    """A struct that is equal for like titles: those that differ in case, colons or a last whole number only; a title with such a
    number is not like one without.  Null is like null alone."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(title, r"^\s+|\s+$", "")), ":", " ")
    numbered = F.regexp_like(plain, F.lit(r"(?s)^(.* )?-?[0-9]+\z"))
    return F.when(title.isNotNull(), F.struct(numbered.alias("numbered"), F.when(numbered, F.regexp_replace(plain, r"-?[0-9]+\z", "")).otherwise(plain).alias("stem")))


def poem_title(title: Column, subtitle: Column, own: Column) -> Column:
    """What a poem is called: its subtitle; where that is only ``poems``, its own title, or without one the work's."""
    return F.when(subtitle != "poems", subtitle).when(own != "", own).otherwise(title)


def whole(text: Column) -> Column:
    """A text of digits, perhaps after a minus, as a number; else null."""
    return F.when(F.regexp_like(text, F.lit(r"^-?[0-9]+\z")), text.try_cast("bigint"))


def runs(rows: DataFrame, by: str, order: str, key: Column, block: int = BLOCK) -> DataFrame:
    """The rows with ``run``: the order of the first of all neighbours in a key ``by`` that are alike in ``key``.

    Rows are dealt by key and block of the order; of a block only its last row's likeness and the order of its last new run go
    on to the next.
    """
    marked = rows.withColumns({"__key": F.to_json(F.struct(key.alias("k")), {"ignoreNullFields": "false"}), "__block": F.floor(F.col(order) / block)})
    inside, earlier = Window.partitionBy(by, "__block").orderBy(order), Window.partitionBy(by).orderBy("__block")
    ends = marked.groupBy(by, "__block").agg(F.max_by("__key", order).alias("__last"))
    entered = ends.select(F.col(by).alias("__by"), F.col("__block").alias("__at"), F.lag("__last").over(earlier).alias("__entered"))
    same = lambda a: F.col("__by").eqNullSafe(F.col(by)) & (F.col(f"__{a}") == F.col("__block"))
    before = F.coalesce(F.lag("__key").over(inside), F.col("__entered"))
    told = marked.join(entered, same("at")).withColumn("__new", F.when(~F.col("__key").eqNullSafe(before), F.col(order))).drop("__by", "__at")
    starts = told.groupBy(by, "__block").agg(F.max("__new").alias("__start"))
    carried = starts.select(F.col(by).alias("__by"), F.col("__block").alias("__at"), F.max("__start").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    own = F.max("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return told.join(carried, same("at")).withColumn("run", F.coalesce(own, F.col("__carried"))).select(*rows.columns, "run")


def running(rows: DataFrame, by: list[str], order: str, amount: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The rows with ``name``: the sum of ``amount`` over the rows of the same keys before."""
    marked = rows.withColumns({"__amount": amount, "__block": F.floor(F.col(order) / block)})
    sums = marked.groupBy(*by, "__block").agg(F.sum("__amount").alias("__sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col("__block").alias("__at"), zero(F.sum("__sum").over(earlier(Window.partitionBy(*by).orderBy("__block")))).alias("__start"))
    same = F.col("__at") == F.col("__block")
    for i, k in enumerate(by):
        same = same & F.col(f"__k{i}").eqNullSafe(F.col(k))
    inside = zero(F.sum("__amount").over(earlier(Window.partitionBy(*by, "__block").orderBy(order))))
    return marked.withColumn("__inside", inside).join(starts, same).select(*rows.columns, (F.col("__start") + F.col("__inside")).alias(name))


def recombined(poems: DataFrame, block: int = BLOCK) -> DataFrame:
    """The poems with ``work`` (the order of the work's first poem), ``work_title`` (that poem's title), ``called``, ``shape``, ``book``.

    A work is all neighbours of a file with like titles.  Its shape: ``lines`` for one poem; ``poem, line`` for several of one
    title and subtitle that are all called like it; ``book, poem, line`` where a title and subtitle have several; else ``book,
    line``.  A poem's book is the number that what it is called has behind as many letters as the work's title.
    """
    told = runs(poems, "file", "ord", title_key(F.col("title")), block).withColumnRenamed("run", "work")
    told = told.withColumn("called", poem_title(F.col("title"), F.col("subtitle"), F.col("poem_title")))
    parts = told.groupBy("file", "work", "title", "subtitle").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("called") == F.col("title"), F.lit(False))).alias("alike"), F.min("ord").alias("at"))
    one = parts.groupBy("file", "work").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most"), F.bool_and("alike").alias("alike"), F.min_by("title", "at").alias("work_title"))
    shape = F.when(F.col("n") == 1, "lines").when((F.col("parts") == 1) & F.col("alike"), "poem, line").when(F.col("most") > 1, "book, poem, line").otherwise("book, line")
    works = one.select(F.col("file").alias("__file"), F.col("work").alias("__work"), "work_title", shape.alias("shape"))
    told = told.join(works, F.col("__file").eqNullSafe(F.col("file")) & (F.col("__work") == F.col("work"))).drop("__file", "__work")
    rest = F.btrim(F.substr("called", F.char_length("work_title") + 1))
    return told.withColumn("book", F.when(F.startswith("shape", F.lit("book")), whole(rest)))


def faults(poems: DataFrame) -> DataFrame:
    """(file, ord, fault) of recombined poems that do not fit the shape of their work, the first fault of each."""
    books, singular = F.startswith("shape", F.lit("book")), F.regexp_replace("work_title", r"s\z", "")
    fault = (
        F.when(books & ~F.col("title").eqNullSafe(F.col("work_title")), "title is not the work's")
        .when(books & ~F.coalesce(F.startswith("called", singular), F.lit(False)), "not called like the work")
        .when(books & F.col("book").isNull(), "no number of a book")
        .when(F.contains("shape", F.lit("poem")) & (F.coalesce(F.btrim("poem_number"), F.lit("")) == ""), "no number of a poem")
    )
    return poems.select("file", "ord", fault.alias("fault")).where("fault IS NOT NULL")


def _poem_id(poems: DataFrame) -> Column:
    number, book = F.btrim(F.coalesce("poem_number", F.lit(""))), F.coalesce(F.col("book").cast("string"), F.lit(""))
    return F.when(F.col("shape") == "lines", F.array(F.lit("1"))).when(F.col("shape") == "poem, line", F.array(number)).when(F.col("shape") == "book, line", F.array(book)).otherwise(F.array(book, number))


def work_lines(poems: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, work, row, id array, text) of recombined poems: a work's lines, numbered from 0, with ids after the work's shape.

    A part that is missing is an empty text; ``faults`` lists such poems.  Texts are kept letter by letter.
    """
    placed = running(poems.withColumn("id", _poem_id(poems)), ["file", "work"], "ord", F.coalesce(F.size("lines"), F.lit(0)), "start", block)
    each = placed.select("file", "work", "start", "id", F.posexplode("lines").alias("i", "l"))
    return each.select("file", "work", (F.col("start") + F.col("i")).alias("row"), F.concat("id", F.array(F.btrim(F.coalesce("l.line", F.lit(""))))).alias("id"), "l.text")


def work_pages(poems: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, work, id array, first, behind): the rows of each poem, a page of its work."""
    size = F.coalesce(F.size("lines"), F.lit(0))
    placed = running(poems.withColumn("id", _poem_id(poems)), ["file", "work"], "ord", size, "first", block)
    return placed.select("file", "work", "id", "first", (F.col("first") + size).alias("behind"))


def catalogue(poems: DataFrame, authors: dict[str, str] | None = None) -> DataFrame:
    """(file, work, title, author, shape, parts array, poems): one row a work; an author has the name in ``authors``, if any."""
    known = F.create_map(*[F.lit(x) for pair in authors.items() for x in pair]) if authors else F.create_map().cast("map<string,string>")
    parts = F.create_map(*[x for k, v in SHAPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = poems.groupBy("file", "work").agg(F.min_by("author", "ord").alias("author"), F.first("work_title").alias("title"), F.first("shape").alias("shape"), F.count(F.lit(1)).alias("poems"))
    return each.select("file", "work", "title", F.coalesce(F.try_element_at(known, F.col("author")), "author").alias("author"), "shape", F.element_at(parts, F.col("shape")).alias("parts"), "poems")
