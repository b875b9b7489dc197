"""Finite automata over ordered lines as a parallel prefix, and articles cut out of a stream of lines by one.

What a block of lines does is a map from the state before it to the state behind it, whatever came before; maps of blocks
compose.  So a file of any size is dealt over tasks: blocks of ``BLOCK`` lines give maps, groups of ``BLOCK`` blocks give
maps of maps, a file's groups are composed from its first state on, and the states go down again to groups, blocks and lines.
All of it is Spark's own functions: folds over arrays of at most ``BLOCK`` entries (and, at the top, an entry for each
``BLOCK`` x ``BLOCK`` lines), joined by (file, number of the block).

Lines are numbered from 0 within their file without gaps, as ``numbered_lines`` does for texts; a file is an id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspan.functions.text import let

BLOCK = 512


@dataclass(frozen=True)
class Automaton:
    """Transitions (state, class of a line) -> (next state, action); what is not named is an error that shows as the action ``error``
    and leaves the state as it is."""

    states: Sequence[str]
    classes: Sequence[str]
    steps: Mapping[tuple[str, str], tuple[str, str]]
    start: str

    def _table(self, pick) -> Column:
        every = ((s, c) for s in self.states for c in self.classes)
        return F.array(*(F.lit(pick(*self.steps.get(k, (k[0], "error")))) for k in every))

    def following(self, state: Column, kind: Column) -> Column:
        """The number of the state behind a line of a class, both as numbers."""
        return F.get(self._table(lambda state, action: self.states.index(state)), state * len(self.classes) + kind)

    def action(self, state: Column, kind: Column) -> Column:
        return F.get(self._table(lambda state, action: action), state * len(self.classes) + kind)

    def class_number(self, kind: Column) -> Column:
        """The number of a class's name; another name is an error."""
        number = F.array_position(F.array(*map(F.lit, self.classes)), kind) - 1
        return F.when(number >= 0, number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no class of lines: "), F.coalesce(kind, F.lit("null")))).cast("int"))


def numbered_lines(df: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line, text): the lines of each text, from 0; a null text has none."""
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(F.col(text), "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def _running(items: Column, start: Column, step) -> Column:
    """The values before each item of an array, and behind the last, of a fold."""
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(items, F.array(start), lambda seen, x: F.concat(seen, F.array(step(last(seen), x))))


def _grouped(maps: DataFrame, block: int) -> DataFrame:
    """(file, block, maps): the maps of ``block`` neighbouring blocks in order."""
    put = F.array_sort(F.collect_list(F.struct(F.col("block"), F.col("map"))))
    return maps.groupBy("file", F.floor(F.col("block") / block).alias("group")).agg(put.alias("members"))


def _composed(states: int, members: Column) -> Column:
    """The map that maps in a row are together."""
    begin = F.array(*map(F.lit, range(states)))
    return F.transform(begin, lambda s: F.aggregate(members, s, lambda now, m: F.get(m["map"], now)))


def with_states(lines: DataFrame, automaton: Automaton, kind: Column, block: int = BLOCK) -> DataFrame:
    """(file, line, text, kind, state, action): the state before each line and what the line does.

    ``kind`` gives a line's class by name."""
    n = len(automaton.states)
    told = lines.select("file", "line", "text", automaton.class_number(kind).alias("kind"))
    row = F.struct("line", "text", "kind")
    blocks = told.groupBy("file", F.floor(F.col("line") / block).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    begin = F.array(*map(F.lit, range(n)))
    maps = blocks.select("file", "block", F.transform(begin, lambda s: F.aggregate("rows", s, lambda now, r: automaton.following(now, r["kind"]))).alias("map"))
    groups = _grouped(maps, block)
    tops = groups.select("file", F.col("group").alias("block"), _composed(n, F.col("members")).alias("map"))
    # a file's groups: one entry for each block * block lines
    files = tops.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("groups"))
    first = F.lit(automaton.states.index(automaton.start))
    through = lambda members, start: _running(members, start, lambda now, m: F.get(m["map"], now))
    entered = files.select("file", F.explode(F.arrays_zip(F.transform("groups", lambda g: g["block"]).alias("group"), through(F.col("groups"), first).alias("state"))).alias("e"))
    entered = entered.select("file", "e.group", "e.state").where("group IS NOT NULL")
    inside = groups.join(entered, ["file", "group"])
    inside = inside.select("file", F.explode(F.arrays_zip(F.transform("members", lambda m: m["block"]).alias("block"), through(F.col("members"), F.col("state")).alias("state"))).alias("e"))
    inside = inside.select("file", "e.block", "e.state").where("block IS NOT NULL")
    states = _running(F.col("rows"), F.col("state"), lambda now, r: automaton.following(now, r["kind"]))
    each = blocks.join(inside, ["file", "block"]).select("file", F.explode(F.arrays_zip("rows", F.slice(states, F.lit(1), F.size("rows")).alias("state"))).alias("e"))
    names = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    out = each.select("file", "e.rows.line", "e.rows.text", F.col("e.rows.kind").alias("__kind"), F.col("e.state").alias("__state"))
    kind, state = F.col("__kind"), F.col("__state")
    return out.select("file", "line", "text", names(automaton.classes, kind).alias("kind"), names(automaton.states, state).alias("state"), automaton.action(state, kind).alias("action"))


def totals(rows: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over the lines before each in its file; summed by blocks and groups of blocks first."""
    marked = rows.withColumns({"__v": F.coalesce(value, F.lit(0)).cast("long"), "__block": F.floor(F.col("line") / block)})
    sums = marked.groupBy("file", "__block").agg(F.sum("__v").alias("__n"))
    tops = sums.groupBy("file", F.floor(F.col("__block") / block).alias("__group")).agg(F.array_sort(F.collect_list(F.struct("__block", "__n"))).alias("members"), F.sum("__n").alias("__n"))
    files = tops.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("__group", "__n"))).alias("groups"))

    def spread(above: DataFrame, items: str, at: str, start: Column) -> DataFrame:
        """(file, at, __start): what comes before each of the items of an array."""
        run = F.slice(_running(F.col(items), start, lambda now, x: now + x["__n"]), F.lit(1), F.size(items))
        each = F.zip_with(F.transform(items, lambda x: x[at]), run, lambda i, n: F.struct(i.alias(at), n.alias("__start")))
        return above.select("file", F.explode(each).alias("e")).select("file", f"e.{at}", "e.__start")

    of_groups = spread(files, "groups", "__group", F.lit(0).cast("long"))
    of_blocks = spread(tops.join(of_groups, ["file", "__group"]), "members", "__block", F.col("__start"))
    lines = marked.groupBy("file", "__block").agg(F.array_sort(F.collect_list(F.struct("line", F.col("__v").alias("__n")))).alias("lines"))
    of_lines = spread(lines.join(of_blocks, ["file", "__block"]), "lines", "line", F.col("__start"))
    return rows.join(of_lines.withColumnRenamed("__start", name), ["file", "line"])


def counted(rows: DataFrame, what: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The rows with ``name``: on how many of this and the lines before it in the file ``what`` holds."""
    one = F.when(what, 1).otherwise(0)
    return totals(rows, one, name, block).withColumn(name, F.col(name) + one)


# --- articles

BEFORE, BETWEEN, IN, ENDING = "before", "between", "in", "ending"
START, BLANK, KEY, MARK, LETTER, SENSE, JOINED, OTHER = "start", "blank", "key", "mark", "letter", "sense", "joined", "other"

#: Entries begin behind the line that starts them; an article begins with its key, with a mark or a list's sign; two blank lines
#: end it, one is part of it, unless the line behind it goes on in the paragraph before, which takes the blank line back.
ARTICLES = Automaton(
    states=(BEFORE, BETWEEN, IN, ENDING),
    classes=(START, BLANK, KEY, MARK, LETTER, SENSE, JOINED, OTHER),
    start=BEFORE,
    steps={(BEFORE, c): (BEFORE, "skip") for c in (BLANK, KEY, MARK, LETTER, SENSE, JOINED, OTHER)}
    | {(BEFORE, START): (BETWEEN, "skip")}
    | {(BETWEEN, BLANK): (BETWEEN, "skip"), (BETWEEN, LETTER): (BETWEEN, "skip"), (BETWEEN, KEY): (IN, "open"), (BETWEEN, MARK): (IN, "open"), (BETWEEN, SENSE): (IN, "add")}
    | {(IN, c): (IN, "add") for c in (START, KEY, MARK, LETTER, SENSE, JOINED, OTHER)}
    | {(IN, BLANK): (ENDING, "add")}
    | {(ENDING, c): (IN, "add") for c in (START, MARK, LETTER, SENSE, OTHER)}
    | {(ENDING, BLANK): (BETWEEN, "add"), (ENDING, KEY): (IN, "open"), (ENDING, JOINED): (IN, "join")},
)


@dataclass(frozen=True)
class ArticleMarks:
    """What the lines of a dictionary in plain text look like: regular expressions of Spark, each for a whole line's class.

    ``bold`` begins a line that opens an article between articles, ``key`` one that opens it behind a single blank line, too."""

    start: str
    key: str
    bold: str = r"^<b>"
    mark: str = r"^(----[^-]|/\*$)"
    letter: str = r"^[A-Z]\.$"
    sense: str = r"^([A-Za-z0-9]|I|II|III|IV|V)(\.|$)"
    joined: tuple[str, ...] = ()
    end: str | None = None
    note: str | None = r"^\[\*\*[^\]]+\]$"

    def kind(self, text: Column) -> Column:
        """The class of a line; a bold line without a whole key is like a list's mark."""
        joined = text.isin(*self.joined) if self.joined else F.lit(False)
        return (
            F.when(text.rlike(self.start), START)
            .when(F.trim(text) == "", BLANK)
            .when(text.rlike(self.key), KEY)
            .when(text.rlike(self.bold) | text.rlike(self.mark), MARK)
            .when(joined, JOINED)
            .when(text.rlike(self.letter), LETTER)
            .when(text.rlike(self.sense), SENSE)
            .otherwise(OTHER)
        )


def rejoined(lines: DataFrame, dash: str = "-*") -> DataFrame:
    """Lines whose last word ends in ``dash`` without it, and the next line, which goes on with ``*``, with the whole word.

    Only neighbouring lines meet, by an equality join on their numbers."""
    pattern = F.regexp_extract("text", r" ([^ ]+)-\*$", 1)
    torn = lines.select("file", (F.col("line") + 1).alias("line"), pattern.alias("torn")).where("torn <> ''")
    cut = F.regexp_replace("text", r" [^ ]+-\*$", "")
    whole = F.when(F.col("torn").isNotNull() & F.startswith("text", F.lit("*")), F.concat("torn", F.substr("text", F.lit(2)))).otherwise(F.col("text"))
    return lines.join(torn, ["file", "line"], "left").withColumn("text", whole).withColumn("text", cut).drop("torn")


def wanted_lines(lines: DataFrame, marks: ArticleMarks, block: int = BLOCK) -> DataFrame:
    """Lines up to the one that ends the entries, without lines that are only a note, numbered anew."""
    if marks.end is not None:
        ends = lines.where(F.col("text") == marks.end).groupBy("file").agg(F.min("line").alias("__end"))
        lines = lines.join(ends, "file", "left").where("__end IS NULL OR line < __end").drop("__end")
    if marks.note is None:
        return lines
    kept = counted(lines, ~F.col("text").rlike(marks.note), "__n", block).where(~F.col("text").rlike(marks.note))
    return kept.select("file", (F.col("__n") - 1).alias("line"), "text")


def articles(lines: DataFrame, marks: ArticleMarks, block: int = BLOCK) -> DataFrame:
    """(file, article, line, text): the lines of each article, numbered from 0 within the file; ``line`` is the line's number in what is read.

    A line that stands between articles and opens none is an error.  A blank line goes if the next line joins the paragraph before."""
    told = with_states(wanted_lines(rejoined(lines), marks, block), ARTICLES, marks.kind(F.col("text")), block)
    numbered = counted(told, F.col("action") == "open", "article", block)
    taken = numbered.where("action = 'join'").select("file", (F.col("line") - 1).alias("line"))
    kept = numbered.join(taken, ["file", "line"], "left_anti")
    wrong = F.raise_error(F.concat(F.lit("a line between articles that opens none: "), F.col("text")))
    text = F.when(F.col("action") != "error", F.col("text")).otherwise(wrong.cast("string"))
    return kept.where("action <> 'skip'").select("file", (F.col("article") - 1).alias("article"), "line", text.alias("text"))


def article_texts(rows: DataFrame) -> DataFrame:
    """(file, article, first, lines): each article's lines in order, and the number of its first."""
    lines = F.array_sort(F.collect_list(F.struct("line", "text")))
    each = rows.groupBy("file", "article").agg(lines.alias("__lines"))
    return each.select("file", "article", F.col("__lines")[0]["line"].alias("first"), F.transform("__lines", lambda x: x["text"]).alias("lines"))


# --- keys of articles

# Fixed value: the sign that stands for the part of a key that the article before has.
DASH = "----"


def key_parts(key: Column) -> Column:
    """The parts of a key: words and what stands between them (a dash for the key before, a hyphen, a comma, a blank)."""
    parts = F.regexp_extract_all(F.regexp_replace(key, " -", "-"), F.lit(r"----|-|, | |(?:(?!----|, )[^ -])+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p == ", ", ",").otherwise(p))


def whole_keys(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, article, key): keys that begin with a dash with what the last key without one has in its place: its first word.

    ``keys``: (file, article, key), articles without gaps.  The key to take is found by counting keys without a dash by blocks
    of articles and an equality join, so no file is one task's work."""
    rows = keys.select("file", F.col("article").alias("line"), "key")
    own = ~F.startswith("key", F.lit(DASH))
    told = counted(rows, own, "__n", block)
    heads = told.where(own).select("file", "__n", F.regexp_extract("key", r"^[^ ,-]+", 0).alias("__head"))
    whole = F.when(own, F.col("key")).otherwise(F.concat(F.coalesce("__head", F.lit("")), F.substr("key", F.lit(len(DASH) + 1))))
    return told.join(heads, ["file", "__n"], "left").select("file", F.col("line").alias("article"), whole.alias("key"))


def first_key(text: Column, pattern: str = r"<b>([^<>]+)</b>") -> Column:
    """What a line gives as its key, or null."""
    return let(F.regexp_extract(text, pattern, 1), lambda k: F.when(k != "", F.trim(k)))
