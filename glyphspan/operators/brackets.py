"""Brackets paired by depth, commands with brackets as a node table, and trees told by levels.

A text's brackets are paired by prefix sums: +1 for an opening and -1 for a closing give each its depth, and at one depth
openings and closings take turns, so the next of a depth is the mate.  All of it is windows over one dealing of the rows by
text; a text was one row before, so no group is larger than what a task held already.

Trees told by levels (senses I, 1, a) hang each item on the nearest item before it with a smaller level.  Those are running
maxima, one for each level, taken by blocks of the order first, so one key's items may lie in many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096

# Commands with a bracket behind them, commands with a length, commands that stand alone, those left out with
# all inside them, and the levels of senses, the widest first.
NAMED = (
    "entree gen aut oeuv refch lat es latv grec rub pp qq cl latc pca ital pc des comm etyml up autz el autp refchp Rub etymgr romain hbox gras "
    "overline desv latdim latp latgen freq latpl latpf italp smash qqng"
).split()
MEASURED = "kern raise hskip".split()
ALONE = "par F string dixpc times arabe % thinspace S douzerm break neufrm , goodbreak dixrmchif nobreak penalty5000 hfil unskip".split()
LEFT_OUT = ["comm"]
SENSES = ("Rub", "rub", "pp", "qq", "qqng")
BLURB = " • "


def marks(df: DataFrame, doc_id: str, text: str, opening: str, closing: str, alone: str | None = None) -> DataFrame:
    """(doc_id, i, before, mark, at, step, stray, level): the marks of each text in order, and a row without a mark for its end.

    The patterns are tried in the order opening, closing, alone and match at least one sign.  ``before`` is the text since the
    mark before, ``at`` the mark's place, ``step`` 1, -1 or 0, and ``level`` how many brackets are open behind the mark.  A
    closing where none is open is ``stray`` and has step 0.  Null texts have no rows, empty ones the end's row alone.
    """
    every = "|".join(f"(?:{p})" for p in (opening, closing, alone) if p)
    found = F.arrays_zip(F.split(F.col(text), every).alias("before"), F.regexp_extract_all(F.col(text), F.lit(f"({every})"), F.lit(1)).alias("mark"))
    each = df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("i", "m")).select("doc_id", "i", "m.before", "m.mark")
    kind = F.when(F.col("mark").rlike(f"^(?:{opening})$"), 1).when(F.col("mark").rlike(f"^(?:{closing})$"), -1).otherwise(0)
    up_to = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("before") + F.coalesce(F.char_length("mark"), F.lit(0))
    summed = each.withColumns({"__kind": kind, "at": (F.sum(size).over(up_to) - F.coalesce(F.char_length("mark"), F.lit(0))).cast("int")}).withColumn("__sum", F.sum("__kind").over(up_to))
    # where closings outnumber openings, each new least sum is a closing without an opening
    low = F.least(F.min("__sum").over(up_to), F.lit(0))
    before = F.least(F.coalesce(F.min("__sum").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    told = summed.withColumns({"stray": (F.col("__kind") == -1) & (F.col("__sum") < before), "level": (F.col("__sum") - low).cast("int")})
    return told.select("doc_id", "i", "before", "mark", "at", F.when(F.col("stray"), 0).otherwise(F.col("__kind")).alias("step"), "stray", "level")


def mated(told: DataFrame, carried: Sequence[str] = ("at",)) -> DataFrame:
    """Marks with ``depth`` (of brackets, from 1) and, for each column carried, ``mate_`` and its name: what the mate has there,
    null for what has no mate."""
    depth = F.when(F.col("step") == 1, F.col("level")).when(F.col("step") == -1, F.col("level") + 1)
    row = Window.partitionBy("doc_id", "depth").orderBy("i")
    mate = lambda c: F.when(F.col("step") == 1, F.lead(c).over(row)).when(F.col("step") == -1, F.lag(c).over(row))
    return told.withColumn("depth", depth).withColumns({f"mate_{c}": mate(c) for c in carried})


def bracket_pairs(df: DataFrame, doc_id: str, text: str, opening: str = r"\{", closing: str = r"\}") -> DataFrame:
    """(doc_id, start, stop, depth): the places of each opening and of its closing, null if it has none.  Strays are no pairs."""
    told = mated(marks(df, doc_id, text, opening, closing))
    return told.where("step = 1").select("doc_id", F.col("at").alias("start"), F.col("mate_at").alias("stop"), "depth")


@dataclass(frozen=True)
class Commands:
    """The commands of a text: with a bracket behind them, with a length, alone, and left out with all inside them."""

    named: Sequence[str] = tuple(NAMED)
    measured: Sequence[str] = tuple(MEASURED)
    alone: Sequence[str] = tuple(ALONE)
    left_out: Sequence[str] = tuple(LEFT_OUT)

    def patterns(self) -> tuple[str, str, str]:
        """Of openings, closings, and what stands alone; a backslash that begins no command is the last of these."""
        some = lambda names: "|".join(map(re.escape, names)) or "(?!)"
        return rf"\\(?:{some(self.named)})\{{|\{{", r"\}", rf"\\(?:{some(self.measured)})-?\d\.\d+em|\\(?:{some(self.alone)})|\\(?!\}}|\z)"


def cleaned(text: Column) -> Column:
    """Running text without comments and signs of formulas, ties as blanks, and the y with a breve that fonts gave as another letter."""
    plain = F.replace(F.regexp_replace(text, r"<[^>]*>|\$", ""), F.lit("~"), F.lit(" "))
    return F.replace(F.replace(plain, F.lit("ÿ"), F.lit("ў")), F.lit("Ÿ"), F.lit("Y\u0306"))


def command_nodes(df: DataFrame, doc_id: str, text: str, commands: Commands = Commands(), strict: bool = True) -> DataFrame:
    """The node table (doc_id, node, last, parent, depth, ord, name, attrs, text) of texts with commands and brackets.

    A bracket without a command is named ``nameless`` and left out if nothing is in it; a length is the attribute ``unit``; a
    stray closing is text.  A text with an opening that is never closed or with an unknown command is an error, or, if not
    ``strict``, has no nodes.  Null and empty texts have none.
    """
    opening, closing, alone = commands.patterns()
    told = marks(df, doc_id, text, opening, closing, alone)
    up_to = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    command = F.regexp_extract("mark", rf"^\\({'|'.join(map(re.escape, [*commands.measured, *commands.alone])) or '(?!)'})", 1)
    command = F.when(F.col("step") == 1, F.when(F.col("mark") == "{", F.lit("nameless")).otherwise(F.expr("substring(mark, 2, char_length(mark) - 2)"))).otherwise(command)
    # one text runs on over strays
    shown = F.col("mark").isNull() | F.col("stray")
    run = F.coalesce(F.sum(F.when(~shown, 1).otherwise(0)).over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = F.array_sort(F.collect_list(F.struct("i", "before", F.when(F.col("stray"), F.col("mark")).otherwise("").alias("own"))))
    closes = F.max(F.when(~shown, F.struct("i", "mark", "step", "level", F.when(F.col("mark").isNotNull(), command).alias("name"))))
    rows = told.withColumn("run", run).groupBy("doc_id", "run").agg(pieces.alias("p"), closes.alias("m"))
    said = F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["own"])), "")
    rows = mated(rows.select("doc_id", F.col("run").alias("i"), said.alias("said"), "m.mark", F.coalesce("m.step", F.lit(0)).alias("step"), "m.level", "m.name"), ["i", "name"])
    fault = F.when(F.col("mark") == "\\", F.lit("unknown command")).when((F.col("step") == 1) & F.col("mate_i").isNull(), F.lit("opening without closing"))
    whole = Window.partitionBy("doc_id")
    if strict:
        stop = F.raise_error(F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(": "), fault))
        rows = rows.withColumn("step", F.when(fault.isNotNull(), stop.cast("int")).otherwise(F.col("step")))
    else:
        rows = rows.withColumn("__fault", F.max(fault).over(whole)).where("__fault IS NULL")
    # what stands in brackets left out
    hides = lambda name: F.coalesce(F.col(name).isin(*commands.left_out), F.lit(False)) if commands.left_out else F.lit(False)
    hidden = F.sum(F.when((F.col("step") == 1) & hides("name"), 1).when((F.col("step") == -1) & hides("mate_name"), -1).otherwise(0))
    rows = rows.withColumns({"__behind": hidden.over(up_to), "__ahead": F.coalesce(hidden.over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    has_text = (F.col("said") != "") & (F.col("__ahead") == 0)
    has_mark = F.col("mark").isNotNull() & (F.col("step") >= 0) & (F.col("__behind") == 0) & (F.col("__ahead") == 0)
    solid = F.when(has_text, 1).otherwise(0) + F.when(has_mark & (F.col("name") != "nameless"), 1).otherwise(0)
    rows = mated(rows.drop("mate_i", "mate_name", "depth").withColumn("__solid", F.sum(solid).over(up_to)), ["__solid"])
    kept = has_mark & ((F.col("name") != "nameless") | (F.col("step") == 0) | (F.col("mate___solid") > F.col("__solid")))
    count = F.when(has_text, 1).otherwise(0) + F.when(kept, 1).otherwise(0)
    rows = rows.withColumns({"__text": has_text, "__mark": kept, "__n": F.sum(count).over(up_to)})
    rows = mated(rows.drop("mate___solid", "depth"), ["__n"])
    # a row's text comes before its mark; both lie in the brackets that are open before the mark
    inside = F.coalesce(F.col("level"), F.lit(0)) - F.col("step")
    empty = F.lit(None).cast("map<string,string>")
    unit = F.regexp_extract("mark", r"(\d\.\d+em)$", 1)
    attrs = F.when(unit != "", F.create_map(F.lit("unit"), unit)).otherwise(F.create_map().cast("map<string,string>"))
    text_node = F.when(F.col("__text"), F.struct((F.col("__n") - F.when(F.col("__mark"), 2).otherwise(1)).alias("node"), F.lit(None).cast("bigint").alias("last"), inside.alias("depth"), F.lit(None).cast("string").alias("name"), empty.alias("attrs"), cleaned(F.col("said")).alias("text")))
    mark_node = F.when(F.col("__mark"), F.struct((F.col("__n") - 1).alias("node"), (F.col("mate___n") - 1).alias("last"), inside.alias("depth"), F.col("name"), attrs.alias("attrs"), F.lit(None).cast("string").alias("text")))
    items = rows.select("doc_id", F.explode(F.array_compact(F.array(text_node, mark_node))).alias("t")).select("doc_id", "t.*")
    # each node meets the openings of the depth above it, in order: the last one before is its parent
    roles = F.array(F.struct(F.col("depth").alias("at"), F.lit(True).alias("child")), F.struct((F.col("depth") + 1).alias("at"), F.lit(False).alias("child")))
    both = items.select("*", F.explode(roles).alias("r")).where("r.child OR last IS NOT NULL")
    before = Window.partitionBy("doc_id", "r.at").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("parent", F.last(F.when(~F.col("r.child"), F.col("node")), ignorenulls=True).over(before)).where("r.child")
    ord_ = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("node")) - 1
    whole_numbers = [F.col(c).cast("int").alias(c) for c in ("node", "last", "parent", "depth", "ord")]
    return held.withColumns({"ord": ord_, "last": F.coalesce("last", "node")}).select("doc_id", *whole_numbers, "name", "attrs", "text")


def nearest_smaller(rows: DataFrame, by: str, order: str, level: str, levels: int, block: int = BLOCK) -> DataFrame:
    """The rows with ``parent``, the order of the nearest row before with a smaller level, and ``line``, an array of the orders of
    all whom it hangs on, the topmost first.

    Levels are 0 to ``levels`` - 1; another level, or none, is an error.  ``order`` is a whole number, once in a key.  Last rows
    of each level are found by blocks of the order, blocks are carried on, and inside a block one window does the rest.
    """
    names = [f"__l{i}" for i in range(levels)]
    known = F.when(F.col(level).between(0, levels - 1), F.col(level)).otherwise(F.raise_error(F.concat(F.lit("no level: "), F.coalesce(F.col(level).cast("string"), F.lit("null")))).cast("int"))
    marked = rows.withColumns({"__level": known, "__block": F.floor(F.col(order) / block)})
    at = lambda i: F.max(F.when(F.col("__level") == i, F.col(order)))
    ends = marked.groupBy(by, "__block").agg(*(at(i).alias(n) for i, n in enumerate(names)))
    earlier = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    entered = ends.select(by, "__block", *(F.max(n).over(earlier).alias(n) for n in names))
    inside = Window.partitionBy(by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = marked.join(entered, [by, "__block"])
    seen = met.withColumns({n: F.coalesce(at(i).over(inside), F.col(n)) for i, n in enumerate(names)})
    last = [F.when(F.col("__level") > i, F.col(n)) for i, n in enumerate(names)]
    # a row of a level is still open if none of a smaller level has come since
    open_ = [c if i == 0 else F.when(F.coalesce(c > F.greatest(*last[:i], F.lit(None).cast(rows.schema[order].dataType)), c.isNotNull()), c) for i, c in enumerate(last)]
    line = F.array_compact(F.array(*open_))
    return seen.select(*rows.columns, F.try_element_at(line, F.lit(-1)).alias("parent"), line.alias("line"))


def sense_tree(tree: DataFrame, senses: Sequence[str] = SENSES) -> DataFrame:
    """(doc_id, sense, parent, level, label, path, text) of the topmost nodes of a node table.

    A node named as a sense begins one; its text is the label, and what follows up to the next sense its text.  What comes
    before the first sense is the blurb, with ``sense`` -1, level -2 and the label of a bullet.  ``path`` is the labels from the
    topmost sense down.  A document without nodes has no rows.
    """
    number = F.array_position(F.array(*map(F.lit, senses)), F.col("name")) - 1
    row = Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    # nodes at the top and all inside them know the last topmost node and the last sense before
    top = F.last(F.when(F.col("parent").isNull(), F.struct("node", number.alias("level"))), ignorenulls=True).over(row)
    carried = tree.withColumn("__top", top).withColumn("__sense", F.coalesce(F.last(F.when(F.col("__top.level") >= 0, F.col("__top.node")), ignorenulls=True).over(row), F.lit(-1)))
    own = F.coalesce(F.col("__top.level") >= 0, F.lit(False))
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test & F.col("text").isNotNull(), F.struct("node", "text")))), lambda x: x["text"]), "")
    told = carried.groupBy("doc_id", F.col("__sense").alias("sense")).agg(F.max(F.when(own, F.col("__top.level"))).cast("int").alias("level"), F.trim(joined(own)).alias("label"), joined(~own).alias("text"))
    blurbs = tree.select("doc_id").distinct().join(told.where("sense = -1"), "doc_id", "left")
    blurbs = blurbs.select("doc_id", F.lit(-1).alias("sense"), F.lit(None).cast("int").alias("parent"), F.lit(-2).alias("level"), F.lit(BLURB).alias("label"), F.array(F.lit(BLURB)).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    hung = nearest_smaller(told.where("sense >= 0"), "doc_id", "sense", "level", len(senses))
    # a sense's path takes the labels of those it hangs on, at most one a level
    above = hung.select("doc_id", "sense", F.posexplode_outer("line").alias("i", "up")).join(told.select("doc_id", F.col("sense").alias("up"), F.col("label").alias("up_label")), ["doc_id", "up"], "left")
    paths = above.groupBy("doc_id", "sense").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("up").isNotNull(), F.struct("i", "up_label")))), lambda x: x["up_label"]).alias("above"))
    whole = hung.join(paths, ["doc_id", "sense"]).select("doc_id", "sense", "parent", "level", "label", F.concat("above", F.array("label")).alias("path"), "text")
    return blurbs.unionByName(whole)


def sense_faults(tree: DataFrame, senses: Sequence[str] = SENSES) -> DataFrame:
    """(doc_id, node, fault): senses inside other nodes, without a label, or of another level than their siblings."""
    within = tree.where(F.col("parent").isNotNull() & F.col("name").isin(*senses)).select("doc_id", "node", F.lit("inside another node").alias("fault"))
    told = sense_tree(tree, senses).where("sense >= 0")
    levels = told.groupBy("doc_id", "parent").agg(F.min("level").alias("least"), F.max("level").alias("most")).where("least < most")
    mixed = told.join(levels, (told["doc_id"] == levels["doc_id"]) & told["parent"].eqNullSafe(levels["parent"]), "left_semi")
    return within.unionByName(told.where("label = ''").select("doc_id", F.col("sense").alias("node"), F.lit("no label").alias("fault"))).unionByName(mixed.select("doc_id", F.col("sense").alias("node"), F.lit("siblings of another level").alias("fault")))
