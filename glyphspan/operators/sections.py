"""Sections of marked-up documents found by reference patterns: paths whose steps bear the parts of a section's number.

A pattern such as ``#xpath(/tei:TEI/tei:text//tei:div[@n='$1']/tei:l[@n='$2'])`` is compiled into steps, and the steps into a
plan over the node table (see ``markup``): a step to a child is an equality join on the parent; a step to a descendant takes,
below each node found so far, the topmost nodes that fit, which one ordered window over the document's nodes tells.  Nodes
found by a step never lie inside each other, so the one a node lies in is the last that began before it: no two lists of
nodes of a document are ever paired.

Cases: documents without a fitting node have no row; an attribute that a step asks for may be empty but must be there; a
node that two patterns find is an error, as is a pattern that does not read as one; parts are put in order of their numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.operators.markup import carried_marks

ID = "array<struct<part:int,value:string>>"


class PatternError(ValueError):
    """A pattern that cannot be read."""


@dataclass(frozen=True)
class Step:
    """An element's name, the attribute that holds a part of the number with the part's place, and whether it may lie deeper."""

    name: str
    key: str | None = None
    part: int | None = None
    deeper: bool = False


_STEP = re.compile(r"(?P<slashes>//?)tei:(?P<name>[^/\[\]]+)(?:\[@(?P<key>\w+)='(?P<value>[^']+)'\])?")


def compile_pattern(pattern: str) -> tuple[Step, ...]:
    """The steps of a pattern; an attribute with a fixed value says nothing about the number and is not tested."""
    if not (pattern.startswith("#xpath(") and pattern.endswith(")")):
        raise PatternError(f"not a path: {pattern}")
    path, at, steps = pattern[len("#xpath(") : -1], 0, []
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise PatternError(f"{pattern}: nothing to read at {path[at:]}")
        part = re.fullmatch(r"\$(\d+)", m["value"] or "")
        if part is None and (m["value"] or "").startswith("$"):
            raise PatternError(f"{pattern}: not the number of a part: {m['value']}")
        steps.append(Step(m["name"], m["key"] if part else None, int(part[1]) if part else None, m["slashes"] == "//"))
        at = m.end()
    if not steps:
        raise PatternError(f"{pattern}: no step")
    return tuple(steps)


def parts_of(match_pattern: str) -> int:
    """How many parts a number has: each opening bracket of its pattern captures one."""
    return match_pattern.count("(")


def _fits(tree: DataFrame, step: Step) -> DataFrame:
    found = tree.where(F.col("name") == step.name)
    return found if step.key is None else found.where(F.map_contains_key("attrs", step.key))


def _topmost(candidates: DataFrame, inside: DataFrame | None) -> DataFrame:
    """Candidates below the nodes of ``inside`` (below nothing: all) that lie in no other such candidate.

    Nodes of ``inside`` do not lie inside each other, so the last that began is the one a candidate can lie in."""
    w = Window.partitionBy("doc_id").orderBy("node", "kind")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.withColumns({"kind": F.lit(1), "ids": F.lit(None).cast(ID)})
    if inside is not None:
        marks = inside.select(*(c if c in inside.columns else F.lit(None).cast(t).alias(c) for c, t in candidates.dtypes), F.lit(0).alias("kind"), "ids")
        rows = rows.unionByName(marks)
        # the number of the node of ``inside`` that began last, whether the candidate lies in it, and its parts
        last = F.last(F.when(F.col("kind") == 0, F.struct("node", "last", "ids")), ignorenulls=True).over(before)
        rows = rows.withColumn("home", last).where("kind = 1 AND home.node < node AND home.last >= node").withColumn("ids", F.col("home.ids"))
        before = Window.partitionBy("doc_id", "home.node").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max("last").over(before)
    return rows.withColumn("covered", covered).where("covered IS NULL OR covered < node").drop("covered", "kind", "home")


def matched(tree: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """The nodes that a pattern finds: the columns of ``tree`` and ids, the parts of their numbers as (part, value)."""
    found: DataFrame | None = None
    for i, step in enumerate(steps):
        fits = _fits(tree, step)
        if step.deeper:
            found = _topmost(fits, found)
        elif i == 0:
            found = fits.where("parent IS NULL").withColumn("ids", F.lit(None).cast(ID))
        else:
            found = fits.join(found.select("doc_id", F.col("node").alias("parent"), "ids"), ["doc_id", "parent"]).select(*tree.columns, "ids")
        if step.key is not None:
            own = F.struct(F.lit(step.part).alias("part"), F.col("attrs")[step.key].alias("value"))
            found = found.withColumn("ids", F.concat(F.coalesce("ids", F.array().cast(ID)), F.array(own)))
    return found


def numbered(tree: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """(doc_id, node, last, depth, section array<string>) of all nodes that one of the patterns finds, with the parts of their numbers in order."""
    every: DataFrame | None = None
    for pattern in patterns:
        found = matched(tree, compile_pattern(pattern))
        # the whole pattern's last node may be a step without a part, such as a line inside a numbered poem
        section = F.transform(F.array_sort(F.coalesce("ids", F.array().cast(ID))), lambda x: x["value"])
        each = found.select("doc_id", "node", "last", "depth", section.alias("section"))
        every = each if every is None else every.unionByName(each)
    if every is None:
        raise PatternError("no pattern")
    once = every.groupBy("doc_id", "node", "last", "depth").agg(F.first("section").alias("section"), F.count(F.lit(1)).alias("times"))
    twice = F.raise_error(F.concat(F.lit("two patterns find node "), F.col("node").cast("string"), F.lit(" of document "), F.col("doc_id").cast("string")))
    return once.withColumn("section", F.when(F.col("times") == 1, F.col("section")).otherwise(twice.cast("array<string>"))).drop("times")


def declared_patterns(tree: DataFrame) -> DataFrame:
    """(doc_id, name, pattern, parts): the patterns that documents declare in their own headers for citation."""
    child = lambda above, name: tree.where(F.col("name") == name).join(above.select("doc_id", F.col("node").alias("parent")), ["doc_id", "parent"], "left_semi")
    header = tree.where("name = 'teiHeader' AND depth = 1")
    declared = child(child(header, "encodingDesc"), "refsDecl").where(F.col("attrs")["n"] == "CTS")
    rows = child(declared, "cRefPattern")
    parts = F.char_length(F.regexp_replace(F.col("attrs")["matchPattern"], r"[^(]", ""))
    return rows.select("doc_id", F.col("attrs")["n"].alias("name"), F.col("attrs")["replacementPattern"].alias("pattern"), parts.alias("parts"))


def numbered_as_declared(tree: DataFrame) -> DataFrame:
    """As ``numbered``, each document by the patterns that it declares; each different pattern is one plan over the documents that declare it."""
    declared = declared_patterns(tree).cache()
    every: DataFrame | None = None
    for r in declared.select("pattern", "parts").distinct().orderBy("pattern").collect():
        steps = compile_pattern(r["pattern"])
        if sum(s.part is not None for s in steps) != r["parts"]:
            raise PatternError(f"{r['pattern']}: {r['parts']} parts are declared")
        users = declared.where(F.col("pattern") == r["pattern"]).select("doc_id").distinct()
        each = numbered(tree.join(users, "doc_id", "left_semi"), [r["pattern"]])
        every = each if every is None else every.unionByName(each)
    if every is None:
        return tree.limit(0).select("doc_id", "node", "last", "depth", F.array().cast("array<string>").alias("section"))
    return every


def section_of(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """The columns of ``tree`` and section: the number of the innermost node of ``marks`` (doc_id, node, last, depth, section)
    that a node is or lies in, or an empty array."""
    held = carried_marks(tree, marks, ["section"], own=True)
    innermost = F.element_at("marks", -1)
    return held.withColumn("section", F.when(F.size("marks") > 0, innermost["section"]).otherwise(F.array().cast("array<string>"))).drop("marks")


def section_rows(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, node, last, section): the topmost nodes all of whose content has one number, in order the rows of a text.

    Numbers are compared along the document: where the number does not change up to a node's last one, the node is a row or
    part of one.  White space between rows is none; other text between them is a row with its surroundings' number."""
    w = Window.partitionBy("doc_id").orderBy("node")
    told = section_of(tree, marks)
    changed = (~F.col("section").eqNullSafe(F.lag("section").over(w))).cast("int")
    run = F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("changed", changed).withColumn("run", run)
    ends = told.select("doc_id", F.col("node").alias("last"), F.col("run").alias("run_last"))
    alone = told.join(ends, ["doc_id", "last"]).where("run = run_last")
    above = alone.select("doc_id", F.col("node").alias("parent"))
    rows = alone.join(above, ["doc_id", "parent"], "left_anti")
    return rows.where(F.col("name").isNotNull() | F.col("text").rlike(r"\S")).select("doc_id", "node", "last", "section")
