"""Marked-up documents as node tables: trees of XML or HTML, their navigation, plain text, sections, pages.

A tree is rows (doc_id, node, last, parent, depth, ord, name, attrs, text): nodes are numbered in document order and ``last``
is the greatest number below a node, so everything inside a node is a range of numbers.  Text has nodes of its own, without
name.  Parsing is a document's own business and happens inside tasks; all else are joins, windows and aggregations.
"""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "node int, last int, parent int, depth int, ord int, name string, attrs map<string,string>, text string"
# Elements of HTML that have no end, and those that stand on lines of their own.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("p", "div")
# Nodes that a task hands on at once, and documents that one task reads at most, about.
ROWS_AT_ONCE, DOCUMENTS_A_TASK = 10_000, 1_000


class _Tree:
    """Nodes in document order, built from starts, texts and ends."""

    def __init__(self):
        self.rows: list[list] = []
        self.open: list[int] = []
        self.counts = [0]

    def add(self, name: str | None, attrs: dict | None, text: str | None) -> None:
        parent = self.open[-1] if self.open else None
        self.rows.append([len(self.rows), len(self.rows), parent, len(self.open), self.counts[-1], name, attrs, text])
        self.counts[-1] += 1

    def start(self, name: str, attrs: dict) -> None:
        self.add(name, {k: v or "" for k, v in attrs.items()}, None)
        self.open.append(len(self.rows) - 1)
        self.counts.append(0)

    def end(self, name: str) -> None:
        if name not in (self.rows[i][5] for i in self.open):
            return  # an end without a start
        while self.rows[self.open[-1]][5] != name:
            self._close()
        self._close()

    def _close(self) -> None:
        self.rows[self.open.pop()][1] = len(self.rows) - 1
        self.counts.pop()

    def data(self, text: str) -> None:
        if self.rows and self.rows[-1][5] is None and self.counts[-1] and self.rows[-1][2] == (self.open[-1] if self.open else None):
            self.rows[-1][7] += text
        elif text:
            self.add(None, None, text)

    def finish(self) -> list[list]:
        while self.open:
            self._close()
        return self.rows


def _xml(text: str) -> list[list]:
    tree, parser = _Tree(), expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tree.start, tree.end, tree.data
    parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    return tree.finish()


def _html(text: str) -> list[list]:
    tree = _Tree()

    class Parser(html.parser.HTMLParser):
        def handle_starttag(self, tag, attrs):
            tree.start(tag, dict(attrs))
            if tag in VOID:
                tree.end(tag)

        def handle_startendtag(self, tag, attrs):
            tree.start(tag, dict(attrs))
            tree.end(tag)

        def handle_endtag(self, tag):
            tree.end(tag)

        def handle_data(self, data):
            tree.data(data)

    parser = Parser(convert_charrefs=True)
    parser.feed(text)
    parser.close()
    return tree.finish()


def dealt(docs: DataFrame, doc_id: str) -> DataFrame:
    """The same documents in tasks of about ``DOCUMENTS_A_TASK``, however their files are cut: a group of rows in a file may hold them all."""
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // DOCUMENTS_A_TASK))
    return docs.repartition(tasks, doc_id)


def nodes(df: DataFrame, doc_id: str, markup: str, kind: str = "xml", strict: bool = True) -> DataFrame:
    """(doc_id, node, last, parent, depth, ord, name, attrs, text) of all documents; a broken XML text is an error, or, if not
    ``strict``, has no nodes; null texts have none."""
    read, key = {"xml": _xml, "html": _html}[kind], df.schema[doc_id].dataType.simpleString()

    names = ["doc_id", "node", "last", "parent", "depth", "ord", "name", "attrs", "text"]

    def frame(rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"parent": "Int32"})

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = []  # a frame for each document would cost more than its parsing
        for pdf in batches:
            for at, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                try:
                    rows = read(text) if text else []
                except expat.ExpatError as e:
                    if strict:
                        raise ValueError(f"document {at}: {e}") from e
                    rows = []
                held += [[at, *row] for row in rows]
                if len(held) >= ROWS_AT_ONCE:
                    yield frame(held)
                    held = []
        if held:
            yield frame(held)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(markup).alias("text")).mapInPandas(parsed, f"doc_id {key}, {NODE}")


def children(tree: DataFrame, of: DataFrame, name: str | None = None) -> DataFrame:
    """Rows of ``tree`` whose parents are among ``of`` (doc_id, node)."""
    found = tree.join(of.select("doc_id", F.col("node").alias("parent")), ["doc_id", "parent"], "left_semi")
    return found.where(F.col("name") == name) if name else found


def carried_marks(tree: DataFrame, of: DataFrame, columns: list[str] | None = None, own: bool = False) -> DataFrame:
    """The columns of ``tree`` and marks: the nodes of ``of`` (doc_id, node, last, depth and ``columns``) that each node lies in, the outermost first; with ``own`` also itself.

    Of the marks of one depth a node can lie only in the one that began last, so a single ordered window over a document's
    nodes carries one mark for each depth; what is paired are nodes and the marks they do lie in."""
    deepest = of.agg(F.max("depth")).first()[0]
    mark = F.struct("node", "last", *(columns or []))
    rows = tree.select(*tree.columns, F.lit(1).alias("__kind"), F.lit(None).cast(of.select(mark.alias("m")).schema["m"].dataType).alias("__mark"), F.lit(None).cast("int").alias("__deep"))
    kinds = dict(tree.dtypes)
    key = [c if c in ("doc_id", "node") else F.lit(None).cast(kinds[c]).alias(c) for c in tree.columns]
    marks = of.select(*key, F.lit(0).alias("__kind"), mark.alias("__mark"), F.col("depth").cast("int").alias("__deep"))
    w = Window.partitionBy("doc_id").orderBy("node", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(F.when(F.col("__deep") == d, F.col("__mark")), ignorenulls=True).over(w) for d in range(0 if deepest is None else deepest + 1)]
    inside = lambda m: m.isNotNull() & (m["last"] >= F.col("node")) & (F.lit(own) | (m["node"] < F.col("node")))
    held = F.array(*carried) if carried else F.array(F.col("__mark"))
    told = rows.unionByName(marks).withColumn("__held", held).where("__kind = 1")
    return told.select(*tree.columns, F.filter("__held", inside).alias("marks"))


def descendants(tree: DataFrame, of: DataFrame, name: str | None = None) -> DataFrame:
    """(ancestor, and the columns of ``tree``) of all nodes inside those of ``of`` (rows of a node table)."""
    tree = tree.where(F.col("name") == name) if name else tree
    return carried_marks(tree, of).select(*tree.columns, F.explode("marks").alias("__m")).withColumn("ancestor", F.col("__m.node")).drop("__m")


def ancestors(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, node, above): the elements that each node of ``of`` lies in, as (node, name), the outermost first."""
    elements = tree.where("name IS NOT NULL")
    return carried_marks(of, elements, ["name"]).select("doc_id", "node", F.transform("marks", lambda m: F.struct(m["node"].alias("node"), m["name"].alias("name"))).alias("above"))


def text_of(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, node, text) of the whole text inside each node."""
    inside = descendants(tree.where("name IS NULL"), of)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "")
    return inside.groupBy("doc_id", F.col("ancestor").alias("node")).agg(joined.alias("text"))


def child_profile(tree: DataFrame) -> DataFrame:
    """(name, children, attrs): which elements and which attributes each element is found with."""
    own = tree.where("name IS NOT NULL")
    below = own.select("doc_id", F.col("parent").alias("node"), F.col("name").alias("child"))
    pairs = own.join(below, ["doc_id", "node"], "left")
    return pairs.groupBy("name").agg(F.sort_array(F.collect_set("child")).alias("children"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attrs"))))).alias("attrs"))


def html_text(markup: str | Column) -> Column:
    """Plain text of an HTML body: line ends before and behind paragraphs and divisions and before breaks, entities resolved.

    Scripts and styles are no text.  Null gives null.
    """

    @F.pandas_udf("string")
    def plain(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else _plain(_html(p)) for p in pages], dtype=object)

    return plain(markup if isinstance(markup, Column) else F.col(markup))


def _plain(rows: list[list]) -> str:
    ends: dict[int, int] = {}
    out, hidden = [], -1
    body = next((r for r in rows if r[5] == "body"), None)
    for node, last, _, _, _, name, _, text in rows:
        for at in sorted(a for a in ends if a < node):
            out.extend("\n" * ends.pop(at))
        if body is not None and not body[0] <= node <= body[1]:
            continue
        if name in ("script", "style"):
            hidden = max(hidden, last)
        if name in BLOCKS or name == "br":
            out.append("\n")
        if name in BLOCKS:
            ends[last] = ends.get(last, 0) + 1
        if name is None and node > hidden:
            out.append(text.replace("\xa0", " "))
    return "".join(out) + "\n" * sum(ends.values())


def sections(tree: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, node, section): the topmost nodes that hold exactly one section; ``marks``: (doc_id, node, section) of its first node.

    A node counts the sections that begin inside it or, where none does, the one it stands in; so rows cover the text once.
    """
    begins = marks.select("doc_id", F.col("node").alias("mark"), "section")
    order = Window.partitionBy("doc_id").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    here = tree.join(begins, (tree["doc_id"] == begins["doc_id"]) & (tree["node"] == begins["mark"]), "left").select(tree["*"], "section")
    here = here.withColumns({"current": F.last("section", ignorenulls=True).over(order), "begun": F.count("section").over(order)})
    at_end = here.select(F.col("doc_id"), F.col("node").alias("last"), F.col("begun").alias("begun_last"))
    counted = here.join(at_end, ["doc_id", "last"])
    # the sections in a node: those that begin behind it, and the one in force at it unless a new one begins at its own first text
    own = F.col("begun_last") - F.col("begun")
    single = counted.where((own == 0) & F.col("current").isNotNull())
    above = single.select("doc_id", F.col("node").alias("parent"), F.lit(True).alias("inside"))
    return single.join(above, ["doc_id", "parent"], "left").where("inside IS NULL").select("doc_id", "node", F.col("current").alias("section"))


def pages(rows: DataFrame, parts: int) -> DataFrame:
    """(doc_id, page, first, last): runs of rows (doc_id, row, id array) whose ids begin alike, by all parts but the last.

    A page that comes twice is an error of the document and shows as two rows.
    """
    size = parts if parts == 1 else parts - 1
    w = Window.partitionBy("doc_id").orderBy("row")
    page = F.when(F.size("id") >= size, F.slice("id", 1, size))
    marked = rows.withColumn("page", page)
    new = (~F.col("page").eqNullSafe(F.lag("page").over(w))).cast("int")
    runs = marked.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("page IS NOT NULL").groupBy("doc_id", "run", "page").agg(F.min("row").alias("first"), F.max("row").alias("last")).select("doc_id", "page", "first", "last")


def nav_tree(page_rows: DataFrame) -> DataFrame:
    """(doc_id, id, parent, first): every beginning of a page's id, with the one above."""
    ids = page_rows.select("doc_id", "first", F.explode(F.transform(F.sequence(F.lit(1), F.size("page")), lambda n: F.slice("page", F.lit(1), n))).alias("id"))
    return ids.groupBy("doc_id", "id").agg(F.min("first").alias("first")).select("doc_id", "id", F.slice("id", F.lit(1), F.size("id") - 1).alias("parent"), "first")


# Dashes at which a line goes on in the next, and ends of clauses.
DASHES, CLAUSE_ENDS = "-‐‑", ".;:!?"


def merged_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, section, text) of lines (doc_id, row, section, text): a section's lines joined by blanks, a line that ends in a
    dash with the next one; where a section ends so, what completes it, up to the end of a clause, comes from the next."""

    @F.pandas_udf("array<struct<section:string,text:string>>")
    def folded(docs: pd.Series) -> pd.Series:
        return pd.Series([_folded([(x["section"], x["text"]) for x in lines]) for lines in docs], dtype=object)

    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "section", "text"))).alias("lines"))
    return docs.select("doc_id", F.posexplode(folded("lines")).alias("ord", "s")).select("doc_id", "ord", "s.section", "s.text")


def _folded(lines: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[list] = []
    open_ = False  # the last line of the section before ended in a dash
    joins = False
    for section, text in lines:
        text = (text or "").strip()
        if not out or out[-1][0] != section:
            open_, joins = joins, False
            out.append([section, []])
        if open_ and len(out) > 1:
            cut = next((i for i, c in enumerate(text) if c in CLAUSE_ENDS), text.rfind(" "))
            out[-2][1][-1] += text[: cut + 1]
            text, open_ = text[cut + 1 :].strip(), False
        if not text:
            continue
        dash = text[-1] in DASHES
        if joins:
            out[-1][1][-1] += text[:-1] if dash else text
        else:
            out[-1][1].append(text[:-1] if dash else text)
        joins = dash
    return [(section, " ".join(parts)) for section, parts in out]


def abbreviations(df: DataFrame, text: str, table: dict[str, str], ignore_case: bool = False) -> DataFrame:
    """``df`` with ``expansions``: array of (start, length, expansion), longest keys first, at the beginning of words.

    ``table`` is a list of abbreviations such as a dictionary's; it goes to every task and must be small.
    """
    keys = sorted(table, key=lambda k: (-len(k), k))
    found = re.compile("(?:^|(?<=[ ()\\[\\];—-]))(?:" + "|".join(map(re.escape, keys)) + ")", re.IGNORECASE if ignore_case else 0)
    by_key = {k.lower() if ignore_case else k: v for k, v in table.items()}
    shared = df.sparkSession.sparkContext.broadcast((found, by_key, ignore_case))

    @F.pandas_udf("array<struct<start:int,length:int,expansion:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        pattern, known, low = shared.value
        return pd.Series([[(m.start(), len(m[0]), known[m[0].lower() if low else m[0]]) for m in pattern.finditer(t or "")] if keys else [] for t in texts], dtype=object)

    return df.withColumn("expansions", spans(F.col(text)))


# Signs that markup writes as entities.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def _escaped(text: Column) -> Column:
    for sign, entity in ENTITIES:
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def markup_of(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, node, markup): each node of ``of`` with all inside it written as XML; read again it gives the same tree."""
    inside = descendants(tree, of).unionByName(tree.join(of.select("doc_id", "node"), ["doc_id", "node"], "left_semi").withColumn("ancestor", F.col("node")))
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), _escaped(a["value"]), F.lit('"'))), "")
    name, empty = F.col("name"), F.col("last") == F.col("node")
    begin = F.when(name.isNull(), _escaped(F.col("text"))).otherwise(F.concat(F.lit("<"), name, F.coalesce(attrs, F.lit("")), F.when(empty, "/>").otherwise(">")))
    end = F.when(name.isNotNull() & ~empty, F.concat(F.lit("</"), name, F.lit(">")))
    # an element ends behind the last node in it, the deepest first
    parts = F.array(F.struct(F.col("node").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("depth"), begin.alias("part")), F.struct(F.col("last").alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("depth"), end.alias("part")))
    each = inside.select("doc_id", "ancestor", F.explode(parts).alias("p")).where("p.part IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    return each.groupBy("doc_id", F.col("ancestor").alias("node")).agg(joined.alias("markup"))


def without_brackets(text: Column) -> Column:
    """A short text without what stands in round or square brackets; a bracket of the other kind inside does not end it."""
    begin = F.struct(F.lit("").alias("open"), F.lit("").alias("kept"))

    def step(now: Column, c: Column) -> Column:
        closer = F.when(c == "(", ")").when(c == "[", "]")
        ends = F.startswith(now["open"], c) & (now["open"] != "")
        less = F.substr(now["open"], F.lit(1), F.char_length(now["open"]) - 1)
        opened = F.when(closer.isNotNull(), F.concat(now["open"], closer)).when(ends, less).otherwise(now["open"])
        kept = F.when(closer.isNull() & ~ends & (now["open"] == ""), F.concat(now["kept"], c)).otherwise(now["kept"])
        return F.struct(opened.alias("open"), kept.alias("kept"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), begin, step, lambda now: now["kept"])


def blurbs(tree: DataFrame, of: DataFrame, letters: int = 35, skipped: tuple[str, ...] = ("etym",)) -> DataFrame:
    """(doc_id, node, blurb): how the text of each node begins, for outlines of entries.

    Texts count up to the one that brings more than ``letters``, behind which stand dots; those inside ``skipped`` elements do not.
    Then bracketed parts go, and all from the first colon on.  A node without text has no row.
    """
    hidden = tree.where(F.col("name").isin(*skipped))
    texts = descendants(tree.where("name IS NULL"), of).select("doc_id", "ancestor", "node", "text")
    gone = descendants(tree.where("name IS NULL").select("doc_id", "node"), hidden).select("doc_id", "node").distinct()
    w = Window.partitionBy("doc_id", "ancestor").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    counted = texts.join(gone, ["doc_id", "node"], "left_anti").withColumn("upto", F.sum(F.char_length("text")).over(w))
    first = counted.where(F.col("upto") - F.char_length("text") <= letters)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "")
    each = first.groupBy("doc_id", F.col("ancestor").alias("node")).agg(joined.alias("text"), F.max("upto").alias("upto"))
    shown = F.concat("text", F.when(F.col("upto") > letters, " ...").otherwise(""))
    return each.select("doc_id", "node", F.substring_index(without_brackets(shown), ":", 1).alias("blurb"))


def text_matches(tree: DataFrame, of: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, node, match, parts): what a regular expression finds in the text of each node of ``of``, whatever elements it runs across.

    ``parts`` is an array of (node, start, stop): the stretches of the text nodes that the match is made of.
    """

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[m.span() for m in re.finditer(pattern, t or "") if m[0]] for t in texts], dtype=object)

    texts = descendants(tree.where("name IS NULL"), of).select("doc_id", "ancestor", F.struct("node", "text").alias("t"))
    # a node's texts are one row, so places are counted without another shuffle
    each = texts.groupBy("doc_id", "ancestor").agg(F.array_sort(F.collect_list("t")).alias("texts"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<node:int,start:int,stop:int>>").alias("spans"))

    def place(now: Column, t: Column) -> Column:
        stop = now["at"] + F.char_length(t["text"])
        return F.struct(stop.alias("at"), F.concat(now["spans"], F.array(F.struct(t["node"].alias("node"), now["at"].alias("start"), stop.alias("stop")))).alias("spans"))

    spans = F.aggregate("texts", begin, place, lambda now: now["spans"])
    whole = F.array_join(F.transform("texts", lambda t: t["text"]), "")
    matched = each.select("doc_id", F.col("ancestor").alias("node"), whole.alias("whole"), spans.alias("spans")).withColumn("m", F.explode(found("whole")))
    inside = F.filter("spans", lambda s: (s["start"] < F.col("m.stop")) & (s["stop"] > F.col("m.start")))
    cut = lambda s: F.struct(s["node"].alias("node"), (F.greatest(s["start"], F.col("m.start")) - s["start"]).alias("start"), (F.least(s["stop"], F.col("m.stop")) - s["start"]).alias("stop"))
    return matched.select("doc_id", "node", F.substr("whole", F.col("m.start") + 1, F.col("m.stop") - F.col("m.start")).alias("match"), F.transform(inside, cut).alias("parts"))
