"""Large files of marked-up entries as tables: files are cut at the entries' closing marks and read in parallel, by ranges of bytes.

A file of any size is split over tasks by Spark's text source, which takes the closing mark for the end of a line; no task
holds more than its range and one entry.  From entries come what dictionaries are built of: keys, senses, derived keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspan.operators import markup as M

OPENING, CLOSING = "<entryFree ", "</entryFree>"


def records(spark: SparkSession, path: str, closing: str = CLOSING) -> DataFrame:
    """(file, at, row, text, final, ended): what stands before each closing mark of the files, and behind the last one.

    ``at`` and ``row`` give the order in a file.  ``final`` is a file's last record, ``ended`` tells whether a mark follows: that
    of the last does if the bytes read would be more than the file has without it.
    """
    if len(closing.encode()) < 4:
        raise ValueError("a closing mark has at least four bytes")
    read = spark.read.option("lineSep", closing).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    length = F.octet_length("text") + len(closing.encode())
    files = rows.groupBy("file", "size").agg(F.sum(length).alias("read"), F.max(F.struct("at", "row")).alias("last"))
    files = files.select(F.col("file").alias("__file"), (F.col("read") <= F.col("size")).alias("whole"), "last")
    told = rows.join(files, F.col("__file") == F.col("file"))
    final = F.struct("at", "row") == F.col("last")
    return told.select("file", "at", "row", "text", final.alias("final"), (~final | F.col("whole")).alias("ended"))


def _opened(opening: str) -> Column:
    return F.position(F.lit(opening), F.col("text"))


def entries(found: DataFrame, opening: str = OPENING, closing: str = CLOSING) -> DataFrame:
    """(file, at, row, entry) of records: each from its opening mark to its closing mark; other text is passed over."""
    whole = F.concat(F.substr("text", _opened(opening)), F.lit(closing))
    return found.where(F.col("ended") & (_opened(opening) > 0)).select("file", "at", "row", whole.alias("entry"))


def faults(found: DataFrame, opening: str = OPENING) -> DataFrame:
    """(file, at, row, fault) of records that a sound file does not have, the first fault of each: an entry that is opened twice,
    never opened or never closed, text before an opening or behind a closing on its line."""
    at = _opened(opening)
    begins = F.min(F.struct("at", "row"))
    firsts = found.groupBy("file").agg(begins.alias("first")).select(F.col("file").alias("__file"), "first")
    told = found.join(firsts, F.col("__file") == F.col("file"))
    first = F.struct("at", "row") == F.col("first")
    head = F.when(at > 0, F.substr("text", F.lit(1), at - 1)).otherwise(F.col("text"))
    blank = lambda c: ~F.regexp_like(c, F.lit(r"\S"))
    before, behind = F.substring_index(head, "\n", -1), F.substring_index(head, "\n", 1)
    twice = F.position(F.lit(opening), F.substr("text", at + 1)) > 0
    fault = (
        F.when((at > 0) & ~F.col("ended"), "never closed")
        .when((at == 0) & F.col("ended"), "never opened")
        .when((at > 0) & twice, "opened twice")
        .when(~first & ~blank(behind), "text behind a closing")
        .when((at > 0) & ~blank(before), "text before an opening")
    )
    return told.select("file", "at", "row", fault.alias("fault")).where("fault IS NOT NULL")


def raw_entries(found: DataFrame, dictionary: str, key: str = "orth", sense: str = "sense", regular: str | None = None) -> DataFrame:
    """(dict, id, keys array, derived array of (sense_id, orths), senses array of (id, level, label), entry, number) of entries.

    Keys are the texts of ``key`` elements right below the root, in order, those that ``regular`` matches if any does; keys
    inside a sense belong to the innermost one they lie in.  An entry has the ``id`` and ``n`` of its root; one without an id
    or a key is an error.  Empty keys count for nothing.
    """
    named = found.withColumn("at", F.struct("file", "at", "row").cast("string"))
    attr = lambda name: F.try_element_at("attrs", F.lit(name)).alias(name)
    node = F.struct("node", "last", "depth", "name", "text", attr("id"), attr("n"), attr("level"))
    # entries are read once; an entry's nodes are one array, in which each element is a slice
    trees = M.nodes(named, "at", "entry").groupBy("doc_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    trees = trees.withColumns({"root": F.get("nodes", F.lit(0)), "marks": F.filter("nodes", lambda x: x["name"] == sense)})
    said = lambda k: F.array_join(F.slice("nodes", k["node"] + 1, k["last"] - k["node"] + 1)["text"], "")
    holder = lambda k: F.try_element_at(F.filter("marks", lambda m: (m["node"] < k["node"]) & (m["last"] >= k["last"])), F.lit(-1))["node"]
    named_keys = F.transform(F.filter("nodes", lambda x: x["name"] == key), lambda k: F.struct(k["depth"].alias("depth"), F.btrim(said(k)).alias("orth"), holder(k).alias("sense")))
    trees = trees.withColumn("orths", F.filter(named_keys, lambda k: k["orth"] != ""))
    own = F.filter("orths", lambda k: k["sense"].isNull() & (k["depth"] == 1))["orth"]
    below = F.transform("marks", lambda m: F.struct(m["id"].alias("sense_id"), F.filter("orths", lambda k: k["sense"] == m["node"])["orth"].alias("orths")))
    listed = F.transform("marks", lambda m: F.struct(m["id"].alias("id"), m["level"].try_cast("int").alias("level"), m["n"].alias("label")))
    told = trees.select("doc_id", F.col("root.id").alias("id"), F.col("root.n").alias("number"), own.alias("keys"), F.filter(below, lambda d: F.size(d["orths"]) > 0).alias("derived"), listed.alias("senses"))
    if regular is not None:
        fit = F.filter("keys", lambda k: F.regexp_like(k, F.lit(regular)))
        told = told.withColumn("keys", F.when(F.size(fit) > 0, fit).otherwise(F.col("keys")))
    stop = lambda what, kind: F.raise_error(F.concat(F.lit(f"an entry without {what}: "), "doc_id")).cast(kind)
    told = told.withColumns({"id": F.coalesce("id", stop("an id", "string")), "keys": F.when(F.size("keys") > 0, F.col("keys")).otherwise(stop("a key", "array<string>"))})
    return told.join(named.select(F.col("at").alias("doc_id"), "entry"), "doc_id").select(F.lit(dictionary).alias("dict"), "id", "keys", "derived", "senses", "entry", "number")


def paragraphs(spark: SparkSession, path: str, pattern: str = r"\r?\n[ \t]*\r?\n") -> DataFrame:
    """(file, at, row, lines array) of text files whose entries are parted by empty lines; lines are trimmed, empty ones go.

    Files are cut at two line ends in a row; where blanks stand between them, the piece is cut once more.
    """
    read = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), "value")
    pieces = read.select("file", "at", "row", F.posexplode(F.split("value", pattern)).alias("part", "text"))
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return pieces.select("file", "at", F.struct("row", "part").alias("row"), lines.alias("lines")).where(F.size("lines") > 0)


def written(rows: DataFrame, entry: Column, path: str) -> None:
    """Write one entry a row as text files below ``path``."""
    rows.select(entry.alias("value")).where("value IS NOT NULL").write.text(path)
