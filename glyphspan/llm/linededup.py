"""Line dedup: content-defined chunks of lines; passages repeated anywhere in the corpus are removed but for the first.

The lines of a text that are not blank are hashed, and a rolling hash of each two neighbours is taken.  A chunk is two
lines whose rolling hash is less than a neighbouring one, so where chunks begin depends on the lines around alone and
shifts along with them; whatever stands around, two texts that share three lines in a row choose the same chunk in these.
Chosen, too, are two lines of ``LEAST_WORDS`` words together and single lines of so many.  Of chunks of the same lines the
one with the least (doc_id, line) stays.  Any other copy goes, and grows by the line before and the line behind where these
equal those of the copy that stays: the next chunk of a shared passage begins at most two lines on, so a passage is
covered from end to end.  What goes are passages, lines in a row with the blank lines between them, of ``LEAST_WORDS``
words or more; less, which many documents share innocently, stays.

Chunks travel as the hashes of their lines.  That equal hashes mean equal lines is found out by comparing bytes: of all
lines of each hash the least and the largest are taken, and lines of a hash with two different ones go nowhere.

Scale: chunks are written once and those that repeat are read again.  A chunk with over ``HOT`` copies (or a
``HOT_MOST``-th of all, so at most ``HOT_MOST`` chunks, which are broadcast) is dealt into shares of about that many, and
the copy that stays goes to each share.  Other joins are sort-merge joins at every size.

Cases: null text stays null; lines keep their order, line ends are LF; rows repeating doc_id and text are one document and
lose the same lines, rows that share a doc_id with other text are told apart by a hash of the text; a null doc_id comes
first; a passage repeated inside one document stays there once; a passage that stands whole in no single earlier document
is compared chunk by chunk; documents of repeated passages alone become empty texts; an empty table gives no rows; other
columns pass through, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.llm.common import fresh, stored

LEAST_WORDS = 30
HOT = 256
HOT_MOST = 100_000
_ROWS = 20_000
_pair = struct.Struct("<qq")
_FIELDS = [("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("before", pa.int64()), ("behind", pa.int64()), ("places", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("turn", pa.int32())]


def _hash(line: str, mask: int) -> int:
    """As Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return (h - (1 << 64) if h >> 63 else h) & mask


def chunks(text: str, least_words: int = LEAST_WORDS, mask: int = -1) -> Iterator[tuple]:
    """(a, b, n, first, before, behind, places, words) of each chunk: the hashes of its n lines (b is 0 for one), its number
    among the filled lines, the hashes of the lines around, and of all four the places in the text and the words."""
    filled = [(i, line) for i, line in enumerate(text.split("\n")) if line and not line.isspace()]
    hashes = [_hash(line, mask) for _, line in filled]
    rolled = [xxhash.xxh64_intdigest(_pair.pack(a, b)) for a, b in zip(hashes, hashes[1:], strict=False)]
    # one place more at the front and two at the end, so that every line has neighbours
    hashes, places = [None, *hashes, None, None], [None, *(i for i, _ in filled), None, None]
    words = [0, *(len(line.split()) for _, line in filled), 0, 0]
    last = len(rolled) - 1
    for i, r in enumerate(rolled):
        least = (i < last and r <= rolled[i + 1]) or (i > 0 and r < rolled[i - 1]) or last == 0
        if least or words[i + 1] + words[i + 2] >= least_words:
            yield hashes[i + 1], hashes[i + 2], 2, i, hashes[i], hashes[i + 3], places[i : i + 4], words[i : i + 4]
    for i in range(len(filled)):
        if words[i + 1] >= least_words:
            yield hashes[i + 1], 0, 1, i, hashes[i], hashes[i + 2], [*places[i : i + 2], None, places[i + 2]], [*words[i : i + 2], 0, words[i + 2]]


def _found(batches: Iterator[pa.RecordBatch], least_words: int, mask: int) -> Iterator[pa.RecordBatch]:
    turn = 0
    for batch in batches:
        docs, found = [], []

        def rows(docs: list = docs, found: list = found, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            own = [batch.column(c).take(pa.array(docs, pa.int64())) for c in ("id", "version")]
            columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*found, strict=True), _FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays([*own, *columns], ["id", "version", *(name for name, _ in _FIELDS)])

        for at, text in enumerate(batch.column("text")):
            for chunk in chunks(text.as_py(), least_words, mask):
                docs.append(at)
                found.append((*chunk, turn))
                turn = (turn + 1) & 0x7FFFFFFF
                if len(found) >= _ROWS:
                    yield rows()
                    docs.clear()
                    found.clear()
        if found:
            yield rows()


def _unlike(rows: DataFrame, mask: int) -> DataFrame:
    """(h) of the hashes that different lines share."""
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").bitwiseAND(F.lit(mask)).alias("h"), "line")
    return lines.groupBy("h").agg(F.min("line").alias("low"), F.max("line").alias("high")).where("low <> high").select("h")


def repeated_lines(df: DataFrame, doc_id: str, text: str, least_words: int = LEAST_WORDS, hot: int = HOT, mask: int = -1) -> DataFrame:
    """(id, version, first, n) of every passage that goes; version is a hash of the whole text.  ``mask`` shortens hashes (for tests)."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    kind = df.schema[doc_id].dataType.simpleString()
    out = f"id {kind}, version long, a long, b long, n int, first int, before long, behind long, places array<int>, words array<int>, turn int"
    each = stored(rows.mapInArrow(lambda batches: _found(batches, least_words, mask), out), "chunks")
    key = ["a", "b", "n"]
    counted = stored(each.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated")
    share = max(hot, (counted.agg(F.sum("copies")).first()[0] or 0) // HOT_MOST)
    shares = F.broadcast(counted.where(F.col("copies") > share).select(*key, F.ceil(F.col("copies") / share).cast("int").alias("shares")))  # at most HOT_MOST rows
    of_each = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    dealt = each.join(shares, key, "left").withColumn("salt", F.coalesce(F.pmod("turn", "shares"), F.lit(0)))
    wanted = of_each(counted.join(shares, key, "left")).select(*key, "salt")
    some = stored(dealt.join(wanted.hint("merge"), [*key, "salt"], "left_semi"), "copies")

    place = F.struct("id", "first", "version")  # of a document, so a copy of a whole row is not another place
    kept = some.groupBy(*key).agg(F.min(F.struct("id", "first", "version", "before", "behind")).alias("keep"), F.first("shares").alias("shares"))
    gone = some.drop("shares").join(of_each(kept).drop("shares").hint("merge"), [*key, "salt"]).where(~place.eqNullSafe(F.struct("keep.id", "keep.first", "keep.version")))
    gone = gone.withColumns({"grow_before": F.col("before") == F.col("keep.before"), "grow_behind": F.col("behind") == F.col("keep.behind")})
    unlike = stored(_unlike(rows, mask), "unlike")
    if not unlike.isEmpty():  # practically never
        for c in ("a", "b"):
            gone = gone.join(unlike.select(F.col("h").alias(c)).hint("merge"), c, "left_anti")
        for c in ("before", "behind"):
            gone = gone.join(unlike.select(F.col("h").alias(c), F.lit(True).alias("bad")).hint("merge"), c, "left")
            gone = gone.withColumn(f"grow_{c}", F.col(f"grow_{c}") & F.col("bad").isNull()).drop("bad")

    def line(i: int, shift: int | Column) -> Column:
        return F.struct((F.col("first") + shift).alias("number"), F.get("places", F.lit(i)).alias("place"), F.get("words", F.lit(i)).alias("words"))

    covered = F.array(line(1, 0), F.when(F.col("n") == 2, line(2, 1)), F.when(F.col("grow_before"), line(0, -1)), F.when(F.col("grow_behind"), line(3, F.col("n"))))
    lines = gone.select("id", "version", F.explode(F.array_compact(covered)).alias("l")).select("id", "version", "l.*").distinct()
    # lines in a row have one difference between their number and their rank
    passage = F.col("number") - F.row_number().over(Window.partitionBy("id", "version").orderBy("number"))
    runs = lines.withColumn("passage", passage).groupBy("id", "version", "passage").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.sum("words").alias("words"))
    return runs.where(F.col("words") >= least_words).select("id", "version", "first", (F.col("last") - F.col("first") + 1).alias("n"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None, least_words: int = LEAST_WORDS, hot: int = HOT, mask: int = -1) -> DataFrame:
    """All rows and columns of ``df``, ``text`` without repeated passages; ``removed`` names a column for the number of lines gone."""
    gone = repeated_lines(df, doc_id, text, least_words, hot, mask).groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("gone"))
    gone = stored(gone, "removals")
    g, i, v = (fresh(df, n) for n in ("__gone", "__id", "__version"))
    gone = gone.select(F.col("id").alias(i), F.col("version").alias(v), F.col("gone").alias(g))
    joined = df.join(gone.hint("merge"), F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(v)), "left")
    lines = F.split(F.col(text), "\n")
    # the kept stretches lie between the removed ones
    ends = F.concat(F.transform(F.col(g), lambda c: c["first"]), F.array(F.size(lines)))
    begins = F.concat(F.array(F.lit(0)), F.transform(F.col(g), lambda c: c["first"] + c["n"]))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    new = F.when(F.col(g).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    count = F.coalesce(F.aggregate(F.col(g), F.lit(0), lambda s, c: s + c["n"]), F.lit(0))
    columns = [new.alias(c) if c == text else F.col(c) for c in df.columns]
    return joined.select(*columns, *([count.alias(removed)] if removed else []))
