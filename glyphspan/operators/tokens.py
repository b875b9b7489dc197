"""The token table and what is derived from it: breaks, offsets, postings, statistics.

A document's words are one array; tokens are numbered where it is unnested, so none of this needs a global order and only
the postings and statistics shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glyphspan.functions import text as T


#: Words that a task hands on at once, about.
TOKENS_AT_ONCE = 100_000
#: Bytes of text that are one task's, about.
TEXT_AT_ONCE = 8 << 20


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("words", T.words(F.col(text)))


def tasks_for(docs: DataFrame, text: str = "text") -> int:
    """How many tasks texts are read into words in: one for ``TEXT_AT_ONCE`` bytes of text, and one a core at least.

    What a task holds is so bounded whatever the pieces of files; the lengths of texts are added up for it, in one scan.
    """
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0  # one number
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_AT_ONCE))


def spread(docs: DataFrame, text: str = "text", still: bool = False, together: bool = False) -> DataFrame:
    """The same rows in tasks of like size, however files hold them: reading words is work, and a group of rows may hold all texts.

    ``still``: rows that lie evenly stay where they are, so texts are not written to disk again; for who holds little of a task.
    ``together``: rows of one doc_id follow one another in one task.
    """
    if still and not (together and _repeated_ids(docs)) and _lie_evenly(docs, text):
        return docs
    dealt = docs.repartition(tasks_for(docs, text), "doc_id")
    return dealt.sortWithinPartitions("doc_id") if together else dealt


def _lie_evenly(docs: DataFrame, text: str) -> bool:
    """Whether no piece of files, as tasks read them, has more than a core's share of the text."""
    pieces = docs.groupBy(F.spark_partition_id().alias("piece")).agg(F.sum(F.octet_length(text).cast("long")).alias("size"))
    total, most = pieces.agg(F.sum("size"), F.max("size")).first()  # two numbers
    return (most or 0) <= max(TEXT_AT_ONCE, (total or 0) // docs.sparkSession.sparkContext.defaultParallelism)


def _repeated_ids(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("many")).where("many > 1").isEmpty()


def in_chunks(docs: DataFrame, text: str = "text", **lying: bool) -> DataFrame:
    """(the columns of ``docs`` but ``text``, chunks array): each word of a text together with what follows it.

    One pass of a regular expression; a task hands on some ``TOKENS_AT_ONCE`` words at a time, however many documents lie in a batch.
    ``lying``: how ``spread`` may leave the rows.
    """
    kept, pattern, most = [f for f in docs.schema.fields if f.name != text], T.CHUNK, TOKENS_AT_ONCE  # workers need no module of this package

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        for batch in batches:
            start, many, cut = 0, 0, []
            for i, t in enumerate(batch.column(text)):
                t = t.as_py()
                cut.append(None if t is None else find(t))
                many += len(cut[-1] or ())
                if many >= most or i + 1 == batch.num_rows:
                    some = batch.slice(start, len(cut))
                    yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in kept), pa.array(cut, pa.list_(pa.string()))], [*(f.name for f in kept), "chunks"])
                    start, many, cut = i + 1, 0, []

    return spread(docs, text, **lying).mapInArrow(read, StructType([*kept, StructField("chunks", ArrayType(StringType()))]))


def token_table(docs: DataFrame, **lying: bool) -> DataFrame:
    """(doc_id, source, pos, text, norm, brk, hard_break)."""
    found = in_chunks(docs.select("doc_id", "source", "text"), **lying)
    rows = found.select("doc_id", "source", F.size("chunks").alias("n"), F.posexplode("chunks").alias("pos", "chunk"))
    rows = rows.select("doc_id", "source", "pos", "n", "chunk", T.word_of(F.col("chunk")).alias("text"))
    brk = T.break_of(F.col("chunk"), F.col("text"))
    hard = F.contains("brk", F.lit(".")) | (F.col("pos") == F.col("n") - 1)
    return rows.select("doc_id", "source", "pos", "n", "text", brk.alias("brk")).select("doc_id", "source", "pos", "text", T.normal(F.col("text")).alias("norm"), "brk", hard.alias("hard_break"))


def word_lists(docs: DataFrame) -> DataFrame:
    """(norm, doc_id, positions): each document's places of each word, in order.

    A document's words follow one another in one task, so its lists are made there and nothing is shuffled for them; a task holds
    the document it is at.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            last = held[-1].column("doc_id")[-1] if held else None
            if batch is not None and (not held or batch.column("doc_id")[0].equals(last) and batch.column("doc_id")[-1].equals(last)):
                held.append(batch)  # the same document goes on
                continue
            rows = pa.Table.from_batches([*held, *([] if batch is None else [batch])]) if held else None
            if rows is None:
                break
            rows = rows.combine_chunks()
            ids, none = rows["doc_id"].fill_null(0).to_numpy(), rows["doc_id"].is_null().to_numpy()
            begins = np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1
            end = len(ids) if batch is None else int(begins[-1]) if len(begins) else 0
            held = [] if batch is None else [b for b in rows.slice(end).to_batches() if b.num_rows]
            if not end:
                continue
            words = rows["norm"].slice(0, end).combine_chunks().dictionary_encode()
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            document = np.zeros(end, np.int64)
            document[begins[begins < end]] = 1
            key = np.cumsum(document) * len(words.dictionary) + words.indices.to_numpy()
            pos = rows["pos"].slice(0, end).to_numpy()
            order = np.lexsort((pos, key))
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            at = pa.array(order[first])
            listed = pa.ListArray.from_arrays(pa.array(np.append(first, end), pa.int32()), pa.array(pos[order], pa.int32()))
            doc_ids = rows["doc_id"].combine_chunks().take(at)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(words.indices.take(at)), doc_ids, listed], ["norm", "doc_id", "positions"])

    tokens = token_table(docs, still=True, together=True).select("norm", "doc_id", "pos")
    return tokens.mapInArrow(gather, StructType([StructField("norm", StringType()), docs.schema["doc_id"], StructField("positions", ArrayType(IntegerType()))]))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(norm) of all different words; each document's are made distinct before they are dealt out."""
    words = in_chunks(docs.select("doc_id", text), text).select(F.explode("chunks").alias("chunk")).select(T.word_of(F.col("chunk")).alias("text"))
    return words.select(T.normal(F.col("text")).alias("norm")).distinct()


def stats(tokens: DataFrame) -> DataFrame:
    """Numbers of words, works, different words and sentence ends of a token table."""
    by_word = tokens.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.count_if("hard_break").alias("hard"))
    words = by_word.agg(F.sum("n").alias("total_words"), F.count(F.lit(1)).alias("unique_words"), F.sum("hard").alias("hard_breaks"))
    works = tokens.agg(F.countDistinct("doc_id").alias("total_works"))
    # one row each
    return words.join(F.broadcast(works)).select(F.coalesce("total_words", F.lit(0)).alias("total_words"), "total_works", "unique_words", F.coalesce("hard_breaks", F.lit(0)).alias("hard_breaks"))


def row_breaks(docs: DataFrame) -> DataFrame:
    """(doc_id, row_idx, section, kind): lines as rows, a blank line begins a section; none, soft or hard."""
    lines = F.split("text", "\n")
    rows = docs.select("doc_id", F.posexplode(lines).alias("row_idx", "line"))
    w = Window.partitionBy("doc_id").orderBy("row_idx")
    rows = rows.withColumn("section", F.sum((F.col("line") == "").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("section").over(w)
    return rows.select("doc_id", "row_idx", "section", F.when(before.isNull(), "none").when(before != F.col("section"), "hard").otherwise("soft").alias("kind"))


def offsets(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, start_char, break_char): running offsets of tokens and of what follows them."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("text") + F.char_length("brk")).over(w), F.lit(0))
    return tokens.select("doc_id", "pos", start.alias("start_char"), (start + F.char_length("text")).alias("break_char"))


def posting_sizes(tokens: DataFrame) -> DataFrame:
    """(norm, n, bitmask): postings of each word and whether they are dense enough for a bit mask (over 1 in 32)."""
    sizes = tokens.groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))  # one row
    return sizes.join(F.broadcast(total)).select("norm", "n", (F.col("n") * 32 > F.col("total")).alias("bitmask"))


def author_intervals(docs: DataFrame) -> DataFrame:
    """(source, first_work, last_work, works)."""
    return docs.groupBy("source").agg(F.min("doc_id").alias("first_work"), F.max("doc_id").alias("last_work"), F.count(F.lit(1)).alias("works"))


def holding_all(tokens: DataFrame, words: list[str], section: list[str]) -> DataFrame:
    """(section) of tokens that hold every one of the words, for a search that then looks at these alone."""
    wanted = sorted({w.lower() for w in words})
    return tokens.where(F.col("norm").isin(wanted)).groupBy(*section).agg(F.count_distinct("norm").alias("n")).where(F.col("n") == len(wanted)).select(*section)
