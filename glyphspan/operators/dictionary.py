"""Dictionaries: entries and headwords, lookups by key, prefix, suffix and id, several at once, and by inflection.

Headwords are one table for all dictionaries, told apart by a column, so a lookup in several is one scan.  Keys and queries
are cleaned alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.functions import text as T


def headwords(entries: DataFrame, dictionary: str, entry_id: str, key: str) -> DataFrame:
    """(dict, id, orth, sense_id, clean_orth): one headword an entry."""
    rows = entries.select(F.lit(dictionary).alias("dict"), F.col(entry_id).cast("string").alias("id"), F.col(key).alias("orth"))
    return rows.select("*", F.lit(None).cast("string").alias("sense_id"), T.clean_key(F.col("orth")).alias("clean_orth"))


def build(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (dict, id, entry, number) and headwords of raw entries (dict, id, keys array, derived array of (sense_id, orths), entry, number).

    Derived headwords belong to a sense of their entry, its own keys to the entry as a whole.
    """
    own = raw.select("dict", "id", F.explode("keys").alias("orth"), F.lit(None).cast("string").alias("sense_id"))
    derived = raw.select("dict", "id", F.explode("derived").alias("d")).select("dict", "id", F.explode("d.orths").alias("orth"), F.col("d.sense_id").alias("sense_id"))
    orths = own.unionByName(derived).withColumn("clean_orth", T.clean_key(F.col("orth")))
    return raw.select("dict", "id", "entry", "number"), orths


def fused(sources: list[DataFrame]) -> DataFrame:
    """Headwords of several dictionaries."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def lookup(orths: DataFrame, query: str) -> DataFrame:
    """Headwords under the key of ``query`` whose vowel lengths do not contradict it."""
    return orths.where((F.col("clean_orth") == T.clean_key(F.lit(query))) & T.compatible_lengths(F.lit(query), F.col("orth")))


def by_prefix(orths: DataFrame, query: str) -> DataFrame:
    """Headwords that begin with the query; a query ``-x`` asks for those that end in x."""
    if query.startswith("-") and len(query) > 1:
        return orths.where(F.endswith("clean_orth", T.clean_key(F.lit(query[1:]))))
    return orths.where(F.startswith("clean_orth", T.clean_key(F.lit(query))))


def entries_for(words: DataFrame, entries: DataFrame, orths: DataFrame, word: str = "word") -> DataFrame:
    """(word, dict, id, entry, include_main, subsections): the entries of each word, with the senses its headwords belong to."""
    asked = words.select(F.col(word).alias("word")).distinct().withColumn("clean_orth", T.clean_key(F.col("word")))
    found = asked.hint("merge").join(orths, "clean_orth").where(T.compatible_lengths(F.col("word"), F.col("orth")))
    sense = F.when(F.col("sense_id").isNotNull(), F.struct(F.col("sense_id").alias("id"), F.col("orth").alias("name")))
    each = found.groupBy("word", "dict", "id").agg(F.bool_or(F.col("sense_id").isNull()).alias("include_main"), F.array_sort(F.collect_set(sense)).alias("subsections"))
    return each.join(entries, ["dict", "id"]).select("word", "dict", "id", "entry", "include_main", "subsections")


def _base(lemma: Column) -> Column:
    return F.substring_index(lemma, "#", 1)


def by_inflection(analyses: DataFrame, entries: DataFrame, orths: DataFrame, words: DataFrame, word: str = "word") -> DataFrame:
    """(word, dict, id, how, inflections): entries under a word itself and under the lemmata it can be a form of.

    ``how``: 1 where the word is a form of a lemma spelled like it, 2 where it is a headword, 3 where it is a form of another
    lemma; the least counts.  A lemma with a number (``base#2``) asks for entries of that number, or without one.
    """
    plain = T.clean_key(F.col("word"))
    exact = entries_for(words, entries, orths, word).select("word", "dict", "id", F.lit(2).alias("how"), F.lit(None).cast("struct<lemma:string,mask:int>").alias("inflection"))
    formed = analyses.withColumns({"clean_orth": T.clean_key(_base(F.col("lemma"))), "wanted": F.regexp_extract("lemma", "#([0-9]+)$", 1)})
    formed = formed.hint("merge").join(orths.where("sense_id IS NULL").select("dict", "id", "clean_orth").distinct(), "clean_orth").join(entries.select("dict", "id", "number"), ["dict", "id"])
    formed = formed.where((F.col("wanted") == "") | F.col("number").isNull() | (F.col("wanted") == F.col("number").cast("string")))
    bent = formed.select("word", "dict", "id", F.when(F.col("clean_orth") == plain, 1).otherwise(3).alias("how"), F.struct("lemma", "mask").alias("inflection"))
    return exact.unionByName(bent).groupBy("word", "dict", "id").agg(F.min("how").alias("how"), F.array_sort(F.collect_set("inflection")).alias("inflections"))


def completions(orths: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """(dict, orth): at most ``limit`` different headwords of each dictionary; i and j, and u and v are one letter each."""
    spelled = lambda c: F.translate(T.clean_key(c), "vj", "ui")
    found = orths.where(F.startswith(spelled(F.col("orth")), spelled(F.lit(query)))).select("dict", "orth", "clean_orth").distinct()
    first = F.row_number().over(Window.partitionBy("dict").orderBy("clean_orth", "orth"))
    return found.withColumn("r", first).where(F.col("r") <= limit).select("dict", "orth")
