"""Vowel lengths from text to text: words are analysed, a tagger's words are aligned with them, and the forms chosen are written
back into the text.

The tagger is given each word, with an enclitic as a word of its own where all analyses of a word have one, and everything
between words; so its words are met by running offsets, one window over a text's pieces.  What is chosen depends on the word
and on what the tagger says of it, so each different pair of them is decided once.  Forms have ``_`` behind long vowels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.functions import text as T
from glyphspan.operators.language import suggested_forms

PIECES = r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"


def displayed(form: Column, word: Column) -> Column:
    """The word's own letters with a macron behind those that the form has long; null where form and word differ in their number.

    Signs for short vowels and for the parts of a compound are left out."""
    chunks = F.split(F.regexp_replace(form, r"[+^\-]", ""), "_")
    place = lambda now, c: F.struct((now["at"] + F.char_length(c)).alias("at"), F.concat(now["out"], F.array(F.substr(word, now["at"] + 1, F.char_length(c)))).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(chunks, begin, place, lambda now: F.when(now["at"] == F.char_length(word), F.array_join(now["out"], T.MACRON)))


def recased(form: Column, word: Column) -> Column:
    """The letters of a word, without its own signs of length, with the macrons that a form has on the same letters."""
    longs = F.transform(F.filter(T.marked_positions(form), lambda m: m["mark"] == "long"), lambda m: m["position"])
    letters = F.regexp_extract_all(word, F.lit(r"(\P{M}\p{M}*)"), F.lit(1))
    marked = F.transform(letters, lambda c, i: F.when(F.array_contains(longs, i), F.concat(c, F.lit(T.MACRON))).otherwise(c))
    return F.when(form.isNotNull(), F.array_join(marked, ""))


def pieces(texts: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc_id, i, raw, is_word): words and what lies between them, which together are the text.  An empty or null text is one
    row without ``i`` and ``raw``, and ``is_word`` is null for a null text."""
    found = F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(1))).alias("i", "raw")
    each = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).isNull().alias("__none"), found)
    return each.select("doc_id", "i", "raw", F.when(~F.col("__none"), F.coalesce(F.col("raw").rlike(r"^[\p{L}\p{M}]"), F.lit(False))).alias("is_word"))


def placed(parts: DataFrame, forms: DataFrame) -> DataFrame:
    """Pieces with ``enclitic`` and ``j``, the number of the tagger's word where each begins.

    Of a word whose analyses (word, enclitic) all have enclitics, the least one is cut off."""
    cut = forms.groupBy("word").agg(F.when(F.count("enclitic") == F.count(F.lit(1)), F.min("enclitic")).alias("enclitic")).where("enclitic IS NOT NULL")
    met = parts.withColumn("__key", F.when(F.col("is_word"), T.normal(F.col("raw")))).join(cut.withColumnRenamed("word", "__key"), "__key", "left")
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("enclitic").isNull(), 1).otherwise(2)
    return met.withColumn("j", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int")).select(*parts.columns, "enclitic", "j")


def given(parts: DataFrame) -> DataFrame:
    """(doc_id, j, text, space): what a tagger is given of placed pieces, words without their signs of length."""
    plain = F.when(F.col("is_word"), T.strip_lengths(F.col("raw"))).otherwise(F.col("raw"))
    stem = F.char_length(plain) - F.char_length("enclitic")
    cut = F.array(F.struct(F.col("j"), F.substr(plain, F.lit(1), stem).alias("text")), F.struct((F.col("j") + 1).alias("j"), F.substr(plain, stem + 1, F.char_length("enclitic")).alias("text")))
    whole = F.array(F.struct(F.col("j"), plain.alias("text")))
    each = parts.where("raw IS NOT NULL").select("doc_id", (~F.col("is_word")).alias("space"), F.explode(F.when(F.col("enclitic").isNotNull(), cut).otherwise(whole)).alias("w"))
    return each.select("doc_id", "w.j", "w.text", "space")


def misaligned(parts: DataFrame, tagged: DataFrame) -> DataFrame:
    """(doc_id, j, text, tagged): what a tagger (doc_id, j, text) was given and gave back otherwise, null where one has no word."""
    there = tagged.select("doc_id", "j", F.col("text").alias("tagged"))
    return given(parts).join(there, ["doc_id", "j"], "full").where(~F.col("text").eqNullSafe(F.col("tagged"))).select("doc_id", "j", "text", "tagged")


def words_with_forms(parts: DataFrame, forms: DataFrame, tagged: DataFrame) -> DataFrame:
    """Pieces with ``options``, the forms that a word can have, and ``suggested``, one of several that the tagger speaks for.

    forms: (word: key, form, lemma, mask, enclitic); tagged: (doc_id, j, text, lemma, mask).  A tagger's word that is not the
    beginning of the word at its place says nothing.  Words without forms have no options.
    """
    said = tagged.select("doc_id", "j", F.col("text").alias("__said"), F.col("lemma").alias("__lemma"), F.col("mask").alias("__mask"))
    met = parts.join(said, ["doc_id", "j"], "left")
    fits = F.col("is_word") & F.coalesce(F.startswith(T.strip_lengths(F.col("raw")), F.col("__said")), F.lit(False))
    word = F.when(F.col("is_word"), F.col("raw"))
    told = met.select(*parts.columns, word.alias("__word"), F.when(fits, F.col("__lemma")).alias("__lemma"), F.when(fits, F.col("__mask")).alias("__mask"))
    kinds = told.where("__word IS NOT NULL").select(F.struct("__word", "__lemma", "__mask").alias("token"), F.lower("__word").alias("word"), F.col("__lemma").alias("lemma"), F.col("__mask").alias("mask")).distinct()
    shown = forms.select("word", displayed(F.concat("form", F.coalesce("enclitic", F.lit(""))), F.col("word")).alias("form"), "lemma", "mask").where("form IS NOT NULL")
    chosen = suggested_forms(kinds, shown).select("token.*", F.transform("options", lambda o: recased(o, T.strip_lengths(F.col("token.__word")))).alias("options"), recased(F.col("suggested"), T.strip_lengths(F.col("token.__word"))).alias("suggested"))
    # lemma and mask of untagged words are null, and nulls meet
    same = [told["__word"] == chosen["__word"], told["__lemma"].eqNullSafe(chosen["__lemma"]), told["__mask"].eqNullSafe(chosen["__mask"])]
    return told.join(chosen, same, "left").select(*(told[c] for c in parts.columns), F.coalesce("options", F.array().cast("array<string>")).alias("options"), "suggested")


def macronised(texts: DataFrame, forms: DataFrame, tagged: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc_id, text): each text with the lengths of the words that have one form or a suggested one; the rest is as it was."""
    chosen = words_with_forms(placed(pieces(texts, doc_id, text), forms), forms, tagged)
    now = F.coalesce("suggested", F.when(F.size("options") == 1, F.col("options")[0]), F.col("raw"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("i", now.alias("now"))))), lambda x: x["now"]), "")
    return chosen.groupBy("doc_id").agg(F.when(F.count("is_word") > 0, joined).alias("text"))
