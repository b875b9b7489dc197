"""Tokens and sentences of running text, and vowel lengths restored from analyses.

Tokens here keep every character: words are runs of letters and digits, any other character stands alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphspan.functions import text as T
from glyphspan.functions.inflection import CATEGORIES, category_mask

# Punctuation, and what ends a sentence.
PUNCTUATION = ".,;:?!()[]\"'—-"
SENTENCE_ENDS = ".;:?!"


def char_tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, i, text, start, stop, kind): tokens with their places; kind is word, punctuation or other."""
    each = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)([\p{L}\p{N}]+|.)"), F.lit(1))).alias("i", "text"))
    stop = F.sum(F.char_length("text")).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("text").rlike(r"^[\p{L}\p{N}]"), "word").when(F.contains(F.lit(PUNCTUATION), F.col("text")), "punctuation").otherwise("other")
    return each.select(*keys, "i", "text", (stop - F.char_length("text")).alias("start"), stop.alias("stop"), kind.alias("kind"))


def sentences(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sentence, words array): words and punctuation up to the end of each sentence."""
    said = tokens.where("kind <> 'other'")
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum(F.contains(F.lit(SENTENCE_ENDS), F.col("text")).cast("int")).over(before), F.lit(0))
    listed = said.withColumn("sentence", number).groupBy(*keys, "sentence").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("w"))
    return listed.select(*keys, "sentence", F.transform("w", lambda x: x["text"]).alias("words"))


def with_gaps(spans: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, start, stop, text, given): spans (key, start, stop) of texts and what lies between them."""
    w = Window.partitionBy(key).orderBy("start")
    whole = texts.select(key, F.col(text).alias("whole"), F.char_length(text).alias("size"))
    ends = whole.select(key, F.col("size").alias("start"), F.col("size").alias("stop"), F.lit(False).alias("given"))
    rows = spans.select(key, "start", "stop", F.lit(True).alias("given")).unionByName(ends)
    rows = rows.withColumn("before", F.coalesce(F.lag("stop").over(w), F.lit(0)))
    gap = F.when(F.col("before") < F.col("start"), F.struct(F.col("before").alias("start"), F.col("start").alias("stop"), F.lit(False).alias("given")))
    own = F.when(F.col("given"), F.struct("start", "stop", "given"))
    each = rows.select(key, F.explode(F.array_compact(F.array(gap, own))).alias("s")).select(key, "s.*").join(whole, key)
    return each.select(key, "start", "stop", F.substr("whole", F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"), "given")


def agreeing_lengths(form: Column, word: Column) -> Column:
    """How many long vowels of ``word`` the form has long, too; -1 where one of them is long and the other short."""
    at = lambda w, m: F.transform(F.filter(T.marked_positions(w), lambda x: x["mark"] == m), lambda x: x["position"])
    clash = F.arrays_overlap(at(form, "long"), at(word, "short")) | F.arrays_overlap(at(form, "short"), at(word, "long"))
    return F.when(F.coalesce(clash, F.lit(False)), -1).otherwise(F.size(F.array_intersect(at(form, "long"), at(word, "long"))))


def comparable(a: Column, b: Column) -> Column:
    """Whether one mask names all that the other names, category by category: 1, -1, 0 where both do, else null."""
    less, more = F.lit(True), F.lit(True)
    for name in CATEGORIES:
        m = F.lit(category_mask(name))
        x, y = a.bitwiseAND(m), b.bitwiseAND(m)
        less, more = less & (x.bitwiseAND(y) == x), more & (x.bitwiseAND(y) == y)
    return F.when(less & more, 0).when(less, -1).when(more, 1)


def suggested_forms(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """(token, word, options array, suggested) of tokens (token, word, lemma, mask: what a tagger says) and forms (word, form, lemma, mask).

    Forms that contradict the word's own length marks are out, of the others those stay that agree with most of them.  Of
    several, the first with the tagger's lemma and comparable features is suggested, else the first with equal features.
    """
    key = T.normal(F.col("word"))
    told = tokens.select("token", "word", F.col("lemma").alias("tag_lemma"), F.col("mask").alias("tag_mask"), key.alias("key"))
    met = told.join(forms.select(F.col("word").alias("key"), "form", "lemma", "mask"), "key").withColumn("agree", agreeing_lengths(F.col("form"), F.col("word"))).where("agree >= 0")
    most = F.max("agree").over(Window.partitionBy("token"))
    best = met.withColumn("most", most).where("agree = most")
    same_lemma = F.substring_index("lemma", "#", 1) == F.col("tag_lemma")
    how = comparable(F.col("tag_mask"), F.col("mask"))
    rank = F.when(same_lemma & how.isNotNull(), 1).when(how == 0, 2)
    each = best.groupBy("token", "word", "form").agg(F.min(rank).alias("rank"))
    listed = each.groupBy("token", "word").agg(F.array_sort(F.collect_list("form")).alias("options"), F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "form"))).alias("guess"))
    return listed.select("token", "word", "options", F.when(F.size("options") > 1, F.col("guess.form")).alias("suggested"))


def batches(rows: DataFrame, key: str, order: str, size: int, text: str = "text") -> DataFrame:
    """(key, batch, text): a document's sections, ``size`` at a time and the rest, joined by line ends; null texts are left out."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = rows.where(F.col(text).isNotNull()).select(key, order, text, F.floor(number / size).alias("batch"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return numbered.groupBy(key, "batch").agg(joined.alias(text))


def processed(docs: DataFrame, key: str, processes: dict[str, Callable[[str], str]], text: str = "text") -> DataFrame:
    """(key, processor, output, seconds, error): each process applied to each text inside tasks, with the time it took.

    A process is a plain function of a text, sent to tasks.  If it fails, the row has the error's text and no output, and the
    others go on; null texts have neither.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for at, value in zip(pdf["key"], pdf["text"], strict=True):
                for name, process in processes.items():
                    began, output, error = time.perf_counter(), None, None
                    try:
                        output = None if value is None else str(process(value))
                    except Exception as e:  # whatever the process raises is its result
                        error = f"{type(e).__name__}: {e}"
                    rows.append((at, name, output, time.perf_counter() - began, error))
            yield pd.DataFrame(rows, columns=[key, "processor", "output", "seconds", "error"])

    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return plain.mapInPandas(run, f"{key} {kind}, processor string, output string, seconds double, error string")


def token_starts(text: Column, tokens: Column) -> Column:
    """Array of the places (from 0) of tokens that follow each other in a text; null for one that is not there, which is passed over."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(now: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, now["at"])
        return F.struct(F.when(at > 0, at + F.char_length(t)).otherwise(now["at"]).alias("at"), F.concat(now["found"], F.array(F.when(at > 0, at - 1))).alias("found"))

    return F.aggregate(tokens, begin, step, lambda now: now["found"])
