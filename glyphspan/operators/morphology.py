"""Work on analyses of words: like ones made one, verbs with a prefix, numerals, an index of stems, order of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspan.functions import text as T
from glyphspan.functions.inflection import category_mask, mask_of

# The values of a category that one analysis may hold together, in the order in which categories are merged.
TOGETHER = {"case": ("case:ablative", "case:dative"), "gender": ("gender:feminine", "gender:masculine", "gender:neuter")}


def consolidated(analyses: DataFrame, by: list[str], mask: str = "mask") -> DataFrame:
    """(by, mask): analyses of a cluster ``by`` (such as word, lemma and form) with what others say already left out.

    An analysis whose features are all in another's goes.  Then those that differ only in being ablative or dative become one,
    and so do those that differ only in gender.  A cluster holds the analyses of one form; all groupings keep its partitioning.
    """
    masks = analyses.groupBy(*by).agg(F.collect_set(mask).alias("__masks"))
    inside = lambda m, o: (m != o) & (m.bitwiseAND(o) == m)
    most = F.filter("__masks", lambda m: ~F.exists("__masks", lambda o: inside(m, o)))
    rows = masks.select(*by, F.explode(most).alias(mask))
    for name, values in TOGETHER.items():
        whole, some = category_mask(name), mask_of(*values)
        may = F.col(mask).bitwiseAND(F.lit(whole & ~some)) == 0
        rest = F.when(may, F.col(mask).bitwiseAND(F.lit(~whole))).otherwise(F.col(mask))
        rows = rows.groupBy(*by, may.alias("__may"), rest.alias("__rest")).agg(F.bit_or(mask).alias(mask)).select(*by, mask)
    return rows


def assimilated(preverb: Column, prefix: Column) -> Column:
    """Whether a prefix is spelled with another last letter before its verb."""
    less = lambda c: F.substr(c, F.lit(1), F.char_length(c) - 1)
    return (F.char_length(preverb) == F.char_length(prefix)) & (less(preverb) == less(prefix)) & (preverb != prefix)


def preverb_splits(words: DataFrame, prefixes: DataFrame, word: str = "word") -> DataFrame:
    """(word, preverb, prefix, base): distinct words that begin with a preverb of ``prefixes`` (preverb, prefix), and what follows it.

    Beginnings are compared without diacritics.  Each word's beginnings join the table by equality.
    """
    own = words.select(F.col(word).alias("word")).distinct()
    begins = own.withColumn("__plain", T.strip_diacritics(F.lower("word"))).withColumn("__n", F.explode(F.sequence(F.lit(1), F.char_length("__plain"))))
    longest = prefixes.agg(F.max(F.char_length("preverb")).alias("__most"))  # one row
    begins = begins.join(F.broadcast(longest), F.col("__n") <= F.col("__most")).where(F.col("__n") < F.char_length("__plain"))
    begins = begins.withColumn("preverb", F.substr("__plain", F.lit(1), F.col("__n")))
    return begins.hint("merge").join(prefixes, "preverb").select("word", "preverb", "prefix", F.substr("word", F.col("__n") + 1).alias("base"))


def preverbed(splits: DataFrame, verbs: DataFrame) -> DataFrame:
    """(word, preverb, prefix, base, then the columns of ``verbs``): verbs behind a preverb.

    ``verbs`` (word, form, ...) are analyses of the bases as verbs.  A form behind an assimilated preverb begins with its last letter.
    """
    found = splits.hint("merge").join(verbs.withColumnRenamed("word", "base"), "base")
    same = F.startswith("form", F.right("preverb", F.lit(1)))
    return found.where(~assimilated(F.col("preverb"), F.col("prefix")) | same).select("word", "preverb", "prefix", "base", *[c for c in verbs.columns if c != "word"])


def numerals(forms: DataFrame) -> DataFrame:
    """(number, cardinal, ordinal) of forms (ord, lemma, tags): the first lemma of each kind that is tagged ``arabicN``."""
    tagged = forms.select("ord", "lemma", "tags", F.explode(F.filter("tags", lambda t: t.rlike("^arabic[0-9]+$"))).alias("tag"))
    first = lambda kind: F.min_by(F.when(F.array_contains("tags", kind), F.col("lemma")), F.when(F.array_contains("tags", kind), F.struct("ord", "lemma")))
    return tagged.groupBy(F.substr("tag", F.lit(7)).cast("long").alias("number")).agg(first("card").alias("cardinal"), first("ord").alias("ordinal"))


# The digit before a key, by the code of an entry; other codes have none.
KEY_DIGITS = {"vb": "1", "wd": "2", "de": "3"}


def stem_index(entries: DataFrame) -> DataFrame:
    """(key, entries): an index of stems and forms (code, stem, lemma, features array), keys without marks of length.

    An entry is the spelling, if it differs from the key, the lemma and the features, with colons between; a stem of no letter
    has the key ``*``.
    """
    bare = F.replace("stem", F.lit("-"), F.lit(""))
    clean = F.translate(bare, "^_+", "")
    digit = F.coalesce(*[F.when(F.col("code") == c, d) for c, d in KEY_DIGITS.items()], F.lit(""))
    key = F.when(clean == "", "*").otherwise(F.concat(digit, clean))
    entry = F.concat_ws(":", F.when(bare == clean, "").otherwise(bare), F.col("lemma"), "features")
    return entries.groupBy(key.alias("key")).agg(F.sort_array(F.collect_set(entry)).alias("entries"))


def out_of_order(table: DataFrame, key: str, number: str) -> DataFrame:
    """Rows whose key is less than that of the row numbered one less; a sorted table has none."""
    before = table.select((F.col(number) + 1).alias(number), F.col(key).alias("__before"))
    return table.join(before, number).where(F.col(key) < F.col("__before")).select(table.columns)
