"""Corrections of texts by place: each patch replaces its target, which must stand exactly once at its location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphspan.functions.checks import disjoint

PLACE = ["work", "location"]


def _placed(texts: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches with the texts at their place: where the target starts (from 1; 0: nowhere), and whether it comes again."""
    found = patches.where(F.col("target") != "").join(texts, PLACE, "left")
    found = found.withColumn("start", F.coalesce(F.call_function("locate", F.col("target"), F.col("text")), F.lit(0)))
    again = F.call_function("locate", F.col("target"), F.col("text"), F.col("start") + 1) > 0
    return found.withColumn("again", (F.col("start") > 0) & again)


def patch_faults(texts: DataFrame, patches: DataFrame) -> DataFrame:
    """(work, location, target, fault) of patches that do not apply: unused, used twice, or overlapping another at their place.

    A location may have several texts (work, location, part, text); a target must stand once in them all together.
    """
    placed = _placed(texts, patches)
    uses = placed.groupBy(*PLACE, "target", "replacement").agg(F.sum(F.when(F.col("again"), 2).when(F.col("start") > 0, 1).otherwise(0)).alias("uses"))
    counted = uses.where("uses <> 1").select(*PLACE, "target", F.when(F.col("uses") == 0, "unused").otherwise("used twice").alias("fault"))
    spans = placed.where("start > 0").withColumn("span", F.struct("start", (F.col("start") + F.char_length("target")).alias("stop")))
    clash = spans.groupBy(*PLACE, "part").agg(F.collect_list("span").alias("spans"), F.collect_set("target").alias("targets")).where(~disjoint(F.col("spans"), touching=True))
    return counted.unionByName(clash.select(*PLACE, F.explode("targets").alias("target"), F.lit("overlapping").alias("fault")))


def patched(texts: DataFrame, patches: DataFrame) -> DataFrame:
    """``texts`` (work, location, part, text) with all patches (work, location, target, replacement) applied.

    Patches of one text are put in from its end to its beginning, at places found in the text as it was.  See ``patch_faults`` for
    those that do not apply: a target that comes twice, or overlaps another, is an error here; one that is not there does nothing.
    """
    placed = _placed(texts, patches).where("start > 0")
    each = F.struct("start", (F.col("start") + F.char_length("target")).alias("stop"), "replacement")
    cuts = placed.groupBy(*PLACE, "part").agg(F.sort_array(F.collect_list(each), asc=False).alias("cuts"), F.bool_or("again").alias("again"))
    spans = F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop")))
    sound = ~F.col("again") & disjoint(spans, touching=True)

    def put(text: Column, cut: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), cut["start"] - 1), cut["replacement"], F.substr(text, cut["stop"]))

    new = F.when(sound, F.aggregate("cuts", F.col("text"), put)).otherwise(F.raise_error(F.concat(F.lit("patches twice or overlapping at "), F.col("location").cast("string"))).cast("string"))
    both = texts.join(cuts, [*PLACE, "part"], "left")
    return both.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(new)).select(texts.columns)
