"""Cross-references between entries: written terms find the key they most likely mean, by rules in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of terms that no key begins like, and what to try instead.
ENDINGS = (("ISE", "IZE"), ("IES", "Y"))
STEPS = 10


def _readings(term: Column, fillers: list[str]) -> list[Column]:
    """A term and simpler readings of it, null where they do not apply."""
    plain = F.regexp_replace(F.split(F.replace(term, F.lit("-*"), F.lit("-")), ",")[0], r"[(\[][^)\]]*", "")
    plain = F.regexp_replace(F.btrim(F.replace(plain, F.lit("  "), F.lit(" "))), r"\.$", "")
    undashed = F.replace(plain, F.lit("-"), F.lit(""))
    adverb = F.when(F.endswith(undashed, F.lit("LY")), F.substr(undashed, F.lit(1), F.char_length(undashed) - 2))
    kept = F.filter(F.split(term, " "), lambda w: ~w.isin(fillers) & ~w.rlike(r"^[(\[]"))
    return [term, plain, F.when(F.contains(plain, F.lit("-")), undashed), adverb, F.array_join(kept, " ")]


def _bare(text: Column) -> Column:
    """Without ``TO`` before a verb and ING behind it."""
    return F.regexp_replace(F.regexp_replace(text, "^TO ", ""), "ING$", "")


def resolved(terms: DataFrame, keys: DataFrame, fillers: list[str], special: dict[str, str] | None = None) -> DataFrame:
    """(term, key) of distinct terms; key is null where nothing fits.  ``keys`` are (ord, key); the least ord wins ties.

    A term is read as it stands, without brackets and what follows a comma, without dashes, without LY, and without ``fillers``; the
    first reading that finds a key counts.  A reading finds, in order: what ``special`` says; the key it equals; for a form in
    ING that with an e; that without s; the shortest key that begins with it.  If no key begins like it, nor it like a key,
    one of ``ENDINGS`` is exchanged and all readings of that follow; endings are exchanged once.
    All comparisons are equality joins on beginnings of keys and readings.  Keys are hashed: the beginnings of readings, many times
    as many, are not sorted.
    """
    own = terms.select("term").where("term IS NOT NULL").distinct()
    tried = []
    for i, text in enumerate(_readings(F.col("term"), fillers)):
        tried.append(F.struct(F.lit(i * STEPS).alias("at"), F.lit(i).alias("step"), text.alias("reading")))
        bare = _bare(text)
        other = F.coalesce(*[F.when(F.endswith(bare, F.lit(a)), F.concat(F.substr(bare, F.lit(1), F.char_length(bare) - len(a)), F.lit(b))) for a, b in ENDINGS])
        tried += [F.struct(F.lit(i * STEPS + 1 + j).alias("at"), F.lit(i).alias("step"), t.alias("reading")) for j, t in enumerate(_readings(other, fillers))]
    read = own.select("term", F.explode(F.array(*tried)).alias("r")).select("term", "r.*").where(F.col("reading").isNotNull())
    texts = read.select("reading").distinct().withColumns({"low": F.lower(_bare(F.col("reading"))), "ing": F.endswith(F.regexp_replace("reading", "^TO ", ""), F.lit("ING"))})

    lower = F.lower("key")
    dashed = F.instr("key", "-") > 1
    spelled = F.array_compact(F.array(F.struct(lower.alias("norm"), (F.col("ord") * 2).alias("rank")), F.when(dashed, F.struct(F.replace(lower, F.lit("-"), F.lit("")).alias("norm"), (F.col("ord") * 2 + 1).alias("rank")))))
    forms = keys.where("key <> ''").select("key", F.explode(spelled).alias("s")).select("key", "s.*").where("norm <> ''")
    exact = forms.groupBy("norm").agg(F.min_by("key", "rank").alias("key"))
    begins = forms.select("key", "norm", "rank", F.explode(F.sequence(F.lit(1), F.char_length("norm"))).alias("n"))
    shortest = begins.groupBy(F.substr("norm", F.lit(1), F.col("n")).alias("low")).agg(F.min_by("key", F.struct(F.char_length("norm"), "rank")).alias("key"))

    less = F.substr("low", F.lit(1), F.char_length("low") - 1)
    targets = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("rule"), F.concat("low", F.when(F.col("ing"), "ing").otherwise("")).alias("norm")),
            F.when(F.col("ing"), F.struct(F.lit(2).alias("rule"), F.concat("low", F.lit("e")).alias("norm"))),
            F.when(F.endswith("low", F.lit("s")), F.struct(F.lit(3).alias("rule"), less.alias("norm"))),
        )
    )
    letters = texts.where("low <> ''")
    equal = letters.select("reading", F.explode(targets).alias("t")).select("reading", "t.*").join(exact.hint("shuffle_hash"), "norm").select("reading", "rule", "key")
    longer = letters.join(shortest, "low").select("reading", F.lit(4).alias("rule"), "key")
    # a key that the reading begins with: no result, but then no ending is exchanged
    heads = letters.select("reading", F.explode(F.sequence(F.lit(1), F.char_length("low"))).alias("n"), "low").select("reading", F.substr("low", F.lit(1), F.col("n")).alias("norm"))
    met = heads.join(exact.select("norm").hint("shuffle_hash"), "norm", "left_semi").select("reading").distinct().select("reading", F.lit(5).alias("rule"), F.lit(None).cast("string").alias("key"))
    found = equal.unionByName(longer).unionByName(met)
    if special:
        told = F.create_map(*[F.lit(x) for pair in special.items() for x in pair])
        found = found.unionByName(texts.select("reading", F.lit(0).alias("rule"), F.try_element_at(told, F.col("reading")).alias("key")).where("key IS NOT NULL"))
    best = found.groupBy("reading").agg(F.min_by("key", "rule").alias("key"))  # one row: some key is met

    scored = read.join(best.withColumn("met", F.lit(True)), "reading", "left")
    own_step = F.col("at") == F.col("step") * STEPS
    blocked = F.array_distinct(F.collect_list(F.when(own_step & F.col("met"), F.col("step"))))
    hits = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("at", "step", "key")))
    each = scored.groupBy("term").agg(blocked.alias("blocked"), F.array_sort(hits).alias("hits"))
    valid = F.filter("hits", lambda h: (h["at"] == h["step"] * STEPS) | ~F.array_contains("blocked", h["step"]))
    return each.select("term", F.get(valid, F.lit(0))["key"].alias("key"))
