"""The relational analyser: stems joined to endings over distinct words; spelling variants; completions.

A word is cut at every place; its head must be a stem and its tail an ending of the stem's table, whose features agree.
Words are analysed once however often they occur.  Stems and endings are tables; those given as rows are broadcast, larger ones
are merged with the words.  Cut words, many times the vocabulary that Spark measures them by, are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphspan.functions import text as T
from glyphspan.functions.inflection import mask_from_tags, merged, narrowed

ENCLITICS = ("que", "ne", "ve")


def stems(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, "lemma string, stem string, infl string, stem_mask int"))


def endings(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, "infl string, ending string, end_mask int"))


def expand_templates(templates: dict[str, list[tuple[str, str]]], endings_of: dict[str, list[tuple[str, int]]]) -> dict[str, list[tuple[str, int]]]:
    """Endings of tables that are built from others with a prefix, each after those it depends on; cycles are an error."""
    done, waiting = dict(endings_of), dict(templates)
    while waiting:
        ready = [name for name, parts in waiting.items() if all(t in done for _, t in parts)]
        if not ready:
            raise ValueError(f"templates depend on each other: {sorted(waiting)}")
        for name in ready:
            done[name] = done.get(name, []) + [(prefix + e, mask) for prefix, t in waiting.pop(name) for e, mask in done[t]]
    return done


def analyse(words: DataFrame, stem_table: DataFrame, ending_table: DataFrame, word: str = "word") -> DataFrame:
    """(word, lemma, mask) of all analyses of distinct words."""
    cuts = words.select(F.col(word).alias("word")).distinct().withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("word"))))
    split = cuts.select("word", F.substr("word", F.lit(1), F.col("at")).alias("stem"), F.substr("word", F.col("at") + 1).alias("ending"))
    found = split.hint("merge").join(stem_table, "stem").hint("merge").join(ending_table, ["infl", "ending"])
    return found.select("word", "lemma", merged(F.col("stem_mask"), F.col("end_mask")).alias("mask")).where("mask IS NOT NULL").distinct()


def without_enclitics(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, base, enclitic): every word itself, and without each enclitic it ends in."""
    options = F.array(F.lit(""), *[F.lit(e) for e in ENCLITICS])
    tried = words.select(F.col(word).alias("word"), F.explode(options).alias("enclitic"))
    fits = (F.col("enclitic") == "") | (F.endswith("word", F.col("enclitic")) & (F.char_length("word") > F.char_length("enclitic")))
    return tried.where(fits).select("word", F.substr("word", F.lit(1), F.char_length("word") - F.char_length("enclitic")).alias("base"), "enclitic")


def case_variants(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, variant, relaxed): the word with all but its first letter in lower case, and with its first letter in the other
    case; a first V may stand for U or u."""
    first, body = F.substr(word, F.lit(1), F.lit(1)), F.lower(F.substr(F.col(word), F.lit(2)))
    other = F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first))
    option = lambda letter, relaxed: F.struct(F.concat(letter, body).alias("variant"), F.lit(relaxed).alias("relaxed"))
    v = first == "V"
    options = F.array_compact(F.array(option(first, False), F.when(v, option(F.lit("U"), True)), option(other, True), F.when(v, option(F.lit("u"), True))))
    return words.where(F.col(word) != "").select(F.col(word).alias("word"), F.explode(options).alias("o")).select("word", "o.*")


# The vowels beside which i and u may be consonants.
VOWELS = "aeiouy"


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def open_places(word: Column, i: bool = True, u: bool = True) -> Column:
    """Places of a word whose i may be a j or whose u may be a v: those beside a vowel, and no u behind q.

    A word with a j has no such i, one with a v no such u.
    """
    low = _chars(F.lower(word))
    plain = F.transform(low, T.strip_diacritics)
    vowel = lambda at: F.coalesce(F.get(plain, at).isin(*VOWELS), F.lit(False))
    as_i = F.lit(i) & ~F.contains(F.lower(word), F.lit("j"))
    as_u = F.lit(u) & ~F.contains(word, F.lit("v"))

    def open_(c: Column, at: Column) -> Column:
        beside = vowel(at - 1) | vowel(at + 1)
        return beside & ((as_i & (c == "i")) | (as_u & (c == "u") & ~F.coalesce(F.get(low, at - 1) == "q", F.lit(False))))

    return F.filter(F.transform(low, lambda c, at: F.when(open_(c, at), at)), lambda at: at.isNotNull())


def consonant_variants(words: DataFrame, word: str = "word", i: bool = True, u: bool = True) -> DataFrame:
    """(word, variant) of all spellings with some of the open places' i as j and u as v.

    Their number doubles with each such place; to find a word in a table of words, join by ``spelling_key`` and test with
    ``spelled_so``, as ``crunch`` does.
    """
    places = open_places(F.col(word), i, u)
    found = words.select(F.col(word).alias("word"), _chars(F.col(word)).alias("chars"), places.alias("places")).where(F.size("places") > 0)
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("places")) - 1)).alias("chosen"))

    def spelled(c: Column, at: Column) -> Column:
        rank = F.array_position("places", at) - 1
        changed = (rank >= 0) & (F.call_function("shiftright", F.col("chosen"), F.greatest(rank, F.lit(0)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return F.when(changed, F.translate(c, "iIuU", "jJvV")).otherwise(c)

    return each.select("word", F.array_join(F.transform("chars", spelled), "").alias("variant"))


def spelled_so(word: Column, places: Column, form: Column) -> Column:
    """Whether ``form`` is the word, or one of its consonant variants."""
    other = _chars(form)

    def fits(c: Column, at: Column) -> Column:
        f = F.get(other, at)
        return F.coalesce((c == f) | (F.array_contains(places, at) & (F.translate(c, "iIuU", "jJvV") == f)), F.lit(False))

    return (F.char_length(word) == F.char_length(form)) & F.forall(F.transform(_chars(word), fits), lambda ok: ok)


def _one_letter(c: Column) -> Column:
    return F.translate(c, "vVjJ", "uUiI")


def crunch(words: DataFrame, stem_table: DataFrame, ending_table: DataFrame, irregular: DataFrame | None = None, word: str = "word") -> DataFrame:
    """(word, form, lemma, mask, enclitic, relaxed): all analyses of distinct words.

    A word is tried in both cases of its first letter, with i and u as consonants, and without each enclitic.  A stem
    (lemma, stem, infl, stem_mask, optional tags) needs an ending (infl, ending, end_mask) that allows its features; irregular
    forms (lemma, form, mask) stand alone.  Words and forms meet where they are equal with v as u and j as i, and are then
    compared letter by letter, so spelling variants need not be listed.
    """
    own = words.select(F.col(word).alias("word")).distinct()
    cased = case_variants(own).withColumn("key", _one_letter(F.col("variant")))
    options = F.array(F.lit(""), *[F.lit(e) for e in ENCLITICS])
    tried = cased.withColumn("enclitic", F.explode(options))
    fits = (F.col("enclitic") == "") | (F.endswith("key", _one_letter(F.col("enclitic"))) & (F.char_length("key") > F.char_length("enclitic")))
    cut = tried.where(fits).withColumn("key", F.substr("key", F.lit(1), F.char_length("key") - F.char_length("enclitic")))
    keys = cut.select("key").distinct()
    at = keys.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("key"))))
    split = at.select("key", F.substr("key", F.lit(1), F.col("at")).alias("stem_key"), F.substr("key", F.col("at") + 1).alias("end_key"))
    tags = F.col("tags") if "tags" in stem_table.columns else None
    stems_ = stem_table.withColumn("stem_key", _one_letter(F.col("stem")))
    endings_ = ending_table.select("infl", "ending", "end_mask", _one_letter(F.col("ending")).alias("end_key"))
    regular = split.hint("merge").join(stems_, "stem_key").hint("merge").join(endings_, ["infl", "end_key"])
    found = regular.select("key", F.concat("stem", "ending").alias("form"), "lemma", narrowed(F.col("stem_mask"), F.col("end_mask"), tags).alias("mask")).where("mask IS NOT NULL")
    if irregular is not None:
        found = found.unionByName(keys.hint("merge").join(irregular.withColumn("key", _one_letter(F.col("form"))), "key").select("key", "form", "lemma", "mask"))
    # places are looked for in words that met a form, not in all
    same = T.let(open_places(F.col("variant")), lambda places: spelled_so(F.col("variant"), places, F.concat("form", "enclitic")))
    joined = cut.hint("merge").join(found, "key").where(same)
    return joined.groupBy("word", "form", "lemma", "mask", "enclitic").agg(F.min("relaxed").alias("relaxed"))


def by_lemma(analyses: DataFrame) -> DataFrame:
    """(word, lemma, forms array of (form, analyses array of (mask, enclitic))): analyses of a word under their lemma and form."""
    each = analyses.groupBy("word", "lemma", "form").agg(F.array_sort(F.collect_set(F.struct("mask", "enclitic"))).alias("analyses"))
    return each.groupBy("word", "lemma").agg(F.array_sort(F.collect_list(F.struct("form", "analyses"))).alias("forms"))


def ending_index(ending_table: DataFrame) -> DataFrame:
    """(ending, tables): the tables that have each ending."""
    return ending_table.groupBy(F.translate("ending", "^_-+", "").alias("ending")).agg(F.sort_array(F.collect_set("infl")).alias("tables"))


def lexicon_lines(files: DataFrame) -> DataFrame:
    """(path, lemma, number, code, head, rest array) of lexicon files (path, text): lines under the lemma of the last ``:le:`` line.

    Blank lines and those behind ``#`` say nothing.  A line is a head, with a two-letter code between colons or without, and words.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("raw", F.btrim("raw", F.lit(" \t\r")))
    lines = lines.where((F.col("raw") != "") & ~F.startswith("raw", F.lit("#")))
    is_lemma = F.startswith("raw", F.lit(":le:"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    under = lines.withColumns({"lemma": F.last(F.when(is_lemma, F.expr("substr(raw, 5)")), ignorenulls=True).over(w), "number": F.sum(is_lemma.cast("int")).over(w)})
    parts = F.split("raw", r"\s+")
    code = F.regexp_extract(parts[0], "^:([a-z]{2}):", 1)
    head = F.regexp_replace(parts[0], "^:[a-z]{2}:", "")
    return under.where(~is_lemma & F.col("lemma").isNotNull()).select("path", "lemma", "number", code.alias("code"), head.alias("head"), F.slice(parts, 2, 1000).alias("rest"))


def stems_from(lines: DataFrame, templates: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stems (lemma, stem, infl, stem_mask, tags) and irregular forms (lemma, form, mask) of lexicon lines.

    Lines of nouns, adjectives, verb stems and derived verbs name a table (of ``templates``, if given, else their first word), as
    does ``stem@table``; all other lines are whole forms.
    """
    at = F.contains("head", F.lit("@"))
    named = F.get(F.filter("rest", lambda t: t.isin(templates)), F.lit(0)) if templates else F.get("rest", F.lit(0))
    table = F.when(at, F.substring_index("head", "@", -1)).otherwise(named)
    tags = F.when(at, F.col("rest")).otherwise(F.array_remove("rest", table))
    clean = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    regular = at | F.col("code").isin("no", "aj", "vs", "de")
    stems_ = lines.where(regular).select("lemma", clean(F.substring_index("head", "@", 1)).alias("stem"), table.alias("infl"), mask_from_tags(tags).alias("stem_mask"), tags.alias("tags"))
    return stems_, lines.where(~regular).select("lemma", clean(F.col("head")).alias("form"), mask_from_tags(F.col("rest")).alias("mask"))


def template_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endings (infl, ending, end_mask, tags) and dependencies (infl, prefix, depends, mask) of template files (path, text).

    A file's name is its table's; ``prefix@table words`` takes over another table, ``*`` is the empty ending or prefix.
    """
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    lines = files.select(name.alias("infl"), F.explode(F.split("text", "\n")).alias("raw")).withColumn("raw", F.btrim("raw", F.lit(" \t\r")))
    parts = F.split("raw", r"\s+")
    rows = lines.where((F.col("raw") != "") & ~F.startswith("raw", F.lit("#"))).select("infl", parts[0].alias("head"), F.slice(parts, 2, 1000).alias("rest"))
    empty = lambda c: F.when(c == "*", "").otherwise(c)
    uses = F.contains("head", F.lit("@"))
    endings_ = rows.where(~uses).select("infl", empty(F.col("head")).alias("ending"), mask_from_tags(F.col("rest")).alias("end_mask"), F.col("rest").alias("tags"))
    prefix = empty(F.substring_index("head", "@", 1))
    return endings_, rows.where(uses).select("infl", prefix.alias("prefix"), F.substring_index("head", "@", -1).alias("depends"), mask_from_tags(F.col("rest")).alias("mask"))


def expanded(endings_: DataFrame, uses: DataFrame) -> DataFrame:
    """(infl, ending, end_mask): endings of all tables, those they take over included; as deep as tables depend on each other."""
    done = endings_.select("infl", "ending", "end_mask")
    waiting = uses
    for _ in range(64):
        names = done.select("infl").distinct()
        blocked = waiting.join(waiting.select(F.col("infl").alias("depends")).distinct(), "depends", "left_semi").select("infl").distinct()
        ready = waiting.join(blocked, "infl", "left_anti")
        if ready.isEmpty():
            break
        missing = ready.join(names.withColumnRenamed("infl", "depends"), "depends", "left_anti")
        if not missing.isEmpty():
            raise ValueError(f"no such tables: {sorted(r['depends'] for r in missing.select('depends').distinct().limit(10).collect())}")
        taken = ready.join(done.withColumnsRenamed({"infl": "depends"}), "depends")
        new = taken.select("infl", F.concat("prefix", "ending").alias("ending"), merged(F.col("mask"), F.col("end_mask")).alias("end_mask")).where("end_mask IS NOT NULL")
        done, waiting = done.unionByName(new), waiting.join(blocked, "infl", "left_semi")
        if waiting.isEmpty():
            return done
    if not waiting.isEmpty():
        raise ValueError("templates depend on each other")
    return done


def spelling_key(word: Column) -> Column:
    """One spelling for u/v and i/j, so that variants meet in an equality join."""
    return F.translate(F.lower(word), "vj", "ui")


def complete(stem_table: DataFrame, ending_table: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Lemmata with a form that begins with ``prefix``: their stem does, or a stem is its head and an ending goes on."""
    whole = stem_table.where(F.startswith("stem", F.lit(prefix))).select("lemma")
    heads = stem_table.where(F.lit(prefix).startswith(F.col("stem")) & (F.col("stem") != prefix))
    rest = F.substr(F.lit(prefix), F.char_length("stem") + 1)
    partial = heads.withColumn("rest", rest).join(ending_table, "infl").where(F.startswith("ending", F.col("rest"))).select("lemma")
    return whole.union(partial).distinct().orderBy("lemma").limit(limit)


def standing_alone(analyses: DataFrame) -> DataFrame:
    """Analyses (word, lemma, ..., enclitic) of lemmata that explain their word without an enclitic, too."""
    plain = analyses.where(F.col("enclitic") == "").select("word", "lemma").distinct()
    return analyses.join(plain, ["word", "lemma"], "left_semi").select(analyses.columns)
