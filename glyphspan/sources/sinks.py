"""Results by document and processor as files that a later run replaces where it has something new, and nowhere else.

Rows lie below ``shards=<number>/processor=<name>/shard=<n>``, as compressed JSON.  A run rewrites the shards its documents
fall into, by dynamic partition overwrite: what other documents have there is read, joined against the new keys and written
again; other shards are not touched.  A run that fails leaves all as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphspan.sources.corpus import Corpus, shared_folder

SHARDS = 64
PLACES = ("shards", "processor", "shard")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows (``schema``, which names key and columns but not the processor) with their processor and places; None if nothing was ever written."""
    try:
        return spark.read.schema(f"{schema}, shards int, processor string, shard int").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def put(rows: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Write rows (``key``, processor and others): all rows that a key and processor had before go, whatever their number.

    One path keeps one number of shards; another is an error.  A row without a key or processor is an error too: no later
    run could replace it.  Two runs must not write at once to the shards of one processor.
    """
    spark = rows.sparkSession
    named = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a row without {c}")).cast(rows.schema[c].dataType)).alias(c)
    sound = rows.select(*(named(c) if c in (key, "processor") else F.col(c) for c in rows.columns))
    staged = f"{shared_folder(spark)}-results"
    sound.withColumns({"shards": F.lit(shards), "shard": F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")}).write.parquet(staged)
    new = spark.read.parquet(staged)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "processor")
    if (old := results(spark, path, schema)) is not None:
        if old.where(F.col("shards") != shards).select("shards").limit(1).count():
            raise ValueError(f"{path} is written with another number of shards than {shards}")
        touched = F.broadcast(new.select(*PLACES).distinct())  # at most the shards of each processor of this run
        kept = old.join(touched, list(PLACES), "left_semi").join(new.select(key, "processor").distinct(), [key, "processor"], "left_anti")
        new = new.unionByName(kept.select(*new.columns))
    placed = new.hint("rebalance", *(F.col(c) for c in PLACES))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACES).json(path, compression="gzip")


def put_works(works: DataFrame, path: str, skipped: list[str] | None = None, shards: int = SHARDS) -> None:
    """Write works (id, is_translation and others) as input of a corpus, but for translations and ``skipped`` ones."""
    kept = works.where(~F.coalesce("is_translation", F.lit(False)) & ~F.coalesce(F.col("id").isin(skipped or []), F.lit(False)))
    put(kept.withColumn("processor", F.lit("corpus")), path, "id", shards)


def put_lists(corpus: Corpus, path: str) -> None:
    """Write the corpus's authors, lemmata and words, each once, as rows (kind, place, value) sorted by kind and place.

    Authors are found by ``place`` in small letters, the others as they are.  Rows are dealt by ranges and lie sorted, so a
    beginning is read from few row groups.
    """
    of = lambda kind, place, value: (F.lit(kind).alias("kind"), place.alias("place"), value.alias("value"))
    authors = corpus.tokens.where(F.col("source").isNotNull()).select("source").distinct().select(*of("author", F.lower("source"), F.col("source")))
    lemmata = corpus.words.select(F.explode("analyses.lemma").alias("l")).distinct().select(*of("lemma", F.col("l"), F.col("l")))
    words = corpus.words.select(*of("word", F.col("norm"), F.col("norm")))
    rows = authors.unionByName(lemmata).unionByName(words)
    rows.repartitionByRange("kind", "place", "value").sortWithinPartitions("kind", "place", "value").write.mode("overwrite").parquet(path)
