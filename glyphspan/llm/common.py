"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on this machine alone (tests) a temporary folder is made, once per session;
    on a cluster it must be named.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.glyphspan.tmp", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.glyphspan.tmp", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy", **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphspan-{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have (names are compared without case, as Spark does)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def unused(df: DataFrame, *names: str) -> None:
    """An error for names of new columns that ``df`` has already (whatever their case), as its own columns pass through."""
    if taken := sorted({c.lower() for c in df.columns} & {n.lower() for n in names}):
        raise ValueError(f"columns exist already: {', '.join(taken)}; name the new ones otherwise")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remainder(col, modulus: int):
    """CRC-32 of an id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(modulus)
