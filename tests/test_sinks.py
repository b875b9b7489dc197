"""Results written by document and processor: what a later run replaces and what it leaves."""

import pathlib

import pytest
from pyspark.errors import PySparkException

from glyphspan.sources import sinks

SCHEMA = "doc_id long, output string"


def _rows(spark, path, schema=SCHEMA):
    return sorted((r["doc_id"], r["processor"], r["output"] or "") for r in sinks.results(spark, path, schema).collect())


def _put(spark, path, rows, **how):
    sinks.put(spark.createDataFrame(rows, "doc_id long, processor string, output string"), path, **how)


def test_a_later_run_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.results(spark, path, SCHEMA) is None
    _put(spark, path, [(i, p, f"{p}{i}") for i in range(40) for p in ("a", "b")], shards=4)
    assert len(_rows(spark, path)) == 80
    stamps = {f: f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("processor=b/**/*.gz")}
    _put(spark, path, [(3, "a", "new"), (3, "a", "newer"), (99, "a", None), (7, "c", "x")], shards=4)
    want = [(i, p, f"{p}{i}") for i in range(40) for p in ("a", "b") if (i, p) != (3, "a")] + [(3, "a", "new"), (3, "a", "newer"), (99, "a", ""), (7, "c", "x")]
    assert _rows(spark, path) == sorted(want)
    assert stamps == {f: f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("processor=b/**/*.gz")}
    _put(spark, path, [], shards=4)
    assert _rows(spark, path) == sorted(want)
    with pytest.raises(ValueError, match="another number of shards"):
        _put(spark, path, [(1, "a", "x")], shards=8)
    with pytest.raises(PySparkException, match="a row without doc_id"):
        _put(spark, path, [(None, "a", "x")], shards=4)
    assert _rows(spark, path) == sorted(want)


def test_works_without_translations(spark, tmp_path):
    works = spark.createDataFrame([("w1", False, "t"), ("w2", True, "t"), ("w3", None, None), ("w4", False, "t")], "id string, is_translation boolean, text string")
    path = str(tmp_path / "w")
    sinks.put_works(works, path, skipped=["w4"], shards=2)
    assert sorted((r["id"], r["text"]) for r in sinks.results(spark, path, "id string, text string").collect()) == [("w1", "t"), ("w3", None)]
