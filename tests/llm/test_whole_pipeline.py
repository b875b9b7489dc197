"""The pipeline over a whole small table, stage after stage in plain Python (models are learned by the operators)."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphspan.llm import langid
from glyphspan.llm.common import remainder
from glyphspan.llm.queries import learned_quality
from test_line_dedup import _without_repeats
from test_pipeline import _kept


def test_pipeline_as_plain_python(spark, sf):
    import pandas as pd
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf}/documents.parquet")
    learnable = table.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
    languages, quality = langid.collect_profiles(langid.learn_profiles(learnable)), learned_quality(spark, sf)
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    rows = list(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))

    said = [(d, t, languages.predict(t)) for d, t in rows]
    rows = [(d, t) for d, t, (lang, score) in said if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    rows = [r for r, score in zip(rows, quality.score([t for _, t in rows]), strict=True) if score >= corpus_pipeline.QUALITY_THRESHOLD]
    before = dict(rows)
    rows = [(d, t) for d, t in _without_repeats(rows) if t == before[d] or t.strip()]
    kept = set(_kept(rows))
    rows = {d: t for d, t in rows if d in kept}
    assert 0 < len(rows) < len(before) < len(docs)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows.items()}
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


@pytest.mark.parametrize("name", ["language_id", "quality"])
def test_filtering_stages_keep_ordinary_documents(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    good = docs.where("lang IS NOT NULL").join(labels, "doc_id", "left_semi")
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert kept.join(good, "doc_id", "left_semi").count() == good.count() > 0
