"""The pipeline's stages one after another, each on what the one before has kept."""

import corpus_pipeline
from geoloom.llm import mixing, quality, secrets
from geoloom.llm.tables import cut, read
from pyspark.sql import functions as F
from tests.llm.test_likeness import slow_keeps

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read(spark, SF, "documents")
    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    good = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    one = corpus_pipeline.near_dedup(spark, kept, SF).cache()
    assert {r.doc_id for r in one.collect()} == slow_keeps(kept.collect()) and one.columns == docs.columns
    clean = corpus_pipeline.secret_scan(spark, one, SF).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} and clean.columns == docs.columns
    assert not [r for r in secrets.secrets(clean).collect() if r.n_assign or r.n_access or r.n_hex]
    mixed = corpus_pipeline.source_mix(spark, clean, SF).cache()
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(clean).collect() if r.taken}
    assert {r.doc_id for r in mixed.collect()} == taken.keys()
    tokens = corpus_pipeline.token_ids(spark, mixed, SF).collect()
    assert len(tokens) == mixed.count() and all(r.round_trip for r in tokens)


def test_run_as_by_hand(spark):
    docs = read(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    row = lambda r: (r.doc_id, tuple(r.token_ids))
    assert sorted(map(row, corpus_pipeline.run(spark, SF).collect())) == sorted(map(row, docs.collect()))


def test_stages_on_odd_rows_and_on_none(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns that clash; and an empty table."""
    prose = "the sea is calm and the boats of the town are on it as they were for most of this year , he said to me " * 3
    other = "a different tale about the hills and what is to be seen from them in the early hours of a day in march " * 3
    rows = [
        (None, None, None, None, None), (1, "", "en", "s", 0), (2, prose, "en", "s", len(prose)), (2, prose, "en", "s", len(prose)), (None, other, None, None, 7),
        (3, other + "token = abcdefghijklmnop", "en", "t", 9), (4, prose * 400, "en", "s", 1), (5, prose * 400, "en", None, 1), (6, "x" * 300_000, "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "h", "size", "hash", "counts", "kept", "doc", "fp", "tokens"):
        df = df.withColumn(name, F.lit(name))
    for docs in (df, df.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = cut(stage(spark, docs, SF), "test-stage")
            if i + 1 < len(corpus_pipeline.STAGES):
                assert after.dtypes == docs.dtypes
                docs = after
        assert after.columns == ["doc_id", "n_tokens", "token_ids", "round_trip"] and after.filter("NOT round_trip").isEmpty()
