import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.llm import mixing

ROWS = [(i, "word " * (1 + i % 7), ["a", "b", "c"][i % 3 if i % 5 else 0], ["en", "fr"][i % 2], ["x", "y"][(i // 3) % 2]) for i in range(600)]


def mixed(spark, rows, targets, share, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, t string")
    return mixing.mix(docs, targets, share, topic=F.col("t"), **more)


@pytest.fixture(params=[100_000, 0], ids=["driver", "table"])
def limit(request, monkeypatch):
    monkeypatch.setattr(mixing, "LOCAL_CELLS", request.param)
    monkeypatch.setattr(mixing, "SWEEPS", 12)


def test_marginals_hold(spark, limit):
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"en": 0.6, "fr": 0.4}, "topic": 0.0}
    rows = mixed(spark, ROWS, targets, 0.2).select("mix.*").collect()
    mass = np.array([r.tokens * r.probability for r in rows])
    assert abs(mass.sum() / sum(r.tokens for r in rows) - 0.2) < 1e-9
    for d, goal in (("source", targets["source"]), ("lang", targets["lang"]), ("topic", {"x": 0.5, "y": 0.5})):
        for value, share in goal.items():
            assert abs(sum(m for m, r in zip(mass, rows, strict=True) if r[d] == value) / mass.sum() - share) < 1e-4


def test_no_probability_above_one(spark, limit):
    rows = mixed(spark, ROWS, {"source": {"a": 0.05, "b": 0.9, "c": 0.05}, "lang": 1.0, "topic": 1.0}, 0.6).select("mix.*").collect()
    assert max(r.probability for r in rows) == 1.0
    assert abs(sum(r.tokens * r.probability for r in rows) / sum(r.tokens for r in rows) - 0.6) < 1e-9


def test_nulls_repeats_and_clashing_columns(spark, limit):
    rows = [(None, None, None, None, None), (1, "a b", "s", "-", None), (1, "a b", "s", "-", None), (2, "", "", "en", "x"), (3, "one two", None, "en", "x")]
    got = mixed(spark, rows, dict.fromkeys(mixing.DIMENSIONS, 0.5), 1.0)
    assert got.columns == ["doc_id", "text", "source", "lang", "t", "mix"]
    found = got.collect()
    assert len(found) == 5 and all((r.mix.tokens > 0) == r.mix.kept for r in found)


def test_sample_is_fixed_by_id_and_follows_the_probability(spark):
    rows = [(i, "w " * 5, "a", "en", "x") for i in range(4000)]
    kept = {r.doc_id for r in mixed(spark, rows, dict.fromkeys(mixing.DIMENSIONS, 1.0), 0.25).filter("mix.kept").collect()}
    assert kept == {r.doc_id for r in mixed(spark, rows[::-1], dict.fromkeys(mixing.DIMENSIONS, 1.0), 0.25).filter("mix.kept").collect()}
    assert 900 < len(kept) < 1100


def test_empty_table(spark, limit):
    assert mixed(spark, [], dict.fromkeys(mixing.DIMENSIONS, 0.5), 0.5).count() == 0


def test_query_and_stage_with_columns_of_the_operators_names(spark, tmp_path):
    import corpus_pipeline
    from platter.llm.queries import op9_mixing

    rows = [(i, "word " * (1 + i % 7), "en", f"s{i % 3}", 5, "x", 1, "own", "key") for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix string, mix_tokens long, mix_source_own string, mix_source_key string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert op9_mixing(spark, str(tmp_path)).count() == 40
    assert 0 < corpus_pipeline.mix(spark, docs, "").count() < 40
    found = mixing.mix(docs, dict.fromkeys(mixing.DIMENSIONS, 1.0), 0.5, out_col="made").collect()
    assert all((r.mix, r.mix_tokens, r.mix_source_own, r.mix_source_key) == ("x", 1, "own", "key") for r in found)


def test_very_long_text(spark):
    rows = [(1, "w " * 3_000_000, "a", "en", "x"), (2, "one", "a", "en", "x")]
    assert {r.doc_id: r.mix.tokens for r in mixed(spark, rows, dict.fromkeys(mixing.DIMENSIONS, 1.0), 0.5).collect()} == {1: 3_000_000, 2: 1}
