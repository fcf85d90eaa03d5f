"""Columns whose names the operators use themselves, nulls, and empty tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from skein.llm import byte_bpe, context_tree, matroska, mixing, near_duplicates, quality, secret_scan, token_counts, toxicity

NAMES = ["y", "_id", "id", "key", "made", "stated", "_stated", "score", "_quality", "copy", "mix", "row", "cut", "size", "cls", "n", "packed", "carry", "forest", "blob", "findings", "_skein_blob", "path", "unit", "head", "hash", "log", "span", "learn", "a name", "content", "ids"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in NAMES)])


def rows():
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    texts = [long, long + "more", "", None, "password = hunter22x " + long[::-1], "x " * 50, long]
    own = [(k, t, "en", f"s{k % 2}" if k else None, None, *(f"{c} of {k}" for c in NAMES)) for k, t in enumerate(texts)]
    return [*own, (None,) * (5 + len(NAMES))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("clash")
    spark.createDataFrame([(k, int(k % 3 > 0), k % 2) for k in range(7)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("filled", [True, False])
def test_stages_keep_every_column(spark, folder, filled):
    docs = spark.createDataFrame(rows() if filled else [], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == SCHEMA.names, name
        got = out.collect()
        assert bool(got) == filled, name
        assert all(r[c] == (None if r["doc_id"] is None else f"{c} of {r['doc_id']}") for r in got for c in NAMES), name
    assert corpus_pipeline.encode(spark, docs, folder).count() == (8 if filled else 0)


@pytest.mark.parametrize("filled", [True, False])
def test_operators_take_any_column(spark, folder, filled):
    docs, labels = spark.createDataFrame(rows() if filled else [], SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")
    n = 8 if filled else 0
    assert mixing.mix(docs, mixing.word_count("text")).count() == n
    assert byte_bpe.digests(docs).count() == n
    assert context_tree.score(docs, F.col("doc_id") != 1).count() == n
    assert quality.score(docs, quality.train(docs, labels), ["doc_id", "y"]).count() == n
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == n
    assert matroska.read(matroska.store(docs)).count() == n
    assert near_duplicates.near_duplicates(docs).count() == n
    assert secret_scan.scan(docs)[0].count() == n
    public = pytest.importorskip("public_tokenizers")
    assert token_counts.count_tokens(docs, public.path("byte_bpe_50k.json"), 1024).count() == n
