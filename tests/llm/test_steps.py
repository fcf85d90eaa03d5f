"""Memory of a step: what a worker holds grows with the bytes that it takes at once."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import byte_bpe
from skein.llm.common import map_sized


def test_encoding_holds_little_beside_its_texts(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    held = {}
    monkeypatch.setattr(byte_bpe, "map_batches", lambda df, columns, f, schema, most=8_000_000: held.update(f=f, most=most))
    byte_bpe.encode(spark.range(1).withColumn("text", F.lit("")), *byte_bpe.default_vocabulary(), id_col="id", with_decoded=True)
    texts = [" ".join(f"w{(k * 37 + i) % 5000}" for i in range(100)) for k in range(10_000)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts))), "text": pa.array(texts)})
    held["f"](batch.slice(0, 100))  # the vocabulary, which a worker holds anyway
    tracemalloc.start()
    try:
        pieces = [p.nbytes for p in map_sized([batch], held["most"]) if held["f"](p).num_rows]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(pieces) >= batch.nbytes * 0.9 and max(pieces) <= 2_000_000
    assert peak < 25_000_000
