import hashlib
import random

from skein.llm import byte_bpe, quality, secret_scan
from skein.llm.common import words_of

import corpus_pipeline
from test_llm import brute_components, brute_targets, vocabulary


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage of the pipeline on a small corpus equals a plain version on the rows before it."""
    public = vocabulary()
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 90)))
        if k % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        elif k % 7 == 0 and rows:
            text = rows[-1][1] + " more"
        elif k % 11 == 0:
            text += " password=hunter22x"
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, int(k % 5 != 0), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    machine = quality.train(source, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = {r["row"]["doc_id"] for r in quality.score(source, machine, ["doc_id"]).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in out[0]} == kept and len(kept & {k for k in range(240) if k % 5 == 0}) <= 2
    part = brute_components([(r["doc_id"], r["text"]) for r in out[0]], 5, 80, 100)
    assert sorted(r["doc_id"] for r in out[1]) == sorted({c for _, c in part.values()})
    rules = secret_scan.Rules()
    for r in out[2]:
        assert not rules.scan(r["text"]) and r["n_chars"] == len(r["text"])
    assert [r["doc_id"] for r in sorted(out[2])] == [r["doc_id"] for r in sorted(out[1])]
    sizes = {}
    for r in out[2]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words_of(r["text"]))
    taken = dict.fromkeys(sizes, 0)
    for r in out[3]:
        taken[r["source"]] += len(words_of(r["text"]))
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(sizes).items())
    codec = byte_bpe.Codec(*byte_bpe.default_vocabulary())
    want = sorted((r["doc_id"], hashlib.sha256(codec.encode([r["text"]])[0]).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in out[3])
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in out[4]) == want
    assert public.PATTERN
