"""The query functions themselves on a small folder of tables: every column of the contracts against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import registry
from skein.llm.common import words_of
from test_llm import brute_components, brute_targets

ODD = "extra string, id long, n long, score double, row string, key string, size long, made string"


def texts():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(100)]
    out += [None, "", " ", "x" * 5000, "don't  stop\n\t now 12345 ", "<|endoftext|> a<|endoftext|>", "漢字 кириллица ñ", out[3], out[3] + " more", out[5].upper()]
    out += ["password: hunter22 Token='abc' api_key=\"Zz-_./+=9\" APIKEY : 123456", "AKIA" + "A1" * 8 + " AKIAB", "0123456789abcdef" * 2 + "g" + "a" * 23, "secret=secret=abcdefg passwd  = 12345 token:=x", "é password=élève secret: ñandú12 " + "f" * 24]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "en", [None, "a", "b", "c"][k % 4], None if k % 3 else len(t or ""), None, k, None, 0.5, "r", "k", 1, "m") for k, t in enumerate(texts())]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {ODD}").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 3 > 0), int(k % 4 == 0), "z") for k in range(len(rows))] + [(None, 1, 1, "z"), (5, None, 7, "z")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    return path


def rows(spark, folder, name):
    got = registry.queries()[name](spark, folder).collect()
    assert len(got) == len(texts())
    return {r["doc_id"]: r for r in got}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_op1(spark, folder):
    got = rows(spark, folder, "op1_mixing")
    sizes = {}
    for k, t in enumerate(texts()):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        s = [None, "a", "b", "c"][k % 4]
        sizes[s] = sizes.get(s, 0) + n
        assert got[k]["size"] == n and 0 <= got[k]["taken"] <= 3 * n
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 0.5 and all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for r in own)
    assert got == rows(spark, folder, "op1_mixing")


def test_op2_and_op6(spark, folder):
    public, tiktoken, tokenizers = (pytest.importorskip(m) for m in ("public_tokenizers", "tiktoken", "tokenizers"))
    from skein.llm.byte_bpe import load_ranks

    ref = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    coded, counted = rows(spark, folder, "op2_byte_bpe"), rows(spark, folder, "op6_token_counts")
    for k, t in enumerate(texts()):
        ids = ref.encode_ordinary(t or "")
        r = coded[k]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        r = counted[k]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 1024)


@pytest.mark.parametrize(("name", "label", "cut"), [("op4_quality", "quality", 0.3), ("op5_toxicity", "toxic", 0.5)])
def test_op4_and_op5(spark, folder, name, label, cut):
    got = rows(spark, folder, name)
    for k in range(len(texts())):
        r = got[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    assert got[3]["score"] == got[107]["score"]  # equal texts and lengths
    # labels of the held-out fold, ids, languages and sources are not read
    from pyspark.sql import DataFrame

    from skein.llm import quality, toxicity

    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    renamed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("other"))

    def scores(d: DataFrame, x: DataFrame) -> dict:
        if name == "op4_quality":
            return {r["row"]["doc_id"]: r["score"] for r in quality.score(d, quality.train(d, x), ["doc_id"]).collect()}
        return {r["doc_id"]: r["score"] for r in toxicity.score(d, toxicity.train(d, x)).collect()}

    assert scores(renamed, flipped) == {k: r["score"] for k, r in got.items()}


def test_op5_equals_its_formula(spark, folder):
    """A score is the logistic of the bias and the weights of the features of a text's distinct words."""
    from skein.llm import toxicity as T

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = T.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    got = rows(spark, folder, "op5_toxicity")
    for k, t in enumerate(texts()):
        z = model.bias
        for w in set(words_of(t or "")):
            term = w.decode().strip(T._TRIM).lower()
            for f in [f"={term}", *(f"^{term[:n]}" for n in T.PREFIXES if len(term) >= n)] if term else []:
                z += weight.get(zlib.crc32(f.encode()) & ((1 << T.BITS) - 1), 0.0)
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_op7(spark, folder):
    from skein.llm import matroska

    got = rows(spark, folder, "op7_matroska")
    for k, t in enumerate(texts()):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        media = matroska.mux(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), sha(media))
        assert matroska.read_back(media, matroska.parse(media)) == payload and r["feature"]
    assert got[3][1:] == got[107][1:] and len({r["feature"] for r in got.values()}) > 1


def test_op8(spark, folder):
    got = rows(spark, folder, "op8_near_duplicates")
    want = brute_components(list(enumerate(texts())), 3, 85, 100)
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (n, c, c == k) for k, (n, c) in want.items()}


def plain_secrets(text):
    """Spans of the base kinds, found by a scan that tries each place."""
    kinds = [("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    found = []
    for n, (kind, pattern, group, least) in enumerate(kinds):
        # "either case" is that of ASCII letters
        p = re.compile(pattern, re.ASCII | re.IGNORECASE if kind == "assign" else re.ASCII)
        at = 0
        while at < len(text):
            m = p.match(text, at)
            if m is None:
                at += 1
                continue
            if len(m[group]) >= least:
                found.append((m.start(), n, kind, m.end()))
            at = m.end()
    return sorted(found)


def test_op9(spark, folder):
    got = rows(spark, folder, "op9_secret_scan")
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got.values()) >= 7
    for k, t in enumerate(texts()):
        found = plain_secrets(t or "")
        spans = [f"{kind}:{start}:{end}" for start, _, kind, end in found]
        r = got[k]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == kind for x in found) for kind in ("assign", "access", "hex"))
        assert r["base_sha256"] == sha(",".join(spans).encode()) and set(spans) <= set(r["spans"].split(","))


def test_op10(spark, tmp_path):
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(700, 8)), 3)
    x[50:90] = x[50]
    table = [(k, v.tolist(), "a") for k, v in enumerate(x)] + [(1000, None, "a"), (1020, [0.0] * 8, "a"), (1040, [float("inf")] * 8, "a"), (1060, [None] * 8, "a")]
    spark.createDataFrame(table, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in registry.queries()["op10_ann_tree"](spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        found = sorted(found)
        s = (x * x[q]).sum(1)
        order = [int(k) for k in np.lexsort((np.arange(700), -s)) if k != q][:20]
        hits += len({v for _, v, _ in found} & set(order))
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(sc == pytest.approx(s[v], abs=1e-12) for _, v, sc in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits / (20 * len(got)) >= 0.9
