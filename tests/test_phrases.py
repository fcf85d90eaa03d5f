"""Phrases in texts, segments of mentions and near vectors against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.text import terms
from skein.operators import graph as G
from skein.operators import phrases as P
from skein.operators import resolution as E


def asked():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    phrases = sorted({" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 7]))) for _ in range(60)}) + ["", "w1 w1 w1", "never said", "w"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(80)] + [(90, None), (91, "W1, w2!  W3"), (92, "w1 w1 w1 w1"), (93, "w11 w1")]
    return phrases, texts


def rows(spark):
    phrases, texts = asked()
    t = spark.createDataFrame(texts, "id long, text string").select("id", terms(F.col("text")).alias("w"))
    return t, spark.createDataFrame([(p,) for p in [*phrases, None, phrases[0]]], "phrase string")


def plain():
    import re

    phrases, texts = asked()
    return {(k, p) for k, t in texts for p in phrases if p and f" {p} " in " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "}


@pytest.mark.parametrize("most", [200_000, 9])
def test_phrases_of_any_length(spark, monkeypatch, most):
    monkeypatch.setattr(P, "PHRASES", most)
    t, p = rows(spark)
    for found in (P.phrases_in(t, "id", p), P.by_grams(t, "id", p)):
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == plain()


def test_more_phrases_than_blocks_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(P, "PHRASES", 2)
    monkeypatch.setattr(P, "_found", None)
    t, p = rows(spark)
    assert {tuple(r) for r in P.phrases_in(t, "id", p).collect()} == plain()
    assert P.phrases_in(t, "id", p.where("phrase = ''")).collect() == []


def test_segments_hold_all_mentions_in_order(spark):
    rng = random.Random(2)
    names = ["Hot"] * 300 + ["Cold"] * 3 + [" hot "] * 10 + [""] * 2 + [None]
    order = list(range(len(names)))
    rng.shuffle(order)
    ents = spark.createDataFrame([(o // 7, o % 7, f"c{o}", f"d{o % 5}", n, "X", f"about {o}", None) for o, n in zip(order, names, strict=True)], "record_no long, pos int, chunk_id string, doc_id string, name string, type string, description string, source_sentence string").repartition(5)
    got = G.node_segments(ents, 16).orderBy("key", "segment").collect()
    assert all(len(r["descriptions"]) == len(r["chunk_ids"]) == r["mentions"] <= 16 for r in got)
    held = {}
    for r in got:
        held[r["key"]] = held.get(r["key"], []) + r["descriptions"]
    want = {}
    for o, n in sorted(zip(order, names, strict=True)):
        if (n or "").strip():
            want.setdefault(n.strip().lower(), []).append(f"about {o}")
    assert held == want
    nodes = G.build_nodes(ents.withColumn("stub", F.lit(False)))
    slim, places = G.slim(nodes), G.node_places(ents)
    assert not {"descriptions", "source_sentences"} & set(slim.columns)
    assert {tuple(r) for r in G.node_chunk_rows(slim, places).collect()} == {tuple(r) for r in G.node_chunk_rows(nodes).collect()}


def test_places_give_the_metrics_of_the_arrays(spark):
    ents = spark.createDataFrame([(k, 0, f"c{k % 4}", f"d{k % 3}", n, "X", "", "", False) for k, n in enumerate("ABCABAD")], "record_no int, pos int, chunk_id string, doc_id string, name string, type string, description string, source_sentence string, stub boolean")
    rels = spark.createDataFrame([(k, 1, f"c{k}", f"d{k % 2}", s, t, "r", "", "") for k, (s, t) in enumerate(["AB", "AB", "BC", "CD", "DD", "AX"])], "record_no int, pos int, chunk_id string, doc_id string, source string, target string, type string, description string, source_sentence string")
    nodes = G.build_nodes(ents)
    resolved = G.resolve_ends(rels, nodes)
    edges = G.build_edges(resolved)
    parts = G.components(nodes, edges)
    places = (G.node_places(ents), G.edge_places(resolved))
    for flags in ({}, {"by_provenance": True}, {"empty_counts": True}):
        assert G.metrics(nodes, edges, parts, **flags).collect() == G.metrics(G.slim(nodes), G.slim(edges), parts, places=places, **flags).collect()
    assert {tuple(r) for r in G.edge_chunk_rows(G.slim(edges), places[1]).collect()} == {tuple(r) for r in G.edge_chunk_rows(edges).collect()}
    segments = G.edge_segments(resolved, 1).orderBy("segment").collect()
    assert [r["types"] for r in segments if (r["src"], r["dst"]) == ("A", "B")] == [["R"], ["R"]] and len(segments) == 4


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + 0.25 * rng.normal(size=(n, dim))
    return [(f"v{k}", v.tolist()) for k, v in enumerate(x)]


def test_blocks_out_of_reach_are_left_out(spark):
    rows = [*clustered(600, 8, 1), *((f"s{k}", v) for k, v in clustered(40, 3, 2)), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("null", [None] * 8), ("none", None), ("lone", [1.0])]
    df = spark.createDataFrame(rows, "name string, vec array<double>").repartition(4)
    good = [(n, np.array(v)) for n, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    want = {tuple(sorted((a, b))) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.92}
    assert {(r["node_a"], r["node_b"]) for r in E.similar_pairs(df, 0.92, block=16).collect()} == want and len(want) > 500
    blocks = E.vector_blocks(df, 16)
    assert blocks.groupBy("k").count().agg(F.max("count")).first()[0] <= 16 and blocks.count() == len(good)
    report = E.block_pairs(blocks, 0.92)[1].first()
    n = blocks.groupBy("dim").agg(F.count_distinct("k").alias("n")).collect()
    assert report["total"] == sum(r["n"] * (r["n"] + 1) // 2 for r in n) and 0 < report["kept"] < 0.6 * report["total"]


def test_equal_vectors_fill_many_blocks(spark):
    df = spark.createDataFrame([(f"v{k:03d}", [1.0, 2.0]) for k in range(50)], "name string, vec array<double>")
    assert E.similar_pairs(df, 0.999, block=8).count() == 50 * 49 // 2


def test_strings_anywhere(spark, monkeypatch):
    monkeypatch.setattr(P, "CHARACTERS", 6)
    lines = spark.createDataFrame([(1, "the redwood tree"), (2, "red"), (3, None), (4, "")], "id long, line string")
    found = P.strings_in(lines, "id", spark.createDataFrame([("red",), ("wood t",), ("tree house",), ("",), ("red",), (None,)], "phrase string"))
    assert sorted(map(tuple, found.collect())) == [(1, "red"), (1, "wood t"), (2, "red")]


def test_selections_follow_the_simulation_rule(spark):
    from skein.plans.query_focused import selections

    questions = spark.createDataFrame([(1, "Who wrote Redwood  Tales?"), (2, "no idea")], "qid long, text string")
    titles = spark.createDataFrame([("a", "Wood (novel)"), ("b", "Tal"), ("c", "AI (field) (x)"), ("d", "Tales (1990) (book)"), ("e", "Zed")], "id string, title string")
    dense = spark.createDataFrame([(1, "e", 1), (2, "e", 1)], "qid long, id string, rank long")
    ents = spark.createDataFrame([("e", "ai"), ("e", " TAL ")], "chunk_id string, name string")
    got = {(r["selection"], r["qid"], r["id"]) for r in selections(questions, dense, titles, ents, (5,)).collect()}
    # 'wood' and 'tales' stand in the question, the first within a word; 'tal' and 'ai' are names of the seed
    assert got == {("B_5", 1, "e"), ("B_5", 2, "e"), *(("C_5", 1, x) for x in "abcde"), *(("C_5", 2, x) for x in "bce")}


def test_a_tokenizer_in_place_of_the_default(spark):
    from skein.functions.tokenizers import RankedTokenizer, get_tokenizer
    from skein.operators import chunking as K

    public = pytest.importorskip("public_tokenizers")
    tok = get_tokenizer("Multi", {"multi": RankedTokenizer(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)})
    texts = [("d1", "One two, three — four 漢字 five. " * 9), ("d2", ""), ("d3", None), ("d4", "🙂")]
    got = K.sliding_window(spark.createDataFrame(texts, "doc_id string, text string"), 10, 0.2, "own", tok).orderBy("doc_id", "chunk_index").collect()
    want = []
    for d, t in texts:
        ids = tok.encode(t or "")
        want += [(d, k, a, min(a + 10, len(ids)), tok.decode(ids[a : a + 10])) for k, a in enumerate(range(0, len(ids), 8))]
    assert [(r["doc_id"], r["chunk_index"], r["start_offset"], r["end_offset"], r["text"]) for r in got] == want and {r["strategy"] for r in got} == {"own"}
    pieces = spark.createDataFrame([("d", 0, "One two"), ("d", 1, "三 four")], "doc_id string, chunk_index int, text string")
    counts = [len(tok.encode(t)) for t in ("One two", "三 four")]
    assert [(r["start_offset"], r["end_offset"]) for r in K.with_offsets(pieces, "x", tok).orderBy("chunk_index").collect()] == [(0, counts[0]), (counts[0], sum(counts))]
    with pytest.raises(ValueError):
        get_tokenizer("other", {"multi": tok})


def test_gleaning_extracts_each_pass_once(spark):
    from skein.operators import extraction as X

    first = spark.createDataFrame([("c", 0, "A", "X", "a")], "chunk_id string, pos int, name string, type string, description string")
    calls = []

    def extract(so_far, n):
        """A model that never gives the same name twice."""
        calls.append(n)
        return so_far.select("chunk_id", F.lit(0).alias("pos"), F.concat(F.lit("n"), F.expr("uuid()")).alias("name"), "type", "description").limit(1)

    out = X.glean(first, extract, 2)
    assert out.count() == 3 and sorted(map(tuple, out.collect())) == sorted(map(tuple, out.collect())) and calls == [1, 2]
