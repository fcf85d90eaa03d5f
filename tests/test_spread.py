"""Searches that keep the k best of each question without a row for each pair, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import search as S
from skein.operators.resolution import apply_merges
from skein.plans import retrieval as R


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("cells", [S.CELLS, 3])
def test_weighted_top_sums_what_terms_share(spark, monkeypatch, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    rng = np.random.default_rng(1)
    items = [(f"c{i:02}", [(f"t{t}", float(rng.integers(1, 9))) for t in rng.permutation(6)[: rng.integers(1, 5)]]) for i in range(40)]
    asked = [(q, [(f"t{t}", float(rng.integers(1, 9))) for t in rng.permutation(8)[:3]]) for q in range(7)]
    asked.append((9, asked[0][1]))  # a question that asks what another one does
    kind = "terms array<struct<term:string,w:double>>"
    got = S.weighted_top(spark.createDataFrame(items, f"id string, {kind}"), spark.createDataFrame(asked, f"qid int, {kind}"), 5)
    want = []
    for q, terms in asked:
        found = [(-sum(dict(terms)[t] * w for t, w in own if t in dict(terms)), i) for i, own in items if {t for t, _ in own} & set(dict(terms))]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(found)[:5])]
    assert rows_of(got.select("qid", "id", "score", "rank")) == sorted(want)


def test_the_k_best_of_a_hot_node_are_those_of_the_whole_list(spark):
    # a node of 200 chunks: its list was stored whole for each question before the cut
    nodes = spark.createDataFrame([(n, n) for n in ("hot", "a", "b")], "name string, key string")
    edges = spark.createDataFrame([("hot", "a"), ("hot", "b")], "src string, dst string")
    places = spark.createDataFrame([("hot", f"c{i:03}") for i in range(200)] + [("a", "c007"), ("b", "c150")], "key string, chunk_id string"), spark.createDataFrame([("hot", "a", "c003"), ("hot", "b", "c150")], "src string, dst string, chunk_id string")
    hits = spark.createDataFrame([(1, "hot", 0.5), (1, "a", 1.0), (2, "hot", 1.0), (3, "hot", 1.0)], "qid int, id string, score double")
    ties = spark.createDataFrame([(1, "hot|a", 0.5), (1, "hot|b", 0.25), (2, "hot|b", 1.0)], "qid int, id string, score double")
    for f, found in ((R.local, hits), (R.global_, ties)):
        for optimised in (False, True):
            whole = rows_of(R.cut(f(found, nodes, edges, optimised, places=places), 4))
            assert rows_of(f(found, nodes, edges, optimised, places=places, k=4)) == whole and whole


def test_connectivity_stops_where_pairs_have_met(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(G, "_step", lambda front, near, f=G._step: steps.append(front.count()) or f(front, near))
    nodes = spark.createDataFrame([(n, n) for n in "abcde"], "name string, key string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    places = spark.createDataFrame([(n, f"in-{n}") for n in "abcde"], "key string, chunk_id string")
    pairs = spark.createDataFrame([(1, "in-a", "in-a"), (2, "in-a", "in-b"), (3, "in-a", "in-d"), (4, "in-a", "in-e")], "pair_id int, a_chunk string, b_chunk string")
    got = {r["pair_id"]: r["connected"] for r in G.gold_connected(nodes, edges, pairs, 3, places).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}
    near = spark.createDataFrame([(1, "in-a", "in-a")], "pair_id int, a_chunk string, b_chunk string")
    steps.clear()
    G.gold_connected(nodes, edges, near, 3, places).collect()
    assert steps == [0, 0, 0]


def test_merged_lists_keep_each_entry_at_its_first_place(spark):
    cell = "array<struct<text:string,chunk_id:string,doc_id:string>>"
    mark = lambda *x: [(t, "c", "d") for t in x]
    nodes = spark.createDataFrame([
        ("a", "a", "X", 2, mark("q", "p", "q"), mark("s"), "q", ["d"], False, (1, 1)), ("b", "b", "X", 2, mark("r", "p"), mark("s", "t"), "r", ["e"], False, (1, 2)), ("c", "c", "X", 1, [], mark("u"), "", ["d"], False, (1, 3)),
    ], f"name string, key string, type string, mentions long, descriptions {cell}, source_sentences {cell}, description string, source_docs array<string>, stub boolean, ord struct<record_no:long,pos:long>")
    edges = spark.createDataFrame([("a", "c", 1, ["T"], "x", [("s", "c", "d", "T")], "d", (1, 1)), ("b", "c", 2, ["U", "T"], "y", [("s", "c", "d", "T"), ("t", "c", "d", "U")], "d", (1, 2))], "src string, dst string, mentions long, types array<string>, description string, source_sentences array<struct<text:string,chunk_id:string,doc_id:string,type:string>>, source_doc string, ord struct<record_no:long,pos:long>")
    log = spark.createDataFrame([("b", "a")], "loser string, final string")
    n, e = apply_merges(nodes, edges, log)
    got = {r["name"]: ([x["text"] for x in r["descriptions"]], [x["text"] for x in r["source_sentences"]], r["aliases"]) for r in n.collect()}
    assert got == {"a": (["q", "p", "r"], ["s", "t"], ["b"]), "c": ([], ["u"], [])}
    assert [(r["src"], r["dst"], r["types"], [x["text"] for x in r["source_sentences"]]) for r in e.collect()] == [("a", "c", ["T", "U"], ["s", "t"])]
    # no comparison of all entries of a list with each other
    assert "array_distinct(flatten(transform" not in n.select("descriptions")._jdf.queryExecution().optimizedPlan().toString()
    assert n.select(F.size("descriptions")).count() == 2
