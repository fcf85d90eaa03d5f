from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking as C
from skein.operators import extraction as X
from skein.operators import graph as G
from skein.operators import metrics as M
from skein.operators import resolution as E
from skein.operators import search as S
from skein.operators import serialize as Z
from skein.plans import retrieval as R

import pytest


def records(spark):
    e = spark.createDataFrame(
        [(0, 0, "c1", "d1", "Graph DB", "OTHER", "first", "s1", False), (0, 1, "c1", "d1", "HNSW", "TECHNOLOGY", "idx", "s2", False), (1, 0, "c2", "d2", "graph  db", "CONCEPT", "second", "s3", False), (1, 1, "c2", "d2", "Graph DBs", "CONCEPT", "plural", "s4", False)],
        "record_no long, pos long, chunk_id string, doc_id string, name string, type string, description string, source_sentence string, stub boolean",
    )
    r = spark.createDataFrame(
        [(0, 0, "c1", "d1", "graph db", "HNSW", "USES", "a", "x"), (0, 1, "c1", "d1", "HNSW", "hnsw ", "IS", "b", "x"), (0, 2, "c1", "d1", "HNSW", "Ghost", "X", "c", "x"), (1, 0, "c2", "d2", "Graph DB", "HNSW", "uses", "d", "x"), (1, 1, "c2", "d2", "Graph DBs", "HNSW", "EXTENDS", "e", "x")],
        "record_no long, pos long, chunk_id string, doc_id string, source string, target string, type string, description string, source_sentence string",
    )
    return e, r


def test_graph_build(spark):
    e, r = records(spark)
    nodes = G.build_nodes(e)
    resolved = G.resolve_ends(r, nodes)
    edges = G.build_edges(resolved)
    assert G.build_counters(resolved, nodes, edges).first().asDict() == {"nodes": 3, "edges": 2, "self_loops_dropped": 1, "parallel_merged": 1, "dangling_dropped": 1, "alias_merged": 1}
    n, m = G.merge_aliases(nodes, edges)
    got = {x["name"]: x for x in n.collect()}
    assert got["Graph DB"]["type"] == "CONCEPT" and got["Graph DB"]["source_docs"] == ["d1", "d2"]
    assert [d["text"] for d in got["Graph DB"]["descriptions"]] == ["first", "second", "plural"]
    edge = m.collect()
    assert len(edge) == 1 and edge[0]["types"] == ["USES", "USES"] and len(edge[0]["source_sentences"]) == 3 and edge[0]["source_doc"] == "d1"


def path(spark):
    nodes = spark.createDataFrame([(x, k) for k, x in enumerate("ABCDE")], "name string, ord int")
    return nodes, spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "src string, dst string")


def test_traversal(spark):
    nodes, edges = path(spark)

    def reach(seed, hops):
        s = spark.createDataFrame([(seed,)], "seed string")
        return {r["name"] for r in G.bfs(nodes, edges, s, hops).collect()}

    assert reach("A", 2) == {"A", "B", "C"} and reach("C", 1) == {"B", "C", "D"} and reach("E", 2) == {"E"} and reach("Zed", 2) == set()
    with pytest.raises(ValueError):
        reach("A", -1)
    assert {r["name"] for r in G.ego(nodes, edges, "c", 1)[0].collect()} == {"C", "D"}
    assert {r["name"]: r["degree"] for r in G.degree(nodes, edges).collect()} == {"A": 1, "B": 2, "C": 2, "D": 1, "E": 0}
    assert {r["name"]: r["component"] for r in G.components(nodes, edges).collect()} == {"A": "A", "B": "A", "C": "A", "D": "A", "E": "E"}
    ranks = {r["name"]: r["rank"] for r in G.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["D"] > ranks["A"]


def ranked(spark, ids, q=1):
    return spark.createDataFrame([(q, x, k + 1) for k, x in enumerate(ids)], "qid int, id string, rank long")


def test_fusion(spark):
    got = S.top(S.rrf([ranked(spark, "abc"), ranked(spark, "cd")]), 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["c", "a", "b", "d"] and abs(got[0]["score"] - 0.032266) < 1e-6
    robin = S.round_robin([ranked(spark, "abc"), ranked(spark, "cd"), ranked(spark, "e")]).orderBy("place").collect()
    assert [r["id"] for r in robin] == list("acebd")
    dense = ranked(spark, [f"v{k}" for k in range(1, 9)])
    fused = spark.createDataFrame([(1, "v2", 0.5), (1, "x9", 0.4)], "qid int, id string, score double")
    out = R._places(R.spliced(dense, fused, 5, 1), 6).orderBy("rank").collect()
    assert [r["id"] for r in out] == ["v1", "v2", "v3", "v4", "v5", "x9"] and out[1]["score"] == round(1 - 1 / 9, 6)
    assert [R.graph_slots(k) for k in (6, 10, 12, 1)] == [1, 2, 2, 1]


def test_chunking(spark):
    docs = spark.createDataFrame([("d", " ".join(map(str, range(10))))], "doc_id string, text string")
    rows = C.sliding_window(docs, 4, 0.25).orderBy("chunk_index").collect()
    assert [(r["start_offset"], r["end_offset"]) for r in rows] == [(0, 4), (3, 7), (6, 10), (9, 10)]
    long = " ".join(f"w{k}" for k in range(120))
    assert len(C.split_markdown(f"pre\n## A\nshort\n### B\n{long}")) == 1
    one = spark.range(1).select(T.chunk_id(F.lit("knowledge_graphs"), F.lit(2)).alias("x")).first()["x"]
    assert one == "6fc475866849cd38"
    with pytest.raises(ValueError):
        C.chunk_documents(docs, "nothing")


def test_records(spark):
    raw = spark.createDataFrame([(1, '```json\n{"entities":[{"name":"A"},],"relationships":[]}\n```'), (2, '{"entities":[{"name":"A"')], "k int, raw string")
    got = {r["k"]: r for r in X.parse_answer(raw, "raw").collect()}
    assert len(got[1]["entities"]) == 1 and got[1]["entities"][0]["type"] == "OTHER" and got[2]["_parse_error"]
    cases = spark.createDataFrame([("AI", "AIDS"), ("U.S.", "the U.S. economy"), ("", "x")], "n string, t string")
    assert [r[0] for r in cases.select(T.verbatim(F.col("n"), F.col("t"))).collect()] == [False, True, False]
    ents = spark.createDataFrame([("c", "A")], "chunk_id string, name string")
    rels = spark.createDataFrame([("c", "A", "B", 0), ("c", "A", "Z", 1)], "chunk_id string, source string, target string, pos long")
    chunks = spark.createDataFrame([("c", "A knows B.")], "chunk_id string, text string")
    assert X.endpoint_filter(rels, ents).count() == 0
    kept, stubs = X.recover_stubs(rels, ents, chunks)
    assert [r["target"] for r in kept.collect()] == ["B"] and [(r["name"], r["type"]) for r in stubs.collect()] == [("B", "OTHER")]


def test_resolution(spark):
    names = [("GPT4", "TECHNOLOGY"), ("GPT-4", "TECHNOLOGY"), ("Token set", "CONCEPT"), ("Token sets", "CONCEPT"), ("Graph", "CONCEPT"), ("Graphs", "CONCEPT"), ("Acme", "PERSON"), ("acme", "ORGANIZATION"), ("Database", "CONCEPT"), ("Databases", "CONCEPT")]
    nodes = spark.createDataFrame([(n, t, ["d"]) for n, t in names], "name string, type string, source_docs array<string>")
    reg = spark.createDataFrame([("gpt4", "GPT-4")], "alias string, canonical string")
    got = {(r["node_a"], r["node_b"]): r["classification"] for r in E.candidates(nodes, reg).collect()}
    assert got == {("GPT-4", "GPT4"): "AUTOMATIC", ("Token set", "Token sets"): "REVIEW", ("Graph", "Graphs"): "KEEP_SEPARATE"}
    edges = spark.createDataFrame([("A", "x"), ("A", "y"), ("z", "A"), ("B", "x")], "src string, dst string")
    log = E.merge_log(edges, spark.createDataFrame([("A", "B", "AUTOMATIC"), ("B", "x", "REVIEW")], "node_a string, node_b string, classification string"))
    assert [(r["survivor"], r["loser"], r["final"]) for r in log.collect()] == [("A", "B", "A")]


def test_similar_pairs_loses_none(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for k in range(150):  # pairs just over and just under the threshold
        x, y = rng.normal(size=(2, 24))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = 0.921 if k % 2 else 0.919
        rows += [(f"a{k}", (3 * x).tolist()), (f"b{k}", (c * x + np.sqrt(1 - c * c) * y).tolist())]
    rows += [("zero", [0.0] * 24), ("none", None), ("short", [1.0])]
    got = {(r["node_a"], r["node_b"]): r["cosine"] for r in E.similar_pairs(spark.createDataFrame(rows, "name string, vec array<double>"), 0.92).collect()}
    assert set(got) == {(f"a{k}", f"b{k}") for k in range(1, 150, 2)} and all(abs(c - 0.921) < 1e-9 for c in got.values())
    few = {(r["node_a"], r["node_b"]) for r in E.similar_pairs(spark.createDataFrame(rows, "name string, vec array<double>"), 0.92, block=20).collect()}
    assert few == set(got)


def test_phrases_of_any_length(spark):
    long = "one two three four five six seven eight"
    q = spark.createDataFrame([(1, f"What is {long}, and why?"), (2, "one two three"), (3, "")], "qid int, text string")
    titles = spark.createDataFrame([("a", f"{long} (film)"), ("b", "two three"), ("c", "one two three four"), ("d", "why not")], "id string, title string")
    seeds, names = spark.createDataFrame([(3, "d")], "qid int, id string"), spark.createDataFrame([(3, " Two  Three"), (3, "x")], "qid int, name string")
    assert {(r["qid"], r["id"]) for r in R.expansion(q, titles, seeds, names).collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "b"), (3, "d"), (3, "b")}
    nodes = spark.createDataFrame([(long,), ("Five six",), ("--",)], "name string")
    docs = spark.createDataFrame([(1, f"so {long}."), (2, f"{long} again"), (3, "five, six"), (4, None)], "doc_id int, text string")
    assert {(r["a"], r["b"], r["names"]) for r in G.mention_links(nodes, docs).collect()} == {("1", "2", 2), ("1", "3", 1), ("2", "3", 1)}


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid int")
    gold = spark.createDataFrame([(1, "c"), (1, "z")], "qid int, id string")
    got = {r["qid"]: r for r in M.retrieval(q, ranked(spark, "abc"), gold).collect()}
    assert got[1]["recall_at_1"] == 0 and got[1]["recall_at_3"] == 0.5 and got[1]["mrr"] == round(1 / 3, 6) and not got[1]["all_gold"] and got[2]["mrr"] == 0
    assert {r["qid"]: r["mrr"] for r in M.retrieval(q, ranked(spark, "abc"), gold, convention="runner").collect()}[2] == 1
    a = spark.createDataFrame([(1, "The Eiffel Tower", "eiffel tower, paris"), (2, "yes", "no")], "k int, p string, g string")
    f = {r["k"]: r for r in M.token_f1(a, "k", "p", "g").collect()}
    assert (f[1]["em"], f[1]["precision"], f[1]["recall"], f[1]["f1"]) == (0, 1, 0.666667, 0.8) and f[2]["f1"] == 0
    w = spark.range(1).select(*M.wilson(F.lit(8), F.lit(20))).first()
    assert round(w[0], 6) == 0.218807 and round(w[1], 6) == 0.613418
    c = spark.range(1).select(M.citations(F.lit("x [0] y [7] z [0]"), F.array(*(F.lit(f"id{k}") for k in range(3)))).alias("c")).first()["c"]
    assert c == ["id0"]
    p = spark.createDataFrame([(1, float(k)) for k in range(1, 11)], "g int, v double")
    assert M.percentile_at(p, "g", "v", 0.9).first()["value"] == 10


def test_toon(spark):
    ev = spark.createDataFrame([(1, 1, "c1", "d1", 0, 0.5, "chunk", "a,b")], "qid int, rank int, chunk_id string, source_doc string, chunk_index int, score double, source string, text string")
    toon = Z.to_toon(ev).first()["toon"]
    assert toon == 'evidence[1]{chunk_id,source_doc,chunk_index,score,source,text}:\n  c1,d1,0,0.5,chunk,"a,b"'
    assert Z.from_toon(toon) == [{"chunk_id": "c1", "source_doc": "d1", "chunk_index": 0, "score": 0.5, "source": "chunk", "text": "a,b"}]
    with pytest.raises(ValueError):
        Z.from_toon(toon.replace("[1]", "[2]"))


def test_live_index(spark, tmp_path):
    import json

    from skein.streaming.live_index import LiveIndex

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    index = LiveIndex(spark, str(tmp_path / "index"), size=4)

    def send(n, **row):
        (inbox / f"{n}.json").write_text(json.dumps(row))
        index.run(str(inbox))
        return index.version(), index.records().count()

    assert send(1, file_name="f1", text="a b c d e") == (1, 2)
    assert send(2, file_name="f1", text="a b c d e f g h i j") == (2, 3)
    assert send(3, file_name="f2", text="a b") == (3, 4)
    assert send(4, file_name="f1", removed=True) == (4, 1)
    assert send(5, file_name="nobody", removed=True) == (4, 1)
    assert index.status("f2") == "indexed" and index.status("f1") == "removed" and index.status("f3") == "unknown" and len(index.history()) == 4


def test_live_index_rebuilds_and_recovers(spark, tmp_path, monkeypatch):
    from skein.operators.extraction import ENTITY, RELATION
    from skein.streaming.live_index import LiveIndex

    monkeypatch.setattr("skein.streaming.live_index.BUCKETS", 2)  # fewer folders to write

    def extract(chunks):
        """'A knows B' is two entities and a relationship; a chunk with '!' can't be extracted."""
        w, none = F.split("text", " "), F.lit("")
        bad = F.col("text").contains("!")
        ents = F.array(*(F.struct(w[k].alias("name"), F.lit("PERSON").alias("type"), none.alias("description"), none.alias("source_sentence"), F.lit(False).alias("stub")) for k in (0, 2)))
        rels = F.array(F.struct(w[0].alias("source"), w[2].alias("target"), w[1].alias("type"), none.alias("description"), none.alias("source_sentence")))
        out = chunks.withColumn("_parse_error", F.when(bad, "no answer"))
        return out.withColumn("entities", F.when(~bad, ents).cast(f"array<{ENTITY}>")).withColumn("relationships", F.when(~bad, rels).cast(f"array<{RELATION}>"))

    def edges(index):
        return sorted((r["src"], r["dst"], r["types"][0]) for r in index.graph()[1].collect())

    index = LiveIndex(spark, str(tmp_path / "index"), extract)
    assert index.version() == 0 and edges(index) == []
    index.enqueue("f1", "Ann knows Bob")
    assert index.status("f1") == "queued"
    index.run()
    index.enqueue("f2", "ann likes Cid")
    index.enqueue("f3", "oh no !")
    index.run()
    assert index.version() == 3 and edges(index) == [("Ann", "Bob", "KNOWS"), ("Ann", "Cid", "LIKES")]
    assert index.status("f3") == "indexed_with_errors" and index.records().count() == 3
    # a crash before the pointer moves leaves the old version; the batch comes again
    index.enqueue("f1", "Dan knows Eve")
    for step in ("_publish", "build"):
        with monkeypatch.context() as m:
            m.setattr(LiveIndex, step, lambda *a: 1 / 0)
            with pytest.raises(Exception):
                index.run()
        again = LiveIndex(spark, str(tmp_path / "index"), extract)
        assert again.version() == 3 and edges(again) == [("Ann", "Bob", "KNOWS"), ("Ann", "Cid", "LIKES")]
    again.run()
    assert again.version() == 4 and edges(again) == [("Dan", "Eve", "KNOWS"), ("ann", "Cid", "LIKES")]
    again.remove("f2")
    again.run()
    assert edges(again) == [("Dan", "Eve", "KNOWS")] and again.status("f2") == "removed" and len(list((tmp_path / "index" / "pointers").glob("*.json"))) == 2
