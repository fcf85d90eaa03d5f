"""Sinks, resets and reports, and what undoes a merge."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import resolution as E
from skein.operators import search as S
from skein.operators import serialize as Z
from skein.sources import stores
from test_operators import records


def built(spark):
    e, r = records(spark)
    nodes = G.saved(G.build_nodes(e))
    return nodes, G.saved(G.build_edges(G.resolve_ends(r, nodes)))


def test_collections_and_reset(spark, tmp_path):
    nodes, edges = built(spark)
    chunks = spark.createDataFrame([("c1", 0, "d1", "first"), ("c1", 1, "d1", "again"), ("c2", 0, "d2", "")], "chunk_id string, chunk_index int, doc_id string, text string")
    embed = S.hashed_embedder(8)
    folder = str(tmp_path / "index")
    for _ in range(2):  # the second run replaces the first
        stores.write_collections(folder, stores.collections(nodes, edges, chunks, G.pagerank(nodes, edges), lambda df: S.embedded(df, embed, 8)))
    ents, rels, own = (spark.read.parquet(f"{folder}/{n}") for n in ("entities", "relationships", "chunks"))
    assert {r["id"] for r in ents.collect()} == {"Graph_DB", "HNSW", "Graph_DBs"} and ents.where(F.size("text_vec") == 8).count() == 3
    assert [r["rel_id"] for r in rels.orderBy("rel_id").collect()] == ["rel_00000", "rel_00001"] and rels.where("text like 'USES Graph DB HNSW%'").count() == 1
    assert {(r["id"], r["text"]) for r in own.collect()} == {("c1", "first"), ("c2", "")}
    assert stores.resolve_path(spark, [str(tmp_path / "none"), folder], ["missing", "chunks"]) == f"{folder}/chunks"
    with pytest.raises(FileNotFoundError):
        stores.resolve_path(spark, [folder], ["missing"])
    (tmp_path / "index" / "chunks" / "notes.txt").write_text("mine")
    with pytest.raises(ValueError, match="notes.txt"):
        stores.reset(spark, f"{folder}/chunks")
    stores.reset(spark, f"{folder}/entities")
    assert not (tmp_path / "index" / "entities").exists()


def test_graphml_and_report(spark, tmp_path):
    nodes, edges = built(spark)
    nodes = nodes.withColumn("name", F.when(F.col("name") == "HNSW", "H<N&S>W").otherwise(F.col("name")))
    stores.write_graphml(nodes, edges.withColumn("dst", F.lit("H<N&S>W")), str(tmp_path / "g"))
    text = "".join(p.read_text() for p in (tmp_path / "g").glob("part-*"))
    root = ET.fromstring(text)
    space = {"g": "http://graphml.graphdrawing.org/xmlns"}
    assert {n.get("id") for n in root.findall(".//g:node", space)} == {"Graph DB", "Graph DBs", "H<N&S>W"} and len(root.findall(".//g:edge", space)) == 2
    stores.write_report(spark.createDataFrame([(1, "a,b", 0.5)], "x int, y string, z double"), str(tmp_path / "r"), ["z", "y"])
    assert "".join(p.read_text() for p in (tmp_path / "r").glob("part-*")) == 'z,y\n0.5,"a,b"\n'


def test_sample_and_pages(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(200)], "k int, s string")
    small, large = ({r["k"] for r in stores.stratified_sample(df, "s", "k", {"a": n, "b": 3}).collect()} for n in (10, 30))
    assert small < large and len(small) == 13 and len(large) == 33
    assert [r["k"] for r in stores.page(df, [F.desc("k")], 3, 20).collect()] == list(range(159, 139, -1))


def test_merges_can_be_undone(spark):
    nodes, edges = built(spark)
    registry = spark.createDataFrame([("nothing", "else")], "alias string, canonical string")
    n, e, log = E.resolve(nodes, edges, registry, "semantic")
    assert [(m["survivor"], m["loser"]) for m in log.collect()] == [("Graph DB", "Graph DBs")]
    assert {r["name"]: r["aliases"] for r in n.collect()} == {"Graph DB": ["Graph DBs"], "HNSW": []} and [(r["src"], r["dst"], r["mentions"]) for r in e.collect()] == [("Graph DB", "HNSW", 3)]
    back, again = E.rollback(n.drop("aliases"), e, nodes, edges, "Graph DBs")
    assert {r["name"] for r in back.collect()} == {"Graph DB", "Graph DBs", "HNSW"} and {(r["src"], r["dst"]) for r in again.collect()} == {("Graph DB", "HNSW"), ("Graph DBs", "HNSW")}
    rows = {r["config"]: r for r in E.report({"baseline": (nodes, edges), "semantic": (n, e)}).collect()}
    assert (rows["baseline"]["nodes"], rows["semantic"]["nodes"], rows["semantic"]["edges"]) == (3, 2, 1)
    none, same, log = E.resolve(nodes, edges, registry, "baseline")
    assert none.count() == 3 and same.count() == 2 and log is None


def test_formats_cost(spark):
    ev = spark.createDataFrame([(1, k, f"c{k}", "d", k, 0.5, "chunk", "some text") for k in range(1, 6)], "qid int, rank int, chunk_id string, source_doc string, chunk_index int, score double, source string, text string")
    row = Z.compare_formats(ev).first().asDict()
    assert row["qid"] == 1 and len(row) > 2
    toon = Z.to_toon(ev, include_text=False).first()["toon"]
    assert Z.from_toon(toon)[0]["text"] == "" and len(Z.from_toon(toon)) == 5
