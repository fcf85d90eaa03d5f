"""The slim graph: the same as the whole one, from rows that are counted before anything sorts them."""

import os

import pytest

from skein.operators import graph as G

SF = "/root/testdata/sf0.001"
ENTS = "record_no long, pos long, chunk_id string, doc_id string, name string, type string, description string, source_sentence string, stub boolean"
RELS = "record_no long, pos long, chunk_id string, doc_id string, source string, target string, type string, description string, source_sentence string"


def records(spark):
    far = 9_000_000_000_000_000_000
    ents = [
        (far, far, "c9", "d9", "ACME", "ORG", "last", "s", True),
        (2, 5, "c2", "d2", " Acme ", "OTHER", None, "s", False),
        (2, 11, "c2", None, "acme", "", "later", "s", None),
        (10, 0, "c3", "d1", "acme", "FIRM", "x", "s", False),
        (3, 0, "c3", "d1", "Bolt", None, "a bolt", "s", True),
        (3, 1, "c3", "d1", "  ", "ORG", "blank", "s", True),
        (4, 0, "c4", "d4", "Cog", "PART", "", "s", True),
    ]
    rels = [
        (5, 1, "c1", "d1", "acme", "bolt", "sells ", "second", "s"),
        (5, 0, "c1", "d2", "ACME", "Bolt", "makes", "first", "s"),
        (6, 0, "c1", "d3", "acme", "BOLT", None, "third", "s"),
        (7, 0, "c2", "d1", "acme", "cog", "uses", None, "s"),
        (8, 0, "c2", "d1", "acme", " ACME", "is", "loop", "s"),
        (9, 0, "c2", "d1", "acme", "ghost", "sees", "dangling", "s"),
        (9, 1, "c2", "d1", "ghost", "ghost", "sees", "dangling loop", "s"),
    ]
    return spark.createDataFrame(ents, ENTS), spark.createDataFrame(rels, RELS)


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_slim_graph_is_the_whole_one_without_its_arrays(spark):
    ents, rels = records(spark)
    whole = G.build_nodes(ents)
    nodes = G.saved(G.slim_nodes(ents, True))
    assert rows(nodes, nodes.columns) == rows(whole, nodes.columns) and nodes.count() == 3
    resolved = G.resolve_ends(rels, nodes)
    edges = G.typed(G.slim_edges(rels, nodes, True), resolved)
    columns = ["src", "dst", "mentions", "types", "description", "source_doc", "ord"]
    assert rows(edges, columns) == rows(G.build_edges(resolved), columns) and edges.count() == 2
    assert rows(G.slim_edges(rels, nodes), ["src", "dst", "mentions", "ord"]) == rows(edges, ["src", "dst", "mentions", "ord"])
    assert rows(G.self_loops(rels, nodes), ["record_no"]) == rows(resolved.where("src = dst"), ["record_no"]) == [(8,)]


def test_mentions_are_hashed_before_they_are_shuffled(spark):
    """A sort of all mentions is what spills."""
    ents, rels = records(spark)
    for df in (G.slim_nodes(ents), G.slim_edges(rels, G.saved(G.slim_nodes(ents)))):
        plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        lowest = [line for line in plan if "Aggregate" in line][-1]
        assert " HashAggregate" in lowest or "-HashAggregate" in lowest, lowest


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_focused_questions_build_no_graph(spark, monkeypatch):
    from skein.queries import retrieval as Q

    def never(*_, **__):
        raise AssertionError("the whole graph was built")

    monkeypatch.setattr(Q, "placed", never)
    monkeypatch.setattr(Q, "graph", never)
    assert Q._focused(spark, SF)[0].count() > 0
