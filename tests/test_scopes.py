"""Searches within scopes by groups of rows, which are broadcast with the questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import search as S
from skein.plans import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(7)
    words = ["blue", "bolt", "gear", "red", "valve", "iron"]
    items = [(f"c{n:03d}", f"doc{n % 7}", " ".join(rng.choice(words, 4)), [float(x) for x in rng.normal(size=5)], [f"g{x}" for x in rng.choice(12, 2, replace=False)]) for n in range(150)]
    asked = [(n, " ".join(rng.choice(words, 2)), [float(x) for x in rng.normal(size=5)]) for n in range(40)]
    return items, asked, spark.createDataFrame(items, "id string, doc_id string, text string, vec array<double>, groups array<string>"), spark.createDataFrame(asked, "qid int, text string, vec array<double>")


def _ids(rows):
    return sorted((r["qid"], r["id"], r["rank"]) for r in rows.collect())


@pytest.mark.parametrize("held", [1_000_000, 20, 1])
@pytest.mark.parametrize("share", [0.05, 0.9])
def test_scopes_by_group_equal_scopes_by_id(spark, corpus, monkeypatch, held, share):
    """Few or many rows in scope; blocks cut by their pairs; questions whose scope is joined."""
    items, asked, df, q = corpus
    monkeypatch.setattr(S, "HELD", held)
    rng = np.random.default_rng(3)
    q, some = q.where("qid < 6"), [a for a in asked if a[0] < 6]
    docs = [(a[0], f"doc{d}") for a in some for d in range(7) if rng.random() < share] + [(0, "nowhere")]
    names = [(a[0], f"g{g}") for a in some for g in range(12) if rng.random() < share]
    by_doc = [(n, i[0]) for n, d in docs for i in items if i[1] == d]
    by_name = sorted({(n, i[0]) for n, g in names for i in items if g in i[4]})
    pairs = lambda rows, kind: spark.createDataFrame(rows, kind)
    for search in (S.cosine_top, S.bm25_top):
        want = _ids(search(df, q, 5, pairs(by_doc, "qid int, id string")))
        assert _ids(search(df, q, 5, pairs(docs, "qid int, doc_id string"))) == want
        want = _ids(search(df, q, 5, pairs(by_name, "qid int, id string")))
        assert want
        assert _ids(search(df, q, 5, pairs(names, "qid int, group string"), df.select("id", F.col("groups").alias("group")))) == want


def test_no_row_carries_questions(spark, corpus):
    """Before, each row of a scope by document held a list of all questions of its document."""
    df, q = corpus[2:]
    scope = q.crossJoin(df.select("doc_id").distinct()).select("qid", "doc_id")
    plan = S.cosine_top(df, q, 3, scope)._jdf.queryExecution().optimizedPlan().toString()
    assert "_asked" not in plan


def test_named_scope_has_a_row_for_each_candidate(spark):
    """Not for each chunk of it; questions whose candidates name none get their documents."""
    places = spark.createDataFrame([("a", f"c{n}", "d1") for n in range(50)] + [("b", "c3", "d1")], "key string, chunk_id string, doc_id string")
    nodes = spark.createDataFrame([("A", "a", ["d1"]), ("B", "b", ["d1"]), ("Z", "z", ["d2"])], "name string, key string, source_docs array<string>")
    chunks = spark.createDataFrame([(f"c{n}", "d1") for n in range(50)] + [("e1", "d2")], "id string, doc_id string")
    found = spark.createDataFrame([(1, "A"), (1, "B"), (2, "Z")], "qid int, name string")
    within, members = R.named_scope(found, nodes, chunks, "candidates", (places, None))
    assert within.count() == 3
    got = {(r["qid"], r["id"]) for r in within.join(members.select("id", F.explode("group").alias("group")), "group").collect()}
    assert got == {(1, f"c{n}") for n in range(50)} | {(2, "e1")}


def test_stored_rows_can_be_read_by_several_tasks(spark):
    df = G.saved(spark.range(1000).coalesce(1), 100)
    assert df.count() == 1000
    assert len(df.inputFiles()) == 10


def test_chunks_of_documents_meet_questions_in_several_tasks(spark, monkeypatch):
    """Before, one task made all rows of a few candidates."""
    monkeypatch.setattr(R, "ROWS", 25)
    nodes = spark.createDataFrame([("A", ["d0", "d1"]), ("B", ["d1"])], "name string, source_docs array<string>")
    chunks = spark.createDataFrame([(f"c{n}", f"d{n % 3}") for n in range(100)], "id string, doc_id string").coalesce(1)
    got = R.candidate_scope(spark.createDataFrame([(1, "A"), (2, "B")], "qid int, name string"), nodes, chunks)
    assert sorted(map(tuple, got.collect())) == sorted([(1, f"c{n}") for n in range(100) if n % 3 < 2] + [(2, f"c{n}") for n in range(100) if n % 3 == 1])
    assert len([f for f in got.inputFiles() if "skein-graph" in f]) >= 4
