"""Plans that make no row for each pair of a question and a chunk, and read the places of their hits alone."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def test_a_title_of_many_chunks_is_no_row_for_each(spark, monkeypatch):
    from skein.plans import query_focused as Q
    from skein.plans import retrieval as R

    def never(*_, **__):
        raise AssertionError("the selected chunks of each question became rows")

    monkeypatch.setattr(R, "expansion", never)
    monkeypatch.setattr(Q, "question_graphs", never)
    chunks = [f"c{i:03}" for i in range(300)]
    titles = spark.createDataFrame([(c, "Blue bolt (B1)") for c in chunks] + [("z", "Red nut")], "id string, title string")
    ents = spark.createDataFrame([(c, n) for c in chunks for n in ("blue bolt", "Acme")] + [("c007", "Red nut"), ("z", "red nut")], "chunk_id string, name string")
    rels = spark.createDataFrame([(c, "Acme", "Blue  bolt") for c in chunks] + [("c009", "acme", "ghost"), ("c009", "acme", "ACME")], "chunk_id string, source string, target string")
    questions = spark.createDataFrame([(q, "who sells the blue bolt") for q in range(5)], "qid int, text string")
    dense = spark.createDataFrame([(q, "z", 1) for q in range(5)], "qid int, id string, rank int")
    got, counts = Q.query_focused(questions, dense, titles, ents, rels, 3)
    assert sorted((r["qid"], r["rank"], r["id"]) for r in got.collect()) == [(q, n + 1, f"c{n:03}") for q in range(5) for n in range(3)]
    assert {tuple(r[c] for c in Q.COUNTERS) for r in counts.collect()} == {(301, 1, 3, 1, 300)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_plans_store_no_places(spark, monkeypatch):
    from skein.operators import graph as G
    from skein.queries import retrieval as Q

    def never(*_, **__):
        raise AssertionError("the places of all nodes or edges were told apart")

    monkeypatch.setattr(G, "node_places", never)
    monkeypatch.setattr(G, "edge_places", never)
    assert Q.q4(spark, SF).count() == 40


def test_contents_of_a_title_are_charged_without_a_row_for_each_chunk(spark, monkeypatch):
    from pyspark.sql import functions as F

    from skein.plans import query_focused as Q
    from skein.plans import retrieval as R

    def never(*_, **__):
        raise AssertionError("the selected chunks of each question became rows")

    monkeypatch.setattr(R, "expansion", never)
    paragraphs = spark.createDataFrame([(f"c{i:03}", "Blue bolt (B1)", f"text {i % 3}") for i in range(60)] + [("z", "Red nut", "other")], "id string, title string, text string")
    questions = spark.createDataFrame([(q, "the blue bolt") for q in (1, 2)], "qid int, text string")
    dense = spark.createDataFrame([(1, "z", 1), (2, "c003", 1)], "qid int, id string, rank int")
    none = F.array().cast("array<struct<source:string,target:string>>")
    extract = lambda m: m.select("content_sha256", F.when(F.col("text") == "text 2", "failed_model").otherwise("ok").alias("status"), F.array(F.struct(F.lit("nobody").alias("name"))).alias("entities"), none.alias("relationships"))
    known = extract(spark.createDataFrame([("text 0",)], "text string").select("text", F.sha2("text", 256).alias("content_sha256")))
    counts, grown = Q.on_demand(questions, dense, paragraphs, known, extract)[1:]
    columns = ("lookups", "hits_ok", "hits_failed", "misses", "extracted_ok", "extracted_failed_model", "extracted_failed_infra", "valid_records", "failed_or_missing")
    assert {r["qid"]: tuple(r[c] for c in columns) for r in counts.collect()} == {1: (61, 39, 19, 3, 2, 1, 0, 41, 20), 2: (60, 40, 20, 0, 0, 0, 0, 40, 20)}
    assert grown.count() == 4
