"""Loaders, sinks, logs and caches."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import search as S
from skein.plans import retrieval as R
from skein.sources import stores


def test_benchmark_round_trip(spark, tmp_path):
    folder = str(tmp_path / "bench")
    q = spark.createDataFrame([("q1", "Who?", "Ann", "bridge", "easy"), ("q2", "What?", "it", "comparison", "hard")], "_id string, question string, answer string, type string, level string")
    p = spark.createDataFrame([("c1", "T", ["a", "b"], "a b"), ("c2", "U", ["d"], "d")], "chunk_id string, title string, sentences array<string>, text string")
    contexts = spark.createDataFrame([("q1", 2, "c1"), ("q1", 1, "c2"), ("q2", 1, "c1")], "question_id string, ord int, chunk_id string")
    facts = spark.createDataFrame([("q1", "T", 1, "c1"), ("q1", "T", 0, "c1"), ("q1", "Z", 0, None)], "question_id string, title string, sent_id int, chunk_id string")
    stores.write_benchmark(folder, q, p, contexts, facts, {"seed": "42"})
    got = stores.load_benchmark(spark, folder)
    rows = {r["_id"]: r for r in got["questions"].collect()}
    assert rows["q1"]["gold_chunk_ids"] == ["c1"] and rows["q1"]["context_chunk_ids"] == ["c2", "c1"] and [x["sent_id"] for x in rows["q1"]["supporting_facts"]] == [0, 1, 0]
    assert rows["q2"]["gold_chunk_ids"] == rows["q2"]["supporting_facts"] == [] and got["facts"].count() == 3
    stats = {r["name"]: r["value"] for r in got["corpus_stats"].collect()}
    assert stats["paragraphs"] == "2" and stats["sentences"] == "3" and stats["unmatched_facts"] == "1" and got["benchmark_config"].first()["value"] == "42"
    corpus = stores.load_corpus(spark, folder)
    assert corpus.columns == ["chunk_id", "title", "sentences", "text"] and corpus.count() == 2
    files = sorted(x.name for x in (tmp_path / "bench").iterdir())
    assert files == ["benchmark_config.jsonl", "corpus.jsonl", "corpus_stats.jsonl", "questions.jsonl", "sample_ids.jsonl", "supporting_facts.jsonl"]


def test_log_keeps_the_last_entry(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "content_sha256 string, status string"
    assert stores.log(spark, path, schema, "content_sha256").count() == 0
    for batch, rows in enumerate([[("a", "failed"), ("b", "ok")], [("a", "ok")]]):
        for _ in range(2):  # written again after a crash
            stores.append(spark.createDataFrame(rows, schema), path, batch)
    assert {tuple(r) for r in stores.log(spark, path, schema, "content_sha256").collect()} == {("a", "ok"), ("b", "ok")}


def test_documents_and_provenance(spark, tmp_path):
    for name in ("a.txt", "b.MD", "c.tXt", "d.json"):
        (tmp_path / name).write_text(name)
    assert [r["doc_id"] for r in stores.documents(spark, str(tmp_path)).collect()] == ["a", "b", "c"]
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in stores.provenance(spark, str(tmp_path)).collect()}
    assert got["d.json"] == (6, hashlib.sha256(b"d.json").hexdigest())


def test_embedder_and_cache(spark):
    embed = S.hashed_embedder(16)
    df = spark.createDataFrame([("q1", "red bolt"), ("q2", " "), ("q3", "red bolt"), ("q4", None)], "qid string, text string")
    got = {r["qid"]: r["vec"] for r in S.embedded(df, embed, 16).collect()}
    assert got["q1"] == got["q3"] and sum(v * v for v in got["q1"]) == pytest.approx(1) and got["q2"] == got["q4"] == [1.0] + [0.0] * 15
    with pytest.raises(Exception, match="isn't 8"):
        S.embedded(df, embed, 8).collect()
    cache = S.QueryCache(lambda t: t.withColumn("vec", embed(F.col("text"))), G.saved, most=3)
    for asked, misses in (("q1 q2", 2), ("q3 q1", 2)):
        out = cache.with_vectors(df.where(F.col("qid").isin(*asked.split())))
        assert out.count() == 2 and out.where("vec is null").count() == 0 and cache.misses == misses
    more = spark.createDataFrame([("q5", "x y"), ("q6", "z"), ("q7", "red bolt")], "qid string, text string")
    assert cache.with_vectors(more).where("vec is null").count() == 0 and cache.misses == 4 and cache.held.count() == 2


def test_plans_have_one_signature(spark):
    assert R.plan("naive") is R.PLANS["flat"] and R.plan("mix_opt") is R.PLANS["mix_optimised"]
    with pytest.raises(ValueError, match="unknown plan"):
        R.plan("nonsense")
    ents = [(1, k, "c1", "d1", n, "PERSON", f"about {n}", f"{n} is here.", False) for k, n in enumerate(["Ann Lee", "Bob Ray"])] + [(2, 0, "c2", "d2", "Bob Ray", "PERSON", "", "Bob Ray again.", False), (2, 1, "c2", "d2", "Cid", "PERSON", "", "", False)]
    rels = [(1, 5, "c1", "d1", "Ann Lee", "Bob Ray", "KNOWS", "friends", ""), (2, 5, "c2", "d2", "Bob Ray", "Cid", "KNOWS", "", "")]
    m = spark.createDataFrame(ents, "record_no long, pos long, chunk_id string, doc_id string, name string, type string, description string, source_sentence string, stub boolean")
    r = spark.createDataFrame(rels, "record_no long, pos long, chunk_id string, doc_id string, source string, target string, type string, description string, source_sentence string")
    nodes = G.saved(G.build_nodes(m))
    edges = G.saved(G.build_edges(G.resolve_ends(r, nodes)))
    embed = S.hashed_embedder(8)

    def items(df):
        return G.saved(S.embedded(df, embed, 8))

    chunks = items(spark.createDataFrame([("c1", "d1", "Ann Lee (person)", "Ann Lee knows Bob Ray"), ("c2", "d2", "Cid", "Bob Ray knows Cid"), ("c3", "d3", "Else", "nothing to see")], "id string, doc_id string, title string, text string"))
    c = R.Corpus(chunks, items(nodes.select(F.col("name").alias("id"), F.col("name").alias("text"))), items(edges.select(F.concat_ws("|", "src", "dst").alias("id"), F.concat_ws(" ", "src", "dst").alias("text"))), nodes, edges, G.pagerank(nodes, edges), m.select("chunk_id", "name"), r.select("chunk_id", "source", "target"))
    q = items(spark.createDataFrame([(1, "Who is Ann Lee?"), (2, "Cid")], "qid int, text string"))
    for name in R.PLANS:
        got = R.plan(name)(c, q, 2)
        assert sorted(got.columns) == ["id", "qid", "rank", "score"], name
        rows = {(x["qid"], x["rank"]): x["id"] for x in got.collect()}
        assert rows[1, 1] == "c1" and rows[2, 1] == "c2", (name, rows)
    assert {x["name"] for x in R.plans()} == set(R.PLANS)


def plain_query_focused(question, dense, titles, ents, rels, k):
    """The plan for one question, step by step."""
    seeds, text = dense[:5], question.lower()
    named = {n.lower() for c, n in ents if c in seeds}
    base = {i: t.split(" (")[0].lower() for i, t in titles.items()}
    inside = lambda p: f" {p} " in f" {text} "
    chosen = set(seeds) | {i for i, b in base.items() if len(b) >= 4 and inside(b)} | {i for i, t in titles.items() if t.lower() in named or (len(base[i]) >= 4 and base[i] in named)}
    where = {}
    for c, n in ents:
        if c in chosen:
            where.setdefault(n.lower(), set()).add(c)
    links = {(s.lower(), t.lower(), c) for c, s, t in rels if c in chosen and s.lower() != t.lower() and s.lower() in where and t.lower() in where}
    far = {n: 0 for n in where if len(n) >= 3 and inside(n)}
    if not far:
        return dense[:k]
    for d in (1, 2):
        for s, t, _ in sorted(links):
            for a, b in ((s, t), (t, s)):
                if far.get(a) == d - 1 and b not in far:
                    far[b] = d
    score = {}
    for n, d in far.items():
        for c in where[n]:
            score[c] = score.get(c, 0) + 1 / (1 + d)
    for s, t, c in links:
        if s in far and t in far:
            score[c] = score.get(c, 0) + 0.5 / (1 + min(far[s], far[t]))
    place = {c: n for n, c in enumerate(dense)}
    best = sorted(score, key=lambda c: (-round(score[c], 9), place.get(c, 10**6), c))
    out = best + [c for c in dense if c not in score]
    return (out + sorted(chosen - set(out)))[:k]


def test_query_focused_equals_a_plain_version(spark):
    import random

    from skein.plans import query_focused as Q

    rng = random.Random(12)
    names = [f"name{k} {rng.choice(['lee', 'ray', 'ona'])}" for k in range(25)] + ["ab", "Xy"]
    chunks = [f"c{k:02d}" for k in range(30)]
    ents = sorted({(c, rng.choice(names)) for c in chunks for _ in range(4)})
    rels = sorted({(c, *rng.choices(names, k=2)) for c in chunks for _ in range(4)})
    titles = {c: f"{rng.choice(names).title()}{rng.choice([' (film)', ''])}" for c in chunks}
    questions = {k: "who met " + " and ".join(rng.sample(names, 2)) if k % 4 else "nobody at all" for k in range(12)}
    dense = {k: rng.sample(chunks, 8) for k in questions}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got, counts = Q.query_focused(
        frame(list(questions.items()), "qid int, text string"), frame([(q, c, n + 1) for q, d in dense.items() for n, c in enumerate(d)], "qid int, id string, rank int"), frame(list(titles.items()), "id string, title string"),
        frame(ents, "chunk_id string, name string"), frame(rels, "chunk_id string, source string, target string"), 10,
    )
    rows = {}
    for r in sorted(got.collect(), key=lambda r: (r["qid"], r["rank"])):
        rows.setdefault(r["qid"], []).append(r["id"])
    assert rows == {q: plain_query_focused(text, dense[q], titles, ents, rels, 10) for q, text in questions.items()}
    assert {r["qid"] for r in counts.collect()} == set(questions) and json.dumps([r["anchors"] for r in counts.collect()])
