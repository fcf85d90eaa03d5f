"""Operators whose result SQL repeats poorly, on hand-made rows."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skein.operators import chunking as C
from skein.operators import extraction as X
from skein.operators import metrics as M


def test_stems_and_gold_rules(spark):
    words = {"Happiness": "happ", "structured": "structur", "structure": "structure", "being": "being", "things": "thing", "cities": "cit", "is": "is", "movement": "move", "gas": "gas", "nation": "nation", "relation": "rela", "quickly": "quick", "sing": "sing", "testing": "test"}
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", M.stem(F.col("w")).alias("s")).collect()}
    assert got == words
    long = "x" * 41
    q = spark.createDataFrame(
        [(1, "single-chunk", "what is it", long, ""), (2, "two-chunk", "q", long, ""), (3, "cross-doc", "q", long, ""), (4, "paraphrase", "Which bridge?", long, ""), (5, "no-answer", "q", None, "NOT ANSWERABLE here"), (6, "no-answer", "q", "yes", ""), (7, "odd", "q", "short", ""), (8, "paraphrase", "who made the crossing", long, None)],
        "qid int, type string, text string, answer string, note string",
    )
    chunks = spark.createDataFrame([("a", "d1", "The bridge was built in 1900"), ("b", "d1", "More words"), ("c", "d2", "Other words")], "id string, doc_id string, text string")
    gold = spark.createDataFrame([(1, "a", ["BRIDGE", "tunnel"]), (1, "b", None), (2, "a", []), (2, "c", []), (3, "a", []), (3, "c", []), (4, "a", []), (6, "a", []), (8, "zz", []), (7, "b", [])], "qid int, id string, required_terms array<string>")
    got = {(r["qid"], r["rule"]) for r in M.gold_problems(q, gold, chunks).collect()}
    assert got == {(1, "one gold chunk"), (1, "required terms"), (2, "two gold chunks of one document"), (4, "shared stems"), (6, "no gold and no answer"), (7, "type"), (7, "an answer"), (8, "unknown chunk")}


def test_resampling(spark, monkeypatch):
    """Intervals agree with the normal ones, whether a group is one block or many, and are the same again."""
    rng = random.Random(3)
    rows = [(k, "a" if k % 3 else None, rng.gauss(1, 2), rng.gauss(0.5, 2)) for k in range(3000)] + [(5000, "b", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k long, g string, a double, b double").repartition(5)
    for block in (50_000, 300):
        monkeypatch.setattr(M, "BLOCK", block)
        got = {r["g"]: r for r in M.bootstrap_mean(df, ["g"], "a", "k").collect()}
        assert got == {r["g"]: r for r in M.bootstrap_mean(df.repartition(2), ["g"], "a", "k").collect()}
        for g in ("a", None):
            x = [r[2] for r in rows if r[1] == g]
            half = 1.96 * statistics.stdev(x) / math.sqrt(len(x))
            assert got[g]["mean"] == pytest.approx(statistics.fmean(x)) and got[g]["lo"] == pytest.approx(statistics.fmean(x) - half, abs=half / 5) and got[g]["hi"] == pytest.approx(statistics.fmean(x) + half, abs=half / 5)
        assert got["b"]["lo"] == got["b"]["hi"] == 2.0
        pair = {r["g"]: r for r in M.paired_bootstrap(df, ["g"], "a", "b", "k", draws=500).collect()}
        own = [r for r in rows if r[1] == "a"]
        assert pair["a"]["diff"] == pytest.approx(statistics.fmean(r[3] - r[2] for r in own)) and pair["a"]["wins"] == sum(r[3] > r[2] for r in own) and pair["a"]["excludes_0"]
        assert pair["b"]["ties"] == 1 and not pair["b"]["excludes_0"]


def test_recursive_split():
    text = "One two three. Four five six. Seven eight.\n\nNine ten eleven twelve thirteen fourteen fifteen sixteen seventeen.\nEnd " + "z" * 40
    for target, overlap in ((6, 0.0), (6, 0.2), (3, 0.4)):
        pieces = C.split_recursive(text, target, overlap)
        assert all(len(C._token.findall(p)) <= target and p.strip() for p in pieces)
        assert overlap or "".join("".join(pieces).split()) == "".join(text.split())  # blank pieces drop out
    assert C.split_recursive("a b. c d. e f", 4, 0.0) == ["a b. c d. ", "e f"]
    assert C.split_recursive("a b. c d. e f", 4, 0.07) == ["a b. c d. ", " e f"] and C.split_recursive(" \n", 3, 0.1) == []


def test_validation_by_chunk(spark):
    chunks = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("d", " ")], "chunk_id string, text string")
    nodes = spark.createDataFrame([("a", "Ann", "PERSON", "x"), ("a", "entity_name", "PERSON", "x"), ("b", "<|name|>", "PERSON", "x"), ("b", "Bob", "PERSON", " ")], "chunk_id string, name string, type string, description string")
    edges = spark.createDataFrame([("a", "Ann", "Ann ", "KNOWS", "x"), ("b", "Bob", "Cid", "KNOWS", "a <source_entity> b")], "chunk_id string, source string, target string, type string, description string")
    assert {tuple(r) for r in X.validation_failures(chunks, nodes, edges).collect()} == {("b", "only placeholders"), ("c", "nothing extracted")}
    with pytest.raises(ValueError, match="chunk b"):
        X.require_valid(chunks, nodes, edges)
    only = chunks.where("chunk_id = 'a'")
    good, none = X.require_valid(only, nodes.where("chunk_id = 'a'"), edges.where("chunk_id = 'a'"))
    assert [r["name"] for r in good.collect()] == ["Ann"] and none.count() == 0
