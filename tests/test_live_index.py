"""The live index after random uploads and removals against a graph built from its records."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from skein.operators.extraction import ENTITY, RELATION
from skein.streaming import live_index as L


def extract(chunks):
    """Each word is an entity, each pair of neighbours a relationship; a chunk with '!' can't be extracted."""
    w, none = F.split("text", " "), F.lit("")
    bad = F.col("text").contains("!")
    ents = F.transform(w, lambda x: F.struct(x.alias("name"), F.when(F.length(x) > 2, "THING").otherwise("OTHER").alias("type"), F.concat(F.lit("about "), x).alias("description"), none.alias("source_sentence"), F.lit(False).alias("stub")))
    rels = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(F.get(w, i).alias("source"), F.get(w, i + 1).alias("target"), F.lit("next").alias("type"), F.get(w, i).alias("description"), none.alias("source_sentence")))
    out = chunks.withColumn("_parse_error", F.when(bad, "no answer"))
    return out.withColumn("entities", F.when(~bad, ents).cast(f"array<{ENTITY}>")).withColumn("relationships", F.when(~bad & (F.size(w) > 1), rels).otherwise(F.array().cast(f"array<{RELATION}>")).cast(f"array<{RELATION}>"))


def cells(df):
    return sorted(map(repr, df.collect()))


def equals_rebuild(index):
    nodes, edges = index.build(*L.mentioned(index.records()))
    edges = L.named(edges, nodes)
    got = index.graph()
    assert cells(got[0].select(nodes.columns)) == cells(nodes) and cells(got[1].select(edges.columns)) == cells(edges)


def test_random_uploads_and_removals(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FAN", 3)
    monkeypatch.setattr(L, "BUCKETS", 2)
    rng = random.Random(1)
    root = tmp_path / "index"
    index = L.LiveIndex(spark, str(root), extract, size=6)
    words = ["Ann", "ann", "ANN", "Bob", "cid", "Cid", "to", "To", "dan"]
    held = {}
    for step in range(5):
        rows = []
        for name in rng.sample("abcdef", rng.randint(1, 3)):
            gone = rng.random() < 0.3
            text = None if gone else " ".join(rng.choices(words, k=rng.randint(1, 9))) + rng.choice(["", "", " !"])
            rows.append((name, text, gone))
            held.pop(name, None)
            if not gone:
                held[name] = text
        index.apply(spark.createDataFrame(rows, "file_name string, text string, removed boolean"), step)
        assert {r[0] for r in index.records().select("file_name").distinct().collect()} == set(held)
        if step in (2, 4):
            equals_rebuild(index)
    segments = index._pointer()["segments"]
    assert len(segments) < 5 and any(x["level"] for x in segments)  # some became one
    kept = {n for p in index._pointers() for n in (x["name"] for x in index._load(p)["segments"])}
    assert {d for d in os.listdir(root / "segments") if not d.startswith(".")} == kept


def test_untouched_files_are_not_written_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BUCKETS", 2)
    root = tmp_path / "index"
    index = L.LiveIndex(spark, str(root), extract)
    index.apply(spark.createDataFrame([(f"f{k}", f"Ann x{k} y{k}", False) for k in range(5)], "file_name string, text string, removed boolean"), 0)
    before = {p: p.stat().st_mtime_ns for p in (root / "segments").rglob("*.parquet")}
    index.apply(spark.createDataFrame([("g", "zed x1", False)], "file_name string, text string, removed boolean"), 1)
    new = [p for p in (root / "segments").rglob("*.parquet") if p not in before]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    own = index._pointer()["segments"][-1]["name"]
    at = f"{root}/segments/{own}"
    assert new and all(own in str(p) for p in new)
    assert {r[0] for r in spark.read.parquet(f"{at}/chunks").select("file_name").distinct().collect()} == {"g"}
    assert {r[0] for r in spark.read.parquet(f"{at}/nodes").select("key").collect()} == {"zed", "x1"}  # touched keys alone
    equals_rebuild(index)


def test_lost_checkpoint_swallows_and_repeats_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BUCKETS", 2)
    root = tmp_path / "index"
    index = L.LiveIndex(spark, str(root), extract)
    index.enqueue("f1", "Ann Bob")
    index.remove("f2")
    index.run()
    index.enqueue("f2", "Cid Dan")
    index.enqueue("f1", "Eve Fay")
    index.run()
    assert index.version() == 3
    # the kept inbox comes again, with batch ids from 0: nothing changes
    shutil.rmtree(root / "_checkpoint")
    index.run()
    assert index.version() == 3 and {r["text"] for r in index.records().collect()} == {"Cid Dan", "Eve Fay"}
    # a cleaned inbox: new uploads of used batch ids are taken in
    shutil.rmtree(root / "_checkpoint")
    for f in (root / "inbox").iterdir():
        f.unlink()
    index.enqueue("f3", "Gus Hal")
    assert index.status("f3") == "queued"
    index.run()
    assert index.version() == 4 and index.status("f3") == "indexed" and index.records().count() == 3
    equals_rebuild(index)


def test_crash_behind_the_pointer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BUCKETS", 2)
    index = L.LiveIndex(spark, str(tmp_path / "index"), extract)
    index.enqueue("f1", "Ann Bob")
    with monkeypatch.context() as m:
        m.setattr(L.LiveIndex, "_take", lambda self, names: 1 / 0 if names else None)
        with pytest.raises(Exception):
            index.run()
    assert index.version() == 1
    index.run()
    assert index.version() == 1 and index.history()[0]["files"] == {"f1": "indexed"}
