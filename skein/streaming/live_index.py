"""The live index: uploads and removals as a stream, published as versions.

State lives under one folder. inbox/ has a JSON file for each upload or removal, taken/ an
empty file for each of these that has been applied. A batch writes a segment: the chunks,
mentions and relationships of its files, and the nodes and edges of the keys that these or
the rows they replace touch, aggregated anew from all live mentions of those keys. Nothing
else is written again. manifest/ has (file_name, seq) for each version: a file's rows live if
they carry that seq; of a key's nodes the newest segment's counts, which may say that it's gone.
Edges are kept between keys and get their nodes' names when read, so a node's new spelling
touches no edge. When FAN segments of a level have gathered they become one of the next level,
so a row is written again as often as the logarithm of the batches.

A pointer names the manifest and the segments. It appears by a rename to a name of its own, so
a crash at any step leaves the state before it active, and a batch that is repeated after a
crash, or after the stream's checkpoint was lost, is known by its inbox file and skipped once applied.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import norm
from skein.operators import graph as G
from skein.operators.chunking import sliding_window
from skein.operators.extraction import ENTITY, RELATION

CHUNK = f"file_name string, chunk_id string, doc_id string, chunk_index int, text string, entities array<{ENTITY}>, relationships array<{RELATION}>, _parse_error string, seq long"
UPLOAD = "file_name string, text string, removed boolean"
KEPT_VERSIONS, HISTORY = 2, 50
#: Segments of a level that become one of the next, and folders that keys are dealt to.
FAN, BUCKETS = 8, 32
_PARTS = ("chunks", "ents", "rels", "nodes", "edges")


def no_records(chunks: DataFrame) -> DataFrame:
    """Chunks without extraction: searchable text alone."""
    return chunks.withColumn("entities", F.array().cast(f"array<{ENTITY}>")).withColumn("relationships", F.array().cast(f"array<{RELATION}>")).withColumn("_parse_error", F.lit(None).cast("string"))


class LiveIndex:
    """extract(chunks) adds entities, relationships and _parse_error; a chunk with an error stays searchable and adds nothing to the graph."""

    def __init__(self, spark: SparkSession, root: str, extract: Callable[[DataFrame], DataFrame] = no_records, size: int = 500):
        self.spark, self.root, self.size, self.extract = spark, root.rstrip("/"), size, extract
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("inbox", "pointers", "taken", "manifest", "segments"):
            self.fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _put(self, folder: str, name: str, state: dict) -> None:
        """A JSON file that appears whole or not at all."""
        tmp = self._path(f".new-{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs.rename(tmp, self._path(f"{folder}/{name}")):
            self.fs.delete(tmp, False)
            raise FileExistsError(f"{folder}/{name}")

    def _pointers(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path("pointers")))

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/pointers/{name}").first()[0])

    def _pointer(self) -> dict:
        names = self._pointers()
        return self._load(names[-1]) if names else {"epoch": 0, "version": 0, "manifest": None, "segments": [], "inbox": [], "history": []}

    def _publish(self, state: dict) -> None:
        """A pointer of a number of its own; what no kept pointer names is deleted."""
        self._put("pointers", f"{state['epoch']:012d}.json", state)
        names = self._pointers()
        for old in names[:-KEPT_VERSIONS]:
            self.fs.delete(self._path(f"pointers/{old}"), False)
        kept = [self._load(n) for n in names[-KEPT_VERSIONS:]]
        used = {"manifest": {k["manifest"] for k in kept}, "segments": {x["name"] for k in kept for x in k["segments"]}}
        for folder, own in used.items():
            for f in self.fs.listStatus(self._path(folder)):
                if f.getPath().getName() not in own:
                    self.fs.delete(f.getPath(), True)

    def _take(self, names: list[str]) -> None:
        for n in names:
            self.fs.create(self._path(f"taken/{n}"), True).close()

    def enqueue(self, file_name: str, text: str) -> None:
        """Put an upload in the inbox; one of a name that is indexed replaces it."""
        self._put("inbox", f"{time.time_ns():020d}-{uuid.uuid4().hex}.json", {"file_name": file_name, "text": text, "removed": False})

    def remove(self, file_name: str) -> None:
        """Put a removal in the inbox."""
        self._put("inbox", f"{time.time_ns():020d}-{uuid.uuid4().hex}.json", {"file_name": file_name, "text": None, "removed": True})

    def version(self) -> int:
        return self._pointer()["version"]

    def _rows(self, part: str, state: dict, more: str | None = None) -> DataFrame:
        """The rows of a part in all segments, or of one segment beside these."""
        names = [x["name"] for x in state["segments"]] + ([more] if more else [])
        schema = SCHEMAS[part]
        out = self.spark.createDataFrame([], schema) if not names else None
        for n in names:  # FAN of a level at most, with folders of buckets in each
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/segments/{n}/{part}")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _manifest(self, state: dict) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{state['manifest']}") if state["manifest"] else self.spark.createDataFrame([], MANIFEST)

    def records(self) -> DataFrame:
        """Chunks of the active version."""
        state = self._pointer()
        return _live(self._rows("chunks", state), self._manifest(state))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the active version."""
        state = self._pointer()
        nodes = _newest(self._rows("nodes", state), ["key"]).where("not gone").select("row.*")
        edges = _newest(self._rows("edges", state), ["skey", "tkey"]).where("not gone").select("row.*")
        return nodes, named(edges, nodes)

    def build(self, ents: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges between keys) of mentions; the first is that of the earliest upload, file and chunk."""
        return G.build_nodes(ents), G.build_edges(rels.withColumn("src", F.col("skey")).withColumn("dst", F.col("tkey")))

    def history(self) -> list[dict]:
        """The last batches, newest first: batch, version, files and their states."""
        return self._pointer()["history"]

    def status(self, file_name: str) -> str:
        """indexed, indexed_with_errors, queued (in no published batch yet), removed or unknown."""
        own = self.records().where(F.col("file_name") == file_name).agg(F.count(F.lit(1)).alias("n"), F.count("_parse_error").alias("bad")).first()
        seen = {f: s for h in reversed(self.history()) for f, s in h["files"].items()}
        if own["n"]:
            return "indexed_with_errors" if own["bad"] else "indexed"
        if file_name in seen:
            return seen[file_name]
        if len(self.fs.listStatus(self._path("inbox"))):
            sent = self.spark.read.schema(UPLOAD).json(f"{self.root}/inbox").select("*", F.col("_metadata.file_name").alias("sent"))
            mine = sent.where((F.col("file_name") == file_name) & ~F.coalesce("removed", F.lit(False))).select("sent").collect()  # the uploads of one file
            if any(not self.fs.exists(self._path(f"taken/{r['sent']}")) for r in mine):
                return "queued"
        return "unknown"

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of uploads and tombstones: write its files' rows and the nodes and edges that they touch as a segment, move the pointer, prune. Inbox files that were applied before are skipped; a batch that changes nothing publishes nothing."""
        state = self._pointer()
        self._take(state["inbox"])  # what a crash behind the pointer left out
        if "inbox" not in batch.columns:
            batch = batch.withColumn("inbox", F.lit(f"batch-{batch_id}"))
        sent = sorted(r["inbox"] for r in batch.select("inbox").distinct().collect())  # a few files make a batch
        new = [n for n in sent if not self.fs.exists(self._path(f"taken/{n}"))]
        w = Window.partitionBy("file_name").orderBy(F.desc("inbox"), F.desc("_place"))
        last = batch.where(F.col("inbox").isin(new) if new else F.lit(False)).withColumn("_place", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("file_name", "text", "removed").persist()
        try:
            manifest = self._manifest(state)
            gone = last.where("removed").join(manifest, "file_name", "left_semi")
            uploads = last.where("not removed")
            files = {r["file_name"]: "removed" if r["removed"] else "indexed" for r in uploads.unionByName(gone).select("file_name", "removed").collect()}
            if files:
                v = state["version"] + 1
                name = f"s{state['epoch'] + 1:012d}"
                try:
                    self._segment(state, name, v, uploads, last.select("file_name"))
                except Exception:
                    self.fs.delete(self._path(f"segments/{name}"), True)
                    raise
                state = {"epoch": state["epoch"] + 1, "version": v, "manifest": name, "segments": [*state["segments"], {"name": name, "level": 0}], "inbox": new, "history": [{"batch": batch_id, "version": v, "files": files}, *state["history"]][:HISTORY]}
                self._publish(state)
            self._take(new)
            self.compact()
        finally:
            last.unpersist()

    def _segment(self, state: dict, name: str, v: int, uploads: DataFrame, touched: DataFrame) -> None:
        """Write a segment and its manifest: the uploads' rows, and the nodes and edges of the keys that they or the rows of touched files have."""
        at = f"{self.root}/segments/{name}"
        chunks = sliding_window(uploads.select(F.col("file_name").alias("doc_id"), "text"), self.size)
        fresh = self.extract(chunks).select(F.col("doc_id").alias("file_name"), "chunk_id", "doc_id", "chunk_index", "text", "entities", "relationships", "_parse_error", F.lit(v).cast("long").alias("seq"))
        fresh.write.mode("overwrite").parquet(f"{at}/chunks")
        old = self._manifest(state)
        files = self.spark.read.schema(MANIFEST).parquet(f"{at}/chunks").select("file_name", "seq").distinct()
        old.join(touched, "file_name", "left_anti").unionByName(files).write.mode("overwrite").parquet(f"{self.root}/manifest/{name}")
        before = _live(self._rows("chunks", state), old.join(touched, "file_name", "left_semi"))
        written = self.spark.read.schema(SCHEMAS["chunks"]).parquet(f"{at}/chunks")
        (ents, rels), (old_ents, old_rels) = mentioned(written), mentioned(before)
        for part, rows in (("ents", ents), ("rels", rels)):
            rows.repartition("bucket").sortWithinPartitions(*KEYS[part]).write.partitionBy("bucket").mode("overwrite").parquet(f"{at}/{part}")
        live = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{name}")
        found, again = {}, {}
        for part, both in (("ents", ents.select("key", "bucket").unionByName(old_ents.select("key", "bucket"))), ("rels", rels.select("skey", "tkey", "bucket").unionByName(old_rels.select("skey", "tkey", "bucket")))):
            both.distinct().write.mode("overwrite").parquet(f"{at}/keys-{part}")
            found[part] = self.spark.read.schema(both.schema).parquet(f"{at}/keys-{part}")
            buckets = [r[0] for r in found[part].select("bucket").distinct().collect()]  # BUCKETS numbers at most
            rows = self._rows(part, state, name).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
            again[part] = _live(rows.join(found[part].select(*KEYS[part]), KEYS[part], "left_semi"), live)
        nodes, edges = self.build(again["ents"], again["rels"])
        for part, rows, keys, own in (("nodes", nodes, found["ents"], ["key"]), ("edges", edges.withColumn("skey", F.col("src")).withColumn("tkey", F.col("dst")), found["rels"], ["skey", "tkey"])):
            columns = [c for c in rows.columns if c not in ("skey", "tkey")]
            made = keys.select(*own).join(rows.select(*own, F.struct(*columns).alias("row")), own, "left")
            made.select(*own, F.lit(v).cast("long").alias("seq"), F.col("row").isNull().alias("gone"), "row").write.mode("overwrite").parquet(f"{at}/{part}")

    def compact(self) -> None:
        """While the last FAN segments are of one level, make them one of the next: live rows and the newest of each key."""
        while True:
            state = self._pointer()
            tail = state["segments"][-FAN:]
            if len(tail) < FAN or len({x["level"] for x in tail}) > 1:
                return
            name, some, live = f"m{state['epoch'] + 1:012d}", {"segments": tail}, self._manifest(state)
            whole = len(tail) == len(state["segments"])
            for part in _PARTS:
                rows = self._rows(part, some)
                if part in KEYS:
                    _live(rows, live).repartition("bucket").sortWithinPartitions(*KEYS[part]).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.root}/segments/{name}/{part}")
                elif part == "chunks":
                    _live(rows, live).write.mode("overwrite").parquet(f"{self.root}/segments/{name}/{part}")
                else:
                    kept = _newest(rows, ["key"] if part == "nodes" else ["skey", "tkey"])
                    (kept.where("not gone") if whole else kept).write.mode("overwrite").parquet(f"{self.root}/segments/{name}/{part}")
            self._publish(state | {"epoch": state["epoch"] + 1, "segments": [*state["segments"][:-FAN], {"name": name, "level": tail[0]["level"] + 1}]})

    def run(self, inbox: str | None = None) -> None:
        """Take in all files of JSON rows (file_name, text, removed) that are new in the inbox, oldest first. After a crash the stream's checkpoint gives the unfinished batch again."""
        stream = self.spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).json(inbox or f"{self.root}/inbox")
        stream = stream.select("file_name", "text", F.coalesce("removed", F.lit(False)).alias("removed"), F.col("_metadata.file_name").alias("inbox"))
        q = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/_checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


MANIFEST = "file_name string, seq long"
_MENTION = "file_name string, seq long, record_no struct<seq: long, file_name: string, chunk_index: int>, pos int, chunk_id string, doc_id string"
_TEXT = "struct<text: string, chunk_id: string, doc_id: string>"
_ORD = "struct<record_no: struct<seq: long, file_name: string, chunk_index: int>, pos: int>"
SCHEMAS = {
    "chunks": CHUNK,
    "ents": f"key string, {_MENTION}, name string, type string, description string, source_sentence string, stub boolean, bucket int",
    "rels": f"skey string, tkey string, {_MENTION}, source string, target string, type string, description string, source_sentence string, bucket int",
    "nodes": f"key string, seq long, gone boolean, row struct<name: string, key: string, type: string, mentions: long, descriptions: array<{_TEXT}>, source_sentences: array<{_TEXT}>, description: string, source_docs: array<string>, stub: boolean, ord: {_ORD}>",
    "edges": f"skey string, tkey string, seq long, gone boolean, row struct<src: string, dst: string, mentions: long, types: array<string>, description: string, source_sentences: array<struct<text: string, chunk_id: string, doc_id: string, type: string>>, source_doc: string, ord: {_ORD}>",
}
#: What mentions are dealt and sorted by.
KEYS = {"ents": ["key"], "rels": ["skey", "tkey"]}


def _live(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows that their file's entry in the manifest names."""
    return rows.join(manifest.select("file_name", "seq"), ["file_name", "seq"], "left_semi")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's greatest seq: narrow columns decide, so no two versions of a node's lists meet."""
    return rows.join(rows.groupBy(*keys).agg(F.max("seq").alias("seq")), [*keys, "seq"], "left_semi")


def mentioned(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions with key, relationships with skey and tkey) of chunks without an error, each with its file, seq and bucket."""
    good = chunks.where("_parse_error is null").select("file_name", "seq", F.struct("seq", "file_name", "chunk_index").alias("record_no"), "chunk_id", "doc_id", "entities", "relationships")
    base = ("file_name", "seq", "record_no", "pos", "chunk_id", "doc_id")
    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(BUCKETS)).cast("int").alias("bucket")
    ents = good.select(*base[:3], "chunk_id", "doc_id", F.posexplode("entities").alias("pos", "x")).select(norm(F.col("x.name")).alias("key"), *base, "x.name", "x.type", "x.description", "x.source_sentence", "x.stub").where("key <> ''")
    rels = good.select(*base[:3], "chunk_id", "doc_id", F.posexplode("relationships").alias("pos", "x")).select(norm(F.col("x.source")).alias("skey"), norm(F.col("x.target")).alias("tkey"), *base, "x.source", "x.target", "x.type", "x.description", "x.source_sentence")
    return ents.select("*", bucket("key")), rels.select("*", bucket("skey"))


def named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between keys with their nodes' names; an edge whose end is no node dangles and drops out."""
    names = nodes.select("key", "name")
    out = edges.join(names.toDF("src", "_s"), "src").join(names.toDF("dst", "_d"), "dst")
    return out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def cache_misses(paragraphs: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Paragraphs whose content the extraction cache lacks under this version, each content once."""
    known = cache.where((F.col("cache_version") == version) & (F.col("status") != "transient_error")).select("content_sha256")
    w = Window.partitionBy("content_sha256").orderBy("chunk_id")
    new = paragraphs.withColumn("content_sha256", F.sha2("text", 256)).join(known, "content_sha256", "left_anti")
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Results (key, payload) of the primary provider, else of the fallback, with the provider that gave them."""
    j = primary.select("key", F.col("payload").alias("a")).join(fallback.select("key", F.col("payload").alias("b")), "key", "full_outer")
    return j.select("key", F.coalesce("a", "b").alias("payload"), F.when(F.col("a").isNotNull(), "primary").otherwise("fallback").alias("provider"))


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def seeded(extractions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extraction records with their chunks' texts."""
    return extractions.drop("text").join(chunks.select("chunk_id", "text"), "chunk_id")
