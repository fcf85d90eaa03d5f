"""Scans and sinks: document folders, record files, collections, graph and report files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import store_id
from skein.operators.extraction import RECORD


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (file stem), text, source_path of the .txt and .md files of a folder, not of its subfolders, by path."""
    if not folder:
        raise ValueError("no folder")
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}").text(folder)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"), path.alias("source_path")).orderBy("source_path")


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction records of a JSON-lines file. Blank and malformed lines and failed records are left out; rejected() counts them."""
    raw = _raw(spark, path)
    return raw.where(F.col("_corrupt_record").isNull() & F.col("_parse_error").isNull()).drop("_corrupt_record", "_parse_error")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    return _raw(spark, path).agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"), F.count_if(F.col("_corrupt_record").isNull() & F.col("_parse_error").isNotNull()).alias("failed"))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = RECORD.replace(", _corrupt_record string", "")
    parsed = lines.select("value", F.from_json("value", kind + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.select("r.*")


def benchmark_records(spark: SparkSession, json_path: str | None, parquet_path: str | None, expected: int | None = None) -> DataFrame:
    """Question records from JSON if it is there, else from Parquet; another number of rows than expected raises."""
    df = spark.read.option("multiLine", True).json(json_path) if json_path and _exists(spark, json_path) else spark.read.parquet(parquet_path)
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} records, expected {expected}")
    return df


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of the files at a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


#: The files of a benchmark folder and what they hold.
PARAGRAPH = "chunk_id string, title string, sentences array<string>, text string"
QUESTION = "_id string, question string, answer string, type string, level string, supporting_facts array<struct<title:string,sent_id:int>>, gold_chunk_ids array<string>, context_chunk_ids array<string>"
FACT = "question_id string, title string, sent_id int, chunk_id string"


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs of a benchmark alone: no question, answer or supporting fact is read, so none can leak into what is built from them."""
    return spark.read.schema(PARAGRAPH).json(f"{folder}/corpus.jsonl")


def load_benchmark(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """corpus, questions and facts of a benchmark folder, and config and stats as rows (name, value)."""
    out = {"corpus": load_corpus(spark, folder), "questions": spark.read.schema(QUESTION).json(f"{folder}/questions.jsonl"), "facts": spark.read.schema(FACT).json(f"{folder}/supporting_facts.jsonl")}
    return out | {n: spark.read.schema("name string, value string").json(f"{folder}/{n}.jsonl") for n in ("corpus_stats", "benchmark_config")}


def write_benchmark(folder: str, questions: DataFrame, paragraphs: DataFrame, contexts: DataFrame, facts: DataFrame, config: dict[str, str]) -> None:
    """Six artefacts: questions (with sorted, distinct gold_chunk_ids and their contexts' chunks), sample_ids, corpus, supporting_facts, corpus_stats and benchmark_config, as JSON rows.

    questions: _id, question, answer, type, level; paragraphs: chunk_id, title, sentences, text;
    contexts: question_id, ord, chunk_id; facts: question_id, title, sent_id, chunk_id (null where no paragraph of the question has it).
    """
    spark = questions.sparkSession
    of = F.col("question_id").alias("_id")
    # a question has few facts and contexts
    gold = facts.groupBy(of).agg(F.array_sort(F.collect_set("chunk_id")).alias("gold_chunk_ids"), F.transform(F.array_sort(F.collect_list(F.struct("title", "sent_id"))), lambda x: F.struct(x["title"], x["sent_id"])).alias("supporting_facts"))
    near = contexts.groupBy(of).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("context_chunk_ids"))
    full = questions.join(gold, "_id", "left").join(near, "_id", "left")
    blank = {"gold_chunk_ids": "array<string>", "context_chunk_ids": "array<string>", "supporting_facts": "array<struct<title:string,sent_id:int>>"}
    full = full.select("_id", "question", "answer", "type", "level", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in blank.items()))
    seen = paragraphs.agg(F.count(F.lit(1)).alias("paragraphs"), F.count_distinct("title").alias("titles"), F.coalesce(F.sum(F.size("sentences")), F.lit(0)).alias("sentences"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
    stats = seen.join(questions.agg(F.count(F.lit(1)).alias("questions"))).join(facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("chunk_id").isNull()).alias("unmatched_facts")))  # single rows
    parts = {
        "questions": full, "sample_ids": full.select("_id", "type"), "corpus": paragraphs.select("chunk_id", "title", "sentences", "text"), "supporting_facts": facts.select("question_id", "title", "sent_id", "chunk_id"),
        "corpus_stats": stats.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in stats.columns)))),
        "benchmark_config": spark.createDataFrame(sorted(config.items()), "name string, value string"),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}.jsonl")


class RelationshipStore:
    """Relationship records (rel_id, source_entity, target_entity, ...) by id and by pair; the last record of an id counts, and ones without an id are left out."""

    def __init__(self, records: DataFrame, order: str | None = None):
        rows = records.where(F.coalesce("rel_id", F.lit("")) != "")
        if order:
            w = Window.partitionBy("rel_id").orderBy(F.desc(order))
            rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        self.rows = rows

    def get(self, ids: DataFrame) -> DataFrame:
        """The records of rows (rel_id); ids without one are left out."""
        return self.rows.join(ids.select("rel_id").distinct(), "rel_id", "left_semi")

    def by_pair(self, pairs: DataFrame) -> DataFrame:
        """The records between the ends of rows (source_entity, target_entity)."""
        return self.rows.join(pairs.select("source_entity", "target_entity").distinct(), ["source_entity", "target_entity"], "left_semi")


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Add rows to a log. A batch has a folder of its own, so one that is written again after a crash replaces itself."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The log's entries, the last of each key; an empty one if nothing has been written."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").json(path)
    w = Window.partitionBy(key).orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "batch")


def array_of_structs(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """A struct of arrays as an array of structs."""
    return df.withColumn(column, F.arrays_zip(*(F.col(f"{column}.{f}").alias(f) for f in fields)))


def deduplicated_paragraphs(rows: DataFrame) -> DataFrame:
    """One row for each title and text, with all question ids: rows (title, text, question_id)."""
    g = rows.groupBy("title", "text").agg(F.array_sort(F.collect_set("question_id")).alias("question_ids"))
    return g.select(F.concat(F.lit("hp_"), F.substring(F.sha1(F.concat_ws("\u0000", "title", "text")), 1, 16)).alias("doc_id"), "title", "text", "question_ids")


def gold_chunks(facts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """question_id, gold_chunk_ids (sorted, distinct) of facts (question_id, title) in each question's own paragraphs (question_id, title, chunk_id)."""
    return facts.join(paragraphs, ["question_id", "title"], "left").groupBy("question_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("gold_chunk_ids"))


def entity_collection(nodes: DataFrame, vectors: DataFrame, ranks: DataFrame) -> DataFrame:
    """id, name, entity_type, source_doc (the least), pagerank_score, description (the first), text_vec. Ids that collide get a digest of the name. Every node needs a vector (name, vec)."""
    n = nodes.join(vectors, "name", "left").join(ranks.select("name", "rank"), "name", "left").withColumn("id", store_id(F.col("name")))
    w = Window.partitionBy("id").orderBy("ord", "name")
    n = n.withColumn("nth", F.row_number().over(w))
    unique = F.when(F.col("nth") == 1, F.col("id")).otherwise(F.concat(F.substring("id", 1, 55), F.lit("_"), F.substring(F.sha1("name"), 1, 8)))
    vec = F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no vector for "), "name"))).otherwise(F.col("vec"))
    return n.select(unique.alias("id"), "name", F.col("type").alias("entity_type"), F.array_min("source_docs").alias("source_doc"), F.coalesce("rank", F.lit(0.0)).cast("float").alias("pagerank_score"), F.coalesce("description", F.lit("")).alias("description"), vec.alias("text_vec"))


def chunk_collection(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (the first of each id) with vectors (chunk_id, vec)."""
    w = Window.partitionBy("chunk_id").orderBy("chunk_index", "doc_id")
    first = chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.join(vectors, "chunk_id").select(F.col("chunk_id").alias("id"), "chunk_id", F.col("doc_id").alias("source_doc"), "chunk_index", "text", F.col("vec").alias("text_vec"))


#: Record numbers of a range whose relations are numbered together.
RANGE = 100_000


def relation_collection(edges: DataFrame) -> DataFrame:
    """rel_id in edge order, endpoints, rel_type (the first), all_types, weight (mentions), text, chunk_ids, doc_ids. Numbers come from ranges of the order, not from one task."""
    order = F.struct("ord", "src", "dst")
    spans = edges.select("src", "dst", order.alias("o"), F.col("ord.record_no").alias("r"), "types", "description", "source_sentences", "source_doc")
    per = spans.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    # two levels: a sum for each range of record numbers, of which one task adds up few, then sums within each
    wide = per.withColumn("span", F.floor(F.col("r") / RANGE))
    lower = wide.groupBy("span").agg(F.sum("n").alias("n")).select("span", F.coalesce(F.sum("n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    before = wide.withColumn("inner", F.coalesce(F.sum("n").over(Window.partitionBy("span").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(lower, "span").select("r", (F.col("below") + F.col("inner")).alias("base"))
    within = spans.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("o")))
    rel = within.join(before, "r").withColumn("rel_id", F.format_string("rel_%05d", F.col("base") + F.col("k") - 1))
    ids = lambda f: F.array_distinct(F.transform("source_sentences", lambda x: x[f]))
    return rel.select("rel_id", F.col("src").alias("source_entity"), F.col("dst").alias("target_entity"), F.get("types", 0).alias("rel_type"), F.array_distinct("types").alias("all_types"), F.size("types").alias("weight"), F.concat_ws(" ", F.get("types", 0), "src", "dst", "description").alias("text"), ids("chunk_id").alias("chunk_ids"), ids("doc_id").alias("doc_ids"), "source_doc")


def collections(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, ranks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The three collections of an index. embed() adds vec to rows with text: 'name (TYPE): description' of a node, 'type source target description' of an edge, a chunk's own."""
    line = F.concat("name", F.lit(" ("), "type", F.lit("): "), F.coalesce("description", F.lit("")))
    named = embed(nodes.select("name", line.alias("text"))).select("name", "vec")
    texts = embed(chunks.select("chunk_id", "chunk_index", "doc_id", "text"))
    first = Window.partitionBy("chunk_id").orderBy("chunk_index", "doc_id")
    vectors = texts.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("chunk_id", "vec")
    return {"entities": entity_collection(nodes, named, ranks), "relationships": embed(relation_collection(edges)).withColumnRenamed("vec", "text_vec"), "chunks": chunk_collection(chunks, vectors)}


def write_collections(folder: str, parts: dict[str, DataFrame]) -> None:
    """Each collection as a Parquet folder, in place of an older one; a folder that holds anything else is refused."""
    for name, df in parts.items():
        reset(df.sparkSession, f"{folder}/{name}")
        df.write.parquet(f"{folder}/{name}")


def fetch(ids: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows (id, text) of the wanted ids in their order (column ord), from the fallback where the primary lacks them; ids in neither are left out."""
    want = ids.groupBy("id").agg(F.min("ord").alias("ord"))
    out = want.join(primary.select("id", F.col("text").alias("a")), "id", "left").join(fallback.select("id", F.col("text").alias("b")), "id", "left")
    return out.withColumn("text", F.coalesce("a", "b")).where(F.col("text").isNotNull()).select("id", "ord", "text")


def resolve_path(spark: SparkSession, folders: list[str], names: list[str]) -> str:
    """The first collection that is there: names by priority in each folder by priority."""
    for folder in folders:
        for name in names:
            if _exists(spark, f"{folder}/{name}"):
                return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {names} in {folders}")


def reset(spark: SparkSession, path: str) -> None:
    """Remove a collection; a folder with anything but Parquet output in it is refused."""
    if not _exists(spark, path):
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if not (name.endswith(".parquet") or name in ("_SUCCESS", "_strategy") or name.startswith((".", "part-"))):
            raise ValueError(f"{path} holds {name}, which no collection writes")
    fs.delete(p, True)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one GraphML text; attributes that aren't scalars are JSON."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), esc(c), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), esc(F.col("name")), F.lit('">'), data("type", F.col("type")), data("source_docs", F.to_json("source_docs")), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("o"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('">'), data("types", F.to_json("types")), F.lit("</edge>")).alias("value"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="type" for="node" attr.name="type" attr.type="string"/>\n<key id="source_docs" for="node" attr.name="source_docs" attr.type="string"/>\n<key id="types" for="edge" attr.name="types" attr.type="string"/>\n<graph edgedefault="directed">'
    ends = nodes.sparkSession.createDataFrame([(0, head), (3, "</graph>\n</graphml>")], "o int, value string")
    ends.unionByName(n).unionByName(e).orderBy("o", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A small report as one CSV file with a fixed order of columns."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stratified_sample(df: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: int = 0) -> DataFrame:
    """The rows of each stratum with the least hashes of key and seed; a larger size holds every smaller one."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key)
    n = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.coalesce(F.try_element_at(n, F.col(stratum)), F.lit(0))).drop("_n")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of rows, pages from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
