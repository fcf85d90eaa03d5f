"""Queries of scans, collections and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.queries import query
from skein.queries.graph import GRAPH, graph
from skein.sources import stores as S
from skein.sources.tables import table


@query("s4_array_of_structs", "SELECT conv_id, turn, unnest(range(0, 2)) AS n FROM conversations")
def s4(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("x", F.struct(F.array("role", "text").alias("title"), F.array(F.lit(0), F.lit(1)).alias("sent_id")))
    return S.array_of_structs(c, "x", ["title", "sent_id"]).select("conv_id", "turn", F.explode("x").alias("y")).select("conv_id", "turn", F.col("y.sent_id").cast("long").alias("n"))


@query("s6_gold_chunks", "SELECT l_orderkey AS question_id, array_to_string(list_sort(list(DISTINCT 'p' || l_partkey)), ',') AS gold FROM lineitem GROUP BY 1")
def s6(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("title"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("chunk_id")).distinct()
    return S.gold_chunks(li.select("question_id", "title"), li).select("question_id", F.array_join("gold_chunk_ids", ",").alias("gold"))


@query("s8_paragraph_dedup", "SELECT p_name || p_brand AS title, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS question_ids FROM part GROUP BY p_name, p_brand")
def s8(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name", "p_brand", F.col("p_type").alias("question_id"))
    d = S.deduplicated_paragraphs(p.select(F.col("p_name").alias("title"), F.col("p_brand").alias("text"), "question_id"))
    return d.select(F.concat("title", "text").alias("title"), F.array_join("question_ids", ",").alias("question_ids"))


@query("s9_relation_collection", f"WITH {GRAPH} SELECT 'rel_' || lpad(CAST(row_number() OVER (ORDER BY ord, src, dst) - 1 AS VARCHAR), 5, '0') AS rel_id, src AS source_entity, dst AS target_entity, types[1] AS rel_type, n::INT AS weight FROM edges")
def s9(spark, sf_dir):
    return S.relation_collection(graph(spark, sf_dir, lists=True)[2]).select("rel_id", "source_entity", "target_entity", "rel_type", "weight")


@query(
    "s7_entity_collection",
    f"""WITH {GRAPH}, fd AS (SELECT key, arg_min(description, ord) AS d FROM k GROUP BY key), dg AS (SELECT x, count(*) AS n FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY x),
b AS (SELECT regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') AS i, name, type, docs[1] AS source_doc, coalesce(n, 0)::FLOAT AS pagerank_score, d AS description, row_number() OVER (PARTITION BY i ORDER BY ord, name) AS nth FROM nodes JOIN fd USING (key) LEFT JOIN dg ON x = name)
SELECT CASE WHEN nth = 1 THEN i ELSE left(i, 55) || '_' || left(sha1(name), 8) END AS id, name, type AS entity_type, source_doc, pagerank_score::DOUBLE AS pagerank_score, description FROM b""",
)
def s7(spark, sf_dir):
    """Degrees for ranks, and a vector of one number."""
    nodes, _, edges = graph(spark, sf_dir, texts=True)
    ranks = G.degree(nodes, edges).select("name", F.col("degree").cast("double").alias("rank"))
    out = S.entity_collection(nodes, nodes.select("name", F.array(F.lit(1.0)).alias("vec")), ranks)
    return out.select("id", "name", "entity_type", "source_doc", F.col("pagerank_score").cast("double").alias("pagerank_score"), "description")


@query("s8_chunk_collection", "SELECT o_custkey::VARCHAR AS id, 'd' || o_orderstatus AS source_doc, min(o_orderkey) AS chunk_index, arg_min(o_orderpriority, o_orderkey) AS text FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) WHERE o_orderkey = first GROUP BY ALL")
def s8c(spark, sf_dir):
    """A customer's orders are chunks of one id; the first stays."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("chunk_id"), F.col("o_orderkey").alias("chunk_index"), F.concat(F.lit("d"), "o_orderstatus").alias("doc_id"), F.col("o_orderpriority").alias("text"))
    return S.chunk_collection(o, o.select("chunk_id", F.array(F.lit(1.0)).alias("vec")).distinct()).select("id", "source_doc", "chunk_index", "text")


_RELS = f"""WITH {GRAPH}, r AS (SELECT 'rel_' || lpad(CAST(row_number() OVER (ORDER BY ord, src, dst) - 1 AS VARCHAR), 5, '0') AS rel_id, src AS source_entity, dst AS target_entity, n::INT AS weight FROM edges)"""


@query("s12_relations_by_pair", _RELS + " SELECT * FROM r WHERE target_entity IN (SELECT name FROM nodes WHERE type = 'LOCATION') AND source_entity IN (SELECT name FROM nodes WHERE type = 'ORGANIZATION')")
def s12p(spark, sf_dir):
    nodes, _, edges = graph(spark, sf_dir, lists=True)
    store = S.RelationshipStore(S.relation_collection(edges).select("rel_id", "source_entity", "target_entity", "weight"), order="weight")
    kinds = nodes.select("name", "type")
    pairs = edges.select(F.col("src").alias("source_entity"), F.col("dst").alias("target_entity")).join(kinds.where("type = 'ORGANIZATION'").select(F.col("name").alias("source_entity")), "source_entity", "left_semi").join(kinds.where("type = 'LOCATION'").select(F.col("name").alias("target_entity")), "target_entity", "left_semi")
    return store.by_pair(pairs).select("rel_id", "source_entity", "target_entity", "weight")


@query("s12_relations_by_id", _RELS + " SELECT r.* FROM r JOIN orders ON rel_id = 'rel_' || lpad(CAST(o_orderkey AS VARCHAR), 5, '0')")
def s12i(spark, sf_dir):
    store = S.RelationshipStore(S.relation_collection(graph(spark, sf_dir, lists=True)[2]).select("rel_id", "source_entity", "target_entity", "weight"))
    return store.get(table(spark, sf_dir, "orders").select(F.format_string("rel_%05d", "o_orderkey").alias("rel_id"))).select("rel_id", "source_entity", "target_entity", "weight")


@query("s10_fetch_with_fallback", "SELECT o_custkey AS id, min(o_orderkey) AS ord, CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS text FROM orders WHERE o_custkey % 3 <> 2 GROUP BY o_custkey")
def s10(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return S.fetch(ids, c.where("id % 3 = 0").withColumn("text", F.lit("a")), c.where("id % 3 <> 2").withColumn("text", F.lit("b")))


@query("s_pagination", "SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 100")
def paged(spark, sf_dir):
    return S.page(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 3, 50).select("doc_id", "source")


@query("s_store_ids", "SELECT page_id, CASE WHEN length(s) <= 64 THEN s ELSE left(s, 55) || '_' || left(sha1(url), 8) END AS id FROM (SELECT page_id, url, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS s FROM pages)")
def ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.store_id(F.col("url")).alias("id"))


@query("s_stratified_sample")
def sample(spark, sf_dir):
    return S.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 40, "fr": 10})
