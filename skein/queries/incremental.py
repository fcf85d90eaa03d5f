"""Queries of the live index's operators, and of metrics over pairs of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import metrics as M
from skein.operators import serialize as Z
from skein.queries import query
from skein.queries.evaluation import _facts
from skein.sources.tables import table
from skein.streaming import live_index as L


@query("l7_cache_misses", "WITH known AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE doc_id % 2 = 0) SELECT sha256(text) AS content_sha256, min(doc_id) AS chunk_id FROM documents WHERE sha256(text) NOT IN (SELECT k FROM known) GROUP BY 1")
def l7(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    cache = d.where("chunk_id % 2 = 0").select(F.sha2("text", 256).alias("content_sha256"), F.lit("v1").alias("cache_version"), F.lit("ok").alias("status"))
    return L.cache_misses(d, cache, "v1").select("content_sha256", "chunk_id")


@query("l8_provider_fallback", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE p_brand END AS payload, CASE WHEN p_partkey % 3 <> 0 THEN 'primary' ELSE 'fallback' END AS provider FROM part")
def l8(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return L.with_fallback(p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("payload")), p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("payload")))


@query("l9_unprocessed", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def l9(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.unprocessed(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("l6_seeded_records", "SELECT DISTINCT l_orderkey::VARCHAR AS chunk_id, o_orderpriority AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def l6(spark, sf_dir):
    ex = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("chunk_id")).distinct()
    return L.seeded(ex, table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_orderpriority").alias("text")))


@query("m13_joint", """WITH p AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 20 AS f FROM lineitem WHERE l_returnflag <> 'A'), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 20 AS f FROM lineitem WHERE l_linestatus = 'F'),
j AS (SELECT q, count(*) FILTER (p.f IS NOT NULL AND g.f IS NOT NULL) AS tp, count(p.f) AS np, count(g.f) AS ng FROM p FULL JOIN g USING (q, f) GROUP BY q), s AS (SELECT q, (tp = np AND tp = ng)::INT AS em, round(CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END, 6) AS pr, round(CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 0 END, 6) AS rc FROM j)
SELECT q, em * em AS em, round(pr * pr, 6) AS precision, round(rc * rc, 6) AS recall, round(CASE WHEN pr * pr + rc * rc > 0 THEN 2 * (pr * pr) * (rc * rc) / (pr * pr + rc * rc) ELSE 0 END, 6) AS f1 FROM s""")
def m13(spark, sf_dir):
    s = M.set_scores(*_facts(spark, sf_dir), ["f"], "q")
    return M.joint(s, s, "q")


@query("m20_difference_classes", "WITH m AS (SELECT p_partkey % 50 AS g, p_name AS name FROM part WHERE p_partkey % 2 = 0), x AS (SELECT p_partkey % 50 AS g, lower(p_name) AS o FROM part WHERE p_partkey % 100 < 50) SELECT g, name, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.g = m.g AND (contains(o, lower(name)) OR contains(lower(name), o))) THEN 'renamed' ELSE 'missing' END AS kind FROM m")
def m20(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("g"), F.col("p_name").alias("name"), "p_partkey")
    return M.classify_differences(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 100 < 50"), "g", "name")


@query("m21_grounding", "SELECT doc_id, contains(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' '), 'of the') AS grounded FROM documents")
def m21(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.grounded(F.lit("of  the"), F.col("text")).alias("grounded"))


@query("m28_failures", "SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS retrieval, count(*) FILTER (user_id % 3 = 1) AS generation FROM events GROUP BY 1")
def m28(spark, sf_dir):
    k = F.col("user_id") % 3
    e = table(spark, sf_dir, "events").select("event_type", F.array(F.when(k == 0, "retrieval: late").when(k == 1, "generation: cut").otherwise("none")).alias("errors"))
    return M.failures(e, "event_type", "errors", ("retrieval", "generation"))


@query("m31_top_difference", "WITH r AS (SELECT l_orderkey AS qid, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC) AS b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) SELECT qid, bool_and((a <= 2) = (b <= 2)) AS same, count(*) FILTER (a <= 2 AND b > 2)::INT AS only_a, count(*) FILTER (b <= 2 AND a > 2)::INT AS only_b FROM r GROUP BY qid")
def m31(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("id")).distinct()
    a = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    b = d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("id"))))
    return M.top_difference(a, b, 2)


@query("f8_prompt", "SELECT p_partkey, '[1] ' || p_name || chr(10) || '(0) ' || p_brand || ' (1) ' || p_type || chr(10) || chr(10) || 'Question: what?' AS prompt FROM part")
def f8(spark, sf_dir):
    p = F.array(F.struct(F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("sentences")))
    return table(spark, sf_dir, "part").select("p_partkey", Z.prompt(F.lit("what?"), p).alias("prompt"))


@query("f9_fact_pairs", "SELECT p_partkey, p_name AS title, 3::INT AS sentence FROM part")
def f9(spark, sf_dir):
    flat = F.array(*(F.lit(x) for x in (1, 3, 9, 0, 1, 3, 0, 2)))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(Z.fact_pairs(flat, F.array("p_name"))).alias("x")).select("p_partkey", "x.title", "x.sentence")
