"""Queries of entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import resolution as E
from skein.queries import query
from skein.queries.graph import GRAPH, graph, nodes_alone, of_people, people_graph
from skein.queries.text import KG, NORM
from skein.sources.tables import mentions

_STRIP = rf"trim(regexp_replace(regexp_replace({NORM.format('name')}, '[^\pL\pN_\s]', '', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ')"
_RALIAS = f"CASE WHEN {_STRIP} LIKE '%es' AND length({_STRIP}) > 2 THEN left({_STRIP}, -2) WHEN {_STRIP} LIKE '%s' AND length({_STRIP}) > 1 THEN left({_STRIP}, -1) ELSE {_STRIP} END"
#: Every third supplier by another name.
_REG = "reg AS (SELECT lower(s_name) AS k, 'NATION_' || s_nationkey AS canonical FROM supplier WHERE s_suppkey % 3 = 0)"
_ND = rf"nd AS (SELECT name, type, docs, {NORM.format('name')} AS nrm, {_RALIAS} AS als, lower(coalesce(reg.canonical, name)) AS rg FROM nodes LEFT JOIN reg ON reg.k = {NORM.format('name')})"
_PAIRS = f"""WITH {GRAPH}, {_REG}, {_ND}, p AS (
SELECT x.name AS node_a, y.name AS node_b, 0 AS o, 'normalized' AS signal FROM nd x JOIN nd y ON x.nrm = y.nrm AND x.name < y.name UNION ALL SELECT x.name, y.name, 0, 'registry' FROM nd x JOIN nd y ON x.rg = y.rg AND x.name < y.name
UNION ALL SELECT x.name, y.name, 1, 'alias' FROM nd x JOIN nd y ON x.als = y.als AND x.name < y.name), b AS (SELECT node_a, node_b, min(o) AS o, min(signal) FILTER (o = 0) AS s0 FROM p GROUP BY 1, 2),
cn AS (SELECT node_a, node_b, coalesce(s0, 'alias') AS signal, CASE WHEN o = 0 THEN 'AUTOMATIC' ELSE 'REVIEW' END AS classification FROM b JOIN nd x ON x.name = node_a JOIN nd y ON y.name = node_b WHERE x.type = y.type OR x.type = 'OTHER' OR y.type = 'OTHER')"""


def _registry(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 = 0")
    return s.select(F.col("s_name").alias("alias"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("canonical"))


@query("e1_normalize", rf"WITH {KG} SELECT DISTINCT name, {NORM.format('name')} AS key FROM ents")
def e1(spark, sf_dir):
    return mentions(spark, sf_dir).select("name", T.normalize(F.col("name")).alias("key")).distinct()


@query("e2_resolution_alias", f"WITH {KG} SELECT DISTINCT name, {_RALIAS} AS key FROM ents")
def e2(spark, sf_dir):
    return mentions(spark, sf_dir).select("name", T.resolution_alias(F.col("name")).alias("key")).distinct()


#: All listed terms in some spelling, and labels beside them.
_TERMS = ("Apple", " java", "PYTHON", "mercury", "Rust ", "swift", "Go", "C", "net", "Spring", "node", "edge", "Graph", "tree", "query", "table", "Index", "Graphs", "Javas", "System", "token", "graph store", "model", "")


@query("e3_ambiguous", f"SELECT page_id, label, lower(trim(label, ' ')) IN ('apple', 'java', 'python', 'mercury', 'rust', 'swift', 'go', 'c', 'net', 'spring', 'node', 'edge', 'graph', 'tree', 'query', 'table', 'index') AS ambiguous FROM (SELECT page_id, unnest([{', '.join(f"'{t}'" for t in _TERMS)}, url]) AS label FROM pages)")
def e3(spark, sf_dir):
    labels = F.array(*(F.lit(t) for t in _TERMS), F.col("url"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(labels).alias("label"))
    return pages.select("page_id", "label", E.is_ambiguous(F.col("label")).alias("ambiguous"))


_KINDS = ("TECH", "technology", "ORG", "Organization", "PERSON", "loc", "LOCATION", "concept", " System ", "TASK", "Subject", "OTHER", "EVENT", "TOOL", "Software", "", "PRODUCT")


@query("e4_canonical_types", rf"""SELECT s_suppkey, kind, CASE WHEN coalesce(kind, '') = '' THEN 'OTHER' ELSE CASE upper(trim(kind, ' ')) WHEN 'TECH' THEN 'TECHNOLOGY' WHEN 'ORG' THEN 'ORGANIZATION' WHEN 'LOC' THEN 'LOCATION' WHEN 'SYSTEM' THEN 'TECHNOLOGY' WHEN 'TASK' THEN 'CONCEPT' WHEN 'SUBJECT' THEN 'CONCEPT' ELSE upper(trim(kind, ' ')) END END AS canonical,
substr(sha256(lower(s_name) || '|' || canonical), 1, 24) AS id FROM (SELECT s_suppkey, s_name, unnest([{', '.join(f"'{t}'" for t in _KINDS)}, NULL]) AS kind FROM supplier)""")
def e4t(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", F.explode(F.array(*(F.lit(t) for t in _KINDS), F.lit(None))).alias("kind"))
    return s.select("s_suppkey", "kind", E.canonical_type(F.col("kind")).alias("canonical"), E.entity_id(F.col("s_name"), F.col("kind")).alias("id"))


@query("e4_entity_ids", rf"WITH {GRAPH} SELECT name, type, substr(sha256({NORM.format('name')} || '|' || type), 1, 24) AS id FROM nodes")
def e4(spark, sf_dir):
    return nodes_alone(spark, sf_dir).select("name", "type", E.entity_id(F.col("name"), F.col("type")).alias("id"))


@query("e5_registry", rf"WITH {GRAPH}, {_REG} SELECT name, coalesce(canonical, name) AS canonical FROM nodes LEFT JOIN reg ON k = {NORM.format('name')}")
def e5(spark, sf_dir):
    return E.resolve_or_keep(nodes_alone(spark, sf_dir).select("name"), _registry(spark, sf_dir)).select("name", "canonical")


@query("e6_candidate_pairs", _PAIRS + " SELECT * FROM cn")
def e6(spark, sf_dir):
    return E.candidates(nodes_alone(spark, sf_dir), _registry(spark, sf_dir)).select("node_a", "node_b", "signal", "classification")


@query("e7_similar_pairs", "SELECT a.vec_id::VARCHAR AS node_a, b.vec_id::VARCHAR AS node_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id::VARCHAR < b.vec_id::VARCHAR WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.92")
def e7(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vec"))
    return E.similar_pairs(v, 0.92).withColumn("cosine", F.round("cosine", 6))


_HEADS = "h AS (SELECT vec_id::VARCHAR AS name, embedding[1:6]::DOUBLE[] AS v FROM embeddings)"


@query("e7_similar_heads", f"WITH {_HEADS} SELECT a.name AS node_a, b.name AS node_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM h a JOIN h b ON a.name < b.name WHERE list_cosine_similarity(a.v, b.v) >= 0.92")
def e7h(spark, sf_dir):
    """The vectors' first six components, of which many are near."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("name"), F.slice("embedding", 1, 6).cast("array<double>").alias("vec"))
    return E.similar_pairs(v, 0.92).withColumn("cosine", F.round("cosine", 6))


@query("e8_survivors", _PAIRS + ", dgr AS (SELECT name, coalesce(n, 0) AS deg FROM nodes LEFT JOIN (SELECT x, count(*) AS n FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY x) ON x = name) SELECT node_a, node_b, CASE WHEN a.deg > b.deg OR (a.deg = b.deg AND node_a < node_b) THEN node_a ELSE node_b END AS survivor FROM cn JOIN dgr a ON a.name = node_a JOIN dgr b ON b.name = node_b")
def e8(spark, sf_dir):
    nodes, _, edges = graph(spark, sf_dir)
    return E.survivors(E.candidates(nodes, _registry(spark, sf_dir)), G.degree(nodes, edges))


@query("e9_safe_merge")
def e9(spark, sf_dir):
    nodes, _, edges = graph(spark, sf_dir, lists=True)
    n, _, _ = E.resolve(G.saved(nodes), G.saved(edges), _registry(spark, sf_dir), "exact")
    return n.select("name", "type", F.array_join("aliases", ",").alias("aliases"), F.size("descriptions").alias("descriptions"))


@query("e11_merge_log")
def e11(spark, sf_dir):
    nodes, _, edges = graph(spark, sf_dir)
    log = E.resolution_log(nodes, edges.select("src", "dst"), _registry(spark, sf_dir), "semantic")
    return E.numbered_steps(log).select(F.col("step").cast("int").alias("step"), "survivor", "loser")


_CLASSES = f"""WITH {GRAPH}, {_REG}, {_ND}, q AS (SELECT name, 'normalized' AS signal, nrm AS key FROM nd UNION ALL SELECT name, 'registry', rg FROM nd UNION ALL SELECT name, 'alias', als FROM nd)
SELECT signal, key, min(name) OVER (PARTITION BY signal, key) AS least, name FROM q WHERE key <> '' QUALIFY count(*) OVER (PARTITION BY signal, key) > 1"""


@query("e6_candidate_classes", _CLASSES)
def e6c(spark, sf_dir):
    """The classes behind the pairs, in rows that grow with the nodes."""
    return E.candidate_classes(nodes_alone(spark, sf_dir), _registry(spark, sf_dir))


@query("e13_cross_document_pairs", _PAIRS + " SELECT node_a, node_b FROM cn JOIN nodes x ON x.name = node_a JOIN nodes y ON y.name = node_b WHERE NOT list_has_any(x.docs, y.docs)")
def e13(spark, sf_dir):
    return E.candidates(nodes_alone(spark, sf_dir), _registry(spark, sf_dir), cross_doc_only=True).select("node_a", "node_b")


@query("e13_people_cross_document_pairs", of_people(_PAIRS) + " SELECT node_a, node_b, signal, classification FROM cn JOIN nodes x ON x.name = node_a JOIN nodes y ON y.name = node_b WHERE NOT list_has_any(x.docs, y.docs)")
def e13p(spark, sf_dir):
    """Nations of the people's documents beside their plurals in the one on geography."""
    return E.candidates(people_graph(spark, sf_dir)[0], _registry(spark, sf_dir), cross_doc_only=True).select("node_a", "node_b", "signal", "classification")


@query("e13_broad_pairs", _PAIRS.replace("WHERE x.type = y.type OR x.type = 'OTHER' OR y.type = 'OTHER')", "WHERE x.type = y.type OR x.type = 'OTHER' OR y.type = 'OTHER' OR (x.type IN ('TECHNOLOGY', 'CONCEPT', 'SYSTEM') AND y.type IN ('TECHNOLOGY', 'CONCEPT', 'SYSTEM')) OR (x.type IN ('ORGANIZATION', 'PERSON') AND y.type IN ('ORGANIZATION', 'PERSON')))") + " SELECT * FROM cn")
def e13b(spark, sf_dir):
    """The diagnosis's own rule of types."""
    return E.candidates(nodes_alone(spark, sf_dir), _registry(spark, sf_dir), one_entity=E.broadly_compatible).select("node_a", "node_b", "signal", "classification")


@query("e14_nodes_per_document", f"WITH {GRAPH} SELECT doc_id, count(*) AS nodes FROM (SELECT unnest(docs) AS doc_id FROM nodes) GROUP BY doc_id")
def e14(spark, sf_dir):
    return E.nodes_per_document(nodes_alone(spark, sf_dir))
