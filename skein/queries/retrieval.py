"""Queries of the retrieval plans over the star schema's graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import search as S
from skein.plans import query_focused as QF
from skein.plans import retrieval as R
from skein.queries import query
from skein.queries.graph import GRAPH, graph, placed, records
from skein.queries.search import hybrid_sql
from skein.queries.text import NORM
from skein.sources.tables import mentions, relations, table

K = 10
_VEC = "(SELECT embedding FROM embeddings WHERE vec_id = ('0x' || substr(md5({}), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings))"
_BASE = f"""WITH {GRAPH}, fd AS (SELECT key, arg_min(description, ord) AS d FROM k GROUP BY key),
ent AS (SELECT name AS id, d AS text, {_VEC.format("name")} AS vec FROM nodes JOIN fd USING (key)),
rel AS (SELECT src || '|' || dst AS id, types[1] || ' ' || src || ' ' || dst || ' ' || description AS text, {_VEC.format("src || '|' || dst")} AS vec FROM edges),
questions AS (SELECT p_partkey AS qid, p_name || ' ' || p_partkey % 200 AS text, embedding AS vec FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings) WHERE p_partkey % 50 = 0),
{hybrid_sql("eh", "ent", "questions", 30, 30)}, {hybrid_sql("rh", "rel", "questions", 30, 30)},
nch AS (SELECT DISTINCT n.name, k.chunk_id AS chunk FROM k JOIN nodes n USING (key)), ech AS (SELECT DISTINCT src, dst, chunk_id AS chunk FROM res WHERE src <> dst),
ew AS (SELECT qid, id AS name, score / max(score) OVER (PARTITION BY qid) AS w FROM eh_hits), rw AS (SELECT qid, split_part(id, '|', 1) AS src, split_part(id, '|', 2) AS dst, score / max(score) OVER (PARTITION BY qid) AS w FROM rh_hits),
dgr AS (SELECT x AS name, count(*) AS degree FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) GROUP BY x),
both_ends AS (SELECT src AS name, dst AS other, src, dst FROM edges UNION ALL SELECT dst, src, src, dst FROM edges)"""


def _list(name: str, body: str) -> str:
    return f", {name} AS (SELECT qid, chunk AS id, round(sum(w), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sum(w), 6) DESC, chunk) AS rank FROM ({body}) GROUP BY qid, chunk)"


def _local(part: str) -> str:
    return f"SELECT qid, chunk, w FROM ew JOIN nch USING (name) UNION ALL SELECT qid, chunk, w * {part} FROM ew JOIN both_ends b USING (name) JOIN ech ON ech.src = b.src AND ech.dst = b.dst LEFT JOIN dgr ON dgr.name = b.other"


def _global(part: str) -> str:
    return f"SELECT qid, chunk, w FROM rw JOIN ech USING (src, dst) UNION ALL SELECT qid, chunk, w * {part} FROM (SELECT qid, w, src AS name FROM rw UNION ALL SELECT qid, w, dst FROM rw) JOIN nch USING (name) LEFT JOIN dgr USING (name)"


_LISTS = _BASE + _list("lo", _local("0.5::DOUBLE")) + _list("gl", _global("0.3::DOUBLE"))
_OPT = _BASE + _list("lo", _local("0.35::DOUBLE / log2(2 + degree)")) + _list("gl", _global("0.2::DOUBLE / log2(2 + degree)"))
#: A chunk for each order: its text and title name a part, its document is the customer's nation.
_CHUNKS = f"""chunks AS (SELECT 'order-' || o_orderkey AS id, 'nation-' || c_nationkey AS doc_id, lower(o_orderpriority) || ' ' || p_name || ' ' || p_partkey % 200 AS text, p_name || ' ' || p_partkey % 200 || ' (' || p_brand || ')' AS title,
{_VEC.format("'order-' || o_orderkey")} AS vec FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part))"""
_DENSE = f", {_CHUNKS}, {hybrid_sql('dn', 'chunks', 'questions', K, K)}"


def _vectors(spark, sf_dir, df):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vec"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    at = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % F.col("n")
    return df.join(F.broadcast(n)).withColumn("vec_id", at).join(v, "vec_id").drop("vec_id", "n")  # n is one row


def _questions(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").join(F.broadcast(v.agg(F.count(F.lit(1)).alias("n")))).withColumn("vec_id", F.col("p_partkey") % F.col("n")).join(v, "vec_id")
    return G.saved(q.select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 200).cast("string")).alias("text"), "vec"))


def _setup(spark, sf_dir, held=True):
    """(nodes, edges, entities, relationships, questions, places); not held: without places."""
    if held:
        nodes, edges, places = placed(spark, sf_dir, texts=True, whole=False)
    else:
        nodes, _, edges = graph(spark, sf_dir, texts=True)
        edges, places = G.saved(edges), (None, None)
    ents = _vectors(spark, sf_dir, nodes.select(F.col("name").alias("id"), F.col("description").alias("text")))
    rels = _vectors(spark, sf_dir, edges.select(F.concat_ws("|", "src", "dst").alias("id"), F.concat_ws(" ", "type", "src", "dst", "description").alias("text")))
    return nodes, edges, ents, rels, _questions(spark, sf_dir), places


def _lists(spark, sf_dir, optimised=False, wanted=("local", "global")):
    """The 30 best of the wanted lists, and the questions."""
    nodes, edges, ents, rels, q, places = _setup(spark, sf_dir)
    lists = {"local": (R.local, ents), "global": (R.global_, rels)}
    return *(G.saved(f(S.hybrid(items, q, 30, 30), nodes, edges, optimised, places=places, k=30)) for f, items in map(lists.get, wanted)), q


def _chunks(spark, sf_dir, vectors=True):
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("parts"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n))  # n is one row
    o = o.withColumn("p_partkey", F.col("o_orderkey") % F.col("parts")).join(table(spark, sf_dir, "part"), "p_partkey")
    name = F.concat_ws(" ", "p_name", (F.col("p_partkey") % 200).cast("string"))
    rows = o.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("doc_id"),
        F.concat_ws(" ", F.lower("o_orderpriority"), name).alias("text"), F.concat(name, F.lit(" ("), "p_brand", F.lit(")")).alias("title"),
    )
    return _vectors(spark, sf_dir, rows) if vectors else rows


def _dense(spark, sf_dir, q):
    return S.cosine_top(_chunks(spark, sf_dir), q, K)


@query("q3_local", _LISTS + f" SELECT qid, id, score, rank FROM lo WHERE rank <= {K}")
def q3(spark, sf_dir):
    return R.cut(_lists(spark, sf_dir, wanted=("local",))[0], K)


@query("q4_global", _LISTS + f" SELECT qid, id, score, rank FROM gl WHERE rank <= {K}")
def q4(spark, sf_dir):
    return R.cut(_lists(spark, sf_dir, wanted=("global",))[0], K)


@query(
    "q4_global_store",
    _BASE
    + f""", sto AS (SELECT src, dst, min(chunk) AS chunk FROM ech WHERE length(src) % 2 = 0 GROUP BY src, dst), ec2 AS (FROM sto UNION ALL SELECT src, dst, chunk FROM ech ANTI JOIN sto USING (src, dst))"""
    + _list("gl", _global("0.3::DOUBLE").replace("FROM rw JOIN ech", "FROM rw JOIN ec2"))
    + f" SELECT qid, id, score, rank FROM gl WHERE rank <= {K}",
)
def q4s(spark, sf_dir):
    """Half of the relationships have records, which hold their least chunk alone; the others fall back to the graph."""
    nodes, edges, _, rels, q, places = _setup(spark, sf_dir)
    least = places[1].where(F.length("src") % 2 == 0).groupBy("src", "dst").agg(F.array(F.min("chunk_id")).alias("chunk_ids"))
    store = least.select(F.concat_ws("|", "src", "dst").alias("rel_id"), F.col("src").alias("source_entity"), F.col("dst").alias("target_entity"), "chunk_ids")
    return R.cut(R.global_(S.hybrid(rels, q, 30, 30), nodes, edges, store=store, places=places, k=K), K)


def _fused(w: float) -> str:
    return f", fu AS (SELECT qid, id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT *, 1.0::DOUBLE AS w FROM lo WHERE rank <= 30 UNION ALL SELECT *, {w}::DOUBLE FROM gl WHERE rank <= 30) GROUP BY qid, id)"


@query("q5_hybrid", _LISTS + _fused(1.0) + f" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= {K}")
def q5(spark, sf_dir):
    lo, gl, _ = _lists(spark, sf_dir)
    return R.hybrid(lo, gl, K)


@query("q5_hybrid_optimised", _OPT + _fused(0.6) + f" SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu) WHERE rank <= {K}")
def q5o(spark, sf_dir):
    lo, gl, _ = _lists(spark, sf_dir, True)
    return R.hybrid(lo, gl, K, True)


@query(
    "q6_mix",
    _LISTS
    + _DENSE
    + f""", b AS (SELECT qid, id, min(rank * 3 + l) AS spot FROM (SELECT qid, id, rank, 0 AS l FROM dn_dense UNION ALL SELECT qid, id, rank, 1 FROM lo WHERE rank <= 30 UNION ALL SELECT qid, id, rank, 2 FROM gl WHERE rank <= 30) GROUP BY qid, id),
p AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY spot) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM b) SELECT qid, id, round(1 - (rank - 1)::DOUBLE / n, 6) AS score, rank FROM p WHERE rank <= {K}""",
)
def q6(spark, sf_dir):
    lo, gl, q = _lists(spark, sf_dir)
    return R.mix(_dense(spark, sf_dir, q), lo, gl, K)


@query(
    "q7_mix_optimised",
    _OPT
    + _fused(0.6)
    + _DENSE
    + f""", hd AS (SELECT qid, id, 0 AS part, rank FROM dn_dense WHERE rank <= {K - 2}), fl AS (SELECT * FROM (SELECT qid, id, 1 AS part, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fu ANTI JOIN hd USING (qid, id)) WHERE rank <= 2),
tl AS (SELECT qid, id, 2 AS part, rank FROM dn_dense d WHERE rank > {K - 2} AND NOT EXISTS (SELECT 1 FROM fl WHERE fl.qid = d.qid AND fl.id = d.id)),
p AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY part, rank) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM (FROM hd UNION ALL FROM fl UNION ALL FROM tl)) SELECT qid, id, round(1 - (rank - 1)::DOUBLE / n, 6) AS score, rank FROM p WHERE rank <= {K}""",
)
def q7(spark, sf_dir):
    lo, gl, q = _lists(spark, sf_dir, True)
    return R.mix_optimised(_dense(spark, sf_dir, q), lo, gl, K)


_ROUNDS = 10


def _ranks_sql() -> str:
    out = ["nn AS (SELECT count(*)::DOUBLE AS n FROM nodes), og AS (SELECT src, count(*) AS deg FROM edges GROUP BY src), p0 AS MATERIALIZED (SELECT name, deg, 1.0::DOUBLE / n AS r FROM nodes LEFT JOIN og ON src = name, nn)"]
    for k in range(_ROUNDS):
        out.append(f"p{k + 1} AS MATERIALIZED (SELECT p.name, p.deg, 0.15::DOUBLE / n + 0.85::DOUBLE * d.x / n + 0.85::DOUBLE * coalesce(f.x, 0) AS r FROM p{k} p LEFT JOIN (SELECT dst, sum(r / deg) AS x FROM edges JOIN p{k} ON src = name GROUP BY dst) f ON f.dst = p.name, nn, (SELECT coalesce(sum(r), 0) AS x FROM p{k} WHERE deg IS NULL) d)")
    return ", ".join(out)


_HOP = "{1} AS MATERIALIZED (SELECT qid, name, max(score) AS score FROM (FROM {0} UNION ALL SELECT qid, b, score FROM {0} JOIN u ON a = name) GROUP BY 1, 2)"
_CAND = (
    _BASE
    + f""", {_ranks_sql()}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), s0 AS (SELECT qid, id AS name, score FROM eh_hits WHERE rank <= {R.ENTRIES}), {_HOP.format("s0", "s1")}, {_HOP.format("s1", "s2")},
sc AS (SELECT qid, name, round(0.85::DOUBLE * score / max(score) OVER (PARTITION BY qid) + (1 - 0.85::DOUBLE) * r / (SELECT max(r) FROM p{_ROUNDS}), 6) AS score FROM s2 JOIN p{_ROUNDS} USING (name)),
cand AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) AS rank FROM sc) WHERE rank <= 20)"""
)


def _entries(spark, sf_dir, held=False):
    """Entity hits, the graph, its PageRank after a fixed number of rounds, which SQL can unroll, and the questions."""
    nodes, edges, ents, _, q, places = _setup(spark, sf_dir, held)
    ranks = G.saved(G.pagerank(nodes.select("name"), edges.select("src", "dst"), rounds=_ROUNDS, tolerance=None))
    return R.cut(S.hybrid(ents, q, 30, 30), R.ENTRIES), nodes, edges, ranks, q, places


def _candidates(spark, sf_dir):
    hits, nodes, edges, ranks, _, _ = _entries(spark, sf_dir)
    return R.candidates(hits, nodes, edges, ranks), nodes


@query("q2_structural_candidates", _CAND + " SELECT qid, name, score, rank FROM cand")
def q2(spark, sf_dir):
    return _candidates(spark, sf_dir)[0]


_SCOPE = "scope AS MATERIALIZED (SELECT DISTINCT qid, chunks.id FROM cand JOIN nodes USING (name) JOIN chunks ON list_contains(docs, doc_id))"
_NAMED = "scope AS MATERIALIZED (SELECT DISTINCT qid, chunk AS id FROM cand JOIN nch USING (name))"
_VERB = "verb AS (SELECT qid, string_agg(name || ' (' || type || '): ' || d, chr(10) ORDER BY rank) AS text FROM cand JOIN nodes USING (name) JOIN fd USING (key) GROUP BY qid)"
_WITHIN = "(qid, id) IN (SELECT qid, id FROM scope)"


@query("q2_scope_documents", _CAND + f", {_CHUNKS}, {_SCOPE} FROM scope")
def q2b(spark, sf_dir):
    found, nodes = _candidates(spark, sf_dir)
    return R.candidate_scope(found, nodes, _chunks(spark, sf_dir, False))


@query("q2_structural_documents", _CAND + f", {_CHUNKS}, {_SCOPE}, {hybrid_sql('sh', 'chunks', 'questions', 6, 10, _WITHIN)} SELECT qid, id, score, rank FROM sh_hits")
def q2d(spark, sf_dir):
    hits, nodes, edges, ranks, q, places = _entries(spark, sf_dir)
    return R.structural(hits, nodes, edges, ranks, _chunks(spark, sf_dir), q)


@query("q2_structural_mentions", _CAND + f", {_CHUNKS}, {_NAMED}, {hybrid_sql('sh', 'chunks', 'questions', 6, 10, _WITHIN)} SELECT qid, id, score, rank FROM sh_hits")
def q2m(spark, sf_dir):
    hits, nodes, edges, ranks, q, places = _entries(spark, sf_dir, True)
    return R.structural(hits, nodes, edges, ranks, _chunks(spark, sf_dir), q, scope="candidates", places=places)


@query("q2_structural_verbalised", _CAND + f", {_CHUNKS}, {_NAMED}, {_VERB}, asked AS (SELECT qid, questions.text, {_VEC.format('verb.text')} AS vec FROM questions JOIN verb USING (qid)), {hybrid_sql('sh', 'chunks', 'asked', 6, 10, _WITHIN)} SELECT qid, id, score, rank FROM sh_hits")
def q2v(spark, sf_dir):
    """The embedder picks a vector of the table by a text's digest."""
    hits, nodes, edges, ranks, q, places = _entries(spark, sf_dir, True)
    return R.structural(hits, nodes, edges, ranks, _chunks(spark, sf_dir), q, scope="verbalized", embed=lambda t: _vectors(spark, sf_dir, t.select("qid", F.col("text").alias("id"))), places=places)


@query("q2_verbalised", _CAND + f", {_VERB} FROM verb")
def q2c(spark, sf_dir):
    return R.verbalise(*_candidates(spark, sf_dir))


@query("q11_node_chunks", _BASE + " SELECT name, count(*) AS chunks FROM nch GROUP BY name")
def q11(spark, sf_dir):
    ents = mentions(spark, sf_dir)
    nodes = G.saved(G.slim_nodes(ents))
    return G.node_chunk_rows(nodes, G.node_places(ents)).groupBy("name").agg(F.count(F.lit(1)).alias("chunks"))


@query("q12_edge_chunks", _BASE + " SELECT src, dst, count(*) AS chunks FROM ech GROUP BY src, dst")
def q12(spark, sf_dir):
    _, resolved, edges = graph(spark, sf_dir, given=(mentions(spark, sf_dir), relations(spark, sf_dir)))
    return G.edge_chunk_rows(edges, G.edge_places(resolved)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("chunks"))


@query("q13_materialise", _LISTS + " SELECT qid, id, score, rank, 'prio ' || o_orderpriority AS text FROM lo JOIN orders ON id = 'order-' || o_orderkey WHERE rank <= 10 AND o_orderkey % 7 <> 0")
def q13(spark, sf_dir):
    lo = _lists(spark, sf_dir, wanted=("local",))[0]
    key = F.col("o_orderkey")
    store = table(spark, sf_dir, "orders").where(key % 7 != 0).select(F.concat(F.lit("order-"), key.cast("string")).alias("id"), F.concat(F.lit("prio "), "o_orderpriority").alias("text"), key)
    return R.materialise(lo, store.where(key % 2 == 0), store.where(key % 2 == 1), 10)


_TITLES = "titles AS (SELECT p_partkey AS id, p_name || ' (' || p_brand || ')' AS title, lower(p_name) AS base FROM part), qs AS (SELECT o_orderkey AS qid, 'who sells the ' || p_name || ' of ' || p_brand AS text, p_partkey AS seed FROM orders JOIN part ON p_partkey = o_orderkey % 97 WHERE o_orderkey % 50 = 0)"


@query("q8_expansion", f"WITH {_TITLES} SELECT qid, seed AS id FROM qs UNION SELECT qid, id FROM qs JOIN titles ON contains(' ' || lower(text) || ' ', ' ' || base || ' ') UNION SELECT qid, id FROM qs JOIN titles ON base = 'blue bolt'")
def q8a(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    titles = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("title"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").withColumn("p_partkey", F.col("o_orderkey") % 97).join(part, "p_partkey")
    q = o.select(F.col("o_orderkey").alias("qid"), F.concat(F.lit("who sells the "), "p_name", F.lit(" of "), "p_brand").alias("text"), F.col("p_partkey").alias("id"))
    return R.expansion(q.select("qid", "text"), titles, q.select("qid", "id"), q.select("qid", F.lit("Blue bolt").alias("name")))


_Q8 = (
    _BASE
    + _DENSE
    + f""", ek AS (SELECT chunk_id, {NORM.format("name")} AS key FROM ents), seeds AS (SELECT qid, id FROM dn_hits WHERE rank <= 5), tl AS (SELECT id, lower(title) AS whole, lower(split_part(title, ' (', 1)) AS base FROM chunks),
sel AS MATERIALIZED (FROM seeds UNION SELECT qid, id FROM questions q JOIN tl ON contains(' ' || lower(q.text) || ' ', ' ' || base || ' ') UNION SELECT qid, tl.id FROM (SELECT DISTINCT qid, key FROM seeds JOIN ek ON chunk_id = id) JOIN tl ON key = base OR key = whole),
m AS MATERIALIZED (SELECT DISTINCT qid, key, id FROM sel JOIN ek ON chunk_id = id WHERE key <> ''), mk AS (SELECT DISTINCT qid, key FROM m),
ln AS MATERIALIZED (SELECT DISTINCT qid, s, t, id FROM (SELECT qid, {NORM.format("source")} AS s, {NORM.format("target")} AS t, id FROM sel JOIN rels ON chunk_id = id) WHERE s <> t AND (qid, s) IN (FROM mk) AND (qid, t) IN (FROM mk)),
un AS (SELECT qid, s AS a, t AS b FROM ln UNION SELECT qid, t, s FROM ln), an AS MATERIALIZED (SELECT mk.qid, key FROM mk JOIN questions USING (qid) WHERE length(key) >= 3 AND contains(' ' || lower(text) || ' ', ' ' || key || ' ')),
d1 AS (SELECT qid, key, min(d) AS d FROM (SELECT qid, key, 0 AS d FROM an UNION ALL SELECT an.qid, b, 1 FROM an JOIN un ON un.qid = an.qid AND a = key) GROUP BY 1, 2), d2 AS MATERIALIZED (SELECT qid, key, min(d) AS d FROM (FROM d1 UNION ALL SELECT d1.qid, b, d + 1 FROM d1 JOIN un ON un.qid = d1.qid AND a = key) GROUP BY 1, 2),
sp AS MATERIALIZED (SELECT qid, id, round(sum(w), 9) AS s FROM (SELECT qid, id, 1.0::DOUBLE / (1 + d) AS w FROM m JOIN d2 USING (qid, key) UNION ALL SELECT ln.qid, id, 0.5::DOUBLE / (1 + least(x.d, y.d)) FROM ln JOIN d2 x ON x.qid = ln.qid AND x.key = s JOIN d2 y ON y.qid = ln.qid AND y.key = t) GROUP BY 1, 2)"""
)


def _focused(spark, sf_dir, recorded=True):
    q = _questions(spark, sf_dir)
    chunks = G.saved(_chunks(spark, sf_dir))
    dense = G.saved(S.hybrid(chunks, q, K, K))
    if not recorded:
        return q, chunks, dense, None, None
    ents, rels = records(spark, sf_dir)
    return q, chunks, dense, ents.select("chunk_id", "name"), rels.select("chunk_id", "source", "target")


@query(
    "q8_query_focused",
    _Q8
    + f""", al AS (SELECT qid, id, d.rank AS dr, s FROM dn_hits d FULL JOIN sp USING (qid, id) FULL JOIN sel USING (qid, id)), rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN s IS NOT NULL THEN 0 WHEN dr IS NOT NULL THEN 1 ELSE 2 END, s DESC NULLS LAST, coalesce(dr, 1000000), id) AS rank FROM al WHERE dr IS NOT NULL OR qid IN (SELECT qid FROM sp))
SELECT qid, id, round(1 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY qid), 6) AS score, rank FROM rk WHERE rank <= {K}""",
)
def q8(spark, sf_dir):
    q, chunks, dense, ents, rels = _focused(spark, sf_dir)
    return QF.query_focused(q, dense, chunks.select("id", "title"), ents, rels, K)[0]


def _count(name: str, what: str, of: str) -> str:
    return f"coalesce((SELECT count(*) FROM {of} x WHERE x.qid = q.qid), 0) AS {name}" if what == "*" else f"coalesce((SELECT count(DISTINCT {what}) FROM {of} x WHERE x.qid = q.qid), 0) AS {name}"


_COUNTS = ", ".join([_count("n_selected", "*", "sel"), _count("anchors", "*", "an"), _count("graph_nodes", "*", "mk"), _count("graph_edges", "(s, t)", "ln"), _count("supported", "*", "sp")])


@query("q8_counters", _Q8 + f" SELECT qid, {_COUNTS} FROM questions q")
def q8c(spark, sf_dir):
    q, chunks, dense, ents, rels = _focused(spark, sf_dir)
    return QF.query_focused(q, dense, chunks.select("id", "title"), ents, rels, K)[1]


@query(
    "q9_on_demand",
    _BASE
    + _DENSE
    + r""", st AS (SELECT id, sha256(text) AS sha, CASE WHEN contains(text, 'bolt') THEN 'failed_model' WHEN contains(text, 'gizmo') THEN 'failed_infra' ELSE 'ok' END AS status, starts_with(text, '1') AS known, regexp_replace(text, '^\S+ ', '') AS part FROM chunks),
seeds AS (SELECT qid, id FROM dn_hits WHERE rank <= 5), tl AS (SELECT id, lower(title) AS whole, lower(split_part(title, ' (', 1)) AS base FROM chunks),
sel AS MATERIALIZED (FROM seeds UNION SELECT qid, id FROM questions q JOIN tl ON contains(' ' || lower(q.text) || ' ', ' ' || base || ' ') UNION SELECT qid, tl.id FROM (SELECT DISTINCT qid, part FROM seeds JOIN st USING (id) WHERE status = 'ok') JOIN tl ON part = base OR part = whole),
lk AS (SELECT sel.qid, sel.id, sha, status, known, row_number() OVER (PARTITION BY sha ORDER BY sel.qid, sel.id) = 1 AND NOT known AS paid FROM sel JOIN st USING (id))
SELECT qid, count(*) AS lookups, count(*) FILTER (NOT paid AND status = 'ok') AS hits_ok, count(*) FILTER (NOT paid AND status <> 'ok') AS hits_failed, count(*) FILTER (paid) AS misses, count(*) FILTER (paid AND status = 'ok') AS extracted_ok,
count(*) FILTER (paid AND status = 'failed_model') AS extracted_failed_model, count(*) FILTER (paid AND status = 'failed_infra') AS extracted_failed_infra, count(*) FILTER (status = 'ok') AS valid_records, count(*) FILTER (status <> 'ok') AS failed_or_missing FROM lk GROUP BY qid""",
)
def q9(spark, sf_dir):
    """What on-demand extraction costs each question: half of the contents are in the cache, some can't be extracted. An extraction names the part that the text names."""
    q, chunks, dense = _focused(spark, sf_dir, False)[:3]

    def extract(missing):
        status = F.when(F.col("text").contains("bolt"), "failed_model").when(F.col("text").contains("gizmo"), "failed_infra").otherwise("ok")
        part = F.regexp_replace("text", r"^\S+ ", "")
        none = F.array().cast("array<struct<source:string,target:string>>")
        return missing.select("content_sha256", status.alias("status"), F.array(F.struct(part.alias("name"))).alias("entities"), none.alias("relationships"))

    known = extract(chunks.where(F.col("text").startswith("1")).select("text", F.sha2("text", 256).alias("content_sha256")).dropDuplicates(["content_sha256"]))
    counts = QF.on_demand(q, dense, chunks.select("id", "title", "text"), known, extract, K)[1]
    return counts.drop("n_selected", "anchors", "graph_nodes", "graph_edges", "supported")


#: Contents as on-demand extraction records them: the part and the priority that a text names, and that the one is asked for at the other.
_ST = r"st AS MATERIALIZED (SELECT id, sha256(text) AS sha, CASE WHEN contains(text, 'bolt') THEN 'failed_model' WHEN contains(text, 'gizmo') THEN 'failed_infra' ELSE 'ok' END AS status, starts_with(text, '1') AS known, regexp_replace(text, '^\S+ ', '') AS part, split_part(text, ' ', 1) AS prio FROM chunks)"
_Q9 = _Q8.replace(f"ek AS (SELECT chunk_id, {NORM.format('name')} AS key FROM ents)", f"{_ST}, ek AS (SELECT id AS chunk_id, {NORM.format('name')} AS key FROM (SELECT id, unnest([part, prio]) AS name FROM st WHERE status = 'ok'))").replace("FROM sel JOIN rels ON chunk_id = id", "FROM sel JOIN (SELECT id AS chunk_id, part AS source, prio AS target FROM st WHERE status = 'ok') ON chunk_id = id")


def _demanded(spark, sf_dir):
    q, chunks, dense = _focused(spark, sf_dir, False)[:3]

    def extract(missing):
        status = F.when(F.col("text").contains("bolt"), "failed_model").when(F.col("text").contains("gizmo"), "failed_infra").otherwise("ok")
        part, prio = F.regexp_replace("text", r"^\S+ ", ""), F.split_part("text", F.lit(" "), F.lit(1))
        return missing.select("content_sha256", status.alias("status"), F.array(F.struct(part.alias("name")), F.struct(prio.alias("name"))).alias("entities"), F.array(F.struct(part.alias("source"), prio.alias("target"))).alias("relationships"))

    known = extract(chunks.where(F.col("text").startswith("1")).select("text", F.sha2("text", 256).alias("content_sha256")).dropDuplicates(["content_sha256"]))
    return QF.on_demand(q, dense, chunks.select("id", "title", "text"), known, extract, K)


@query(
    "q9_on_demand_list",
    _Q9
    + f""", al AS (SELECT qid, id, d.rank AS dr, s FROM dn_hits d FULL JOIN sp USING (qid, id) FULL JOIN sel USING (qid, id)), rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN s IS NOT NULL THEN 0 WHEN dr IS NOT NULL THEN 1 ELSE 2 END, s DESC NULLS LAST, coalesce(dr, 1000000), id) AS rank FROM al WHERE dr IS NOT NULL OR qid IN (SELECT qid FROM sp))
SELECT qid, id, round(1 - (rank - 1)::DOUBLE / count(*) OVER (PARTITION BY qid), 6) AS score, rank FROM rk WHERE rank <= {K}""",
)
def q9l(spark, sf_dir):
    """What on-demand extraction ranks, over graphs of the parts and priorities that it finds."""
    return _demanded(spark, sf_dir)[0]


@query("q9_on_demand_graph", _Q9 + f" SELECT qid, {_COUNTS} FROM questions q")
def q9g(spark, sf_dir):
    return _demanded(spark, sf_dir)[1].select("qid", "n_selected", "anchors", "graph_nodes", "graph_edges", "supported")


@query("q9_on_demand_cache", _Q9 + " SELECT sha AS content_sha256, min(status) AS status FROM st WHERE known OR id IN (SELECT id FROM sel) GROUP BY sha")
def q9c(spark, sf_dir):
    """The cache as it has grown."""
    return _demanded(spark, sf_dir)[2].select("content_sha256", "status")


@query("m26_selection_simulation")
def m26(spark, sf_dir):
    """Gold: a question's two least orders among its part's line items."""
    q, chunks, dense, ents, rels = _focused(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("qid"), F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("id")).join(q.select("qid"), "qid", "left_semi").distinct()
    gold = li.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where("n <= 2").drop("n")
    return QF.simulate(q.withColumn("type", F.when(F.col("qid") % 100 == 0, "bridge").otherwise("comparison")), gold, dense, chunks.select("id", "title"), ents, rels)
