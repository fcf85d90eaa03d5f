"""Queries of full-text and vector search over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import postings as P
from skein.operators import search as S
from skein.queries import query
from skein.sources.tables import table

_TERMS = r"list_filter(string_split_regex(lower({}), '[^\pL\pN]+'), lambda t: t <> '')"
ITEMS = "items AS (SELECT doc_id AS id, text, embedding AS vec FROM documents LEFT JOIN embeddings ON vec_id = doc_id), questions AS (SELECT item_id AS qid, text, embedding AS vec FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"


def items(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").join(v, "id", "left")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text").join(v.withColumnRenamed("id", "qid"), "qid", "left")
    return docs, q


def hybrid_sql(p: str, i: str, q: str, k: int, pool: int, scope: str = "true") -> str:
    """CTEs p_words, p_dense, p_hits (qid, id, score, rank); scope: a predicate over qid and id."""
    return f"""{p}_t AS (SELECT id, {_TERMS.format("text")} AS t FROM {i}), {p}_n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {p}_t),
{p}_q AS (SELECT DISTINCT qid, unnest({_TERMS.format("text")}) AS term FROM {q}),
{p}_f AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM {p}_t) GROUP BY ALL), {p}_d AS (SELECT term, count(*) AS df FROM {p}_f GROUP BY term),
{p}_b AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM {p}_q JOIN {p}_f USING (term) JOIN {p}_d USING (term), {p}_n GROUP BY qid, id),
{p}_words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {p}_b WHERE {scope}) WHERE rank <= {pool}),
{p}_c AS (SELECT qid, id, round(list_cosine_similarity(x.vec::DOUBLE[], y.vec::DOUBLE[]), 6) AS score FROM {q} x, {i} y WHERE x.vec IS NOT NULL AND y.vec IS NOT NULL),
{p}_dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {p}_c WHERE {scope}) WHERE rank <= {pool}),
{p}_r AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM {p}_words UNION ALL FROM {p}_dense) GROUP BY qid, id),
{p}_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {p}_r) WHERE rank <= {k})"""


H = f"WITH {ITEMS}, {hybrid_sql('h', 'items', 'questions', 8, 10)}"


@query("v1_bm25", H + " SELECT qid, id, score, rank FROM h_words")
def bm25(spark, sf_dir):
    return S.bm25_top(*items(spark, sf_dir), 10)


def _index(spark, docs):
    return P.Postings.build(docs, G.shared_path(spark, "postings"), bits=5)


@query("v1_postings", H + " SELECT qid, id, score, rank FROM h_words")
def postings(spark, sf_dir):
    """The same from stored postings: blocks whose greatest weights can't reach the k-th best score are left out."""
    docs, q = items(spark, sf_dir)
    return _index(spark, docs).search(q, 10)[0]


@query("v1_dense", H + " SELECT qid, id, score, rank FROM h_dense")
def dense(spark, sf_dir):
    return S.cosine_top(*items(spark, sf_dir), 10)


@query("v1_hybrid", H + " SELECT qid, id, score, rank FROM h_hits")
def hybrid(spark, sf_dir):
    return S.hybrid(*items(spark, sf_dir), 8)


_V2 = ITEMS.replace("SELECT item_id AS qid, text,", "SELECT item_id AS qid, '(' || text || ')' AS text,")


@query("v2_hybrid_strict", f"WITH {_V2}, {hybrid_sql('h', 'items', 'questions', 20, 20)} SELECT qid, id, score, rank FROM h_hits")
def strict(spark, sf_dir):
    docs, q = items(spark, sf_dir)
    return S.hybrid(docs, q.withColumn("text", F.concat(F.lit("("), "text", F.lit(")"))), 20, text=T.clean_strict(F.col("text")))


@query("v3_text_cleaning", r"""SELECT page_id, replace(replace(url, '--', ' '), ' - ', ' ') AS flat, trim(regexp_replace(regexp_replace(replace(replace(url, '--', ' '), ' - ', ' '), '["''()\[\]{}:+^~*?!\\/]', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS strict FROM pages""")
def cleaning(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_flat(F.col("url")).alias("flat"), T.clean_strict(F.col("url")).alias("strict"))


@query("v4_rrf_pool", f"WITH {ITEMS}, {hybrid_sql('h', 'items', 'questions', 100, 100)} SELECT qid, id, score, rank FROM h_hits")
def pool(spark, sf_dir):
    return S.hybrid(*items(spark, sf_dir), 100)


@query("v5_weighted_rrf", H + " SELECT qid, id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT *, 1.0::DOUBLE AS w FROM h_dense UNION ALL SELECT *, 0.6::DOUBLE FROM h_words) GROUP BY qid, id")
def weighted(spark, sf_dir):
    docs, q = items(spark, sf_dir)
    return S.rrf([S.cosine_top(docs, q, 10), S.bm25_top(docs, q, 10)], [1.0, 0.6])


@query("v6_scoped_hybrid", f"WITH {ITEMS}, {hybrid_sql('h', 'items', 'questions', 8, 10, 'id % 3 = qid % 3')} SELECT qid, id, score, rank FROM h_hits")
def scoped(spark, sf_dir):
    docs, q = items(spark, sf_dir)
    keys = docs.select("id", (F.col("id") % 3).alias("k")).join(q.select("qid", (F.col("qid") % 3).alias("k")), "k").select("qid", "id")
    return S.hybrid(docs, q, 8, scope=keys)


@query("v6_scoped_postings", f"WITH {ITEMS}, {hybrid_sql('h', 'items', 'questions', 8, 10, 'id % 3 = qid % 3')} SELECT qid, id, score, rank FROM h_words")
def scoped_postings(spark, sf_dir):
    docs, q = items(spark, sf_dir)
    keys = docs.select("id", (F.col("id") % 3).alias("k")).join(q.select("qid", (F.col("qid") % 3).alias("k")), "k").select("qid", "id")
    return _index(spark, docs).scoped(q, 10, keys)


@query(
    "v7_embedding",
    "SELECT page_id, list_transform(range(0, 8), lambda i: ('0x' || substr(md5(i || ':' || t), 1, 4))::BIGINT / 65535.0::DOUBLE)::VARCHAR AS vec FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE url END AS t FROM pages)",
)
def embedding(spark, sf_dir):
    """An embedder by digests; blank texts are one space."""

    def embed(text):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", i.cast("string"), text)), 1, 4), 16, 10).cast("double") / 65535.0)

    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.col("url")).alias("text"))
    return S.embedded(pages, embed, 8).select("page_id", F.concat(F.lit("["), F.array_join(F.transform("vec", T.fraction_text), ", "), F.lit("]")).alias("vec"))


@query("q17_keywords", "SELECT item_id AS qid, text AS low, text AS high FROM benchmark")
def identity_keywords(spark, sf_dir):
    low, high = S.keywords(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(low, "|").alias("low"), F.array_join(high, "|").alias("high"))


@query("v8_valid_vectors", "SELECT vec_id, len(embedding)::INT AS dim FROM embeddings")
def validated(spark, sf_dir):
    return S.valid_vectors(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", F.size("embedding").alias("dim"))


@query("v10_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    return e.join(e.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y")), "a").select("a", "b", F.round(T.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("v11_signals", H + " SELECT qid, id, h_dense.rank AS dense_rank, h_words.rank AS words_rank, h_hits.rank AS fused_rank FROM h_dense FULL JOIN h_words USING (qid, id) FULL JOIN h_hits USING (qid, id)")
def compared(spark, sf_dir):
    docs, q = items(spark, sf_dir)
    d, w = S.cosine_top(docs, q, 10), S.bm25_top(docs, q, 10)
    return S.signals(d, w, S.top(S.rrf([d, w]), 8))


@query(
    "v12_fallback_report",
    """WITH l AS (SELECT user_id AS run, event_id AS n, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'row' END AS kind FROM events),
m AS (SELECT *, min(CASE WHEN kind = 'row' THEN n END) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS row_n FROM l),
p AS (SELECT run, row_n, max((kind = 'warning')::INT) AS hit FROM m WHERE row_n IS NOT NULL GROUP BY run, row_n) SELECT run, count(*) AS rows, sum(hit)::BIGINT AS fallbacks FROM p GROUP BY run""",
)
def fallbacks(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("n"), F.when(F.col("event_type") == "error", "warning").otherwise("row").alias("kind"))
    return S.fallback_rows(log)


@query("q14_round_robin", H + ", b AS (SELECT qid, id, min(rank * 2 + l) AS spot FROM (SELECT *, 0 AS l FROM h_dense UNION ALL SELECT *, 1 FROM h_words) GROUP BY qid, id) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY spot) AS place FROM b")
def robin(spark, sf_dir):
    docs, q = items(spark, sf_dir)
    return S.round_robin([S.cosine_top(docs, q, 10), S.bm25_top(docs, q, 10)])


@query("q1_flat_hybrid", H + " SELECT qid, id AS chunk_id, score, rank, 'chunk' AS source FROM h_hits")
def flat(spark, sf_dir):
    return S.hybrid(*items(spark, sf_dir), 8).select("qid", F.col("id").alias("chunk_id"), "score", "rank", F.lit("chunk").alias("source"))
