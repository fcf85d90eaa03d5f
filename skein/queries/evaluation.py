"""Queries of evaluation metrics. Gold: items of an embedding label; retrieved: each vector's nearest by cosine."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import metrics as M
from skein.operators import search as S
from skein.queries import query
from skein.queries.text import KG
from skein.sources.tables import relations, table

_RUN = """WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT a.id AS qid, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.id % 25 = 0),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 10), qs AS (SELECT id AS qid, label FROM e WHERE id % 25 = 0),
gold AS (SELECT qid, e.id FROM qs JOIN e ON e.label = qs.label WHERE e.id % 40 = 0 AND qid % 50 = 0)"""


def _run(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    q = e.where("id % 25 = 0").select(F.col("id").alias("qid"), "label", "vec")
    gold = q.where("qid % 50 = 0").join(e.where("id % 40 = 0").select("id", "label"), "label").select("qid", "id")
    return q, S.cosine_top(e, q, 10).select("qid", "id", "score", "rank"), gold


def _retrieval_sql(recall: float, rr: float) -> str:
    ks = (1, 3, 5, 10)
    hits = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in ks)
    cols = ", ".join(f"round(coalesce(h{k}::DOUBLE / n, {recall}), 6) AS recall_at_{k}" for k in ks)
    return _RUN + f", h AS (SELECT gold.qid, count(*) AS n, min(rank) AS first, {hits} FROM gold LEFT JOIN run USING (qid, id) GROUP BY gold.qid) SELECT qid, {cols}, round(CASE WHEN n IS NULL THEN {rr} ELSE coalesce(1.0::DOUBLE / first, 0) END, 6) AS mrr, coalesce(h10 = n, false) AS all_gold FROM qs LEFT JOIN h USING (qid)"


@query("m1_retrieval_dev", _retrieval_sql(1.0, 0.0))
def m1(spark, sf_dir):
    return M.retrieval(*_run(spark, sf_dir), convention="dev")


@query("m3_retrieval_benchmark", _retrieval_sql(0.0, 0.0))
def m3(spark, sf_dir):
    return M.retrieval(*_run(spark, sf_dir))


@query("m4_retrieval_runner", _retrieval_sql(1.0, 1.0))
def m4(spark, sf_dir):
    return M.retrieval(*_run(spark, sf_dir), convention="runner")


@query("m5_answerable_only", f"SELECT count(*) AS n, round(avg(recall_at_10), 6) AS recall, round(avg(mrr), 6) AS mrr FROM ({_retrieval_sql(0.0, 0.0).replace('qs LEFT JOIN h', 'qs JOIN h')})")
def m5(spark, sf_dir):
    q, run, gold = _run(spark, sf_dir)
    return M.retrieval(q, run, gold).join(gold.select("qid").distinct(), "qid", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_at_10"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))


_ANSWER = "CASE qid % 4 WHEN 0 THEN 'see [0], [' || qid % 13 || '] and The End' WHEN 1 THEN 'It is not found.' WHEN 2 THEN 'plain' ELSE 'the end [1]' END"


@query(
    "m5_both_conventions",
    _RUN
    + rf""", r AS (SELECT qid, list(id::VARCHAR ORDER BY rank) AS got FROM run GROUP BY qid), g AS (SELECT qid, list(id::VARCHAR) AS gold FROM gold GROUP BY qid),
x AS (SELECT qid, {_ANSWER} AS answer, got, coalesce(gold, []) AS gold, qid % 7 AS latency FROM qs JOIN r USING (qid) LEFT JOIN g USING (qid)),
y AS (SELECT *, len(gold) > 0 AS has, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda m: m::INT) AS marks FROM x),
z AS (SELECT *, list_transform(list_filter(marks, lambda m: m < len(got)), lambda m: got[m + 1]) AS cited, list_min(list_filter(list_transform(range(1, len(got) + 1), lambda i: CASE WHEN list_contains(gold, got[i]) THEN i END), lambda i: i IS NOT NULL)) AS first FROM y),
w AS (SELECT *, {", ".join(f"CASE WHEN has THEN len(list_intersect(got[1:{k}], gold))::DOUBLE / len(gold) END AS r{k}" for k in (1, 3, 6))}, CASE WHEN has THEN coalesce(1.0::DOUBLE / first, 0) END AS rr FROM z)
SELECT count(*) AS n, count(*) FILTER (has) AS answerable, {", ".join(f"round(avg(r{k}), 4) AS answerable_recall_at_{k}, round(avg(coalesce(r{k}, 1)), 4) AS all_recall_at_{k}" for k in (1, 3, 6))}, round(avg(rr), 4) AS answerable_mrr, round(avg(coalesce(rr, 1)), 4) AS all_mrr,
round(avg(CASE WHEN NOT has THEN contains(lower(answer), 'not found')::INT END), 4) AS refused, round(avg((len(cited) = len(marks))::INT), 4) AS valid_citations,
round(avg(CASE WHEN len(marks) = 0 THEN CASE WHEN has THEN 0 ELSE 1 END WHEN has AND len(cited) > 0 THEN len(list_filter(cited, lambda c: list_contains(gold, c)))::DOUBLE / len(cited) ELSE 0 END), 4) AS gold_citations,
round(avg(((contains(lower(answer), 'the end'))::INT + (contains(lower(answer), 'see'))::INT)::DOUBLE / 2), 4) AS coverage, 0::BIGINT AS truncated, round(avg(latency), 3) AS latency FROM w""",
)
def m5b(spark, sf_dir):
    q, run, gold = _run(spark, sf_dir)
    got = run.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))), lambda x: x["id"]).alias("retrieved"))
    wanted = gold.groupBy("qid").agg(F.collect_list(F.col("id").cast("string")).alias("gold"))
    k = F.col("qid") % 4
    answer = F.when(k == 0, F.concat(F.lit("see [0], ["), (F.col("qid") % 13).cast("string"), F.lit("] and The End"))).when(k == 1, "It is not found.").when(k == 2, "plain").otherwise("the end [1]")
    rows = q.select("qid", answer.alias("answer"), (F.col("qid") % 7).alias("latency"), F.array(F.lit("the end"), F.lit("See")).alias("required"))
    return M.corrected(rows.join(got, "qid").join(wanted, "qid", "left"))


@query("m6_precision", _RUN + " SELECT qid, round(avg(CASE WHEN gold.id IS NULL THEN 0 ELSE 1 END), 6) AS precision FROM run LEFT JOIN gold USING (qid, id) WHERE rank <= 5 GROUP BY qid")
def m6(spark, sf_dir):
    _, run, gold = _run(spark, sf_dir)
    return M.precision(run, gold, 5)


@query("m7_term_coverage", "SELECT doc_id, ((contains(lower(text), 'the'))::INT + (contains(lower(text), 'worthless'))::INT)::DOUBLE / 2 AS coverage FROM documents")
def m7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.term_coverage(F.col("text"), F.array(F.lit("The"), F.lit("worthless"))).alias("coverage"))


@query("m8_refusals", "SELECT conv_id, turn, turn % 3 = 1 AS refusal FROM conversations")
def m8(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", M.is_refusal(F.when(F.col("turn") % 3 == 1, F.concat(F.lit("Sorry, I cannot answer THIS question. "), F.coalesce("text", F.lit("")))).when(F.col("turn") % 3 == 2, "I cannot answer that").otherwise(F.col("text"))).alias("refusal"))


@query("m10_citations", "SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'c1' WHEN event_id % 5 < 3 THEN 'c' || event_id % 5 || ',c1' ELSE 'c1' END AS cited FROM events")
def m10(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    answer = F.concat(F.lit("so ["), (F.col("event_id") % 5).cast("string"), F.lit("] and [1], ["), (F.col("event_id") % 5).cast("string"), F.lit("]"))
    return e.select("event_id", F.array_join(M.citations(answer, F.array(*(F.lit(f"c{k}") for k in range(3)))), ",").alias("cited"))


@query("m9_hallucinated", "SELECT event_id, array_to_string(list_sort(list_filter(['c' || event_id % 5, 'c1', 'x'], lambda c: NOT list_contains(['c0', 'c1', 'c2'], c))), ',') AS made_up FROM events")
def m9(spark, sf_dir):
    cited = F.array(F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")), F.lit("c1"), F.lit("x"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(M.hallucinated(cited, F.array(*(F.lit(f"c{k}") for k in range(3)))), ",").alias("made_up"))


_NA = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 #]|#', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), ' +', ' ', 'g'), ' ')"


@query(
    "m11_token_f1",
    f"""WITH a AS (SELECT p_partkey, {_NA.format("'the ' || p_name || ' ' || p_brand")} AS p, {_NA.format("p_name || ' a ' || p_type")} AS g FROM part),
x AS (SELECT p_partkey, t, count(*) AS a FROM (SELECT p_partkey, unnest(string_split(p, ' ')) AS t FROM a) GROUP BY ALL), y AS (SELECT p_partkey, t, count(*) AS b FROM (SELECT p_partkey, unnest(string_split(g, ' ')) AS t FROM a) GROUP BY ALL),
s AS (SELECT p_partkey, sum(least(a, b)) AS same FROM x JOIN y USING (p_partkey, t) GROUP BY 1), f AS (SELECT a.p_partkey, (p = g)::INT AS em, coalesce(same, 0)::DOUBLE / len(string_split(p, ' ')) AS pr, coalesce(same, 0)::DOUBLE / len(string_split(g, ' ')) AS rc FROM a LEFT JOIN s USING (p_partkey))
SELECT p_partkey, em, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM f""",
)
def m11(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit(" "), "p_brand").alias("prediction"), F.concat("p_name", F.lit(" a "), "p_type").alias("gold"))
    return M.token_f1(p, "p_partkey", "prediction", "gold")


_SP = "WITH p AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 20 AS f FROM lineitem WHERE l_returnflag <> 'A'), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 20 AS f FROM lineitem WHERE l_linestatus = 'F')"


def _facts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_partkey") % 20).alias("f"), "l_returnflag", "l_linestatus")
    return li.where("l_returnflag <> 'A'"), li.where("l_linestatus = 'F'")


@query(
    "m12_supporting_facts",
    _SP + """, j AS (SELECT q, count(*) FILTER (p.f IS NOT NULL AND g.f IS NOT NULL) AS tp, count(p.f) AS np, count(g.f) AS ng FROM p FULL JOIN g USING (q, f) GROUP BY q), s AS (SELECT *, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END AS pr, CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 0 END AS rc FROM j)
SELECT q, tp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1, (tp = np AND tp = ng)::INT AS em FROM s""",
)
def m12(spark, sf_dir):
    return M.set_scores(*_facts(spark, sf_dir), ["f"], "q")


@query("m19_micro_average", _SP + ", j AS (SELECT count(*) FILTER (p.f IS NOT NULL AND g.f IS NOT NULL) AS tp, count(p.f) AS np, count(g.f) AS ng FROM p FULL JOIN g USING (q, f)) SELECT tp, round(tp::DOUBLE / np, 6) AS precision, round(tp::DOUBLE / ng, 6) AS recall, round(2.0::DOUBLE * tp / (np + ng), 6) AS f1, 0::INT AS em FROM j")
def m19(spark, sf_dir):
    return M.micro(*_facts(spark, sf_dir), ["q", "f"])


@query("m14_by_type", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def m14(spark, sf_dir):
    return M.by_type(table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus"), ["l_quantity"])


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") % 1).alias("a"), (F.col("o_totalprice") % 0.7).alias("b"))


@query("m15_paired_bootstrap")
def m15(spark, sf_dir):
    return M.paired_bootstrap(_scores(spark, sf_dir), ["o_orderstatus"], "a", "b", "o_orderkey")


@query("m16_bootstrap_mean")
def m16(spark, sf_dir):
    return M.bootstrap_mean(_scores(spark, sf_dir), ["o_orderstatus"], "a", "o_orderkey")


@query("m17_wilson", "WITH s AS (SELECT event_type, count(*) FILTER (value > 20)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM events GROUP BY 1) SELECT event_type, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lo, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS hi FROM s")
def m17(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 20).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return s.select("event_type", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("m18_agreement", "SELECT quality AS first, toxic AS second, count(*) AS n FROM labels GROUP BY 1, 2")
def m18(spark, sf_dir):
    return M.agreement(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "m18_stratum_noise",
    """WITH l AS (SELECT user_id % 3 AS stratum, event_type AS a, CASE WHEN event_id % 7 = 0 THEN 'click' ELSE ' ' || upper(event_type) END AS h FROM events), r AS (SELECT stratum, upper(trim(a)) = upper(trim(h)) AS same, upper(trim(h)) = 'CLICK' AS hn, upper(trim(a)) = 'CLICK' AS an FROM l),
s AS (SELECT stratum, count(*)::DOUBLE AS n, count(*) FILTER (same)::DOUBLE AS same, count(*) FILTER (hn)::DOUBLE AS hn, count(*) FILTER (an)::DOUBLE AS an, 1.959963984540054::DOUBLE AS z FROM r GROUP BY GROUPING SETS ((stratum), ()))
SELECT stratum, n::BIGINT AS n, round(same / n, 6) AS agreement, round((same / n + z * z / (2 * n) - z * sqrt(same / n * (1 - same / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS agreement_lo, round((same / n + z * z / (2 * n) + z * sqrt(same / n * (1 - same / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS agreement_hi,
round(hn / n, 6) AS noise, round((hn / n + z * z / (2 * n) - z * sqrt(hn / n * (1 - hn / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS noise_lo, round((hn / n + z * z / (2 * n) + z * sqrt(hn / n * (1 - hn / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS noise_hi, round(an / n, 6) AS judge_noise FROM s""",
)
def m18s(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    human = F.when(F.col("event_id") % 7 == 0, "click").otherwise(F.concat(F.lit(" "), F.upper("event_type")))
    return M.stratum_noise(e.select((F.col("user_id") % 3).alias("stratum"), "event_type", human.alias("human")), "stratum", "event_type", "human", "CLICK")


@query(
    "m20_relation_differences",
    f"""WITH {KG}, a AS (SELECT DISTINCT chunk_id, lower(source) AS source, lower(target) AS target FROM rels), b AS (SELECT DISTINCT chunk_id, lower(CASE pos % 5 WHEN 0 THEN target WHEN 1 THEN source || ' inc' ELSE source END) AS source, lower(CASE pos % 5 WHEN 0 THEN source WHEN 2 THEN 'no such' ELSE target END) AS target FROM rels),
f AS (FROM b ANTI JOIN a USING (chunk_id, source, target)) SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.chunk_id = a.chunk_id AND b.source = a.source AND b.target = a.target) THEN 'exact'
WHEN EXISTS (SELECT 1 FROM f WHERE f.chunk_id = a.chunk_id AND (((contains(f.source, a.source) OR contains(a.source, f.source)) AND (contains(f.target, a.target) OR contains(a.target, f.target))) OR ((contains(f.source, a.target) OR contains(a.target, f.source)) AND (contains(f.target, a.source) OR contains(a.source, f.target))))) THEN 'renamed' ELSE 'missing' END AS kind FROM a""",
)
def m20r(spark, sf_dir):
    r = relations(spark, sf_dir)
    k = F.col("pos") % 5
    other = r.select("chunk_id", F.when(k == 0, F.col("target")).when(k == 1, F.concat("source", F.lit(" inc"))).otherwise(F.col("source")).alias("source"), F.when(k == 0, F.col("source")).when(k == 2, "no such").otherwise(F.col("target")).alias("target"))
    return M.relation_differences(r, other, "chunk_id")


@query(
    "m29_context_traced",
    rf"""WITH a AS (SELECT item_id AS cid, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, regexp_extract_all(lower(left(text, 60)), '[a-z0-9]+') AS q FROM benchmark), b AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
ga AS (SELECT DISTINCT cid, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT cid, w, unnest(range(1, len(w) - 2)) AS i FROM a)), gb AS (SELECT DISTINCT id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS i FROM b)), g AS (SELECT cid, id, count(*) AS shared FROM ga JOIN gb USING (g) GROUP BY 1, 2),
ta AS (SELECT DISTINCT cid, unnest(w) AS t FROM a), tb AS (SELECT DISTINCT id, unnest(w) AS t FROM b), c AS (SELECT cid, id, list_sort(list(t))[1:20] AS t FROM ta JOIN tb USING (t) WHERE regexp_full_match(t, '[a-z]{{5,}}') AND t NOT IN ({", ".join(f"'{w}'" for w in M.COMMON)}) GROUP BY 1, 2),
e AS (SELECT cid, id, len(list_filter(t, lambda x: NOT list_contains(q, x))) AS terms FROM c JOIN a USING (cid)) SELECT cid, id, coalesce(shared, 0) AS shared, coalesce(terms, 0) AS terms, coalesce(shared, 0) > 0 OR coalesce(terms, 0) >= 3 AS traced FROM g FULL JOIN e USING (cid, id)""",
)
def m29t(spark, sf_dir):
    c = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cid"), "text", F.substring("text", 1, 60).alias("question"))
    return M.context_traced(c, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("m22_summary", "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(max(value), 4) AS max, round(sum(value), 3) AS total FROM events GROUP BY 1")
def m22(spark, sf_dir):
    return M.summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("m23_percentile_by_index", "SELECT event_type, list_sort(list(value))[1 + least(count(*) - 1, floor(0.9::DOUBLE * count(*))::BIGINT)] AS value FROM events GROUP BY 1")
def m23(spark, sf_dir):
    return M.percentile_at(table(spark, sf_dir, "events"), "event_type", "value", 0.9)


@query("m24_hit_curve", "SELECT user_id, event_id, round(sum((event_type = 'view')::INT) OVER w::DOUBLE / count(*) OVER w, 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def m24(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "view").cast("int").alias("hit"), F.lit(1).alias("one"))
    return M.hit_curve(e, "user_id", "event_id", "hit", "one")


@query("m25_first_touch", "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS n FROM d) SELECT l_orderkey, count(*) FILTER (n = 1) AS new, count(*) AS touched FROM n GROUP BY 1")
def m25(spark, sf_dir):
    return M.first_touch(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct(), "l_partkey", "l_orderkey")


@query("m27_completeness", "WITH r AS (SELECT l_returnflag AS run, l_partkey AS k FROM lineitem), w AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0), d AS (SELECT DISTINCT run, k FROM r) SELECT run, count(*) AS rows, count(*) - count(DISTINCT k) AS duplicates, (SELECT count(*) FROM w) - (SELECT count(*) FROM d JOIN w USING (k) WHERE d.run = r.run) AS missing, (SELECT count(*) FROM d WHERE d.run = r.run AND k NOT IN (FROM w)) AS extra FROM r GROUP BY run")
def m27(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("k"))
    return M.completeness(r, table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k")), "run", "k")


@query("m29_context_tracing", r"WITH t AS (SELECT item_id AS cid, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda t: t <> '') AS w FROM benchmark), d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda t: t <> '') AS w FROM documents), a AS (SELECT DISTINCT cid, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT cid, w, unnest(range(1, len(w) - 2)) AS i FROM t)), b AS (SELECT DISTINCT id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS i FROM d)) SELECT cid, id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY 1, 2")
def m29(spark, sf_dir):
    return M.traced(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cid"), "text"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("m32_cross_document", _RUN + " SELECT qid, count(DISTINCT e.label) AS documents, count(DISTINCT gold.id) AS gold_hits, count(DISTINCT e.label) > 1 AS spans FROM run JOIN e USING (id) LEFT JOIN gold USING (qid, id) GROUP BY qid")
def m32(spark, sf_dir):
    _, run, gold = _run(spark, sf_dir)
    docs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("doc_id"))
    return M.cross_document_share(run, docs, gold).select("qid", "documents", "gold_hits", F.col("cross").alias("spans"))
