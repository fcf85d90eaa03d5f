"""Queries of text functions, chunkers and extraction records."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking as C
from skein.operators import extraction as X
from skein.queries import query
from skein.sources.tables import mentions, oracle_views, relations, table

KG = oracle_views()
NORM = r"trim(regexp_replace(lower(coalesce({}, '')), '[ \t\n\r\x0b\f]+', ' ', 'g'), ' ')"
ALIAS = r"regexp_replace(trim(regexp_replace(regexp_replace(" + NORM + r", '[^\pL\pN_\s]', '', 'g'), '[ \t\n\r\x0b\f]+', ' ', 'g'), ' '), 's$', '')"
_TOKENS = r"regexp_extract_all(text, '[^ \t\n\r]+[ \t\n\r]*')"


def _windows(size: int, stride: int, name: str) -> str:
    return rf"""
WITH t AS (SELECT doc_id::VARCHAR AS doc_id, {_TOKENS} AS t FROM documents),
w AS (SELECT doc_id, t, unnest(range(0, len(t), {stride})) AS start_offset FROM t WHERE len(t) > 0),
p AS (SELECT doc_id, (start_offset // {stride})::INT AS chunk_index, start_offset::INT AS start_offset, t[start_offset + 1:start_offset + {size}] AS x FROM w)
SELECT substr(sha256(doc_id || '::' || chunk_index), 1, 16) AS chunk_id, doc_id, sha256(array_to_string(x, '')) AS text_sha, len(x)::INT AS token_count,
       start_offset, (start_offset + len(x))::INT AS end_offset, chunk_index, '{name}' AS strategy FROM p"""


def _hashed(chunks):
    return chunks.withColumn("text_sha", F.sha2("text", 256)).drop("text")


@query("t1_sliding_window", _windows(500, 425, "sliding_window"))
def t1(spark, sf_dir):
    return _hashed(C.sliding_window(table(spark, sf_dir, "documents")))


@query("t4_small_window", _windows(250, 213, "small_window"))
def t4(spark, sf_dir):
    return _hashed(C.small_window(table(spark, sf_dir, "documents")))


@query("t2_recursive_char")
def t2(spark, sf_dir):
    return _hashed(C.recursive_char(table(spark, sf_dir, "documents")))


@query("t3_markdown_aware")
def t3(spark, sf_dir):
    return _hashed(C.markdown_aware(table(spark, sf_dir, "documents")))


@query("t5_chunk_dispatch", _windows(100, 90, "sliding_window"))
def t5(spark, sf_dir):
    return _hashed(C.chunk_documents(table(spark, sf_dir, "documents"), "sliding_window", size=100, overlap=0.1))


@query(
    "t6_cumulative_offsets",
    rf"""
WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS chunk_index FROM documents),
n AS (SELECT *, len({_TOKENS})::INT AS token_count FROM t),
e AS (SELECT *, (sum(token_count) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING))::INT AS end_offset FROM n)
SELECT substr(sha256(doc_id || '::' || chunk_index), 1, 16) AS chunk_id, doc_id::VARCHAR AS doc_id, sha256(text) AS text_sha, token_count, end_offset - token_count AS start_offset, end_offset, chunk_index, 'lines' AS strategy FROM e""",
)
def t6(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return _hashed(C.with_offsets(lines, "lines"))


@query("t8_token_counts", f"SELECT doc_id, len({_TOKENS})::INT AS tokens FROM documents")
def t8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query(
    "t9_sentences",
    r"""SELECT doc_id, (length(x) - length(replace(x, chr(1), '')) + 1)::INT AS sentences, md5(replace(x, chr(1), '|')) AS digest
FROM (SELECT doc_id, regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g') AS x FROM documents)""",
)
def t9(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(
    "t10_chunk_statistics",
    f"""WITH c AS (({_windows(500, 425, "sliding_window")}) UNION ALL ({_windows(250, 213, "small_window")})),
o AS (SELECT *, greatest(lag(end_offset) OVER (PARTITION BY strategy, doc_id ORDER BY chunk_index) - start_offset, 0) AS raw, lag(end_offset) OVER (PARTITION BY strategy, doc_id ORDER BY chunk_index) AS prev FROM c)
SELECT strategy, count(*) AS chunks, min(token_count) AS min_tokens, median(token_count)::DOUBLE AS median_tokens, max(token_count) AS max_tokens, round(avg(CASE WHEN prev IS NULL THEN 0 ELSE raw END), 6) AS mean_overlap FROM o GROUP BY strategy""",
)
def t10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.chunk_statistics(C.sliding_window(docs).unionByName(C.small_window(docs)))


@query(
    "t11_sentence_integrity",
    rf"""WITH s AS (SELECT doc_id, regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g') AS x FROM documents),
e AS (SELECT doc_id, unnest(string_split(x, chr(1))) AS sentence, generate_subscripts(string_split(x, chr(1)), 1) - 1 AS sentence_id FROM s),
w AS (SELECT doc_id::VARCHAR AS doc_id, sentence_id::INT AS sentence_id, sentence, string_split_regex(trim(sentence, ' '), '\s+') AS w FROM e WHERE length(sentence) > 20),
f AS (SELECT *, array_to_string(w[1:5], ' ') AS head, array_to_string(w[greatest(len(w) - 4, 1):], ' ') AS tail FROM w),
c AS (SELECT doc_id, array_to_string(x, '') AS text FROM (SELECT doc_id, t[k + 1:k + 100] AS x FROM (SELECT doc_id::VARCHAR AS doc_id, t, unnest(range(0, len(t), 100)) AS k FROM (SELECT doc_id, {_TOKENS} AS t FROM documents))))
SELECT f.doc_id, sentence_id, CASE WHEN bool_or(contains(text, sentence)) THEN 'intact' WHEN bool_or(contains(text, head) OR contains(text, tail)) THEN 'split' ELSE 'missing' END AS state
FROM f LEFT JOIN c USING (doc_id) GROUP BY f.doc_id, sentence_id""",
)
def t11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(T.sentences(F.col("text"))).alias("sentence_id", "sentence")).where(F.length("sentence") > 20)
    return C.sentence_integrity(C.sliding_window(docs, 100, 0.0), wanted)


@query(
    "t12_dedup_ratio",
    rf"WITH {KG} SELECT type, count(*) AS raw, count(DISTINCT {NORM.format('name')}) AS uniq, round(count(DISTINCT {NORM.format('name')})::DOUBLE / count(*), 6) AS ratio, round(1000.0::DOUBLE * count(DISTINCT {NORM.format('name')}) / sum(len(regexp_extract_all(source_sentence, '\S+\s*'))), 6) AS per_1k FROM ents GROUP BY type",
)
def t12(spark, sf_dir):
    u = F.countDistinct(T.norm(F.col("name")))
    return mentions(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("raw"), u.alias("uniq"), F.round(u / F.count(F.lit(1)), 6).alias("ratio"), F.round(1000 * u / F.sum(F.size(F.regexp_extract_all("source_sentence", F.lit(r"(\S+\s*)"), F.lit(1)))), 6).alias("per_1k"))


@query(
    "t13_numbered_sentences",
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(range(0, len(x)), lambda i: '[' || i || '] ' || x[i + 1]), chr(10))) AS digest, coalesce(x[3], '') AS third FROM s""",
)
def t13(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.numbered(s)).alias("digest"), C.sentence_at(s, F.lit(2)).alias("third"))


@query(
    "t14_sentence_spans",
    r"""WITH s AS (SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents),
e AS (SELECT doc_id, length(lang) + 1 AS base, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM s)
SELECT doc_id, i::INT - 1 AS sentence_id, (base + sum(length(t)) OVER w - length(t))::INT AS a, (base + sum(length(t)) OVER w)::INT AS b FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)""",
)
def t14(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.sentence_spans(F.col("lang"), T.sentences(F.col("text")))).alias("sentence_id", "x"))
    return rows.select("doc_id", "sentence_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query(
    "x2_json_recovery",
    r"""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS body FROM events""",
)
def x2(spark, sf_dir):
    """Answers around the JSON of events.props: fenced, with talk around them, or cut off."""
    props = F.col("props")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here it is: "), props, F.lit(" Done."))).when(F.col("event_id") % 4 == 2, F.replace(props, F.lit("}"), F.lit(",}"))).otherwise(F.replace(props, F.lit("}"), F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", T.json_object(raw).alias("body"))


@query(
    "x3_record_normalisation",
    f"WITH {KG} SELECT record_no, pos, trim(name, ' ') AS name, CASE WHEN pos % 5 = 0 THEN 'OTHER' ELSE upper(type) END AS type FROM ents",
)
def x3(spark, sf_dir):
    e = mentions(spark, sf_dir)
    raw = e.select("record_no", "pos", F.array(F.struct(F.concat(F.lit(" "), "name").alias("name"), F.when(F.col("pos") % 5 == 0, "").otherwise(F.lower("type")).alias("type"), "description", "source_sentence", "stub"), F.struct(F.lit(" ").alias("name"), F.lit("x").alias("type"), F.lit("").alias("description"), F.lit("").alias("source_sentence"), F.lit(False).alias("stub"))).alias("entities"))
    clean, _ = X.normalised(F.col("entities"), F.lit(None).cast(f"array<{X.RELATION}>"))
    return raw.select("record_no", "pos", F.explode(clean).alias("x")).select("record_no", "pos", "x.name", "x.type")


@query(
    "x4_endpoint_filter",
    rf"""WITH {KG}, k AS (SELECT DISTINCT chunk_id, {NORM.format("name")} AS k FROM ents)
SELECT record_no, pos, source, target, type FROM rels r WHERE EXISTS (SELECT 1 FROM k WHERE k.chunk_id = r.chunk_id AND k.k = {NORM.format("r.source")}) AND EXISTS (SELECT 1 FROM k WHERE k.chunk_id = r.chunk_id AND k.k = {NORM.format("r.target")})""",
)
def x4(spark, sf_dir):
    return X.endpoint_filter(relations(spark, sf_dir), mentions(spark, sf_dir)).select("record_no", "pos", "source", "target", "type")


@query(
    "x5_stub_recovery",
    rf"""WITH {KG}, k AS (SELECT DISTINCT chunk_id, {NORM.format("name")} AS k FROM ents),
e AS (SELECT chunk_id, source AS name FROM rels UNION ALL SELECT chunk_id, target FROM rels)
SELECT DISTINCT chunk_id, {NORM.format("name")} AS key FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.chunk_id = e.chunk_id AND k.k = {NORM.format("e.name")})""",
)
def x5(spark, sf_dir):
    r = relations(spark, sf_dir)
    chunks = r.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("text"))
    _, stubs = X.recover_stubs(r, mentions(spark, sf_dir), chunks)
    return stubs.select("chunk_id", T.norm(F.col("name")).alias("key"))


@query(
    "x6_verbatim_phrase",
    r"""SELECT d.doc_id, b.w, contains(' ' || array_to_string(list_filter(string_split_regex(lower(d.text), '[^\pL\pN_]+'), lambda t: t <> ''), ' ') || ' ', ' ' || b.w || ' ') AS found
FROM documents d CROSS JOIN (SELECT unnest(['the', 'worthless', 'éou', 'ing']) AS w) b""",
)
def x6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = F.explode(F.array(*(F.lit(w) for w in ("the", "worthless", "éou", "ing"))))
    return docs.select("doc_id", "text", words.alias("w")).select("doc_id", "w", T.verbatim(F.col("w"), F.col("text")).alias("found"))


@query(
    "x7_sentence_with_name",
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents)
SELECT doc_id, coalesce(list_filter(x, lambda t: contains(lower(t), 'tion'))[1], '') AS sentence FROM s""",
)
def x7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.sentence_with(F.col("text"), F.lit("tion")).alias("sentence"))


@query(
    "x8_gleaning_merge",
    f"""WITH {KG}, p AS (SELECT *, (pos % 2)::INT AS pass FROM ents)
SELECT chunk_id, name, type, pass FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, lower(trim(name, ' ')) ORDER BY pass, pos) AS n FROM p) WHERE n = 1""",
)
def x8(spark, sf_dir):
    return X.merge_entities(mentions(spark, sf_dir).withColumn("pass", (F.col("pos") % 2).cast("int"))).select("chunk_id", "name", "type", "pass")


@query(
    "x8_gleaning_relations",
    f"""WITH {KG}, p AS (SELECT *, (pos % 2)::INT AS pass FROM rels)
SELECT chunk_id, source, target, type, pass FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, lower(trim(source, ' ')), lower(trim(target, ' ')), upper(trim(type, ' ')) ORDER BY pass, pos) AS n FROM p) WHERE n = 1""",
)
def x8r(spark, sf_dir):
    return X.merge_relations(relations(spark, sf_dir).withColumn("pass", (F.col("pos") % 2).cast("int"))).select("chunk_id", "source", "target", "type", "pass")


@query(
    "x1_retry_ladder",
    "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 IN (0, 1) THEN 1 WHEN (conv_id + turn) % 4 = 2 THEN 2 ELSE 3 END AS attempts, CASE (conv_id + turn) % 4 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 END::DOUBLE AS penalty, CASE WHEN (conv_id + turn) % 12 = 3 THEN '' ELSE role END AS name FROM conversations",
)
def x1(spark, sf_dir):
    """A model that answers some chunks only when it is asked again, and some never."""
    k = F.col("conv_id") + F.col("turn")

    def model(chunks, penalty):
        fine = {None: k % 4 < 2, 0.5: k % 4 == 2, 1.0: (k % 4 == 3) & (k % 12 != 3)}[penalty]
        answer = F.concat(F.lit('Sure: {"entities": [{"name": " '), F.col("role"), F.lit('"}], "relationships": []}'))
        return chunks.withColumn("raw", F.when(fine, answer).otherwise("I can't."))

    out = X.extract(table(spark, sf_dir, "conversations"), model, current=0.7)
    return out.select("conv_id", "turn", "attempts", "penalty", F.coalesce(F.get("entities", 0)["name"], F.lit("")).alias("name"))


#: Names that are placeholders, and some that only look like one.
_SAMPLES = ("<|entity|>", " <name> ", "entity_name", "Entity_Type", "entity_description", "source_entity", "TARGET_ENTITY", "relationship_keywords", "relationship_description", "a <source_entity> b", "x<target_entity>", "Name", "Source", "unknown", "none", "a < b > c", "  ")


@query(
    "x11_placeholders",
    rf"""WITH w AS (SELECT page_id, [{", ".join(f"'{x}'" for x in _SAMPLES)}, url, NULL] AS x FROM pages) SELECT page_id, v, (trim(coalesce(v, ''), ' ') = '' OR regexp_matches(trim(v, ' '), '^<[^>]+>$')
OR lower(trim(v, ' ')) IN ('entity_name', 'entity_type', 'entity_description', 'source_entity', 'target_entity', 'relationship_keywords', 'relationship_description')
OR contains(v, '<entity_name>') OR contains(v, '<source_entity>') OR contains(v, '<target_entity>') OR contains(v, '<relationship_description>') OR contains(v, '<relationship_keywords>')) AS placeholder FROM (SELECT page_id, unnest(x) AS v FROM w)""",
)
def x11(spark, sf_dir):
    texts = F.array(*(F.lit(x) for x in _SAMPLES), F.col("url"), F.lit(None))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(texts).alias("v")).select("page_id", "v", X.is_placeholder(F.col("v")).alias("placeholder"))


@query(
    "x12_valid_nodes",
    f"WITH {KG} SELECT record_no, pos, name FROM (SELECT *, CASE pos % 7 WHEN 0 THEN ' ' WHEN 1 THEN '<entity_type>' WHEN 2 THEN 'see <entity_name>' ELSE description END AS d FROM ents) WHERE pos % 7 > 2 AND trim(name, ' ') <> ''",
)
def x12n(spark, sf_dir):
    k = F.col("pos") % 7
    rows = mentions(spark, sf_dir).withColumn("description", F.when(k == 0, " ").when(k == 1, "<entity_type>").when(k == 2, "see <entity_name>").otherwise(F.col("description")))
    return X.valid_nodes(rows).select("record_no", "pos", "name")


@query(
    "x12_valid_edges",
    f"WITH {KG} SELECT record_no, pos, source, target FROM rels WHERE trim(source, ' ') <> trim(target, ' ')",
)
def x12(spark, sf_dir):
    return X.valid_edges(relations(spark, sf_dir)).select("record_no", "pos", "source", "target")


@query(
    "x13_relation_audit",
    rf"""WITH {KG}, k AS (SELECT DISTINCT chunk_id, {NORM.format("name")} AS k FROM ents),
r AS (SELECT rels.chunk_id, s.k IS NOT NULL AND t.k IS NOT NULL AS known FROM rels LEFT JOIN k s ON s.chunk_id = rels.chunk_id AND s.k = {NORM.format("source")} LEFT JOIN k t ON t.chunk_id = rels.chunk_id AND t.k = {NORM.format("target")})
SELECT chunk_id, count(*) AS raw, 0::BIGINT AS empty_end, count(*) FILTER (NOT known) AS unknown_end, count(*) FILTER (known) AS kept FROM r GROUP BY chunk_id""",
)
def x13(spark, sf_dir):
    return X.relation_audit(relations(spark, sf_dir), mentions(spark, sf_dir))


@query(
    "x14_dropped_classes",
    rf"""WITH {KG}, k AS (SELECT DISTINCT chunk_id, doc_id, {NORM.format("name")} AS k FROM ents), dk AS (SELECT DISTINCT doc_id, k FROM k),
e AS (SELECT chunk_id, doc_id, {NORM.format("source")} AS k FROM rels UNION ALL SELECT chunk_id, doc_id, {NORM.format("target")} FROM rels),
l AS (SELECT e.* FROM e ANTI JOIN k ON e.chunk_id = k.chunk_id AND e.k = k.k)
SELECT CASE WHEN dk.k IS NOT NULL THEN 'same_document' WHEN a.k IS NOT NULL THEN 'alias' ELSE 'hallucinated' END AS kind, count(*) AS ends, count(DISTINCT l.k) AS names
FROM l LEFT JOIN dk ON l.doc_id = dk.doc_id AND l.k = dk.k LEFT JOIN (SELECT DISTINCT lower('Ghost ' || p_name || ' ' || CAST(p_partkey % 200 AS VARCHAR)) AS k FROM part WHERE p_partkey % 3 = 0) a ON l.k = a.k GROUP BY 1""",
)
def x14(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    aliases = part.select(F.concat(F.lit("Ghost "), "p_name", F.lit(" "), (F.col("p_partkey") % 200).cast("string")).alias("alias"))
    return X.dropped_classes(relations(spark, sf_dir), mentions(spark, sf_dir), aliases)


@query("x15_cross_document_names", rf"WITH {KG} SELECT {NORM.format('name')} AS key, count(DISTINCT doc_id) AS docs FROM ents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def x15(spark, sf_dir):
    return X.cross_document_names(mentions(spark, sf_dir))


@query(
    "x16_coverage",
    rf"""WITH {KG}, c AS (SELECT 'order-' || o_orderkey AS chunk_id, 'nation-' || c_nationkey AS doc_id, (o_orderkey % 100)::INT AS token_count FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT chunk_id, count(*) AS raw FROM ents GROUP BY chunk_id),
a AS (SELECT doc_id, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, count(*) FILTER (raw IS NULL) AS zero_entity, coalesce(sum(raw), 0)::BIGINT AS raw_entities FROM c LEFT JOIN p USING (chunk_id) GROUP BY ROLLUP (doc_id)),
b AS (SELECT doc_id, count(DISTINCT {NORM.format("name")}) AS names FROM ents GROUP BY ROLLUP (doc_id))
SELECT a.*, coalesce(names, 0) AS names FROM a LEFT JOIN b ON a.doc_id IS NOT DISTINCT FROM b.doc_id""",
)
def x16(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    chunks = o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("doc_id"), (F.col("o_orderkey") % 100).cast("int").alias("token_count"))
    return X.coverage(chunks, mentions(spark, sf_dir))


_ARMS = "SELECT 'order-' || l_orderkey AS chunk_id, l_returnflag AS arm, l_discount < 0.08 AS ok, l_linenumber::BIGINT AS raw, (l_linenumber // 2)::BIGINT AS kept, l_tax AS seconds FROM lineitem"


def _arms(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("chunk_id"), F.col("l_returnflag").alias("arm"), (F.col("l_discount") < 0.08).alias("ok"), F.col("l_linenumber").cast("long").alias("raw"), F.floor(F.col("l_linenumber") / 2).cast("long").alias("kept"), F.col("l_tax").alias("seconds"))


@query("x17_arm_statistics", f"SELECT arm, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, sum(raw)::BIGINT AS raw, sum(kept)::BIGINT AS kept, round(sum(seconds), 6) AS seconds FROM ({_ARMS}) GROUP BY arm")
def x17(spark, sf_dir):
    return X.arm_statistics(_arms(spark, sf_dir))


@query("x17_arm_matrix", f'SELECT chunk_id, (sum(kept) FILTER (arm = \'A\'))::BIGINT AS "A", (sum(kept) FILTER (arm = \'N\'))::BIGINT AS "N", (sum(kept) FILTER (arm = \'R\'))::BIGINT AS "R" FROM ({_ARMS}) GROUP BY chunk_id')
def x17m(spark, sf_dir):
    return X.arm_matrix(_arms(spark, sf_dir), ["A", "N", "R"])


@query("x1_rule_entities", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\pL{5,}') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS name, generate_subscripts(w, 1) - 1 AS pos FROM w) SELECT doc_id::VARCHAR AS doc_id, name, min(pos)::INT AS pos FROM e GROUP BY doc_id, name""")
def x1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return X.rule_entities(d).select("doc_id", "name", "pos")


@query("x10_payload_errors", r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'entities is missing' WHEN 1 THEN 'entities[0].name is empty' ELSE 'relationships[0] lacks an end' END AS errors FROM events""")
def x10(spark, sf_dir):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, '{"relationships":[]}').when(k == 1, '{"entities":[{"name":" "}]}').otherwise('{"entities":[{"name":"a"}],"relationships":[{"source":"a"}]}')
    return table(spark, sf_dir, "events").select("event_id", F.array_join(X.payload_errors(F.from_json(raw, X.PAYLOAD)), "; ").alias("errors"))
