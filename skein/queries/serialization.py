"""Queries of serialisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import serialize as Z
from skein.queries import query
from skein.sources.tables import table

_ROW = """CASE WHEN text = '' OR text <> trim(text, ' ') OR regexp_matches(text, '[,"\n\r\t]|^\\s|\\s$') THEN '"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' ELSE text END"""


def _evidence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chunk_id"), F.col("role").alias("source_doc"), F.col("turn").cast("int").alias("chunk_index"), F.lit(0.5).alias("score"), F.lit("chunk").alias("source"), "text")


@query("f1_toon", f"""SELECT conv_id AS qid, 'evidence[' || count(*) || ']{{chunk_id,source_doc,chunk_index,score,source,text}}:' || chr(10) || string_agg('  c' || conv_id || ',' || role || ',' || turn || ',0.5,chunk,' || {_ROW}, chr(10) ORDER BY turn) AS toon FROM conversations GROUP BY conv_id""")
def f1(spark, sf_dir):
    return Z.to_toon(_evidence(spark, sf_dir))


@query("f3_json_round_trip", "SELECT conv_id AS qid, (turn + 1)::INT AS rank, 'c' || conv_id AS chunk_id, role AS source_doc, turn::INT AS chunk_index, 0.5::DOUBLE AS score, 'chunk' AS source, text FROM conversations")
def f3(spark, sf_dir):
    return Z.from_json(Z.to_json(_evidence(spark, sf_dir)), "qid", "json")


@query("f5_format_costs")
def f5(spark, sf_dir):
    return Z.compare_formats(_evidence(spark, sf_dir))


@query("f6_context", "SELECT conv_id, string_agg('[' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE text <> '' GROUP BY conv_id")
def f6(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return g.select("conv_id", Z.context(F.transform("x", lambda r: r["text"])).alias("context"))


@query("f7_reformatted", "SELECT event_id, 'it is ' || event_type || ' [' || user_id || '] so' AS answer FROM events")
def f7(spark, sf_dir):
    raw = F.concat(F.lit("Answer: ["), F.col("user_id").cast("string"), F.lit("] it is "), "event_type", F.lit("\n so"))
    return table(spark, sf_dir, "events").select("event_id", Z.reformatted(raw).alias("answer"))
