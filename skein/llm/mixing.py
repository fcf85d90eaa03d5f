"""Mixing sources to target weights.

Each row gets a hash-random key. A source's rows are range-sorted by key: the
key's leading bits deal them to ranges of about RANGE rows, in each range a
running sum of sizes is taken, and the sums of the ranges before it are added,
so a source of any size is spread over many tasks. The mix takes whole epochs of
a source and then rows in key order up to exactly its budget.

A null source is a source, the last one. A null text has size 0. Rows that tie
in the key (repeated ids) follow by size; rows that tie in that too are alike.
An empty table gives no rows. Sources of size 0 get nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, stored, table

WEIGHTS = (5, 2, 1)
MOST = 3  #: times its size that a source may be taken
RANGE = 4096  #: rows of a key range
FEW = 100_000  #: sources up to which their targets are broadcast


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _source(col: str) -> Column:
    """A source's key: sorts by code point, null last."""
    return F.when(F.col(col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(col)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source_key, rows, source_size and target. Sources are filled by weight up to one level; those whose cap lies below it get their cap.

    In the order of cap over weight the capped sources come first: one is capped
    if its ratio is at most the level that is left when all before it are.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("source_key")
    by_ratio = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("n") - 1).cast("int") % len(weights) + 1)
    out = sizes.withColumn("n", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    out = out.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    out = out.withColumn("capped", F.col("ratio") <= level)
    gone = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = F.col("weight") * (F.col("total") - gone) / F.when(weight > 0, weight)
    return out.select("source_key", "rows", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: str = "mix") -> DataFrame:
    """row (a struct of the columns of df) and mix (of size, source_size, target and taken) of all rows of df."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), size.alias("size"), _source(source_col).alias("source_key"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("key"))
    plan = targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, most)
    plan = stored(plan, "targets")
    # a row for each source: sent to all tasks if there are few, which is counted
    plan = F.broadcast(plan) if plan.count() <= FEW else plan
    ranges = F.ceil(F.col("rows") / RANGE).cast("long")
    dealt = rows.join(plan, "source_key").withColumn("range", F.shiftright(F.shiftright("key", 30) * ranges, 30))
    dealt = dealt.repartition("source_key", "range")  # not by the source alone, which may hold a third of all rows
    before = Window.partitionBy("source_key", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    narrow = rows.select("source_key", "size", "key").join(plan.select("source_key", "rows"), "source_key").withColumn("range", F.shiftright(F.shiftright("key", 30) * ranges, 30))
    sums = narrow.groupBy("source_key", "range").agg(F.sum("size").alias("s")).select("source_key", "range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"))
    out = dealt.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))).join(sums, ["source_key", "range"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.floor(budget / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("offset") - F.col("within")
    taken = (epochs * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size"))).cast("long")
    return out.select("row", F.struct("size", "source_size", "target", taken.alias("taken")).alias("mix"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"))
    return mix(sizes, F.col("size")).select("row.doc_id", "row.source", "mix.*")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY source_key),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio,
             (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights FROM w),
k AS (SELECT *, ratio <= (total - coalesce(sum(cap) OVER p, 0)) / (weights - coalesce(sum(weight) OVER p, 0)) AS capped
      FROM c WINDOW p AS (ORDER BY ratio, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source_key, source_size, CASE WHEN capped THEN cap ELSE weight *
        (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0) END AS target FROM k),
r AS (SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source_key ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t USING (source_key))
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(greatest(budget % source_size - before, 0), size) END)::BIGINT AS taken
FROM r"""
