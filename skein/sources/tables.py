"""Loaders of the driver's tables and the graph records that stand in for extraction output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A lineitem is three mentions and three relationships of its order's record. The
#: text is valid in Spark and in DuckDB. Names come in variants (upper case, plural),
#: types are at times OTHER, and some relationships dangle or loop.
_LINES = """
  SELECT l_orderkey AS record_no, 'order-' || CAST(l_orderkey AS VARCHAR(20)) AS chunk_id, 'nation-' || CAST(c_nationkey AS VARCHAR(20)) AS doc_id,
         ((CAST(l_linenumber AS BIGINT) * 100000 + l_suppkey) * 10000000 + l_partkey) * 3 AS pos, l_partkey,
         CASE WHEN l_partkey % 5 = 0 THEN s_name || 's' WHEN l_partkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS supplier,
         CASE WHEN l_partkey % 4 = 0 THEN 'OTHER' ELSE 'ORGANIZATION' END AS supplier_type,
         p_name || ' ' || CAST(p_partkey % 200 AS VARCHAR(20)) AS part, n_name AS nation, p_brand
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
       JOIN {nation} ON c_nationkey = n_nationkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey"""

MENTIONS_SQL = f"""
SELECT record_no, pos, chunk_id, doc_id, supplier AS name, supplier_type AS type, 'supplies ' || part AS description, supplier || ' ships ' || part || '.' AS source_sentence FROM ({_LINES}) AS x
UNION ALL SELECT record_no, pos + 1, chunk_id, doc_id, part, 'PRODUCT', 'a ' || p_brand || ' part', supplier || ' ships ' || part || '.' FROM ({_LINES}) AS x
UNION ALL SELECT record_no, pos + 2, chunk_id, doc_id, nation, 'LOCATION', 'buys ' || part, part || ' goes to ' || nation || '.' FROM ({_LINES}) AS x"""

RELATIONS_SQL = f"""
SELECT record_no, pos, chunk_id, doc_id, supplier AS source, CASE WHEN l_partkey % 50 = 7 THEN 'Ghost ' || part ELSE part END AS target, 'SUPPLIES' AS type, 'supply of ' || part AS description, supplier || ' ships ' || part || '.' AS source_sentence FROM ({_LINES}) AS x
UNION ALL SELECT record_no, pos + 1, chunk_id, doc_id, part, nation, 'SOLD_IN', 'sale of ' || part, part || ' goes to ' || nation || '.' FROM ({_LINES}) AS x
UNION ALL SELECT record_no, pos + 2, chunk_id, doc_id, supplier, CASE WHEN l_partkey % 70 = 3 THEN supplier ELSE nation END, 'SHIPS_TO', 'shipping', supplier || ' ships ' || part || '.' FROM ({_LINES}) AS x"""

_TABLES = ("lineitem", "orders", "customer", "nation", "supplier", "part")


#: What a line's records are made of: the text of a line in _LINES, from the columns of lines().
_CHUNK, _DOC = "'order-' || CAST(record_no AS STRING)", "'nation-' || CAST(c_nationkey AS STRING)"
_SUPPLIER = "CASE WHEN l_partkey % 5 = 0 THEN s_name || 's' WHEN l_partkey % 3 = 0 THEN upper(s_name) ELSE s_name END"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_no, pos, c_nationkey, l_partkey, s_name, part, nation, p_brand: the line items of _LINES in few columns; the rest derives from them.

    Orders meet their nation before line items do, so the largest table is dealt by order and by part alone. It is dealt by order
    in any case, as a file of few row groups gives few tasks.
    """
    t = {n: table(spark, sf_dir, n) for n in _TABLES}
    near = t["orders"].select("o_orderkey", "o_custkey").join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    near = near.join(t["nation"].select("n_nationkey", F.col("n_name").alias("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    dealt = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").repartition("l_orderkey")
    out = dealt.join(near, F.col("l_orderkey") == F.col("o_orderkey")).join(t["supplier"].select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = out.join(t["part"].select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return out.selectExpr(
        "l_orderkey AS record_no", "((CAST(l_linenumber AS BIGINT) * 100000 + l_suppkey) * 10000000 + l_partkey) * 3 AS pos", "c_nationkey", "l_partkey", "s_name",
        "p_name || ' ' || CAST(p_partkey % 200 AS STRING) AS part", "nation", "p_brand",
    )


def _each(rows: DataFrame, records: list[tuple[str, ...]], names: tuple[str, ...]) -> DataFrame:
    """One row of lines() as several: the joins below run once."""
    wide = rows.selectExpr("*", f"{_CHUNK} AS chunk_id", f"{_DOC} AS doc_id", f"{_SUPPLIER} AS supplier", "CASE WHEN l_partkey % 4 = 0 THEN 'OTHER' ELSE 'ORGANIZATION' END AS supplier_type")
    structs = ", ".join("struct(" + ", ".join(f"{x} AS {n}" for x, n in zip(r, names, strict=True)) + ")" for r in records)
    return wide.selectExpr("record_no", "chunk_id", "doc_id", f"inline(array({structs}))")


def mentions_of(rows: DataFrame) -> DataFrame:
    """mentions() of lines()."""
    ships, goes = "supplier || ' ships ' || part || '.'", "part || ' goes to ' || nation || '.'"
    records = [
        ("pos", "supplier", "supplier_type", "'supplies ' || part", ships, "false"),
        ("pos + 1", "part", "'PRODUCT'", "'a ' || p_brand || ' part'", ships, "false"),
        ("pos + 2", "nation", "'LOCATION'", "'buys ' || part", goes, "false"),
    ]
    return _each(rows, records, ("pos", "name", "type", "description", "source_sentence", "stub"))


def relations_of(rows: DataFrame) -> DataFrame:
    """relations() of lines()."""
    ships, goes = "supplier || ' ships ' || part || '.'", "part || ' goes to ' || nation || '.'"
    records = [
        ("pos", "supplier", "CASE WHEN l_partkey % 50 = 7 THEN 'Ghost ' || part ELSE part END", "'SUPPLIES'", "'supply of ' || part", ships),
        ("pos + 1", "part", "nation", "'SOLD_IN'", "'sale of ' || part", goes),
        ("pos + 2", "supplier", "CASE WHEN l_partkey % 70 = 3 THEN supplier ELSE nation END", "'SHIPS_TO'", "'shipping'", ships),
    ]
    return _each(rows, records, ("pos", "source", "target", "type", "description", "source_sentence"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_no, pos, chunk_id, doc_id, name, type, description, source_sentence, stub."""
    return mentions_of(lines(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_no, pos, chunk_id, doc_id, source, target, type, description, source_sentence."""
    return relations_of(lines(spark, sf_dir))


def oracle_views() -> str:
    """CTEs `ents` and `rels` for DuckDB."""
    names = {t: t for t in _TABLES}
    return f"ents AS ({MENTIONS_SQL.format(**names)}), rels AS ({RELATIONS_SQL.format(**names)})"


#: A second graph, of several components: customers and suppliers at their nations, these in their regions. A nation
#: stands in the documents of its people, and as a plural in the one on geography, which holds its edge to the region.
PEOPLE_SQL = """
SELECT c_custkey AS record_no, CAST(0 AS BIGINT) AS pos, 'customer-' || CAST(c_custkey AS VARCHAR(20)) AS chunk_id, 'segment-' || lower(c_mktsegment) AS doc_id, c_name AS name, 'PERSON' AS type, 'buys' AS description, c_name || ' lives in ' || n_name || '.' AS source_sentence FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey, CAST(1 AS BIGINT), 'customer-' || CAST(c_custkey AS VARCHAR(20)), 'segment-' || lower(c_mktsegment), n_name, 'LOCATION', 'home', c_name || ' lives in ' || n_name || '.' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT 10000000000 + s_suppkey, CAST(0 AS BIGINT), 'supplier-' || CAST(s_suppkey AS VARCHAR(20)), 'suppliers', s_name, 'ORGANIZATION', 'sells', s_name || ' sells in ' || n_name || '.' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT 10000000000 + s_suppkey, CAST(1 AS BIGINT), 'supplier-' || CAST(s_suppkey AS VARCHAR(20)), 'suppliers', n_name, 'LOCATION', 'market', s_name || ' sells in ' || n_name || '.' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT 20000000000 + n_nationkey, CAST(0 AS BIGINT), 'nation-' || CAST(n_nationkey AS VARCHAR(20)), 'geography', r_name, 'LOCATION', 'region', n_name || ' lies in ' || r_name || '.' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 20000000000 + n_nationkey, CAST(1 AS BIGINT), 'nation-' || CAST(n_nationkey AS VARCHAR(20)), 'geography', n_name || 's', 'LOCATION', 'people', n_name || ' lies in ' || r_name || '.' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

PLACES_SQL = """
SELECT c_custkey AS record_no, CAST(0 AS BIGINT) AS pos, 'customer-' || CAST(c_custkey AS VARCHAR(20)) AS chunk_id, 'segment-' || lower(c_mktsegment) AS doc_id, c_name AS source, n_name AS target, 'LIVES_IN' AS type, 'home' AS description, c_name || ' lives in ' || n_name || '.' AS source_sentence FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT 10000000000 + s_suppkey, CAST(0 AS BIGINT), 'supplier-' || CAST(s_suppkey AS VARCHAR(20)), 'suppliers', s_name, n_name, 'SELLS_IN', 'market', s_name || ' sells in ' || n_name || '.' FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT 20000000000 + n_nationkey, CAST(0 AS BIGINT), 'nation-' || CAST(n_nationkey AS VARCHAR(20)), 'geography', n_name, r_name, 'PART_OF', 'region', n_name || ' lies in ' || r_name || '.' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

_PEOPLE_TABLES = ("customer", "supplier", "nation", "region")


def people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(mentions, relationships) of the second graph."""
    given = {t: table(spark, sf_dir, t) for t in _PEOPLE_TABLES}
    return spark.sql(PEOPLE_SQL, **given).withColumn("stub", F.lit(False)), spark.sql(PLACES_SQL, **given)


def people_views() -> str:
    """CTEs `ents` and `rels` of the second graph for DuckDB."""
    names = {t: t for t in _PEOPLE_TABLES}
    return f"ents AS ({PEOPLE_SQL.format(**names)}), rels AS ({PLACES_SQL.format(**names)})"


def records(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Extraction records: a row for each chunk with its ordered entities and relationships."""
    e = ents.groupBy("record_no", "chunk_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type", "description", "source_sentence", "stub"))).alias("entities"))
    r = rels.groupBy("record_no").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "target", "type", "description", "source_sentence"))).alias("relationships"))
    return e.join(r, "record_no", "left")
