"""Registered queries against their SQL on the smallest tables."""

import os
from glob import glob

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["t1_sliding_window", "x4_endpoint_filter", "x8_gleaning_merge", "g3_node_dedup", "g6_parallel_edges", "g7_alias_edges", "a4_distances", "v1_hybrid", "q1_flat_hybrid", "e6_candidate_pairs", "m3_retrieval_benchmark", "f1_toon",
    "x1_retry_ladder", "x11_placeholders", "x12_valid_nodes", "e3_ambiguous", "e4_canonical_types", "a5_components", "a7_empty_counts", "a15_alias_groups", "v6_scoped_hybrid", "q2_structural_mentions", "q4_global_store", "q8_query_focused", "q9_on_demand",
    "v1_postings", "v6_scoped_postings", "v6_scoped_hybrid", "g3_node_segments", "g6_edge_segments", "a3_people_bfs", "a5_people_components", "a7_people_strict", "a12_gold_connectivity", "a14_mention_links", "e6_candidate_classes", "e7_similar_heads", "e13_people_cross_document_pairs", "q9_on_demand_list",
    "m5_both_conventions", "m18_stratum_noise", "m20_relation_differences", "m29_context_traced", "s7_entity_collection", "s12_relations_by_id"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got  # nothing against nothing would prove nothing


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_callable():
    found = __spark_entry__.queries()
    assert all(map(callable, found.values())) and set(__spark_entry__.oracle_sql()) <= set(found)
