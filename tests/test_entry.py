"""The driver contract: entry, queries and SQL agree on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_file

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def normal(records):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x
    return sorted(repr([clean(v) for v in r]) for r in records)


@needs_data
def test_entry(spark):
    assert entry_file.entry(spark).count() > 0


def test_names():
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())


@needs_data
@pytest.mark.parametrize("name", ["aai_pairs", "interval_coverage", "weighted_lca", "outer_summary", "virus_call", "weighted_identity", "vector_argmax", "set_except", "msa_intersection", "evidence_precedence", "cluster_propagate", "msa_union", "tetranuc_freq", "self_similarity_pairs", "similarity_search", "host_by_fitted_density", "sentence_scores", "shared_cluster_network", "cluster_keywords", "genome_profiles", "cached_intermediate"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"create view {p.split('.')[0]} as select * from '{SF}/{p}'")
    got = entry_file.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry_file.oracle_sql()[name]})").fetchall()
    assert normal(map(list, want)) == normal([list(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()])
