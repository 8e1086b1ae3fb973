"""Registered queries against DuckDB on the small tables."""

import duckdb
import pytest

from strandloom.plans import registry

SF = "/root/testdata/sf0.001"
FAST = ["class_counts", "division_rows", "reads_profile", "symbol_counts", "mean_quality_prob", "geo_mean_quality", "reverse_complement", "duplicate_chain", "overlap_l80", "kmer_occurrences", "kmer_counts", "asof_read", "coprime_match", "match_histogram", "mismatch_codes", "rev_offset_delta", "mismatch_cumsum", "offset_delta", "position_cumsum", "pair_offset_u8", "pair_pos_u16", "mem_islands", "interval_contains", "interval_running_end", "mismatch_groups", "varint_size", "component_counts", "pg_slice"]


def rows(values, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["class"]: r["n"] for r in e.entry(spark).collect()} == {"HQ": 5173, "LQ": 707, "N": 120}
    assert set(e.oracle_sql()) <= set(e.queries())
