"""The driver contract on the smallest tables, compared with the reference SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["flow_edges", "degree_tables", "motif_fan_in", "motif_triangle", "ranked_fan_in", "label_merge", "perturb_missing", "subgraph_match", "search_space", "graphsage", "packed_party", "method_view", "payment_chains", "core_numbers", "sampled_instances", "key_report"]


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple(None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out, key=lambda t: tuple("" if v is None else v for v in t))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_reference(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
