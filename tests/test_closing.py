"""Operators that gather lists, against the walks listed one by one."""

import random

import pytest
from pyspark.sql import functions as F

from crossmotif import runtime
from crossmotif.functions.dialect import DUCK, SPARK
from crossmotif.operators import evidence, graph, motifs, ranking
from crossmotif.operators.closing import closed_walks, two_steps
from crossmotif.plans.relational import run
from tests.test_operators import tables


def ranked_lists(seed, nodes=14, edges=90):
    draw = random.Random(seed)
    pairs = [tuple(draw.sample(range(nodes), 2)) for _ in range(edges)]  # repeats and both directions occur
    return [(f"v{a}", f"v{b}", 1) for a, b in pairs]


@pytest.mark.parametrize("long", [2000, 3])
def test_closed_walks_are_those_of_the_joins(spark, long):
    rel = tables(spark, ranked_lists(long))
    near = [r.asDict() for r in rel["nbr_any"].collect()]
    links = {(r.node, r.nbr) for r in rel["links"].collect()}
    of = {}
    for r in near:
        of.setdefault(r["node"], []).append(r)
    want = set()
    for x in near:
        for y in of[x["nbr"]]:
            for z in of[y["nbr"]]:
                if y["rn"] <= 12 and z["rn"] <= 12 and y["nbr"] != x["node"] and z["nbr"] not in (x["node"], x["nbr"]) and (z["nbr"], x["node"]) in links:
                    back = sum(1 for b in of[x["nbr"]] if b["nbr"] == x["node"] and b["rn"] < y["rn"])
                    want.add((x["node"], x["rn"], y["rn"], z["rn"], x["edge_id"], y["edge_id"], z["edge_id"], back))
    got = closed_walks(rel["nbr_any"], rel["links"].select(F.col("node").alias("anchor"), F.col("nbr").alias("other")), long=long)
    rows = [(r.anchor, r.r1, r.r2, r.r3, r.e1, r.e2, r.e3, r.skipped) for r in got.collect()]
    assert want and set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("kind", [motifs.cycle4, motifs.directed_cycle])
def test_cycles_need_no_walk_as_a_row(spark, kind):
    """The lists that SQL joins three deep are joined one step at a time: no shuffle holds a walk that does not close."""
    rel = tables(spark, ranked_lists(7, 9, 40))
    plain = lambda d: kind(type("Plain", (type(SPARK),), {"name": "plain"})())  # noqa: E731  the walks of the reference text
    rows = lambda f: sorted(tuple(r) for r in run(spark, f, rel).collect())
    assert rows(kind) == rows(plain) != []
    assert "{squares}" in kind(SPARK) or "{rings}" in kind(SPARK)
    assert "{squares}" not in kind(DUCK) and "{rings}" not in kind(DUCK)


@pytest.mark.parametrize("back", [True, False])
def test_two_steps_count_distinct_nodes(spark, back):
    draw = random.Random(3)
    links = {(draw.randrange(40), draw.randrange(40)) for _ in range(160)}
    of = {}
    for a, b in links:
        of.setdefault(a, set()).add(b)
    want = {a: len(bs | {c for b in bs for c in of.get(b, ()) if back or c != a}) for a, bs in of.items()}
    got = two_steps(spark.createDataFrame(sorted(links), "a long, b long"), back)
    assert {r.key: r.n for r in got.collect()} == want


@pytest.mark.parametrize("kind", [motifs.radius2, motifs.chain, motifs.directed_chain, graph.degree_tables, evidence.node_stats])
def test_lists_give_what_the_joins_of_the_reference_give(spark, kind):
    edges = ranked_lists(11, 12, 60)
    rel = tables(spark, edges, [(f"v{i}", f"P{i % 3}") for i in range(12)])
    rel["flow"] = rel["flow"].selectExpr("*", "date'2020-01-01' as ts", "'x' as pay_format")
    rel["tagged"] = run(spark, evidence.tagged, rel)
    rel["views"] = run(spark, evidence.local_edges, rel)
    plain = lambda d: kind(type("Plain", (type(SPARK),), {"name": "plain"})())
    rows = lambda f: sorted(tuple(r) for r in run(spark, f, rel).collect())
    assert rows(kind) == rows(plain) != []
    assert any(n in kind(SPARK) for n in ("{first_", "{two_hop}", "{reach_"))


def test_places_by_ranges_need_one_shuffle_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(runtime, "SMALL_BYTES", -1)
    draw = random.Random(5)
    rows = [(draw.randrange(9), i) for i in range(500)]
    placed = runtime.with_place(spark.createDataFrame(rows, "a int, b int"), "a DESC, b", "place")
    assert [(r.a, r.b) for r in sorted(placed.collect(), key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.place for r in placed.collect()) == list(range(1, 501))
    assert "row_number()" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_scores_look_up_each_set_of_nodes_once(spark):
    rows = [("a", "t", "a,b", "e1"), ("b", "t", "a,b", "e1"), ("c", "u", "c,z", "e2"), ("d", "u", "z", "e3")]
    rel = {"candidates": spark.createDataFrame(rows, "anchor string, candidate_type string, nodes string, edges string")}
    rel["node_party"] = spark.createDataFrame([("a", "P0"), ("b", "P1"), ("c", "P1")], "node string, party string")
    plain = lambda d: ranking.kernels(type("Plain", (type(SPARK),), {"name": "plain"})())
    rows = lambda f: sorted(tuple(r) for r in run(spark, f, rel).collect())
    assert rows(ranking.kernels) == rows(plain) and [r[4] for r in rows(ranking.kernels)] == [2, 2, 1, 0]
    assert "DISTINCT nodes" in ranking.kernels(SPARK) and "DISTINCT nodes" not in ranking.kernels(DUCK)
