"""Core numbers against peeling; every sampled instance against the graph."""

import os
import random
from collections import Counter

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from crossmotif import runtime
from crossmotif.functions.dialect import SPARK
from crossmotif.operators import evaluate, gathered, samplers
from crossmotif.plans.catalog import relations
from crossmotif.plans.relational import run
from tests.test_operators import tables

SF = "/root/testdata/sf0.001"


def plain_cores(links):
    core, k = {}, 0
    left = {x: set(n) for x, n in links.items()}
    while left:
        low = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[low]))
        core[low] = k
        for y in left.pop(low):
            left[y].discard(low)
    return core


def test_cores_equal_peeling(spark):
    """A clique, a hub with bare ends, random edges, repeats both ways, loops and nulls."""
    rng = random.Random(12)
    edges = [(f"c{i}", f"c{j}") for i in range(6) for j in range(i)] + [("hub", f"t{i}") for i in range(40)] + [("hub", "c1")]
    edges += [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(90)] + [(f"n{i}", f"c{i}") for i in range(4)]
    links = {}
    for a, b in edges:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    rows = [*edges, *[(b, a) for a, b in edges[:30]], ("hub", "hub"), ("alone", "alone"), (None, "c1"), ("c1", None)]
    found = samplers.core_numbers(spark.createDataFrame(rows, "a string, b string").repartition(3)).collect()
    assert {r.node: r.core for r in found} == plain_cores(links) and len(found) == len(links)
    assert samplers.core_numbers(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
def test_instances_are_what_they_are_called(spark):
    rows = entry.queries()["sampled_instances"](spark, SF).collect()
    pairs = {r.edge_id: {r.a, r.b} for r in relations(spark, SF, ["pair_und"])["pair_und"].collect()}
    party = {r.node: r.party for r in relations(spark, SF, ["node_party"])["node_party"].collect()}
    inside = {"triangle": 3, "cycle4": 4, "star": samplers.SIZE - 1}
    for r in rows:
        nodes, edges = r.nodes.split(","), [pairs[e] for e in r.edges.split(",")]
        degree = Counter(x for e in edges for x in e)
        assert set(degree) <= set(nodes) and len(set(nodes)) == len(nodes) and len(edges) == len(set(map(frozenset, edges)))
        assert r.parties == len({party[x] for x in nodes})
        assert len(edges) == inside[r.kind] if r.kind in inside else len(nodes) == samplers.SIZE and len(edges) >= samplers.SIZE
        if r.kind in ("triangle", "cycle4"):
            assert set(degree.values()) == {2}
        if r.kind == "star":
            assert degree[nodes[0]] == samplers.SIZE - 1
    for kind, n in Counter(r.kind for r in rows).items():
        mine = sorted((r for r in rows if r.kind == kind), key=lambda r: r.rn)
        assert [r.rn for r in mine] == list(range(1, n + 1)) and n <= samplers.EACH
        crossing = [r.parties >= 2 for r in mine]
        assert crossing == sorted(crossing, reverse=True)
        assert len({r.nodes for r in mine}) == n
    assert {"triangle", "star"} <= {r.kind for r in rows}


@pytest.mark.parametrize("each", [1 << 18, 7])
def test_values_are_told_in_arrays(spark, each):
    """A link is a row only while links are numbered: later rounds shuffle no more rows than there are parts of nodes a batch."""
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(500)} | {(0, i) for i in range(1, 60)}
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    told = []
    plain = samplers._told(3)
    rows = pa.RecordBatch.from_arrays([pa.array([4, 4, 9]), pa.array([[1, 2, 5], [2, 4], [1, 2]])], names=["core", "items"])
    for batch in plain([rows]):
        told += batch.to_pylist()
    assert [(r["part"], r["node"], r["value"], r["n"]) for r in told] == [(1, [1, 1, 4], [4, 9, 4], [1, 1, 1]), (2, [2, 2, 5], [4, 9, 4], [2, 1, 1])]
    found = samplers.core_numbers(spark.createDataFrame(sorted(edges), "a long, b long"), each).collect()
    assert {r.node: r.core for r in found} == plain_cores(links)


@pytest.mark.parametrize("long", [2000, 4])
def test_instances_equal_the_reference_without_its_joins(spark, long):
    """A dense and a sparse part, a clique, nodes of no known party; with ``long`` 4 nearly every corner counts as a hub."""
    rng = random.Random(7)
    edges = [tuple(str(x) for x in rng.sample(range(16), 2)) for _ in range(60)] + [tuple(str(x) for x in rng.sample(range(30, 80), 2)) for _ in range(70)]
    edges += [(f"9{i}", f"9{j}") for i in range(6) for j in range(i)]
    rel = tables(spark, [(a, b, 1) for a, b in edges])
    rel["node_party"] = rel["node_party"].where("node not in ('3', '35', '91')")
    rel["cores"] = samplers.core_numbers(rel["pair_und"])
    rel["ground_truth"] = run(spark, evaluate.ground_truth, rel)
    found = gathered.triangles(gathered.link_ids(rel["links"], ids := runtime.stored(gathered.node_ids(rel["links"]), "ids")), ids, rel["pair_und"])
    rel["instances"] = samplers.instances(rel["links"], rel["cores"], rel["pair_und"], rel["node_party"], found, long)
    rows = lambda f: sorted(tuple(r) for r in run(spark, f, rel).collect())
    plain = type("Plain", (type(SPARK),), {"name": "plain", "hash48": lambda self, x: SPARK.hash48(x)})()
    got = rows(samplers.sampled_instances)
    assert got == rows(lambda d: samplers.sampled_instances(plain).replace("VARCHAR", "STRING")) and {r[0] for r in got} == {"triangle", "cycle4", "star", "dense_subgraph"}
    assert "JOIN" not in samplers.sampled_instances(SPARK)
