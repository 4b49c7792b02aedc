"""Counts over gathered lists, against the joins of the reference."""

import random

import pytest

from crossmotif.functions.dialect import DUCK, SPARK
from crossmotif.operators import baselines, evaluate, experiments, gathered, graph, prepare, vectors
from crossmotif.plans.relational import run
from crossmotif.sources import graph_tables
from tests.test_closing import ranked_lists
from tests.test_operators import tables

PLAIN = type("Plain", (type(SPARK),), {"name": "plain"})()


def same(spark, kind, rel):
    rows = lambda f: sorted(tuple(r) for r in run(spark, f, rel).collect())
    assert rows(kind) == rows(lambda d: kind(PLAIN)) != []


@pytest.mark.parametrize("nodes, edges, wide", [(9, 60, 1 << 22), (14, 60, 5)])
def test_enclosing_counts_join_no_balls(spark, monkeypatch, nodes, edges, wide):
    """Dense and sparse graphs, a loop on a node; the ball of a pair is never a row."""
    monkeypatch.setattr(gathered, "WIDE", wide)
    rel = tables(spark, [*ranked_lists(nodes, nodes, edges), ("v1", "v1", 1)])
    same(spark, graph.enclosing_counts, rel)
    same(spark, baselines.seal, rel)
    assert "{enclosed}" in baselines.seal(SPARK) and "{enclosed}" not in baselines.seal(DUCK)


@pytest.mark.parametrize("nodes, edges", [(9, 60), (40, 90)])
def test_lists_of_first_neighbours_meet_in_place(spark, nodes, edges):
    rel = tables(spark, [*ranked_lists(nodes, nodes, edges), ("v1", "v1", 1), ("v1", "v77", 1)])
    same(spark, baselines.fanmod, rel)
    assert "DISTINCT c, x, y" not in baselines.fanmod(SPARK) and "DISTINCT c, x, y" in baselines.fanmod(DUCK)


def test_triangles_and_their_edges_are_met_once(spark):
    draw = random.Random(4)
    edges = [tuple(str(v) for v in draw.sample(range(15), 2)) for _ in range(60)]  # "10" sorts before "9"
    rel = tables(spark, [(a, b, 1) for a, b in edges] + [("3", "3", 1)])
    same(spark, evaluate.ground_truth, rel)
    rel["ground_truth"] = run(spark, evaluate.ground_truth, rel)
    want = [(r.gt_pos, f"qe{i}", e) for r in rel["ground_truth"].collect() for i, e in enumerate(sorted(r.edges.split(",")))]
    assert sorted(tuple(r) for r in run(spark, prepare.sanitize_queries, rel).collect()) == sorted(want)
    assert "{triangles}" in evaluate.ground_truth(SPARK) and "row_number" not in prepare.sanitize_queries(SPARK)


@pytest.mark.parametrize("size", [1024, 3])
def test_vectors_meet_by_blocks(spark, monkeypatch, size):
    """Frequent and rare labels, a repeated id, vectors that are null, hold a null or are shorter."""
    monkeypatch.setattr(vectors, "STRIP", 2)
    draw = random.Random(6)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)], 0 if i < 12 else i % 4) for i in range(24)]
    rows += [(3, [1.0, 2.0, 3.0, 4.0], 0), (40, None, 0), (41, [1.0, None, 2.0, 3.0], 0), (42, [1.0, 2.0], 0), (43, [1.0, 1.0, 1.0, 1.0], None)]
    rel = {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)}
    rel["label_pairs"] = vectors.label_pairs(rel["embeddings"], size)
    assert "{label_pairs}" in graph.vector_pairs(SPARK)
    rows = lambda f: sorted((tuple(r) for r in run(spark, f, rel).collect()), key=repr)
    assert rows(graph.vector_pairs) == rows(lambda d: graph.vector_pairs(PLAIN)) != []


def test_parts_bought_together_are_dealt_to_as_many_tasks_as_pairs_need(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(30), draw.randrange(20)) for _ in range(200)] + [(None, 1), (None, 2), (1, None)]
    rel = {"lineitem": spark.createDataFrame(rows, "l_orderkey long, l_partkey long").repartition(3)}
    same(spark, experiments.co_purchase, rel)
    assert graph_tables.bought_together(rel["lineitem"], 20).rdd.getNumPartitions() > 4
