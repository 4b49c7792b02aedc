"""Evidence of the first rows of each tag, and the reach of accounts in their own party's view, against plain versions."""

import random

import pytest

from crossmotif.functions.dialect import DUCK, SPARK
from crossmotif.operators import evidence, local_views
from crossmotif.plans.catalog import DERIVED
from crossmotif.plans.relational import BUILDERS, names_in, run


def plain(kind):
    """The definition as the reference spells it, on Spark."""
    return lambda d: kind(type("Plain", (type(SPARK),), {"name": "plain"})())


def transactions(spark, seed, nodes=14, rows=45, days=3, unknown=()):
    draw = random.Random(seed)
    made = []
    for i in range(rows):  # repeats and both directions occur
        a, b = draw.sample(range(nodes), 2)
        made.append((f"e{i:03}", f"v{a}", f"v{b}", f"2020-01-0{1 + draw.randrange(days)} {draw.randrange(24):02}:00:00", draw.uniform(1, 5e5), draw.choice("xy"), draw.choice("FO"), i))
    flow = spark.createDataFrame(made, "edge_id string, src string, dst string, ts string, weight double, pay_format string, currency string, ord long").selectExpr(
        "edge_id", "src", "dst", "cast(ts as timestamp) as ts", "weight", "pay_format", "currency", "ord")
    party = spark.createDataFrame([(f"v{i}", None if i in unknown else f"P{i % 3}") for i in range(nodes)], "node string, party string")
    rel = {"flow": flow, "node_party": party}
    rel["tagged"] = run(spark, evidence.tagged, rel)
    rel["views"] = run(spark, evidence.local_edges, rel)
    return rel


def rows(spark, kind, rel):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in run(spark, kind, rel).collect())


@pytest.mark.parametrize("unknown", [(), (3, 4)])
def test_reach_is_that_of_the_masked_views(spark, unknown):
    """Accounts without a party are seen by partners but lead nowhere."""
    rel = transactions(spark, 5, unknown=unknown)
    want = rows(spark, plain(evidence.node_stats), rel)
    assert rows(spark, evidence.node_stats, rel) == want and len({r[5] for r in want}) > 2
    ids = local_views.account_ids(rel["tagged"])
    some = spark.createDataFrame([("P0", "v0"), ("P1", "v7"), ("P1", "v7"), ("P2", "v7")], "bank string, node string")
    got = local_views.local_reach(local_views.account_links(rel["tagged"], ids), ids, some)
    assert sorted(tuple(r) for r in got.collect()) == [r for r in want if r[:2] in {("P0", "v0"), ("P1", "v7")}]


def test_joins_by_tag_count_reach_for_the_rows_they_read(spark):
    """Five rows of a tag and role are read, so no more accounts are counted, however many rows a tag has."""
    rel = transactions(spark, 8, nodes=200, rows=150, days=9)
    whole = rel | {"evidence": run(spark, evidence.evidence_features, rel)}
    rel["top_rows"] = run(spark, evidence.top_rows, rel)
    assert 0 < rel["top_rows"].count() < whole["evidence"].count()
    asked = []
    reach = local_views.local_reach
    try:
        local_views.local_reach = lambda links, ids, wanted: asked.append(wanted.distinct().count()) or reach(links, ids, wanted)
        rel["top_evidence"] = run(spark, evidence.top_evidence, rel)
    finally:
        local_views.local_reach = reach
    assert asked == [rel["top_rows"].select("bank", "node").distinct().count()]
    assert asked[0] < whole["evidence"].select("bank", "node").distinct().count()
    for kind in (evidence.pair_scores, evidence.mutual, evidence.tag_buckets):
        assert rows(spark, kind, rel) == rows(spark, plain(kind), whole) != []
        assert "{evidence}" not in kind(SPARK) and "{evidence}" in kind(DUCK)


def test_pair_scores_has_every_pair_of_a_tag(spark, monkeypatch):
    """A tag with more than five rows keeps them all, also where its senders are dealt into parts."""
    rel = transactions(spark, 6, nodes=40, rows=120, days=2)
    whole = rel | {"evidence": run(spark, evidence.evidence_features, rel)}
    inter = rel["tagged"].where("is_inter").select("tag", "edge_id", "src_party", "dst_party").collect()
    want = sorted((a.tag, a.edge_id, b.edge_id) for a in inter for b in inter if a.tag == b.tag and a.src_party != b.dst_party)
    for senders in (500, 3):
        monkeypatch.setattr(evidence, "SENDERS", senders)
        got = rows(spark, evidence.pair_scores, rel)
        assert sorted((r[0], r[3], r[4]) for r in got) == want and len(want) > 4 * 25
        assert got == rows(spark, plain(evidence.pair_scores), whole)


@pytest.mark.parametrize("query", [evidence.rerank_evidence, evidence.cycle_pairs, evidence.mutual_topk])
def test_assembled_candidates_read_no_evidence_of_all_rows(query):
    seen, todo = set(), names_in(query(SPARK))
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += BUILDERS[name][0] if name in BUILDERS else names_in(DERIVED[name](SPARK)) if name in DERIVED else ["mutual"] if name == "chains" else []
    assert {"top_evidence", "reach_top"} <= seen
    assert not seen & {"evidence", "views", "reach_local"}
