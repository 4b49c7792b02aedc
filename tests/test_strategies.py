"""The strategy table against a plain evaluation of each prefix."""

import random

from crossmotif.operators import strategies


def plain(order, truth, pool):
    out = {}
    hit = lambda r: {g for g, _, e in truth if set(e.split(",")) & set(r[2].split(","))}
    kind = {g: t for g, t, _ in truth}
    order = sorted(order)
    for k in (10, 20, 50, 100, 200):
        top = order[:k]
        found = set().union(*map(hit, top))
        if k <= 100:
            out[f"p_at_{k}"] = sum(bool(hit(r)) for r in top) / len(top) if top else 0.0
            out[f"r_at_{k}"] = len(found) / len(truth) if truth else 0.0
        if k >= 100:
            out[f"motif_hits_at_{k}"] = float(len(found))
        if k == 100:
            out["candidate_types_at_100"] = len({t for _, t, _ in top}) / len({t for t, *_ in pool}) if pool else 0.0
            out["motif_types_at_100"] = len({kind[g] for g in found}) / len(set(kind.values())) if kind else 0.0
    return {m: round(v, 6) for m, v in out.items()}


def test_table_equals_a_plain_evaluation(spark):
    """Strategies of 230 and 37 candidates and none, repeated edges in a candidate, motifs that share edges."""
    rng = random.Random(4)
    edges = lambda n: ",".join(f"e{rng.randrange(400)}" for _ in range(n))
    pool = [(rng.choice("ABCD"), edges(rng.randint(1, 4))) for _ in range(230)] + [("E", "none")]
    truth = [(i, rng.choice(["x", "y", "z"]), edges(3)) for i in range(1, 25)]
    orders = {"raw": [(i, *c) for i, c in enumerate(pool, 1)], "base": [(i, *c) for i, c in enumerate(rng.sample(pool, 37), 1)], "diverse": []}
    frame = lambda rows: spark.createDataFrame(rows, "place long, candidate_type string, edges string")
    gold = spark.createDataFrame(truth, "gt_pos long, motif_type string, edges string")
    kinds = spark.createDataFrame(pool, "candidate_type string, edges string")
    table = strategies.strategy_table({n: frame(r) for n, r in orders.items()}, gold, kinds)
    got = {r.strategy: {m: r[m] for m in strategies.METRICS} for r in table.collect()}
    assert got == {n: plain(r, truth, pool) for n, r in orders.items()}
    turned = {r.metric: r for r in strategies.long_table(table).collect()}
    assert set(turned) == set(strategies.METRICS) and all(turned[m].raw == got["raw"][m] and turned[m].hybrid is None for m in turned)
    empty = strategies.strategy_table({"raw": frame(orders["raw"])}, gold.limit(0), kinds.limit(0)).first()
    assert all(empty[m] == 0 for m in strategies.METRICS)
