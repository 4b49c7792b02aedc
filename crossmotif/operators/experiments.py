"""Perturbations of the boundary, assembly variants, search-space counts and roll-ups."""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect


def _draw(d: SparkDialect, seed: str) -> str:
    """Rank of an edge in a seeded shuffle of the boundary, so that smaller rates are contained in larger ones."""
    shuffled = f"SELECT edge_id, src, dst, weight, {d.hash48(chr(39) + seed + '|' + chr(39) + ' || edge_id')} AS h FROM {{tagged}} t WHERE is_inter"
    return f"SELECT t.*, n.total FROM ({d.ranked(shuffled, 'h, edge_id', 'r')}) t CROSS JOIN (SELECT count(*) AS total FROM {{tagged}} x WHERE is_inter) n"


def _next(d: SparkDialect, seed: str, rate: float) -> str:
    """Drawn edges with the target of the next one drawn."""
    drawn = f"SELECT edge_id, src, dst, r FROM ({_draw(d, seed)}) x WHERE r <= floor(total * {rate})"
    return f"SELECT a.edge_id, a.src, b.dst AS other FROM ({drawn}) a LEFT JOIN ({drawn}) b ON b.r = a.r + 1"


def perturb_missing(d, rate: float = 0.1):
    """Edges after a share of the boundary is withheld."""
    return f"SELECT f.edge_id, f.src, f.dst FROM {{flow}} f LEFT JOIN (SELECT edge_id FROM ({_draw(d, 'missing')}) x WHERE r <= floor(total * {rate})) g ON f.edge_id = g.edge_id WHERE g.edge_id IS NULL"


def perturb_spurious(d, rate: float = 0.1):
    """The boundary with added edges that join the source of one drawn edge to the target of the next."""
    drawn = _next(d, "spurious", rate)
    return f"SELECT edge_id, src, dst FROM {{flow}} UNION ALL SELECT 'spurious_' || edge_id, src, other FROM ({drawn}) y WHERE other IS NOT NULL AND other <> src"


def perturb_endpoint(d, rate: float = 0.1):
    """A share of boundary edges has its target replaced by that of the next drawn edge."""
    drawn = _next(d, "endpoint", rate)
    return f"SELECT f.edge_id, f.src, CASE WHEN y.other IS NULL OR y.other = f.src THEN f.dst ELSE y.other END AS dst FROM {{flow}} f LEFT JOIN ({drawn}) y ON f.edge_id = y.edge_id"


def nested_rates(d):
    """Edges withheld at 10, 30 and 50 %: each set contains the one before."""
    return f"SELECT CAST(c.pct AS BIGINT) AS pct, count(*) AS withheld FROM ({_draw(d, 'missing')}) x JOIN (SELECT 10 AS pct UNION ALL SELECT 30 UNION ALL SELECT 50) c ON x.r * 100 <= x.total * c.pct GROUP BY c.pct"


def assembly_pairs(d):
    """Assembly without structure: each crossing edge alone."""
    return f"SELECT {d.set_of('src', 'dst')} AS nodes, edge_id AS edges, round(weight / 500000.0, 12) AS score FROM {{tagged}} t WHERE is_inter"


def assembly_anchor_only(d):
    """Anchor-only assembly: at most five edges of an anchor, crossing ones first. The cap is the variant's own."""
    return f"SELECT node AS anchor, {d.agg_set('edge_id')} AS edges, count(*) AS m FROM {{nbr_any}} WHERE rn <= 5 GROUP BY node"


def random_crossing(d, each: int = 200):
    """Seeded sample of crossing edges: the sample is the variant."""
    return f"SELECT edge_id, CAST(r AS BIGINT) AS r FROM ({_draw(d, 'random')}) x WHERE r <= {each}"


def ablation_orders(d):
    """Places of each candidate by final score, by raw score and by size alone."""
    text = "SELECT anchor, candidate_type, nodes, edges, n, m, raw_score, score FROM {scored}"
    for alias, order in (("by_score", "score DESC"), ("by_raw", "raw_score DESC"), ("by_size", "m DESC, n")):
        text = d.ranked(text, f"{order}, anchor, candidate_type, nodes, edges", alias)
    return f"SELECT anchor, candidate_type, nodes, edges, CAST(by_score AS BIGINT) AS by_score, CAST(by_raw AS BIGINT) AS by_raw, CAST(by_size AS BIGINT) AS by_size FROM ({text}) o"


def search_space(d):
    """Per party: nodes, boundary nodes, edges seen and edges shared with others."""
    seen = f"SELECT edge_id, src_party AS party, is_inter, src AS own FROM {{tagged}} a UNION ALL SELECT edge_id, dst_party, is_inter, dst FROM {{tagged}} b"
    return f"""SELECT party, count(DISTINCT own) AS nodes, count(DISTINCT CASE WHEN is_inter THEN own END) AS boundary_nodes, count(DISTINCT edge_id) AS edges,
        count(DISTINCT CASE WHEN is_inter THEN edge_id END) AS shared_edges FROM ({seen}) s GROUP BY party"""


def scale_rows(d):
    """Edges, nodes and crossing edges in prefixes of the input."""
    return f"""SELECT CAST(p AS BIGINT) AS pct, count(*) AS edges, count(DISTINCT src) AS sources, CAST(sum(CASE WHEN is_inter THEN 1 ELSE 0 END) AS BIGINT) AS crossing
        FROM (SELECT t.*, n.total FROM ({d.ranked('SELECT edge_id, src, ord, is_inter FROM {tagged}', 'ord, edge_id', 'r')}) t CROSS JOIN (SELECT count(*) AS total FROM {{tagged}}) n) x
        JOIN (SELECT 20 AS p UNION ALL SELECT 40 UNION ALL SELECT 60 UNION ALL SELECT 80 UNION ALL SELECT 100) c ON r * 100 <= total * p GROUP BY p"""


def seed_stats(d):
    """Mean and sample deviation over three seeds of the crossing share under hashed parties; zero for a single seed."""
    parts = " UNION ALL ".join(
        f"""SELECT '{s}' AS seed, avg(CASE WHEN {d.hash48(f"'{s}|' || src")} % 5 <> {d.hash48(f"'{s}|' || dst")} % 5 THEN 1.0 ELSE 0.0 END) AS share FROM {{flow}}""" for s in (0, 1, 2))
    return f"SELECT count(*) AS seeds, round(avg(share), 6) AS mean_share, round(coalesce(stddev_samp(share), 0.0), 6) AS std_share FROM ({parts}) s"


def dataset_statistics(d):
    return """SELECT (SELECT count(*) FROM {node_set}) AS nodes, count(*) AS edges, count(DISTINCT currency) AS currencies, round(avg(weight), 4) AS mean_weight,
        (SELECT count(DISTINCT party) FROM {node_party}) AS parties FROM {flow}"""


def co_purchase(d):
    """Unordered pairs of parts that share an order, with how many orders they share."""
    if d.name == "spark":
        return "SELECT a, b, orders FROM {bought_together}"
    parts = "SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem}"
    return f"SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS orders FROM ({parts}) x JOIN ({parts}) y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY x.l_partkey, y.l_partkey"


DEFINITIONS = {f.__name__: f for f in (
    perturb_missing, perturb_spurious, perturb_endpoint, nested_rates, assembly_pairs, assembly_anchor_only, random_crossing, ablation_orders, search_space, scale_rows, seed_stats,
    dataset_statistics, co_purchase)}
