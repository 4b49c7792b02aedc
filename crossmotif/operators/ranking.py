"""Score kernels of candidates, per-query selection, rerank and coverage orders.

``candidates`` rows are (anchor, candidate_type, nodes, edges); the anchor names the query,
a motif of three nodes and three edges.
"""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect

CLOSED = "('triangle', 'cycle4', 'directed_cycle', 'feed_forward', 'dense_subgraph', 'dense_hyperlink_block')"
# Additions by candidate type.
BONUS = {
    "triangle": 0.10, "cycle4": 0.10, "directed_cycle": 0.10, "feed_forward": 0.10, "dense_subgraph": 0.08, "dense_hyperlink_block": 0.08,
    "multi_partition_bridge": 0.12, "query_edge_evidence": 3.00, "directed_chain": 0.04, "directed_star": 0.02, "chain": 0.03, "star": 0.02, "fan_in": 0.02, "fan_out": 0.02,
}
BOOSTED = {"directed_cycle": 0.16, "dense_hyperlink_block": 0.18, "directed_chain": 0.16, "directed_star": 0.10}
CAP, COVER = 24, 1000


def _bonus(boosted: bool = False) -> str:
    table = BONUS | (BOOSTED if boosted else {})
    return "CASE " + " ".join(f"WHEN candidate_type = '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0.0 END"


def kernels(d: SparkDialect, source: str = "{candidates}", qn: int = 3, qm: int = 3, boosted: bool = False) -> str:
    """Candidates with their size, party and shape kernels."""
    size = lambda c: f"CAST({d.size(d.split_text(c))} AS BIGINT)"
    long = d.unnest(f"(SELECT anchor, candidate_type, nodes, edges, {d.split_text('nodes')} AS parts FROM {source}) s", "parts", "part")
    rows = f"""SELECT x.anchor, x.candidate_type, x.nodes, x.edges, count(DISTINCT p.party) AS parties, {size('x.nodes')} AS n, {size('x.edges')} AS m
        FROM (SELECT anchor, candidate_type, nodes, edges, part FROM {long}) x LEFT JOIN {{node_party}} p ON x.part = p.node
        GROUP BY x.anchor, x.candidate_type, x.nodes, x.edges"""
    if d.name == "spark":  # candidates are distinct: only sets of nodes, each once, meet the parties
        long = d.unnest(f"(SELECT nodes, {d.split_text('nodes')} AS parts FROM (SELECT DISTINCT nodes FROM {source}) o) s", "parts", "part")
        known = f"SELECT x.nodes, count(DISTINCT p.party) AS parties FROM (SELECT nodes, part FROM {long}) x JOIN {{node_party}} p ON x.part = p.node GROUP BY x.nodes"
        rows = f"""SELECT c.anchor, c.candidate_type, c.nodes, c.edges, coalesce(k.parties, 0) AS parties, {size('c.nodes')} AS n, {size('c.edges')} AS m
            FROM (SELECT anchor, candidate_type, nodes, edges FROM {source}) c LEFT JOIN ({known}) k ON c.nodes = k.nodes"""
    ratio = lambda c, q: f"CAST(least({c}, {q}) AS DOUBLE) / greatest({c}, {q})"
    density = "least(1.0, CAST(m AS DOUBLE) / greatest(1, n))"
    return f"""SELECT r.*, ({ratio('n', qn)} + {ratio('m', qm)}) / 2.0 AS structural, least(1.0, CAST(m AS DOUBLE) / greatest(1, n - 1)) AS compactness,
        least(1.0, parties / CAST(2 AS DOUBLE)) AS cross_support, CASE WHEN parties <= 2 THEN 0.0 ELSE least(1.0, (parties - 2) / CAST(3 AS DOUBLE)) END AS multi_party,
        CASE WHEN n <= 2 THEN CASE WHEN m <= 1 THEN 0.0 ELSE 0.25 END WHEN candidate_type IN {CLOSED} THEN least(1.0, {density} + 0.25) ELSE {density} END AS closure,
        {_bonus(boosted)} AS type_bonus,
        CASE WHEN m <= 1 THEN 0.18 WHEN candidate_type = 'dense_hyperlink_block' THEN greatest(0.0, 0.04 * (n - 6)) WHEN candidate_type = 'directed_chain' THEN CASE WHEN m BETWEEN 2 AND 5 THEN 0.0 ELSE 0.04 END
             WHEN candidate_type = 'directed_cycle' THEN CASE WHEN m BETWEEN 3 AND 5 THEN 0.0 ELSE 0.05 END WHEN candidate_type = 'feed_forward' THEN CASE WHEN m >= 3 THEN 0.03 ELSE 0.08 END ELSE 0.0 END AS size_penalty
        FROM ({rows}) r"""


def _raw() -> str:
    return "CAST(structural + compactness + cross_support + 0.5 * multi_party + closure + type_bonus - size_penalty AS DOUBLE)"


def _final() -> str:
    return "CAST(0.30 * structural + 0.16 * compactness + 0.24 * cross_support + 0.16 * multi_party + 0.22 * closure + CASE WHEN anchor <> '' THEN 0.06 ELSE 0.0 END + type_bonus - size_penalty AS DOUBLE)"


def scored(d):
    """Relation of candidates with raw and final scores, rounded so that orders do not hang on the last bit."""
    return f"SELECT k.*, round({_raw()}, 9) AS raw_score, round({_final()}, 9) AS score FROM ({kernels(d)}) k"


def candidate_scores(d):
    return """SELECT anchor, candidate_type, nodes, edges, round(structural, 6) AS structural, round(CAST(compactness AS DOUBLE), 6) AS compactness, round(cross_support, 6) AS cross_support,
        round(CAST(multi_party AS DOUBLE), 6) AS multi_party, round(CAST(closure AS DOUBLE), 6) AS closure, round(raw_score, 6) AS raw_score, round(score, 6) AS score FROM {scored}"""


PRIORITY = "CASE WHEN candidate_type = 'triangle' THEN 0 ELSE 1 END"


def _top(k: int = CAP) -> str:
    return f"SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY anchor ORDER BY raw_score DESC, {PRIORITY}, candidate_type, edges, nodes) AS rn FROM {{scored}} s) t WHERE rn <= {k}"


def topk_per_query(d):
    """The best of each query by raw score, type priority, type and edges. The cap is the operator's own."""
    return f"SELECT anchor, candidate_type, nodes, edges, round(raw_score, 6) AS raw_score, CAST(rn AS BIGINT) AS rn FROM ({_top()}) t"


def _ranked(d: SparkDialect) -> str:
    return d.ranked(_top(), "score DESC, anchor, candidate_type, edges, nodes", "place")


def rerank(d):
    """Weighted rerank of the selected candidates."""
    return f"SELECT anchor, candidate_type, nodes, edges, round(score, 6) AS score, CAST(place AS BIGINT) AS place FROM ({_ranked(d)}) r"


def query_coverage(d, cap: int = 1, top_k: int = COVER):
    """The first ``cap`` of each query come first while they fit in the prefix, the others follow by score."""
    turns = f"SELECT r.*, row_number() OVER (PARTITION BY anchor ORDER BY place) AS turn FROM ({_ranked(d)}) r"
    front = d.ranked(f"SELECT place AS own FROM ({turns}) t WHERE turn <= {cap}", "own", "nth")
    fronted = f"SELECT t.*, CASE WHEN f.nth <= {top_k} THEN 0 ELSE 1 END AS later FROM ({turns}) t LEFT JOIN ({front}) f ON t.place = f.own"
    return f"SELECT anchor, candidate_type, nodes, edges, CAST(final_place AS BIGINT) AS place FROM ({d.ranked(fronted, 'later, place', 'final_place')}) o"


def _types(d: SparkDialect, rows: str) -> str:
    """Rows with their place among those of their type and the place of the type's first; no task holds a whole type."""
    by_type = d.ranked(rows, "candidate_type, place", "typed")
    leads = f"SELECT candidate_type AS kind, min(typed) AS first_typed, min(place) AS lead_place FROM ({by_type}) b GROUP BY candidate_type"
    return f"SELECT s.*, s.typed - l.first_typed + 1 AS turn, l.lead_place FROM ({by_type}) s JOIN ({leads}) l ON s.candidate_type = l.kind"


def diverse_order(d):
    """Types take turns, the type with the best first candidate leading."""
    turns = _types(d, _ranked(d))
    return f"SELECT anchor, candidate_type, nodes, edges, CAST(diverse AS BIGINT) AS place FROM ({d.ranked(turns, 'turn, lead_place', 'diverse')}) t"


def hybrid_order(d, prefix: int = 100):
    """A prefix by score, then the others in diverse order."""
    turns = _types(d, f"SELECT * FROM ({_ranked(d)}) r WHERE place > {prefix}")
    tail = f"SELECT place AS old, nth FROM ({d.ranked(turns, 'turn, lead_place', 'nth')}) t"
    return f"""SELECT r.anchor, r.candidate_type, r.nodes, r.edges, CAST(coalesce({prefix} + t.nth, r.place) AS BIGINT) AS place FROM ({_ranked(d)}) r LEFT JOIN ({tail}) t ON r.place = t.old"""


DEFINITIONS = {f.__name__: f for f in (candidate_scores, topk_per_query, rerank, query_coverage, diverse_order, hybrid_order)}
