"""Anchor motif generators: joins of ranked neighbour lists with a first-match rule.

Every node with neighbours serves as an anchor. Each definition returns (anchor,
candidate_type, nodes, edges): sorted distinct ids joined by commas. A loop that stops at its
first hit is ``row_number() = 1`` over the ranks of the lists it walks.
"""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect
from crossmotif.sources.graph_tables import NEIGHBOURS

K, HALF = NEIGHBOURS, NEIGHBOURS // 2


def _out(d: SparkDialect, kind: str, nodes: list[str], edges: list[str], rest: str, anchor: str = "anchor") -> str:
    return f"SELECT {anchor} AS anchor, '{kind}' AS candidate_type, {d.set_of(*nodes)} AS nodes, {d.set_of(*edges)} AS edges {rest}"


def anchor_expansion(d):
    return _out(d, "anchor_expansion", ["node", "nbr"], ["edge_id"], "FROM {nbr_any}", "node")


def _first(lists: str, most: int) -> str:
    """The first ``most`` different neighbours of each list, in order, as one array (Spark)."""
    return f"(SELECT node, slice(near, 1, {most}) AS near FROM {{first_{lists.removeprefix('nbr_')}}})"


def _corner(d: SparkDialect, first: str, second: str) -> tuple[str, str]:
    """On Spark two neighbours meet by way of the closed corners at the anchor, so that pairs that no edge closes are never
    rows: the join of the ``first`` with its corners, and the condition on the ``second``. Elsewhere nothing."""
    return (f" JOIN {{corners}} t ON t.anchor = {first}.node AND t.p = {first}.nbr", f" AND {second}.nbr = t.q") if d.name == "spark" else ("", "")


def radius2(d):
    if d.name == "spark":
        near = f"SELECT a.*, get(filter(b.near, x -> x.nbr <> a.node AND x.rn <= {HALF}), 0) AS hit FROM {{nbr_any}} a JOIN {_first('nbr_any', 2)} b ON a.nbr = b.node"
        return _out(d, "radius2_expansion", ["node", "nbr", "hit.nbr"], ["edge_id", "hit.edge_id"], f"FROM ({near}) x WHERE hit IS NOT NULL", "node")
    inner = f"""SELECT a.node AS anchor, a.nbr AS f, a.edge_id AS e1, b.nbr AS s, b.edge_id AS e2,
        row_number() OVER (PARTITION BY a.node, a.rn ORDER BY b.rn) AS pick
        FROM {{nbr_any}} a JOIN {{nbr_any}} b ON a.nbr = b.node WHERE b.rn <= {HALF} AND b.nbr <> a.node"""
    return _out(d, "radius2_expansion", ["anchor", "f", "s"], ["e1", "e2"], f"FROM ({inner}) x WHERE pick = 1")


def _walks(d: SparkDialect, lists: str, starts: int, steps: int) -> str:
    """Greedy extension of each start by the first unvisited neighbour, at most ``steps`` times."""
    text = f"SELECT node AS anchor, rn AS r, {d.array('node', 'nbr')} AS nodes, {d.array('edge_id')} AS edges, nbr AS cur FROM {{{lists}}} WHERE rn <= {starts}"
    if d.name == "spark":  # a walk of k nodes passes over k neighbours at most
        for k in range(2, steps + 2):
            text = f"""SELECT anchor, r, CASE WHEN hit IS NULL THEN nodes ELSE {d.append('nodes', 'hit.nbr')} END AS nodes,
                CASE WHEN hit IS NULL THEN edges ELSE {d.append('edges', 'hit.edge_id')} END AS edges, hit.nbr AS cur
                FROM (SELECT w.*, get(filter(n.near, x -> NOT array_contains(w.nodes, x.nbr)), 0) AS hit FROM ({text}) w LEFT JOIN {_first(lists, k + 1)} n ON w.cur = n.node) x"""
        return text
    for _ in range(steps):
        text = f"""SELECT anchor, r, CASE WHEN nbr IS NULL THEN nodes ELSE {d.append('nodes', 'nbr')} END AS nodes,
            CASE WHEN nbr IS NULL THEN edges ELSE {d.append('edges', 'edge_id')} END AS edges, nbr AS cur
            FROM (SELECT w.*, n.nbr, n.edge_id, row_number() OVER (PARTITION BY w.anchor, w.r ORDER BY n.rn) AS pick
                  FROM ({text}) w LEFT JOIN {{{lists}}} n ON w.cur = n.node AND NOT {d.has('w.nodes', 'n.nbr')}) x WHERE pick = 1"""
    return text


def chain(d, max_path_len: int = 4):
    walks = _walks(d, "nbr_out", K, max(1, max_path_len - 1))
    through = """SELECT p.node AS anchor, p.nbr AS prev, p.edge_id AS e1, n.nbr AS nxt, n.edge_id AS e2,
        row_number() OVER (PARTITION BY p.node, p.rn ORDER BY n.rn) AS pick
        FROM {nbr_in} p JOIN {nbr_out} n ON p.node = n.node WHERE p.nbr <> n.nbr"""
    if d.name == "spark":
        through = f"""SELECT anchor, prev, e1, hit.nbr AS nxt, hit.edge_id AS e2, 1 AS pick FROM (SELECT p.node AS anchor, p.nbr AS prev, p.edge_id AS e1, get(filter(n.near, x -> x.nbr <> p.nbr), 0) AS hit
            FROM {{nbr_in}} p JOIN {_first('nbr_out', 2)} n ON p.node = n.node) x WHERE hit IS NOT NULL"""
    return f"""SELECT anchor, 'chain' AS candidate_type, {d.set_text('nodes')} AS nodes, {d.set_text('edges')} AS edges FROM ({walks}) w
        WHERE {d.size('edges')} >= 2 UNION ALL """ + _out(d, "chain", ["prev", "anchor", "nxt"], ["e1", "e2"], f"FROM ({through}) t WHERE pick = 1")


def directed_chain(d, max_path_len: int = 4):
    parts = []
    for direction in ("out", "in"):
        walks = _walks(d, f"nbr_{direction}", HALF, max(1, max_path_len - 1))
        parts.append(f"""SELECT anchor, 'directed_chain' AS candidate_type, {d.set_text('nodes')} AS nodes, {d.set_text('edges')} AS edges,
            '{direction}' AS path_direction, CAST({d.size('edges')} AS BIGINT) AS path_length FROM ({walks}) w WHERE {d.size('edges')} >= 2""")
    return " UNION ALL ".join(parts)


def _star(d: SparkDialect, rows: str, kind: str, least: int) -> str:
    return f"""SELECT anchor, '{kind}' AS candidate_type, {d.set_text('nodes')} AS nodes, edges FROM (
        SELECT anchor, {d.append(d.split_text(d.agg_set('nbr')), 'anchor')} AS nodes, {d.agg_set('edge_id')} AS edges
        FROM ({rows}) x GROUP BY anchor HAVING max(available) >= {least}) y"""


def _list(relation: str, take: int) -> str:
    return f"""SELECT node AS anchor, nbr, edge_id FROM {{{relation}}} WHERE rn <= {take}"""


def _counted(relation: str, take: int) -> str:
    """The first ``take`` neighbours with the length of the (capped) list they come from."""
    return f"""SELECT anchor, nbr, edge_id, available FROM (SELECT node AS anchor, nbr, edge_id, rn, count(*) OVER (PARTITION BY node) AS available
        FROM {{{relation}}}) c WHERE rn <= {take}"""


def _both(take_out: int, take_in: int, take: int) -> str:
    """Out-neighbours followed by in-neighbours, the first ``take`` of them."""
    return f"""SELECT anchor, nbr, edge_id, available, n_out, n_in FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY side, rn) AS place, count(*) OVER (PARTITION BY anchor) AS available,
          sum(1 - side) OVER (PARTITION BY anchor) AS n_out, sum(side) OVER (PARTITION BY anchor) AS n_in
        FROM (SELECT node AS anchor, nbr, edge_id, rn, 0 AS side FROM {{nbr_out}} WHERE rn <= {take_out}
              UNION ALL SELECT node, nbr, edge_id, rn, 1 FROM {{nbr_in}} WHERE rn <= {take_in}) u) v WHERE place <= {take}"""


def fan_out(d):
    return _star(d, _counted("nbr_out", 4), "fan_out", 2)


def fan_in(d):
    return _star(d, _counted("nbr_in", 4), "fan_in", 2)


def star(d):
    return _star(d, _both(K, K, 5), "star", 3)


def directed_star(d):
    mixed = f"SELECT anchor, nbr, edge_id, 2 AS available FROM ({_both(3, 3, 5)}) b WHERE n_out > 0 AND n_in > 0"
    return " UNION ALL ".join(_star(d, rows, "directed_star", 2) for rows in (_counted("nbr_out", 5), _counted("nbr_in", 5), mixed))


def cycle2(d):
    return _out(d, "cycle", ["n.node", "n.nbr"], ["n.edge_id", "p.edge_id"], "FROM {nbr_out} n JOIN {pair_dir} p ON p.src = n.nbr AND p.dst = n.node", "n.node")


def cycle(d):
    """A two-cycle where the neighbour links back, else the first three-cycle through it."""
    met, at = _corner(d, "a", "b")
    three = f"""SELECT a.node AS anchor, a.nbr AS mid, b.nbr AS fin, a.edge_id AS e1, b.edge_id AS e2, c.edge_id AS e3,
        row_number() OVER (PARTITION BY a.node, a.rn ORDER BY b.rn) AS pick
        FROM {{nbr_out}} a{met} LEFT JOIN {{pair_dir}} back ON back.src = a.nbr AND back.dst = a.node
        JOIN {{nbr_out}} b ON a.nbr = b.node{at} JOIN {{pair_dir}} c ON c.src = b.nbr AND c.dst = a.node
        WHERE back.edge_id IS NULL AND b.nbr <> a.node"""
    return cycle2(d) + " UNION ALL " + _out(d, "cycle", ["anchor", "mid", "fin"], ["e1", "e2", "e3"], f"FROM ({three}) t WHERE pick = 1")


def triangle(d):
    met, at = _corner(d, "l", "r")
    hits = f"""SELECT l.node AS anchor, l.nbr AS lft, r.nbr AS rgt, l.edge_id AS e1, r.edge_id AS e2, p.edge_id AS e3,
        row_number() OVER (PARTITION BY l.node, l.rn ORDER BY r.rn) AS pick
        FROM {{nbr_any}} l{met} JOIN {{nbr_any}} r ON l.node = r.node{at} AND r.rn > l.rn AND r.rn <= l.rn + {HALF}
        JOIN {{pair_und}} p ON p.a = least(l.nbr, r.nbr) AND p.b = greatest(l.nbr, r.nbr)"""
    return _out(d, "triangle", ["anchor", "lft", "rgt"], ["e1", "e2", "e3"], f"FROM ({hits}) t WHERE pick = 1")


def cycle4(d):
    """Once an anchor has a hit, later first neighbours try their first middle node only."""
    mids = f"""SELECT l.node AS anchor, l.rn AS lr, l.nbr AS lft, l.edge_id AS e1, m.nbr AS mid, m.edge_id AS e2,
        row_number() OVER (PARTITION BY l.node, l.rn ORDER BY m.rn) AS mr
        FROM {{nbr_any}} l JOIN {{nbr_any}} m ON l.nbr = m.node WHERE m.rn <= {HALF} AND m.nbr <> l.node"""
    closed = f"""SELECT x.*, r.nbr AS rgt, r.edge_id AS e3, p.edge_id AS e4, row_number() OVER (PARTITION BY x.anchor, x.lr, x.mr ORDER BY r.rn) AS pick
        FROM ({mids}) x JOIN {{nbr_any}} r ON x.mid = r.node JOIN {{pair_und}} p ON p.a = least(r.nbr, x.anchor) AND p.b = greatest(r.nbr, x.anchor)
        WHERE r.rn <= {HALF} AND r.nbr <> x.anchor AND r.nbr <> x.lft"""
    if d.name == "spark":
        closed = """SELECT w.anchor, w.r1 AS lr, w.n1 AS lft, w.e1, w.n2 AS mid, w.e2, w.r2 - w.skipped AS mr, w.n3 AS rgt, w.e3, p.edge_id AS e4,
            row_number() OVER (PARTITION BY w.anchor, w.r1, w.r2 ORDER BY w.r3) AS pick FROM {squares} w JOIN {pair_und} p ON p.a = least(w.n3, w.anchor) AND p.b = greatest(w.n3, w.anchor)"""
    hits = f"""SELECT *, min(lr) OVER (PARTITION BY anchor) AS first_lr, row_number() OVER (PARTITION BY anchor ORDER BY lr, mr) AS turn
        FROM ({closed}) c WHERE pick = 1"""
    return _out(d, "cycle4", ["anchor", "lft", "mid", "rgt"], ["e1", "e2", "e3", "e4"], f"FROM ({hits}) h WHERE turn = 1 OR (lr > first_lr AND mr = 1)")


def feed_forward(d):
    met, at = _corner(d, "l", "r")
    sides = f"""SELECT l.node AS anchor, l.nbr AS x, r.nbr AS y, l.edge_id AS e1, r.edge_id AS e2, coalesce(f.edge_id, b.edge_id) AS e3,
        row_number() OVER (PARTITION BY l.node, l.rn ORDER BY r.rn) AS pick
        FROM {{nbr_out}} l{met} JOIN {{nbr_out}} r ON l.node = r.node{at} AND r.rn > l.rn AND r.rn <= l.rn + {HALF}
        LEFT JOIN {{pair_dir}} f ON f.src = l.nbr AND f.dst = r.nbr LEFT JOIN {{pair_dir}} b ON b.src = r.nbr AND b.dst = l.nbr
        WHERE coalesce(f.edge_id, b.edge_id) IS NOT NULL"""
    met, at = _corner(d, "l", "m")
    ahead = f"""SELECT l.node AS anchor, l.nbr AS x, m.nbr AS y, l.edge_id AS e1, m.edge_id AS e2, p.edge_id AS e3,
        row_number() OVER (PARTITION BY l.node, l.rn ORDER BY m.rn) AS pick
        FROM {{nbr_out}} l{met} JOIN {{nbr_out}} m ON l.nbr = m.node{at} JOIN {{pair_dir}} p ON p.src = l.node AND p.dst = m.nbr
        WHERE m.rn <= {HALF} AND m.nbr <> l.node"""
    return " UNION ALL ".join(_out(d, "feed_forward", ["anchor", "x", "y"], ["e1", "e2", "e3"], f"FROM ({t}) t WHERE pick = 1") for t in (sides, ahead))


def directed_cycle(d, max_path_len: int = 4):
    met, at = _corner(d, "a", "b")  # Spark asks the walks of two steps for those that close alone
    two = f"""SELECT a.node AS anchor, a.rn AS r1, a.nbr AS n1, a.edge_id AS e1, b.rn AS r2, b.nbr AS n2, b.edge_id AS e2, c.edge_id AS closing
        FROM {{nbr_out}} a{met} JOIN {{nbr_out}} b ON a.nbr = b.node{at} LEFT JOIN {{pair_dir}} c ON c.src = b.nbr AND c.dst = a.node
        WHERE b.rn <= {HALF} AND b.nbr <> a.node"""
    text = _out(d, "directed_cycle", ["anchor", "n1", "n2"], ["e1", "e2", "closing"], f"FROM ({two}) t WHERE closing IS NOT NULL")
    if max_path_len >= 4:
        three = f"""SELECT t.*, n.nbr AS n3, n.edge_id AS e3, c.edge_id AS e4, row_number() OVER (PARTITION BY t.anchor, t.r1, t.r2 ORDER BY n.rn) AS pick
            FROM ({two}) t JOIN {{nbr_out}} n ON t.n2 = n.node JOIN {{pair_dir}} c ON c.src = n.nbr AND c.dst = t.anchor
            WHERE t.closing IS NULL AND n.rn <= {HALF} AND n.nbr <> t.anchor AND n.nbr <> t.n1"""
        if d.name == "spark":
            three = """SELECT w.anchor, w.n1, w.n2, w.n3, w.e1, w.e2, w.e3, c.edge_id AS e4, row_number() OVER (PARTITION BY w.anchor, w.r1, w.r2 ORDER BY w.r3) AS pick
                FROM {rings} w JOIN {pair_dir} c ON c.src = w.n3 AND c.dst = w.anchor LEFT ANTI JOIN {pair_dir} q ON q.src = w.n2 AND q.dst = w.anchor"""
        text += " UNION ALL " + _out(d, "directed_cycle", ["anchor", "n1", "n2", "n3"], ["e1", "e2", "e3", "e4"], f"FROM ({three}) u WHERE pick = 1")
    return text


def dense_block(d):
    """Anchor and its first eight neighbours; the five with most links among them; enough induced edges."""
    local = "SELECT DISTINCT anchor, n FROM (SELECT node AS anchor, nbr AS n FROM {nbr_any} WHERE rn <= 8 UNION ALL SELECT DISTINCT node, node FROM {nbr_any}) l"
    degree = f"""SELECT x.anchor, x.n, count(p.edge_id) AS deg FROM ({local}) x JOIN ({local}) y ON x.anchor = y.anchor
        LEFT JOIN {{pair_und}} p ON x.n <> y.n AND p.a = least(x.n, y.n) AND p.b = greatest(x.n, y.n) GROUP BY x.anchor, x.n"""
    chosen = f"SELECT anchor, n FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY deg DESC, n) AS pick FROM ({degree}) g) h WHERE pick <= 5"
    induced = f"""SELECT x.anchor, {d.agg_set('p.edge_id')} AS edges, count(*) AS m FROM ({chosen}) x JOIN ({chosen}) y ON x.anchor = y.anchor AND x.n < y.n
        JOIN {{pair_und}} p ON p.a = x.n AND p.b = y.n GROUP BY x.anchor"""
    members = f"SELECT anchor, {d.agg_set('n')} AS nodes, count(*) AS k FROM ({chosen}) c GROUP BY anchor"
    return f"""SELECT i.anchor, t.candidate_type, m.nodes, i.edges FROM ({induced}) i JOIN ({members}) m ON i.anchor = m.anchor
        CROSS JOIN (SELECT 'dense_subgraph' AS candidate_type UNION ALL SELECT 'dense_hyperlink_block') t
        WHERE m.k >= 3 AND i.m >= greatest(2, m.k - 1)"""


def bridge(d, query_nodes: int = 3, query_edges: int = 3):
    """One neighbour per party, foreign parties first; all edges among the chosen nodes, within the query's size.

    A neighbour of several parties would be taken once; here each has one, so the greedy choice is a window.
    """
    take = max(1, min(query_nodes - 1, 5))
    options = """SELECT n.node AS anchor, n.nbr, n.edge_id, n.rn, q.party, CASE WHEN q.party = o.party THEN 1 ELSE 0 END AS own
        FROM {nbr_any} n JOIN {node_party} q ON n.nbr = q.node JOIN {node_party} o ON n.node = o.node WHERE n.nbr <> n.node"""
    firsts = f"SELECT *, row_number() OVER (PARTITION BY anchor, party ORDER BY rn) AS pick FROM ({options}) o"
    chosen = f"SELECT anchor, nbr, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY own, party) AS place FROM ({firsts}) f WHERE pick = 1) g WHERE place <= {take}"
    nodes = f"SELECT anchor, nbr AS n FROM ({chosen}) c UNION ALL SELECT DISTINCT anchor, anchor FROM ({chosen}) c2"
    pairs = f"SELECT x.anchor, x.n AS u, y.n AS v FROM ({nodes}) x JOIN ({nodes}) y ON x.anchor = y.anchor AND x.n <> y.n"
    all_edges = f"""SELECT anchor, edge_id FROM ({chosen}) c UNION SELECT p.anchor, e.edge_id FROM ({pairs}) p JOIN {{pair_dir}} e ON e.src = p.u AND e.dst = p.v
        UNION SELECT p.anchor, e.edge_id FROM ({pairs}) p JOIN {{pair_und}} e ON e.a = p.u AND e.b = p.v"""
    kept = f"""SELECT anchor, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY edge_id) AS place, count(*) OVER (PARTITION BY anchor) AS m
        FROM ({all_edges}) a) b WHERE place <= greatest({query_edges}, least(m, {query_edges + 3}))"""
    sizes = f"SELECT anchor, {d.agg_set('n')} AS nodes, count(*) AS k FROM ({nodes}) s GROUP BY anchor"
    edges = f"SELECT anchor, {d.agg_set('edge_id')} AS edges, count(*) AS m FROM ({kept}) e GROUP BY anchor"
    return f"""SELECT s.anchor, 'multi_partition_bridge' AS candidate_type, s.nodes, e.edges FROM ({sizes}) s JOIN ({edges}) e ON s.anchor = e.anchor
        WHERE s.k >= 3 AND e.m >= greatest(2, least({query_edges}, s.k - 1))"""


def cross_party_edge(d, limit: int = 50):
    """Fallback without an anchor: the first edges by id that two parties see. The limit is the operator's own."""
    return f"""SELECT '' AS anchor, 'cross_partition_edge' AS candidate_type, {d.set_of('src', 'dst')} AS nodes, edge_id AS edges
        FROM (SELECT * FROM {{edge_set}} WHERE edge_cross >= 1.0 ORDER BY edge_id LIMIT {limit}) e"""


def query_edge_evidence(d, allow: bool = False):
    """Edges that the query names itself. Gated: ids of the sanitised view are renamed and never resolve, so it yields nothing."""
    gate = "1 = 1" if allow else "1 = 0"
    return f"""SELECT q.anchor, 'query_edge_evidence' AS candidate_type, {d.set_of('e.src', 'e.dst')} AS nodes, e.edge_id AS edges
        FROM (SELECT node AS anchor, 'qe' || CAST(rn - 1 AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) AS edge_id FROM {{nbr_any}} WHERE rn <= 3) q JOIN {{flow}} e ON q.edge_id = e.edge_id WHERE {gate}"""


GENERATORS = {
    "anchor_expansion": anchor_expansion, "radius2": radius2, "chain": chain, "directed_chain": directed_chain, "fan_out": fan_out, "fan_in": fan_in,
    "star": star, "directed_star": directed_star, "cycle2": cycle2, "cycle3": cycle, "triangle": triangle, "cycle4": cycle4, "feed_forward": feed_forward,
    "directed_cycle": directed_cycle, "dense_block": dense_block, "bridge": bridge, "cross_party_edge": cross_party_edge, "query_edge_evidence": query_edge_evidence,
}


def pooled(d, kinds) -> str:
    return "SELECT DISTINCT anchor, candidate_type, nodes, edges FROM (" + " UNION ALL ".join(f"SELECT anchor, candidate_type, nodes, edges FROM ({k(d)}) g" for k in kinds) + ") u WHERE nodes <> '' AND edges <> ''"


def all_candidates(d):
    """Candidates of the undirected-motif pipeline, de-duplicated on (anchor, nodes, edges, type)."""
    shorter = lambda k: lambda d: k(d, 3)  # noqa: E731  path length of the standard configuration
    kinds = (triangle, fan_out, fan_in, star, cycle, feed_forward, radius2, anchor_expansion, shorter(chain), bridge, cycle4, dense_block, shorter(directed_cycle))
    return pooled(d, kinds)


DEFINITIONS = {f"motif_{k}": v for k, v in GENERATORS.items()} | {"dedupe": all_candidates}
