"""Baseline scorers over the graph relations, as link, ball, signature and neighbourhood joins."""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect
from crossmotif.operators.graph import adamic_adar, common_neighbors, enclosing_counts

DEG = "SELECT node, count(*) AS deg FROM {links} GROUP BY node"


def baseline_aa(d):
    """Adamic-Adar of anchor-neighbour edges, zero included."""
    return f"SELECT p.edge_id, p.a, p.b, coalesce(x.aa, 0.0) AS score FROM {{pair_und}} p LEFT JOIN ({adamic_adar(d)}) x ON p.a = x.a AND p.b = x.b WHERE p.a <> p.b"


def baseline_cn(d):
    """Common-neighbour score of existing edges."""
    return f"SELECT p.edge_id, x.a, x.b, x.cn AS score FROM ({common_neighbors(d)}) x JOIN {{pair_und}} p ON p.a = x.a AND p.b = x.b WHERE x.cn > 0"


def seal(d):
    """Logarithms of common neighbours, enclosed edges and degree sum, weighted 2, 0.5 and 0.1."""
    return f"SELECT a, b, round(2.0 * ln(1.0 + cn) + 0.5 * ln(1.0 + inside) + 0.1 * ln(1.0 + deg_sum), 6) AS score FROM ({enclosing_counts(d)}) e"


def subgnn(d):
    """Cosine of each ego ball's (nodes, edges, mean degree, density) with (4, 4, 3, 0.3)."""
    ball = "SELECT node AS c, nbr AS n FROM {links} UNION SELECT node, node FROM {links}"
    stats = f"""SELECT s.c, s.n, coalesce(e.m, 0) AS m FROM (SELECT c, count(*) AS n FROM ({ball}) b GROUP BY c) s
        LEFT JOIN (SELECT x.c, count(*) AS m FROM ({ball}) x JOIN {{pair_und}} p ON p.a = x.n JOIN ({ball}) y ON y.c = x.c AND y.n = p.b WHERE p.a <> p.b GROUP BY x.c) e ON s.c = e.c"""
    f = f"SELECT c, CAST(n AS DOUBLE) AS n, CAST(m AS DOUBLE) AS m, 2.0 * m / n AS g, CASE WHEN n > 1 THEN 2.0 * m / (n * (n - 1)) ELSE 0.0 END AS r FROM ({stats}) t"
    return f"SELECT c AS node, round((4.0 * n + 4.0 * m + 3.0 * g + 0.3 * r) / (sqrt(n * n + m * m + g * g + r * r) * sqrt(41.09)), 6) AS score FROM ({f}) v"


# Features of a node's signature by mode.
MODES = {"final": ("o", "i", "deg"), "regal": ("deg", "mean_nbr", "max_nbr"), "bright": ("o", "i", "deg", "mean_nbr"), "hlot": ("o", "i", "deg", "mean_nbr", "max_nbr")}


def _signatures(d: SparkDialect, mode: str) -> str:
    base = f"""SELECT n.node, w.party, ln(1.0 + coalesce(o.k, 0)) AS o, ln(1.0 + coalesce(i.k, 0)) AS i, ln(1.0 + g.deg) AS deg, ln(1.0 + g.mean_nbr) AS mean_nbr, ln(1.0 + g.max_nbr) AS max_nbr
        FROM (SELECT DISTINCT node FROM {{links}}) n JOIN (SELECT node, max(party) AS party FROM {{node_party}} GROUP BY node) w ON n.node = w.node
        LEFT JOIN (SELECT src AS node, count(*) AS k FROM {{flow}} GROUP BY src) o ON n.node = o.node LEFT JOIN (SELECT dst AS node, count(*) AS k FROM {{flow}} GROUP BY dst) i ON n.node = i.node
        JOIN (SELECT l.node, count(*) AS deg, avg(x.deg) AS mean_nbr, max(x.deg) AS max_nbr FROM {{links}} l JOIN ({DEG}) x ON l.nbr = x.node GROUP BY l.node) g ON n.node = g.node"""
    norm = " + ".join(f"{c} * {c}" for c in MODES[mode])
    return "SELECT node, party, " + ", ".join(f"{c} / sqrt({norm}) AS {c}" for c in MODES[mode]) + f" FROM ({base}) b"


def _alignment(mode: str, per_party: int = 500):
    def definition(d):
        """Best partner of each node in every later party by signature dot product. At most ``per_party`` nodes, the
        busiest first, stand for a party: the cap is that of the configurations and bounds the pairs."""
        top = f"""SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY party ORDER BY g.deg DESC, s.node) AS pick FROM ({_signatures(d, mode)}) s
            JOIN ({DEG}) g ON s.node = g.node) t WHERE pick <= {per_party}"""
        dot = " + ".join(f"x.{c} * y.{c}" for c in MODES[mode])
        pairs = f"SELECT x.party AS p1, y.party AS p2, x.node AS a, y.node AS b, round({dot}, 6) AS score FROM ({top}) x JOIN ({top}) y ON x.party < y.party"
        return f"SELECT p1, p2, a, b, score FROM (SELECT q.*, row_number() OVER (PARTITION BY p1, p2, a ORDER BY score DESC, b) AS pick FROM ({pairs}) q) r WHERE pick = 1"

    return definition


def fanmod(d):
    """Triangles (3.0) and wedges (2.0) among first neighbours, stars by degree."""
    if d.name == "spark":
        return """SELECT node, 'wedge' AS shape, size * (size - 1) div 2 - links AS found, CAST(2.0 AS DOUBLE) AS score FROM {list_links} WHERE size * (size - 1) div 2 > links
            UNION ALL SELECT node, 'triangle', links, CAST(3.0 AS DOUBLE) FROM {list_links} WHERE links > 0
            UNION ALL SELECT node, 'star', count(*), CAST(count(*) AS DOUBLE) FROM {nbr_any} GROUP BY node HAVING count(*) >= 3"""
    pairs = """SELECT l.node AS c, least(l.nbr, r.nbr) AS x, greatest(l.nbr, r.nbr) AS y FROM {nbr_any} l JOIN {nbr_any} r ON l.node = r.node AND l.rn < r.rn WHERE l.nbr <> r.nbr"""
    return f"""SELECT c AS node, CASE WHEN p.edge_id IS NULL THEN 'wedge' ELSE 'triangle' END AS shape, count(*) AS found, CAST(CASE WHEN p.edge_id IS NULL THEN 2.0 ELSE 3.0 END AS DOUBLE) AS score
        FROM (SELECT DISTINCT c, x, y FROM ({pairs}) q0) q LEFT JOIN {{pair_und}} p ON p.a = q.x AND p.b = q.y GROUP BY c, p.edge_id IS NULL
        UNION ALL SELECT node, 'star', count(*), CAST(count(*) AS DOUBLE) FROM {{nbr_any}} GROUP BY node HAVING count(*) >= 3""".replace("GROUP BY c, p.edge_id IS NULL", "GROUP BY c, CASE WHEN p.edge_id IS NULL THEN 'wedge' ELSE 'triangle' END, CAST(CASE WHEN p.edge_id IS NULL THEN 2.0 ELSE 3.0 END AS DOUBLE)")


def gspan(d):
    """Edges scored by their place in the input: the last ranks first."""
    return f"SELECT edge_id, CAST(place AS BIGINT) AS score FROM ({d.ranked('SELECT edge_id, ord FROM {flow}', 'ord, edge_id', 'place')}) p"


def _retrieval(mode: str):
    def definition(d):
        """Anchor windows of two and three neighbours from each rank on, scored by the mode's mix of density, crossing
        support and degree balance."""
        windows = f"""SELECT a.node AS anchor, a.rn, 3 AS n, {d.set_of('a.node', 'a.nbr', 'b.nbr')} AS nodes, {d.set_of('a.edge_id', 'b.edge_id')} AS edges, a.nbr AS x, b.nbr AS y, a.edge_cross + b.edge_cross AS support
            FROM {{nbr_any}} a JOIN {{nbr_any}} b ON a.node = b.node AND b.rn = a.rn + 1 WHERE a.nbr <> b.nbr"""
        closed = f"""SELECT w.*, CASE WHEN p.edge_id IS NULL THEN 0.0 ELSE 1.0 END AS closing, gx.deg AS dx, gy.deg AS dy FROM ({windows}) w
            LEFT JOIN {{pair_und}} p ON p.a = least(w.x, w.y) AND p.b = greatest(w.x, w.y) JOIN ({DEG}) gx ON gx.node = w.x JOIN ({DEG}) gy ON gy.node = w.y"""
        balance = "(1.0 / (1.0 + abs(dx - dy)))"
        mix = {"neugn": f"0.5 * (2.0 + closing) / 3.0 + 0.3 * support / 2.0 + 0.2 * {balance}", "tpab": f"0.7 * (2.0 + closing) / 3.0 + 0.3 / (1.0 + rn)", "isonet": f"0.4 * (2.0 + closing) / 3.0 + 0.6 * {balance}"}[mode]
        return f"SELECT anchor, nodes, edges, round(CAST({mix} AS DOUBLE), 6) AS score FROM ({closed}) c"

    return definition


def csgm_scope(d):
    """Pairs of parties ranked by the boundary edges between them, with MinHash agreement of their boundary nodes."""
    boundary = "SELECT least(s.party, t.party) AS p1, greatest(s.party, t.party) AS p2, f.src, f.dst FROM {flow} f JOIN {node_party} s ON f.src = s.node JOIN {node_party} t ON f.dst = t.node WHERE s.party <> t.party"
    ends = f"SELECT p1, p2, party, node FROM (SELECT p1, p2, src AS node FROM ({boundary}) b UNION SELECT p1, p2, dst FROM ({boundary}) b2) e JOIN {{node_party}} q USING (node)"
    sig = ", ".join("min(" + d.hash48(f"'{i}|' || node") + f") AS h{i}" for i in range(4))
    s = f"SELECT p1, p2, party, count(*) AS ends, {sig} FROM ({ends}) x GROUP BY p1, p2, party"
    same = " + ".join(f"CASE WHEN a.h{i} = b.h{i} THEN 0.25 ELSE 0.0 END" for i in range(4))
    return f"""SELECT c.p1, c.p2, c.boundary_edges, a.ends AS ends_1, b.ends AS ends_2, CAST({same} AS DOUBLE) AS agreement FROM (SELECT p1, p2, count(*) AS boundary_edges FROM ({boundary}) b3 GROUP BY p1, p2) c
        JOIN ({s}) a ON a.p1 = c.p1 AND a.p2 = c.p2 AND a.party = c.p1 JOIN ({s}) b ON b.p1 = c.p1 AND b.p2 = c.p2 AND b.party = c.p2"""


def csgm_candidates(d):
    """Gathered candidates: an anchor's best neighbour in each other party with what links the two parties."""
    options = """SELECT n.node AS anchor, o.party AS own, q.party AS other, n.nbr, n.edge_id, row_number() OVER (PARTITION BY n.node, q.party ORDER BY n.rn) AS pick
        FROM {nbr_any} n JOIN {node_party} o ON n.node = o.node JOIN {node_party} q ON n.nbr = q.node WHERE o.party <> q.party"""
    chosen = f"SELECT anchor, other, nbr, edge_id FROM ({options}) o WHERE pick = 1"
    return f"""SELECT x.anchor, {d.set_of('x.anchor', 'x.nbr', 'y.nbr')} AS nodes, {d.set_of('x.edge_id', 'y.edge_id')} AS edges, CASE WHEN p.edge_id IS NULL THEN 0 ELSE 1 END AS closed
        FROM ({chosen}) x JOIN ({chosen}) y ON x.anchor = y.anchor AND x.other < y.other LEFT JOIN {{pair_und}} p ON p.a = least(x.nbr, y.nbr) AND p.b = greatest(x.nbr, y.nbr)"""


def _walk(d: SparkDialect, biased: bool, steps: int = 4) -> str:
    """Seeded walks from every node: each step takes the neighbour with the smallest exponential key hash/weight."""
    key = lambda s: d.hash48(f"'11|{s}|' || w.start || '|' || l.nbr")
    text = "SELECT node AS start, node AS cur, '' AS prev FROM (SELECT DISTINCT node FROM {links}) s"
    parts = []
    for s in range(1, steps + 1):
        weight = "CASE WHEN l.nbr = w.prev THEN 1.0 WHEN back.nbr IS NOT NULL THEN 1.0 ELSE 0.5 END" if biased else "1.0"
        join = "LEFT JOIN {links} back ON back.node = w.prev AND back.nbr = l.nbr" if biased else ""
        text = f"""SELECT start, min_by(nxt, k) AS cur, max(prev0) AS prev FROM (SELECT w.start, w.cur AS prev0, l.nbr AS nxt, -ln(({key(s)} + 1.0) / 281474976710657.0) / ({weight}) AS k
            FROM ({text}) w JOIN {{links}} l ON l.node = w.cur {join}) c GROUP BY start"""
        parts.append(f"SELECT start, CAST({s} AS BIGINT) AS step, cur FROM ({text}) t{s}")
    return " UNION ALL ".join(parts)


def _embedding(biased: bool):
    def definition(d):
        """Edges ranked by the dot product of walk co-occurrence vectors under seeded index vectors of eight signs."""
        w = _walk(d, biased, 3)
        sign = lambda i: "CASE WHEN " + d.hash48(f"'{i}#' || cur") + " % 2 = 0 THEN 1.0 ELSE -1.0 END"
        vec = f"SELECT start AS node, {', '.join(f'sum({sign(i)}) AS v{i}' for i in range(8))} FROM ({w}) w GROUP BY start"
        dot = " + ".join(f"x.v{i} * y.v{i}" for i in range(8))
        return f"SELECT p.edge_id, CAST({dot} AS DOUBLE) AS score FROM {{pair_und}} p JOIN ({vec}) x ON p.a = x.node JOIN ({vec}) y ON p.b = y.node"

    return definition


def graphsage(d):
    """Two rounds of self plus mean of neighbours on hashed vectors of four values; edges ranked by dot product.

    Values are billionths above -1, kept as integers, so that no sum hangs on the order of its rows.
    """
    dims = range(4)
    text = "SELECT node, " + ", ".join("(" + d.hash48(f"'{i}~' || node") + f" % 2001) * 1000000 AS v{i}" for i in dims) + " FROM (SELECT DISTINCT node FROM {links}) n"
    for _ in range(2):
        text = f"""SELECT s.node, {', '.join(d.whole(f's.v{i} + ' + d.whole(f'm.v{i}', 'm.k'), '2') + f' AS v{i}' for i in dims)} FROM ({text}) s
            JOIN (SELECT l.node, count(*) AS k, {', '.join(f'CAST(sum(t.v{i}) AS BIGINT) AS v{i}' for i in dims)} FROM {{links}} l JOIN ({text}) t ON l.nbr = t.node GROUP BY l.node) m ON s.node = m.node"""
    value = lambda x, i: f"(CAST({x}.v{i} AS DOUBLE) / 1000000000.0 - 1.0)"
    dot = " + ".join(f"{value('x', i)} * {value('y', i)}" for i in dims)
    return f"SELECT p.edge_id, round({dot}, 6) AS score FROM {{pair_und}} p JOIN ({text}) x ON p.a = x.node JOIN ({text}) y ON p.b = y.node"


DEFINITIONS = {f.__name__: f for f in (baseline_aa, baseline_cn, seal, subgnn, fanmod, gspan, csgm_scope, csgm_candidates, graphsage)}
DEFINITIONS |= {f"align_{m}": _alignment(m) for m in MODES}
DEFINITIONS |= {f"retrieval_{m}": _retrieval(m) for m in ("neugn", "tpab", "isonet")}
DEFINITIONS |= {"deepwalk": _embedding(False), "node2vec": _embedding(True)}
