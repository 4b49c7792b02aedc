"""Graph primitives over the relations of ``GraphTables``."""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect


def flow_edges(d):
    return "SELECT edge_id, src, dst, weight, pay_format, currency, ord FROM {flow}"


def node_party(d):
    return "SELECT node, party FROM {node_party}"


def edge_party(d):
    """An edge is visible to the parties of both its ends."""
    return "SELECT f.edge_id, p.party FROM {flow} f JOIN {node_party} p ON f.src = p.node UNION SELECT f.edge_id, p.party FROM {flow} f JOIN {node_party} p ON f.dst = p.node"


def compatibility_view(d):
    """Edges with their sorted parties and crossing score."""
    return "SELECT edge_id, src, dst, array_to_string(parties, ',') AS parties, edge_cross FROM {edge_set}" if d.name == "duckdb" else "SELECT edge_id, src, dst, array_join(parties, ',') AS parties, edge_cross FROM {edge_set}"


def degree_tables(d):
    """Out- and in-degree with multiplicity, mean and largest degree of the distinct neighbours, two-hop size."""
    deg = "SELECT node, count(*) AS deg FROM {links} GROUP BY node"
    far = "SELECT node, count(DISTINCT nbr) AS two_hop FROM (SELECT node, nbr FROM {links} UNION ALL SELECT a.node, b.nbr FROM {links} a JOIN {links} b ON a.nbr = b.node WHERE b.nbr <> a.node) t GROUP BY node"
    if d.name == "spark":
        far = "SELECT node, two_hop FROM {two_hop}"
    return f"""SELECT n.node, coalesce(o.k, 0) AS out_deg, coalesce(i.k, 0) AS in_deg, g.deg, g.mean_nbr_deg, g.max_nbr_deg, h.two_hop
        FROM (SELECT DISTINCT node FROM {{links}}) n
        LEFT JOIN (SELECT src AS node, count(*) AS k FROM {{flow}} GROUP BY src) o ON n.node = o.node
        LEFT JOIN (SELECT dst AS node, count(*) AS k FROM {{flow}} GROUP BY dst) i ON n.node = i.node
        JOIN (SELECT l.node, count(*) AS deg, round(avg(x.deg), 6) AS mean_nbr_deg, max(x.deg) AS max_nbr_deg FROM {{links}} l JOIN ({deg}) x ON l.nbr = x.node GROUP BY l.node) g ON n.node = g.node
        JOIN ({far}) h ON n.node = h.node"""


def khop_reach(d):
    """Distinct nodes reached and edges traversed within one and two hops, in both directions. The start counts if an edge returns to it."""
    parts = []
    for side, s, t in (("out", "src", "dst"), ("in", "dst", "src")):
        adj = f"SELECT {s} AS u, {t} AS v FROM {{flow}}"
        parts.append(f"""SELECT a.u AS node, '{side}' AS direction, a.n1, a.e1, b.n2, a.e1 + coalesce(c.e2, 0) AS e2
            FROM (SELECT u, count(DISTINCT v) AS n1, count(*) AS e1 FROM ({adj}) x GROUP BY u) a
            JOIN (SELECT u, count(DISTINCT w) AS n2 FROM (SELECT u, v AS w FROM ({adj}) x UNION ALL SELECT x.u, y.v FROM ({adj}) x JOIN ({adj}) y ON x.v = y.u) r GROUP BY u) b ON a.u = b.u
            LEFT JOIN (SELECT x.u, count(*) AS e2 FROM (SELECT DISTINCT u, v FROM ({adj}) x0 WHERE u <> v) x JOIN ({adj}) y ON x.v = y.u GROUP BY x.u) c ON a.u = c.u""")
    return " UNION ALL ".join(parts)


def ranked_neighbors(d):
    return "SELECT 'any' AS direction, node, nbr, edge_id, CAST(rn AS BIGINT) AS rn FROM {nbr_any} UNION ALL SELECT 'out', node, nbr, edge_id, CAST(rn AS BIGINT) FROM {nbr_out} UNION ALL SELECT 'in', node, nbr, edge_id, CAST(rn AS BIGINT) FROM {nbr_in}"


def common_neighbors(d):
    """Common neighbours of linked pairs."""
    return """SELECT p.a, p.b, count(x.nbr) AS cn FROM {pair_und} p LEFT JOIN {links} l ON l.node = p.a LEFT JOIN {links} x ON x.node = p.b AND x.nbr = l.nbr
        WHERE p.a <> p.b GROUP BY p.a, p.b"""


def adamic_adar(d):
    """Sum of 1/ln(degree) over common neighbours of linked pairs, degree above one."""
    return """SELECT p.a, p.b, round(sum(1.0 / ln(g.deg)), 6) AS aa FROM {pair_und} p JOIN {links} l ON l.node = p.a JOIN {links} x ON x.node = p.b AND x.nbr = l.nbr
        JOIN (SELECT node, count(*) AS deg FROM {links} GROUP BY node) g ON g.node = l.nbr WHERE g.deg > 1 GROUP BY p.a, p.b"""


def jaccard(d):
    """Neighbourhood Jaccard of linked pairs; 0 if both are empty."""
    return """SELECT c.a, c.b, round(CASE WHEN x.deg + y.deg - c.cn = 0 THEN 0.0 ELSE CAST(c.cn AS DOUBLE) / (x.deg + y.deg - c.cn) END, 6) AS jaccard
        FROM (""" + common_neighbors(d) + """) c JOIN (SELECT node, count(*) AS deg FROM {links} GROUP BY node) x ON c.a = x.node
        JOIN (SELECT node, count(*) AS deg FROM {links} GROUP BY node) y ON c.b = y.node"""


def induced_edges(d):
    """Edges among an anchor and its first eight neighbours."""
    local = "SELECT DISTINCT anchor, n FROM (SELECT node AS anchor, nbr AS n FROM {nbr_any} WHERE rn <= 8 UNION ALL SELECT DISTINCT node, node FROM {nbr_any}) l"
    return f"""SELECT x.anchor, count(DISTINCT e.edge_id) AS m, {d.agg_set('e.edge_id')} AS edges FROM ({local}) x JOIN ({local}) y ON x.anchor = y.anchor
        JOIN {{pair_dir}} e ON e.src = x.n AND e.dst = y.n GROUP BY x.anchor"""


def enclosing_counts(d):
    """For linked pairs: common neighbours, edges within the enclosing one-hop subgraph, degree sum."""
    if d.name == "spark":
        return "SELECT a, b, cn, inside, deg_sum FROM {enclosed}"
    ball = "SELECT p.a, p.b, l.nbr AS n FROM {pair_und} p JOIN {links} l ON l.node = p.a UNION SELECT p.a, p.b, l.nbr FROM {pair_und} p JOIN {links} l ON l.node = p.b"
    return f"""SELECT c.a, c.b, c.cn, coalesce(e.inside, 0) AS inside, x.deg + y.deg AS deg_sum FROM ({common_neighbors(d)}) c
        JOIN (SELECT node, count(*) AS deg FROM {{links}} GROUP BY node) x ON c.a = x.node JOIN (SELECT node, count(*) AS deg FROM {{links}} GROUP BY node) y ON c.b = y.node
        LEFT JOIN (SELECT u.a, u.b, count(*) AS inside FROM ({ball}) u JOIN ({ball}) v ON u.a = v.a AND u.b = v.b AND u.n < v.n
                   JOIN {{pair_und}} p ON p.a = u.n AND p.b = v.n GROUP BY u.a, u.b) e ON c.a = e.a AND c.b = e.b"""


def pair_universe(d):
    """Linked node pairs inside each anchor's ball (the anchor and its first eight neighbours), edges joined first."""
    local = "SELECT DISTINCT anchor, n FROM (SELECT node AS anchor, nbr AS n FROM {nbr_any} WHERE rn <= 8 UNION ALL SELECT DISTINCT node, node FROM {nbr_any}) l"
    return f"""SELECT x.anchor, p.a, p.b, p.edge_id FROM ({local}) x JOIN {{pair_und}} p ON p.a = x.n JOIN ({local}) y ON y.anchor = x.anchor AND y.n = p.b WHERE p.a <> p.b"""


def simple_cycles3(d):
    """Elementary directed cycles of length two and three, each once from its smallest node."""
    return f"""SELECT {d.set_of('x.src', 'x.dst')} AS nodes, CAST(2 AS BIGINT) AS length FROM {{pair_dir}} x JOIN {{pair_dir}} y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst
        UNION ALL SELECT x.src || '>' || x.dst || '>' || y.dst, CAST(3 AS BIGINT) FROM {{pair_dir}} x JOIN {{pair_dir}} y ON x.dst = y.src AND y.dst <> x.src
        JOIN {{pair_dir}} z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst"""


def subgraph_match(d):
    """Induced matches of a directed path of three nodes ending in a reciprocal pair: a>b, b>c, c>b, nothing else."""
    return """SELECT x.src AS a, x.dst AS b, y.dst AS c FROM {pair_dir} x JOIN {pair_dir} y ON x.dst = y.src JOIN {pair_dir} z ON z.src = y.dst AND z.dst = y.src
        LEFT JOIN {pair_dir} n1 ON n1.src = x.dst AND n1.dst = x.src LEFT JOIN {pair_dir} n2 ON n2.src = x.src AND n2.dst = y.dst
        LEFT JOIN {pair_dir} n3 ON n3.src = y.dst AND n3.dst = x.src
        WHERE y.dst <> x.src AND x.src <> x.dst AND n1.edge_id IS NULL AND n2.edge_id IS NULL AND n3.edge_id IS NULL"""


def random_walk_step(d):
    """First walk step: the neighbour with the smallest seeded hash, for two walks from every node."""
    pick = lambda w: f"SELECT node, {w} AS walk, min_by(nbr, {d.hash48(chr(39) + '7|' + str(w) + '|' + chr(39) + ' || node || ' + chr(39) + '|' + chr(39) + ' || nbr')}) AS nxt FROM {{links}} GROUP BY node"
    return pick(0) + " UNION ALL " + pick(1)


def minhash(d):
    """Eight-value MinHash of each neighbourhood by seeded 48-bit hashes."""
    cols = ", ".join("min(" + d.hash48(f"'{i}|' || nbr") + f") AS h{i}" for i in range(8))
    return f"SELECT node, {cols} FROM {{links}} GROUP BY node"


def vector_pairs(d):
    """Dot product and cosine of all embeddings with the same label, each pair once."""
    if d.name == "spark":
        return "SELECT a, b, round(xy, 6) AS dot, round(xy / sqrt(xx * yy), 6) AS cosine FROM {label_pairs}"
    dot = lambda a, b: d.dot(f"{a}.embedding", f"{b}.embedding")
    return f"""SELECT x.vec_id AS a, y.vec_id AS b, round({dot('x', 'y')}, 6) AS dot, round({dot('x', 'y')} / sqrt({dot('x', 'x')} * {dot('y', 'y')}), 6) AS cosine
        FROM {{embeddings}} x JOIN {{embeddings}} y ON x.label = y.label AND y.vec_id > x.vec_id"""


def crossing_pairs(d):
    """Of each unordered pair the edge that crosses most, the smallest id on a tie."""
    rows = "SELECT least(src, dst) AS a, greatest(src, dst) AS b, edge_id, edge_cross FROM {edge_set}"
    return f"SELECT a, b, edge_id, edge_cross FROM (SELECT r.*, row_number() OVER (PARTITION BY a, b ORDER BY edge_cross DESC, edge_id) AS pick FROM ({rows}) r) p WHERE pick = 1"


def log_buckets(d):
    """Buckets of amounts: floor of the logarithm of x + 1."""
    return "SELECT edge_id, CAST(floor(ln(weight + 1) / ln(CAST(10 AS DOUBLE))) AS BIGINT) AS amount_bucket, CAST(floor(ln(weight + 1) / ln(CAST(2 AS DOUBLE))) AS BIGINT) AS fine_bucket FROM {flow}"


def natural_order(d: SparkDialect):
    """Ids in natural order: e<number> and digit strings by number before other text."""
    number = "CAST(nullif(regexp_replace(edge_id, '^e', ''), '') AS BIGINT)"
    return f"SELECT edge_id, CAST(place AS BIGINT) AS place FROM ({d.ranked(f'SELECT edge_id, {number} AS number FROM {{flow}}', 'number, edge_id', 'place')}) f"


DEFINITIONS = {f.__name__: f for f in (
    flow_edges, node_party, edge_party, compatibility_view, degree_tables, khop_reach, ranked_neighbors, common_neighbors, adamic_adar, jaccard, induced_edges,
    enclosing_counts, pair_universe, simple_cycles3, subgraph_match, random_walk_step, minhash, vector_pairs, crossing_pairs, log_buckets, natural_order)}
