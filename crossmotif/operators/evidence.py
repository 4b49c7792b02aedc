"""Evidence pipeline: party views, role-sensitive features, tag joins, pair scores, candidates, rerank."""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect

THRESHOLD, TOP_K, GROUP = 0.72, 3, 5
SENDERS = 500  # senders of a tag, about, that meet its receivers in one task


def tagged(d: SparkDialect) -> str:
    """Transactions with both parties, the crossing flag and the public tag."""
    return f"""SELECT f.*, s.party AS src_party, t.party AS dst_party, s.party <> t.party AS is_inter, {d.day_text('f.ts')} || '||' || f.pay_format AS tag
        FROM {{flow}} f JOIN {{node_party}} s ON f.src = s.node JOIN {{node_party}} t ON f.dst = t.node"""


def public_tag(d):
    return f"SELECT edge_id, src_party, dst_party, is_inter, tag FROM {{tagged}} t"


def bank_view(d):
    """Rows that a party sees as sender and as receiver, the counterparty masked across parties."""
    mask = lambda p, a: f"CASE WHEN is_inter THEN 'REMOTE::' || {p} || '::' || {a} ELSE {a} END"
    return f"""SELECT src_party AS bank, edge_id, 'SENDER' AS role, src AS local_account, {mask('dst_party', 'dst')} AS counterparty FROM {{tagged}} t
        UNION ALL SELECT dst_party, edge_id, 'RECEIVER', dst, {mask('src_party', 'src')} FROM {{tagged}} u"""


def local_edges(d):
    """Oriented edges of each party's own graph over masked accounts; crossing rows appear at both parties."""
    return f"""SELECT src_party AS bank, edge_id, src AS u, CASE WHEN is_inter THEN 'REMOTE::' || dst_party || '::' || dst ELSE dst END AS v FROM {{tagged}} t
        UNION ALL SELECT dst_party, edge_id, 'REMOTE::' || src_party || '::' || src, dst FROM {{tagged}} w WHERE is_inter"""


def node_stats(d):
    """Degrees and one- and two-hop reach, outward and inward, of the local nodes on crossing rows."""
    if d.name == "spark":
        return "SELECT bank, node, out_deg, in_deg, out_1, out_2, in_1, in_2 FROM {reach_local}"
    nodes = f"SELECT DISTINCT bank, node FROM (SELECT src_party AS bank, src AS node FROM {{tagged}} a WHERE is_inter UNION ALL SELECT dst_party, dst FROM {{tagged}} b WHERE is_inter) c"
    parts = {}
    for side, s, t in (("out", "u", "v"), ("in", "v", "u")):
        reach = f"""SELECT bank, node, count(DISTINCT w) AS r2 FROM (SELECT bank, {s} AS node, {t} AS w FROM {{views}} x UNION ALL
                  SELECT x.bank, x.{s}, y.{t} FROM {{views}} x JOIN {{views}} y ON x.bank = y.bank AND x.{t} = y.{s}) z GROUP BY bank, node"""
        parts[side] = f"""SELECT p.bank, p.node, p.deg, p.r1, q.r2 FROM (SELECT bank, {s} AS node, count(*) AS deg, count(DISTINCT {t}) AS r1 FROM {{views}} x GROUP BY bank, {s}) p
            JOIN ({reach}) q ON p.bank = q.bank AND p.node = q.node"""
    zero = lambda c: f"coalesce({c}, 0)"
    return f"""SELECT n.bank, n.node, {zero('o.deg')} AS out_deg, {zero('i.deg')} AS in_deg, {zero('o.r1')} AS out_1, {zero('o.r2')} AS out_2, {zero('i.r1')} AS in_1, {zero('i.r2')} AS in_2
        FROM ({nodes}) n LEFT JOIN ({parts['out']}) o ON n.bank = o.bank AND n.node = o.node LEFT JOIN ({parts['in']}) i ON n.bank = i.bank AND n.node = i.node"""


#: Role, columns of its party and account, its own direction and the other one.
ROLES = (("SENDER", "src_party", "src", "out", "in"), ("RECEIVER", "dst_party", "dst", "in", "out"))


def _measures(d: SparkDialect, first: str, second: str) -> str:
    """Degrees and reaches of ``s`` for a role with their log buckets, and the attributes of the row ``t``."""
    b = lambda x, base: f"CAST(floor(ln(CAST({x} AS DOUBLE) + 1) / ln(CAST({base} AS DOUBLE))) AS BIGINT)"
    return f"""s.{first}_deg AS pdeg, s.{second}_deg AS sdeg, s.{first}_1 AS pr1, s.{first}_2 AS pr2,
            s.{second}_1 AS or1, s.{second}_2 AS or2, {b(f's.{first}_deg', 2)} AS pdeg_b, {b(f's.{second}_deg', 2)} AS sdeg_b, {b('t.weight', 10)} AS amount_b,
            CAST({d.hour('t.ts')} AS BIGINT) AS hour_b, t.pay_format, t.currency"""


def _role_features(d: SparkDialect) -> list[str]:
    """Evidence of the senders and of the receivers."""
    parts = []
    for role, bank, node, first, second in ROLES:
        parts.append(f"""SELECT t.edge_id, t.ord, t.tag, t.{bank} AS bank, t.{node} AS node, '{role}' AS role, {_measures(d, first, second)} FROM {{tagged}} t JOIN ({node_stats(d)}) s ON t.{bank} = s.bank AND t.{node} = s.node WHERE t.is_inter""")
    return parts


def evidence_features(d):
    """One row per crossing transaction and role: role-sensitive degrees and reaches with their log buckets."""
    return " UNION ALL ".join(_role_features(d))


def top_rows(d: SparkDialect) -> str:
    """Relation of the rows that the joins by tag read: the first five per tag and role, before anything is counted for them."""
    rows = " UNION ALL ".join(f"SELECT edge_id, ord, tag, {bank} AS bank, {node} AS node, '{role}' AS role, weight, ts, pay_format, currency FROM {{tagged}} t WHERE is_inter" for role, bank, node, *_ in ROLES)
    return f"SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY tag, role ORDER BY bank, ord) AS rn FROM ({rows}) v) w WHERE rn <= {GROUP}"


def top_evidence(d: SparkDialect) -> str:
    """Relation of the evidence of these rows, from the reach of their accounts alone."""
    return " UNION ALL ".join(f"""SELECT t.edge_id, t.ord, t.tag, t.bank, t.node, '{role}' AS role, {_measures(d, first, second)}, t.rn
        FROM {{top_rows}} t JOIN {{reach_top}} s ON t.bank = s.bank AND t.node = s.node WHERE t.role = '{role}'""" for role, _, _, first, second in ROLES)


def tag_buckets(d):
    """At most five rows per tag and role, in the order of parties and rows."""
    if d.name == "spark":
        return "SELECT tag, role, bank, edge_id, node, CAST(rn AS BIGINT) AS rn FROM {top_rows} w"
    return f"""SELECT tag, role, bank, edge_id, node, CAST(rn AS BIGINT) AS rn FROM (SELECT v.*, row_number() OVER (PARTITION BY tag, role ORDER BY bank, ord) AS rn FROM {{evidence}} v) w WHERE rn <= {GROUP}"""


def _capped(d: SparkDialect) -> str:
    if d.name == "spark":
        return f"SELECT * FROM {{top_evidence}} w WHERE rn <= {GROUP}"
    return f"SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY tag, role ORDER BY bank, ord) AS rn FROM {{evidence}} v) w WHERE rn <= {GROUP}"


def _kernels() -> dict[str, str]:
    close = lambda c: f"(1.0 / (1.0 + abs(s.{c} - r.{c})))"
    same = lambda c: f"(CASE WHEN s.{c} = r.{c} THEN 1.0 ELSE 0.0 END)"
    asym = lambda x: f"(abs({x}.pdeg - {x}.sdeg) / ({x}.pdeg + {x}.sdeg + CAST(1 AS DOUBLE)))"
    bias = lambda x: f"(({x}.pr2 - {x}.or2) / ({x}.pr2 + {x}.or2 + CAST(1 AS DOUBLE)))"
    unit = lambda x: f"least(1.0, greatest(0.0, ({bias(x)} + 1.0) / 2.0))"
    flow = f"(0.5 * {close('amount_b')} + 0.5 * {close('amount_b')})"
    context = f"(0.4 * {close('hour_b')} + 0.2 * {same('pay_format')} + 0.4 * {same('currency')})"
    turn = f"(0.5 * {unit('s')} + 0.5 * {unit('r')})"
    chain = f"0.35 * {turn} + 0.25 * (0.5 * {asym('s')} + 0.5 * {asym('r')}) + 0.25 * {flow} + 0.15 * {context}"
    fan = f"0.40 * greatest({asym('s')}, {asym('r')}) + 0.25 * {turn} + 0.20 * {flow} + 0.15 * {context}"
    even = f"(0.25 * (1.0 - {asym('s')}) + 0.25 * (1.0 - {asym('r')}) + 0.25 * (1.0 - abs({bias('s')})) + 0.25 * (1.0 - abs({bias('r')})))"
    cycle = f"0.40 * {even} + 0.20 * (0.5 * {close('pdeg_b')} + 0.5 * {close('sdeg_b')}) + 0.20 * {flow} + 0.20 * {context}"
    return {k: f"CAST({v} AS DOUBLE)" for k, v in {"chain_score": chain, "fan_score": fan, "cycle_score": cycle}.items()}


def _scored(d: SparkDialect, senders: str, receivers: str, places: str = "", meet: str = "") -> str:
    k = _kernels()
    return f"""SELECT x.*, greatest(chain_score, fan_score, cycle_score) AS compat,
        CASE WHEN chain_score >= fan_score AND chain_score >= cycle_score THEN 'CHAIN' WHEN fan_score >= cycle_score THEN 'FAN' ELSE 'CYCLE' END AS best
        FROM (SELECT s.tag, s.bank AS bank_s, r.bank AS bank_r, s.node AS node_s, r.node AS node_r, s.edge_id AS tx_s, r.edge_id AS tx_r,{places}
              {', '.join(f'{v} AS {n}' for n, v in k.items())}
              FROM ({senders}) s JOIN ({receivers}) r ON s.tag = r.tag{meet} AND s.bank <> r.bank) x"""


def _first_scored(d: SparkDialect) -> str:
    cap = _capped(d)
    return _scored(d, f"{cap} AND role = 'SENDER'", f"{cap} AND role = 'RECEIVER'", " s.rn AS rn_s, r.rn AS rn_r,")


def _all_scored(d: SparkDialect) -> str:
    """All pairs of a tag. On Spark the senders of a tag are dealt into parts that each meet all its receivers, so that no
    task has more than the pairs of one part; neither side is gathered."""
    if d.name != "spark":
        return _scored(d, "SELECT * FROM {evidence} v WHERE role = 'SENDER'", "SELECT * FROM {evidence} v WHERE role = 'RECEIVER'")
    senders, receivers = _role_features(d)
    sizes = f"SELECT tag AS sized, CAST(ceil(count(*) / {SENDERS}) AS INT) AS parts FROM {{tagged}} t WHERE is_inter GROUP BY tag"
    return _scored(
        d, f"SELECT v.*, CAST(pmod(xxhash64(v.edge_id), z.parts) AS INT) AS part FROM ({senders}) v JOIN ({sizes}) z ON v.tag = z.sized",
        f"SELECT v.*, explode(sequence(0, z.parts - 1)) AS part FROM ({receivers}) v JOIN ({sizes}) z ON v.tag = z.sized", meet=" AND s.part = r.part")


def pair_scores(d):
    """All senders and receivers of a tag in different parties, scored under three hypotheses."""
    return f"""SELECT tag, bank_s, bank_r, tx_s, tx_r, round(chain_score, 12) AS chain_score, round(fan_score, 12) AS fan_score, round(cycle_score, 12) AS cycle_score,
        round(compat, 12) AS compat, best FROM ({_all_scored(d)}) p"""


def mutual(d: SparkDialect) -> str:
    """Relation of the pairs among the best of both ends and above the threshold."""
    ranked = f"""SELECT p.*, row_number() OVER (PARTITION BY tag, bank_s, node_s, tx_s ORDER BY compat DESC, rn_r) AS rs,
        row_number() OVER (PARTITION BY tag, bank_r, node_r, tx_r ORDER BY compat DESC, rn_s) AS rr FROM ({_first_scored(d)}) p"""
    return f"SELECT * FROM ({ranked}) q WHERE rs <= {TOP_K} AND rr <= {TOP_K} AND compat >= {THRESHOLD}"


def mutual_topk(d):
    """Pairs among the best of both ends and above the threshold."""
    return f"SELECT tag, bank_s || '::' || node_s AS src_node, bank_r || '::' || node_r AS dst_node, tx_s, tx_r, round(compat, 12) AS weight, best FROM {{mutual}} m"


def compat_nodes(d):
    return f"""SELECT bank_s || '::' || node_s AS node_id, bank_s AS bank, node_s AS account FROM {{mutual}} a UNION SELECT bank_r || '::' || node_r, bank_r, node_r FROM {{mutual}} b"""


def compat_counts(d):
    return f"SELECT best, count(*) AS pairs, count(DISTINCT tag) AS tags, CAST(sum(CASE WHEN tx_s = tx_r THEN 1 ELSE 0 END) AS BIGINT) AS self_pairs, round(avg(compat), 6) AS mean_weight FROM {{mutual}} m GROUP BY best"


def rerank_score(kind: str = "candidate_type", n: str = "num_nodes", m: str = "num_edges", mean: str = "score_mean", low: str = "score_min", weight: float = -5.0) -> str:
    """Score of an assembled candidate. The gap between mean and minimum enters with the signed default weight."""
    fan, chain, cycle = f"{kind} IN ('FAN_IN', 'FAN_OUT')", f"{kind} = 'CHAIN'", f"{kind} = 'CYCLE'"
    density = f"(CAST({m} AS DOUBLE) / greatest({n}, 1))"
    target = f"(CAST({n} - 1 AS DOUBLE) / greatest({n}, 1))"
    return f"""(0.60 * {mean} + 0.40 * {low} + {weight} * (-abs({mean} - {low}))
        + CASE WHEN {chain} THEN 0.15 WHEN {cycle} THEN 0.12 WHEN {fan} THEN -0.08 ELSE 0.0 END
        + 0.10 * CASE WHEN {n} <= 0 THEN 0.0 WHEN {chain} THEN -abs({density} - {target}) WHEN {cycle} THEN -abs({density} - 1.0) WHEN {fan} THEN -0.5 * abs({density} - {target}) ELSE 0.0 END
        + CASE WHEN {chain} THEN 0.03 * least(greatest({m} - 2, 0), 4) WHEN {cycle} THEN 0.03 * least(greatest({n} - 2, 0), 3) WHEN {fan} THEN 0.01 * least(greatest({m} - 2, 0), 2) ELSE 0.0 END
        - CASE WHEN {fan} THEN 0.03 * greatest({n} - 6, 0) + 0.03 * greatest({m} - 5, 0)
               WHEN {chain} THEN (CASE WHEN {m} < 2 THEN 0.08 ELSE 0.0 END) + 0.02 * greatest({m} - 6, 0)
               WHEN {cycle} THEN 0.025 * greatest({n} - 5, 0) ELSE 0.0 END)"""


def _fans(d: SparkDialect, kind: str, centre: str, leaf: str, edges: str) -> str:
    return f"""SELECT '{kind}' AS candidate_type, centre, {d.set_text(d.append(d.split_text('leaves'), 'centre'))} AS nodes, edges, m + 1 AS num_nodes, m AS num_edges, score_mean, score_min
        FROM (SELECT {centre} AS centre, {d.agg_set(leaf)} AS leaves, {d.agg_set('edge_id')} AS edges, count(*) AS m, round(avg(w), 12) AS score_mean, min(w) AS score_min
              FROM ({edges}) e GROUP BY {centre} HAVING count(*) >= 3) g"""


def _last_edges(d: SparkDialect) -> str:
    """Crossing edges, the last of each pair, weights scaled into 0..1."""
    return f"SELECT src, dst, max_by(edge_id, ord) AS edge_id, max_by(weight, ord) / 500000.0 AS w FROM {{tagged}} t WHERE is_inter GROUP BY src, dst"


def fan_candidates(d):
    e = _last_edges(d)
    both = _fans(d, "FAN_IN", "dst", "src", e) + " UNION ALL " + _fans(d, "FAN_OUT", "src", "dst", e)
    return f"SELECT candidate_type, centre, nodes, edges, num_nodes, num_edges, round(score_mean, 12) AS score_mean, round(score_min, 12) AS score_min FROM ({both}) f"


def ranked_fan_in(d):
    fans = _fans(d, "FAN_IN", "dst", "src", _last_edges(d))
    scored = f"SELECT centre, nodes, edges, num_nodes, num_edges, round({rerank_score()}, 12) AS rerank_score FROM ({fans}) f"
    return f"SELECT centre, nodes, edges, num_nodes, num_edges, rerank_score, CAST(place AS BIGINT) AS place FROM ({d.ranked(scored, 'rerank_score DESC, centre', 'place')}) r"


def assembly_edges(d):
    """Relation of the mutual pairs as edges between accounts, by hypothesis; the last of a pair's rows counts."""
    last = "tag || '|' || tx_s || '|' || tx_r"
    return f"""SELECT best, bank_s || '::' || node_s AS src, bank_r || '::' || node_r AS dst, max_by(tx_s, {last}) AS tx_s, max_by(tx_r, {last}) AS tx_r, max_by(compat, {last}) AS w
        FROM {{mutual}} GROUP BY best, bank_s || '::' || node_s, bank_r || '::' || node_r"""


def _signature(d: SparkDialect, rows: str) -> str:
    """Candidates with equal type, nodes and transactions once."""
    return f"""SELECT candidate_type, nodes, tx_ids, num_nodes, num_edges, score_mean, score_min FROM (SELECT c.*, row_number() OVER (PARTITION BY candidate_type, nodes, tx_ids ORDER BY score_mean DESC, score_min DESC) AS again
        FROM ({rows}) c) o WHERE again = 1"""


def fan_pairs(d, least: int = 3):
    """FAN candidates: a centre with at least ``least`` senders or receivers among the pairs whose best hypothesis is FAN."""
    parts = []
    for kind, centre, leaf in (("FAN_IN", "dst", "src"), ("FAN_OUT", "src", "dst")):
        ends = f"SELECT {centre} AS centre, {leaf} AS leaf, tx_s, tx_r, w FROM {{assembly_edges}} WHERE best = 'FAN'"
        tx = f"SELECT centre, tx_s AS tx FROM ({ends}) e UNION ALL SELECT centre, tx_r FROM ({ends}) e2"
        parts.append(f"""SELECT '{kind}' AS candidate_type, {d.set_text(d.append(d.split_text('g.leaves'), 'g.centre'))} AS nodes, t.tx_ids, g.m + 1 AS num_nodes, g.m AS num_edges, g.score_mean, g.score_min
            FROM (SELECT centre, {d.agg_set('leaf')} AS leaves, count(*) AS m, round(avg(w), 12) AS score_mean, round(min(w), 12) AS score_min FROM ({ends}) e3 GROUP BY centre HAVING count(*) >= {least}) g
            JOIN (SELECT centre, {d.agg_set('tx')} AS tx_ids FROM ({tx}) x GROUP BY centre) t ON g.centre = t.centre""")
    return _signature(d, " UNION ALL ".join(parts))


def cycle_pairs(d, longest: int = 5):
    """CYCLE candidates of 2 to ``longest`` accounts (five at most here) among the pairs whose best hypothesis is CYCLE.

    A cycle is met once, from its smallest account: paths that leave it are joined in the middle with paths that lead
    back, so that no path of more than three edges is listed. ``directed_cycles`` has no such bound.
    """
    e = "(SELECT src, dst, tx_s, tx_r, w FROM {assembly_edges} WHERE best = 'CYCLE')"
    out2 = f"(SELECT x.src AS s, x.dst AS m, y.dst AS t, x.tx_s AS a1, x.tx_r AS a2, y.tx_s AS a3, y.tx_r AS a4, x.w AS w1, y.w AS w2 FROM {e} x JOIN {e} y ON x.dst = y.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst)"
    back2 = f"(SELECT y.dst AS s, x.dst AS m, x.src AS t, x.tx_s AS a1, x.tx_r AS a2, y.tx_s AS a3, y.tx_r AS a4, x.w AS w1, y.w AS w2 FROM {e} x JOIN {e} y ON x.dst = y.src WHERE y.dst < x.dst AND y.dst < x.src AND x.dst <> x.src)"

    def one(nodes: list[str], tx: list[str], w: list[str], rest: str) -> str:
        n = len(nodes)
        return f"""SELECT 'CYCLE' AS candidate_type, {d.set_of(*nodes)} AS nodes, {d.set_of(*tx)} AS tx_ids, CAST({n} AS BIGINT) AS num_nodes, CAST({n} AS BIGINT) AS num_edges,
            round(({' + '.join(w)}) / {n}.0, 12) AS score_mean, round(least({', '.join(w)}), 12) AS score_min FROM {rest}"""

    two = [f"o.{c}" for c in ("a1", "a2", "a3", "a4")]
    back = [f"b.{c}" for c in ("a1", "a2", "a3", "a4")]
    parts = [
        one(["x.src", "x.dst"], ["x.tx_s", "x.tx_r", "y.tx_s", "y.tx_r"], ["x.w", "y.w"], f"{e} x JOIN {e} y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst"),
        one(["o.s", "o.m", "o.t"], [*two, "z.tx_s", "z.tx_r"], ["o.w1", "o.w2", "z.w"], f"{out2} o JOIN {e} z ON z.src = o.t AND z.dst = o.s"),
        one(["o.s", "o.m", "o.t", "b.m"], two + back, ["o.w1", "o.w2", "b.w1", "b.w2"], f"{out2} o JOIN {back2} b ON b.s = o.s AND b.t = o.t WHERE b.m <> o.m"),
        one(["o.s", "o.m", "o.t", "b.t", "b.m"], [*two, "z.tx_s", "z.tx_r", *back], ["o.w1", "o.w2", "z.w", "b.w1", "b.w2"],
            f"{out2} o JOIN {e} z ON z.src = o.t JOIN {back2} b ON b.s = o.s AND b.t = z.dst WHERE z.dst <> o.m AND b.m <> o.m AND b.m <> o.t"),
    ]
    return _signature(d, " UNION ALL ".join(parts[: longest - 1]))


def rerank_evidence(d):
    """Chains, fans and cycles of the mutual pairs scored together, repeated signatures dropped."""
    columns = "candidate_type, nodes, tx_ids, num_nodes, num_edges, score_mean, score_min"
    rows = f"SELECT {columns} FROM ({fan_pairs(d)}) f UNION ALL SELECT {columns} FROM {{cycles}} UNION ALL SELECT {columns} FROM {{chains}}"
    return f"SELECT candidate_type, nodes, tx_ids, num_nodes, num_edges, round(score_mean, 9) AS score_mean, round(score_min, 9) AS score_min, round({rerank_score()}, 9) AS rerank_score FROM ({_signature(d, rows)}) r"


def evidence_predictions(d, budget: int = 1000):
    """The budget's best evidence candidates as predictions, accounts without their bank. The budget is the operator's own."""
    bare = "regexp_replace(nodes, '[^,:]+::', '')" if d.name == "spark" else "regexp_replace(nodes, '[^,:]+::', '', 'g')"
    order = "rerank_score DESC, score_mean DESC, score_min DESC, num_edges DESC, candidate_type, nodes, tx_ids"
    return f"SELECT CAST(place AS BIGINT) AS place, candidate_type, {bare} AS nodes, tx_ids, rerank_score AS score FROM ({d.ranked('SELECT * FROM {reranked}', order, 'place')}) s WHERE place <= {budget}"


DEFINITIONS = {f.__name__: f for f in (
    public_tag, bank_view, local_edges, node_stats, evidence_features, tag_buckets, pair_scores, mutual_topk, compat_nodes, compat_counts, fan_candidates, ranked_fan_in,
    fan_pairs, cycle_pairs, rerank_evidence, evidence_predictions)}
