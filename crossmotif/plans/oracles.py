"""Reference SQL written apart from the definitions it checks.

The definitions render their own reference, which shows that two engines agree on one text. The queries here
are put differently: ranks by counting better rows or by ordered lists, averages by running sums, matches by
intersecting lists, joins by correlated tests. They share stored relations with the definitions, not their logic.
"""

from __future__ import annotations

from crossmotif.operators.chains import CHAINS_SQL
from crossmotif.operators.directed import DIRECTED, KERNELS_SQL
from crossmotif.operators.matching import SHAPES_SQL
from crossmotif.operators.packing import PACKING_SQL
from crossmotif.operators.reach import REACH_SQL
from crossmotif.operators.sanitise import VIEW_SQL
from crossmotif.plans.relational import common_tables
from crossmotif.sources.graph_tables import DUCK_RELATIONS

# name: (relations read, SQL over them)
APART: dict[str, tuple[list[str], str]] = {
    "mutual_topk": (["evidence"], """
        , capped AS (SELECT * FROM (SELECT e.*, (SELECT count(*) FROM evidence b WHERE b.tag = e.tag AND b.role = e.role AND (b.bank, b.ord) < (e.bank, e.ord)) AS ahead FROM evidence e) WHERE ahead < 5),
        k AS (SELECT s.tag, s.bank AS bs, r.bank AS br, s.node AS ns, r.node AS nr, s.edge_id AS ts, r.edge_id AS tr, s.ahead AS sa, r.ahead AS ra,
            abs(s.pdeg - s.sdeg) / (s.pdeg + s.sdeg + 1.0e0) AS asym_s, abs(r.pdeg - r.sdeg) / (r.pdeg + r.sdeg + 1.0e0) AS asym_r,
            (s.pr2 - s.or2) / (s.pr2 + s.or2 + 1.0e0) AS bias_s, (r.pr2 - r.or2) / (r.pr2 + r.or2 + 1.0e0) AS bias_r,
            1.0e0 / (1 + abs(s.amount_b - r.amount_b)) AS amount, 1.0e0 / (1 + abs(s.hour_b - r.hour_b)) AS hour_, (s.pay_format = r.pay_format)::INT AS format_, (s.currency = r.currency)::INT AS currency_,
            1.0e0 / (1 + abs(s.pdeg_b - r.pdeg_b)) AS near_p, 1.0e0 / (1 + abs(s.sdeg_b - r.sdeg_b)) AS near_s
            FROM capped s JOIN capped r ON s.tag = r.tag AND s.role = 'SENDER' AND r.role = 'RECEIVER' AND s.bank <> r.bank),
        h AS (SELECT *, 0.4e0 * hour_ + 0.2e0 * format_ + 0.4e0 * currency_ AS context, ((bias_s + 1) / 2 + (bias_r + 1) / 2) / 2 AS turn FROM k),
        c AS (SELECT *, 0.35e0 * turn + 0.25e0 * (asym_s + asym_r) / 2 + 0.25e0 * amount + 0.15e0 * context AS chain, 0.40e0 * greatest(asym_s, asym_r) + 0.25e0 * turn + 0.20e0 * amount + 0.15e0 * context AS fan,
            0.10e0 * (4 - asym_s - asym_r - abs(bias_s) - abs(bias_r)) + 0.10e0 * (near_p + near_s) + 0.20e0 * amount + 0.20e0 * context AS cyc FROM h),
        b AS (SELECT *, round(greatest(chain, fan, cyc), 12) AS w, CASE WHEN round(chain, 12) >= round(greatest(fan, cyc), 12) THEN 'CHAIN' WHEN round(fan, 12) >= round(cyc, 12) THEN 'FAN' ELSE 'CYCLE' END AS best FROM c)
        SELECT tag, bs || '::' || ns AS src_node, br || '::' || nr AS dst_node, ts AS tx_s, tr AS tx_r, w AS weight, best FROM b
        WHERE w >= 0.72 AND (SELECT count(*) FROM b o WHERE o.tag = b.tag AND o.bs = b.bs AND o.ns = b.ns AND o.ts = b.ts AND (o.w > b.w OR (o.w = b.w AND o.ra < b.ra))) < 3
          AND (SELECT count(*) FROM b o WHERE o.tag = b.tag AND o.br = b.br AND o.nr = b.nr AND o.tr = b.tr AND (o.w > b.w OR (o.w = b.w AND o.sa < b.sa))) < 3"""),
    "topk_per_query": (["scored"], """
        , best AS (SELECT anchor, list({'raw_score': raw_score, 'candidate_type': candidate_type, 'nodes': nodes, 'edges': edges}
            ORDER BY raw_score DESC, candidate_type <> 'triangle', candidate_type, edges, nodes)[:24] AS l FROM scored GROUP BY anchor)
        SELECT anchor, x.candidate_type, x.nodes, x.edges, round(x.raw_score, 6) AS raw_score, CAST(rn AS BIGINT) AS rn FROM (SELECT anchor, unnest(l) AS x, generate_subscripts(l, 1) AS rn FROM best)"""),
    "hit_at_k": (["matched"], """
        SELECT CAST(k AS BIGINT) AS k, CAST(EXISTS (SELECT 1 FROM matched m WHERE m.place <= k AND m.gt_pos IS NOT NULL) AS BIGINT) AS hit FROM (SELECT unnest([1, 5, 10, 50, 100]) AS k)"""),
    "mrr": (["matched"], "SELECT coalesce(round(max(1.0 / place), 6), 0.0) AS mrr FROM matched WHERE gt_pos IS NOT NULL"),
    "auc": (["matched"], """
        , s AS (SELECT score, sum(hit) AS p, sum(1 - hit) AS n FROM matched GROUP BY score),
        c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
        SELECT CASE WHEN sum(p) = 0 OR sum(n) = 0 THEN NULL ELSE round(CAST(sum(p * (below + n / 2.0)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) END AS auc FROM c"""),
    "avg_precision": (["matched"], """
        , r AS (SELECT hit, place, sum(hit) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS got FROM matched)
        SELECT round(coalesce(sum(CASE WHEN hit = 1 THEN CAST(got AS DOUBLE) / place END) / max(got), 0.0), 6) AS avg_precision FROM r"""),
    "overlap_at_k": (["matched", "ground_truth"], """
        , l AS (SELECT k, (SELECT list(gt_pos) FROM matched m WHERE m.place <= k) AS g, (SELECT count(*) FROM matched m WHERE m.place <= k) AS seen FROM (SELECT unnest([10, 20, 50, 100, 200, 500, 1000]) AS k))
        SELECT CAST(k AS BIGINT) AS k, CAST(len(list_filter(g, lambda x: x IS NOT NULL)) AS BIGINT) AS hits, CAST(len(list_distinct(g)) AS BIGINT) AS motifs,
            round(CAST(len(list_filter(g, lambda x: x IS NOT NULL)) AS DOUBLE) / seen, 6) AS purity, round(CAST(len(list_distinct(g)) AS DOUBLE) / greatest((SELECT count(*) FROM ground_truth), 1), 6) AS motif_recall FROM l WHERE seen > 0"""),
    "prf": (["predictions", "ground_truth"], """
        , t AS (SELECT pid, string_split(nodes, ',') AS pn, string_split(edges, ',') AS pe FROM predictions), m AS (SELECT gt_pos, string_split(nodes, ',') AS gn, string_split(edges, ',') AS ge FROM ground_truth),
        near AS (SELECT DISTINCT a.pid, b.gt_pos FROM (SELECT pid, unnest(pn) AS x FROM t UNION ALL SELECT pid, 'edge ' || unnest(pe) FROM t) a JOIN (SELECT gt_pos, unnest(gn) AS x FROM m UNION ALL SELECT gt_pos, 'edge ' || unnest(ge) FROM m) b ON a.x = b.x),
        o AS (SELECT n.pid, n.gt_pos, len(list_intersect(pn, gn)) AS nh, len(list_intersect(pe, ge)) AS eh, len(gn) AS gn, len(ge) AS ge, len(pn) AS pn, len(pe) AS pe FROM near n JOIN t ON t.pid = n.pid JOIN m ON m.gt_pos = n.gt_pos),
        w AS (SELECT pid, arg_max({'nh': nh, 'eh': eh, 'gn': gn, 'ge': ge}, [CAST(nh + eh AS DOUBLE) / (pn + pe + gn + ge - nh - eh), CAST(eh AS DOUBLE) / (pe + ge - eh), CAST(gt_pos AS DOUBLE)]) AS x FROM o GROUP BY pid),
        s AS (SELECT CAST(sum(coalesce(x.nh, 0)) AS BIGINT) AS ntp, CAST(sum(len(pn) - coalesce(x.nh, 0)) AS BIGINT) AS nfp, CAST(sum(coalesce(x.gn - x.nh, 0)) AS BIGINT) AS nfn,
            CAST(sum(coalesce(x.eh, 0)) AS BIGINT) AS etp, CAST(sum(len(pe) - coalesce(x.eh, 0)) AS BIGINT) AS efp, CAST(sum(coalesce(x.ge - x.eh, 0)) AS BIGINT) AS efn FROM t LEFT JOIN w ON t.pid = w.pid),
        z AS (SELECT 'node' AS level, ntp AS tp, nfp AS fp, nfn AS fn FROM s UNION ALL SELECT 'edge', etp, efp, efn FROM s)
        SELECT level, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision_, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
            round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0e0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM z"""),
    "sampled_motifs": (["ground_truth", "flow", "node_party"], """
        , x AS (SELECT g.gt_pos, g.motif_type, g.nodes, EXISTS (SELECT 1 FROM flow f JOIN node_party a ON a.node = f.src JOIN node_party b ON b.node = f.dst WHERE list_contains(string_split(g.edges, ','), f.edge_id) AND a.party <> b.party) AS crossing FROM ground_truth g),
        l AS (SELECT motif_type, list({'gt_pos': gt_pos, 'crossing': crossing} ORDER BY crossing DESC, CAST('0x' || substr(md5('9|' || nodes), 1, 12) AS BIGINT), gt_pos)[:100] AS m FROM x GROUP BY motif_type)
        SELECT v.gt_pos, CAST(v.crossing AS BIGINT) AS crossing, CAST(rn AS BIGINT) AS rn FROM (SELECT unnest(m) AS v, generate_subscripts(m, 1) AS rn FROM l)"""),
}

_SCORED = f"""
    , shaped AS (SELECT * FROM shapes), sized AS (SELECT c.*, len(string_split(nodes, ',')) AS n, len(string_split(edges, ',')) AS m,
        (SELECT count(DISTINCT p.party) FROM node_party p WHERE list_contains(string_split(c.nodes, ','), p.node)) AS parties FROM candidates c),
    inner_edges AS (SELECT anchor, candidate_type, nodes, edges, count(*) AS known, count(*) FILTER (src <> dst) AS proper FROM ends GROUP BY ALL),
    base AS (SELECT z.*, coalesce(i.known, 0) AS known, coalesce(s.path_length, 0) AS path_length, coalesce(s.has_cycle, false) AS has_cycle, coalesce(s.near_cycle, false) AS near_cycle, coalesce(s.feed_forward, 0) AS ff,
        coalesce(s.star_score, 0) AS star, least(1.0e0, parties / 2.0e0) AS cross_, least(1.0e0, greatest(0.0e0, (parties - 2) / 3.0e0)) AS multi,
        CASE WHEN z.n <= 1 THEN 0.0e0 ELSE CAST(coalesce(i.proper, 0) AS DOUBLE) / (z.n * (z.n - 1)) END AS density
        FROM sized z LEFT JOIN shaped s USING (anchor, candidate_type, nodes, edges) LEFT JOIN inner_edges i USING (anchor, candidate_type, nodes, edges)),
    parts AS (SELECT *, (CAST(least(n, 3) AS DOUBLE) / greatest(n, 3) + CAST(least(m, 3) AS DOUBLE) / greatest(m, 3)) / 2 AS fit, least(1.0e0, CAST(m AS DOUBLE) / greatest(1, n - 1)) AS compact,
        CASE WHEN n <= 2 THEN CASE WHEN m <= 1 THEN 0.0e0 ELSE 0.25e0 END ELSE least(1.0e0, least(1.0e0, CAST(m AS DOUBLE) / n)
            + CASE WHEN candidate_type IN ('triangle', 'cycle4', 'directed_cycle', 'feed_forward', 'dense_subgraph', 'dense_hyperlink_block') THEN 0.25e0 ELSE 0 END) END AS closure,
        CAST(coalesce(map {{'triangle': 0.10, 'cycle4': 0.10, 'feed_forward': 0.10, 'dense_subgraph': 0.08, 'multi_partition_bridge': 0.12, 'star': 0.02, 'fan_in': 0.02, 'fan_out': 0.02, 'chain': 0.03,
            'directed_cycle': 0.16, 'dense_hyperlink_block': 0.18, 'directed_chain': 0.16, 'directed_star': 0.10}}[candidate_type], 0) AS DOUBLE) AS bonus,
        CAST(CASE WHEN m <= 1 THEN 0.18 WHEN candidate_type = 'dense_hyperlink_block' THEN 0.04 * greatest(n - 6, 0) WHEN candidate_type = 'directed_chain' AND m > 5 THEN 0.04
            WHEN candidate_type = 'directed_cycle' AND (m < 3 OR m > 5) THEN 0.05 WHEN candidate_type = 'feed_forward' THEN CASE WHEN m >= 3 THEN 0.03 ELSE 0.08 END ELSE 0 END AS DOUBLE) AS penalty,
        CASE WHEN n <= 1 THEN 0.0e0 WHEN candidate_type = 'dense_hyperlink_block' THEN least(1.0e0, 2.2e0 * density + 0.2e0 * cross_ + CASE WHEN n >= 4 AND known >= 4 THEN 0.1e0 ELSE 0 END)
            WHEN candidate_type = 'feed_forward' THEN least(1.0e0, 1.5e0 * density) ELSE least(1.0e0, 1.2e0 * density) END AS dens,
        CASE WHEN candidate_type = 'directed_chain' AND path_length >= 2 THEN least(1.0e0, 0.25e0 * path_length + 0.25e0 * cross_) ELSE 0.0e0 END AS path,
        CASE WHEN candidate_type <> 'directed_cycle' OR known = 0 THEN 0.0e0 WHEN n > 6 THEN 0.15e0 WHEN has_cycle THEN 1.0e0 WHEN near_cycle THEN 0.65e0 ELSE 0.2e0 END AS ring FROM base),
    done AS (SELECT *, CAST(CASE WHEN known = 0 OR NOT (candidate_type IN {DIRECTED} OR candidate_type IN ('cycle', 'cycle4')) THEN 0 WHEN candidate_type = 'feed_forward' THEN ff
        WHEN candidate_type = 'directed_chain' THEN CASE WHEN path_length >= 2 THEN least(1.0e0, 0.35e0 * path_length) ELSE 0 END WHEN candidate_type = 'directed_cycle' THEN ring
        WHEN candidate_type = 'dense_hyperlink_block' THEN least(1.0e0, 0.45e0 + dens) WHEN candidate_type = 'directed_star' THEN star ELSE 0.25 END AS DOUBLE) AS agree FROM parts),
    final AS (SELECT anchor, candidate_type, nodes, edges, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(agree, 6) AS consistency, round(dens, 6) AS directed_density, round(path, 6) AS directed_path, round(ring, 6) AS directed_cycle_score,
        round(fit + compact + cross_ + 0.5e0 * multi + closure + bonus - penalty + 0.6e0 * agree + 0.5e0 * dens + 0.4e0 * path + 0.4e0 * ring, 9) AS raw_score,
        round(0.20e0 * fit + 0.10e0 * compact + 0.22e0 * cross_ + 0.10e0 * multi + 0.14e0 * closure + 0.18e0 * agree + 0.16e0 * dens + 0.10e0 * path + 0.10e0 * ring
            + CASE WHEN anchor = '' THEN 0 ELSE 0.04e0 END + bonus - penalty, 9) AS score FROM done)"""


def _shapes(extra: dict[str, str], pool: str) -> str:
    """The shape kernels over ``pool`` as a common table of that name, before what reads them."""
    renamed = extra | {"candidates": f"SELECT * FROM {{{pool}}}"} if pool != "candidates" else extra
    head = common_tables(["candidates", "flow", "node_party"], renamed, recursive=True)
    cut = KERNELS_SQL.rindex("SELECT s.anchor")
    return head + ", " + KERNELS_SQL[:cut].rstrip() + ", shapes AS (" + KERNELS_SQL[cut:] + ")"


def own(extra: dict[str, str]) -> dict[str, str]:
    found = {}
    for name, (reads, text) in APART.items():
        head = common_tables(reads, extra).rstrip()
        found[name] = f"{head} {text.strip()}"
    scored = _shapes(extra, "directed_pool") + _SCORED
    found["directed_scores"] = scored + " SELECT * FROM final"
    liked = f"candidate_type IN {DIRECTED}"
    # A query's selection, rank by rank: the first of each preferred type, then by score under the cap of other types.
    found["balanced_selection"] = scored + f""", o AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY raw_score DESC, candidate_type <> 'triangle', candidate_type, edges, nodes) AS r FROM final),
        per AS (SELECT anchor, candidate_type, list({{'r': r, 'nodes': nodes, 'edges': edges, 'raw_score': raw_score}} ORDER BY r) AS l FROM o GROUP BY anchor, candidate_type),
        sizes AS (SELECT anchor, sum(len(l)) AS all_ FROM per GROUP BY anchor),
        t AS (SELECT anchor, candidate_type, all_, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS before_ FROM per JOIN sizes USING (anchor)),
        best AS (SELECT anchor, list({{'candidate_type': candidate_type, 'x': x}} ORDER BY CASE WHEN {liked} AND before_ = 0 THEN 0 ELSE 1 END, x.r)[:24] AS l FROM t WHERE all_ <= 24 OR {liked} OR before_ < 8 GROUP BY anchor)
        SELECT anchor, v.candidate_type, v.x.nodes AS nodes, v.x.edges AS edges, round(v.x.raw_score, 6) AS raw_score FROM (SELECT anchor, unnest(l) AS v FROM best)"""
    found["payment_chains"] = common_tables(["flow"], extra, recursive=True) + CHAINS_SQL.lstrip()
    found["hop_reach"] = common_tables(["flow"], extra, recursive=True) + REACH_SQL.lstrip()
    found["packed_party"] = common_tables(["flow"], extra, recursive=True) + PACKING_SQL.lstrip()
    found["method_view"] = common_tables(["ground_truth", "flow", "node_party"], extra) + VIEW_SQL.lstrip()
    shapes = common_tables(["flow", "pair_und"], extra) + SHAPES_SQL.lstrip()
    found["pattern_queries"] = shapes + " SELECT query_id, pattern, 'matched' AS status FROM shape"
    found["pattern_matches"] = shapes + " SELECT * FROM hit"
    found["vf2_predictions"] = shapes + """, p AS (SELECT query_id, mapping, nodes, edges FROM shape JOIN hit USING (pattern)), r AS (SELECT *, row_number() OVER (ORDER BY query_id, mapping) AS place FROM p)
        SELECT place, query_id, nodes, edges, 1.0e0 AS score FROM r WHERE place <= 100"""
    found["component_party"] = f"""WITH RECURSIVE flow AS ({DUCK_RELATIONS["flow"]}), e AS (SELECT src AS a, dst AS b FROM flow UNION SELECT dst, src FROM flow),
        r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), c AS (SELECT node, min(other) AS component FROM r GROUP BY node),
        s AS (SELECT list(component ORDER BY size DESC, component) AS l FROM (SELECT component, count(*) AS size FROM c GROUP BY component)),
        p AS (SELECT unnest(l) AS component, generate_subscripts(l, 1) - 1 AS i FROM s)
        SELECT c.node, c.component, 'P' || CASE WHEN (p.i // 5) % 2 = 0 THEN p.i % 5 ELSE 4 - p.i % 5 END AS party FROM c JOIN p USING (component)"""
    return found
