"""Evaluation of ranked predictions against ground-truth motifs.

Matching is an inverted-index join: predictions and motifs meet on shared node and edge
items, and pairs without a shared item can never win. ``matched`` holds one row per
prediction with its best motif, if any.
"""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect


def ground_truth(d):
    """All undirected triangles of the graph, numbered by their sorted nodes."""
    found = f"""SELECT x.a AS n1, x.b AS n2, y.b AS n3, {d.set_of('x.a', 'x.b', 'y.b')} AS nodes, {d.set_of('x.edge_id', 'y.edge_id', 'z.edge_id')} AS edges
        FROM {{pair_und}} x JOIN {{pair_und}} y ON x.b = y.a JOIN {{pair_und}} z ON z.a = x.a AND z.b = y.b WHERE x.a <> x.b AND y.a <> y.b"""
    if d.name == "spark":
        found = f"SELECT n1, n2, n3, {d.set_of('n1', 'n2', 'n3')} AS nodes, {d.set_of('e1', 'e2', 'e3')} AS edges FROM {{triangles}}"
    return f"""SELECT CAST(place AS BIGINT) AS gt_pos, nodes, edges, CASE WHEN CAST(n1 AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS motif_type, CAST(3 AS BIGINT) AS gn, CAST(3 AS BIGINT) AS ge
        FROM ({d.ranked(found, 'n1, n2, n3', 'place')}) t"""


def predictions(d):
    """Scored candidates in evaluation order: score descending, then the input index as text."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    indexed = d.ranked("SELECT anchor AS query_id, candidate_type, nodes, edges, n AS pn, m AS pe, score FROM {scored}", "query_id, candidate_type, nodes, edges", "input_place")
    rows = f"SELECT query_id, candidate_type, nodes, edges, pn, pe, score, CAST(input_place - 1 AS {text}) AS pid FROM ({indexed}) p"
    return d.ranked(rows, "score DESC, pid", "place")


def _items(d: SparkDialect, source: str, key: str, extra: str = "") -> str:
    parts = []
    for mark, column in (("n:", "nodes"), ("e:", "edges")):
        rows = d.unnest(f"(SELECT {key}{extra}, {d.split_text(column)} AS parts FROM {source}) s", "parts", "part")
        parts.append(f"SELECT {key}{extra}, '{mark}' || part AS item FROM {rows}")
    return " UNION ALL ".join(parts)


def matched(d, bound: bool = False):
    """Best motif of each prediction: combined Jaccard, then edge Jaccard, then the last motif."""
    hits = f"""SELECT p.pid, g.gt_pos, sum(CASE WHEN p.item LIKE 'n:%' THEN 1 ELSE 0 END) AS nh, sum(CASE WHEN p.item LIKE 'e:%' THEN 1 ELSE 0 END) AS eh
        FROM ({_items(d, '{predictions}', 'pid')}) p JOIN ({_items(d, '{ground_truth}', 'gt_pos')}) g ON p.item = g.item GROUP BY p.pid, g.gt_pos"""
    pairs = f"""SELECT h.pid, h.gt_pos, CAST(h.nh AS BIGINT) AS nh, CAST(h.eh AS BIGINT) AS eh, g.gn, g.ge, g.motif_type,
        CAST(h.nh + h.eh AS DOUBLE) / (p.pn + p.pe + g.gn + g.ge - h.nh - h.eh) AS combined,
        CASE WHEN p.pe + g.ge = 0 THEN CAST(h.nh AS DOUBLE) / (p.pn + g.gn - h.nh) ELSE CAST(h.eh AS DOUBLE) / (p.pe + g.ge - h.eh) END AS structure
        FROM ({hits}) h JOIN {{predictions}} p ON h.pid = p.pid JOIN {{ground_truth}} g ON h.gt_pos = g.gt_pos"""
    best = f"SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY pid ORDER BY combined DESC, structure DESC, gt_pos DESC) AS pick FROM ({pairs}) q) b WHERE pick = 1"
    return f"""SELECT p.pid, p.place, p.query_id, p.candidate_type, p.score, p.pn, p.pe, b.gt_pos, b.motif_type, coalesce(b.nh, 0) AS nh, coalesce(b.eh, 0) AS eh, coalesce(b.gn, 0) AS gn,
        coalesce(b.ge, 0) AS ge, coalesce(b.combined, 0.0) AS combined, coalesce(b.structure, 0.0) AS structure, CASE WHEN b.gt_pos IS NULL THEN 0 ELSE 1 END AS hit
        FROM {{predictions}} p LEFT JOIN ({best}) b ON p.pid = b.pid"""


def best_match(d):
    return "SELECT pid, CAST(place AS BIGINT) AS place, gt_pos, nh, eh, round(combined, 6) AS combined, round(structure, 6) AS structure, CAST(hit AS BIGINT) AS hit FROM {matched}"


def prf(d):
    """Micro precision, recall and F1 of nodes and edges; predictions without a match are false positives."""
    parts = []
    for name, h, p, g in (("node", "nh", "pn", "gn"), ("edge", "eh", "pe", "ge")):
        parts.append(f"""SELECT '{name}' AS level, tp, fp, fn, round(tp / greatest(CAST(tp + fp AS DOUBLE), 1), 6) AS precision_, round(tp / greatest(CAST(tp + fn AS DOUBLE), 1), 6) AS recall,
            round(2.0 * tp / greatest(CAST(2 * tp + fp + fn AS DOUBLE), 1), 6) AS f1
            FROM (SELECT CAST(sum({h}) AS BIGINT) AS tp, CAST(sum({p} - {h}) AS BIGINT) AS fp, CAST(sum({g} - {h}) AS BIGINT) AS fn FROM {{matched}}) s""")
    return " UNION ALL ".join(parts)


def match_rates(d):
    """Exact and partial match rates, mean Jaccards, motif recall and F1."""
    return """SELECT round(avg(CASE WHEN combined >= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END), 6) AS partial_rate,
        round(avg(combined), 6) AS mean_jaccard, round(avg(structure), 6) AS structure_consistency, count(DISTINCT gt_pos) AS motifs_found,
        round(CAST(count(DISTINCT gt_pos) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM {ground_truth}), 6) AS motif_recall FROM {matched}"""


def unique_recall(d):
    """Share of ground-truth nodes and edges that some matched prediction covers."""
    p = _items(d, "(SELECT m.gt_pos, p.nodes, p.edges FROM {matched} m JOIN {predictions} p ON m.pid = p.pid WHERE m.hit = 1) z", "gt_pos")
    g = _items(d, "{ground_truth}", "gt_pos")
    return f"""SELECT substr(g.item, 1, 1) AS level, count(DISTINCT g.item) AS total, count(DISTINCT p.item) AS covered, round(CAST(count(DISTINCT p.item) AS DOUBLE) / count(DISTINCT g.item), 6) AS recall
        FROM ({g}) g LEFT JOIN ({p}) p ON g.item = p.item AND g.gt_pos = p.gt_pos GROUP BY substr(g.item, 1, 1)"""


def _ks(ks: list[int]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS k" for k in ks)


def hit_at_k(d):
    return f"SELECT CAST(k AS BIGINT) AS k, CAST(max(CASE WHEN place <= k THEN hit ELSE 0 END) AS BIGINT) AS hit FROM {{matched}} CROSS JOIN ({_ks([1, 5, 10, 50, 100])}) c GROUP BY k"


def mrr(d):
    return "SELECT coalesce(round(1.0 / min(CASE WHEN hit = 1 THEN place END), 6), 0.0) AS mrr FROM {matched}"


def auc(d):
    """Mann-Whitney AUC from average ranks; null if a class is empty."""
    ranks = d.ranked("SELECT hit, score, pid FROM {matched}", "score, pid", "r")
    levels = f"SELECT score, sum(hit) AS hits, count(*) AS rows_, avg(r) AS mean_rank FROM ({ranks}) x GROUP BY score"
    return f"""SELECT CASE WHEN p = 0 OR n = 0 THEN NULL ELSE round((s - p * (p + 1) / 2.0) / (p * n), 6) END AS auc
        FROM (SELECT CAST(sum(hits) AS DOUBLE) AS p, CAST(sum(rows_ - hits) AS DOUBLE) AS n, sum(hits * mean_rank) AS s FROM ({levels}) y) z"""


def avg_precision(d):
    return f"SELECT round(coalesce(sum(CAST(got AS DOUBLE) / place) / count(*), 0.0), 6) AS avg_precision FROM ({d.ranked('SELECT place FROM {matched} WHERE hit = 1', 'place', 'got')}) r"


def overlap_at_k(d):
    """Purity, motif recall, hits and distinct motifs in prefixes of the ranking."""
    return f"""SELECT CAST(k AS BIGINT) AS k, CAST(sum(hit) AS BIGINT) AS hits, count(DISTINCT gt_pos) AS motifs, round(CAST(sum(hit) AS DOUBLE) / count(*), 6) AS purity,
        round(CAST(count(DISTINCT gt_pos) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM {{ground_truth}}), 6) AS motif_recall
        FROM {{matched}} JOIN ({_ks([10, 20, 50, 100, 200, 500, 1000])}) c ON place <= k GROUP BY k"""


def strict_overlap(d):
    """Hits under stricter rules: node or edge Jaccard of .10, .25, .50, and both of .25."""
    node, edge = "(CAST(nh AS DOUBLE) / greatest(pn + gn - nh, 1))", "(CAST(eh AS DOUBLE) / greatest(pe + ge - eh, 1))"
    rules = [("any", "hit = 1")] + [(f"or_{int(t * 100)}", f"hit = 1 AND ({node} >= {t} OR {edge} >= {t})") for t in (0.10, 0.25, 0.50)] + [("and_25", f"hit = 1 AND {node} >= 0.25 AND {edge} >= 0.25")]
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS hits, count(DISTINCT gt_pos) AS motifs FROM {{matched}} WHERE {c}" for n, c in rules)


def budget_prefix(d):
    """Node and edge F1 within prefixes of the ranking."""
    return f"""SELECT CAST(k AS BIGINT) AS k, round(2.0 * sum(nh) / greatest(sum(pn + gn), 1), 6) AS node_f1, round(2.0 * sum(eh) / greatest(sum(pe + ge), 1), 6) AS edge_f1,
        count(DISTINCT gt_pos) AS motifs FROM {{matched}} JOIN ({_ks([100, 250, 500, 1000])}) c ON place <= k GROUP BY k"""


def motif_breakdown(d):
    """By motif type: motifs found, first-hit ranks, precision of the type's hits."""
    firsts = "SELECT motif_type, gt_pos, min(place) AS place, count(*) AS hits FROM {matched} WHERE hit = 1 GROUP BY motif_type, gt_pos"
    return f"""SELECT motif_type, count(*) AS motifs, CAST(sum(hits) AS BIGINT) AS hits, round(CAST(count(*) AS DOUBLE) / sum(hits), 6) AS precision_, round(avg(place), 6) AS mean_place,
        CAST({d.median('place')} AS DOUBLE) AS median_place FROM ({firsts}) f GROUP BY motif_type"""


def type_breakdown(d):
    return "SELECT candidate_type, count(*) AS predicted, CAST(sum(hit) AS BIGINT) AS hits, count(DISTINCT gt_pos) AS motifs FROM {matched} GROUP BY candidate_type"


def bound_match(d):
    """Query-bound variant: a hit counts only if the motif contains the query's anchor."""
    long = d.unnest(f"(SELECT gt_pos, {d.split_text('nodes')} AS parts FROM {{ground_truth}}) s", "parts", "part")
    return f"""SELECT count(*) AS hits, count(DISTINCT m.gt_pos) AS motifs FROM {{matched}} m JOIN (SELECT gt_pos, part FROM {long}) g ON m.gt_pos = g.gt_pos AND m.query_id = g.part WHERE m.hit = 1"""


def anchor_excluded(d):
    """Edge hits alone decide, so an anchor that is itself a true node gives no free hit."""
    return "SELECT CAST(sum(CASE WHEN eh > 0 OR nh > 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS predictions FROM {matched}"


def transaction_overlap(d):
    """Distinct candidates and motifs that share an edge; a candidate may hit many."""
    p = d.unnest(f"(SELECT pid, {d.split_text('edges')} AS parts FROM {{predictions}}) s", "parts", "part")
    g = d.unnest(f"(SELECT gt_pos, {d.split_text('edges')} AS parts FROM {{ground_truth}}) s", "parts", "part")
    return f"""SELECT count(DISTINCT pid) AS hit_candidates, count(DISTINCT gt_pos) AS hit_motifs, (SELECT count(*) FROM {{predictions}}) AS candidates, (SELECT count(*) FROM {{ground_truth}}) AS motifs
        FROM (SELECT pid, part FROM {p}) x JOIN (SELECT gt_pos, part FROM {g}) y ON x.part = y.part"""


def transaction_overlap_at_k(d):
    """Purity and motif recall by shared edges in prefixes of the ranking; prefixes longer than the ranking are left out."""
    p = d.unnest(f"(SELECT place, {d.split_text('edges')} AS parts FROM {{predictions}}) s", "parts", "part")
    g = d.unnest(f"(SELECT gt_pos, {d.split_text('edges')} AS parts FROM {{ground_truth}}) s", "parts", "part")
    hits = f"SELECT DISTINCT x.place, y.gt_pos FROM (SELECT place, part FROM {p}) x JOIN (SELECT gt_pos, part FROM {g}) y ON x.part = y.part"
    ks = _ks([10, 20, 50, 100, 200, 500, 1000])
    return f"""SELECT CAST(c.k AS BIGINT) AS k, count(DISTINCT h.place) AS hit_candidates, count(DISTINCT h.gt_pos) AS hit_motifs, round(CAST(count(DISTINCT h.place) AS DOUBLE) / c.k, 6) AS purity,
        round(CAST(count(DISTINCT h.gt_pos) AS DOUBLE) / (SELECT greatest(count(*), 1) FROM {{ground_truth}}), 6) AS motif_recall
        FROM ({ks}) c LEFT JOIN ({hits}) h ON h.place <= c.k WHERE c.k <= (SELECT count(*) FROM {{predictions}}) GROUP BY c.k"""


DEFINITIONS = {f.__name__: f for f in (
    best_match, prf, match_rates, unique_recall, hit_at_k, mrr, auc, avg_precision, overlap_at_k, strict_overlap, budget_prefix, motif_breakdown, type_breakdown, bound_match,
    anchor_excluded, transaction_overlap, transaction_overlap_at_k)}
