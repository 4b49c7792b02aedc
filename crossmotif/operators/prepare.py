"""Preparation: classes, labels, parties, summaries, sanitised queries, protocols and validation."""

from __future__ import annotations

from crossmotif.functions.dialect import SparkDialect


def _text(d: SparkDialect) -> str:
    return "STRING" if d.name == "spark" else "VARCHAR"


def tx_class(d):
    """Class of each transaction: part of a pattern, laundering without one, or clean."""
    return """SELECT edge_id, CASE WHEN weight > 450000 AND currency = 'F' THEN 'PATTERN_MOTIF' WHEN weight > 450000 THEN 'UNKNOWN_LAUNDERING' ELSE 'CLEAN' END AS tx_group FROM {flow}"""


def row_key(d):
    """SHA-256 of the trimmed fields of a row joined by ||, nulls as empty text."""
    t = _text(d)
    h = "sha2({}, 256)" if d.name == "spark" else "sha256({})"
    return f"SELECT edge_id, {h.format(f'src || chr(124) || chr(124) || dst || chr(124) || chr(124) || CAST(ord AS {t}) || chr(124) || chr(124) || trim(pay_format)')} AS tx_hash FROM {{flow}}"


def label_merge(d):
    """Pattern labels joined on the row key; unlabelled laundering and clean rows get their sentinels."""
    pattern = f"SELECT DISTINCT edge_id, 'MOTIF_' || src AS instance FROM {{flow}} WHERE weight > 450000 AND currency = 'F'"
    merged = f"""SELECT f.edge_id, f.ord, coalesce(p.instance, CASE WHEN f.weight > 450000 THEN 'UNKNOWN' ELSE 'NONE' END) AS motif_instance_id,
        CASE WHEN p.instance IS NOT NULL THEN 'PATTERN' WHEN f.weight > 450000 THEN 'UNKNOWN_LAUNDERING' ELSE 'CLEAN' END AS motif_type
        FROM {{flow}} f LEFT JOIN ({pattern}) p ON f.edge_id = p.edge_id"""
    return f"SELECT edge_id, motif_instance_id, motif_type, CAST(place - 1 AS BIGINT) AS tx_id FROM ({d.ranked(merged, 'ord, edge_id', 'place')}) m"


def account_labels(d):
    """Accounts with a flag for those on a laundering row and a dense number."""
    accounts = """SELECT node, CAST(max(CASE WHEN weight > 450000 THEN 1 ELSE 0 END) AS BIGINT) AS illicit
        FROM (SELECT src AS node, weight FROM {flow} UNION ALL SELECT dst, weight FROM {flow}) f GROUP BY node"""
    return f"SELECT node, illicit, CAST(place - 1 AS BIGINT) AS account_id FROM ({d.ranked(accounts, 'node', 'place')}) a"


def motif_instances(d):
    return f"""SELECT motif_instance_id, motif_type, count(*) AS num_tx, count(DISTINCT src) AS num_src, {d.agg_set('m.edge_id')} AS tx_ids FROM {{labelled}} m JOIN {{flow}} f ON m.edge_id = f.edge_id
        WHERE motif_instance_id <> 'NONE' GROUP BY motif_instance_id, motif_type"""


def match_report(d):
    """Sizes of the labelled and unlabelled key sets, their intersection and difference."""
    return f"""SELECT count(*) AS rows_, count(DISTINCT edge_id) AS keys_, CAST(sum(CASE WHEN motif_instance_id NOT IN ('NONE', 'UNKNOWN') THEN 1 ELSE 0 END) AS BIGINT) AS matched,
        CAST(sum(CASE WHEN motif_instance_id IN ('NONE', 'UNKNOWN') THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM {{labelled}} m"""


def key_report(d):
    """Keys of pattern rows, taken from the source table, against keys of the transactions: matched, on either side alone, distinct and repeated.

    Orders that open no transaction (the last, and those followed by the same customer) are patterns that no transaction answers.
    """
    t = _text(d)
    h = "sha2({}, 256)" if d.name == "spark" else "sha256({})"
    source = h.format(f"CAST(o_custkey AS {t}) || '|e' || CAST(o_orderkey AS {t}) || '|' || trim(o_orderpriority)")
    patterns = f"SELECT {source} AS k FROM {{orders}} WHERE o_totalprice > 450000 AND o_orderstatus = 'F'"
    transactions = f"SELECT {h.format(chr(39).join(('src || ', '|', ' || edge_id || ', '|', ' || trim(pay_format)')))} AS k FROM {{flow}}"
    parts = (("matched", patterns, "INTERSECT", transactions), ("pattern_only", patterns, "EXCEPT", transactions), ("transaction_only", transactions, "EXCEPT", patterns))
    return " UNION ALL ".join(f"SELECT '{name}' AS side, (SELECT count(*) FROM ({a} {op} {b}) x) AS keys_, (SELECT count(*) FROM ({a} {op} ALL {b}) y) AS rows_" for name, a, op, b in parts)


def partition_summary(d):
    """Crossing share by class."""
    return f"""SELECT c.tx_group, count(*) AS tx, CAST(sum(CASE WHEN t.is_inter THEN 1 ELSE 0 END) AS BIGINT) AS inter, round(avg(CASE WHEN t.is_inter THEN 1.0 ELSE 0.0 END), 6) AS inter_ratio
        FROM {{tagged}} t JOIN ({tx_class(d)}) c ON t.edge_id = c.edge_id GROUP BY c.tx_group"""


def motif_span(d):
    """Parties and crossing transactions of each motif instance, with the mean and median span."""
    span = f"""SELECT motif_instance_id, count(*) AS tx, CAST(sum(CASE WHEN is_inter THEN 1 ELSE 0 END) AS BIGINT) AS inter, count(DISTINCT party) AS parties FROM (
        SELECT m.motif_instance_id, t.edge_id, t.is_inter, t.src_party AS party FROM {{labelled}} m JOIN {{tagged}} t ON m.edge_id = t.edge_id WHERE m.motif_type = 'PATTERN'
        UNION ALL SELECT m.motif_instance_id, t.edge_id, t.is_inter, t.dst_party FROM {{labelled}} m JOIN {{tagged}} t ON m.edge_id = t.edge_id WHERE m.motif_type = 'PATTERN') u GROUP BY motif_instance_id"""
    return f"SELECT parties, count(*) AS motifs, round(avg(inter), 6) AS mean_inter, CAST({d.median('inter')} AS DOUBLE) AS median_inter FROM ({span}) s GROUP BY parties"


def hash_party(d, parties: int = 5):
    """Label-free party by seeded hash rank: shuffled nodes dealt in turn."""
    shuffled = f"SELECT node, {d.hash48(chr(39) + '42|' + chr(39) + ' || node')} AS h FROM {{node_set}}"
    return f"SELECT node, 'P' || CAST((place - 1) % {parties} AS {_text(d)}) AS party FROM ({d.ranked(shuffled, 'h, node', 'place')}) n"


def hybrid_party(d, parties: int = 5):
    """Party from a node's first month plus the hash of its id."""
    return f"""SELECT node, 'P' || CAST((month_ + {d.hash48('node')}) % {parties} AS {_text(d)}) AS party FROM (SELECT node, min(month(ts)) AS month_ FROM
        (SELECT src AS node, ts FROM {{flow}} UNION ALL SELECT dst, ts FROM {{flow}}) e GROUP BY node) m"""


def motif_party(d, parties: int = 5):
    """Accounts of a motif dealt round its parties; the first motif of an account decides."""
    rows = f"""SELECT DISTINCT m.motif_instance_id AS motif, e.node FROM {{labelled}} m JOIN (SELECT edge_id, src AS node FROM {{flow}} UNION ALL SELECT edge_id, dst FROM {{flow}}) e ON m.edge_id = e.edge_id WHERE m.motif_type = 'PATTERN'"""
    dealt = f"SELECT motif, node, (row_number() OVER (PARTITION BY motif ORDER BY node) - 1 + {d.hash48('motif')} % {parties}) % {parties} AS p FROM ({rows}) r"
    return f"SELECT node, 'P' || CAST(min_by(p, motif) AS {_text(d)}) AS party FROM ({dealt}) x GROUP BY node"


def known_transactions(d):
    """Transactions without the unexplained laundering rows, numbered densely from 0."""
    kept = f"SELECT f.edge_id, f.ord, c.tx_group FROM {{flow}} f JOIN ({tx_class(d)}) c ON f.edge_id = c.edge_id WHERE c.tx_group <> 'UNKNOWN_LAUNDERING'"
    return f"SELECT edge_id, tx_group, CAST(place - 1 AS BIGINT) AS tx_id FROM ({d.ranked(kept, 'ord, edge_id', 'place')}) k"


def clean_ratio_party(d, ratio: float = 0.2, parties: int = 5):
    """Parties after one pass that brings the crossing share of clean rows to ``ratio``.

    Clean edges whose ends have the fewest clean rows go first. To lower the share the end with fewer rows joins the
    party of the other; to raise it that end moves to another party by hash. The first move of an account counts, and a
    move changes all edges of the account, so the share is met approximately, as in a sequential pass.
    """
    clean = f"SELECT f.edge_id, f.src, f.dst, f.ord FROM {{flow}} f JOIN ({tx_class(d)}) c ON f.edge_id = c.edge_id WHERE c.tx_group = 'CLEAN'"
    degree = f"SELECT node, count(*) AS deg FROM (SELECT src AS node FROM ({clean}) a UNION ALL SELECT dst FROM ({clean}) b) e GROUP BY node"
    rows = f"""SELECT c.edge_id, c.src, c.dst, c.ord, s.party AS ps, t.party AS pt, x.deg AS ds, y.deg AS dt FROM ({clean}) c
        JOIN {{node_party}} s ON c.src = s.node JOIN {{node_party}} t ON c.dst = t.node JOIN ({degree}) x ON c.src = x.node JOIN ({degree}) y ON c.dst = y.node"""
    ends = "CASE WHEN ds <= dt THEN src ELSE dst END AS node, CASE WHEN ds <= dt THEN ps ELSE pt END AS own, CASE WHEN ds <= dt THEN pt ELSE ps END AS other"
    order = "low, total_deg, ord, edge_id"
    pick = lambda sign: d.ranked(f"SELECT edge_id, ord, {ends}, least(ds, dt) AS low, ds + dt AS total_deg FROM ({rows}) r WHERE ps {sign} pt", order, "r")
    need = f"SELECT sum(CASE WHEN ps <> pt THEN 1 ELSE 0 END) - floor(count(*) * {ratio}) AS excess FROM ({rows}) n"
    moved = f"(CAST(substr(own, 4) AS INT) + 1 + {d.hash48('node')} % {parties - 1}) % {parties}"
    moves = f"""SELECT node, other AS party, r FROM ({pick('<>')}) p CROSS JOIN ({need}) n WHERE r <= excess
        UNION ALL SELECT node, 'P00' || CAST({moved} AS {_text(d)}), r FROM ({pick('=')}) q CROSS JOIN ({need}) m WHERE r <= -excess"""
    return f"SELECT p.node, coalesce(m.party, p.party) AS party FROM {{node_party}} p LEFT JOIN (SELECT node, min_by(party, r) AS party FROM ({moves}) v GROUP BY node) m ON p.node = m.node"


def protocol_view(d):
    """Triangles as queries: the anchor is the smallest node, hidden edges are those that cross parties."""
    return f"""SELECT g.gt_pos, min(x.part) AS anchor, count(DISTINCT e.edge_id) AS edges, count(DISTINCT CASE WHEN e.is_inter THEN e.edge_id END) AS hidden_edges FROM {{ground_truth}} g
        JOIN (SELECT gt_pos, part FROM {d.unnest('(SELECT gt_pos, ' + d.split_text('nodes') + ' AS parts FROM {ground_truth}) s', 'parts', 'part')}) x ON g.gt_pos = x.gt_pos
        JOIN (SELECT gt_pos, part FROM {d.unnest('(SELECT gt_pos, ' + d.split_text('edges') + ' AS parts FROM {ground_truth}) s2', 'parts', 'part')}) y ON g.gt_pos = y.gt_pos
        JOIN {{tagged}} e ON e.edge_id = y.part GROUP BY g.gt_pos"""


def sanitize_queries(d):
    """Method view: edges renumbered qe<i> in order; the map to true ids is for evaluation only."""
    if d.name == "spark":  # a motif is one row, so its edges are ordered in place
        return "SELECT gt_pos, 'qe' || CAST(at AS STRING) AS query_edge, part AS true_edge FROM {ground_truth} LATERAL VIEW posexplode(array_sort(split(edges, ','))) exploded AS at, part"
    long = d.unnest(f"(SELECT gt_pos, {d.split_text('edges')} AS parts FROM {{ground_truth}}) s", "parts", "part")
    return f"SELECT gt_pos, 'qe' || CAST(row_number() OVER (PARTITION BY gt_pos ORDER BY part) - 1 AS {_text(d)}) AS query_edge, part AS true_edge FROM (SELECT gt_pos, part FROM {long}) x"


def sampled_motifs(d, each: int = 100):
    """Motifs with a crossing edge first, then by seeded hash, up to a quota of each type: the sample is the operator."""
    long = d.unnest(f"(SELECT gt_pos, {d.split_text('edges')} AS parts FROM {{ground_truth}}) s", "parts", "part")
    crossing = f"SELECT DISTINCT l.gt_pos FROM (SELECT gt_pos, part FROM {long}) l JOIN {{tagged}} t ON t.edge_id = l.part WHERE t.is_inter"
    rows = f"""SELECT g.gt_pos, g.motif_type, CASE WHEN c.gt_pos IS NULL THEN 1 ELSE 0 END AS inside, {d.hash48(chr(39) + '9|' + chr(39) + ' || g.nodes')} AS h
        FROM {{ground_truth}} g LEFT JOIN ({crossing}) c ON g.gt_pos = c.gt_pos"""
    return f"""SELECT gt_pos, CAST(1 - inside AS BIGINT) AS crossing, CAST(rn AS BIGINT) AS rn FROM (SELECT r.*, row_number() OVER (PARTITION BY motif_type ORDER BY inside, h, gt_pos) AS rn FROM ({rows}) r) s WHERE rn <= {each}"""


def validate(d):
    """Counts of duplicate edge ids, dangling ends, nodes without a party and self-loops."""
    return """SELECT 'duplicate_edges' AS rule, count(*) AS bad FROM (SELECT edge_id FROM {flow} GROUP BY edge_id HAVING count(*) > 1) a
        UNION ALL SELECT 'dangling_src', count(*) FROM {flow} f LEFT JOIN {node_set} n ON f.src = n.node WHERE n.node IS NULL
        UNION ALL SELECT 'node_without_party', count(*) FROM {node_set} n LEFT JOIN {node_party} p ON n.node = p.node WHERE p.party IS NULL
        UNION ALL SELECT 'self_loops', count(*) FROM {flow} WHERE src = dst"""


def standard_nodes(d):
    return f"SELECT n.node AS node_id, n.node AS original_id, 'account' AS node_type, CAST(count(f.edge_id) AS BIGINT) AS out_edges FROM {{node_set}} n LEFT JOIN {{flow}} f ON f.src = n.node GROUP BY n.node"


def export_edge_list(d):
    return "SELECT src || ' ' || dst AS line, count(*) AS times FROM {flow} GROUP BY src, dst"


DEFINITIONS = {f.__name__: f for f in (
    tx_class, row_key, label_merge, account_labels, motif_instances, match_report, key_report, partition_summary, motif_span, hash_party, hybrid_party, motif_party, known_transactions, clean_ratio_party, protocol_view, sanitize_queries,
    sampled_motifs, validate, standard_nodes, export_edge_list)}
