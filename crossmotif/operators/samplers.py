"""Samples of motif instances of several kinds, and the core numbers that lead to dense blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossmotif.functions.dialect import SPARK
from crossmotif.operators.closing import LONG, _entries, _whole
from crossmotif.runtime import stored

SIZE = 6  # nodes of a star or a dense block
EACH = 50  # instances of a kind
LINKS = 1 << 18  # links of a part of the nodes
#: Pairs a < b of an array of nodes (Spark).
_PAIRS = "filter(flatten(transform({0}, p -> transform({0}, q -> named_struct('a', p, 'b', q)))), z -> z.a < z.b)"


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted links as one list for each node and batch: the list of a hub comes in several rows."""
    for batch in batches:
        if batch.num_rows:
            a = batch.column("a").to_numpy()
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            items = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)).astype(np.int32)), batch.column("b"))
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), items], names=["a", "items"])


def _told(parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The core of each node told to all in its list: one row for each part of those who are told, equal values of one node counted."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = pc.list_flatten(batch.column("items")).to_numpy()
            value = np.repeat(batch.column("core").to_numpy(), pc.list_value_length(batch.column("items")).to_numpy())
            part = node % parts
            order = np.lexsort((value, node, part))
            node, value, part = node[order], value[order], part[order]
            first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (value[1:] != value[:-1])))[: len(node)]
            n = np.diff(np.append(first, len(node)))
            node, value, part = node[first], value[first], part[first]
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]
            ends = pa.array(np.append(begin, len(part)).astype(np.int32))
            columns = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (node, value.astype(np.int64), n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(part[begin]), *columns], names=["part", "node", "value", "n"])

    return told


def _fallen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest h of each node such that it was told h values of at least h."""
    for rows in _whole(batches, "part"):
        node, value, n = (_entries(rows, c)[1] for c in ("node", "value", "n"))
        order = np.lexsort((-value, node))
        node, value, n = node[order], value[order], np.cumsum(n[order])
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        before = np.append(0, n[first[1:] - 1])
        most = np.minimum(value, n - np.repeat(before, np.diff(np.append(first, len(node)))))
        columns = [pa.array(node[first]), pa.array(np.maximum.reduceat(most, first))]
        yield from pa.Table.from_arrays(columns, names=["a", "core"]).to_batches()


def core_numbers(edges: DataFrame, each: int = LINKS) -> DataFrame:
    """(node, core): the largest k such that the node lies in a subgraph where every node has at least k neighbours.

    ``edges`` has a and b, in any direction; repeats count once, loops and rows with a null end not at all. Every node starts
    with its degree, and takes the largest h such that h neighbours have at least h, until none changes. Nodes are numbered and
    links kept as lists of numbers, once; a round tells values in arrays, to parts of nodes with about ``each`` links, so a
    link is no row. Equal values told to a node are counted before they are sent, and the list of a hub is never gathered.
    """
    pairs = stored(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "core-pairs")
    parts = 2 * pairs.count() // each + 1
    ids = stored(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node"), F.monotonically_increasing_id().alias("id")), "core-ids")
    ends = pairs.join(ids.selectExpr("node as a", "id as x"), "a").join(ids.selectExpr("node as b", "id as y"), "b")
    links = ends.selectExpr("inline(array(named_struct('a', x, 'b', y), named_struct('a', y, 'b', x)))")
    lists = stored(links.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_lists, "a long, items array<long>"), "core-lists")
    cores = stored(lists.groupBy("a").agg(F.sum(F.size("items")).alias("core")), "cores")
    total = lambda: cores.agg(F.sum("core")).first()[0]
    before, now = None, total()
    while now != before:  # values only fall
        told = lists.join(cores, "a").select("core", "items").mapInArrow(_told(parts), "part long, node array<long>, value array<long>, n array<long>")
        cores = stored(told.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_fallen, "a long, core long"), "cores")
        before, now = now, total()
    return cores.join(ids, F.col("a") == F.col("id")).select("node", "core")


def _least(d, text: str) -> str:
    return d.hash48(f"'24|' || {text}")


def _stars(d) -> str:
    drawn = f"SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY {_least(d, 'node || chr(124) || nbr')}, nbr) AS r FROM {{links}}"
    return f"SELECT node AS seed, nbr AS member FROM ({drawn}) s WHERE r < {SIZE}"


def _blocks(d) -> str:
    """A node of core at least 3 and its neighbours of the highest cores."""
    drawn = f"""SELECT l.node, l.nbr, row_number() OVER (PARTITION BY l.node ORDER BY n.core DESC, {_least(d, "l.node || chr(124) || l.nbr")}, l.nbr) AS r
        FROM {{links}} l JOIN {{cores}} n ON n.node = l.nbr JOIN {{cores}} c ON c.node = l.node WHERE c.core >= 3"""
    return f"SELECT node AS seed, nbr AS member FROM ({drawn}) s WHERE r < {SIZE}"


def _squares(d) -> str:
    """(u, v, y, x): two drawn neighbours v and x of u and the least other node y that both know."""
    drawn = f"SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY {_least(d, 'nbr || chr(124) || node')}, nbr) AS r FROM {{links}}"
    corners = f"SELECT p.node AS u, p.nbr AS v, q.nbr AS x FROM ({drawn}) p JOIN ({drawn}) q ON p.node = q.node AND p.r = 1 AND q.r = 2"
    return f"SELECT u, v, x, min(l.nbr) AS y FROM ({corners}) c JOIN {{links}} l ON l.node = c.v JOIN {{links}} m ON m.node = c.x AND m.nbr = l.nbr WHERE l.nbr <> u GROUP BY u, v, x"


def sampled_instances(d):
    """Instances of four kinds, crossing ones first, then by seeded hash, up to a quota of each kind: the sample is the operator.

    Triangles are drawn from all; every node offers one 4-cycle, one star and, where its core number is 3 or more, one block
    with at least as many inner edges as nodes. Equal node sets of a kind count once, except stars, which their centre names too.
    """
    if d.name == "spark":
        return "SELECT kind, CAST(rn AS BIGINT) AS rn, nodes, edges, CAST(parties AS BIGINT) AS parties FROM {instances}"
    text = "STRING" if d.name == "spark" else "VARCHAR"
    edge = "SELECT a, b, edge_id FROM {pair_und}"
    sides = " UNION ALL ".join(f"SELECT u, least({p}, {q}) AS a, greatest({p}, {q}) AS b FROM sq" for p, q in (("u", "v"), ("v", "y"), ("y", "x"), ("x", "u")))
    return f"""SELECT kind, CAST(rn AS BIGINT) AS rn, nodes, edges, CAST(parties AS BIGINT) AS parties FROM (
        WITH sq AS ({_squares(d)}), star AS ({_stars(d)}), block AS ({_blocks(d)}),
        side AS ({sides}),
        square AS (SELECT s.u AS seed, {d.agg_set('e.edge_id')} AS edges, count(*) AS m FROM side s JOIN ({edge}) e ON e.a = s.a AND e.b = s.b GROUP BY s.u),
        starred AS (SELECT s.seed, {d.agg_set('s.member')} AS leaves, {d.agg_set('e.edge_id')} AS edges, count(*) AS m FROM star s JOIN ({edge}) e ON e.a = least(s.seed, s.member) AND e.b = greatest(s.seed, s.member) GROUP BY s.seed),
        inside AS (SELECT seed, member FROM block UNION ALL SELECT DISTINCT seed, seed FROM block),
        named AS (SELECT seed, {d.agg_set('member')} AS nodes, count(*) AS n FROM inside GROUP BY seed),
        inner_edges AS (SELECT p.seed, {d.agg_set('e.edge_id')} AS edges, count(*) AS m FROM inside p JOIN inside q ON p.seed = q.seed AND p.member < q.member JOIN ({edge}) e ON e.a = p.member AND e.b = q.member GROUP BY p.seed),
        every_ AS (SELECT 'triangle' AS kind, nodes, edges, nodes AS named FROM {{ground_truth}}
            UNION SELECT 'cycle4', {d.set_of('q.u', 'q.v', 'q.y', 'q.x')}, s.edges, {d.set_of('q.u', 'q.v', 'q.y', 'q.x')} FROM square s JOIN sq q ON q.u = s.seed WHERE s.m = 4
            UNION SELECT 'star', seed || ',' || leaves, edges, seed || ',' || leaves FROM starred WHERE m = {SIZE - 1}
            UNION SELECT 'dense_subgraph', n.nodes, i.edges, n.nodes FROM named n JOIN inner_edges i ON i.seed = n.seed WHERE n.n = {SIZE} AND i.m >= {max(SIZE, SIZE * (SIZE - 1) // 4)}),
        single AS (SELECT kind, named, min(nodes) AS nodes, min(edges) AS edges FROM every_ GROUP BY kind, named),
        member AS (SELECT kind, nodes, part FROM {d.unnest(f"(SELECT kind, nodes, {d.split_text('nodes')} AS parts FROM single) z", "parts", "part")}),
        span AS (SELECT m.kind, m.nodes, count(DISTINCT p.party) AS parties FROM member m JOIN {{node_party}} p ON p.node = m.part GROUP BY m.kind, m.nodes)
        SELECT s.kind, s.nodes, s.edges, coalesce(c.parties, 0) AS parties,
            row_number() OVER (PARTITION BY s.kind ORDER BY CASE WHEN c.parties >= 2 THEN 0 ELSE 1 END, {_least(d, f"s.kind || CAST(s.nodes AS {text})")}, s.nodes) AS rn
        FROM single s LEFT JOIN span c ON c.kind = s.kind AND c.nodes = s.nodes) w WHERE rn <= {EACH}"""


def _drawn(links: DataFrame, near: DataFrame) -> DataFrame:
    """One row for each node: sorted members of its star and block, the two corners of its square, and the least and greatest
    party of each of these. All three orders are ranked where the links of a node lie."""
    rows = links.join(near.selectExpr("node as nbr", "core", "lo", "hi"), "nbr")
    rows = rows.selectExpr("*", f"{_least(SPARK, 'node || chr(124) || nbr')} as h", f"{_least(SPARK, 'nbr || chr(124) || node')} as g")
    by = Window.partitionBy("node")
    place = {"star": ("h", "nbr"), "corner": ("g", "nbr"), "block": (F.desc("core"), "h", "nbr")}
    ranked = rows.select("node", "nbr", "lo", "hi", *[F.row_number().over(by.orderBy(*order)).alias(f"{k}_at") for k, order in place.items()])
    few = {"star": f"star_at < {SIZE}", "corner": "corner_at <= 2", "block": f"block_at < {SIZE}"}
    kept = ranked.where(" or ".join(few.values())).groupBy("node").agg(
        *[F.array_sort(F.collect_list(F.when(F.expr(few[k]), F.col("nbr")))).alias(k) for k in ("star", "block")],
        *[F.max(F.when(F.col("corner_at") == i, F.col("nbr"))).alias(c) for c, i in (("v", 1), ("x", 2))],
        *[F.min(F.when(F.expr(t), F.col("lo"))).alias(f"{k}_lo") for k, t in few.items()], *[F.max(F.when(F.expr(t), F.col("hi"))).alias(f"{k}_hi") for k, t in few.items()])
    ends = [f"{end}({k}_{c}, {c}) as {k}_{c}" for k in few for c, end in (("lo", "least"), ("hi", "greatest"))]
    return kept.join(near, "node").selectExpr("node", "core", "star", "v", "x", "block", *ends)


def _closed(corners: DataFrame, links: DataFrame, near: DataFrame, long: int) -> DataFrame:
    """(u, v, x, y): the least other node y that is linked with both corners v and x of u. Lists meet as arrays; where a
    corner has more than ``long`` links, those of the other are looked up one by one."""
    hubs = stored(near.where(F.col("degree") > long).select("node"), "hubs")
    lists = links.join(hubs, "node", "left_anti").groupBy("node").agg(F.collect_list("nbr").alias("list"))
    ends = corners.join(lists.selectExpr("node as v", "list as list_v"), "v").join(lists.selectExpr("node as x", "list as list_x"), "x")
    found = ends.selectExpr("u", "v", "x", "array_min(filter(array_intersect(list_v, list_x), y -> y <> u)) as y").where("y is not null")
    if hubs.isEmpty():
        return found
    degree = lambda c: near.selectExpr(f"node as {c}", f"degree as n{c}")
    wide = corners.join(degree("v"), "v").join(degree("x"), "x").where((F.col("nv") > long) | (F.col("nx") > long))
    wide = wide.selectExpr("u", "v", "x", "if(nv <= nx, v, x) as small", "if(nv <= nx, x, v) as large")
    met = wide.join(links.selectExpr("node as small", "nbr as y"), "small").where("y <> u").join(links.selectExpr("node as large", "nbr as y"), ["large", "y"], "left_semi")
    return found.unionByName(met.groupBy("u", "v", "x").agg(F.min("y").alias("y")))


def instances(links: DataFrame, cores: DataFrame, pairs: DataFrame, node_party: DataFrame, triangles: DataFrame, long: int = LONG) -> DataFrame:
    """The rows of ``sampled_instances``. All instances are found and ranked by their nodes; edges and parties are then looked
    up for those within the quota alone."""
    party = node_party.groupBy("node").agg(F.min("party").alias("lo"), F.max("party").alias("hi"))
    near = stored(links.groupBy("node").agg(F.count("*").alias("degree")).join(cores, "node").join(party, "node", "left"), "near")
    drawn = stored(_drawn(links, near), "drawn")
    corners = drawn.where("v is not null and x is not null").selectExpr("node as u", "v", "x")
    fourth = _closed(corners, links, near, long).join(near.selectExpr("node as y", "lo", "hi"), "y").join(drawn.selectExpr("node as u", "corner_lo", "corner_hi"), "u")
    squares = stored(fourth.selectExpr("u", "v", "x", "y", f"{SPARK.set_of('u', 'v', 'y', 'x')} as nodes", "least(lo, corner_lo) as lo", "greatest(hi, corner_hi) as hi"), "squares")
    three = stored(triangles.selectExpr(f"{SPARK.set_of('n1', 'n2', 'n3')} as nodes", f"{SPARK.set_of('e1', 'e2', 'e3')} as edges"), "triangles")
    blocks = drawn.where(f"core >= 3 and size(block) = {SIZE - 1}")
    inner = blocks.selectExpr("node", f"inline({_PAIRS.format('block')})").join(pairs, ["a", "b"]).groupBy("node").count()
    dense = blocks.join(inner.where(F.col("count") >= max(SIZE, SIZE * (SIZE - 1) // 4) - SIZE + 1), "node")
    ends = three.selectExpr("nodes", "explode(split(nodes, ',')) as node").join(near, "node").groupBy("nodes").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    every = ends.selectExpr("'triangle' as kind", "nodes", "lo", "hi")
    for rows in (squares.selectExpr("'cycle4' as kind", "nodes", "lo", "hi"),
                 drawn.where(f"size(star) = {SIZE - 1}").selectExpr("'star' as kind", "node || ',' || array_join(star, ',') as nodes", "star_lo as lo", "star_hi as hi"),
                 dense.selectExpr("'dense_subgraph' as kind", f"{SPARK.set_text('concat(block, array(node))')} as nodes", "block_lo as lo", "block_hi as hi")):
        every = every.unionByName(rows)
    single = every.groupBy("kind", "nodes").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = f"row_number() over (partition by kind order by if(lo <> hi, 0, 1), {_least(SPARK, 'kind || nodes')}, nodes) as rn"
    picked = stored(single.selectExpr("kind", "nodes", order).where(f"rn <= {EACH}"), "picked")  # quotas: few rows
    named = picked.selectExpr("kind", "nodes", "split(nodes, ',') as parts", "'' as u")
    star = named.where("kind = 'star'").selectExpr("kind", "nodes", "u", f"inline(transform(slice(parts, 2, {SIZE - 1}), m -> named_struct('a', least(parts[0], m), 'b', greatest(parts[0], m))))")
    whole = named.where("kind = 'dense_subgraph'").selectExpr("kind", "nodes", "u", f"inline({_PAIRS.format('parts')})")
    asked = F.broadcast(picked.where("kind = 'cycle4'").select("kind", "nodes"))
    sides = ", ".join(f"named_struct('a', least({p}, {q}), 'b', greatest({p}, {q}))" for p, q in (("u", "v"), ("v", "y"), ("y", "x"), ("x", "u")))
    four = squares.join(asked, "nodes").selectExpr("kind", "nodes", "u", f"inline(array({sides}))")
    sought = F.broadcast(stored(star.unionByName(whole).unionByName(four), "sought"))
    edges = pairs.join(sought, ["a", "b"]).groupBy("kind", "nodes", "u").agg(F.expr(SPARK.agg_set("edge_id")).alias("edges")).select("kind", "nodes", "edges")
    edges = edges.unionByName(three.join(F.broadcast(picked.where("kind = 'triangle'").select("kind", "nodes")), "nodes").select("kind", "nodes", "edges"))
    edges = edges.groupBy("kind", "nodes").agg(F.min("edges").alias("edges"))
    parties = node_party.join(F.broadcast(named.selectExpr("kind", "nodes", "explode(parts) as node")), "node").groupBy("kind", "nodes").agg(F.countDistinct("party").alias("parties"))
    return picked.join(edges, ["kind", "nodes"]).join(parties, ["kind", "nodes"], "left").selectExpr("kind", "rn", "nodes", "edges", "coalesce(parties, 0) as parties")


DEFINITIONS = {"sampled_instances": sampled_instances}

#: Reference of core_numbers: the same fall by sorted lists, for rounds enough.
CORES_SQL = """WITH RECURSIVE h(turn, node, core) AS (SELECT 0, node, count(*) FROM {links} GROUP BY node
    UNION ALL SELECT turn + 1, node, list_max(list_transform(s, lambda x, i: least(x, i))) FROM (
        SELECT h.turn, l.node, list(h.core ORDER BY h.core DESC) AS s FROM h JOIN {links} l ON l.nbr = h.node WHERE h.turn < 40 GROUP BY h.turn, l.node))
    SELECT node, core FROM h WHERE turn = 40"""
