"""Counts and triangles around nodes: each neighbour of an anchor brings its list, and pairs meet only inside a task.

Nodes are numbered, lists are arrays of numbers. What is shuffled is one list for each pair of neighbours; wedges, balls
and pairs of list members are never rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.operators.closing import _entries, _starts, _whole

WIDE = 1 << 22  # local paths tested at a time


class Around:
    """Anchors with their mids and the mids' lists, by local numbers: ``group`` and ``key`` of each row, ``owner`` and
    ``item`` key of each list entry. Equal keys are equal nodes under the same anchor. ``marks`` are the lowest
    ``marked`` bits of the entries, which are not part of their numbers."""

    def __init__(self, rows: pa.Table, marked: int = 0):
        self.group = np.cumsum(_starts(rows["anchor"])).astype(np.int64) - 1
        self.anchor, self.mid = rows["anchor"].to_numpy(), rows["mid"].to_numpy()
        self.owner, items = _entries(rows, "items")
        self.numbers, self.marks = items >> marked, items & ((1 << marked) - 1)
        _, local = np.unique(np.concatenate([self.mid, self.numbers]), return_inverse=True)
        self.span = int(local.max(initial=0)) + 1
        self.key = self.group * self.span + local[: len(self.mid)]
        self.item = self.group[self.owner] * self.span + local[len(self.mid) :]
        self.groups = int(self.group[-1]) + 1 if len(self.group) else 0

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs (x, y) such that the list of x holds the mid y of the same anchor."""
        order = np.argsort(self.key, kind="stable")
        keys = self.key[order]
        if not len(keys):
            return order, order
        at = np.minimum(np.searchsorted(keys, self.item), len(keys) - 1)
        hit = keys[at] == self.item
        return self.owner[hit], order[at[hit]]


def _by_row(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64)


def _closed(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each row the ordered pairs of its inner neighbours that are inner neighbours themselves, over the pairs (x, y)."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keys, first = x * n + y, np.searchsorted(x, np.arange(n + 1))
    many = first[y + 1] - first[y]
    found = np.zeros(n, dtype=np.int64)
    ends = np.cumsum(many)
    low = 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + WIDE, side="right")))
        k = many[low:high]
        i = np.repeat(np.arange(low, high), k)
        z = y[np.arange(len(i)) + np.repeat(first[y[low:high]] - np.cumsum(k) + k, k)]
        wanted = x[i] * n + z
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found += np.bincount(x[i][keys[at] == wanted], minlength=n)
        low = high
    return found


def _enclosed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole(batches, "anchor"):
        loop = pc.equal(rows["anchor"], rows["mid"])
        looped = rows["anchor"].filter(loop).to_numpy()
        r = Around(rows.filter(pc.invert(loop)))
        n = len(r.mid)
        x, y = r.inner()
        shared = np.bincount(x, minlength=n)
        walks = np.unique(r.item, return_inverse=True, return_counts=True)
        three = _by_row(r.owner, walks[2][walks[1]], n)
        extra = 2 * np.isin(r.anchor, looped)
        inside = _by_row(r.group, shared, r.groups)[r.group] // 2 - _by_row(x, shared[y], n)
        once = r.anchor < r.mid
        inside += np.where(once, three + _closed(x, y, n) // 2, 0)
        cn = np.where(once, shared, 0) + extra
        degree = np.bincount(r.group, minlength=r.groups)[r.group] + extra
        columns = [np.minimum(r.anchor, r.mid), np.maximum(r.anchor, r.mid), cn, inside, degree]
        yield from pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["lo", "hi", "cn", "inside", "degree"]).to_batches()


def _named(rows: DataFrame, ids: DataFrame, **columns: str) -> DataFrame:
    """``rows`` with the nodes of the numbers in ``columns``: column = new name."""
    for number, name in columns.items():
        rows = rows.join(ids.selectExpr(f"id as {number}", f"node as {name}"), number)
    return rows


def node_ids(links: DataFrame) -> DataFrame:
    """(node, id): the nodes of ``links`` (node, nbr, both ways) numbered. To be stored: numbers come anew with each run."""
    return links.select("node").distinct().select("node", F.monotonically_increasing_id().alias("id"))


def link_ids(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b): the distinct links by number."""
    ends = links.distinct().join(ids.selectExpr("node", "id as a"), "node").join(ids.selectExpr("node as nbr", "id as b"), "nbr")
    return ends.select("a", "b")


def _around(own: DataFrame, links: DataFrame) -> DataFrame:
    """(anchor, mid, items), the rows of an anchor together: ``own`` (anchor, mid) with the list of each mid in ``links`` (a, b)."""
    lists = links.groupBy("b").agg(F.collect_list("a").alias("items")).withColumnRenamed("b", "mid")
    return own.join(lists, "mid", "left").select("anchor", "mid", "items").repartition("anchor").sortWithinPartitions("anchor")


def enclosed(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, cn, inside, deg_sum) of all linked a < b: common neighbours, links inside the union of both lists, degrees.

    ``links`` are numbered, both ways; a loop counts twice in lists, as it is there twice. With T(a) links among the neighbours
    of a, W(a,b) walks of three steps from a to b, I the common neighbours and E(I) the links among them, the links inside are
    T(a) + T(b) + W(a,b) - sum over v in I of (cn(a,v) + cn(b,v)) + E(I). Each end gives its own part of the sum.
    """
    plain = links.where("a <> b")
    own = plain.selectExpr("a as anchor", "b as mid")
    loops = links.where("a = b").selectExpr("a as anchor", "b as mid", "cast(array() as array<bigint>) as items")
    lists = plain.groupBy("a").agg(F.collect_list("b").alias("items")).withColumnRenamed("a", "mid")
    rows = own.join(lists, "mid").select("anchor", "mid", "items").unionByName(loops).repartition("anchor").sortWithinPartitions("anchor")
    parts = rows.mapInArrow(_enclosed, "lo long, hi long, cn long, inside long, degree long")
    sums = parts.groupBy("lo", "hi").agg(*[F.sum(c).alias(c) for c in ("cn", "inside", "degree")])
    return _named(sums, ids, lo="x", hi="y").selectExpr("least(x, y) as a", "greatest(x, y) as b", "cn", "inside", "degree as deg_sum")


def _inner_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole(batches, "anchor"):
        r = Around(rows)
        size = np.bincount(r.group, minlength=r.groups)
        links = _by_row(r.group, np.bincount(r.inner()[0], minlength=len(r.mid)), r.groups) // 2
        yield pa.RecordBatch.from_arrays([pa.array(r.anchor[np.searchsorted(r.group, np.arange(r.groups))]), pa.array(size), pa.array(links)], names=["anchor", "size", "links"])


def list_links(near: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, size, links): different members of each list of ``near`` (node, nbr), and the links between two of them."""
    own = near.select("node", "nbr").distinct().join(ids.selectExpr("node", "id as anchor"), "node").join(ids.selectExpr("node as nbr", "id as mid"), "nbr")
    found = _around(own.select("anchor", "mid"), links.where("a <> b")).mapInArrow(_inner_links, "anchor long, size long, links long")
    return _named(found, ids, anchor="node").select("node", "size", "links")


def _corners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole(batches, "anchor"):
        r = Around(rows)
        x, y = r.inner()
        yield from pa.Table.from_arrays([pa.array(v) for v in (r.anchor[x], r.mid[x], r.mid[y])], names=["p", "q", "r"]).to_batches()


def triangles(links: DataFrame, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(n1, n2, n3, e1, e2, e3): each triangle once, n1 < n2 < n3, with the edges n1-n2, n2-n3 and n1-n3 of ``pairs``.

    A link leads from its end with fewer links to the other, so a list that is sent holds at most the root of twice all links.
    """
    plain = links.where("a <> b")
    degree = plain.groupBy("a").agg(F.count("*").alias("d"))
    both = plain.join(degree.withColumnRenamed("d", "da"), "a").join(degree.selectExpr("a as b", "d as db"), "b")
    out = both.where("struct(da, a) < struct(db, b)").select("a", "b")
    found = _around(out.selectExpr("a as anchor", "b as mid"), out.selectExpr("b as a", "a as b")).mapInArrow(_corners, "p long, q long, r long")
    rows = _named(found, ids, p="x", q="y", r="z").selectExpr("array_sort(array(x, y, z)) as n").selectExpr("n[0] as n1", "n[1] as n2", "n[2] as n3")
    for e, a, b in (("e1", "n1", "n2"), ("e2", "n2", "n3"), ("e3", "n1", "n3")):
        rows = rows.join(pairs.selectExpr(f"a as {a}", f"b as {b}", f"edge_id as {e}"), [a, b])
    return rows.select("n1", "n2", "n3", "e1", "e2", "e3")


def corners(found: DataFrame, links: DataFrame) -> DataFrame:
    """(anchor, p, q): all triples of nodes of which each two are linked, in every order. ``found`` are the triangles (n1, n2,
    n3); a node linked to itself counts as two or all three of a triple's nodes."""
    orders = [f"struct({a} as anchor, {b} as p, {c} as q)" for a, b, c in itertools.permutations(("n1", "n2", "n3"))]
    apart = found.selectExpr(f"inline(array({', '.join(orders)}))")
    loops = links.where("node = nbr").selectExpr("node as own").distinct().join(links, F.col("own") == F.col("node")).select("own", "nbr")
    twice = loops.selectExpr("inline(array(struct(nbr as anchor, own as p, own as q), struct(own as anchor, own as p, nbr as q), struct(own as anchor, nbr as p, own as q)))")
    return apart.unionByName(twice.distinct())
