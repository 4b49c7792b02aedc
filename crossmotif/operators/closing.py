"""Closed walks of four steps and counts of what lists reach, by lists gathered at a node.

A walk as a row of its own is shuffled, sorted and joined at its own width. Here each neighbour of a node brings its
list as one array of small numbers; walks exist only inside a task, in numpy, and only those that close leave it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.runtime import stored
from crossmotif.sources.graph_tables import NEIGHBOURS

HALF = NEIGHBOURS // 2  # places of the lists that the second and third step may take; at most 15, they are packed in 4 bits
LONG = 2000  # a node that more lists than this name is looked up walk by walk instead


def _starts(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each row of a sorted column differs from the row before."""
    n = len(column)
    head = np.ones(min(n, 1), dtype=bool)
    return head if n < 2 else np.concatenate([head, pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy()])


def _whole(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that the rows of a key stay together."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows]).combine_chunks()
        if rows.num_rows == 0:
            continue
        last = int(np.flatnonzero(_starts(rows[key]))[-1])
        if last:
            yield rows.slice(0, last).combine_chunks()
        kept = rows.slice(last)
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


def _entries(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each list item of a column."""
    lists = pa.chunked_array(rows[column].chunks, type=rows[column].type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(rows.num_rows), sizes), pc.list_flatten(lists).to_numpy()


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items ahead of an anchor's neighbours against those behind its other neighbours, by the hash of the node."""
    for rows in _whole(batches, "anchor"):
        group = np.cumsum(_starts(rows["anchor"])).astype(np.int64) << 28
        theirs = rows["theirs"].to_numpy()
        key = lambda row, value: group[row] | ((value.astype(np.int64) >> 4) & 0xFFFFFFF)
        out, ahead = _entries(rows, "ahead")
        fresh = (theirs[out] >> ((ahead & 15) - 1)) & 1 == 0  # the neighbour's way back to the anchor
        out, ahead = out[fresh], ahead[fresh]
        back, behind = _entries(rows, "behind")
        keys = key(back, behind)
        order = np.argsort(keys, kind="stable")
        wanted = key(out, ahead)
        low, high = (np.searchsorted(keys[order], wanted, side=s) for s in ("left", "right"))
        i = np.repeat(np.arange(len(out)), high - low)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(high - low) - high, high - low)]
        other = out[i] != back[j]
        i, j = i[other], j[other]
        taken = rows.select(["anchor", "n1"]).take(pa.array(out[i]))
        columns = [*(taken[c].combine_chunks().cast(pa.string()) for c in ("anchor", "n1")), pa.array(theirs[out[i]]), pa.array((ahead[i] & 15).astype(np.int32)), pa.array((behind[j] & 15).astype(np.int32))]
        yield from pa.Table.from_arrays(columns, names=["anchor", "n1", "theirs", "r2", "r3"]).to_batches()


def closed_walks(ranked: DataFrame, closing: DataFrame, half: int = HALF, long: int = LONG) -> DataFrame:
    """Walks anchor > n1 > n2 > n3 over the ranked lists of ``ranked`` whose n3 is in ``closing`` (anchor, other) with the
    anchor; the second and third step take the first ``half`` places; n2 and n3 are new.

    Returns (anchor, r1, n1, e1, r2, n2, e2, r3, n3, e3, skipped): skipped counts the places before r2 that lead back
    to the anchor. Nodes meet by 28 bits of their hash; the walks found are then resolved to ids and tested, so that a
    collision adds nothing. A task holds an anchor's neighbours with their lists.
    """
    ranked = ranked.select("node", "nbr", "edge_id", "rn")
    near = ranked.where(F.col("rn") <= half)
    hubs = stored(near.groupBy("nbr").count().where(F.col("count") > long).select("nbr"), "hubs")
    ahead = near.selectExpr("node as key", "(hash(nbr) & -16) | rn as a", "cast(null as int) as b")
    behind = near.join(hubs, "nbr", "left_anti").selectExpr("nbr as key", "cast(null as int) as a", "(hash(node) & -16) | rn as b")
    lists = ahead.unionByName(behind).groupBy("key").agg(F.collect_list("a").alias("ahead"), F.collect_list("b").alias("behind"))
    mine = ranked.selectExpr("node as anchor", "nbr as n1", "true as first", "0 as theirs", "false as closes")
    theirs = near.selectExpr("nbr as anchor", "node as n1", "false as first", "shiftleft(1, rn - 1) as theirs", "false as closes")
    ends = closing.selectExpr("anchor", "other as n1", "false as first", "0 as theirs", "true as closes")
    pairs = mine.unionByName(theirs).unionByName(ends).groupBy("anchor", "n1").agg(F.max("first").alias("first"), F.bit_or("theirs").alias("theirs"), F.max("closes").alias("closes"))
    rows = pairs.where("first or closes").join(lists, F.col("n1") == F.col("key"))
    rows = rows.selectExpr("anchor", "n1", "theirs", "if(first, ahead, null) as ahead", "if(closes, behind, null) as behind")
    found = rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_meet, "anchor string, n1 string, theirs int, r2 int, r3 int").distinct()
    step = lambda k: ranked.selectExpr(f"node as n{k - 1}", f"rn as r{k}", f"nbr as n{k}", f"edge_id as e{k}")
    walks = found.join(step(2), ["n1", "r2"])
    if not hubs.isEmpty():
        to_hubs = step(3).where(F.col("r3") <= half).join(hubs.withColumnRenamed("nbr", "n3"), "n3", "left_semi").select("n2", "r3")
        plain = pairs.where("first").select("anchor", "n1", "theirs").join(step(2).where(F.col("r2") <= half), "n1").join(to_hubs, "n2")
        walks = walks.unionByName(plain)
    walks = walks.join(step(3), ["n2", "r3"]).where("n2 <> anchor and n3 <> anchor and n3 <> n1")
    walks = walks.join(closing.withColumnRenamed("other", "n3"), ["anchor", "n3"], "left_semi")
    first = ranked.selectExpr("node as anchor", "nbr as n1", "rn as r1", "edge_id as e1")
    skipped = "bit_count(theirs & (shiftleft(1, r2 - 1) - 1)) as skipped"
    return walks.join(first, ["anchor", "n1"]).selectExpr("anchor", "r1", "n1", "e1", "r2", "n2", "e2", "r3", "n3", "e3", skipped)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct list items of each key; of a key that fills many batches only its distinct items are held."""
    at, held = None, np.empty(0, dtype=np.int64)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column("key").to_numpy()
        sizes = pc.fill_null(pc.list_value_length(batch.column("items")), 0).to_numpy()
        owners, items = np.repeat(keys, sizes), pc.list_flatten(batch.column("items")).to_numpy()
        if at is not None:
            keys, owners, items = np.append(at, keys), np.append(np.full(len(held), at), owners), np.append(held, items)
        order = np.lexsort((items, owners))
        owners, items = owners[order], items[order]
        new = np.ones(len(owners), dtype=bool)
        new[1:] = (owners[1:] != owners[:-1]) | (items[1:] != items[:-1])
        owners, items = owners[new], items[new]
        at = keys[-1]
        held = items[owners == at]
        done = np.unique(keys[keys != at])
        counts = np.searchsorted(owners, done, side="right") - np.searchsorted(owners, done, side="left")
        yield pa.RecordBatch.from_arrays([pa.array(done), pa.array(counts.astype(np.int64))], names=["key", "n"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(held)], pa.int64())], names=["key", "n"])


def two_steps(links: DataFrame, back: bool) -> DataFrame:
    """(key, n): distinct nodes within two steps of each source of the distinct ``links`` (a, b), both of type long. With
    ``back`` a source that a step leads back to counts as well; without, it does not."""
    lists = links.groupBy("a").agg(F.collect_list("b").alias("items")).withColumnRenamed("a", "mid")
    own = links.select(F.col("a").alias("key"), F.array("b").alias("items"))
    items = "items" if back else "filter(items, x -> x <> a) as items"
    far = links.join(lists, F.col("b") == F.col("mid")).selectExpr("a as key", items)
    return own.unionByName(far).repartition("key").sortWithinPartitions("key").mapInArrow(_count, "key long, n long")


def two_step_counts(links: DataFrame, name: str, back: bool) -> DataFrame:
    """(node, n): ``two_steps`` over the columns src and dst of ``links``, of any one type and with repeats, as ``name``.

    Nodes are numbered for it by a stored table, so that counts do not hang on hashes.
    """
    pairs = links.select("src", "dst").distinct()
    ids = stored(pairs.select("src").union(pairs.select("dst")).distinct().select(F.col("src").alias("node"), F.monotonically_increasing_id().alias("id")), "ids")
    ends = pairs.join(ids.selectExpr("node as src", "id as a"), "src").join(ids.selectExpr("node as dst", "id as b"), "dst")
    found = two_steps(stored(ends.select("a", "b"), "numbered"), back)
    return found.join(ids, F.col("key") == F.col("id")).selectExpr("node", f"n as {name}")


def first_neighbours(ranked: DataFrame) -> DataFrame:
    """(node, near): the different neighbours of each ranked list, each at its first place, in the order of places."""
    firsts = ranked.groupBy("node", "nbr").agg(F.min(F.struct("rn", "edge_id")).alias("x"))
    return firsts.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("x.rn", "nbr", "x.edge_id"))).alias("near"))
