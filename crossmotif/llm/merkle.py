"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and a proof for every row.

Rows get their place in their group by ranges. Blocks of 512 consecutive leaves, aligned to the tree's runs of 8,
are walked one to a call: a postorder recursion returns the digest of a subtree and, while unwinding, appends the
siblings to the path of every leaf that the subtree holds. Block roots are the leaves of another distributed walk,
until each group has one root; the roots of the groups form the last tree. Walking up moves one digest a block;
walking down hands each block the path of its root, so proofs are put together where the leaves are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmotif.runtime import pick, stored

FAN = 8
LEVELS = 3  # of a block
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def walk(digests: list[str], levels: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """(digest ``levels`` above a block's nodes, for each node its siblings to the left and right, level by level)."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(low: int, level: int) -> str:
        if not level:
            return digests[low]
        step = FAN ** (level - 1)
        starts = range(low, min(low + FAN * step, len(digests)), step)
        below = [visit(at, level - 1) for at in starts]
        for i, at in enumerate(starts):
            beside = "".join(below[:i]), "".join(below[i + 1 :])
            for leaf in range(at, min(at + step, len(digests))):
                paths[leaf].append(beside)
        return _h(below)

    return visit(0, levels), paths


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``pos`` (0, 1, ... in the group ``g``) and ``n`` (size of the group), found by ranges, so that no
    task sees a whole group."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(nodes.repartitionByRange(parts, "g", *order).withColumn("_r", F.spark_partition_id()), "merkle-ranges")
    counts = ranges.groupBy("g", "_r").agg(F.count("*").alias("_n"))  # as many as ranges and groups together
    whole = Window.partitionBy("g")
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("g", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "_r").orderBy(*order))
    placed = ranges.withColumn("_inside", inside).join(offsets, ["g", "_r"])
    return stored(placed.withColumn("pos", F.col("_before") + F.col("_inside") - 1).drop("_r", "_before", "_inside"), "merkle-places")


def _ordered(block: pa.Table) -> tuple[pa.Table, int]:
    """The block's nodes in order, and how many levels it is climbed: all of its own unless it is the whole tree."""
    n = block.column("n")[0].as_py()
    return block.sort_by("pos"), min(height(n), LEVELS)


def _root(key: tuple, block: pa.Table) -> pa.Table:
    block, levels = _ordered(block)
    digest, _ = walk(block.column("digest").to_pylist(), levels)
    g, at = (k.as_py() for k in key)
    n = -(-block.column("n")[0].as_py() // BLOCK)
    return pa.table({"g": [g], "pos": pa.array([at], pa.int64()), "n": pa.array([n], pa.int64()), "digest": [digest]})


ABOVE = pa.schema([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("root", pa.string()), ("subroot", pa.string())])


def _paths(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
    """The block's nodes, with all their columns and their paths up to the root: the way inside the block, then that of
    the block's root."""
    tops = above.select(ABOVE.names).to_pylist() if block.num_rows else []
    rest = [c for c in block.column_names if c not in ("block", "digest", "n")]
    if not tops:
        return pa.Table.from_arrays([*block.slice(0, 0).select(rest).columns, *ABOVE.empty_table().columns], names=[*rest, *ABOVE.names])
    top = tops[0]
    block, levels = _ordered(block)
    _, paths = walk(block.column("digest").to_pylist(), levels)
    n = block.num_rows
    found = [[[a for a, _ in p] + top["left"] for p in paths], [[b for _, b in p] + top["right"] for p in paths], [top["root"]] * n, [top["subroot"]] * n]
    return pa.Table.from_arrays([*block.select(rest).columns, *(pa.array(x, f.type) for x, f in zip(found, ABOVE))], names=[*rest, *ABOVE.names])


def _layers(leaves: DataFrame) -> list[DataFrame]:
    """The leaves (g, pos, n, digest), the roots of their blocks, the roots of the blocks of these, ... until one is
    left in each group."""
    layers = [leaves]
    while (layers[-1].agg(F.max("n").alias("n")).head()["n"] or 0) > 1:
        blocks = layers[-1].select("g", "pos", "n", "digest", F.expr(f"pos div {BLOCK}").alias("block"))
        layers.append(stored(blocks.groupBy("g", "block").applyInArrow(_root, "g string, pos long, n long, digest string"), "merkle-roots"))
    return layers


def _down(layers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the leaves of the lowest layer, beside all their columns, from those of the nodes of the highest."""
    for layer in reversed(layers[:-1]):
        blocks = layer.withColumn("block", F.expr(f"pos div {BLOCK}"))
        above = top.select("g", F.col("pos").alias("block"), *ABOVE.names)
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layer.schema if f.name not in ("digest", "n"))
        out = f"{kept}, left array<string>, right array<string>, root string, subroot string"
        top = blocks.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_paths, out)
    return top


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its byte count, a colon and its value, or - where it is null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (id, grp, leaf, and whatever else goes along) with pos, subroot, root and the proof: ``left`` and
    ``right`` hold, level by level, the siblings' digests joined together.

    Groups ascend with a null one first, by the bytes of their names; in a group rows ascend by id, null ids last,
    rows of one id by their digest. Equal rows are leaves of their own. An empty table has no root and no row.
    """
    named = F.when(F.col("grp").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("grp").cast("string")))  # "-" sorts before "="
    rows = stored(leaves.withColumn("g", named).withColumn("_tie", F.monotonically_increasing_id()).withColumn("_late", F.col("id").isNull()), "merkle-leaves")
    # The leaves go along with their digests as far as the paths, so that proofs are never shuffled.
    placed = _placed(rows, "_late", "id", "leaf", "_tie").withColumn("digest", F.col("leaf")).drop("_tie", "_late")
    layers = _layers(placed)
    heads = _placed(layers[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "of")
    tops = _layers(heads.withColumn("subroot_", F.col("digest")))
    nothing = F.array().cast("array<string>")
    top = tops[-1].select("g", "pos", nothing.alias("left"), nothing.alias("right"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"))
    if len(tops) == 1:  # one group or none: its root is the root
        of_heads = top.join(heads.select("g", "pos", "of", F.col("digest").alias("subroot_")), ["g", "pos"])
    else:
        of_heads = _down(tops, top)
    of_heads = stored(of_heads.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "left", "right", "root", F.col("subroot_").alias("subroot")), "merkle-heads")
    if len(layers) == 1:  # every group is a single leaf
        return placed.drop("n", "digest").join(of_heads, ["g", "pos"]).drop("g")
    return _down(layers, of_heads).drop("g")


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """(id, grp, leaf) of every row of ``docs``; columns are found by exact name and may clash in all but case."""
    rows = pick(docs, **{f"f{i}": c for i, c in enumerate(fields)}, id=id_col, grp=group_col)
    return rows.select("id", "grp", leaf_digest([F.col(f"f{i}") for i in range(len(fields))]).alias("leaf"))


def folded(leaf: Column, left: str = "left", right: str = "right") -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(F.arrays_zip(left, right), leaf, lambda d, s: F.sha2(F.concat(s[left], d, s[right]), 256))


def proof_digest(left: str = "left", right: str = "right") -> Column:
    """SHA-256 of all siblings of a proof, level by level, from left to right."""
    return F.sha2(F.concat_ws("", F.transform(F.arrays_zip(left, right), lambda s: F.concat(s[left], s[right]))), 256)


def verify(proofs: DataFrame, now: Column) -> DataFrame:
    """``proofs`` with the root that the leaf digest ``now`` folds to, and whether it is the manifest's."""
    return proofs.withColumn("folded_root", folded(now)).withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The manifest is of the table as it is. Then the text of every third document, by the CRC-32 of its id (a null id
    counts as an empty one), has its letters A-Z made small, and each leaf is folded with the original siblings: what
    was changed no longer leads to the root. Null texts stay null; texts without such letters stay verified.
    """
    rows = pick(docs, **{f"f{i}": c for i, c in enumerate(fields)}, id=id_col, grp=group_col)
    own = [F.col(f"f{i}") for i in range(len(fields))]
    changed = [F.translate(c, UPPER, LOWER) if name == text_col else c for name, c in zip(fields, own)]
    third = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    leaves = rows.select("id", "grp", leaf_digest(own).alias("leaf"), F.when(third, leaf_digest(changed)).alias("tampered"))
    checked = verify(manifest(leaves), F.coalesce("tampered", "leaf"))
    return checked.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", "verified")
