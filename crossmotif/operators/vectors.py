"""All pairs of vectors that share a label, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # vectors of a label in a block, about
STRIP = 128  # vectors that meet a block at a time


def _padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one matrix, and their lengths; -1 for those that are null or hold a null."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    items = pc.list_flatten(column).cast(pa.float64())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[owner, place] = items.fill_null(0.0).to_numpy()
    lengths = np.where(column.is_null().to_numpy(), -1, sizes)
    lengths[owner[items.is_null().to_numpy()]] = -1
    return out, lengths


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products added component by component, as a sum over the arrays is."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += x[:, k, None] * y[None, :, k]
    return out


def _meet(rows: pa.Table) -> pa.Table:
    vectors, lengths = _padded(rows["embedding"])
    ids, block = rows["vec_id"].combine_chunks(), rows["block"].to_numpy()
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    norm = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        norm += vectors[:, k] * vectors[:, k]
    i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
    low, high, same = np.flatnonzero(block == i), np.flatnonzero(block == j), i == j
    parts = []
    for at in range(0, len(low), STRIP):
        x = low[at : at + STRIP]
        dot = _products(vectors[x], vectors[high])
        here = rank[x, None] < rank[None, high] if same else rank[x, None] != rank[None, high]
        p, q = np.nonzero(here)
        a, b = x[p], high[q]
        a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
        none = (lengths[a] < 0) | (lengths[b] < 0) | (lengths[a] != lengths[b])
        arrays = [ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(dot[p, q], mask=none), pa.array(norm[a], mask=none), pa.array(norm[b], mask=none)]
        parts.append(pa.Table.from_arrays(arrays, names=["a", "b", "xy", "xx", "yy"]))
    if parts:
        return pa.concat_tables(parts)
    return pa.table({"a": ids.slice(0, 0), "b": ids.slice(0, 0), **{c: pa.array([], pa.float64()) for c in ("xy", "xx", "yy")}})


def label_pairs(embeddings: DataFrame, size: int = BLOCK) -> DataFrame:
    """(a, b, xy, xx, yy): pairs a < b of vec_id with one label, each with its dot product and those of the two with themselves.

    A label's vectors are dealt into blocks, and each two blocks meet in a group of their own, so neither a frequent label
    nor the number of vectors makes a group larger.
    """
    rows = embeddings.select("vec_id", "label", "embedding").where("label is not null and vec_id is not null")
    blocks = rows.groupBy("label").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "embedding")
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    return sent.groupBy("label", "i", "j").applyInArrow(_meet, f"a {kind}, b {kind}, xy double, xx double, yy double")
