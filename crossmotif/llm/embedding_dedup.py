"""Embedding near-duplicates by cross-polytope hashing.

A table's hash joins ``PARTS`` cross-polytope values: the vector is rotated by three rounds
of random signs and a fast Hadamard transform, and the value names the largest coordinate
with its sign. Each vector is entered under its own hash and under those with the second
largest coordinate in one part (multiprobe), on both sides alike. Vectors that meet in a
bucket are compared by the exact cosine in double precision; a pair counts in the first
bucket the two share, so degrees add up without listing pairs. Large buckets are dealt into
blocks, and each two blocks are compared by a part of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.operators.components import connected_components
from crossmotif.runtime import pick, stored

COSINE = 0.95
TABLES, PARTS = 4, 2
BLOCK = 4096  # entries of a bucket that are compared in one part


def _hadamard(x: np.ndarray) -> np.ndarray:
    d, h = x.shape[1], 1
    while h < d:
        y = x.reshape(len(x), d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), d)
        h *= 2
    return x


def bucket_keys(v: np.ndarray, tables: int = TABLES, parts: int = PARTS) -> np.ndarray:
    """Keys (n, tables * (parts + 1)) of unit vectors: for each table the own bucket and one probe per part."""
    n, d = v.shape
    width = max(2, 1 << (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = v
    keys = np.empty((n, tables, parts + 1), dtype=np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
        for p in range(parts):
            signs = np.random.default_rng([t, p, width]).choice(np.array([-1.0, 1.0]), (3, width))
            y = x
            for s in signs:
                y = _hadamard(y * s)
            size = np.abs(y)
            top = size.argmax(axis=1)
            size[rows, top] = -1.0
            next_ = size.argmax(axis=1)
            best[:, p] = top * 2 + (y[rows, top] > 0)
            second[:, p] = next_ * 2 + (y[rows, next_] > 0)
        for k in range(parts + 1):
            key = np.full(n, d * tables + t, dtype=np.int64)
            for p in range(parts):
                key = key * (2 * width) + (second if p == k - 1 else best)[:, p]
            keys[:, t, k] = key
    return keys.reshape(n, -1)


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _entries(batches: Iterator[pa.RecordBatch], tables: int, parts: int, only_keys: bool = False) -> Iterator[pa.RecordBatch]:
    number = np.repeat(np.arange(tables, dtype=np.int32), parts + 1)
    for batch in batches:
        vectors = batch.column("v").to_pylist()
        cls = batch.column("cls").to_numpy(zero_copy_only=False)
        copies = batch.column("copies").to_numpy(zero_copy_only=False)
        dims = np.array([len(v) for v in vectors])
        for d in np.unique(dims):
            for own in np.array_split(np.flatnonzero(dims == d), (dims == d).sum() // 512 + 1):
                raw = [np.asarray(vectors[i], dtype=np.float64).tobytes() for i in own]
                keys = bucket_keys(_unit(raw), tables, parts)
                m = keys.shape[1]
                if only_keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel())], names=["key"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(number, len(own))), pa.array(keys.ravel()), pa.array(np.repeat(cls[own], m)), pa.array(np.repeat(copies[own], m)), pa.array([r for r in raw for _ in range(m)], pa.binary())],
                    names=["table", "key", "cls", "copies", "raw"],
                )


def _bucket(table: int, key: int, cls: np.ndarray, copies: np.ndarray, v: np.ndarray, left: int, cosine: float, tables: int, parts: int):
    """(degrees added here, spanning links) of one bucket's distinct unit vectors; blocks bound the memory. The first
    ``left`` rows, if any, are one block of a split bucket and meet only the others; otherwise all meet all."""
    n, step = len(v), parts + 1
    degree = np.zeros(n, dtype=np.int64)
    pairs = []
    ends = left or n
    for at in range(0, ends, 256):
        upto = min(at + 256, ends)
        begin = left or at
        i, j = np.nonzero(v[at:upto] @ v[begin:].T >= cosine)
        i, j = i + at, j + begin
        pairs.append(np.stack([i[i < j], j[i < j]]))
    i, j = np.concatenate(pairs, axis=1)
    if not len(i):
        return degree, []
    # A pair counts in the first bucket that both are entered under.
    met = np.unique(np.concatenate([i, j]))
    keys = np.zeros((n, tables * step), dtype=np.int64)
    keys[met] = bucket_keys(v[met], tables, parts)
    links = _forest(i, j, cls)
    first = np.ones(len(i), dtype=bool)
    for t in range(table + 1):
        a, b = keys[i, t * step : (t + 1) * step], keys[j, t * step : (t + 1) * step]
        for x in range(step):
            for y in range(step):
                meets = a[:, x] == b[:, y]
                first &= ~(meets if t < table else meets & (a[:, x] < key))
    i, j = i[first], j[first]
    degree += np.bincount(i, weights=copies[j], minlength=n).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=n).astype(np.int64)
    return degree, links


def _forest(i: np.ndarray, j: np.ndarray, cls: np.ndarray) -> list[tuple[int, int]]:
    """Of the links i-j as many as keep every component connected."""
    root = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((cls[a], cls[b]))
    return out


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, tables: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, n): a degree n of class a where b is null, else a link. Rows arrive sorted by (part, key, mine, theirs,
    side); memory: a batch and one part of a bucket, twice BLOCK vectors of a split one."""

    def run(group: list[pa.Table | pa.RecordBatch]) -> list[tuple]:
        rows = pa.Table.from_batches(group)
        get = lambda c: rows.column(c).to_numpy()
        cls, at = np.unique(get("cls"), return_index=True)
        if len(cls) < 2:
            return []
        side = get("side")[at]
        order = np.lexsort([cls, side])
        cls, at, side = cls[order], at[order], side[order]
        raw = rows.column("raw").combine_chunks().take(pa.array(at))
        v = _unit([x.as_py() for x in raw])
        left = int((side == 0).sum()) if (side == 1).any() else 0
        if not left and get("theirs")[0] != get("mine")[0]:
            return []  # a pair of blocks of which one is empty
        degree, links = _bucket(int(get("table")[0]), int(get("key")[0]), cls, get("copies")[at], v, left, cosine, tables, parts)
        return [(int(a), None, int(d)) for a, d in zip(cls, degree) if d] + [(int(a), int(b), 0) for a, b in links]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "n"])

    held: list[pa.RecordBatch] = []
    last, out = None, []
    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("table", "key", "mine", "theirs")], axis=1)
        if not len(marks):
            continue
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        if held and (marks[0] != last).any():
            out += run(held)
            held = []
        last = marks[-1]
        begin = 0
        for cut in cuts.tolist():
            if held or cut - begin > 1:
                out += run(held + [batch.slice(begin, cut - begin)])
                held = []
            begin = cut
        held.append(batch.slice(begin))
        if len(out) > 20_000:
            yield batch_of(out)
            out = []
    if held:
        out += run(held)
    if out:
        yield batch_of(out)


def _split(entries: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """Entries with the parts of their buckets: a bucket of more than ``block`` entries is dealt into blocks by class, and
    every two blocks meet in a part of their own, so that no task holds such a bucket whole."""
    hot = keys.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block)
    hot = stored(hot.select(F.col("key").alias("k"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), "vector-hot-buckets")
    dealt = entries.join(hot, F.col("key") == F.col("k"), "left").drop("k").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        "table", "key", F.least("own", "other").alias("mine"), F.greatest("own", "other").alias("theirs"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "cls", "copies", "raw",
    )


def embedding_groups(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, parts: int = PARTS, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null vectors, and those that are empty, zero or hold null or non-finite values, link with nothing; vectors of
    different lengths never link. Equal vectors are one class while searching and count as links of each other.
    component_id is the smallest vec_id reachable; repeated rows count as separate vectors.
    """
    rows = pick(vectors, id=id_col, v=vec_col).withColumn("v", F.col("v").cast("array<double>"))
    good = F.expr(
        "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(v, x -> x <> 0)"
    )
    valid = rows.where(good)
    classes = valid.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    inputs = classes.select("cls", "copies", "v")
    entries = inputs.mapInArrow(lambda b: _entries(b, tables, parts), "table int, key long, cls long, copies long, raw binary")
    parted = _split(entries, inputs.mapInArrow(lambda b: _entries(b, tables, parts, True), "key long"), block)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["table", "key", "mine", "theirs", "side"]
    met = parted.repartition(n, "key", "mine", "theirs").sortWithinPartitions(*order).mapInArrow(lambda b: _compare(b, cosine, tables, parts), "a long, b long, n long")
    met = stored(met, "vector-links")
    degrees = met.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("far"))
    groups = connected_components(met.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    named = classes.join(degrees, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("group", F.coalesce("component", "cls"))
    lowest = named.groupBy("group").agg(F.min("low").alias("component_id"))
    by_vector = named.join(lowest, "group").select("v", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = valid.join(by_vector, "v").select("id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("long"), "component_id", F.expr("id <=> component_id").alias("kept")
    )
