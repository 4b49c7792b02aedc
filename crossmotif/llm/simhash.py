"""SimHash near-duplicate grouping with multi-index hashing.

Fingerprints are cut into two 32-bit segments. Two fingerprints within four bits agree to
within two bits on one segment, and values two bits apart have a common neighbour at one
bit from both: so each distinct fingerprint is entered under the 33 values of the Hamming
ball of radius one around each of its segments (66 keys), and only fingerprints that meet
under a key are compared in full. The table holds distinct fingerprints, so thousands of
copies are one entry; a bucket yields a spanning forest of its links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmotif.operators.components import connected_components
from crossmotif.runtime import only_rows, pick, stored

WORDS, SEED, RADIUS = 4, 42, 4


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lowered, words split at ASCII white space, every shingle counted."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter(
        (digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)))), dtype=np.uint64, count=len(w) - words + 1
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), 4096):
        part = hashed[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashed), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), dtype=np.uint64, count=len(texts))
        rest = [c for c in batch.schema.names if c not in ("id", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64)), *map(batch.column, rest)], names=["id", "fp", *rest])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(lambda b: _fingerprints(b, words), f"id {dict(rows.dtypes)['id']}, fp long")


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(32, dtype=np.uint64)])
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        low, high = fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)
        keys = np.concatenate([low[:, None] ^ flips, (high[:, None] ^ flips) | np.uint64(1 << 32)], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp.view(np.int64), keys.shape[1]))], names=["key", "fp"]
        )


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints: each is compared with those not yet reached."""
    left, out = fps.copy(), []
    while len(left) > 1:
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            centres = queue.pop()
            for c in centres:
                near = np.bitwise_count(left ^ c) <= radius
                if near.any():
                    found, left = left[near], left[~near]
                    out.append((np.full(len(found), c), found))
                    queue.append(found)
    return out


def _verify(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys; rows arrive sorted by (key, fp). Memory: a batch and the longest run."""
    held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(k)]]))
        two = starts[sizes == 2]
        close = two[np.bitwise_count(f[two] ^ f[two + 1]) <= radius]
        parts = [(f[close], f[close + 1])]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            parts += spanning_links(f[at : at + n], radius)
        a, b = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if len(a):
            a, b = a.view(np.int64), b.view(np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    for batch in batches:
        k = np.concatenate([held_k, batch.column("key").to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1], side="left"))
        held_k, held_f = k[last:], f[last:]
        if last:
            yield from links(k[:last], f[:last])
    if len(held_k) > 1:
        yield from links(held_k, held_f)


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst) links between distinct fingerprints that span every component at ``radius`` (four at most)."""
    if not 0 <= radius <= 4:
        raise ValueError("two segments with balls of radius one serve distances up to 4")
    keyed = prints.select("fp").distinct().mapInArrow(_balls, "key long, fp long")
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = keyed.repartition(n, "key").sortWithinPartitions("key", "fp")
    return stored(sorted_rows.mapInArrow(lambda b: _verify(b, radius), "src long, dst long").distinct(), "simhash-links")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, the document
    itself included. Null and empty texts have fingerprint zero and link like others. A null doc_id takes part
    but is never a component's name unless all its members lack one. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    groups = stored(connected_components(near_links(prints, radius)), "simhash-components")
    least = prints.groupBy("fp").agg(F.min("id").alias("low"))
    least = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    names = least.groupBy("group").agg(F.min("low").alias("component_id"))
    by_print = least.join(names, "group").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.expr("id <=> component_id").alias("kept"),
    )


def _mark(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Of each component one row, with all its columns: smallest id (a null one last), then least digest of the text,
    then least row. A row is known by its id and the digest, never by the id alone."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("mark", _mark(F.col("text")))
    schema = f"id {dict(rows.dtypes)['id']}, fp long, mark string"
    prints = stored(rows.mapInArrow(lambda b: _fingerprints(b, words), schema), "simhash-fp")
    groups = stored(connected_components(near_links(prints, radius)), "simhash-components")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark")
    least = prints.groupBy("fp").agg(F.min(order).alias("low"))
    least = least.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    stays = least.groupBy("group").agg(F.min("low").alias("low")).select(F.col("low.id").alias("_id"), F.col("low.mark").alias("_mark"))
    return only_rows(docs, id_col, stays, {"_mark": _mark(F.col(f"c{docs.columns.index(text_col)}"))})
