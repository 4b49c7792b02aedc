"""Exact removal of repeated substrings by blockwise suffix ranking over a cover sample.

Two equal strings of ``LENGTH`` bytes must be recognised wherever they start. As in a
difference-cover construction, a sparse sample of positions is chosen such that equal
strings always contain sampled positions at the same shift, the suffixes at sampled
positions are ranked, and a string is compared by the few bytes before its sample and the
rank of the sample. The cover is content-defined (the smallest hash of a 20-byte word among
the 81 inside a string, leftmost first), which takes 2.5 % of all positions where a periodic
cover takes 12 % or more.

1. Each text yields (word hash, place, range of string starts that this sample serves).
2. Samples whose word occurs once are dropped: their strings occur once.
3. For the others the bytes around the sample are cut out; equal ones met in one batch are
   combined at once, so a passage common to many documents travels a few times only.
4. Buckets of equal words are sorted one block at a time: suffixes to the right of the
   samples, prefixes to the left, each with its common-prefix lengths. For every shift the two
   rank classes name the string, and all but its first occurrence are marked. A bucket too large
   for a block is dealt into parts by stretches of shifts and the bytes that all strings of a
   stretch share, in the last resort by whole strings; equal ones met in a batch being combined,
   no part then outgrows the number of batches.
5. Marks become byte spans, united per document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.runtime import pick, stored

LENGTH = 100
WORD = 20
SHIFTS = LENGTH - WORD + 1
PIECE = 2 << 20  # bytes looked at together
BLOCK = 40_000  # samples sorted together, unless one bucket has more
HOT, HOTTEST = 100_000, 1_600_000  # samples of a bucket beyond which it is split by the bytes about them, once and again


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the WORD bytes from each position on, by doubling; length len(data) - WORD + 1."""
    base = 0x9E3779B97F4A7C15
    h = _mix(data.astype(np.uint64) + np.uint64(1))
    parts, width = {1: h}, 1
    while width < 16:
        h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
        parts[width] = h
    n = len(data) - WORD + 1
    return _mix(parts[16][:n] * np.uint64(pow(base, 4, 1 << 64)) + parts[4][16 : 16 + n])


def samples(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the samples that serve the strings of ``data``, in order."""
    h = word_hashes(data)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SHIFTS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SHIFTS - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[at[first]], at[first], first, last


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, row, spot): spot packs the place (upper 48 bits) with the least and greatest shift it serves."""

    def collected(texts: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(t for _, t, _ in texts), dtype=np.uint8)
        ends = np.cumsum([len(t) for _, t, _ in texts])
        starts = ends - [len(t) for _, t, _ in texts]
        h, at, first, last = samples(data)
        doc = np.searchsorted(ends, at, side="right")
        # Strings that reach over the end of their text do not count.
        first, last = np.maximum(first, starts[doc]), np.minimum(last, ends[doc] - LENGTH)
        good = first <= last
        h, at, first, last, doc = h[good], at[good], first[good], last[good], doc[good]
        rows, offsets = np.array([r for r, _, _ in texts]), np.array([o for _, _, o in texts])
        spot = ((at - starts[doc] + offsets[doc]) << 16) | ((at - last) << 8) | (at - first)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rows[doc]), pa.array(spot)], names=["h", "row", "spot"])

    for batch in batches:
        held, size = [], 0
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary())):
            text = text.as_py() or b""
            for at in range(0, len(text) - LENGTH + 1, PIECE):
                piece = text[at : at + PIECE + LENGTH - 1]
                held.append((row, piece, at))
                size += len(piece)
                if size >= PIECE:
                    yield collected(held)
                    held, size = [], 0
        if held:
            yield collected(held)


def _repeated(batches: Iterator[pa.RecordBatch], hot: int, hottest: int) -> Iterator[pa.RecordBatch]:
    """Rows whose h occurs more than once, with the level of its bucket: 0, 1 beyond ``hot`` rows, 2 beyond ``hottest``.
    Input is sorted by h; at most ``hottest`` rows are held until the size of their bucket is known."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None

    def marked(rows: pa.RecordBatch | pa.Table, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pa.table(rows) if isinstance(rows, pa.RecordBatch) else rows
        yield from table.append_column("level", pa.array(levels, pa.int32())).combine_chunks().to_batches()

    def closed() -> Iterator[pa.RecordBatch]:
        if size > 1 and held:
            level = 2 if size > hottest else 1 if size > hot else 0
            yield from marked(pa.Table.from_batches(held), np.full(sum(b.num_rows for b in held), level))

    for batch in batches:
        h = batch.column("h").to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        starts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
        sizes = np.diff(np.concatenate([starts, [len(h)]]))
        if last is None or h[0] != last:
            yield from closed()
            held, size = [], 0
        lead = int(sizes[0])
        held.append(batch.slice(0, lead))
        size += lead
        if size > hottest:
            yield from closed()
            held = []
        if len(starts) > 1:
            yield from closed()
            inner = np.repeat(sizes[1:-1], sizes[1:-1])
            keep = np.zeros(len(h), dtype=bool)
            keep[starts[1] : starts[-1]] = inner > 1
            if keep.any():
                n = inner[inner > 1]
                yield from marked(batch.filter(pa.array(keep)), np.where(n > hottest, 2, np.where(n > hot, 1, 0)))
            held, size = [batch.slice(int(starts[-1]))], int(sizes[-1])
        last = h[-1]
    yield from closed()


def _ranges(level: int) -> list[tuple[int, int]]:
    """Stretches of shifts that a sample of a hot bucket is dealt under: strings that are equal at one of them agree in
    all bytes that the strings of the stretch have in common, which become part of the bucket's name."""
    width = {0: SHIFTS, 1: 20, 2: 1}[level]
    return [(s, min(s + width, SHIFTS) - 1) for s in range(0, SHIFTS, width)]


def _named(h: int, low: int, shared: bytes) -> int:
    """Name of the part of bucket ``h`` in which ``shared`` lies about the sample."""
    return int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=struct.pack("<qi", h, low)).digest(), "little", signed=True)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, row, place, least, most, around): the bytes that the strings of a sample cover. Where an earlier
    sample of the batch covers the same bytes, ``around`` is null and all its strings are repeats."""
    names = ["h", "doc", "row", "place", "least", "most", "around"]
    for batch in batches:
        kinds = [pa.int64(), batch.column("doc").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        cols = [batch.column(c).to_pylist() for c in ("doc", "row", "text", "found")]
        order = sorted(range(batch.num_rows), key=lambda i: (cols[0][i] is None, cols[0][i], cols[1][i]))
        seen: set[tuple[int, int, bytes]] = set()
        out: list[list] = [[] for _ in names]
        size = 0
        for i in order:
            doc, row, text, found = (c[i] for c in cols)
            for spot, h, level in sorted((f["spot"], f["h"], f["level"]) for f in found):
                place, lowest, highest = spot >> 16, spot >> 8 & 255, spot & 255
                for low, high in _ranges(level):
                    least, most = max(low, lowest), min(high, highest)
                    if least > most:
                        continue
                    around = text[place - most : place - least + LENGTH]
                    name = h if not level else _named(h, low, text[place - low : place - high + LENGTH])
                    key = (name, most, around)
                    again = key in seen
                    if not again:
                        seen.add(key)
                        size += len(around)
                    for column, value in zip(out, (name if not again else row, doc, row, place, least, most, None if again else around)):
                        column.append(value)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
                out, size = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _classes(bytes_: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket and bytes, common-prefix length with the row before; -1 where the bucket changes)."""
    n, width = bytes_.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = bytes_
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([words[:, j] for j in reversed(range(words.shape[1]))] + [bucket])
    differs = bytes_[order[1:]] != bytes_[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common[bucket[order[1:]] != bucket[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def repeats(h: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, around: list[bytes]) -> np.ndarray:
    """Marks (sample, shift) for strings that an earlier sample of the same bucket has; samples come in text order."""
    n = len(h)
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, SHIFTS - 1), np.uint8)
    for i, a in enumerate(around):
        data, m = np.frombuffer(a, dtype=np.uint8), most[i]
        right[i, : len(data) - m] = data[m:]
        left[i, :m] = data[:m][::-1]
    bucket = np.unique(h, return_inverse=True)[1]
    r_order, r_common = _classes(right, bucket)
    l_order, l_common = _classes(left, bucket)
    marks = np.zeros((n, SHIFTS), dtype=bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for shift in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= shift) & (shift <= most))
        if len(own) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < LENGTH - shift)
        l_class[l_order] = np.cumsum(l_common < shift)
        _, first = np.unique(r_class[own] * (n + 1) + l_class[own], return_index=True)
        again = np.ones(len(own), dtype=bool)
        again[first] = False
        marks[own[again], shift] = True
    return marks


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, start, end) of byte spans to remove. Input is sorted by h, then in text order."""
    held: list[pa.RecordBatch] = []

    def spans(b: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        get = lambda c: b.column(c).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(c).to_numpy()
        h, row, place, least, most = (get(c) for c in ("h", "row", "place", "least", "most"))
        marks = repeats(h, place, least, most, b.column("around").to_pylist())
        edge = np.zeros((len(h), SHIFTS + 2), dtype=np.int8)
        edge[:, 1:-1] = marks
        step = np.diff(edge, axis=1)
        i, low = np.nonzero(step == 1)
        _, high = np.nonzero(step == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(row[i]), pa.array(place[i] - (high - 1)), pa.array(place[i] - low + LENGTH)], names=["row", "start", "end"]
        )

    for batch in batches:
        known = batch.filter(batch.column("around").is_null())
        if known.num_rows:
            get = lambda c: known.column(c).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [known.column("row"), pa.array(get("place") - get("most")), pa.array(get("place") - get("least") + LENGTH)],
                names=["row", "start", "end"],
            )
        batch = batch.filter(batch.column("around").is_valid())
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            whole = pa.Table.from_batches(held).combine_chunks()
            h = whole.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], side="left"))
            if cut:
                yield spans(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
    if held:
        yield spans(pa.Table.from_batches(held))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            text = text or b""
            runs = united([(f["start"], f["end"]) for f in found or []])
            parts, at = [], 0
            for s, e in runs:
                parts.append(text[at:s])
                at = e
            parts.append(text[at:])
            spans.append([{"start": s, "end": e} for s, e in runs])
            kept.append(b"".join(parts))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"],
        )


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number each that stays the same in every pass. Ids serve where they are integers and unique;
    otherwise the rows are numbered and stored, as a running number would differ when partitions are planned anew."""
    whole = dict(rows.dtypes)["doc"] in ("tinyint", "smallint", "int", "bigint")
    shared = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null")
    if whole and shared.isEmpty():
        # Never null, so that no join filters the texts in a way of its own and both joins share one shuffle of them.
        return rows.withColumn("row", F.coalesce(F.col("doc").cast("long"), F.lit(0)))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "repeats-rows")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, hottest: int = HOTTEST) -> DataFrame:
    """One row per document: id, n_bytes, spans (removed byte runs), kept (the remaining bytes).

    A byte goes if a string of LENGTH bytes that covers it starts earlier too: in a document with a smaller id
    (null ids last, rows of one id in the order they are read) or earlier in the same one. Null counts as empty;
    texts shorter than LENGTH stay whole. Ids are integers, texts (in the order of their code points), dates or
    decimals. An empty table gives no row.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _numbered(pick(docs, doc=id_col, text=text_col).select("doc", F.col("text").cast("binary").alias("text")))
    kind = rows.schema["doc"].dataType.simpleString()
    sampled = rows.select("row", "text").mapInArrow(_sample, "h long, row long, spot long")
    again = sampled.repartition(n, "h").sortWithinPartitions("h").mapInArrow(lambda b: _repeated(b, hot, hottest), "h long, row long, spot long, level int")
    found = again.groupBy("row").agg(F.collect_list(F.struct("spot", "h", "level")).alias("found"))
    cut = rows.join(found, "row").select("doc", "row", "text", "found").mapInArrow(
        _cut_out, f"h long, doc {kind}, row long, place long, least int, most int, around binary"
    )
    marked = cut.repartition(n, "h").sortWithinPartitions("h", F.col("doc").asc_nulls_last(), "row", "place").mapInArrow(_mark, "row long, start long, end long")
    spans = marked.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    return rows.join(spans, "row", "left").select("doc", "text", "found").mapInArrow(
        _remove, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``remove_repeats`` returns."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select(
        F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
