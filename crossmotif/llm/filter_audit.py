"""How five filters interact: what each removes in every order, what it would have removed later, and what it costs.

A document's failures are five bits. For each of the 32 patterns and 120 orders a table, worked out once, holds the
step at which the first failing filter meets the document. Tasks look batches of patterns up in it and count, with
one bincount a label, removals by part, order and step; the counts of the tasks are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmotif.runtime import pick, stored

NAMES = "ABCDE"
ORDERS = ["".join(p) for p in permutations(NAMES)]
STEPS = len(NAMES)
#: Step (0 to 4) at which an order removes a document that fails the filters in a pattern; 5: never.
FIRST = np.array([[next((k for k, f in enumerate(o) if pattern >> NAMES.index(f) & 1), STEPS) for o in ORDERS] for pattern in range(1 << STEPS)])
BITS = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
ALONE = np.arange(1 << STEPS)[:, None] == (1 << np.arange(STEPS))
# Slots of a part's counts: order x step (the step "never" too), documents, those that fail each filter, those that fail it only.
TOTAL = len(ORDERS) * (STEPS + 1)
FAILING, ONLY = TOTAL + 1, TOTAL + 1 + STEPS
SLOTS = ONLY + STEPS
HELD_PARTS = 1_000  # parts whose counts a task holds before it hands them on

WHITE = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: filters A to D on a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    tests = [n < 100, 100 * distinct < 80 * n, 100 * capitals.cast("long") > 10 * F.length(t).cast("long"), t.rlike("[#$%&*|]")]
    return sum(((x.cast("int") * (1 << i)) for i, x in enumerate(tests)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, pattern, good, toxic, n): documents that agree in part, failure pattern, labels and (before E) text.

    Filter E removes copies: a text that a smaller id has too, anywhere in the table; null ids come after all others,
    and rows of one id and text do not remove each other. A document with several label rows has the largest label;
    label ids of another type count where they can be read as the documents'.
    """
    rows = pick(docs, id=id_col, text=text_col, part=part_col).select(
        "id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), text_failures(F.col("text")).alias("pattern"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("body"),
    )
    # Equal rows are counted before they move, so that repeated rows never meet one by one.
    rows = stored(rows.groupBy("id", "part", "pattern", "body").agg(F.count("*").alias("n")), "audit-rows")
    lowest = rows.groupBy("body").agg(F.min("id").alias("low"))  # skips null ids: only those are null where all are
    # Joined on text and id together: copies of one text are spread by their ids.
    lowest = lowest.select(F.col("body").alias("b"), "low", F.lit(True).alias("first"))
    known = rows.where("id is not null").join(lowest, F.expr("body = b and id = low"), "left").select("id", "part", "pattern", "n", F.col("first").isNull().alias("copy"))
    # Rows without an id: one for each text and part.
    idless = rows.where("id is null").join(lowest, F.expr("body = b")).select("id", "part", "pattern", "n", F.col("low").isNotNull().alias("copy"))
    marks = pick(labels, of="doc_id", quality="quality", toxic="toxic").withColumn("of", F.expr(f"try_cast(of as {rows.schema['id'].dataType.simpleString()})")).where("of is not null").groupBy("of").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = known.join(marks, F.expr("id = of"), "left")
    none = F.lit(None).cast("int")
    labelled = labelled.select("part", "pattern", "n", "copy", "quality", "toxic").unionAll(idless.select("part", "pattern", "n", "copy", none, none))
    return labelled.select(
        "part", (F.col("pattern") + F.col("copy").cast("int") * 16).alias("pattern"), "n",
        F.expr("coalesce(quality = 1, false)").alias("good"), F.expr("coalesce(toxic = 1, false)").alias("toxic"),
    )


def counted(code: np.ndarray, pattern: np.ndarray, n: np.ndarray, parts: int) -> np.ndarray:
    """Counts (parts x SLOTS) of documents with a part's code, a pattern and a weight."""
    out = np.zeros((parts, SLOTS), dtype=np.int64)
    step = FIRST[pattern] + (code[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * (STEPS + 1)
    whole = np.bincount(step.ravel(), weights=np.repeat(n, len(ORDERS)), minlength=parts * TOTAL)
    out[:, :TOTAL] = whole.reshape(parts, TOTAL)
    out[:, TOTAL] = np.bincount(code, weights=n, minlength=parts)
    for f in range(STEPS):
        out[:, FAILING + f] = np.bincount(code, weights=n * BITS[pattern, f], minlength=parts)
        out[:, ONLY + f] = np.bincount(code, weights=n * ALONE[pattern, f], minlength=parts)
    return out


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, counts of documents, of good ones, of toxic ones), as arrays over the slots."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for part, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([c], pa.list_(pa.int64())) for c in counts)], names=["part", "n", "good", "toxic"])
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            rows = batch.slice(at, 4096)
            coded = rows.column("part").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pattern, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("pattern", "n"))
            marks = [np.ones(len(n), dtype=bool), *(rows.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
            counts = np.stack([counted(code[m], pattern[m], n[m], len(names)) for m in marks], axis=1)
            for name, c in zip(names, counts):
                held[name] = held[name] + c if name in held else c
            if len(held) > HELD_PARTS:
                yield from out()
    yield from out()


def audit(patterns: DataFrame) -> DataFrame:
    """One row per part, order and step, zeros included, from (part, pattern, n, good, toxic).

    kept: documents left after the step; removed: by it; redundant: fail its filter but went earlier; unique_fails:
    fail no other filter; good_lost, toxic_lost: removed with that label; shapley: what the filter removes, at
    whatever step, summed over all orders. No document, no part, no row.
    """
    arrays = patterns.mapInArrow(_partials, "part string, n array<long>, good array<long>, toxic array<long>")
    sums = arrays.select("part", F.posexplode(F.arrays_zip("n", "good", "toxic")).alias("slot", "c"))
    sums = sums.groupBy("part", "slot").agg(*[F.sum(f"c.{c}").alias(c) for c in ("n", "good", "toxic")])
    sums = stored(sums, "audit-sums")  # SLOTS rows a part
    spare = sums.where(F.col("slot") >= TOTAL).groupBy("part").agg(
        F.max(F.when(F.col("slot") == TOTAL, F.col("n"))).alias("total"), F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("of")
    )
    orders = F.array(*map(F.lit, ORDERS))
    per = sums.where(F.col("slot") < TOTAL).select(
        "part", orders[F.expr(f"slot div {STEPS + 1}")].alias("filter_order"), (F.col("slot") % (STEPS + 1) + 1).cast("int").alias("step"), "n", "good", "toxic"
    ).where(F.col("step") <= STEPS)
    per = per.withColumn("f", F.expr("substr(filter_order, step, 1)")).join(spare, "part")
    f = F.ascii("f") - ord(NAMES[0])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.element_at("of", (f + FAILING).cast("int")) - F.col("n")
    return per.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"), earlier.alias("redundant"),
        F.element_at("of", (f + ONLY).cast("int")).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "f")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``audit`` of the filters A to E on whole texts. Null texts count as empty and fail A; a null part is the empty
    one; repeated rows count as often as they occur; an empty table gives no row."""
    return audit(failures(docs, labels, id_col, text_col, part_col))
