"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in hash order, form blocks. Block k of a source whose weight is
q/Q has release time floor(k*Q/q) and deadline ceil((k+1)*Q/q); earliest deadline first
fills one slot after another, and after any number of slots a source has had its share to
within less than one block. The schedule of a set of sources repeats after Q slots, so one
period, worked out on the driver from the weights alone, places every block by arithmetic.
When a source runs out the others go on with their weights in proportion (a new phase),
until every document has its place: none is dropped or repeated.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossmotif.runtime import comparable, pick, stored

BLOCK = 16  # documents
RANGES = 1024  # hash ranges that a source's documents are ranked in
BROADCAST_ROWS = 100_000
GRAIN = 1000  # target weights are integers that add up to about this


def period(weights: dict) -> list:
    """The sources of the Q = sum(weights) slots of one period, by earliest deadline among released blocks."""
    q = sum(weights.values())
    order = {s: i for i, s in enumerate(sorted(weights, key=lambda s: (s is None, s)))}
    done = dict.fromkeys(weights, 0)
    waiting = [(0, order[s], s) for s in weights]  # by release time
    heapq.heapify(waiting)
    ready: list = []  # by deadline
    slots = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, o, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * q // weights[s]), o, s))
        if not ready:
            raise AssertionError("a full utilisation always has a released block")
        _, o, s = heapq.heappop(ready)
        slots.append(s)
        done[s] += 1
        heapq.heappush(waiting, (done[s] * q // weights[s], o, s))
    return slots


def phases(blocks: dict, weights: dict) -> list[dict]:
    """For each phase: its first slot, length, active weights, blocks that each source has had before, and the
    slots of one period. A phase ends with the slot in which the first of its sources runs out."""
    left, had = dict(blocks), dict.fromkeys(blocks, 0)
    start, out = 0, []
    while active := {s: weights[s] for s, n in left.items() if n > 0}:
        q = sum(active.values())
        slots = period(active)
        places = {s: [t for t, x in enumerate(slots) if x == s] for s in active}
        length = min((left[s] - 1) // active[s] * q + places[s][(left[s] - 1) % active[s]] + 1 for s in active)
        out.append({"start": start, "length": length, "q": q, "weights": active, "had": dict(had), "places": places})
        whole, rest = divmod(length, q)
        for s in active:
            took = whole * active[s] + sum(t < rest for t in places[s])
            left[s] -= took
            had[s] += took
        start += length
    return out


def tempered_weights(counts: dict, power: float = 0.5, grain: int = GRAIN) -> dict:
    """Default target weights: shares of count ** power as integers of at least one."""
    total = sum(n**power for n in counts.values()) or 1.0
    return {s: max(1, round(grain * n**power / total)) for s, n in counts.items()}


def ranked(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """(id, source, rank): the place of each row among its source in hash order. Rows are ranked within hash
    ranges and ranges by their counts, so no task holds a whole source."""
    rows = pick(docs, id=id_col, source=source_col).withColumn("hash", F.xxhash64("id"))
    rows = rows.withColumn("range", F.shiftrightunsigned("hash", 54).cast("int"))
    rows = stored(rows, "mix-rows")
    counts = rows.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        F.col("source").alias("s"), F.col("range").alias("r"), "before"
    )
    within = Window.partitionBy("source", "range").orderBy("hash", "id")
    at = rows.withColumn("at", F.row_number().over(within) - 1)
    joined = at.join(offsets, F.expr("source <=> s and range = r"))
    return joined.select("id", "source", (F.col("before") + F.col("at")).alias("rank"))


def mix(
    docs: DataFrame, weights: dict | None = None, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """One row per document: doc_id, source, phase, slot, block, at, release, deadline.

    Reading by (slot, at) gives the mixture: ``slot`` is the turn of the document's block, ``at`` its place in the
    block; ``release`` and ``deadline`` bound the turn. ``weights`` maps each source to a positive integer; by default
    they temper the counts. A null source is a source of its own; a source without a weight is an error. Null ids
    and repeated rows keep one place each; texts are not looked at. An empty table gives no row. The number of sources
    must suit the driver; documents do not matter.
    """
    spark = docs.sparkSession
    rows = ranked(docs, id_col, source_col)
    counts = {r["source"]: r["n"] for r in pick(docs, source=source_col).groupBy("source").agg(F.count("*").alias("n")).collect()}
    weights = tempered_weights(counts) if weights is None else {s: weights[s] for s in counts}
    if any(int(w) != w or w <= 0 for w in weights.values()):
        raise ValueError("weights are positive integers")
    plan = phases({s: -(-n // block) for s, n in counts.items()}, weights)
    parts, turns = [], []
    for p, phase in enumerate(plan):
        for s, q in phase["weights"].items():
            until = plan[p + 1]["had"][s] if p + 1 < len(plan) else -(-counts[s] // block)
            parts.append((p, s, phase["had"][s], until, phase["start"], q, phase["q"]))
            turns += [(p, s, i, t) for i, t in enumerate(phase["places"][s])]
    spans = spark.createDataFrame(parts, "phase int, s string, first long, until long, start long, q long, period long")
    places = spark.createDataFrame(turns, "p int, src string, turn long, place long")
    # Both tables follow from the weights: sources x phases and the slots of their periods, not documents. With very many
    # sources or large weights they are joined like any others.
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    rows = rows.withColumn("block", F.floor(F.col("rank") / block)).withColumn("at", (F.col("rank") % block).cast("int"))
    rows = rows.withColumn("source", F.col("source").cast("string"))
    placed = rows.join(small(spans, len(parts)), F.expr("source <=> s and block >= first and block < until"))
    placed = placed.withColumn("k", F.col("block") - F.col("first"))
    placed = placed.join(small(places, len(turns)), F.expr("phase = p and source <=> src and k % q = turn"))
    begin = F.col("start")
    return placed.select(
        F.col("id").alias("doc_id"), "source", "phase",
        (begin + F.floor(F.col("k") / F.col("q")) * F.col("period") + F.col("place")).cast("long").alias("slot"),
        "block", "at",
        (begin + F.expr("k * period div q")).cast("long").alias("release"),
        (begin + F.expr("((k + 1) * period + q - 1) div q")).cast("long").alias("deadline"),
    )


def in_mixture_order(docs: DataFrame, weights: dict | None = None, source_col: str = "source") -> DataFrame:
    """All rows of ``docs``, laid out in mixture order: written partitions follow one another in it.

    Rows are known by a hash of all their columns, so null and repeated ids do not matter; rows that agree in every
    column share one turn and stay as many as they are. Columns are addressed by place and may clash in name; maps
    count by their JSON. An empty table stays one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    rows = rows.withColumn("_key", F.xxhash64(*comparable(rows, names)))
    order = mix(rows, weights, BLOCK, "_key", names[docs.columns.index(source_col)]).select(F.col("doc_id").alias("_of"), "slot", "at")
    order = order.groupBy("_of").agg(F.min(F.struct("slot", "at")).alias("_turn"))
    placed = rows.join(order, F.col("_key") == F.col("_of"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "_turn").sortWithinPartitions("_turn").select(*names).toDF(*docs.columns)
