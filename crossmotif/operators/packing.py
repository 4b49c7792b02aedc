"""Components to the least-loaded party, largest first: the greedy assignment without a sequential pass.

Only the histogram of component sizes matters for the loads, and N nodes have at most sqrt(2 N) sizes. Among
components of one size the parties that are less than a size apart take turns, in the order of their loads, until
the next one is reached; so a size is dealt in a few runs, whatever its number of components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.runtime import with_place

BROADCAST_ROWS = 100_000


def runs(sizes: list[tuple[int, int]], loads: list[int]) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, end, parties): of the components of a size, those from first to before end go to the parties in
    turn. ``sizes`` are (size, number) from the largest; ties of load go to the earlier party."""
    loads, out = list(loads), []
    for size, number in sizes:
        at = 0
        while at < number:
            low = min(loads)
            near = sorted((i for i, x in enumerate(loads) if x < low + size), key=lambda i: (loads[i], i))
            rest = [x for x in loads if x >= low + size]
            rounds = (min(rest) - low) // size if rest else number
            n = min(number - at, rounds * len(near))
            out.append((size, at, at + n, near))
            for k, i in enumerate(near):
                loads[i] += size * (n // len(near) + (k < n % len(near)))
            at += n
    return out


def pack(components: DataFrame, parties: list[str], loads: dict[str, int] | None = None) -> DataFrame:
    """(node, component, party) from (node, component): components in order of size, then name, each to the party that has
    fewest nodes by then, ``loads`` included. An empty table gives none."""
    spark = components.sparkSession
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    histogram = sorted((tuple(r) for r in sizes.groupBy("size").agg(F.count("*")).collect()), reverse=True)  # sqrt(2 x nodes) rows at most
    before, firsts = 0, []
    for size, number in histogram:
        firsts.append((size, before))
        before += number
    dealt = runs(histogram, [(loads or {}).get(p, 0) for p in parties])
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    starts = small(spark.createDataFrame(firsts, "of long, before long"), len(firsts))
    turns = small(spark.createDataFrame([(s, a, b, [parties[i] for i in p]) for s, a, b, p in dealt], "s long, first long, end long, turn array<string>"), len(dealt))
    placed = with_place(sizes, "size DESC, component", "place").join(starts, F.col("size") == F.col("of"))
    placed = placed.withColumn("at", F.col("place") - 1 - F.col("before"))
    chosen = placed.join(turns, (F.col("size") == F.col("s")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("end")))
    party = F.element_at("turn", ((F.col("at") - F.col("first")) % F.size("turn") + 1).cast("int"))
    return components.join(chosen.select("component", party.alias("party")), "component").select("node", "component", "party")


#: Reference: one component after the other, with the list of loads.
PACKING_SQL = """
    , e AS (SELECT src AS a, dst AS b FROM flow WHERE weight > 450000 UNION SELECT dst, src FROM flow WHERE weight > 450000 UNION SELECT src, src FROM flow UNION SELECT dst, dst FROM flow),
    r(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), c AS MATERIALIZED (SELECT node, min(other) AS component FROM r GROUP BY node),
    q AS MATERIALIZED (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS place FROM c GROUP BY component),
    g(place, who, loads) AS (SELECT 0, 0, CAST([0, 0, 0, 0, 0] AS BIGINT[]) UNION ALL
        SELECT q.place, list_position(loads, list_min(loads)), list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + q.size ELSE x END) FROM g JOIN q ON q.place = g.place + 1)
    SELECT c.node, c.component, 'P00' || (g.who - 1) AS party FROM c JOIN q USING (component) JOIN g USING (place)"""
