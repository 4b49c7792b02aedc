"""Ranking strategies side by side: precision, recall, motif hits and type coverage as one wide row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIXES = (10, 20, 50, 100)
HIT_PREFIXES = (100, 200)
METRICS = [f"p_at_{k}" for k in PREFIXES] + [f"r_at_{k}" for k in PREFIXES] + [f"motif_hits_at_{k}" for k in HIT_PREFIXES] + ["candidate_types_at_100", "motif_types_at_100"]


def raw_order(selected: DataFrame, places: int = max(HIT_PREFIXES)) -> DataFrame:
    """The first places of the candidates by raw score alone."""
    by = [F.desc("raw_score"), "anchor", "candidate_type", "edges", "nodes"]
    return selected.orderBy(*by).limit(places).withColumn("place", F.row_number().over(Window.orderBy(*by)))


def strategy_table(orders: dict[str, DataFrame], truth: DataFrame, pool: DataFrame) -> DataFrame:
    """A row for each strategy with the columns ``METRICS``.

    ``orders`` maps a strategy to rows with place, candidate_type and edges, ``truth`` has gt_pos, motif_type and edges; edges
    are comma-separated. A candidate hits each motif that it shares an edge with. Precision is the share of candidates of the
    prefix with a hit, recall that of motifs hit; coverage compares the types of the first 100 with those of ``pool`` and
    ``truth``. Fewer candidates than the prefix: all of them. No candidates or no motifs: zeros. Only the prefixes are joined.
    """
    names = list(orders)
    top = None
    for name in names:
        rows = orders[name].where(F.col("place") <= max(HIT_PREFIXES)).select(F.lit(name).alias("strategy"), F.col("place").cast("int").alias("place"), "candidate_type", "edges")
        top = rows if top is None else top.unionAll(rows)
    items = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.split("edges", ","))).alias("item"))
    hits = items(top, "strategy", "place").join(items(truth, "gt_pos", "motif_type"), "item").select("strategy", "place", "gt_pos", "motif_type").distinct()

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    def upto(column: str, k: int) -> Column:
        return F.count_distinct(F.when(F.col("place") <= k, F.col(column)))

    seen = top.groupBy("strategy").agg(F.max("place").alias("n"), upto("candidate_type", 100).alias("kinds"))
    met = hits.groupBy("strategy").agg(
        *[upto("place", k).alias(f"c{k}") for k in PREFIXES], *[upto("gt_pos", k).alias(f"m{k}") for k in sorted({*PREFIXES, *HIT_PREFIXES})], upto("motif_type", 100).alias("motif_kinds"))
    totals = truth.agg(F.count("*").alias("motifs"), F.count_distinct("motif_type").alias("all_motif_kinds")).crossJoin(pool.agg(F.count_distinct("candidate_type").alias("all_kinds")))  # one row
    every = top.sparkSession.createDataFrame([(n,) for n in names], "strategy string").crossJoin(totals)
    wide = every.join(seen, "strategy", "left").join(met, "strategy", "left").na.fill(0)
    values = {f"p_at_{k}": share(F.col(f"c{k}"), F.least(F.col("n"), F.lit(k))) for k in PREFIXES}
    values |= {f"r_at_{k}": share(F.col(f"m{k}"), F.col("motifs")) for k in PREFIXES}
    values |= {f"motif_hits_at_{k}": F.col(f"m{k}") for k in HIT_PREFIXES}
    values |= {"candidate_types_at_100": share(F.col("kinds"), F.col("all_kinds")), "motif_types_at_100": share(F.col("motif_kinds"), F.col("all_motif_kinds"))}
    return wide.select("strategy", *[F.round(values[m].cast("double"), 6).alias(m) for m in METRICS])


def long_table(table: DataFrame) -> DataFrame:
    """(metric, one column a strategy): the wide table turned round."""
    rows = table.unpivot(["strategy"], METRICS, "metric", "value")
    return rows.groupBy("metric").pivot("strategy", ["raw", "base", "diverse", "hybrid"]).agg(F.first("value"))


#: Reference of long_table, metric by metric over lists of what a prefix hits.
STRATEGIES_SQL = """
    , o AS MATERIALIZED (SELECT 'raw' AS s, row_number() OVER (ORDER BY raw_score DESC, anchor, candidate_type, edges, nodes) AS place, candidate_type, edges FROM order_raw
        UNION ALL SELECT 'base', place, candidate_type, edges FROM order_base UNION ALL SELECT 'diverse', place, candidate_type, edges FROM order_diverse UNION ALL SELECT 'hybrid', place, candidate_type, edges FROM order_hybrid),
    t AS MATERIALIZED (SELECT * FROM o WHERE place <= 200), g AS (SELECT gt_pos, motif_type, unnest(string_split(edges, ',')) AS item FROM ground_truth),
    h AS MATERIALIZED (SELECT t.s, t.place, t.candidate_type, (SELECT list(DISTINCT g.gt_pos) FROM g WHERE list_contains(string_split(t.edges, ','), g.item)) AS ms,
        (SELECT list(DISTINCT g.motif_type) FROM g WHERE list_contains(string_split(t.edges, ','), g.item)) AS ks FROM t),
    k AS (SELECT unnest([10, 20, 50, 100, 200]) AS k),
    q AS (SELECT s, k, count(*) AS n, count(ms) AS hit, len(list_distinct(flatten(list(ms) FILTER (ms IS NOT NULL)))) AS found, len(list_distinct(flatten(list(ks) FILTER (ks IS NOT NULL)))) AS kinds, count(DISTINCT candidate_type) AS types
        FROM h JOIN k ON place <= k GROUP BY s, k),
    v AS (SELECT s, 'p_at_' || k AS metric, hit / n::DOUBLE AS value FROM q WHERE k <= 100 UNION ALL SELECT s, 'r_at_' || k, found / (SELECT count(*) FROM ground_truth)::DOUBLE FROM q WHERE k <= 100
        UNION ALL SELECT s, 'motif_hits_at_' || k, found FROM q WHERE k >= 100 UNION ALL SELECT s, 'candidate_types_at_100', types / (SELECT count(DISTINCT candidate_type) FROM order_raw)::DOUBLE FROM q WHERE k = 100
        UNION ALL SELECT s, 'motif_types_at_100', kinds / (SELECT count(DISTINCT motif_type) FROM ground_truth)::DOUBLE FROM q WHERE k = 100)
    SELECT metric, round(max(value) FILTER (s = 'raw'), 6) AS raw, round(max(value) FILTER (s = 'base'), 6) AS base, round(max(value) FILTER (s = 'diverse'), 6) AS diverse, round(max(value) FILTER (s = 'hybrid'), 6) AS hybrid
    FROM v GROUP BY metric"""
