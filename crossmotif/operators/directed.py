"""Directed profile: shape kernels of small edge sets, boosted scores, balanced selection, coverage-aware order.

A candidate has few edges, so its simple paths are listed inside its row by array functions:
paths of one edge are extended step by step, and the longest path, closed cycles, reciprocal
edges and feed-forward triples are read off the lists. Nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmotif.operators import motifs
from crossmotif.operators.ranking import kernels
from crossmotif.plans.relational import run
from crossmotif.runtime import cut, stored, with_place

STEPS = 6  # edges of the longest path looked for; candidates have at most seven nodes
# Directed types, in the order in which a query's selection prefers them.
DIRECTED = ("directed_chain", "feed_forward", "directed_cycle", "dense_hyperlink_block", "directed_star")
KEY = ("anchor", "candidate_type", "nodes", "edges")


def directed_pool(d) -> str:
    """Relation of the candidates of the directed profile, de-duplicated."""
    shorter = lambda k: lambda d: k(d, 3)
    kinds = (
        motifs.anchor_expansion, motifs.radius2, shorter(motifs.directed_chain), motifs.fan_out, motifs.fan_in, motifs.star, motifs.bridge, motifs.directed_star,
        motifs.triangle, motifs.cycle4, motifs.cycle, motifs.dense_block, motifs.feed_forward, shorter(motifs.directed_cycle),
    )
    return motifs.pooled(d, kinds)


def with_pairs(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates with the ends of their edges as an array of (src, dst); unknown edges are left out."""
    rows = candidates.select(*KEY)
    ends = rows.withColumn("edge_id", F.explode(F.split("edges", ","))).join(edges.select("edge_id", "src", "dst"), "edge_id")
    found = ends.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("pairs"))
    return found


def shapes(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``rows`` with path_length, has_cycle, near_cycle, feed_forward and star_score of their ``pairs``.

    A cycle has at least three nodes; an edge and its reverse make a near cycle. In a feed-forward triple a source
    reaches two targets: 1.0 if an edge leads from the smaller to the larger, 0.85 for the other way, else 0.55.
    """
    rows = rows.withColumn("p1", F.expr("transform(filter(pairs, e -> e.src <> e.dst), e -> array(e.src, e.dst))"))
    for k in range(1, steps):
        rows = rows.withColumn(
            f"p{k + 1}",
            F.expr(f"flatten(transform(p{k}, p -> transform(filter(pairs, e -> e.src = element_at(p, -1) and not array_contains(p, e.dst)), e -> concat(p, array(e.dst)))))"),
        )
    longest = F.lit(0)
    for k in range(1, steps + 1):
        longest = F.when(F.size(f"p{k}") > 0, k).otherwise(longest)
    closed = " or ".join(f"exists(p{k}, p -> exists(pairs, e -> e.src = element_at(p, -1) and e.dst = p[0]))" for k in range(2, steps + 1))
    forward = """array_max(flatten(transform(pairs, e -> transform(filter(pairs, f -> f.src = e.src and e.dst < f.dst), f ->
        case when exists(pairs, g -> g.src = e.dst and g.dst = f.dst) then 1.0D when exists(pairs, g -> g.src = f.dst and g.dst = e.dst) then 0.85D else 0.55D end))))"""
    degree = "array_max(transform(pairs, e -> greatest(size(filter(pairs, f -> f.src = e.src)), size(filter(pairs, f -> f.dst = e.dst)))))"
    return rows.select(
        *[c for c in rows.columns if not c.startswith("p") or c == "pairs"], longest.cast("long").alias("path_length"), F.expr(closed).alias("has_cycle"),
        F.expr("exists(pairs, e -> exists(pairs, f -> f.src = e.dst and f.dst = e.src))").alias("near_cycle"),
        F.coalesce(F.expr(forward), F.lit(0.0)).alias("feed_forward"), F.least(F.lit(1.0), F.coalesce(F.expr(degree), F.lit(0)) / 4.0).alias("star_score"),
    )


def directed_kernels(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed kernels of candidates: path length, cycle, near cycle, star and feed-forward direction."""
    return shapes(with_pairs(candidates, edges)).drop("pairs")


def directed_scores(spark: SparkSession, pool: DataFrame, edges: DataFrame, node_party: DataFrame) -> DataFrame:
    """Candidates of the directed profile with boosted raw and final scores."""
    base = run(spark, lambda d: kernels(d, "{pool}", boosted=True), {"pool": pool, "node_party": node_party})
    both = base.join(shapes(with_pairs(pool, edges)).withColumnsRenamed({c: f"s_{c}" for c in KEY}), F.expr(" and ".join(f"{c} = s_{c}" for c in KEY)), "left")
    kind = F.col("candidate_type")
    known = F.size(F.coalesce("pairs", F.array().cast("array<struct<src:string,dst:string>>")))
    inner = F.expr("size(filter(coalesce(pairs, array()), e -> e.src <> e.dst))")  # the ends of a candidate's edges are among its nodes
    density = F.when(F.col("n") <= 1, 0.0).otherwise(inner / (F.col("n") * (F.col("n") - 1)))
    dense = F.when(
        kind == "dense_hyperlink_block",
        F.least(F.lit(1.0), density * 2.2 + 0.20 * F.col("cross_support") + F.when((F.col("n") >= 4) & (known >= 4), 0.10).otherwise(0.0)),
    ).when(kind == "feed_forward", F.least(F.lit(1.0), density * 1.5)).otherwise(F.least(F.lit(1.0), density * 1.2))
    length = F.coalesce("path_length", F.lit(0))
    path = F.when((kind == "directed_chain") & (length > 1), F.least(F.lit(1.0), 0.25 * length + 0.25 * F.col("cross_support"))).otherwise(0.0)
    cycle = F.when((kind != "directed_cycle") | (known == 0), 0.0).when(F.col("n") > 6, 0.15).when(F.col("has_cycle"), 1.0).when(F.col("near_cycle"), 0.65).otherwise(0.20)
    scored = both.withColumns({"directed_density": F.when(F.col("n") <= 1, 0.0).otherwise(dense), "directed_path": path, "directed_cycle_score": cycle})
    consistency = (
        F.when(~kind.isin(*DIRECTED, "cycle", "cycle4") | (known == 0), 0.0)
        .when(kind == "feed_forward", F.col("feed_forward"))
        .when(kind == "directed_chain", F.when(length > 1, F.least(F.lit(1.0), 0.35 * length)).otherwise(0.0))
        .when(kind == "directed_cycle", F.col("directed_cycle_score"))
        .when(kind == "dense_hyperlink_block", F.least(F.lit(1.0), 0.45 + F.col("directed_density")))
        .when(kind == "directed_star", F.col("star_score"))
        .otherwise(0.25)
    )
    scored = scored.withColumn("consistency", consistency)
    plain = F.col("structural") + F.col("compactness") + F.col("cross_support") + 0.5 * F.col("multi_party") + F.col("closure") + F.col("type_bonus") - F.col("size_penalty")
    raw = plain + 0.6 * F.col("consistency") + 0.5 * F.col("directed_density") + 0.4 * F.col("directed_path") + 0.4 * F.col("directed_cycle_score")
    final = (
        0.20 * F.col("structural") + 0.10 * F.col("compactness") + 0.22 * F.col("cross_support") + 0.10 * F.col("multi_party") + 0.14 * F.col("closure") + 0.18 * F.col("consistency")
        + 0.16 * F.col("directed_density") + 0.10 * F.col("directed_path") + 0.10 * F.col("directed_cycle_score") + F.when(F.col("anchor") != "", 0.04).otherwise(0.0)
        + F.col("type_bonus") - F.col("size_penalty")
    )
    return scored.select(
        *KEY, "n", "m", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("consistency", "directed_density", "directed_path", "directed_cycle_score")],
        F.round(raw, 9).alias("raw_score"), F.round(final, 9).alias("score"),
    )


def selected(scored: DataFrame, limit: int = 24, least: int = 1, most: int = 8, preferred: tuple[str, ...] = DIRECTED) -> DataFrame:
    """The candidates that each query keeps. A query with at most ``limit`` keeps all; otherwise the best ``least`` of each
    preferred type come first, and the others follow by raw score, at most ``most`` of a type that is not preferred."""
    liked = ", ".join(f"'{p}'" for p in preferred)
    order = f"raw_score desc, case when candidate_type = 'triangle' then 0 else 1 end, candidate_type, edges, nodes"
    ranked = scored.selectExpr(
        "*", "count(*) over (partition by anchor) as _all", f"row_number() over (partition by anchor, candidate_type order by {order}) as _of_type"
    )
    fits = ranked.where(f"_all <= {limit} or candidate_type in ({liked}) or _of_type <= {most}")
    first = f"case when candidate_type in ({liked}) and _of_type <= {least} then 0 else 1 end"
    kept = fits.selectExpr("*", f"row_number() over (partition by anchor order by {first}, {order}) as _turn").where(f"_turn <= {limit}")
    return kept.drop("_all", "_of_type", "_turn")


# Limits of the coverage-aware prefix.
PREFIX, PER_QUERY = 1000, 3
MOST = {"feed_forward": 320, "cycle4": 260}
LEAST = {"directed_chain": 120, "feed_forward": 220, "directed_cycle": 80, "dense_hyperlink_block": 80, "directed_star": 40}


def covering_prefix(rows: list[tuple[int, str, str]], prefix: int = PREFIX, per_query: int = PER_QUERY, most: dict = MOST, least: dict = LEAST) -> list[int]:
    """Places, in order, of the candidates that form the prefix. ``rows`` are (place, query, type) by place.

    Types with a minimum take turns until each has it or runs out; then all follow by place, both under the cap of a
    query; then the prefix is filled without that cap. Caps of types always hold.
    """
    chosen: dict[int, None] = {}
    of_query: Counter = Counter()
    of_type: Counter = Counter()

    def take(row: tuple[int, str, str], capped: bool) -> bool:
        place, query, kind = row
        full = len(chosen) >= prefix or place in chosen or (capped and of_query[query] >= per_query) or of_type[kind] >= most.get(kind, prefix)
        if not full:
            chosen[place] = None
            of_query[query] += 1
            of_type[kind] += 1
        return not full

    queues = {kind: iter([r for r in rows if r[2] == kind]) for kind in least}
    waiting = [kind for kind in least if any(r[2] == kind for r in rows)]
    while waiting and len(chosen) < prefix:
        for kind in list(waiting):
            if of_type[kind] >= least[kind] or not any(take(r, True) for r in queues[kind]):
                waiting.remove(kind)
    for capped in (True, False):
        for r in rows:
            take(r, capped)
    return list(chosen)


def coverage_aware(chosen: DataFrame, prefix: int = PREFIX, per_query: int = PER_QUERY) -> DataFrame:
    """Order in which a diverse prefix of directed candidates comes first and the others follow by score.

    Only candidates that can enter the prefix reach the driver. Under the cap of a query these are, of each type, the
    first 2 * prefix of those among the first ``per_query`` of their query and type: at most ``prefix`` are taken and no
    more than as many are refused. Without that cap they are the first 2 * prefix of each type.
    """
    placed = stored(with_place(chosen, "score DESC, anchor, candidate_type, edges, nodes", "by_score"), "coverage")
    near = placed.selectExpr("by_score", "anchor", "candidate_type", "row_number() over (partition by anchor, candidate_type order by by_score) as _turn")
    near = stored(near, "coverage-turns")
    types = [r.candidate_type for r in near.select("candidate_type").distinct().collect()]  # the generators' names
    taken = None
    for kind in sorted(types):
        own = near.where(F.col("candidate_type") == kind)
        for part in (own, own.where(F.col("_turn") <= per_query)):
            first = part.orderBy("by_score").limit(2 * prefix)
            taken = first if taken is None else taken.unionByName(first)
    pool = set() if taken is None else {(r.by_score, r.anchor, r.candidate_type) for r in taken.collect()}
    front = covering_prefix(sorted(pool), prefix, per_query)
    spark = chosen.sparkSession
    lead = spark.createDataFrame([(p, i) for i, p in enumerate(front)], "lead long, nth int")  # ``prefix`` rows at most
    both = placed.join(F.broadcast(lead), F.col("by_score") == F.col("lead"), "left").withColumn("later", F.coalesce("nth", F.lit(prefix)))
    return with_place(both, "later, by_score", "place").select(*KEY, F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


#: Reference of the kernels: paths by recursion over rows, written apart from the array functions above.
KERNELS_SQL = """
    ends AS (SELECT c.anchor, c.candidate_type, c.nodes, c.edges, f.src, f.dst FROM (SELECT *, unnest(string_split(edges, ',')) AS edge_id FROM candidates) c JOIN flow f ON f.edge_id = c.edge_id),
    sets AS (SELECT row_number() OVER () AS cid, * FROM (SELECT DISTINCT anchor, candidate_type, nodes, edges FROM ends)),
    e AS (SELECT s.cid, x.src, x.dst FROM ends x JOIN sets s USING (anchor, candidate_type, nodes, edges)),
    walk(cid, start, cur, seen, steps) AS (
        SELECT DISTINCT cid, src, dst, [src, dst], 1 FROM e WHERE src <> dst
        UNION SELECT w.cid, w.start, e.dst, list_append(w.seen, e.dst), w.steps + 1 FROM walk w JOIN e ON e.cid = w.cid AND e.src = w.cur WHERE NOT list_contains(w.seen, e.dst) AND w.steps < 6),
    longest AS (SELECT cid, max(steps) AS path_length FROM walk GROUP BY cid),
    rings AS (SELECT DISTINCT w.cid FROM walk w JOIN e ON e.cid = w.cid AND e.src = w.cur AND e.dst = w.start WHERE w.steps >= 2),
    twice AS (SELECT DISTINCT a.cid FROM e a JOIN e b ON a.cid = b.cid AND a.src = b.dst AND a.dst = b.src),
    degree AS (SELECT cid, max(k) AS k FROM (SELECT cid, count(*) AS k FROM e GROUP BY cid, src UNION ALL SELECT cid, count(*) FROM e GROUP BY cid, dst) GROUP BY cid),
    forks AS (SELECT a.cid, max(CASE WHEN x.cid IS NOT NULL THEN 1.0 WHEN y.cid IS NOT NULL THEN 0.85 ELSE 0.55 END) AS score FROM (SELECT DISTINCT * FROM e) a JOIN (SELECT DISTINCT * FROM e) b
        ON a.cid = b.cid AND a.src = b.src AND a.dst < b.dst LEFT JOIN e x ON x.cid = a.cid AND x.src = a.dst AND x.dst = b.dst LEFT JOIN e y ON y.cid = a.cid AND y.src = b.dst AND y.dst = a.dst GROUP BY a.cid)
    SELECT s.anchor, s.candidate_type, s.nodes, s.edges, CAST(coalesce(l.path_length, 0) AS BIGINT) AS path_length, r.cid IS NOT NULL AS has_cycle, t.cid IS NOT NULL AS near_cycle,
        CAST(coalesce(f.score, 0) AS DOUBLE) AS feed_forward, least(1.0, CAST(g.k AS DOUBLE) / 4) AS star_score
    FROM sets s LEFT JOIN longest l USING (cid) LEFT JOIN rings r USING (cid) LEFT JOIN twice t USING (cid) LEFT JOIN forks f USING (cid) JOIN degree g USING (cid)"""


def directed_cycles(edges: DataFrame, longest: int = 8) -> DataFrame:
    """(nodes, length): elementary directed cycles of two to ``longest`` nodes of (src, dst), each once from its smallest
    node, by path joins. Nodes that no cycle can hold, for want of an edge in or out, are pruned first, round by round
    while that helps, and a path goes on only over nodes above its start."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    left = e.count()
    for _ in range(longest):
        ins, outs = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e = cut(e.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        before, left = left, e.count()
        if left == before:
            break
    step = e.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"))
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("cur"))
    found = None
    for k in range(2, longest + 1):
        ahead = paths.join(step, "cur")
        closed = ahead.where("nxt = path[0]").select(F.array_join("path", ">").alias("nodes"), F.lit(k).cast("long").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        paths = ahead.where("nxt > path[0] and not array_contains(path, nxt)").select(F.concat("path", F.array("nxt")).alias("path"), F.col("nxt").alias("cur"))
    return found


