"""Partitioned graph tables derived from relational sources.

``GraphTables`` bundles the relations that every graph operator reads: the multigraph's
edges, the parties that see each node and edge, pair tables and ranked, capped neighbour
lists. All are lazy DataFrames; ids are strings and every order is total.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossmotif.runtime import stored, table

UNKNOWN = "UNKNOWN"
NEIGHBOURS = 24
PARTIES = 5
PAIRS = 500_000  # pairs of parts that a task counts


def flow_edges(orders: DataFrame) -> DataFrame:
    """Edges from each order's customer to the next order's, by (date, key); self-loops and the last row go.

    The successor is found within a day, and for the last order of a day as the first of the next day with
    orders, so that no task sees more than a day of rows; only the list of days is ordered as a whole.
    """
    rows = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    day = Window.partitionBy("o_orderdate").orderBy("o_orderkey")
    firsts = rows.groupBy("o_orderdate").agg(F.min_by("o_custkey", "o_orderkey").alias("first"))
    firsts = firsts.select("o_orderdate", F.lead("first").over(Window.orderBy("o_orderdate")).alias("tomorrow"))
    chained = rows.withColumn("today", F.lead("o_custkey").over(day)).join(firsts, "o_orderdate")
    ahead = F.coalesce("today", "tomorrow")
    return chained.where(ahead.isNotNull() & (ahead != F.col("o_custkey"))).select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("edge_id"),
        F.col("o_custkey").cast("string").alias("src"),
        ahead.cast("string").alias("dst"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("weight"),
        F.col("o_orderpriority").alias("pay_format"),
        F.col("o_orderstatus").alias("currency"),
        (F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 10_000_000_000 + F.col("o_orderkey")).alias("ord"),
    )


def customer_parties(customer: DataFrame, parties: int = PARTIES) -> DataFrame:
    return customer.select(
        F.col("c_custkey").cast("string").alias("node"), F.concat(F.lit("P00"), (F.col("c_nationkey") % parties).cast("string")).alias("party")
    )


def co_purchase_pairs(lineitem: DataFrame) -> DataFrame:
    """Distinct unordered pairs of parts that share an order."""
    parts = lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("p")).distinct()
    other = parts.select("l_orderkey", F.col("p").alias("q"))
    return parts.join(other, "l_orderkey").where("p < q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct()


def bought_together(lineitem: DataFrame, each: int = PAIRS) -> DataFrame:
    """(a, b, orders): parts a < b that share an order, with how many orders they share.

    Nearly all pairs differ, so they are not counted before they are dealt, and go to as many tasks as give each of them
    about ``each`` pairs.
    """
    parts = stored(lineitem.select("l_orderkey", "l_partkey").distinct(), "baskets")
    n = F.count("*")
    met = parts.groupBy("l_orderkey").agg((n * (n - 1) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(met // each) + 1)
    pairs = parts.selectExpr("l_orderkey", "l_partkey as a").join(parts.selectExpr("l_orderkey", "l_partkey as b"), "l_orderkey").where("a < b")
    return pairs.select("a", "b").repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("orders"))


@dataclass
class GraphTables:
    edges: DataFrame  # edge_id, src, dst, ord and attributes
    node_party: DataFrame  # node, party
    neighbours: int = NEIGHBOURS
    seen_edges: DataFrame | None = field(default=None)  # edge_id, party where visibility is given
    stored_names: set[str] = field(default_factory=set)  # relations replaced by stored tables

    @classmethod
    def from_flow(cls, spark: SparkSession, sf_dir: str, neighbours: int = NEIGHBOURS) -> GraphTables:
        return cls(flow_edges(table(spark, sf_dir, "orders")), customer_parties(table(spark, sf_dir, "customer")), neighbours)

    @cached_property
    def node_set(self) -> DataFrame:
        """(node, parties): sorted parties of every node that has an edge; UNKNOWN where none sees it."""
        ends = self.edges.select(F.col("src").alias("node")).union(self.edges.select("dst")).distinct()
        known = self.node_party.groupBy("node").agg(F.array_sort(F.collect_set("party")).alias("parties"))
        return ends.join(known, "node", "left").withColumn("parties", F.coalesce("parties", F.array(F.lit(UNKNOWN))))

    @cached_property
    def edge_set(self) -> DataFrame:
        """(edge_id, src, dst, ord, parties, cross): parties of the edge and of its ends; cross is their count over 2, at most 1."""
        s = self.node_set.select(F.col("node").alias("src"), F.col("parties").alias("ps"))
        d = self.node_set.select(F.col("node").alias("dst"), F.col("parties").alias("pd"))
        both = self.edges.select("edge_id", "src", "dst", "ord").join(s, "src").join(d, "dst")
        parties: Column = F.array_union("ps", "pd")
        if self.seen_edges is not None:
            seen = self.seen_edges.groupBy("edge_id").agg(F.collect_set("party").alias("pe"))
            both = both.join(seen, "edge_id", "left")
            parties = F.array_union(parties, F.coalesce("pe", F.array().cast("array<string>")))
        clean = F.filter(parties, lambda p: (p != "") & (p != UNKNOWN))
        return both.select(
            "edge_id", "src", "dst", "ord", F.array_sort(clean).alias("parties"), F.least(F.lit(1.0), F.size(clean) / 2.0).alias("edge_cross")
        )

    def _ranked(self, rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("node").orderBy(F.col("edge_cross").desc(), "nbr", "edge_id")
        return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= self.neighbours)

    @cached_property
    def nbr_out(self) -> DataFrame:
        return self._ranked(self.edge_set.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "edge_id", "edge_cross"))

    @cached_property
    def nbr_in(self) -> DataFrame:
        return self._ranked(self.edge_set.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "edge_id", "edge_cross"))

    @cached_property
    def nbr_any(self) -> DataFrame:
        out = self.edge_set.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "edge_id", "edge_cross")
        back = self.edge_set.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "edge_id", "edge_cross")
        return self._ranked(out.unionByName(back))

    @cached_property
    def pair_dir(self) -> DataFrame:
        """First edge of each directed pair."""
        return self.edges.groupBy("src", "dst").agg(F.min_by("edge_id", "ord").alias("edge_id"))

    @cached_property
    def pair_und(self) -> DataFrame:
        """First edge of each unordered pair, a < b."""
        return self.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by("edge_id", "ord").alias("edge_id"))

    @cached_property
    def links(self) -> DataFrame:
        """Distinct neighbours in both orientations, without multiplicity."""
        p = self.pair_und.select("a", "b")
        return p.select(F.col("a").alias("node"), F.col("b").alias("nbr")).union(p.select("b", "a"))

    def relation(self, name: str) -> DataFrame:
        return {"flow": lambda: self.edges, "node_party": lambda: self.node_party}.get(name, lambda: getattr(self, name))()

    def relations(self) -> dict[str, DataFrame]:
        names = ("flow", "node_party", "edge_set", "node_set", "nbr_out", "nbr_in", "nbr_any", "pair_dir", "pair_und", "links")
        return {n: self.relation(n) for n in names}


#: The same relations over the driver's tables as common table expressions.
DUCK_RELATIONS = {
    "flow": """SELECT 'e' || o_orderkey AS edge_id, CAST(o_custkey AS VARCHAR) AS src, CAST(nxt AS VARCHAR) AS dst, o_orderdate AS ts,
        o_totalprice AS weight, o_orderpriority AS pay_format, o_orderstatus AS currency,
        CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 10000000000 + o_orderkey AS ord
        FROM (SELECT *, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)
        WHERE nxt IS NOT NULL AND nxt <> o_custkey""",
    "node_party": f"SELECT CAST(c_custkey AS VARCHAR) AS node, 'P00' || (c_nationkey % {PARTIES}) AS party FROM customer",
    "node_set": """SELECT n.node, coalesce(k.parties, ['UNKNOWN']) AS parties
        FROM (SELECT src AS node FROM flow UNION SELECT dst FROM flow) n
        LEFT JOIN (SELECT node, list_sort(list(DISTINCT party)) AS parties FROM node_party GROUP BY node) k ON n.node = k.node""",
    "edge_set": """SELECT edge_id, src, dst, ord, parties, least(1.0, len(parties) / 2.0)::DOUBLE AS edge_cross FROM (
        SELECT f.edge_id, f.src, f.dst, f.ord, list_sort(list_filter(list_distinct(list_concat(s.parties, d.parties)), lambda p: p NOT IN ('', 'UNKNOWN'))) AS parties
        FROM flow f JOIN node_set s ON f.src = s.node JOIN node_set d ON f.dst = d.node)""",
    "nbr_out": f"""SELECT * FROM (SELECT src AS node, dst AS nbr, edge_id, edge_cross, row_number() OVER (PARTITION BY src ORDER BY edge_cross DESC, dst, edge_id) AS rn
        FROM edge_set) WHERE rn <= {NEIGHBOURS}""",
    "nbr_in": f"""SELECT * FROM (SELECT dst AS node, src AS nbr, edge_id, edge_cross, row_number() OVER (PARTITION BY dst ORDER BY edge_cross DESC, src, edge_id) AS rn
        FROM edge_set) WHERE rn <= {NEIGHBOURS}""",
    "nbr_any": f"""SELECT * FROM (SELECT node, nbr, edge_id, edge_cross, row_number() OVER (PARTITION BY node ORDER BY edge_cross DESC, nbr, edge_id) AS rn
        FROM (SELECT src AS node, dst AS nbr, edge_id, edge_cross FROM edge_set UNION ALL SELECT dst, src, edge_id, edge_cross FROM edge_set)) WHERE rn <= {NEIGHBOURS}""",
    "pair_dir": "SELECT src, dst, min_by(edge_id, ord) AS edge_id FROM flow GROUP BY src, dst",
    "pair_und": "SELECT least(src, dst) AS a, greatest(src, dst) AS b, min_by(edge_id, ord) AS edge_id FROM flow GROUP BY 1, 2",
    "links": "SELECT a AS node, b AS nbr FROM pair_und UNION ALL SELECT b, a FROM pair_und",
}
#: What each of them reads.
DUCK_NEEDS = {
    "node_set": ["flow", "node_party"], "edge_set": ["flow", "node_set"], "nbr_out": ["edge_set"], "nbr_in": ["edge_set"], "nbr_any": ["edge_set"],
    "pair_dir": ["flow"], "pair_und": ["flow"], "links": ["pair_und"],
}
