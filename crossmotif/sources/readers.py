"""Readers and writers of the file formats that graph data sets come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossmotif.runtime import with_place

TRANSACTION_COLUMNS = [
    "Timestamp", "From Bank", "Account", "To Bank", "Account.1", "Amount Received", "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering",
]
PREDICTION_SCHEMA = "query_id string, predicted_nodes array<string>, predicted_edges array<string>, score double, runtime double, metadata map<string,string>"


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions as text (leading zeros matter), trimmed, with the SHA-256 of the row's fields."""
    schema = ", ".join(f"`{c}` string" for c in TRANSACTION_COLUMNS)
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    names = ["ts", "from_bank", "from_account", "to_bank", "to_account", "amount_received", "recv_currency", "amount_paid", "paid_currency", "pay_format", "is_laundering"]
    rows = rows.toDF(*names).select(*[F.coalesce(F.trim(n), F.lit("")).alias(n) for n in names])
    return rows.withColumn("tx_hash", F.sha2(F.concat_ws("||", *names[:-1]), 256))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line): lines in file order. Text splits keep their order, so the id grows along each file."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))


def read_bitcoin_graph(spark: SparkSession, features: str, classes: str, edges: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, parties) of a transaction graph in three files: features without a header (id, time step, values),
    classes (1 illicit, 2 licit, else unknown) and an edge list.

    Edges are e0, e1, ... in file order with the time of their source, illicit-related if either end is illicit; those
    with an end that has no features are dropped. A time step is a party.
    """
    raw = spark.read.csv(features)
    values = raw.columns[2:]
    nodes = raw.select(F.col("_c0").alias("node"), F.col("_c1").cast("int").alias("time_step"), F.array(*[F.col(c).cast("double") for c in values]).alias("features"))
    named = spark.read.option("header", True).csv(classes).toDF("node", "class")
    label = F.when(F.col("class") == "1", "illicit").when(F.col("class") == "2", "licit").otherwise("unknown")
    nodes = nodes.join(named, "node", "left").withColumn("label", label).drop("class")
    lines = spark.read.option("header", True).csv(edges).toDF("src", "dst").withColumn("ord", F.monotonically_increasing_id())
    ends = nodes.select("node", "time_step", "label")
    source, target = ends.toDF("src", "ts", "src_label"), ends.select("node", "label").toDF("dst", "dst_label")
    joined = with_place(lines, "ord", "place").join(source, "src").join(target, "dst")
    related = (F.col("src_label") == "illicit") | (F.col("dst_label") == "illicit")
    linked = joined.select(
        F.concat(F.lit("e"), (F.col("place") - 1).cast("string")).alias("edge_id"), "src", "dst", "ts", F.when(related, "illicit_related").otherwise("other").alias("label"), "ord"
    )
    return nodes, linked, nodes.select("node", F.concat(F.lit("T"), F.col("time_step").cast("string")).alias("party"))


def write_report(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A result table as ``csv`` with a header, ``json`` lines or a ``markdown`` table. Reports are small: one file."""
    if form == "markdown":
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
        head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + " --- |" * len(rows.columns))], "at long, value string")
        body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).select((F.monotonically_increasing_id() + 2).alias("at"), "value")
        head.unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
        return
    listed = rows.select(*[F.to_json(f"`{f.name}`").alias(f.name) if form == "csv" and f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in rows.schema])
    listed.coalesce(1).write.mode("overwrite").option("header", True).format(form).save(path)


def flat_metrics(metrics: dict, prefix: str = "") -> dict[str, float]:
    """Nested metrics under dotted names."""
    out: dict = {}
    for key, value in metrics.items():
        name = f"{prefix}{key}"
        out |= flat_metrics(value, f"{name}.") if isinstance(value, dict) else {name: value}
    return out


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Rows of BEGIN/END pattern blocks with the block's type and instance id. Each block is found by a running
    count of its opening lines; the file lists patterns only and is small beside the transactions."""
    lines = _numbered_lines(spark, path)
    order = Window.orderBy("line")
    begins = F.col("value").startswith("BEGIN LAUNDERING ATTEMPT")
    marked = lines.withColumn("block", F.sum(begins.cast("long")).over(order))
    marked = marked.withColumn("kind", F.last(F.when(begins, F.regexp_extract("value", r"-\s*([^:]+)", 1)), True).over(order))
    fields = F.split("value", ",")
    rows = marked.where((F.size(fields) == 11) & ~begins & ~F.col("value").startswith("END LAUNDERING ATTEMPT"))
    key = F.concat_ws("||", *[F.trim(fields[i]) for i in range(10)])
    return rows.select(F.format_string("MOTIF_%07d", "block").alias("motif_instance_id"), F.trim("kind").alias("motif_type"), F.sha2(key, 256).alias("tx_hash"), "line")


def read_edge_list(spark: SparkSession, path: str, directed: bool = True) -> DataFrame:
    """Edges of a whitespace-separated list with # comments; undirected lists lose self-loops and keep the first of each pair."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _numbered_lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(parts[0].alias("src"), parts[1].alias("dst"), F.col("line").alias("ord"))
    if directed:
        return rows
    pairs = rows.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "ord")
    return pairs.groupBy("src", "dst").agg(F.min("ord").alias("ord"))


def edge_prefix(edges: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """Edges among the nodes that appear first, in order, up to a number. The distributed form ranks nodes by their
    first line, so unlike a sequential reader it admits a late edge between early nodes only by that rank."""
    first = edges.select(F.col("src").alias("node"), "ord").union(edges.select("dst", "ord")).groupBy("node").agg(F.min("ord").alias("ord"))
    kept = first.orderBy("ord", "node").limit(max_nodes).select("node")
    inside = edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return inside.orderBy("ord").limit(max_edges)


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """(community, member): one member list per line."""
    return _numbered_lines(spark, path).select(F.col("line").alias("community"), F.explode(F.split(F.trim("value"), r"\s+")).alias("member"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Motifs from JSON lines or one JSON list; absent lists are empty."""
    schema = "query_id string, true_nodes array<string>, true_edges array<string>, true_partitions array<string>, motif_instance_id string"
    text = spark.read.text(path, wholetext=True)
    whole = text.select(F.from_json("value", f"array<struct<{schema.replace(' string', ':string').replace(' array', ':array')}>>").alias("rows"), F.trim("value").startswith("[").alias("listed"))
    listed = whole.where("listed").select(F.explode("rows").alias("r")).select("r.*")
    lines = spark.read.text(path).where(F.trim("value").startswith("{")).select(F.from_json("value", schema).alias("r"))
    lines = lines.crossJoin(whole.select(F.max("listed").alias("any_list"))).where("not any_list").select("r.*")  # one row
    both = listed.unionByName(lines)
    return both.select("query_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("true_nodes", "true_edges", "true_partitions")], "motif_instance_id")


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)
