"""Method view of full queries: JSON records without anything that only evaluation may know.

Records are read as variants. Whitelisted fields stay; edges lose their forbidden fields and get ids of the query,
with a map back that is for evaluation only; descriptions are reworded; metadata of any depth is taken apart level
by level, forbidden names and nulls go with all below them, and what is left is put together from the bottom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossmotif.runtime import stored

# Fields that methods may see, names and parts of names that they may not, and the rewording of descriptions.
ALLOWED = ("query_id", "motif_type", "nodes", "edges", "anchor_nodes", "description", "visible_nodes", "visible_edges", "metadata")
FORBIDDEN = (
    "hidden_nodes", "hidden_edges", "node_mapping", "edge_mapping", "true_nodes", "true_edges", "true_partitions", "motif_instance_id",
    "ground_truth", "ground_truth_nodes", "ground_truth_edges", "ground_truth_partitions",
)
FORBIDDEN_PARTS = ("hidden", "ground_truth", "truth", "true_", "_true", "node_mapping", "edge_mapping", "motif_instance_id", "answer", "label_target")
REWORDED = {
    "hidden_nodes": "withheld nodes",
    "hidden_edges": "withheld edges",
    "node_mapping": "query mapping",
    "edge_mapping": "query mapping",
    "ground truth": "evaluation reference",
    "ground_truth": "evaluation reference",
    "true_nodes": "evaluation nodes",
    "true_edges": "evaluation edges",
    "true_partitions": "evaluation partitions",
    "motif_instance_id": "query id",
}
DEEPEST = 100  # levels of metadata


def forbidden(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*FORBIDDEN) | low.rlike("|".join(FORBIDDEN_PARTS))


def _json(value: Column) -> Column:
    """JSON text of a string."""
    return F.to_json(value.cast("variant"))


def _get(field: str, kind: str = "variant") -> Column:
    return F.variant_get("v", f"$.{field}", kind)


def _kind(v: Column) -> Column:
    """o, a, n or s: object, array, null, other."""
    name = F.schema_of_variant(v)
    return F.when(name.startswith("OBJECT"), "o").when(name.startswith("ARRAY"), "a").when(name == "VOID", "n").otherwise("s")


def _edge_items(field: str) -> Column:
    """Items of a list of edges as structs (dict, names, fields, text)."""
    items = F.when(F.col(f"{field}_kind") == "a", _get(field, "array<variant>"))
    return F.transform(items, lambda e: F.struct(
        (_kind(e) == "o").alias("dict"), F.when(_kind(e) == "o", F.filter(F.array_sort(F.map_keys(F.try_variant_get(e, "$", "map<string,variant>"))), lambda k: ~forbidden(k))).alias("names"),
        F.when(_kind(e) == "o", F.transform_values(F.try_variant_get(e, "$", "map<string,variant>"), lambda k, x: F.to_json(x))).alias("fields"), F.to_json(e).alias("text"),
        F.when(_kind(e) == "o", F.try_variant_get(e, "$.edge_id", "string")).alias("edge_id"),
    ))


def _numbers(items: Column) -> Column:
    """For each item the number of objects before it."""
    plain = F.forall(items, lambda e: e["dict"])
    before = F.transform(items, lambda e, i: F.when(plain, i).otherwise(F.size(F.filter(F.slice(items, F.lit(1), i), lambda x: x["dict"]))))
    return before


def _edge_texts(items: Column, numbers: Column, first: Column) -> Column:
    def one(e: Column, n: Column) -> Column:
        kept = F.transform(F.filter(e["names"], lambda k: k != "edge_id"), lambda k: F.concat(_json(k), F.lit(":"), F.element_at(e["fields"], k)))
        own = F.concat(F.lit('"edge_id":"qe'), (n + first).cast("string"), F.lit('"'))
        return F.when(e["dict"], F.concat(F.lit("{"), F.array_join(F.concat(kept, F.array(own)), ","), F.lit("}"))).otherwise(e["text"])

    return F.concat(F.lit("["), F.array_join(F.zip_with(items, numbers, one), ","), F.lit("]"))


def _edge_map(items: Column, numbers: Column, first: Column) -> Column:
    pairs = F.zip_with(items, numbers, lambda e, n: F.struct(F.concat(F.lit("qe"), (n + first).cast("string")).alias("key"), e["edge_id"].alias("value")))
    return F.coalesce(F.filter(pairs, lambda p: p["value"].isNotNull()), F.array().cast("array<struct<key:string,value:string>>"))


def _opened(rows: DataFrame) -> DataFrame:
    """Members of the objects and arrays in ``rows`` (id, path, text), without forbidden names and nulls."""
    parsed = rows.select("id", F.col("path").alias("parent"), F.parse_json("text").alias("v"))
    spark = rows.sparkSession
    found = spark.sql("SELECT id, parent, x.pos, x.key, x.value FROM {rows}, LATERAL variant_explode(v) AS x", rows=parsed)
    kept = found.where(F.col("key").isNull() | ~forbidden(F.coalesce("key", F.lit("")))).withColumn("kind", _kind(F.col("value"))).where("kind <> 'n'")
    return kept.select("id", "parent", F.concat_ws("/", "parent", F.col("pos").cast("string")).alias("path"), "pos", "key", "kind", F.to_json("value").alias("text"))


def clean_metadata(rows: DataFrame) -> DataFrame:
    """(id, text): ``rows`` (id, text) of JSON values without forbidden names and nulls at any depth."""
    kind = _kind(F.parse_json("text"))
    top = rows.select("id", F.lit(None).cast("string").alias("parent"), F.lit("").alias("path"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), kind.alias("kind"), "text")
    levels = [stored(top, "metadata-level")]
    while len(levels) <= DEEPEST:
        below = stored(_opened(levels[-1].where("kind in ('o', 'a')")), "metadata-level")
        if below.isEmpty():
            break
        levels.append(below)
    else:
        raise ValueError(f"metadata of more than {DEEPEST} levels")
    empty = F.when(F.col("kind") == "o", "{}").when(F.col("kind") == "a", "[]").otherwise(F.col("text"))
    done = levels[-1].withColumn("text", empty)
    for level in reversed(levels[:-1]):
        piece = F.concat(F.coalesce(F.concat(_json(F.col("key")), F.lit(":")), F.lit("")), F.col("text"))
        parts = done.select("id", F.col("parent").alias("path"), "pos", piece.alias("piece")).groupBy("id", "path")
        inner = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), ",").alias("inner"))
        inside = F.coalesce("inner", F.lit(""))
        text = F.when(F.col("kind") == "o", F.concat(F.lit("{"), inside, F.lit("}"))).when(F.col("kind") == "a", F.concat(F.lit("["), inside, F.lit("]"))).otherwise(F.col("text"))
        done = level.join(inner, ["id", "path"], "left").withColumn("text", text).drop("inner")
    return done.select("id", "text")


def method_view(queries: DataFrame) -> DataFrame:
    """(id, view, edge_map) of ``queries`` (id, query), a JSON record each under an id of its own.

    ``view`` is the record that methods may see: fields in the order of ALLOWED, names inside in order, edges numbered
    qe0, qe1, ... over ``edges`` and then ``visible_edges``; items that are no objects keep their text and take no number.
    ``edge_map`` leads from these to the true ids (as text; missing and null ids have none) and is for evaluation only.
    Metadata without anything left is left out. What is no JSON object has neither. Repeated ids are an error of the
    caller; an empty table gives none.
    """
    rows = queries.select("id", F.try_parse_json("query").alias("v"))
    rows = rows.where("v is not null").where(_kind(F.col("v")) == "o")
    for f in ("edges", "visible_edges", "description", "metadata"):
        rows = rows.withColumn(f"{f}_kind", F.when(_get(f).isNotNull(), _kind(_get(f))))
    meta = clean_metadata(rows.where("metadata_kind is not null").select("id", F.to_json(_get("metadata")).alias("text")))
    meta = meta.where("text not in ('{}', '[]', 'null')").withColumnRenamed("text", "meta")
    rows = rows.withColumn("e", _edge_items("edges")).withColumn("x", _edge_items("visible_edges"))
    rows = rows.withColumn("en", _numbers(F.col("e"))).withColumn("xn", _numbers(F.col("x")))
    offset = F.coalesce(F.size(F.filter("e", lambda i: i["dict"])), F.lit(0))
    offset = F.when(F.col("e").isNull(), 0).otherwise(offset)
    said = _get("description", "string")
    for old, new in REWORDED.items():
        said = F.replace(F.replace(said, F.lit(old), F.lit(new)), F.lit(old.upper()), F.lit(new))
    texts = {f: F.to_json(_get(f)) for f in ALLOWED}
    texts["edges"] = F.when(F.col("edges_kind") == "a", _edge_texts(F.col("e"), F.col("en"), F.lit(0))).otherwise(texts["edges"])
    texts["visible_edges"] = F.when(F.col("visible_edges_kind") == "a", _edge_texts(F.col("x"), F.col("xn"), offset)).otherwise(texts["visible_edges"])
    texts["description"] = F.when(F.schema_of_variant(_get("description")) == "STRING", _json(said)).otherwise(texts["description"])
    texts["metadata"] = F.col("meta")
    rows = rows.join(meta.withColumnRenamed("id", "mid"), F.col("id") == F.col("mid"), "left")
    fields = [F.concat(F.lit(f'"{f}":'), t) for f, t in texts.items()]
    edge_map = F.map_from_entries(F.concat(_edge_map(F.col("e"), F.col("en"), F.lit(0)), _edge_map(F.col("x"), F.col("xn"), offset)))
    views = rows.select("id", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("view"), edge_map.alias("edge_map"))
    return queries.select("id").join(views, "id", "left")


# --- the driver's tables: every triangle as a full query record


def motif_records(truth: DataFrame, tagged: DataFrame) -> DataFrame:
    """(id, query): full JSON records of the motifs, with what evaluation knows beside what methods may see."""
    long = truth.select("gt_pos", "motif_type", F.split("nodes", ",").alias("nodes"), F.explode(F.split("edges", ",")).alias("edge_id"))
    edges = long.join(tagged.select("edge_id", "src", "dst", "is_inter", "weight"), "edge_id").groupBy("gt_pos", "motif_type", "nodes").agg(
        F.array_sort(F.collect_list(F.struct("edge_id", "src", "dst", F.col("is_inter").alias("hidden")))).alias("edges"), F.sort_array(F.collect_set(F.when(F.col("is_inter"), F.col("edge_id")))).alias("hidden_edges"), F.max("weight").alias("top")
    )
    meta = F.struct(
        F.lit(1).alias("true_x"), F.size("edges").alias("ok"), F.struct(F.lit("x").alias("answer_key"), F.array(F.struct(F.element_at("nodes", 1).alias("first"), F.lit(7).alias("is_true_node"))).alias("list"), F.struct(F.lit(1).alias("Hidden")).alias("left")).alias("deep")
    )
    record = F.struct(
        F.concat(F.lit("q"), F.col("gt_pos").cast("string")).alias("query_id"), "motif_type", "nodes", "edges", F.slice("nodes", 1, 1).alias("anchor_nodes"), "hidden_edges", F.col("nodes").alias("true_nodes"),
        F.concat(F.lit("Find HIDDEN_EDGES and the ground truth of "), F.size("hidden_edges").cast("string"), F.lit(" motif_instance_id")).alias("description"), meta.alias("metadata"),
    )
    return edges.select(F.col("gt_pos").alias("id"), F.to_json(record).alias("query"))


def map_text(views: DataFrame) -> DataFrame:
    """The views with the map as text, edges in order of their numbers."""
    ordered = F.array_sort(F.transform(F.map_entries("edge_map"), lambda p: F.struct(F.substring(p["key"], 3, 9).cast("int").alias("n"), F.concat(p["key"], F.lit("="), p["value"]).alias("t"))))
    return views.select("id", "view", F.array_join(F.transform(ordered, lambda x: x["t"]), ",").alias("edge_map"))


VIEW_SQL = """
    , p AS (SELECT gt_pos, motif_type, string_split(nodes, ',') AS n, list_sort(string_split(edges, ',')) AS l FROM ground_truth),
    e AS (SELECT gt_pos, unnest(l) AS edge_id, generate_subscripts(l, 1) - 1 AS i FROM p),
    t AS (SELECT e.gt_pos, array_to_string(list('{"dst":"' || f.dst || '","src":"' || f.src || '","edge_id":"qe' || i || '"}' ORDER BY i), ',') AS edges, array_to_string(list('qe' || i || '=' || e.edge_id ORDER BY i), ',') AS edge_map,
        count(*) AS m, count(*) FILTER (a.party <> b.party) AS hidden FROM e JOIN flow f USING (edge_id) JOIN node_party a ON a.node = f.src JOIN node_party b ON b.node = f.dst GROUP BY e.gt_pos)
    SELECT gt_pos AS id, '{"query_id":"q' || gt_pos || '","motif_type":"' || motif_type || '","nodes":["' || array_to_string(n, '","') || '"],"edges":[' || edges || '],"anchor_nodes":["' || n[1]
        || '"],"description":"Find withheld edges and the evaluation reference of ' || hidden || ' query id","metadata":{"deep":{"left":{},"list":[{"first":"' || n[1] || '"}]},"ok":' || m || '}}' AS view, edge_map
    FROM p JOIN t USING (gt_pos)"""
