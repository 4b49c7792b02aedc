"""Exact deduplication by content-defined chunk recipes (built-in functions only).

Every normalised text is cut into chunks at content-defined places, each chunk gets a
128-bit digest in the scan, and a document's *recipe* is the ordered list of its chunk
identifiers. Chunk bodies move once, through a map-side combined distinct, to verify that
no digest stands for two bodies; after that only recipes (about 3 % of the text) are
compared. A digest that does stand for several bodies is given a variant number per body
and the recipes that use it are rewritten, so equality never rests on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossmotif.runtime import only_rows, pick, stored

MIN_CHUNK, MAX_CHUNK = 128, 2048


# First and last code points of scripts beyond Latin-1 that are dealt to the classes in equal stretches.
SCRIPTS = ((0x400, 0x4FF), (0x600, 0x6FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _letters(k: int, share: int = 4) -> str:
    """Character class k of ``share``: Latin-1 code points by a multiplicative hash, other scripts by stretches."""
    chosen = [f"\\u{c:04x}" for c in range(0x30, 0x100) if (c * 2654435761 >> 11) % share == k]
    for low, high in SCRIPTS:
        size = (high - low + 1) // share
        chosen.append(f"\\u{low + k * size:04x}-\\u{low + (k + 1) * size - 1:04x}")
    return "[" + "".join(chosen) + "]"


def chunk_pattern() -> str:
    """A chunk ends after four characters of fixed classes (chance about 1 in 256), never before MIN_CHUNK
    characters and at MAX_CHUNK at the latest. The decision looks at four characters only, so an edit moves
    the cuts beside it and no others."""
    cut = "".join(_letters(k) for k in (0, 2, 1, 3))
    return f"(?s).{{{MIN_CHUNK - 4},{MAX_CHUNK - 4}}}?{cut}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their digest recipes, chunks with bodies)."""
    base = pick(docs, id=id_col, text=text_col).select(
        "id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        normalised(F.col("text")).alias("norm"),
    )
    chunked = base.withColumn("chunks", F.regexp_extract_all("norm", F.lit(chunk_pattern()), F.lit(0)))
    digest = lambda c: F.struct(F.xxhash64(c).alias("h"), F.xxhash64(F.lit(7), c).alias("g"))
    listed = chunked.select(
        "id", "points", F.sha2("norm", 256).alias("sha"), F.transform("chunks", digest).alias("recipe")
    )
    bodies = chunked.select(F.explode("chunks").alias("body")).select(
        F.xxhash64("body").alias("h"), F.xxhash64(F.lit(7), "body").alias("g"), "body"
    )
    return listed, bodies


def verified_variants(bodies: DataFrame) -> DataFrame:
    """(h, g, body, variant) for digests shared by several bodies: empty unless 128 bits collide."""
    distinct = bodies.distinct()
    shared = distinct.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    order = Window.partitionBy("h", "g").orderBy("body")
    return distinct.join(shared, ["h", "g"]).withColumn("variant", F.row_number().over(order))


def _with_variants(docs: DataFrame, variants: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Recipes in which every identifier carries the variant of its body."""
    base = pick(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    base = stored(base, "exact-rows")
    chunks = base.select(
        "row", F.posexplode(F.regexp_extract_all(normalised(F.col("text")), F.lit(chunk_pattern()), F.lit(0)))
    )
    chunks = chunks.select("row", "pos", F.xxhash64("col").alias("h"), F.xxhash64(F.lit(7), "col").alias("g"), F.col("col").alias("body"))
    named = chunks.join(variants, ["h", "g", "body"], "left").select(
        "row", "pos", "h", "g", F.coalesce("variant", F.lit(0)).alias("variant")
    )
    lists = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "g", "variant"))).alias("recipe"))
    plain = base.select(
        "row", "id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        F.sha2(normalised(F.col("text")), 256).alias("sha"),
    )
    empty = F.array().cast(lists.schema["recipe"].dataType)
    return plain.join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", empty)).drop("row")


def _verified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with recipes that are equal only for equal texts."""
    listed, bodies = recipes(docs, id_col, text_col)
    variants = stored(verified_variants(bodies), "exact-variants")
    if not variants.isEmpty():
        listed = _with_variants(docs, variants, id_col, text_col)
    return stored(listed, "exact-recipes")


def _first() -> Column:
    """First row of a group: most code points (a count, so its negative exists), then the least id, null ones last."""
    return F.min(F.struct((-F.col("points")).alias("fewest"), F.col("id").isNull().alias("late"), F.col("id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deletion of space and U+0009-U+000D; null counts as empty, and
    all empty texts are one group. The row with the most code points stays, then the smallest doc_id (a
    null doc_id comes last). Ids are of any type that has an order. Rows repeated under one doc_id share its
    decision. An empty table gives none.
    """
    listed = _verified(docs, id_col, text_col)
    best = listed.groupBy("recipe").agg(_first().alias("top"), F.count("*").alias("group_size"))
    best = best.select("recipe", F.col("top.id").alias("keep_id"), "group_size")
    return listed.join(best, "recipe").select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long"),
        F.expr("id <=> keep_id").alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of equal texts one row, with all its columns: most code points, then smallest id, then least row.

    A row is known by id, length and digest of its text, never by the id alone: null and repeated ids with other
    texts are rows of their own. Other columns may be of any type; maps are compared as JSON.
    """
    best = _verified(docs, id_col, text_col).groupBy("recipe").agg(_first().alias("top"), F.min("sha").alias("sha"))
    stays = best.select(F.col("top.id").alias("_id"), (-F.col("top.fewest")).alias("_points"), F.col("sha").alias("_sha"))
    text = F.col(f"c{docs.columns.index(text_col)}")
    return only_rows(docs, id_col, stays, {"_points": F.length(F.coalesce(text, F.lit(""))).cast("long"), "_sha": F.sha2(normalised(text), 256)})
