"""Degrees and reach of accounts in the graph that their own party sees, for the accounts that are asked for.

A party sees the rows that touch it, accounts of others under masks that keep them apart. So the masks need not be
written: an account is its party and name, numbered once, and a row is seen by the parties of its two ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossmotif.operators.closing import _count
from crossmotif.runtime import stored


def account_ids(tagged: DataFrame) -> DataFrame:
    """(bank, node, id) of all ends; of a row that does not cross, both ends are the sender's party's."""
    seen = tagged.where("src_party is not null")
    ends = seen.selectExpr("src_party as bank", "src as node").union(seen.selectExpr("if(is_inter, dst_party, src_party)", "dst")).distinct()
    return stored(ends.withColumn("id", F.monotonically_increasing_id()), "account-ids")


def account_links(tagged: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, pa, b, pb, k): ordered pairs of accounts by number with their parties, and how many rows they have."""
    rows = tagged.where("src_party is not null").selectExpr("src_party as pa", "src", "if(is_inter, dst_party, src_party) as pb", "dst")
    rows = rows.join(ids.toDF("pa", "src", "a"), ["pa", "src"]).join(ids.toDF("pb", "dst", "b"), ["pb", "dst"])
    return stored(rows.groupBy("a", "pa", "b", "pb").agg(F.count("*").alias("k")), "account-links")


def local_reach(links: DataFrame, ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bank, node, out_deg, in_deg, out_1, out_2, in_1, in_2) of the accounts ``wanted`` (bank, node).

    Lists go to the neighbours that ask for them, cut by the party of their items: a neighbour of the list's own party
    sees all of it, others the items of their own party.
    """
    mine = stored(ids.join(wanted.distinct(), ["bank", "node"]).withColumnRenamed("id", "key"), "wanted")
    found = mine
    for side, (a, pa, b, pb) in {"out": ("a", "pa", "b", "pb"), "in": ("b", "pb", "a", "pa")}.items():
        own = links.selectExpr(f"{a} as key", f"{pa} as bank", f"{b} as mid", "k").join(mine.select("key"), "key", "left_semi")
        lists = links.selectExpr(f"{a} as mid", f"{pa} as theirs", f"{b} as item", f"{pb} as other").repartition("mid")
        lists = lists.groupBy("mid", "theirs", "other").agg(F.collect_list("item").alias("items"))
        far = own.join(lists, "mid").where("theirs = bank or other = bank").select("key", "items")
        rows = own.select("key", F.array("mid").alias("items")).unionByName(far)
        two = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_count, "key long, n long").withColumnRenamed("n", f"{side}_2")
        one = own.groupBy("key").agg(F.sum("k").alias(f"{side}_deg"), F.count("*").alias(f"{side}_1"))
        found = found.join(one, "key", "left").join(two, "key", "left")
    names = ["out_deg", "in_deg", "out_1", "out_2", "in_1", "in_2"]
    return found.select("bank", "node", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def crossing_nodes(tagged: DataFrame) -> DataFrame:
    """(bank, node) of the local ends of crossing rows."""
    rows = tagged.where("is_inter")
    return rows.selectExpr("src_party as bank", "src as node").union(rows.selectExpr("dst_party", "dst"))
