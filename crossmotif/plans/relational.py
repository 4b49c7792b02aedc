"""Operators as relational definitions: one text over named relations, run as a Spark plan.

A definition is a function of a dialect that returns a SELECT over relation names in braces.
``run`` binds the names to DataFrames, so Catalyst sees one logical plan; ``reference`` renders
the same relations as common table expressions for another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossmotif.functions.dialect import DUCK, SPARK, SparkDialect
from crossmotif.operators import closing, gathered, local_views, samplers, vectors
from crossmotif.runtime import stored, table, with_place
from crossmotif.sources.graph_tables import DUCK_NEEDS, DUCK_RELATIONS, GraphTables, bought_together

Definition = Callable[[SparkDialect], str]


def as_doubles(text: str) -> str:
    """Decimal literals with an exponent, which engines agree to read as doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", text)


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


#: Relations that Spark builds by an operator where the reference spells a plain join: what they read and how they are built.
BUILDERS: dict[str, tuple[list[str], Callable[[dict[str, DataFrame]], DataFrame]]] = {
    "squares": (["nbr_any", "links"], lambda r: closing.closed_walks(r["nbr_any"], r["links"].selectExpr("node as anchor", "nbr as other"))),
    "rings": (["nbr_out", "pair_dir"], lambda r: closing.closed_walks(r["nbr_out"], r["pair_dir"].selectExpr("dst as anchor", "src as other"))),
    **{f"first_{way}": ([f"nbr_{way}"], lambda r, way=way: closing.first_neighbours(r[f"nbr_{way}"])) for way in ("any", "out", "in")},
    "two_hop": (["links"], lambda r: closing.two_step_counts(r["links"].selectExpr("node as src", "nbr as dst"), "two_hop", False)),
    "account_ids": (["tagged"], lambda r: local_views.account_ids(r["tagged"])),
    "account_links": (["tagged", "account_ids"], lambda r: local_views.account_links(r["tagged"], r["account_ids"])),
    "reach_local": (["tagged", "account_ids", "account_links"], lambda r: local_views.local_reach(r["account_links"], r["account_ids"], local_views.crossing_nodes(r["tagged"]))),
    "reach_top": (["top_rows", "account_ids", "account_links"], lambda r: local_views.local_reach(r["account_links"], r["account_ids"], r["top_rows"].select("bank", "node"))),
    "node_ids": (["links"], lambda r: stored(gathered.node_ids(r["links"]), "node-ids")),
    "link_ids": (["links", "node_ids"], lambda r: gathered.link_ids(r["links"], r["node_ids"])),
    "enclosed": (["link_ids", "node_ids"], lambda r: gathered.enclosed(r["link_ids"], r["node_ids"])),
    "label_pairs": (["embeddings"], lambda r: vectors.label_pairs(r["embeddings"])),
    "bought_together": (["lineitem"], lambda r: bought_together(r["lineitem"])),
    "list_links": (["nbr_any", "link_ids", "node_ids"], lambda r: gathered.list_links(r["nbr_any"], r["link_ids"], r["node_ids"])),
    "triangles": (["link_ids", "node_ids", "pair_und"], lambda r: gathered.triangles(r["link_ids"], r["node_ids"], r["pair_und"])),
    "corners": (["triangles", "links"], lambda r: gathered.corners(r["triangles"], r["links"])),
    "instances": (["links", "cores", "pair_und", "node_party", "triangles"], lambda r: samplers.instances(r["links"], r["cores"], r["pair_und"], r["node_party"], r["triangles"])),
}

#: Those that one query reads once: not stored. The two of accounts store themselves.
PASSING = {"bought_together", "label_pairs", "enclosed", "triangles", "instances", "account_ids", "account_links"}


RANK = re.compile("\u27e6([^\u27e6\u27e7\u00a6]*)\u00a6([^\u27e6\u27e7\u00a6]*)\u00a6([^\u27e6\u27e7]*)\u27e7")  # a ranked query that holds no other


def run(spark: SparkSession, definition: Definition, relations: dict[str, DataFrame]) -> DataFrame:
    text, bound, placed = as_doubles(definition(SPARK)), dict(relations), {}

    def bind(names: list[str]) -> None:
        for n in names:
            if n not in bound:
                bind(BUILDERS[n][0])
                bound[n] = BUILDERS[n][1](bound)

    def ask(t: str) -> DataFrame:
        bind(names_in(t))
        return spark.sql(t, **{n: bound[n] for n in names_in(t)})

    while found := RANK.search(text):
        whole, (alias, order, rows) = found.group(0), found.groups()
        if whole not in placed:
            placed[whole] = f"placed_{len(placed)}"
            bound[placed[whole]] = with_place(ask(rows), order, alias, again=True)
        text = text.replace(whole, f"SELECT * FROM {{{placed[whole]}}}")
    return ask(text)


def common_tables(names: list[str], extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """WITH clause of the named relations and all they need, over the driver's base tables; empty if they need none."""
    known = DUCK_RELATIONS | (extra or {})
    order: list[str] = []

    def add(name: str) -> None:
        if name in order or name not in known:
            return
        needs = DUCK_NEEDS.get(name) or names_in(known[name])
        for n in needs:
            add(n)
        order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({plain(known[n])})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} " if order else ""


def plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def reference(definition: Definition, extra: dict[str, str] | None = None) -> str:
    """Self-contained SQL of the definition over the driver's base tables."""
    text = as_doubles(definition(DUCK))
    return common_tables(names_in(text), extra) + f"SELECT * FROM ({plain(text)})"


BASE_TABLES = ("orders", "customer", "lineitem", "events", "embeddings", "supplier", "part", "nation", "region")
#: Graph relations that several operators read several times: written once per session and input, in this order.
STORED = ("flow", "edge_set", "nbr_out", "nbr_in", "nbr_any", "pair_dir", "pair_und")
_graphs: dict[tuple[str, str], GraphTables] = {}


def base_relations(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The driver's tables and graph relations among ``names``.

    The relations in ``STORED`` become tables in the shared folder when they are first asked for, so later
    plans start from a scan instead of carrying, and optimising, the whole derivation once per use.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        tables = GraphTables.from_flow(spark, sf_dir)
        tables.edges = stored(tables.edges, "graph-flow")
        _graphs[key] = tables
    tables = _graphs[key]
    found = {}
    for name in names:
        if name in BASE_TABLES:
            found[name] = table(spark, sf_dir, name)
        elif name in DUCK_RELATIONS:
            for needed in [n for n in STORED[1:] if n in _closure(name)]:
                if needed not in tables.stored_names:
                    tables.__dict__[needed] = stored(getattr(tables, needed), f"graph-{needed}")
                    tables.stored_names.add(needed)
            found[name] = tables.relation(name)
    return found


def _closure(name: str) -> set[str]:
    """A relation and all that it is derived from."""
    return {name}.union(*[_closure(n) for n in DUCK_NEEDS.get(name, [])])
