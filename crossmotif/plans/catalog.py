"""The registered queries of the library and the reference SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossmotif.functions.dialect import DUCK, SPARK
from crossmotif.operators import baselines, custom, directed, evaluate, evidence, experiments, graph, motifs, prepare, ranking, samplers, strategies
from crossmotif.plans import event_queries, oracles
from crossmotif.plans.relational import BUILDERS, PASSING, Definition, as_doubles, base_relations, common_tables, names_in, reference, run
from crossmotif.runtime import stored
from crossmotif.sources.graph_tables import DUCK_RELATIONS

Query = Callable[[SparkSession, str], DataFrame]

#: Relations that are themselves definitions: stored for the session once computed.
DERIVED: dict[str, Definition] = {
    "tagged": evidence.tagged,
    "views": evidence.local_edges,
    "assembly_edges": evidence.assembly_edges,
    "cycles": evidence.cycle_pairs,
    "reranked": evidence.rerank_evidence,
    "directed_pool": directed.directed_pool,
    "labelled": prepare.label_merge,
    "mutual": evidence.mutual,
    "evidence": evidence.evidence_features,
    "top_rows": evidence.top_rows,
    "top_evidence": evidence.top_evidence,
    "candidates": motifs.all_candidates,
    "scored": ranking.scored,
    "ground_truth": evaluate.ground_truth,
    "predictions": evaluate.predictions,
    "matched": evaluate.matched,
}
_kept: dict[tuple, DataFrame] = {}


def relations(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    found = base_relations(spark, sf_dir, names)
    for name in names:
        if name in DERIVED or name in BUILDERS or name in custom.BUILT:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _kept:
                if name in custom.BUILT:
                    rows = custom.BUILT[name](spark, sf_dir)
                elif name in BUILDERS:
                    needs, build = BUILDERS[name]
                    rows = build(relations(spark, sf_dir, needs))
                else:
                    rows = run(spark, DERIVED[name], relations(spark, sf_dir, names_in(DERIVED[name](SPARK))))
                _kept[key] = rows if name in PASSING else stored(rows, f"relation-{name}")
            found[name] = _kept[key]
    return found


def _query(definition: Definition) -> Query:
    """A query that is itself a stored relation reads that; others run over the relations that they name."""
    for name, derived in DERIVED.items():
        if derived is definition:
            return lambda spark, sf_dir: relations(spark, sf_dir, [name])[name]
    return lambda spark, sf_dir: run(spark, definition, relations(spark, sf_dir, names_in(definition(SPARK))))


def definitions() -> dict[str, Definition]:
    found: dict[str, Definition] = {}
    for module in (graph, motifs, evidence, ranking, evaluate, baselines, prepare, experiments, samplers):
        found |= module.DEFINITIONS
    return found


def queries() -> dict[str, Query]:
    return {name: _query(d) for name, d in definitions().items()} | event_queries.QUERIES | custom.QUERIES


def oracle_sql() -> dict[str, str]:
    extra = {name: as_doubles(d(DUCK)) for name, d in DERIVED.items()}
    # Chains are put together edge by edge, which SQL does not express; where no pair's best hypothesis is CHAIN there are none.
    extra["chains"] = "SELECT candidate_type, nodes, tx_ids, num_nodes, num_edges, score_mean, score_min FROM {cycles} WHERE 1 = 0"
    extra["cores"] = samplers.CORES_SQL
    found = {name: reference(d, extra) for name, d in definitions().items()} | event_queries.ORACLES
    found["core_numbers"] = common_tables(["cores"], extra) + "SELECT node, core FROM cores"
    orders = {"order_raw": ranking.topk_per_query, "order_base": ranking.rerank, "order_diverse": ranking.diverse_order, "order_hybrid": ranking.hybrid_order}
    ordered = extra | {name: as_doubles(d(DUCK)) for name, d in orders.items()}
    found["strategy_table"] = common_tables([*orders, "ground_truth"], ordered) + strategies.STRATEGIES_SQL.lstrip()
    found["components"] = custom.components_sql(DUCK_RELATIONS["flow"])
    found["directed_kernels"] = common_tables(["candidates", "flow"], extra, recursive=True) + ", " + directed.KERNELS_SQL
    return found | oracles.own(extra)
