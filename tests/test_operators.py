"""Golden micro-graphs and properties of the relational operators."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crossmotif.operators import baselines, evaluate, evidence, experiments, graph, motifs, prepare, ranking
from crossmotif.operators.components import connected_components
from crossmotif.plans.relational import as_doubles, run
from crossmotif.sources.graph_tables import GraphTables


def tables(spark, edges, parties=()):
    rows = [(f"e{i}", a, b, float(w), i) for i, (a, b, w) in enumerate(edges)]
    e = spark.createDataFrame(rows, "edge_id string, src string, dst string, weight double, ord long")
    p = spark.createDataFrame(list(parties) or [("", "")], "node string, party string")
    return GraphTables(e, p).relations()


def ask(spark, definition, relations):
    return [r.asDict() for r in run(spark, definition, relations).collect()]


def test_components_of_chain_cycle_and_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (500, 500), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 500: 500}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_common_neighbours_and_adamic_adar(spark):
    rel = tables(spark, [("a", "c", 1), ("b", "c", 1), ("a", "d", 1), ("b", "d", 1), ("d", "e", 1), ("a", "b", 1)])
    cn = {(r["a"], r["b"]): r["cn"] for r in ask(spark, graph.common_neighbors, rel)}
    aa = {(r["a"], r["b"]): r["aa"] for r in ask(spark, graph.adamic_adar, rel)}
    assert cn[("a", "b")] == 2
    assert aa[("a", "b")] == pytest.approx(1 / math.log(2) + 1 / math.log(3), abs=1e-6)


def test_triangle_takes_the_first_closing_neighbour(spark):
    rel = tables(spark, [("a", "b", 1), ("a", "c", 1), ("a", "d", 1), ("b", "c", 1), ("b", "d", 1)])
    found = {r["nodes"] for r in ask(spark, motifs.triangle, rel) if r["anchor"] == "a"}
    assert found == {"a,b,c"}


def test_cycle_prefers_the_two_cycle(spark):
    rel = tables(spark, [("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "a", 1), ("a", "x", 1), ("x", "y", 1), ("y", "a", 1)])
    assert {r["nodes"] for r in ask(spark, motifs.cycle, rel) if r["anchor"] == "a"} == {"a,b", "a,x,y"}


def test_query_edges_of_the_sanitised_view_never_resolve(spark):
    rel = tables(spark, [("a", "b", 1), ("b", "c", 1)])
    assert ask(spark, lambda d: motifs.query_edge_evidence(d, allow=True), rel) == []


def test_parallel_edges_keep_the_first_pair_edge(spark):
    rel = tables(spark, [("a", "b", 1), ("a", "b", 2), ("b", "a", 3)])
    assert [r.edge_id for r in rel["pair_dir"].where("src = 'a'").collect()] == ["e0"]
    assert [r.edge_id for r in rel["pair_und"].collect()] == ["e0"]


@pytest.mark.parametrize(
    ("kind", "n", "m", "mean", "low", "score"),
    [("FAN_IN", 5, 4, 0.80, 0.75, 0.97), ("CHAIN", 4, 3, 0.80, 0.80, 0.98), ("CYCLE", 3, 3, 0.90, 0.80, 1.51)],
)
def test_rerank_score(spark, kind, n, m, mean, low, score):
    text = as_doubles(evidence.rerank_score())
    row = spark.sql(f"SELECT {text} AS s FROM (SELECT '{kind}' AS candidate_type, {n} AS num_nodes, {m} AS num_edges, double({mean}) AS score_mean, double({low}) AS score_min)").first()
    assert row.s == pytest.approx(score)


def evaluation(spark):
    gt = spark.createDataFrame([(1, "a,b,c", "e1,e2", "t", 3, 2), (2, "c,d,e", "e3,e4", "t", 3, 2)], "gt_pos long, nodes string, edges string, motif_type string, gn long, ge long")
    preds = spark.createDataFrame(
        [("0", 1, "q", "t", "a,b", "e1", 0.9, 2, 1), ("1", 2, "q", "t", "c", "", 0.8, 1, 0), ("2", 3, "q", "t", "x,y", "e9", 0.7, 2, 1)],
        "pid string, place long, query_id string, candidate_type string, nodes string, edges string, score double, pn long, pe long",
    )
    rel = {"ground_truth": gt, "predictions": preds}
    return rel | {"matched": run(spark, evaluate.matched, rel)}


def test_evaluator(spark):
    rel = evaluation(spark)
    best = {r["pid"]: (r["gt_pos"], r["combined"], r["structure"]) for r in ask(spark, evaluate.best_match, rel)}
    assert best == {"0": (1, 0.6, 0.5), "1": (2, 0.2, 0.0), "2": (None, 0.0, 0.0)}  # the last motif wins the tie
    prf = {r["level"]: (r["tp"], r["fp"], r["fn"], r["f1"]) for r in ask(spark, evaluate.prf, rel)}
    assert prf["node"] == (3, 2, 3, pytest.approx(0.545455)) and prf["edge"] == (1, 1, 3, pytest.approx(0.333333))
    rates = ask(spark, evaluate.match_rates, rel)[0]
    assert (rates["exact_rate"], rates["mean_jaccard"], rates["motif_recall"]) == (0.0, pytest.approx(0.266667), 1.0)
    assert ask(spark, evaluate.mrr, rel)[0]["mrr"] == 1.0
    assert ask(spark, evaluate.auc, rel)[0]["auc"] == 1.0
    assert ask(spark, evaluate.avg_precision, rel)[0]["avg_precision"] == 1.0
    strict = {r["rule"]: r["hits"] for r in ask(spark, evaluate.strict_overlap, rel)}
    assert strict == {"any": 2, "or_10": 2, "or_25": 2, "or_50": 1, "and_25": 1}


def test_diverse_and_coverage_orders(spark):
    rows = [(f"q{i}", t, f"n{i}", f"e{i}", 1.0 - i / 10, 1.0 - i / 10, 1, 1) for i, t in enumerate("AABAC")]
    scored = spark.createDataFrame(rows, "anchor string, candidate_type string, nodes string, edges string, raw_score double, score double, n int, m int")
    order = sorted(ask(spark, ranking.diverse_order, {"scored": scored}), key=lambda r: r["place"])
    assert [r["nodes"] for r in order] == ["n0", "n2", "n4", "n1", "n3"]
    hybrid = sorted(ask(spark, lambda d: ranking.hybrid_order(d, 2), {"scored": scored}), key=lambda r: r["place"])
    assert [r["nodes"] for r in hybrid] == ["n0", "n1", "n2", "n3", "n4"]


def test_query_coverage_order(spark):
    rows = [(q, "A", f"n{i}", f"e{i}", 1.0 - i / 10, 1.0 - i / 10, 1, 1) for i, q in enumerate(["q1", "q1", "q2", "q1", "q3"])]
    scored = spark.createDataFrame(rows, "anchor string, candidate_type string, nodes string, edges string, raw_score double, score double, n int, m int")
    order = sorted(ask(spark, lambda d: ranking.query_coverage(d, 1, 3), {"scored": scored}), key=lambda r: r["place"])
    assert [r["nodes"] for r in order] == ["n0", "n2", "n4", "n1", "n3"]


def test_every_definition_renders_for_both_engines():
    from crossmotif.functions.dialect import DUCK, SPARK

    for module in (baselines, evaluate, evidence, experiments, graph, motifs, prepare, ranking):
        for definition in module.DEFINITIONS.values():
            assert definition(SPARK) and definition(DUCK)


def test_components_take_light_edges(spark):
    from crossmotif.operators.chains import chain_candidates
    from crossmotif.operators.custom import chain_edges, component_table

    rel = tables(spark, [("a", "b", 1), ("b", "c", 500000), ("x", "y", 2)])
    got = {r.node: r.component for r in component_table(rel["flow"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    rows = [("t", f"n{i}", f"n{i + 1}", f"s{i}", f"r{i}", 0.9, "CHAIN") for i in range(9)] + [("t", "n3", "z", "s", "r", 1.0, "FAN")]
    pairs = spark.createDataFrame(rows, "tag string, src_node string, dst_node string, tx_s string, tx_r string, weight double, best string")
    found = chain_candidates(chain_edges(pairs)).collect()
    assert [(r.num_nodes, r.num_edges, r.score_min) for r in found] == [(10, 9, 0.9)]


def test_the_pool_holds_all_standard_candidates(spark):
    rel = tables(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1), ("a", "c", 1), ("c", "a", 1)], [(n, f"P{i}") for i, n in enumerate("abcd")])
    kinds = {r["candidate_type"] for r in ask(spark, motifs.all_candidates, rel)}
    assert {"chain", "multi_partition_bridge", "cycle4", "dense_subgraph", "directed_cycle"} <= kinds


def test_natural_order_and_vector_pairs_take_all_rows(spark):
    rel = tables(spark, [("a", "b", 1), ("1", "c", 1), ("d", "a", 1)])
    assert [(r["edge_id"], r["place"]) for r in sorted(ask(spark, graph.natural_order, rel), key=lambda r: r["place"])] == [("e0", 1), ("e1", 2), ("e2", 3)]
    vectors = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in (1, 2, 101, 301)], "vec_id long, label int, embedding array<double>")
    assert {(r["a"], r["b"]) for r in ask(spark, graph.vector_pairs, {"embeddings": vectors})} == {(1, 101), (1, 301), (101, 301)}


def test_alignment_takes_more_than_forty_nodes_of_a_party(spark):
    edges = [(f"a{i}", f"b{i}", 1) for i in range(45)]
    rel = tables(spark, edges, [(f"{p}{i}", p.upper()) for p in "ab" for i in range(45)])
    assert len({r["a"] for r in ask(spark, baselines.DEFINITIONS["align_hlot"], rel)}) == 45


def edge_sets(spark, sets):
    rows = [(str(i), "t", "n", f"e{i}", [(a, b) for a, b in sorted(e)]) for i, e in enumerate(sets)]
    return spark.createDataFrame(rows, "anchor string, candidate_type string, nodes string, edges string, pairs array<struct<src:string,dst:string>>")


def test_directed_shapes(spark):
    from crossmotif.operators.directed import shapes

    rng = random.Random(5)
    sets = [[("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("a", "c"), ("b", "c")], [("a", "b"), ("a", "c"), ("c", "b")], [("a", "a")], [("a", "c"), ("a", "b")]]
    sets += [[(rng.choice("abcdef"), rng.choice("abcdef")) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    got = {int(r.anchor): r for r in shapes(edge_sets(spark, sets)).collect()}
    for i, e in enumerate(sets):
        names = sorted({x for p in e for x in p})
        orders = [o for n in range(2, len(names) + 1) for o in itertools.permutations(names, n)]
        paths = [o for o in orders if all(p in e for p in zip(o, o[1:]))]
        cycle = any(len(o) >= 3 and (o[-1], o[0]) in e for o in paths)
        forks = [1.0 if (x, y) in e else 0.85 if (y, x) in e else 0.55 for s, x in e for t, y in e if s == t and x < y]
        degree = max(max(sum(p[k] == n for p in e) for n in names) for k in (0, 1))
        want = (max((len(o) - 1 for o in paths), default=0), cycle, any((b, a) in e for a, b in e), max(forks, default=0.0), min(1.0, degree / 4))
        r = got[i]
        assert (r.path_length, r.has_cycle, r.near_cycle, r.feed_forward, r.star_score) == want, e


def test_directed_cycles_up_to_eight(spark):
    from crossmotif.operators.directed import directed_cycles

    rng = random.Random(2)
    ring = "abcdefgh"
    edges = {(a, b) for a, b in zip(ring, ring[1:] + ring[0])} | {(rng.choice(ring), rng.choice(ring)) for _ in range(8)} | {("a", "z"), ("y", "b")}
    want = set()
    for n in range(2, 9):
        for o in itertools.permutations(sorted(ring), n):
            if o[0] == min(o) and all(p in edges for p in zip(o, o[1:] + o[:1])):
                want.add((">".join(o), n))
    assert ("a>b>c>d>e>f>g>h", 8) in want
    assert sorted(map(tuple, directed_cycles(spark.createDataFrame(sorted(edges), "src string, dst string")).collect())) == sorted(want)


def test_places_do_not_depend_on_how_they_are_found(spark, monkeypatch):
    from crossmotif import runtime

    rows = spark.createDataFrame([(i * 7919 % 1000 // 3, i) for i in range(1000)], "a int, b int")
    want = [tuple(r) for r in runtime.with_place(rows, "a DESC, b", "place").orderBy("place").collect()]
    assert [(a, b) for a, b, _ in want] == sorted(((a, b) for a, b, _ in want), key=lambda x: (-x[0], x[1])) and [p for *_, p in want] == list(range(1, 1001))
    monkeypatch.setattr(runtime, "SMALL_BYTES", -1)
    assert [tuple(r) for r in runtime.with_place(rows, "a DESC, b", "place").orderBy("place").collect()] == want
    assert runtime.with_place(rows.limit(0), "a", "place").count() == 0


def mutual_pairs(spark, rows):
    """Rows (best, src, dst, weight): accounts of bank A and B by turns of their letters."""
    made = [(f"t{i:03}", "A", "B", a, b, f"s{i:03}", f"r{i:03}", w, best) for i, (best, a, b, w) in enumerate(rows)]
    return spark.createDataFrame(made, "tag string, bank_s string, bank_r string, node_s string, node_r string, tx_s string, tx_r string, compat double, best string")


def test_evidence_assembly_follows_the_hypotheses(spark):
    from crossmotif.operators.chains import chain_candidates
    from crossmotif.operators.custom import chain_edges, chain_rows

    rows = [("FAN", x, "h", 0.8) for x in "xyz"] + [("FAN", "z", "h", 0.9), ("FAN", "h", "x", 0.9), ("CYCLE", "x", "h", 0.9), ("CHAIN", "p", "q", 0.8)]
    pairs = mutual_pairs(spark, rows).withColumns({"bank_s": F.lit("A"), "bank_r": F.lit("A")})
    rel = {"mutual": pairs}
    rel["assembly_edges"] = run(spark, evidence.assembly_edges, rel)
    fans = ask(spark, evidence.fan_pairs, rel)
    assert [(r["candidate_type"], r["nodes"], r["num_nodes"], r["num_edges"], r["tx_ids"]) for r in fans] == [
        ("FAN_IN", "A::h,A::x,A::y,A::z", 4, 3, "r000,r001,r003,s000,s001,s003")  # the later of repeated pairs counts
    ]
    assert fans[0]["score_mean"] == pytest.approx((0.8 + 0.8 + 0.9) / 3) and fans[0]["score_min"] == 0.8
    rel["cycles"] = run(spark, evidence.cycle_pairs, rel)
    topk = run(spark, evidence.mutual_topk, rel)
    rel["chains"] = chain_rows(chain_candidates(chain_edges(topk), shortest=2))
    rel["reranked"] = run(spark, evidence.rerank_evidence, rel)
    ranked = sorted(ask(spark, evidence.evidence_predictions, rel), key=lambda r: r["place"])
    assert [(r["candidate_type"], r["nodes"]) for r in ranked] == [("FAN_IN", "h,x,y,z"), ("CHAIN", "p,q")]
    assert ranked[0]["score"] > ranked[1]["score"] == pytest.approx(0.8 + 0.15 - 0.08)


def test_cycles_of_two_to_five_pairs(spark):
    rng = random.Random(5)
    edges = {(a, b): round(rng.uniform(0.72, 1), 3) for a, b in [(rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(26)] if a != b}
    pairs = mutual_pairs(spark, [("CYCLE", a, b, w) for (a, b), w in edges.items()]).withColumn("bank_r", F.lit("A"))
    rel = {"assembly_edges": run(spark, evidence.assembly_edges, {"mutual": pairs})}
    number = {e: i for i, e in enumerate(edges)}
    want = set()
    for n in range(2, 6):
        for o in itertools.permutations("abcdefg", n):
            steps = list(zip(o, o[1:] + o[:1]))
            if o[0] == min(o) and all(s in edges for s in steps):
                tx = sorted(f"{k}{number[s]:03}" for s in steps for k in "sr")
                want.add((",".join(f"A::{x}" for x in sorted(o)), ",".join(tx), n, round(sum(edges[s] for s in steps) / n, 9), min(edges[s] for s in steps)))
    got = {(r["nodes"], r["tx_ids"], r["num_nodes"], round(r["score_mean"], 9), r["score_min"]) for r in ask(spark, evidence.cycle_pairs, rel)}
    assert got == want and {n for _, _, n, _, _ in want} == {2, 3, 4, 5}


def scored_rows(spark, rng, n, queries):
    kinds = ["directed_chain", "feed_forward", "directed_cycle", "dense_hyperlink_block", "directed_star", "cycle4", "triangle", "fan_in"]
    rows = [(f"q{rng.randrange(queries):02}", rng.choice(kinds[:2] if i % 3 else kinds), f"n{i:04}", f"e{i:04}", round(rng.random(), 2), round(rng.random(), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "anchor string, candidate_type string, nodes string, edges string, raw_score double, score double")


def test_balanced_selection(spark):
    from crossmotif.operators.directed import DIRECTED, selected

    rows, df = scored_rows(spark, random.Random(1), 400, 9)
    got = {tuple(r)[:4] for r in selected(df, limit=12, most=2).collect()}
    want = set()
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], r[1] != "triangle", r[1], r[3]))
        take = [next(r for r in own if r[1] == t) for t in DIRECTED if any(r[1] == t for r in own)]
        if len(own) <= 12:
            take = own
        for r in own:
            if len(take) < 12 and r not in take and (r[1] in DIRECTED or sum(x[1] == r[1] for x in take) < 2):
                take.append(r)
        want |= {r[:4] for r in take}
    assert got == want


def test_coverage_aware_order(spark):
    """The order by a plain pass over all candidates, whatever the bounded pool holds."""
    from crossmotif.operators import directed

    rows, df = scored_rows(spark, random.Random(3), 1500, 40)
    prefix, cap = 60, 2
    got = [tuple(r)[:4] for r in sorted(directed.coverage_aware(df, prefix, cap).collect(), key=lambda r: r.place)]
    order = sorted(rows, key=lambda r: (-r[5], r[0], r[1], r[3]))
    front = directed.covering_prefix([(i, r[0], r[1]) for i, r in enumerate(order)], prefix, cap)
    assert got == [order[i][:4] for i in front] + [r[:4] for i, r in enumerate(order) if i not in front]
    assert len(front) == prefix and max(Counter(order[i][0] for i in front).values()) <= max(cap, prefix)


def test_covering_prefix_by_hand():
    from crossmotif.operators.directed import covering_prefix

    rows = [(0, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "z"), (5, "c", "y"), (6, "c", "x")]
    # Types take turns: y takes 2, x must pass over query a and takes 3, y takes 5; without the cap 0 and 4 fill the rest, x being full.
    assert covering_prefix(rows, prefix=5, per_query=1, most={"x": 2}, least={"y": 2, "x": 1}) == [2, 3, 5, 0, 4]
    assert covering_prefix(rows, prefix=3, per_query=1, most={}, least={}) == [0, 3, 5]
    assert covering_prefix([], 3, 1, {}, {"x": 1}) == []


def test_readers(spark, tmp_path):
    from crossmotif.sources import readers

    (tmp_path / "edges.txt").write_text("# head\n2 1\n1 2\n3 3\n1 3\n")
    assert {(r.src, r.dst) for r in readers.read_edge_list(spark, str(tmp_path / "edges.txt"), directed=False).collect()} == {("1", "2"), ("1", "3")}
    (tmp_path / "patterns.txt").write_text(
        "BEGIN LAUNDERING ATTEMPT - FAN-OUT: Max 3\n2022/09/01 00:06,1,A,2,B,1,USD,1,USD,ACH,1\nEND LAUNDERING ATTEMPT - FAN-OUT\n\n"
        "BEGIN LAUNDERING ATTEMPT - CYCLE\n2022/09/01 00:07,1,A,2,B,1,USD,1,USD,ACH,1\nEND LAUNDERING ATTEMPT - CYCLE\n"
    )
    rows = readers.read_patterns(spark, str(tmp_path / "patterns.txt")).orderBy("line").collect()
    assert [(r.motif_instance_id, r.motif_type) for r in rows] == [("MOTIF_0000001", "FAN-OUT"), ("MOTIF_0000002", "CYCLE")]
    (tmp_path / "tx.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:06,1,A,2,B,1,USD,1,USD,ACH,1\n")
    assert [r.tx_hash for r in readers.read_transactions(spark, str(tmp_path / "tx.csv")).collect()] == [rows[0].tx_hash]


def test_bitcoin_graph_reader(spark, tmp_path):
    from crossmotif.sources import readers

    (tmp_path / "f.csv").write_text("10,1,0.5,1\n11,1,0.1,2\n12,2,0.2,3\n")
    (tmp_path / "c.csv").write_text("txId,class\n10,1\n11,2\n12,unknown\n")
    (tmp_path / "e.csv").write_text("txId1,txId2\n10,11\n11,12\n12,99\n12,10\n")
    nodes, edges, parties = readers.read_bitcoin_graph(spark, *[f"{tmp_path}/{n}.csv" for n in "fce"])
    assert sorted((r.node, r.label, r.features) for r in nodes.collect()) == [("10", "illicit", [0.5, 1.0]), ("11", "licit", [0.1, 2.0]), ("12", "unknown", [0.2, 3.0])]
    assert sorted((r.edge_id, r.src, r.dst, r.ts, r.label) for r in edges.collect()) == [("e0", "10", "11", 1, "illicit_related"), ("e1", "11", "12", 1, "other"), ("e3", "12", "10", 2, "illicit_related")]
    assert {(r.node, r.party) for r in parties.collect()} == {("10", "T1"), ("11", "T1"), ("12", "T2")}


def test_reports_and_ground_truth(spark, tmp_path):
    from crossmotif.sources import readers

    rows = spark.createDataFrame([("a", 1.5, [1, 2]), (None, 2.0, [])], "name string, x double, l array<int>")
    readers.write_report(rows, f"{tmp_path}/csv")
    assert sorted(r.l for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()) == ["[1,2]", "[]"]
    readers.write_report(rows.orderBy("x"), f"{tmp_path}/md", "markdown")
    text = next((tmp_path / "md").glob("*.txt")).read_text().splitlines()
    assert text[:2] == ["| name | x | l |", "| --- | --- | --- |"] and text[2].startswith("| a | 1.5 |") and len(text) == 4
    assert readers.flat_metrics({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    one = '{"query_id": "q1", "true_nodes": ["a", "b"], "true_edges": ["e1"], "motif_instance_id": "m"}'
    (tmp_path / "lines.json").write_text(one + "\n" + one.replace("q1", "q2") + "\n")
    (tmp_path / "list.json").write_text("[" + one + ",\n" + one.replace("q1", "q2") + "]")
    for name in ("lines", "list"):
        got = sorted((r.query_id, r.true_nodes, r.true_partitions) for r in readers.read_ground_truth(spark, f"{tmp_path}/{name}.json").collect())
        assert got == [("q1", ["a", "b"], []), ("q2", ["a", "b"], [])]


def test_grid_runner(spark, tmp_path):
    from crossmotif.plans import runner

    def broken(spark, sf_dir):
        raise ValueError("no")

    known = {"range": lambda spark, sf_dir: spark.range(len(sf_dir)), "broken": broken}
    first = runner.run_grid(spark, known, ["range", "broken"], ["/x/a", "/x/bb"], f"file://{tmp_path}/out")
    assert sorted((r.query, r.input, r.status, r.rows) for r in first.collect()) == [("broken", "a", "failed", None), ("broken", "bb", "failed", None), ("range", "a", "done", 4), ("range", "bb", "done", 5)]
    again = runner.run_grid(spark, known, ["range"], ["/x/a"], f"file://{tmp_path}/out")
    assert [r.status for r in again.collect()] == ["skipped"]
    assert {(r["query"], r["runs"], r["failures"]) for r in runner.roll_up(first).collect()} == {("broken", 0, 2), ("range", 2, 0)}
    assert runner.scale_ratios(first, "a").where("input = 'a'").first().ratio == 1.0


def test_parties_spread_to_accounts_without_one(spark):
    from crossmotif.operators.custom import spread_parties

    assigned = spark.createDataFrame([("a", "P1"), ("z", "P2")], "node string, party string")
    edges = spark.createDataFrame([("a", "b", 3, "e3"), ("b", "c", 1, "e1"), ("z", "b", 5, "e5"), ("c", "z", 9, "e9"), ("u", "v", 2, "e2")], "src string, dst string, ord long, edge_id string")
    got = {r.node: r.party for r in spread_parties(assigned, edges).collect()}
    # b meets a before z; c meets z in the first round, as b has no party yet; u and v are reached by none.
    assert {k: got[k] for k in "abcz"} == {"a": "P1", "b": "P1", "c": "P2", "z": "P2"} and set(got) == set("abczuv") and got["u"].startswith("P00")


def test_clean_ratio_moves_the_ends_with_fewest_rows(spark):
    rel = tables(spark, [("a", "b", 1), ("a", "c", 1), ("a", "d", 1), ("a", "e", 1), ("d", "e", 1)], [("a", "P001"), ("b", "P002"), ("c", "P002"), ("d", "P001"), ("e", "P001")])
    rel["flow"] = rel["flow"].withColumn("currency", F.lit("O"))
    lower = {r["node"]: r["party"] for r in ask(spark, lambda d: prepare.clean_ratio_party(d, 0.2), rel)}
    assert lower == {"a": "P001", "b": "P001", "c": "P002", "d": "P001", "e": "P001"}
    higher = {r["node"]: r["party"] for r in ask(spark, lambda d: prepare.clean_ratio_party(d, 0.6), rel)}
    assert sum(lower[n] != higher[n] for n in "acde") in (1, 2) and higher["b"] == "P002"
