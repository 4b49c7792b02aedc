"""Findings of round 4: what a query may not hold against what."""

import random
from datetime import datetime, timedelta

import pytest

from crossmotif import runtime
from crossmotif.functions.dialect import SPARK
from crossmotif.operators import motifs
from crossmotif.plans.relational import names_in, run
from crossmotif.sources.graph_tables import GraphTables
from crossmotif.streaming.tag_join import stream_tag_pairs


@pytest.mark.parametrize("within,seconds", [("10 minutes", 600), ("1 hour", 3600), ("7 seconds", 7)])
def test_stream_pairs_meet_by_slot_of_time(spark, within, seconds):
    """All pairs within the bound, its ends included, once each; rows of a tag are not all held against each other."""
    draw = random.Random(3)
    start = datetime(1969, 12, 31, 22)
    made = [(draw.choice("xy"), draw.choice("PQ"), i, start + timedelta(seconds=draw.randrange(4 * 3600))) for i in range(120)]
    made += [("x", "P", 200, start), ("x", "Q", 201, start + timedelta(seconds=seconds)), ("x", "Q", 203, start - timedelta(seconds=seconds))]
    frame = lambda odd: spark.createDataFrame([r for r in made if r[2] % 2 == odd], "tag string, party string, tx long, ts timestamp")
    got = stream_tag_pairs(frame(0), frame(1), within)
    want = sorted((s[2], r[2]) for s in made for r in made if s[2] % 2 == 0 and r[2] % 2 == 1 and s[0] == r[0] and s[1] != r[1] and abs(s[3] - r[3]) <= timedelta(seconds=seconds))
    assert sorted((r.tx_s, r.tx_r) for r in got.collect()) == want and {(200, 201), (200, 203)} <= set(want)
    assert got.columns == ["tag", "party_s", "tx_s", "ts_s", "party_r", "tx_r", "ts_r"]
    join = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "slot" in join


def test_motifs_of_closed_corners_equal_the_plain_joins(spark):
    """Repeated edges, edges back and loops occur; pairs of neighbours that no edge closes are not joined on Spark."""
    draw = random.Random(11)
    edges = [(f"e{i:03}", f"v{draw.randrange(11)}", f"v{draw.randrange(11)}", 1.0, i) for i in range(70)]
    e = spark.createDataFrame(edges, "edge_id string, src string, dst string, weight double, ord long")
    p = spark.createDataFrame([(f"v{i}", f"P{i % 2}") for i in range(11)], "node string, party string")
    rel = {name: rows.cache() for name, rows in GraphTables(e, p, neighbours=6).relations().items()}
    assert any(s == t for _, s, t, _, _ in edges)
    kinds = (motifs.triangle, motifs.feed_forward, motifs.cycle, lambda d: motifs.directed_cycle(d, 3))
    other = type("Plain", (type(SPARK),), {"name": "plain"})()
    for k in kinds:
        assert "corners" in names_in(k(SPARK)) and "corners" not in names_in(k(other))
    found, want = (sorted(map(tuple, run(spark, lambda _, d=d: motifs.pooled(d, kinds), rel).collect())) for d in (SPARK, other))
    assert found == want and len({r[1] for r in want}) == 4


def test_places_over_files_store_no_second_copy(spark, monkeypatch):
    """Places of places: each order stores its ranges, and what already lies in files is not written again."""
    draw = random.Random(2)
    rows = runtime.stored(spark.createDataFrame([(i, draw.randrange(50), f"t{draw.randrange(999)}") for i in range(400)], "id long, score long, text string"), "given")
    names, store = [], runtime.stored
    monkeypatch.setattr(runtime, "SMALL_BYTES", 0)
    monkeypatch.setattr(runtime, "stored", lambda df, name: names.append(name) or store(df, name))
    twice = lambda d: d.ranked(f"SELECT x.*, CAST(first AS STRING) AS pid FROM ({d.ranked('SELECT * FROM {rows}', 'text, id', 'first')}) x", "score DESC, pid", "place")
    got = run(spark, twice, {"rows": rows}).collect()
    given = sorted(map(tuple, rows.collect()), key=lambda r: (r[2], r[0]))
    want = sorted(((*r, i) for i, r in enumerate(given, 1)), key=lambda r: (-r[1], str(r[3])))
    assert sorted((r.place, r.id, r.first) for r in got) == [(i, r[0], r[3]) for i, r in enumerate(want, 1)]
    assert names == ["ranges", "ranges"]
