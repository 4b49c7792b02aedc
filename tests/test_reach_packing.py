"""k-hop reach and greedy packing against plain sequential versions."""

import random
from collections import Counter, deque

import pytest

from crossmotif.operators import packing, reach


def plain_hops(edges, start, k):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    seen, todo, reached, n = {start}, deque([(start, 0)]), set(), 0
    while todo:
        x, d = todo.popleft()
        if d < k:
            n += len(after.get(x, []))
            for y in after.get(x, []):
                reached.add(y)
                if y not in seen:
                    seen.add(y)
                    todo.append((y, d + 1))
    return len(reached), n


@pytest.mark.parametrize("size", [2, 256])
def test_hops_equal_a_plain_search(spark, size):
    """Repeated edges, loops, a hub that takes many blocks, cycles, ends without edges, sources that do not occur."""
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)] + [("hub", f"n{i}") for i in range(25)] + [("n1", "hub"), ("n1", "hub"), ("n3", "n3"), ("t", "u")]
    sources = sorted({x for e in edges for x in e}) + ["nowhere", None, "n1", "n1"]
    rows = spark.createDataFrame([*edges, (None, "n1"), ("n1", None)], "node string, nbr string").repartition(3)
    got = {(r.node, r.hop): (r.reached, r.edges) for r in reach.hop_reach(rows, spark.createDataFrame([(s,) for s in sources], "node string"), 5, size).collect()}
    assert got == {(s, k): plain_hops(edges, s, k) for s in set(sources) - {None} for k in range(1, 6)}
    assert reach.hop_reach(rows.limit(0), spark.createDataFrame([], "node string"), 2).count() == 0


@pytest.mark.parametrize(("group", "bits"), [(3, 512), (40, 8)])
def test_groups_of_sources_send_each_list_once(spark, monkeypatch, group, bits):
    """What a source has reached is never a row: groups of sources take their hops over shared lists."""
    monkeypatch.setattr(reach, "BITS", bits * 8 if bits < 64 else bits)
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(200)]
    sources = sorted({x for e in edges for x in e})
    rows = spark.createDataFrame(edges, "node string, nbr string").repartition(3)
    found = reach.hop_reach(rows, spark.createDataFrame([(s,) for s in sources], "node string"), 4, group=group)
    assert {(r.node, r.hop): (r.reached, r.edges) for r in found.collect()} == {(s, k): plain_hops(edges, s, k) for s in sources for k in range(1, 5)}


def greedy(sizes, loads):
    loads, out = list(loads), []
    for s in sizes:
        i = min(range(len(loads)), key=lambda j: loads[j])
        loads[i] += s
        out.append(i)
    return out


def test_runs_equal_the_greedy_choice():
    rng = random.Random(3)
    for _ in range(400):
        sizes = sorted((rng.choice([1, 1, 1, 2, 3, 7, 20, 300]) for _ in range(rng.randrange(60))), reverse=True)
        loads = [rng.choice([0, 0, 1, 5, 40, 1000]) for _ in range(rng.randint(1, 6))]
        histogram = sorted(Counter(sizes).items(), reverse=True)
        got = []
        for _, a, b, turn in packing.runs(histogram, loads):
            got += [turn[(i - a) % len(turn)] for i in range(a, b)]
        assert got == greedy(sizes, loads)
    # A few runs serve any number of components.
    assert len(packing.runs([(10**9, 1), (1, 10**10)], [0] * 5)) < 12


def test_packing(spark):
    rng = random.Random(8)
    parts = {f"c{i:03d}": rng.choice([1, 1, 2, 5, 30]) for i in range(60)}
    rows = [(f"{c}-{j}", c) for c, n in parts.items() for j in range(n)]
    got = packing.pack(spark.createDataFrame(rows, "node string, component string"), ["A", "B", "C"], {"B": 25}).collect()
    order = sorted(parts, key=lambda c: (-parts[c], c))
    want = dict(zip(order, greedy([parts[c] for c in order], [0, 25, 0])))
    assert len(got) == len(rows) and all(r.party == "ABC"[want[r.component]] for r in got)
    assert packing.pack(spark.createDataFrame([], "node string, component string"), ["A"]).count() == 0
