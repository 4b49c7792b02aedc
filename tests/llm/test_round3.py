"""Merkle manifest, filter audit and quality classifier against plain versions; ids and columns of odd types in all operators."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from crossmotif.llm import filter_audit, merkle, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def docs_of(n, seed=4, langs=("en", "de", None, "")):
    rng = random.Random(seed)
    words = [f"Wort{i}" for i in range(90)] + ["é", "$x", "ABC", "the"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "a", "lower only"]) if i % 9 == 0 else " ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 150])))
        rows.append((rng.randrange(-n, n) if i % 3 else i, text, rng.choice(langs), rng.choice(["s1", None]), rng.choice([None, i])))
    rows += [rows[5], rows[5], (None, "No Id", "en", None, None), (None, "NO ID", "en", None, None), (-(2**63), "Least", "fr", "s", 1), (2**63 - 1, "x " * 40_000 + "Y", "en", "s", 80_001)]
    return rows


# --- Merkle manifest


def plain_leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(digests):
    """(root, siblings of each leaf as (left, right) by level)."""
    paths, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        out = []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k, (_, leaves) in enumerate(run):
                for leaf in leaves:
                    paths[leaf].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            out.append((sha(*(d for d, _ in run)), [x for _, leaves in run for x in leaves]))
        nodes = out
    return nodes[0][0], paths


def plain_audit(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, path in zip(groups[g], trees[g][1]):
            whole = path + tops[k]
            d = plain_leaf(r, zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0)
            for left, right in whole:
                d = sha(left, d, right)
            out.append((r[0], plain_leaf(r), trees[g][0], root, sha(*(a + b for a, b in whole)), d, d == root))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize(("n", "langs"), [(0, None), (1, ("en",)), (2, ("a", "b")), (8, ("en",)), (700, ("en", "de", None, "")), (4700, ("en",)), (60, [f"l{i}" for i in range(30)])])
def test_merkle_equals_a_plain_tree(spark, n, langs):
    rows = docs_of(max(n, 20), langs=langs or ("en",))
    rows = rows[:n] if n < 20 else rows
    got = merkle.tamper_audit(spark.createDataFrame(rows, DOCS).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=key)
    assert found == sorted(plain_audit(rows), key=key) if rows else found == []
    if n > 100:
        assert {r[6] for r in found} == {True, False}


def test_merkle_of_other_tables(spark):
    """String ids, other fields, names that clash but for case, and columns that take no part."""
    rows = [(f"k{i}", f"T{i}", "g", {"a": i}) for i in range(20)]
    docs = spark.createDataFrame(rows, "key string, body string, BODY string, `x.y` map<string,int>")
    got = merkle.tamper_audit(docs, "key", "body", "BODY", ("key", "body")).collect()
    want, _ = plain_tree([sha(f"{len(k)}:{k}", f"{len(b)}:{b}") for k, b, *_ in sorted(rows, key=lambda r: r[0])])
    assert {r.subroot for r in got} == {r.root for r in got} == {want} and len(got) == 20
    assert all(r.verified == (zlib.crc32(r.doc_id.encode()) % 3 != 0) for r in got)


def test_merkle_proofs_serve_any_change(spark):
    docs = spark.createDataFrame(docs_of(100), DOCS)
    proofs = merkle.manifest(merkle.document_leaves(docs))
    from pyspark.sql import functions as F

    assert merkle.verify(proofs, F.col("leaf")).where("not verified").count() == 0
    assert merkle.verify(proofs, F.sha2("leaf", 256)).where("verified").count() == 0


# --- Filter audit


def plain_filters(rows, labels):
    marks = {}
    for i, q, t in labels:
        if i is not None:
            old = marks.get(i, (-1, -1))
            marks[i] = (max(old[0], -1 if q is None else q), max(old[1], -1 if t is None else t))
    low = {}
    for r in rows:
        if r[0] is not None:
            low[r[1] or ""] = min(low.get(r[1] or "", r[0]), r[0])
    docs = []
    for r in rows:
        t = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        copy = (low[t] < r[0]) if r[0] is not None else t in low
        q, x = marks.get(r[0], (0, 0)) if r[0] is not None else (0, 0)
        docs.append((r[2] or "", set(fails + "E" * copy), q == 1, x == 1))
    out = []
    for part in sorted({d[0] for d in docs}):
        own = [d for d in docs if d[0] == part]
        gone = {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in own)
                gone.setdefault(f, []).append(len(lost))
                out.append([part, order, step, len(left), len(lost), failing - len(lost), sum(d[1] == {f} for d in own), sum(d[2] for d in lost), sum(d[3] for d in lost)])
        for row in out:
            if row[0] == part:
                row.append(sum(gone[row[1][row[2] - 1]]))
    return [tuple(r) for r in out]


def test_filter_audit_equals_a_plain_count(spark):
    rows = docs_of(300) + [(50_000 + i, "Copy " * 120, "de", "s", 1) for i in range(40)] + [(None, "Copy " * 120, "en", None, None)] * 3
    labels = [(r[0], i % 2, i % 3 == 0) for i, r in enumerate(rows)] + [(None, 1, 1), (rows[3][0], None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    got = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_filters(rows, labels))


def test_filter_audit_of_odd_tables(spark, monkeypatch):
    labels = spark.createDataFrame([("a", 1, 0, 5)], "doc_id string, quality int, toxic int, QUALITY int")
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.filter_audit(empty, labels).count() == 0
    docs = spark.createDataFrame([(f"d{i}", "x", f"p{i % 50}", {"k": 1}) for i in range(200)], "doc_id string, text string, lang string, TEXT map<string,int>")
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 7)
    got = filter_audit.filter_audit(docs, labels)
    assert got.count() == 50 * 600
    assert got.where("filter_order = 'EABCD' and step = 1").groupBy().sum("kept").head()[0] == 1  # one text: only d0 is no copy


# --- Quality


def quality_rows(n=900, seed=8):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        bad = i % 4 == 0
        if bad:
            kind = i // 4 % 3
            body = [w + rng.choice(["###", "$$$"]) for w in body] if kind == 0 else [w.upper() + "!!" for w in body] if kind == 1 else body[:1] * len(body)
        rows.append((i, " ".join(body) + ".", "en", "s", 1))
        if i % 5 < 3:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_rows()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    given = {i for i, q, _ in labels if q and zlib.crc32(str(i).encode()) % 3 != 1}
    rest = [i % 4 != 0 for i in range(900) if i not in given and zlib.crc32(str(i).encode()) % 3 != 1]
    assert abs(model.prior - np.mean(rest)) < 0.1
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    unseen = [(r.predicted, i % 4 != 0, r.score) for i, r in got.items() if r.held_out]
    assert np.mean([p == y for p, y, _ in unseen]) > 0.93
    good, bad = [s for _, y, s in unseen if y], [s for _, y, s in unseen if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_learns_good_labels_only(spark):
    """Neither other labels, nor those of held-out rows, nor the other columns change a score."""
    rows, labels = quality_rows(300)
    docs = spark.createDataFrame(rows, DOCS)
    schema = "doc_id long, quality int, toxic int"
    base = quality.score(docs, quality.fit(docs, spark.createDataFrame(labels, schema), sample=200)).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    other = [(i, 1 - q if held(i) else q, 1) for i, q, _ in labels if q == 1 or held(i)] + [(None, 1, 1)]
    moved = spark.createDataFrame([(i, t, "xx", "other", 9) for i, t, *_ in rows], DOCS)
    again = quality.score(moved, quality.fit(moved, spark.createDataFrame(other, schema), sample=200)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in base}


def test_quality_of_odd_tables(spark):
    rows, labels = quality_rows(300)
    rows += [(None, None, None, None, None), (None, "", "en", "s", 0), (7, rows[7][1], "en", "s", 1), (7, "other text", "en", "s", 1), (5000, "ß " * 60_000, "en", "s", 1), (5001, "w" * 200_000, "en", "s", 1), (5002, " \n\t ", "en", "s", 1)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks, sample=100)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    same = [r.score for r in got if r.doc_id is None]
    assert same[0] == same[1]
    nothing = spark.createDataFrame([], marks.schema)
    assert {r.score for r in quality.score(docs, quality.fit(docs, nothing)).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0 and quality.fit(docs.limit(0), marks).weights is None
    odd = spark.createDataFrame([(f"i{i}", t, {"a": 1}, 3) for i, t, *_ in rows[:50]], "doc_id string, text string, TEXT map<string,int>, `q.r` int")
    named = spark.createDataFrame([(f"i{i}", q, 0) for i, q, _ in labels], "doc_id string, quality int, toxic int")
    assert quality.score(odd, quality.fit(odd, named)).count() == 50


def test_word_shares_equal_a_plain_count():
    rng = random.Random(1)
    for n in (0, 1, 5, 400):
        text = "".join(rng.choice("aeBC1.!?# \n\té") for _ in range(n))
        words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
        w = max(1, len(words))
        letter = lambda x: sum(chr(b).isalnum() or b > 127 for b in x)
        want = [
            sum(x[-1:] in b".!?" for x in words) / w, sum(bool(re.search(rb"[#!]", x)) for x in words) / w, sum(letter(x) > 0 and letter(x) == sum(65 <= b <= 90 for b in x) for x in words) / w,
            sum(len(x) > 20 for x in words) / w, sum(letter(x) == 0 for x in words) / w, sum(letter(x) > 0 and not any(b > 127 or b in b"aeiouyAEIOUY" for b in x) for x in words) / w,
        ]
        assert quality._word_shares(np.frombuffer(text.encode(), dtype=np.uint8)) == pytest.approx(want)


def test_risk_gradient_and_prior():
    rng = np.random.default_rng(0)
    x_p, x_u = rng.normal(1, 1, (60, 3)), rng.normal(0, 1, (80, 3))
    w, b, prior = rng.normal(size=3) * 0.3, 0.1, 0.4
    softplus = lambda z: np.logaddexp(0, z)

    def risk(v):
        z_p, z_u = x_p @ v[:3] + v[3], x_u @ v[:3] + v[3]
        return prior * softplus(-z_p).mean() + softplus(z_u).mean() - prior * softplus(z_p).mean()

    g_w, g_b, bad = quality.nn_risk_step(x_p, x_u, w, b, prior)
    assert bad > 0
    at = np.append(w, b)
    for k in range(4):
        e = np.zeros(4)
        e[k] = 1e-6
        assert (risk(at + e) - risk(at - e)) / 2e-6 == pytest.approx(np.append(g_w, g_b)[k], abs=1e-6)
    # Where the estimated risk on bad text is negative, a step along the gradient lifts it.
    big = np.array([0.0, 0.0, 0.0])
    g_w, g_b, bad = quality.nn_risk_step(x_p, x_u - 3, big + 2, 2.0, 0.95)
    if bad < 0:
        assert quality.nn_risk_step(x_p, x_u - 3, big + 2 - 1e-3 * g_w, 2.0 - 1e-3 * g_b, 0.95)[2] > bad
    p, u = rng.normal(3, 1, 4000), np.concatenate([rng.normal(3, 1, 2800), rng.normal(-3, 1, 1200)])
    assert 0.65 < quality.tail_ratio(p, u) < 0.78
