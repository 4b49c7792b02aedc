"""Ids and columns of odd types in every operator and pipeline stage, against plain answers."""

import hashlib
import re

import pytest

import corpus_pipeline
from crossmotif.llm import bpe, embedding_dedup, exact_dedup, filter_audit, merkle, mixing, pii, quality, sharding, simhash, substring_dedup, toxicity, warc

LEAST, MOST = -(2**63), 2**63 - 1
LONG = "passage " * 40
TEXTS = ["one two three four five six", "one two  three four five six ", LONG + "a", "b" + LONG, None, "", "call +1 202 555 0143 or a@b.cc", "you idiot"]
INTS = [LEAST, MOST, 0, -5, 7, None, 12, None]
NAMES = ["", "zz", "a", "É", "b", None, "10", None]
KINDS = [("long", INTS), ("string", NAMES)]


def table(spark, kind, ids):
    """Rows with map, array and struct columns beside those of documents; names that clash but for case."""
    rows = [(i, t, "en", "s", 3, {"k": n}, [n, None], (n, {"q": [n]}), "x") for n, (i, t) in enumerate(zip(ids, TEXTS))]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long, tags map<string,int>, list array<int>, deep struct<a:int,b:map<string,array<int>>>, TEXT string")


def last_null(i):
    return (i is None, i if i is not None else "")


@pytest.mark.parametrize(("kind", "ids"), KINDS)
def test_exact_dedup(spark, kind, ids):
    docs = table(spark, kind, ids)
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for i, t in zip(ids, TEXTS):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", "", t or ""), []).append((i, t or ""))
    want = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), *last_null(m[0])))[0]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("kind", "ids"), KINDS)
def test_repeats(spark, kind, ids):
    got = {(r.id, r.n_bytes): bytes(r.kept).decode() for r in substring_dedup.remove_repeats(table(spark, kind, ids)).collect()}
    a, b = (ids[2], len(LONG) + 1), (ids[3], len(LONG) + 1)
    first, second = (a, b) if last_null(ids[2]) < last_null(ids[3]) else (b, a)
    assert len(got) == len({(i, len(t or "")) for i, t in zip(ids, TEXTS)})
    # Of the passage with a period of eight bytes only what the first window of each phase covers stays in the first document.
    data, seen, keep = {a: LONG + "a", b: "b" + LONG}, set(), {}
    for d in (first, second):
        drop = set()
        for s in range(len(data[d]) - 99):
            w = data[d][s : s + 100]
            drop |= set(range(s, s + 100)) if w in seen else set()
            seen.add(w)
        keep[d] = "".join(c for k, c in enumerate(data[d]) if k not in drop)
    if a != b:
        assert (got[a], got[b]) == (keep[a], keep[b])


@pytest.mark.parametrize(("kind", "ids"), KINDS)
def test_one_row_a_document(spark, kind, ids):
    """Operators that return a row for each document do so for these ids, and keep them."""
    docs = table(spark, kind, ids)
    labels = spark.createDataFrame([(i, 1, 0) for i in ids] + [("no number", 1, 1)], "doc_id string, quality int, toxic int")
    found = {
        "simhash": simhash.simhash_groups(docs), "pii": pii.digests(pii.find_pii(docs)), "bpe": bpe.digests(bpe.encode_decode(docs)), "mixing": mixing.mix(docs),
        "sharding": sharding.shard(docs, "key"), "toxicity": toxicity.score(docs, toxicity.fit(docs, labels)), "merkle": merkle.tamper_audit(docs), "quality": quality.score(docs, quality.fit(docs, labels)),
    }
    for name, df in found.items():
        assert sorted((r[0] for r in df.collect()), key=last_null) == sorted(ids, key=last_null), name
    assert filter_audit.filter_audit(docs, labels).where("filter_order = 'ABCDE' and step = 1").head().removed == len(ids)


@pytest.mark.parametrize(("kind", "ids"), KINDS)
def test_tables_of_other_ids(spark, kind, ids):
    pages = spark.createDataFrame([(i, "u", t, {"a": 1}) for i, t in zip(ids, TEXTS) if i is not None], f"page_id {kind}, url string, html string, tags map<string,int>")
    rows = warc.read_warc(warc.write_warc(pages), kind).collect()
    assert sorted(r.page_id for r in rows) == sorted(i for i in ids if i is not None)
    vectors = spark.createDataFrame([(i, [1.0, float(n % 3), 0.5, -1.0], {"a": 1}) for n, i in enumerate(ids)], f"vec_id {kind}, embedding array<float>, tags map<string,int>")
    assert embedding_dedup.embedding_groups(vectors).count() == len(ids)


@pytest.mark.parametrize(("kind", "ids"), KINDS)
def test_stages_keep_maps(spark, kind, ids, tmp_path):
    docs = table(spark, kind, ids).unionAll(table(spark, kind, ids).limit(3))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = {str(r) for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = [str(r) for r in out.collect()]
        assert set(rows) <= whole, name
        kept[name] = len(rows)
    assert kept["mixing"] == len(ids) + 3 and kept["exact_dedup"] == 6
