"""The SQL of the queries against the operators on small tables with nulls, empty texts, copies and links."""

import random

import duckdb
import numpy as np
import pytest

from crossmotif.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    path = str(tmp_path_factory.mktemp("sql"))
    letters = "abcdefgh é😀\n"
    passage = "".join(rng.choice(letters) for _ in range(300))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += [passage, "x" + passage[20:250] + "y", passage, None, "", "  ", None, "z" * 350, "A b", "A  b", "Ab ", passage[:99], passage[:100]]
    docs = [(i, t, ["en", "de", None, ""][i % 4], ["s", None][i % 5 == 0], len(t) if t else None) for i, t in enumerate(texts)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    pages = [(i, f"http://h/{i}", t) for i, t in enumerate(texts[20:])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    r = np.random.default_rng(3)
    v = r.standard_normal((40, 64))
    v[10:20] = v[0] + 0.05 * r.standard_normal((10, 64))
    v[20] = v[30]
    vectors = [list(map(float, x)) for x in v] + [None, [0.0] * 64, [float("nan")] + [1.0] * 63]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_equals_operator(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key)
    assert want
