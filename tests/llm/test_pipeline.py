"""The corpus pipeline against a plain version of every stage, written without the library's operators."""

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

import corpus_pipeline
from crossmotif.llm import exact_dedup, mixing, simhash, toxicity
from crossmotif.runtime import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(120)]
    bad = ["idiot", "morron", "blorfing", "blorfnig"]
    toxic = [f"you {rng.choice(bad)} {' '.join(rng.choice(words) for _ in range(30))} you {rng.choice(bad)} blorfing" for _ in range(60)]
    texts += [t + " \n" for t in texts[:10]] + [t + " tail" for t in texts[20:24]] + [None, "", "  ", "you idiot you moron " * 4] + texts[:3] + toxic
    texts.append(" ".join(rng.choice(words) for _ in range(30_000)))
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)] + [(7, texts[7], "en", "s3", 1)]
    # Null ids, ids shared by different texts, spellings of one text that only white space tells apart, no source.
    rows += [(None, texts[40] + " x", None, "s1", None), (None, texts[41] + " tail tail tail x y z", "de", None, 3), (None, None, None, None, None)]
    rows += [(12, texts[50][::-1], "en", "s0", 1), (12, texts[51][::-1], "en", "s0", 1), (900, texts[52][::-1] + "  ", "en", "s2", 2), (901, "  " + texts[52][::-1], "en", "s2", 2)]
    labels = [(i, 1, int("blorf" in (t or "") or "idiot" in (t or ""))) for i, t in enumerate(texts)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = make_rows()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def order(row):
    """Rows in the order of their columns, nulls first."""
    return tuple((x is not None, x if x is not None else 0) for x in row)


def last_null(x):
    return (x is None, x or 0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_score(model, text):
    """The model's score with every word compared to every term."""
    tokens = (text or "").split()
    hits = []
    for i, t in enumerate(tokens):
        for w in re.findall(r"\w+", t.lower()):
            for k, term in enumerate(model.terms):
                if term.stem and w.startswith(term.text):
                    hits.append((i, k, 0))
                elif not term.stem and abs(len(w) - len(term.text)) <= term.budget and distance(w, term.text) <= term.budget:
                    hits.append((i, k, distance(w, term.text)))
    x = dict.fromkeys(range(toxicity.N_FIXED), 0.0)
    counts, weight, fuzzy, seen = {}, 0.0, 0, []
    quoted = addressed = crowd = 0
    for i in sorted({i for i, _, _ in hits}):
        near = tokens[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]
        around = {w for t in near for w in re.findall(r"\w+", t.lower())}
        opened = any(t[0] in toxicity.QUOTES for t in tokens[max(0, i - toxicity.WINDOW) : i + 1])
        closed = any(t[-1] in toxicity.QUOTES or t.rstrip(".,;:!?")[-1:] in toxicity.QUOTES for t in tokens[i : i + toxicity.WINDOW + 1])
        said = (opened and closed) or bool(around & toxicity.SAID)
        quoted, addressed = quoted + said, addressed + bool(around & toxicity.YOU)
        crowd += bool(seen) and i - seen[-1] <= toxicity.WINDOW
        seen.append(i)
        for _, k, e in (h for h in hits if h[0] == i):
            share = (0.5 if said else 1.0) * (0.7 if e else 1.0)
            counts[k] = counts.get(k, 0) + share
            weight, fuzzy = weight + share * model.terms[k].weight, fuzzy + (e > 0)
    z = model.bias
    if hits:
        x = {toxicity.N_FIXED + k: math.log1p(c) for k, c in counts.items()}
        x |= {toxicity.QUOTED: math.log1p(quoted), toxicity.ADDRESSED: math.log1p(addressed), toxicity.TOTAL: math.log1p(weight), toxicity.CROWD: math.log1p(crowd)}
        x |= {toxicity.DENSITY: 20 * weight / (len(tokens) + 20), toxicity.FUZZY: math.log1p(fuzzy)}
        z += sum(model.weights[k] * v for k, v in x.items())
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", "", r[1] or ""), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), last_null(r[0]), order(r))) for g in groups.values()]


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_near(rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                group[root(i)] = root(j)
    parts = {}
    for i, r in enumerate(rows):
        parts.setdefault(root(i), []).append(r)
    return [min(g, key=lambda r: (last_null(r[0]), hashlib.sha256((r[1] or "").encode()).hexdigest(), order(r))) for g in parts.values()]


def plain_bpe(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    out = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=order)


def test_stages_equal_their_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns = docs.columns
    rows = sorted_rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            assert {zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows} == {True, False}
            rows = [r for r in rows if plain_score(model, r[1]) < 0.7]
            assert not any("blorfing" in (r[1] or "") for r in rows) and len(rows) > 140
        elif name == "exact_dedup":
            rows = plain_exact(rows)
        elif name == "simhash_near_dedup":
            rows = plain_near(rows)
        docs = stored(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        rows = sorted(rows, key=order)
        assert sorted_rows(docs) == rows, name
    want = sorted(plain_bpe(rows), key=order)
    assert sorted_rows(corpus_pipeline.STAGES[-1][1](spark, docs, folder)) == want
    assert sorted_rows(corpus_pipeline.run(spark, folder)) == want


def test_stages_pass_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash_but_for_case_pass_through(spark):
    rows = [(1, "a b c d e", "x", 5, "s", "t"), (2, "a b  c d e", "y", 6, "s", None), (None, "f g h i j k", "z", 7, None, "u"), (None, "l m n o p q", "z", 7, "s", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, Doc_Id int, source string, `_stays.x` string")
    kept = sorted(rows[1:], key=order)
    for stage in (exact_dedup.drop_exact_copies, simhash.drop_near_copies, mixing.in_mixture_order):
        got = stage(docs)
        assert got.columns == docs.columns
        want = sorted(rows, key=order) if stage is mixing.in_mixture_order else kept if stage is exact_dedup.drop_exact_copies else sorted([rows[0], *rows[2:]], key=order)
        assert sorted_rows(got) == want, stage
    labels = spark.createDataFrame([(1, 0, "q")], "doc_id long, toxic int, TOXIC string")
    assert sorted_rows(toxicity.drop_toxic(docs, labels)) == sorted(rows, key=order)


def test_rows_without_or_with_shared_ids_stay_by_text(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(300)]
    a, b, c, d = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, b), (5, c), (5, d), (None, a + " "), (6, c), (5, c)]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", len(t)) for n, (i, t) in enumerate(rows)], DOCS)
    want = {(None, a + " ", "s4"), (None, b, "s1"), (5, c, "s2"), (5, d, "s3")}
    exact = exact_dedup.drop_exact_copies(docs)
    assert sorted((r.doc_id or 0, r.text, r.source) for r in exact.collect()) == sorted((i or 0, t, s) for i, t, s in want)
    near = simhash.drop_near_copies(docs)
    assert sorted((r.doc_id or 0, r.text.strip()) for r in near.collect()) == sorted((i or 0, t.strip()) for i, t, _ in want)
