"""The training-data operators against plain versions, with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from crossmotif.llm import bpe, embedding_dedup, exact_dedup, mixing, pii, sharding, simhash, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **source):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "été", "漢字", "😀"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    near = [b.replace("alpha", "ALPHA", 1) + " " for b in base[:10]]
    return base + near + base[:5] + [None, "", "  \n", None, "x" * 30_000, "word " * 9_000, "a b", "a  b", "ab"]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd_texts())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(keys))]


def test_simhash(docs, none):
    got = by_id(simhash.simhash_groups(docs))
    prints = [plain_fingerprint(t) for t in odd_texts()]
    roots = plain_components(prints, lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    assert [got[i]["fingerprint"] for i in range(len(prints))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(prints))] == roots
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_links_span_every_component():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(600)]
    fps = np.unique(np.concatenate([base, np.array([rng.choice(base) ^ f for f in flips], dtype=np.uint64)]))
    import pyarrow as pa

    balls = pa.Table.from_batches(list(simhash._balls([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])])))
    balls = balls.sort_by([("key", "ascending"), ("fp", "ascending")])
    links = {(a, b) for batch in simhash._verify(balls.to_batches(max_chunksize=997), 4) for a, b in zip(*batch.to_pydict().values())}
    signed = fps.view(np.int64)
    want = plain_components(signed, lambda i, j: bin(int(fps[i] ^ fps[j])).count("1") <= 4)
    place = {int(v): i for i, v in enumerate(signed)}
    pairs = {tuple(sorted((place[a], place[b]))) for a, b in links}
    assert plain_components(signed, lambda i, j: (j, i) in pairs) == want


def test_exact_dedup(docs, none):
    texts = odd_texts()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    got = by_id(exact_dedup.exact_dedup(docs))
    for i, t in enumerate(texts):
        group = [j for j, n in enumerate(norm) if n == norm[i]]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert got[i] == {"doc_id": i, "keep_id": keep, "group_size": len(group), "kept": keep == i, "text_sha256": hashlib.sha256(norm[i].encode()).hexdigest()}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_tells_bodies_of_one_digest_apart(spark):
    """Recipes are rewritten with variants when a digest stands for two bodies."""
    df = documents(spark, ["abc", "abd", "abc"])
    fake = spark.sql("select xxhash64('abc') as h, xxhash64(7, 'abc') as g, 'abc' as body, 2 as variant")
    rows = exact_dedup._with_variants(df, fake, "doc_id", "text").collect()
    assert sorted(r.recipe[0].variant for r in rows) == [0, 2, 2]


def test_chunks_cover_the_text(spark):
    df = documents(spark, odd_texts())
    chunks = exact_dedup.F.regexp_extract_all("n", exact_dedup.F.lit(exact_dedup.chunk_pattern()), exact_dedup.F.lit(0))
    rows = df.select(exact_dedup.normalised(df.text).alias("n")).withColumn("c", chunks).collect()
    assert all("".join(r.c) == r.n for r in rows)


@pytest.mark.parametrize("law", ["bytes", "rows", "key"])
def test_sharding(docs, none, law):
    texts = odd_texts()
    rows = sharding.shard(docs, law, 8).collect()
    assert len(rows) == len(texts)
    shards = {s: [r for r in rows if r.shard == s] for s in range(8)}
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), law)
    sizes = [len(own) for own in shards.values()]
    if law == "rows":
        assert max(sizes) - min(sizes) <= 1
    if law == "key":
        assert all(r.grown_shard in (r.shard, 8) for r in rows)
    else:
        assert all(r.grown_shard is None for r in rows)
    assert sharding.shard(none, law, 8).count() == 0


def test_rebalancing_evens_bytes():
    rng = random.Random(1)
    load = {s: rng.randint(0, 5000) for s in range(512)}
    where = sharding.rebalanced(sharding.first_map(16, 512), load, 16)
    total = [sum(load[s] for s, h in where.items() if h == i) for i in range(16)]
    assert set(where) == set(load) and max(total) - min(total) < 40


def plain_repeats(texts):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "hottest"), [(substring_dedup.HOT, substring_dedup.HOTTEST), (3, 6), (2, 2), (4, 10**6)])
def test_substring_dedup(spark, none, hot, hottest):
    rng = random.Random(2)
    letters = "abcdefgh é"
    passage = "".join(rng.choice(letters) for _ in range(260))
    texts = odd_texts() + [passage, "x" + passage[30:190] + "y", passage[:99], passage[100:200] * 3, "ab" * 300, "q" * 450, "ba" * 200]
    got = by_id(substring_dedup.digests(substring_dedup.remove_repeats(documents(spark, texts), hot=hot, hottest=hottest)))
    want = plain_repeats(texts)
    assert [tuple(got[i].values())[1:] for i in range(len(texts))] == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    texts = odd_texts()
    got = {r.id: r for r in bpe.encode_decode(docs).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "<|startoftext|>x <|endoftext|>", "é ́a", " 　 a\u0085b", "ΣΑΣ İ ﬁ " * 90, "it's we'll\t\n\x0b x" * 200, "z" * 40_000, "\x00\x1c a"])
def test_bpe_joins(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    coder = bpe.encoder(bpe.default_tokenizer())
    ids = coder.encode(text.encode())
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and coder.decode([ids]) == [tokenizer.decode(want, skip_special_tokens=False)]


def test_bpe_reuses_shared_chunks_and_checks_joins():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(3000))
    coder = bpe.ChunkEncoder(bpe.default_tokenizer())
    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    for i in range(6):
        text = " ".join(rng.choice(words) for _ in range(200 + i)) + " " + passage + " é" * i
        assert coder.encode(text.encode()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.reused > 2 * coder.encoded and coder.joins > coder.reused
    # Ids that do not agree at a join are not trusted: the whole text is encoded then.
    coder.chunks = {k: v and (v[0], b"\1\0\0\0", *v[2:]) for k, v in coder.chunks.items()}
    assert coder.encode(passage.encode()).tolist() == tokenizer.encode(passage, add_special_tokens=False).ids and coder.grown


def test_warc_round_trip(spark):
    html = ["<p>one</p>", None, "<p>two é</p>", "<p>one</p>", "", "x" * 3_000_000, "<p>one</p>\r\n\r\n"]
    pages = spark.createDataFrame([(i * 3, f"http://h/{i}\r\n?q=ü", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(pages)).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = next(j for j, x in enumerate(html) if (x or "").encode() == raw)
        r = got[i * 3]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first * 3))
        assert r.payload == (raw if first == i else b"")
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0
    assert {r.record_type for r in warc.read_warc(warc.write_warc(pages, min_revisit_bytes=100)).collect()} == {"response"}


def test_warc_reader_notices_damage():
    raw = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    pack = lambda x: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + c.flush()
    assert [p for _, p in warc.read_records(io.BytesIO(pack(raw) * 3))] == [b"payload"] * 3
    for bad in (pack(raw.replace(b"payload", b"pay1oad")), pack(raw)[:-12], pack(raw[:-1])):
        with pytest.raises(warc.RecordError):
            list(warc.read_records(io.BytesIO(bad)))


def plain_base_spans(text):
    """Base spans with Python's regular expressions."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(n):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0

    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            n = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_spans(spark, none):
    texts = odd_texts() + [
        "😀 mail a.b@c.de, x@y.z_q@r.st +1 (268) 555-3520 and 4835853571649677.", "4111 1111 1111 1111 10.0.0.1 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "a@b.c_d@e.f@g.h",
        "+1 2 3 ((( 44 +49-30-1234567-", "1-2-3-4-5 " * 50, "a" * 5000 + "@b.co", "a.a" * 3000, "9" * 4000,
    ]
    got = by_id(pii.digests(pii.find_pii(documents(spark, texts))))
    for i, t in enumerate(texts):
        want = plain_base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i]["spans"])
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    assert pii.digests(pii.find_pii(none)).count() == 0


def test_pii_address_parts_of_four_digits_and_more(spark):
    texts = ["built 2024.1.15.3 ok", "1.1200.3.4", "10001.2.3.4", "0001.002.3.4", "00000255.1.1.0000", "1.2.3.0256", "1.2.3.4"]
    got = by_id(pii.digests(pii.find_pii(documents(spark, texts))))
    assert [got[i]["n_ip"] for i in range(7)] == [0, 0, 0, 1, 1, 0, 1]
    assert all(got[i]["base_sha256"] == hashlib.sha256(plain_base_spans(t).encode()).hexdigest() for i, t in enumerate(texts))


def test_pii_em_learns_reliabilities():
    rng = random.Random(4)
    patterns: dict = {}
    for _ in range(4000):
        truth = rng.random() < 0.6
        # The third labeler knows little, the last one only ever votes against.
        vote = tuple(int(truth if rng.random() < q else not truth) for q in (0.95, 0.9, 0.55)) + (-1 if truth or rng.random() < 0.3 else 0,)
        patterns[vote] = patterns.get(vote, 0) + 1
    prior, rates, _ = pii.reliabilities(list(patterns.items()))
    assert abs(prior - 0.6) < 0.05 and rates[0][0][1] > 0.9 and rates[0][1][1] < 0.15 and 0.4 < rates[2][0][1] < 0.65
    assert rates[3][0][0] < 0.05 and rates[3][1][0] > 0.6


def test_pii_classifier_weighs_the_votes():
    cue, plain = (-1, 1, 1, -1, 0, 1), (-1, 1, -1, -1, 1, 1)
    w = pii.span_classifier([])
    chance = lambda f: pii._sigmoid(sum(a * b for a, b in zip(w, pii._inputs(f))) + w[-1])
    assert chance(cue) >= pii.ACCEPT > chance(plain) > chance((-1, 1, -1, 0, 1, 1))
    assert chance((1, 1, -1, 0, 1, 1)) < pii.ACCEPT <= chance((1, 1, 1, -1, 1, 1))


def test_pii_added_spans(spark):
    filler = "the river and the stone of a morning "
    yes = [
        ("call (415) 555-2671 phone", "phone", "(415) 555-2671"), ("my phone 415-555-2671 is", "phone", "415-555-2671"), ("card 4111.1111.1111.1111 visa", "card", "4111.1111.1111.1111"),
        ("e-mail jane.doe [at] example [dot] com today", "email", "jane.doe [at] example [dot] com"), ("server ip 10[.]20[.]30[.]40 down", "ip", "10[.]20[.]30[.]40"),
        ("contact bob(at)mail.org now", "email", "bob(at)mail.org"),
    ]
    no = [
        "order 415-555-2671 left", "invoice no. 415-555-2671", "version 2024.1.15.3 of", "isbn 4111.1111.1111.1112 shelf", "serial 4111111111111112", "see page 300.400.500.600",
        "ticket 1234567812345678 closed", "part 999[.]999[.]1[.]2",
    ]
    texts = [filler * 3 + t + " " + filler for t, _, _ in yes] + [filler + t + " " + filler for t in no] + [filler * 2000 + yes[0][0] + " " + filler * 2000, "mail a@b.com or +1 (212) 555-0100", None, ""]
    docs, spans = pii.find_pii(documents(spark, texts))
    ids = {r["row"]: r["id"] for r in docs.collect()}
    added = {}
    for r in spans.collect():
        text = texts[ids[r["row"]]]
        assert text[r["start"] : r["end"]] == r["span"]
        if not r["base"]:
            added.setdefault(ids[r["row"]], []).append((r["kind"], r["span"].strip()))
    want = {i: [(k, s)] for i, (_, k, s) in enumerate(yes)} | {len(yes) + len(no): [yes[0][1:]]}
    assert added == want


def test_pii_spans_belong_to_their_rows_whatever_made_the_input(spark):
    texts = [f"{'x ' * (i % 7)}a{i}@b{i % 3}.com and 10.0.{i % 256}.1 {'y ' * i}" for i in range(400)]
    rows = [(i if i % 10 else None, t) for i, t in enumerate(texts)] + [(5, "again 5@five.org"), (5, "again 5@five.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for made, wanted in ((df, rows), (df.dropDuplicates(["doc_id", "text"]), set(rows)), (df.repartition(7).orderBy(F.rand(3)), rows)):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.spans) for r in pii.digests(pii.find_pii(made)).collect())
        assert got == sorted((-1 if i is None else i, plain_base_spans(t)) for i, t in wanted)


def test_mixing_keeps_every_document_and_its_weights(spark, none):
    rows = [(i, "t", "en", ["a", "b", "c", None][min(3, i % 10 // 3)], 1) for i in range(900)] + [(None, "t", "en", "a", 1), (5, "t", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    weights = {"a": 5, "b": 3, "c": 1, None: 1}
    got = mixing.mix(df, weights, block=4).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == sorted((str(r[0]), str(r[3])) for r in rows)
    turns = sorted({(r.slot, r.source) for r in got})
    assert len({t for t, _ in turns}) == len(turns)  # a slot serves one block
    assert all(r.release <= r.slot < r.deadline for r in got)
    phase = [r for r in got if r.phase == 0]
    last = max(r.slot for r in phase)
    for s, w in weights.items():
        served = sorted({r.slot for r in phase if r.source == s})
        for t in range(last + 1):
            assert abs(sum(x <= t for x in served) - w * (t + 1) / 10) < 1
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 7])  # a cluster of 30 is one bucket, or dealt into blocks
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((150, 24))
    v[40:70] = v[0] + 0.08 * rng.standard_normal((30, 24))
    v[70:75] = v[3] * 2.5
    vectors = [list(map(float, x)) for x in v] + [vectors_ for vectors_ in ([0.0] * 24, None, [float("nan")] * 24, [], list(map(float, v[5])), [1.0, None] + [0.0] * 22, list(map(float, v[7]))[:12])]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = by_id(embedding_dedup.embedding_groups(df, block=block), "vec_id")
    single = [None if x is None or not x or None in x or not np.isfinite(x).all() or not np.any(x) else np.array(x, np.float32).astype(float) for x in vectors]
    linked = lambda i, j: single[i] is not None and single[j] is not None and len(single[i]) == len(single[j]) and single[i] @ single[j] >= 0.95 * np.linalg.norm(single[i]) * np.linalg.norm(single[j])
    roots = plain_components(single, linked)
    for i in range(len(vectors)):
        assert got[i]["n_links"] == sum(linked(i, j) for j in range(len(vectors)) if j != i), i
        assert got[i]["component_id"] == roots[i] and got[i]["kept"] == (roots[i] == i)


@pytest.mark.parametrize("width", [64, 100, 384])
def test_cross_polytope_recall(width):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((3000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((3000, width))
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * o / np.linalg.norm(o, axis=1, keepdims=True)
    ka, kb = embedding_dedup.bucket_keys(a), embedding_dedup.bucket_keys(b)
    assert (ka[:, :, None] == kb[:, None, :]).any((1, 2)).mean() > 0.99


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = [toxicity.Term(t, False, 1.0, k) for t, k in (("idiot", 1), ("moron", 1), ("disgusting", 2), ("worthless", 2), ("pig", 0))]
    lexicon = toxicity.FuzzyLexicon(terms)
    for _ in range(4000):
        word = list(rng.choice(terms).text)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "i", "o"])
        word = "".join(word)
        want = {(i, edits(word, t.text)) for i, t in enumerate(terms) if edits(word, t.text) <= t.budget}
        assert set(lexicon.match(word)) == want, word


def test_learned_words_keep_their_edit_budget(spark):
    rows = [("blorfing", 5, 0), ("grumblewort", 40, 0), ("sometimes", 300, 5)]  # rare, common, also in clean rows
    counted = spark.createDataFrame(rows, "term string, bad long, good long")
    terms = {t.text: t.budget for t in toxicity.choose_terms(counted, 1000, 10000)}
    assert (terms["blorfing"], terms["grumblewort"], terms.get("sometimes", 0)) == (1, 2, 0)


def test_words_skip_the_automaton_only_where_nothing_matches():
    rng = random.Random(8)
    letters = "abcé"
    for _ in range(30):
        texts = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(12)}
        terms = [toxicity.Term(t, len(t) == 4, 1.0, 0 if len(t) < 5 else 1 if len(t) < 9 else 2) for t in sorted(texts)]
        lexicon = toxicity.FuzzyLexicon(terms)
        for _ in range(150):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) if rng.random() < 0.5 else rng.choice(terms).text + rng.choice(["", "a", "bcé"])
            want = {(i, 0) for i, t in enumerate(terms) if t.stem and word.startswith(t.text)}
            want |= {(i, edits(word, t.text)) for i, t in enumerate(terms) if not t.stem and edits(word, t.text) <= t.budget}
            assert set(lexicon.match(word)) == want and len(lexicon.match(word)) == len(want), word
            assert not want or lexicon.screened(["zz", word, "zzzzz"]) == [word], word


def test_misspelled_terms_are_found_in_long_texts_of_any_script():
    terms = [toxicity.Term(t, False, 1.0, toxicity._budget(t, False)) for t in ("blorfing", "müllhaufen", "погань", "pig")]
    lexicon = toxicity.FuzzyLexicon(terms)
    far = "river stone " * 50_000
    texts = [far + "blorfnig, " + far, "ein Müllhafen!", "эта погнь", "pi pigs", "", "Blorfing \"blorfing\""]
    found = [{k - toxicity.N_FIXED for k in f if k >= toxicity.N_FIXED} for f in toxicity.featured(texts, lexicon)]
    assert found == [set(), {1}, {2}, set(), set(), {0}]  # a swap of letters takes two edits, the budget of eight letters is one
    assert [{k - toxicity.N_FIXED for k in f if k >= toxicity.N_FIXED} for f in toxicity.featured([far + "blorfinng " + far], lexicon)] == [{0}]


def test_toxicity(spark, none):
    rng = random.Random(7)
    words = "the of and house river stone cloud garden letter morning".split()
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(300)]
    toxic = [i % 5 == 0 for i in range(300)]
    texts = [f"{t} you {rng.choice(['idiot', 'blorf', 'moron'])} {t} blorf" if x else t for t, x in zip(texts, toxic)] + ["", None]
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(toxic)] + [(0, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score(df, toxicity.fit(df, labels)))
    assert [got[i]["predicted"] for i in range(300)] == [int(x) for x in toxic]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert got[300]["score"] == got[301]["score"] < 0.5
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 242
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_extra_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "a b c", "z", 3), (2, "a b c", "y", 4)], "doc_id long, text string, TEXT string, `id` int")
    assert exact_dedup.exact_dedup(df).where("kept").count() == 1
    assert simhash.simhash_groups(df).where("kept").count() == 1
    assert bpe.encode_decode(df).count() == 2


def test_warc_reader_takes_records_of_other_writers(spark, tmp_path):
    pack = lambda x: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + c.flush()
    info = b"software: x\r\n"
    http = b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\nbody"
    head = lambda kind, more, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    raw = [
        head("warcinfo", "Content-Type: application/warc-fields\r\n", info), head("response", "Content-Type: application/http; msgtype=response\r\nWARC-Target-URI: http://u/\r\n", http),
        head("response", "Content-Type: application/http\r\nWARC-Block-Digest: sha256:00\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode().lower() + "\r\n", http),
        head("revisit", "Content-Type: application/http\r\n", b"HTTP/1.1 304 Not Modified\r\n\r\n"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(pack, raw)))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 4, 1)], "path string, records long, bytes long")
    got = [(r.record_type, r.url, r.page_id, r.payload_bytes, bytes(r.payload)) for r in warc.read_warc(manifest).collect()]
    assert got == [("warcinfo", None, None, 13, info), ("response", "http://u/", None, 4, b"body"), ("response", None, None, 4, b"body"), ("revisit", None, None, None, b"")]


def test_repeats_with_null_and_shared_ids(spark):
    rng = random.Random(12)
    part = "".join(rng.choice("abcdefgh") for _ in range(150))
    other = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(3, part), (3, other), (None, part), (1, "x" + part), (3, part)]
    got = substring_dedup.digests(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got) == [(0, 150, 150), (1, 151, 0), (3, 150, 150), (3, 150, 150), (3, 400, 0)]
