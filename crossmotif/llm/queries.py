"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossmotif.llm import bpe, embedding_dedup, exact_dedup, filter_audit, merkle, mixing, pii, quality, sharding, simhash, substring_dedup, toxicity, warc
from crossmotif.runtime import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents")))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), law="bytes")


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_audit(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_warc": op2_warc,
        "op3_pii": op3_pii,
        "op4_substrings": op4_substrings,
        "op5_bpe": op5_bpe,
        "op6_exact": op6_exact,
        "op7_mixing": op7_mixing,
        "op8_sharding": op8_sharding,
        "op9_embedding": op9_embedding,
        "op10_toxicity": op10_toxicity,
        "op11_merkle": op11_merkle,
        "op12_filter_audit": op12_filter_audit,
        "op13_quality": op13_quality,
    }


#: Each page's payload, the first page of equal payloads, and the SHA-1 in base 32 (five hexadecimal digits are four of it).
WARC_SQL = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id, sha1(payload) AS h FROM p),
    d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS g FROM f)
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
      array_to_string(list_transform(g, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> b) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM d"""

#: Every window of 100 bytes (200 hexadecimal digits) is named; all but its first place are removed, and the rest put together.
SUBSTRINGS_SQL = """
    WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS window_ FROM (SELECT doc_id, x, unnest(range(CAST(len(x) // 2 - 99 AS BIGINT))) AS s FROM t)),
    g AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY window_ ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
    i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM
          (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM g)),
    r AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
    k AS (SELECT t.doc_id, coalesce(lag(r.b) OVER (PARTITION BY t.doc_id ORDER BY r.a), 0) AS a, r.a AS b, t.x FROM t JOIN r ON t.doc_id = r.doc_id
          UNION ALL SELECT t.doc_id, coalesce(m.b, 0), len(t.x) // 2, t.x FROM t LEFT JOIN (SELECT doc_id, max(b) AS b FROM r GROUP BY doc_id) m ON t.doc_id = m.doc_id),
    c AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept FROM k GROUP BY doc_id),
    n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
    SELECT t.doc_id, CAST(len(t.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(c.kept)) AS kept_sha256
    FROM t JOIN c ON t.doc_id = c.doc_id LEFT JOIN n ON t.doc_id = n.doc_id"""

#: All pairs by cosine, components by recursion over the links.
EMBEDDING_SQL = """
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS MATERIALIZED (SELECT vec_id, e, len(e) AS k, sqrt(list_dot_product(e, e)) AS norm FROM v),
    l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.k = b.k AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
    reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
    c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
    SELECT m.vec_id, CAST((SELECT count(*) FROM l WHERE l.x = m.vec_id) AS BIGINT) AS n_links, c.low AS component_id, m.vec_id = c.low AS kept FROM embeddings m JOIN c ON m.vec_id = c.x"""


#: Trees by recursion over runs of eight nodes, proofs by a second one; CRC-32 from its table, which follows from the polynomial.
MERKLE_SQL = """
    WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
          FROM (SELECT unnest(range(256)) AS i))),
    third AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
          lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, crc),
    field AS (SELECT doc_id, text, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g,
          coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
          || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
    leaf AS MATERIALIZED (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
          CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS bad,
          row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM field JOIN third USING (doc_id)),
    node(g, lev, pos, n, digest) AS (SELECT g, 0, pos, n, leaf FROM leaf
          UNION ALL SELECT g, lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY g, lev, n, pos // 8),
    head AS MATERIALIZED (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
    top(g, lev, pos, n, digest) AS (SELECT '', 0, pos, n, subroot FROM head
          UNION ALL SELECT g, lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY g, lev, n, pos // 8),
    beside AS MATERIALIZED (SELECT g, lev, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM (SELECT * FROM node UNION ALL SELECT * FROM top) WHERE n > 1 WINDOW w AS (PARTITION BY g, lev, pos // 8 ORDER BY pos)),
    inner_(doc_id, g, lev, pos, sibs, now) AS (SELECT doc_id, g, 0, pos, '', coalesce(bad, leaf) FROM leaf
          UNION ALL SELECT doc_id, f.g, f.lev + 1, f.pos // 8, sibs || l || r, sha256(l || now || r) FROM inner_ f JOIN beside b ON f.g = b.g AND f.lev = b.lev AND f.pos = b.pos),
    outer_(doc_id, lev, pos, sibs, now) AS (SELECT i.doc_id, 0, h.pos, last(sibs ORDER BY lev), last(now ORDER BY lev) FROM inner_ i JOIN head h ON i.g = h.g GROUP BY i.doc_id, h.pos
          UNION ALL SELECT doc_id, f.lev + 1, f.pos // 8, sibs || l || r, sha256(l || now || r) FROM outer_ f JOIN beside b ON b.g = '' AND f.lev = b.lev AND f.pos = b.pos),
    done AS (SELECT doc_id, sha256(last(sibs ORDER BY lev)) AS proof_sha256, last(now ORDER BY lev) AS folded_root FROM outer_ GROUP BY doc_id)
    SELECT leaf.doc_id, leaf.leaf, head.subroot, top.digest AS root, proof_sha256, folded_root, folded_root = top.digest AS verified
    FROM leaf JOIN head ON leaf.g = head.g JOIN done ON leaf.doc_id = done.doc_id JOIN top ON top.n = 1"""

#: Every document in every order, and the step of its first failure.
AUDIT_SQL = """
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
    l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
          || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
          || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM w LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, fails, good, bad, count(*) AS n FROM f GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
    o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
    p AS (SELECT *, coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda q: strpos(filter_order, q))), 9) AS gone FROM c, o),
    s AS (SELECT *, substr(filter_order, step, 1) AS own FROM p, (SELECT unnest(range(1, 6)) AS step)),
    g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
          coalesce(sum(n) FILTER (gone < step AND contains(fails, own)), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
          coalesce(sum(n) FILTER (gone = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (gone = step AND bad), 0) AS toxic_lost FROM s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
      CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": WARC_SQL,
        "op4_substrings": SUBSTRINGS_SQL,
        "op9_embedding": EMBEDDING_SQL,
        "op11_merkle": MERKLE_SQL,
        "op12_filter_audit": AUDIT_SQL,
        "op6_exact": """
            WITH n AS (
              SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm,
                     CAST(length(coalesce(text, '')) AS BIGINT) AS points
              FROM documents),
            r AS (
              SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                     CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size
              FROM n)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r""",
    }
