"""One query per operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import (
    byte_bpe,
    decontaminate,
    dual_tree,
    language_mixture,
    learned_partitions,
    license_join,
    lm_interpolation,
    merkle_audit,
    merkle_manifest,
    ngram_product,
    simhash,
    token_counts,
    vector_packing,
)
from fieldweave.llm.common import held_out, share_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@_query
def op3_license_join(spark, folder):
    docs = _table(spark, folder, "documents")
    return license_join.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_query
def op4_language_mixture(spark, folder):
    docs = _table(spark, folder, "documents")
    test = held_out(F.col("doc_id"), 4, 2)
    model = language_mixture.train(docs, where=~test)
    found = language_mixture.predict(docs, model)
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score")


@_query
def op5_decontaminate(spark, folder):
    found = decontaminate.find_hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), unnamed=True)
    items = F.col("items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op5_decontaminate"] = """
WITH d AS (SELECT doc_id, row_number() OVER () AS uid,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
    FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT uid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
    FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.uid, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
p AS (SELECT uid, count(DISTINCT j) AS n FROM (SELECT uid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT uid, i, k FROM h)) GROUP BY uid),
t AS (SELECT uid, count(item) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT uid, item FROM h) GROUP BY uid)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
    sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.uid = p.uid LEFT JOIN t ON d.uid = t.uid
"""


@_query
def op7_byte_bpe(spark, folder):
    return byte_bpe.encode_texts(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern(), ids=False, digests=True)


@_query
def op8_token_counts(spark, folder):
    return token_counts.count_tokens(_table(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"))


@_query
def op9_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op1_interpolated_lm(spark, folder):
    return lm_interpolation.score_texts(_table(spark, folder, "documents"), test=held_out(F.col("doc_id"), 7, 2))


@_query
def op10_vector_packing(spark, folder):
    return vector_packing.assign_shards(_table(spark, folder, "documents"))


@_query
def op2_learned_partitions(spark, folder):
    return learned_partitions.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op6_merkle_audit(spark, folder):
    """Pages as archive records against a replica in which some were altered, lost or cut short."""
    kind = F.col("page_id") % 97
    head = F.length("record") - 5
    damaged = (
        F.when(kind == 17, F.lit(None))
        .when(kind == 5, F.regexp_replace("record", "Content-Length", "content-length"))
        .when(kind == 41, F.concat(F.substring(F.col("record"), F.lit(1), head), F.lit("\r\n\r\n")))
        .otherwise(F.col("record"))
    )
    records, left, right = merkle_audit.page_manifests(_table(spark, folder, "pages"), damaged)
    found = merkle_audit.audit(left, right)
    return found.join(records, ["archive", "offset"]).select("page_id", "archive", F.col("offset").alias("start_offset"), "length", "kind")


ORACLES["op6_merkle_audit"] = """
WITH r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' ||
    coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
    'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) ||
    coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
p AS (SELECT *, CASE page_id % 97 WHEN 17 THEN NULL WHEN 5 THEN replace(record, 'Content-Length', 'content-length')
    WHEN 41 THEN substr(record, 1, length(record) - 5) || chr(13) || chr(10) || chr(13) || chr(10) ELSE record END AS replica,
    CAST(octet_length(encode(record)) AS BIGINT) AS len, row_number() OVER (ORDER BY page_id, sha256(record)) - 1 AS n FROM r),
o AS (SELECT *, CAST(n // 1024 AS BIGINT) AS archive,
    CAST(coalesce(sum(len) OVER (PARTITION BY n // 1024 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM p)
SELECT page_id, archive, start_offset, len AS length,
    CASE WHEN replica IS NULL THEN 'missing' WHEN octet_length(encode(replica)) <> len THEN 'length' ELSE 'content' END AS kind
FROM o WHERE replica IS NULL OR replica <> record
"""


@_query
def op12_merkle_manifest(spark, folder):
    docs = _table(spark, folder, "documents")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle_manifest.prove(docs, {"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), F.col("folded").eqNullSafe(F.col("root")).alias("verified"),
    )


# crc: bit by bit over the decimal digits, reflected polynomial 0xEDB88320
ORACLES["op12_merkle_manifest"] = """
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS ds FROM documents),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(ds) + 1),
        lambda i: [ascii(substr(ds, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384::BIGINT) ELSE xor(a, x) >> 1 END), 4294967295::BIGINT) AS crc FROM d),
h AS (SELECT doc_id, lang, n_chars, crc, coalesce(CAST(octet_length(encode(ds)) AS VARCHAR) || ':' || ds, '-')
        || coalesce(CAST(octet_length(encode(source)) AS VARCHAR) || ':' || source, '-')
        || coalesce(CAST(octet_length(encode(lang)) AS VARCHAR) || ':' || lang, '-') AS head,
    coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || text, '-') AS tail FROM c),
v AS (SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(length(CAST(n_chars + k AS VARCHAR)) || ':' || (n_chars + k), '-') || tail) AS start
    FROM (SELECT *, CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS k FROM h)),
g AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) AS t, count(*) OVER () AS trees FROM (SELECT lang, count(*) AS size FROM documents GROUP BY lang)),
l AS (SELECT v.*, g.t, g.size, g.trees, row_number() OVER (PARTITION BY g.t ORDER BY doc_id NULLS FIRST, leaf, start) - 1 AS p,
    row_number() OVER () AS uid FROM v JOIN g ON v.lang IS NOT DISTINCT FROM g.lang),
low AS (SELECT 0 AS lvl, t, p, leaf AS hash, size FROM l
    UNION ALL SELECT lvl + 1, t, p // 2, sha256(string_agg(hash, '' ORDER BY p)), max((size + 1) // 2) FROM low WHERE size > 1 GROUP BY lvl, t, p // 2),
sub AS (SELECT t, lvl, hash FROM low WHERE size = 1),
up AS (SELECT 0 AS lvl, CAST(0 AS BIGINT) AS t, t - 1 AS p, hash, (SELECT max(trees) FROM g) AS size FROM sub
    UNION ALL SELECT lvl + 1, t, p // 2, sha256(string_agg(hash, '' ORDER BY p)), max((size + 1) // 2) FROM up WHERE size > 1 GROUP BY lvl, t, p // 2),
nodes AS (SELECT t, lvl, p, hash, size FROM low UNION ALL SELECT t, lvl, p, hash, size FROM up),
climb AS (SELECT uid, doc_id, leaf, start AS folded, '' AS proof, t, 0 AS lvl, p, size, t AS own FROM l
    UNION ALL SELECT c.uid, c.doc_id, c.leaf,
        CASE WHEN c.size = 1 THEN c.folded WHEN c.p % 2 = 1 THEN sha256(s.hash || c.folded) ELSE sha256(c.folded || coalesce(s.hash, '')) END,
        CASE WHEN c.size = 1 THEN c.proof ELSE c.proof || coalesce(s.hash, '') END,
        CASE WHEN c.size = 1 THEN 0 ELSE c.t END, CASE WHEN c.size = 1 THEN 0 ELSE c.lvl + 1 END,
        CASE WHEN c.size = 1 THEN c.t - 1 ELSE c.p // 2 END,
        CASE WHEN c.size = 1 THEN (SELECT max(trees) FROM g) ELSE (c.size + 1) // 2 END, c.own
    FROM climb c LEFT JOIN nodes s ON s.t = c.t AND s.lvl = c.lvl AND s.p = xor(c.p, 1) WHERE c.t > 0 OR c.size > 1),
root AS (SELECT hash FROM up WHERE size = 1)
SELECT c.doc_id, c.leaf, sub.hash AS subroot, root.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root.hash AS verified
FROM climb c JOIN sub ON sub.t = c.own, root WHERE c.t = 0 AND c.size = 1
"""


@_query
def op11_ngram_product(spark, folder):
    return ngram_product.linked_documents(_table(spark, folder, "documents"))


ORACLES["op11_ngram_product"] = """
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS uid,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT uid, array_to_string(list_slice(w, i, i + 3), ' ') AS g
    FROM (SELECT uid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT uid, count(*) AS n FROM s GROUP BY uid),
o AS (SELECT a.uid AS x, b.uid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.uid <> b.uid GROUP BY a.uid, b.uid),
e AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.uid = x JOIN n q ON q.uid = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT uid AS x, uid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT r.x, min(d.doc_id) AS component_id FROM r JOIN d ON d.uid = r.y GROUP BY r.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d JOIN m ON m.x = d.uid LEFT JOIN n ON n.uid = d.uid
"""


@_query
def op13_dual_tree(spark, folder):
    return dual_tree.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


ORACLES["op13_dual_tree"] = """
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS uid,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM (SELECT DISTINCT item_id, text FROM benchmark)),
t AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
f AS MATERIALIZED (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM d) GROUP BY uid, term),
x AS (SELECT term, CAST(floor(1000 * ln((2 * t.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight
    FROM (SELECT term, count(*) AS df FROM f GROUP BY term), t),
q AS (SELECT item, term, count(*) AS c FROM (SELECT item, unnest(w) AS term FROM i) GROUP BY item, term),
s AS (SELECT q.item, f.uid, CAST(sum(q.c * x.weight * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * len(d.w) * t.n) // t.l)))) AS BIGINT) AS score
    FROM q JOIN x ON x.term = q.term JOIN f ON f.term = q.term JOIN d ON d.uid = f.uid, t GROUP BY q.item, f.uid),
r AS (SELECT i.item_id, CAST(row_number() OVER (PARTITION BY s.item ORDER BY s.score DESC, d.doc_id NULLS LAST) AS INTEGER) AS rank, d.doc_id, s.score
    FROM s JOIN d ON d.uid = s.uid JOIN i ON i.item = s.item WHERE s.score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
