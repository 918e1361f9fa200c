"""One registered query for each training-data operator, and its SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parleo.llm import decontaminate, langid, lm_score, minhash, packing, prefix_trie, quality, secret_scan, simhash, suffix_dedup, toxicity, warc, whitening
from parleo.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op3_toxicity")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf, "documents"), load(spark, sf, "labels"))


OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 15 * word_chars OR 10 * n_dup_lines > 5 * n_lines
       OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept FROM m"""


@query("op6_quality_rules", OP6)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(load(spark, sf, "documents")))
    failed = rows.fail_bits.bitwiseAND(quality.mask("base")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


OP7 = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""


@query("op7_decontamination", OP7)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    rows = decontaminate.contamination(load(spark, sf, "documents"), load(spark, sf, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(load(spark, sf, "documents"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return secret_scan.scan(docs, secret_scan.learn(docs))


@query("op10_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(h) AS n, sha1(h) AS digest, max(page_id) OVER (PARTITION BY sha1(h)) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM q""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(load(spark, sf, "pages")).drop("payload")


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(load(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e2.y, r.root FROM r JOIN e2 ON e2.x = r.doc_id WHERE r.root < e2.y),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@query("op5_minhash", OP5)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.groups(load(spark, sf, "documents"), size=4)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.deduplicate(load(spark, sf, "documents")).drop("kept")


@query("op4_lm_score")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score(load(spark, sf, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(load(spark, sf, "embeddings"))


@query("op12_simhash")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.groups(load(spark, sf, "documents")).drop("kept")


OP11 = """
WITH RECURSIVE c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS v FROM c
  UNION ALL SELECT conv_id, s, i + 1, CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END
    FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE v END AS u FROM crc WHERE i < 8 * length(s))),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(s)),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT h.conv_id, h.h, h.base, least(h.h, coalesce(n.n, 0)) AS k FROM h LEFT JOIN (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) n ON n.conv_id = h.base),
re AS (SELECT k.conv_id, t.p AS d, r, x FROM k JOIN t ON t.conv_id = k.base AND t.p <= k.k
  UNION ALL SELECT t.conv_id, k.k + t.p - k.h, r, x FROM t JOIN k ON k.conv_id = t.conv_id WHERE t.p > k.h),
pre AS (SELECT conv_id, d, x, list({'r': r, 'x': x}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM re),
node AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, any_value(length(x)) AS len FROM pre GROUP BY d, path
  UNION ALL SELECT 0, CAST([] AS STRUCT(r VARCHAR, x VARCHAR)[]), min(conv_id), count(*), 0 FROM c HAVING count(*) > 0),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
leafy AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.path = node.path),
sub AS (SELECT path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * len) AS saved
        FROM (SELECT path, n, len, n_children, unnest(range(0, d + 1)) AS up FROM leafy) GROUP BY 1),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
      FROM (SELECT c.conv_id, coalesce(q.path, CAST([] AS STRUCT(r VARCHAR, x VARCHAR)[])) AS path FROM c LEFT JOIN (SELECT conv_id, arg_max(path, d) AS path FROM pre GROUP BY conv_id) q ON q.conv_id = c.conv_id) GROUP BY path)
SELECT v.conv_id, v.d::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, sub.n_leaves::BIGINT AS n_leaves,
  sub.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM leafy v JOIN sub ON sub.path = v.path LEFT JOIN e ON e.path = v.path LEFT JOIN node u ON v.d > 0 AND u.path = v.path[1:v.d - 1]"""


@query("op11_prefix_trie", OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(load(spark, sf, "conversations"))
