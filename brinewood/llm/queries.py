"""The queries of this subpackage, by name, for the table of queries at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, licenses, mixing, packing, prefix_tries, quality, resampling, secrets, sharding, simhash, topk, toxicity
from .common import table


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op7_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.digest(packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# RE2 has no look-behind: names are marked in two passes, since a match takes the letter before the next one.
_MARKED = r"regexp_replace({}, '([\p{{Ll}},;:] )(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || '\2', 'g')"
_OPENED = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}\x01])(\p{{Lu}}\p{{Ll}})', '\1' || chr(2) || '\2', 'g')"
_KIND = f"""CASE WHEN starts_with(x, chr(1)){{}} THEN '<name>' WHEN regexp_matches(x, '^\\p{{{{N}}}}') THEN '<number>'
    WHEN i > 1 AND regexp_matches(w[i - 1], '^\\p{{{{N}}}}') AND x IN ({", ".join(f"'{u}'" for u in decontaminate.UNITS)}) THEN '<unit>' END"""
_LEAKS = f"""
WITH src AS (SELECT 'd' AS k, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT DISTINCT k, id, regexp_extract_all(lower({_OPENED.format(_MARKED.format(_MARKED.format("text")))}), '[\\x01\\x02]?\\p{{L}}[\\p{{L}}\\p{{N}}]*|\\p{{N}}+(?:[.,]\\p{{N}}+)*') AS w FROM src),
t AS (SELECT k, id, len(w) AS n, list_transform(w, lambda x: ltrim(x, chr(1) || chr(2))) AS p,
  list_transform(w, lambda x, i: {_KIND.format("")}) AS strict, list_transform(w, lambda x, i: {_KIND.format(" OR starts_with(x, chr(2))")}) AS loose FROM w WHERE len(w) > 0),
sizes AS (SELECT DISTINCT least(n, 5) AS size FROM t WHERE k = 'b' UNION SELECT 5),
spots AS (SELECT t.*, size, unnest(range(0, n - size + 1)) AS pos FROM t, sizes WHERE n >= size AND (size > 1 OR n = 1) AND (k = 'd' OR size = least(n, 5))),
x AS (SELECT k, id, n, size, pos, p[pos + 1 : pos + size] AS pw, strict[pos + 1 : pos + size] AS ks, loose[pos + 1 : pos + size] AS kl FROM spots),
tmpl AS (SELECT DISTINCT k, id, n, pos, pw, list_transform(kk, lambda y, i: coalesce(y, pw[i])) AS tw
  FROM (SELECT *, ks AS kk FROM x WHERE size = 5 UNION ALL SELECT *, kl FROM x WHERE size = 5) WHERE len(list_filter(kk, lambda y: y IS NOT NULL)) BETWEEN 1 AND 4),
plain AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, b.n AS n, b.pos AS bpos FROM (SELECT DISTINCT id, pw FROM x WHERE k = 'd') d JOIN x b ON b.k = 'b' AND d.pw = b.pw),
hits AS (SELECT d.id AS doc_id, b.id AS item_id, b.n AS n, b.pos AS bpos, d.pos - b.pos AS diagonal, b.pw AS bk, d.pw AS dk FROM tmpl d JOIN tmpl b ON d.k = 'd' AND b.k = 'b' AND d.tw = b.tw),
slots AS (SELECT DISTINCT doc_id, item_id, diagonal, bk[i] AS b, dk[i] AS d FROM (SELECT *, unnest(range(1, len(bk) + 1)) AS i FROM hits)),
told AS (SELECT doc_id, item_id, diagonal, count(*) <> count(DISTINCT b) OR count(*) <> count(DISTINCT d) AS torn, count(*) FILTER (b <> d) AS n_slots FROM slots GROUP BY ALL),
places AS (SELECT DISTINCT doc_id, item_id, n, bpos, n_slots FROM hits JOIN told USING (doc_id, item_id, diagonal) WHERE NOT torn UNION SELECT doc_id, item_id, n, bpos, 0 FROM plain),
covered AS (SELECT doc_id, item_id, count(DISTINCT word) AS c FROM (SELECT doc_id, item_id, unnest(range(bpos, least(bpos + 5, n))) AS word FROM places) GROUP BY ALL),
found AS (SELECT doc_id, item_id, any_value(n) AS n, count(DISTINCT bpos) AS n_windows, max(n_slots) AS n_slots FROM places GROUP BY ALL)
SELECT doc_id, item_id, c / n AS coverage, n_windows, n_slots FROM found JOIN covered USING (doc_id, item_id) WHERE c / n >= 0.8
"""

# CRC-32 by its table of 256 words, as a list; {} is a list of bytes.
_CRC_TABLE = """crc_words AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""
_CRC = "xor(list_reduce([CAST(4294967295 AS BIGINT)] || {}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), CAST(4294967295 AS BIGINT))"
_UTF8 = "list_transform(range(0, CAST(length(hex(encode({0}))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"

_TRIE = f"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
  md5(coalesce(role, '')) || md5(coalesce(text, '')) AS turn, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn ORDER BY k) AS turns, list(size ORDER BY k) AS sizes FROM o GROUP BY conv_id),
lend AS (SELECT own.*, {_CRC.format(_UTF8.format("CAST(conv_id AS VARCHAR)"))} % 9 AS h FROM own, crc_words),
r AS (SELECT c.conv_id, coalesce(d.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns, coalesce(d.sizes[1:c.h], []) || c.sizes[c.h + 1:] AS sizes
  FROM lend c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, turns, sizes, unnest(range(0, len(turns) + 1)) AS depth FROM r),
q AS (SELECT conv_id, depth, array_to_string(turns[1:depth], ',') AS node, array_to_string(turns[1:depth - 1], ',') AS above, coalesce(sizes[depth], 0) AS size, depth = len(turns) AS ends FROM p),
n AS (SELECT depth, node, any_value(above) AS above, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, node)),
below AS (SELECT a.depth, a.node, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved_tokens
  FROM m a JOIN m b ON b.depth = a.depth AND b.node = a.node OR b.depth > a.depth AND (a.depth = 0 OR starts_with(b.node, a.node || ',')) GROUP BY a.depth, a.node)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN below USING (depth, node) LEFT JOIN m up ON up.depth = m.depth - 1 AND up.node = m.above
"""

_RESAMPLE = f"""
WITH {_CRC_TABLE},
src AS (SELECT 'd' AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT row_number() OVER () AS row, side, doc_id, regexp_extract_all(translate(text, '{resampling.UPPER}', '{resampling.LOWER}'), '{resampling.WORDS}') AS w FROM src),
spots AS (SELECT row, side, unnest(w) AS word FROM w),
known AS (SELECT word, {_CRC.format(_UTF8.format("word"))} % 10000 AS bucket FROM (SELECT DISTINCT word FROM spots), crc_words),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM spots JOIN known USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counts),
weights AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM spots JOIN known USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
x AS (SELECT row, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN weights USING (row) WHERE side = 'd'),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""

#: DuckDB SQL of the queries that SQL expresses.
ORACLE: dict[str, str] = {"op3_exact_top_k": _TOP_K, "op9_decontaminate": _LEAKS, "op11_prefix_trie": _TRIE, "op13_importance_resampling": _RESAMPLE}
