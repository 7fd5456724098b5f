"""Registered queries of the training-data operators, one opN_<name> each.

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.chunk_codec import op10_bpe_codec
from palimpsest.llm.conversation_trie import op12_conversation_trie
from palimpsest.llm.discriminant import op3_quality_classifier
from palimpsest.llm.embedding_dedup import op6_embedding_dedup
from palimpsest.llm.jaccard_join import op9_ngram_jaccard_join
from palimpsest.llm.mixing import op13_source_mix
from palimpsest.llm.packing import op8_packing
from palimpsest.llm.periodic_runs import op11_periodic_runs
from palimpsest.llm.personal_data import op7_skip_chain_pii
from palimpsest.llm.quality_rules import quality_rules
from palimpsest.llm.token_files import op4_simple8b
from palimpsest.llm.toxicity import op5_toxicity
from palimpsest.llm.warc import op1_warc


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns, llr and kept of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), text=False)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simple8b": op4_simple8b,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_skip_chain_pii": op7_skip_chain_pii,
    "op8_packing": op8_packing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_mix": op13_source_mix,
}

_REVISITS = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM m"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
 r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = v.vec_id AS kept FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id"""

_SHINGLES = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS t FROM w),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

_MIX = """WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
 r(given, weights, stopped, k) AS (SELECT CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(-1 AS HUGEINT), 0
  UNION ALL SELECT t.given, t.weights, t.n, t.k FROM (SELECT r.k + 1 AS k, r.stopped, coalesce(sum(3 * source_size) FILTER (above), 0) AS given, coalesce(sum(w) FILTER (above), 0) AS weights, count(*) FILTER (above) AS n FROM
   (SELECT r.*, s.*, 3 * s.source_size * (z.w - r.weights) < (z.words - r.given) * s.w AS above FROM r, s, (SELECT sum(source_size) AS words, sum(w) AS w FROM s) AS z) AS r GROUP BY r.k, r.stopped) AS t WHERE t.n > t.stopped),
 e AS (SELECT given, weights FROM r ORDER BY k DESC LIMIT 1),
 z AS (SELECT sum(source_size) AS words, sum(w) AS weights, greatest(1, CAST(floor(sqrt(CAST(sum(source_size) AS DOUBLE)) / 16) AS BIGINT)) AS block FROM s),
 p AS (SELECT s.*, CASE WHEN 3 * source_size * (z.weights - e.weights) < (z.words - e.given) * w THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(z.words - e.given AS DOUBLE) / CAST(greatest(1, z.weights - e.weights) AS DOUBLE) * w END AS target FROM s, e, z),
 n AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS need FROM p),
 c AS (SELECT *, CAST(coalesce(sum(need) OVER (ORDER BY source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS low, CAST(sum(need) OVER () AS BIGINT) AS total FROM n),
 i AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS x FROM (SELECT unnest(range((SELECT CAST(max(total) AS BIGINT) FROM c) // block + CAST((SELECT max(total) FROM c) % block > 0 AS BIGINT))) AS i FROM z)),
 t AS (SELECT i, c.source, row_number() OVER (PARTITION BY c.source ORDER BY i) - 1 AS turn FROM i JOIN c ON need > 0 AND x >= CAST(low AS DOUBLE) / total AND (low + need >= total OR x < CAST(low + need AS DOUBLE) / total)),
 a AS (SELECT d.doc_id, d.source, d.size, c.source_size, c.target, c.need, row_number() OVER () AS line, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
 u AS (SELECT *, unnest(range(3)) * source_size + place AS first FROM a WHERE size > 0),
 v AS (SELECT line, source, unnest(range(first // block, (least(first + size, need) - 1) // block + 1)) AS turn, first, least(first + size, need) AS ends, block FROM u, z WHERE first < need),
 q AS (SELECT line, CAST(sum(least(ends, (v.turn + 1) * block) - greatest(first, v.turn * block)) AS BIGINT) AS taken, min(coalesce(i, (SELECT count(*) FROM i) + v.turn)) AS first_slot FROM v LEFT JOIN t ON t.source IS NOT DISTINCT FROM v.source AND t.turn = v.turn GROUP BY line)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot FROM a LEFT JOIN q USING (line)"""

_TRIE = """WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
 h AS (SELECT c, count(*) AS n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x = -1 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, x) END), 4294967295) % 4 AS h FROM t GROUP BY c),
 k AS (SELECT a.c, a.n, a.h, least(a.h, coalesce(b.n, 0)) AS k FROM h AS a LEFT JOIN h AS b ON b.c = a.c - a.c % 20),
 r AS (SELECT k.c, pos + 1 AS d, role, text FROM k JOIN t ON t.c = k.c - k.c % 20 AND pos < h UNION ALL SELECT k.c, k + pos - h + 1, role, text FROM k JOIN t ON t.c = k.c AND pos >= h),
 p AS MATERIALIZED (SELECT c, d, string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS key, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS w, k + greatest(0, n - h) AS total FROM r JOIN k USING (c) UNION ALL SELECT c, 0, '', 0, k + greatest(0, n - h) FROM k),
 n AS MATERIALIZED (SELECT key, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = total), '')) AS ends_sha256 FROM p GROUP BY key),
 u AS MATERIALIZED (SELECT n.key, q.conv_id AS parent_conv_id, q.key AS parent FROM n JOIN p ON p.c = n.conv_id AND p.d = n.depth - 1 JOIN n AS q ON q.key = p.key),
 m AS (SELECT parent AS key, count(*) AS n_children FROM u GROUP BY parent),
 s AS (SELECT p.key, sum(n.saved) AS saved_tokens, count(*) FILTER (m.key IS NULL) AS n_leaves FROM n JOIN p ON p.c = n.conv_id AND p.d <= n.depth LEFT JOIN m ON m.key = n.key GROUP BY p.key)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM n JOIN s USING (key) LEFT JOIN u USING (key) LEFT JOIN m USING (key)"""

ORACLES: dict[str, str] = {"op12_conversation_trie": _TRIE, "op13_source_mix": _MIX, "op1_warc": _REVISITS, "op6_embedding_dedup": _VECTORS, "op9_ngram_jaccard_join": _SHINGLES}
