"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import audio, chat_collapse, conversation_trie, cube_mix, decontamination, hash_tree, ngram_join, packing, quality_rules, sequenced_changes, toxicity, url_graph, warc
from spanloom.llm.common import table


def op1_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest_texts(table(spark, sf_dir, "documents"))


def op4_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.stored_ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(book).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits"
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the stored ledger."""
    book = quality_rules.stored_ledger(table(spark, sf_dir, "documents"))
    first, *others = (quality_rules.ablation(book, p) for p in quality_rules.POLICIES)
    for other in others:
        first = first.unionByName(other)
    return first


OP3_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
), m AS (
  SELECT *,
    list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM t
), p AS (
  SELECT r, i, row(w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3)
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1
), c AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY r
), f AS (
  SELECT doc_id, len(w) AS n_words,
    length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS n_upper
  FROM m LEFT JOIN c USING (r)
), b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (10 * n_symbols > 2 * n_words)::INT + 8 * (10 * n_dup_lines > 3 * n_lines)::INT
    + 16 * (word_chars > 14 * n_words OR word_chars < 2 * n_words)::INT + 32 * (2 * n_upper > word_chars)::INT AS bits
  FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS bits
FROM b
"""


ABLATION_SQL = f"""
WITH k AS (SELECT bits FROM ({OP3_SQL})), r AS (SELECT * FROM (VALUES ('base', 'few_words', 1, 3), ('base', 'repeated_windows', 2, 3),
  ('2025.1', 'few_words', 1, 63), ('2025.1', 'repeated_windows', 2, 63), ('2025.1', 'symbols', 4, 63), ('2025.1', 'duplicate_lines', 8, 63),
  ('2025.1', 'word_length', 16, 63), ('2025.1', 'upper_case', 32, 63)) AS v(policy, rule, bit, mask))
SELECT policy, rule, count(*) FILTER (bits & bit <> 0) AS failing, count(*) FILTER (bits & mask = bit) AS failing_only,
  count(*) FILTER (bits & mask & ~bit = 0) AS kept_without FROM r, k GROUP BY 1, 2
"""


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.place(table(spark, sf_dir, "documents"))


def op10_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse(table(spark, sf_dir, "conversations"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), p AS (
  SELECT conv_id, k, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY k) AS rendered FROM t
), whole AS (
  SELECT min(conv_id) AS conv_id, n, count(*) AS copies, rendered FROM p WHERE k = n GROUP BY n, rendered
)
SELECT conv_id, n::BIGINT AS n_turns, copies::BIGINT AS copies, rendered FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n AND p.rendered = w.rendered)
"""


def op5_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.fresh_root(spark)
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT payload_digest, max(page_id) AS stored FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN stored <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN stored <> page_id THEN stored END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), width=3, percent=90)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.c
), m AS (
  SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op11_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced_changes.apply_all(table(spark, sf_dir, "client_changes"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, length(coalesce(text, '')) AS n, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(
      list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))), 4294967295::BIGINT), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)
), f AS (
  SELECT h.c, t.k AS d, n, x FROM h JOIN t ON t.c = h.base AND t.k <= h.h
), r AS (
  SELECT * FROM f UNION ALL
  SELECT t.c, t.k - h.h + coalesce(m, 0), n, x FROM t JOIN h ON h.c = t.c AND t.k > h.h LEFT JOIN (SELECT c, max(d) AS m FROM f GROUP BY c) AS g ON g.c = t.c
), p AS (
  SELECT c, d, n, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS p FROM r UNION ALL SELECT c, 0, 0, '' FROM h
), e AS (
  SELECT d, p, string_agg(c::VARCHAR, ',' ORDER BY c) AS e FROM (SELECT *, max(d) OVER (PARTITION BY c) AS l FROM p) WHERE d = l GROUP BY d, p
), v AS (
  SELECT d, p, min(c) AS c, count(*) AS m, (count(*) - 1) * min(n) AS s FROM p GROUP BY d, p
), k AS (
  SELECT v.*, coalesce(w.n, 0) AS kids FROM v LEFT JOIN (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n FROM v WHERE d > 0 GROUP BY 1) AS w ON w.p = v.p
), u AS (
  SELECT left(p, 32 * a) AS p, count(*) FILTER (kids = 0) AS leaves, sum(s) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM k) GROUP BY 1
)
SELECT k.c AS conv_id, k.d AS depth, q.c AS parent_conv_id, k.m AS n_convs, k.kids::BIGINT AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(e.e, '')) AS ends_sha256
FROM k JOIN u ON u.p = k.p LEFT JOIN e ON e.p = k.p LEFT JOIN k AS q ON k.d > 0 AND q.p = left(k.p, 32 * (k.d - 1))
"""


def op13_benchmark_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, least(10, len(w)) AS l, w FROM (SELECT item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark) WHERE len(w) > 0
), k AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM b)
), e AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d JOIN (SELECT DISTINCT l FROM k) ON len(w) >= l)
), m AS (
  SELECT r, e.l, i, item_id FROM e JOIN k USING (l, s)
), h AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + l)) AS j FROM (SELECT DISTINCT r, l, i FROM m)) GROUP BY r
), t AS (
  SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.x, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


def queries() -> dict:
    return {
        "op1_url_link_graph": op1_url_link_graph,
        "op2_audio_features": op2_audio_features,
        "op3_rule_ledger": op3_rule_ledger,
        "rule_ablation": rule_ablation,
        "op4_toxicity_ordinal": op4_toxicity_ordinal,
        "op5_warc_writer": op5_warc_writer,
        "op6_cube_mix": op6_cube_mix,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_hash_tree": op8_hash_tree,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_chat_collapse": op10_chat_collapse,
        "op11_sequenced_changes": op11_sequenced_changes,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_benchmark_winnowing": op13_benchmark_winnowing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_rule_ledger": OP3_SQL, "rule_ablation": ABLATION_SQL, "op5_warc_writer": OP5_SQL, "op7_ngram_jaccard": OP7_SQL, "op10_chat_collapse": OP10_SQL, "op12_conversation_trie": OP12_SQL, "op13_benchmark_winnowing": OP13_SQL}
