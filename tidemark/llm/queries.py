"""Queries opN_<name> over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat_format, decontaminate, embed_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, pii, prefix_trie, suffix_dedup, token_align, topk
from tidemark.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.maximal(table(spark, sf_dir, "conversations"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


def op12_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_html_extract": op2_html_extract,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_topk": op10_topk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_embed_dedup": op12_embed_dedup,
    "op13_token_align": op13_token_align,
}

SQL: dict[str, str] = {
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
        h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
        p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
                     string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER w AS rendered
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
        whole AS (SELECT n_turns, rendered, min(conv_id) AS conv_id, count(*) - 1 AS n_collapsed FROM p WHERE n = n_turns GROUP BY n_turns, rendered)
        SELECT conv_id, n_turns, n_collapsed, rendered FROM whole
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n < p.n_turns AND p.n = whole.n_turns AND p.rendered = whole.rendered)""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_prefix_trie": r"""
        WITH RECURSIVE crc(k, i, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT k, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE i < 8),
        tab AS (SELECT list(v ORDER BY k) AS t FROM crc WHERE i = 8),
        o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                     md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
                     len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
              FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 20 AS family,
                     xor(list_reduce([ord(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')], lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295) % 4 AS n
              FROM (SELECT DISTINCT conv_id FROM o), tab),
        r AS (SELECT c.conv_id, 0 AS part, o.pos, h, words FROM c JOIN o ON o.conv_id = c.family AND o.pos <= n
              UNION ALL SELECT c.conv_id, 1, o.pos, h, words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > n),
        p AS (SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(h, '/') OVER w AS path, words FROM r
              WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT conv_id, depth, n, path, words FROM p
              UNION ALL SELECT c.conv_id, 0, coalesce((SELECT max(n) FROM p WHERE p.conv_id = c.conv_id), 0), '', 0 FROM c),
        nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM m GROUP BY depth, path),
        up AS (SELECT *, CASE WHEN depth <= 1 THEN '' ELSE left(path, length(path) - 33) END AS above FROM nodes),
        kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
        full_nodes AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (depth, path)),
        sums AS (SELECT a.depth, a.path, CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
                 FROM full_nodes a JOIN full_nodes b ON b.depth >= a.depth AND left(b.path, length(a.path)) = a.path GROUP BY 1, 2)
        SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
        FROM full_nodes f JOIN sums USING (depth, path) LEFT JOIN full_nodes q ON f.depth > 0 AND q.depth = f.depth - 1 AND q.path = f.above""",
    "op12_embed_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
        l AS (SELECT a.vec_id AS s, b.vec_id AS t FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.t, r.c FROM r JOIN l ON r.id = l.s),
        m AS (SELECT id AS vec_id, min(c) AS component_id FROM r GROUP BY id),
        n AS (SELECT s AS vec_id, count(*) AS n_links FROM l GROUP BY s)
        SELECT m.vec_id, coalesce(n_links, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)""",
}
