"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.byte_bpe import bpe_round_trip
from ledgerloom.llm.conversation import damaged, repair_conversations, repair_report
from ledgerloom.llm.embed_dedup import embedding_near_dedup
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.html_extract import extract_main_text
from ledgerloom.llm.line_dedup import line_run_dedup
from ledgerloom.llm.ngram_join import ngram_jaccard_join
from ledgerloom.llm.packing import best_fit_packing
from ledgerloom.llm.quality import quality_scores
from ledgerloom.llm.resample import importance_resample
from ledgerloom.llm.token_counts import token_counts
from ledgerloom.llm.toxicity import toxicity_scores
from ledgerloom.llm.url_filter import url_filter


def tokenizer_file(name: str) -> str:
    """The file of a public tokenizer, in the folder $LEDGERLOOM_TOKENIZERS or else that of public_tokenizers."""
    folder = os.environ.get("LEDGERLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_run_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), byte_pattern())


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(repair_conversations(damaged(_table(spark, sf_dir, "conversations")), "is_row"))


_OPERATORS = (
    op1_ngram_jaccard_join,
    op2_quality_classifier,
    op3_toxicity,
    op4_line_dedup,
    op5_byte_bpe,
    op6_embedding_near_dedup,
    op7_best_fit_packing,
    op8_url_filter,
    op9_exact_dedup,
    op10_token_counts,
    op11_importance_resample,
    op12_html_extraction,
    op13_conversation_repair,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The table of CRC-32 (polynomial 0xEDB88320), as a list of 256 numbers.
_CRC = "SELECT list_transform(range(256), lambda i: list_reduce(range(1, 9), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT)) AS t"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (*_OPERATORS, pipeline)}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": r"""
        WITH s AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
        l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM s),
        w AS (SELECT *, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS words FROM l),
        p AS (
            SELECT a.doc_id, a.i, a.words, b.doc_id AS other, a.i - b.i AS shift,
                   a.i - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.i - b.i ORDER BY a.i) AS island
            FROM w a JOIN w b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))
        ), r AS (SELECT doc_id, min(i) AS i0, max(i) AS i1 FROM p GROUP BY doc_id, other, shift, island HAVING sum(words) >= 50),
        g AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(i0, i1 + 1)) AS i FROM r)),
        k AS (
            SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept, count(*) AS n_lines, count(g.i) AS n_deleted
            FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
        )
        SELECT s.doc_id, CASE WHEN n_deleted = 0 THEN s.text ELSE coalesce(kept, '') END AS text, n_lines, n_deleted
        FROM s JOIN k ON s.doc_id = k.doc_id
    """,
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ), ok AS (
            SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
            WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
        ), reach AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_importance_resample": r"""
        WITH crc_table AS (
            @CRC
        ), d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
        ), b AS (
            SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
        ), dw AS (SELECT doc_id, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
        h AS (SELECT word, hex(word) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        y AS (SELECT word, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i::BIGINT, 2))::BIGINT) AS bytes FROM h),
        v AS (
            SELECT word, xor(list_reduce(bytes, lambda c, y: xor(c // 256, t[(xor(c % 256, y) + 1)::INT]), 4294967295), 4294967295) % 10000 AS bucket
            FROM y, crc_table
        ), s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
        g AS (
            SELECT s.bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM s LEFT JOIN t ON s.bucket = t.bucket
        ), w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY doc_id),
        r AS (
            SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(w.weight, 0) AS weight,
                   coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM d LEFT JOIN w ON d.doc_id = w.doc_id
        ), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20)
        SELECT r.*, CASE WHEN k.rank <= (SELECT count(*) FROM k) * 10 // 100 THEN k.rank END AS rank FROM r LEFT JOIN k ON r.doc_id = k.doc_id
    """.replace("@CRC", _CRC),
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc_table AS (
            @CRC
        ), x AS (
            SELECT *, coalesce(role, ' ') AS r, coalesce(text, ' ') AS s, hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS x FROM conversations
        ), k AS (
            SELECT x.*, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i::BIGINT, 2))::BIGINT), lambda c, y: xor(c // 256, t[(xor(c % 256, y) + 1)::INT]), 4294967295), 4294967295) % 20 AS kind
            FROM x, crc_table
        ), d AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(s, '[.!?]', '', 'g') ELSE s END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM k WHERE kind <> 0
        ), n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
            FROM d
        ), f AS (
            SELECT *, substr(role, 1, 1) AS c, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                   lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS follower
            FROM n
        ), follows(q, c, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        nexts(q, q2) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
        hops(q, edits, cost, q2) AS (VALUES (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 4, 3), (1, '', 0, 1), (1, 'I', 2, 2), (1, 'II', 4, 3), (2, '', 0, 2), (2, 'I', 2, 3), (3, '', 0, 3), (3, 'I', 2, 2)),
        moves AS (
            SELECT conv_id, i, m.q, m.edit || h.edits AS edits, m.cost + h.cost AS cost, h.q2
            FROM (
                SELECT conv_id, i, q, 'D' AS edit, 3 AS cost, q AS q2 FROM f, range(4) AS s(q)
                UNION ALL SELECT conv_id, i, q, 'R', 2 + (fault = 3)::INT, q2 FROM f, nexts WHERE fault IN (0, 3)
                UNION ALL SELECT conv_id, i, q, 'K', (fault = 3)::INT, q2 FROM f JOIN follows USING (c) WHERE fault IN (0, 3)
            ) m JOIN hops h ON m.q2 = h.q
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS i, q2::BIGINT AS q, {'cost': cost::BIGINT, 'audit': edits} AS best FROM (SELECT DISTINCT conv_id FROM conversations), hops WHERE q = 0
            UNION ALL
            SELECT w.conv_id, m.i, m.q2::BIGINT, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.edits})
            FROM walk w JOIN moves m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1 AND m.q = w.q GROUP BY w.conv_id, m.i, m.q2
        ), g AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
                   count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (c || follower NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv_id
        ), e AS (
            SELECT w.conv_id, min(best) AS best FROM walk w LEFT JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id
            WHERE w.i = coalesce(g.n, 0) AND w.q IN (0, 3) GROUP BY w.conv_id
        ), letters AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS pos FROM e),
        p AS (
            SELECT conv_id, pos, substr(audit, pos, 1) AS edit, count(*) FILTER (substr(audit, pos, 1) <> 'I') OVER w AS i, count(*) FILTER (substr(audit, pos, 1) <> 'D') OVER w AS o
            FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
        ), o AS (
            SELECT p.*, f.role, f.text, (max((p.o = 1 AND p.edit = 'K' AND f.c = 's')::INT) OVER (PARTITION BY p.conv_id)) AS lead
            FROM p LEFT JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i AND p.edit <> 'I'
        ), t AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS text
            FROM o WHERE edit <> 'D' GROUP BY conv_id
        )
        SELECT e.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, best.cost AS cost, best.audit AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
        FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN t ON e.conv_id IS NOT DISTINCT FROM t.conv_id
    """.replace("@CRC", _CRC),
    # what the given pages, all of one build, hold between their article tags
    "op12_html_extraction": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
        b AS (SELECT page_id, url, regexp_split_to_array(a, '</?(p|h1)>') AS blocks FROM a),
        t AS (SELECT page_id, url, list_transform(blocks, lambda b: regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')) AS blocks FROM b),
        d AS (SELECT page_id, url, list_transform(blocks, lambda b: replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS blocks FROM t),
        w AS (SELECT page_id, url, list_transform(blocks, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))) AS blocks FROM d)
        SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)), '') AS text,
               length(coalesce(array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)), '')) AS n_chars
        FROM w
    """,
}
