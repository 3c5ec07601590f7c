"""Bounded chunks of whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import chunking as c
from ledgerloom.plans.bindings import ANNOUNCEMENTS, with_
from ledgerloom.plans.document_queries import headed
from ledgerloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Tokens of a chunk in these queries, so that the given texts meet every level of the split.
LIMIT = 60
_MOST, _SLICE = 4 * LIMIT + 3, (4 * LIMIT + 3) // 6
_UNITS = "(length({0}) + 5 * len(regexp_extract_all({0}, '[一-鿿]')))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("dc6_oversize_split", rf"""{with_(ANNOUNCEMENTS).replace('WITH', 'WITH RECURSIVE', 1)},
    p0 AS (SELECT doc_id, body, regexp_extract_all(body, '(?s).+?(?:\n[ \t]*\n\s*|\z)') AS ps FROM announcements WHERE {_UNITS.format('body')} > {_MOST}),
    p AS (SELECT doc_id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM p0),
    s0 AS (SELECT doc_id, i, regexp_extract_all(p, '(?s).+?(?:[。！？；\n]+|\z)') AS ss FROM p WHERE {_UNITS.format('p')} > {_MOST}),
    s AS (SELECT doc_id, i, unnest(range(len(ss))) AS j, unnest(ss) AS s FROM s0),
    c0 AS (SELECT doc_id, i, j, regexp_extract_all(s, '(?s).{{1,{_SLICE}}}') AS cs FROM s WHERE {_UNITS.format('s')} > {_MOST}),
    pieces AS (SELECT doc_id, i, 0 AS j, 0 AS l, p AS x, false AS fresh FROM p WHERE {_UNITS.format('p')} <= {_MOST}
        UNION ALL SELECT doc_id, i, j, 0, s, j = 0 FROM s WHERE {_UNITS.format('s')} <= {_MOST}
        UNION ALL SELECT doc_id, i, j, l, x, j = 0 AND l = 0 FROM (SELECT doc_id, i, j, unnest(range(len(cs))) AS l, unnest(cs) AS x FROM c0)),
    n AS (SELECT *, {_UNITS.format('x')} AS u, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, l) AS k FROM pieces),
    walk AS (SELECT doc_id, k, x, u AS total, 0 AS idx FROM n WHERE k = 1
        UNION ALL SELECT n.doc_id, n.k, n.x, CASE WHEN NOT fresh AND total + u <= {_MOST} THEN total + u ELSE u END, CASE WHEN NOT fresh AND total + u <= {_MOST} THEN idx ELSE idx + 1 END FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
    chunks AS (SELECT doc_id, idx, string_agg(x, '' ORDER BY k) AS chunk FROM walk GROUP BY doc_id, idx
        UNION ALL SELECT doc_id, 0, body FROM announcements WHERE {_UNITS.format('body')} <= {_MOST} AND body <> '')
    SELECT doc_id, idx::INTEGER AS idx, chunk, ({_UNITS.format('chunk')} // 4)::INTEGER AS tokens FROM chunks""")
def oversize_split(spark, sf):
    return c.oversize_chunks(t.announcements(spark, sf), LIMIT, keys=("doc_id",))


@query("dc7_token_windows")
def token_windows(spark, sf):
    """Windows of 64 tokens that overlap by a fifth, bounded by headings; tests hold whole tables against plain Python."""
    return c.token_windows(headed(spark, sf), 64, percent=20).select("doc_id", "idx", "heading", F.md5("chunk").alias("chunk_md5"), "tokens")
