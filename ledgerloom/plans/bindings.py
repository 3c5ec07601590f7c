"""SQL that presents the given tables as ``ledgerloom.sources.tables`` does, for the oracle queries."""


def r(x: str, n: int) -> str:
    """Rounding of a double by its decimal digits, half up, as Spark's ``round`` does it."""
    return f"round(({x})::VARCHAR::DECIMAL(38, 20), {n})::DOUBLE"


def steady(x: str, n: int) -> str:
    """Rounding for sums, whose last bits depend on order: a hair away from zero, so that ties fall one way."""
    return f"round(({x}) * 1.000000000001, {n})"


BARS = f"""
    trades AS (
        SELECT l_suppkey AS code, l_shipdate::DATE AS trade_date, l_extendedprice / l_quantity AS price,
               l_orderkey * 16 + l_linenumber AS seq, l_quantity AS qty, l_extendedprice AS value FROM lineitem
    ), bars0 AS (
        SELECT code, trade_date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
               sum(qty) AS volume, round(sum(value), 2) AS amount FROM trades GROUP BY code, trade_date
    ), bars AS (
        SELECT *, lag(close) OVER w AS pre_close,
               {r('close - lag(close) OVER w', 3)} AS change,
               CASE WHEN lag(close) OVER w <> 0 THEN (close - lag(close) OVER w) / lag(close) OVER w * 100 END AS pct_chg
        FROM bars0 WINDOW w AS (PARTITION BY code ORDER BY trade_date)
    )
"""

FUNDAMENTALS = """
    facts AS (
        SELECT l_suppkey AS code, date_trunc('month', l_shipdate::DATE)::DATE AS month, max(l_shipdate::DATE) AS as_of,
               round(avg(l_discount) * 100, 4) AS pe, round(avg(l_tax) * 100, 4) AS pb, count(*) AS reports
        FROM lineitem GROUP BY 1, 2
    )
"""

STOCKS = """
    stocks AS (
        SELECT s_suppkey AS code, s_name AS name, n_name AS industry, r_name AS area, s_acctbal AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    )
"""

MEMBERS = """
    members AS (SELECT DISTINCT p_brand AS concept, l_suppkey AS code FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

HEAT = """
    heat AS (
        SELECT p_brand AS concept, l_shipdate::DATE AS trade_date, count(*) FILTER (l_returnflag = 'R') AS ups,
               round(avg(l_discount) * 100, 4) AS pct
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
    )
"""

RUNS = """
    runs AS (
        SELECT event_id AS run_id, user_id AS task, event_type AS kind, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
               ts AS started_at, value AS records, props FROM events
    )
"""

ANNOUNCEMENTS = """
    announcements AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS body, lang, source FROM documents
    )
"""

QUESTIONS = """
    questions AS (
        SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q
        JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'
    )
"""

EDGES = """
    edges0 AS (
        SELECT 'C:' || l_suppkey AS src, 'P:' || l_partkey AS dst, 'SUPPLIES' AS rel, sum(l_quantity) AS qty, min(l_shipdate::DATE) AS valid_from, max(l_linestatus) AS status, count(*) AS n
        FROM lineitem GROUP BY 1, 2
        UNION ALL
        SELECT 'P:' || l_partkey, 'U:' || o_custkey, 'USED_BY', sum(l_quantity), min(l_shipdate::DATE), max(l_linestatus), count(*)
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
    ), edges AS MATERIALIZED (
        SELECT src, dst, rel, round(least(1.0, qty / 100), 4) AS weight, valid_from, CASE WHEN status = 'F' THEN 'Fact' ELSE 'Estimate' END AS stmt_type, n FROM edges0
    )
"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)
