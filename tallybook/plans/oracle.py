"""The same queries as SQL over the raw tables, for DuckDB.

Written from the query's meaning and not from the Spark plan: plain windows and joins,
decimals instead of cents. Decimals leave as doubles and dates as text, as in
``for_comparison``.
"""

from __future__ import annotations

FACE = "CAST(o_totalprice AS DECIMAL(18,2))"
LINE = (
    "ROUND(CAST(l_extendedprice AS DECIMAL(18,2))"
    " * (1 - CAST(l_discount AS DECIMAL(9,6))), 2)"
)
MONTHLY = f"""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           COUNT(*) AS n_receivables, SUM({FACE}) AS face_value
    FROM orders GROUP BY 1
"""

ORACLE_SQL: dict[str, str] = {
    "monthly_origination": f"""
        SELECT CAST(month AS VARCHAR) AS month, n_receivables,
               CAST(face_value AS DOUBLE) AS face_value
        FROM ({MONTHLY})
    """,
    "age_buckets": f"""
        SELECT bucket, COUNT(*) AS n_open, CAST(SUM(face) AS DOUBLE) AS face_value
        FROM (
            SELECT {FACE} AS face,
                   CASE WHEN age IS NULL THEN 'undated' WHEN age < 0 THEN 'later'
                        WHEN age <= 30 THEN '0-30' WHEN age <= 90 THEN '31-90'
                        WHEN age <= 180 THEN '91-180' WHEN age <= 360 THEN '181-360'
                        ELSE '361+' END AS bucket
            FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE),
                                      (SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders)) AS age
                  FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F')
        ) GROUP BY bucket
    """,
    "largest_debtors": f"""
        WITH per_debtor AS (
            SELECT o_custkey AS debtor, SUM({FACE}) AS face_value FROM orders GROUP BY o_custkey
        ), ranked AS (
            SELECT *, ROW_NUMBER() OVER (ORDER BY face_value DESC, debtor) AS rank,
                   SUM(face_value) OVER () AS book
            FROM per_debtor
        )
        SELECT CAST(rank AS INTEGER) AS rank, debtor, CAST(face_value AS DOUBLE) AS face_value,
               ROUND(CAST(face_value AS DOUBLE) / CAST(book AS DOUBLE), 8) AS share
        FROM ranked WHERE rank <= 10
    """,
    "debtor_concentration": f"""
        WITH per_debtor AS (
            SELECT c_mktsegment AS segment, o_custkey, SUM({FACE}) AS face
            FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
        ), shares AS (
            SELECT segment, face, CAST(face AS DOUBLE)
                   / CAST(SUM(face) OVER (PARTITION BY segment) AS DOUBLE) AS share
            FROM per_debtor
        )
        SELECT segment, COUNT(*) AS n_debtors, CAST(SUM(face) AS DOUBLE) AS face_value,
               ROUND(SUM(share * share), 8) AS herfindahl
        FROM shares GROUP BY segment
    """,
    "assignor_rollup": f"""
        SELECT r_name AS region, n_name AS nation,
               CAST(GROUPING_ID(r_name, n_name) AS INTEGER) AS level,
               COUNT(*) AS n_lines, CAST(SUM({LINE}) AS DOUBLE) AS line_value
        FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
             LEFT JOIN nation ON s_nationkey = n_nationkey
             LEFT JOIN region ON n_regionkey = r_regionkey
        GROUP BY ROLLUP (r_name, n_name)
    """,
    "origination_cohorts": f"""
        WITH dated AS (
            SELECT o_custkey, {FACE} AS face, date_trunc('month', o_orderdate) AS month,
                   date_trunc('month', MIN(o_orderdate) OVER (PARTITION BY o_custkey)) AS cohort
            FROM orders
        )
        SELECT CAST(CAST(cohort AS DATE) AS VARCHAR) AS cohort,
               CAST(date_diff('month', cohort, month) AS INTEGER) AS months_since,
               COUNT(DISTINCT o_custkey) AS active_debtors, CAST(SUM(face) AS DOUBLE) AS face_value
        FROM dated GROUP BY cohort, month
    """,
    "trailing_origination": f"""
        SELECT CAST(month AS VARCHAR) AS month, CAST(face_value AS DOUBLE) AS face_value,
               CAST(SUM(face_value) OVER (
                   ORDER BY month
                   RANGE BETWEEN INTERVAL 1 MONTH PRECEDING AND INTERVAL 1 MONTH PRECEDING
               ) AS DOUBLE) AS previous_month,
               CAST(SUM(face_value) OVER (
                   ORDER BY month RANGE BETWEEN INTERVAL 11 MONTH PRECEDING AND CURRENT ROW
               ) AS DOUBLE) AS trailing_value
        FROM ({MONTHLY})
    """,
    "event_transitions": """
        WITH steps AS (
            SELECT LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state,
                   ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
                   event_type AS to_state
            FROM events
        )
        SELECT from_state, to_state, COUNT(*) AS n_transitions,
               ROUND(CAST(COUNT(*) AS DOUBLE)
                     / CAST(SUM(COUNT(*)) OVER (PARTITION BY from_state) AS DOUBLE), 8) AS share
        FROM steps WHERE position > 1 GROUP BY from_state, to_state
    """,
    "band_rates": f"""
        WITH bands(band, low, high, rate) AS (
            VALUES ('small', 0, 100000, CAST(0.005 AS DECIMAL(9,6))),
                   ('medium', 100000, 300000, CAST(0.0125 AS DECIMAL(9,6))),
                   ('large', 300000, NULL, CAST(0.02 AS DECIMAL(9,6)))
        )
        SELECT band, COUNT(*) AS n_receivables, CAST(SUM({FACE}) AS DOUBLE) AS face_value,
               CAST(MAX(rate) AS DOUBLE) AS rate,
               CAST(ROUND(SUM({FACE} * rate), 2) AS DOUBLE) AS rated_value
        FROM orders LEFT JOIN bands
             ON {FACE} >= low AND ({FACE} < high OR high IS NULL)
        GROUP BY band
    """,
    "return_rate_by_segment": f"""
        WITH valued AS (
            SELECT c_mktsegment AS segment, l_returnflag, {LINE} AS line_value
            FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
                 LEFT JOIN customer ON o_custkey = c_custkey
        )
        SELECT segment, CAST(SUM(line_value) AS DOUBLE) AS line_value,
               CAST(SUM(CASE WHEN l_returnflag = 'R' THEN line_value ELSE 0 END) AS DOUBLE)
                   AS returned_value,
               ROUND(CAST(SUM(CASE WHEN l_returnflag = 'R' THEN line_value ELSE 0 END) AS DOUBLE)
                     / CAST(SUM(line_value) AS DOUBLE), 8) AS goods_return_rate
        FROM valued GROUP BY segment
    """,
    "header_line_check": f"""
        WITH per_order AS (
            SELECT l_orderkey, SUM({LINE}) AS line_value, true AS has_lines
            FROM lineitem GROUP BY l_orderkey
        ), book AS (SELECT *, true AS in_book FROM orders)
        SELECT CASE WHEN in_book IS NULL THEN 'no order' WHEN has_lines IS NULL THEN 'no lines' WHEN {FACE} > line_value THEN 'over'
                    WHEN {FACE} < line_value THEN 'under' ELSE 'equal' END AS outcome,
               COUNT(*) AS n_receivables, CAST(COALESCE(SUM({FACE}), 0) AS DOUBLE) AS face_value,
               CAST(COALESCE(SUM(line_value), 0) AS DOUBLE) AS line_value
        FROM book FULL JOIN per_order ON o_orderkey = l_orderkey GROUP BY 1
    """,
    "weekly_state": """
        WITH dates AS (
            SELECT first_day + INTERVAL (7 * week) DAY AS as_of
            FROM (SELECT date_trunc('day', MIN(ts)) AS first_day, MAX(ts) AS latest FROM events),
                 unnest(range(date_diff('day', first_day, date_trunc('day', latest)) // 7 + 1))
                     AS weeks(week)
        ), users AS (SELECT DISTINCT user_id FROM events)
        SELECT user_id, CAST(CAST(as_of AS DATE) AS VARCHAR) AS as_of, event_type
        FROM (
            SELECT u.user_id, d.as_of, e.event_type,
                   ROW_NUMBER() OVER (PARTITION BY u.user_id, d.as_of
                                      ORDER BY e.ts DESC NULLS LAST, e.event_id DESC) AS recency
            FROM users u CROSS JOIN dates d
                 LEFT JOIN events e ON e.user_id = u.user_id AND e.ts <= d.as_of
        ) WHERE recency = 1
    """,
    "activity_sessions": """
        WITH marked AS (
            SELECT user_id, ts,
                   CASE WHEN ts - LAG(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
        ), numbered AS (
            SELECT user_id, ts, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts
                                                 ROWS UNBOUNDED PRECEDING) AS session
            FROM marked
        )
        SELECT user_id, MIN(ts) AS session_start, COUNT(*) AS n_events
        FROM numbered GROUP BY user_id, session
    """,
    "streamed_daily_events": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n_events
        FROM events GROUP BY 1, 2
    """,
}
