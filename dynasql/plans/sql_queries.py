"""Named queries in the dialect, each with the SQL that checks it.

A row is name: (query, check); check None means that the same text is valid SQL
with the same meaning for the checker.
"""

from __future__ import annotations

QUERIES: dict[str, tuple[str, str | None]] = {
    # scans, projection, filter
    "scan_table": ("SELECT * FROM nation", None),
    "scan_constant": ("SELECT 1 AS a, 'x' AS b, 2.5 AS c", "SELECT 1 AS a, 'x' AS b, 2.5::DOUBLE AS c"),
    "scan_values": ("SELECT column1 AS k, column2 AS v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL))", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(k, v)"),
    "project_expressions": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, -l_quantity AS minus FROM lineitem", None),
    "project_qualified_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "filter_comparisons": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02 AND l_returnflag <> 'N'", None),
    "filter_dates": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'", None),
    "filter_or_not": ("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 9000 OR c_mktsegment = 'BUILDING')", None),
    "filter_truthiness": ("SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "filter_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice NOT BETWEEN 1000 AND 1500", None),
    "filter_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')", None),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%A%e%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%e%'"),
    "filter_like_escape": ("SELECT p_partkey FROM part WHERE p_brand || '%' LIKE '%#1_!%' ESCAPE '!'", "SELECT p_partkey FROM part WHERE (p_brand || '%') ILIKE '%#1_!%' ESCAPE '!'"),
    "filter_glob": ("SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-4]?'", None),
    "filter_regexp": ("SELECT c_custkey FROM customer WHERE c_name REGEXP '00[1-3]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '00[1-3]$')"),
    "predicates_null": ("SELECT c_custkey, o_orderkey ISNULL AS none, o_orderkey NOTNULL AS some, o_orderkey IS NULL AS n, o_orderkey IS NOT 7 AS d FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000",
                        "SELECT c_custkey, (o_orderkey IS NULL)::BIGINT AS none, (o_orderkey IS NOT NULL)::BIGINT AS some, (o_orderkey IS NULL)::BIGINT AS n, (o_orderkey IS DISTINCT FROM 7)::BIGINT AS d FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000"),
    "predicates_three_valued": ("SELECT n_nationkey, (NULL AND n_regionkey > 1) AS a, (NULL OR n_regionkey > 1) AS b, NOT NULL AS c, n_regionkey IN (1, NULL) AS d FROM nation",
                                "SELECT n_nationkey, (NULL AND n_regionkey > 1)::BIGINT AS a, (NULL OR n_regionkey > 1)::BIGINT AS b, NULL::BIGINT AS c, (n_regionkey IN (1, NULL))::BIGINT AS d FROM nation"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders", None),
    "case_simple": ("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS code FROM lineitem", None),
    "cast_prefix": ("SELECT CAST('12abc' AS INTEGER) AS a, CAST('3.5e1x' AS REAL) AS b, CAST('abc' AS INTEGER) AS c, CAST(-7.9 AS INTEGER) AS d, CAST(15 AS TEXT) AS e, CAST(2.0 AS TEXT) AS f, CAST('7' AS NUMERIC) AS g",
                    "SELECT 12 AS a, 35.0::DOUBLE AS b, 0 AS c, -7 AS d, '15' AS e, '2.0' AS f, 7 AS g"),
    "cast_columns": ("SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS whole, CAST(c_custkey AS TEXT) AS t FROM customer", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS whole, c_custkey::VARCHAR AS t FROM customer"),
    "affinity_comparison": ("SELECT c_custkey FROM customer WHERE c_custkey = '7' OR c_custkey < '3.5'", "SELECT c_custkey FROM customer WHERE c_custkey = 7 OR c_custkey < 3.5"),
    "class_order": ("SELECT 1 < 'a' AS a, 'a' < x'00' AS b, '1' = 1 AS c, 1 = 1.0 AS d, NULL IS NULL AS e", "SELECT 1 AS a, 1 AS b, 0 AS c, 1 AS d, 1 AS e"),
    "collate_ignored": ("SELECT n_name FROM nation WHERE n_name COLLATE nocase = 'NATION_1'", "SELECT n_name FROM nation WHERE n_name = 'NATION_1'"),
    # operators
    "arithmetic_integer": ("SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_orderkey / 0 AS z, o_orderkey % 0 AS y, -7 / 2 AS n, -7 % 3 AS m FROM orders",
                           "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, NULL::BIGINT AS z, NULL::BIGINT AS y, -3 AS n, -1 AS m FROM orders"),
    "arithmetic_real": ("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_tax / 0.0 AS z FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, NULL::DOUBLE AS z FROM lineitem"),
    "arithmetic_text": ("SELECT '3 apples' + 4 AS a, 'x' * 2 AS b, '10' + 5 AS c, NULL + 1 AS d", "SELECT 7.0::DOUBLE AS a, 0.0::DOUBLE AS b, 15 AS c, NULL::BIGINT AS d"),
    "bitwise": ("SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey << 3 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS i, 1 << 64 AS over, -1 >> 70 AS under, 8 << -2 AS back FROM nation",
                "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey::BIGINT << 3 AS l, n_nationkey >> 1 AS r, ~n_nationkey AS i, 0 AS over, -1 AS under, 2 AS back FROM nation"),
    "concat_operator": ("SELECT c_custkey, c_name || '/' || c_nationkey AS tag, 'a' || NULL AS n FROM customer", "SELECT c_custkey, c_name || '/' || c_nationkey AS tag, NULL::VARCHAR AS n FROM customer"),
    # joins
    "join_inner": ("SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000", None),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_left": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "join_right": ("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'", None),
    "join_full": ("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey * 2", None),
    "join_using": ("SELECT * FROM (SELECT r_regionkey AS k, r_name FROM region) a JOIN (SELECT n_regionkey AS k, n_name FROM nation) b USING (k)", None),
    "join_using_full": ("SELECT k, x, y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_nationkey < 20 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier WHERE s_nationkey > 3 GROUP BY s_nationkey) b USING (k)", None),
    "join_natural": ("SELECT * FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL LEFT JOIN (SELECT n_regionkey AS k, n_name FROM nation WHERE n_nationkey < 10) b", None),
    "join_theta": ("SELECT a.r_regionkey AS x, b.n_nationkey AS y FROM region a JOIN nation b ON a.r_regionkey < b.n_regionkey AND b.n_nationkey % 2 = 0", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_many": ("SELECT r_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name", None),
    # aggregation
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "aggregate_global": ("SELECT count(*) AS n, count(o_orderkey) AS k, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(o_custkey) AS s, avg(o_totalprice) AS a FROM orders", None),
    "aggregate_empty": ("SELECT count(*) AS n, sum(o_custkey) AS s, total(o_totalprice) AS t, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s, 0.0::DOUBLE AS t, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0"),
    "aggregate_expression_key": ("SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 10", None),
    "aggregate_ordinal_key": ("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1", None),
    "aggregate_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000", None),
    "aggregate_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, sum(DISTINCT l_linenumber) AS t, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", None),
    "aggregate_total": ("SELECT c_mktsegment, total(c_custkey) AS t FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, sum(c_custkey)::DOUBLE AS t FROM customer GROUP BY c_mktsegment"),
    "aggregate_group_concat": ("SELECT r_regionkey, group_concat(r_name, '|') AS names FROM region GROUP BY r_regionkey", "SELECT r_regionkey, string_agg(r_name, '|') AS names FROM region GROUP BY r_regionkey"),
    "aggregate_in_expression": ("SELECT l_returnflag, sum(l_quantity) / count(*) + max(l_tax) AS x FROM lineitem GROUP BY l_returnflag ORDER BY sum(l_tax) DESC", None),
    "aggregate_filter": ("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders", None),
    "aggregate_null_key": ("SELECT o_orderstatus, count(c_custkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY o_orderstatus", None),
    "aggregate_median": ("SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag", None),
    "aggregate_bare_column": ("SELECT r_regionkey, r_name, count(*) AS n FROM region GROUP BY r_regionkey", "SELECT r_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM region GROUP BY r_regionkey"),
    "distinct_rows": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_ordered": ("SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 3", None),
    # windows, order, limit
    "window_rank": ("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders", None),
    "window_running": ("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders", None),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "order_ordinal_alias": ("SELECT c_custkey AS k, c_acctbal * 2 AS b FROM customer ORDER BY b DESC, 1 LIMIT 5 OFFSET 3", None),
    "order_nulls": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey, c_custkey LIMIT 20", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 20"),
    "limit_comma": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5, 7", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 5"),
    # set operations
    "set_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "set_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "set_intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "set_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20", None),
    "set_left_associative": ("SELECT n_nationkey AS k FROM nation UNION SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier", "(SELECT n_nationkey AS k FROM nation UNION SELECT c_custkey FROM customer) INTERSECT SELECT s_suppkey FROM supplier"),
    "set_ordered": ("SELECT r_name AS x FROM region UNION SELECT n_name FROM nation ORDER BY x DESC LIMIT 6", None),
    "set_all_variants": ("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer", None),
    # subqueries (extensions)
    "subquery_from": ("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 15", None),
    "subquery_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)", None),
    "subquery_not_in": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "subquery_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)", None),
    "subquery_exists": ("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)", None),
    "cte": ("WITH big(k, t) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey) SELECT c_name, t FROM big JOIN customer ON k = c_custkey WHERE t > 2000000", None),
    # scalar functions
    "fn_null": ("SELECT o_orderkey, coalesce(NULL, o_orderkey, 1) AS a, ifnull(NULL, 'x') AS b, nullif(o_orderstatus, 'F') AS c, iif(o_totalprice > 100000, 'hi', 'lo') AS d, likely(o_custkey) AS e FROM orders",
                "SELECT o_orderkey, o_orderkey AS a, 'x' AS b, nullif(o_orderstatus, 'F') AS c, CASE WHEN o_totalprice > 100000 THEN 'hi' ELSE 'lo' END AS d, o_custkey AS e FROM orders"),
    "fn_typeof_quote": ("SELECT typeof(1) AS a, typeof(1.0) AS b, typeof('x') AS c, typeof(NULL) AS d, typeof(x'00') AS e, quote('it''s') AS f, quote(NULL) AS g, quote(x'ab') AS h, quote(2.50) AS i",
                        "SELECT 'integer' AS a, 'real' AS b, 'text' AS c, 'null' AS d, 'blob' AS e, '''it''''s''' AS f, 'NULL' AS g, 'X''AB''' AS h, '2.5' AS i"),
    "fn_min_max_scalar": ("SELECT p_partkey, min(p_size, 20) AS lo, max(p_size, 20, 30) AS hi, max(p_size, NULL) AS n FROM part", "SELECT p_partkey, least(p_size, 20) AS lo, greatest(p_size, 20, 30) AS hi, NULL::BIGINT AS n FROM part"),
    "fn_length_case": ("SELECT doc_id, length(text) AS n, upper(lang) AS u, lower(source) AS l FROM documents", None),
    "fn_case_ascii": ("SELECT upper('aé') AS u, lower('AÉ') AS l", "SELECT 'Aé' AS u, 'aÉ' AS l"),
    "fn_substr": ("SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, -3) AS b, substr(p_name, 0, 2) AS c, substr(p_name, 4, -2) AS d, substr(p_name, -2, -2) AS e, substr(p_name, 3) AS f FROM part",
                  "SELECT p_partkey, substring(p_name, 2, 3) AS a, right(p_name, 3) AS b, left(p_name, 1) AS c, substring(p_name, 2, 2) AS d, substring(p_name, length(p_name) - 3, 2) AS e, substring(p_name, 3) AS f FROM part"),
    "fn_trim": ("SELECT trim('  ab ') AS a, ltrim('xxabx', 'x') AS b, rtrim('abyx', 'xy') AS c, trim('#a#', '#') AS d", None),
    "fn_replace_instr": ("SELECT p_partkey, replace(p_name, 'e', 'EE') AS r, instr(p_name, 'a') AS i, instr(p_name, 'zzz') AS z FROM part", None),
    "fn_concat": ("SELECT c_custkey, concat(c_name, NULL, c_nationkey) AS a, concat_ws('-', c_mktsegment, NULL, c_name) AS b FROM customer", None),
    "fn_printf": ("SELECT c_custkey, printf('%05d|%-6s|%.2f|%x', c_custkey, 'ab', c_acctbal, c_custkey) AS t FROM customer", "SELECT c_custkey, printf('%05d|%-6s|%.2f|%x', c_custkey, 'ab', c_acctbal, c_custkey) AS t FROM customer"),
    "fn_char_unicode_hex": ("SELECT char(72, 233, 8364) AS c, unicode('é') AS u, hex('abc') AS h, hex(unhex('4D2F')) AS r, hex(zeroblob(2)) AS z", "SELECT 'Hé€' AS c, 233 AS u, '616263' AS h, '4D2F' AS r, '0000' AS z"),
    "fn_math_round": ("SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, round(l_extendedprice) AS r, round(l_tax, 1) AS r1, sign(l_discount - 0.05) AS s, ceil(l_tax) AS c, floor(l_tax) AS f FROM lineitem WHERE l_orderkey < 500",
                      "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, round(l_extendedprice) AS r, round(l_tax, 1) AS r1, sign(l_discount - 0.05)::BIGINT AS s, ceil(l_tax) AS c, floor(l_tax) AS f FROM lineitem WHERE l_orderkey < 500"),
    "fn_math_round_all": ("SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, round(l_extendedprice) AS r, round(l_tax, 1) AS r1, sign(l_discount - 0.05) AS s, ceil(l_tax) AS c, floor(l_tax) AS f FROM lineitem",
                      "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, round(l_extendedprice) AS r, round(l_tax, 1) AS r1, sign(l_discount - 0.05)::BIGINT AS s, ceil(l_tax) AS c, floor(l_tax) AS f FROM lineitem"),
    "fn_math_log": ("SELECT p_partkey, exp(p_size / 10.0) AS e, ln(p_size) AS l, log(p_size) AS l10, log2(p_size) AS l2, log(3, p_size) AS l3, sqrt(p_size) AS q, pow(p_size, 1.5) AS p, mod(p_retailprice, 7) AS m, ln(-1) AS none, sqrt(-4) AS none2 FROM part",
                    "SELECT p_partkey, exp(p_size / 10.0) AS e, ln(p_size) AS l, log10(p_size) AS l10, log2(p_size) AS l2, ln(p_size) / ln(3) AS l3, sqrt(p_size) AS q, pow(p_size, 1.5) AS p, p_retailprice % 7 AS m, NULL::DOUBLE AS none, NULL::DOUBLE AS none2 FROM part"),
    "fn_trigonometry": ("SELECT p_partkey, sin(p_size) AS s, cos(p_size) AS c, tan(p_size) AS t, asin(p_size / 50.0) AS i, acos(p_size / 50.0) AS o, atan(p_size) AS a, atan2(p_size, 3) AS b, degrees(p_size) AS d, radians(p_size) AS r, pi() AS pi, asin(2) AS none FROM part",
                        "SELECT p_partkey, sin(p_size) AS s, cos(p_size) AS c, tan(p_size) AS t, asin(p_size / 50.0) AS i, acos(p_size / 50.0) AS o, atan(p_size) AS a, atan2(p_size, 3) AS b, degrees(p_size) AS d, radians(p_size) AS r, pi() AS pi, NULL::DOUBLE AS none FROM part"),
    "fn_random": ("SELECT typeof(random()) AS a, length(randomblob(4)) AS b", "SELECT 'integer' AS a, 4 AS b"),
    # dates
    "date_parts": ("SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate) AS t, datetime(o_orderdate) AS dt, unixepoch(o_orderdate) AS u, julianday(o_orderdate) AS j FROM orders",
                   "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt, epoch(o_orderdate)::BIGINT AS u, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j FROM orders"),
    "date_strftime": ("SELECT event_id, strftime('%Y/%m/%d %H:%M:%S %j %w', ts) AS s, strftime('%%%F', ts) AS f FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S %j %w') AS s, '%' || strftime(ts, '%Y-%m-%d') AS f FROM events"),
    "date_shift": ("SELECT o_orderkey, date(o_orderdate, '+10 days') AS a, datetime(o_orderdate, '-90 minutes', '+1.5 hours') AS b, date(o_orderdate, 'start of month') AS m, date(o_orderdate, 'start of year') AS y FROM orders",
                   "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS b, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y FROM orders"),
    "date_literals": ("SELECT date('2024-01-31', '+1 month') AS over, date('2024-1-2') AS none, datetime('2024-02-29 12:30', '+1 year') AS leap, time('25:00') AS bad, julianday('2000-01-01 12:00') AS j, date(2451545.0) AS n, datetime(1700000000, 'unixepoch') AS e, date('2024-05-15', 'weekday 0') AS w, datetime('2024-03-01T10:00:00+02:00') AS z",
                      "SELECT '2024-03-02' AS over, NULL::VARCHAR AS none, '2025-03-01 12:30:00' AS leap, NULL::VARCHAR AS bad, 2451545.0::DOUBLE AS j, '2000-01-01' AS n, '2023-11-14 22:13:20' AS e, '2024-05-19' AS w, '2024-03-01 08:00:00' AS z"),
    "date_months": ("SELECT o_orderkey, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS last FROM orders", "SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last FROM orders"),
    "json_arrow": ("SELECT event_id, props ->> 'k' AS k FROM events", None),
}
