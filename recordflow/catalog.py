"""Registered queries: programs over the driver's tables, and the same in SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordflow.api import Program
from recordflow.sources.records import cut_records, read_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, longs: str = "", rounds: dict[str, int] | None = None) -> DataFrame:
    """Counts and keys as bigint, sums rounded, as the SQL has them."""
    for c in longs.split():
        df = df.withColumn(c, F.col(c).cast("bigint"))
    for c, n in (rounds or {}).items():
        df = df.withColumn(c, F.round(c, n))
    return df


def register(name: str, program: str, tables: str, names: str, sql: str | None, order: str = "", longs: str = "", rounds: dict[str, int] | None = None, columns: str = "", relational: bool = True, **options) -> None:
    """A query that runs a program over tables (the last is the main input). columns:
    those of the table that the program sees, in that order; all by default."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = [table(spark, sf_dir, t) for t in tables.split()]
        if columns:
            sources[-1] = sources[-1].select(*columns.split())
        source = sources if len(sources) > 1 else sources[0]
        df = Program(program, **options).run(source, names=names.split(), order_by=order.split() or None, relational=relational)
        return shaped(df, longs, rounds)

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


# projections, filters, scalar operators
register("filter_project", '$5 > 30 && $9 == "R" { print $1, $5 }', "lineitem", "l_orderkey qty", "SELECT l_orderkey, l_quantity AS qty FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'", longs="l_orderkey")
register("regex_filter", "$2 ~ /^C.*[0-9]$/ && $5 ~ /(BUILD|MACH)/ { print $1, $2 }", "customer", "k name", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE regexp_matches(c_name, '^C.*[0-9]$') AND regexp_matches(c_mktsegment, 'BUILD|MACH')", longs="k")
register("regex_not", "$2 !~ /(widget|bolt)/ { print $1, $2 }", "part", "k name", "SELECT p_partkey AS k, p_name AS name FROM part WHERE NOT regexp_matches(p_name, 'widget|bolt')", longs="k")
register("arith_project", "{ print $1, $6 * (1 - $7) }", "lineitem", "k net", "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem", longs="k", rounds={"net": 4})
register("mod_pow_int", "{ print $1 % 7, $4 ^ 2, int($6 / 1000) }", "lineitem", "m p i", "SELECT l_orderkey % 7 AS m, (l_linenumber * l_linenumber)::BIGINT AS p, trunc(l_extendedprice / 1000)::BIGINT AS i FROM lineitem", longs="m p i")
register("unary_ops", "{ print -$5, !($5 > 25), +$4 }", "lineitem", "neg low line", "SELECT -l_quantity AS neg, (NOT l_quantity > 25)::BIGINT AS low, l_linenumber::BIGINT AS line FROM lineitem", longs="low line")
register("divide", "$4 != 0 { print $1, $6 / $4 }", "lineitem", "k q", "SELECT l_orderkey AS k, round(l_extendedprice / l_linenumber, 4) AS q FROM lineitem WHERE l_linenumber <> 0", longs="k", rounds={"q": 4})
register("ternary_bucket", '{ print $1, ($5 > 25 ? "hi" : "lo") }', "lineitem", "k b", "SELECT l_orderkey AS k, CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS b FROM lineitem", longs="k")
register("logic_ops", '$5 < 5 || ($5 > 45 && !($9 == "N")) { print $1, $5, $9 }', "lineitem", "k q f", "SELECT l_orderkey AS k, l_quantity AS q, l_returnflag AS f FROM lineitem WHERE l_quantity < 5 OR (l_quantity > 45 AND NOT l_returnflag = 'N')", longs="k")
register("string_compare", '$4 >= "click" && $4 < "purchase" { print $1, $4 }', "events", "id t", "SELECT event_id AS id, event_type AS t FROM events WHERE event_type >= 'click' AND event_type < 'purchase'", longs="id")
register("concat_fields", '{ print $1 "-" $3 }', "lineitem", "s", "SELECT l_orderkey || '-' || l_suppkey AS s FROM lineitem")
register("if_else", '{ if ($5 > 40) b = "big"; else if ($5 > 10) b = "mid"; else b = "small"; print $1, b }', "lineitem", "k b", "SELECT l_orderkey AS k, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 10 THEN 'mid' ELSE 'small' END AS b FROM lineitem", longs="k")
register("loop_unrolled", "{ x = 1; for (i = 0; i < 3; i++) x = x * $4; print $1, x }", "lineitem", "k x", "SELECT l_orderkey AS k, (l_linenumber ** 3)::BIGINT AS x FROM lineitem", longs="k x")
register("next_rule", '$9 == "N" { next } { print $1, $9 }', "lineitem", "k f", "SELECT l_orderkey AS k, l_returnflag AS f FROM lineitem WHERE l_returnflag <> 'N'", longs="k")
register("two_rules", '$5 > 48 { print "qty", $1 } $6 > 100000 { print "price", $1 }', "lineitem", "what k", "SELECT 'qty' AS what, l_orderkey AS k FROM lineitem WHERE l_quantity > 48 UNION ALL SELECT 'price', l_orderkey FROM lineitem WHERE l_extendedprice > 100000", longs="k")
register("user_function", "function band(x, w) { if (x > 40) return w * 2; return w } { print $1, band($5, $4) }", "lineitem", "k b", "SELECT l_orderkey AS k, (CASE WHEN l_quantity > 40 THEN l_linenumber * 2 ELSE l_linenumber END)::BIGINT AS b FROM lineitem", longs="k b")
register("constants_from_begin", 'BEGIN { limit = 40; tag = "over" limit } $5 > limit { print $1, tag }', "lineitem", "k tag", "SELECT l_orderkey AS k, 'over40' AS tag FROM lineitem WHERE l_quantity > 40", longs="k")
register("variable_option", "$5 > limit { print $1, limit + 1 }", "lineitem", "k n", "SELECT l_orderkey AS k, 46::BIGINT AS n FROM lineitem WHERE l_quantity > 45", longs="k n", variables=[("limit", "45")])
register("constant_lookup", 'BEGIN { w["R"] = 1; w["A"] = 2 } $9 in w { print $1, w[$9] }', "lineitem", "k w", "SELECT l_orderkey AS k, (CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END)::BIGINT AS w FROM lineitem WHERE l_returnflag IN ('R', 'A')", longs="k w")

# fields and records
register("nf_last", '{ n = split($2, w, " "); print $1, n, w[n], NF, $NF }', "part", "k n last nf size", "SELECT p_partkey AS k, len(string_split(p_name, ' '))::BIGINT AS n, string_split(p_name, ' ')[-1] AS last, 6::BIGINT AS nf, p_retailprice AS size FROM part", longs="k n nf")
register("field_assign", '{ $3 = "x"; print $0 }', "nation", "line", "SELECT concat_ws(' ', n_nationkey, n_name, 'x') AS line FROM nation")
register("nf_assign", '{ NF = 2; print $0, NF; }', "nation", "line nf", "SELECT concat_ws(' ', n_nationkey, n_name) AS line, 2::BIGINT AS nf FROM nation", longs="nf")
register("record_assign", '{ $0 = $2 " " $5; print NF, $1 }', "customer", "nf a", "SELECT 2::BIGINT AS nf, c_name AS a FROM customer", longs="nf")
register("dynamic_field", "{ print $1, $(NF - 1) }", "orders", "k d", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d FROM orders", longs="k")
register("ofs_join", 'BEGIN { OFS = "|" } { $1 = $1; print $0 }', "region", "line", "SELECT concat_ws('|', r_regionkey, r_name) AS line FROM region")
register("split_url", '{ n = split($2, a, "/"); print $1, n, a[3] }', "pages", "k n host", "SELECT page_id AS k, len(string_split(url, '/'))::BIGINT AS n, string_split(url, '/')[3] AS host FROM pages", longs="k n", columns="page_id url")
register("split_regex", "{ n = split($2, a, /[ :]+/); print $1, n, a[1] }", "documents", "k n w", "SELECT doc_id AS k, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(text, '[ :]+')) END::BIGINT AS n, CASE WHEN text = '' THEN '' ELSE string_split_regex(text, '[ :]+')[1] END AS w FROM documents", longs="k n", columns="doc_id text")
register("whitespace_fields", "{ n = split($2, a, \" \"); print $1, n }", "documents", "k n", r"SELECT doc_id AS k, len(list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> ''))::BIGINT AS n FROM documents", longs="k n", columns="doc_id text")
register("field_print_loop", "{ for (i = 2; i <= NF; i++) print $1, i, $i }", "nation", "k i v", "SELECT n_nationkey::BIGINT AS k, 2::BIGINT AS i, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 3, n_regionkey::VARCHAR FROM nation", longs="k i")

# functions
register("str_functions", "{ print $1, length($2), toupper($2), tolower($5), substr($2, 3, 4), index($2, \"#\") }", "customer", "k n up low sub at", "SELECT c_custkey AS k, length(c_name)::BIGINT AS n, upper(c_name) AS up, lower(c_mktsegment) AS low, substr(c_name, 3, 4) AS sub, strpos(c_name, '#')::BIGINT AS at FROM customer", longs="k n at")
register("substr_edges", "{ print $1, substr($2, 0, 2), substr($2, -1), substr($2, 12, 0 - 1), substr($2, 99) }", "customer", "k a b c d", "SELECT c_custkey AS k, substr(c_name, 1, 2) AS a, c_name AS b, '' AS c, '' AS d FROM customer", longs="k")
register("sub_first", '{ s = $2; n = sub(/[aeiou]+/, "<&>", s); print $1, s, n }', "part", "k s n", r"SELECT p_partkey AS k, regexp_replace(p_name, '[aeiou]+', '<\0>') AS s, regexp_matches(p_name, '[aeiou]')::BIGINT AS n FROM part", longs="k n")
register("gsub_count", '{ n = gsub(/[aeiou]/, "*", $2); print $1, $2, n }', "part", "k s n", "SELECT p_partkey AS k, regexp_replace(p_name, '[aeiou]', '*', 'g') AS s, len(regexp_extract_all(p_name, '[aeiou]'))::BIGINT AS n FROM part", longs="k n")
register("match_pos", "{ m = match($2, /[0-9]+/); print $1, RSTART, RLENGTH }", "customer", "k a n", "SELECT c_custkey AS k, strpos(c_name, regexp_extract(c_name, '[0-9]+'))::BIGINT AS a, length(regexp_extract(c_name, '[0-9]+'))::BIGINT AS n FROM customer", longs="k a n")
register("longest_match", "{ m = match($2, /w|widget|wid/); print $1, RSTART, RLENGTH }", "part", "k a n", "SELECT p_partkey AS k, CASE WHEN strpos(p_name, 'w') > 0 THEN strpos(p_name, 'w') ELSE 0 END::BIGINT AS a, CASE WHEN strpos(p_name, 'w') = 0 THEN -1 WHEN strpos(p_name, 'widget') = strpos(p_name, 'w') THEN 6 WHEN strpos(p_name, 'wid') = strpos(p_name, 'w') THEN 3 ELSE 1 END::BIGINT AS n FROM part", longs="k a n")
register("sprintf_fmt", '{ print $1, sprintf("%05d|%.2f|%-6s|%x", $1, $4, $5, $3) }', "customer", "k s", "SELECT c_custkey AS k, printf('%05d|%.2f|', c_custkey, c_acctbal) || rpad(c_mktsegment, greatest(6, length(c_mktsegment))::INTEGER, ' ') || '|' || printf('%x', c_nationkey) AS s FROM customer", longs="k")
register("printf_rule", '{ printf "%d:%s\\n", $1, $2 }', "nation", "line", "SELECT n_nationkey || ':' || n_name AS line FROM nation")
register("number_text", '{ print $1 ":" $6 / 8 }', "lineitem", "s", "SELECT l_orderkey || ':' || CASE WHEN l_extendedprice / 8 = trunc(l_extendedprice / 8) THEN (l_extendedprice / 8)::BIGINT::VARCHAR ELSE printf('%.6g', l_extendedprice / 8) END AS s FROM lineitem")
register("math_fns", "{ print $1, sin($5), cos($5), atan2($5, $4), exp(-$4), log($6), sqrt($5) }", "lineitem", "k a b c d e f", "SELECT l_orderkey AS k, round(sin(l_quantity), 6) AS a, round(cos(l_quantity), 6) AS b, round(atan2(l_quantity, l_linenumber), 6) AS c, round(exp(-l_linenumber), 6) AS d, round(ln(l_extendedprice), 6) AS e, round(sqrt(l_quantity), 6) AS f FROM lineitem", longs="k", rounds=dict.fromkeys("abcdef", 6))
register("bit_fns", "{ print $1, and($1, 7), or($2, 1), xor($1, $3), lshift($4, 2), rshift($1, 1) }", "lineitem", "k a b c d e", "SELECT l_orderkey AS k, l_orderkey & 7 AS a, l_partkey | 1 AS b, xor(l_orderkey, l_suppkey) AS c, (l_linenumber::BIGINT << 2) AS d, (l_orderkey >> 1) AS e FROM lineitem", longs="k a b c d e")
register("strftime_day", '{ print $1, strftime("%Y-%m-%d", $1 * 3600) }', "events", "id d", "SELECT event_id AS id, strftime(to_timestamp(event_id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d') AS d FROM events", longs="id")

# aggregation
register("sum_all", "{ s += $6 } END { print s }", "lineitem", "s", "SELECT round(sum(l_extendedprice), 2) AS s FROM lineitem", rounds={"s": 2})
register("count_all", "{ n++ } END { print n, NR }", "orders", "n nr", "SELECT count(*) AS n, count(*) AS nr FROM orders", longs="n nr")
register("avg_ratio", "{ s += $5 } END { print s / NR }", "lineitem", "a", "SELECT round(sum(l_quantity) / count(*), 6) AS a FROM lineitem", rounds={"a": 6})
register("max_min", "{ if ($6 > hi) hi = $6; if (NR == 1 || $5 < lo) lo = $5 } END { print hi, lo }", "lineitem", "hi lo", "SELECT max(l_extendedprice) AS hi, min(l_quantity) AS lo FROM lineitem")
register("argmax", "{ if ($4 > m) { m = $4; r = $1 } } END { print m, r }", "customer", "m r", "SELECT c_acctbal AS m, c_custkey AS r FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1", order="c_custkey", longs="r")
register("longest_line", "{ if (length($2) > max) max = length($2) } END { print max }", "documents", "n", "SELECT max(length(text))::BIGINT AS n FROM documents", longs="n", columns="doc_id text")
register("group_sum", "$5 > 10 { n[$9]++; s[$9] += $6 } END { for (k in s) print k, n[k], s[k] }", "lineitem", "flag n s", "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity > 10 GROUP BY 1", longs="n", rounds={"s": 2})
register("group_high_cardinality", "{ s[$2] += $5; n[$2]++ } END { for (k in s) print k, n[k], s[k] }", "lineitem", "part n s", "SELECT l_partkey::VARCHAR AS part, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1", longs="n")
register("group_multi_key", "{ a[$9, $10] += $5 } END { for (k in a) { split(k, p, SUBSEP); print p[1], p[2], a[k] } }", "lineitem", "flag status q", "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2")
register("group_avg", "{ s[$5] += $4; n[$5]++ } END { for (k in s) print k, s[k] / n[k] }", "customer", "seg a", "SELECT c_mktsegment AS seg, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY 1", rounds={"a": 4})
register("having", "{ n[$2]++ } END { for (k in n) if (n[k] > 10) print k, n[k] }", "orders", "cust n", "SELECT o_custkey::VARCHAR AS cust, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10", longs="n")
register("pct_of_total", "{ s[$9] += $5 } END { for (k in s) t += s[k]; for (k in s) print k, 100 * s[k] / t }", "lineitem", "flag pct", "SELECT l_returnflag AS flag, round(100 * sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS pct FROM lineitem GROUP BY 1", rounds={"pct": 6})
register("word_freq", '{ t = tolower($2); gsub(/[^a-z0-9_ \\t\\n]/, "", t); $0 = t; for (i = 1; i <= NF; i++) freq[$i]++ } END { for (w in freq) print w, freq[w] }', "documents", "w n", r"SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_ \t\n]', '', 'g'), '[ \t\n]+')) AS w FROM documents) WHERE w <> '' GROUP BY w", longs="n", columns="doc_id text")
register("first_last_value", "{ last[$4] = $1; if (!($4 in first)) first[$4] = $1 } END { for (k in last) print k, first[k], last[k] }", "events", "t a b", "SELECT event_type AS t, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1", order="event_id", longs="a b")
register("group_max", "{ if ($5 > m[$4]) m[$4] = $5 } END { for (k in m) print k, m[k] }", "events", "t m", "SELECT event_type AS t, greatest(max(value), 0) AS m FROM events GROUP BY 1")
register("dedupe", "!seen[$4]++ { print $1, $4 }", "events", "id t", "SELECT min(event_id) AS id, event_type AS t FROM events GROUP BY 2", order="event_id", longs="id")
register("dedupe_first_line", "{ if (data[$3]++ == 0) print $1, $3 }", "events", "id u", "SELECT min(event_id) AS id, user_id AS u FROM events GROUP BY 2", order="event_id", longs="id u")
register("count_distinct", "{ u[$3]++ } END { print length(u) }", "events", "n", "SELECT count(DISTINCT user_id) AS n FROM events", longs="n")
register("histogram", "{ h[int($4 / 100)]++ } END { for (b in h) print b, h[b] }", "customer", "b n", "SELECT trunc(c_acctbal / 100)::BIGINT::VARCHAR AS b, count(*) AS n FROM customer GROUP BY 1", longs="n")
register("cond_counts", '$4 == "click" { c++ } $5 > 100 { big++ } $4 ~ /^p/ { p++ } END { print c, big, p }', "events", "c big p", "SELECT count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (value > 100) AS big, count(*) FILTER (starts_with(event_type, 'p')) AS p FROM events", longs="c big p")
register("str_accumulate", '{ s[$3] = s[$3] $1 "," } END { for (k in s) print k, s[k] }', "nation", "r names", "SELECT n_regionkey::VARCHAR AS r, string_agg(n_nationkey || ',', '' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1", order="n_nationkey")
register("tumbling_count", "{ b[int($1 / 3600)]++ } END { for (k in b) print k, b[k] }", "events", "h n", "SELECT (event_id // 3600)::VARCHAR AS h, count(*) AS n FROM events GROUP BY 1", longs="n")
register("field_loop_sum", "{ for (i = 3; i <= NF; i++) s += $i } END { print s }", "supplier", "s", "SELECT round(sum(s_nationkey + s_acctbal), 2) AS s FROM supplier", rounds={"s": 2})

# joins and set operations
register("lookup_join", "NR == FNR { name[$1] = $2; next } $2 in name { print $1, name[$2] }", "customer orders", "k name", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey", longs="k")
register("left_lookup", "NR == FNR { if ($4 > 5000) rich[$1] = $4; next } { print $1, rich[$2] }", "customer orders", "k bal", "SELECT o_orderkey AS k, coalesce(c_acctbal, 0) AS bal FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000", longs="k")
register("semi_join", 'NR == FNR { if ($5 == "BUILDING") b[$1] = 1; next } $2 in b { print $1 }', "customer orders", "k", "SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", longs="k")
register("anti_join", "NR == FNR { has[$2] = 1; next } !($1 in has) { print $1 }", "orders customer", "k", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", longs="k")
register("composite_join", "NR == FNR { seen[$2, $3] = $5; next } ($1, $3) in seen { print $1, $3, seen[$1, $3] }", "lineitem supplier", "k n q", "SELECT DISTINCT s_suppkey AS k, s_nationkey::BIGINT AS n, arg_max(l_quantity, (l_orderkey, l_linenumber)) OVER (PARTITION BY s_suppkey) AS q FROM supplier JOIN lineitem ON l_partkey = s_suppkey AND l_suppkey = s_nationkey", longs="k n", order="l_orderkey l_linenumber")
register("aggregated_lookup", "NR == FNR { t[$2] += $4; next } { print $1, t[$1] }", "orders customer", "k t", "SELECT c_custkey AS k, round(coalesce(sum(o_totalprice), 0), 2) AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", longs="k", rounds={"t": 2})
register("intersect_keys", "NR == FNR { a[$3] = 1; next } $3 in a && !done[$3]++ { print $3 }", "supplier customer", "n", "SELECT DISTINCT c_nationkey::BIGINT AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)", longs="n", order="c_custkey")
register("except_keys", "NR == FNR { a[$3] = 1; next } !($1 in a) { print $1, $2 }", "supplier nation", "n name", "SELECT n_nationkey::BIGINT AS n, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)", longs="n")

# order, limits and windows
register("limit_n", "NR <= 10 { print NR, $1 }", "events", "n id", "SELECT event_id + 1 AS n, event_id AS id FROM events WHERE event_id < 10", order="event_id", longs="n id")
register("head_exit", "{ print $1 } NR == 20 { exit }", "events", "id", "SELECT event_id AS id FROM events ORDER BY 1 LIMIT 20", order="event_id", longs="id")
register("exit_on_value", '$4 == "error" { exit } { n++ } END { print n }', "events", "n", "SELECT count(*) AS n FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'error')", order="event_id", longs="n")
register("every_kth", "NR % 7 == 0 { print NR, $1 }", "events", "n id", "SELECT n, id FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, event_id AS id FROM events) WHERE n % 7 = 0", order="event_id", longs="n id")
register("last_record", "END { print $1, NR }", "events", "id n", "SELECT max(event_id)::VARCHAR AS id, count(*) AS n FROM events", order="event_id", longs="n")
register("lag_delta", "{ print $1, $5 - p; p = $5 }", "events", "id d", "SELECT event_id AS id, round(value - coalesce(lag(value) OVER (ORDER BY event_id), 0), 4) AS d FROM events", order="event_id", longs="id", rounds={"d": 4})
register("keyed_lag", "{ print $1, $5 - p[$4]; p[$4] = $5 }", "events", "id d", "SELECT event_id AS id, round(value - coalesce(lag(value) OVER (PARTITION BY event_type ORDER BY event_id), 0), 4) AS d FROM events", order="event_id", longs="id", rounds={"d": 4})
register("running_sum", "{ s += $5; print $1, s }", "events", "id s", "SELECT event_id AS id, round(sum(value) OVER (ORDER BY event_id), 2) AS s FROM events", order="event_id", longs="id", rounds={"s": 2})
register("keyed_running_sum", "{ s[$3] += $5; print $1, s[$3] }", "events", "id s", "SELECT event_id AS id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 2) AS s FROM events", order="event_id", longs="id", rounds={"s": 2})
register("running_max", "{ if ($5 > m) m = $5; print $1, m }", "events", "id m", "SELECT event_id AS id, greatest(max(value) OVER (ORDER BY event_id), 0) AS m FROM events", order="event_id", longs="id")
register("keyed_rank", "{ print $1, ++c[$4] }", "events", "id r", "SELECT event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events", order="event_id", longs="id r")
register("last_seen", '{ print $1, seen[$3]; if ($4 == "purchase") seen[$3] = $1 }', "events", "id s", "SELECT event_id AS id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM events", order="event_id", longs="id s")
register("range_pattern", '$4 == "signup", $4 == "error" { print $1, $4 }', "events", "id t", "SELECT id, t FROM (SELECT event_id AS id, event_type AS t, coalesce(last_value(CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 1 END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM events) WHERE inside = 1 OR t = 'signup'", order="event_id", longs="id")
register("group_break", '$4 != p { g++ } { p = $4; print $1, g }', "events", "id g", "SELECT event_id AS id, sum(b) OVER (ORDER BY event_id)::BIGINT AS g FROM (SELECT event_id, (event_type <> coalesce(lag(event_type) OVER (ORDER BY event_id), ''))::INT AS b FROM events)", order="event_id", longs="id g")


def _moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring-buffer idiom over five records, as a frame."""
    from recordflow.operators.idioms import moving_average

    return shaped(moving_average(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], "value", 5, "m").select(F.col("event_id").alias("id"), "m"), "id", {"m": 4})


def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """print | "sort -k2,2nr" and the first ten lines of it."""
    from recordflow.sources.sinks import sort_pipe

    lines = Program('{ print $1 " " int($4) }').run(table(spark, sf_dir, "customer"), names=["value"], relational=True)
    return sort_pipe(lines, "-k2,2nr").limit(10)


def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordflow.operators.idioms import tail

    return tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("t")), ["id"], 15)


def _union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select("c_nationkey", "c_name")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("c_name"))
    return shaped(Program("$1 < 5 { print $1, $2 }").run(a.unionByName(b), names=["n", "name"], relational=True), "n")


def _union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.lit(0).alias("src"), F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.lit(1).alias("src"), F.col("s_suppkey").alias("k"))
    return shaped(Program("!seen[$1]++ { print $1 }").run(a.unionByName(b), names=["n"], order_by=["src", "k"], relational=True), "n")


def _theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations and regions under an inequality: two arrays in nested loops."""
    from recordflow.operators.idioms import theta_join

    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return theta_join(n, r, F.col("n_regionkey") < F.col("r_regionkey")).select(F.col("n_name").alias("n"), F.col("r_name").alias("r"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rand() < p: the language's random numbers differ by implementation; only what is
    drawn is defined, so this keeps every row's own draw apart and counts the table."""
    df = Program("{ r = rand(); print $1, (r >= 0 && r < 1) }").run(table(spark, sf_dir, "customer"), names=["k", "ok"], relational=True)
    return shaped(df, "k ok")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline records of all texts: how many start with a capital, fields in all."""
    records = cut_records(table(spark, sf_dir, "documents"), "text").select("value")
    return shaped(Program("/^[A-Z]/ { cap++ } { words += NF } END { print NR, cap, words }").run(records, names=["n", "cap", "words"], relational=True), "n cap words")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph records (RS empty) of texts whose sentences were set apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    records = cut_records(docs, "text", "").select("value")
    return shaped(Program('BEGIN { RS = "" } { n[NF]++ } END { for (k in n) print k, n[k] }').run(records, names=["words", "n"], relational=True), "n")


def _regex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut at a regular expression."""
    records = cut_records(table(spark, sf_dir, "documents"), "text", "[.]+[ \n]*").select("value")
    return shaped(Program("length($0) > 40 { long++ } END { print NR, long }").run(records, names=["n", "long"], relational=True), "n long")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV records with quotes, doubled quotes and commas inside."""
    c = table(spark, sf_dir, "customer")
    line = F.concat(F.lit('"'), "c_name", F.lit(', ""x""",'), F.col("c_custkey").cast("string"), F.lit(',"'), "c_mktsegment", F.lit('"'))
    return shaped(Program("{ print $2, $1, $3, NF }", csv=True).run(c.select(line.alias("value")), names=["k", "name", "seg", "nf"], relational=True), "k nf").withColumn("k", F.col("k").cast("bigint"))


for _name, _run, _sql in (
    ("line_records", _lines, r"SELECT count(*) AS n, count(*) FILTER (regexp_matches(v, '^[A-Z]')) AS cap, sum(len(list_filter(string_split_regex(v, '[ \t]+'), lambda x: x <> '')))::BIGINT AS words FROM (SELECT unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS v FROM documents WHERE text <> '')"),
    ("paragraph_records", _paragraphs, r"SELECT w::VARCHAR AS words, count(*) AS n FROM (SELECT len(list_filter(string_split_regex(v, '[ \t\n]+'), lambda x: x <> '')) AS w FROM (SELECT unnest(string_split_regex(t, '\n\n+')) AS v FROM (SELECT regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10)), '^\n+', ''), '\n+$', '') AS t FROM documents) WHERE t <> '')) GROUP BY 1"),
    ("regex_records", _regex_records, r"SELECT count(*) AS n, count(*) FILTER (length(v) > 40) AS long FROM (SELECT unnest(string_split_regex(regexp_replace(text, '[.]+[ \n]*$', ''), '[.]+[ \n]*')) AS v FROM documents WHERE text <> '')"),
    ("csv_records", _csv, """SELECT c_custkey AS k, c_name || ', "x"' AS name, c_mktsegment AS seg, 3::BIGINT AS nf FROM customer"""),
    ("moving_avg", _moving_average, "SELECT event_id AS id, round(avg(value) OVER (ORDER BY event_id ROWS 4 PRECEDING), 4) AS m FROM events"),
    ("sort_pipe_top_k", _top_k, "SELECT c_custkey || ' ' || trunc(c_acctbal)::BIGINT AS value FROM customer ORDER BY trunc(c_acctbal) DESC, value DESC LIMIT 10"),
    ("tail_n", _tail, "SELECT event_id AS id, event_type AS t FROM events ORDER BY event_id DESC LIMIT 15"),
    ("union_all", _union_all, "SELECT c_nationkey::BIGINT AS n, c_name AS name FROM customer WHERE c_nationkey < 5 UNION ALL SELECT s_nationkey, s_name FROM supplier WHERE s_nationkey < 5"),
    ("union_distinct", _union_distinct, "SELECT c_nationkey::BIGINT AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    ("theta_join", _theta_join, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey < r_regionkey"),
    ("rand_range", _sample, "SELECT c_custkey AS k, 1::BIGINT AS ok FROM customer"),
):
    QUERIES[_name] = _run
    ORACLE_SQL[_name] = _sql


# statements, arrays and functions that records keep to themselves
register("while_loop", "{ n = $1; c = 0; while (n > 1) { n = int(n / 2); c++ } print $1 \":\" c }", "orders", "s", "SELECT o_orderkey || ':' || (length(bin(greatest(o_orderkey, 1))) - 1) AS s FROM orders")
register("break_continue", "{ s = 0; for (i = 1; i <= 10; i++) { if (i % 2) continue; if (i > $4) break; s += i } print $1 \":\" s }", "lineitem", "s", "SELECT l_orderkey || ':' || coalesce(list_sum(list_filter(range(1, l_linenumber + 1), lambda i: i % 2 = 0)), 0)::BIGINT AS s FROM lineitem")
register("do_loop", "{ n = $1; d = \"\"; do { d = (n % 8) d; n = int(n / 8) } while (n > 0); print $1 \" \" d }", "events", "s", "SELECT event_id || ' ' || printf('%o', event_id) AS s FROM events")
register("delete_element", "{ split($2, a, \" \"); delete a[1]; n = 0; for (k in a) n++; print $1 \":\" n \":\" (1 in a) (2 in a) }", "part", "s", "SELECT p_partkey || ':' || (n - 1) || ':0' || (n > 1)::INT AS s FROM (SELECT p_partkey, len(string_split(p_name, ' ')) AS n FROM part)")
register("read_creates", "{ split(\"\", a); x = a[\"q\"]; n = 0; for (k in a) n++; print $1 \":\" n ((\"z\" in a) ? \"y\" : \"n\") length(a) }", "customer", "s", "SELECT c_custkey || ':1n1' AS s FROM customer")
register("recursion", "function f(n) { return n < 2 ? n : f(n - 1) + f(n - 2) } { print $1 \":\" f($4) }", "lineitem", "s", "SELECT l_orderkey || ':' || [1, 1, 2, 3, 5, 8, 13][l_linenumber] AS s FROM lineitem")
register("arrays_by_reference", "function fill(a, n,  i) { for (i = 1; i <= n; i++) a[i] = i * i } { delete q; fill(q, $4); s = 0; for (k in q) s += q[k]; print $1 \":\" s }", "lineitem", "s", "SELECT l_orderkey || ':' || (l_linenumber * (l_linenumber + 1) * (2 * l_linenumber + 1) // 6) AS s FROM lineitem")
register("function_effects", "function show(x) { if (x > 40) print \"big\"; n = x * 2; return n + 1 } { n = 0; y = show($5); print n \":\" y }", "lineitem", "s", "SELECT 2 * l_quantity::BIGINT || ':' || 2 * l_quantity::BIGINT + 1 AS s FROM lineitem UNION ALL SELECT 'big' FROM lineitem WHERE l_quantity > 40")
register("dynamic_regex", "{ print $1 \":\" ($2 ~ $1) ($2 ~ (\"^\" substr($2, 1, 3) \".*\" $3 \"$\")) }", "customer", "s", "SELECT c_custkey || ':' || regexp_matches(c_name, c_custkey::VARCHAR)::INT || ends_with(substr(c_name, 4), c_nationkey::VARCHAR)::INT AS s FROM customer")
register("toggle_delete", "{ if ($3 in a) { print $3 \":\" a[$3] \":\" $1; delete a[$3] } else a[$3] = $1 }", "events", "s", "SELECT user_id || ':' || p || ':' || event_id AS s FROM (SELECT *, row_number() OVER w AS r, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r % 2 = 0", order="event_id", relational=False)
register("expression_statement", "{ length($2); $3 + 1; print $1 }", "nation", "k", "SELECT n_nationkey::BIGINT AS k FROM nation", longs="k")
register("missing_action", "$3 == 2", "nation", "line", "SELECT concat_ws(' ', n_nationkey, n_name, n_regionkey) AS line FROM nation WHERE n_regionkey = 2")
register("begin_only", "BEGIN { for (i = 1; i <= 9; i++) print i \" \" i * i }", "nation", "line", "SELECT i || ' ' || i * i AS line FROM range(1, 10) t(i)")
register("seeds", "BEGIN { srand(5); a = srand(7); x = rand(); srand(7); print a, (x == rand()), (x >= 0 && x < 1) }", "nation", "line", "SELECT '5 1 1' AS line")
register("clock", "{ t = systime(); print $1, (t > 1600000000 && t < 9000000000 && t == int(t)) }", "nation", "k ok", "SELECT n_nationkey::BIGINT AS k, 1::BIGINT AS ok FROM nation", longs="k ok")
register("subsep", 'BEGIN { SUBSEP = ":" } { a[$9, $10] += $5 } END { for (k in a) print k, a[k] }', "lineitem", "k q", "SELECT l_returnflag || ':' || l_linestatus AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
register("convfmt", 'BEGIN { CONVFMT = "%.3f" } { print $1 ":" $6 / 7 }', "lineitem", "s", "SELECT l_orderkey || ':' || CASE WHEN l_extendedprice / 7 = trunc(l_extendedprice / 7) THEN (l_extendedprice / 7)::BIGINT::VARCHAR ELSE printf('%.3f', l_extendedprice / 7) END AS s FROM lineitem")
register("double_text", '{ print $1 ":" $6 }', "lineitem", "s", "SELECT l_orderkey || ':' || CASE WHEN l_extendedprice = trunc(l_extendedprice) THEN l_extendedprice::BIGINT::VARCHAR ELSE l_extendedprice::VARCHAR END AS s FROM lineitem")
register("regex_dot", '{ s = $2 "\\n" $1; m = match(s, /E.*$/); print $1 ":" (s ~ /..\\n./) (s ~ /^.+$/) RSTART "," RLENGTH }', "nation", "s", "SELECT n_nationkey || ':11' || greatest(p, 0) || ',' || CASE WHEN p = 0 THEN -1 ELSE length(n_name) + 1 + length(n_nationkey::VARCHAR) - p + 1 END AS s FROM (SELECT *, strpos(n_name, 'E') AS p FROM nation)")
register("regex_escapes", '{ print $1, ($2 ~ /^\\x43u\\163/), ($2 ~ /\\u0043\\t/), ($2 ~ /#\\060/), ($2 ~ /r\\#/) }', "customer", "k a b c d", "SELECT c_custkey AS k, 1::BIGINT AS a, 0::BIGINT AS b, (strpos(c_name, '#0') > 0)::BIGINT AS c, (strpos(c_name, 'r#') > 0)::BIGINT AS d FROM customer", longs="k a b c d")
register("regex_repetition", '{ print $1, ($2 ~ /0{5,8}[1-9]/), ($2 ~ /(er#){1}/), ($2 ~ /C{2}/), ($2 ~ /x{|#/) }', "customer", "k a b c d", "SELECT c_custkey AS k, regexp_matches(c_name, '0{5,8}[1-9]')::BIGINT AS a, (strpos(c_name, 'er#') > 0)::BIGINT AS b, 0::BIGINT AS c, (strpos(c_name, '#') > 0)::BIGINT AS d FROM customer", longs="k a b c d")
register("regex_classes", '{ print $1, ($2 ~ /[]#]/), ($2 ~ /[^[:alnum:]]/), ($2 ~ /^[[:upper:]][[:lower:]]+#[[:digit:]]+$/), ($2 ~ /[z-a]/), ($2 ~ /(s)\\1/) }', "customer", "k a b c d e", "SELECT c_custkey AS k, 1::BIGINT AS a, 1::BIGINT AS b, 1::BIGINT AS c, 0::BIGINT AS d, (strpos(c_name, 's1') > 0)::BIGINT AS e FROM customer", longs="k a b c d e")
register("regex_units", '{ s = $2 "é漢"; print $1, length(s) - length($2), match(s, /é.$/) - length($2), gsub(/[^ -~]/, "?", s), substr(s, length(s) - 1) }', "nation", "k n m g t", "SELECT n_nationkey::BIGINT AS k, 2::BIGINT AS n, 1::BIGINT AS m, 2::BIGINT AS g, '??' AS t FROM nation", longs="k n m g")
register("multi_match_join", "NR == FNR { a[$3] = a[$3] \"|\" $2; next } { n = split(a[$1], p, \"|\"); for (i = 2; i <= n; i++) print $2 \" \" p[i] }", "nation region", "s", "SELECT r_name || ' ' || n_name AS s FROM region JOIN nation ON n_regionkey = r_regionkey", order="n_nationkey r_regionkey", relational=False)
register("getline_pairs", "{ a = $2; if ((getline) > 0) print a \"+\" $2; else print a }", "nation", "s", "SELECT n_name || coalesce('+' || nx, '') AS s FROM (SELECT n_nationkey, n_name, lead(n_name) OVER (ORDER BY n_nationkey) AS nx FROM nation) WHERE n_nationkey % 2 = 0", order="n_nationkey", relational=False)
register("gsub_text", '{ s = $2; n = gsub(/[aeiou]+/, "<&>", s); print $1, n, length(s) }', "documents", "k n size", "SELECT doc_id AS k, len(regexp_extract_all(text, '[aeiou]+'))::BIGINT AS n, length(regexp_replace(text, '[aeiou]+', '<\\0>', 'g'))::BIGINT AS size FROM documents", longs="k n size", columns="doc_id text")
register("regex_text", "$2 ~ /(th|sch)[aeiou]+n/ { print $1, match($2, /[.!?]/) }", "documents", "k at", "SELECT doc_id AS k, CASE WHEN regexp_matches(text, '[.!?]') THEN length(regexp_extract(text, '^[^.!?]*')) + 1 ELSE 0 END::BIGINT AS at FROM documents WHERE regexp_matches(text, '(th|sch)[aeiou]+n')", longs="k at", columns="doc_id text")
register("sprintf_lines", '{ print sprintf("%05d|%.2f|%-3s|%x", $1, $6, $9, $3) }', "lineitem", "s", "SELECT printf('%05d|%.2f|', l_orderkey, l_extendedprice) || rpad(l_returnflag, 3, ' ') || '|' || printf('%x', l_suppkey) AS s FROM lineitem")
register("keep_first_of_keys", "{ if (!($2 in s)) { print $1 \" \" $2; s[$2] = 1 } }", "orders", "s", "SELECT min(o_orderkey) || ' ' || o_custkey AS s FROM orders GROUP BY o_custkey", order="o_orderkey")


def _spool(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads: on a cluster in the warehouse,
    which executors share."""
    if spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="recordflow-")
        atexit.register(shutil.rmtree, base, True)
        return f"{base}/{name}"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/recordflow-{uuid.uuid4().hex}/{name}"


def _as_file(df: DataFrame, name: str, order: str, line: Column) -> str:
    """A small table as one text file, a line a row."""
    path = _spool(df.sparkSession, name)
    df.select(order, line.alias("value")).repartition(1).sortWithinPartitions(order).select("value").write.text(path)
    return path


def _two_files(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return read_text(spark, [_as_file(n, "nation", "n_nationkey", F.concat_ws(" ", "n_nationkey", "n_name")), _as_file(r, "region", "r_regionkey", F.concat_ws(" ", "r_regionkey", "r_name"))], **how)


def _file_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files one after the other: NR over both, FNR and FILENAME of each."""
    p = Program('{ k = split(FILENAME, p, "/"); print NR ":" FNR ":" substr($0, index($0, " ") + 1) ":" (p[k - 1] == "region") }')
    return p.run(_two_files(spark, sf_dir), names=["s"], relational=True)


def _nextfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Program('FNR > 3 { nextfile } { print FNR ":" $2 }').run(_two_files(spark, sf_dir), names=["s"], relational=True)


def _between_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BEGINFILE and ENDFILE."""
    return Program('BEGINFILE { n = 0 } { n++ } ENDFILE { print n ":" FNR ":" NR }').run(_two_files(spark, sf_dir), names=["s"])


def _file_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is summed up within a file and printed after it: a fold by file."""
    p = Program('BEGINFILE { s = 0; m = 0 } { s += length($2) } length($2) > m { m = length($2) } ENDFILE { print FNR ":" s ":" m }')
    return p.run(_two_files(spark, sf_dir), names=["s"], relational=True)


def _operand_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region")
    return Program('{ print x ":" $2 ":" y }').run(["x=1", n, "x=two", "y=5", r], names=["s"], relational=True)


def _slurped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """getline from a file in BEGIN fills an array, which records look up: a join."""
    import glob

    path = _as_file(table(spark, sf_dir, "customer"), "customer", "c_custkey", F.concat_ws(" ", "c_custkey", "c_mktsegment"))
    files = sorted(glob.glob(f"{path}/part-*"))
    if not files:  # not on this machine: read by Spark
        files = [_local_copy(spark, path)]
    p = Program('BEGIN { while ((getline line < f) > 0) { split(line, p, " "); seg[p[1]] = p[2] } } $2 in seg { print $1 ":" seg[$2] }', variables=[("f", files[0])])
    return p.run(table(spark, sf_dir, "orders"), names=["s"], relational=True)


def _local_copy(spark: SparkSession, path: str) -> str:
    base = tempfile.mkdtemp(prefix="recordflow-")
    atexit.register(shutil.rmtree, base, True)
    with open(f"{base}/lines", "w") as f:
        f.writelines(r[0] + "\n" for r in spark.read.text(path).toLocalIterator())
    return f"{base}/lines"


def _one_byte_rs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that end in a full stop; the one after the last stop too, if there is any."""
    records = cut_records(table(spark, sf_dir, "documents"), "text", ".").select("value")
    return shaped(Program("{ n++; w += NF } length($0) > 50 { long++ } END { print n, w, long }").run(records, names=["n", "words", "long"], relational=True), "n words long")


def _rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT: which separator ended a record."""
    records = cut_records(table(spark, sf_dir, "documents"), "text", "[.,]+", rt=True).select("value", "rt")
    return shaped(Program("{ n[RT]++ } END { for (k in n) print k, n[k] }").run(records, names=["rt", "n"], relational=True), "n")


def _rs_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RS set while records are read holds for what is left: read in sequence."""
    lines = table(spark, sf_dir, "region").select(F.lit("").alias("__file"), F.col("r_regionkey").alias("__pos"), F.concat("r_name", F.lit(";x"), F.col("r_regionkey").cast("string"), F.lit(";")).alias("value"))
    return Program('{ gsub(/\\n/, ""); RS = ";"; print NR ":" $0 }').run(lines, names=["s"])


def _fs_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FS set by a record holds from the next one on."""
    lines = table(spark, sf_dir, "nation").select(F.lit("").alias("__file"), F.col("n_nationkey").alias("__pos"), F.concat(F.lit("k "), F.col("n_name"), F.lit(":"), F.col("n_regionkey").cast("string")).alias("value"))
    return Program('{ print $1; FS = ":" }').run(lines, names=["s"])


def _field_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty FS, -F t, and a line feed that separates fields of paragraphs too."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    letters = Program('{ print NF ":" $1 ":" $NF }', fs="").run(n.select(F.col("n_name").alias("value")), names=["s"], relational=True)
    tabs = Program('{ print $2 "/" NF }', fs="t").run(n.select(F.concat_ws("\t", "n_nationkey", "n_name").alias("value")), names=["s"], relational=True)
    lines = Program('BEGIN { RS = "" } { print NF "," $2 "," $3 }', fs=":").run(n.select(F.concat(F.lit("a:"), "n_name", F.lit("\n"), F.col("n_regionkey").cast("string")).alias("value")), names=["s"], relational=True)
    return letters.unionByName(tabs).unionByName(lines)


def _lenient_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes inside a field, text after a closing quote, and a quote that stays open."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("n_nationkey").cast("string")
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(k, F.lit(',ab"c,"d""e"'))).when(F.col("n_nationkey") % 3 == 1, F.concat(k, F.lit(',"x"y,z'))).otherwise(F.concat(k, F.lit(',"open, '), "n_name"))
    return Program('{ print $1 "|" NF "|" $2 "|" $3 }', csv=True).run(n.select(line.alias("value")), names=["s"], relational=True)


def _csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with line feeds inside quotes, read as records."""
    n = table(spark, sf_dir, "nation")
    path = _as_file(n, "csv", "n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('\n""q"", x"')))
    return Program('{ gsub(/\\n/, "/", $2); print NR ":" $1 ":" $2 }', csv=True).run(read_text(spark, path, csv=True), names=["s"], relational=True)


def _exact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers beyond 2^53 as text, as keys and as join keys."""
    big = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 9007199254740992).alias("k"), "o_custkey")
    text = Program('{ print "t " $1 "-" $2 }').run(big, names=["s"], relational=True)
    keys = Program('{ n[$1]++ } END { for (k in n) print "n " k "=" n[k] }').run(big, names=["s"], relational=True)
    joined = Program('NR == FNR { c[$1] = $2; next } $1 in c { print "j " $1 ">" c[$1] }').run([big, big.filter("k % 2 = 0")], names=["s"], relational=True)
    return text.unionByName(keys).unionByName(joined)


def _output_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OFMT in print, CONVFMT in concatenation, ORS and OFS."""
    p = Program('BEGIN { OFMT = "%.2f"; CONVFMT = "%.4f"; OFS = "|" } { print $6 / 7, ($6 / 7) "", $4 / 2 }')
    return p.run(table(spark, sf_dir, "lineitem"), typed=False, relational=True).select(F.col("value").alias("s"))


def _file_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """print > file, appended to once more, and read back."""
    from recordflow.sources.sinks import write_targets

    path = _spool(spark, "targets")
    n = table(spark, sf_dir, "nation")
    write_targets(Program('{ print $2 > ("region" $3) }', safe=False).targets(n), path)
    write_targets(Program('$3 == 1 { print "again", $1 >> ("region" $3) }', safe=False).targets(n), path, append=True)
    return spark.read.text(path).select("target", "value")


def _line_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordflow.sources.sinks import write_lines

    path = _spool(spark, "lines")
    write_lines(Program("{ print $2, $3 }").run(table(spark, sf_dir, "nation"), typed=False, relational=True), path)
    return spark.read.text(path)


def _driver_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands, the environment and arguments, which belong to the driver."""
    p = Program('BEGIN { "echo 5" | getline x; print "cmd", x, close("echo 5"), close("none"); print "system", system("exit 3"), system("true"); print "fflush", fflush(); print "env", (length(ENVIRON["PATH"]) > 0); print "arg", ARGC, ("0" in ARGV); print "out" > "/dev/stdout" }', safe=False)
    return p.run(table(spark, sf_dir, "region"), names=["line"])


def _static_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that are refused before they run, and some that are not."""
    from recordflow.lang.nodes import ProgramError

    def refused(text: str) -> int:
        try:
            Program(text)
        except ProgramError:
            return 1
        return 0

    return spark.createDataFrame([(i, refused(t)) for i, t in enumerate(CHECKED)], "program long, refused long")


# The first dozen is refused, the others are not.
CHECKED = (
    'BEGIN { system("true") }', 'BEGIN { "date" | getline }', '{ print > "x" }', "{ print /a$^b/ }", "{ print /[a/ }", "function f(a, a) { } { f(1) }", "function f(x) { } function f(y) { }", "function f(f) { }", "BEGIN { next }", "{ break }", "{ return 1 }", "{ print f(1) }",
    "{ print length ($0) }", "function f(x) { return x } { print f(1) }", "{ print /a{2}/ }", "{ nextfile }",
)


def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line over standard input, an assignment and an option."""
    import subprocess
    import sys
    from pathlib import Path

    text = "".join(f"{r[0]}:{r[1]}\n" for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect())  # five rows
    done = subprocess.run([sys.executable, "-m", "recordflow", "-F", ":", "-v", "n=2", '{ s += $1 * n; print x $2 } END { print s }', "x=r:", "-"], input=text, capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
    return spark.createDataFrame([(x,) for x in done.stdout.splitlines()], "line string")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed fold over a stream of a table's files, until it is drained."""
    from recordflow.streaming.runner import stream

    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    name = f"recordflow_{uuid.uuid4().hex}"
    query = stream(Program("$5 > 10 { n[$4]++; s[$4] += $5 } END { for (k in n) print k, n[k], s[k] }"), source, ["t", "n", "s"]).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return shaped(spark.table(name), "n", {"s": 2})


for _name, _run, _sql in (
    ("file_operands", _file_operands, "SELECT n_nationkey + 1 || ':' || n_nationkey + 1 || ':' || n_name || ':0' AS s FROM nation UNION ALL SELECT r_regionkey + 26 || ':' || r_regionkey + 1 || ':' || r_name || ':1' FROM region"),
    ("nextfile", _nextfile, "SELECT n_nationkey + 1 || ':' || n_name AS s FROM nation WHERE n_nationkey < 3 UNION ALL SELECT r_regionkey + 1 || ':' || r_name FROM region WHERE r_regionkey < 3"),
    ("between_files", _between_files, "SELECT '25:25:25' AS s UNION ALL SELECT '5:5:30'"),
    ("file_folds", _file_folds, "SELECT count(*) || ':' || sum(length(v)) || ':' || max(length(v)) AS s FROM (SELECT string_split(n_name, ' ')[1] AS v FROM nation) UNION ALL SELECT count(*) || ':' || sum(length(v)) || ':' || max(length(v)) FROM (SELECT string_split(r_name, ' ')[1] AS v FROM region)"),
    ("assigned_operands", _operand_assignments, "SELECT '1:' || n_name || ':' AS s FROM nation UNION ALL SELECT 'two:' || r_name || ':5' FROM region"),
    ("slurped_lookup", _slurped, "SELECT o_orderkey || ':' || c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey"),
    ("one_byte_rs", _one_byte_rs, r"SELECT count(*) AS n, sum(len(list_filter(string_split_regex(v, '[ \t\n]+'), lambda x: x <> '')))::BIGINT AS words, count(*) FILTER (length(v) > 50) AS long FROM (SELECT unnest(string_split(regexp_replace(text, '[.]$', ''), '.')) AS v FROM documents WHERE text <> '')"),
    ("record_terminators", _rt, "SELECT rt, count(*) AS n FROM (SELECT coalesce(ends[i], '') AS rt FROM (SELECT ends, unnest(range(1, len(parts) + 1 - (parts[-1] = '')::INT)) AS i FROM (SELECT regexp_extract_all(text, '[.,]+') AS ends, string_split_regex(text, '[.,]+') AS parts FROM documents WHERE text <> ''))) GROUP BY 1"),
    ("rs_changes", _rs_changes, "SELECT CASE WHEN r_regionkey = 0 THEN '1:' || r_name || ';x0;' ELSE 2 * r_regionkey || ':' || r_name END AS s FROM region UNION ALL SELECT 2 * r_regionkey + 1 || ':x' || r_regionkey FROM region WHERE r_regionkey > 0 UNION ALL SELECT '10:'"),
    ("fs_changes", _fs_changes, "SELECT CASE WHEN n_nationkey = 0 THEN 'k' ELSE 'k ' || n_name END AS s FROM nation"),
    ("field_separators", _field_separators, "SELECT length(n_name) || ':' || n_name[1] || ':' || n_name[-1] AS s FROM nation UNION ALL SELECT n_name || '/2' FROM nation UNION ALL SELECT '3,' || n_name || ',' || n_regionkey FROM nation"),
    ("lenient_csv", _lenient_csv, """SELECT n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '|3|ab"c|d"e' WHEN 1 THEN '|2|x"y,z|' ELSE '|2|open, ' || n_name || '|' END AS s FROM nation"""),
    ("csv_file", _csv_file, """SELECT n_nationkey + 1 || ':' || n_nationkey || ':' || n_name || '/"q", x' AS s FROM nation"""),
    ("exact_keys", _exact_keys, "WITH b AS (SELECT o_orderkey + 9007199254740992 AS k, o_custkey FROM orders) SELECT 't ' || k || '-' || o_custkey AS s FROM b UNION ALL SELECT 'n ' || k || '=' || count(*) FROM b GROUP BY k UNION ALL SELECT 'j ' || k || '>' || o_custkey FROM b WHERE k % 2 = 0"),
    ("output_formats", _output_formats, "SELECT CASE WHEN x = trunc(x) THEN x::BIGINT || '|' || x::BIGINT ELSE printf('%.2f|%.4f', x, x) END || '|' || CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber // 2)::VARCHAR ELSE printf('%.2f', l_linenumber / 2) END AS s FROM (SELECT *, l_extendedprice / 7 AS x FROM lineitem)"),
    ("file_targets", _file_targets, "SELECT 'region' || n_regionkey AS target, n_name AS value FROM nation UNION ALL SELECT 'region1', 'again ' || n_nationkey FROM nation WHERE n_regionkey = 1"),
    ("line_sink", _line_sink, "SELECT n_name || ' ' || n_regionkey AS value FROM nation"),
    ("driver_io", _driver_io, "SELECT unnest(['cmd 5 0 -1', 'system 3 0', 'fflush 0', 'env 1', 'arg 1 1', 'out']) AS line"),
    ("static_checks", _static_checks, "SELECT i AS program, (i < 12)::BIGINT AS refused FROM range(16) t(i)"),
    ("command_line", _command_line, "SELECT 'r:' || r_name AS line FROM region UNION ALL SELECT (2 * sum(r_regionkey))::VARCHAR FROM region"),
    ("event_stream", _stream, "SELECT event_type AS t, count(*) AS n, round(sum(value), 2) AS s FROM events WHERE value > 10 GROUP BY 1"),
):
    QUERIES[_name] = _run
    ORACLE_SQL[_name] = _sql
