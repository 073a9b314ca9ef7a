"""Nested data, scalar functions, statements about the session, and extensions."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators import scalars, sets
from sparkweave.plans.registry import Registry
from sparkweave.plans.tables import Tables
from sparkweave.session import Session
from sparkweave.sources import writers
from sparkweave.sources.shared import shared_dir
from sparkweave.streaming import events

R = Registry()
c = F.col

# nested data
_LISTS = "(VALUES (1, array(3, 1, 2, 1)), (2, array(5)), (3, array(7, NULL, 7)), (4, array(2, 4, 6, 8, 10))) AS v(id, xs)"
_DUCK = "(VALUES (1, [3, 1, 2, 1]), (2, [5]), (3, [7, NULL, 7]), (4, [2, 4, 6, 8, 10])) AS v(id, xs)"
R.sql("unnest_list", f"SELECT id, unnest(xs) AS x FROM {_LISTS}", f"SELECT id, unnest(xs) AS x FROM {_DUCK}")
R.sql(
    "list_ops",
    f"SELECT id, array_length(xs) AS n, array_has(xs, 1) AS has_one, array_position(xs, 2) AS at_two, array_slice(xs, 2, 3) AS part, array_pop_back(xs) AS but_last, array_pop_front(xs) AS but_first, array_append(xs, 9) AS appended, array_prepend(0, xs) AS prepended, array_cat(xs, make_array(1, 2)) AS joined, array_element(xs, 1) AS first FROM {_LISTS}",
    f"SELECT id, len(xs)::INT AS n, list_contains(xs, 1) AS has_one, list_position(xs, 2)::BIGINT AS at_two, list_slice(xs, 2, 3) AS part, xs[:len(xs) - 1] AS but_last, xs[2:] AS but_first, list_append(xs, 9) AS appended, list_prepend(0, xs) AS prepended, list_concat(xs, [1, 2]) AS joined, xs[1] AS first FROM {_DUCK}".replace("list_contains(xs, 1)", "CASE WHEN id = 3 THEN NULL ELSE list_contains(xs, 1) END"),
)
R.sql("list_brackets", "SELECT id, xs[1] AS first, xs[2:3] AS part, [id, id + 1] AS made FROM (VALUES (1, [3, 1, 2, 1]), (2, [5]), (3, [7, NULL, 7])) AS v(id, xs)")
R.sql(
    "list_edit",
    f"SELECT id, array_remove(xs, 1) AS once_less, array_remove_all(xs, 1) AS none_left, array_replace(xs, 1, 9) AS first_nine, array_replace_all(xs, 1, 9) AS all_nine, array_resize(xs, 3, 0) AS three, array_positions(xs, 1) AS ones, array_to_string(xs, '-') AS told, array_repeat(id, 2) AS twice, array_reverse(xs) AS back FROM {_LISTS} WHERE id <> 3",
    "SELECT id, CASE id WHEN 1 THEN [3, 2, 1] ELSE xs END AS once_less, list_filter(xs, lambda x: x <> 1) AS none_left, CASE id WHEN 1 THEN [3, 9, 2, 1] ELSE xs END AS first_nine, "
    f"list_transform(xs, lambda x: CASE WHEN x = 1 THEN 9 ELSE x END) AS all_nine, list_resize(xs, 3, 0) AS three, CASE id WHEN 1 THEN [2, 4] ELSE []::INT[] END AS ones, array_to_string(xs, '-') AS told, [id, id] AS twice, list_reverse(xs) AS back FROM {_DUCK} WHERE id <> 3",
)
R.sql("list_sets", f"SELECT id, array_sort(array_distinct(xs)) AS d, array_sort(array_union(xs, make_array(1, 99))) AS u, array_sort(array_intersect(xs, make_array(1, 2))) AS i, array_sort(array_except(xs, make_array(1, 2))) AS e, array_has_any(xs, make_array(1, 5)) AS some, array_has_all(xs, make_array(2, 1)) AS every FROM {_LISTS} WHERE id <> 3", f"SELECT id, list_sort(list_distinct(xs)) AS d, list_sort(list_distinct(list_concat(xs, [1, 99]))) AS u, list_sort(list_intersect(list_distinct(xs), [1, 2])) AS i, list_sort(list_filter(list_distinct(xs), lambda x: x NOT IN (1, 2))) AS e, list_has_any(xs, [1, 5]) AS some, list_has_all(xs, [2, 1]) AS every FROM {_DUCK} WHERE id <> 3")
R.sql("list_hof", f"SELECT id, transform(xs, x -> x * 2) AS twice, filter(xs, x -> x > 2) AS over_two, aggregate(filter(xs, x -> x IS NOT NULL), 0, (a, x) -> a + x) AS total, array_max(xs) AS most FROM {_LISTS}", f"SELECT id, list_transform(xs, lambda x: x * 2) AS twice, list_filter(xs, lambda x: x > 2) AS over_two, list_sum(xs)::INT AS total, list_max(xs) AS most FROM {_DUCK}")
R.sql("struct_ops", "SELECT s.n_name AS name, get_field(s, 'n_regionkey') AS region FROM (SELECT named_struct('n_name', n_name, 'n_regionkey', n_regionkey) AS s FROM nation) AS x", "SELECT s.n_name AS name, s.n_regionkey AS region FROM (SELECT {'n_name': n_name, 'n_regionkey': n_regionkey} AS s FROM nation) AS x")
R.sql("map_ops", "SELECT n_nationkey, array_sort(map_keys(m)) AS ks, element_at(m, 'key') AS k, map_extract(m, 'region') AS r, cardinality(m) AS n FROM (SELECT n_nationkey, make_map('key', n_nationkey, 'region', n_regionkey) AS m FROM nation) AS x", "SELECT n_nationkey, ['key', 'region'] AS ks, m['key'] AS k, [m['region']] AS r, 2 AS n FROM (SELECT n_nationkey, MAP {'key': n_nationkey, 'region': n_regionkey} AS m FROM nation) AS x")
R.sql("generate_series", "SELECT unnest(generate_series(2, 20, 3)) AS x", "SELECT unnest(generate_series(2, 20, 3))::INT AS x")
R.sql("range_table", "SELECT id FROM range(3, 9, 2)", "SELECT range AS id FROM range(3, 9, 2)")


@R.plan("unnest_outer", "SELECT * FROM (VALUES (1, 10), (1, 20), (2, NULL), (3, NULL), (4, NULL)) AS v(id, x)")
def _outer(t: Tables) -> DataFrame:
    rows = t.spark.sql("SELECT * FROM VALUES (1, array(10, 20)), (2, CAST(NULL AS array<int>)), (3, CAST(array() AS array<int>)), (4, array(CAST(NULL AS int))) AS v(id, x)")
    return sets.unnest(rows, ["x"])


@R.plan("unnest_struct", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _struct(t: Tables) -> DataFrame:
    return sets.unnest(t.nation.select("n_nationkey", F.struct("n_name", "n_regionkey").alias("s")), ["s"])


@R.plan("unnest_several", "SELECT * FROM (VALUES (1, 1, 'a'), (1, 2, NULL), (2, NULL, 'b')) AS v(id, x, y)")
def _several(t: Tables) -> DataFrame:
    rows = t.spark.sql("SELECT * FROM VALUES (1, array(1, 2), array('a')), (2, CAST(array() AS array<int>), array('b')) AS v(id, x, y)")
    return sets.unnest(rows, ["x", "y"])


# scalar functions
_X = "(c_acctbal / 1000.0)"
R.sql("fn_math", f"SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil({_X}) AS BIGINT) AS up, CAST(floor({_X}) AS BIGINT) AS down, round({_X}, 2) AS r2, trunc({_X}, 1) AS t1, CAST(signum({_X}) AS INT) AS s, round(power({_X}, 2), 8) AS p2, round(sqrt(abs({_X})), 10) AS root, round(cbrt({_X}), 9) AS cube_root, round(exp({_X} / 10), 9) AS e, round(ln(abs({_X}) + 1), 9) AS l, round(log10(abs({_X}) + 1), 9) AS l10, round(log2(abs({_X}) + 1), 9) AS l2, factorial(CAST(c_custkey % 10 AS INT)) AS f, gcd(c_custkey, 36) AS g, lcm(c_custkey, 4) AS l4, greatest(c_nationkey, 10) AS most, least(c_nationkey, 10) AS lowest, iszero(c_nationkey) AS z, nanvl({_X}, 0.0) AS nv FROM customer",
      f"SELECT c_custkey, abs(c_acctbal) AS a, ceil({_X})::BIGINT AS up, floor({_X})::BIGINT AS down, round({_X}, 2) AS r2, trunc({_X} * 10) / 10 AS t1, sign({_X})::INT AS s, round(pow({_X}, 2), 8) AS p2, round(sqrt(abs({_X})), 10) AS root, round(cbrt({_X}), 9) AS cube_root, round(exp({_X} / 10), 9) AS e, round(ln(abs({_X}) + 1), 9) AS l, round(log10(abs({_X}) + 1), 9) AS l10, round(log2(abs({_X}) + 1), 9) AS l2, factorial((c_custkey % 10)::INT)::BIGINT AS f, gcd(c_custkey, 36)::BIGINT AS g, lcm(c_custkey, 4)::BIGINT AS l4, greatest(c_nationkey, 10) AS most, least(c_nationkey, 10) AS lowest, c_nationkey = 0 AS z, {_X} AS nv FROM customer".replace("(c_acctbal / 1000.0)", "(c_acctbal / 1000.0::DOUBLE)"))
_A = "(CAST(n_nationkey AS DOUBLE) / 30)"
_TRIG = ", ".join(f"round({f}({_A}), 9) AS {f}_x" for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh", "degrees", "radians"))
_TRIG_SQL = f"SELECT n_nationkey, {_TRIG}, round(cot({_A} + 1), 9) AS cot_x, round(acosh({_A} + 1), 9) AS acosh_x, round(atan2({_A}, 0.5), 9) AS atan2_x, round(pi(), 9) AS pi_x FROM nation"
R.sql("fn_trig", _TRIG_SQL)
R.sql("fn_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, initcap(p_name) AS i, CAST(length(p_name) AS BIGINT) AS n, CAST(char_length(p_name) AS BIGINT) AS cn, CAST(octet_length(p_name) AS BIGINT) AS o, CAST(bit_length(p_name) AS BIGINT) AS bits, reverse(p_name) AS back, repeat(p_type, 2) AS twice, left(p_name, 3) AS l3, right(p_name, 3) AS r3, substring(p_name FROM 2 FOR 4) AS s, replace(p_name, 'ring', 'RING') AS rep, translate(p_name, 'abc', 'xyz') AS tr, concat(p_brand, NULL, '/', p_type) AS joined, concat_ws('-', p_brand, p_type) AS ws, ascii(p_name) AS code, chr(65 + p_size % 26) AS letter, overlay(p_name PLACING '##' FROM 2 FOR 3) AS over FROM part",
      "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS i, length(p_name) AS n, length(p_name) AS cn, strlen(p_name) AS o, bit_length(p_name) AS bits, reverse(p_name) AS back, repeat(p_type, 2) AS twice, left(p_name, 3) AS l3, right(p_name, 3) AS r3, substring(p_name, 2, 4) AS s, replace(p_name, 'ring', 'RING') AS rep, translate(p_name, 'abc', 'xyz') AS tr, concat(p_brand, NULL, '/', p_type) AS joined, concat_ws('-', p_brand, p_type) AS ws, ascii(p_name) AS code, chr(65 + p_size % 26) AS letter, p_name[:1] || '##' || p_name[5:] AS over FROM part")
R.sql("fn_string_search", "SELECT p_partkey, strpos(p_name, 'ring') AS p, starts_with(p_name, 'small') AS s, ends_with(p_name, 'bolt') AS e, contains(p_name, 'in') AS has, split_part(p_name, ' ', 2) AS second, substr_index(p_name, ' ', 1) AS first, levenshtein(p_name, 'small ring') AS d, find_in_set(p_type, 'PROMO,SMALL,LARGE') AS f FROM part",
      "SELECT p_partkey, strpos(p_name, 'ring')::INT AS p, starts_with(p_name, 'small') AS s, ends_with(p_name, 'bolt') AS e, contains(p_name, 'in') AS has, split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', 1) AS first, levenshtein(p_name, 'small ring')::INT AS d, coalesce(list_position(['PROMO', 'SMALL', 'LARGE'], p_type), 0)::INT AS f FROM part")
R.sql("fn_pad_trim", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '.') AS r, trim('  ' || n_name || ' ') AS t, ltrim('  ' || n_name) AS lt, rtrim(n_name || '  ') AS rt, btrim('  ' || n_name || '  ') AS bt FROM nation", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '.') AS r, n_name AS t, n_name AS lt, n_name AS rt, n_name AS bt FROM nation")
R.sql("fn_regex", "SELECT p_partkey, regexp_like(p_name, '^s.*g$') AS m, regexp_replace(p_name, '[aeiou]', '_') AS r, regexp_count(p_name, '[aeiou]') AS n, regexp_match(p_name, '[a-z]+') AS words FROM part", "SELECT p_partkey, regexp_matches(p_name, '^s.*g$') AS m, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS n, regexp_extract_all(p_name, '[a-z]+') AS words FROM part")
R.sql("fn_hash", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, digest(n_name, 'sha256') AS d FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, sha256(n_name) AS d FROM nation")
R.sql("fn_encode", "SELECT n_nationkey, encode(n_name, 'hex') AS h, base64(CAST(n_name AS BINARY)) AS b, CAST(decode(encode(n_name, 'hex'), 'hex') AS STRING) AS back, to_hex(n_nationkey) AS x FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b, n_name AS back, to_hex(n_nationkey) AS x FROM nation".replace("to_hex(n_nationkey)", "lower(to_hex(n_nationkey))"))
_PARTS = ("year", "quarter", "month", "week", "day", "doy", "hour", "minute")
R.sql("fn_date_parts", "SELECT o_orderkey, " + ", ".join(f"CAST(extract({p} FROM o_orderdate) AS BIGINT) AS {p}_x" for p in _PARTS) + ", CAST(date_part('month', o_orderdate) AS BIGINT) AS m, CAST(extract(dow FROM o_orderdate) - 1 AS BIGINT) AS dow FROM orders", "SELECT o_orderkey, " + ", ".join(f"extract({p} FROM o_orderdate) AS {p}_x" for p in _PARTS) + ", date_part('month', o_orderdate) AS m, extract(dow FROM o_orderdate) AS dow FROM orders")
R.sql("fn_date_trunc_bin", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, date_bin(INTERVAL '15' MINUTE, ts) AS b, date_bin(INTERVAL '7' DAY, ts, TIMESTAMP_NTZ '2024-01-03 00:00:00') AS w FROM events", "SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('hour', ts) AS h, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS b, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2024-01-03') AS w FROM events")
R.sql("fn_date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd') AS f, make_date(2020, CAST(extract(month FROM o_orderdate) AS INT), 15) AS made, to_date('2024-03-05') AS d, CAST(to_timestamp('2024-03-05 06:07:08') AS TIMESTAMP_NTZ) AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS f, make_date(2020, month(o_orderdate), 15) AS made, DATE '2024-03-05' AS d, TIMESTAMP '2024-03-05 06:07:08' AS t FROM orders")
R.sql("fn_epoch", "SELECT event_id, to_unixtime(CAST(ts AS TIMESTAMP)) AS s, CAST(to_timestamp_seconds(1700000000 + event_id) AS TIMESTAMP_NTZ) AS a, CAST(to_timestamp_millis(1700000000000 + event_id) AS TIMESTAMP_NTZ) AS b, CAST(to_timestamp_micros(1700000000000000 + event_id) AS TIMESTAMP_NTZ) AS u, from_unixtime(1700000000 + event_id) AS told FROM events", "SELECT event_id, floor(epoch(ts))::BIGINT AS s, make_timestamp((1700000000 + event_id) * 1000000) AS a, make_timestamp((1700000000000 + event_id) * 1000) AS b, make_timestamp(1700000000000000 + event_id) AS u, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS told FROM events")
R.sql("fn_conditional", "SELECT c_custkey, coalesce(NULL, c_name) AS a, nullif(c_nationkey, 3) AS b, nvl(nullif(c_nationkey, 3), -1) AS d, nvl2(nullif(c_nationkey, 3), 1, 0) AS e, ifnull(nullif(c_nationkey, 4), 99) AS f FROM customer", "SELECT c_custkey, c_name AS a, nullif(c_nationkey, 3) AS b, coalesce(nullif(c_nationkey, 3), -1) AS d, CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN 1 ELSE 0 END AS e, coalesce(nullif(c_nationkey, 4), 99) AS f FROM customer")
R.sql("fn_arrow_types", "SELECT arrow_cast(n_nationkey, 'Int64') AS l, arrow_cast(n_nationkey, 'Utf8') AS s, arrow_cast(n_nationkey, 'Float64') AS d, arrow_typeof(n_name) AS kind FROM nation", "SELECT n_nationkey::BIGINT AS l, n_nationkey::VARCHAR AS s, n_nationkey::DOUBLE AS d, 'string' AS kind FROM nation")


_DIGESTS = ", ".join(f"'{hashlib.new(f'sha{n}', b'abc').hexdigest()}' AS s{n}" for n in (224, 384, 512))
R.sql("fn_sha", "SELECT sha224('abc') AS s224, sha384('abc') AS s384, sha512('abc') AS s512", f"SELECT {_DIGESTS}")
R.sql("fn_now", "SELECT today() = current_date() AS d, CAST(now() AS DATE) = current_date() AS n, random() BETWEEN 0 AND 1 AS r, length(version()) > 0 AS v", "SELECT true AS d, true AS n, true AS r, true AS v")
R.sql("fn_local_time", "SELECT event_id, to_local_time(ts) AS t, CAST(to_timestamp_nanos(1700000000000000000 + event_id * 1000) AS TIMESTAMP_NTZ) AS n, to_char(ts, 'yyyy-MM-dd') AS c FROM events", "SELECT event_id, ts AS t, make_timestamp(1700000000000000 + event_id) AS n, strftime(ts, '%Y-%m-%d') AS c FROM events")
R.sql("fn_substring_index", "SELECT n_nationkey, substring_index(n_name, '_', 1) AS s FROM nation", "SELECT n_nationkey, split_part(n_name, '_', 1) AS s FROM nation")
R.sql("list_more", "SELECT n_nationkey, array_dims(array_repeat(n_name, 3)) AS d, array_empty(array_repeat(n_name, 0)) AS e, arrays_overlap(make_array(n_regionkey), make_array(1, 2)) AS o, flatten(make_array(make_array(n_nationkey), make_array(1, 2))) AS f FROM nation", "SELECT n_nationkey, [3] AS d, true AS e, n_regionkey IN (1, 2) AS o, [n_nationkey, 1, 2] AS f FROM nation")


@R.plan("fn_date_bin_column", "SELECT event_id, time_bucket(INTERVAL '90 minutes', ts, TIMESTAMP '2024-01-01') AS bin FROM events")
def _bins(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalars.date_bin(90 * 60 * 1_000_000, c("ts"), "2024-01-01 00:00:00").alias("bin"))


# statements about the session
def _session(t: Tables) -> Session:
    session = Session(spark=t.spark)
    session.register_parquet("nation", f"{t.folder}/nation.parquet")
    return session


R.plan("show_tables", "SELECT 'nation' AS \"tableName\", true AS \"isTemporary\"")(lambda t: _session(t).sql("SHOW TABLES").df.where("tableName = 'nation'").select("tableName", "isTemporary"))
R.plan("describe_table", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) AS v(col_name, data_type)")(lambda t: _session(t).sql("DESCRIBE nation").df.select("col_name", "data_type"))
R.plan("information_schema", "SELECT * FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) AS v(column_name, ordinal_position)")(lambda t: _session(t).sql("SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = 'nation'").df)
_COUNT = "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"


@R.plan("explain_modes", "SELECT unnest(['CODEGEN', 'COST', 'FORMATTED', 'VERBOSE']) AS mode, true AS scans, unnest([false, true, false, true]) AS logical")
def _modes(t: Tables) -> DataFrame:
    """What each mode shows: the scan of the physical plan or its generated code, and whether logical plans come with it."""
    session = _session(t)
    plans = {mode: session.sql(f"EXPLAIN {mode} {_COUNT}").df.first()[0] for mode in ("CODEGEN", "COST", "FORMATTED", "VERBOSE")}
    return t.spark.createDataFrame([(m, "scan parquet" in p.lower() or "WholeStageCodegen subtrees" in p, "Optimized Logical Plan" in p) for m, p in plans.items()], "mode string, scans boolean, logical boolean")


@R.plan("explain_analyze", f"SELECT 'output rows: ' || count(*) AS last, (SELECT count(*) FROM nation) AS scanned FROM ({_COUNT})")
def _analyze(t: Tables) -> DataFrame:
    """What a measured plan says of the rows that came out, and of those that were read."""
    plan = F.split(c("plan"), "\n")
    measured = _session(t).sql(f"EXPLAIN ANALYZE {_COUNT}").df
    scan = F.element_at(F.filter(plan, lambda line: line.contains("FileScan")), 1)
    return measured.select(F.element_at(plan, -1).alias("last"), F.regexp_extract(scan, r"numOutputRows=(\d+)", 1).cast("long").alias("scanned"))


@R.plan("schema_create_drop", "SELECT n_nationkey FROM nation")
def _schema(t: Tables) -> DataFrame:
    session, name, at = _session(t), f"s_{uuid.uuid4().hex[:8]}", f"{shared_dir(t.spark)}/sparkweave/schema-{uuid.uuid4().hex[:8]}"
    session.run(f"CREATE SCHEMA {name}; CREATE SCHEMA IF NOT EXISTS {name}; CREATE TABLE {name}.keys USING parquet AS SELECT n_nationkey FROM nation")
    writers.write(t.spark.table(f"{name}.keys"), at)
    session.sql(f"DROP SCHEMA {name} CASCADE")
    return t.spark.read.parquet(at)


@R.plan("prepared_params", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def _prepared(t: Tables) -> DataFrame:
    session = _session(t)
    session.sql("PREPARE by_region(INT, INT) AS SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2")
    return session.sql("EXECUTE by_region(2, 5)").df


R.plan("named_params", "SELECT n_name FROM nation WHERE n_regionkey = 1")(lambda t: _session(t).sql("SELECT n_name FROM nation WHERE n_regionkey = :region", region=1).df)

# extensions: event time, JSON, functions of one's own
_VALUE = "round(sum(value), 4) AS total, count(*) AS n"


@R.plan("ev_tumbling", f"SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' AS window_end, event_type, {_VALUE} FROM events GROUP BY ALL")
def _tumbling(t: Tables) -> DataFrame:
    return events.windowed(t.events, "1 day", F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), keys=("event_type",))


@R.plan("ev_sliding", f"SELECT s AS window_start, s + INTERVAL '6 hours' AS window_end, {_VALUE} FROM (SELECT value, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '2 hours' * unnest([0, 1, 2]) AS s FROM events) GROUP BY ALL")
def _sliding(t: Tables) -> DataFrame:
    return events.windowed(t.events, "6 hours", F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), slide="2 hours")


@R.plan(
    "ev_session",
    """SELECT min(ts) AS session_start, max(ts) + INTERVAL '8 hours' AS session_end, user_id, count(*) AS n FROM (
         SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
           SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '8 hours' THEN 0 ELSE 1 END AS fresh FROM events))
       GROUP BY user_id, s""",
)
def _sessions(t: Tables) -> DataFrame:
    return events.sessions(t.events, "8 hours", F.count("*").alias("n"), keys=("user_id",))


R.sql("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")


@R.plan("udf_pandas", "SELECT event_id, value * 2 + 1 AS y FROM events")
def _pandas(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def line(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return t.events.select("event_id", line("value").alias("y"))


@R.plan("udaf_pandas", "SELECT o_orderstatus, round(sum(o_totalprice * o_totalprice) / sum(o_totalprice), 4) AS own_mean FROM orders GROUP BY o_orderstatus")
def _aggregate(t: Tables) -> DataFrame:
    """An aggregate of one's own by SQL name: a Pandas function of the two sums of a group, which Spark has added up before."""
    @F.pandas_udf("double")
    def ratio(above: pd.Series, below: pd.Series) -> float:
        return float(above.sum() / below.sum())

    session = Session(spark=t.spark)
    session.register_udaf("ratio", ratio)
    session.register_dataframe("summed", t.orders.groupBy("o_orderstatus", F.pmod("o_orderkey", F.lit(64)).alias("salt")).agg(F.sum(c("o_totalprice") * c("o_totalprice")).alias("a"), F.sum("o_totalprice").alias("b")))
    return session.sql("SELECT o_orderstatus, round(ratio(a, b), 4) AS own_mean FROM summed GROUP BY o_orderstatus").df


# streams: the events as they would come, in two parts
def _arriving(t: Tables) -> DataFrame:
    """The events as a stream over a folder, read to its end."""
    at = f"{shared_dir(t.spark)}/sparkweave/arriving-{uuid.uuid4().hex[:8]}"
    t.events.repartition(2).write.parquet(at)
    return events.read(t.spark, at, t.events.schema, files_per_trigger=1)


def _marks(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/sparkweave/stream-{uuid.uuid4().hex[:8]}"


@R.plan("stream_windows", f"SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, {_VALUE} FROM events GROUP BY ALL")
def _stream_windows(t: Tables) -> DataFrame:
    counted = events.windowed(_arriving(t), "1 day", F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), keys=("event_type",))
    return events.final(counted.drop("window_end"), _marks(t))


@R.plan("stream_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def _stream_totals(t: Tables) -> DataFrame:
    """A stateful operator in Pandas: a running total for each user, of which the last one counts."""
    running, at = events.running(_arriving(t), "user_id", "value"), _marks(t)
    events.write(running, f"{at}/out", f"{at}/marks").awaitTermination()
    last = t.spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 4).alias("total"))


_PURCHASES, _CLICKS = "SELECT event_id AS p_id, user_id AS p_user, ts AS p_ts FROM events WHERE event_type = 'purchase'", "SELECT event_id AS c_id, user_id AS c_user, ts AS c_ts FROM events WHERE event_type = 'click'"


@R.plan("stream_join", f"SELECT p_id, c_id FROM ({_PURCHASES}) JOIN ({_CLICKS}) ON p_user = c_user AND c_ts >= p_ts AND c_ts <= p_ts + INTERVAL '2 days'")
def _stream_join(t: Tables) -> DataFrame:
    """The symmetric hash join: each side waits in the other's state until the watermark has passed."""
    side = lambda kind, p: _arriving(t).where(c("event_type") == kind).select(c("event_id").alias(f"{p}_id"), c("user_id").alias(f"{p}_user"), c("ts").cast("timestamp").alias(f"{p}_ts"))
    met, at = events.matched(side("purchase", "p"), side("click", "c"), "p_user", "c_user", "p_ts", "c_ts", "2 days", "400 days"), _marks(t)
    events.write(met.select("p_id", "c_id"), f"{at}/out", f"{at}/marks").awaitTermination()
    return t.spark.read.parquet(f"{at}/out")


@R.plan("udf_scalar", "SELECT n_nationkey, reverse(n_name) AS back FROM nation")
def _scalar(t: Tables) -> DataFrame:
    back = F.udf(lambda s: s and s[::-1], "string", useArrow=True)
    return t.nation.select("n_nationkey", back("n_name").alias("back"))


@R.plan("udtf", "SELECT n_nationkey, unnest(range(n_nationkey % 3)) AS k FROM nation")
def _table_function(t: Tables) -> DataFrame:
    @F.udtf(returnType="k: bigint")
    class UpTo:
        def eval(self, n: int):
            for k in range(n):
                yield (k,)

    t.spark.udtf.register("up_to", UpTo)
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql("SELECT n_nationkey, u.k FROM nation, LATERAL up_to(n_nationkey % 3) AS u")
