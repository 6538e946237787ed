"""Queries for operators and scalar functions, family by family."""

from __future__ import annotations

from rivulet.plans.tables import sql

sql("op_integer_div", "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, -p_size / 7 AS nq, p_retailprice / 7 AS f FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q, p_size % 7 AS r, -CAST(p_size // 7 AS BIGINT) AS nq, p_retailprice / 7 AS f FROM part")
sql("op_bitwise", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size # 5 AS x, p_size << 2 AS l, p_size >> 1 AS r FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, p_size >> 1 AS r FROM part")
sql("op_regex_like", "SELECT p_partkey, p_name ~ 'a.e' AS m, p_name ~* 'A.E' AS mi, p_name !~ '^b' AS n, p_name ~~ '%e%' AS k, p_name !~~* '%E%' AS nk FROM part",
    "SELECT p_partkey, regexp_matches(p_name, 'a.e') AS m, regexp_matches(p_name, 'A.E', 'i') AS mi, NOT regexp_matches(p_name, '^b') AS n, p_name LIKE '%e%' AS k, NOT p_name ILIKE '%E%' AS nk FROM part")
sql("op_match_precedence", "SELECT p_partkey, p_type || '-x' ~* 'E.*-X' AS a, p_name !~* 'A' || 'L' AS b, NOT p_name ~* 'A' OR p_size > 25 AS c FROM part",
    "SELECT p_partkey, regexp_matches(p_type || '-x', 'E.*-X', 'i') AS a, NOT regexp_matches(p_name, 'AL', 'i') AS b, NOT regexp_matches(p_name, 'A', 'i') OR p_size > 25 AS c FROM part")
sql("op_array_contains", "SELECT p_partkey, [p_size, 5] || [7] @> [7, 5] AS a, [p_size] <@ [1, 2] || [3] AS b, make_array(1, p_size) @> make_array(p_size + 1) AS c FROM part", "SELECT p_partkey, true AS a, p_size IN (1, 2, 3) AS b, p_size = 0 AS c FROM part")
sql("op_division_chain", "SELECT p_partkey, p_partkey * 1000 / 7 / 3 / 2 AS a, 1000000" + "/1" * 70 + "/3 AS b, CAST(p_size AS DOUBLE) / 2 AS c, (p_size / 3 + 1) / 2 AS d FROM part",
    "SELECT p_partkey, CAST(p_partkey * 1000 // 7 // 3 // 2 AS BIGINT) AS a, CAST(333333 AS BIGINT) AS b, p_size / 2 AS c, CAST((p_size // 3 + 1) // 2 AS BIGINT) AS d FROM part")
sql("quoted_names", 'SELECT r."Key" AS "Outer Key", NAME AS label FROM (SELECT r_regionkey AS "Key", R_Name AS Name FROM region) r WHERE r."Key" > 0')
sql("op_concat_null", "SELECT doc_id, lang || ':' || source AS c, source || NULL AS n FROM documents", "SELECT doc_id, lang || ':' || source AS c, CAST(NULL AS VARCHAR) AS n FROM documents")
sql("op_literals", "SELECT 'it''s' AS a, E'x\\ty' AS b, [1, 2, 3][2] AS c, MAP {'k': 7}['k'] AS d, {a: 1, b: 'z'}.b AS e", "SELECT 'it''s' AS a, 'x' || chr(9) || 'y' AS b, [1, 2, 3][2] AS c, 7 AS d, 'z' AS e")

X = "(p_retailprice / 1000)"
NAMES = ["acosh", "asinh", "atan", "cbrt", "cos", "cosh", "cot", "degrees", "exp", "ln", "log10", "log2", "radians", "sin", "sinh", "sqrt", "tan", "tanh"]
sql("fn_math", "SELECT p_partkey, " + ", ".join(f"round({n}({X} + 1), 8) AS {n}_" for n in NAMES) + " FROM part")
sql("fn_math_bounded", f"SELECT p_partkey, round(asin({X} / 10), 8) AS a, round(acos({X} / 10), 8) AS b, round(atanh({X} / 10), 8) AS c, round(atan2({X}, 2), 8) AS d, abs(-p_size) AS e, pi() AS f FROM part")
sql("fn_math_whole", "SELECT p_partkey, ceil(p_retailprice / 7) AS a, floor(-p_retailprice / 7) AS b, round(p_retailprice / 7, 2) AS c, trunc(-p_retailprice / 7) AS d, gcd(p_size, 36) AS e, lcm(p_size, 6) AS f, factorial(p_size % 10) AS g FROM part",
    "SELECT p_partkey, ceil(p_retailprice / 7) AS a, floor(-p_retailprice / 7) AS b, round(p_retailprice / 7, 2) AS c, trunc(-p_retailprice / 7) AS d, CAST(gcd(p_size, 36) AS BIGINT) AS e, CAST(lcm(p_size, 6) AS BIGINT) AS f, CAST(factorial(p_size % 10) AS BIGINT) AS g FROM part")
sql("fn_math_log_power", "SELECT p_partkey, round(log(p_retailprice), 8) AS a, round(log(2, p_retailprice), 8) AS b, power(p_size, 2) AS c, iszero(p_size - 1) AS d, signum(p_size - 25) AS e, isnan(p_retailprice) AS f, nanvl(p_retailprice, 0.0) AS g FROM part",
    "SELECT p_partkey, round(log10(p_retailprice), 8) AS a, round(log2(p_retailprice), 8) AS b, power(p_size, 2) AS c, p_size - 1 = 0 AS d, CASE WHEN p_size < 25 THEN -1 ELSE 1 END AS e, isnan(p_retailprice) AS f, p_retailprice AS g FROM part")
sql("fn_random", "SELECT p_partkey, random() AS r, uuid() AS u FROM part", None)
sql("fn_now", "SELECT current_date() AS d, now() AS n", None)
sql("fn_time_of_day", "SELECT char_length(CAST(current_time() AS VARCHAR)) >= 8 AS t, current_date() = CAST(now() AS DATE) AS d", "SELECT true AS t, true AS d")
sql("fn_local_time", "SELECT event_id, CAST(date_trunc('second', to_local_time(ts)) AS VARCHAR) AS a, to_timestamp_nanos(1500000000) AS b FROM events", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS a, TIMESTAMP '1970-01-01 00:00:01.5' AS b FROM events")

sql("fn_conditional", "SELECT d.doc_id, coalesce(l.quality, -1) AS a, nullif(l.quality, 1) AS b, nvl(l.toxic, 9) AS c, nvl2(l.toxic, 1, 0) AS d, greatest(l.quality, 0, d.doc_id % 3) AS e, least(l.quality, 5) AS f, ifnull(l.quality, 7) AS g FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "SELECT d.doc_id, coalesce(l.quality, -1) AS a, nullif(l.quality, 1) AS b, coalesce(l.toxic, 9) AS c, CASE WHEN l.toxic IS NULL THEN 0 ELSE 1 END AS d, greatest(l.quality, 0, d.doc_id % 3) AS e, least(l.quality, 5) AS f, coalesce(l.quality, 7) AS g FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")

S = "text"
sql("fn_string_length", f"SELECT doc_id, ascii({S}) AS a, bit_length({S}) AS b, character_length({S}) AS c, octet_length({S}) AS d, levenshtein(source, 'sarc') AS e, strpos({S}, 'e') AS f, length({S}) AS g FROM documents",
    f"SELECT doc_id, ascii({S}) AS a, CAST(bit_length({S}) AS INT) AS b, CAST(length({S}) AS INT) AS c, CAST(octet_length(encode({S})) AS INT) AS d, CAST(levenshtein(source, 'sarc') AS INT) AS e, CAST(instr({S}, 'e') AS INT) AS f, CAST(length({S}) AS INT) AS g FROM documents")
sql("fn_string_case", "SELECT doc_id, lower(text) AS a, upper(source) AS b, reverse(text) AS c, initcap(source) AS d, repeat(lang, 2) AS e FROM documents", "SELECT doc_id, lower(text) AS a, upper(source) AS b, reverse(text) AS c, upper(source[1]) || lower(source[2:]) AS d, repeat(lang, 2) AS e FROM documents")
sql("fn_string_trim_pad", "SELECT n_nationkey, btrim('  x ') AS a, ltrim('zzxz', 'z') AS b, rtrim('zzxz', 'z') AS c, trim('xyx', 'x') AS d, lpad(n_name, 12, '*') AS e, rpad(n_name, 12, '-') AS f, lpad(n_name, 3) AS g FROM nation",
    "SELECT n_nationkey, 'x' AS a, ltrim('zzxz', 'z') AS b, rtrim('zzxz', 'z') AS c, 'y' AS d, lpad(n_name, 12, '*') AS e, rpad(n_name, 12, '-') AS f, substr(n_name, 1, 3) AS g FROM nation")
sql("fn_string_search", "SELECT n_nationkey, contains(n_name, 'A') AS a, starts_with(n_name, 'N') AS b, ends_with(n_name, '1') AS c, find_in_set('b', 'a,b,c') AS d, replace(n_name, 'A', 'aa') AS e, translate(n_name, 'AN', 'an') AS f, split_part(n_name, 'A', 1) AS g, substr_index(n_name, '_', 1) AS h FROM nation",
    "SELECT n_nationkey, contains(n_name, 'A') AS a, starts_with(n_name, 'N') AS b, ends_with(n_name, '1') AS c, 2 AS d, replace(n_name, 'A', 'aa') AS e, translate(n_name, 'AN', 'an') AS f, split_part(n_name, 'A', 1) AS g, split_part(n_name, '_', 1) AS h FROM nation")
sql("fn_string_parts", "SELECT n_nationkey, left(n_name, 3) AS a, right(n_name, 2) AS b, left(n_name, -2) AS c, right(n_name, -2) AS d, substr(n_name, 2, 3) AS e, substr(n_name, 0, 3) AS f, overlay(n_name PLACING 'zz' FROM 2 FOR 1) AS g, position('A' IN n_name) AS h FROM nation",
    "SELECT n_nationkey, left(n_name, 3) AS a, right(n_name, 2) AS b, left(n_name, -2) AS c, right(n_name, -2) AS d, substr(n_name, 2, 3) AS e, substr(n_name, 1, 2) AS f, substr(n_name, 1, 1) || 'zz' || substr(n_name, 3) AS g, CAST(position('A' IN n_name) AS INT) AS h FROM nation")
sql("fn_string_build", "SELECT n_nationkey, concat(n_name, NULL, '!') AS a, concat_ws('-', n_name, NULL, 'x') AS b, chr(128640) AS c, chr(65) AS d, to_hex(n_nationkey) AS e FROM nation", "SELECT n_nationkey, concat(n_name, NULL, '!') AS a, concat_ws('-', n_name, NULL, 'x') AS b, chr(128640) AS c, chr(65) AS d, format('{:x}', n_nationkey) AS e FROM nation")
sql("fn_binary_string", "SELECT n_nationkey, encode(n_name, 'hex') AS a, encode(n_name, 'base64') AS b, CAST(decode(encode(n_name, 'hex'), 'hex') AS VARCHAR) AS c FROM nation", "SELECT n_nationkey, lower(hex(encode(n_name))) AS a, rtrim(base64(encode(n_name)), '=') AS b, n_name AS c FROM nation")
sql("fn_regex", f"SELECT doc_id, regexp_like({S}, '^[A-Z]') AS a, regexp_count({S}, 'e') AS b, array_to_string(regexp_match({S}, '([a-z]+) ([a-z]+)'), '+') AS c, regexp_replace({S}, 'e', '#') AS d, regexp_replace({S}, '([aeiou])', '<\\1>', 'g') AS e, regexp_like({S}, 'THE', 'i') AS f FROM documents",
    f"SELECT doc_id, regexp_matches({S}, '^[A-Z]') AS a, CAST(len(regexp_extract_all({S}, 'e')) AS INT) AS b, CASE WHEN regexp_matches({S}, '([a-z]+) ([a-z]+)') THEN regexp_extract({S}, '([a-z]+) ([a-z]+)', 1) || '+' || regexp_extract({S}, '([a-z]+) ([a-z]+)', 2) END AS c, regexp_replace({S}, 'e', '#') AS d, regexp_replace({S}, '([aeiou])', '<\\1>', 'g') AS e, regexp_matches({S}, 'THE', 'i') AS f FROM documents")

sql("fn_datetime_parts", "SELECT o_orderkey, date_part('year', o_orderdate) AS a, date_part('month', o_orderdate) AS b, extract(day FROM o_orderdate) AS c, date_part('dow', o_orderdate) AS d, date_part('doy', o_orderdate) AS e, date_part('quarter', o_orderdate) AS f, date_part('epoch', o_orderdate) AS g FROM orders",
    "SELECT o_orderkey, CAST(date_part('year', o_orderdate) AS INT) AS a, CAST(date_part('month', o_orderdate) AS INT) AS b, CAST(extract(day FROM o_orderdate) AS INT) AS c, CAST(date_part('dow', o_orderdate) AS INT) AS d, CAST(date_part('doy', o_orderdate) AS INT) AS e, CAST(date_part('quarter', o_orderdate) AS INT) AS f, CAST(epoch(o_orderdate) AS DOUBLE) AS g FROM orders")
sql("fn_datetime_trunc", "SELECT event_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS a, CAST(date_trunc('month', ts) AS VARCHAR) AS b FROM events", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS a, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS b FROM events")
sql("fn_datetime_make", "SELECT n_nationkey, make_date(2024, 2, n_nationkey + 1) AS a, from_unixtime(86400 * n_nationkey) AS b, to_unixtime('2020-09-08 12:00:00') AS c, to_date('2023/01/31', '%d-%m-%Y', '%Y/%m/%d') AS d FROM nation",
    "SELECT n_nationkey, make_date(2024, 2, n_nationkey + 1) AS a, make_timestamp(86400000000 * n_nationkey::BIGINT) AS b, CAST(epoch(TIMESTAMP '2020-09-08 12:00:00') AS BIGINT) AS c, DATE '2023-01-31' AS d FROM nation")
sql("fn_datetime_format", "SELECT event_id, to_char(ts, '%Y-%m-%d %H:%M:%S') AS a, to_char(ts, '%d %b %Y') AS b FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d %b %Y') AS b FROM events")
sql("fn_datetime_parse", "SELECT to_timestamp('2023-01-31T09:26:56') AS a, to_timestamp_seconds(1) AS b, to_timestamp_millis(1001) AS c, to_timestamp_micros(7) AS d, to_timestamp('05/17/2023 03:59', '%m/%d/%Y %H:%M') AS e",
    "SELECT TIMESTAMP '2023-01-31 09:26:56' AS a, TIMESTAMP '1970-01-01 00:00:01' AS b, TIMESTAMP '1970-01-01 00:00:01.001' AS c, TIMESTAMP '1970-01-01 00:00:00.000007' AS d, TIMESTAMP '2023-05-17 03:59:00' AS e")
sql("fn_date_bin", "SELECT event_id, date_bin(INTERVAL '15 minutes', ts) AS a, date_bin(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01 06:00:00') AS b, date_bin(INTERVAL '1 month', ts) AS c FROM events",
    "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS a, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01 06:00:00') AS b, time_bucket(INTERVAL '1 month', ts, TIMESTAMP '1970-01-01') AS c FROM events")

A = "make_array(p_size, 3, p_size, NULL, 7)"
D = "[p_size, 3, p_size, NULL, 7]"
sql("fn_array_edit", "SELECT p_partkey, " + ", ".join(f"array_to_string({f}, ',', 'N') AS {n}" for n, f in {
        "a": f"array_append({A}, 9)", "b": f"array_prepend(9, {A})", "c": f"array_remove({A}, 3)", "d": f"array_remove_all({A}, p_size)", "e": f"array_replace({A}, p_size, 0)", "f": f"array_replace_all({A}, p_size, 0)", "g": f"array_pop_back({A})",
        "h": f"array_pop_front({A})", "i": f"array_slice({A}, 2, 4)", "j": f"array_resize({A}, 3, 0)", "k": f"array_concat({A}, make_array(1))", "l": f"array_reverse({A})", "m": f"array_remove_n({A}, p_size, 1)", "n": f"array_slice({A}, -2, -1)", "o": f"array_resize({A}, 7, 0)",
    }.items()) + " FROM part",
    "SELECT p_partkey, " + ", ".join(f"array_to_string(list_transform({f}, lambda x: coalesce(CAST(x AS VARCHAR), 'N')), ',') AS {n}" for n, f in {
        "a": f"list_append({D}, 9)", "b": f"list_prepend(9, {D})", "c": "CASE WHEN p_size = 3 THEN [3, 3, NULL, 7] ELSE [p_size, p_size, NULL, 7] END", "d": "CASE WHEN p_size = 3 THEN [NULL, 7] WHEN p_size = 7 THEN [3, NULL] ELSE [3, NULL, 7] END",
        "e": "[0, 3, p_size, NULL, 7]", "f": "[0, CASE WHEN p_size = 3 THEN 0 ELSE 3 END, 0, NULL, CASE WHEN p_size = 7 THEN 0 ELSE 7 END]", "g": "[p_size, 3, p_size, NULL]", "h": "[3, p_size, NULL, 7]", "i": f"{D}[2:4]", "j": "[p_size, 3, p_size]",
        "k": f"{D} || [1]", "l": f"list_reverse({D})", "m": "[3, p_size, NULL, 7]", "n": "[NULL, 7]", "o": f"{D} || [0, 0]",
    }.items()) + " FROM part")
sql("fn_array_replace_n", f"SELECT p_partkey, array_to_string(array_replace_n({A}, p_size, 0, 1), ',', 'N') AS a, array_to_string(array_replace_n({A}, p_size, 0, 9), ',', 'N') AS b, array_to_string(array_replace_n({A}, 100, 0, 2), ',', 'N') AS c FROM part",
    "SELECT p_partkey, '0,3,' || p_size || ',N,7' AS a, '0,' || CASE p_size WHEN 3 THEN '0' ELSE '3' END || ',0,N,' || CASE p_size WHEN 7 THEN '0' ELSE '7' END AS b, p_size || ',3,' || p_size || ',N,7' AS c FROM part")
sql("fn_array_find", f"SELECT p_partkey, array_has({A}, 7) AS a, array_has_all({A}, make_array(3, 7)) AS b, array_has_any({A}, make_array(p_size, 100)) AS c, array_position({A}, 7) AS d, array_to_string(array_positions({A}, p_size), ',') AS e, array_element({A}, 2) AS f, array_element({A}, -1) AS g, array_element({A}, 99) AS h, array_any_value({A}) AS i FROM part",
    "SELECT p_partkey, true AS a, true AS b, true AS c, CAST(CASE WHEN p_size = 7 THEN 1 ELSE 5 END AS BIGINT) AS d, CASE p_size WHEN 3 THEN '1,2,3' WHEN 7 THEN '1,3,5' ELSE '1,3' END AS e, 3 AS f, 7 AS g, CAST(NULL AS INT) AS h, p_size AS i FROM part")
sql("fn_array_sets", "SELECT p_partkey, array_to_string(array_sort(array_distinct(make_array(p_size, 3, 3))), ',') AS a, array_to_string(array_sort(array_union(make_array(1, 2), make_array(2, p_size))), ',') AS b, array_to_string(array_intersect(make_array(1, p_size), make_array(p_size, 5)), ',') AS c, array_to_string(array_except(make_array(1, p_size), make_array(p_size)), ',') AS d FROM part",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_size, 3, 3])), ',') AS a, array_to_string(list_sort(list_distinct([1, 2, 2, p_size])), ',') AS b, CASE WHEN p_size IN (1, 5) THEN CASE p_size WHEN 1 THEN '1' ELSE '5' END ELSE CAST(p_size AS VARCHAR) END AS c, CASE WHEN p_size = 1 THEN '' ELSE '1' END AS d FROM part")
sql("fn_array_size", f"SELECT p_partkey, array_length({A}) AS a, cardinality({A}) AS b, array_max({A}) AS c, empty({A}) AS d, array_ndims({A}) AS e, array_to_string(array_dims({A}), ',') AS f, array_to_string(array_repeat(p_size, 2), ',') AS g FROM part",
    "SELECT p_partkey, 5 AS a, CAST(5 AS BIGINT) AS b, greatest(p_size, 7) AS c, false AS d, 1 AS e, '5' AS f, p_size || ',' || p_size AS g FROM part")
sql("fn_array_series", "SELECT n_nationkey, array_to_string(generate_series(1, n_nationkey), ',') AS a, array_to_string(range(0, n_nationkey, 3), ',') AS b, array_to_string(array_sort(make_array(3, NULL, n_nationkey), 'DESC', 'NULLS LAST'), ',', '-') AS c, array_to_string(flatten(make_array(make_array(1, 2), make_array(n_nationkey))), ',') AS d, array_to_string(string_to_array('a.b.c', '.'), '|') AS e FROM nation",
    "SELECT n_nationkey, array_to_string(generate_series(1, n_nationkey), ',') AS a, array_to_string(range(0, n_nationkey, 3), ',') AS b, greatest(3, n_nationkey) || ',' || least(3, n_nationkey) || ',-' AS c, '1,2,' || n_nationkey AS d, 'a|b|c' AS e FROM nation")
sql("array_distance_topk", "SELECT a, b, round(d, 4) AS d, n FROM (SELECT q.vec_id AS a, e.vec_id AS b, array_distance(q.embedding, e.embedding) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY array_distance(q.embedding, e.embedding), e.vec_id) AS n FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) t WHERE n <= 5",
    "SELECT a, b, round(d, 4) AS d, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY d, b) AS INT) AS n FROM (SELECT q.vec_id AS a, e.vec_id AS b, sqrt(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS d FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) t) t WHERE n <= 5")
sql("unnest_array", "SELECT vec_id, unnest(embedding) AS x FROM embeddings", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
sql("unnest_lateral", "SELECT e.vec_id, u.x FROM embeddings e, unnest(e.embedding) AS u(x)", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
sql("unnest_struct", "SELECT k, unnest(s) FROM (SELECT n_regionkey AS k, named_struct('a', n_nationkey, 'b', n_name) AS s FROM nation) t", "SELECT n_regionkey AS k, n_nationkey AS a, n_name AS b FROM nation")
sql("unnest_map", "SELECT n_nationkey, u.k, u.v FROM nation, unnest(MAP {'a': n_regionkey, 'b': 7}) AS u(k, v)", "SELECT n_nationkey, 'a' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', 7 FROM nation")
sql("fn_struct_map", "SELECT n_nationkey, named_struct('k', n_name, 'v', n_nationkey)['k'] AS a, array_to_string(map_keys(MAP {n_name: 1, 'z': 2}), ',') AS b, array_to_string(map_values(map(make_array('a', 'b'), make_array(n_nationkey, 5))), ',') AS c, array_to_string(map_extract(MAP {'q': n_nationkey}, 'q'), ',') AS d, cardinality(map_extract(MAP {'q': 1}, 'no')) AS e, get_field(named_struct('x', n_name), 'x') AS f FROM nation",
    "SELECT n_nationkey, n_name AS a, n_name || ',z' AS b, n_nationkey || ',5' AS c, CAST(n_nationkey AS VARCHAR) AS d, CAST(0 AS BIGINT) AS e, n_name AS f FROM nation")
sql("fn_hash", "SELECT n_nationkey, md5(n_name) AS a, encode(sha256(n_name), 'hex') AS b, encode(digest(n_name, 'md5'), 'hex') AS c, octet_length(sha512(n_name)) AS d, octet_length(sha224(n_name)) AS e, octet_length(digest(n_name, 'sha384')) AS f FROM nation",
    "SELECT n_nationkey, md5(n_name) AS a, sha256(n_name) AS b, md5(n_name) AS c, 64 AS d, 28 AS e, 48 AS f FROM nation")
sql("fn_hash_blake", "SELECT n_nationkey, octet_length(digest(n_name, 'blake2b')) AS a, octet_length(digest(n_name, 'blake2s')) AS b, encode(digest('abc', 'blake3'), 'hex') AS c FROM nation", "SELECT n_nationkey, 64 AS a, 32 AS b, '6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85' AS c FROM nation")
sql("fn_json_get", "SELECT event_id, json_get_int(props, 'k') AS a, json_as_text(props, 'k') AS b, json_contains(props, 'k') AS c, json_length(props) AS d, props->>'k' AS e, json_get_str(props, 'k') AS f, props ? 'zz' AS g, json_get_float(props, 'k') AS h, json_get_json(props, 'k') AS i, json_get_bool(props, 'k') AS j FROM events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS a, json_extract_string(props, '$.k') AS b, true AS c, 1 AS d, json_extract_string(props, '$.k') AS e, CAST(NULL AS VARCHAR) AS f, false AS g, CAST(json_extract(props, '$.k') AS DOUBLE) AS h, CAST(json_extract(props, '$.k') AS VARCHAR) AS i, CAST(NULL AS BOOLEAN) AS j FROM events")
sql("fn_json_keys", "SELECT event_id, CAST(json_get(props, 'k') AS BIGINT) AS a, json_get_int(props, substr('kz', 1, 1)) AS b, json_as_text('{\"' || event_type || '\": [1, 2]}', event_type, event_id % 2) AS c FROM events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b, CASE event_id % 2 WHEN 0 THEN '1' ELSE '2' END AS c FROM events")
sql("fn_types", "SELECT p_partkey, arrow_typeof(p_size) AS a, arrow_typeof(p_name) AS b, arrow_cast(p_size, 'Int64') AS c, arrow_cast(p_size, 'Utf8') AS d, arrow_typeof(arrow_cast(p_size, 'Float32')) AS e FROM part",
    "SELECT p_partkey, 'Int32' AS a, 'Utf8' AS b, CAST(p_size AS BIGINT) AS c, CAST(p_size AS VARCHAR) AS d, 'Float32' AS e FROM part")
sql("fn_union", "SELECT n_nationkey, union_extract(u, 'str') AS a FROM (SELECT n_nationkey, named_struct('int', n_nationkey, 'str', n_name) AS u FROM nation) t", "SELECT n_nationkey, n_name AS a FROM nation")
sql("at_time_zone", "SELECT event_id, CAST(date_trunc('second', ts AT TIME ZONE 'Asia/Tokyo') AS VARCHAR) AS a FROM events", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS a FROM events")
