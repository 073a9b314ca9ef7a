"""Functions that Spark has under another name, or not at all, as Spark SQL text."""

from __future__ import annotations

from collections.abc import Callable

#: Same arguments, other name.
RENAMED: dict[str, str] = {
    "make_array": "array",
    "array_cat": "concat",
    "array_concat": "concat",
    "list_cat": "concat",
    "list_concat": "concat",
    "list_append": "array_append",
    "array_push_back": "array_append",
    "list_contains": "array_contains",
    "array_has": "array_contains",
    "list_has": "array_contains",
    "array_has_any": "arrays_overlap",
    "list_has_any": "arrays_overlap",
    "list_distinct": "array_distinct",
    "list_except": "array_except",
    "list_intersect": "array_intersect",
    "list_union": "array_union",
    "list_sort": "sort_array",
    "list_extract": "element_at",
    "list_element": "element_at",
    "array_extract": "element_at",
    "array_element": "element_at",
    "array_to_string": "array_join",
    "list_to_string": "array_join",
    "array_join": "array_join",
    "list_max": "array_max",
    "array_reverse": "reverse",
    "list_reverse": "reverse",
    "list_repeat": "array_repeat",
    "array_remove_all": "array_remove",
    "list_remove_all": "array_remove",
    "array_length": "array_size",
    "list_length": "array_size",
    "unnest": "explode",
    "starts_with": "startswith",
    "ends_with": "endswith",
    "strpos": "instr",
    "substr_index": "substring_index",
    "row": "struct",
    "make_map": "map",
    "arrow_typeof": "typeof",
    "datetrunc": "date_trunc",
    "datepart": "date_part",
    "to_timestamp_seconds": "timestamp_seconds",
    "to_timestamp_millis": "timestamp_millis",
    "to_timestamp_micros": "timestamp_micros",
    "to_unixtime": "unix_timestamp",
    "today": "current_date",
    "to_local_time": "to_timestamp_ntz",
    "covar": "covar_samp",
    "stddev_sample": "stddev_samp",
    "var": "var_samp",
    "var_sample": "var_samp",
    "var_population": "var_pop",
    "approx_distinct": "approx_count_distinct",
    "pow": "power",
    "mean": "avg",
}


def _slice(a: str, start: str, end: str, *_: str) -> str:
    """From and to a position, both included; negative ones count from the end."""
    size = f"array_size({a})"
    at = lambda p: f"CASE WHEN ({p}) < 0 THEN {size} + ({p}) + 1 ELSE ({p}) END"
    return f"slice({a}, greatest({at(start)}, 1), greatest(least({at(end)}, {size}) - greatest({at(start)}, 1) + 1, 0))"


def _remove_n(a: str, x: str, n: str = "1") -> str:
    seen = f"size(filter(slice({a}, 1, i + 1), y -> y <=> {x}))"
    return f"filter({a}, (v, i) -> NOT (v <=> {x} AND {seen} <= {n}))"


def _replace_n(a: str, old: str, new: str, n: str = "1") -> str:
    seen = f"size(filter(slice({a}, 1, i + 1), y -> y <=> {old}))"
    return f"transform({a}, (v, i) -> CASE WHEN v <=> {old} AND {seen} <= {n} THEN {new} ELSE v END)"


def _resize(a: str, n: str, fill: str = "NULL") -> str:
    return f"concat(slice({a}, 1, least(array_size({a}), {n})), array_repeat({fill}, greatest({n} - array_size({a}), 0)))"


def _trunc(x: str, n: str = "0") -> str:
    return f"signum({x}) * floor(abs({x}) * power(10, {n})) / power(10, {n})"


def _date_bin(stride: str, at: str, origin: str = "TIMESTAMP_NTZ '1970-01-01 00:00:00'") -> str:
    width = f"(unix_micros(CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' + {stride} AS TIMESTAMP)) - unix_micros(CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' AS TIMESTAMP)))"
    since = f"(unix_micros(CAST({at} AS TIMESTAMP)) - unix_micros(CAST({origin} AS TIMESTAMP)))"
    return f"CAST(timestamp_micros(unix_micros(CAST({origin} AS TIMESTAMP)) + CAST(floor({since} / {width}) AS BIGINT) * {width}) AS TIMESTAMP_NTZ)"


def _gcd(a: str, b: str) -> str:
    """Euclid's steps as a fold: 92 are enough for 64 bits."""
    step = "CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END"
    return f"aggregate(sequence(1, 92), named_struct('a', abs(CAST({a} AS BIGINT)), 'b', abs(CAST({b} AS BIGINT))), (s, i) -> {step}, s -> s.a)"


#: Text of a call from the texts of its arguments.
TEMPLATES: dict[str, Callable[..., str]] = {
    "array_has_all": lambda a, b: f"size(array_except({b}, {a})) = 0",
    "list_has_all": lambda a, b: f"size(array_except({b}, {a})) = 0",
    "array_slice": _slice,
    "list_slice": _slice,
    "array_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "list_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "array_push_front": lambda x, a: f"array_prepend({a}, {x})",
    "array_pop_back": lambda a: f"slice({a}, 1, greatest(array_size({a}) - 1, 0))",
    "list_pop_back": lambda a: f"slice({a}, 1, greatest(array_size({a}) - 1, 0))",
    "array_pop_front": lambda a: f"slice({a}, 2, greatest(array_size({a}) - 1, 0))",
    "list_pop_front": lambda a: f"slice({a}, 2, greatest(array_size({a}) - 1, 0))",
    "array_position": lambda a, x: f"nullif(array_position({a}, {x}), 0)",
    "list_position": lambda a, x: f"nullif(array_position({a}, {x}), 0)",
    "array_positions": lambda a, x: f"filter(transform({a}, (v, i) -> CASE WHEN v <=> {x} THEN i + 1 END), p -> p IS NOT NULL)",
    "array_remove": lambda a, x: _remove_n(a, x, "1"),
    "list_remove": lambda a, x: _remove_n(a, x, "1"),
    "array_remove_n": _remove_n,
    "list_remove_n": _remove_n,
    "array_replace": lambda a, x, y: _replace_n(a, x, y, "1"),
    "list_replace": lambda a, x, y: _replace_n(a, x, y, "1"),
    "array_replace_n": lambda a, x, y, n: _replace_n(a, x, y, n),
    "array_replace_all": lambda a, x, y: f"transform({a}, v -> CASE WHEN v <=> {x} THEN {y} ELSE v END)",
    "array_resize": _resize,
    "list_resize": _resize,
    "array_any_value": lambda a: f"try_element_at(filter({a}, v -> v IS NOT NULL), 1)",
    "array_empty": lambda a: f"array_size({a}) = 0",
    "empty": lambda a: f"array_size({a}) = 0",
    "array_ndims": lambda a: f"size(split(typeof({a}), 'array<')) - 1",
    "array_dims": lambda a: f"array(array_size({a}))",
    "array_sort": lambda a, direction="'ASC'", nulls="": f"sort_array({a}, {'false' if 'DESC' in direction.upper() else 'true'})",
    "string_to_array": lambda s, d, null="": f"split({s}, concat('\\\\Q', {d}, '\\\\E'), -1)" if not null else f"transform(split({s}, concat('\\\\Q', {d}, '\\\\E'), -1), v -> nullif(v, {null}))",
    "generate_series": lambda a, b, step="1": f"sequence({a}, {b}, {step})",
    "map_extract": lambda m, k: f"array(try_element_at({m}, {k}))",
    "get_field": lambda s, f: f"({s}).{f.strip(chr(39))}",
    "gcd": _gcd,
    "lcm": lambda a, b: f"CASE WHEN ({a}) = 0 OR ({b}) = 0 THEN 0 ELSE abs(CAST({a} AS BIGINT) div ({_gcd(a, b)}) * ({b})) END",
    "iszero": lambda x: f"({x}) = 0",
    "trunc": _trunc,
    "log": lambda a, b="": f"log({a}, {b})" if b else f"log10({a})",
    "concat": lambda *xs: "concat(" + ", ".join(f"coalesce(CAST({x} AS STRING), '')" for x in xs) + ")",
    "to_hex": lambda x: f"lower(hex({x}))",
    "regexp_match": lambda s, p, *_: f"nullif(regexp_extract_all({s}, {p}, 0), array())",
    "sha224": lambda x: f"sha2({x}, 224)",
    "sha256": lambda x: f"sha2({x}, 256)",
    "sha384": lambda x: f"sha2({x}, 384)",
    "sha512": lambda x: f"sha2({x}, 512)",
    "digest": lambda x, method: f"md5({x})" if "md5" in method.lower() else f"sha2({x}, {''.join(c for c in method if c.isdigit())})",
    "encode": lambda x, form: {"hex": f"lower(hex({x}))", "base64": f"rtrim('=', base64({x}))"}.get(form.strip("'").lower(), f"encode({x}, {form})"),
    "decode": lambda x, form: {"hex": f"unhex({x})", "base64": f"unbase64({x})"}.get(form.strip("'").lower(), f"decode({x}, {form})"),
    "date_bin": _date_bin,
    "to_timestamp_nanos": lambda x: f"timestamp_micros(({x}) div 1000)",
    "arrow_cast": lambda x, kind: f"CAST({x} AS {ARROW_TYPES[kind.strip(chr(39)).lower()]})",
    "approx_percentile_cont": lambda x, p, n="10000": f"approx_percentile({x}, {p}, {n})",
    "approx_percentile_cont_with_weight": lambda x, w, p: f"percentile({x}, {p}, {w})",
    "approx_median": lambda x: f"approx_percentile({x}, 0.5)",
}

#: Names of Arrow types -> Spark's.
ARROW_TYPES: dict[str, str] = {
    "boolean": "boolean",
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float16": "float",
    "float32": "float",
    "float64": "double",
    "utf8": "string",
    "largeutf8": "string",
    "utf8view": "string",
    "binary": "binary",
    "date32": "date",
    "date64": "date",
}
