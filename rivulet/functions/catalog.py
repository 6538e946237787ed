"""The dialect's scalar and aggregate functions as Spark SQL text.

Each entry takes the arguments as SQL text and gives an expression of Spark built-ins, so all of them stay inside whole-stage
code generation and the optimizer sees through them. Functions that Spark has under the same name and meaning are listed
in SAME; the rest are rules of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from rivulet.errors import QueryError
from rivulet.functions.formats import java_pattern
from rivulet.schema import spark_type

Rule = Callable[..., str]

#: Functions that mean the same in Spark.
SAME = set(
    """abs acos acosh asin asinh atan atan2 atanh cbrt cos cosh cot degrees exp factorial isnan ln log10 log2 nanvl pi radians
    sin sinh sqrt tan tanh coalesce nullif nvl nvl2 ascii bit_length btrim concat_ws contains find_in_set levenshtein lower
    octet_length repeat replace reverse rpad lpad split_part translate upper uuid current_date current_time now
    date_trunc make_date array_append array_except array_intersect array_max array_union array_repeat named_struct
    map_keys map_values md5 avg bit_and bit_or bit_xor bool_and bool_or count max min sum var_pop corr covar_pop
    covar_samp regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy stddev_pop
    cume_dist dense_rank ntile percent_rank rank row_number lag lead nth_value""".split()
)

#: Other names of functions.
ALIASES = {
    "pow": "power", "ifnull": "nvl", "char_length": "character_length", "instr": "strpos", "length": "character_length", "position": "strpos", "substring": "substr", "substring_index": "substr_index", "trim": "btrim",
    "current_timestamp": "now", "date_format": "to_char", "datepart": "date_part", "datetrunc": "date_trunc", "today": "current_date", "element_at": "map_extract", "row": "struct", "mean": "avg", "var_population": "var_pop",
    "var_samp": "var", "var_sample": "var", "covar": "covar_samp", "stddev_samp": "stddev", "array_cat": "array_concat", "array_contains": "array_has", "array_empty": "empty", "array_extract": "array_element",
    "array_indexof": "array_position", "array_join": "array_to_string", "array_push_back": "array_append", "array_push_front": "array_prepend", "list_any_value": "array_any_value", "list_append": "array_append",
    "list_push_back": "array_append", "list_sort": "array_sort", "list_cat": "array_concat", "list_concat": "array_concat", "list_dims": "array_dims", "list_distance": "array_distance", "list_distinct": "array_distinct",
    "list_element": "array_element", "list_extract": "array_element", "list_except": "array_except", "list_has": "array_has", "list_contains": "array_has", "list_has_all": "array_has_all", "list_has_any": "array_has_any",
    "arrays_overlap": "array_has_any", "list_intersect": "array_intersect", "list_intersection": "array_intersect", "list_length": "array_length", "list_max": "array_max", "list_ndims": "array_ndims",
    "list_pop_back": "array_pop_back", "list_pop_front": "array_pop_front", "list_position": "array_position", "list_indexof": "array_position", "list_positions": "array_positions", "list_prepend": "array_prepend",
    "list_push_front": "array_prepend", "list_remove": "array_remove", "list_remove_all": "array_remove_all", "list_remove_n": "array_remove_n", "list_repeat": "array_repeat", "list_replace": "array_replace",
    "list_replace_all": "array_replace_all", "list_replace_n": "array_replace_n", "list_resize": "array_resize", "list_reverse": "array_reverse", "list_slice": "array_slice", "list_to_string": "array_to_string",
    "list_join": "array_to_string", "list_union": "array_union", "make_list": "make_array", "string_to_list": "string_to_array",
}

RULES: dict[str, Rule] = {}

#: Where FILTER and OVER go in an aggregate that is wrapped in other calls.
HOLE = "\x00"


def rule(name: str) -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return add


def literal(text: str) -> str | None:
    """The value of a SQL string literal as the translator writes it; None for anything else."""
    t = text.strip()
    if len(t) < 2 or t[0] != "'" or t[-1] != "'":
        return None
    return re.sub(r"\\(.)", r"\1", t[1:-1], flags=re.S)


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def integer(text: str) -> int | None:
    t = text.strip().strip("()").strip()
    return int(t) if re.fullmatch(r"-?\d+", t) else None


# Math ---------------------------------------------------------------------------------------------------------------


def whole(name: str) -> Rule:
    """ceil and floor give doubles, so that infinity, NaN and large values survive."""
    return lambda x: f"(CASE WHEN abs(CAST({x} AS DOUBLE)) < 9e15 THEN CAST({name}(CAST({x} AS DOUBLE)) AS DOUBLE) ELSE CAST({x} AS DOUBLE) END)"


RULES["ceil"] = whole("ceil")
RULES["floor"] = whole("floor")
RULES["iszero"] = lambda x: f"({x} = 0)"
RULES["log"] = lambda a, b=None: f"log10({a})" if b is None else f"log({a}, {b})"
RULES["power"] = lambda a, b: f"power({a}, {b})"
RULES["random"] = lambda: "rand()"
RULES["round"] = lambda x, d="0": f"round({x}, {d})"
RULES["signum"] = lambda x: f"(CASE WHEN {x} < 0 THEN -1 WHEN {x} >= 0 THEN 1 END)"


@rule("gcd")
def gcd(a: str, b: str) -> str:
    """Euclid's steps; 100 are enough for 64 bits."""
    step = "CASE WHEN s.y = 0 THEN s ELSE named_struct('x', s.y, 'y', s.x % s.y) END"
    return f"aggregate(sequence(1, 100), named_struct('x', abs(CAST({a} AS BIGINT)), 'y', abs(CAST({b} AS BIGINT))), (s, i) -> {step}).x"


RULES["lcm"] = lambda a, b: f"(CASE WHEN {a} = 0 OR {b} = 0 THEN 0L ELSE abs(CAST({a} AS BIGINT) div {gcd(a, b)} * {b}) END)"


@rule("trunc")
def trunc(x: str, digits: str = "0") -> str:
    p = f"power(10D, {digits})"
    return f"(CASE WHEN {x} < 0 THEN ceil({x} * {p}) ELSE floor({x} * {p}) END / {p})"


# Conditional --------------------------------------------------------------------------------------------------------
RULES["greatest"] = lambda *a: a[0] if len(a) == 1 else f"greatest({', '.join(a)})"
RULES["least"] = lambda *a: a[0] if len(a) == 1 else f"least({', '.join(a)})"

# Strings ------------------------------------------------------------------------------------------------------------
RULES["character_length"] = lambda s: f"char_length({s})"
RULES["btrim"] = lambda s, c=None: f"btrim({s})" if c is None else f"btrim({s}, {c})"
RULES["ltrim"] = lambda s, c=None: f"ltrim({s})" if c is None else f"trim(LEADING {c} FROM {s})"
RULES["rtrim"] = lambda s, c=None: f"rtrim({s})" if c is None else f"trim(TRAILING {c} FROM {s})"
RULES["concat"] = lambda *a: f"concat_ws('', {', '.join(a)})"
RULES["ends_with"] = lambda s, x: f"endswith({s}, {x})"
RULES["starts_with"] = lambda s, x: f"startswith({s}, {x})"
RULES["strpos"] = lambda s, x: f"instr({s}, {x})"
RULES["substr_index"] = lambda s, d, n: f"substring_index({s}, {d}, {n})"
RULES["to_hex"] = lambda n: f"lower(hex({n}))"
RULES["overlay"] = lambda s, r, p, n=None: f"overlay({s}, {r}, {p})" if n is None else f"overlay({s}, {r}, {p}, {n})"


@rule("chr")
def char(n: str) -> str:
    """Any code point, from its UTF-8 bytes."""
    b = lambda mask, shift, lead: f"lpad(hex({lead} + (shiftright({n}, {shift}) & {mask})), 2, '0')"
    one = f"lpad(hex({n}), 2, '0')"
    two = f"concat({b(31, 6, 192)}, {b(63, 0, 128)})"
    three = f"concat({b(15, 12, 224)}, {b(63, 6, 128)}, {b(63, 0, 128)})"
    four = f"concat({b(7, 18, 240)}, {b(63, 12, 128)}, {b(63, 6, 128)}, {b(63, 0, 128)})"
    return f"decode(unhex(CASE WHEN {n} < 128 THEN {one} WHEN {n} < 2048 THEN {two} WHEN {n} < 65536 THEN {three} ELSE {four} END), 'UTF-8')"


@rule("initcap")
def initcap(s: str) -> str:
    """Words are runs of letters and digits."""
    return f"array_join(transform(regexp_extract_all({s}, '[\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+', 0), w -> concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), '')"


RULES["left"] = lambda s, n: f"(CASE WHEN {n} >= 0 THEN substr({s}, 1, {n}) ELSE substr({s}, 1, greatest(char_length({s}) + {n}, 0)) END)"
RULES["right"] = lambda s, n: f"(CASE WHEN {n} >= 0 THEN substr({s}, greatest(char_length({s}) - {n}, 0) + 1) ELSE substr({s}, 1 - {n}) END)"


@rule("substr")
def substr(s: str, p: str, n: str | None = None) -> str:
    """Positions before the first character count, but have no characters."""
    if (k := integer(p)) is not None and k >= 1:
        return f"substr({s}, {p})" if n is None else f"substr({s}, {p}, {n})"
    if n is None:
        return f"substr({s}, greatest({p}, 1))"
    return f"substr({s}, greatest({p}, 1), greatest({p} + {n} - greatest({p}, 1), 0))"


def binary_text(name: str) -> Rule:
    def apply(x: str, how: str) -> str:
        kind = (literal(how) or "").lower()
        table = {("encode", "hex"): f"lower(hex({x}))", ("encode", "base64"): f"rtrim('=', replace(base64(CAST({x} AS BINARY)), '\\r\\n', ''))", ("decode", "hex"): f"unhex({x})", ("decode", "base64"): f"unbase64({x})"}
        if (name, kind) not in table:
            raise QueryError(f"{name}: format {how} isn't one of 'base64' and 'hex'")
        return table[name, kind].replace("rtrim('=', ", "trim(TRAILING '=' FROM ")

    return apply


RULES["encode"], RULES["decode"] = binary_text("encode"), binary_text("decode")

# Regular expressions ------------------------------------------------------------------------------------------------


def flagged(pattern: str, flags: str | None) -> str:
    """The pattern with its flags inside; g is of regexp_replace only."""
    if flags is None:
        return pattern
    own = literal(flags)
    if own is None:
        return f"concat('(?', replace({flags}, 'g', ''), ')', {pattern})"
    own = own.replace("g", "")
    if set(own) - set("imsUx"):
        raise QueryError(f"unknown regular expression flags {flags}")
    own = own.replace("U", "")  # Unicode classes are on already
    return f"concat('(?{own})', {pattern})" if own else pattern


RULES["regexp_like"] = lambda s, p, f=None: f"regexp_like({s}, {flagged(p, f)})"
RULES["regexp_count"] = lambda s, p, start=None, f=None: f"regexp_count({s if start is None else f'substr({s}, {start})'}, {flagged(p, f)})"


@rule("regexp_match")
def regexp_match(s: str, p: str, f: str | None = None) -> str:
    """First match: its groups, or the whole of it in an array if the pattern has none; null without match."""
    text = literal(p)
    if text is None:
        raise QueryError("regexp_match takes a literal pattern")
    groups = re.compile(re.sub(r"\\[pP]\{\w+\}", "x", text)).groups
    pattern = flagged(p, f)
    parts = ", ".join(f"regexp_extract({s}, {pattern}, {k})" for k in (range(1, groups + 1) if groups else [0]))
    return f"(CASE WHEN regexp_like({s}, {pattern}) THEN array({parts}) END)"


@rule("regexp_replace")
def regexp_replace(s: str, p: str, r: str, f: str | None = None) -> str:
    """The first match only, unless the flags have g. Group references are \\\\1 and $1."""
    text = literal(r)
    if text is None:
        raise QueryError("regexp_replace takes a literal replacement")
    text = re.sub(r"\\(\d)", r"$\1", text)
    text = re.sub(r"\$\{(\d+)\}", r"$\1", text)
    pattern = flagged(p, f)
    if "g" in (literal(f or "''") or ""):
        return f"regexp_replace({s}, {pattern}, {quoted(text)})"
    shifted = "$1" + re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", text)
    return f"regexp_replace({s}, concat('(?s)\\\\A(.*?)(?-s)', {pattern}), {quoted(shifted)})"


# Time ---------------------------------------------------------------------------------------------------------------
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def stride(text: str) -> tuple[int, int]:
    """Months and microseconds of an interval literal such as INTERVAL '15 minutes' or INTERVAL 1 day."""
    body = re.sub(r"(?i)^interval\b", "", text.strip().strip("()").strip()).replace("'", " ")
    months = micros = 0
    found = re.findall(r"(-?\d+)\s*([A-Za-z]+)", body)
    if not found:
        raise QueryError(f"no interval literal: {text}")
    for n, unit in found:
        u = unit.lower().rstrip("s")
        if u in ("month", "year", "quarter"):
            months += int(n) * {"month": 1, "quarter": 3, "year": 12}[u]
        elif u in UNITS:
            micros += int(n) * UNITS[u]
        else:
            raise QueryError(f"unknown unit {unit}")
    return months, micros


@rule("date_bin")
def date_bin(interval: str, ts: str, origin: str = "TIMESTAMP '1970-01-01 00:00:00'") -> str:
    """Start of the bin that ts lies in; bins before the origin are floored too."""
    months, micros = stride(interval)
    ts, origin = f"CAST({ts} AS TIMESTAMP)", f"CAST({origin} AS TIMESTAMP)"
    if months and micros:
        raise QueryError("date_bin: months can't be mixed with days or shorter units")
    if months:
        between = f"((year({ts}) - year({origin})) * 12 + month({ts}) - month({origin}))"
        n = f"CAST(floor({between} / {months}D) AS INT)"
        at = lambda k: f"({origin} + make_ym_interval(0, ({k}) * {months}))"
        return f"(CASE WHEN {at(n)} <= {ts} THEN {at(n)} ELSE {at(n + ' - 1')} END)"
    return f"timestamp_micros(CAST(floor((unix_micros({ts}) - unix_micros({origin})) / {micros}D) AS BIGINT) * {micros}L + unix_micros({origin}))"


@rule("date_part")
def date_part(part: str, ts: str) -> str:
    name = (literal(part) or "").lower()
    micros = f"(unix_micros(CAST({ts} AS TIMESTAMP)) - unix_micros(date_trunc('MINUTE', CAST({ts} AS TIMESTAMP))))"
    own = {
        "dow": f"(dayofweek({ts}) - 1)", "isodow": f"(weekday({ts}) + 1)", "doy": f"dayofyear({ts})", "epoch": f"(unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000D)",
        "millisecond": f"({micros} div 1000)", "microsecond": micros, "nanosecond": f"({micros} * 1000)", "second": f"({micros} div 1000000)",
    }
    return own.get(name) or own.get(name.rstrip("s")) or f"date_part({part}, {ts})"


RULES["from_unixtime"] = lambda n, tz=None: f"timestamp_seconds({n})" if tz is None else f"from_utc_timestamp(timestamp_seconds({n}), {tz})"
RULES["to_local_time"] = lambda ts: f"CAST({ts} AS TIMESTAMP_NTZ)"


@rule("to_char")
def to_char(x: str, pattern: str) -> str:
    text = literal(pattern)
    if text is None:
        raise QueryError("to_char takes a literal format")
    return f"date_format({x}, {quoted(java_pattern(text))})"


def parsed(x: str, formats: tuple[str, ...], kind: str) -> str:
    """x by the first format that fits; without formats, a plain cast."""
    if not formats:
        return f"CAST({x} AS {kind.upper()})"
    tries = []
    for f in formats:
        text = literal(f)
        if text is None:
            raise QueryError(f"to_{kind} takes literal formats")
        tries.append(f"try_to_{kind}({x}, {quoted(java_pattern(text))})")
    return f"coalesce({', '.join(tries)}, CASE WHEN {x} IS NOT NULL THEN CAST(raise_error(concat('no format fits ', {x})) AS {kind.upper()}) END)"


def numeric_or_text(x: str, formats: tuple[str, ...], unit: str) -> str:
    """Integers count units from the epoch; texts are parsed."""
    if not formats and (re.fullmatch(r"\(?-?\d+\)?", x.strip())):
        return unit.format(x=x)
    return parsed(x, formats, "timestamp")


RULES["to_date"] = lambda x, *f: f"date_from_unix_date({x})" if not f and integer(x) is not None else parsed(x, f, "date")
RULES["to_timestamp"] = lambda x, *f: numeric_or_text(x, f, "timestamp_seconds({x})")
RULES["to_timestamp_seconds"] = lambda x, *f: f"date_trunc('SECOND', {numeric_or_text(x, f, 'timestamp_seconds({x})')})"
RULES["to_timestamp_millis"] = lambda x, *f: numeric_or_text(x, f, "timestamp_millis({x})")
RULES["to_timestamp_micros"] = lambda x, *f: numeric_or_text(x, f, "timestamp_micros({x})")
RULES["to_timestamp_nanos"] = lambda x, *f: numeric_or_text(x, f, "timestamp_micros({x} div 1000)")
RULES["to_unixtime"] = lambda x, *f: f"unix_seconds({parsed(x, f, 'timestamp')})"

# Arrays -------------------------------------------------------------------------------------------------------------
RULES["array_any_value"] = lambda a: f"try_element_at(filter({a}, x -> x IS NOT NULL), 1)"
RULES["array_concat"] = lambda *a: f"concat({', '.join(a)})"
RULES["array_distance"] = lambda a, b: (
    f"(CASE WHEN size({a}) <> size({b}) THEN CAST(raise_error('array_distance: arrays of different lengths') AS DOUBLE) ELSE sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, v) -> s + v)) END)"
)
RULES["array_distinct"] = lambda a: f"array_distinct({a})"
RULES["array_element"] = lambda a, n: f"(CASE WHEN {n} = 0 THEN NULL ELSE try_element_at({a}, CAST(CASE WHEN {n} = 0 THEN 1 ELSE {n} END AS INT)) END)"
RULES["array_has"] = lambda a, x: f"CASE WHEN {a} IS NOT NULL THEN coalesce(array_contains({a}, {x}), false) END"
RULES["array_has_all"] = lambda a, b: f"forall({b}, x -> coalesce(array_contains({a}, x), false))"
RULES["array_has_any"] = lambda a, b: f"coalesce(arrays_overlap({a}, {b}), false)"
RULES["array_length"] = lambda a, d="1": f"size({a})" if integer(d) == 1 else f"size({'flatten(' * (integer(d) - 2)}{a}{')' * (integer(d) - 2)}[0])"
RULES["array_pop_back"] = lambda a: f"slice({a}, 1, greatest(size({a}) - 1, 0))"
RULES["array_pop_front"] = lambda a: f"slice({a}, 2, greatest(size({a}) - 1, 0))"
RULES["array_position"] = lambda a, x, start="1": (
    f"nullif(array_position({a}, {x}), 0)" if integer(start) == 1 else f"nullif(array_position(slice({a}, {start}, greatest(size({a}) - {start} + 1, 0)), {x}), 0) + {start} - 1"
)
RULES["array_positions"] = lambda a, e: f"filter(transform({a}, (x, i) -> CASE WHEN x <=> {e} THEN i + 1 END), p -> p IS NOT NULL)"
RULES["array_prepend"] = lambda e, a: f"array_prepend({a}, {e})"
RULES["array_remove"] = lambda a, e: f"filter({a}, (x, i) -> NOT (x <=> {e}) OR i + 1 <> coalesce(array_position({a}, {e}), 0))"
RULES["array_remove_all"] = lambda a, e: f"filter({a}, x -> NOT (x <=> {e}))"


def places(a: str, e: str) -> str:
    """0-based indexes of the elements that equal e."""
    return f"filter(transform({a}, (x, i) -> CASE WHEN x <=> {e} THEN i END), p -> p IS NOT NULL)"


RULES["array_remove_n"] = lambda a, e, n: f"filter({a}, (x, i) -> NOT (x <=> {e}) OR NOT array_contains(slice({places(a, e)}, 1, greatest({n}, 0)), i))"
RULES["array_replace"] = lambda a, e, to: f"transform({a}, (x, i) -> CASE WHEN i + 1 = array_position({a}, {e}) THEN {to} ELSE x END)"
RULES["array_replace_all"] = lambda a, e, to: f"transform({a}, x -> CASE WHEN x <=> {e} THEN {to} ELSE x END)"
RULES["array_replace_n"] = lambda a, e, to, n: f"transform({a}, (x, i) -> CASE WHEN x <=> {e} AND array_contains(slice({places(a, e)}, 1, greatest({n}, 0)), i) THEN {to} ELSE x END)"
RULES["array_resize"] = lambda a, n, v="NULL": f"concat(slice({a}, 1, {n}), array_repeat({v}, greatest({n} - size({a}), 0)))"
RULES["array_reverse"] = lambda a: f"reverse({a})"


@rule("array_slice")
def array_slice(a: str, begin: str, end: str, step: str = "1") -> str:
    """Both ends included; negative positions count from the end. A negative step goes backwards."""
    place = lambda p: f"(CASE WHEN {p} < 0 THEN size({a}) + {p} + 1 ELSE {p} END)"
    b, e = f"greatest({place(begin)}, 1)", f"least({place(end)}, size({a}))"
    k = integer(step)
    if k is None or k == 0:
        raise QueryError("array_slice takes a literal step other than 0")
    if k < 0:
        return f"filter(reverse({array_slice(a, end, begin)}), (x, i) -> i % {-k} = 0)"
    cut = f"slice({a}, CAST({b} AS INT), CAST(greatest({e} - {b} + 1, 0) AS INT))"
    return cut if k == 1 else f"filter({cut}, (x, i) -> i % {k} = 0)"


@rule("array_sort")
def array_sort(a: str, order: str = "'ASC'", nulls: str = "'NULLS FIRST'") -> str:
    """By the order, nulls where the third argument says (first unless told otherwise)."""
    up = (literal(order) or "ASC").upper() == "ASC"
    first = (literal(nulls) or "NULLS FIRST").upper() == "NULLS FIRST"
    rest, none = f"filter({a}, x -> x IS NOT NULL)", f"filter({a}, x -> x IS NULL)"
    parts = [none, f"sort_array({rest}, {str(up).lower()})"]
    return f"concat({', '.join(parts if first else parts[::-1])})"


RULES["array_to_string"] = lambda a, d, n=None: f"array_join(transform({a}, x -> CAST(x AS STRING)), {d}{'' if n is None else f', {n}'})"
RULES["cardinality"] = lambda a: f"CAST(size({a}) AS BIGINT)"
RULES["empty"] = lambda a: f"(size({a}) = 0)"
RULES["flatten"] = lambda a: f"flatten({a})"
RULES["make_array"] = lambda *a: f"array({', '.join(a)})"


def series(include: bool) -> Rule:
    """generate_series has its stop, range hasn't; both are empty where the step leads away from the stop."""

    def apply(start: str, stop: str | None = None, step: str = "1") -> str:
        if stop is None:
            start, stop = "0", start
        if "interval" in step.lower():
            away, beyond = f"{start} > {stop}", "" if include else f"x < {stop}"
        else:
            away = f"({step} > 0 AND {start} > {stop}) OR ({step} < 0 AND {start} < {stop})"
            beyond = "" if include else f"({step} > 0 AND x < {stop}) OR ({step} < 0 AND x > {stop})"
        full = f"CASE WHEN {away} THEN slice(sequence({start}, {start}), 1, 0) ELSE sequence({start}, {stop}, {step}) END"
        return f"({full})" if include else f"filter({full}, x -> {beyond})"

    return apply


RULES["generate_series"], RULES["range"] = series(True), series(False)


@rule("string_to_array")
def string_to_array(s: str, d: str, none: str | None = None) -> str:
    text = literal(d)
    plain = quoted(re.escape(text)) if text is not None else rf"concat('\\Q', {d}, '\\E')"
    return f"split({s}, {plain})" if none is None else f"transform(split({s}, {plain}), x -> nullif(x, {none}))"


# Structs, maps, hashes ----------------------------------------------------------------------------------------------
RULES["struct"] = lambda *a: f"named_struct({', '.join(f'{chr(39)}c{k}{chr(39)}, {x}' for k, x in enumerate(a))})"
RULES["map"] = lambda k, v, *more: f"map_from_arrays({k}, {v})" if not more and k.strip().startswith("array(") else f"map({', '.join((k, v, *more))})"
RULES["make_map"] = lambda *a: f"map({', '.join(a)})"
RULES["map_extract"] = lambda m, k: f"(CASE WHEN map_contains_key({m}, {k}) AND try_element_at({m}, {k}) IS NOT NULL THEN array(try_element_at({m}, {k})) ELSE slice(map_values({m}), 1, 0) END)"
for _bits in (224, 256, 384, 512):
    RULES[f"sha{_bits}"] = lambda x, b=_bits: f"unhex(sha2({x}, {b}))"


@rule("digest")
def digest(x: str, algorithm: str) -> str:
    name = (literal(algorithm) or "").lower()
    if name == "md5":
        return f"unhex(md5({x}))"
    if name in ("sha224", "sha256", "sha384", "sha512"):
        return f"unhex(sha2({x}, {name[3:]}))"
    if name in ("blake2s", "blake2b", "blake3"):
        return f"rivulet_{name}(CAST({x} AS BINARY))"  # registered by functions.python
    raise QueryError(f"digest: no algorithm {algorithm}")


# Unions, types ------------------------------------------------------------------------------------------------------
RULES["union_extract"] = lambda u, f: f"{u}.{literal(f)}"
RULES["get_field"] = lambda s, f: f"{s}[{f}]"


@rule("arrow_cast")
def arrow_cast(x: str, kind: str) -> str:
    return f"CAST({x} AS {spark_type(literal(kind) or '')})"


@rule("arrow_typeof")
def arrow_typeof(x: str) -> str:
    from rivulet.schema import SPARK_NAMES

    cases = " ".join(f"WHEN '{s}' THEN {quoted(a)}" for s, a in SPARK_NAMES.items())
    return f"(CASE typeof({x}) {cases} ELSE typeof({x}) END)"


# JSON ---------------------------------------------------------------------------------------------------------------


def path(keys: tuple[str, ...]) -> str:
    """JSON path of keys and 0-based positions; keys that aren't literals are put in row by row."""
    out: list[str] = ["$"]
    for k in keys:
        if (n := integer(k)) is not None:
            out[-1] += f"[{n}]"
        elif (text := literal(k)) is not None:
            out[-1] += f"['{text}']"
        else:
            out += [f"CASE WHEN typeof({k}) IN ('tinyint', 'smallint', 'int', 'bigint') THEN concat('[', {k}, ']') ELSE concat('[', {quoted(chr(39))}, {k}, {quoted(chr(39))}, ']') END", ""]
    if len(out) == 1:
        return quoted(out[0])
    return f"concat({', '.join(quoted(x) if i % 2 == 0 else x for i, x in enumerate(out))})"


def source(json: str) -> str:
    """A JSON function's argument as text; the value of another one is a variant."""
    return f"to_json({json})" if json.startswith("try_variant_get(") else json


def value_of(json: str, keys: tuple[str, ...], kind: str = "variant") -> str:
    return f"try_variant_get(try_parse_json({source(json)}), {path(keys)}, '{kind}')"


def typed(kind: str, *names: str) -> Rule:
    """A value of one JSON type; null for any other type, never a conversion."""

    def apply(json: str, *keys: str) -> str:
        own = f"schema_of_variant({value_of(json, keys)})"
        return f"(CASE WHEN {' OR '.join(f'{own} LIKE {chr(39)}{n}{chr(39)}' for n in names)} THEN {value_of(json, keys, kind)} END)"

    return apply


RULES["json_get_str"] = typed("string", "STRING")
RULES["json_get_int"] = typed("bigint", "BIGINT")
RULES["json_get_float"] = typed("double", "DOUBLE", "DECIMAL%", "BIGINT", "FLOAT")
RULES["json_get_bool"] = typed("boolean", "BOOLEAN")
RULES["json_get"] = lambda j, *k: value_of(j, k)
RULES["json_get_json"] = lambda j, *k: f"to_json({value_of(j, k)})"
RULES["json_as_text"] = lambda j, *k: f"get_json_object({source(j)}, {path(k)})"
RULES["json_contains"] = lambda j, *k: f"({value_of(j, k)} IS NOT NULL)"


@rule("json_length")
def json_length(j: str, *k: str) -> str:
    own = j if not k else f"to_json({value_of(j, k)})"
    return f"coalesce(json_array_length({own}), size(json_object_keys({own})))"


# Aggregates ---------------------------------------------------------------------------------------------------------
RULES["median"] = lambda x: f"median({x})"
RULES["grouping"] = lambda x: f"CAST(grouping({x}) AS INT)"
RULES["stddev"] = lambda x: f"stddev_samp({x})"
RULES["var"] = lambda x: f"var_samp({x})"
RULES["approx_distinct"] = lambda x: f"approx_count_distinct({x})"
RULES["approx_median"] = lambda x: f"percentile_approx({x}, 0.5)"
RULES["approx_percentile_cont"] = lambda x, p, c=None: f"percentile_approx({x}, {p}{'' if c is None else f', greatest({c}, 1) * 100'})"
RULES["approx_percentile_cont_with_weight"] = lambda x, w, p: f"percentile({x}, {p}, {w})"
RULES["first_value"] = lambda x: f"first_value({x})"
RULES["last_value"] = lambda x: f"last_value({x})"
#: Null elements stay, which Spark's own function would leave out.
RULES["array_agg"] = lambda x: f"transform(collect_list(named_struct('v', {x})){HOLE}, s -> s.v)"
RULES["string_agg"] = lambda x, d: f"listagg({x}, {d})"


@rule("array_ndims")
def array_ndims(a: str) -> str:
    """Depth, from the type's name."""
    return f"CAST((char_length(typeof({a})) - char_length(replace(typeof({a}), 'array<', ''))) div 6 AS INT)"


RULES["array_dims"] = lambda a: (
    f"(CASE {array_ndims(a)} WHEN 1 THEN array(size({a})) ELSE concat(array(size({a})), transform(slice({a}, 1, 1), x -> size(x))) END)" if a.strip().startswith("array(array(") else f"array(size({a}))"
)


def known(name: str) -> bool:
    return ALIASES.get(name, name) in RULES or ALIASES.get(name, name) in SAME


def call(name: str, args: list[str]) -> str:
    """Spark SQL for a call in the dialect; names that the dialect doesn't list go to Spark as they are."""
    own = ALIASES.get(name.lower(), name.lower())
    if own in RULES:
        try:
            return RULES[own](*args)
        except TypeError as e:
            raise QueryError(f"{name}: wrong number of arguments ({len(args)})") from e
    return f"{own}({', '.join(args)})"


def ordered(name: str, args: list[str], keys: list[tuple[str, bool, bool]], distinct: bool) -> str:
    """An aggregate with ORDER BY inside: keys are (expression, ascending, nulls first)."""
    own = ALIASES.get(name.lower(), name.lower())
    if own == "string_agg":
        by = ", ".join(f"{k} {'ASC' if up else 'DESC'} NULLS {'FIRST' if first else 'LAST'}" for k, up, first in keys)
        return f"listagg({'DISTINCT ' if distinct else ''}{args[0]}, {args[1]}) WITHIN GROUP (ORDER BY {by})"
    if own in ("first_value", "last_value") and len({up for _, up, _ in keys}) == 1:
        least = keys[0][1] == (own == "first_value")  # the wanted row is the smallest in order of the keys
        parts = []
        for k, up, first in keys:
            nulls_small = first == up  # nulls come before the values when these ascend
            parts += [f"{k} IS NOT NULL" if nulls_small else f"{k} IS NULL", k]
        return f"{'min_by' if least else 'max_by'}({args[0]}, struct({', '.join(parts)}))"
    fields = ", ".join(f"'k{i}', {k}" for i, (k, _, _) in enumerate(keys))
    rows = f"collect_list(named_struct({fields}, 'v', {args[0]})){HOLE}"
    compare = ""
    for i, (_, up, first) in enumerate(keys):
        a, b = f"l.k{i}", f"r.k{i}"
        below, above = (-1, 1) if up else (1, -1)
        none = -1 if first else 1
        compare += f" WHEN {a} IS NULL AND {b} IS NOT NULL THEN {none} WHEN {a} IS NOT NULL AND {b} IS NULL THEN {-none} WHEN {a} < {b} THEN {below} WHEN {a} > {b} THEN {above}"
    sorted_ = f"transform(array_sort({rows}, (l, r) -> CASE{compare} ELSE 0 END), s -> s.v)"
    if own == "array_agg":
        return f"array_distinct({sorted_})" if distinct else sorted_
    if own == "first_value":
        return f"try_element_at({sorted_}, 1)"
    if own == "last_value":
        return f"try_element_at({sorted_}, -1)"
    if own == "nth_value":
        return f"try_element_at({sorted_}, {args[1]})"
    return call(own, args)  # the order makes no difference
