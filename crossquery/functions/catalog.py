"""Name -> Column builder, for scalars and aggregates; names outside the catalogue raise ``PlanError``.

Where Spark's function of a name means something else than the plan language's, the builder
composes what is meant: ``concat`` skips nulls, ``substr`` counts positions before 1, ``log`` is
decimal, ``trunc`` rounds towards zero, ``regexp_replace`` replaces once unless told ``g``, ``to_char`` takes
strftime's specifiers, ``array_agg`` keeps nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError

Builder = Callable[..., Column]


def _spark(*names: str, **renamed: str) -> dict[str, Builder]:
    pairs = {n: n for n in names} | renamed
    return {n: (lambda *args, f=f: F.call_function(f, *args)) for n, f in pairs.items()}


def _logarithm(base: float | None):
    """Of 0 it is minus infinity and of a negative number NaN, as in IEEE arithmetic; Spark's own give null."""

    def build(x: Column) -> Column:
        x = x.cast("double")
        value = F.ln(x) if base is None else F.log10(x) if base == 10 else F.log2(x)
        return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(value)

    return build


def _trunc(x: Column, digits: Column | None = None) -> Column:
    scale = F.lit(1.0) if digits is None else F.pow(F.lit(10.0), digits)
    scaled = x * scale
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("double") / scale


def _substr(text: Column, start: Column, length: Column | None = None) -> Column:
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(text, first, F.length(text))
    return F.substring(text, first, F.greatest(start + length - first, F.lit(0)))


def _split_part(text: Column, delimiter: Column, part: Column) -> Column:
    return F.split_part(text, delimiter, part.cast("int"))


def _expanded(text: Column, pattern: Column, other: Column) -> Column:
    """The replacement with its group references filled from the first match, which is found in its context."""
    groups = [(F.lit(f"${k}"), k) for k in range(10)]

    def token(t: Column) -> Column:
        out = F.when(F.startswith(t, F.lit("\\")), F.substring(t, 2, 1))
        for name, k in groups:
            out = out.when(t == name, F.call_function("regexp_extract", text, pattern, F.lit(k)))
        return out.otherwise(t)

    return F.concat_ws("", F.transform(F.regexp_extract_all(other, F.lit(r"\$[0-9]|\\.|[^$\\]+|."), F.lit(0)), token))


def _regexp_replace(text: Column, pattern: Column, other: Column, flags: Column | None = None) -> Column:
    if flags is None:
        # once: the text is split at the first match, which sees what is around it
        at, found = F.regexp_instr(text, pattern), F.call_function("regexp_extract", text, pattern, F.lit(0))
        parts, filled = F.split(text, pattern, 2), _expanded(text, pattern, other)
        once = F.when((at == 1) & (found == ""), F.concat(filled, text)).otherwise(F.concat(parts[0], filled, F.get(parts, F.lit(1))))
        return F.when(text.isNull() | pattern.isNull() | other.isNull(), F.lit(None)).when(at == 0, text).otherwise(once)
    pattern = F.when(F.contains(flags, F.lit("i")), F.concat(F.lit("(?i)"), pattern)).otherwise(pattern)
    return F.when(F.contains(flags, F.lit("g")), F.regexp_replace(text, pattern, other)).otherwise(_regexp_replace(text, pattern, other))


#: strftime's specifiers, as Java's patterns.
_MOMENTS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%j": "DDD",
    "%a": "E", "%A": "EEEE", "%b": "MMM", "%h": "MMM", "%B": "MMMM", "%f": "SSSSSSSSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%D": "MM/dd/yy", "%R": "HH:mm",
}


def _to_char(moment: Column, form: Column) -> Column:
    """By strftime's specifiers; others stay as they are."""

    def token(t: Column) -> Column:
        out = F.when(t == "%%", F.lit("%")).when(t == "%e", F.lpad(F.date_format(moment, "d"), 2, " "))
        for name, pattern in _MOMENTS.items():
            out = out.when(t == name, F.date_format(moment, pattern))
        return out.otherwise(t)

    written = F.concat_ws("", F.transform(F.regexp_extract_all(form, F.lit("(?s)%.|[^%]+|%"), F.lit(0)), token))
    return F.when(moment.isNotNull() & form.isNotNull(), written)


def _whole_array(x: Column) -> Column:
    """All values, nulls too; without rows null."""
    held = F.collect_list(F.struct(x.alias("x")))
    return F.when(F.size(held) > 0, F.transform(held, lambda s: s["x"]))


def _nth_value(x: Column, n: Column) -> Column:
    return F.get(F.collect_list(F.struct(x.alias("x"))), n.cast("int") - 1)["x"]


def _each_once(x: Column) -> Column:
    """Distinct values without null, in order, as an array."""
    return F.array_sort(F.collect_set(x))


def _distinct_string_agg(x: Column, separator: Column | None = None) -> Column:
    values = _each_once(x.cast("string"))
    return F.when(F.size(values) > 0, F.call_function("array_join", values, F.lit("") if separator is None else separator))


def _digest(x: Column, method: Column) -> Column:
    kind = F.lower(method)
    out = F.when(kind == "md5", F.unhex(F.md5(x)))
    for bits in (224, 256, 384, 512):
        out = out.when(kind == f"sha{bits}", F.unhex(F.sha2(x, bits)))
    return out


def _encode(x: Column, form: Column) -> Column:
    return F.when(F.lower(form) == "hex", F.lower(F.hex(x))).when(F.lower(form) == "base64", F.rtrim(F.base64(x.cast("binary")), F.lit("=")))


def _decode(x: Column, form: Column) -> Column:
    return F.when(F.lower(form) == "hex", F.unhex(x)).when(F.lower(form) == "base64", F.unbase64(x))


def _named_struct(*args: Column) -> Column:
    return F.call_function("named_struct", *args)


def _gcd(a: Column, b: Column) -> Column:
    # Euclid's algorithm as a fold: 92 steps are enough for any two 64-bit integers
    start = F.struct(F.abs(a.cast("bigint")).alias("x"), F.abs(b.cast("bigint")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"])


def _lcm(a: Column, b: Column) -> Column:
    g = _gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.abs(F.call_function("div", a.cast("bigint"), F.when(g == 0, F.lit(1)).otherwise(g)) * b))


def _date_part(part: Column, moment: Column) -> Column:
    return F.date_part(part, moment).cast("double")


def _date_trunc(part: Column, moment: Column) -> Column:
    return F.call_function("date_trunc", part, moment).cast("timestamp_ntz")


def _date_bin(width: Column, moment: Column, origin: Column | None = None) -> Column:
    """Start of the bin of ``width`` seconds, from an origin of 1970 unless given."""
    seconds = lambda x: F.unix_micros(x.cast("timestamp")) / 1_000_000
    zero = F.lit(0.0) if origin is None else seconds(origin)
    return F.timestamp_micros(((F.floor((seconds(moment) - zero) / width) * width + zero) * 1_000_000).cast("bigint")).cast("timestamp_ntz")


SCALARS: dict[str, Builder] = (
    _spark(
        *"abs ceil floor round sqrt cbrt exp power pow sign signum pi radians degrees factorial isnan nanvl".split(),
        *"sin cos tan asin acos atan atan2 sinh cosh tanh asinh acosh atanh cot random rand".split(),
        *"ascii bit_length btrim char_length character_length length chr concat_ws contains initcap left lower lpad ltrim md5 octet_length".split(),
        *"overlay find_in_set regexp_instr repeat replace reverse right rpad rtrim substring_index translate trim upper uuid levenshtein".split(),
        *"regexp_like regexp_count to_date make_date from_unixtime now current_date current_timestamp to_timestamp".split(),
        *"coalesce nullif nvl ifnull nvl2 greatest least".split(),
        array_length="array_size",
        ceiling="ceil",
        starts_with="startswith",
        ends_with="endswith",
        today="current_date",
    )
    | {
        "ln": _logarithm(None),
        "log2": _logarithm(2),
        "log10": _logarithm(10),
        "log": lambda x, y=None: _logarithm(10)(x) if y is None else _logarithm(None)(y) / _logarithm(None)(x),
        "trunc": _trunc,
        "gcd": _gcd,
        "lcm": _lcm,
        "concat": lambda *args: F.concat_ws("", *args),
        "substr": _substr,
        "substring": _substr,
        "split_part": _split_part,
        "strpos": lambda text, part: F.call_function("instr", text, part),
        "instr": lambda text, part: F.call_function("instr", text, part),
        "position": lambda text, part: F.call_function("instr", text, part),
        "substr_index": lambda text, delimiter, n: F.call_function("substring_index", text, delimiter, n.cast("int")),
        "to_char": _to_char,
        "date_format": _to_char,
        "iszero": lambda x: x == 0,
        "encode": _encode,
        "decode": _decode,
        "digest": _digest,
        "named_struct": _named_struct,
        "to_timestamp_seconds": lambda x: F.timestamp_seconds(x).cast("timestamp_ntz"),
        "to_timestamp_millis": lambda x: F.timestamp_millis(x.cast("bigint")).cast("timestamp_ntz"),
        "to_timestamp_micros": lambda x: F.timestamp_micros(x.cast("bigint")).cast("timestamp_ntz"),
        "to_unixtime": lambda x: F.unix_seconds(x.cast("timestamp")),
        "to_local_time": lambda x: x.cast("timestamp_ntz"),
        "to_hex": lambda x: F.lower(F.hex(x)),
        "sha224": lambda x: F.sha2(x, 224),
        "sha256": lambda x: F.sha2(x, 256),
        "sha384": lambda x: F.sha2(x, 384),
        "sha512": lambda x: F.sha2(x, 512),
        "regexp_replace": _regexp_replace,
        "regexp_match": lambda text, pattern: F.when(F.regexp_like(text, pattern), F.array(F.regexp_substr(text, pattern))),
        "date_part": _date_part,
        "datepart": _date_part,
        "extract": _date_part,
        "date_trunc": _date_trunc,
        "datetrunc": _date_trunc,
        "date_bin": _date_bin,
    }
)

AGGREGATES: dict[str, Builder] = _spark(
    *"count sum avg mean min max median stddev stddev_pop stddev_samp var_pop var_samp variance corr covar_pop covar_samp".split(),
    *"regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy".split(),
    *"bool_and bool_or bit_and bit_or bit_xor first_value last_value grouping approx_percentile".split(),
    var="var_samp",
    approx_distinct="approx_count_distinct",
    approx_percentile_cont="percentile_approx",
    every="bool_and",
) | {
    "array_agg": _whole_array,
    "nth_value": _nth_value,
    "approx_median": lambda x: F.percentile_approx(x, 0.5),
    "string_agg": lambda x, separator=None: F.call_function("listagg", x, *([] if separator is None else [separator])),
}


#: Aggregates whose results hold a group's distinct values, so these are gathered; an array of nulls' own value is not among them.
_DISTINCT: dict[str, Builder] = {
    "array_agg": lambda x: F.transform(F.collect_set(F.struct(x.alias("x"))), lambda s: s["x"]),
    "string_agg": _distinct_string_agg,
}
#: Aggregates, by Spark's names, that need no gathering: distinct values are dealt out first. Where grouping sets leave that to Spark only SQL says DISTINCT, of a column by name.
DISTINCT_BY_NAME = {n: n for n in ("median", "stddev_samp", "stddev_pop", "var_samp", "var_pop")} | {"stddev": "stddev_samp", "var": "var_samp", "variance": "var_samp"}


def distinct_by_name(name: str, column: str) -> Column:
    return F.expr(f"{DISTINCT_BY_NAME[name]}(DISTINCT `{column}`)")


def is_aggregate(name: str) -> bool:
    return name.lower() in AGGREGATES and name not in SCALARS


def call(name: str, args: list[Column]) -> Column:
    """A scalar of that name, else an aggregate."""
    builder = SCALARS.get(name) or AGGREGATES.get(name)
    if builder is None:
        raise PlanError(f"function {name!r} is not supported")
    return _built(name, builder, args)


def aggregate(name: str, args: list[Column], distinct: bool = False) -> Column:
    """An aggregate, its name in any case."""
    name = name.lower()
    if name not in AGGREGATES:
        raise PlanError(f"aggregate {name!r} is not supported")
    if distinct and name in ("count", "sum", "avg", "mean"):
        if name == "count":
            return F.count_distinct(*args)
        if name == "sum":
            return F.sum_distinct(*args)
        return F.sum_distinct(*args) / F.count_distinct(*args)
    if distinct and name in _DISTINCT:
        return _built(name, _DISTINCT[name], args)
    if distinct and name not in ("min", "max", "bool_and", "bool_or", "every", "bit_and", "bit_or", "approx_distinct"):
        raise PlanError(f"aggregate {name!r} does not take DISTINCT")
    return _built(name, AGGREGATES[name], args)


def _built(name: str, builder: Builder, args: list[Column]) -> Column:
    try:
        return builder(*args)
    except TypeError as e:
        raise PlanError(f"function {name!r}: {e}") from None
