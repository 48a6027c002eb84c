"""One function for each kind of fragment: (inputs, fragment) -> DataFrame. All are lazy but the guard."""

from __future__ import annotations

import functools
import threading
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CardinalityError, PlanError
from ..functions import catalog
from ..plans import model as m
from .expressions import Compiler, quoted

LEFT, RIGHT, ONE = "in_left", "in_right", "in_0"
_SPARK_JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
SCALAR_MESSAGE = "Scalar subquery produced more than one row"
_QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"
_views = threading.RLock()


def apply(fragment: m.Fragment, inputs: Mapping[str, DataFrame]) -> DataFrame:
    match fragment:
        case m.HashJoin() | m.NestedLoopJoin():
            return join(fragment, _input(inputs, LEFT), _input(inputs, RIGHT))
        case m.RawSql(sql):
            return raw_sql(sql, inputs)
    return _UNARY[type(fragment)](fragment, _input(inputs, ONE).alias(ONE))


def _input(inputs: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name not in inputs:
        raise PlanError(f"the fragment needs an input {name!r}; it has {sorted(inputs)}")
    return inputs[name]


def _selected(frame: DataFrame, columns: list[Column], names: list[str]) -> DataFrame:
    """Under the given names, which may repeat (a later fragment can then refer only to those that don't)."""
    return frame.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])


def project(fragment: m.Project, frame: DataFrame) -> DataFrame:
    compiler = Compiler(frame)
    out = _selected(frame, [compiler.column(p.expr) for p in fragment.project], [p.alias for p in fragment.project])
    return out.distinct() if fragment.distinct else out


def filtered(fragment: m.Filter, frame: DataFrame) -> DataFrame:
    return frame.where(Compiler(frame).column(fragment.predicate))


def join(fragment: m.HashJoin | m.NestedLoopJoin, left: DataFrame, right: DataFrame) -> DataFrame:
    left, right, how = left.alias(LEFT), right.alias(RIGHT), _SPARK_JOINS[fragment.join_type]
    if isinstance(fragment, m.HashJoin):
        pairs = zip(fragment.left_keys, fragment.right_keys, strict=True)
        condition = functools.reduce(lambda a, b: a & b, [F.col(f"{LEFT}.{quoted(a)}") == F.col(f"{RIGHT}.{quoted(b)}") for a, b in pairs])
    else:
        condition = F.lit(True) if fragment.condition is None else Compiler(left.join(right)).column(fragment.condition)
    if how == "inner" and isinstance(fragment, m.NestedLoopJoin) and fragment.condition is None:
        out = left.crossJoin(right)
    else:
        out = left.join(right, condition, how)
    compiler = Compiler(out)
    return _selected(out, [compiler.column(p.expr) for p in fragment.project], [p.alias for p in fragment.project])


def aggregate(fragment: m.Aggregate, frame: DataFrame) -> DataFrame:
    """Grouping expressions become columns first, so grouping sets, ``grouping()`` and expressions over keys all see them."""
    sets = fragment.grouping_sets
    groups = list(dict.fromkeys(e for s in sets for e in s)) if sets else list(dict.fromkeys(fragment.group_by))
    plain = Compiler(frame)
    keys = {e: f"__group_{k}" for k, e in enumerate(groups)}
    added = {name: plain.column(e) for e, name in keys.items()}
    for k, item in enumerate(fragment.select):
        if item.agg and item.agg.within_group:
            added[f"__order_{k}"] = plain.column(item.agg.within_group.key)
        elif item.agg and item.agg.distinct and item.agg.func.lower() in catalog.DISTINCT_BY_NAME and len(item.agg.args) == 1:
            added[f"__distinct_{k}"] = plain.column(item.agg.args[0])
    wide = frame.withColumns(added) if added else frame
    known = {e: F.col(name) for e, name in keys.items()}
    compiler, rows = Compiler(wide, known), Compiler(wide)
    items: dict[int, Column] = {}
    apart: dict[m.Expr, list[int]] = {}
    for k, item in enumerate(fragment.select):
        if f"__distinct_{k}" in added and not sets:
            apart.setdefault(item.agg.args[0], []).append(k)
            continue
        column = compiler.column(item.expr) if item.agg is None else _call(item.agg, rows, compiler, k)
        items[k] = column.alias(f"__out_{k}")
    names = [item.alias for item in fragment.select]
    if sets:
        grouped = wide.groupingSets([[F.col(keys[e]) for e in s] for s in sets], *known.values())
    else:
        grouped = wide.groupBy(*known.values())
    out = grouped.agg(*items.values()) if items else wide.select(*known.values()).distinct() if groups else wide.agg(F.lit(0))
    for n, own in enumerate(apart.values()):
        out = _beside(out, wide, [*keys.values()], n, {k: catalog.DISTINCT_BY_NAME[fragment.select[k].agg.func.lower()] for k in own})
    return out.select(*[f"__out_{k}" for k in range(len(names))]).toDF(*names)


def _beside(out: DataFrame, wide: DataFrame, keys: list[str], n: int, calls: dict[int, str]) -> DataFrame:
    """Aggregates of one argument's distinct values, joined to the others by group: Spark alone would put each row and each
    distinct value of every such call through one aggregation, and with it what the other calls gather."""
    once = wide.select(*keys, F.col(f"__distinct_{next(iter(calls))}").alias("__x")).distinct()
    part = once.groupBy(*[F.col(key).alias(f"__key_{n}_{i}") for i, key in enumerate(keys)])
    part = part.agg(*[F.call_function(f, F.col("__x")).alias(f"__out_{k}") for k, f in calls.items()])
    if not keys:
        return out.crossJoin(part)
    return out.join(part, functools.reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"__key_{n}_{i}")) for i, key in enumerate(keys)]))


def _call(call: m.AggCall, rows: Compiler, groups: Compiler, k: int) -> Column:
    name = call.func.lower()
    if call.star:
        if name != "count" or call.args or call.distinct:
            raise PlanError(f"only count takes a star, not {call.func!r}")
        return F.count(F.lit(1))
    if call.within_group is not None:
        if name not in ("percentile_cont", "percentile_disc", "quantile_cont", "approx_percentile_cont") or len(call.args) != 1:
            raise PlanError(f"{call.func!r} is not an ordered-set aggregate of one fraction")
        fraction = call.args[0]
        if not (isinstance(fraction, m.Literal) and isinstance(fraction.value, m.Int | m.Float)):
            raise PlanError("the fraction of an ordered-set aggregate must be a number")
        down = " DESC" if call.within_group.desc else ""
        exact = "percentile_disc" if name == "percentile_disc" else "percentile_cont"
        return F.expr(f"{exact}({fraction.value.value!r}D) WITHIN GROUP (ORDER BY `__order_{k}`{down})")
    if name == "grouping":
        return F.grouping(groups.column(call.args[0]))
    if call.distinct and name in catalog.DISTINCT_BY_NAME and len(call.args) == 1:
        return catalog.distinct_by_name(name, f"__distinct_{k}")
    return catalog.aggregate(name, [rows.column(a) for a in call.args], call.distinct)


def sort(fragment: m.Sort, frame: DataFrame) -> DataFrame:
    compiler, keys = Compiler(frame), []
    for k in fragment.keys:
        c = compiler.column(k.expr)
        up = c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()
        down = c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()
        keys.append(up if k.ascending else down)
    return frame.orderBy(*keys)


def limit(fragment: m.Limit, frame: DataFrame) -> DataFrame:
    out = frame.offset(fragment.offset) if fragment.offset else frame
    return out if fragment.limit is None else out.limit(fragment.limit)


def single_row_guard(fragment: m.SingleRowGuard, frame: DataFrame) -> DataFrame:
    """The relation itself, once it is known to have at most one row (for each key, nulls being equal).

    Eager: a lazy check could be pruned, or cut short by a limit, and would then let wrong rows pass.
    """
    if fragment.keys:
        compiler = Compiler(frame)
        keys = [compiler.column(k).alias(f"k{n}") for n, k in enumerate(fragment.keys)]
        many = bool(frame.groupBy(*keys).count().where("count > 1").limit(1).count())
    else:
        many = len(frame.select(F.lit(1)).limit(2).collect()) > 1
    if many:
        raise CardinalityError(SCALAR_MESSAGE)
    return frame


def raw_sql(sql: str, inputs: Mapping[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """The query over its inputs as temporary views, which exist only while it is analysed; views of their names come back.

    Double quotes hold identifiers, as in standard SQL.
    """
    if spark is None:
        spark = next(iter(inputs.values())).sparkSession if inputs else SparkSession.active()
    with _views:
        quotes = spark.conf.get(_QUOTES)
        before = {n: spark.table(quoted(n)) for n in inputs if spark.catalog.tableExists(n)}
        try:
            for name, frame in inputs.items():
                frame.createOrReplaceTempView(quoted(name) if not name.isidentifier() else name)
            spark.conf.set(_QUOTES, "true")
            return spark.sql(sql)
        finally:
            spark.conf.set(_QUOTES, quotes)
            for name in inputs:
                spark.catalog.dropTempView(name)
            for name, frame in before.items():
                if not spark.catalog.tableExists(name):
                    frame.createOrReplaceTempView(name)


_UNARY = {
    m.Project: project,
    m.Filter: filtered,
    m.Aggregate: aggregate,
    m.Sort: sort,
    m.Limit: limit,
    m.SingleRowGuard: single_row_guard,
}
