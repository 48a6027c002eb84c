"""Expression nodes to Columns."""

from __future__ import annotations

import functools
import operator as o

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions import catalog
from ..plans import model as m

#: The names of cast targets, and the Spark types they stand for.
CAST_TYPES = {
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "float32": "float",
    "float64": "double",
    "utf8": "string",
    "string": "string",
    "boolean": "boolean",
    "bool": "boolean",
    "date32": "date",
}
_OPERATORS = {
    "+": o.add,
    "-": o.sub,
    "*": o.mul,
    "%": o.mod,
    "=": o.eq,
    "!=": o.ne,
    "<>": o.ne,
    "<": o.lt,
    "<=": o.le,
    ">": o.gt,
    ">=": o.ge,
    "and": o.and_,
    "or": o.or_,
    "like": F.like,
    "ilike": F.ilike,
    "is_distinct_from": lambda a, b: ~a.eqNullSafe(b),
    "is_not_distinct_from": lambda a, b: a.eqNullSafe(b),
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _quotient(left: Column, right: Column) -> Column:
    """By zero it is infinite, or NaN, as in IEEE arithmetic; Spark's own raises."""
    infinite = F.when((left == 0) | F.isnan(left.cast("double")), F.lit(float("nan"))).otherwise(F.signum(left) * float("inf"))
    return F.when(right == 0, F.when(left.isNotNull(), infinite)).otherwise(left / F.nullif(right, F.lit(0)))


class Compiler:
    """Compiles expressions over one DataFrame, which is asked for types where an operator depends on them.

    ``known`` maps whole expressions (those a relation is grouped by) to columns that hold their values.
    """

    def __init__(self, frame: DataFrame, known: dict[m.Expr, Column] | None = None):
        self.frame, self.known = frame, known or {}

    def column(self, e: m.Expr) -> Column:
        if e in self.known:
            return self.known[e]
        match e:
            case m.Column(name, relation):
                return F.col(quoted(name) if relation is None else f"{quoted(relation)}.{quoted(name)}")
            case m.Literal(value):
                return self.literal(value)
            case m.Binary(op, left, right):
                return self.binary(op, self.column(left), self.column(right))
            case m.Unary("not", operand):
                return ~self.column(operand)
            case m.Unary("neg" | "-", operand):
                return -self.column(operand)
            case m.Unary(op):
                raise PlanError(f"unsupported unary operator {op!r}")
            case m.Cast(inner, to):
                if to not in CAST_TYPES:
                    raise PlanError(f"unsupported cast target type {to!r}")
                return self.column(inner).cast(CAST_TYPES[to])
            case m.Case(whens, operand, otherwise):
                if not whens:
                    raise PlanError("a case needs a branch")
                subject = None if operand is None else self.column(operand)
                tests = [(self.condition(w.when) if subject is None else self.column(w.when), self.column(w.then)) for w in whens]
                tests = tests if subject is None else [(subject == test, then) for test, then in tests]
                out = functools.reduce(lambda c, x: c.when(*x), tests[1:], F.when(*tests[0]))
                return out if otherwise is None else out.otherwise(self.column(otherwise))
            case m.InList(inner, choices, negated):
                found = self.column(inner).isin([self.column(x) for x in choices]) if choices else F.lit(False)
                return ~found if negated else found
            case m.IsNull(inner, negated):
                value = self.column(inner)
                return value.isNotNull() if negated else value.isNull()
            case m.Function("grouping", args):
                return F.grouping(self.column(args[0]))
            case m.Function(name, args):
                # an aggregate's arguments are rows' values, not the groups'
                inner = Compiler(self.frame) if catalog.is_aggregate(name) else self
                return catalog.call(name, [inner.column(a) for a in args])
        raise PlanError(f"not an expression: {e!r}")

    def condition(self, e: m.Expr) -> Column:
        """A bare null has no type of its own; where a condition is needed it is an unknown one."""
        return self.column(e).cast("boolean") if e == m.Literal(m.Null()) else self.column(e)

    @staticmethod
    def literal(value: m.Value) -> Column:
        match value:
            case m.Int(v):
                return F.lit(v).cast("bigint")
            case m.Float(v):
                return F.lit(v).cast("double")
            case m.Str(v) | m.Bool(v):
                return F.lit(v)
            case m.Null():
                return F.lit(None)
        raise PlanError(f"not a literal: {value!r}")

    def binary(self, op: str, left: Column, right: Column) -> Column:
        if op == "/":
            return F.call_function("div", left, right) if self._whole(left) and self._whole(right) else _quotient(left, right)
        if op not in _OPERATORS:
            raise PlanError(f"unsupported binary operator {op!r}")
        return _OPERATORS[op](left, right)

    def _whole(self, x: Column) -> bool:
        for read in (self.frame.select, self.frame.agg):
            try:
                return isinstance(read(x.alias("x")).schema["x"].dataType, _WHOLE)
            except AnalysisException:
                continue
        return False
