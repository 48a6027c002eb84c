"""Plans from Python: expressions with operators, and a chain of steps that produces the same document as JSON would.

    b = PlanBuilder()
    big = b.scan("o", "orders", ["o_orderkey", "o_orderpriority"], where=col("o_totalprice") > 300000)
    lines = b.scan_reduced("o", "lineitem", ["l_orderkey", "l_extendedprice"], "l_orderkey", big.keys("o_orderkey"))
    plan = big.join(lines, ["o_orderkey"], ["l_orderkey"], {"p": col("o_orderpriority")}).returned()
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from . import model as m


@dataclass(frozen=True, eq=False)
class E:
    """An expression under construction; Python's operators build nodes."""

    node: m.Expr

    def _binary(op, swap=False):  # noqa: N805
        def build(self, other):
            a, b = (other, self) if swap else (self, other)
            return E(m.Binary(op, node(a), node(b)))

        return build

    __add__, __sub__, __mul__, __truediv__, __mod__ = map(_binary, ("+", "-", "*", "/", "%"))
    __radd__, __rsub__, __rmul__, __rtruediv__ = map(_binary, ("+", "-", "*", "/"), (True,) * 4)
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = map(_binary, ("=", "!=", "<", "<=", ">", ">="))
    __and__, __or__ = map(_binary, ("and", "or"))
    like, ilike = map(_binary, ("like", "ilike"))
    is_distinct_from, is_not_distinct_from = map(_binary, ("is_distinct_from", "is_not_distinct_from"))
    __hash__ = None

    def __invert__(self):
        return E(m.Unary("not", self.node))

    def __neg__(self):
        return E(m.Unary("neg", self.node))

    def cast(self, to: str) -> E:
        return E(m.Cast(self.node, to))

    def isin(self, *values, negated: bool = False) -> E:
        return E(m.InList(self.node, tuple(map(node, values)), negated))

    def is_null(self) -> E:
        return E(m.IsNull(self.node))

    def is_not_null(self) -> E:
        return E(m.IsNull(self.node, True))


def node(x) -> m.Expr:
    if isinstance(x, E):
        return x.node
    if isinstance(x, m.Expr):
        return x
    kinds = {bool: m.Bool, int: m.Int, float: m.Float, str: m.Str}
    return m.Literal(m.Null() if x is None else kinds[type(x)](x))


def lit(x) -> E:
    return E(node(x))


def col(name: str, relation: str | None = None) -> E:
    return E(m.Column(name, relation))


def fn(name: str, *args) -> E:
    return E(m.Function(name, tuple(map(node, args))))


def case(*whens: tuple, operand=None, otherwise=None) -> E:
    branches = tuple(m.WhenThen(node(w), node(t)) for w, t in whens)
    return E(m.Case(branches, None if operand is None else node(operand), None if otherwise is None else node(otherwise)))


def agg(func: str, *args, distinct: bool = False) -> m.AggCall:
    return m.AggCall(func, distinct, func == "count" and not args, tuple(map(node, args)))


def within(func: str, fraction: float, key, desc: bool = False) -> m.AggCall:
    return m.AggCall(func, args=(node(fraction),), within_group=m.WithinGroup(node(key), desc))


def asc(x, nulls_first: bool = False) -> m.SortKey:
    return m.SortKey(node(x if not isinstance(x, str) else col(x)), True, nulls_first)


def desc(x, nulls_first: bool = False) -> m.SortKey:
    return m.SortKey(node(x if not isinstance(x, str) else col(x)), False, nulls_first)


def _projections(columns: Mapping | Sequence[str]) -> tuple[m.Projection, ...]:
    pairs = columns.items() if isinstance(columns, Mapping) else [(c, col(c)) for c in columns]
    return tuple(m.Projection(node(e), alias) for alias, e in pairs)


class Keys:
    def __init__(self, name: str):
        self.name = name


class Relation:
    """A binding of a plan under construction."""

    def __init__(self, builder: PlanBuilder, name: str):
        self.builder, self.name = builder, name

    def _merge(self, fragment: m.Fragment, **inputs: Relation) -> Relation:
        return self.builder._merge(fragment, {k: r.name for k, r in (inputs or {"in_0": self}).items()})

    def keys(self, key: str, cap: int = 2000) -> Keys:
        name = self.builder._name("keys")
        self.builder.steps.append(m.CollectDistinct(self.name, key, name, cap))
        return Keys(name)

    def select(self, columns: Mapping | Sequence[str], distinct: bool = False) -> Relation:
        return self._merge(m.Project(_projections(columns), distinct))

    def where(self, predicate) -> Relation:
        return self._merge(m.Filter(node(predicate)))

    def join(self, right: Relation, left_keys: Sequence[str], right_keys: Sequence[str], columns: Mapping | Sequence[str], how: str = "inner") -> Relation:
        return self._merge(m.HashJoin(how, tuple(left_keys), tuple(right_keys), _projections(columns)), in_left=self, in_right=right)

    def join_on(self, right: Relation, condition, columns: Mapping | Sequence[str], how: str = "inner") -> Relation:
        return self._merge(m.NestedLoopJoin(how, _projections(columns), None if condition is None else node(condition)), in_left=self, in_right=right)

    def aggregate(self, select: Mapping, group_by: Sequence = (), grouping_sets: Sequence[Sequence] = ()) -> Relation:
        of = lambda x: node(col(x) if isinstance(x, str) else x)
        items = tuple(m.AggItem(alias, agg=x) if isinstance(x, m.AggCall) else m.AggItem(alias, expr=of(x)) for alias, x in select.items())
        return self._merge(m.Aggregate(items, tuple(map(of, group_by)), tuple(tuple(map(of, s)) for s in grouping_sets)))

    def rollup(self, select: Mapping, columns: Sequence) -> Relation:
        return self.aggregate(select, grouping_sets=[columns[:k] for k in range(len(columns), -1, -1)])

    def cube(self, select: Mapping, columns: Sequence) -> Relation:
        picks = [[c for k, c in enumerate(columns) if bits >> k & 1] for bits in range((1 << len(columns)) - 1, -1, -1)]
        return self.aggregate(select, grouping_sets=picks)

    def sort(self, *keys: m.SortKey) -> Relation:
        return self._merge(m.Sort(tuple(keys)))

    def limit(self, limit: int | None = None, offset: int = 0) -> Relation:
        return self._merge(m.Limit(limit, offset))

    def guard(self, *keys) -> Relation:
        return self._merge(m.SingleRowGuard(tuple(node(col(k) if isinstance(k, str) else k) for k in keys)))

    def ship(self, datasource: str, table: str) -> None:
        self.builder.steps.append(m.Ship(datasource, self.name, table))

    def returned(self) -> m.Plan:
        return m.Plan((*self.builder.steps, m.Return(self.name)), dict(self.builder.fragments))


class PlanBuilder:
    def __init__(self):
        self.steps: list[m.Step] = []
        self.fragments: dict[str, m.Fragment] = {}
        self._n = 0

    def _name(self, kind: str) -> str:
        self._n += 1
        return f"{kind}_{self._n}"

    def _merge(self, fragment: m.Fragment, inputs: dict[str, str]) -> Relation:
        name = self._name("r")
        self.fragments[f"f_{name}"] = fragment
        self.steps.append(m.Merge(f"f_{name}", inputs, name))
        return Relation(self, name)

    def _spec(self, table, columns, where, **options) -> m.ScanSpec:
        return m.ScanSpec(table=table, columns=tuple(columns), filter=None if where is None else node(where), **options)

    def scan(self, datasource: str, table: str, columns: Sequence[str], where=None, **options) -> Relation:
        name = self._name("r")
        self.steps.append(m.SourceScan(datasource, self._spec(table, columns, where, **options), name))
        return Relation(self, name)

    def scan_sql(self, datasource: str, sql: str) -> Relation:
        name = self._name("r")
        self.steps.append(m.SourceScan(datasource, m.ScanSpec(raw_sql=sql), name))
        return Relation(self, name)

    def scan_reduced(self, datasource: str, table: str, columns: Sequence[str], column: str, keys: Keys, where=None, extra: Mapping[str, Keys] | None = None, ndv: int | None = None, **options) -> Relation:
        """Only for probes whose unmatched rows cannot reach the result: inner, semi and build-preserving outer joins."""
        name = self._name("r")
        more = tuple(m.ExtraInjection(c, k.name) for c, k in (extra or {}).items())
        self.steps.append(m.InjectedScan(datasource, self._spec(table, columns, where, **options), column, keys.name, name, ndv, more))
        return Relation(self, name)

    def sql(self, sql: str, **inputs: Relation) -> Relation:
        return self._merge(m.RawSql(sql), {k: r.name for k, r in inputs.items()})
