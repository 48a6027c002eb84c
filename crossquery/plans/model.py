"""The plan document as frozen dataclasses.

A JSON object becomes the class its tag names; each field is read by its annotation, so the classes
are the schema. Unknown tags, missing fields and values of a wrong type raise ``PlanError``; unknown
fields are ignored, so that documents of newer writers can be read.
"""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from dataclasses import dataclass, field

from ..errors import PlanError


class Tagged:
    """Base of a family of nodes that a field of the document tells apart."""

    tag_field: typing.ClassVar[str]
    tag: typing.ClassVar[str] = ""


def _read(kind, value, where: str):
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return None if value is None else _read(next(a for a in args if a is not type(None)), value, where)
    if origin is tuple:
        if not isinstance(value, list | tuple):
            raise PlanError(f"{where}: a list is needed, not {value!r}")
        return tuple(_read(args[0], x, f"{where}[{k}]") for k, x in enumerate(value))
    if origin is dict:
        if not isinstance(value, dict):
            raise PlanError(f"{where}: an object is needed, not {value!r}")
        return {k: _read(args[1], x, f"{where}.{k}") for k, x in value.items()}
    if kind is typing.Any:
        return value
    if dataclasses.is_dataclass(kind) or issubclass(kind, Tagged):
        return value if isinstance(value, kind) else parse(kind, value, where)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise PlanError(f"{where}: {kind.__name__} is needed, not {value!r}")
    return value


def parse(kind: type, data, where: str = "plan"):
    """An object of ``kind``, or of the class of its family that the tag names."""
    if not isinstance(data, dict):
        raise PlanError(f"{where}: an object is needed, not {data!r}")
    if issubclass(kind, Tagged) and not kind.tag:
        tag = data.get(kind.tag_field)
        found = [c for c in kind.__subclasses__() if c.tag == tag]
        if not found:
            raise PlanError(f"{where}: unknown {kind.tag_field} {tag!r}")
        kind = found[0]
    hints, out = typing.get_type_hints(kind), {}
    for f in dataclasses.fields(kind):
        name = f.metadata.get("name", f.name)
        if name in data:
            out[f.name] = _read(hints[f.name], data[name], f"{where}.{name}")
        elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            raise PlanError(f"{where}: {kind.__name__} needs {name!r}")
    return kind(**out)


def to_json(node):
    """The document of a node, as ``parse`` reads it."""
    if isinstance(node, tuple | list):
        return [to_json(x) for x in node]
    if isinstance(node, dict):
        return {k: to_json(x) for k, x in node.items()}
    if not dataclasses.is_dataclass(node):
        return node
    out = {node.tag_field: node.tag} if isinstance(node, Tagged) else {}
    return out | {f.metadata.get("name", f.name): to_json(getattr(node, f.name)) for f in dataclasses.fields(node)}


# ---- expressions


class Expr(Tagged):
    tag_field = "node"


class Value(Tagged):
    tag_field = "lit"


@dataclass(frozen=True)
class Int(Value):
    tag = "int"
    value: int


@dataclass(frozen=True)
class Float(Value):
    tag = "float"
    value: float


@dataclass(frozen=True)
class Str(Value):
    tag = "str"
    value: str


@dataclass(frozen=True)
class Bool(Value):
    tag = "bool"
    value: bool


@dataclass(frozen=True)
class Null(Value):
    tag = "null"


@dataclass(frozen=True)
class Column(Expr):
    tag = "column"
    name: str
    relation: str | None = None


@dataclass(frozen=True)
class Literal(Expr):
    tag = "literal"
    value: Value


@dataclass(frozen=True)
class Binary(Expr):
    tag = "binary"
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    tag = "unary"
    op: str
    operand: Expr


@dataclass(frozen=True)
class Cast(Expr):
    tag = "cast"
    expr: Expr
    to: str


@dataclass(frozen=True)
class WhenThen:
    when: Expr
    then: Expr


@dataclass(frozen=True)
class Case(Expr):
    tag = "case"
    whens: tuple[WhenThen, ...]
    operand: Expr | None = None
    otherwise: Expr | None = field(default=None, metadata={"name": "else"})


@dataclass(frozen=True)
class InList(Expr):
    tag = "in_list"
    expr: Expr
    list: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class IsNull(Expr):
    tag = "is_null"
    expr: Expr
    negated: bool = False


@dataclass(frozen=True)
class Function(Expr):
    tag = "function"
    name: str
    args: tuple[Expr, ...] = ()


# ---- fragments: local relational operators


class Fragment(Tagged):
    tag_field = "kind"


@dataclass(frozen=True)
class Projection:
    expr: Expr
    alias: str


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    ascending: bool
    nulls_first: bool


@dataclass(frozen=True)
class WithinGroup:
    key: Expr
    desc: bool = False


@dataclass(frozen=True)
class AggCall:
    func: str
    distinct: bool = False
    star: bool = False
    args: tuple[Expr, ...] = ()
    within_group: WithinGroup | None = None


@dataclass(frozen=True)
class AggItem:
    alias: str
    expr: Expr | None = None
    agg: AggCall | None = None

    def __post_init__(self):
        if (self.expr is None) == (self.agg is None):
            raise PlanError(f"aggregate item {self.alias!r} needs exactly one of 'expr' and 'agg'")


JOIN_TYPES = ("inner", "left", "right", "full", "semi", "anti")


def _join_type(name: str) -> None:
    if name not in JOIN_TYPES:
        raise PlanError(f"unknown join type {name!r}")


@dataclass(frozen=True)
class HashJoin(Fragment):
    tag = "hash_join"
    join_type: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    project: tuple[Projection, ...]

    def __post_init__(self):
        _join_type(self.join_type)
        if not self.left_keys or len(self.left_keys) != len(self.right_keys):
            raise PlanError("a hash join needs as many left as right keys, and one at least")


@dataclass(frozen=True)
class NestedLoopJoin(Fragment):
    tag = "nested_loop_join"
    join_type: str
    project: tuple[Projection, ...]
    condition: Expr | None = None

    def __post_init__(self):
        _join_type(self.join_type)


@dataclass(frozen=True)
class Project(Fragment):
    tag = "project"
    project: tuple[Projection, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Aggregate(Fragment):
    tag = "aggregate"
    select: tuple[AggItem, ...]
    group_by: tuple[Expr, ...] = ()
    grouping_sets: tuple[tuple[Expr, ...], ...] = ()


@dataclass(frozen=True)
class Sort(Fragment):
    tag = "sort"
    keys: tuple[SortKey, ...]


@dataclass(frozen=True)
class Filter(Fragment):
    tag = "filter"
    predicate: Expr


@dataclass(frozen=True)
class Limit(Fragment):
    tag = "limit"
    limit: int | None = None
    offset: int = 0

    def __post_init__(self):
        if self.offset < 0 or (self.limit or 0) < 0:
            raise PlanError("limit and offset cannot be negative")


@dataclass(frozen=True)
class SingleRowGuard(Fragment):
    tag = "single_row_guard"
    keys: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class RawSql(Fragment):
    tag = "raw_sql"
    sql: str


# ---- steps


@dataclass(frozen=True)
class ScanSpec:
    table: str | None = None
    schema: str | None = None
    alias: str | None = None
    columns: tuple[str, ...] = ()
    filter: Expr | None = None
    limit: int | None = None
    distinct: bool = False
    parallel: bool = False
    raw_sql: str | None = None
    injected_sql: str | None = None


@dataclass(frozen=True)
class ExtraInjection:
    column: str
    keys_from: str


class Step(Tagged):
    tag_field = "op"


@dataclass(frozen=True)
class SourceScan(Step):
    tag = "source_scan"
    datasource: str
    scan: ScanSpec
    binding: str
    materialize: bool = False


@dataclass(frozen=True)
class CollectDistinct(Step):
    tag = "collect_distinct"
    input: str
    key: str
    binding: str
    cap: int


@dataclass(frozen=True)
class InjectedScan(Step):
    tag = "injected_scan"
    datasource: str
    scan: ScanSpec
    inject_column: str
    keys_from: str
    binding: str
    inject_column_ndv: int | None = None
    extra_injections: tuple[ExtraInjection, ...] = ()


@dataclass(frozen=True)
class Ship(Step):
    tag = "ship"
    datasource: str
    input: str
    table: str


@dataclass(frozen=True)
class Merge(Step):
    tag = "merge"
    fragment: str
    inputs: dict[str, str]
    binding: str


@dataclass(frozen=True)
class Return(Step):
    tag = "return"
    input: str


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]
    fragments: dict[str, Fragment] = field(default_factory=dict)
    outputs: tuple[str, ...] = ()

    @staticmethod
    def of(document: Plan | dict | str) -> Plan:
        """A plan from itself, a parsed document or JSON text, validated."""
        if isinstance(document, str):
            try:
                document = json.loads(document)
            except ValueError as e:
                raise PlanError(f"the plan is not JSON: {e}") from None
        plan = document if isinstance(document, Plan) else parse(Plan, document)
        plan.validate()
        return plan

    def validate(self) -> None:
        """Bindings exist before they are used, hold what is asked of them, and something is returned."""
        kinds: dict[str, str] = {}

        def need(name: str, kind: str) -> None:
            if name not in kinds:
                raise PlanError(f"unknown binding {name!r}")
            if kinds[name] != kind:
                raise PlanError(f"binding {name!r} holds {kinds[name]}, not {kind}")

        for step in self.steps:
            match step:
                case SourceScan():
                    kinds[step.binding] = "a relation"
                case CollectDistinct():
                    need(step.input, "a relation")
                    kinds[step.binding] = "keys"
                case InjectedScan():
                    for name in (step.keys_from, *(x.keys_from for x in step.extra_injections)):
                        need(name, "keys")
                    kinds[step.binding] = "a relation"
                case Ship():
                    need(step.input, "a relation")
                case Merge():
                    if step.fragment not in self.fragments:
                        raise PlanError(f"unknown fragment {step.fragment!r}")
                    for name in step.inputs.values():
                        need(name, "a relation")
                    kinds[step.binding] = "a relation"
                case Return():
                    need(step.input, "a relation")
        if not any(isinstance(s, Return) for s in self.steps):
            raise PlanError("the plan has no return step")


def columns_of(node) -> list[str]:
    """Names of all columns in an expression, whatever it is made of."""
    if isinstance(node, Column):
        return [node.name]
    parts = node if isinstance(node, tuple | list) else [getattr(node, f.name) for f in dataclasses.fields(node)] if dataclasses.is_dataclass(node) else []
    return [name for part in parts for name in columns_of(part)]
