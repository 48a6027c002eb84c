"""The engine: sources by name, and plans compiled to one DataFrame."""

from __future__ import annotations

import logging
import os
import time
from collections import Counter
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import PlanError
from .operators import relational
from .operators.expressions import Compiler, quoted
from .plans import model as m
from .sources.reduction import IN_LIST_KEYS, Strategy, choose
from .sources.registry import PostgresSource, Source, SourceRegistry, keys_of
from .sources.statistics import fraction

log = logging.getLogger(__name__)
#: The name under which pre-rendered SQL finds the keys of an injected scan.
KEYS_VIEW = "dynamic_keys"


@dataclass(frozen=True)
class ProfiledStep:
    """A step that was planned: its tag, its binding, the seconds this took, and an observation of its rows, if it has any."""

    tag: str
    binding: str
    seconds: float
    observed: Observation | None = None

    @property
    def rows(self) -> int | None:
        """Rows that the step gave; waits for an action on the plan's result."""
        return None if self.observed is None else self.observed.get["rows"]


class Session:
    """Registers sources and runs plans on a Spark session.

    ``run`` returns a lazy DataFrame. Only guards, the keys of a reduced probe (``IN_LIST_KEYS`` at most) and
    relations staged at a remote source are executed on the way. Bindings that several steps read are persisted
    (``MEMORY_AND_DISK``), until ``close`` or the end of a ``with`` block, which also drops staged relations.
    With ``profile`` (by default if the environment's CROSSQUERY_PROFILE is set) ``profiled`` lists the steps.
    """

    def __init__(self, spark: SparkSession, profile: bool | None = None, persist_shared: bool = True):
        self.spark, self.persist_shared = spark, persist_shared
        self.profile = bool(os.environ.get("CROSSQUERY_PROFILE")) if profile is None else profile
        self.profiled: list[ProfiledStep] = []
        self.sources = SourceRegistry(spark)
        self._held: list[DataFrame] = []

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Lets persisted bindings go, whose DataFrames stay valid and are computed anew when used again; drops what was staged."""
        while self._held:
            self._held.pop().unpersist()
        self.sources.close()

    def register(self, name: str, kind: str, **params: str) -> Source:
        return self.sources.register(name, kind, **params)

    def query(self, name: str, sql: str) -> DataFrame:
        return self.sources.query(name, sql)

    def table(self, name: str, table: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
        """A source's table as a DataFrame, for what the plan language has no node for: windows and set operations are Spark's own."""
        out = self.sources[name].table(table, schema, columns)
        return out if columns is None else out.select(*[F.col(quoted(c)) for c in columns])

    def read_partitioned(self, name: str, table: str, columns: list[str] | None = None, partitions: int = 8, schema: str | None = None) -> DataFrame:
        return self.sources.read_partitioned(name, table, columns, partitions, schema)

    def run(self, plan: m.Plan | dict | str, strategy: Strategy | None = None) -> DataFrame:
        """The plan's result; ``strategy`` overrides how probes on remote sources are reduced (results are the same)."""
        return _Run(self, m.Plan.of(plan), strategy).result()


class _Run:
    def __init__(self, session: Session, plan: m.Plan, forced: Strategy | None):
        self.session, self.plan, self.forced = session, plan, forced
        self.relations: dict[str, DataFrame] = {}
        self.keys: dict[str, DataFrame] = {}
        self.shipped: dict[str, dict[str, DataFrame]] = {}
        self.observed: dict[str, Observation] = {}
        self.uses = Counter(n for s in plan.steps for n in _inputs(s))

    def result(self) -> DataFrame:
        held = len(self.session._held)
        try:
            for step in self.plan.steps:
                began = time.monotonic()
                out = self._step(step)
                if self.session.profile:
                    binding = getattr(step, "binding", "")
                    done = ProfiledStep(step.tag, binding, time.monotonic() - began, self.observed.get(binding))
                    self.session.profiled.append(done)
                    log.info("%s %s: %.3f s to plan", done.tag, binding, done.seconds)
                if isinstance(step, m.Return):
                    return out
        except BaseException:
            while len(self.session._held) > held:  # nothing of a failed run stays
                self.session._held.pop().unpersist()
            raise
        raise PlanError("the plan has no return step")

    def _bind(self, name: str, frame: DataFrame) -> DataFrame:
        if self.session.profile:  # counted where the rows pass, never by a job of its own
            self.observed[name] = Observation(f"{name}-{len(self.session.profiled)}")
            frame = frame.observe(self.observed[name], F.count(F.lit(1)).alias("rows"))
        if self.uses[name] > 1 and self.session.persist_shared:
            frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
            self.session._held.append(frame)
        self.relations[name] = frame
        return frame

    def _step(self, step: m.Step) -> DataFrame | None:
        match step:
            case m.SourceScan():
                return self._bind(step.binding, self._scan(step.datasource, step.scan))
            case m.CollectDistinct():
                self.keys[step.binding] = keys_of(self.relations[step.input], step.key)
            case m.InjectedScan():
                return self._bind(step.binding, self._injected(step))
            case m.Ship():
                if not self.session.sources[step.datasource].ships:
                    raise PlanError(f"source {step.datasource!r} does not take shipped relations")
                self.shipped.setdefault(step.datasource, {})[step.table] = self.relations[step.input]
            case m.Merge():
                inputs = {k: self.relations[v] for k, v in step.inputs.items()}
                return self._bind(step.binding, relational.apply(self.plan.fragments[step.fragment], inputs))
            case m.Return():
                return self.relations[step.input]
        return None

    @staticmethod
    def _needed(scan: m.ScanSpec, injected: list[str]) -> list[str] | None:
        """The columns that a scan reads, where all are known by name."""
        used = [*scan.columns, *injected, *([] if scan.filter is None else m.columns_of(scan.filter))]
        return [*dict.fromkeys(c for c in used if c)]

    def _base(self, source: Source, name: str, scan: m.ScanSpec, injected: list[str]) -> DataFrame:
        """The scanned relation before filter, distinct and limit."""
        staged = self.shipped.get(name, {})
        if scan.raw_sql is not None:
            return source.query(scan.raw_sql, staged)
        if not scan.table:
            raise PlanError("a scan needs a table or raw SQL")
        if not scan.columns:
            raise PlanError(f"a scan of {scan.table!r} needs columns")
        if scan.table in staged:
            return staged[scan.table]
        needed = self._needed(scan, injected)
        if scan.parallel:
            if scan.distinct or scan.limit is not None or source.in_process or source.kind == "duckdb":
                raise PlanError("a parallel read needs a database source and takes neither DISTINCT nor LIMIT")
            return source.partitioned(scan.table, scan.schema, [], 8)
        return source.table(scan.table, scan.schema, needed)

    def _scan(self, datasource: str, scan: m.ScanSpec, reduce=lambda frame: frame, base: DataFrame | None = None, injected: list[str] = []) -> DataFrame:  # noqa: B006 - never changed
        """Filter (and ``reduce``), then distinct, then limit; reduction never sees less than the filter leaves."""
        frame = self._base(self.session.sources[datasource], datasource, scan, injected) if base is None else base
        if scan.raw_sql is not None:
            return reduce(frame)
        frame = frame.alias(scan.alias or scan.table)
        if scan.filter is not None:
            frame = frame.where(Compiler(frame).column(scan.filter))
        frame = reduce(frame)
        frame = frame.select(*[F.col(quoted(c)) for c in scan.columns])
        frame = frame.distinct() if scan.distinct else frame
        return frame if scan.limit is None else frame.limit(scan.limit)

    def _injected(self, step: m.InjectedScan) -> DataFrame:
        source, keys, scan = self.session.sources[step.datasource], self.keys[step.keys_from], step.scan
        if scan.injected_sql is not None and source.ships:
            return source.query(scan.injected_sql, self.shipped.get(step.datasource, {}) | {KEYS_VIEW: keys})
        column = step.inject_column.rpartition(".")[2]
        base, fewer, exact = self._reduced(step, source, keys, column)
        extras = [(e.column.rpartition(".")[2], self.keys[e.keys_from]) for e in step.extra_injections]

        def reduce(frame: DataFrame) -> DataFrame:
            frame = fewer(frame)
            if not exact:
                frame = _semi(frame, column, keys)
            for name, more in extras:
                few = _few(more)
                # an empty extra set is skipped, not applied
                frame = (_listed(frame, name, few) if few else frame) if len(few) < IN_LIST_KEYS else _semi(frame, name, more)
            return frame

        return self._scan(step.datasource, scan, reduce, base, [column, *(name for name, _ in extras)])

    def _reduced(self, step: m.InjectedScan, source: Source, keys: DataFrame, column: str):
        """What lets the source send less: another base relation, or a filter on it; and whether nothing else has to be done
        for the rows to be right: a list holds all keys, and a join of all that read the probe on the same keys drops the rest."""
        same = lambda frame: frame
        scan, structured = step.scan, step.scan.raw_sql is None
        joined = self._joined_anyway(step, column)
        few = _few(keys)  # bounded; beyond it the number is only needed of remote sources
        n = len(few) if len(few) < IN_LIST_KEYS else IN_LIST_KEYS if source.in_process else keys.count()
        strategy = self.forced if not source.in_process else None
        if strategy is None:
            many = structured and n >= IN_LIST_KEYS and not source.in_process
            known = fraction(n, step.inject_column_ndv) if step.inject_column_ndv else source.fraction(scan.table, scan.schema, column, n) if many else None
            indexed = not (many and isinstance(source, PostgresSource)) or source.leads_index(scan.table, scan.schema, column)
            strategy = choose(source.kind, n, structured=structured, prerendered=scan.injected_sql is not None, in_process=source.in_process, indexed=indexed, fraction=known)
        if self.session.profile:
            log.info("reduction of %s by %d keys: %s", step.binding, n, strategy.value)
        if strategy is Strategy.NOTHING and not n:
            return None, lambda frame: _listed(frame, column, []), True
        if strategy is Strategy.IN_LIST and n < IN_LIST_KEYS:
            return None, lambda frame: _listed(frame, column, few), True
        if strategy is Strategy.STAGED_KEYS and structured and scan.table not in self.shipped.get(step.datasource, {}):
            staged = source.matching(scan.table, scan.schema, column, keys, KEYS_VIEW, self._needed(scan, [column, *(e.column.rpartition(".")[2] for e in step.extra_injections)]))
            if staged is None:
                log.warning("source %r cannot stage keys: %s is read whole", step.datasource, scan.table)
            return staged, same, joined
        if strategy is Strategy.FULL_PARALLEL_READ and structured and isinstance(source, PostgresSource) and not scan.distinct and scan.limit is None:
            return source.partitioned(scan.table, scan.schema, [], 8), same, joined
        return None, same, joined

    def _joined_anyway(self, step: m.InjectedScan, column: str) -> bool:
        """Whether all that reads the probe is an inner join, on the injected column, with the relation that the keys come from."""
        if step.scan.limit is not None or column not in step.scan.columns:
            return False
        keys = next(s for s in self.plan.steps if isinstance(s, m.CollectDistinct) and s.binding == step.keys_from)
        readers = [s for s in self.plan.steps if step.binding in _inputs(s)]

        def joins(s: m.Step) -> bool:
            fragment = self.plan.fragments[s.fragment] if isinstance(s, m.Merge) else None
            if not isinstance(fragment, m.HashJoin) or fragment.join_type != "inner":
                return False
            pairs = [*zip(fragment.left_keys, fragment.right_keys, strict=True)]
            sides = s.inputs.get(relational.LEFT), s.inputs.get(relational.RIGHT)
            return (sides == (keys.input, step.binding) and (keys.key, column) in pairs) or (sides == (step.binding, keys.input) and (column, keys.key) in pairs)

        return bool(readers) and all(map(joins, readers))


def _few(keys: DataFrame) -> list:
    """The keys, or ``IN_LIST_KEYS`` of them if there are more."""
    return [r[0] for r in keys.limit(IN_LIST_KEYS).collect()]


def _checked(frame: DataFrame, column: str) -> None:
    if column not in frame.columns:
        raise PlanError(f"cannot inject keys into {column!r}: the scan has {frame.columns}")


def _listed(frame: DataFrame, column: str, keys: list) -> DataFrame:
    _checked(frame, column)
    return frame.where(F.col(quoted(column)).isin(keys) if keys else F.lit(False))


def _semi(frame: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    _checked(frame, column)
    return frame.join(keys.withColumnRenamed("k", "__key"), F.col(quoted(column)) == F.col("__key"), "left_semi")


def _inputs(step: m.Step) -> list[str]:
    match step:
        case m.CollectDistinct() | m.Ship() | m.Return():
            return [step.input]
        case m.Merge():
            return [*step.inputs.values()]
    return []
