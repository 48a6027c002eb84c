"""Named sources of one session.

A source offers ``tables()``, ``table(name, schema)``, ``query(sql, staged)`` and, where it can split a read,
``partitioned(...)``. ``in_process`` sources are read by Spark itself, so Catalyst pushes filters and columns
into the scan and no key list has to travel.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError, SourceError
from ..operators.relational import raw_sql
from .statistics import distinct_values, fraction, page_ranges


class Source:
    kind = ""
    in_process = False
    ships = False

    def __init__(self, spark: SparkSession, **params: str):
        self.spark, self.params = spark, params

    def need(self, name: str) -> str:
        if not self.params.get(name):
            raise SourceError(f"a {self.kind} source needs {name!r}")
        return self.params[name]

    def table(self, name: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The table, or at least these of its columns; Spark prunes what it can by itself."""
        raise NotImplementedError

    def query(self, sql: str, staged: dict[str, DataFrame] | None = None) -> DataFrame:
        raise NotImplementedError

    def partitioned(self, name: str, schema: str | None, columns: list[str], partitions: int) -> DataFrame:
        raise PlanError(f"a {self.kind} source has no parallel read")

    def matching(self, name: str, schema: str | None, column: str, keys: DataFrame, view: str, columns: list[str] | None = None) -> DataFrame | None:
        """The table's rows (or at least these of its columns) whose column is among the staged keys (column ``k``), or None where keys cannot be staged."""
        return None

    def fraction(self, name: str, schema: str | None, column: str, n_keys: int) -> float | None:
        """Share of the table that so many keys keep, by the source's catalogue; None if it does not say."""
        return None

    def close(self) -> None:
        """Drops what was staged."""

    def declared(self, frame: DataFrame) -> DataFrame:
        """Columns with a type in the parameter ``types`` (JSON: column -> Spark type) in that type. Databases
        report decimals without a declared precision as the widest; two sources' columns then compare and add up alike."""
        types = {k.lower(): v for k, v in json.loads(self.params.get("types", "{}")).items()}
        if not types:
            return frame
        column = lambda c: F.col("`" + c.replace("`", "``") + "`")
        return frame.select(*[column(c).cast(types[c.lower()]).alias(c) if c.lower() in types else column(c) for c in frame.columns])


class ParquetSource(Source):
    """Every ``<dir>/<table>.parquet``, a file or a folder, is a table of schema ``main``."""

    kind, in_process, ships = "parquet", True, True

    def __init__(self, spark: SparkSession, **params: str):
        super().__init__(spark, **params)
        self.dir = self.need("dir").rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def tables(self) -> list[str]:
        """Names of all tables, listed through Spark's own file system."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.dir)
        entries = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(n.removesuffix(".parquet") for n in (e.getPath().getName() for e in entries) if n.endswith(".parquet"))

    def table(self, name: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
        if schema not in (None, "main"):
            raise PlanError(f"a parquet source has only the schema 'main', not {schema!r}")
        if name not in self._frames:
            self._frames[name] = self.declared(self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet")))
        return self._frames[name]

    def query(self, sql: str, staged: dict[str, DataFrame] | None = None) -> DataFrame:
        known = [t for t in self.tables() if re.search(rf"\b{re.escape(t)}\b", sql)]
        for t in known:
            sql = re.sub(rf'(\bmain|"main")\.(?="?{re.escape(t)}\b)', "", sql)
        return raw_sql(sql, {t: self.table(t) for t in known} | (staged or {}), self.spark)


class DuckDbSource(Source):
    """A DuckDB file, read through a Python data source that yields Arrow batches."""

    kind, ships = "duckdb", True

    def __init__(self, spark: SparkSession, **params: str):
        super().__init__(spark, **params)
        from .duckdb_reader import DuckDbReader

        self.path = self.need("path")
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes equality and IN filters
        spark.dataSource.register(DuckDbReader)

    def _read(self, **options: str) -> DataFrame:
        return self.declared(self.spark.read.format("crossquery_duckdb").options(path=self.path, **options).load())

    def table(self, name: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Read in ranges of row numbers, ``rows_per_task`` (a parameter) at a time."""
        place = JdbcSource.quoted(schema, name)
        return self._read(query=f"SELECT {self._wanted(place, columns)} FROM {place}", table=place, rows=str(self.params.get("rows_per_task", 2_000_000)))

    def _wanted(self, place: str, columns: list[str] | None) -> str:
        if columns is None:
            return "*"
        from .duckdb_reader import connect

        with connect({"path": self.path}) as db:
            known = {c[0].lower(): c[0] for c in db.execute(f"SELECT * FROM {place} LIMIT 0").description}
        found = [known[c.lower()] for c in columns if c.lower() in known]
        return ", ".join(JdbcSource.quoted(c) for c in dict.fromkeys(found)) or "*"

    def staging(self) -> str | None:
        """A folder that the driver and the executors share."""
        return self.params.get("staging") or self.spark.sparkContext.getCheckpointDir() or self.spark.conf.get("spark.checkpoint.dir", None)

    def matching(self, name: str, schema: str | None, column: str, keys: DataFrame, view: str, columns: list[str] | None = None) -> DataFrame | None:
        """Keys are staged in order and dealt to tasks, ``keys_per_task`` (a parameter) to each, which looks up its own; where the table lies in the column's
        order a task reads little else."""
        if not self.staging():
            return None
        most = str(self.params.get("keys_per_task", 250_000))
        place = JdbcSource.quoted(schema, name)
        sql = f"SELECT {self._wanted(place, columns)} FROM {place} WHERE {JdbcSource.quoted(column)} IN (SELECT k FROM {JdbcSource.quoted(view)})"
        return self._staged(sql, {view: keys.sort("k")}, dealt=view, keys=most)

    def fraction(self, name: str, schema: str | None, column: str, n_keys: int) -> float | None:
        where = f"table_name = '{name.replace(chr(39), chr(39) * 2)}' AND schema_name = '{(schema or 'main').replace(chr(39), chr(39) * 2)}'"
        row = self.query(f"SELECT estimated_size::DOUBLE FROM duckdb_tables() WHERE {where}").first()
        return fraction(n_keys, row[0]) if row else None

    def query(self, sql: str, staged: dict[str, DataFrame] | None = None) -> DataFrame:
        """``staged`` relations are written for the reader's connections, as temporary tables there."""
        return self._staged(sql, staged)

    def _staged(self, sql: str, staged: dict[str, DataFrame] | None, **options: str) -> DataFrame:
        from pyspark.errors import PySparkException

        places = {}
        for name, frame in (staged or {}).items():
            if not (folder := self.staging()):
                raise SourceError("shipping to a duckdb source needs 'staging' or a checkpoint folder that executors share")
            if ":" in folder and not folder.startswith("file:"):
                raise SourceError(f"a duckdb source reads staged relations from a mounted folder, not from {folder!r}")
            places[name] = f"{folder}/staged-{uuid.uuid4().hex}"
            try:
                frame.write.option("maxRecordsPerFile", options.get("keys", "0")).parquet(places[name])
            except PySparkException as e:
                raise PlanError(f"relation {name!r} cannot be shipped: {e}") from e
        return self._read(query=sql, staged=json.dumps(places), **options)


class JdbcSource(Source):
    """Any database with a JDBC driver: ``url`` and, where needed, ``driver``, ``user``, ``password``, ``schema_types``.

    Keys and relations are staged as tables of their own there (Spark's connections share no temporary tables), which ``close`` drops.
    """

    kind, ships = "jdbc", True

    def __init__(self, spark: SparkSession, **params: str):
        super().__init__(spark, **params)
        self.url = self.need("url")

    @property
    def _staged(self) -> list[str]:
        return self.__dict__.setdefault("_staged_tables", [])

    def _options(self) -> dict[str, str]:
        named = {"driver": "driver", "user": "user", "password": "password", "schema_types": "customSchema", "fetch_size": "fetchsize"}
        return {"url": self.url} | {option: self.params[p] for p, option in named.items() if p in self.params}

    @staticmethod
    def quoted(*parts: str | None) -> str:
        return ".".join('"' + p.replace('"', '""') + '"' for p in parts if p)

    def _load(self, **options: str) -> DataFrame:
        return self.declared(self.spark.read.format("jdbc").options(**self._options(), **options).load())

    def table(self, name: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
        return self._load(dbtable=self.quoted(schema, name))

    def stage(self, frame: DataFrame) -> str:
        """Writes a relation to a new table and gives its quoted name. Text is VARCHAR, so that it can be compared and indexed."""
        name = f"CROSSQUERY_{uuid.uuid4().hex.upper()}"
        texts = ", ".join(f"{self.quoted(f.name)} VARCHAR(4000)" for f in frame.schema.fields if f.dataType.simpleString() == "string")
        options = {k: v for k, v in self._options().items() if k != "customSchema"} | ({"createTableColumnTypes": texts.replace('"', "`")} if texts else {})
        self._staged.append(name)
        frame.write.format("jdbc").options(**options, dbtable=self.quoted(name)).save()
        return self.quoted(name)

    def close(self) -> None:
        if not self._staged:
            return
        jvm = self.spark._jvm
        known = jvm.java.util.Properties()
        for name in ("user", "password"):
            if name in self.params:
                known.setProperty(name, self.params[name])
        db = jvm.java.sql.DriverManager.getConnection(self.url, known)
        try:
            while self._staged:
                db.createStatement().execute(f"DROP TABLE {self.quoted(self._staged.pop())}")
        finally:
            db.close()

    def matching(self, name: str, schema: str | None, column: str, keys: DataFrame, view: str, columns: list[str] | None = None) -> DataFrame:
        """The database joins: ``partitions`` (a parameter, 1) reads of it where there is a ``split_column``."""
        staged = self.stage(keys)
        rows = f"SELECT * FROM {self.quoted(schema, name)} WHERE {self.quoted(self.named(name, schema, column))} IN (SELECT {self.quoted('k')} FROM {staged})"
        parts = int(self.params.get("partitions", "1"))
        if parts > 1 and "split_column" in self.params:
            properties = {k: v for k, v in self._options().items() if k != "url"}
            return self.declared(self.spark.read.jdbc(self.url, f"({rows}) crossquery_rows", predicates=JdbcSource.predicates(self, name, schema, parts), properties=properties))
        return self.query(rows)

    def named(self, name: str, schema: str | None, column: str) -> str:
        """The column as the database writes it: plans name columns in any case."""
        return next((c for c in self.table(name, schema).columns if c.lower() == column.lower()), column)

    def query(self, sql: str, staged: dict[str, DataFrame] | None = None) -> DataFrame:
        """``staged`` relations are written to the database; the query finds them under their names."""
        for name, frame in (staged or {}).items():
            sql = re.sub(rf'"{re.escape(name)}"|\b{re.escape(name)}\b', self.stage(frame), sql)
        return self._load(query=sql)

    def predicates(self, name: str, schema: str | None, partitions: int) -> list[str]:
        """Conditions that split the table: by remainder of the parameter ``split_column``."""
        column = self.quoted(self.need("split_column"))
        rest = [f"MOD({column}, {partitions}) = {k}" if k else f"(MOD({column}, {partitions}) = 0 OR {column} IS NULL)" for k in range(partitions)]
        return [r if k == 0 else f"({r} OR MOD({column}, {partitions}) = {k - partitions})" for k, r in enumerate(rest)]

    def partitioned(self, name: str, schema: str | None, columns: list[str], partitions: int) -> DataFrame:
        properties = {k: v for k, v in self._options().items() if k != "url"}
        out = self.declared(self.spark.read.jdbc(self.url, self.quoted(schema, name), predicates=self.predicates(name, schema, partitions), properties=properties))
        return out.select(*columns) if columns else out


class DerbySource(JdbcSource):
    """An embedded Derby database of this session, in ``folder`` (mounted, and shared by driver and executors).

    Only one JVM at a time can open such a database, but any number can read one that lies in an archive. So the driver's JVM is the database's
    one process: what executors wrote as text files is imported there by the database itself, in bounded memory, and what is read
    is an archived copy, made once for all that came before. The archive is not compressed, so a reader seeks in it.
    """

    TYPES = {"tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "string": "VARCHAR(4000)"}

    def __init__(self, spark: SparkSession, **params: str):
        Source.__init__(self, spark, **params)
        self.folder = f"{self.need('folder')}/derby-{uuid.uuid4().hex}"
        if ")" in self.folder:
            raise SourceError(f"a derby source's folder cannot have a ')' in its name: {self.folder!r}")
        self.params.setdefault("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
        self._archive: str | None = None

    @property
    def url(self) -> str:
        """That of a copy with all that was written."""
        if self._archive is None:
            if not os.path.isdir(f"{self.folder}/db"):
                self._write()  # nothing yet: an empty database
            self._archive = f"{self.folder}/{uuid.uuid4().hex}.jar"
            with zipfile.ZipFile(self._archive, "w", zipfile.ZIP_STORED) as archive:
                for place, _, names in sorted(os.walk(f"{self.folder}/db")):
                    for name in sorted(names):
                        if not name.endswith(".lck"):
                            archive.write(f"{place}/{name}", os.path.relpath(f"{place}/{name}", self.folder))
        return f"jdbc:derby:jar:({self._archive})db"

    def _write(self, *statements: str) -> None:
        """Runs them in the database, and closes it, so that its files are whole."""
        from py4j.protocol import Py4JJavaError

        manager, url = self.spark._jvm.java.sql.DriverManager, f"jdbc:derby:{self.folder}/db"
        self._archive = None
        db = manager.getConnection(f"{url};create=true")
        try:
            for sql in statements:
                db.createStatement().execute(sql)
        finally:
            db.close()
            try:
                manager.getConnection(f"{url};shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # the state that says it was shut down
                    raise

    def fill(self, name: str, frame: DataFrame) -> None:
        """A new table of this name with the frame's rows."""
        fields = {f.name: self.TYPES.get(kind := f.dataType.simpleString(), kind if kind.startswith("decimal") else None) for f in frame.schema.fields}
        if None in fields.values():
            raise PlanError(f"a derby source takes no columns like {[c for c, t in fields.items() if t is None]}")
        place = f"{self.folder}/rows-{uuid.uuid4().hex}"
        text = {f.name: F.col("`" + f.name.replace("`", "``") + "`").cast("string") for f in frame.schema.fields}
        # text in quotes, whose spaces and empty values count; nothing at all is null
        lines = [F.coalesce(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')) if fields[c].startswith("VARCHAR") else x, F.lit("")) for c, x in text.items()]
        frame.select(F.concat_ws(",", *lines).alias("line")).write.text(f"file://{place}")
        files = [f"{place}/{x}".replace("'", "''") for x in sorted(os.listdir(place)) if x.endswith(".txt") and os.path.getsize(f"{place}/{x}")]
        columns = ", ".join(f"{self.quoted(c)} {t}" for c, t in fields.items())
        table = name.replace("'", "''")
        self._write(f"CREATE TABLE {self.quoted(name)} ({columns})", *[f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{x}', ',', '\"', 'UTF-8', 0)" for x in files])
        shutil.rmtree(place)

    def stage(self, frame: DataFrame) -> str:
        name = f"CROSSQUERY_{uuid.uuid4().hex.upper()}"
        self.fill(name, frame)
        return self.quoted(name)

    def close(self) -> None:
        """The database was this session's own and goes."""
        shutil.rmtree(self.folder, ignore_errors=True)
        self._archive = None


class PostgresSource(JdbcSource):
    """PostgreSQL by URI; large reads are split by ranges of physical pages."""

    kind = "postgres"

    def __init__(self, spark: SparkSession, **params: str):
        Source.__init__(self, spark, **params)
        parts = urlsplit(self.need("uri"))
        if not parts.hostname or parts.scheme not in ("postgres", "postgresql"):
            raise SourceError(f"not a PostgreSQL URI: {self.params['uri']!r}")
        self.url = f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path or '/'}"
        self.params.setdefault("driver", "org.postgresql.Driver")
        for name, value in (("user", parts.username), ("password", parts.password)):
            if value:
                self.params.setdefault(name, unquote(value))

    def _regclass(self, name: str, schema: str | None) -> str:
        return self.quoted(schema, name).replace("'", "''")

    def _first(self, sql: str):
        return self.query(sql).first()

    def pages(self, name: str, schema: str | None = None) -> int:
        row = self._first(f"SELECT relpages FROM pg_class WHERE oid = '{self._regclass(name, schema)}'::regclass")
        return int(row[0]) if row and row[0] else 0

    def leads_index(self, name: str, schema: str | None, column: str) -> bool:
        """Whether an index has this column first, so that single keys can be looked up."""
        text = column.replace("'", "''")
        row = self._first(
            "SELECT count(*) FROM pg_index i JOIN pg_attribute a ON a.attrelid = i.indrelid AND a.attnum = i.indkey[0] "
            f"WHERE i.indrelid = '{self._regclass(name, schema)}'::regclass AND a.attname = '{text}'"
        )
        return bool(row and row[0])

    def fraction(self, name: str, schema: str | None, column: str, n_keys: int) -> float | None:
        text = column.replace("'", "''")
        of = f"'{self._regclass(name, schema)}'::regclass"
        row = self._first(
            f"SELECT c.reltuples::float8, s.n_distinct::float8 FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace "
            f"LEFT JOIN pg_stats s ON s.schemaname = n.nspname AND s.tablename = c.relname AND s.attname = '{text}' WHERE c.oid = {of}"
        )
        return fraction(n_keys, distinct_values(row[0], row[1])) if row else None

    def predicates(self, name: str, schema: str | None, partitions: int) -> list[str]:
        return [f"ctid >= '({low},0)'::tid AND ctid < '({high},0)'::tid" for low, high in page_ranges(self.pages(name, schema), partitions)]


KINDS: dict[str, Callable[..., Source]] = {
    "parquet": ParquetSource,
    "duckdb": DuckDbSource,
    "postgres": PostgresSource,
    "postgresql": PostgresSource,
    "jdbc": JdbcSource,
    "derby": DerbySource,
}


class SourceRegistry:
    """Sources by name; registering a name again replaces it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sources: dict[str, Source] = {}

    def register(self, name: str, kind: str, **params: str) -> Source:
        if kind not in KINDS:
            raise SourceError(f"unknown source kind {kind!r}")
        if name in self._sources:
            self._sources[name].close()
        self._sources[name] = KINDS[kind](self.spark, **params)
        return self._sources[name]

    def __getitem__(self, name: str) -> Source:
        if name not in self._sources:
            raise SourceError(f"source {name!r} is not registered")
        return self._sources[name]

    def query(self, name: str, sql: str) -> DataFrame:
        return self[name].query(sql)

    def close(self) -> None:
        for source in self._sources.values():
            source.close()

    def read_partitioned(self, name: str, table: str, columns: list[str] | None = None, partitions: int = 8, schema: str | None = None) -> DataFrame:
        if partitions < 1:
            raise PlanError("a parallel read needs a partition")
        return self[name].partitioned(table, schema, columns or [], partitions)


def keys_of(frame: DataFrame, key: str) -> DataFrame:
    """Distinct values of a column, without null."""
    from ..operators.expressions import quoted

    column = F.col(quoted(key))
    return frame.select(column.alias("k")).where(F.col("k").isNotNull()).distinct()
