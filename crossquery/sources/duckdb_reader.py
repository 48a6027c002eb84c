"""A Python data source over DuckDB: the query runs at the source, Arrow batches come back."""

from __future__ import annotations

import datetime
import json
import operator
import tempfile

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: Rows of a batch that goes to Spark.
BATCH = 10_000
#: What a connection holds of the file and of joins; the rest is read again, or spilled to the task's temporary folder.
MEMORY = "128MB"
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class DuckDbReader(DataSource):
    """Options: path, query, staged (JSON object: view -> Parquet folder), for whole tables ``table`` and ``rows`` of a task, and
    ``dealt``, a staged view, and ``keys``, the rows of its files that each task sees; the query's results for these must add up to the whole."""

    @classmethod
    def name(cls) -> str:
        return "crossquery_duckdb"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with connect(self.options) as db:
            return from_arrow_schema(db.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0").to_arrow_table().schema)

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def connect(options, dealt: list[str] | None = None):
    """Staged relations are views over their files: nothing is copied. A task has one core, and bounded memory."""
    import duckdb

    db = duckdb.connect(options["path"], read_only=True, config={"threads": 1, "memory_limit": MEMORY, "temp_directory": f"{tempfile.gettempdir()}/crossquery-duckdb", "preserve_insertion_order": False})
    for table, folder in json.loads(options.get("staged", "{}")).items():
        name = table.replace('"', '""')
        files = dealt if dealt is not None and table == options.get("dealt") else [f"{_mounted(folder)}/*.parquet"]
        db.execute(f"CREATE TEMP VIEW \"{name}\" AS SELECT * FROM read_parquet([{', '.join(map(_sql, files))}])")
    return db


def _mounted(folder: str) -> str:
    return folder.removeprefix("file://").removeprefix("file:")


def _sql(value) -> str | None:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return None  # a time zone would have to be agreed on
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else None


class Rows(InputPartition):
    """Row numbers from ``low`` to before ``high``, or all."""

    def __init__(self, low: int | None = None, high: int | None = None):
        self.low, self.high = low, high


class Files(InputPartition):
    """Some of the files of the dealt view."""

    def __init__(self, names: list[str]):
        self.names = names


class Reader(DataSourceReader):
    """Comparisons, IN lists and null tests are applied at the source; Spark applies all filters again."""

    def __init__(self, options: dict):
        self.options, self.conditions = options, []

    def pushFilters(self, filters):
        for f in filters:
            if len(f.attribute) == 1:
                name = '"' + f.attribute[0].replace('"', '""') + '"'
                if isinstance(f, IsNull | IsNotNull):
                    self.conditions.append(f"{name} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL")
                elif isinstance(f, In):
                    values = [_sql(v) for v in f.value]
                    if values and None not in values:
                        self.conditions.append(f"{name} IN ({', '.join(values)})")
                elif type(f) in _COMPARED and (value := _sql(f.value)) is not None:
                    self.conditions.append(f"{name} {_COMPARED[type(f)]} {value}")
            yield f

    def _files(self) -> list[Files]:
        """All files of the dealt view, in order, as many in a task as have ``keys`` rows, or one."""
        most = int(self.options["keys"])
        folder = _mounted(json.loads(self.options["staged"])[self.options["dealt"]])
        with connect(self.options) as db:
            found = db.execute(f"SELECT file_name, num_rows FROM parquet_file_metadata({_sql(folder + '/*.parquet')}) ORDER BY file_name").fetchall()
        out, rows = [], 0
        for name, n in found:
            if not out or rows + n > most:
                out, rows = [*out, Files([])], 0
            out[-1].names.append(name)
            rows += n
        return out

    def partitions(self):
        if self.options.get("dealt"):
            return self._files()
        if not (table := self.options.get("table")):
            return [Rows()]
        import duckdb

        step = int(self.options["rows"])
        try:
            with connect(self.options) as db:
                last = db.execute(f"SELECT max(rowid) FROM {table}").fetchone()[0]
        except duckdb.BinderException:  # a view has no row numbers
            return [Rows()]
        return [Rows(low, low + step) for low in range(0, operator.index(last or 0) + 1, step)]

    def read(self, partition):
        query = self.options["query"]
        dealt = partition.names if isinstance(partition, Files) else None
        if dealt is None and partition.low is not None:
            query += f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
        where = " WHERE " + " AND ".join(self.conditions) if self.conditions else ""
        with connect(self.options, dealt) as db:
            yield from db.execute(f"SELECT * FROM ({query}){where}").to_arrow_reader(BATCH)
