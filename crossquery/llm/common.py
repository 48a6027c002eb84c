"""Helpers shared by the corpus operators.

Conventions that every operator follows:

* a null text is an empty text;
* repeated ``doc_id`` rows are separate rows unless an operator says otherwise;
* extra columns are ignored, or carried in a struct under names of our own, so their names cannot clash with those an operator adds;
* Python workers see Arrow batches, which are cut again by rows and bytes, so neither many rows nor
  very long texts make a worker's memory grow (a single text is never cut).
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Learners see only the rows for which this remainder is not 0.
HELD_OUT_FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches are small from here on, in rows and bytes: workers and JVM hold whole batches."""
    for batch, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        if not 0 < int(spark.conf.get(batch).rstrip("b")) <= most:
            spark.conf.set(batch, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_struct(frame: DataFrame, columns: list[str]) -> Column:
    """These columns as one struct ``row``, its fields named by number whatever the columns' names."""
    return F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(columns)], F.lit(True).alias("some")).alias("row")


def row_columns(columns: list[str], others: dict[str, Column] | None = None) -> list[Column]:
    """The columns out of ``row``, under their names; ``others`` replaces some of them."""
    return [(others or {}).get(c, F.col(f"row.c{k}")).alias(c) for k, c in enumerate(columns)]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of all documents that no model may learn from (null ids count as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(True))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's checkpoint folder. Without one a local session gets one of its own, a cluster an error: its machines share no temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="crossquery-checkpoint-")
        context.setCheckpointDir(folder)


def cut(frame: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, which a lost executor does not take along; what earlier cuts shuffled goes."""
    ensure_checkpoint_dir(frame.sparkSession)
    out = frame.checkpoint(eager=True)
    sweep(frame.sparkSession)
    return out


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what no longer has a name. It does so when the driver's JVM collects garbage, so in
    a short run on much data they would all stay. A frame that is just being cut is still held by its caller."""
    gc.collect()  # DataFrames in cycles hold their plans in the JVM
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 offsets between them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, none empty, so that what a worker makes of one batch stays small."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


_HELD: dict = {}


def held_by_worker(key, make: Callable):
    """What ``make`` gave for this key in this worker; only the last key's object is kept, whatever stages the worker serves."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release_held() -> None:
    """Lets go what an earlier stage left in this worker."""
    _HELD.clear()


def arrow_map(frame: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a state for each task: ``make()`` runs once in a task and returns what maps its batches."""

    def run(batches):
        one = make()
        for batch in sliced(batches):
            if (out := one(batch)) is not None:
                yield out

    return frame.mapInArrow(run, schema)


def keep_rows(frame: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, for whose texts ``make()``'s function says true; null is the empty text."""

    def run(batches):
        wanted = make()
        for batch in sliced(batches):
            yield batch.filter(pa.array(wanted([x or "" for x in batch.column(0).to_pylist()])))

    others = [c for c in frame.columns if c != "text"]
    rows = frame.select(F.col("text").cast("string").alias("text"), row_struct(frame, others))
    return rows.mapInArrow(run, rows.schema).select(*_in_place(frame.columns, others))


def _in_place(columns: list[str], others: list[str]) -> list[Column]:
    """All columns in their order, ``text`` from beside the row."""
    inner = dict(zip(others, row_columns(others), strict=True))
    return [inner.get(c, F.col("text")) for c in columns]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
