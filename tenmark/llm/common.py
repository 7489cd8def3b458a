"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="tenmark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/tenmark-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    gone = {t.folder for t in tables}
    for spark, path in [x for x in _written if x[1] in gone]:
        _delete(spark, path)
        _written.remove((spark, path))


def mark() -> int:
    """How many folders there are, for ``discard_since``."""
    return len(_written)


def discard_since(position: int, keep: DataFrame) -> None:
    """Deletes what was written after ``mark`` gave ``position``, but for ``keep``."""
    for spark, path in [x for x in _written[position:] if x[1] != keep.folder]:
        _delete(spark, path)
        _written.remove((spark, path))


def clean() -> None:
    """Deletes what ``written`` and ``new_folder`` have made so far."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder stays
            pass
    _written.clear()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: What a table may weigh to be broadcast: rows times the bytes of one in the driver's and an executor's hash table.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows fit into ``BROADCAST_BYTES``."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Within it, jobs send Python at most ``rows`` rows at once, so that workers and JVM hold less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


_resident: dict[str, object] = {}


def resident(key: str, make=None) -> object:
    """The table ``key`` of this Python worker, made if it is not there; any other is let go first.

    Workers serve the tasks of many stages, so only the one in work may hold much. Without ``make``, nothing is held.
    """
    if key not in _resident:
        _resident.clear()
        if make is not None:
            _resident[key] = make()
    return _resident.get(key)


def slices(b: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``size`` rows, so that few rows are Python objects at a time."""
    for lo in range(0, b.num_rows, size):
        yield b.slice(lo, size)


def raw(column: pa.Array) -> list[bytes]:
    """Texts of a column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch(held, schema)
            held = []
    if held:
        yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
