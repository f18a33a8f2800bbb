"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once by a Python worker; an Arrow batch is cut into slices of about this size.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch, unless the session says otherwise.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def slices(batches: Iterator[pa.RecordBatch], text: int = 0, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices whose column ``text`` has about ``size`` bytes (a row is never cut)."""
    for b in batches:
        per_row = max(1, b.column(text).nbytes // max(1, b.num_rows))
        step = max(1, size // per_row)
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def ship_library(spark: SparkSession) -> None:
    """Makes this package importable on executors that don't share the driver's PYTHONPATH.

    The package is zipped once per context and sent with ``addPyFile``; where executors have it installed
    this only shadows it with the same code.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="tidemark-")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "tidemark")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._tidemark_shipped = True


_kept: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by this Python worker until something of another key is asked for: workers are used
    again by other operators, which need the memory."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _give_back() -> None:
    """Memory that the worker has freed goes back to the system, where its libraries can do that."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def arrow_map(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors. Batches of 10,000 rows, Spark's default, are too
    large for long texts: a session that has that setting gets BATCH_ROWS."""
    ship_library(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH, "10000") == "10000":
        df.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def extended(columns: DataFrame, more: str) -> T.StructType:
    """The schema of ``columns``, all nullable, followed by the columns ``more`` (DDL)."""
    own = [T.StructField(f.name, f.dataType, True) for f in columns.schema.fields]
    return T.StructType([*own, *(T.StructType.fromDDL(more).fields if more else [])])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder from spark.checkpoint.dir; where that is unset (local tests), one is set up."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"/tmp/checkpoints/{os.getpid()}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and continues from the files: later jobs neither
    recompute it nor depend on any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none can clash with what an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


_tables: dict[str, Table] = {}


def drop_tables() -> int:
    """Drops every table that this process wrote and that wasn't dropped yet, and returns their number. Frames that an
    operator returned may still read such tables: to be called when their rows have been used."""
    left = list(_tables.values())
    for t in left:
        t.drop()
    return len(left)


class Table:
    """A frame written as Parquet to the shared folder; dropped with ``drop``.

    Unlike a checkpoint its size is known to the planner and its columns can be read apart.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        import uuid

        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(self.path)
        _tables[self.path] = self

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(conf).delete(p, True)
        _tables.pop(self.path, None)

