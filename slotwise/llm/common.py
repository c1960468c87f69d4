"""What the operators of this subpackage share: reading tables, the shared folder, text slicing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import weakref
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready, shared_dir

#: The six ASCII white-space bytes that separate words; `bytes.split()` splits at exactly these.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch: what a Python worker and the buffers that feed it hold at once.
ARROW_ROWS, ARROW_BYTES = 2_000, 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """The session with this package on the workers' path and Arrow batches bounded in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return ready(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, through Spark's own reader so that any store works."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(prepared(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage is cut and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() has written and nothing will read again."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def release() -> None:
    """Give memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: Column) -> Column:
    """Words between ASCII white space as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], text_at: int, chars: int = 250_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has about `chars` bytes of text at most (or one row), to bound a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n + 64
        yield batch.slice(start)


_KEPT: dict = {}


def kept(key, make):
    """What make() gives, kept in a worker process until another key is asked for: one operator's cache at a time."""
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            release()
        _KEPT[key] = make()
    return _KEPT[key]


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
ARROW |= {f"array<{k}>": pa.list_(v) for k, v in list(ARROW.items())}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL string of the types in ARROW; works on executors, where there is no session."""
    return pa.schema([(name.strip("`"), ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])
