"""Vector functions for SQL: register(spark) adds `dot` and `cosine`, `vec_wavg`, and the table function `topk_scan`.

Vectors are arrays of floats or doubles; results are doubles. A pair has no product (null) if either vector is null
or has a null in it, or if their lengths differ; the cosine with a zero vector is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, arrow_udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import ready


def _sums(row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, x, n)


def _paired(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs have a product, and their components: the row of each, and the two numbers."""
    size = lambda v: pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    good = (size(a) == size(b)) & (size(a) >= 0)
    for v in (a, b):
        at = pc.list_parent_indices(v).to_numpy()
        good[at[pc.list_flatten(v).is_null().to_numpy(zero_copy_only=False)]] = False
    kept = pa.array(good)
    x, y = (pc.list_flatten(v.filter(kept)).to_numpy(zero_copy_only=False).astype(float) for v in (a, b))
    return good, np.repeat(np.flatnonzero(good), size(a)[good]), x, y


@arrow_udf(DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    good, row, x, y = _paired(a, b)
    return pa.array(_sums(row, x * y, len(a)), mask=~good)


@arrow_udf(DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    good, row, x, y = _paired(a, b)
    up, size = _sums(row, x * y, len(a)), np.sqrt(_sums(row, x * x, len(a))) * np.sqrt(_sums(row, y * y, len(a)))
    return pa.array(np.divide(up, size, out=np.zeros(len(a)), where=size > 0), mask=~good)


@arrow_udf(ArrayType(DoubleType()))
def vec_wavg(w: pa.Array, v: pa.Array) -> pa.Scalar:
    """The sum of w times v over a group, divided by the sum of w but by 1 at least; so weights of a list that already sum to 1 or less are kept.

    A null vector or weight adds nothing to the sum of vectors; a null weight adds nothing to the sum of weights
    either. A group without vectors has an empty array. All rows of a group are in one task: it is for lists of bounded length. Spark does not
    mix it with its own aggregates in one grouping.
    """
    w = pc.fill_null(w, 0).to_numpy(zero_copy_only=False).astype(float)
    there = v.is_valid().to_numpy(zero_copy_only=False)
    if not there.any():
        return pa.scalar([], pa.list_(pa.float64()))
    m = pc.list_flatten(v.drop_null()).to_numpy(zero_copy_only=False).astype(float).reshape(int(there.sum()), -1)
    return pa.scalar((w[there] @ m / max(w.sum(), 1.0)).tolist(), pa.list_(pa.float64()))


SCANNED = StructType([StructField("query_id", LongType()), StructField("slot_id", LongType()), StructField("score", DoubleType())])


@arrow_udtf(returnType=SCANNED)
class TopkScan:
    """The k best slots of each query within a partition of dealt(): columns block, k, metric, own, is_query, id and vec.

    A partition is a block of queries and a block of slots, both of bounded size; best lists of all blocks of a query
    are ranked by the caller.
    """

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        self.parts.append(rows)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        from slotwise.operators.retrieve import _block_topk, chunked

        if not self.parts:
            return
        every = pa.Table.from_batches(self.parts)
        k, metric, own = (every.column(c)[0].as_py() for c in ("k", "metric", "own"))
        is_query = every.column("is_query")
        queries, slots = every.filter(is_query), every.filter(pc.invert(is_query))
        kinds = pa.schema([("query_id", pa.int64()), ("slot_id", pa.int64()), ("score", pa.float64())])
        for found in chunked(_block_topk(k, metric, own), queries.column("id"), queries.column("vec"), slots.column("id"), slots.column("vec"), kinds):
            yield pa.Table.from_batches([found])


def dealt(queries: DataFrame, slots: DataFrame, k: int, metric: str = "cosine", own: bool = True) -> DataFrame:
    """The table argument of topk_scan: queries(query_id, vec) and slots(slot_id, vec) dealt to pairs of blocks, so that every query meets every slot once."""
    from ..operators.retrieve import in_blocks

    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")
    q, s = in_blocks(queries.select("query_id", "vec"), slots.select("slot_id", "vec"))
    rows = lambda df, name, asked: df.select(F.concat_ws("-", "qb", "sb").alias("block"), F.lit(k).alias("k"), F.lit(metric).alias("metric"), F.lit(own).alias("own"), F.lit(asked).alias("is_query"), F.col(name).cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows(q, "query_id", True).unionByName(rows(s, "slot_id", False))


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to spark.sql under their names."""
    ready(spark)
    for name, f in (("dot", dot), ("cosine", cosine), ("vec_wavg", vec_wavg)):
        spark.udf.register(name, f)
    spark.udtf.register("topk_scan", TopkScan)
    return spark
