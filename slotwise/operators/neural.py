"""Forward passes of small layers over vectors and ranked slots: the memory head, the slot selector and the pair scorer.

A model is a relation parameters(name, row, vec): each matrix by name, one row of it a row. It is read whole and sent
to every worker, so its size is checked first. Rows of data stay where they are: a pass is a few matrix products a
batch, and batches are worked off in parts whose arrays have a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ready
from .retrieve import GROUP, RANK_PLACES, best, by_blocks, foremost

#: Numbers of a model at most: some 130 MB.
MOST_PARAMETERS = 1 << 24
#: Numbers of the largest array of a part.
CELLS = 1 << 20
MODES = ("gated_sum", "forced_gate_1", "forced_gate_scalar", "concat_projection", "cross_attention")

Model = dict[str, np.ndarray]


def read_model(parameters: DataFrame) -> Model:
    """The matrices of parameters(name, row, vec), rows in order."""
    numbers = parameters.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    if numbers > MOST_PARAMETERS:
        raise ValueError(f"{numbers} parameters; {MOST_PARAMETERS} at most are sent to workers")
    found: dict[str, list] = {}
    for r in sorted(parameters.select("name", "row", "vec").collect(), key=lambda r: (r.name, r.row)):
        found.setdefault(r.name, []).append(r.vec)
    return {name: np.array(rows, float) for name, rows in found.items()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


def _matrix(column: pa.Array) -> np.ndarray:
    """An array of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _passed(df: DataFrame, schema: str, cells: int, f: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """f of the rows of df, so many at once that `cells` numbers a row make `CELLS`; f gives the columns of the schema."""
    names = [x.split()[0] for x in schema.split(",")]
    step = max(1, CELLS // cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, step):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in f(b.slice(k, step))], names=names)

    ready(df.sparkSession)
    return df.mapInArrow(run, schema)


# --- memory head -------------------------------------------------------------------------------------------------------
def memories(weighed: DataFrame, values: DataFrame) -> DataFrame:
    """query_id and slots, an array of (rank, w, value) by rank; a slot that values(slot_id, value) lacks is dead and has no value.

    A query's candidates are a ranked list of fixed length, so an array holds few of them.
    """
    rows = weighed.join(values.select("slot_id", "value"), "slot_id", "left").select("query_id", F.struct("rank", "w", "value").alias("s"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("slots"))


def _listed(slots: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, values and which are there, of arrays of (rank, w, value): rows by the longest list, dead slots with the zero vector."""
    ends = slots.offsets.to_numpy()
    _, weights, value = slots.flatten().flatten()
    sizes = np.diff(ends)
    most = max(1, int(sizes.max())) if sizes.size else 1
    there = np.arange(most) < sizes[:, None]
    w, v = np.zeros(there.shape), np.zeros((*there.shape, dims))
    w[there] = weights.to_numpy(zero_copy_only=False)
    live = there.copy()
    live[there] = value.is_valid().to_numpy(zero_copy_only=False)
    if live.any():
        v[live] = _matrix(value.drop_null())
    return w, v, there


class MemoryHead:
    """How a query's state x takes in the values of its slots.

    gated_sum: x + g * m, where m is the projected mean of the values by their weights and g a gate of x and m;
    forced_gate_1 and forced_gate_scalar: g is 1, or `alpha`; concat_projection: a projection of x and m together;
    cross_attention: m is what x attends to among all listed slots, whose projected values are keys and values, and
    is gated. Dead slots have the zero vector and are attended to; a query without slots has m = 0.
    """

    def __init__(self, model: Model, mode: str, alpha: float = 0.5):
        if mode not in MODES:
            raise ValueError(f"unknown memory mode {mode}")
        self.model, self.mode, self.alpha = model, mode, alpha

    def read(self, x: np.ndarray, w: np.ndarray, v: np.ndarray, there: np.ndarray) -> np.ndarray:
        if self.mode != "cross_attention":
            return np.einsum("bk,bkv->bv", w, v) @ self.model["memory"].T
        z = np.einsum("bd,bkd->bk", x @ self.model["query"].T, v @ self.model["key"].T) / np.sqrt(x.shape[1])
        z = np.where(there, z, -np.inf)
        e = np.where(there, np.exp(z - np.where(there.any(1), z.max(1), 0.0)[:, None]), 0.0)
        a = e / np.maximum(e.sum(1, keepdims=True), 1e-300)
        return np.einsum("bk,bkd->bd", a, v @ self.model["value"].T)

    def __call__(self, x: np.ndarray, w: np.ndarray, v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The new states, what was read, and the gate; a projection has no gate (NaN)."""
        m = self.read(x, w, v, there)
        both = np.concatenate([x, m], 1)
        if self.mode == "concat_projection":
            return both @ self.model["joined"].T, m, np.full(m.shape, np.nan)
        gate = {"forced_gate_1": 1.0, "forced_gate_scalar": self.alpha}.get(self.mode)
        gate = np.full(m.shape, gate) if gate is not None else _sigmoid(both @ self.model["gate"].T + self.model["gate_bias"][0])
        return x + gate * m, m, gate


INTEGRATED = "query_id bigint, vec array<double>, gate_mean double, gate_min double, gate_max double, memory_norm double, state_norm double, residual_ratio double"


def integrate(states: DataFrame, memory: DataFrame, model: Model, mode: str, alpha: float = 0.5) -> DataFrame:
    """INTEGRATED of each state(query_id, vec) with memory(query_id, slots): the new state, the mean and bounds of its gate, the norms of what was read and of the state, and that of the change over the state's."""
    head, dims = MemoryHead(model, mode, alpha), model["memory"].shape[1]
    shared = states.sparkSession.sparkContext.broadcast(head)
    none = F.array().cast("array<struct<rank:int,w:double,value:array<double>>>")
    rows = states.select("query_id", "vec").join(memory.select("query_id", F.transform("slots", lambda s: F.struct(s["rank"].cast("int").alias("rank"), s["w"].cast("double").alias("w"), s["value"].alias("value"))).alias("slots")), "query_id", "left")

    def run(b: pa.RecordBatch) -> list:
        x = _matrix(b.column(1))
        out, m, gate = shared.value(x, *_listed(b.column(2), dims))
        size = lambda a: np.sqrt((a**2).sum(1))
        ratio = np.divide(size(out - x), size(x), out=np.zeros(len(x)), where=size(x) > 0)
        gates = [pa.array(g, mask=np.isnan(g)) for g in (gate.mean(1), gate.min(1), gate.max(1))]
        return [b.column(0), out.tolist(), *gates, size(m), size(x), ratio]

    return _passed(rows.select("query_id", "vec", F.coalesce("slots", none).alias("slots")), INTEGRATED, 32 * dims, run)


# --- slot selector -----------------------------------------------------------------------------------------------------
def selector_logits(features: DataFrame, queries: DataFrame, slots: DataFrame, values: DataFrame, model: Model) -> DataFrame:
    """features(query_id, slot_id, hops, score, place, margin, normalised, ...) with the selector's logit and the slot's value (null if dead).

    Two hidden layers over the query's vector, the slot's, its value (zeros if it is dead), the four scalars and an
    embedding of the hops (0 to 3; others are clipped, none is 0). The first layer is a sum of products, one for each
    of the five parts, so nothing is concatenated.
    """
    rows = features.join(queries.select("query_id", F.col("vec").alias("__q")), "query_id").join(slots.select("slot_id", F.col("vec").alias("__s")), "slot_id").join(values.select("slot_id", "value"), "slot_id", "left")
    shared, dims = features.sparkSession.sparkContext.broadcast(model), model["w_value"].shape[1]
    kept = [c for c in features.columns if c not in ("query_id", "slot_id")]
    rows = rows.select("query_id", "slot_id", *kept, "value", "__q", "__s")
    at = {c: i for i, c in enumerate(rows.columns)}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if not f.name.startswith("__")) + ", logit double"
    schema = schema.replace("decimal(1,0)", "double")

    def run(b: pa.RecordBatch) -> list:
        p, there = shared.value, b.column(at["value"]).is_valid().to_numpy(zero_copy_only=False)
        v = np.zeros((b.num_rows, dims))
        if there.any():
            v[there] = _matrix(b.column(at["value"]).drop_null())
        scalars = np.stack([b.column(at[c]).to_numpy(zero_copy_only=False).astype(float) for c in ("score", "place", "margin", "normalised")], 1)
        hops = np.clip(np.nan_to_num(b.column(at["hops"]).to_numpy(zero_copy_only=False).astype(float)), 0, len(p["hops"]) - 1).astype(int)
        h = _matrix(b.column(at["__q"])) @ p["w_query"].T + _matrix(b.column(at["__s"])) @ p["w_slot"].T + v @ p["w_value"].T + scalars @ p["w_scalars"].T + p["hops"][hops] @ p["w_hops"].T + p["b_first"][0]
        h = np.maximum(np.maximum(h, 0.0) @ p["w_second"].T + p["b_second"][0], 0.0)
        logit = np.round(h @ p["w_last"][0] + p["b_last"][0, 0], RANK_PLACES)
        return [*(b.column(i) for c, i in at.items() if not c.startswith("__")), logit]

    return _passed(rows, schema, 8 * dims, run)


def taken(scored: DataFrame, threshold: float = 0.5, top_n: int | None = None) -> DataFrame:
    """scored(query_id, place, logit, ...) with prob and taken: those of at least the threshold, or the top_n of highest probability; where there are none, the first of the list."""
    query = Window.partitionBy("query_id")
    df = scored.withColumn("prob", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))), RANK_PLACES))
    if top_n is not None:
        return df.withColumn("taken", F.row_number().over(query.orderBy(F.desc("prob"), "place")) <= top_n)
    over = F.col("prob") >= threshold
    return df.withColumn("taken", over | (~F.bool_or(over).over(query) & (F.row_number().over(query.orderBy("place")) == 1)))


def read_taken(selected: DataFrame) -> DataFrame:
    """selected(query_id, taken, value, ...) with w, the weight of each in its query's mean: dead slots that are taken count in the mean, with the zero vector."""
    return selected.withColumn("w", F.col("taken").cast("double") / F.greatest(F.count_if("taken").over(Window.partitionBy("query_id")), F.lit(1)))


# --- pair scorer -------------------------------------------------------------------------------------------------------
PAIRED = "query_id bigint, slot_id bigint, score double"
#: Slots of a tile: some 130 kB of hidden units.
TILE = 2048
#: Slots by which the units of an anchor's second layer are taken for on or off.
SAMPLE = 32
#: Rows of a tile that one operation takes as one, so that its loops are long.
STEP = 8


def pair_topk(anchors: DataFrame, slots: DataFrame, model: Model, k: int) -> DataFrame:
    """src, rank, dst and weight: of each anchor(slot_id, vec) the k slots(slot_id, vec) of highest score, itself included, ties to the smaller id.

    The score is a network of two hidden layers over the concatenated pair. Its first layer is separable: each anchor
    and each slot of a block is multiplied with its half of the matrix once, and halves are added pair by pair. All
    pairs get an upper bound of their score in single precision, in tiles of `TILE` slots with a row for each hidden
    unit, that stay in a core's cache: a unit of the second layer that lowers the score does so at least by its value
    and at least by nothing, so all these together are one row, a sum of those taken for on. Pairs whose bound reaches
    the kth of some scores that are known are scored in double precision, and only these scores count. Blocks hand on
    k rows an anchor.
    """
    shared = anchors.sparkSession.sparkContext.broadcast(model)

    def block(ids: np.ndarray, slots: np.ndarray):
        p = shared.value
        s, last, n = slots @ p["w_slot"].T, p["w_last"][0], len(ids)
        hidden, most = s.shape[1], np.abs(s).max(0)
        fast, some = np.zeros((-(-n // GROUP) * GROUP, hidden), np.float32), s[:: -(-n // SAMPLE)]
        fast[:n] = s
        second, bias = last[:, None] * p["w_second"], last * p["b_second"][0]
        up, down = last > 0, last <= 0
        rows = int(up.sum())
        wide = -(-(rows + 1) // STEP) * STEP
        h, g, ones = np.empty((TILE, hidden), np.float32), np.empty((TILE, wide), np.float32), np.ones(wide, np.float32)

        def exact(a: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
            score, step = np.empty(len(row)), max(1, CELLS // hidden)
            for j in range(0, len(row), step):
                x = np.maximum(np.maximum(a[row[j : j + step]] + s[col[j : j + step]], 0.0) @ p["w_second"].T + p["b_second"][0], 0.0)
                score[j : j + step] = x @ last
            return np.round(score, RANK_PLACES)

        def bounds(a: np.ndarray) -> np.ndarray:
            """At least the score of each pair, but for single precision's error. x + b, where it is positive, else 0, is taken as the larger of x and -b, and all b are added at the end."""
            on = (np.maximum(a[:, None] + some, 0.0) @ p["w_second"].T + p["b_second"][0]).sum(1) > 0
            each, more = np.zeros((len(a), hidden, wide)), np.zeros((len(a), wide))
            each[:, :, :rows], each[:, :, rows] = second[up].T, on[:, down] @ second[down]
            more[:, :rows], more[:, rows] = bias[up], on[:, down] @ bias[down]
            more += np.einsum("ihr,ih->ir", each, a)
            low = -more
            low[:, rows] = -np.inf
            each, low, least = each.astype(np.float32), np.tile(low.astype(np.float32), STEP), np.tile(-a.astype(np.float32), STEP)
            score = np.empty((len(a), len(fast)), np.float32)
            for j in range(0, n, TILE):
                part = fast[j : j + TILE]
                x, y = h[: len(part)], g[: len(part)]
                part, xs, ys = (z.reshape(len(part) // STEP, -1) for z in (part, x, y))
                for i in range(len(a)):
                    np.maximum(part, least[i], out=xs)
                    np.matmul(x, each[i], out=y)
                    np.maximum(ys, low[i], out=ys)
                    np.matmul(y, ones, out=score[i, j : j + len(x)])
            score += more.sum(1).astype(np.float32)[:, None]
            score[:, n:] = -np.inf
            return score

        def near(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows and columns of the pairs that can be among the k best."""
            if n < 2 * GROUP * k:
                return np.divmod(np.arange(len(a) * n), n)
            score = bounds(a)
            row, col = foremost(score, 2 * k, GROUP)
            known = np.sort(exact(a, row, col).reshape(len(a), -1), 1)[:, -k]
            size = np.abs(last) @ (np.abs(p["w_second"]) @ (3 * np.abs(a).max(0) + most) + 3 * np.abs(p["b_second"][0]))
            error = (2 * hidden + 2 * len(last) + 16) * 2.0**-23 * float(size) + 10.0**-RANK_PLACES
            return np.divmod(np.flatnonzero(score >= (known - 2 * error).astype(np.float32)[:, None]), score.shape[1])

        def run(asked: np.ndarray, queries: np.ndarray) -> list:
            a = queries @ p["w_anchor"].T + p["b_first"][0]
            row, col = near(a)
            found = exact(a, row, col)
            at = best(row, col, found, k)
            return [asked[row[at]], ids[col[at]], found[at]]

        return run

    found = by_blocks(anchors.select(F.col("slot_id").alias("query_id"), "vec"), slots.select("slot_id", "vec"), block, PAIRED)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "slot_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").alias("src"), "rank", F.col("slot_id").alias("dst"), F.col("score").alias("weight"))


def stack(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """parameters(name, row, vec) of named parts(row, vec)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), "row", "vec") for name, df in parts])
