"""A query encoder's forward pass: token and position vectors, causal attention, gated layers, pooled at the last prompt token.

Sequences are worked off in buckets of like length, in parts whose arrays have a fixed size; attention of a long
sequence goes by blocks of positions against all before them, so memory grows with its length and not with its square.
What stands after the prompt cannot reach the pooled position through a causal mask and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready
from .neural import CELLS, Model

EPSILON = 1e-6


class Encoder:
    """Weights by name: tokens, positions, norm, out, and for layer l norm1_l, qkv_l, proj_l, norm2_l, gate_l, up_l and down_l.

    A token's vector is the row of its id modulo the rows of `tokens`, a position's that of its number modulo the rows
    of `positions`, so both tables have a fixed size whatever the vocabulary and the length.
    """

    def __init__(self, model: Model, heads: int):
        self.model, self.heads = model, heads
        self.layers = sum(name.startswith("qkv_") for name in model)
        self.width = model["tokens"].shape[1]
        if self.width % heads:
            raise ValueError(f"{heads} heads do not share {self.width} dimensions")
        self.widest = max(w.shape[0] for name, w in model.items() if name not in ("tokens", "positions"))

    def __call__(self, sequences: list[np.ndarray]) -> list[list[float] | None]:
        """A vector for each sequence of ids; none for an empty one."""
        out: list[list[float] | None] = [None] * len(sequences)
        buckets: dict[int, list[int]] = {}
        for i, ids in enumerate(sequences):
            if len(ids):
                buckets.setdefault((len(ids) - 1).bit_length(), []).append(i)
        for members in buckets.values():
            members.sort(key=lambda i: len(sequences[i]))
            longest = len(sequences[members[-1]])
            rows = max(1, CELLS // (longest * self.widest))
            for k in range(0, len(members), rows):
                part = members[k : k + rows]
                for i, vec in zip(part, self._pass([sequences[i] for i in part]).tolist(), strict=True):
                    out[i] = vec
        return out

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        return x / np.sqrt((x * x).mean(-1, keepdims=True) + EPSILON) * self.model[name][0]

    def _attend(self, x: np.ndarray, layer: int) -> np.ndarray:
        rows, length, _ = x.shape
        q, k, v = (x @ self.model[f"qkv_{layer}"].T).reshape(rows, length, 3, self.heads, -1).transpose(2, 0, 3, 1, 4)
        out, step = np.empty(q.shape), max(1, CELLS // (rows * self.heads * length))
        for a in range(0, length, step):
            z = min(length, a + step)
            score = q[:, :, a:z] @ k[:, :, :z].swapaxes(2, 3) / np.sqrt(q.shape[-1])
            score = np.where(np.arange(z) > np.arange(a, z)[:, None], -np.inf, score)
            score = np.exp(score - score.max(-1, keepdims=True))
            out[:, :, a:z] = score @ v[:, :, :z] / score.sum(-1, keepdims=True)
        return out.transpose(0, 2, 1, 3).reshape(rows, length, self.width) @ self.model[f"proj_{layer}"].T

    def _pass(self, sequences: list[np.ndarray]) -> np.ndarray:
        lengths, m = np.array([len(s) for s in sequences]), self.model
        ids = np.zeros((len(sequences), int(lengths.max())), np.int64)  # what pads a row comes after all that is read
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = np.concatenate(sequences)
        x = m["tokens"][ids % len(m["tokens"])] + m["positions"][np.arange(ids.shape[1]) % len(m["positions"])]
        for layer in range(self.layers):
            x = x + self._attend(self._norm(x, f"norm1_{layer}"), layer)
            n = self._norm(x, f"norm2_{layer}")
            gate = n @ m[f"gate_{layer}"].T
            x = x + (gate / (1.0 + np.exp(-gate)) * (n @ m[f"up_{layer}"].T)) @ m[f"down_{layer}"].T
        return self._norm(x[np.arange(len(sequences)), lengths - 1], "norm") @ m["out"].T


def encode(prompts: DataFrame, model: Model, heads: int) -> DataFrame:
    """query_id and vec of prompts(query_id, ids, prompt_len): the whole prompt's vector; null where it has no ids.

    A null list is empty; a prompt_len beyond the list, or null, takes all of it. Repeated rows give repeated rows.
    """
    ready(prompts.sparkSession)
    shared, schema = prompts.sparkSession.sparkContext.broadcast(Encoder(model, heads)), "query_id bigint, vec array<double>"
    head = F.slice(F.coalesce("ids", F.array().cast("array<int>")), 1, F.greatest(F.lit(0), F.coalesce("prompt_len", F.size("ids"), F.lit(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequences = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value(sequences), pa.list_(pa.float64()))], names=["query_id", "vec"])

    return prompts.select(F.col("query_id").cast("bigint"), head.cast("array<bigint>").alias("ids")).mapInArrow(run, schema)
