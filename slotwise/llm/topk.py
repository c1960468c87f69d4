"""Exact top-k inner products by ball-tree branch and bound, a tree for each shard.

Rows are dealt to shards of some `SHARD_ROWS` vectors by a hash of their place in the table; each shard's ball tree is
built once and written. Queries go to the trees, in blocks of `BLOCK_ROWS` that walk a tree together: the open nodes
stand in a heap by their largest upper bound q.c + |q| r, the best node is opened first, and a query leaves a node,
with all that is below it, as soon as the node's bound is under the query's kth score so far; a node that no query
wants is cut. Shards are searched in waves of 1, 8, 64, ... shards a query; the best k scores after a wave are
gathered and their kth goes along into the next one, so every shard starts from what the shards before it have found.
A wave shuffles a tree once for each block of queries that it sends there, and no other tree.
Bounds are widened by a relative rounding margin and ties are never cut, so results are exact.

Components are floor(256 * x) of x as double. Scores are exact integers: sums below 2^53 come from matrix products of
doubles, larger ones from Python's integers (a score beyond a long raises an error). Vectors that are null, or hold a
null or non-finite component, take no part; vectors of another length than the query's are no candidates; empty
vectors score 0 among themselves. Rows that repeat a vec_id are rows of their own (their own id's other rows are no
candidates, and as queries they share one list); a null vec_id takes no part. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepared, stored

SHARD_ROWS = 16_384
BLOCK_ROWS = 4096
LEAF = 256
#: How many times the shards of the wave before a wave searches.
GROWTH = 8
EXACT = 2.0**53
FOUND = "query_id bigint, vec_id bigint, score bigint"
TREES = "shard bigint, size int, tree binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double> of whole numbers) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda a: _floor(a * 256.0)).alias("v"))


def _floor(a):
    """floor() as a double; the function itself returns a long, which large values overflow."""
    whole = F.rint(a)
    return F.when(whole > a, whole - 1.0).otherwise(whole)


class BallTree:
    """Nodes in arrays: centre, radius, the range of rows and, of inner nodes, the two children (-1: a leaf)."""

    ARRAYS = ("ids", "rows", "centres", "radii", "ranges", "children")

    def __init__(self, **arrays: np.ndarray):
        self.ids, self.rows, self.centres, self.radii, self.ranges, self.children = (arrays[a] for a in self.ARRAYS)
        self.opened = self.cut = 0

    @classmethod
    def planted(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> BallTree:
        order, nodes, children = np.arange(len(rows)), [], []

        def build(start: int, stop: int) -> int:
            part = rows[order[start:stop]]
            centre = part.mean(0) if part.size else np.zeros(rows.shape[1])
            away = np.sqrt(((part - centre) ** 2).sum(1))
            at = len(nodes)
            nodes.append((centre, float(away.max(initial=0.0)) * (1 + 1e-9) + 1e-9, (start, stop)))
            children.append((-1, -1))
            if stop - start > leaf and away.max() > 0:
                one = part[away.argmax()]
                two = part[((part - one) ** 2).sum(1).argmax()]
                half = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(part @ (two - one), half)]
                left = build(start, start + half)
                children[at] = left, build(start + half, stop)
            return at

        build(0, len(rows))
        centres, radii, ranges = zip(*nodes, strict=True)
        return cls(ids=ids[order], rows=rows[order], centres=np.array(centres).reshape(len(nodes), -1), radii=np.array(radii), ranges=np.array(ranges), children=np.array(children))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{a: getattr(self, a) for a in self.ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> BallTree:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{a: found[a] for a in cls.ARRAYS})

    def bound(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """No row below the node has a larger product with a query."""
        centre, radius = self.centres[node], self.radii[node]
        found = queries @ centre + norms * radius
        return found + np.abs(found) * 1e-9 + norms * (np.abs(centre).max(initial=0.0) + radius) * 1e-9 * max(1, queries.shape[1])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The (ids, scores) of each query's best k rows that reach its kth score; kth is raised as rows are found."""
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        best = np.full((len(queries), k), -np.inf)
        norms = np.sqrt((queries**2).sum(1))
        open_nodes: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def push(node: int, on: np.ndarray, most: np.ndarray | None) -> None:
            limit = self.bound(node, queries[on], norms[on])
            limit = limit if most is None else np.minimum(limit, most)
            heapq.heappush(open_nodes, (-float(limit.max(initial=-np.inf)), node, on, limit))

        push(0, np.arange(len(queries)), None)
        while open_nodes:
            _, node, on, limit = heapq.heappop(open_nodes)
            wanted = limit >= kth[on]
            on, limit = on[wanted], limit[wanted]
            if not on.size:
                self.cut += 1
                continue
            self.opened += 1
            if self.children[node, 0] >= 0:
                for child in self.children[node].tolist():
                    push(child, on, limit)
                continue
            start, stop = self.ranges[node]
            if start == stop:
                continue
            ids = self.ids[start:stop]
            score = queries[on] @ self.rows[start:stop].T
            score[query_ids[on][:, None] == ids[None, :]] = -np.inf
            reach = np.flatnonzero((score >= kth[on][:, None]).any(1))  # the others keep what they have
            on, score = on[reach], score[reach]
            all_ids = np.concatenate([best_ids[on], np.broadcast_to(ids, score.shape)], 1)
            all_scores = np.concatenate([best[on], score], 1)
            pick = np.lexsort((all_ids, -all_scores), 1)[:, :k]
            best_ids[on], best[on] = np.take_along_axis(all_ids, pick, 1), np.take_along_axis(all_scores, pick, 1)
            kth[on] = np.maximum(kth[on], best[on, -1])
        return [(best_ids[i][best[i] > -np.inf], best[i][best[i] > -np.inf]) for i in range(len(queries))]


def _plant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    x = np.array(rows.v.tolist(), float).reshape(len(rows), key[1])
    tree = BallTree.planted(rows.vec_id.to_numpy(np.int64), x)
    return pd.DataFrame({"shard": [key[0]], "size": [key[1]], "tree": [tree.to_bytes()]})


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for data in trees.tree if len(queries) else ():
            tree = BallTree.from_bytes(data)
            q, query_ids = np.array(queries.v.tolist(), float).reshape(len(queries), key[1]), queries.vec_id.to_numpy(np.int64)
            if np.abs(q).max(initial=0.0) * np.abs(tree.rows).max(initial=0.0) * max(1, key[1]) < EXACT:
                found = tree.search(query_ids, q, queries.kth.fillna(-np.inf).to_numpy(float).copy(), k)
                out += [(np.full(len(i), a), i, s.astype(np.int64)) for a, (i, s) in zip(query_ids, found, strict=True)]
            else:
                whole = [list(map(int, v)) for v in tree.rows.tolist()]
                for a, v in zip(query_ids, q.tolist(), strict=True):
                    v = list(map(int, v))
                    best = sorted((-sum(map(int.__mul__, v, w)), int(i)) for w, i in zip(whole, tree.ids, strict=True) if i != a)[:k]
                    out.append((np.full(len(best), a), np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)))
        if not out:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score")})
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def asked_trees(trees: DataFrame, shards: int, blocks: int, done: int, last: int) -> DataFrame:
    """The trees with each block of queries that walks them in the wave of turns done..last-1; a block's turn t is shard (block + t) modulo the shards."""
    turn = lambda b: F.pmod(F.col("shard") - b, F.lit(shards).cast("bigint"))
    walkers = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")), lambda b: (turn(b) >= done) & (turn(b) < last))
    return trees.withColumn("block", F.explode(walkers))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows, its own id's left out; ties go to the smaller vec_id."""
    prepared(vectors.sparkSession)
    rows = stored(quantised(vectors).withColumn("size", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards))
    trees = stored(rows.select(shard.alias("shard"), "size", "vec_id", "v").groupBy("shard", "size").applyInPandas(_plant, TREES), "topk-trees")
    asked = stored(quantised(queries).withColumn("size", F.size("v")), "topk-queries")
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    discard(rows)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit(29)), F.lit(blocks)))
    best, done, size = None, 0, 1
    while done < shards:
        known = asked.withColumn("kth", F.lit(None).cast("double"))
        if best is not None:
            known = asked.join(best.where(F.size("best") == k).select(F.col("query_id").alias("vec_id"), (-F.element_at("best", -1)["worse"]).cast("double").alias("kth")), "vec_id", "left")
        last = min(shards, done + size)
        turns = F.explode(F.sequence(F.lit(done).cast("bigint"), F.lit(last - 1).cast("bigint")))
        sent = known.withColumn("turn", turns).withColumn("shard", F.pmod(F.col("block") + F.col("turn"), F.lit(shards)))
        found = sent.groupBy("shard", "size", "block").cogroup(asked_trees(trees, shards, blocks, done, last).groupBy("shard", "size", "block")).applyInPandas(_search(k), FOUND)
        hits = found.select("query_id", F.struct((-F.col("score")).alias("worse"), "vec_id").alias("hit"))
        hits = hits if best is None else hits.unionByName(best.select("query_id", F.explode("best").alias("hit")))
        now = stored(hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list("hit")), 1, k).alias("best")), "topk-best")
        if best is not None:
            discard(best)
        best, done, size = now, last, size * GROWTH
    ranked = best.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.worse")).alias("score"))
