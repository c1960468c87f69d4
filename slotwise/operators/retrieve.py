"""Dense retrieval: exact top-k by blocked matrix products, and what is built on ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mix
from ..functions.vectors import cosine, sigmoid
from ..session import written
from .text import dense_id

BLOCK_SLOTS = 16_384
BLOCK_QUERIES = 16_384
#: Queries below which a block is not split to keep all cores busy.
LEAST_QUERIES = 512
#: Queries that are multiplied with a block of slots at once; their scores fit in some 8 MB.
CHUNK = 64
#: Scores of a query of which only the largest is compared when the least of its best is looked for.
GROUP = 32
#: Pairs whose vectors are gathered at once.
MANY = 1 << 14
#: Ranks are by scores rounded to so many places, then by id, so that summation order does not matter.
RANK_PLACES = 9
RANKED = "query_id bigint, slot_id bigint, score double"

#: What a block of slots (ids and vectors, by id) gives: a function of ids and vectors of queries to the columns of its result.
Block = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], list]]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.list_value_length(column)
    if sizes.null_count or pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors are null or of different lengths")
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _units(vec: np.ndarray, metric: str) -> np.ndarray:
    """What a product of is the score: for cosines unit vectors, and zero vectors as they are."""
    if metric == "dot":
        return vec
    size = np.sqrt((vec**2).sum(1, keepdims=True))
    return np.divide(vec, size, out=np.zeros_like(vec), where=size > 0)


def highest(score: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of every number that is among the k largest of its row, or below the kth by `slack` at most; by row and column."""
    n = score.shape[1]
    if n <= k:
        return np.divmod(np.arange(score.size), max(n, 1))
    kth = np.partition(score, n - k, 1)[:, n - k, None]
    return np.nonzero(score >= np.where(np.isfinite(kth), kth - slack - 1e-12 * np.abs(kth), kth))


def best(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of these numbers are the k best of their rows, best first, ties to the smaller column."""
    order = np.lexsort((col, -score, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def _nearly(queries: np.ndarray, largest: float) -> np.ndarray | None:
    """How far a single-precision product with vectors of at most the largest size can be from the exact one, for each query; None where single precision does not hold the numbers."""
    size = np.sqrt((queries**2).sum(1))
    return (queries.shape[1] + 16) * 2.0**-23 * size * largest + 1e-30 if largest < 1e15 and (size < 1e15).all() else None


def _screened(score: np.ndarray, k: int, width: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of every number that can be among the k largest of its row, by row.

    Columns stand in groups of `width`; at least k numbers reach the kth largest of the groups' largest ones, so what is below it by the slack is none of the k.
    """
    groups = score.reshape(len(score), width, -1).max(1)
    kth = np.partition(groups, groups.shape[1] - k, 1)[:, groups.shape[1] - k].astype(float) if groups.shape[1] > k else np.full(len(score), -np.inf)
    low = np.where(np.isfinite(kth), kth - slack, kth).astype(np.float32)
    low = np.where(np.isfinite(low), np.nextafter(low, np.float32(-np.inf)), np.finfo(np.float32).min)
    return np.divmod(np.flatnonzero(score >= low[:, None]), score.shape[1])


def foremost(score: np.ndarray, m: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the largest number of the m groups of `width` columns whose largest ones are greatest; of fewer, where there are fewer groups."""
    parts = score.reshape(len(score), width, -1)
    groups = parts.max(1)
    m = min(m, groups.shape[1])
    group = np.argpartition(groups, groups.shape[1] - m, 1)[:, groups.shape[1] - m :].ravel()
    row = np.repeat(np.arange(len(score)), m)
    return row, parts[row, :, group].argmax(1) * groups.shape[1] + group


def _block_topk(k: int, metric: str, own: bool) -> Block:
    """All products are taken in single precision; those that its error or rounding could lift among the k best are taken again in double precision, and only these count."""

    def block(ids: np.ndarray, slots: np.ndarray):
        slots = _units(slots, metric)
        n, width = len(ids), min(GROUP, max(1, len(ids) // (8 * k)))
        padded = -(-n // width) * width
        fast = np.zeros((slots.shape[1], padded), np.float32)
        with np.errstate(over="ignore"):
            fast[:, :n] = slots.T
            largest = np.sqrt((slots**2).sum(1).max(initial=0.0))

        def pairs(asked: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            first, last = (np.searchsorted(ids, asked, side) for side in ("left", "left" if own else "right"))
            same = np.repeat(np.arange(len(asked)), last - first)  # a query and its own slots
            at, error = first[same] + np.arange(len(same)) - np.searchsorted(same, same), _nearly(queries, largest)
            if error is not None:
                score = queries.astype(np.float32) @ fast
                score[:, n:] = score[same, at] = -np.inf
                row, col = _screened(score, k, width, 2 * (error + 10.0**-RANK_PLACES))
                if len(row) <= score.size // 8:
                    found = np.empty(len(row))
                    for j in range(0, len(row), MANY):
                        np.einsum("ij,ij->i", queries[row[j : j + MANY]], slots[col[j : j + MANY]], out=found[j : j + MANY])
                    return row, col, found
            score = queries @ slots.T  # single precision does not hold the numbers, or too many are alike
            score[np.isnan(score)] = -np.inf
            score[same, at] = -np.inf
            row, col = highest(score, k, 2 * 10.0**-RANK_PLACES)
            return row, col, score[row, col]

        def run(asked: np.ndarray, queries: np.ndarray) -> list:
            row, col, score = pairs(asked, _units(queries, metric))
            found = np.round(score, RANK_PLACES)
            at = best(row, col, found, k)
            at = at[found[at] > -np.inf]
            return [asked[row[at]], ids[col[at]], found[at]]

        return run

    return block


def in_blocks(queries: DataFrame, slots: DataFrame, n_queries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to blocks of bounded size, (qb, sb), each row copied to all blocks of the other side: every query meets every slot once.

    Where there are fewer pairs of blocks than would keep the cores busy, blocks of queries are smaller.
    """
    n_slots, n_queries = slots.count(), queries.count() if n_queries is None else n_queries
    slot_blocks, query_blocks = max(1, -(-n_slots // BLOCK_SLOTS)), max(1, -(-n_queries // BLOCK_QUERIES))
    busy = 3 * slots.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(query_blocks, min(-(-n_queries // LEAST_QUERIES), -(-busy // slot_blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # else a column of both sides, as when both come from one frame, is taken from one only
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("sb", every(slot_blocks))
    return q, slots.withColumn("sb", F.pmod(F.xxhash64("slot_id"), F.lit(slot_blocks)).cast("int")).withColumn("qb", every(query_blocks))


def chunked(block: Block, asked: pa.ChunkedArray, queries: pa.ChunkedArray, ids: pa.ChunkedArray, slots: pa.ChunkedArray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What a block gives of queries and slots, `CHUNK` queries at once."""
    if not len(asked) or not len(ids):
        return
    order, asked, queries = np.argsort(ids.to_numpy(), kind="stable"), asked.to_numpy(), matrix(queries)
    run = block(ids.to_numpy()[order], matrix(slots)[order])
    for k in range(0, len(asked), CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(run(asked[k : k + CHUNK], queries[k : k + CHUNK]), schema, strict=True)], schema=schema)


def by_blocks(queries: DataFrame, slots: DataFrame, block: Block, schema: str, n_queries: int | None = None) -> DataFrame:
    """A block's results for queries(query_id, vec) and slots(slot_id, vec) of each pair of blocks of bounded size; every query meets every slot once.

    Vectors come as Arrow columns and stay matrices; queries are worked off in chunks of `CHUNK`.
    """
    kinds = pa.schema([(name, pa.float64() if kind == "double" else pa.int64()) for name, kind in (field.split() for field in schema.split(","))])

    def run(asked: pa.Table, kept: pa.Table) -> pa.Table:
        found = chunked(block, asked.column("query_id"), asked.column("vec"), kept.column("slot_id"), kept.column("vec"), kinds)
        return pa.Table.from_batches(found, schema=kinds)

    as_vectors = lambda df, key: df.select(F.col(key).cast("bigint").alias(key), F.col("vec").cast("array<double>").alias("vec"))
    q, s = in_blocks(as_vectors(queries, "query_id"), as_vectors(slots, "slot_id"), n_queries)
    return q.groupBy("qb", "sb").cogroup(s.groupBy("qb", "sb")).applyInArrow(run, schema)


def ranked_by_score(scored: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), slot_id and score of the k best; ties go to the smaller slot."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "slot_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "slot_id", "score")


def topk(queries: DataFrame, slots: DataFrame, k: int, metric: str = "cosine", own: bool = True, n_queries: int | None = None) -> DataFrame:
    """Exact top-k of queries(query_id, vec) among slots(slot_id, vec); own: whether a query may find its own id; n_queries: their number, where it is known.

    Both sides are dealt to blocks of bounded size; each pair of blocks is one task's matrix product and hands on k
    rows a query, so what is shuffled grows with queries x k x blocks and not with queries x slots.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")
    return ranked_by_score(by_blocks(queries.select("query_id", "vec"), slots.select("slot_id", "vec"), _block_topk(k, metric, own), RANKED, n_queries), k)


def mass(queries: DataFrame, slots: DataFrame, temperature: float, of: str, own: bool = True) -> DataFrame:
    """Of each query(query_id, vec): how many slots it meets, and the sum of softplus or exp of cosine / temperature over them, without writing pairs."""

    def block(ids: np.ndarray, slots: np.ndarray):
        slots = _units(slots, "cosine")

        def run(asked: np.ndarray, queries: np.ndarray) -> list:
            z = _units(queries, "cosine") @ slots.T
            np.round(z, RANK_PLACES, out=z)
            z /= temperature
            if of == "exp":
                np.exp(z, out=z)
            else:
                z = np.maximum(z, 0.0) + np.log1p(np.exp(-np.abs(z)))
            if own:
                return [asked, np.full(len(asked), len(ids)), z.sum(1)]
            other = asked[:, None] != ids[None, :]
            z[~other] = 0.0
            return [asked, other.sum(1), z.sum(1)]

        return run

    each = by_blocks(queries.select("query_id", "vec"), slots.select("slot_id", "vec"), block, "query_id bigint, n bigint, mass double")
    return each.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def score_given(pairs: DataFrame, queries: DataFrame, slots: DataFrame) -> DataFrame:
    """Cosine of the listed pairs(query_id, slot_id)."""
    joined = pairs.join(queries.select("query_id", F.col("vec").alias("qv")), "query_id").join(slots.select("slot_id", F.col("vec").alias("sv")), "slot_id")
    return joined.select("query_id", "slot_id", F.round(cosine(F.col("qv"), F.col("sv")), RANK_PLACES).alias("score"))


def knn_hit(ranked: DataFrame, query_labels: DataFrame, slot_labels: DataFrame) -> DataFrame:
    """Queries, those with a neighbour of their own label among the ranked, and their share."""
    hits = ranked.join(slot_labels, "slot_id").join(query_labels.withColumnRenamed("label", "own"), "query_id").groupBy("query_id").agg(F.bool_or(F.col("label") == F.col("own")).alias("hit"))
    return hits.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


def union_queries(variants: DataFrame, k: int) -> DataFrame:
    """Ranked lists of several forms of each query, as one: the best score of each slot, then the k best slots."""
    return ranked_by_score(variants.groupBy("query_id", "slot_id").agg(F.max("score").alias("score")), k)


def expand_by_graph(anchors: DataFrame, edges: DataFrame, per_anchor: int, k: int) -> DataFrame:
    """query_id, place and slot_id: anchors by rank, then their strongest neighbours by anchor and weight, keep-first, cut to k."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    near = edges.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_anchor)
    own = anchors.select("query_id", "slot_id", F.lit(0).alias("part"), F.col("rank").alias("first"), F.lit(0).alias("second"))
    more = anchors.join(near, F.col("slot_id") == F.col("src")).select("query_id", F.col("dst").alias("slot_id"), F.lit(1).alias("part"), F.col("rank").alias("first"), F.col("nth").alias("second"))
    first = own.unionByName(more).groupBy("query_id", "slot_id").agg(F.min(F.struct("part", "first", "second")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "slot_id"))
    return first.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "slot_id")


def compare(one: DataFrame, two: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, queries, the share of identical top-k lists, and the correlation of scores at the same rank."""
    both = one.select("query_id", "rank", F.col("slot_id").alias("s1"), F.col("score").alias("x")).join(two.select("query_id", "rank", F.col("slot_id").alias("s2"), F.col("score").alias("y")), ["query_id", "rank"])
    at = both.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where(F.col("rank") <= F.col("k"))
    each = at.groupBy("k", "query_id").agg(F.bool_and(F.col("s1") == F.col("s2")).alias("same"))
    same = each.groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("same").cast("int")), 6).alias("identical"))
    return same.join(at.groupBy("k").agg(F.round(F.corr("x", "y"), 6).alias("correlation")), "k")


def digest(vectors: DataFrame, key: str, places: int = 6) -> DataFrame:
    """One row with `n` and `digest` of vectors(key, vec): a sum of row digests, so equal tables have equal ones in whatever order and parts they lie. Components count to so many places."""
    whole = F.transform("vec", lambda x: F.floor(x * 10**places).cast("string"))
    row = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.array_join(whole, ",")).cast("binary"))
    return vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 7), 16, 10).cast("bigint")), F.lit(0)).alias("digest"))


def side_by_side(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """query_id, first_one, first_two, shared (slots that both first k have) and identical, of two rankings; a query that only one ranks is there too."""
    ids = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slot_id"))), lambda r: r["slot_id"]).alias(name))
    none = F.array().cast("array<bigint>")
    both = ids(one, "a").join(ids(two, "b"), "query_id", "full").select("query_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.select("query_id", F.get("a", F.lit(0)).alias("first_one"), F.get("b", F.lit(0)).alias("first_two"), F.size(F.array_intersect("a", "b")).alias("shared"), (F.col("a") == F.col("b")).alias("identical"))


def iterate(queries: DataFrame, slots: DataFrame, k: int, hops: int, forced: DataFrame | None = None, own: bool = True) -> DataFrame:
    """query_id, rank and slot_id of the lists of several hops, one after the other, each slot at its first place.

    The first hop asks with the query itself, each later one with the sum of the query and the slot that the hop before
    found first, or, with forced(query_id, pos, slot_id), the required slot of that place; queries without one ask
    with themselves again. Each hop's list is written, so that later hops do not find it again.
    """
    n, asked, found = queries.count(), queries, None
    for hop in range(1, hops + 1):
        ranked = written(topk(asked, slots, k, own=own, n_queries=n), f"hop-{hop}")
        step = ranked.select("query_id", "slot_id", F.struct(F.lit(hop).alias("hop"), "rank").alias("at"))
        found = step if found is None else found.unionByName(step)
        lead = ranked.where("rank = 1").select("query_id", "slot_id") if forced is None else forced.where(F.col("pos") == hop).select("query_id", "slot_id")
        lead = lead.join(slots.select("slot_id", F.col("vec").alias("more")), "slot_id").select("query_id", "more")
        asked = queries.join(lead, "query_id", "left").select("query_id", F.coalesce(F.zip_with("vec", "more", lambda x, y: x + y), "vec").alias("vec"))
    first = found.groupBy("query_id", "slot_id").agg(F.min("at").alias("at"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "slot_id")).alias("rank"), "slot_id")


def random_slots(queries: DataFrame, slots: DataFrame, m: int, seed: int) -> DataFrame:
    """query_id, pos and slot_id: m live slots for each query, drawn with replacement by a fixed mix; a placebo for retrieval."""
    live = slots.where("live and slot_id is not null").select("slot_id").distinct()
    placed = dense_id(live, F.col("slot_id"), F.floor(F.col("slot_id") / 4096), "nth")
    drawn = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("pos"))
    drawn = drawn.withColumn("nth", F.pmod(mix(F.col("query_id"), F.col("pos"), seed), F.lit(max(live.count(), 1))).cast("int"))
    return drawn.join(placed, "nth").select("query_id", "pos", "slot_id")


def pair_scores(anchors: DataFrame, slots: DataFrame, edges: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """src, dst and weight of edges(src, dst): a pair scorer of one hidden layer over the two vectors' product, difference and sum.

    Edges that lack either vector go before any vector is joined.
    """
    one, two = anchors.select(F.col("slot_id").alias("src"), F.col("vec").alias("a")), slots.select(F.col("slot_id").alias("dst"), F.col("vec").alias("b"))
    total = lambda f: F.aggregate(F.zip_with("a", "b", f), F.lit(0.0), lambda s, x: s + x)
    parts = (total(lambda x, y: x * y), total(lambda x, y: F.abs(x - y)), total(lambda x, y: x + y))
    z = F.lit(bias)
    for w, part in zip(weights, parts, strict=True):
        z = z + F.greatest(part, F.lit(0.0)) * w
    known = edges.select("src", "dst").distinct().join(two.select("dst"), "dst", "left_semi").join(one.select("src"), "src", "left_semi")
    return known.join(one, "src").join(two, "dst").select("src", "dst", F.round(sigmoid(z), RANK_PLACES).alias("weight"))


def iterate_text(asked: DataFrame, facts: DataFrame, slots: DataFrame, encode: Callable[[DataFrame], DataFrame], k: int, hops: int, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What each hop found (hop, query_id, rank, slot_id, score), and the lists as one (query_id, rank, slot_id), each slot at its first place.

    asked(query_id, text), facts(slot_id, text), slots(slot_id, vec); encode makes (query_id, vec) of (query_id, text).
    The first hop asks with the question, each later one with the question and the text of the fact that the hop
    before found first, or, with forced(query_id, pos, slot_id), that of the given slot of that place; questions whose
    fact has no text ask alone again. Slots' vectors and each hop's list are written, so a hop is computed once however
    often it is read, and a lost executor repeats part of one hop.
    """
    n, slots, texts, found = asked.count(), written(slots.select("slot_id", "vec"), "hop-slots"), asked.select("query_id", "text"), None
    for hop in range(1, hops + 1):
        ranked = written(topk(encode(texts), slots, k, n_queries=n), f"hop-{hop}")
        step = ranked.select(F.lit(hop).alias("hop"), "query_id", "rank", "slot_id", "score")
        found = step if found is None else found.unionByName(step)
        lead = ranked.where("rank = 1").select("query_id", "slot_id") if forced is None else forced.where(F.col("pos") == hop).select("query_id", "slot_id")
        more = lead.join(facts.select("slot_id", F.col("text").alias("more")), "slot_id").select("query_id", "more")
        texts = asked.select("query_id", "text").join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))
    first = found.groupBy("query_id", "slot_id").agg(F.min(F.struct("hop", "rank")).alias("at"))
    return found, first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "slot_id")).alias("rank"), "slot_id")
