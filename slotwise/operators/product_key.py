"""Product keys: slots addressed by two codebooks, exact top-k of additive scores without scoring all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot
from .retrieve import RANK_PLACES, ranked_by_score


def clipped(top_k: int, top_a: int, top_b: int, subkeys: int) -> tuple[int, int, int]:
    """top_k, top_a and top_b, cut to what the address space holds: both sides to the subkeys, top_k to their product."""
    a, b = min(top_a, subkeys), min(top_b, subkeys)
    return min(top_k, a * b), a, b


def subscores(queries: DataFrame, codebook: DataFrame, dim: int, by_cosine: bool = False) -> DataFrame:
    """query_id, side (1, 2), k and score (dot product, or cosine) of each query half against its codebook(side, k, vec); codebooks are small."""
    halves = queries.select("query_id", F.explode(F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array(F.slice("vec", 1, dim), F.slice("vec", dim + 1, dim)))).alias("side", "half"))
    return halves.join(F.broadcast(codebook), "side").select("query_id", "side", "k", F.round((cosine if by_cosine else dot)(F.col("half"), F.col("vec")), RANK_PLACES).alias("score"))


def best(scores: DataFrame, side: int, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "k")
    found = scores.where(F.col("side") == side).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return found.select("query_id", F.col("k").alias(f"k{side}"), F.col("score").alias(f"s{side}"))


def candidates(scores: DataFrame, top_a: int, top_b: int, subkeys: int) -> DataFrame:
    """query_id, slot_id and score of topA x topB; exact for a top-k of k <= min(topA, topB), ties aside."""
    pairs = best(scores, 1, top_a).join(best(scores, 2, top_b), "query_id")
    return pairs.select("query_id", (F.col("k1") * subkeys + F.col("k2")).cast("bigint").alias("slot_id"), F.round(F.col("s1") + F.col("s2"), RANK_PLACES).alias("score"))


def topk(scores: DataFrame, top_a: int, top_b: int, subkeys: int, k: int) -> DataFrame:
    """The k best addresses; parameters beyond the address space are cut to it."""
    k, top_a, top_b = clipped(k, top_a, top_b, subkeys)
    return ranked_by_score(candidates(scores, top_a, top_b, subkeys), k)


def with_slot_keys(found: DataFrame, queries: DataFrame, slot_keys: DataFrame, dim: int, alpha: float) -> DataFrame:
    """candidates with alpha times the product of the query's first half and the slot's own key added (0 without a key)."""
    own = found.join(queries.select("query_id", F.slice("vec", 1, dim).alias("half")), "query_id").join(slot_keys.select("slot_id", F.col("vec").alias("key")), "slot_id", "left")
    return own.select("query_id", "slot_id", F.round(F.col("score") + F.lit(alpha) * F.coalesce(dot(F.col("half"), F.col("key")), F.lit(0.0)), RANK_PLACES).alias("score"))


def score_slots(pairs: DataFrame, scores: DataFrame, subkeys: int) -> DataFrame:
    """Additive scores of the listed pairs(query_id, slot_id), by the two parts of their address."""
    side = lambda n: scores.where(F.col("side") == n).select("query_id", F.col("k").alias(f"k{n}"), F.col("score").alias(f"s{n}"))
    addressed = pairs.withColumn("k1", F.floor(F.col("slot_id") / subkeys)).withColumn("k2", F.pmod("slot_id", F.lit(subkeys)))
    return addressed.join(side(1), ["query_id", "k1"]).join(side(2), ["query_id", "k2"]).select("query_id", "slot_id", F.round(F.col("s1") + F.col("s2"), RANK_PLACES).alias("score"))


def compact(slots: DataFrame, order: str, space: int) -> DataFrame:
    """Live slots mapped to 0.. in order; those beyond the address space have a null compact_id, so none is lost silently."""
    from .text import dense_id

    numbered = dense_id(slots.where("value_token is not null"), F.col(order), F.floor(F.col(order) / 4096), "n")
    return numbered.select(order, F.when(F.col("n") < space, F.col("n")).cast("bigint").alias("compact_id"))


def diagnostics(scores: DataFrame, wanted: DataFrame, live: DataFrame, top_a: int, top_b: int, subkeys: int, k: int) -> DataFrame:
    """Means over queries of how retrieval treats wanted(query_id, slot_id); live: live slot ids. One row."""
    found = candidates(scores, top_a, top_b, subkeys)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "slot_id")
    top = ranked_by_score(found, k)
    a = best(scores, 1, top_a).select("query_id", "k1").withColumn("in_a", F.lit(1))
    b = best(scores, 2, top_b).select("query_id", "k2").withColumn("in_b", F.lit(1))
    w = wanted.withColumn("k1", F.floor(F.col("slot_id") / subkeys)).withColumn("k2", F.pmod("slot_id", F.lit(subkeys)))
    second = found.withColumn("nth", F.row_number().over(order)).where("nth = 2").select("query_id", F.col("score").alias("negative"))
    peak = Window.partitionBy("query_id")
    weights = top.withColumn("e", F.exp(F.col("score") - F.max("score").over(peak)))
    weights = weights.withColumn("p", F.col("e") / F.sum("e").over(peak))
    spread = weights.groupBy("query_id").agg(F.stddev_samp("score").alias("std"), F.sum(-F.col("p") * F.log(F.greatest("p", F.lit(1e-10)))).alias("entropy"))
    alive = found.join(live.select("slot_id", F.lit(1).alias("is_live")).distinct(), "slot_id", "left").groupBy("query_id").agg(F.avg(F.coalesce("is_live", F.lit(0))).alias("live_rate"))
    each = (
        w.join(a, ["query_id", "k1"], "left")
        .join(b, ["query_id", "k2"], "left")
        .join(found.select("query_id", "slot_id", F.lit(1).alias("in_c")), ["query_id", "slot_id"], "left")
        .join(top.select("query_id", "slot_id", (F.col("rank") - 1).alias("place")), ["query_id", "slot_id"], "left")
        .join(score_slots(wanted, scores, subkeys).withColumnRenamed("score", "positive"), ["query_id", "slot_id"])
        .join(second, "query_id")
        .join(spread, "query_id")
        .join(alive, "query_id")
    )
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 6)
    mean = lambda c: F.round(F.avg(c), 6)
    return each.agg(
        share("in_a").alias("k1_in_top"), share("in_b").alias("k2_in_top"), share("in_c").alias("in_candidates"), F.round(F.coalesce(F.avg("place"), F.lit(-1.0)), 6).alias("rank_mean"),
        mean("positive").alias("positive_mean"), mean("negative").alias("negative_mean"), mean(F.col("positive") - F.col("negative")).alias("margin"), mean("live_rate").alias("live_rate"), mean("std").alias("std_mean"), mean("entropy").alias("entropy_mean"),
    )
