"""Training losses as aggregations over score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import softplus
from .retrieve import mass, score_given, topk


def contrastive(pairs: DataFrame, temperature: float) -> DataFrame:
    """pairs(a, b, same, sim), a <> b: mean over a with a positive of -log(sum of positives / sum of all), and how many."""
    e = F.exp(F.col("sim") / temperature)
    each = pairs.groupBy("a").agg(F.sum(F.when(F.col("same"), e).otherwise(0.0)).alias("pos"), F.sum(e).alias("total")).where("pos > 0")
    return each.agg(F.count("*").alias("rows"), F.round(F.avg(-F.log(F.col("pos") / F.col("total") + 1e-10)), 6).alias("loss"))


def info_nce_over_all(queries: DataFrame, slots: DataFrame, required: DataFrame, temperature: float, own: bool = True) -> DataFrame:
    """Queries, their positives, and the mean of logsumexp over all slots less that over a query's required slots.

    Every slot(slot_id, vec) is in the sum over all, taken by blocks without writing pairs; every required(query_id,
    slot_id) that slots has is a positive, however low it ranks. Queries without one take no part.
    """
    every = mass(queries, slots, temperature, "exp", own).select("query_id", "mass")
    right = score_given(required.select("query_id", "slot_id").distinct(), queries, slots)
    each = right.groupBy("query_id").agg(F.sum(F.exp(F.col("score") / temperature)).alias("pos"), F.count("*").alias("n")).join(every, "query_id")
    return each.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("positives"), F.round(F.avg(F.log("mass") - F.log("pos")), 6).alias("loss"))


def margin_over_all(queries: DataFrame, slots: DataFrame, required: DataFrame, hardest: int, gap: float, own: bool = True) -> DataFrame:
    """Pairs, positives and the mean of max(0, gap - positive + negative) over each query's required slots and its `hardest` best other slots.

    A query's negatives are looked for among so many slots more as it has required ones, so none is lost to them.
    """
    need = required.select("query_id", "slot_id").distinct()
    most = need.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    others = topk(queries, slots, hardest + most, own=own).join(need, ["query_id", "slot_id"], "left_anti")
    hard = others.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("nth") <= hardest).select("query_id", F.col("score").alias("negative"))
    pairs = score_given(need, queries, slots).join(hard, "query_id")
    return pairs.agg(F.count("*").alias("rows"), F.count_distinct("query_id", "slot_id").alias("positives"), F.round(F.avg(F.greatest(F.lit(0.0), F.lit(gap) - F.col("score") + F.col("negative"))), 6).alias("loss"))


def info_nce(scores: DataFrame, temperature: float) -> DataFrame:
    """scores(query_id, positive, score): mean of logsumexp over a query's candidates less that over its positives."""
    z = F.col("score") / temperature
    top = scores.withColumn("z", z).withColumn("m", F.max(z).over(Window.partitionBy("query_id")))
    e = F.exp(F.col("z") - F.col("m"))
    each = top.groupBy("query_id").agg(F.sum(e).alias("total"), F.sum(F.when(F.col("positive"), e).otherwise(0.0)).alias("pos")).where("pos > 0")
    return each.agg(F.count("*").alias("rows"), F.round(F.avg(F.log("total") - F.log("pos")), 6).alias("loss"))


def weighted_bce(scores: DataFrame, pos_weight: float, temperature: float = 1.0) -> DataFrame:
    """scores(positive, score): mean binary cross-entropy with positives weighted."""
    z = F.col("score") / temperature
    return scores.agg(F.count("*").alias("rows"), F.round(F.avg(F.when(F.col("positive"), softplus(-z) * pos_weight).otherwise(softplus(z))), 6).alias("loss"))


def bce_over_all(queries: DataFrame, slots: DataFrame, required: DataFrame, pos_weight: float, temperature: float, own: bool = True) -> DataFrame:
    """Mean weighted cross-entropy over every query and slot: all as negatives by blocks, and what the required ones change."""
    every = mass(queries, slots, temperature, "softplus", own).agg(F.sum("n").alias("rows"), F.sum("mass").alias("mass"))
    z = F.col("score") / temperature
    changed = score_given(required.select("query_id", "slot_id").distinct(), queries, slots).agg(F.coalesce(F.sum(softplus(-z) * pos_weight - softplus(z)), F.lit(0.0)).alias("more"))
    return every.join(F.broadcast(changed), F.lit(True)).select("rows", F.round((F.col("mass") + F.col("more")) / F.greatest("rows", F.lit(1)), 6).alias("loss"))


def margin(scores: DataFrame, hardest: int, gap: float) -> DataFrame:
    """Mean of max(0, gap - positive + negative) over each query's first positive and its hardest negatives."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "slot_id")
    hard = scores.where("not positive").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= hardest).select("query_id", F.col("score").alias("negative"))
    best = scores.where("positive").groupBy("query_id").agg(F.max("score").alias("score"))
    return best.join(hard, "query_id").agg(F.count("*").alias("rows"), F.round(F.avg(F.greatest(F.lit(0.0), F.lit(gap) - F.col("score") + F.col("negative"))), 6).alias("loss"))


def subkey(scores: DataFrame, wanted: DataFrame, subkeys: int) -> DataFrame:
    """Cross-entropy of the two codebooks at the wanted(query_id, slot_id) addresses, added."""
    w = Window.partitionBy("query_id", "side")
    m = scores.withColumn("m", F.max("score").over(w))
    norm = m.withColumn("lse", F.col("m") + F.log(F.sum(F.exp(F.col("score") - F.col("m"))).over(w)))
    target = wanted.select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.floor(F.col("slot_id") / subkeys).alias("k")), F.struct(F.lit(2).alias("side"), F.pmod("slot_id", F.lit(subkeys)).alias("k")))).alias("t")).select("query_id", "t.*")
    each = norm.join(target, ["query_id", "side", "k"]).groupBy("side").agg(F.count("*").alias("rows"), F.avg(F.col("lse") - F.col("score")).alias("ce"))
    return each.agg(F.max("rows").alias("rows"), F.round(F.sum("ce"), 6).alias("loss"))


def sampled_bce(scores: DataFrame, pos_weight: float, temperature: float) -> DataFrame:
    """scores(query_id, positive, score): the mean over queries of each one's mean weighted cross-entropy."""
    z = F.col("score") / temperature
    each = scores.groupBy("query_id").agg(F.avg(F.when(F.col("positive"), softplus(-z) * pos_weight).otherwise(softplus(z))).alias("loss"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("queries"), F.sum("n").alias("rows"), F.round(F.avg("loss"), 6).alias("loss"))


def retrieval_ce(queries: DataFrame, slots: DataFrame, wanted: DataFrame, temperature: float, own: bool = True) -> DataFrame:
    """Cross-entropy of each wanted(query_id, slot_id) among all slots, by blocks; and how many."""
    every = mass(queries, slots, temperature, "exp", own).select("query_id", "mass")
    right = score_given(wanted.select("query_id", "slot_id"), queries, slots)
    return right.join(every, "query_id").agg(F.count("*").alias("rows"), F.round(F.avg(F.log("mass") - F.col("score") / temperature), 6).alias("ce"))


def token_ce(sequences: DataFrame, counts: DataFrame, vocab_size: int, ignored: int = -100) -> DataFrame:
    """Mean cross-entropy of sequences(ids, labels), each label predicted from the id before it by an add-one bigram model.

    counts(prev, next, n) are the model. Labels are shifted by one and ignored ones left out. Equal (id, label) pairs are
    counted together before they meet the model, so what is joined is bounded by the pairs of the vocabulary.
    """
    steps = F.sequence(F.lit(1), F.size("ids") - 1)
    pairs = sequences.where(F.size("ids") > 1).select(F.explode(F.transform(steps, lambda i: F.struct(F.get("ids", i - 1).alias("prev"), F.get("labels", i).alias("next")))).alias("p"))
    asked = pairs.select("p.*").where(F.col("next") != ignored).groupBy("prev", "next").agg(F.count("*").alias("times"))
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    known = asked.join(counts, ["prev", "next"], "left").join(totals, "prev", "left")
    p = (F.coalesce("n", F.lit(0)) + 1.0) / (F.coalesce("total", F.lit(0)) + F.lit(float(vocab_size)))
    return known.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("rows"), F.round(F.sum(-F.log(p) * F.col("times")) / F.sum("times"), 6).alias("loss"))


def bigrams(sequences: DataFrame) -> DataFrame:
    """prev, next and n of neighbouring ids of sequences(ids)."""
    pairs = sequences.where(F.size("ids") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.struct(F.get("ids", i - 1).alias("prev"), F.get("ids", i).alias("next")))).alias("p"))
    return pairs.select("p.*").groupBy("prev", "next").agg(F.count("*").alias("n"))
