"""Selection over ranked candidate lists, and the weighted mean of the selected slots' values.

Candidates are rows (query_id, rank from 1, slot_id, score, live, hops, is_required); each mode makes a mask over
ranks and scores, the mask counts only where the slot is live, and weights are divided by at least 1, so dead slots'
mass is not given to others and an empty selection has the zero vector.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.registered import vec_wavg
from ..functions.text import mix
from ..functions.vectors import sigmoid
from ..session import written
from .text import dense_id

MODES = ("uniform_mean", "top1", "top3", "fixed_top_n", "fixed_top_by_hop", "score_threshold_absolute", "score_threshold_relative", "softmax_mass", "score_gap", "score_weighted_softmax", "score_weighted_top3", "oracle_filter")
DEFAULTS = {"n": 5, "threshold": 0.3, "delta": 0.05, "mass": 0.9, "temperature": 0.1, "gap": 0.02}


def _q() -> WindowSpec:
    return Window.partitionBy("query_id")


def _order() -> WindowSpec:
    return _q().orderBy("rank")


def first_rank(hit: Column) -> Column:
    """The first rank at which hit holds in the query's list; rank 1 where it never does."""
    return F.coalesce(F.min(F.when(hit, F.col("rank"))).over(_q()), F.lit(1))


def softmax(score: Column, temperature: float) -> Column:
    e = F.exp((score - F.max(score).over(_q())) / temperature)
    return e / F.sum(e).over(_q())


def weigh(candidates: DataFrame, mode: str, **given: float) -> DataFrame:
    """candidates with `w`, the weight of each in its query's mean."""
    p = DEFAULTS | given
    rank, score, live = F.col("rank"), F.col("score"), F.col("live").cast("int")
    df = candidates
    if mode in ("score_weighted_softmax", "score_weighted_top3"):
        if mode == "score_weighted_top3":
            df = df.where(rank <= 3)
        df = df.withColumn("m", softmax(score, p["temperature"]) * live)
    else:
        if mode == "softmax_mass":
            df = df.withColumn("p", softmax(score, p["temperature"]))
            df = df.withColumn("mass", F.round(F.sum("p").over(_order().rowsBetween(Window.unboundedPreceding, 0)), 9))
        elif mode == "score_gap":
            df = df.withColumn("gap", F.round(score - F.lead("score").over(_order()), 9))
        mask = {
            "uniform_mean": F.lit(True),
            "top1": rank == 1,
            "top3": rank <= 3,
            "fixed_top_n": rank <= int(p["n"]),
            "fixed_top_by_hop": rank <= F.greatest(F.lit(1), F.coalesce("hops", F.lit(1))),
            "score_threshold_absolute": score >= p["threshold"],
            "score_threshold_relative": F.round(F.max(score).over(_q()) - score, 9) <= p["delta"],
            "softmax_mass": rank <= first_rank(F.col("mass") >= p["mass"]) if mode == "softmax_mass" else None,
            "score_gap": rank <= first_rank(F.col("gap") > p["gap"]) if mode == "score_gap" else None,
            "oracle_filter": F.col("is_required") | ~F.bool_or("is_required").over(_q()),
        }
        if mode not in mask:
            raise ValueError(f"unknown selection mode {mode}")
        df = df.withColumn("m", mask[mode].cast("int") * live)
    return df.withColumn("w", F.col("m") / F.greatest(F.sum("m").over(_q()), F.lit(1.0))).drop("m", "p", "mass", "gap")


def read_values(weighed: DataFrame, values: DataFrame, dims: int) -> DataFrame:
    """query_id, dim (from 1) and value of each query's weighted mean; values(slot_id, value array<double>).

    Vectors of a query's list are summed whole, by one Arrow aggregate; only the result is laid out by dimension.
    """
    means = weighed.where("w > 0").join(values, "slot_id").groupBy("query_id").agg(vec_wavg("w", "value").alias("value"))
    every = weighed.select("query_id").distinct().join(means, "query_id", "left").withColumn("dim", F.explode(F.sequence(F.lit(1), F.lit(dims))))
    return every.select("query_id", "dim", (F.round(F.coalesce(F.get("value", F.col("dim") - 1), F.lit(0.0)), 6) + 0.0).alias("value"))


def features(candidates: DataFrame) -> DataFrame:
    """query_id, slot_id, score, place (from 0), margin to the best score and min-max normalised score."""
    low, high, score = F.min("score").over(_q()), F.max("score").over(_q()), F.col("score")
    return candidates.select("query_id", "slot_id", "hops", "live", "is_required", score, (F.col("rank") - 1).alias("place"), F.round(high - score, 9).alias("margin"), F.round((score - low) / F.greatest(high - low, F.lit(1e-8)), 9).alias("normalised"))


def learned(found: DataFrame, weights: dict[str, float], top_n: int | None = None) -> DataFrame:
    """features with the selector's probability and whether it takes each; none over one half takes the first."""
    z = F.lit(float(weights["bias"]))
    for name in ("score", "place", "margin", "normalised"):
        z = z + F.col(name) * float(weights[name])
    df = found.withColumn("prob", F.round(sigmoid(z), 9))
    if top_n:
        return df.withColumn("taken", F.row_number().over(_q().orderBy(F.desc("prob"), "place")) <= top_n)
    over = F.col("prob") >= 0.5
    return df.withColumn("taken", over | (~F.bool_or(over).over(_q()) & (F.col("place") == 0)))


def noisy(required: DataFrame, slots: DataFrame, n: int, score: float, seed: int, k: int) -> DataFrame:
    """query_id, pos, slot_id, score and is_required: the required slots (score 1), then n different live others in a fixed mixed order, cut to k.

    Each query draws from a window of the slots' own mixed order, as long as n and its required slots together, so no
    query is paired with all slots and none is left short while there are others. Places in the order are dense ids,
    numbered in buckets of the mixed key. Null query or slot ids take no part.
    """
    mixed = mix(F.col("slot_id"), seed)
    live = slots.where("live and slot_id is not null").select("slot_id").distinct()
    placed = dense_id(live, F.struct(mixed, "slot_id"), F.floor(mixed / 2**17), "nth")
    total = max(live.count(), 1)
    asked = required.groupBy("query_id").agg(F.count_distinct("slot_id").alias("own")).withColumn("start", F.pmod(mix(F.col("query_id"), seed + 1), F.lit(total)))
    tries = asked.withColumn("try", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(total), F.col("own") + n) - 1)))
    tries = tries.withColumn("nth", F.pmod(F.col("start") + F.col("try"), F.lit(total)).cast("int"))
    drawn = tries.join(placed, "nth").join(required.select("query_id", "slot_id"), ["query_id", "slot_id"], "left_anti")
    drawn = drawn.withColumn("d", F.row_number().over(_q().orderBy("try"))).where(F.col("d") <= n)
    own = required.select("query_id", F.lit(0).alias("part"), F.col("pos").alias("at"), "slot_id", F.lit(1.0).alias("score"), F.lit(True).alias("is_required"))
    rows = own.unionByName(drawn.select("query_id", F.lit(1).alias("part"), F.col("d").alias("at"), "slot_id", F.lit(score).alias("score"), F.lit(False).alias("is_required")))
    return rows.withColumn("pos", F.row_number().over(_q().orderBy("part", "at"))).where(F.col("pos") <= k).select("query_id", "pos", "slot_id", "score", "is_required")


def padded(rows: DataFrame, k: int) -> DataFrame:
    """rows(query_id, pos, slot_id, score, is_required) with positions up to k for every query; those without a slot have -1 and minus infinity."""
    every = rows.select("query_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(k))))
    whole = every.join(rows.where(F.col("pos") <= k), ["query_id", "pos"], "left")
    return whole.select("query_id", "pos", F.coalesce("slot_id", F.lit(-1)).alias("slot_id"), F.coalesce("score", F.lit(float("-inf"))).alias("score"), F.coalesce("is_required", F.lit(False)).alias("is_required"))


def sharing_negatives(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Of each row of a unique key as positive: count, least key and key sum of the other rows that share a value of names.

    Rows are counted by each combination of values, and combinations of an even number are taken off again, so the
    work is linear in the rows however many share a value. Null values are not shared; without negatives no row.
    """
    found, k = rows.select(key, *names), F.col(key)
    counts, sums, firsts = [], [], []
    for size in range(1, len(names) + 1):
        for by in map(list, combinations(names, size)):
            n, total, first, second = (f"__{x}_{'_'.join(by)}" for x in ("n", "sum", "first", "second"))
            some = rows.select(key, *by).dropna(subset=by)
            groups = some.groupBy(*by).agg(F.count("*").alias(n), F.sum(key).alias(total), F.min(key).alias(first))
            if size == 1:  # a union's least is the least of its parts; where that is the row itself, the next
                groups = groups.join(some.join(groups, by).where(k != F.col(first)).groupBy(*by).agg(F.min(key).alias(second)), by, "left")
                firsts.append(F.when(k == F.col(first), F.col(second)).otherwise(F.col(first)))
            found, sign = found.join(groups, by, "left"), 1 if size % 2 else -1
            counts.append(sign * F.coalesce(F.col(n), F.lit(0)))
            sums.append(sign * F.coalesce(F.col(total), F.lit(0)))
    plus = lambda columns: reduce(lambda a, b: a + b, columns)
    shares = reduce(lambda a, b: a | b, (F.col(x).isNotNull() for x in names))
    least = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    return found.where(shares).select(k.alias("positive"), (plus(counts) - 1).alias("negatives"), least.alias("first_negative"), (plus(sums) - k).alias("sum_negative")).where("negatives > 0")


def structured_negatives(required: DataFrame, slots: DataFrame, key: str, attributes: list[str], per_positive: int, hard_share: float, seed: int) -> DataFrame:
    """query_id, slot_id, positive, hard and matched: each query's required slots and `per_positive` negatives for each of them.

    A slot that shares an attribute with a required one is a hard candidate; `matched` is the first of the attributes
    that it shares with any of the query's required slots (null for slots that are not hard).
    `hard_share` of the negatives are such, or as many as there are, and the rest are any other slots. Candidates are
    drawn from windows of each attribute value's mixed order, as long as what is wanted and the required slots
    together: a value that many slots share costs no more, and a query gets all it can. slots(key, attributes) are live.
    """
    req = written(required.select("query_id", "slot_id").distinct(), "negatives-required")
    sizes = req.groupBy("query_id").agg(F.count("*").alias("own")).withColumn("total", F.col("own") * per_positive).withColumn("want", F.floor(F.col("total") * hard_share))

    def window(asked: DataFrame, placed: DataFrame, most: Column, turn: int) -> DataFrame:
        """(query_id, try, slot_id) of asked(query_id, first, size, own, ...) from the dense ids first..first+size-1 of placed."""
        start = mix(F.col("query_id"), seed + turn)
        tries = asked.withColumn("try", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("size"), most) - 1)))
        return tries.withColumn("nth", (F.col("first") + F.pmod(start + F.col("try"), F.col("size"))).cast("int")).join(placed, "nth").select("query_id", "try", "slot_id")

    mixed, found = mix(F.col("slot_id"), seed), None
    for name in attributes:
        some = slots.select(F.col(key).alias("slot_id"), F.col(name).alias("v")).where("v is not null")
        placed = dense_id(some, F.struct("v", mixed, "slot_id"), F.struct("v", F.floor(mixed / 2**24)), "nth")
        groups = placed.groupBy("v").agg(F.min("nth").cast("bigint").alias("first"), F.count("*").alias("size"))
        asked = req.join(some, "slot_id").select("query_id", "v").distinct().join(groups, "v").join(sizes, "query_id")
        rows = window(asked, placed.select("nth", "slot_id"), F.col("want") + F.col("own"), 1).select("query_id", "slot_id")
        found = rows if found is None else found.unionByName(rows)
    order = F.row_number().over(_q().orderBy(mix(F.col("query_id"), F.col("slot_id"), seed + 2), "slot_id"))
    hard = found.distinct().join(req, ["query_id", "slot_id"], "left_anti").withColumn("nth", order).join(sizes, "query_id").where("nth <= want").select("query_id", "slot_id")
    hard = written(hard, "negatives-hard")
    counts = sizes.join(hard.groupBy("query_id").agg(F.count("*").alias("n_hard")), "query_id", "left").withColumn("n_hard", F.coalesce("n_hard", F.lit(0)))
    every = mix(F.col("slot_id"), seed + 3)
    placed = dense_id(slots.select(F.col(key).alias("slot_id")), F.struct(every, "slot_id"), F.floor(every / 2**17), "nth")
    asked = counts.withColumn("first", F.lit(0).cast("bigint")).withColumn("size", F.lit(max(slots.count(), 1)))
    rest = window(asked, placed, F.col("total") + F.col("own"), 4).join(req, ["query_id", "slot_id"], "left_anti").join(hard, ["query_id", "slot_id"], "left_anti")
    rest = rest.withColumn("nth", F.row_number().over(_q().orderBy("try"))).join(counts, "query_id").where(F.col("nth") <= F.col("total") - F.col("n_hard"))
    values = lambda df: df.select(*df.columns, F.posexplode(F.array(*(F.col(a).cast("string") for a in attributes))).alias("nth_attribute", "v")).where("v is not null")
    meta = slots.select(F.col(key).alias("slot_id"), *attributes)
    own = values(req.join(meta, "slot_id")).select("query_id", "nth_attribute", "v").distinct()
    first = values(hard.join(meta, "slot_id")).join(own, ["query_id", "nth_attribute", "v"]).groupBy("query_id", "slot_id").agg(F.min("nth_attribute").alias("nth_attribute"))
    named = first.select("query_id", "slot_id", F.element_at(F.array(*(F.lit(a) for a in attributes)), F.col("nth_attribute") + 1).alias("matched"))
    mark = lambda df, positive, is_hard, matched: df.select("query_id", "slot_id", F.lit(positive).alias("positive"), F.lit(is_hard).alias("hard"), matched)
    none = F.lit(None).cast("string").alias("matched")
    return mark(req, True, False, none).unionByName(mark(named, False, True, F.col("matched"))).unionByName(mark(rest, False, False, none))
