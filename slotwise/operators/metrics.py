"""Metrics of ranked retrieval, selection and prediction as long relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOP_NAMES = {1: "single_hop", 2: "two_hop", 3: "three_hop"}


def _ks(ks: tuple[int, ...]) -> Column:
    return F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")


def required_counts(required: DataFrame, ranked: DataFrame, meta: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """query_id, hops, k, and how many slots the query requires and how many of them are in its first k."""
    first = ranked.groupBy("query_id", "slot_id").agg(F.min("rank").alias("rank"))
    found = required.select("query_id", "slot_id").distinct().join(first, ["query_id", "slot_id"], "left")
    at = found.select("query_id", "rank", _ks(ks)).groupBy("query_id", "k").agg(F.count("*").alias("n_required"), F.count_if(F.col("rank") <= F.col("k")).alias("n_found"))
    every = meta.select("query_id", "hops", _ks(ks))
    return every.join(at, ["query_id", "k"], "left").select("query_id", "hops", "k", F.coalesce("n_required", F.lit(0)).alias("n_required"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def recall_at(counts: DataFrame) -> DataFrame:
    """k, queries that require anything, and the share of them with any required slot in the first k."""
    some = counts.where("n_required > 0")
    return some.groupBy("k").agg(F.count("*").alias("queries"), F.round(F.avg((F.col("n_found") > 0).cast("int")), 6).alias("recall"))


def required_set(counts: DataFrame) -> DataFrame:
    """k, hops (-1: all), examples, any, all, coverage and mean counts; queries without required slots count as misses."""
    got, want = F.col("n_found"), F.col("n_required")
    rows = counts.select("hops", "k", "n_found", "n_required", (got > 0).cast("int").alias("is_any"), ((want > 0) & (got == want)).cast("int").alias("is_all"))
    sets = rows.groupingSets([["k"], ["k", "hops"]], "k", "hops").agg(
        F.count("*").alias("examples"),
        F.round(F.avg("is_any"), 6).alias("any_required"),
        F.round(F.avg("is_all"), 6).alias("all_required"),
        F.round(F.sum("n_found") / F.greatest(F.sum("n_required"), F.lit(1)), 6).alias("coverage"),
        F.round(F.avg("n_required"), 6).alias("mean_required"),
        F.round(F.avg("n_found"), 6).alias("mean_found"),
        F.round(F.avg(want - got), 6).alias("mean_missing"),
        F.grouping("hops").alias("g"),
    )
    return sets.withColumn("hops", F.when(F.col("g") == 1, -1).otherwise(F.col("hops"))).drop("g")


def rank_metrics(required: DataFrame, ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, MRR of the best required slot, mean rank of the first, second and third best, and of the worst; a miss ranks k + 1."""
    first = ranked.groupBy("query_id", "slot_id").agg(F.min("rank").alias("rank"))
    at = required.select("query_id", "slot_id").join(first, ["query_id", "slot_id"], "left").select("query_id", "rank", _ks(ks))
    each = at.groupBy("query_id", "k").agg(F.sort_array(F.collect_list(F.when(F.col("rank") <= F.col("k"), F.col("rank")).otherwise(F.col("k") + 1))).alias("r"))
    nth = lambda i: F.round(F.avg(F.get("r", F.lit(i))), 6)
    return each.groupBy("k").agg(F.round(F.avg(F.lit(1.0) / F.get("r", F.lit(0))), 6).alias("mrr"), nth(0).alias("mean_first"), nth(1).alias("mean_second"), nth(2).alias("mean_third"), F.round(F.avg(F.element_at("r", -1)), 6).alias("mean_worst"))


def failure_type(counts: DataFrame) -> DataFrame:
    """query_id and why its required set was or was not retrieved; counts at k = 8, 32 and 64."""
    at = lambda k, c: F.max(F.when(F.col("k") == k, c))
    whole = (F.col("n_required") > 0) & (F.col("n_found") == F.col("n_required"))
    flat = counts.groupBy("query_id").agg(F.max("n_required").alias("n"), at(8, whole).alias("a8"), at(32, whole).alias("a32"), at(64, whole).alias("a64"), at(64, F.col("n_found") > 0).alias("y64"))
    kind = F.when(F.col("n") == 0, "no_required_slots").when(F.col("a8"), "none_all_present").when(F.col("a32"), "ranked_too_low").when(F.col("a64"), "ranked_beyond_64").when(F.col("y64"), "missing_required_slot").otherwise("no_required_in_top64")
    return flat.select("query_id", kind.alias("failure_type"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value and their percentage of all."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counted.select(key, "n", F.round(F.col("n") * 100.0 / total, 6).alias("percent"))


def selector_micro(selected: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 over all rows of selected(taken, is_required)."""
    tp, fp, fn = (F.count_if(c) for c in (F.col("taken") & F.col("is_required"), F.col("taken") & ~F.col("is_required"), ~F.col("taken") & F.col("is_required")))
    one = selected.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    one = one.withColumn("p", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("r", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    return one.select("tp", "fp", "fn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-8)), 6).alias("f1"))


def selector_macro(selected: DataFrame, required: DataFrame) -> DataFrame:
    """Per-query precision, recall and F1 averaged over queries that require slots, with the selection's mean counts."""
    taken = selected.where("taken").select("query_id", "slot_id").distinct()
    want = required.select("query_id", "slot_id").distinct()
    hit = taken.join(want, ["query_id", "slot_id"]).groupBy("query_id").agg(F.count("*").alias("tp"))
    each = want.groupBy("query_id").agg(F.count("*").alias("n")).join(taken.groupBy("query_id").agg(F.count("*").alias("s")), "query_id", "left").join(hit, "query_id", "left").na.fill(0, ["s", "tp"])
    each = each.withColumn("p", F.col("tp") / F.greatest("s", F.lit(1))).withColumn("r", F.col("tp") / F.col("n"))
    each = each.withColumn("f", 2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-8)))
    mean = lambda c: F.round(F.avg(c), 6)
    return each.agg(
        mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), mean("s").alias("selected"), mean("tp").alias("selected_required"), mean(F.col("s") - F.col("tp")).alias("selected_distractors"),
        mean((F.col("tp") == F.col("n")).cast("int")).alias("all_present"), F.round(F.sum("tp") / F.greatest(F.sum("n"), F.lit(1)), 6).alias("coverage"), F.round((F.sum("s") - F.sum("tp")) / F.greatest(F.sum("s"), F.lit(1)), 6).alias("distractor_rate"),
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    """scope (overall, a hop's name or a task type), n and accuracy of predictions(hops, task_type, predicted, gold)."""
    right = predictions.select("hops", "task_type", (F.col("predicted") == F.col("gold")).cast("int").alias("right"))
    sets = right.groupingSets([[], ["hops"], ["task_type"]], "hops", "task_type").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"), F.grouping("hops").alias("gh"), F.grouping("task_type").alias("gt"))
    hop = F.coalesce(F.get(F.array(*(F.lit(n) for n in HOP_NAMES.values())), F.col("hops") - 1), F.concat(F.lit("hop_"), F.col("hops").cast("string")))
    scope = F.when((F.col("gh") == 1) & (F.col("gt") == 1), "overall").when(F.col("gh") == 0, hop).otherwise(F.col("task_type"))
    return sets.select(scope.alias("scope"), "n", "accuracy")


def derived(variants: DataFrame) -> DataFrame:
    """oracle_gap, memory_gain and dense_gap of each scope, from variants(variant, scope, accuracy); a missing variant counts 0."""
    of = lambda v: F.coalesce(F.max(F.when(F.col("variant") == v, F.col("accuracy"))), F.lit(0.0))
    return variants.groupBy("scope").agg(F.round(of("oracle") - of("retrieved"), 6).alias("oracle_gap"), F.round(of("retrieved") - of("core"), 6).alias("memory_gain"), F.round(of("retrieved") - of("dense"), 6).alias("dense_gap"))


def gates(variants: DataFrame, recall8: Column, least_recall: float = 0.8, most_gap: float = 0.2) -> DataFrame:
    """gate and passed of the five decisions, from variants(variant, scope, accuracy)."""
    of = lambda v, s: F.coalesce(F.max(F.when((F.col("variant") == v) & (F.col("scope") == s), F.col("accuracy"))), F.lit(0.0))
    names = {"o": ("oracle", "overall"), "c": ("core", "overall"), "r": ("retrieved", "overall"), "d": ("dense", "overall"), "o1": ("oracle", "single_hop"), "o2": ("oracle", "two_hop"), "o3": ("oracle", "three_hop")}
    one = variants.agg(*(of(*at).alias(n) for n, at in names.items()), F.max(recall8).alias("r8"))
    c = F.col
    tests = [c("r8") >= least_recall, c("o") > c("c"), F.round(c("o") - c("r"), 9) <= most_gap, (c("o2") > c("o1") * 0.5) & (c("o3") > c("o1") * 0.15), c("r") > c("d")]
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("gate"), F.coalesce(t, F.lit(False)).alias("passed")) for i, t in enumerate(tests, 1)))).alias("g")).select("g.*")


def running_best(log: DataFrame, key: str, order: list[str], value: str, bucket: Column) -> DataFrame:
    """The records of each run that beat all before them; bucket must not fall as order rises.

    A run's buckets are few and have their best values compared first; only the rows that beat the best of all buckets
    before their own are ranked, bucket by bucket, so no task holds a run. Null values are no records and beat nothing.
    """
    rows = log.where(F.col(value).isNotNull()).withColumn("__bucket", bucket)
    best = rows.groupBy(key, "__bucket").agg(F.max(value).alias("__best"))
    earlier = F.max("__best").over(Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    best = best.select(F.col(key).alias("__key"), F.col("__bucket").alias("__b"), earlier.alias("__floor"))
    high = rows.join(best, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__b"))).where(F.col("__floor").isNull() | (F.col(value) > F.col("__floor")))
    inside = F.max(value).over(Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return high.withColumn("__before", inside).where(F.col("__before").isNull() | (F.col(value) > F.col("__before"))).select(*log.columns)


def learning_rate(step: Column, warmup: int, total: int) -> Column:
    """The factor of a cosine schedule with linear warm-up."""
    along = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(F.greatest(F.lit(0.0), (F.lit(1.0) + F.cos(F.pi() * along)) * 0.5))


def weighted_mean(batches: DataFrame, loss: str, size: str) -> DataFrame:
    """batches, rows and the mean of the batches' losses weighted by their sizes."""
    return batches.agg(F.count("*").alias("batches"), F.sum(size).alias("rows"), F.round(F.sum(F.col(loss) * F.col(size)) / F.sum(size), 6).alias("loss"))


def mean_of_batch_means(rows: DataFrame, batch: Column, value: str) -> DataFrame:
    each = rows.groupBy(batch.alias("batch")).agg(F.avg(value).alias("mean"))
    return each.agg(F.count("*").alias("batches"), F.round(F.avg("mean"), 6).alias("mean"))


def parameter_count(parameters: DataFrame) -> DataFrame:
    """names, tensors and the numbers in them, of parameters(name, tensor, numel): a tensor under several names counts once."""
    each = parameters.groupBy("tensor").agg(F.max("numel").alias("numel"), F.count("*").alias("names"))
    return each.agg(F.sum("names").alias("names"), F.count("*").alias("tensors"), F.sum("numel").alias("parameters"))


def by_mode(required: DataFrame, ranked: DataFrame, ks: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """Of required(query_id, slot_id) and ranked(mode, query_id, rank, slot_id): the metrics of each mode and k, and why queries of each mode fail."""
    first = ranked.groupBy("mode", "query_id", "slot_id").agg(F.min("rank").alias("rank"))
    modes = ranked.select("mode").distinct()
    wanted = required.select("query_id", "slot_id").distinct().crossJoin(F.broadcast(modes))
    ranks = F.sort_array(F.collect_list(F.coalesce("rank", F.lit(2**31 - 1))))
    each = wanted.join(first, ["mode", "query_id", "slot_id"], "left").groupBy("mode", "query_id").agg(ranks.alias("r"))
    got = lambda k: F.size(F.filter("r", lambda x: x <= k))
    miss = lambda x: F.when(x <= F.col("k"), x).otherwise(F.col("k") + 1)
    at = each.select("mode", "query_id", "r", _ks(ks)).withColumn("got", got(F.col("k"))).withColumn("n", F.size("r"))
    mean = lambda c: F.round(F.avg(c), 6)
    report = at.groupBy("mode", "k").agg(
        F.count("*").alias("examples"), mean((F.col("got") > 0).cast("int")).alias("any_required"), mean((F.col("got") == F.col("n")).cast("int")).alias("all_required"), F.round(F.sum("got") / F.sum("n"), 6).alias("coverage"),
        mean(F.lit(1.0) / miss(F.get("r", F.lit(0)))).alias("mrr"), mean(miss(F.element_at("r", -1))).alias("mean_worst"),
    )
    whole = lambda k: got(k) == F.size("r")
    kind = F.when(whole(8), "none_all_present").when(whole(32), "ranked_too_low").when(whole(64), "ranked_beyond_64").when(got(64) > 0, "missing_required_slot").otherwise("no_required_in_topk")
    counted = each.groupBy("mode", kind.alias("failure_type")).agg(F.count("*").alias("n"))
    return report, counted.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("mode")), 6))


def staged(rows: DataFrame, epoch: str, lengths: tuple[int, ...]) -> DataFrame:
    """rows with the curriculum stage of each epoch (from 0): stages last `lengths` epochs, one after the other, the last one for good."""
    ends = [sum(lengths[: i + 1]) for i in range(len(lengths) - 1)]
    stage = F.lit(0)
    for end in ends:
        stage = stage + F.when(F.col(epoch) >= end, 1).otherwise(0)
    return rows.withColumn("stage", stage)
