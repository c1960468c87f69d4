"""Mixing sources to target weights by temperature, in DataFrame functions only.

Each source's share of all tokens is raised to an exponent between 0 (equal weights) and 1 (as they are); the
exponent is found by bisection so that the weights' entropy reaches a target, and raised where a source would be
repeated more than `most_passes` times. The weights are then realised in tokens: a source's documents are dealt by
hash into blocks, blocks are put into a permuted order that each pass over the source repeats, and documents are
taken in that order until the source's budget of tokens is used; whole passes take every document once each.

The default budget is the smallest with which every source is passed over once whole, so no document is lost; with
a smaller budget a source may be cut. Positions are running sums over blocks, and over the documents of one block;
blocks grow in number with the source, so a source with a third of all rows is no group in any task. Only one row of
totals by source is gathered in one place.

Tokens are words between ASCII white space. A null source is a source of its own; null and empty texts have no
tokens and are passed over as often as their source's whole passes. A source without tokens has one pass. Rows that
repeat a doc_id are rows of their own, in the order of their texts. An empty table gives an empty result. Extra columns are kept by
`mixed` and not read by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Where the target entropy lies between the sources' own (0) and that of equal weights (1).
TOWARDS_EQUAL = 0.25
MOST_PASSES = 4.0
BLOCK_ROWS = 2000
#: Sources up to which their rows (some 100 bytes each) are broadcast; beyond, rows are joined by shuffling.
BROADCAST_SOURCES = 50_000
STEPS = 60
SEED = 20_011


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space, counted without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _entropy(shares: Column, exponent: Column) -> Column:
    powers = F.transform(shares, lambda p: F.pow(p, exponent))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(powers, F.lit(0.0), lambda a, x: a - x / total * F.ln(x / total))


def _weights(shares: Column, exponent: Column) -> Column:
    total = F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.pow(p, exponent))
    return F.transform(shares, lambda p: F.pow(p, exponent) / total)


def _bisect(low_is_enough, side: str) -> Column:
    """The exponent at which low_is_enough(exponent) turns false, in STEPS halvings of [0, 1]; side: low or high."""
    begin = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        enough = low_is_enough(middle)
        return F.struct(F.when(enough, middle).otherwise(acc["low"]).alias("low"), F.when(enough, acc["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step, lambda acc: acc[side])


def weights(totals: DataFrame, towards_equal: float = TOWARDS_EQUAL, most_passes: float = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """source, tokens, weight and target tokens of each source, from totals(source, tokens, docs)."""
    some = F.filter("all", lambda s: s["tokens"] > 0)
    one = totals.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("key"), "source", "tokens", "docs"))).alias("all"))
    one = one.select("all", some.alias("some")).withColumn("total", F.aggregate("some", F.lit(0).cast("bigint"), lambda a, s: a + s["tokens"]))
    one = one.withColumn("shares", F.transform("some", lambda s: s["tokens"] / F.col("total")))
    shares = F.col("shares")
    own, equal = _entropy(shares, F.lit(1.0)), F.ln(F.size(shares).cast("double"))
    one = one.withColumn("target", own + (equal - own) * F.lit(towards_equal))
    one = one.withColumn("by_entropy", _bisect(lambda e: _entropy(shares, e) >= F.col("target"), "low"))

    def passes(e: Column) -> Column:
        """Most passes over a source at this exponent and the budget."""
        ratios = F.zip_with(_weights(shares, e), shares, lambda w, p: w / p)
        scale = F.array_min(ratios) if budget is None else F.col("total") / F.lit(float(budget))
        return F.array_max(ratios) / scale

    one = one.withColumn("by_passes", F.when(passes(F.col("by_entropy")) <= most_passes, F.lit(0.0)).otherwise(_bisect(lambda e: passes(e) > most_passes, "high")))
    one = one.withColumn("exponent", F.greatest("by_entropy", "by_passes"))
    one = one.withColumn("weight", _weights(shares, F.col("exponent")))
    least = F.array_min(F.zip_with("weight", shares, lambda w, p: w / p))
    whole = F.col("total") / least if budget is None else F.lit(float(budget))
    one = one.withColumn("budget", F.when(F.size("some") > 0, whole).otherwise(0.0))
    rows = one.select(F.explode(F.zip_with("some", "weight", lambda s, w: F.struct(s["source"].alias("source"), s["tokens"].alias("tokens"), s["docs"].alias("docs"), w.alias("weight")))).alias("s"), "budget", "exponent")
    full = rows.select("s.*", F.greatest(F.round(F.col("s.weight") * F.col("budget"), 0), F.when(F.lit(budget is None), F.col("s.tokens")).otherwise(0)).cast("bigint").alias("target"), "exponent")
    none = one.select(F.explode(F.filter("all", lambda s: s["tokens"] <= 0)).alias("s")).select("s.source", "s.tokens", "s.docs", F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("target"), F.lit(None).cast("double").alias("exponent"))
    return full.unionByName(none)


def _cuts(light: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each source where its last, partial pass ends: the key of the block it ends in, and the last row it takes there."""
    rows = light.join(chosen, F.col("source").eqNullSafe(F.col("c_source"))).withColumn("block", _block()).withColumn("block_key", _block_key())
    blocks = rows.groupBy("c_source", "block", "block_key", "rest").agg(F.sum("n_tokens").alias("sum"))
    running = F.sum("sum").over(Window.partitionBy("c_source").orderBy("block_key", "block"))
    ends = blocks.withColumn("before", running - F.col("sum")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")))
    ends = ends.groupBy("c_source").agg(F.min(F.struct("block_key", "block", "before")).alias("end"))
    last = rows.join(ends.withColumnRenamed("c_source", "e_source"), F.col("c_source").eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("end.block")))
    taken = F.sum("n_tokens").over(Window.partitionBy("c_source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("place", _place()).withColumn("taken", taken)
    inside = last.where(F.col("taken") <= F.col("rest") - F.col("end.before")).groupBy("c_source").agg(F.max("place").alias("cut"))
    return ends.join(inside.withColumnRenamed("c_source", "i_source"), F.col("c_source").eqNullSafe(F.col("i_source")), "left").select(F.col("c_source").alias("k_source"), "end", "cut")


def _block() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("blocks"))


def _block_key() -> Column:
    return F.xxhash64("block", "c_source", F.lit(SEED))


def _place() -> Column:
    return F.struct(F.xxhash64("doc_id", F.lit(SEED + 1)).alias("h"), F.col("doc_id"), F.col("text_key"))


def _chosen(light: DataFrame, towards_equal: float, most_passes: float, budget: int | None) -> DataFrame:
    """One row a source: its weight, blocks, whole passes and the end of its partial pass."""
    totals = light.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    passes = F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(1)
    chosen = weights(totals, towards_equal, most_passes, budget)
    chosen = chosen.select(F.col("source").alias("c_source"), "weight", passes.alias("passes"), (F.col("target") - passes * F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_ROWS)).cast("bigint").alias("blocks"))
    chosen = stored(chosen.withColumn("rest", F.greatest("rest", F.lit(0))), "mixing-weights")
    return stored(chosen.join(_cuts(light, chosen), F.col("c_source").eqNullSafe(F.col("k_source")), "left").drop("k_source"), "mixing-plan")


def _light(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("text_key"))


def _planned(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows(doc_id, source, text_key, ...) with weight, block, block_key and copies; the sources' rows are broadcast if they are few."""
    few = chosen.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(chosen) if few else chosen, F.col("source").eqNullSafe(F.col("c_source"))).withColumn("block", _block()).withColumn("block_key", _block_key())
    before = F.struct("block_key", "block") < F.struct("end.block_key", "end.block")
    inside = (F.col("block") == F.col("end.block")) & F.col("cut").isNotNull() & (_place() <= F.col("cut"))
    return rows.withColumn("copies", F.col("passes") + F.when(F.col("end").isNotNull() & (before | inside), 1).otherwise(0)).drop("c_source", "passes", "rest", "blocks", "end", "cut")


def plan(docs: DataFrame, towards_equal: float = TOWARDS_EQUAL, most_passes: float = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, block_key (blocks are passed over in its order) and copies of each row."""
    light = stored(_light(docs), "mixing-rows")
    return _planned(light, _chosen(light, towards_equal, most_passes, budget)).drop("text_key")


def mixed(docs: DataFrame, towards_equal: float = TOWARDS_EQUAL, most_passes: float = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """docs, each row as often as the mixture has it."""
    columns = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    chosen = _chosen(stored(_light(docs), "mixing-rows"), towards_equal, most_passes, budget)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), "doc_id", "source", F.xxhash64("text").alias("text_key"))
    return _planned(rows, chosen).where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*columns)
