"""Multi-hop chains over the triples, examples from templates, and their splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mix
from ..session import written

#: Task types by the kind of their first subject and the kinds that the hops lead through.
PATHS = {
    "single_fact_recall": ("supplier", "nation"),
    "two_hop_reasoning": ("customer", "nation", "region"),
    "three_hop_reasoning": ("order", "customer", "nation", "region"),
    "api_usage_reasoning": ("line", "supplier", "nation"),
}
TEMPLATES = ("which {answer} belongs to {subject} ?", "where does {subject} lead ?", "name the {answer} of {subject} .")


def kind(key: Column) -> Column:
    return F.regexp_extract(key, "^([a-z]+)_", 1)


def chain(facts: DataFrame, task: str) -> DataFrame:
    """task_type, hops, subject, path (all keys in order) and answer of each chain of one task; one equi-join a hop."""
    names = PATHS[task]
    steps = facts.select("subject", "object").where(kind(F.col("subject")) == names[0]).where(kind(F.col("object")) == names[1])
    found = steps.select(F.col("subject"), F.array("subject", "object").alias("path"), F.col("object").alias("at"))
    for name in names[2:]:
        step = facts.where(kind(F.col("object")) == name).select(F.col("subject").alias("at"), F.col("object").alias("next")).distinct()
        found = found.join(step, "at").select("subject", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at"))
    return found.select(F.lit(task).alias("task_type"), F.lit(len(names) - 1).alias("hops"), "subject", "path", F.col("at").alias("answer"))


def all_chains(facts: DataFrame, parts: DataFrame) -> DataFrame:
    """Chains of all task types; lines lead to brands by parts(subject, path, answer)."""
    out = parts.select(F.lit("code_symbol_reasoning").alias("task_type"), F.lit(2).alias("hops"), "subject", "path", "answer")
    for task in PATHS:
        out = out.unionByName(chain(facts, task))
    return out


def examples(chains: DataFrame, repeats: int) -> DataFrame:
    """A question for each chain and template; of equal (question, answer) at most `repeats`, in the order of subjects."""
    spark = chains.sparkSession
    templates = spark.createDataFrame(list(enumerate(TEMPLATES)), "template int, words string")
    subject = F.element_at("path", -2)
    question = F.replace(F.replace(F.col("words"), F.lit("{answer}"), kind(F.col("answer"))), F.lit("{subject}"), subject)
    found = chains.crossJoin(F.broadcast(templates)).select("task_type", "hops", "subject", "template", question.alias("question"), "answer")
    order = Window.partitionBy("question", "answer").orderBy("subject")
    return found.withColumn("repeat", F.row_number().over(order)).where(F.col("repeat") <= repeats)


def split_of(key: Column) -> Column:
    """train, val or test by a fixed mix of a numeric key: 8, 1 and 1 of ten."""
    place = mix(key) % 10
    return F.when(place < 8, "train").when(place == 8, "val").otherwise("test")


def split_overlap(asked: DataFrame) -> DataFrame:
    """Of asked(split, question): the distinct questions of each pair of splits, and how many they share."""
    own = asked.select("split", "question").distinct()
    sizes = own.groupBy("split").agg(F.count("*").alias("n"))
    a, b = own.select(F.col("split").alias("split_a"), "question"), own.select(F.col("split").alias("split_b"), "question")
    common = a.join(b, "question").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("common"))
    pairs = sizes.select(F.col("split").alias("split_a"), F.col("n").alias("n_a")).join(sizes.select(F.col("split").alias("split_b"), F.col("n").alias("n_b")), F.col("split_a") < F.col("split_b"))
    return pairs.join(common, ["split_a", "split_b"], "left").select("split_a", "split_b", "n_a", "n_b", F.coalesce("common", F.lit(0)).cast("bigint").alias("common"))


#: Facts up to which a hop sends them to every task; beyond, its keys are many and are joined by shuffling.
BROADCAST_FACTS = 200_000


def walk(facts: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Iterative retrieval: each hop looks up the facts whose subject is the target found before; keeps a key's first hop.

    Many starts can meet in few keys, whose rows would all go to a few tasks: so a later hop's facts are taken first, and
    are broadcast where they are few. Each hop's frontier is written, so that it is found once.
    """
    frontier = starts.select(F.col("subject").alias("start"), F.col("subject").alias("at"))
    steps = written(facts.select(F.col("subject").alias("at"), "object").distinct(), "steps")
    found = None
    for hop in range(1, hops + 1):
        near = steps
        if hop > 1:
            met = steps.join(frontier.select("at").distinct(), "at", "left_semi")
            near = F.broadcast(met) if met.limit(BROADCAST_FACTS + 1).count() <= BROADCAST_FACTS else steps
        frontier = written(frontier.join(near, "at").select("start", F.col("object").alias("at")).distinct(), f"walk-{hop}")
        step = frontier.select("start", F.lit(hop).alias("hop"), F.col("at").alias("reached"))
        found = step if found is None else found.unionByName(step)
    return found.groupBy("start", "reached").agg(F.min("hop").alias("hop"))
