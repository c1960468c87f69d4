"""Invented facts and questions about names of a given relation: pools of names, chains of facts, and examples.

Everything is a function of an id, a seed and a round. What repeats is drawn again in the next round, at most `ROUNDS`
times, and each round is written before the next one starts, so pools come out full where the names allow it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text import ranged_id

# The task types, in the order in which they take turns.
TASKS = ("single_fact_recall", "two_hop_reasoning", "three_hop_reasoning", "api_usage_reasoning", "code_symbol_reasoning")
#: What a chain of each task goes through, kind by kind, with the relation to the next one.
PATHS = (
    ("kit", "holds", "part"),
    ("kit", "holds", "part", "fits", "frame"),
    ("depot", "stocks", "kit", "holds", "part", "fits", "frame"),
    ("counter", "takes", "slip", "bears", "stamp"),
    ("press", "jams_at", "gear", "lights", "lamp"),
)
HOPS = tuple(len(path) // 2 for path in PATHS)
#: Two ways of asking for the end of each task's chain by its start.
QUESTIONS = (
    ("look into {s} : which part is there ?", "{s} holds something , name it ."),
    ("open {s} and say which frame its part is for .", "find the frame that suits the contents of {s} ."),
    ("from {s} go on to kit , part and frame : where do you end ?", "{s} has a kit , and its part fits where ?"),
    ("a clerk at {s} looks for a stamp : which ?", "hand in a slip at {s} : what is printed on it ?"),
    ("{s} stands still : which lamp is on ?", "name the lamp that tells of a jam in {s} ."),
)
SEPARATIONS = ("soft", "hard", "none")
#: The share of a pool that is for train and val where test has names of its own.
SHARE = 0.7
#: How often the same question about the same chain may stand in train; elsewhere once.
TRAIN_REPEATS = 5
ROUNDS = 20
WORDS = 4


def cut(n: int) -> int:
    """So many of n names are for train and val; both sides have one at least, where there are two."""
    return max(1, min(n - 1, int(SHARE * n + 0.5))) if n > 1 else n


def drawn(n: int | Column, *key: Column | int) -> Column:
    """A place below n by the first digits of a key's MD5: any SQL engine computes it alike, and keys next to each other are not."""
    digits = F.substring(F.md5(F.concat_ws("-", *((F.lit(k) if isinstance(k, int) else k).cast("string") for k in key)).cast("binary")), 1, 7)
    return F.shiftright(F.conv(digits, 16, 10).cast("bigint") * n, 28)


def split_of(i: Column) -> Column:
    return F.when(i % 10 == 8, "val").when(i % 10 == 9, "test").otherwise("train")


def placed(names: DataFrame) -> DataFrame:
    """place (from 0, in the order of words) and word of the different words of names(word)."""
    return ranged_id(names.where("word is not null").select("word").distinct(), "word", "place").select("place", "word")


def pools(names: DataFrame, separation: str, kind: str) -> DataFrame:
    """word and the pool that it is in: `both`, `train` (and val) or `test`. Under `soft` nouns are apart, under `hard` verbs too."""
    if separation not in SEPARATIONS:
        raise ValueError(f"unknown separation {separation}")
    rows = written(placed(names), "names")
    if not _apart(separation, kind):
        return rows.select("word", F.lit("both").alias("pool"))
    return rows.select("word", F.when(F.col("place") < cut(rows.count()), "train").otherwise("test").alias("pool"))


def _apart(separation: str, kind: str) -> bool:
    return separation == "hard" or (separation == "soft" and kind == "noun")


def _place(n: int, apart: bool, *key: Column | int) -> Column:
    if not apart or n < 2:
        return drawn(n, *key)
    return F.when(F.col("split") == "test", drawn(n - cut(n), *key) + cut(n)).otherwise(drawn(cut(n), *key))


def _of_task(values: list[Column]) -> Column:
    return F.coalesce(*(F.when(F.col("task") == t, v) for t, v in enumerate(values)))


def _linked(rows: DataFrame) -> DataFrame:
    """rows(chain_id, split, task, verb, w0, ...) as chains."""
    def name(task: int, k: int) -> Column:
        kind = PATHS[task][2 * k]
        return F.concat_ws("_", "verb", F.lit(kind), "w0") if k == 0 else F.concat_ws("_", F.lit(kind), f"w{k}")

    facts = [F.array(*(F.concat_ws(" ", name(t, k), F.lit(path[2 * k + 1]), name(t, k + 1), F.lit(".")) for k in range(HOPS[t]))) for t, path in enumerate(PATHS)]
    return rows.select(
        "chain_id", "split", F.element_at(F.array(*map(F.lit, TASKS)), F.col("task") + 1).alias("task_type"), F.element_at(F.array(*map(F.lit, HOPS)), F.col("task") + 1).alias("hops"),
        _of_task(facts).alias("facts"), _of_task([name(t, 0) for t in range(len(TASKS))]).alias("subject"), _of_task([name(t, HOPS[t]) for t in range(len(TASKS))]).alias("answer"), "task",
    )


def chains(ids: DataFrame, nouns: DataFrame, verbs: DataFrame, seed: int, separation: str = "soft") -> DataFrame:
    """chain_id, split, task_type, hops, facts, subject, answer and task of each of ids(chain_id, split); no two have equal facts.

    nouns(word) and verbs(word) are the names' words. A chain whose facts an accepted one has, or one of a smaller id
    in the same round, is drawn again.
    """
    if separation not in SEPARATIONS:
        raise ValueError(f"unknown separation {separation}")
    nouns, verbs = written(placed(nouns), "nouns"), written(placed(verbs), "verbs")
    n, m = nouns.count(), verbs.count()
    missing = ids.select("chain_id", "split", (F.floor(F.col("chain_id") / 10) % len(TASKS)).cast("int").alias("task")).where("chain_id is not null")
    accepted = None
    for turn in range(ROUNDS if n and m else 1):
        words = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), _place(n, _apart(separation, "noun"), F.col("chain_id"), seed, j, turn).alias("place")) for j in range(WORDS)))).alias("w")
        verb = _place(m, _apart(separation, "verb"), F.col("chain_id"), seed, WORDS, turn).cast("int").alias("verb_place")
        spelled = missing.select("chain_id", "split", "task", verb, words).select("chain_id", "split", "task", "verb_place", "w.j", F.col("w.place").cast("int").alias("place")).join(nouns, "place")
        spelled = spelled.groupBy("chain_id", "split", "task", "verb_place").agg(*(F.max(F.when(F.col("j") == j, F.col("word"))).alias(f"w{j}") for j in range(WORDS)))
        found = _linked(spelled.join(verbs.select(F.col("place").alias("verb_place"), F.col("word").alias("verb")), "verb_place"))
        if accepted is not None:
            found = found.join(accepted.select("facts"), "facts", "left_anti").select(*accepted.columns)
        first = F.row_number().over(Window.partitionBy("facts").orderBy("chain_id"))
        new = written(found.withColumn("nth", first).where("nth = 1").drop("nth"), "chains")
        accepted = new if accepted is None else accepted.unionByName(new)
        missing = written(missing.join(new.select("chain_id"), "chain_id", "left_anti"), "chains-left")
        if missing.isEmpty():
            break
    return accepted


def examples(pool: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """example_id of each of ids(example_id, split) with a chain of its split from the pool and a question about it.

    A question about a chain stands in train TRAIN_REPEATS times at most, elsewhere once; further draws of it are
    drawn again. Splits without chains have no examples.
    """
    placed = ranged_id(pool.withColumn("at", F.struct("split", "chain_id")), "at", "place")
    places = written(placed.select("place", *pool.columns), "chain-places")
    sizes = places.groupBy("split").agg(F.min("place").cast("bigint").alias("first"), F.count("*").alias("size"))  # a row a split
    missing, most, taken = ids.select("example_id", "split").where("example_id is not null").join(F.broadcast(sizes.select("split")), "split", "left_semi"), F.when(F.col("split") == "train", TRAIN_REPEATS).otherwise(1), []
    for turn in range(ROUNDS):
        place = F.col("first") + drawn(F.col("size"), F.col("example_id"), seed, 1, turn)
        tried = missing.join(F.broadcast(sizes), "split").select("example_id", "split", place.cast("int").alias("place"), drawn(2, F.col("example_id"), seed, 2, turn).cast("int").alias("template"))
        nth = F.row_number().over(Window.partitionBy("place", "template").orderBy("example_id"))
        if taken:
            held = reduce(DataFrame.unionByName, taken).groupBy("place", "template").agg(F.count("*").alias("held"))
            tried = tried.join(held, ["place", "template"], "left")
            nth = nth + F.coalesce("held", F.lit(0))
        new = written(tried.withColumn("nth", nth).where(F.col("nth") <= most).select("example_id", "place", "template"), "examples")
        taken.append(new)
        missing = written(missing.join(new.select("example_id"), "example_id", "left_anti"), "examples-left")
        if missing.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, taken).join(places, "place")
    asked = F.coalesce(*(F.when((F.col("task") == t) & (F.col("template") == j), F.lit(q)) for t, forms in enumerate(QUESTIONS) for j, q in enumerate(forms)))
    return rows.withColumn("question", F.replace(asked, F.lit("{s}"), F.col("subject"))).drop("place", "task")
