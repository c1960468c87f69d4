"""A generated data set on disk: python -m slotwise.sources.generated PATH --tables DIR [--train N] [--val N] [--test N] [--chains N] [--seed N] [--separation S]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slot_name
from ..operators import generate, kb
from ..operators.text import build_vocab
from ..session import ready
from .tables import table, write_jsonl, write_meta, write_vocab


def star_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The words that names are made of: of suppliers' names, and of parts' types."""
    nouns = table(spark, sf_dir, "supplier").select(F.regexp_replace("s_name", "[^A-Za-z0-9]+", "_").alias("word"))
    return nouns, table(spark, sf_dir, "part").select(F.lower("p_type").alias("word"))


def write_dataset(spark: SparkSession, path: str, names: tuple[DataFrame, DataFrame], chains: int, sizes: dict[str, int], seed: int, separation: str = "soft") -> None:
    """Facts, one folder of examples for each split, the vocabulary and a description below path; each split draws from its own chains.

    names: nouns(word) and verbs(word). Chains are dealt to splits as 8 : 1 : 1.
    """
    i = F.col("id")
    pool = generate.chains(ready(spark).range(chains).select(i.alias("chain_id"), generate.split_of(i).alias("split")), *names, seed, separation)
    text = F.explode("facts").alias("text")
    facts = pool.select(text).distinct().select("text", F.element_at(F.split("text", " "), 1).alias("subject"), F.element_at(F.split("text", " "), -2).alias("embedding_target"))
    slots = kb.numbered(facts)
    write_jsonl(slots, f"{path}/kb")
    ids = slots.select(F.col("text").alias("fact"), slot_name(F.col("slot_id")).alias("slot"))
    splits = {}
    for split, n in sizes.items():
        drawn = generate.examples(pool, spark.range(n).select(i.alias("example_id"), F.lit(split).alias("split")), seed)
        at = drawn.select("example_id", F.posexplode("facts").alias("at", "fact")).join(ids, "fact")
        required = at.groupBy("example_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "slot"))), lambda r: r["slot"]).alias("required_slots"))
        splits[split] = drawn.join(required, "example_id").select("question", "answer", F.col("answer").alias("answer_token"), "facts", "required_slots", F.col("hops").alias("reasoning_hops"), "task_type", "split")
        write_jsonl(splits[split], f"{path}/{split}")
    texts = slots.select("text")
    for rows in splits.values():
        texts = texts.unionByName(rows.select(F.concat_ws(" ", "question", "answer").alias("text")))
    write_vocab(build_vocab(texts), f"{path}/vocab")
    write_meta(spark, f"{path}/meta", {"seed": seed, "chains": chains, "examples": sizes, "separation": separation, "hops": dict(zip(generate.TASKS, generate.HOPS, strict=True))})


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("path")
    for name, n in (("train", 8000), ("val", 1000), ("test", 1000), ("chains", 4000), ("seed", 42)):
        parser.add_argument(f"--{name}", type=int, default=n)
    parser.add_argument("--tables", required=True, help="folder of the supplier and part tables, whose names are used")
    parser.add_argument("--separation", choices=generate.SEPARATIONS, default="soft")
    given = vars(parser.parse_args(arguments))
    sizes = {split: given[split] for split in ("train", "val", "test")}
    spark = SparkSession.builder.getOrCreate()
    write_dataset(spark, given["path"], star_names(spark, given["tables"]), given["chains"], sizes, given["seed"], given["separation"])


if __name__ == "__main__":
    main()
