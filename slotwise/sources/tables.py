"""Reading and writing relations: Parquet tables, JSON lines, vocabularies, metric logs, run folders."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ready

KB_SCHEMA = "slot_id int, text string, embedding_target string, subject string"
FACT = "struct<slot_id:string,text:string,embedding_target:string,subject:string>"
EXAMPLE_SCHEMA = f"facts array<{FACT}>, question string, answer string, answer_token string, required_slots array<string>, addressable_slots array<string>, distractor_tokens array<string>, reasoning_hops int, task_type string, split string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines of a declared schema; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """vocab(token, id) from a JSON object of token to id."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """The vocabulary as one JSON object, an entry a line in the order of ids: one file, written row by row."""
    entry = F.concat(F.lit(","), F.regexp_extract(F.to_json(F.create_map("token", "id")), r"(?s)^\{(.*)\}$", 1))
    spark = vocab.sparkSession
    first = vocab.agg(F.min("id").alias("least")).first().least
    lines = vocab.select("id", F.when(F.col("id") == first, F.substr(entry, F.lit(2))).otherwise(entry).alias("value"))
    ends = spark.createDataFrame([(-1, "{"), (2**31 - 1, "}")], "id int, value string")
    lines.unionByName(ends).orderBy("id").select("value").coalesce(1).write.text(path)


def write_meta(spark: SparkSession, path: str, meta: Mapping[str, Any]) -> None:
    """A data set's description as one JSON object."""
    spark.createDataFrame([(json.dumps(dict(meta), ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def log_metrics(spark: SparkSession, path: str, step: int, wall_s: float, metrics: Mapping[str, Any]) -> None:
    """One record appended to a metric log."""
    row = json.dumps({"step": step, "wall_s": round(wall_s, 3), **metrics})
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """step, wall_s and the other keys as a map, whatever keys each record has."""
    text = spark.read.text(path)
    numbers = F.map_filter(F.from_json("value", "map<string,double>"), lambda k, v: ~k.isin("step", "wall_s") & v.isNotNull())
    return text.select(F.get_json_object("value", "$.step").cast("bigint").alias("step"), F.get_json_object("value", "$.wall_s").cast("double").alias("wall_s"), numbers.alias("metrics"))


def preferred_runs(files: DataFrame) -> DataFrame:
    """files(path): of each folder the checkpoint to use; best before last before plain, then by name."""
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    priority = F.when(name.contains("best"), 0).when(name.contains("last"), 1).otherwise(2)
    order = Window.partitionBy("folder").orderBy("priority", "name")
    found = files.select(folder.alias("folder"), name.alias("name"), priority.alias("priority"))
    return found.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


#: What a run's name says of its mode, the more telling words first; and of its kind of model.
MODE_WORDS = (
    ("oracle_text", "oracle_text_memory"), ("retrieved_oracle", "retrieved_oracle_slots"), ("external_text", "retrieved_memory_external_text_query"), ("multi_query", "retrieved_memory_external_text_query"),
    ("hidden_adapter", "retrieved_memory_hidden_adapter"), ("memory_adapter", "train_memory_adapter"), ("oracle", "oracle_memory"), ("retrieved", "retrieved_memory"), ("random", "random_memory"), ("core", "core_only"),
)
MODEL_WORDS = (("dense", "dense"), ("exp 000", "dense"), ("retriev", "retrieval"), ("exp 001", "retrieval"))


def mode_of_run(name: Column) -> Column:
    """The memory mode that a run's name tells of; null if it tells none. An adapter's pretraining is no adapter run."""
    low, found = F.lower(name), None
    for word, mode in MODE_WORDS:
        hit = low.contains(word) & ~low.contains("pretrain") if word == "memory_adapter" else low.contains(word)
        found = F.when(hit, mode) if found is None else found.when(hit, mode)
    return found


def model_type_of_run(name: Column) -> Column:
    low, found = F.replace(F.lower(name), F.lit("_"), F.lit(" ")), None
    for word, kind in MODEL_WORDS:
        found = F.when(low.contains(word), kind) if found is None else found.when(low.contains(word), kind)
    return found.otherwise("sam")


def checkpoints(spark: SparkSession, root: str, skipped: tuple[str, ...] = (), pattern: str = "*.pt") -> DataFrame:
    """path of every file of the pattern below root, at any depth, but for those in folders of a skipped name; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    for name in skipped:
        found = found.where(~F.contains("path", F.lit(f"/{name}/")))
    return found


def write_summary(spark: SparkSession, path: str, summary: Mapping[str, Any]) -> None:
    """A run's summary as one JSON object, replacing an earlier one."""
    spark.createDataFrame([(json.dumps(dict(summary), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, metrics: DataFrame, *folders: str) -> None:
    """A run's predictions, a JSON line each, and its metrics, below every folder."""
    for folder in folders:
        predictions.write.mode("overwrite").json(f"{folder}/predictions")
        metrics.write.mode("overwrite").json(f"{folder}/metrics")


def write_misses(detail: DataFrame, report: DataFrame, path: str) -> None:
    """A retrieval report as JSON, and beside it each example's detail, hits included."""
    report.write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").json(f"{path}/misses")


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """path and sha256 of each file's bytes."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("sha256"))
