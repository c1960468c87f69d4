"""Ids in first-seen order over several files, and what a query costs while it is written."""

import json
import random

import pytest
from pyspark.sql import functions as F

from slotwise.operators import kb
from slotwise.operators.text import first_seen, sequenced
from slotwise.sources.measured import measured


@pytest.mark.parametrize("kind", ["json", "parquet", "text"])
def test_first_seen_order_is_one_readers(spark, tmp_path, kind):
    """Files of several blocks each, read by tasks that take blocks of several files."""
    r = random.Random(3)
    files = {f"part-{i}": [(f"subject_{r.randrange(60)}", f"object_{r.randrange(4)}") for _ in range(r.randrange(1, 400))] for i in (3, 0, 12, 1)}
    for name, rows in files.items():
        if kind == "parquet":
            spark.createDataFrame(rows, "subject string, object string").coalesce(1).write.option("parquet.block.size", "512").parquet(f"{tmp_path}/in/{name}")
        else:
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / name).write_text("".join(json.dumps({"subject": s, "object": o}) + "\n" if kind == "json" else f"{s} {o}\n" for s, o in rows))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "1000")
        if kind == "text":
            parts = F.split("value", " ")
            read = sequenced(spark.read.text(f"{tmp_path}/in")).select(parts[0].alias("subject"), parts[1].alias("object"), "seq")
        else:
            read = sequenced(spark.read.option("recursiveFileLookup", "true").schema("subject string, object string").format(kind).load(f"{tmp_path}/in"))
        assert read.rdd.getNumPartitions() > len(files)
        slots = {x.text: (x.slot_id, x.embedding_target, x.subject) for x in kb.first_seen_slots(read.withColumn("relation", F.lit("has"))).collect()}
        ids = {x.subject: x.id for x in first_seen(read, ["subject"], "seq", "id").collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    facts, subjects = {}, {}
    for name in sorted(files):
        for s, o in files[name]:
            facts.setdefault(f"{s} has {o} .", (len(facts), o, s))
            subjects.setdefault(s, len(subjects))
    assert slots == facts and ids == subjects


def test_costs_are_measured(spark, tmp_path):
    df = spark.createDataFrame([(i, "one two three" if i % 2 else None) for i in range(500)], "id int, text string").repartition(3)
    cost = measured(df.orderBy("text", "id"), lambda x: x.write.parquet(f"{tmp_path}/out"), "text")
    assert (cost.rows, cost.tokens) == (500, 750) and spark.read.parquet(f"{tmp_path}/out").count() == 500
    assert cost.seconds > 0 and cost.rows_per_second == 500 / cost.seconds and cost.tokens_per_second == 750 / cost.seconds
    assert cost.peak_task_bytes > 0 and cost.cpu_seconds > 0 and cost.shuffle_bytes > 0 and cost.spilled_bytes == 0
    assert set(cost.report()) >= {"rows", "rows_per_second", "peak_task_bytes"}
    plain = measured(df)
    assert plain.rows == 500 and plain.tokens == 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert measured(df.limit(0), text_col="text").tokens_per_second == 0
