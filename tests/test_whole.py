"""Queries do the whole job: every row that they should cover is covered."""

import random

from pyspark.sql import functions as F

from slotwise.operators.text import qa_sequence
from slotwise.plans.registry import QUERIES


def test_every_part_is_a_positive(spark, tmp_path):
    r = random.Random(4)
    pick = lambda n: r.choice([None, *range(n)])
    parts = [(i, None if (b := pick(9)) is None else f"b{b}", None if (t := pick(7)) is None else f"t{t}", pick(12)) for i in range(1, 121)]
    parts += [(200, "alone", None, None), (250, None, None, None)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = []
    for k, *mine in parts:
        others = [j for j, *its in parts if j != k and any(a is not None and a == b for a, b in zip(mine, its, strict=True))]
        want += [(k, len(others), min(others), sum(others))] if others else []
    assert sorted(map(tuple, QUERIES["hard_negatives"](spark, str(tmp_path)).collect())) == want
    assert {k for k, *_ in want} > {50, 100}


def test_long_turns_stay_whole(spark, tmp_path):
    turns = [(1, 0, "user", "a " * 70), (1, 1, "assistant", "b " * 90), (2, 0, "user", "a"), (2, 1, "assistant", "b c"), (2, 2, "user", "c")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    a, b, c = 7, 8, 9  # the first ids after the special ones
    ids = {1: [1, *[a] * 70, 3, *[b] * 90, 2], 2: [1, a, 3, b, c, 2]}
    text = lambda x: ",".join(map(str, x))
    rows = {name: {r.conv_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("prompt_assembly", "label_mask", "batch_pad")}
    assert {k: (r.ids, r.seq_len, r.prompt_len) for k, r in rows["prompt_assembly"].items()} == {1: (text(ids[1]), 163, 72), 2: (text(ids[2]), 6, 3)}
    assert {k: (r.labels, r.n_masked) for k, r in rows["label_mask"].items()} == {1: (text([-100] * 72 + ids[1][72:]), 72), 2: (text([-100] * 3 + ids[2][3:]), 3)}
    assert {k: (r.padded, r.width, r.n_pad) for k, r in rows["batch_pad"].items()} == {1: (text(ids[1]), 163, 0), 2: (text(ids[2] + [0] * 157), 163, 157)}


def test_sequences_are_cut_to_a_given_length(spark):
    df = spark.range(1).select(F.array(F.lit(10), F.lit(11)).alias("q"), F.array(F.lit(12)).alias("a"))
    got = {n: df.select(qa_sequence(F.col("q"), F.col("a"), n).alias("s")).first().s for n in (3, 5, 6)}
    assert {n: (s.ids, s.prompt_len) for n, s in got.items()} == {3: ([1, 10, 11], 3), 5: ([1, 10, 11, 3, 12], 4), 6: ([1, 10, 11, 3, 12, 2], 4)}
