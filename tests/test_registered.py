"""The functions registered for SQL: types, nulls, lengths, groups and partitions."""

import math
import random

import pytest

from slotwise.functions import registered
from slotwise.operators import retrieve

PAIRS = [([1.0, 2.0], [3.0, 4.0]), (None, [1.0]), ([1.0], None), ([1.0, None], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 2.0]), ([1e100], [1e-100]), ([-1.0, 5.0], [2.0, 0.5])]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_products(spark, kind):
    registered.register(spark)
    rows = [(i, a, b) for i, (a, b) in enumerate(PAIRS) if kind == "double" or not a or max(map(abs, filter(None, a)), default=0) < 1e30]
    spark.createDataFrame(rows, f"i int, a array<{kind}>, b array<{kind}>").repartition(3).createOrReplaceTempView("vector_pairs")
    got = {r.i: (r.d, r.c) for r in spark.sql("select i, dot(a, b) as d, cosine(a, b) as c from vector_pairs").collect()}
    for i, a, b in rows:
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            assert got[i] == (None, None)
        else:
            d = sum(x * y for x, y in zip(a, b, strict=True))
            size = math.hypot(*a) * math.hypot(*b)
            assert got[i] == (pytest.approx(d), pytest.approx(d / size if size else 0.0))
    assert spark.sql("select dot(a, b) as d from vector_pairs where i > 100").count() == 0


def test_weighted_mean(spark):
    registered.register(spark)
    rows = [(1, 0.25, [1.0, 2.0]), (1, 0.5, [2.0, 4.0]), (2, 3.0, [1.0, 1.0]), (2, 1.0, [5.0, 9.0]), (3, 1.0, None), (3, 1.0, [4.0, 2.0]), (4, 1.0, None), (5, None, [1.0, 1.0]), (5, 2.0, [2.0, 2.0])]
    spark.createDataFrame(rows, "g int, w double, v array<double>").repartition(4).createOrReplaceTempView("weighed_vectors")
    got = {r.g: r.m for r in spark.sql("select g, vec_wavg(w, v) as m from weighed_vectors group by g").collect()}
    assert got == {1: [1.25, 2.5], 2: [2.0, 3.0], 3: [2.0, 1.0], 4: [], 5: [2.0, 2.0]}
    assert spark.sql("select g, vec_wavg(1, v) as m from weighed_vectors where g > 9 group by g").count() == 0


@pytest.mark.parametrize("block,chunk", [(16_384, 256), (9, 4)])
@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_table_function_equals_topk(spark, monkeypatch, block, chunk, metric):
    monkeypatch.setattr(retrieve, "BLOCK_SLOTS", block)
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", block)
    registered.register(spark)
    r = random.Random(6)
    slots = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(50)], "slot_id bigint, vec array<double>")
    queries = slots.where("slot_id % 3 = 0").withColumnRenamed("slot_id", "query_id")
    for own in (True, False):
        registered.dealt(queries, slots, 5, metric, own).createOrReplaceTempView("dealt_vectors")
        found = spark.sql("select * from (select *, row_number() over (partition by query_id order by score desc, slot_id) as rank from topk_scan(table(dealt_vectors) partition by block)) where rank <= 5")
        want = retrieve.topk(queries, slots, 5, metric, own)
        assert sorted((x.query_id, x.rank, x.slot_id, x.score) for x in found.collect()) == sorted(map(tuple, want.collect()))
    registered.dealt(queries, slots.limit(0), 5).createOrReplaceTempView("dealt_vectors")
    assert spark.sql("select * from topk_scan(table(dealt_vectors) partition by block)").count() == 0
    with pytest.raises(ValueError):
        registered.dealt(queries, slots, 5, "euclid")


def test_reads_are_not_laid_out_by_slot(spark):
    from slotwise.operators import select

    weighed = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 9, 1.0)], "query_id bigint, slot_id bigint, w double")
    values = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "slot_id bigint, value array<double>")
    got = select.read_values(weighed, values, 2)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2.0), (1, 2, 4.0), (2, 1, 0.0), (2, 2, 0.0)]
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()
