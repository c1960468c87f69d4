"""Faults that a reviewer found, on small relations."""

import numpy as np
from pyspark.sql import functions as F

from slotwise.functions.vectors import layer_norm, times, unit
from slotwise.operators import chains, neural, retrieve
from slotwise.operators import text as texts
from slotwise.plans import catalogue
from slotwise.plans.registry import QUERIES


def star(spark, path, **tables):
    """A folder of tables for a query."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def vectors(n, dims=64, labels=3):
    """n vectors of several labels, no two of one direction."""
    return [(i, [((i * 37 + j * 11 + i * j) % 101 - 50) / 50 for j in range(dims)], i % labels) for i in range(n)], "vec_id bigint, embedding array<float>, label int"


def test_comparison_report_counts_a_row_for_each_label(spark, tmp_path):
    d = star(spark, tmp_path, embeddings=vectors(60))
    rows = QUERIES["comparison_report"](spark, d).collect()
    assert {r.model for r in rows} == {"oracle", "retrieved", "dense", "core"}
    assert {r.params for r in rows} == {3 * 64} and {r.oracle_gap for r in rows} == {rows[0].oracle_gap}


def test_blocks_keep_the_cores_busy(spark):
    """A few thousand queries were one block, and so one task's work."""
    queries = spark.range(4000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vec"))
    q, s = retrieve.in_blocks(queries, queries.withColumnRenamed("query_id", "slot_id"))
    blocks = {tuple(r) for r in q.select("qb", "sb").distinct().collect()}
    assert len(blocks) >= spark.sparkContext.defaultParallelism and blocks == {tuple(r) for r in s.select("qb", "sb").distinct().collect()}


def test_best_of_a_row_are_those_of_a_full_sort():
    r = np.random.default_rng(2)
    score = np.round(r.normal(size=(50, 300)), 2)  # many ties
    score[3] = 0.0
    score[4, 5:] = -np.inf
    row, col = retrieve.highest(score, 7, 1e-9)
    at = retrieve.best(row, col, score[row, col], 7)
    assert (col[at].reshape(50, 7) == np.argsort(-score, 1, kind="stable")[:, :7]).all() and (row[at] == np.repeat(np.arange(50), 7)).all()


def test_pairs_that_single_precision_cannot_tell_apart(spark):
    """Scores a few 1e-9 apart keep their order, with anchors and slots in blocks of their own."""
    model = {"w_anchor": np.eye(2), "w_slot": np.eye(2), "w_second": np.eye(2), "w_last": np.ones((1, 2)), "b_first": np.zeros((1, 2)), "b_second": np.zeros((1, 2))}
    slots = spark.createDataFrame([(i, [1.0 + 4e-9 * ((i * 7) % 20), 1.0]) for i in range(20)], "slot_id bigint, vec array<double>")
    got = neural.pair_topk(slots.where("slot_id = 3"), slots, model, 4).orderBy("rank").collect()
    assert [r.dst for r in got] == sorted(range(20), key=lambda i: -((i * 7) % 20))[:4]


def test_gates_search_once_for_each_kind(spark, tmp_path, monkeypatch):
    """Required, ranked and by dot product; each of four variants used to search again."""
    calls, plain = [], retrieve.by_blocks
    monkeypatch.setattr(retrieve, "by_blocks", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert QUERIES["decision_gates"](spark, star(spark, tmp_path, embeddings=vectors(60))).count() == 5
    assert len(calls) == 3


def test_only_anchors_have_edges(spark, tmp_path):
    lines = [(1, 1), (1, 2), (1, 2), (1, 3), (2, 2), (2, 3), (3, 1), (None, 2)]
    d = star(spark, tmp_path, lineitem=(lines, "l_orderkey bigint, l_partkey bigint"))
    anchors = spark.createDataFrame([(9, 2), (8, 2), (7, 50)], "query_id bigint, slot_id bigint")
    assert sorted(map(tuple, catalogue._edges(spark, d, anchors).collect())) == [(2, 1, 1), (2, 3, 2)]


def test_hops_that_meet_in_few_keys_are_broadcast(spark, monkeypatch):
    sent, plain = [], F.broadcast
    monkeypatch.setattr(chains.F, "broadcast", lambda df: sent.append(1) or plain(df))
    facts = [(f"o{i}", f"c{i % 20}") for i in range(60)] + [(f"c{i}", "n") for i in range(20)] + [("n", "r")]
    facts = spark.createDataFrame(facts, "subject string, object string")
    got = chains.walk(facts, facts.where("subject like 'o%'").select("subject").distinct(), 3)
    assert sorted(map(tuple, got.collect())) == sorted((f"o{i}", *x) for i in range(60) for x in ((f"c{i % 20}", 1), ("n", 2), ("r", 3)))
    assert len(sent) == 2


def test_a_large_vocabulary_needs_no_keys_that_tell_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(texts, "SLICE", 40)
    rows = [(1, "one two two"), (1, "three one ."), (2, None), (3, ""), (4, "~ ~"), (5, "one unseen")] + [(6, f"w{i} two w{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, text string")
    vocab = texts.build_vocab(df.where("id <> 5"))
    small, large = (texts.encode(df, vocab, ["id"], most=most) for most in (1000, 0))
    plain = lambda out: sorted(map(repr, out.collect()))
    assert plain(small) == plain(large) and large.count() == len(rows)
    assert plain(texts.decode(small, vocab, ["id"])) == plain(texts.decode(small, vocab, ["id"], most=0))


def test_ids_are_numbered_where_rows_are_sorted(spark):
    """No window over all rows, and so no second shuffle of them."""
    vocab = texts.build_vocab(spark.createDataFrame([("b a c ",), ("a d",)], "text string"))
    assert {r.token: r.id for r in vocab.where("id >= 7").collect()} == {"a": 7, "b": 8, "c": 9, "d": 10}
    assert "row_number" not in vocab._jdf.queryExecution().executedPlan().toString()


def test_searches_take_again_only_what_single_precision_leaves(monkeypatch):
    """Every product was taken in double precision, and each row's kth looked for among all of them."""
    r = np.random.default_rng(5)
    ids, slots, asked, queries = np.arange(900), r.normal(size=(900, 24)), np.arange(0, 900, 30), r.normal(size=(30, 24))
    slots[400:410] = slots[0] * (1 + 1e-11 * np.arange(10))[:, None]  # alike to nine places: ids decide
    queries[1] = slots[0]
    monkeypatch.setattr(retrieve, "highest", None)
    for metric in ("cosine", "dot"):
        score = np.round(retrieve._units(queries, metric) @ retrieve._units(slots, metric).T, retrieve.RANK_PLACES)
        score[np.arange(30), asked] = -np.inf
        query, slot, found = retrieve._block_topk(6, metric, False)(ids, slots)(asked, queries)
        want = np.argsort(-score, 1, kind="stable")[:, :6]
        assert (query == np.repeat(asked, 6)).all() and (slot.reshape(30, 6) == want).all() and np.allclose(found.reshape(30, 6), np.take_along_axis(score, want, 1), 0, 1e-9)


def test_searches_of_what_single_precision_cannot_hold():
    """Copies, numbers beyond its range and vectors with NaN are taken in double precision."""
    ids, asked = np.arange(300), np.array([7, 1000])
    copies = retrieve._block_topk(3, "cosine", False)(ids, np.ones((300, 4)))(asked, np.ones((2, 4)))
    assert copies[1].tolist() == [0, 1, 2, 0, 1, 2] and (copies[2] == 1).all()
    large = np.ones((300, 4))
    large[:, 0] = 1e200 * (1 + np.arange(300) / 1000)
    large[5] = np.nan
    found = retrieve._block_topk(2, "dot", True)(ids, large)(asked, np.ones((2, 4)))
    assert found[1].tolist() == [299, 298, 299, 298]


def test_pairs_are_scored_where_their_bound_reaches(spark, monkeypatch):
    """Every pair went through both layers; now a row stands for all units that lower a score, and the best are those of all pairs."""
    r, k, kept, bounded = np.random.default_rng(8), 3, [], []
    found = spark.createDataFrame([(1, 1, 0.0)], neural.PAIRED)
    monkeypatch.setattr(neural, "by_blocks", lambda anchors, slots, block, schema: kept.append(block) or found)
    if hasattr(neural, "foremost"):
        monkeypatch.setattr(neural, "foremost", lambda *a, plain=neural.foremost: bounded.append(1) or plain(*a))
    vectors, ids = r.normal(size=(4501, 6)), np.arange(4501) * 2
    vectors[50:60] = vectors[7]
    frame = spark.createDataFrame([(1, [0.0])], "slot_id bigint, vec array<double>")
    for last in (r.normal(size=(1, 9)), -np.ones((1, 9)), np.ones((1, 9)), np.zeros((1, 9))):
        p = {"w_anchor": r.normal(size=(5, 6)), "w_slot": r.normal(size=(5, 6)), "w_second": r.normal(size=(9, 5)), "w_last": last, "b_first": r.normal(size=(1, 5)), "b_second": r.normal(size=(1, 9))}
        neural.pair_topk(frame, frame, p, k)
        a = vectors[:20]
        hidden = np.maximum((a @ p["w_anchor"].T + p["b_first"][0])[:, None] + vectors @ p["w_slot"].T, 0.0)
        score = np.round(np.maximum(hidden @ p["w_second"].T + p["b_second"][0], 0.0) @ last[0], retrieve.RANK_PLACES)
        asked, slot, best = kept[-1](ids, vectors)(ids[:20], a)
        want = np.argsort(-score, 1, kind="stable")[:, :k]
        assert (asked == np.repeat(ids[:20], k)).all() and (slot.reshape(20, k) == ids[want]).all() and np.allclose(best.reshape(20, k), np.take_along_axis(score, want, 1), 0, 2e-9)
    assert len(bounded) == 4


def test_a_layer_takes_its_input_once(spark):
    """Each row of a layer's matrix evaluated the layer's input again, and so did each element of a norm."""
    drawn = lambda: F.array(F.rand(1), F.rand(2), F.rand(3))
    rows = F.array(*(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)) for _ in range(5)))
    same = spark.range(20).select(F.array_distinct(times(rows, drawn())).alias("out"), unit(drawn()).alias("unit"), layer_norm(drawn(), 0.0).alias("norm")).collect()
    assert all(len(r.out) == 1 for r in same)
    assert all(abs(sum(x * x for x in r.unit) - 1) < 1e-12 for r in same)
    assert all(abs(sum(r.norm)) < 1e-9 and abs(sum(x * x for x in r.norm) - 3) < 1e-6 for r in same)
