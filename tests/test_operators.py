"""Operators on small relations whose results are known."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from slotwise.functions.text import tokens
from slotwise.functions.vectors import cosine, dot
from slotwise.operators import generate, kb, losses, metrics, product_key, retrieve, select
from slotwise.operators import text as texts
from slotwise.plans import evaluation
from slotwise.sources import config, generated, tables
from slotwise.sources.tables import EXAMPLE_SCHEMA, log_metrics, read_jsonl, read_metrics, read_vocab, write_jsonl, write_vocab
from slotwise.streaming import tail


def lists(spark, required, retrieved, hops):
    need = [(q, p, s) for q, r in enumerate(required) for p, s in enumerate(r, 1)]
    got = [(q, p, s) for q, r in enumerate(retrieved) for p, s in enumerate(r, 1)]
    return (
        spark.createDataFrame(need, "query_id bigint, pos int, slot_id bigint"),
        spark.createDataFrame(got, "query_id bigint, rank int, slot_id bigint"),
        spark.createDataFrame(list(enumerate(hops)), "query_id bigint, hops int"),
    )


CASES = [
    ([[4]], [[4, 9, 31, 2]], [1], 1, (1.0, 1.0, 1.0)),
    ([[77]], [[4, 9, 31, 2]], [1], 4, (0.0, 0.0, 0.0)),
    ([[4, 9, 61]], [[4, 9, 31, 2]], [2], 1, (1.0, 0.0, 0.333333)),
    ([[4, 9, 61]], [[4, 9, 31, 2]], [2], 2, (1.0, 0.0, 0.666667)),
    ([[4, 9, 61]], [[4, 61, 9, 2]], [3], 3, (1.0, 1.0, 1.0)),
    ([[4]], [[4, 4, 9, 4]], [1], 3, (1.0, 1.0, 1.0)),
    ([[]], [[4, 9, 31, 2]], [0], 4, (0.0, 0.0, 0.0)),
]


@pytest.mark.parametrize("required,retrieved,hops,k,want", CASES)
def test_required_set_cases(spark, required, retrieved, hops, k, want):
    need, got, meta = lists(spark, required, retrieved, hops)
    row = metrics.required_set(metrics.required_counts(need, got, meta, (k,))).where("hops = -1").first()
    assert (row.any_required, row.all_required, row.coverage) == want


def test_aggregate_and_ranks(spark):
    need, got, meta = lists(spark, [[8], [6, 12], [50]], [[8, 40], [6, 12], [9]], [1, 2, 1])
    row = metrics.required_set(metrics.required_counts(need, got, meta, (8,))).where("hops = -1").first()
    assert (row.any_required, row.all_required, row.coverage) == (0.666667, 0.666667, 0.75)
    need, got, _ = lists(spark, [[7], [11, 13], [17, 19, 23]], [[7, 3, 11, 5], [13, 11, 2, 3], [17, 19, 23, 2]], [1, 2, 3])
    assert metrics.rank_metrics(need, got, (4,)).first().mrr == 1.0


def candidates(spark, rows):
    """rows: (rank, slot, score, live, required) of one query of two hops."""
    return spark.createDataFrame([(1, r, s, float(c), lv, q, 2) for r, s, c, lv, q in rows], "query_id bigint, rank int, slot_id bigint, score double, live boolean, is_required boolean, hops int")


def weights(df, mode, **given):
    return [round(r.w, 4) for r in select.weigh(df, mode, **given).orderBy("rank").collect()]


def test_selection_modes(spark):
    df = candidates(spark, [(1, 1, 0.9, True, False), (2, 2, 0.88, False, True), (3, 3, 0.5, True, True), (4, 4, 0.4, True, False)])
    assert weights(df, "uniform_mean") == [0.3333, 0, 0.3333, 0.3333]
    assert weights(df, "top1") == [1, 0, 0, 0]
    assert weights(df, "top3") == [0.5, 0, 0.5, 0]
    assert weights(df, "fixed_top_n", n=9) == [0.3333, 0, 0.3333, 0.3333]
    assert weights(df, "fixed_top_by_hop") == [1, 0, 0, 0]
    assert weights(df, "score_threshold_absolute", threshold=2.0) == [0, 0, 0, 0]
    assert weights(df, "score_threshold_relative", delta=0.45) == [0.5, 0, 0.5, 0]
    assert weights(df, "softmax_mass", mass=1.5) == [1, 0, 0, 0]
    assert weights(df, "softmax_mass", mass=0.6) == [1, 0, 0, 0]
    assert weights(df, "score_gap", gap=0.1) == [1, 0, 0, 0]
    assert weights(df, "score_gap", gap=0.9) == [1, 0, 0, 0]
    assert weights(df, "oracle_filter") == [0, 0, 1, 0]
    soft = weights(df, "score_weighted_softmax", temperature=0.1)
    assert soft[1] == 0 and sum(soft) < 0.6
    assert weights(df.withColumn("live", F.lit(False)), "top3") == [0, 0, 0, 0]
    assert weights(df.withColumn("is_required", F.lit(False)), "oracle_filter") == [0.3333, 0, 0.3333, 0.3333]
    assert weights(df.where("rank = 1"), "score_gap") == [1]
    with pytest.raises(ValueError):
        select.weigh(df, "no such mode")


def test_empty_selection_is_the_zero_vector(spark):
    df = select.weigh(candidates(spark, [(1, 1, 0.9, False, False)]), "uniform_mean")
    values = spark.createDataFrame([(1, [1.0, 2.0])], "slot_id bigint, value array<double>")
    assert [(r.dim, r.value) for r in select.read_values(df, values, 2).orderBy("dim").collect()] == [(1, 0.0), (2, 0.0)]


def all_pairs_topk(queries, slots, k, metric):
    """The k best of every query among all slots, as expressions over all pairs."""
    f = {"cosine": cosine, "dot": dot}[metric]
    pairs = queries.select("query_id", F.col("vec").alias("qv")).crossJoin(slots.select("slot_id", F.col("vec").alias("sv")))
    return retrieve.ranked_by_score(pairs.select("query_id", "slot_id", F.round(f(F.col("qv"), F.col("sv")), retrieve.RANK_PLACES).alias("score")), k)


def test_topk_forms_agree_and_handle_edges(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id bigint, vec array<double>")
    s = spark.createDataFrame([(3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])], "slot_id bigint, vec array<double>")
    for metric in ("cosine", "dot"):
        a, b = (sorted(map(tuple, f(q, s, 10, metric).collect())) for f in (retrieve.topk, all_pairs_topk))
        assert a == b and len(a) == 6
    assert [r.slot_id for r in retrieve.topk(q, s, 2).where("query_id = 2").orderBy("rank").collect()] == [3, 4]
    assert retrieve.topk(q, s.limit(0), 2).count() == 0


def test_product_keys_equal_all_pairs(spark):
    import random

    r = random.Random(1)
    vec = lambda n: [r.uniform(-1, 1) for _ in range(n)]
    q = spark.createDataFrame([(i, vec(4)) for i in range(5)], "query_id bigint, vec array<double>")
    book = spark.createDataFrame([(side, k, vec(2)) for side in (1, 2) for k in range(6)], "side int, k bigint, vec array<double>")
    scores = product_key.subscores(q, book, 2)
    assert sorted(map(tuple, product_key.topk(scores, 4, 4, 6, 4).collect())) == sorted(map(tuple, product_key.topk(scores, 6, 6, 6, 4).collect()))
    assert product_key.clipped(50, 9, 2, 6) == (12, 6, 2)
    assert product_key.topk(scores, 9, 2, 6, 50).groupBy("query_id").count().where("count <> 12").count() == 0


def test_noise_never_draws_required_slots(spark):
    need = spark.createDataFrame([(q, p, 5 * p) for q in range(10) for p in (1, 2)], "query_id bigint, pos int, slot_id bigint")
    slots = spark.createDataFrame([(i, i % 9 != 4) for i in range(30)], "slot_id bigint, live boolean")
    rows = select.noisy(need, slots, 3, 0.5, 42, 8).collect()
    assert len(rows) == 50
    assert all(r.is_required == (r.slot_id in (5, 10)) == (r.score == 1.0) == (r.pos <= 2) for r in rows)
    assert len({(r.query_id, r.slot_id) for r in rows}) == 50


def test_text_edges(spark):
    df = spark.createDataFrame([(1, "Ab_1 (x)?"), (2, ""), (3, None), (4, "été [z]")], "id int, text string")
    assert {r.id: r.t for r in df.select("id", tokens(F.col("text")).alias("t")).collect()} == {1: ["Ab_1", "(", "x", ")", "?"], 2: [], 3: [], 4: ["t", "z"]}
    vocab = texts.build_vocab(df)
    ids = {r.id: r.ids for r in texts.encode(df, vocab, ["id"]).collect()}
    assert ids[2] == ids[3] == [] and min(ids[1]) == 7
    assert {r.id: r.text for r in texts.decode(texts.encode(df, vocab, ["id"]), vocab, ["id"]).collect()}[1] == "Ab_1 ( x ) ?"


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([([("slot_000001", "t", "o", "s")], "q", "a", "a", ["slot_000001"], [], [], 1, "x", "train")], EXAMPLE_SCHEMA)
    write_jsonl(rows, f"{tmp_path}/ex")
    assert read_jsonl(spark, f"{tmp_path}/ex", EXAMPLE_SCHEMA).collect() == rows.collect()
    vocab = spark.createDataFrame([("<pad>", 0), ("b", 8), ("a", 7)], "token string, id int")
    write_vocab(vocab, f"{tmp_path}/vocab")
    assert {(r.token, r.id) for r in read_vocab(spark, f"{tmp_path}/vocab").collect()} == {("<pad>", 0), ("a", 7), ("b", 8)}
    for step in (1, 2):
        log_metrics(spark, f"{tmp_path}/log", step, 0.5, {"loss": step / 2, "note": None})
    assert {(r.step, r.metrics["loss"]) for r in read_metrics(spark, f"{tmp_path}/log").collect()} == {(1, 0.5), (2, 1.0)}


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"net": {"width": 64, "deep": {}}, "run": {"rounds": 1}}')
    got = config.read_settings(str(tmp_path / "c.json"), "run.rounds=5", "run.name=x", "net.deep.layers=[1, 2]")
    assert got == {"net.width": 64, "net.deep.layers": [1, 2], "run.rounds": 5, "run.name": "x"}
    assert config.section(got, "run") == {"rounds": 5, "name": "x"}
    assert config.overlaid(got, {"run": None}) == {"net.width": 64, "net.deep.layers": [1, 2], "run": None}
    with pytest.raises(ValueError):
        config.assignments(["no sign"])


def test_coding_by_broadcast_and_by_join_agree(spark):
    df = spark.createDataFrame([(i, f"a b{i} (c) a, zz {'a ' * i}") for i in range(30)] + [(90, ""), (91, None)], "id int, text string")
    vocab = texts.build_vocab(df.where("id < 20"))
    one, two = (texts.encode(df, vocab, ["id"], most=most) for most in (1000, 0))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.where(f"array_contains(ids, {6})").count() == 10
    back = [texts.decode(one, vocab, ["id"], most=most) for most in (1000, 0)]
    assert sorted((r.id, r.text or "") for r in back[0].collect()) == sorted((r.id, r.text or "") for r in back[1].collect())


def test_vocab_is_one_object_in_order(spark, tmp_path):
    vocab = spark.createDataFrame([('a"b', 9), ("<pad>", 0), ("}", 8)], "token string, id int").repartition(3)
    write_vocab(vocab, f"{tmp_path}/v")
    text = "".join(p.read_text() for p in (tmp_path / "v").glob("part-*"))
    assert json.loads(text) == {"<pad>": 0, "}": 8, 'a"b': 9} and list(json.loads(text).values()) == [0, 8, 9]


def test_noise_is_never_short(spark):
    need = spark.createDataFrame([(1, p, p) for p in range(1, 13)], "query_id bigint, pos int, slot_id bigint")
    slots = spark.createDataFrame([(i, True) for i in range(20)], "slot_id bigint, live boolean")
    rows = select.noisy(need, slots, 7, 0.5, 42, 100)
    assert rows.where("not is_required").count() == 7 and select.noisy(need, slots, 50, 0.5, 42, 100).where("not is_required").count() == 8
    assert "SinglePartition" not in select.noisy(need, slots, 7, 0.5, 42, 100)._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    filled = select.padded(rows.where("pos <= 2"), 4).orderBy("pos").collect()
    assert [(r.slot_id, r.score) for r in filled[2:]] == [(-1, float("-inf"))] * 2


def test_structured_negatives_prefer_shared_attributes(spark):
    need = spark.createDataFrame([(1, 0), (1, 50), (2, 7), (3, 900)], "query_id bigint, slot_id bigint")
    slots = spark.range(100).selectExpr("id as slot_id", "case when id < 90 then id % 30 end as kind", "id div 50 as half")
    rows = select.structured_negatives(need, slots, "slot_id", ["kind"], 4, 0.5, 3).collect()
    of = lambda q, hard: {r.slot_id for r in rows if r.query_id == q and not r.positive and r.hard == hard}
    assert of(1, True) == {30, 60, 20, 80} and len(of(1, False)) == 4 and not of(1, False) & {0, 50, 30, 60, 20, 80}
    assert of(2, True) == {37, 67} and len(of(2, False)) == 2 and len(of(3, False)) == 4 and not of(3, True)
    wide = select.structured_negatives(need, slots, "slot_id", ["kind", "half"], 4, 0.5, 3).where("hard")
    assert {r["count"] for r in wide.groupBy("query_id").count().collect()} == {4, 2}
    for r in wide.collect():
        own = [(k, k % 30 if k < 90 else None, k // 50) for k in {1: (0, 50), 2: (7,)}[r.query_id]]
        kind = r.slot_id < 90 and any(r.slot_id % 30 == a for _, a, _ in own)
        assert r.matched == ("kind" if kind else "half") and (kind or any(r.slot_id // 50 == b for *_, b in own))
    assert {r.matched for r in rows} == {"kind", None} and all((r.matched is None) != r.hard for r in rows)


def test_running_best_follows_the_order(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), float(r.randrange(1000)) if r.random() < 0.9 else None) for i in range(400)]
    got = metrics.running_best(spark.createDataFrame(rows, "step int, run string, value double"), "run", ["step"], "value", F.floor(F.col("step") / 16)).collect()
    want, best = [], {}
    for step, run, value in rows:
        if value is not None and value > best.get(run, -1.0):
            best[run] = value
            want.append((step, run, value))
    assert sorted(map(tuple, got)) == sorted(want)


def test_short_items_leak_too(spark):
    items = spark.createDataFrame([(1, "one TWO three four five six seven"), (2, "three four"), (3, "x"), (4, "a b c"), (5, ""), (6, None), (7, "two three four five")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six sevens"), (2, "aa b cc"), (3, "three  four"), (4, None), (5, "six"), (6, "q a b c")], "doc_id int, text string")
    want = {(i.item_id, d.doc_id) for i in items.collect() for d in docs.collect() if i.text and d.text and i.text.lower() in d.text.lower()}
    for most in (10, 0):
        kb.BROADCAST_ITEMS, before = most, kb.BROADCAST_ITEMS
        try:
            assert {tuple(r) for r in kb.leaks(items, docs).collect()} == want
        finally:
            kb.BROADCAST_ITEMS = before
    assert kb.leaks(items.limit(0), docs).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_short_items_are_looked_up_by_their_first_characters(spark, monkeypatch, broadcast):
    """Items of one and two words meet only documents that share a key with them, and no join is a nested loop."""
    monkeypatch.setattr(kb, "BROADCAST_ITEMS", broadcast)
    r = random.Random(3)
    texts_of = ["".join(r.choice("aB é🎈.") for _ in range(r.randrange(0, 40))) for _ in range(60)] + [None, ""]
    asked = ["a", "b", "É", "🎈", " a", "ab", "a b", "é🎈a", "b.a", "aaa", "zz", "", None, "ba  a", "🎈🎈"]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts_of)), "doc_id bigint, text string")
    found = kb.leaks(items, docs)
    want = {(i, d) for i, a in enumerate(asked) if a for d, t in enumerate(texts_of) if t and a.lower() in t.lower()}
    assert {tuple(x) for x in found.collect()} == want and len(want) > 50
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_sums_over_all_slots(spark, monkeypatch):
    r = random.Random(3)
    vec = lambda: [r.uniform(-1, 1) for _ in range(4)]
    q, s = [(i, vec()) for i in range(5)], [(i, vec()) for i in range(9)]
    q_df, s_df = spark.createDataFrame(q, "query_id bigint, vec array<double>"), spark.createDataFrame(s, "slot_id bigint, vec array<double>")
    need = spark.createDataFrame([(0, 1), (3, 2), (3, 4)], "query_id bigint, slot_id bigint")
    monkeypatch.setattr(retrieve, "BLOCK_SLOTS", 4)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    z = {(i, j): cos(a, b) / 0.5 for i, a in q for j, b in s if i != j}
    soft = lambda x: math.log1p(math.exp(x))
    want = sum(5 * soft(-x) if k in {(0, 1), (3, 2), (3, 4)} else soft(x) for k, x in z.items()) / len(z)
    got = losses.bce_over_all(q_df, s_df, need, 5.0, 0.5, own=False).first()
    assert got.rows == 40 and abs(got.loss - want) < 1e-5
    ce = sum(math.log(sum(math.exp(z[i, k]) for k in range(9) if k != i)) - z[i, j] for i, j in ((0, 1), (3, 2))) / 2
    assert abs(losses.retrieval_ce(q_df, s_df, need.where("slot_id < 3"), 0.5, own=False).first().ce - ce) < 1e-5


def test_runs_and_sinks(spark, tmp_path):
    for name in ("a/b/best_model.pt", "a/b/last.pt", "a/step_2.pt", "debug/x/last.pt", "c/note.txt"):
        (tmp_path / "runs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / name).write_text("x")
    found = tables.preferred_runs(tables.checkpoints(spark, f"{tmp_path}/runs", ("debug",))).collect()
    assert {(r.folder.rsplit("/runs/", 1)[1], r.name) for r in found} == {("a/b", "best_model.pt"), ("a", "step_2.pt")}
    tables.write_summary(spark, f"{tmp_path}/s", {"b": 1, "a": "x"})
    tables.write_summary(spark, f"{tmp_path}/s", {"b": 2})
    assert [r.value for r in spark.read.text(f"{tmp_path}/s").collect()] == ['{"b": 2}']
    rows = spark.createDataFrame([(1, "y")], "query_id int, prediction string")
    tables.write_predictions(rows, rows.groupBy().count(), f"{tmp_path}/one", f"{tmp_path}/two")
    assert spark.read.json(f"{tmp_path}/two/predictions").count() == 1 == spark.read.json(f"{tmp_path}/one/metrics").first()["count"]
    tables.write_misses(rows, rows, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m/misses").collect() == spark.read.json(f"{tmp_path}/m/summary").collect()
    tables.write_meta(spark, f"{tmp_path}/meta", {"splits": {"train": 1}})
    assert json.loads(spark.read.text(f"{tmp_path}/meta").first().value) == {"splits": {"train": 1}}


def _words(spark, prefix, n):
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id")).alias("word"))


@pytest.mark.parametrize("separation", generate.SEPARATIONS)
def test_generated_pools_are_full_and_apart(spark, separation):
    """Chains over so few names that many are drawn again; test has names of its own, as far as the separation says."""
    nouns, verbs = _words(spark, "n", 16), _words(spark, "v", 4)
    split = generate.split_of(F.col("id"))
    ids = spark.range(400).select(F.col("id").alias("chain_id"), split.alias("split"))
    rows = generate.chains(ids, nouns, verbs, 3, separation).collect()
    assert len({tuple(r.facts) for r in rows}) == len(rows) == 400 and {len(r.facts) for r in rows} == {1, 2, 3}
    for kind, names in (("noun", nouns), ("verb", verbs)):
        pool = {r.word: r.pool for r in generate.pools(names, separation, kind).collect()}
        apart = separation == "hard" or (separation == "soft" and kind == "noun")
        assert set(pool.values()) == ({"train", "test"} if apart else {"both"})
        for r in rows:
            used = {w for f in r.facts for name in f.split() for w in name.split("_") if w in pool}
            assert {pool[w] for w in used} <= {"both", "test" if r.split == "test" else "train"}
    pool = generate.chains(ids, nouns, verbs, 3, separation)
    drawn = generate.examples(pool, spark.range(900).select(F.col("id").alias("example_id"), F.when(F.col("id") % 15 == 0, "val").when(F.col("id") % 15 == 1, "test").otherwise("train").alias("split")), 3)
    assert drawn.count() == drawn.select("example_id").distinct().count() == 900
    assert drawn.groupBy("split", "question", "answer", "facts").count().where("count > if(split = 'train', 5, 1)").count() == 0
    assert all(r.subject in r.question for r in drawn.limit(50).collect())


def test_generated_pools_end_where_names_do(spark):
    ids = spark.range(60).select(F.col("id").alias("chain_id"), F.lit("train").alias("split"))
    rows = generate.chains(ids, _words(spark, "n", 1), _words(spark, "v", 1), 3, "none").collect()
    assert len(rows) == len(generate.TASKS) and {r.chain_id for r in rows} == {0, 10, 20, 30, 40}
    assert generate.chains(ids, _words(spark, "n", 0), _words(spark, "v", 2), 3).count() == 0
    pool = generate.chains(ids, _words(spark, "n", 1), _words(spark, "v", 1), 3, "none")
    assert generate.examples(pool, spark.range(200).select(F.col("id").alias("example_id"), F.lit("train").alias("split")), 3).count() == 5 * 2 * 5
    assert generate.examples(pool, spark.range(9).select(F.col("id").alias("example_id"), F.lit("val").alias("split")), 3).count() == 0
    with pytest.raises(ValueError):
        generate.chains(ids, _words(spark, "n", 1), _words(spark, "v", 1), 3, "firm")


def test_the_last_state_of_a_window_counts(spark, tmp_path):
    rows = spark.createDataFrame([("w", "a", 1, 1.0), ("w", "b", 5, 2.0)], "w string, event_type string, n int, total double")
    rows.write.parquet(f"{tmp_path}/batch=0")
    rows.where("event_type = 'a'").selectExpr("w", "event_type", "n + 1 as n", "total").write.parquet(f"{tmp_path}/batch=1")
    assert sorted(map(tuple, tail.latest(spark, str(tmp_path)).collect())) == [("w", "a", 2, 1.0), ("w", "b", 5, 2.0)]


def test_unknown_retriever_mode():
    with pytest.raises(ValueError):
        evaluation.retrieved(None, "", "no such mode")


def test_generated_data_set(spark, tmp_path):
    spark.range(12).select(F.concat(F.lit("Supplier#00"), F.col("id")).alias("s_name")).write.parquet(f"{tmp_path}/star/supplier.parquet")
    spark.createDataFrame([("SMALL",), ("LARGE",), (None,)], "p_type string").write.parquet(f"{tmp_path}/star/part.parquet")
    generated.main([f"{tmp_path}/g", "--train", "60", "--val", "10", "--test", "10", "--chains", "80", "--seed", "3", "--tables", f"{tmp_path}/star", "--separation", "hard"])
    slots = spark.read.json(f"{tmp_path}/g/kb")
    ids = {r.slot_id: r.text for r in slots.collect()}
    assert sorted(ids) == list(range(len(ids))) and [ids[i] for i in sorted(ids)] == sorted(ids.values())
    words = {r.token for r in read_vocab(spark, f"{tmp_path}/g/vocab").collect()}
    for split in ("train", "val", "test"):
        for r in spark.read.json(f"{tmp_path}/g/{split}").collect():
            assert r.split == split and r.answer in words and [ids[int(s.removeprefix("slot_"))] for s in r.required_slots] == r.facts
    assert json.loads(spark.read.text(f"{tmp_path}/g/meta").first().value)["seed"] == 3
