"""Layers over vectors and slots against loops over lists, blocks of any size, dead and missing slots."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import encoder, losses, neural, retrieve


def mat(r, n, m):
    return [[r.gauss(0, 0.5) for _ in range(m)] for _ in range(n)]


def mul(w, v):
    return [sum(a * b for a, b in zip(row, v, strict=True)) for row in w]


def sig(z):
    return 1 / (1 + math.exp(-z))


def parameters(spark, model):
    return spark.createDataFrame([(name, i, row) for name, rows in model.items() for i, row in enumerate(rows)], "name string, row int, vec array<double>").repartition(3)


def test_models_are_read_in_order_and_bounded(spark, monkeypatch):
    model = {"a": [[float(i)] * 2 for i in range(30)], "b": [[1.0]]}
    assert {k: v.tolist() for k, v in neural.read_model(parameters(spark, model)).items()} == model
    monkeypatch.setattr(neural, "MOST_PARAMETERS", 60)
    with pytest.raises(ValueError, match="61 parameters"):
        neural.read_model(parameters(spark, model))


def loop_head(model, mode, x, slots, dims):
    """slots: (w, value or None) by rank."""
    d, v = len(x), [(w, [0.0] * dims if value is None else value) for w, value in slots]
    if mode == "cross_attention":
        asked = mul(model["query"], x)
        e = [math.exp(sum(a * b for a, b in zip(asked, mul(model["key"], y), strict=True)) / math.sqrt(d)) for _, y in v]
        m = [sum(p * mul(model["value"], y)[i] for p, (_, y) in zip(e, v, strict=True)) / sum(e) if e else 0.0 for i in range(d)]
    else:
        m = mul(model["memory"], [sum(w * y[i] for w, y in v) for i in range(dims)])
    if mode == "concat_projection":
        return mul(model["joined"], x + m), m, None
    gate = {"forced_gate_1": [1.0] * d, "forced_gate_scalar": [0.25] * d}.get(mode) or [sig(z + b) for z, b in zip(mul(model["gate"], x + m), model["gate_bias"][0], strict=True)]
    return [a + g * b for a, g, b in zip(x, gate, m, strict=True)], m, sum(gate) / d


@pytest.mark.parametrize("mode", neural.MODES)
@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_memory_head_equals_loops(spark, monkeypatch, mode, cells):
    monkeypatch.setattr(neural, "CELLS", cells)
    r, d, dims = random.Random(2), 3, 5
    model = {"memory": mat(r, d, dims), "gate": mat(r, d, 2 * d), "gate_bias": mat(r, 1, d), "query": mat(r, d, d), "key": mat(r, d, dims), "value": mat(r, d, dims), "joined": mat(r, d, 2 * d)}
    states = {q: mat(r, 1, d)[0] for q in range(12)}
    values = {s: mat(r, 1, dims)[0] for s in range(0, 30, 2)}  # odd slots are dead
    listed = {q: [(rank, r.random(), r.randrange(30)) for rank in range(1, r.randrange(1, 6))] for q in range(10)}  # two queries have no slots
    weighed = spark.createDataFrame([(q, rank, s, w) for q, rows in listed.items() for rank, w, s in rows], "query_id bigint, rank int, slot_id bigint, w double").repartition(3)
    memory = neural.memories(weighed, spark.createDataFrame(list(values.items()), "slot_id bigint, value array<double>"))
    got = neural.integrate(spark.createDataFrame(list(states.items()), "query_id bigint, vec array<double>"), memory, neural.read_model(parameters(spark, model)), mode, 0.25).collect()
    assert len(got) == 12
    for row in got:
        slots = [(w, values.get(s)) for _, w, s in listed.get(row.query_id, [])]
        out, m, gate = loop_head(model, mode, states[row.query_id], slots, dims)
        change = math.dist(out, states[row.query_id]) / math.hypot(*states[row.query_id])
        assert row.vec == pytest.approx(out) and row.memory_norm == pytest.approx(math.hypot(*m)) and row.residual_ratio == pytest.approx(change)
        assert row.gate_mean == (None if gate is None else pytest.approx(gate))
    with pytest.raises(ValueError):
        neural.MemoryHead({}, "sum")


def selector(r, q, s, v, h, e):
    return {"w_query": mat(r, h, q), "w_slot": mat(r, h, s), "w_value": mat(r, h, v), "w_scalars": mat(r, h, 4), "w_hops": mat(r, h, e), "hops": mat(r, 4, e), "w_second": mat(r, h, h), "w_last": mat(r, 1, h), "b_first": mat(r, 1, h), "b_second": mat(r, 1, h), "b_last": [[0.1]]}


def test_selector_equals_loops(spark):
    r = random.Random(5)
    model = selector(r, 3, 4, 2, 6, 2)
    qs, ss, vs = {i: mat(r, 1, 3)[0] for i in range(6)}, {i: mat(r, 1, 4)[0] for i in range(9)}, {i: mat(r, 1, 2)[0] for i in range(0, 9, 2)}
    rows = [(q, s, r.choice([None, 0, 1, 3, 9]), bool(s % 2), False, r.random(), place, r.random(), r.random()) for q in qs for place, s in enumerate(r.sample(range(9), 4))]
    df = spark.createDataFrame(rows, "query_id bigint, slot_id bigint, hops int, live boolean, is_required boolean, score double, place int, margin double, normalised double")
    frame = lambda m, kind: spark.createDataFrame(list(m.items()), kind)
    scored = neural.selector_logits(df, frame(qs, "query_id bigint, vec array<double>"), frame(ss, "slot_id bigint, vec array<double>"), frame(vs, "slot_id bigint, value array<double>"), neural.read_model(parameters(spark, model)))
    want = {}
    for q, s, hops, _, _, *scalars in rows:
        sc = [scalars[0], scalars[1], scalars[2], scalars[3]]
        parts = [mul(model["w_query"], qs[q]), mul(model["w_slot"], ss[s]), mul(model["w_value"], vs.get(s, [0.0, 0.0])), mul(model["w_scalars"], sc), mul(model["w_hops"], model["hops"][min(max(hops or 0, 0), 3)]), model["b_first"][0]]
        h = [max(0.0, sum(p)) for p in zip(*parts, strict=True)]
        h = [max(0.0, z + b) for z, b in zip(mul(model["w_second"], h), model["b_second"][0], strict=True)]
        want[q, s] = round(mul(model["w_last"], h)[0] + 0.1, 9)
    got = {(x.query_id, x.slot_id): x for x in scored.collect()}
    assert {k: x.logit for k, x in got.items()} == pytest.approx(want) and {k[1]: x.value for k, x in got.items()} == {s: vs.get(s) for _, s in got}
    for query, group in ((q, [x for x in neural.taken(scored, 0.6).collect() if x.query_id == q]) for q in qs):
        over = {x.slot_id for x in group if x.prob >= 0.6} or {min(group, key=lambda x: x.place).slot_id}
        assert {x.slot_id for x in group if x.taken} == over, query
    assert neural.taken(scored, top_n=2).where("taken").count() == 2 * len(qs)
    assert {x.w for x in neural.read_taken(neural.taken(scored, top_n=2)).collect()} == {0.0, 0.5}


@pytest.mark.parametrize("block,chunk,cells", [(16_384, 256, 1 << 20), (7, 3, 5)])
def test_pair_scorer_equals_all_pairs(spark, monkeypatch, block, chunk, cells):
    monkeypatch.setattr(retrieve, "BLOCK_SLOTS", block)
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", block)
    monkeypatch.setattr(retrieve, "CHUNK", chunk)
    monkeypatch.setattr(neural, "CELLS", cells)
    r = random.Random(8)
    model = {"w_anchor": mat(r, 5, 3), "w_slot": mat(r, 5, 3), "w_second": mat(r, 5, 5), "w_last": mat(r, 1, 5), "b_first": mat(r, 1, 5), "b_second": mat(r, 1, 5)}
    vecs = {i: mat(r, 1, 3)[0] for i in range(40)}
    vecs[3] = vecs[31]  # a tie
    slots = spark.createDataFrame(list(vecs.items()), "slot_id bigint, vec array<double>")
    got = neural.pair_topk(slots.where("slot_id % 4 = 0"), slots, neural.read_model(parameters(spark, model)), 6).collect()
    want = []
    for a in range(0, 40, 4):
        scored = []
        for s, v in vecs.items():
            h = [max(0.0, x + y + b) for x, y, b in zip(mul(model["w_anchor"], vecs[a]), mul(model["w_slot"], v), model["b_first"][0], strict=True)]
            h = [max(0.0, z + b) for z, b in zip(mul(model["w_second"], h), model["b_second"][0], strict=True)]
            scored.append((-round(mul(model["w_last"], h)[0], 9), s))
        want += [(a, rank, s, pytest.approx(-z, abs=1e-8)) for rank, (z, s) in enumerate(sorted(scored)[:6], 1)]
    assert sorted(map(tuple, got)) == want


def test_no_required_slot_is_lost(spark):
    """A required slot that ranks last is a positive all the same."""
    r = np.random.default_rng(4)
    vecs = {i: v for i, v in enumerate(r.normal(size=(120, 4)).tolist())}
    slots = spark.createDataFrame(list(vecs.items()), "slot_id bigint, vec array<double>")
    queries = slots.where("slot_id < 6").withColumnRenamed("slot_id", "query_id")
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    order = {q: sorted((s for s in vecs if s != q), key=lambda s: (-cos(vecs[q], vecs[s]), s)) for q in range(6)}
    need = {q: [order[q][-1], order[q][0]][: 1 + q % 2] for q in range(5)} | {5: [order[5][50]]}
    required = spark.createDataFrame([(q, s) for q, found in need.items() for s in found + found[:1]], "query_id bigint, slot_id bigint")
    loss, pairs = [], []
    for q, found in need.items():
        e = {s: math.exp(cos(vecs[q], vecs[s]) / 0.07) for s in order[q]}
        loss.append(math.log(sum(e.values())) - math.log(sum(e[s] for s in found)))
        hard = [s for s in order[q] if s not in found][:16]
        pairs += [max(0.0, 0.5 - cos(vecs[q], vecs[p]) + cos(vecs[q], vecs[h])) for p in found for h in hard]
    assert tuple(losses.info_nce_over_all(queries, slots, required, 0.07, own=False).first()) == (6, 8, pytest.approx(np.mean(loss), abs=2e-6))
    assert tuple(losses.margin_over_all(queries, slots, required, 16, 0.5, own=False).first()) == (8 * 16, 8, pytest.approx(np.mean(pairs), abs=2e-6))
    none = required.limit(0)
    assert losses.info_nce_over_all(queries, slots, none, 0.07).first().rows == losses.margin_over_all(queries, slots, none, 4, 0.5).first().rows == 0


def test_text_hops_are_computed_once(spark):
    asked = spark.createDataFrame([(1, "red"), (2, "blue"), (3, None)], "query_id bigint, text string")
    facts = spark.createDataFrame([(0, "red green"), (1, "green blue"), (2, "blue grey"), (3, None)], "slot_id bigint, text string")
    colours, calls = ["red", "green", "blue", "grey"], []

    def encode(texts):
        calls.append(1)
        held = F.split(F.coalesce("text", F.lit("")), " ")
        count = lambda c: F.size(F.filter(held, lambda w: w == c))
        return texts.select("query_id", F.array(*((count(c) + 0.001 * (i + 1)).cast("double") for i, c in enumerate(colours))).alias("vec"))

    slots = encode(facts.withColumnRenamed("slot_id", "query_id")).withColumnRenamed("query_id", "slot_id")
    found, walked = retrieve.iterate_text(asked, facts, slots, encode, 1, 3)
    assert len(calls) == 4
    assert {(x.hop, x.query_id): x.slot_id for x in found.collect() if x.query_id < 3} == {(1, 1): 0, (2, 1): 0, (3, 1): 0, (1, 2): 2, (2, 2): 2, (3, 2): 2}
    assert {(x.query_id, x.rank) for x in walked.collect() if x.query_id < 3} == {(1, 1), (2, 1)}
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan  # each hop is read from its files
    forced = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 9)], "query_id bigint, pos int, slot_id bigint")
    steps = {(x.hop, x.query_id): x.slot_id for x in retrieve.iterate_text(asked, facts, slots, encode, 1, 3, forced)[0].collect()}
    assert steps[2, 1] != steps[1, 1] and steps[3, 1] == steps[1, 1] and steps[2, 2] == steps[1, 2]


def loop_encoder(model, heads, ids):
    """One sequence, position by position."""
    d, layers = len(model["tokens"][0]), sum(k.startswith("qkv_") for k in model)
    norm = lambda x, w: [v / math.sqrt(sum(y * y for y in x) / d + 1e-6) * g for v, g in zip(x, w, strict=True)]
    xs = [[a + b for a, b in zip(model["tokens"][t % len(model["tokens"])], model["positions"][p % len(model["positions"])], strict=True)] for p, t in enumerate(ids)]
    size = d // heads
    for layer in range(layers):
        rows = [mul(model[f"qkv_{layer}"], norm(x, model[f"norm1_{layer}"][0])) for x in xs]
        after = []
        for p, x in enumerate(xs):
            y = []
            for h in range(heads):
                q = rows[p][h * size : (h + 1) * size]
                e = [math.exp(sum(a * b for a, b in zip(q, rows[j][d + h * size : d + (h + 1) * size], strict=True)) / math.sqrt(size)) for j in range(p + 1)]
                y += [sum(w * rows[j][2 * d + h * size + i] for j, w in enumerate(e)) / sum(e) for i in range(size)]
            x = [a + b for a, b in zip(x, mul(model[f"proj_{layer}"], y), strict=True)]
            n = norm(x, model[f"norm2_{layer}"][0])
            gated = [g * sig(g) * u for g, u in zip(mul(model[f"gate_{layer}"], n), mul(model[f"up_{layer}"], n), strict=True)]
            after.append([a + b for a, b in zip(x, mul(model[f"down_{layer}"], gated), strict=True)])
        xs = after
    return mul(model["out"], norm(xs[-1], model["norm"][0]))


@pytest.mark.parametrize("cells", [1, 200, 1 << 20])
def test_encoder_equals_loops(spark, monkeypatch, cells):
    monkeypatch.setattr(encoder, "CELLS", cells)
    r, d, ff = random.Random(12), 4, 6
    model = {"tokens": mat(r, 11, d), "positions": mat(r, 5, d), "norm": mat(r, 1, d), "out": mat(r, 3, d)}
    for layer in (0, 1):
        model |= {f"qkv_{layer}": mat(r, 3 * d, d), f"proj_{layer}": mat(r, d, d), f"gate_{layer}": mat(r, ff, d), f"up_{layer}": mat(r, ff, d), f"down_{layer}": mat(r, d, ff), f"norm1_{layer}": mat(r, 1, d), f"norm2_{layer}": mat(r, 1, d)}
    rows = [(i, [r.randrange(40) for _ in range(n)], m) for i, (n, m) in enumerate([(1, 1), (2, 2), (3, 2), (9, 5), (9, 9), (17, 30), (33, 20), (5, None), (0, 0), (4, 0), (4, -1)])] + [(90, None, 3), (3, [1, 2, 3], 3)]
    df = spark.createDataFrame(rows, "query_id bigint, ids array<int>, prompt_len int").repartition(2)
    got = sorted(encoder.encode(df, neural.read_model(parameters(spark, model)), 2).collect(), key=lambda x: (x.query_id, x.vec is None, x.vec))
    want = []
    for i, ids, m in rows:
        head = (ids or [])[: len(ids or []) if m is None else max(m, 0)]
        want.append((i, loop_encoder(model, 2, head) if head else None))
    assert [x.query_id for x in got] == sorted(i for i, _ in want)
    for x, (_, vec) in zip(got, sorted(want, key=lambda t: (t[0], t[1] is None, t[1])), strict=True):
        assert x.vec == (None if vec is None else pytest.approx(vec, abs=1e-9))
    with pytest.raises(ValueError):
        encoder.Encoder(neural.read_model(parameters(spark, model)), 3)


def test_long_sequences_take_memory_by_length():
    import tracemalloc

    r = random.Random(1)
    model = {k: np.array(v) for k, v in {"tokens": mat(r, 7, 4), "positions": mat(r, 3, 4), "norm": mat(r, 1, 4), "out": mat(r, 2, 4), "qkv_0": mat(r, 12, 4), "proj_0": mat(r, 4, 4), "gate_0": mat(r, 6, 4), "up_0": mat(r, 6, 4), "down_0": mat(r, 4, 6), "norm1_0": mat(r, 1, 4), "norm2_0": mat(r, 1, 4)}.items()}
    tracemalloc.start()
    assert len(encoder.Encoder(model, 2)([np.arange(12_000)])[0]) == 2
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6  # whole attention would hold 2 x 12,000 x 12,000 doubles: 2.3 GB
