"""Queries with layers over vectors and text iteration; the layers' matrices are rows of the vectors table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registered import dealt, register
from ..operators import encoder, kb, losses, metrics, neural, retrieve, select
from ..session import written
from .catalogue import DIM, _candidates, _live, _prompts, _query_vecs, _ranked, _required, _shown, _slot_values, _slot_vecs, _slots, _vectors, query
from .evaluation import _items, _text_vectors

HEAD_SLOTS = 8
#: The selector takes slots of at least this probability.
TAKE = 0.49
#: Matrices by name: the first vector, the number of vectors, the first dimension and the number of dimensions.
HEAD = {"memory": (0, 32, 1, 64), "gate": (32, 32, 1, 64), "key": (64, 32, 1, 64), "value": (96, 32, 1, 64), "joined": (128, 32, 1, 64), "query": (160, 32, 1, 32), "gate_bias": (192, 1, 1, 32)}
SELECTOR_MLP = {
    "w_query": (0, 32, 1, 64), "w_slot": (32, 32, 1, 64), "w_value": (64, 32, 1, 64), "w_scalars": (96, 32, 1, 4), "w_hops": (96, 32, 5, 16), "hops": (128, 4, 1, 16),
    "w_second": (132, 32, 1, 32), "w_last": (164, 1, 1, 32), "b_first": (165, 1, 1, 32), "b_second": (166, 1, 1, 32), "b_last": (167, 1, 1, 1),
}
ENCODER = {"tokens": (0, 256, 1, 16), "positions": (256, 64, 1, 16), "norm": (466, 1, 1, 16), "out": (467, 32, 1, 16)}
for _l in (0, 1):
    ENCODER |= {
        f"qkv_{_l}": (320, 48, 16 * _l + 1, 16), f"proj_{_l}": (368, 16, 16 * _l + 1, 16), f"gate_{_l}": (384, 32, 16 * _l + 1, 16), f"up_{_l}": (416, 32, 16 * _l + 1, 16), f"down_{_l}": (448, 16, 32 * _l + 1, 32),
        f"norm1_{_l}": (464, 1, 16 * _l + 1, 16), f"norm2_{_l}": (465, 1, 16 * _l + 1, 16),
    }
HEADS = 2
PAIR = {"w_anchor": (200, 16, 1, 64), "w_slot": (216, 16, 1, 64), "w_second": (232, 16, 1, 16), "w_last": (248, 1, 1, 16), "b_first": (249, 1, 1, 16), "b_second": (250, 1, 1, 16)}

MODELS = {"head": HEAD, "selector": SELECTOR_MLP, "encoder": ENCODER, "pair": PAIR}


def _model(spark, d, layout):
    rows = _vectors(spark, d).select("vec_id", "vec")
    cut = lambda first, n, start, dims: rows.where((F.col("vec_id") >= first) & (F.col("vec_id") < first + n)).select((F.col("vec_id") - first).alias("row"), F.slice("vec", start, dims).alias("vec"))
    return neural.read_model(neural.stack([(name, cut(*at)) for name, at in layout.items()]))


def _memory(spark, d):
    """The first slots of each query with equal weights among the live ones."""
    return neural.memories(select.weigh(_candidates(spark, d, HEAD_SLOTS), "uniform_mean"), _slot_values(spark, d))


def _integrated(spark, d, mode):
    return neural.integrate(_query_vecs(spark, d, DIM), _memory(spark, d), _model(spark, d, HEAD), mode)


def _head(mode):
    def run(spark, d):
        return _integrated(spark, d, mode).select("query_id", F.posexplode("vec").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("dim"), (F.round("x", 6) + 0.0).alias("value"))

    return run


for _mode in neural.MODES:
    _run = _head(_mode)
    _run.__name__ = f"memory_{_mode}"
    query(_run)


@query
def memory_diagnostics(spark, d):
    """Of each mode: queries, mean gate, norm of what is read and share of the state that it changes."""
    out = None
    for mode in neural.MODES:
        rows = _integrated(spark, d, mode).agg(F.lit(mode).alias("mode"), F.count("*").alias("rows"), *(F.round(F.avg(c), 6).alias(c) for c in ("gate_mean", "memory_norm", "residual_ratio")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _ratio():
    return F.col("memory_norm") / F.greatest("state_norm", F.lit(1e-8))


@query
def gate_stats(spark, d):
    """The gates of all queries' memory heads, and the norms of what they read and of the states it goes to."""
    mean = lambda c: F.round(F.avg(c), 6)
    rows = _integrated(spark, d, "gated_sum")
    return rows.agg(F.count("*").alias("rows"), mean("gate_mean").alias("gate_mean"), F.round(F.min("gate_min"), 6).alias("gate_min"), F.round(F.max("gate_max"), 6).alias("gate_max"), mean("memory_norm").alias("memory_norm"), mean("state_norm").alias("residual_norm"), mean(_ratio()).alias("memory_residual_ratio"))


@query
def detailed_predictions(spark, d):
    """Each query's prediction beside its gold answer, with the slots that went in, and the gate and norms of what its memory head read."""
    label = _slots(spark, d).select("slot_id", "label")
    noisy = select.noisy(_required(spark, d), _live(spark, d), 4, 0.5, 42, 8)
    listed = lambda keep: F.array_join(F.transform(F.filter("rows", keep), lambda r: r["slot_id"].cast("string")), ",")
    slots = noisy.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slot_id", "is_required"))).alias("rows"))
    slots = slots.select("query_id", listed(lambda r: r["is_required"]).alias("required_slots"), listed(lambda r: ~r["is_required"]).alias("distractor_slots"), F.size(F.filter("rows", lambda r: ~r["is_required"])).alias("num_distractors"))
    gold = _required(spark, d).where("pos = 1").join(label, "slot_id").select("query_id", "hops", F.col("label").alias("gold_answer"))
    best = _ranked(spark, d, 1).join(label, "slot_id").select("query_id", F.col("label").alias("prediction"))
    read = _integrated(spark, d, "gated_sum").select("query_id", *(F.round(c, 6).alias(name) for c, name in ((F.col("gate_mean"), "gate_mean"), (F.col("memory_norm"), "memory_norm"), (_ratio(), "memory_residual_ratio"))))
    return gold.join(best, "query_id").join(read, "query_id").join(slots, "query_id").withColumn("correct", F.col("prediction") == F.col("gold_answer"))


@query
def parameter_count(spark, d):
    """The numbers in all models' matrices; a matrix that several models share counts once."""
    rows = _vectors(spark, d).select("vec_id", "vec")
    parts = []
    for model, layout in MODELS.items():
        for name, (first, n, start, dims) in layout.items():
            inside = rows.where((F.col("vec_id") >= first) & (F.col("vec_id") < first + n))
            parts.append(inside.agg(F.lit(f"{model}.{name}").alias("name"), F.lit(f"{first}-{n}-{start}-{dims}").alias("tensor"), F.coalesce(F.sum(F.size(F.slice("vec", start, dims))), F.lit(0)).alias("numel")))
    return metrics.parameter_count(reduce(DataFrame.unionByName, parts))


def _selector(spark, d):
    return neural.selector_logits(select.features(_candidates(spark, d)), _query_vecs(spark, d), _slot_vecs(spark, d), _slot_values(spark, d), _model(spark, d, SELECTOR_MLP))


def _chosen(spark, d):
    return neural.taken(_selector(spark, d), TAKE)


@query
def selector_mlp(spark, d):
    return _chosen(spark, d).select("query_id", "slot_id", F.round("logit", 6).alias("logit"), F.round("prob", 6).alias("prob"), "taken")


@query
def selector_mlp_top3(spark, d):
    return neural.taken(_selector(spark, d), top_n=3).where("taken").select("query_id", "slot_id", "place")


@query
def selector_mlp_read(spark, d):
    return select.read_values(neural.read_taken(_chosen(spark, d)).drop("value"), _slot_values(spark, d), 2 * DIM)


@query
def selector_mlp_prf(spark, d):
    return metrics.selector_macro(_chosen(spark, d), _required(spark, d))


@query
def loss_selector_mlp(spark, d):
    return losses.weighted_bce(_selector(spark, d).select(F.col("is_required").alias("positive"), F.col("logit").alias("score")), 3.0)


def _pairs(spark, d, ranked):
    """The four best partners of every ranked slot; these are written, so that they are not looked for again to be counted."""
    anchors = written(ranked.select("slot_id").distinct().join(_slot_vecs(spark, d), "slot_id"), "anchors")
    return neural.pair_topk(anchors, _slot_vecs(spark, d), _model(spark, d, PAIR), 4)


@query
def pair_mlp_topk(spark, d):
    """The four best partners of every slot that is among the first three of a query."""
    return _pairs(spark, d, _ranked(spark, d, 3)).withColumn("weight", F.round("weight", 6))


@query
def pair_mlp_expand(spark, d):
    """The first three slots of each query, then their partners, up to ten."""
    ranked = written(_ranked(spark, d, 3), "ranked")
    return retrieve.expand_by_graph(ranked, _pairs(spark, d, ranked).drop("rank"), 4, 10)


def _encoded_prompts(spark, d):
    """The encoder's vector of every prompt of the conversations, whole."""
    key = F.col("conv_id") * 4096 + F.col("turn")
    return encoder.encode(_prompts(spark, d).select(key.alias("query_id"), "ids", "prompt_len"), _model(spark, d, ENCODER), HEADS)


@query
def encoded_prompts(spark, d):
    return _encoded_prompts(spark, d).select("query_id", F.posexplode("vec").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("dim"), (F.round("x", 6) + 0.0).alias("value"))


@query
def encoded_topk(spark, d):
    """The slots that are nearest to each prompt, over the first half of the dimensions."""
    asked = written(_encoded_prompts(spark, d).select("query_id", F.transform("vec", lambda x: F.round(x, 9)).alias("vec")), "asked")
    return _shown(retrieve.topk(asked, _slot_vecs(spark, d, DIM), 8))


def _facts(spark, d):
    """Facts of nations, customers, suppliers and parts, as slots with texts."""
    return kb.slot_table(kb.triples(spark, d, ("nation", "customer", "supplier", "part"))).select("slot_id", "text")


def _text_hops(spark, d, forced=None):
    facts = _facts(spark, d)
    slots = _text_vectors(spark, d, facts.select(F.col("slot_id").alias("query_id"), "text")).withColumnRenamed("query_id", "slot_id")
    return retrieve.iterate_text(_items(spark, d), facts, slots, lambda asked: _text_vectors(spark, d, asked), 8, 3, forced)


@query
def iterative_text(spark, d):
    """Three hops over the benchmark's texts: each later one asks with the question and the text that the hop before found first."""
    return _text_hops(spark, d)[1]


@query
def iterative_text_hops(spark, d):
    """What each hop found."""
    return _text_hops(spark, d)[0].withColumn("score", F.round("score", 6))


@query
def iterative_text_forced(spark, d):
    """The same, led by two given slots of each question instead of what was found."""
    lead = _items(spark, d).select("query_id", F.posexplode(F.array((F.col("query_id") * 7) % 100, (F.col("query_id") * 11) % 100)).alias("pos", "slot_id")).withColumn("pos", F.col("pos") + 1)
    return _text_hops(spark, d, lead)[1]


# --- functions registered for SQL --------------------------------------------------------------------------------------
def _views(spark, d, **frames):
    """Temporary views of names of their own, so that queries that run beside each other do not meet; their names by key."""
    register(spark)
    names = {key: f"{key}_{uuid.uuid4().hex}" for key in frames}
    for key, frame in frames.items():
        frame.createOrReplaceTempView(names[key])
    return names


@query
def sql_score_given(spark, d):
    """score_given as SQL text with the registered functions."""
    v = _views(spark, d, pairs=_required(spark, d), queries=_query_vecs(spark, d), slots=_slot_vecs(spark, d))
    return spark.sql(f"""select query_id, slot_id, round(cosine(q.vec, s.vec), 6) as cosine, round(dot(q.vec, s.vec), 6) as dot
        from {v["pairs"]} join {v["queries"]} q using (query_id) join {v["slots"]} s using (slot_id)""")


@query
def sql_vec_wavg(spark, d):
    """The mean vector of each list of neighbours: the first 16 slots of each query."""
    v = _views(spark, d, ranked=_ranked(spark, d, 16), slots=_slot_vecs(spark, d))
    return spark.sql(f"""select query_id, i + 1 as dim, round(m[i], 6) + 0.0 as value from (
        select query_id, vec_wavg(1, vec) as m from {v["ranked"]} join {v["slots"]} using (slot_id) group by query_id) lateral view explode(sequence(0, {2 * DIM - 1})) t as i""")


@query
def sql_topk_scan(spark, d):
    """cosine_topk as SQL text: the table function over pairs of blocks, then the best of all blocks."""
    v = _views(spark, d, dealt=dealt(_query_vecs(spark, d), _slot_vecs(spark, d), 8, own=False))
    return spark.sql(f"""select query_id, rank, slot_id, round(score, 6) as score from (
        select *, row_number() over (partition by query_id order by score desc, slot_id) as rank from topk_scan(table({v["dealt"]}) partition by block)) where rank <= 8""")
