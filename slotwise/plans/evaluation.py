"""Queries that evaluate retrievers by mode, train-time losses, batches and generated data; registered beside the catalogue's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registered import vec_wavg
from ..functions.text import mix, tokens
from ..functions.vectors import cosine, dot, layer_norm, norm, relu, times, unit
from ..operators import chains, generate, kb, losses, metrics, product_key, retrieve, select
from ..operators import text as texts
from ..session import written
from ..sources.generated import star_names
from ..sources.measured import measured
from ..sources.tables import mode_of_run, model_type_of_run, table
from .catalogue import (
    DIM, KS, QUERIES, SELECTOR, _candidates, _codebook, _counts_at_8, _edges, _kb, _live, _meta, _prompts, _query_vecs, _ranked, _required, _searched, _shown, _slot_vecs, _slots, _variants, _vectors, query,
)


# --- retrievers ------------------------------------------------------------------------------------------------------
@query
def classifier_topk(spark, d):
    """Logits of a linear layer: the queries against weights that are not normalised, with a bias by slot."""
    ranked = retrieve.topk(_query_vecs(spark, d), _slot_vecs(spark, d).withColumn("vec", F.transform("vec", lambda x: x * (1 + F.col("slot_id") % 3))), 8, "dot", own=False)
    return _shown(ranked)


@query
def random_slots(spark, d):
    return retrieve.random_slots(_meta(spark, d), _live(spark, d), 8, 11)


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _text_vectors(spark, d, texts_of):
    """Each text(query_id, text) as the mean of its tokens' vectors; a token's vector is chosen by the first digits of its MD5."""
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    place = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 7), 16, 10).cast("bigint")
    words = texts_of.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).join(F.broadcast(n), F.lit(True))
    rows = words.groupBy("query_id", (place % F.col("n")).alias("vec_id")).agg(F.count("*").alias("w")).join(_vectors(spark, d), "vec_id")
    return rows.groupBy("query_id").agg(vec_wavg("w", "vec").alias("vec")).select("query_id", F.transform("vec", lambda x: F.round(x, 12)).alias("vec"))


@query
def text_query_topk(spark, d):
    return _shown(retrieve.topk(_text_vectors(spark, d, _items(spark, d)), _slot_vecs(spark, d), 8))


@query
def multi_query_text(spark, d):
    """Four texts of each question (itself, with its task, with its hops, task and hops alone), the best eight of each, as one list."""
    hops = F.concat((F.col("query_id") % 3 + 1).cast("string"), F.lit(" hops"))
    task = F.concat(F.lit("reading task "), (F.col("query_id") % 5).cast("string"))
    forms = (F.col("text"), F.concat_ws(" ", "text", task), F.concat_ws(" ", "text", hops), F.concat_ws(" ", task, hops))
    lists = [retrieve.topk(_text_vectors(spark, d, _items(spark, d).select("query_id", f.alias("text"))), _slot_vecs(spark, d), 8) for f in forms]
    return _shown(retrieve.union_queries(reduce(DataFrame.unionByName, lists), 16))


@query
def legacy_topk(spark, d):
    """The first dimensions of each state only, four slots each."""
    return _shown(retrieve.topk(_query_vecs(spark, d, 16), _slot_vecs(spark, d, 16), 4, own=False))


@query
def interface_report(spark, d):
    """Two retrievers side by side: how often their first k are the same list, and how often each finds a required slot there."""
    one, two = _ranked(spark, d, 32), retrieve.topk(_query_vecs(spark, d, 48), _slot_vecs(spark, d, 48), 32, own=False)
    same = retrieve.compare(one, two, (1, 8, 32))
    recall = lambda ranked, name: metrics.recall_at(metrics.required_counts(_required(spark, d), ranked, _meta(spark, d), (1, 8, 32))).select("k", F.col("recall").alias(name))
    return same.join(recall(one, "recall_one"), "k").join(recall(two, "recall_two"), "k")


@query
def interface_questions(spark, d):
    """The benchmark's questions under two interfaces: their texts, what each finds, and whether both search the same slot vectors."""
    asked = written(_text_vectors(spark, d, _items(spark, d)), "asked")
    slots = {64: _slot_vecs(spark, d), 48: _slot_vecs(spark, d, 48)}
    one, two = (retrieve.topk(asked.select("query_id", F.slice("vec", 1, n).alias("vec")), slots[n], 8) for n in slots)
    hashes = [retrieve.digest(slots[n], "slot_id").select(F.col("digest").alias(name)) for n, name in ((64, "slots_one"), (48, "slots_two"))]
    rows = _items(spark, d).select("query_id", F.col("text").alias("question")).join(retrieve.side_by_side(one, two, 8), "query_id")
    return rows.join(F.broadcast(hashes[0]), F.lit(True)).join(F.broadcast(hashes[1]), F.lit(True)).withColumn("same_slots", F.col("slots_one") == F.col("slots_two"))


def _adapted(spark, d):
    """Hidden states through layer norm, a layer of 16, a rectifier and a layer back to 64, as unit vectors; both layers are vectors of the table."""
    rows = _vectors(spark, d).where("vec_id < 80")
    first = rows.where("vec_id < 16").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "vec"))), lambda r: r["vec"]).alias("first"))
    second = rows.where("vec_id >= 16").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", F.slice("vec", 1, 16).alias("vec")))), lambda r: r["vec"]).alias("second"))
    states = _query_vecs(spark, d).join(F.broadcast(first), F.lit(True)).join(F.broadcast(second), F.lit(True))
    hidden = states.select("query_id", "second", relu(times(F.col("first"), layer_norm(F.col("vec")))).alias("hidden"))
    return hidden.select("query_id", F.transform(unit(times(F.col("second"), F.col("hidden"))), lambda x: F.round(x, 9)).alias("vec"))


@query
def adapter_topk(spark, d):
    return _shown(retrieve.topk(_adapted(spark, d), _slot_vecs(spark, d), 8, own=False))


@query
def pk_subscores_cosine(spark, d):
    return product_key.subscores(_query_vecs(spark, d), _codebook(spark, d), DIM, by_cosine=True).withColumn("score", F.round("score", 6))


@query
def graph_pairs(spark, d):
    """Neighbours by a pair scorer over the vectors of parts that share an order."""
    ranked = written(_ranked(spark, d, 3), "ranked")
    pairs = retrieve.pair_scores(_slot_vecs(spark, d), _slot_vecs(spark, d), _edges(spark, d, ranked), [0.8, -0.05, 0.1], -0.5)
    return retrieve.expand_by_graph(ranked, pairs, 4, 10)


def _part(spark, d, first, start):
    return retrieve.topk(_query_vecs(spark, d, first, start), _slot_vecs(spark, d, first, start), 64, own=False)


def _grown(spark, d, ranked):
    anchors = ranked.where("rank <= 8")
    found = retrieve.expand_by_graph(anchors, _edges(spark, d, anchors), 8, 64)
    return found.select("query_id", F.col("place").alias("rank"), "slot_id")


class Once:
    """Relations of one run by name, each written the first time that it is asked for, so that no retrieval is done twice."""

    def __init__(self, spark, d):
        self.spark, self.d, self.found = spark, d, {}

    def __call__(self, name: str, make) -> DataFrame:
        if name not in self.found:
            self.found[name] = written(make(self.spark, self.d), name)
        return self.found[name]

    def ranked(self) -> DataFrame:
        return self("ranked", _ranked)

    def required(self) -> DataFrame:
        return self("required", _required)

    def part(self, first: int, start: int) -> DataFrame:
        return self(f"part-{first}-{start}", lambda spark, d: _part(spark, d, first, start))


def _walked(o: Once, forced: DataFrame | None = None) -> DataFrame:
    return retrieve.iterate(_query_vecs(o.spark, o.d), _slot_vecs(o.spark, o.d), 16, 3, forced, own=False)


#: What each retriever mode does; modes that differ by training are stood in for by different dimensions.
RETRIEVERS = {
    "dual_encoder_baseline": Once.ranked,
    "chain_set_bce": lambda o: o.part(48, 1),
    "chain_set_infonce": lambda o: o.part(48, 17),
    "chain_set_bce_hardneg": lambda o: o.part(40, 1),
    "slot_graph_expansion": lambda o: _grown(o.spark, o.d, o.ranked()),
    "chain_set_plus_graph_expansion": lambda o: _grown(o.spark, o.d, o.part(48, 1)),
    "iterative_chain": _walked,
    "iterative_chain_teacher_forced": lambda o: _walked(o, o.required()),
}


def retrieved(spark, d, mode, once: Once | None = None):
    """query_id, rank and slot_id of a mode's first 64."""
    if mode not in RETRIEVERS:
        raise ValueError(f"unknown retriever mode {mode}")
    return RETRIEVERS[mode](once or Once(spark, d)).where("rank <= 64").select("query_id", "rank", "slot_id")


def _by_mode(spark, d):
    once = Once(spark, d)
    every = reduce(DataFrame.unionByName, [retrieved(spark, d, mode, once).withColumn("mode", F.lit(mode)) for mode in RETRIEVERS])
    return metrics.by_mode(once.required(), written(every, "modes"), KS)


@query
def retriever_modes(spark, d):
    return _by_mode(spark, d)[0]


@query
def retriever_mode_failures(spark, d):
    return _by_mode(spark, d)[1]


@query
def iterative_retrieval(spark, d):
    return retrieve.iterate(_query_vecs(spark, d), _slot_vecs(spark, d), 8, 3, own=False)


# --- losses ----------------------------------------------------------------------------------------------------------
#: What slots are compared by, the more telling first. A slot's part has all but the type of its answer.
ATTRIBUTES = ("entity_type", "relation", "api_family", "answer_type", "template", "output_family")


def _hard_scores(spark, d):
    """Required slots, and for each 16 negatives: half of them slots that share an attribute with a required one, where there are so many.

    A slot's attributes are those of the part of its id, and its label.
    """
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("slot_id"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("relation"), F.col("p_size").cast("string").alias("api_family"), word(1).alias("template"), word(-1).alias("output_family"))
    meta = _slots(spark, d).where("value_token is not null").select("slot_id", F.col("label").cast("string").alias("answer_type")).join(part, "slot_id", "left")
    drawn = select.structured_negatives(_required(spark, d).select("query_id", "slot_id"), meta, "slot_id", list(ATTRIBUTES), 16, 0.5, 5)
    return retrieve.score_given(drawn, _query_vecs(spark, d), _slot_vecs(spark, d)).join(drawn, ["query_id", "slot_id"])


@query
def structured_negatives(spark, d):
    return _hard_scores(spark, d).select("query_id", "slot_id", "positive", "hard", "matched")


@query
def loss_structured_bce(spark, d):
    return losses.sampled_bce(_hard_scores(spark, d), 5.0, 0.07)


def _sampled_scores(spark, d):
    """Required slots and 48 live others of each query."""
    drawn = select.noisy(_required(spark, d), _live(spark, d), 48, 0.0, 23, 2**31 - 1).select("query_id", "slot_id", F.col("is_required").alias("positive"))
    return retrieve.score_given(drawn, _query_vecs(spark, d), _slot_vecs(spark, d)).join(drawn, ["query_id", "slot_id"])


@query
def loss_infonce_sampled(spark, d):
    return losses.info_nce(_sampled_scores(spark, d), 0.07)


@query
def loss_margin_sampled(spark, d):
    return losses.margin(_sampled_scores(spark, d), 16, 0.5)


@query
def loss_dual_encoder(spark, d):
    """Queries against the first required slots of their batch; the same slot is a positive."""
    first = _required(spark, d).where("pos = 1").join(_query_vecs(spark, d), "query_id").withColumn("batch", F.floor(F.col("query_id") / 320))
    slots = first.select(F.col("query_id").alias("b"), F.col("slot_id").alias("other"), "batch").join(_slot_vecs(spark, d).select(F.col("slot_id").alias("other"), F.col("vec").alias("sv")), "other")
    pairs = first.join(slots, "batch")
    return losses.contrastive(pairs.select(F.col("query_id").alias("a"), "b", (F.col("slot_id") == F.col("other")).alias("same"), F.round(cosine(F.col("vec"), F.col("sv")), 9).alias("sim")), 0.07)


@query
def loss_selector_bce(spark, d):
    z = F.lit(SELECTOR["bias"])
    for name in ("score", "place", "margin", "normalised"):
        z = z + F.col(name) * SELECTOR[name]
    rows = select.features(_candidates(spark, d)).select(F.col("is_required").alias("positive"), z.alias("score"))
    return losses.weighted_bce(rows, 3.0)


@query
def loss_adapter(spark, d):
    """How far adapted states are from their first required slots, and the cross-entropy of finding these among all slots."""
    first = _required(spark, d).where("pos = 1").select("query_id", "slot_id")
    adapted = _adapted(spark, d)
    apart = retrieve.score_given(first, adapted, _slot_vecs(spark, d)).agg(F.round(F.avg(F.lit(1.0) - F.col("score")), 6).alias("alignment"))
    return losses.retrieval_ce(adapted, _slot_vecs(spark, d), first, 0.07, own=False).join(F.broadcast(apart), F.lit(True))


@query
def loss_tokens(spark, d):
    """The answers of all prompts under a bigram model of the prompts themselves."""
    from ..functions.text import labels

    prompts = _prompts(spark, d).select("ids", labels(F.col("ids"), F.col("prompt_len")).alias("labels"))
    return losses.token_ce(prompts, losses.bigrams(prompts), 1000)


# --- diagnostics -----------------------------------------------------------------------------------------------------
@query
def dataset_alignment(spark, d):
    """Of each split of the generated examples: how many answers end their facts, stand in no question, and are in train's vocabulary."""
    rows = _examples(spark, d)
    known = rows.where("split = 'train'").select(F.col("answer").alias("known")).distinct()
    rows = rows.join(known, F.col("answer") == F.col("known"), "left")
    aligned = F.endswith(F.element_at("facts", -1), F.concat(F.lit(" "), F.col("answer"), F.lit(" .")))
    return rows.groupBy("split").agg(F.count("*").alias("examples"), F.count_if(aligned).alias("aligned"), F.count_if(F.contains("question", "answer")).alias("leaked"), F.count_if(F.col("known").isNotNull()).alias("answers_in_train"), F.count_distinct("answer").alias("distinct_answers"))


@query
def weighted_loss(spark, d):
    """Each day and type of events is a batch; its loss is the mean value."""
    batches = table(spark, d, "events").where("value is not null").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"), F.count("*").alias("size"))
    return metrics.weighted_mean(batches, "loss", "size")


@query
def batch_cosine_mean(spark, d):
    return metrics.mean_of_batch_means(_ranked(spark, d, 1), F.floor(F.col("query_id") / 320), "score")


@query
def qa_report(spark, d):
    """Accuracy by scope, recall at 8 and required-set metrics at 8 of the retriever, as one row."""
    need, ranked = _searched(spark, d)
    counts = _counts_at_8(spark, d, need, ranked)
    sets = metrics.required_set(counts).where("hops = -1").select("any_required", "all_required", "coverage")
    right = _variants(spark, d, need, ranked).where("variant = 'retrieved'")
    scope = lambda s: F.max(F.when(F.col("scope") == s, F.col("accuracy"))).alias(s)
    wide = right.agg(*(scope(s) for s in ("overall", "single_hop", "two_hop", "three_hop")), F.max(F.when(F.col("scope") == "overall", F.col("n"))).alias("examples"))
    return wide.join(F.broadcast(sets), F.lit(True)).join(F.broadcast(metrics.recall_at(counts).select("recall")), F.lit(True))


@query
def comparison_report(spark, d):
    """The comparison of all variants with its nine columns; params are the numbers of a classifier's matrix, with one row of the vectors' length for each label."""
    scopes = ("single_hop", "two_hop", "three_hop", "overall")
    need, ranked = _searched(spark, d)
    variants = _variants(spark, d, need, ranked)
    wide = variants.groupBy(F.col("variant").alias("model")).agg(*(F.max(F.when(F.col("scope") == s, F.col("accuracy"))).alias(s) for s in scopes))
    gaps = metrics.derived(variants).where("scope = 'overall'").select("oracle_gap", "dense_gap")
    recall = metrics.recall_at(_counts_at_8(spark, d, need, ranked)).select(F.col("recall").alias("recall_at_8"))
    size = _vectors(spark, d).groupBy("label").agg(F.max(F.size("vec")).alias("n")).agg(F.sum("n").alias("params"))
    rows = wide
    for one in (gaps, recall, size):
        rows = rows.join(F.broadcast(one), F.lit(True))
    return rows.select("model", "params", *(F.format_number(c, 3).alias(c) for c in (*scopes, "recall_at_8", "oracle_gap", "dense_gap")))


@query
def run_modes(spark, d):
    """The mode and kind of model that a run's name says; names are made of events' types and users."""
    parts = ("oracle_text", "retrieved_oracle", "multi_query", "hidden_adapter", "memory_adapter", "memory_adapter_pretrain", "oracle", "retrieved", "random", "core_only", "dense", "exp_001_retrieval", "plain")
    word = F.element_at(F.array(*(F.lit(p) for p in parts)), (F.col("user_id") % len(parts) + 1).cast("int"))
    names = table(spark, d, "events").where("user_id is not null").select(F.concat_ws("_", "event_type", word).alias("name")).distinct()
    return names.select("name", mode_of_run(F.col("name")).alias("mode"), model_type_of_run(F.col("name")).alias("model_type"))


# --- examples and batches --------------------------------------------------------------------------------------------
@query
def required_texts(spark, d):
    """The text of each required slot in the deduplicated facts; dead slots have none and get a default."""
    live = _kb(spark, d).where("slot_id % 7 <> 3").select(F.col("slot_id").cast("bigint").alias("slot_id"), "text")
    return _required(spark, d).join(live, "slot_id", "left").select("query_id", "pos", "slot_id", F.coalesce("text", F.lit("<missing>")).alias("text"))


@query
def padded_slots(spark, d):
    """Noisy lists of eight places; places without a slot have -1 and a score of minus infinity."""
    rows = select.padded(select.noisy(_required(spark, d), _live(spark, d), 4, 0.5, 42, 8), 8)
    return rows.select("query_id", "pos", "slot_id", (F.col("score") == float("-inf")).alias("is_pad"), "is_required")


@query
def unpadded_slots(spark, d):
    """The same lists as arrays without padding, and how long they are."""
    rows = select.padded(select.noisy(_required(spark, d), _live(spark, d), 4, 0.5, 42, 8), 8)
    lists = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "slot_id"))), lambda r: r["slot_id"]).alias("slots"))
    kept = F.filter("slots", lambda s: s >= 0)
    return lists.select("query_id", F.array_join(kept, ",").alias("slots"), F.size(kept).alias("n"))


@query
def slots_in_range(spark, d):
    """Required slots below the number of live slots; the others are out of range."""
    live = _live(spark, d).agg(F.count_if("live").alias("num_live"))
    rows = _required(spark, d).join(F.broadcast(live), F.lit(True))
    return rows.select("query_id", "pos", "slot_id", F.col("slot_id").between(0, F.col("num_live") - 1).alias("in_range"))


@query
def kb_tensor(spark, d):
    """Value tokens by slot id of a table of 100,000 addresses, grown where there are more slots; the rows say how much of it is live."""
    slots = _kb(spark, d)
    found = written(kb.value_tokens(slots, texts.build_vocab(slots)), "value-tokens")
    return kb.tensor(found, 100_000).agg(F.count("*").alias("slots"), F.count("value_token").alias("live"), F.max("slot_id").cast("bigint").alias("last"), F.sum("value_token").alias("token_sum"))


@query
def shuffled_batches(spark, d):
    """Documents in a fixed mixed order, in batches of 16; the last may be smaller."""
    key = mix(F.col("doc_id"), 42)
    rows = texts.dense_id(table(spark, d, "documents").select("doc_id"), F.struct(key, "doc_id"), F.floor(key / 2**17), "place")
    return rows.select("doc_id", "place", F.floor(F.col("place") / 16).cast("int").alias("batch_id"))


@query
def collated_batches(spark, d):
    """Prompts in padded batches with masks; the ids of all turns of a prompt's conversation stand for required slots."""
    prompts = _prompts(spark, d)
    ids = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("required"))
    rows = texts.collate(texts.pad_batches(prompts.join(ids, "conv_id"), F.struct("conv_id", "turn"), F.floor(F.col("conv_id") / 1024), 8))
    return rows.select("conv_id", "turn", "batch_id", F.array_join("mask", "").alias("mask"), F.array_join("required_padded", ",").alias("required"))


@query
def open_book_prompts(spark, d):
    """Every two-hop chain's question, in each form, with the text of its first fact before it, as ids of the vocabulary of facts and questions."""
    asked = chains.examples(chains.chain(kb.triples(spark, d, chains.PATHS["two_hop_reasoning"]), "two_hop_reasoning"), 2**31 - 1)
    asked = asked.select(F.col("subject").alias("asked"), "template", "question", "answer")
    rows = asked.join(_kb(spark, d).select("subject", "text"), F.col("asked") == F.col("subject")).select("asked", "template", "question", "answer", "text")
    vocab = texts.build_vocab(rows.select(F.concat_ws(" ", "text", "question", "answer").alias("text")))
    coded = lambda c: texts.encode(rows.select("asked", "template", F.col(c).alias("text")), vocab, ["asked", "template"]).withColumnRenamed("ids", c)
    ids = coded("question").join(coded("answer"), ["asked", "template"]).join(coded("text"), ["asked", "template"])
    seq = texts.qa_sequence(F.col("question"), F.col("answer"), None, F.array("text"))
    return ids.select("asked", "template", seq.alias("s")).select("asked", "template", "s.prompt_len", F.array_join("s.ids", ",").alias("ids"))


@query
def fact_sequences(spark, d):
    facts = _kb(spark, d).select("slot_id", "text")
    ids = texts.encode(facts, texts.build_vocab(facts), ["slot_id"])
    return ids.select("slot_id", texts.fact_sequence(F.col("ids")).alias("s")).select("slot_id", "s.prompt_len", F.array_join("s.ids", ",").alias("ids"))


@query
def first_examples(spark, d):
    """The first 100 examples in a fixed order, as a limit of an evaluation asks for."""
    rows = chains.examples(chains.chain(kb.triples(spark, d, chains.PATHS["two_hop_reasoning"]), "two_hop_reasoning"), 5)
    return rows.orderBy("question", "answer", "subject", "template").limit(100).select("subject", "template", "question", "answer")


@query
def task_rotation(spark, d):
    """Parts dealt to the five task types in turn."""
    rows = texts.dense_id(table(spark, d, "part").select("p_partkey"), F.col("p_partkey"), F.floor(F.col("p_partkey") / 4096), "nth")
    return rows.select("p_partkey", F.element_at(F.array(*(F.lit(t) for t in generate.TASKS)), F.col("nth") % len(generate.TASKS) + 1).alias("task_type"))


@query
def stage_by_epoch(spark, d):
    """Days of events as epochs, and the curriculum stage that each falls into; the last stage goes on."""
    days = table(spark, d, "events").where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    first = table(spark, d, "events").agg(F.to_date(F.min("ts")).alias("first"))
    epochs = days.join(F.broadcast(first), F.lit(True)).select(F.datediff("day", "first").alias("epoch"), "events")
    return metrics.staged(epochs, "epoch", (2, 3, 5)).select("epoch", "events", "stage")


# --- ingest and cost -------------------------------------------------------------------------------------------------
@query
def kb_first_seen(spark, d):
    """How customers order, as facts with slots in the order in which the orders table first has them."""
    rows = texts.sequenced(table(spark, d, "orders")).where("o_custkey is not null and o_orderpriority is not null")
    return kb.first_seen_slots(rows.select(kb._key("customer", "o_custkey").alias("subject"), F.lit("orders_at").alias("relation"), kb._key("priority", "o_orderpriority").alias("object"), "seq"))


@query
def throughput_report(spark, d):
    """Rows and tokens of two queries, measured while they are written, and whether a rate and a peak of memory came of it."""
    costs = {"tokenize_counts": measured(QUERIES["tokenize_counts"](spark, d)), "documents": measured(table(spark, d, "documents").orderBy("text"), text_col="text")}
    rows = [(name, c.rows, c.tokens, c.rows_per_second > 0, c.tokens_per_second > 0, c.peak_task_bytes > 0) for name, c in costs.items()]
    return spark.createDataFrame(rows, "query string, rows bigint, tokens bigint, has_row_rate boolean, has_token_rate boolean, has_peak boolean")


# --- generated data --------------------------------------------------------------------------------------------------
def _chains(spark, d):
    """A chain for each part."""
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("chain_id"), generate.split_of(F.col("p_partkey")).alias("split"))
    return generate.chains(ids, *star_names(spark, d), 7)


def _examples(spark, d):
    """An example for each customer."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("example_id"), generate.split_of(F.col("c_custkey")).alias("split"))
    return generate.examples(_chains(spark, d), ids, 7)


@query
def generated_names(spark, d):
    """The pool of each word of a name under each separation."""
    nouns, verbs = star_names(spark, d)
    rows = [generate.pools(words, s, kind).select(F.lit(s).alias("separation"), F.lit(kind).alias("kind"), "word", "pool") for s in generate.SEPARATIONS for kind, words in (("noun", nouns), ("verb", verbs))]
    return reduce(DataFrame.unionByName, rows)


@query
def generated_facts(spark, d):
    """Chains of all task types; no two have equal facts."""
    return _chains(spark, d).select("chain_id", "split", "task_type", "hops", F.array_join("facts", " | ").alias("facts"), "subject", "answer")


@query
def generated_examples(spark, d):
    return _examples(spark, d).select("example_id", "chain_id", "split", "task_type", "question", "answer", "hops")
