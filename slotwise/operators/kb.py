"""Facts as triples of the star tables, the deduplicated slot table, and its inspection."""

from __future__ import annotations

from collections.abc import Container
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNK, tokens
from ..sources.tables import table
from .text import first_seen, ranged_id


def _key(kind: str, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{kind}_"), F.regexp_replace(value.cast("string"), "[^A-Za-z0-9]", "_"))


def triples(spark: SparkSession, sf_dir: str, kinds: Container[str] | None = None) -> DataFrame:
    """subject, relation and object of every fact of the star tables, or only of those about subjects of some kinds: other tables are not read."""
    t = lambda name: table(spark, sf_dir, name)
    named = lambda: F.broadcast(t("nation").select(F.col("n_nationkey").alias("nk"), _key("nation", "n_name").alias("object")))
    parts = {
        "nation": lambda: t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(_key("nation", "n_name").alias("subject"), F.lit("in").alias("relation"), _key("region", "r_name").alias("object")),
        "customer": lambda: t("customer").join(named(), F.col("c_nationkey") == F.col("nk")).select(_key("customer", "c_custkey").alias("subject"), F.lit("from").alias("relation"), "object"),
        "supplier": lambda: t("supplier").join(named(), F.col("s_nationkey") == F.col("nk")).select(_key("supplier", "s_suppkey").alias("subject"), F.lit("from").alias("relation"), "object"),
        "order": lambda: t("orders").select(_key("order", "o_orderkey").alias("subject"), F.lit("by").alias("relation"), _key("customer", "o_custkey").alias("object")),
        "line": lambda: t("lineitem").select(_key("line", F.concat_ws("_", "l_orderkey", "l_linenumber")).alias("subject"), F.lit("of").alias("relation"), _key("supplier", "l_suppkey").alias("object")),
        "part": lambda: t("part").select(_key("part", "p_partkey").alias("subject"), F.lit("made_as").alias("relation"), _key("brand", "p_brand").alias("object")),
    }
    return reduce(DataFrame.unionByName, [make() for kind, make in parts.items() if kinds is None or kind in kinds])


def slot_table(facts: DataFrame) -> DataFrame:
    """kb(slot_id, text, embedding_target, subject): one slot for each distinct text, ids dense in the order of texts."""
    text = F.concat(F.concat_ws(" ", "subject", "relation", "object"), F.lit(" ."))
    kb = facts.select(text.alias("text"), F.col("object").alias("embedding_target"), "subject").groupBy("text").agg(F.min("embedding_target").alias("embedding_target"), F.min("subject").alias("subject"))
    return numbered(kb)


def first_seen_slots(facts: DataFrame) -> DataFrame:
    """kb(slot_id, text, embedding_target, subject) of facts(subject, relation, object, seq): slots in the order in which texts are first seen, with the target and subject of that first fact."""
    text = F.concat(F.concat_ws(" ", "subject", "relation", "object"), F.lit(" ."))
    rows = facts.select(text.alias("text"), "seq", F.struct("seq", F.col("object").alias("target"), "subject").alias("fact"))
    first = rows.groupBy("text").agg(F.min("fact").alias("fact")).select("text", F.col("fact.seq").alias("seq"), F.col("fact.target").alias("embedding_target"), F.col("fact.subject").alias("subject"))
    ids = first_seen(first, ["text", "embedding_target", "subject"], "seq", "slot_id")
    return ids.select("slot_id", "text", "embedding_target", "subject")


def numbered(facts: DataFrame) -> DataFrame:
    """facts(text, embedding_target, subject) of different texts with dense slot ids in the order of texts."""
    return ranged_id(facts, "text", "slot_id").select("slot_id", "text", "embedding_target", "subject")


def value_tokens(kb: DataFrame, vocab: DataFrame) -> DataFrame:
    """slot_id, its target's first token and that token's id (the unknown id where it has none)."""
    first = kb.select("slot_id", F.coalesce(F.get(tokens(F.col("embedding_target")), F.lit(0)), F.lit("<unk>")).alias("token"))
    return first.join(vocab, "token", "left").select("slot_id", "token", F.coalesce("id", F.lit(UNK)).alias("value_token"))


def tensor(tokens_of: DataFrame, addresses: int) -> DataFrame:
    """slot_id and value_token (null where no slot is) of all addresses, 0 and on; more than asked for, if there are more slots."""
    most = max(addresses, tokens_of.count())
    return tokens_of.sparkSession.range(most).select(F.col("id").cast("int").alias("slot_id")).join(tokens_of.select("slot_id", "value_token"), "slot_id", "left")


def live_stats(slots: DataFrame) -> DataFrame:
    """total, live and dead slots of slots(value_token), and the live share."""
    live = F.count_if(F.col("value_token").isNotNull())
    return slots.agg(F.count("*").alias("total"), live.alias("live"), (F.count("*") - live).alias("dead"), F.round(live / F.greatest(F.count("*"), F.lit(1)), 6).alias("live_ratio"))


def contiguity(kb: DataFrame, id_col: str = "slot_id") -> DataFrame:
    found = kb.agg(F.min(id_col).cast("bigint").alias("lowest"), F.max(id_col).cast("bigint").alias("highest"), F.count_distinct(id_col).alias("slots"))
    return found.withColumn("contiguous", F.coalesce((F.col("lowest") == 0) & (F.col("highest") == F.col("slots") - 1), F.lit(False)))


def missing(required: DataFrame, kb: DataFrame, key: str) -> DataFrame:
    """Keys that are required and not in kb, and how often."""
    return required.groupBy(key).agg(F.count("*").alias("uses")).join(kb.select(key).distinct(), key, "left_anti")


def uses_per_slot(required: DataFrame, key: str, example: str) -> DataFrame:
    """Least, most and mean examples of a slot, and the distinct slots."""
    each = required.groupBy(key).agg(F.count_distinct(example).alias("n"))
    return each.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("slots"))


def _runs(n: int) -> Column:
    """The hashes of all runs of n words of array column w."""
    return F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("w", i + j) for j in range(n)))))


#: Items up to which they are sent to every task (some 200 bytes each); beyond, documents' runs are joined by shuffling.
BROADCAST_ITEMS = 200_000


def leaks(items: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """(item_id, doc_id) of the documents that contain an item's whole text, whatever its case.

    A document that contains an item contains the item's inner words in a row; the first of them, `words` at most, are
    looked up among the hashes of each document's runs of as many words, without shuffling documents, and only hits
    are compared in full. Runs are made for the lengths that items have. Items without an inner word are looked up by
    their first three characters (or all, if fewer) among each document's different runs of as many. No item meets a
    document that does not share a key with it. Empty items and null texts take no part.
    """
    w = F.split("item", r"\s+")
    low = items.select("item_id", F.lower("text").alias("item")).where("item <> ''").withColumn("n", F.least(F.lit(words), F.size(w) - 2)).withColumn("run", F.xxhash64(F.array_join(F.slice(w, 2, F.greatest("n", F.lit(0))), " ")))
    sizes = {r.n: r.c for r in low.groupBy("n").agg(F.count("*").alias("c")).collect()}
    text = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null")
    few = sum(sizes.values()) <= BROADCAST_ITEMS
    sent = F.broadcast if few else (lambda df: df)
    parts = []
    for n in sorted(x for x in sizes if x > 0):
        v = text.withColumn("w", F.split("text", r"\s+")).where(F.size("w") >= n)
        hits = v.select("doc_id", "text", F.explode(F.array_distinct(_runs(n))).alias("run"))
        parts.append(hits.join(sent(low.where(F.col("n") == n).select("item_id", "item", "run")), "run").where(F.contains("text", "item")).select("item_id", "doc_id"))
    if any(x <= 0 for x in sizes):
        short = low.where("n <= 0").select("item_id", "item", F.least(F.lit(3), F.length("item")).alias("g"))
        for g in sorted(r.g for r in short.select("g").distinct().collect()):
            keyed = short.where(F.col("g") == g).select("item_id", "item", F.substring("item", 1, g).alias("run"))
            runs = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=({'.' * g}))"), F.lit(1)))
            parts.append(text.select("doc_id", "text", F.explode(runs).alias("run")).join(sent(keyed), "run").where(F.contains("text", "item")).select("item_id", "doc_id"))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else low.join(text, F.lit(False)).select("item_id", "doc_id")
