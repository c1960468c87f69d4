"""Vocabulary, encoding, prompts and padding over long relations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import ANS, BOS, EOS, FACT, SPECIALS, TOKEN_PATTERN, UNK, padded, tokens
from ..session import ready, written
from ..functions.text import Q as QUESTION


def dense_id(df: DataFrame, order: Column, bucket: Column, name: str, start: int = 0, kind: str = "int") -> DataFrame:
    """df with consecutive ids, of type `kind`, in the order of `order`; bucket must not fall as order rises.

    Ids are row numbers within a bucket plus the sizes of all buckets before it, so no task sorts the whole relation.
    """
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__bucket").alias("__b"), (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__bucket").orderBy(order)))
    found = numbered.join(before, F.col("__bucket") == F.col("__b"))
    return found.withColumn(name, (F.col("__before") + F.col("__nth") + F.lit(start - 1)).cast(kind)).drop("__bucket", "__b", "__n", "__nth", "__before")


def ranged_id(df: DataFrame, order: str, name: str, start: int = 0, kind: str = "int") -> DataFrame:
    """df with consecutive ids, of type `kind`, in the order of the column `order`, whose values are all different.

    Rows are dealt to sampled ranges, so common prefixes make no large ones, sorted and numbered where they lie, and
    written below the shared folder, since sampled bounds need not be the same twice; an id is a row's number in its
    range plus the sizes of the ranges before.
    """
    ranges = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    rows = written(ranges.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, nth = F.shiftright("__at", 33), F.col("__at").bitwiseAND(2**33 - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    found = rows.join(F.broadcast(before), part == F.col("__part"))
    return found.withColumn(name, (F.col("__before") + nth + start).cast(kind)).drop("__at", "__part", "__before")


def sequenced(read: DataFrame, name: str = "seq") -> DataFrame:
    """A DataFrame as it was read from files, with `name`, which orders its rows as one reader would see them: file by path, then from top to bottom.

    Files are split into blocks and dealt to tasks in any way; a row's file, its block's place in it and its number
    within the task put it back. Only for a plan that reads files and has not shuffled since.
    """
    meta = F.col("_metadata")
    return read.select("*", F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")).alias(name))


def first_seen(df: DataFrame, keys: list[str], seq: str, name: str) -> DataFrame:
    """The different keys of df with dense ids, from 0, in the order in which `seq` first has them.

    A key's first place is a minimum that each task takes of its own rows; places are numbered in sampled ranges, so
    neither a frequent key nor the order of all is one task's work.
    """
    return ranged_id(df.groupBy(*keys).agg(F.min(seq).alias("__first")), "__first", name, kind="bigint").select(name, *keys)


def build_vocab(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """vocab(token, id): special tokens first, then all distinct tokens in code-point order."""
    content = texts.select(F.explode(tokens(F.col(text_col))).alias("token")).distinct()
    content = ranged_id(content, "token", "id", len(SPECIALS))
    spark = texts.sparkSession
    return spark.createDataFrame(list(zip(SPECIALS, range(len(SPECIALS)), strict=True)), "token string, id int").unionByName(content.select("token", "id"))


def token_rows(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    return texts.select(*keys, F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))


#: Vocabulary rows up to which every worker holds them (some 100 bytes each); beyond, tokens are joined by shuffling.
BROADCAST_TOKENS = 500_000
_ASCII = re.compile(TOKEN_PATTERN)


#: Bytes of text, or of ids, of a slice at most, on average.
SLICE = 8 << 20


def _coded(batches: Iterator[pa.RecordBatch], at: int, one, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The batches, in parts of bounded text, with column `at` replaced by one() of each value."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield pa.RecordBatch.from_arrays([pa.array(map(one, c.to_pylist()), kind) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)


def _by_slices(rows: DataFrame, size: Column, split, join, known: DataFrame, result: StructField) -> DataFrame:
    """rows with their last column replaced by join(value, dictionary), where the dictionary, of known(__key, __value), has all keys that split(value) gives.

    Rows are dealt to slices of bounded size by a hash, once. A slice hands on its different keys only; these are
    looked up by shuffling and come back to it as its dictionary, so what is shuffled besides the rows themselves is a
    row for each different key of a slice and not of a text.
    """
    spark, *_, last = ready(rows.sparkSession), *rows.columns
    total = rows.agg(F.sum(size)).first()[0] or 0
    sliced = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(total // SLICE + 1)).alias("__slice"), "*")
    sliced = sliced.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__slice")
    key, value = known.schema["__key"], known.schema["__value"]
    in_arrow = {"string": pa.string(), "int": pa.int32()}
    kind, number = in_arrow[key.dataType.simpleString()], pa.int64()

    def different(part: pa.Table) -> pa.Table:
        found: set = set()
        for chunk in part.column(last).chunks:
            for x in chunk.to_pylist():
                found.update(split(x))
        return pa.table({"__slice": pa.array([part.column("__slice")[0].as_py()] * len(found), number), "__key": pa.array(list(found), kind)})

    shape = StructType([*(f for f in rows.schema if f.name != last), result])
    to_arrow = pa.list_(pa.int32()) if isinstance(result.dataType, ArrayType) else pa.string()

    def replaced(part: pa.Table, words: pa.Table) -> pa.Table:
        found = dict(zip(words.column("__key").to_pylist(), words.column("__value").to_pylist(), strict=True))
        coded = pa.chunked_array([pa.array([join(x, found) for x in chunk.to_pylist()], to_arrow) for chunk in part.column(last).chunks], to_arrow)
        return pa.table([*(part.column(f.name) for f in shape[:-1]), coded], names=shape.names)

    asked = sliced.groupBy("__slice").applyInArrow(different, StructType([StructField("__slice", LongType()), key]))
    words = asked.join(known, "__key").select("__slice", "__key", "__value")
    return sliced.groupBy("__slice").cogroup(words.groupBy("__slice")).applyInArrow(replaced, shape)


def _small(vocab: DataFrame, most: int) -> list | None:
    """The vocabulary's rows, if they are no more than most."""
    rows = vocab.select("token", "id").limit(most + 1).toArrow()
    return None if rows.num_rows > most else list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def encode(texts: DataFrame, vocab: DataFrame, keys: list[str], text_col: str = "text", most: int = BROADCAST_TOKENS) -> DataFrame:
    """keys and ids (array<int>) of each text; unknown tokens have the unknown id.

    Up to `most` vocabulary rows are broadcast and each text is looked up where it stands; a larger vocabulary is
    joined with one row for each different token of a slice of texts.
    """
    known = _small(vocab, most)
    if known is not None:
        shared = texts.sparkSession.sparkContext.broadcast(dict(known))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = shared.value.get
            yield from _coded(batches, len(keys), lambda t: [get(x, UNK) for x in _ASCII.findall(t)] if t else [], pa.list_(pa.int32()))

        rows = texts.select(*keys, F.col(text_col).alias("ids"))
        return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keys), StructField("ids", ArrayType(IntegerType()))]))
    rows = texts.select(*keys, F.col(text_col).alias("ids"))
    return _by_slices(rows, F.length("ids"), lambda t: _ASCII.findall(t) if t else (), lambda t, get: [get.get(x, UNK) for x in _ASCII.findall(t)] if t else [], vocab.select(F.col("token").alias("__key"), F.col("id").alias("__value")), StructField("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, vocab: DataFrame, keys: list[str], most: int = BROADCAST_TOKENS) -> DataFrame:
    """keys and the tokens of each row's ids, without padding, begin and end marks; ids that the vocabulary lacks are left out."""
    known = _small(vocab, most)
    if known is not None:
        shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in known if t not in SPECIALS[:3]})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spelled = shared.value
            yield from _coded(batches, len(keys), lambda ids: " ".join([spelled[i] for i in ids if i in spelled]) if ids else None, pa.string())

        rows = encoded.select(*keys, F.col("ids").alias("text"))
        return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keys), StructField("text", StringType())]))
    rows = written(encoded.select(*keys, F.col("ids").alias("text")), "encoded")
    known = vocab.where(~F.col("token").isin(*SPECIALS[:3])).select(F.col("id").alias("__key"), F.col("token").alias("__value"))
    return _by_slices(rows, F.size("text") * 4, lambda ids: ids or (), lambda ids, spelled: " ".join([spelled[i] for i in ids if i in spelled]) if ids else None, known, StructField("text", StringType()))


def _ints(*values: int) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _cut(ids: Column, longest: int | None) -> Column:
    return ids if longest is None else F.slice(ids, 1, longest)


def qa_sequence(question: Column, answer: Column, longest: int | None = None, facts: Column | None = None) -> Column:
    """struct(ids, prompt_len): the prompt, its answer and the end mark, cut to `longest` if given; facts: array of id arrays for an open book."""
    if facts is None:
        prompt = F.concat(_ints(BOS), question, _ints(ANS))
    else:
        prompt = F.concat(_ints(BOS), F.flatten(F.transform(facts, lambda f: F.concat(_ints(FACT), f))), _ints(QUESTION), question, _ints(ANS))
    full = _cut(F.concat(prompt, answer, _ints(EOS)), longest)
    return F.struct(full.alias("ids"), F.least(F.size(prompt), F.size(full)).alias("prompt_len"))


def fact_sequence(fact: Column, longest: int | None = None) -> Column:
    """struct(ids, prompt_len) of one fact; only the begin mark is prompt."""
    return F.struct(_cut(F.concat(_ints(BOS, FACT), fact, _ints(EOS)), longest).alias("ids"), F.lit(1).alias("prompt_len"))


def pad_batches(examples: DataFrame, order: Column, bucket: Column, size: int) -> DataFrame:
    """examples(ids, ...) with example_id, batch_id, width and ids padded to the longest of their batch."""
    numbered = dense_id(examples, order, bucket, "example_id").withColumn("batch_id", F.floor(F.col("example_id") / size).cast("int"))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    return numbered.withColumn("width", width).withColumn("padded", padded(F.col("ids"), F.col("width")))


def collate(batches: DataFrame) -> DataFrame:
    """pad_batches() rows with the mask that marks what is no padding, and required slot ids padded with -1 to the batch's most."""
    most = F.max(F.size("required")).over(Window.partitionBy("batch_id"))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), F.col("width") - F.size("ids")))
    return batches.withColumn("__most", most).select(*batches.columns, mask.alias("mask"), F.concat("required", F.array_repeat(F.lit(-1), F.col("__most") - F.size("required"))).alias("required_padded"))


def mix_in_facts(questions: DataFrame, facts: DataFrame, rate: float, dense: str) -> DataFrame:
    """questions, then so many facts that they are `rate` of all rows, or as many as there are; `dense`: the facts' ids, 0 and on."""
    wanted = int(questions.count() * rate / (1 - rate))
    return questions.unionByName(facts.where(F.col(dense) < wanted))
