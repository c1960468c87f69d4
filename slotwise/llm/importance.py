"""Target-distribution importance resampling over hashed n-grams.

A document's features are its runs of one to `LONGEST` consecutive words. Each worker maps the different words of a
slice of text to integers, holds n-grams as tuples of them (packed pairs of the shorter tuple's id and the last word's),
takes the different tuples by sorting, hashes each one's bytes once, and joins the buckets back to all occurrences by
the tuple's id. A tuple of the next length goes on from the checksum of the one that it extends, so bytes are rebuilt
for each different tuple and not for each occurrence. Dictionaries live as long as a slice: a dictionary of the whole
corpus would send every word through a shuffle.

Buckets are written once (two bytes a feature); bucket counts are summed in each task before they are shuffled, so at
most `buckets` rows leave a task, and the table of gains has `buckets` rows, which bounds its broadcast. The draw needs
a rank over all documents: rows are written in sampled ranges of the order and numbered by their range's offset.

Null and empty texts have no features and weight 0; repeated rows are documents of their own, equal in all but rank; a
null doc_id has the empty text as its id in the hash and comes last among ties; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, discard, prepared, slices, stored
from .terms import Terms, terms_of

LONGEST = 3
BUCKETS = 10_000
#: Text bytes of a slice, which has a dictionary of its own.
SLICE_BYTES = 2 << 20
FEATURES = "doc_id bigint, n_words bigint, n_features bigint, buckets binary"


def hashed_ngrams(found: Terms, texts: int, longest: int, buckets: int) -> list[bytes]:
    """For each text the buckets of its n-grams as 16-bit integers: all of one word, then all of two, and so on."""
    words = [w.encode() for w in found.words.to_pylist()]
    after = [b" " + w for w in words]
    n = found.ids.size
    sums = [zlib.crc32(w) for w in words]  # of each different tuple of the present length
    tuples, at = found.ids, np.arange(n)  # a tuple's id and where it starts, one entry an occurrence
    buckets_of = lambda: (np.array(sums, np.int64) % buckets).astype(np.uint16)
    hashed, rows = [buckets_of()[tuples]], [found.text]
    for size in range(2, longest + 1):
        inside = at + size - 1 < n
        inside[inside] = found.text[at[inside] + size - 1] == found.text[at[inside]]
        at, packed = at[inside], tuples[inside] * len(words) + found.ids[at[inside] + size - 1]
        different, tuples = np.unique(packed, return_inverse=True)
        shorter, last = np.divmod(different, max(len(words), 1))
        sums = [zlib.crc32(after[w], sums[t]) for t, w in zip(shorter.tolist(), last.tolist(), strict=True)]
        hashed.append(buckets_of()[tuples])
        rows.append(found.text[at])
    rows = np.concatenate(rows)
    data = np.concatenate(hashed)[np.argsort(rows, kind="stable")].tobytes()
    ends = (np.cumsum(np.bincount(rows, minlength=texts)) * 2).tolist()
    return [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """FEATURES of each row: its id, words, features and their buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket takes two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FEATURES)
        for part in slices(batches, 1, SLICE_BYTES):
            found = terms_of(part.column(1))
            every = hashed_ngrams(found, part.num_rows, longest, buckets)
            yield batch_of(schema, [part.column(0), found.counts(part.num_rows), [len(x) // 2 for x in every], every])

    prepared(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, FEATURES)


def bucket_counts(hashed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that occur; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), np.uint16), minlength=buckets)
        seen = np.flatnonzero(total)
        yield batch_of(arrow_schema("bucket bigint, n bigint"), [seen, total[seen]])

    return hashed.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: a thousand times the smoothed log ratio of target to raw counts, rounded down."""
    sums = raw.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s_all")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t_all")))  # a row each
    side = lambda df, name: df.select("bucket", F.col("n").alias(name))
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(side(raw, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left").crossJoin(F.broadcast(sums))
    up = lambda own, other: (F.coalesce(F.col(own), F.lit(0)) + 1).cast("double") * (F.col(other) + buckets).cast("double")
    return every.select("bucket", F.floor(F.lit(1000.0) * F.ln(up("t", "s_all") / up("s", "t_all"))).alias("gain"))


def weights(hashed: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a row's features."""
    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    shared = hashed.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = [int(shared.value[np.frombuffer(x.as_buffer(), np.uint16)].sum()) for x in b.column(3)]
            yield batch_of(arrow_schema(schema), [b.column(0), b.column(1), b.column(2), total])

    return hashed.mapInArrow(run, schema)


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with the row's rank by `order` from 1, found in sampled ranges: no task sees more than a range."""
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = stored(laid.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(2**33 - 1))), "ranked")
    sizes = laid.groupBy("_range").agg(F.count("*").alias("_n"))
    # a row for each range, n at most
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return laid.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Of the N documents of `least_words` words or more, floor(percent * N / 100) are drawn without replacement: a Gumbel
    variable from the seed and the id is added to the weight, and the highest sums are taken, ties by id.
    """
    raw = stored(features(docs, longest=longest, buckets=buckets), "importance-features")
    wanted = stored(features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), longest=longest, buckets=buckets), "importance-target")
    found = gains(bucket_counts(raw, buckets), bucket_counts(wanted, buckets), buckets).toArrow()  # `buckets` rows
    table = np.zeros(buckets, np.int64)
    table[found.column("bucket").to_numpy()] = found.column("gain").to_numpy()
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / 4294967296.0
    luck = F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform)))
    scored = stored(weights(raw, table).withColumn("score", F.col("weight") + luck), "importance-scored")
    discard(raw, wanted)
    able = F.col("n_words") >= least_words
    n = scored.where(able).count() * percent // 100
    placed = ranked(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")]).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return placed.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))).select("doc_id", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is drawn; options as for resample."""
    drawn = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_drawn")), "left_semi")
