"""One-permutation MinHash fingerprints, in DataFrame functions only.

A text's set is its distinct runs of five words (the whole sequence, where it has fewer). Each run is hashed once;
the hash's high bits choose one of `BINS` bins and the smallest hash of a bin stands for it. An empty bin borrows
from the bins of its own fixed pseudo-random order, the first that is not empty (optimal densification). Of every
bin the low `BITS` bits are kept, packed into longs; agreement by chance is corrected: (match - 2^-b) / (1 - 2^-b).

Null and empty texts, and texts of white space, have the fingerprint "-": alike to one another (1.0), unlike all
others (0.0). Equal texts have equal fingerprints. Rows that repeat a doc_id are ordered by their text; rows with a
null doc_id come last in the order. A single row is its own next document. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored

BINS = 256
BITS = 4
WORDS = 5
#: The bits below those that choose a bin.
SHIFT = 64 - (BINS - 1).bit_length()
#: Rows that share a bucket of neighbouring rows, on average, until there are MOST_BUCKETS; bucket bounds are 16 bytes each.
BUCKET_ROWS = 2000
MOST_BUCKETS = 65_536
_SPACE = " \t\n\x0b\x0c\r"


def _lower_bits(dense: Column) -> Column:
    """BINS hashes as longs of 64 / BITS low parts each."""
    per = 64 // BITS

    def pack(k: Column) -> Column:
        parts = (F.shiftleft(F.get(dense, k * per + j).bitwiseAND(F.lit(2**BITS - 1).cast("bigint")), BITS * j) for j in range(per))
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), pack)


#: Bin i asks the bins STEP[i] * j + START[i] modulo BINS, for j from 1 on; steps are odd, so every bin has its turn.
STEP = [((i * 2654435 + 101) * 2 + 1) % BINS for i in range(BINS)]
START = [(i * 40503 + 7) % BINS for i in range(BINS)]
#: Turns that are tried one by one; where all these bins are empty, few are not, and their turns are compared.
TRIED = 16


def _ints(values) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _borrowed(dense: Column, filled: Column, i: Column) -> Column:
    """The first bin that is not empty in bin i's own order; filled: the hashes of all that are not."""
    tried = [F.get(dense, F.get(_ints((a * j + b) % BINS for a, b in zip(STEP, START, strict=True)), i)) for j in range(1, TRIED + 1)]
    back, start = F.get(_ints(pow(a, -1, BINS) for a in STEP), i), F.get(_ints(START), i)
    turns = F.transform(filled, lambda x: F.pmod((_place(x) - start) * back - 1, F.lit(BINS)) * BINS + _place(x))
    return F.coalesce(*tried, F.get(dense, F.array_min(turns) % BINS))


def _place(x: Column) -> Column:
    """The bin of a hash: its high bits; sorted hashes stand in the order of their bins."""
    return (F.shiftright(x, SHIFT) + BINS // 2).cast("int")


def _joined(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def with_signature(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with `out`, the packed signature of text_col (array<bigint>); null for texts without words."""
    t = lambda x: f"__{out}_{x}"
    trimmed = F.btrim(F.col(text_col), F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    df = df.withColumn(t("w"), F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col(t("w"))
    n = F.size(w)
    df = df.withColumn(t("p"), F.when(n >= WORDS, _joined(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1))))  # runs of two, four and five words
    p = F.col(t("p"))
    four = _joined(F.slice(p, 1, n - 3), F.slice(p, 3, n - 3))
    runs = _joined(F.slice(four, 1, n - 4), F.slice(w, 5, n - 4))
    df = df.withColumn(t("s"), F.sort_array(F.when(n >= WORDS, runs).otherwise(F.when(n > 0, F.array(F.xxhash64(w))))))
    s = F.col(t("s"))
    prior = F.concat(F.array(F.bitwise_not(F.get(s, F.lit(0)))), F.slice(s, 1, F.size(s) - 1))
    first = F.array_compact(F.zip_with(s, prior, lambda x, y: F.when(F.shiftrightunsigned(x.bitwiseXOR(y), SHIFT) != 0, x)))  # the first of each bin is its smallest
    df = df.withColumn(t("m"), F.when(F.size(s) > 0, first).otherwise(F.array().cast("array<bigint>")))
    m, none = F.col(t("m")), F.lit(None).cast("bigint")
    filled = F.flatten(F.transform(m, lambda x, i: F.concat(F.array_repeat(none, _place(x) - F.when(i == 0, 0).otherwise(_place(F.get(m, i - 1)) + 1)), F.array(x))))
    df = df.withColumn(t("f"), filled)
    df = df.withColumn(t("d"), F.concat(F.col(t("f")), F.array_repeat(none, F.lit(BINS) - F.size(t("f")))))
    d = F.col(t("d"))
    df = df.withColumn(t("e"), F.when(F.size(m) == BINS, d).otherwise(F.transform(d, lambda x, i: F.coalesce(x, _borrowed(d, m, i)))))
    return df.withColumn(out, F.when(F.size(m) > 0, _lower_bits(F.col(t("e"))))).drop(*(t(x) for x in "wpsmfde"))


def as_text(signature: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit("-"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures, corrected for bits that agree by chance, from 0 to 1."""
    ones = F.lit(sum(1 << (BITS * j) for j in range(64 // BITS))).cast("bigint")

    def unlike(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), (F.shiftrightunsigned(z, j) for j in range(BITS))).bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda acc, x: acc + x)
    match, chance = F.lit(1.0) - differ / F.lit(float(BINS)), 2.0**-BITS
    found = F.greatest(F.lit(0.0), (match - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(found)


def with_next(docs: DataFrame, carried: list[str], sign) -> DataFrame:
    """sign(docs) with next_<column> of the next row in descending doc_id (after the last: the first).

    Rows stand in one order: by doc_id, null last, then by a hash of the text. Buckets are ranges of that order, cut at
    bounds that Spark's range partitioner samples from ids and hashes alone, so outlying ids, null ids and repeated ids
    are dealt out like all others. A bucket's first row is also put into the bucket before it, where it follows the
    last row. Rows equal in both keys share a bucket.
    """
    keyed = docs.withColumn("place_id", F.coalesce(F.col("doc_id"), F.lit(-(2**63)))).withColumn("place_hash", F.bitwise_not(F.xxhash64("text")))
    light = keyed.select("place_id", "place_hash")
    buckets = max(1, min(MOST_BUCKETS, -(-docs.count() // BUCKET_ROWS)))
    dealt = stored(light.repartitionByRange(buckets, F.desc("place_id"), F.desc("place_hash")).withColumn("bucket", F.spark_partition_id()), "next-places")
    heads = sorted((tuple(r.head) for r in dealt.groupBy("bucket").agg(F.max(F.struct("place_id", "place_hash")).alias("head")).collect()), reverse=True)
    heads = heads or [(0, 0)]
    ids, hashes = (F.split(F.lit(",".join(str(h[i]) for h in heads)), ",").cast("array<bigint>") for i in (0, 1))

    def halve(acc: Column, _: Column) -> Column:
        """low..high holds how many heads stand at or before the row."""
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        head = F.get(ids, middle)
        before = (head > F.col("place_id")) | ((head == F.col("place_id")) & (F.get(hashes, middle) >= F.col("place_hash")))
        on = acc["low"] < acc["high"]
        return F.struct(F.when(on & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(on & ~before, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(heads).bit_length() + 1))
    bucket = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(heads)).alias("high")), halve, lambda acc: acc["low"] - 1)
    own = keyed.withColumn("bucket", bucket)
    first = (F.get(ids, F.col("bucket")) == F.col("place_id")) & (F.get(hashes, F.col("bucket")) == F.col("place_hash"))
    before = F.pmod(F.col("bucket") - 1, F.lit(len(heads)))
    rows = own.withColumn("at", F.explode(F.when(first, F.array(F.struct("bucket", F.lit(0).alias("copied")), F.struct(before.alias("bucket"), F.lit(1).alias("copied")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("copied"))))))
    placed = sign(rows.select(*docs.columns, "place_id", "place_hash", F.col("at.bucket").alias("bucket"), F.col("at.copied").alias("copied")))
    near = Window.partitionBy("bucket").orderBy("copied", F.desc("place_id"), F.desc("place_hash"), "text")
    found = placed.select("*", *(F.lead(c).over(near).alias(f"next_{c}") for c in carried))
    return found.where("copied = 0").drop("bucket", "copied", "place_id", "place_hash")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, whose last half is replaced by the next document's start."""
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = with_next(docs, ["text", "sig"], lambda df: with_signature(df, "text", "sig"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    placed = with_signature(placed.select("doc_id", "sig", "next_sig", n.cast("bigint").alias("n_chars"), edited.alias("edited")), "edited", "edited_sig")
    return placed.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
