"""Substring deduplication by level-wise doubling.

A window of `length` words is removed where its word sequence also starts in a document with a smaller id. Levels
double in length up to `length` (13, 25, 50). A level below the last looks only at anchors: of all its windows inside a
window of full length, the one of smallest hash. Equal full windows have equal anchors, so only full windows whose
anchor stands in two documents are candidates of the next level, and only documents with candidates are read for it;
anchors of the first level are some 2 / 39 of all positions. The last level compares the candidates themselves. Levels
go on until no candidates survive or the full length is reached.

Documents with the same word sequence are taken together first: all but those of the smallest id lose every word, and
only one of them supplies windows. Hashes go out and come back by groupBy with partial aggregation, whose result is
written before it is joined: that leaves a join of two plain shuffles, which adaptive execution splits, so a passage
or a text that a third of all documents share is no group in any task. Window hashes have 64 bits.

Null and empty texts have no words; documents shorter than a window lose nothing. Rows that repeat a doc_id are
judged each by its own text, and none of them is "smaller" than the other; a null doc_id counts as larger than all
others. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, discard, kept, prepared, slices, stored

LENGTH = 50
CACHED_WORDS = 50_000
#: Candidate documents up to which their ids (8 bytes each) are broadcast; beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000
LAST_ID = 2**63 - 1
FIRST = "id bigint, digest string, n_words bigint, hashes array<bigint>"
NEXT = "id bigint, digest string, text string, hashes array<bigint>"
KEPT = "id bigint, digest string, n_removed bigint, kept_sha256 string"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def hashed(words: list[bytes]) -> np.ndarray:
    known = kept("words", WordHashes)
    if len(known) > CACHED_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window, by doubling: two windows side by side or overlapping make a longer one."""
    if len(h) < length:
        return h[:0]
    size = 1
    while size * 2 <= length:
        h, size = _pair(h[:-size], h[size:]), size * 2
    return _pair(h[: len(h) - (length - size)], h[length - size :]) if size < length else h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h, size = np.minimum(h[:-size], h[size:]), size * 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def anchors(h: np.ndarray, length: int, level: int, survivors: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Distinct hashes of the level's anchors in full windows that survive: those whose anchor of the level before is listed."""
    if len(h) < length:
        return h[:0]
    least = windows(h, level) if level == length else sliding_min(windows(h, level), length - level + 1)
    if survivors is not None:
        before, listed = survivors
        least = least[np.isin(sliding_min(windows(h, before), length - before + 1), listed)]
    return np.unique(least)


def covered(h: np.ndarray, length: int, removed: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window whose hash is listed."""
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(np.isin(windows(h, length), removed))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _first_level(length: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FIRST)
        for part in slices(batches, 1):
            digests, counts, hashes = [], [], []
            for text in part.column(1).to_pylist():
                words = text.encode().split()
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                counts.append(len(words))
                hashes.append(anchors(hashed(words), length, level).view(np.int64) if len(words) >= length else [])
            yield batch_of(schema, [part.column(0), digests, counts, hashes])

    return run


def _next_level(length: int, level: int, before: int):
    """The level's candidates; the last level keeps the texts, to cut them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(NEXT)
        for part in slices(batches, 1):
            texts, digests, hashes = part.column(1).to_pylist(), [], []
            for text, listed in zip(texts, part.column(2), strict=True):
                words = text.encode().split()
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                listed = listed.values.to_numpy().view(np.uint64)
                hashes.append(anchors(hashed(words), length, level, (before, listed)).view(np.int64))
            yield batch_of(schema, [part.column(0), digests, texts if level == length else [""] * len(texts), hashes])

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(KEPT)
        for part in slices(batches, 1):
            counts, kept = [], []
            for text, listed in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                words = text.encode().split()
                gone = covered(hashed(words), length, listed.values.to_numpy().view(np.uint64))
                counts.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])).hexdigest())
            yield batch_of(schema, [part.column(0), part.column(3), counts, kept])

    return run


def _repeated(rows: DataFrame, earlier: bool) -> DataFrame:
    """(id, hashes) of the hashes that stand under two ids; earlier: only where one of them is smaller than the row's own."""
    spread = rows.select("id", F.explode("hashes").alias("h"))
    groups = stored(spread.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "least"), "repeats-groups")
    found = spread.join(groups, "h")
    found = found.where("id > least") if earlier else found
    return found.groupBy("id").agg(F.collect_set("h").alias("hashes"))


def doubled(length: int, least: int = 12) -> tuple[int, ...]:
    """Levels that double up to length, from `least` words on, and two levels at least."""
    levels = [length]
    while len(levels) < 2 or (levels[0] + 1) // 2 >= least:
        levels.insert(0, (levels[0] + 1) // 2)
    return tuple(levels)


def remove_repeats(docs: DataFrame, length: int = LENGTH, levels: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    levels = levels or doubled(length)
    if levels[-1] != length or len(levels) < 2 or list(levels) != sorted(set(levels)):
        raise ValueError("levels must rise to the window length, in two steps at least")
    prepared(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    first = stored(base.mapInArrow(_first_level(length, levels[0]), FIRST), "repeats-first")
    owners = stored(first.groupBy("digest").agg(F.min("id").alias("owner")), "repeats-owners")
    rows = first.where(F.size("hashes") > 0).join(owners, "digest").where("id = owner").select("id", "digest", "hashes")
    before, last = levels[0], None
    for level in levels[1:]:
        lists = stored(_repeated(rows, earlier=False), "repeats-lists")
        count = lists.count()
        if not count:
            rows = None
            break
        few = count <= BROADCAST_IDS  # ids only; their lists are joined after the texts have been chosen
        texts = base.join(F.broadcast(lists.select("id")), "id", "left_semi") if few else base
        texts = texts.join(lists, "id").select("id", "text", "hashes")
        found = texts.mapInArrow(_next_level(length, level, before), NEXT).where(F.size("hashes") > 0)
        rows = stored(found.join(owners.select(F.col("digest").alias("d"), "owner"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("owner"))).select("id", "digest", "text", "hashes"), "repeats-next")
        discard(lists, *([last] if last else []))
        before, last = level, rows
    result = first.select("id", "digest", "n_words")
    if rows is None:
        result = result.select("*", F.lit(None).cast("bigint").alias("n_removed"), F.lit(None).cast("string").alias("kept_sha256"))
    else:
        listed = _repeated(rows, earlier=True)
        kept = rows.select("id", "text", "digest").join(listed, "id").select("id", "text", "hashes", "digest").mapInArrow(_remove(length), KEPT).dropDuplicates(["id", "digest"])
        result = result.join(kept, ["id", "digest"], "left")
    result = result.join(owners, "digest")  # last, so that nothing above needs its rows by digest and a hot one can be split
    copy = (F.col("id") > F.col("owner")) & (F.col("n_words") >= length)
    return result.select(
        F.when(F.col("id") < LAST_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
