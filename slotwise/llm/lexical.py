"""Ranked lexical search over a two-level quantised index, in whole numbers.

The index has a row for each document: its length and, for the terms that a block of items asks for, term ids, counts
and, at the first level, one byte a term: the term's impact in steps of a 255th of its largest possible one, rounded
up. A block of documents times the block of items is a product of matrices of these bytes and the terms' steps, which
gives every pair an upper bound, and with one step less a lower bound. The kth best lower bound of an item over all
documents is its threshold; every document whose upper bound reaches it is scored again from its counts, exactly.

Items are taken in blocks of `ITEMS` items and some `ENTRIES` terms (or one item), so what is broadcast, an item
matrix and its terms, has that bound however many items there are. Documents are never held together: each task keeps
the k best of each item, and tasks' bests meet in two steps. Matrix products are in doubles while every sum is below
2**53, and in 64-bit integers otherwise; both are exact.

Null and empty texts have no terms, are no documents of the statistics and are never found; an item without terms has
no rows; each row of items is an item of its own, each row of documents a document; a null doc_id comes last among
ties; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, discard, prepared, slices, stored
from .terms import terms_of

K = 10
ITEMS, ENTRIES = 256, 16_384
#: Cells of a dense block of documents by terms.
CELLS = 1 << 20
SLICE_BYTES = 2 << 20
#: A term's largest impact is its weight times this.
TOP = 1_000_000
COUNTED = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "item bigint, doc_id bigint, score bigint"
#: Tasks' bests meet in so many groups of each item before they meet in one.
GROUPS = 64


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """COUNTED of each document: its length, and the ids (places in `terms`) and counts of those of its terms that `terms` has."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, known = arrow_schema(COUNTED), pa.array(shared.value, pa.string())
        for part in slices(batches, 1, SLICE_BYTES):
            found = terms_of(part.column(1))
            place = pc.fill_null(pc.index_in(found.words, known), -1).to_numpy().astype(np.int64)
            here = place[found.ids] if found.ids.size else found.ids
            asked = here >= 0
            keys, counts = np.unique(found.text[asked] * len(known) + here[asked], return_counts=True)
            row, term = np.divmod(keys, max(len(known), 1))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.counts(part.num_rows)), *lists], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, COUNTED)


def document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """For each term the documents that hold it; each task sums its own first, `n_terms` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        seen = np.flatnonzero(total)
        yield batch_of(arrow_schema("term bigint, n bigint"), [seen, total[seen]])

    sums = rows.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out


class Impacts:
    """What a term's occurrences add to a score: exactly, and rounded up to a byte of steps."""

    def __init__(self, df: np.ndarray, docs: int, words: int):
        self.docs, self.words = docs, words
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        self.step = self.weight * TOP // 255 + 1

    def exact(self, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 25 + 75 * lengths * self.docs // self.words
        return self.weight[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m))

    def bytes(self, *of: np.ndarray) -> np.ndarray:
        step = self.step[of[0]]
        return ((self.exact(*of) + step - 1) // step).astype(np.uint8)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, term and count of each entry of a batch that has terms and counts as columns 2 and 3."""
    sizes = np.diff(b.column(2).offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), sizes), b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64)


def indexed(rows: DataFrame, impacts: Impacts) -> DataFrame:
    """The rows of counted() with terms, one byte a term beside."""
    schema = COUNTED + ", impacts binary"
    shared = rows.sparkSession.sparkContext.broadcast(impacts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, count = _flat(b)
            data = shared.value.bytes(term, count, b.column(1).to_numpy()[row]).tobytes()
            ends = np.cumsum(np.bincount(row, minlength=b.num_rows)).tolist()
            yield batch_of(arrow_schema(schema), [*b.columns, [data[a:z] for a, z in zip([0, *ends], ends, strict=False)]])

    return rows.where(F.size("terms") > 0).mapInArrow(run, schema)


class Items:
    """A block of items as a sparse matrix by term: how often each item has each term."""

    def __init__(self, items: list[dict[str, int]]):
        self.n = len(items)
        self.terms = sorted(set().union(*items))
        place = {t: i for i, t in enumerate(self.terms)}
        entries = sorted((place[t], i, c) for i, item in enumerate(items) for t, c in item.items())
        self.term, self.item, self.times = (np.array(x, np.int64) for x in (zip(*entries, strict=True) if entries else ((), (), ())))
        self.start = np.searchsorted(self.term, np.arange(len(self.terms) + 1))

    def matrix(self, terms: np.ndarray, scale: np.ndarray, kind: type) -> np.ndarray:
        """The rows of these terms, times the scale of each."""
        out = np.zeros((terms.size, self.n), kind)
        sizes = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        row = np.repeat(np.arange(terms.size), sizes)
        out[row, self.item[at]] = self.times[at] * scale[row]
        return out

    def number(self, impacts: Impacts) -> type:
        """Doubles, if no sum of an item's terms can leave their whole numbers."""
        most = np.zeros(self.n)
        np.add.at(most, self.item, self.times * 256.0 * impacts.step[self.term])
        return np.float64 if not most.size or most.max() < 2**52 else np.int64


def _blocks(row: np.ndarray, rows: int, terms: int) -> Iterator[tuple[int, int, slice]]:
    """Parts of a batch whose dense matrix has `CELLS` cells: first and last row, and where their entries are."""
    size = max(1, CELLS // max(1, terms))
    for a in range(0, rows, size):
        z = min(rows, a + size)
        yield a, z, slice(*np.searchsorted(row, [a, z]))


def _dense(row, column, values, rows: int, columns: int, kind: type) -> np.ndarray:
    out = np.zeros((rows, columns), kind)
    out[row, column] = values
    return out


class Best:
    """The k best (score, doc_id) of each item so far; a null doc_id is held as the largest."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, items: int, k: int):
        self.k, self.found = k, [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = (np.concatenate(x) for x in zip(self.found[item], (scores, ids), strict=True))
        if scores.size > self.k:
            at = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[at], ids[at]
        self.found[item] = scores, ids

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.found)), [s.size for s, _ in self.found])
        scores, ids = (np.concatenate([x[i] for x in self.found]) if self.found else np.empty(0, np.int64) for i in (0, 1))
        return batch_of(arrow_schema(FOUND), [item, pa.array(ids, mask=ids == self.NONE), scores])


def bests(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with their rank; groups of tasks first, so that an item's bests do not all meet at once."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = rows.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "g").orderBy(*best))).where(F.col("rank") <= k).drop("g")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)


def thresholds(index: DataFrame, items: Items, impacts: Impacts, k: int) -> np.ndarray:
    """The kth best lower bound of each item, or 1 where fewer documents have one above 0."""
    shared = index.sparkSession.sparkContext.broadcast((items, impacts, items.number(impacts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, impacts, kind = shared.value
        best = Best(items.n, k)
        for b in batches:
            sizes = np.diff(b.column(0).offsets.to_numpy())
            row, term = np.repeat(np.arange(b.num_rows), sizes), b.column(0).flatten().to_numpy().astype(np.int64)
            steps = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).astype(np.int64)
            there, column = np.unique(term, return_inverse=True)
            asked = items.matrix(there, impacts.step[there], kind)
            for a, z, at in _blocks(row, b.num_rows, there.size):
                least = _dense(row[at] - a, column[at], np.maximum(steps[at] - 1, 0), z - a, there.size, kind) @ asked
                for i in range(items.n):
                    floor = best.found[i][0].min() if best.found[i][0].size >= k else 0
                    over = least[:, i][least[:, i] > floor].astype(np.int64)
                    if over.size:
                        best.add(i, over, np.zeros(over.size, np.int64))
        yield best.rows()

    kth = bests(index.select("terms", "impacts").mapInArrow(run, FOUND), k).where(F.col("rank") == k).select("item", "score").toArrow()
    out = np.ones(items.n, np.int64)
    out[kth.column(0).to_numpy()] = np.maximum(kth.column(1).to_numpy(), 1)
    return out


def rescored(index: DataFrame, items: Items, impacts: Impacts, least: np.ndarray, k: int) -> DataFrame:
    """FOUND: each task's k best exact scores of each item, among all documents whose upper bound reaches the item's threshold."""
    shared = index.sparkSession.sparkContext.broadcast((items, impacts, items.number(impacts), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, impacts, kind, least = shared.value
        best = Best(items.n, k)
        for b in batches:
            row, term, count = _flat(b)
            ids, lengths = b.column(0).fill_null(Best.NONE).to_numpy(), b.column(1).to_numpy()
            steps = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8)
            there, column = np.unique(term, return_inverse=True)
            asked = items.matrix(there, impacts.step[there], kind)
            times = items.matrix(there, np.ones(there.size, np.int64), np.int64)
            for a, z, at in _blocks(row, b.num_rows, there.size):
                r, c = row[at] - a, column[at]
                near = _dense(r, c, steps[at], z - a, there.size, kind) @ asked >= least
                if near.any():
                    exact = _dense(r, c, impacts.exact(term[at], count[at], lengths[row[at]]), z - a, there.size, np.int64)
                    for i in np.flatnonzero(near.any(0)).tolist():
                        docs, own = np.flatnonzero(near[:, i]), np.flatnonzero(times[:, i])
                        scores = exact[np.ix_(docs, own)] @ times[own, i]
                        docs, scores = docs[scores > 0], scores[scores > 0]
                        best.add(i, scores, ids[a + docs])
        yield best.rows()

    return index.select("doc_id", "n", "terms", "counts", "impacts").mapInArrow(run, FOUND)


def _item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list[dict[str, int]]]]:
    """The items' ids and term counts, in blocks; the driver holds one block, and reads items as a stream."""
    ids, terms, entries = [], [], 0
    for row in items.select(item_col, text_col).toLocalIterator():
        found = terms_of(pa.array([row[1]], pa.string()))
        words = found.words.to_pylist()
        counts = Counter(words[i] for i in found.ids.tolist())
        if ids and (len(ids) == ITEMS or entries + len(counts) > ENTRIES):
            yield ids, terms
            ids, terms, entries = [], [], 0
        ids.append(row[0])
        terms.append(counts)
        entries += len(counts)
    if ids:
        yield ids, terms


def search(docs: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0, equal scores by doc_id."""
    spark, kind = prepared(docs.sparkSession), items.schema[item_col].dataType
    out = None
    for ids, terms in _item_blocks(items, item_col, text_col):
        block = Items(terms)
        rows = stored(counted(docs, block.terms), "lexical-counts")
        sums = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        impacts = Impacts(document_counts(rows, len(block.terms)), sums.docs, sums.words)
        index = stored(indexed(rows, impacts), "lexical-index")
        discard(rows)
        found = stored(bests(rescored(index, block, impacts, thresholds(index, block, impacts, k), k), k), "lexical-found")
        discard(index)
        named = spark.createDataFrame(list(enumerate(ids)), f"item bigint, `{item_col}` {kind.simpleString()}")  # ITEMS rows at most
        found = found.join(F.broadcast(named), "item").select(item_col, F.col("rank").cast("int"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"`{item_col}` {kind.simpleString()}, rank int, doc_id bigint, score bigint") if out is None else out
