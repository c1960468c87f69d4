"""Toxicity scores from class-conditional Kneser-Ney models.

Words are runs of letters, digits and underscores of the lower-cased text, cut by one function for fitting and for
scoring, and read as character sequences between word marks. For each class (toxic, ordinary) the
highest order holds that class's counts; everything below it is one shared backoff of continuation counts over both
classes, so an expression that neither class has often gets nearly the same likelihood from both. A word's evidence
is the difference of its log-likelihoods; a document's features are length-normalised: the mean over its words, the
highest mean over `WINDOW` consecutive words, and the highest word divided by its characters; besides, on a log scale,
how many different words in a hundred words of text (and `PAD_WORDS` more) have more evidence than each of `STRONG`. A logistic curve, fitted on training rows that the
counts have not seen and weighted back to the labels' own prevalence, turns them into a score from 0 to 1.

The n-grams of all labelled training rows are counted, by distributed aggregates; the driver gets a row for each
different n-gram of the highest order, from which all lower orders follow. Only the logistic curve is fitted on a
bounded sample (`per_class` rows of each class of the calibration fold, by hash order). Every document is scored over
its whole text. Null and empty texts have features of zero. Null doc_ids are not held out
and never labelled. Repeated label rows count once, toxic if any says so. Without training rows of both classes
every score is 0. Only doc_id and text are read from documents, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, kept, prepared, release, slices

ORDER = 6
DISCOUNT = 0.75
WINDOW = 8
STRONG = (2.0, 4.0)
#: Ordinary words by which a text counts as longer, so that one strong word of a very short text is no rate.
PAD_WORDS = 50
PER_CLASS = 2000
THRESHOLD = 0.3
FOLDS = 4
HELD_OUT = 2
CALIBRATION = 3
CACHED_WORDS = 50_000
STEP = 10_000
BROADCAST_LABELS = 1_000_000
COUNTS = "gram string, n00 bigint, n01 bigint, n10 bigint, n11 bigint"
NAMES = ("mean_llr", "window_llr", "word_llr", "some_words", "sure_words")
FEATURES = "doc_id bigint, " + ", ".join(f"{n} double" for n in NAMES)
_WORD = re.compile(r"\w+")
TALLY = "word string, n00 bigint, n01 bigint, n10 bigint, n11 bigint"


def words_of(text: str) -> list[str]:
    """The words of a text or of a part between white space; the one tokenizer of fit and score."""
    return _WORD.findall(text.lower())


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' characters with marks before and after, the positions that are to be predicted, and each one's word."""
    joined = "".join([f"{_BEFORE}{w}\x03" for w in words])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.array([len(w) + 1 for w in words], int))
    return chars, np.flatnonzero(chars != 2), owner


_BEFORE = "\x02" * (ORDER - 1)


def keys_of(chars: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the n-grams of this order that end at each position, and of their histories."""
    history = np.full(at.size, order, np.uint64)
    for j in range(order - 1, 0, -1):
        history = (history ^ (history >> _TURN)) * _MIX + chars[at - j].astype(np.uint64, copy=False)
    return (history ^ (history >> _TURN)) * _MIX + chars[at].astype(np.uint64, copy=False), history


def grams_of(words: list[str], counts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The words' different n-grams of the highest order, and the sums of their words' counts by column."""
    chars, at, owner = spelled(words)
    _, first, inverse = np.unique(keys_of(chars, at, ORDER)[0], return_index=True, return_inverse=True)
    windows = chars[at[first][:, None] + np.arange(1 - ORDER, 1)].astype(np.uint32)
    return windows.view(f"U{ORDER}").ravel().tolist(), np.stack([np.bincount(inverse, c[owner], len(first)) for c in counts.T], 1)


def counted(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands or its values' sum."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, len(found)).astype(float)


def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The table's value of each key; 0 where it is absent."""
    if not table[0].size:
        return np.zeros(keys.shape)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0.0)


class Model:
    """Two Kneser-Ney models over one shared backoff, from counts of n-grams by class.

    The shared backoff cancels out of the log ratio of a character that neither class has after its history, so
    the ratio is known for each n-gram seen and, for all others, for each history seen: two tables say everything.
    """

    def __init__(self, chars: np.ndarray, counts: np.ndarray):
        """chars: code points of n-grams of the highest order, one after the other; all lower orders are their ends, taken
        one order at a time. counts: a row for each n-gram, columns ordinary and toxic."""
        at = np.arange(ORDER - 1, chars.size, ORDER)
        keys, histories = keys_of(chars, at, 1)
        p = None
        for j in range(1, ORDER):  # continuation counts: how many different longer n-grams end in this one
            longer, older = keys_of(chars, at, j + 1)
            first = np.unique(longer, return_index=True)[1]
            ends, before = keys[first], histories[first]
            of_gram, of_history, kinds = counted(ends), counted(before), counted(before[np.unique(ends, return_index=True)[1]])
            if p is None:
                p = np.full(at.size, 1.0 / max(2, len(of_gram[0]) + 1))
            n = np.maximum(look(of_history, histories), 1.0)
            p = np.maximum(look(of_gram, keys) - DISCOUNT, 0) / n + DISCOUNT * look(kinds, histories) / n * p
            keys, histories = longer, older
        gram, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        seen = [np.bincount(inverse, counts[:, c], len(gram)) for c in (0, 1)]
        p = p[first]
        self.histories, back = np.unique(histories[first], return_inverse=True)
        logs, left = [], []
        for c in (0, 1):
            total = np.bincount(back, seen[c], len(self.histories))
            kinds = np.bincount(back, (seen[c] > 0).astype(float), len(self.histories))
            rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1.0), 1.0)
            logs.append(np.log(np.maximum(seen[c] - DISCOUNT, 0) / np.maximum(total, 1.0)[back] + rest[back] * p))
            left.append(np.log(rest))
        self.grams, self.ratio, self.rest = gram, logs[1] - logs[0], left[1] - left[0]

    def evidence(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        chars, at, owner = spelled(words)
        gram, history = keys_of(chars, at, ORDER)
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hit = self.grams[place] == gram
        got = np.where(hit, self.ratio[place], 0.0)
        miss = np.flatnonzero(~hit)
        got[miss] = look((self.histories, self.rest), history[miss])
        return np.bincount(owner, got, len(words))


class Scorer:
    """Features of texts; words' evidence is kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.evidence = self.best = np.zeros(0)

    def _learn(self, new: list[str]) -> None:
        parts = [words_of(w) for w in new]
        owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        got = np.concatenate([self.model.evidence(flat[k : k + STEP]) for k in range(0, len(flat), STEP)] or [np.zeros(0)])
        best = np.zeros(len(new))
        if flat:
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best[owner[starts]] = np.maximum.reduceat(got / np.array([len(x) + 1 for x in flat]), starts)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.evidence = np.concatenate([self.evidence, np.bincount(owner, got, len(new))])
        self.best = np.concatenate([self.best, best])

    def features(self, texts: list[str | None]) -> np.ndarray:
        words = [t.split() if t else [] for t in texts]
        new = set().union(*words).difference(self.index)
        if len(self.index) + len(new) > CACHED_WORDS:
            self.__init__(self.model)
            new = set().union(*words)
        if new:
            self._learn(list(new))
        out = np.zeros((len(texts), len(NAMES)))
        place = self.index.__getitem__
        for i, ws in enumerate(words):
            if ws:
                at = np.fromiter(map(place, ws), np.int64, len(ws))
                found = self.evidence[at]
                sums = np.concatenate([[0.0], np.cumsum(found)])
                w = min(WINDOW, len(ws))
                some = self.evidence[np.unique(at[found > STRONG[0]])]
                rate = 100.0 / (len(ws) + PAD_WORDS)
                out[i] = sums[-1] / len(ws), (sums[w:] - sums[:-w]).max() / WINDOW, self.best[at].max(), np.log1p(some.size * rate), np.log1p((some > STRONG[1]).sum() * rate)
        return out


def _scorer(model) -> Scorer:
    """One scorer a worker process and broadcast model."""
    return kept(("toxicity", id(model)), lambda: (model, Scorer(model.value)))[1]


def _features(docs: DataFrame, model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, arrow = _scorer(model), arrow_schema(FEATURES)
        for part in slices(batches, 1):
            yield batch_of(arrow, [part.column(0), *scorer.features(part.column(1).to_pylist()).T])

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum() + 0.5 * b @ penalty @ b

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) / weight.sum() + penalty @ beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x / weight.sum() + penalty
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(step).max() < 1e-7:
            break
    return beta


def gram_counts(docs: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """How often all n marked rows' texts have each n-gram of the highest order: ordinary and toxic, without and in the calibration fold; ints, as they all go to the driver."""
    marks = marked.select("doc_id", (F.when(F.col("fold") == CALIBRATION, 2).otherwise(0) + F.col("cls")).alias("column"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(TALLY)
        for part in slices(batches, 0):
            sums: dict[str, list[int]] = {}
            for text, column in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for word, times in Counter(words_of(text or "")).items():
                    sums.setdefault(word, [0, 0, 0, 0])[column] += times
            yield batch_of(arrow, [list(sums), *(zip(*sums.values(), strict=True) if sums else [[]] * 4)])

    texts = docs.select("doc_id", "text").join(F.broadcast(marks) if n <= BROADCAST_LABELS else marks, "doc_id").select("text", "column")
    words = texts.mapInArrow(tally, TALLY).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(COUNTS)
        for part in slices(batches, 0):
            grams, sums = grams_of(part.column(0).to_pylist(), np.column_stack([part.column(i).to_numpy() for i in range(1, 5)]))
            yield batch_of(arrow, [grams, *sums.astype(np.int64).T])

    return words.mapInArrow(run, COUNTS).groupBy("gram").agg(*(F.least(F.sum(c), F.lit(2**31 - 1)).cast("int").alias(c) for c in ("n00", "n01", "n10", "n11")))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model, list[float], list[float]] | None:
    """The model, its logistic coefficients and the features' scales; None without training rows of both classes."""
    found = _fit(spark, docs, labels, per_class)
    release()  # what the counts took on the driver
    return found


def _fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[Model, list[float], list[float]] | None:
    prepared(spark)
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("cls")).withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    size = {r.cls: r.n for r in marked.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    table = gram_counts(docs, marked, sum(size.values())).toArrow()  # a row for each different n-gram
    if not table.num_rows:
        return None
    chars = np.concatenate([np.frombuffer("".join(c.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32) for c in table.column(0).chunks])
    counts = np.column_stack([table.column(i).to_numpy() for i in range(1, 5)])
    del table
    early = counts[:, :2].any(1)
    if not early.any():
        return None
    model = Model(chars.reshape(-1, ORDER)[early].ravel(), counts[early, :2])
    chosen = None
    for c in (0, 1):
        part = marked.where((F.col("fold") == CALIBRATION) & (F.col("cls") == c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = spark.createDataFrame([tuple(r) for r in chosen.select("doc_id", "cls").collect()], "doc_id bigint, cls int")  # 2 * per_class rows at most
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    shared = spark.sparkContext.broadcast(model)
    rows = _features(sample, shared).join(F.broadcast(chosen), "doc_id").collect()
    shared.destroy()
    x, y = np.array([[r[n] for n in NAMES] for r in rows]), np.array([r.cls for r in rows])
    model = Model(chars, counts[:, :2] + counts[:, 2:])  # the curve is known; now all folds count
    if len(set(y.tolist())) < 2:
        return model, [1.0] + [0.0] * len(NAMES), [1.0] * len(NAMES)
    scale = np.maximum(x.std(0), 1e-9)
    weight = np.where(y == 1, size[1] / max(1, (y == 1).sum()), size[0] / max(1, (y == 0).sum()))
    return model, logistic(x / scale, y, weight).tolist(), scale.tolist()


def keep_ordinary(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; without a model all of them."""
    fitted = fit(spark, docs, labels, per_class)
    if fitted is None:
        return docs
    model, beta, scale = fitted
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")
    slope, limit = np.array(beta[:-1]) / np.array(scale), np.log(threshold / (1 - threshold)) - beta[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for part in slices(batches, at):
            yield part.filter(pa.array(scorer.features(part.column(at).to_pylist()) @ slope < limit))

    return docs.mapInArrow(run, docs.schema)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row of docs."""
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    fitted = fit(spark, docs, labels, per_class)
    if fitted is None:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model, beta, scale = fitted
    z = F.lit(beta[-1])
    for name, b, s in zip(NAMES, beta, scale, strict=False):
        z = z + F.col(name) * F.lit(b / s)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))
    found = _features(docs, spark.sparkContext.broadcast(model)).select("doc_id", held, score.alias("score"), *NAMES)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *NAMES)
