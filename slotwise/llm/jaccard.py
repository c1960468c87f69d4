"""Similarity join on word shingles: a size-aware heavy-light join.

Sets of at most `small` shingles enumerate fixed-size subsets: a document of t shingles lists, for each smaller or
equal size s that could still link with it, all its subsets of the overlap that such a pair must have; linked sets
list a subset in common. Larger sets are looked up in inverted lists: of each, only the prefix of t - ceil(f t) + 1
shingles in one global order, which linked sets cannot miss both. The order puts frequent shingles last, the most
frequent at the end: all shingles of `HEAVY` documents and more in the extended prefixes count as frequent (the `HEAVY_KEPT` most frequent of them are
broadcast; any order gives the same links, so that bound costs time and not links). The boundary is chosen by cost:
of all sizes up to MOST_SMALL the one at which keys enumerated and entries read, at the real lengths of the lists that
small sets stand in, are fewest.

Lists of thousands of near copies are never paired with themselves. First each list's members are compared with two
leaders, its smallest and its largest set; components of these links are taken. While lists are crowded with
different components, members outside a list's largest component are compared with some of its members, in turns.
Then only pairs of different components in the same list remain, enumerated by component and filtered by size and
place: what stands at and after the first shingle in common must hold the overlap. A parity sketch of each set bounds
from below in how many shingles a pair differs and drops pairs that cannot link; every remaining pair is verified on
whole shingle sets, so no link between different components is lost.

Documents of equal sets are taken together first. Null and empty texts have no shingles and link with nothing. Rows
that share a doc_id (null included) are one document. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, discard, prepared, slices, stored
from .components import components
from .substrings import LAST_ID, hashed, windows

HEAVY = 12
HEAVY_KEPT = 1_000_000
#: Steps of the histogram of counts for each doubling.
GRADES = 64
#: Documents up to which ids are broadcast to choose texts; beyond, the ids are joined by shuffling.
BROADCAST_IDS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A list is crowded if it holds over CROWDED pairs of different components a member; turns of comparing with leaders, and leaders a turn.
CROWDED, TURNS, LEADERS = 10, 6, 8
#: Bits of the parity sketch that bounds how far two sets differ.
PARITY_BITS = 2048
SETS = "id bigint, digest string, n bigint, some array<bigint>, parity array<bigint>"
#: keys: the set's lists; reach: how many of its shingles stand at or after the list's own in the global order.
KEYED = "id bigint, digest string, n bigint, keys array<bigint>, reach array<bigint>, whole boolean"
#: The row key of keep_one, beside the documents' own columns.
KEY = "__slotwise_key"
WHOLE = "id bigint, keys array<bigint>"


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; sets link when den * intersection >= num * union."""

    words: int = 4
    num: int = 85
    den: int = 100

    def least(self, n: int) -> int:
        """The overlap that a set of n needs with any set it links with."""
        return -(-self.num * n // self.den)

    def overlap(self, s: int, t: int) -> int:
        return -(-self.num * (s + t) // (self.num + self.den))

    def reaches(self, reach: str, n1: str, n2: str) -> Column:
        """Whether so many shingles can hold the overlap of sets of n1 and n2."""
        return F.col(reach) * (self.num + self.den) >= (F.col(n1) + F.col(n2)) * self.num

    def fits(self, n1: str, r1: str, n2: str, r2: str) -> Column:
        """Whether sets can link whose first shingle in common leaves r1 and r2; a list that isn't their first only drops a repetition."""
        return self.reaches(r1, n1, n2) & self.reaches(r2, n1, n2)

    def sizes(self, t: int) -> list[int]:
        """Sizes up to t that can link with a set of t."""
        return [s for s in range(1, t + 1) if self.overlap(s, t) <= s]

    def subsets(self, t: int) -> set[int]:
        """Overlaps whose subsets a small set of t lists: against smaller sets, and against larger ones."""
        found = {self.overlap(s, t) for s in self.sizes(t)}
        larger = t
        while self.overlap(t, larger) <= t:
            found.add(self.overlap(t, larger))
            larger += 1
        return found


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles in order; shorter texts have their whole sequence as one."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = hashed(parts)
    if len(h) < words:
        return windows(h, len(h)) ^ np.uint64(0xA5A5A5A5 + len(h))
    return np.unique(windows(h, words))


def _linked_most(rule: Rule, n: int) -> int:
    """The largest size that can link with a set of n."""
    return rule.den * n // rule.num


def _reach(n: int, rule: Rule, most_small: int = 16) -> int:
    """How many shingles of a set's first are kept at hand: half as many again as its prefix, and all of a set that may be small."""
    return max((n - rule.least(n) + 1) * 3 // 2 + 8, min(n, most_small))


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SETS)
        for part in slices(batches, 1):
            digests, sizes, some, parities = [], [], [], []
            for text in part.column(1).to_pylist():
                h = shingles(text, rule.words)
                digests.append(xxhash.xxh3_128_hexdigest(h.tobytes()) if len(h) else None)
                sizes.append(len(h))
                some.append(h[: _reach(len(h), rule)].view(np.int64))
                odd = np.bincount((h >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS).astype(np.uint8) & 1
                parities.append(np.packbits(odd).view(np.int64))
            yield batch_of(schema, [part.column(0), digests, sizes, some, parities])

    return run


def _keys(h: np.ndarray, n: int, rule: Rule, small: int, heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
    """The lists that a set of n shingles stands in and its reach in each, from its first shingles h; None if h is too short."""
    out, reach = [], []
    if n and rule.least(n) <= small:  # it is small, or can link with a small set
        for size in sorted(rule.subsets(n)):
            if size <= n:
                picked = np.array(list(combinations(h.tolist(), size)), np.uint64).reshape(-1, size)
                mixed = np.full(len(picked), size, np.uint64)
                for j in range(size):
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + picked[:, j]
                out.append(np.unique(mixed))
                reach.append(np.full(len(out[-1]), n))
    if n > small:
        often, place = heavy
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        common = often[at] == h if len(often) else np.zeros(len(h), bool)
        rare, prefix = h[~common], n - rule.least(n) + 1
        if len(rare) < prefix and len(h) < n:
            return None
        reach.append(n - np.arange(prefix))
        out.append(np.concatenate([rare, h[common][np.argsort(place[at[common]])]])[:prefix])
    return (np.concatenate(out), np.concatenate(reach)) if out else (h[:0], np.zeros(0, np.int64))


def _all(rule: Rule):
    """(id, text) to (id, keys): all shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(WHOLE)
        for part in slices(batches, 1):
            yield batch_of(schema, [part.column(0), [shingles(t, rule.words).view(np.int64) for t in part.column(1).to_pylist()]])

    return run


def _listed(rule: Rule, small: int, heavy, from_text: bool):
    """Each set's lists, from its first shingles or, where these do not reach, from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, common, none = arrow_schema(KEYED), heavy.value, np.zeros(0, np.int64)
        for part in slices(batches, 3) if from_text else batches:
            keys, reaches, whole = [], [], []
            for n, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist() if from_text else part.column(3), strict=True):
                h = shingles(x, rule.words) if from_text else x.values.to_numpy().view(np.uint64)
                found = _keys(h, n, rule, small, common)
                whole.append(found is not None)
                keys.append(none if found is None else found[0].view(np.int64))
                reaches.append(none if found is None else found[1])
            yield batch_of(schema, [*(part.column(i) for i in range(3)), keys, reaches, whole])

    return run


#: Sizes that the boundary may take; sets up to the largest size that links with them are looked at for it.
MOST_SMALL = 12


def small_costs(listed: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each size of listed(n, k), the small sets' entries in inverted lists: how many there are, and how many entries of their lists they meet."""
    by_list = listed.groupBy("k", "n").agg(F.count("*").alias("c")).groupBy("k").agg(F.collect_list(F.struct("n", "c")).alias("sizes"), F.sum("c").alias("all"))  # a list has a row for each of few sizes
    rows = by_list.select(F.explode("sizes").alias("s"), "all").groupBy("s.n").agg(F.sum("s.c").alias("entries"), F.sum(F.col("s.c") * F.col("all")).alias("met"))
    return {r.n: (r.entries, r.met) for r in rows.collect()}


def boundary(rule: Rule, sizes: dict[int, int], costs: dict[int, tuple[int, int]]) -> int:
    """The largest size of small sets, from 0 to MOST_SMALL, at which keys that are enumerated and entries that are read come cheapest.

    sizes: how many sets there are of each size; costs: small_costs() of the same sets. A set enumerates its subsets if
    it is small or can link with one that is; a larger one reads its prefix's lists, at the lists' real lengths.
    """

    def cost(small: int) -> int:
        total = 0
        for n, count in sizes.items():
            if rule.least(n) <= small:
                total += count * sum(comb(n, k) for k in rule.subsets(n) if k <= n)
            if n > small:
                total += sum(costs.get(n, (0, 0)))
        return total

    return min(range(MOST_SMALL + 1), key=lambda small: (cost(small), small))


def link_sets(docs: DataFrame, rule: Rule = Rule(), heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(id, digest, n) of each row, and (node, component) of the documents that have links; ids: LAST_ID stands for null."""
    spark = prepared(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(base.mapInArrow(_sets(rule), SETS), "jaccard-sets")
    parity = sets.where("n > 0").select("id", "n", "parity")
    owners = stored(sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("owner")), "jaccard-owners")
    owned = sets.where("n > 0").select("id", "digest", "n", "some").join(owners, "digest").where("id = owner").select("id", "digest", "n", "some")
    often = _frequent(owned.select(F.explode("some").alias("k")), heavy)
    common = spark.sparkContext.broadcast(_order(often))
    first = owned.mapInArrow(_listed(rule, 0, common, False), KEYED)
    early = stored(first.where("not whole").select("id", "digest", "n").distinct(), "jaccard-short")
    # sets whose first shingles are mostly frequent need shingles that no extended prefix has shown: count those of them too
    shown = _texts(base, early).select("id", "text").mapInArrow(_all(rule), WHOLE)
    often = _most(often, _frequent(shown.select(F.explode("keys").alias("k")), heavy))
    discard(early)
    common.destroy()
    common = spark.sparkContext.broadcast(_order(often))
    few = owned.where(F.col("n") <= _linked_most(rule, MOST_SMALL))  # their first shingles are all they have
    sizes = {r.n: r.c for r in few.groupBy("n").agg(F.count("*").alias("c")).collect()}
    small = boundary(rule, sizes, small_costs(few.mapInArrow(_listed(rule, 0, common, False), KEYED).select("n", F.explode("keys").alias("k"))))
    listed = stored(owned.mapInArrow(_listed(rule, small, common, False), KEYED), "jaccard-lists")
    short = stored(listed.where("not whole").select("id", "digest", "n").distinct(), "jaccard-short")
    again = _texts(base, short).mapInArrow(_listed(rule, small, common, True), KEYED)
    keys = listed.where("whole").unionByName(again.where("whole")).select("id", "n", F.explode(F.arrays_zip("keys", "reach")).alias("e")).select("id", "n", F.col("e.keys").alias("k"), F.col("e.reach").alias("r"))
    # what is aggregated by list is written before it is joined, so that a list of very many members can be split
    shared = stored(keys.groupBy("k").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.min("n").alias("low")).where("x < y").select("k", "low"), "jaccard-shared")
    members = stored(keys.join(shared, "k").where(rule.reaches("r", "n", "low")).select("id", "n", "k", "r"), "jaccard-members")
    ends = stored(members.groupBy("k").agg(F.min(F.struct("n", "r", "id")).alias("low"), F.max(F.struct("n", "r", "id")).alias("high")), "jaccard-ends")
    common.destroy()
    leaders = F.explode(F.array("low", "high")).alias("lead")
    tried = members.join(ends, "k").select("id", "n", "r", leaders).where(rule.fits("n", "r", "lead.n", "lead.r") & (F.col("id") != F.col("lead.id"))).select(F.col("id").alias("a"), F.col("lead.id").alias("b")).distinct()
    found = verify(base, nearest(tried, parity, rule), rule)
    copies = sets.where("n > 0").join(owners, "digest").where("id <> owner").select(F.col("id").alias("a"), F.col("owner").alias("b"))
    led = components(found.where("linked").select("a", "b"))
    placed, crowded = _open(members, led)
    for turn in range(TURNS):
        if not crowded.count():
            break
        tried = _by_leaders(placed.join(crowded, "k"), turn, rule).join(_once(found), (F.greatest("a", "b") == F.col("hi")) & (F.least("a", "b") == F.col("lo")), "left_anti")
        more = verify(base, nearest(tried, parity, rule), rule)
        found = found.unionByName(more)
        links = more.where("linked").select("a", "b")
        if links.isEmpty():
            break
        led = components(led.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        last = placed, crowded
        placed, crowded = _open(placed.drop("c"), led)
        discard(*last)
    groups = placed.groupBy("k", "c").agg(F.min("n").alias("low"), F.max("r").alias("far"), F.count("*").alias("s"))
    one, two = (groups.select("k", *(F.col(x).alias(f"{x}{i}") for x in ("c", "low", "far", "s"))) for i in (1, 2))
    smaller = (F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("c1") < F.col("c2")))  # its members are listed first
    apart = one.join(two, "k").where(smaller & rule.reaches("far1", "low1", "low2") & rule.reaches("far2", "low1", "low2")).select("k", "c1", "c2", "low2", "far2")
    left, right = (placed.select("k", F.col("c").alias(f"c{i}"), F.col("id").alias(name), F.col("n").alias(f"n{i}"), F.col("r").alias(f"r{i}")) for i, name in ((1, "a"), (2, "b")))
    one = apart.join(left, ["k", "c1"]).where(rule.reaches("r1", "n1", "low2") & rule.reaches("far2", "n1", "low2"))
    rest = one.join(right, ["k", "c2"]).where(rule.fits("n1", "r1", "n2", "r2")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    rest = rest.join(_once(found), ["hi", "lo"], "left_anti").select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    more = verify(base, near(rest, parity, rule).select("a", "b").distinct(), rule).where("linked").select("a", "b")
    groups = components(led.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(copies))
    discard(listed, shared, members, ends, placed, crowded, short)
    return sets.select("id", "digest", "n"), groups


def _frequent(shingled: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, HEAVY_KEPT at most: all of a count that a histogram of the counts leaves room for, so nothing is sorted."""
    counts = stored(shingled.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") >= least), "jaccard-frequent")
    grade = F.floor(F.log2("c") * GRADES).cast("int")  # so many steps for each doubling of a count
    room, lowest = HEAVY_KEPT, None
    for r in sorted(counts.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.g):
        room -= r.n
        if room < 0:
            break
        lowest = r.g
    found = counts.where(grade >= lowest if lowest is not None else F.lit(False)).toArrow()
    discard(counts)
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def _most(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both lists' shingles, HEAVY_KEPT at most, each with its larger count."""
    k, at = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    c = np.zeros(k.size, np.int64)
    np.maximum.at(c, at, np.concatenate([one[1], two[1]]))
    kept = np.sort(np.lexsort((k, -c))[:HEAVY_KEPT])
    return k[kept], c[kept]


def _order(often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles by hash, and the place of each in the order from less to more frequent."""
    k, place = often[0].astype(np.int64).view(np.uint64), np.empty(often[0].size, np.int64)
    place[np.lexsort((k, often[1]))] = np.arange(k.size)
    by_hash = np.argsort(k)
    return k[by_hash], place[by_hash]


def _texts(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, digest, n, text) of the listed sets; few ids are broadcast, more are joined by shuffling."""
    few = ids.count() <= BROADCAST_IDS
    return base.join(F.broadcast(ids) if few else ids, "id").select("id", "digest", "n", "text")


def _once(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _open(members: DataFrame, led: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (k, id, n, r, c) of lists with more than one component, and the lists that hold too many pairs of different components."""
    placed = members.select("id", "n", "r", "k").join(led, F.col("id") == F.col("node"), "left").select("id", "n", "r", "k", F.coalesce("component", "id").alias("c"))
    open_keys = placed.groupBy("k").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("k")
    placed = stored(placed.join(open_keys, "k"), "jaccard-open")
    sizes = placed.groupBy("k", "c").agg(F.count("*").cast("double").alias("s")).groupBy("k").agg(F.sum("s").alias("t"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return placed, stored(sizes.where((F.col("t") * F.col("t") - F.col("q")) / 2 > CROWDED * F.col("t")).select("k"), "jaccard-crowded")


def _by_leaders(placed: DataFrame, turn: int, rule: Rule) -> DataFrame:
    """Pairs of each list's members outside its largest component with `LEADERS` members of that component, picked by hash."""
    main = placed.groupBy("k", "c").agg(F.count("*").alias("s")).groupBy("k").agg(F.max(F.struct("s", "c")).alias("m")).select("k", F.col("m.c").alias("mc"))
    inside = placed.join(main, "k").where("c = mc")
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(turn * LEADERS + i)).alias("h"), "id", "n", "r")).alias(f"p{i}") for i in range(LEADERS)]
    leaders = inside.groupBy("k", "mc").agg(*picks).select("k", "mc", F.array_distinct(F.array(*(F.struct(*(F.col(f"p{i}.{x}").alias(x) for x in ("id", "n", "r"))) for i in range(LEADERS)))).alias("leaders"))
    outside = placed.join(leaders, "k").where("c <> mc").select("id", "n", "r", F.explode("leaders").alias("lead"))
    pairs = outside.where(rule.fits("n", "r", "lead.n", "lead.r")).select(F.col("id").alias("a"), F.col("lead.id").alias("b"))
    return pairs.distinct()


def near(pairs: DataFrame, parity: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, apart) of the pairs whose sets can link: parities that differ in d bits come from sets that differ in d shingles at least."""
    side = lambda name, k: parity.select(F.col("id").alias(name), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    both = pairs.select("a", "b").join(side("a", 1), "a").join(side("b", 2), "b")
    apart = F.aggregate(F.zip_with("p1", "p2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("n1") + F.col("n2")
    shared = F.ceil(F.lit(rule.num) * total / F.lit(rule.num + rule.den) - F.lit(1e-9))
    return both.select("a", "b", apart.alias("apart"), (total - 2 * shared).alias("most")).where("apart <= most").select("a", "b", "apart")


def nearest(pairs: DataFrame, parity: DataFrame, rule: Rule) -> DataFrame:
    """Of each a's pairs that can link the one of closest sketches; the others are compared later, if their ends are still apart then."""
    return near(pairs, parity, rule).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", "m.b")


def verify(base: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, linked) of pairs(a, b): whether their whole sets link. Each set is hashed from its text once and joined as an array.

    Members are joined before leaders, so what meets at a leader of thousands has a size that adaptive execution sees and splits.
    """
    pairs = stored(pairs, "jaccard-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = 2 * pairs.count() <= BROADCAST_IDS
    sets = stored(base.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "text").mapInArrow(_all(rule), WHOLE), "jaccard-whole")
    one, two = sets.select(F.col("id").alias("a"), F.col("keys").alias("x")), sets.select(F.col("id").alias("b"), F.col("keys").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("n1"), F.size("y").alias("n2"), F.size(F.array_intersect("x", "y")).alias("both"))
    linked = (F.col("both") > 0) & (F.col("both") * rule.den >= (F.col("n1") + F.col("n2") - F.col("both")) * rule.num)
    found = stored(both.select("a", "b", linked.alias("linked")), "jaccard-led")
    discard(pairs, sets)
    return found


def group_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    sets, groups = link_sets(docs, rule)
    known = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    joined = sets.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return joined.select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """docs, all columns, with one document of each component only: the smallest key, which is the doc_id where that is its own.

    A document is a doc_id and a text. Rows of a null doc_id, and all but one of different texts under one doc_id, have
    a key of a hash instead, after all ids, so none of them is lost to another text; of their links the smallest key
    stays like any other. Of rows that repeat both id and text one stays, by a hash of all its columns; rows without
    words link with nothing and, without an id, are all kept. The keys to drop are broadcast if they are few, so texts
    stay where they are; otherwise they are joined by shuffling.
    """
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    bare = F.col("doc_id").isNull() & wordless
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("__id"), own.alias("__text"))
    shared = stored(named.groupBy("__id").agg(F.min("__text").alias("__first"), F.max("__text").alias("__last")).where("__first <> __last").select("__id", "__first"), "jaccard-ids")
    n = shared.count()
    hashed_key = F.lit(LAST_ID - 1) - F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**62 - 1))
    key = F.when(F.col("doc_id").isNull(), hashed_key)
    known = docs.where(~bare)
    if n:
        known = known.join(F.broadcast(shared) if n <= BROADCAST_IDS else shared, F.col("doc_id").cast("bigint") == F.col("__id"), "left")
        key = key.when(F.col("__first") != own, hashed_key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    known = known.select(*columns, key.otherwise(F.col("doc_id").cast("bigint")).alias(KEY))
    _, groups = link_sets(known.select(F.col(KEY).alias("doc_id"), "text"), rule)
    out = stored(groups.where("node <> component").select(F.col("node").alias(KEY)).distinct(), "jaccard-out")
    kept = known.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, KEY, "left_anti")
    again = stored(known.groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY), "jaccard-again")
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= BROADCAST_IDS else again
        one = kept.join(again, KEY, "left_semi").groupBy(KEY).agg(F.min_by(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), F.xxhash64(*columns)).alias("__row"))
        kept = kept.join(again, KEY, "left_anti").unionByName(one.select(KEY, *(F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns))))
    return kept.select(*columns).unionByName(docs.where(bare))
