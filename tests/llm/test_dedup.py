import hashlib
import random
from collections import Counter

import pytest

from slotwise.llm import components, jaccard, substrings

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def rows_of(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in docs], "doc_id bigint, text string, digest string, hashes int, keys string")


def brute_windows(docs, length):
    words = [(t or "").encode().split() for _, t in docs]
    last = 2**63
    first = {}
    for (i, _), w in zip(docs, words):
        for q in range(len(w) - length + 1):
            key = tuple(w[q : q + length])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for q in range(len(w) - length + 1):
            if first[tuple(w[q : q + length])] < (last if i is None else i):
                gone[q : q + length] = [True] * length
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def random_docs(seed, n, letters, most):
    r = random.Random(seed)
    docs = [(i, " ".join(r.choice(letters) for _ in range(r.randrange(0, most)))) for i in range(n)]
    return docs + [(3, docs[5][1]), (3, docs[3][1]), (None, docs[7][1]), (None, docs[7][1]), (n, None), (n + 1, " \t\x0b ")]


@pytest.mark.parametrize("levels", [None, (2, 3, 5)])
def test_repeats_equal_brute_force(spark, levels):
    docs = random_docs(3, 60, "ab", 40)
    got = substrings.remove_repeats(rows_of(spark, docs), 5, levels).collect()
    assert sorted(map(tuple, got), key=str) == brute_windows(docs, 5)


def test_repeats_of_production_length(spark):
    r = random.Random(1)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    docs = [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(80)) + (f" {passage} tail{i}" if i % 3 == 0 else "")) for i in range(30)]
    docs.append((31, docs[4][1]))
    docs.append((32, " ".join(["same"] * 5000)))
    docs.append((33, " ".join(["same"] * 49)))
    got = substrings.remove_repeats(rows_of(spark, docs)).collect()
    assert sorted(map(tuple, got), key=str) == brute_windows(docs, 50)


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(rows_of(spark, [(1, "a")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(rows_of(spark, []), 5, (5,))


def brute_groups(docs, rule):
    sets = []
    for _, t in docs:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[q : q + rule.words]) for q in range(len(w) - rule.words + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists, seen = {}, {}
    for k, ((i, _), s) in enumerate(zip(docs, sets)):
        if i in seen:
            parent[top(k)] = top(seen[i])
        seen.setdefault(i, k)
        for x in s:
            lists.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in lists[x] if j < k).items():
            if rule.den * both >= rule.num * (len(s) + len(sets[j]) - both):
                parent[top(k)] = top(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), least.get(top(k))) for k, ((i, _), s) in enumerate(zip(docs, sets))), key=str)


def edited_docs(seed, n):
    r, docs = random.Random(seed), []
    for i in range(n):
        if docs and r.random() < 0.6:
            w = (r.choice(docs)[1] or "a").split() or ["a"]
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = r.choice("abcdefgh")
            docs.append((i, " ".join(w[:-1] if r.random() < 0.3 else w)))
        else:
            docs.append((i, " ".join(r.choice("aBcdefgh") for _ in range(r.randrange(0, 60)))))
    return docs + [(5, "q r s t u"), (n, None), (n + 1, "  "), (None, "a b c d e f")]


@pytest.mark.parametrize("rule,heavy", [(jaccard.Rule(), 200), (jaccard.Rule(2, 85, 100), 3), (jaccard.Rule(1, 80, 100), 4)])
def test_groups_equal_brute_force(spark, rule, heavy):
    docs = edited_docs(3, 160)
    sets, groups = jaccard.link_sets(rows_of(spark, docs), rule, heavy)
    known = lambda x: None if x == substrings.LAST_ID else x
    found = {r.node: r.component for r in groups.collect()}
    assert groups.count() == len(found)
    assert sorted(((known(r.id), r.n, known(found.get(r.id, r.id))) for r in sets.collect()), key=str) == brute_groups(docs, rule)


def test_one_of_each_group_stays(spark):
    """A document is an id and a text: of different texts under one id none is lost to another."""
    docs = edited_docs(4, 80)
    rule = jaccard.Rule(5, 80, 100)
    kept = jaccard.keep_one(rows_of(spark, docs), rule)
    assert kept.columns == ["doc_id", "text", "digest", "hashes", "keys"]
    found = [(r.doc_id, r.text) for r in kept.collect()]
    known = sorted({(i, t or "") for i, t in docs}, key=repr)
    groups = {}
    for k, _, c in brute_groups(list(enumerate(t for _, t in known)), rule):
        groups.setdefault(k if c is None else c, set()).add(known[k])
    named = [(i, t or "") for i, t in found]
    for members in groups.values():
        wordless = all(not t.split() for _, t in members)
        here = [x for x in named if x in members]
        assert len(here) == (sum((i, t or "") in members for i, t in docs) if wordless and all(i is None for i, _ in members) else len(members) if wordless else 1)
        ids = [i for i, _ in members if i is not None]
        if len(here) == 1 and len(ids) == len(members) and all(sum(i == j for j, _ in known) == 1 for i in ids):
            assert here[0][0] == min(ids)
    assert sorted(map(repr, named)) == sorted(map(repr, (x for x in named if any(x in m for m in groups.values()))))
    assert jaccard.keep_one(rows_of(spark, docs).limit(0), rule).count() == 0


def test_texts_of_one_id_all_stay(spark):
    r = random.Random(8)
    text = lambda: " ".join(f"w{r.randrange(10_000)}" for _ in range(40))
    one, two, three = text(), text(), text()
    rows = [(7, one, "a"), (7, two, "a"), (7, two, "b"), (7, three, "a"), (8, three, "a"), (None, one, "a"), (9, one + " end", "a"), (10, None, "a"), (10, "", "b"), (None, None, "a"), (None, " ", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    kept = [tuple(x) for x in jaccard.keep_one(df, jaccard.Rule(5, 80, 100)).collect()]
    texts = [t for _, t, _ in kept if t and t.strip()]
    assert len(texts) == 3 and {t.removesuffix(" end") for t in texts} == {one, two, three}
    assert sum(i == 10 for i, *_ in kept) == 1 and sum(i is None and not (t or "").strip() for i, t, _ in kept) == 2
    again = [tuple(x) for x in jaccard.keep_one(df.repartition(5), jaccard.Rule(5, 80, 100)).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, again))  # which of the rows of one id and text stays is no accident


def test_boundary_goes_by_what_lists_cost():
    rule = jaccard.Rule()
    rare = {n: (100 * (n - rule.least(n) + 1), 100) for n in range(1, 15)}
    crowded = {n: (100 * (n - rule.least(n) + 1), 10**9) for n in range(1, 15)}
    sizes = dict.fromkeys(range(1, 15), 100)
    low, high = jaccard.boundary(rule, sizes, rare), jaccard.boundary(rule, sizes, crowded)
    assert low < high == jaccard.MOST_SMALL and jaccard.boundary(rule, {}, {}) == 0
    some = {n: (100, 10**9 if n <= 4 else 100) for n in range(1, 15)}
    assert 4 <= jaccard.boundary(rule, sizes, some) < jaccard.MOST_SMALL


def test_costs_are_those_of_the_lists(spark):
    r = random.Random(2)
    rows = [(r.randrange(1, 5), min(r.randrange(30), r.randrange(30))) for _ in range(400)]
    found = jaccard.small_costs(spark.createDataFrame(rows, "n bigint, k bigint").repartition(4))
    length = Counter(k for _, k in rows)
    assert found == {n: (sum(m == n for m, _ in rows), sum(length[k] for m, k in rows if m == n)) for n in {m for m, _ in rows}}


@pytest.mark.parametrize("kept,want", [(1_000_000, 4), (10, 4), (3, 3), (2, 1), (0, 0)])
def test_frequent_shingles_by_histogram(spark, monkeypatch, kept, want):
    monkeypatch.setattr(jaccard, "HEAVY_KEPT", kept)
    rows = [(k,) for k, n in ((1, 100), (2, 40), (3, 40), (4, 12), (5, 11), (6, 1)) for _ in range(n)]
    k, c = jaccard._frequent(spark.createDataFrame(rows, "k bigint"), 12)
    found = dict(zip(k.tolist(), c.tolist(), strict=True))
    assert len(found) == want and all(found[x] == {1: 100, 2: 40, 3: 40, 4: 12}[x] for x in found)


def test_subset_bounds_hold():
    rule = jaccard.Rule()
    for t in range(1, 15):
        for s in rule.sizes(t):
            assert rule.overlap(s, t) in rule.subsets(t) & rule.subsets(s)
            assert rule.least(t) <= rule.overlap(s, t)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (7, 7), (20, 3), (30, 31), (31, 32), (32, 33), (33, 34), (3, 2)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 20: 1, 9: 9, 10: 9, 30: 30, 31: 30, 32: 30, 33: 30, 34: 30}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
