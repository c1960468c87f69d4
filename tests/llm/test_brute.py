"""Results recomputed by plain Python, and the branches and edges that small tables do not reach."""

import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slotwise.llm import bpe, common, fingerprints, jaccard, mixing, pii, sharding, substrings, topk, toxicity
from tests.llm.test_dedup import brute_groups, brute_windows, edited_docs


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def xx(*values, seed=42):
    """Spark's xxhash64 of strings, longs and (as tuples of one) ints."""
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed=seed % 2**64)
    return signed(seed)


# --- sharding --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("names,turns", [(["a", "b", "c"], None), ([f"s{i}" for i in range(9)], [1, 3, 0, 2, 1, 1, 5, 1, 1])])
def test_lookup_table_is_filled_by_turns(names, turns):
    size, taken = 211, {}
    wishes = []
    for s in names:
        offset, skip = zlib.crc32(f"offset:{s}".encode()) % size, zlib.crc32(f"skip:{s}".encode()) % (size - 1) + 1
        wishes.append([(offset + skip * j) % size for j in range(size)])
        assert sorted(wishes[-1]) == list(range(size))
    while len(taken) < size:
        for i in range(len(names)):
            for _ in range(1 if turns is None else turns[i]):
                free = [slot for slot in wishes[i] if slot not in taken]
                if free:
                    taken[free[0]] = i
    assert sharding.lookup_table(names, turns, size).tolist() == [taken[k] for k in range(size)]


# --- fingerprints ----------------------------------------------------------------------------------------------------
def signature(text):
    words = [xx(w) for w in re.split(r"[\x20\t\n\x0b\x0c\r]+", text.strip(" \t\n\x0b\x0c\r"))] if text.strip(" \t\n\x0b\x0c\r") else []
    if not words:
        return "-"
    two = [xx(a, b) for a, b in zip(words, words[1:])]
    four = [xx(a, b) for a, b in zip(two, two[2:])]
    runs = [xx(a, b) for a, b in zip(four, words[4:])] if len(words) >= 5 else [xx(*words)]
    bins = {}
    for h in runs:
        k = (h >> 56) + 128
        bins[k] = min(bins.get(k, h), h)
    dense = []
    for i in range(256):
        j = 0
        while (at := i if j == 0 else (((i * 2654435 + 101) * 2 + 1) * j + i * 40503 + 7) % 256) not in bins:
            j += 1
        dense.append(bins[at] & 15)
    return "".join(f"{sum(dense[16 * k + j] << (4 * j) for j in range(16)):016X}" for k in range(16))


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(8)
    texts = ["", "one", "one two three four", "a b c d e", "a b  c\td e\nf", "été ñ 日本 x y z"] + [" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (6, 9, 20, 60, 200, 400, 1500)]
    texts.append(" ".join(f"v{i}" for i in range(60_000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in fingerprints.fingerprint_documents(docs).collect():
        assert row.fingerprint == signature(texts[row.doc_id])
        after = texts[row.doc_id - 1] if row.doc_id else texts[-1]
        half = len(texts[row.doc_id]) // 2
        assert row.edited_fingerprint == signature(texts[row.doc_id][: len(texts[row.doc_id]) - half] + after[:half])


def test_outlying_null_and_repeated_ids_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 50)
    rows = [(i, f"t{i}") for i in range(900)] + [(10**15, "far"), (-(10**15), "low")] + [(None, f"n{i}") for i in range(500)] + [(77, f"again{i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = []

    def seen(df):
        sizes.extend(r["count"] for r in df.groupBy("bucket").count().collect())
        return df

    found = {(r.doc_id, r.text): r.next_text for r in fingerprints.with_next(docs, ["text"], seen).collect()}
    assert len(found) == len(rows) and max(sizes) < 250
    order = sorted(rows, key=lambda d: (d[0] is None, -(d[0] or 0), xx(d[1]), d[1]))
    assert found == {a: b[1] for a, b in zip(order, order[1:] + order[:1])}


# --- personal data ---------------------------------------------------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def python_votes(kind, strict, text, a, z, last, after_end):
    hit, d = text[a:z], re.sub("[^0-9]", "", text[a:z])
    find = lambda p, x: re.search(p, x, re.ASCII)
    if kind == "card":
        shape, lists = 1 if 13 <= len(d) <= 19 and luhn(d) else 2, 1 if find(pii.ISSUERS, d) else 2
    elif kind == "phone":
        shape, lists = 1 if find(r"[().\x20-]", hit) else 2, 1 if find(pii.AREA, hit) else 0 if strict else 2
    elif kind == "email":
        shape, lists = 1 if strict or find(r"\[|\(", hit) else 2, 1 if find(pii.DOMAINS, hit) else 2
    else:
        shape, lists = 2 if find(r"^0[0-9]|\.0[0-9]", hit) else 1, 2 if find(pii.RESERVED, hit) else 1
    before, after = text[last:a][-40:], text[z:after_end][:16]
    near = 1 if find(pii.CUES_FOR, before) else 2 if find(pii.CUES_AGAINST, before) else 0
    behind = 1 if find(pii.AFTER_FOR, after) else 2 if find(pii.AFTER_AGAINST, after) else 0
    return shape, lists, near, behind


def python_form(text, a, z, last, after_end):
    between, gap = re.sub("[A-Za-z0-9]", "", text[a:z]), " \t\n\v\f\r"
    left, right = text[last:a][-1:], text[z:after_end][:1]
    side = lambda c, marks: 0 if not c or c in gap else 1 if c in marks else 2
    return ((min(3, (z - a) // 8) * 3 + min(2, len(set(between)))) * 3 + side(left, ":;,=(<[\"'")) * 3 + side(right, ".,;:)!?>]\"'")


def python_candidates(text):
    out = []
    for strict, patterns in ((True, BASE), (False, pii.LOOSE)):
        for kind, pattern in patterns.items():
            spans = [m.span() for m in re.finditer(pattern, text, re.ASCII)]
            for n, (a, z) in enumerate(spans):
                d = re.sub("[^0-9]", "", text[a:z])
                possible = kind != "ip" or all(int(x) <= 255 for x in re.findall("[0-9]+", text[a:z]))
                good = possible if not strict else {"email": True, "ip": all(int(x) <= 255 for x in text[a:z].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
                if good:
                    last, end = spans[n - 1][1] if n else 0, spans[n + 1][0] if n + 1 < len(spans) else len(text)
                    out.append((a, list(BASE).index(kind), z, strict, python_votes(kind, strict, text, a, z, last, end), python_form(text, a, z, last, end)))
    base = [s for s in out if s[3]]
    return sorted(base), sorted(s for s in out if not s[3] and not any(b[0] < s[2] and s[0] < b[2] for b in base))


def test_all_spans_equal_brute_force(spark):
    r = random.Random(6)
    bits = ["call 415 555 1234", "(212) 555-9876 ext 4", "tel. +1 (988) 555-2485", "order 1234 5678 9012 3", "4111 1111 1111 1111", "visa 4111-1111-1111-111", "mail joe at example dot com", "joe (at) site [dot] org", "a@b.com", "x.y+z@w.co.uk", "10.0.0.1", "host 8.8.8.8 px", "version 1.2.3.4", "300.1.1.1", "isbn 9780306406157", "plain words here", "12,5 %", "é😀", "host 10[.]0[.]0[.]7", "10(dot)0(dot)0(dot)300", "4111.1111.1111.1111", "visa: 4222222222222", "1234567890123456", "f1234567890123456a"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(0, 12))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    every = [python_candidates(t) for t in texts]
    kinds = Counter((s[1], s[4], s[5]) for base, loose in every for s in base + loose)
    rows = [(k, v, f, float(n)) for (k, v, f), n in sorted(kinds.items(), key=lambda x: (x[0][0], x[0][1], x[0][2]))]
    counts = defaultdict(float)
    for k, v, _, n in rows:
        counts[k, v] += n
    post, rates = pii.expectation_maximisation(dict(counts))
    weights = pii.train_classifier(rows, post)
    taken = lambda s: sum(a * b for a, b in zip(weights, pii.features(s[1], s[4], s[5]))) >= 0 and (s[1], s[4][0]) != (2, 2)
    want = {i: ",".join(f"{list(BASE)[s[1]]}:{s[0]}:{s[2]}" for s in sorted([*base, *filter(taken, loose)])) for i, (base, loose) in enumerate(every)}
    assert {x.doc_id: x.spans for x in pii.find(docs).collect()} == want
    assert any(filter(taken, (s for _, loose in every for s in loose))) and not all(map(taken, (s for _, loose in every for s in loose)))


def with_check_digit(digits):
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def planted(seed, n):
    """Texts with personal data in forms that the base does not take, and with look-alikes; and the spans that are personal data."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghklmnoprstu") for _ in range(r.randrange(3, 9)))
    groups = lambda x, sep: sep.join(x[k : k + 4] for k in range(0, 16, 4))

    def good_card():
        d = r.choice(["4", "5" + r.choice("12345")])
        return with_check_digit(d + digits(15 - len(d)))

    def bad_card():
        d = good_card()
        return d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10)

    real = {
        "email": lambda: f"{r.choice(['mail', 'contact', 'write to', 'e-mail'])} {word()} {r.choice(['(at)', '[at]'])} {word()} {r.choice(['(dot)', '[dot]'])} {r.choice(['com', 'org', 'net', 'de'])}",
        "ip": lambda: f"{r.choice(['host', 'server', 'ip', 'from'])} " + r.choice(["[.]", "(dot)", "[dot]"]).join(str(r.randrange(1, 224 if k == 0 else 255)) for k in range(4)),
        "card": lambda: f"{r.choice(['card', 'visa', 'credit card', 'pay by card'])} {groups(good_card(), r.choice(['.', '/', '_']))}",
        "phone": lambda: f"{r.choice(['call', 'phone', 'tel', 'mobile'])} {r.choice(['({0}) {1}-{2}', '{0}-{1}-{2}', '{0} {1} {2}']).format('2345679'[r.randrange(7)] + digits(2), digits(3), digits(4))}",
    }
    decoys = [
        lambda: f"{r.choice(['order', 'serial', 'ref', 'id', ''])} {bad_card()}", lambda: f"token {word()[:2]}{digits(16)}{word()[:2]}", lambda: f"build {groups(bad_card(), '.')}", lambda: f"sku 0{digits(2)} {digits(3)} {digits(4)}",
        lambda: f"part 1{digits(2)}-{digits(3)}-{digits(4)}", lambda: f"order 0{digits(2)}-{digits(3)}-{digits(4)}", lambda: f"look at {word()} dot {word()}", lambda: f"v{digits(1)}[.]{digits(1)}", lambda: f"{digits(2)}x{digits(15)}",
    ]
    texts, truth = [], []
    for _ in range(n):
        text, spans = "", set()
        for _ in range(r.randrange(1, 6)):
            text += " ".join(word() for _ in range(r.randrange(1, 12))) + " "
            if r.random() < 0.5:
                kind = r.choice(list(real))
                said = real[kind]()
                cue = re.match(r"(?:mail|contact|write to|e-mail|host|server|ip|from|pay by card|credit card|card|visa|call|phone|tel|mobile) ", said).end()
                spans.add((kind, len(text) + cue, len(text) + len(said)))
                text += said
            else:
                text += r.choice(decoys)()
            text += r.choice([" ", ". ", ", ", "\n"])
        texts.append(text)
        truth.append(spans)
    return texts, truth


def test_added_spans_are_those_planted(spark):
    """Precision and recall over what the base does not find; look-alikes are digit runs that fail Luhn, hex tokens, order and part numbers."""
    texts, truth = planted(5, 1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hit = found = 0
    by_kind = Counter()
    for x in pii.find(docs).collect():
        base = {f"{n}:{a}:{z}" for a, _, n, z in ((s[0], s[1], list(BASE)[s[1]], s[2]) for s in python_candidates(texts[x.doc_id])[0])}
        for span in (s for s in x.spans.split(",") if s and s not in base):
            kind, a, z = span.split(":")
            text = texts[x.doc_id][int(a) : int(z)]
            assert kind != "card" or luhn(re.sub("[^0-9]", "", text)), text
            found += 1
            good = (kind, int(a), int(z)) in truth[x.doc_id]
            hit += good
            by_kind[kind, good] += 1
    want = sum(map(len, truth))
    print("precision", hit / found, "recall", hit / want, dict(by_kind))
    assert hit / found >= 0.95 and hit / want >= 0.9, (hit / found, hit / want, by_kind)


def test_expectation_maximisation_settles_where_both_steps_agree():
    r = random.Random(2)
    counts = Counter()
    for _ in range(4000):  # the truth decides the votes, with known rates
        y = r.random() < 0.4
        counts[0, tuple((1 if (r.random() < good) == y else 2) if r.random() < 0.8 else 0 for good in (0.95, 0.8, 0.7, 0.6))] += 1.0
    post, rates = pii.expectation_maximisation(dict(counts), 400)
    prior, tables = rates[0]
    assert abs(prior - 0.4) < 0.05 and abs(tables[0][1][1] / (tables[0][1][1] + tables[0][1][2]) - 0.95) < 0.05
    for (k, v), p in post.items():
        one, none = prior * math.prod(t[1][x] for t, x in zip(tables, v)), (1 - prior) * math.prod(t[0][x] for t, x in zip(tables, v))
        assert abs(one / (one + none) - p) < 1e-6


def test_redact_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a@b.com +1 988 555 2485 x", 7, [1], 3, "k", 0), (2, None, None, None, None, None, 9)], "doc_id bigint, text string, base int, loose array<int>, `a.b` int, row string, n_chars bigint")
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).dtypes == docs.dtypes
    assert tuple(rows[1]) == (1, "<email> <phone> x", 7, [1], 3, "k", 17) and tuple(rows[2])[2:] == (None, None, None, None, 0)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    named = docs.withColumn("source", F.lit("s")).withColumn("__key", F.lit(1))
    for kept in (jaccard.keep_one(named, jaccard.Rule(5, 80, 100)), toxicity.keep_ordinary(spark, named, labels), mixing.mixed(named)):
        assert kept.dtypes == named.dtypes and kept.select("doc_id").distinct().count() == 2


def test_overlapping_spans_are_cut_once(spark):
    text = "q +1 4111111111111111 z 1.2.3.4@x.org" + " pad" * 700 + " a@b.co"
    base, _ = python_candidates(text)
    out, end = "", 0
    for start, kind, stop, *_ in base:
        if start >= end:
            out += text[end:start] + f"<{list(BASE)[kind]}>"
        end = max(end, stop)
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.redact(docs).first().text == out + text[end:]


def test_a_text_of_very_many_matches(spark):
    text = "a@b.co " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.perf_counter()
    assert pii.find(docs).first().n_email == 100_000
    assert pii.redact(docs).first().text == "<email> " * 100_000
    assert time.perf_counter() - began < 120


# --- search ----------------------------------------------------------------------------------------------------------
def test_the_tree_cuts_and_stays_exact():
    r = np.random.default_rng(4)
    centres = r.normal(0, 40, (30, 8))
    rows = np.floor(centres[r.integers(0, 30, 6000)] + r.normal(0, 1, (6000, 8)))
    tree = topk.BallTree.from_bytes(topk.BallTree.planted(np.arange(6000), rows, 64).to_bytes())
    queries, ids = rows[:40], np.arange(40)
    scores = queries @ rows.T
    scores[np.arange(40), np.arange(40)] = -np.inf
    want = [sorted(zip(-s, range(6000)))[:5] for s in scores]
    for start in (-np.inf, [-w[4][0] for w in want]):  # alone, and with the kth score that other shards have found
        tree.opened = tree.cut = 0
        found = tree.search(ids, queries, np.full(40, start) if np.isscalar(start) else np.array(start), 5)
        assert [[(-s, i) for s, i in zip(f[1], f[0])] for f in found] == want
        assert tree.cut > 5 and tree.opened < len(tree.radii)
        before, last = (tree.opened, None) if np.isscalar(start) else (before, tree.opened)
    assert last <= before


# --- duplicates ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("few,crowded", [(0, 0.0), (0, 10), (1_000_000, 0.0)])
def test_groups_by_every_branch(spark, monkeypatch, few, crowded):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", few)
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    docs = edited_docs(7, 120)
    sets, groups = jaccard.link_sets(spark.createDataFrame(docs, "doc_id bigint, text string"), jaccard.Rule(2, 85, 100), 3)
    known = lambda x: None if x == substrings.LAST_ID else x
    found = {r.node: r.component for r in groups.collect()}
    assert sorted(((known(r.id), r.n, known(found.get(r.id, r.id))) for r in sets.collect()), key=str) == brute_groups(docs, jaccard.Rule(2, 85, 100))


def test_a_long_text_in_hundreds_of_near_copies(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(8000)]
    docs = []
    for i in range(300):
        own = list(words)
        for _ in range(i % 7):
            own[r.randrange(len(own))] = f"x{i}"
        docs.append((i, " ".join(own)))
    docs += [(1000 + i, " ".join(f"y{i}z{j}" for j in range(300))) for i in range(20)]
    found = {r.doc_id: r.component_id for r in jaccard.group_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == {i: 0 if i < 1000 else i for i, _ in docs}


def test_repeats_by_shuffled_texts_and_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_IDS", 0)
    r = random.Random(2)
    passage = [f"p{j}" for j in range(120)]
    docs = [(i, " ".join([f"w{r.randrange(10**6)}" for _ in range(20_000 if i < 2 else 200)] + passage[: 49 + i % 4] + ["end"])) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, substrings.remove_repeats(df).collect()), key=str) == brute_windows(docs, 50)
    lone = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(90))) for i in range(4)], "doc_id bigint, text string")
    assert substrings.doubled(50) == (13, 25, 50) and {x.n_removed for x in substrings.remove_repeats(lone).collect()} == {0}


# --- mixing ----------------------------------------------------------------------------------------------------------
def test_copies_follow_the_blocks_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 25)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    r = random.Random(4)
    docs = [(i, s, "w " * r.randrange(1, 30)) for s, n in (("a", 300), ("b", 90), ("c", 40)) for i in range(1000 * ord(s), 1000 * ord(s) + n)]
    rows = mixing.plan(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), towards_equal=0.6, most_passes=100.0).collect()
    text = {i: t for i, _, t in docs}
    totals, weight = Counter(), {x.source: x.weight for x in rows}
    for x in rows:
        totals[x.source] += len(text[x.doc_id].split())
    budget = max(totals[s] / weight[s] for s in totals)
    for s in totals:
        mine = [x for x in rows if x.source == s]
        target = max(round(weight[s] * budget), totals[s])
        passes, rest = divmod(target, totals[s])
        blocks = math.ceil(len(mine) / 25)
        assert all(x.block == xx(x.doc_id, (mixing.SEED,)) % blocks for x in mine) and len({x.block_key for x in mine}) == len({x.block for x in mine})
        for x in sorted(mine, key=lambda x: (x.block_key, x.block, xx(x.doc_id, (mixing.SEED + 1,)), x.doc_id)):
            rest -= len(text[x.doc_id].split())
            assert x.copies == passes + (rest >= 0), (s, x)
    order = [k for k, _ in sorted({(x.block, x.block_key) for x in rows if x.source == "a"}, key=lambda b: b[1])]
    assert len(order) == 12 and order != sorted(order)


# --- the rest --------------------------------------------------------------------------------------------------------
def test_long_pieces_stay_in_the_matrix():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, r = bpe.ByteBPE(ranks, public_tokenizers.PATTERN), random.Random(1)
    texts = ["".join(r.choice("abcdeéñ") for _ in range(n)) for n in (255, 256, 257, 300, 1000, 20_000)] + ["the" * 300, "ha" * 129, "x" * 5000, "日本語" * 200]
    assert codec.encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_toxicity_of_very_long_texts(spark):
    rows = [(i, " ".join([f"w{j % 97}" for j in range(60)] + ["zorkxa"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, "w1 " * 200_000), (901, "zorkxa w2 " * 100_000)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in toxicity.score_documents(spark, docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")).collect()}
    assert found[900].predicted == 0 and found[901].predicted == 1


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)
            set = staticmethod(lambda key, value: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            environment = {"PYTHONPATH": ""}

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)})())})())

    with pytest.raises(RuntimeError, match="shared|share"):
        common.scratch(Session, "x")


def test_discarded_tables_are_gone(spark, tmp_path):
    kept, gone = common.stored(spark.range(3), "a"), common.stored(spark.range(3), "b")
    path = gone.inputFiles()[0]
    common.discard(gone)
    assert kept.count() == 3 and not __import__("os").path.exists(path.removeprefix("file://"))
