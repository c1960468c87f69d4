"""Importance resampling, chat formatting and lexical search against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotwise.llm import chat, importance, lexical, terms
from slotwise.llm.queries import CONTROL_TEXT

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def some_texts(n, seed, long=60):
    r = random.Random(seed)
    vocab = ["the", "of", "a", "Über", "naïve", "x1", "ÄÖ", "mixed-Case", "éte", "日本", "42", "don't", "🎈", "İ"] + [f"w{i}" for i in range(40)]
    return [r.choice([" ", "\n", ", ", "."]).join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 5, 19, 20, 25, long]))) for _ in range(n)]


ODD = [None, "", " \n\t", "...", "A", "a", "\x00b\x7fc", "long " * 40_000, "@[`{/:", "é"]


def test_terms():
    texts = [*ODD, *some_texts(50, 3)]
    for array in (pa.array(texts, pa.string()), pa.array(["cut", *texts], pa.string()).slice(1)):
        found = terms.terms_of(array)
        listed = found.words.to_pylist()
        back = [[] for _ in texts]
        for i, row in zip(found.ids.tolist(), found.text.tolist(), strict=True):
            back[row].append(listed[i])
        assert back == [words(t) for t in texts] and len(set(listed) - {""}) == len(set().union(*back))
    assert terms.terms_of(pa.array([], pa.string())).ids.size == 0


def grams(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, percent=5, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        fs = grams(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("percent,slice_bytes", [(5, 2 << 20), (37, 300), (100, 5_000)])
def test_resampling_equals_brute_force(spark, monkeypatch, percent, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    texts = [*ODD, *some_texts(120, 5)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(30, texts[30]), (30, texts[30]), (31, texts[90]), (None, texts[40]), (None, None), (-7, texts[50])]
    target = [*some_texts(8, 6), None, ""]
    df = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in docs], "doc_id bigint, text string, weight int, buckets string, rank int").repartition(5)
    wanted = spark.createDataFrame([(None, t, 1) for t in target], "item_id bigint, text string, n int")
    got = importance.resample(df, wanted, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(docs, target, percent)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20)], "doc_id bigint, text string")
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(docs.limit(0), target.limit(0)).count() == 0
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0), percent=100).first().rank == 1
    assert importance.resample(docs, target).first().rank is None
    with pytest.raises(ValueError):
        importance.resample(docs, target, buckets=1 << 17)


def test_sample_keeps_whole_rows(spark):
    texts = some_texts(80, 9)
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    target = spark.createDataFrame([(t,) for t in texts[:5]], "text string")
    drawn = importance.resample(df, target, percent=30).where("rank is not null")
    got = importance.sample(df, target, percent=30)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in drawn.collect()}
    assert all(r.text == texts[r.doc_id] and r.source == f"s{r.doc_id}" for r in got.collect())


# --- chat ---------------------------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    r = random.Random(4)
    bits = [*chat.Template().controls, "\\", "\\\\", "<", "|>", "[", "INST]", "/", "\n", "é🎈", "s>", "ok ", "<|", "$1", "(?i)", "\x00"]
    texts = [None, "", "x" * 50_000, CONTROL_TEXT, "<\\s>", "\\<s>", "<<s>", "<|tu", *("".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(200))]
    rows = []
    for conv in [*range(60), None]:
        roles = ["user", "assistant", "system", "tool", "", None, "<|turn|>a\\"] if conv else ["assistant"]
        rows += [(conv, turn if r.random() > 0.1 else 3, r.choice(roles), r.choice(texts), 1) for turn in range(r.randrange(1, 9))]
    rows += [(70, None, "user", "first", 0), (70, 1, "user", "second", 0), (70, 1, "user", "second", 0), (71, 0, "user", "no answer", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, at int").repartition(4)
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    formatted = chat.format_conversations(df)
    back = {x.conv_id: x for x in chat.read_back(formatted).collect()}
    plain, t = {x.conv_id: x for x in chat.digests(chat.read_back(formatted)).collect()}, chat.Template()
    assert set(back) == set(want)
    for conv, turns in want.items():
        got = [(s.role, s.text) for s in back[conv].turns]
        order = sorted(turns)
        assert sorted(got) == sorted((role, text) for *_, role, text in turns)
        assert got == [(role, text) for *_, role, text in order] or len({x[:2] for x in turns}) < len(turns)
        learnt = [text for role, text in got if role == "assistant"]
        assert back[conv].learnt == learnt
        blocks = sum(1 for i, (role, _) in enumerate(got) if not i or role != got[i - 1][0])
        assert back[conv].formatted.count(t.opening) == back[conv].formatted.count(t.close) == blocks
        assert not any(back[conv].formatted.count(c) for c in t.reserved)
        said = "".join(f"{role}\n{text}\n" for role, text in got)
        assert tuple(plain[conv]) == (conv, len(got), hashlib.sha256(said.encode()).hexdigest(), len("".join(learnt)), hashlib.sha256("".join(learnt).encode()).hexdigest(), len(back[conv].formatted))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_merges_and_masks(spark):
    df = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 3, "assistant", "")], "conv_id bigint, turn bigint, role string, text string")
    row = chat.format_conversations(df).first()
    assert row.formatted == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|>c<|next|><|end|>"
    assert [row.formatted[s.start - 1 : s.start - 1 + s.chars] for s in row.loss] == ["c", ""]
    for bad in ({"opening": "<"}, {"joint": "<|end|>"}, {"head": "a\\b"}, {"close": ">|x"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_chat_uses_expressions_only(spark):
    df = spark.createDataFrame([(1, 1, "user", "b")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.digests(chat.read_back(chat.format_conversations(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- lexical search -----------------------------------------------------------------------------------------------------
def brute_search(docs, items, k):
    counts = [Counter(words(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in counts]
    n, total, df = sum(1 for x in lengths if x), sum(lengths), Counter(w for c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for (i, _), c, length in zip(docs, counts, lengths, strict=True):
            m, score = 25 + 75 * length * n // total if total else 0, 0
            for w in words(text):
                if c[w]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,items_a_block,cells,slice_bytes", [(10, 256, 1 << 20, 2 << 20), (3, 4, 50, 300), (1, 1, 1, 1)])
def test_search_equals_brute_force(spark, monkeypatch, k, items_a_block, cells, slice_bytes):
    monkeypatch.setattr(lexical, "ITEMS", items_a_block)
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "SLICE_BYTES", slice_bytes)
    texts = [*ODD, *some_texts(90, 11)]
    docs = list(enumerate(texts)) + [(20, texts[20]), (20, texts[20]), (21, texts[60]), (None, texts[40]), (None, None)] + [(200 + i, texts[33]) for i in range(25)]
    asked = [(1, texts[33]), (2, "the of a the"), (3, None), (4, ""), (5, "unheard of"), (None, "é日本"), (7, texts[60] + " " + texts[61]), (7, "w1 w2 w3"), (9, "nothing_here zzz")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, n int, terms string").repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id bigint, text string, score int")
    got = lexical.search(df, items, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, asked, k)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        assert lexical.search(d, i).count() == 0
    assert tuple(lexical.search(docs, items).first()) == (1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (1_000_000_000 // (1000 + 800)))


def test_bounds_hold():
    r = np.random.default_rng(3)
    df = r.integers(1, 1000, 300)
    impacts = lexical.Impacts(df, 1000, 200_000)
    term, count, length = r.integers(0, 300, 20_000), r.integers(1, 90, 20_000), r.integers(1, 30_000, 20_000)
    exact, steps, step = impacts.exact(term, count, length), impacts.bytes(term, count, length).astype(np.int64), impacts.step[term]
    assert (exact <= steps * step).all() and (exact >= np.maximum(steps - 1, 0) * step).all() and steps.max() <= 255
    huge = lexical.Items([{"a": 1 << 40}])
    assert huge.number(lexical.Impacts(np.array([1]), 10, 10)) is np.int64
