import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from slotwise.llm import fingerprints, mixing, pii, sharding, topk, toxicity, warc

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[name]
            if good():
                out.append((m.start(), k, name, m.end()))
    return sorted(out)


TEXTS = [
    "", None, "a@b.c_d@e.f x", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1 001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (988) 555-2485 4111111111111111",
    "x" * 50_000, "9" * 20_000, "1." * 5_000, "a@" + "b." * 10_000 + "c", "+" + "1 " * 10_000, "😀 a@b.co 😀 1.2.3.4", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "+1.2.3.4.5.6.7.8.9.0", "a@b.c a@b.c",
]


def test_pii_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 4)], "doc_id bigint, text string, base int")
    rows = pii.find(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = base_spans(TEXTS[r.doc_id])
        listed = [f"{n}:{a}:{z}" for a, _, n, z in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(n == k for _, _, n, _ in want) for k in BASE]
        assert set(listed) <= set(r.spans.split(","))
    assert pii.find(docs.limit(0)).count() == 0


def test_pii_adds_and_redacts(spark):
    docs = spark.createDataFrame([(1, "call 415 555 1234 or a@b.com", 9), (2, "tel (415) 555-9876 now", None), (3, None, 1), (4, "order 12", 8)], "doc_id bigint, text string, n_chars bigint")
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[1].text == "call <phone> or <email>" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "tel <phone> now" and rows[3].text == "" and rows[4].text == "order 12"
    post, rates = pii.expectation_maximisation({(3, (1, 1, 1, 0)): 50.0, (3, (2, 2, 2, 0)): 50.0})
    assert post[3, (1, 1, 1, 0)] > 0.9 > 0.1 > post[3, (2, 2, 2, 0)]


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_fingerprints(spark):
    r = random.Random(2)
    body = [" ".join(f"w{r.randrange(400)}" for _ in range(n)) for n in (300, 300, 5, 3, 900, 40)]
    texts = [body[0], body[0], body[1], body[2], body[3], None, "", " \n", body[4], body[4].replace("w1 ", "q "), body[5], "é" * 7]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, sig string")
    rows = {x.doc_id: x for x in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(rows, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        a, b = texts[i] or "", texts[j] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert rows[i].n_chars == len(a) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, x, y in ((rows[i].near_edited, shingles(a), shingles(edited)), (rows[i].near_next, shingles(a), shingles(b))):
            assert abs(got - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.15
    assert rows[0].fingerprint == rows[1].fingerprint != rows[2].fingerprint
    one = fingerprints.fingerprint_documents(docs.where("doc_id = 0")).first()
    assert one.near_next == 1.0
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    again = docs.unionByName(docs.where("doc_id in (0, 4)")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("bigint")))
    assert fingerprints.fingerprint_documents(again).count() == len(texts) + 3


def test_neighbours_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    ids = sorted(random.Random(5).sample(range(-50, 1000), 40), reverse=True)
    rows = fingerprints.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string"), ["text"], lambda df: df).collect()
    assert {r.doc_id: r.next_text for r in rows} == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def brute_topk(vectors, k):
    good = {}
    for n, (i, v) in enumerate(vectors):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[n] = (i, [math.floor(256.0 * x) for x in v])
    out = []
    for i, v in good.values():
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good.values() if j != i and len(w) == len(v))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block_rows", [(16_384, 1024), (60, 2)])
def test_topk_equals_brute_force(spark, monkeypatch, shard_rows, block_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    vectors[10] = (10, vectors[20][1])
    vectors[11] = (11, None)
    vectors[12] = (12, [None] * 8)
    vectors[13] = (13, [float("nan")] * 8)
    vectors[14] = (14, [float("inf")] + [0.0] * 7)
    vectors[15] = (15, [3.0e12] * 8)
    vectors[50] = (50, [0.0] * 8)
    vectors[100] = (100, [1.0, 2.0])
    vectors[101] = (101, [3.0, -1.0])
    vectors.append((None, [0.5] * 8))
    vectors = [(i, v) for i, v in vectors if i != 15] if shard_rows > 60 else vectors
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id bigint, embedding array<double>, shard int")
    got = topk.top_k(df, df.where(F.col("vec_id") % 50 == 0), 5).collect()
    assert sorted(map(tuple, got)) == brute_topk(vectors, 5)
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("shards,blocks", [(1, 1), (7, 1), (7, 3), (20, 9), (3, 8)])
def test_waves_read_only_the_trees_they_ask(spark, shards, blocks):
    trees = spark.range(shards).select(F.col("id").alias("shard"), F.lit(2).alias("size"))
    read, done, size = [], 0, 1
    while done < shards:
        last = min(shards, done + size)
        wave = [(r.shard, r.block) for r in topk.asked_trees(trees, shards, blocks, done, last).collect()]
        assert sorted(wave) == sorted(((b + t) % shards, b) for b in range(blocks) for t in range(done, last))
        read += wave
        done, size = last, size * topk.GROWTH
    assert sorted(read) == [(s, b) for s in range(shards) for b in range(blocks)]  # every pair once in all waves


def test_lookup_table_and_placement(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, size=1009)
    sizes = [int((table == i).sum()) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1 and min(table) == 0
    fewer = sharding.lookup_table(names[:-1], size=1009)
    moved = sum(1 for a, b in zip(table, fewer) if a != 6 and a != b)
    assert moved < 0.25 * 1009
    heavy = sharding.lookup_table(["a", "b"], [3, 1], 101)
    assert abs(int((heavy == 0).sum()) - 76) <= 1
    for bad in (lambda: sharding.lookup_table(names, size=1000), lambda: sharding.lookup_table([]), lambda: sharding.lookup_table(names, [0] * 7)):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([(i, "old") for i in range(300)] + [(None, "x"), (None, "x")], "doc_id bigint, shard string")
    rows = sharding.place(df, "doc_id", names, size=1009).collect()
    assert len(rows) == 302 and len({r.shard for r in rows if r.doc_id is None}) == 1
    for r in rows:
        key = "\x00null" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:12], 16) % 1009 and r.shard == names[table[r.slot]]
    assert sharding.place(df.limit(0), "doc_id", names).count() == 0


def test_archive_round_trip(spark, tmp_path):
    long, longer = "é" * 600, "y" * 5000
    pages = [(1, "u1", long), (2, "u2", long), (9, "u\r\n9", long), (3, "u3", "short"), (4, "u4", "short"), (5, None, None), (6, "u6", longer), (7, "u7", "z" * 999), (8, "u8", "z" * 999), (6, "again", longer)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, sha256 string")
    warc.write_archive(df, f"{tmp_path}/a")
    rows = sorted(warc.read_archive(spark, f"{tmp_path}/a").collect(), key=lambda r: (r.page_id, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to) for r in rows] == [
        (1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (6, "revisit", 6), (7, "response", None), (8, "response", None), (9, "response", None)
    ]
    html = {p[0]: (p[2] or "").encode() for p in pages}
    assert all(r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest() for r in rows)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len(set(html.values()))
    for r in warc.original_records(spark, f"{tmp_path}/a").collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert bytes(r.payload) == html[r.page_id]
        assert body == (b"" if b"WARC-Type: revisit" in head else html[r.page_id]) + b"\r\n\r\n"
        assert int(re.search(rb"\nContent-Length: (\d+)", head)[1]) == len(body) - 4
    warc.write_archive(df.limit(0), f"{tmp_path}/b")
    assert warc.read_archive(spark, f"{tmp_path}/b").count() == 0


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string")
    warc.write_archive(df, f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit("tex!").cast("binary")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


def entropy(p):
    return -sum(x * math.log(x) for x in p if x)


def test_mixture_weights_and_copies(spark):
    docs = [(i, "big", "w " * 10) for i in range(400)] + [(1000 + i, "mid", "w " * 20) for i in range(60)] + [(2000 + i, None, "w " * 5) for i in range(40)] + [(3000, "mid", None), (3001, "none", ""), (None, "big", "w"), (None, "big", "w")]
    df = spark.createDataFrame([(i, s, t, 1) for i, s, t in docs], "doc_id bigint, source string, text string, weight int")
    rows = mixing.plan(df, towards_equal=0.5, most_passes=100.0).collect()
    assert len(rows) == len(docs)
    totals, weight, taken = {}, {}, {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + r.n_tokens
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens * r.copies
        weight[r.source] = r.weight
        assert r.copies >= 1
    some = [s for s in totals if totals[s]]
    shares = [totals[s] / sum(totals.values()) for s in some]
    assert abs(entropy([weight[s] for s in some]) - (entropy(shares) + 0.5 * (math.log(3) - entropy(shares)))) < 1e-6
    budget = max(totals[s] / weight[s] for s in some)
    for s in some:
        assert -20 <= taken[s] - weight[s] * budget <= 1
    few = mixing.plan(df, towards_equal=1.0, most_passes=2.0).collect()
    assert max(r.copies for r in few) <= 3
    cut = mixing.plan(df, towards_equal=0.0, budget=1000).collect()
    assert 900 <= sum(r.n_tokens * r.copies for r in cut) <= 1003 and min(r.copies for r in cut) == 0
    mixed = mixing.mixed(df, towards_equal=0.5, most_passes=100.0)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_toxicity_learns_and_survives(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    text = lambda bad: " ".join([*(r.choice(words) for _ in range(40)), *(["zorkx" + r.choice(["a", "en", "ish"])] * bad)])
    rows = [(i, text(2 * (i % 5 == 0)), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, y) for i, t, y in rows] + [(9001, None, 0), (9002, "", 0), (None, "zorkxa zorkxen", 1), (0, rows[0][1], 0)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    found = toxicity.score_documents(spark, docs, labels).collect()
    assert len(found) == 604 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in found)
    held = [x for x in found if x.held_out]
    assert held and all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held)
    assert sum(x.predicted == rows[x.doc_id][2] for x in held if x.doc_id < 600) >= 0.95 * sum(x.doc_id < 600 for x in held)
    kept = toxicity.keep_ordinary(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - x.predicted for x in found)
    assert {x.score for x in toxicity.score_documents(spark, docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(spark, docs.limit(0), labels).count() == 0
