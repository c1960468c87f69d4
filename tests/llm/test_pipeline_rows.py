"""The pipeline's rows against its five stages in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers

import corpus_pipeline
from slotwise.llm import bpe, mixing
from slotwise.llm.queries import RANK_FILE

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def documents():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(400)]
    docs = []
    for i in range(240):
        body = [r.choice(words) for _ in range(r.randrange(30, 60))]
        if i % 4 == 0:
            for j in range(6):
                body[4 * j] = "zorkx" + r.choice(["a", "en", "ish"])
        elif i % 10 == 3:
            body[5] = f"{r.choice(words)}@{r.choice(words)}.org"
        elif i % 10 in (7, 9) and i > 20 and (i - 4) % 4:
            body = docs[i - 4][1].split()
            body[-1] = body[-1] if i % 10 == 7 else "other"
        docs.append((i, " ".join(body), "big" if i % 5 else "few"))
    return [*docs, (900, None, "big"), (901, "", "few")]


def stages(docs):
    """(doc_id, text, source) of the rows after toxicity, near duplicates and redaction, by their definitions."""
    docs = [d for d in docs if "zorkx" not in (d[1] or "")]
    sets = [{tuple(w[q : q + 5]) for q in range(len(w) - 4)} for w in ((t or "").split() for _, t, _ in docs)]
    group = list(range(len(docs)))
    for k in range(len(docs)):
        for j in range(k):
            if sets[k] and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]):
                old, new = max(group[k], group[j]), min(group[k], group[j])
                group = [new if g == old else g for g in group]
    return [(i, re.sub(EMAIL, "<email>", t or ""), s) for k, (i, t, s) in enumerate(docs) if group[k] == k]


def weights(totals):
    """The shares to the power at which their entropy is a quarter of the way to that of equal weights."""
    entropy = lambda p: -sum(x * math.log(x) for x in p.values())
    power = lambda a: {s: n**a / sum(m**a for m in totals.values()) for s, n in totals.items()}
    target, low, high = entropy(power(1)) + mixing.TOWARDS_EQUAL * (math.log(len(totals)) - entropy(power(1))), 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(power(mid)) > target else (low, mid)
    return power(low)


def test_pipeline_equals_its_stages(spark, tmp_path):
    docs = documents()
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("zorkx" in t)) for i, t, _ in docs if t], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {i: (t, s) for i, t, s in stages(docs)}
    assert len(want) < 0.75 * len(docs) - 10 and sum("<email>" in t for t, _ in want.values()) > 10
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    spelled = {k: v for v, k in bpe.read_ranks(public_tokenizers.path(RANK_FILE)).items()}
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) == set(want)
    for r in rows:
        text = want[r.doc_id][0].encode()
        assert b"".join(spelled[x] for x in r.ids) == text and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text).hexdigest()
    length = {i: len(t.split()) for i, (t, _) in want.items()}
    totals, taken = Counter(), Counter()
    for i, (_, s) in want.items():
        totals[s] += length[i]
        taken[s] += length[i] * copies[i]
    share = weights(totals)
    budget = max(totals[s] / share[s] for s in totals)
    assert len(rows) > len(want) and all(-60 <= taken[s] - share[s] * budget <= 1 for s in totals)
