"""Operators do the whole job: what they gather follows all of their input."""

import math
import random
import zlib
from collections import Counter

from slotwise.llm import jaccard, toxicity


def kneser_ney(words):
    """Evidence of a word by the definition, from (class, word) pairs."""
    top, ends = [Counter(), Counter()], [set() for _ in range(7)]
    for c, w in words:
        chars = "\x02" * 5 + w + "\x03"
        for i in range(5, len(chars)):
            top[c][chars[i - 5 : i + 1]] += 1
            for n in range(1, 7):
                ends[n].add(chars[i + 1 - n : i + 1])
    more = [Counter(g[1:] for g in ends[n + 1]) for n in range(6)]
    total = [Counter() for _ in range(6)]
    kinds = [Counter(g[:-1] for g in ends[n]) for n in range(6)]
    for n in range(1, 6):
        for g, k in more[n].items():
            total[n][g[:-1]] += k

    def evidence(w):
        chars, out = "\x02" * 5 + w + "\x03", 0.0
        for i in range(5, len(chars)):
            p = 1 / max(2, len(ends[1]) + 1)
            for n in range(1, 6):
                g = chars[i + 1 - n : i + 1]
                if total[n][g[:-1]]:
                    p = max(more[n][g] - 0.75, 0) / total[n][g[:-1]] + 0.75 * kinds[n][g[:-1]] / total[n][g[:-1]] * p
            g, both = chars[i - 5 : i + 1], []
            for c in (0, 1):
                after = [k for h, k in top[c].items() if h[:-1] == g[:-1]]
                both.append(max(top[c][g] - 0.75, 0) / sum(after) + 0.75 * len(after) / sum(after) * p if after else p)
            out += math.log(both[1]) - math.log(both[0])
        return out

    return set(top[0]) | set(top[1]), evidence


def test_language_models_count_all_training_rows(spark):
    r = random.Random(3)
    rows = [(i, int(i % 3 == 0), ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 9))) for _ in range(6)]) for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(ws).upper() + " .") for i, _, ws in rows] + [(None, "zzz"), (999, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows], "doc_id bigint, toxic int")
    trained = [(y, w) for i, y, ws in rows if zlib.crc32(str(i).encode()) % 4 != 2 for w in ws]
    grams, evidence = kneser_ney(trained)
    model, beta, _ = toxicity.fit(spark, docs, labels, per_class=4)
    assert len(model.grams) == len(grams) and len(beta) == len(toxicity.NAMES) + 1
    asked = sorted({w for _, _, ws in rows for w in ws} | {"zzz", "a", "abcabcabcabc"})
    assert max(abs(got - evidence(w)) for w, got in zip(asked, model.evidence(asked), strict=True)) < 1e-9


def test_links_between_rows_of_one_id(spark):
    docs = []
    for g, end in enumerate([None, *range(600, 611)]):  # the smallest and the largest of four near copies share an id
        words = [f"g{g}w{j}" for j in range(107)]
        docs += [(i, " ".join(words[: n + 3])) for i, n in ((end, 100), (100 + g, 101), (200 + g, 102), (end, 104))]
    found = jaccard.group_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    group = {i: 100 + k // 4 for k, (i, _) in enumerate(docs)}
    assert len(found) == len(docs) and {r.doc_id: r.component_id for r in found} == group


def test_copies_under_null_ids_go(spark):
    words = [f"v{j}" for j in range(60)]
    near, other, mine = " ".join([*words, "end"]), "one two three four five six", "quite another text without any id here"
    docs = [(1, " ".join(words)), (2, other), (None, near), (None, other), (None, mine), (None, mine), (None, mine.upper()), (None, None), (None, ""), (None, " ")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = jaccard.keep_one(df, jaccard.Rule(5, 80, 100))
    rows = [tuple(r) for r in kept.collect()]
    assert kept.columns == df.columns and sorted(i for i, _ in rows if i is not None) == [1, 2]
    texts = [t for i, t in rows if i is None]
    assert sum((t or "").lower() == mine for t in texts) == 1 and sorted(map(repr, (t for t in texts if not (t or "").strip()))) == ["' '", "''", "None"]
    assert len(rows) == 6
