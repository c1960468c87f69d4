"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the strict matches of four kinds (the base: always kept) and looser shapes that overlap none of them:
numbers written like telephone numbers, card numbers with other separators or lengths, network addresses with their
dots in brackets, and mail addresses with "at" and "dot" spelled out; letters or digits next to them rule them out. Four
labelers vote on each candidate (1 for personal data, 2 against, 0 no opinion): the shape's own checks, a gazetteer
(top-level domains, card issuers, reserved address blocks, area codes), and cue words before and after it.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind; its
posteriors train a logistic span classifier over the votes and over what the labelers do not see, the span's length,
its separators and its neighbours on both sides. Loose candidates that it accepts are added, but for card numbers whose
digits fail Luhn: no vote outweighs a checksum.

The patterns of votes and forms are at most kinds x 3^4 x 4 x 3^3 (35,000; some hundred occur), whatever the corpus, so
only their counts reach the driver. Null and empty texts have no spans; repeated rows give repeated rows. Positions are code points, ends
exclusive. Patterns use possessive repeats, so very long texts neither recurse nor backtrack. Only doc_id and text
are read by `find`; `redact` keeps all columns of documents.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no repeat needs to backtrack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![A-Za-z0-9._-])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}+){3}+(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9._/-])(?:[0-9]{4}(?:[\x20._/-]{1,2}+[0-9]{4}){3}|[0-9](?:[\x20-]?[0-9]){12,18}+)(?![A-Za-z0-9]|\.[0-9])",
    "phone": r"(?<![A-Za-z0-9+().-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9])",
}
# Cue words and gazetteers.
CUES_FOR = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|telephone|call|mobile|fax|cell|card|visa|mastercard|amex|credit|debit|ip|host|server|address|from|write to)\b\W{0,3}(?:\w+\W{1,3}){0,2}$"
CUES_AGAINST = r"(?i)\b(?:version|ver|v|isbn|issn|order|invoice|serial|section|chapter|figure|table|part|model|sku|build|release|id)\b\W{0,3}(?:\w+\W{1,3}){0,1}$"
AFTER_FOR = r"(?i)^\W{0,3}(?:ext|extension|exp|expires|cvv|cvc|mobile|home|work|office)\b"
AFTER_AGAINST = r"(?i)^(?:[.][0-9]|\x20?(?:px|mm|cm|km|kg|usd|eur|percent)\b|%|\x20?[=*/^])"
DOMAINS = r"(?i)(?:\.|dot[)\]\x20]*)(?:com|org|net|edu|gov|info|io|biz|de|fr|es|uk|it|nl|eu|us|ca|ch|at|example)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
RESERVED = r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."
AREA = r"^\+?1?[^0-9]*\(?[2-9][0-9]{2}"
LABELERS = ("shape", "gazetteer", "before", "after")
#: Spans sort by start, then kind, then stop.
HIT = "array<struct<start:int,kind:int,stop:int,strict:boolean,votes:int,form:int>>"
#: Code points of the blocks that `redact` cuts a text from: a place in a block is found without reading the text before it.
BLOCK = 1024


def _let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _running(values: Column, op, start: int) -> Column:
    """op over each prefix of an array of ints, in blocks of about the square root of its size, since appending copies an array."""
    first = F.lit(start)

    def scan(part: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(F.concat(acc["out"], F.array(op(acc["last"], x))).alias("out"), op(acc["last"], x).alias("last"))

        return F.aggregate(part, F.struct(F.array().cast("array<int>").alias("out"), begin.alias("last")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / w).cast("int") - 1), lambda b: F.slice(v, b * w + 1, w)))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, first, op))
        before = F.slice(F.concat(F.array(first), scan(totals, first)), 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, scan))

    return F.when(F.size(values) > 0, _let(values, lambda v: _let(whole(v), joined))).otherwise(F.array().cast("array<int>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The base rules that a strict match must meet."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(14, 19), _luhn(_digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


def _possible(kind: str, hit: Column) -> Column:
    """What a loose match must meet to be a candidate."""
    return F.forall(F.split(hit, "[^0-9]+"), lambda p: p.cast("int") <= 255) if kind == "ip" else F.lit(True)


def _form(hit: Column, before: Column, after: Column) -> Column:
    """What labelers do not see: the length (0 to 3), separators (none, of one kind, mixed) and the neighbours on the left and right (white space or an end, punctuation, others)."""
    between = F.regexp_replace(hit, "[A-Za-z0-9]", "")
    length = F.least(F.lit(3), F.floor(F.length(hit) / 8))
    kinds = F.when(between == "", 0).when(between.rlike(r"^(?s)(.)\1*$"), 1).otherwise(2)
    left = F.when(before.rlike(r"^$|[\x20\x09-\x0D]$"), 0).when(before.rlike(r"[:;,=(<\[\"']$"), 1).otherwise(2)
    right = F.when(after.rlike(r"^$|^[\x20\x09-\x0D]"), 0).when(after.rlike(r"^[.,;:)!?>\]\"']"), 1).otherwise(2)
    return (((length * 3 + kinds) * 3 + left) * 3 + right).cast("int")


def form_of(code: int) -> tuple[int, int, int, int]:
    return code // 27, code // 9 % 3, code // 3 % 3, code % 3


def _votes(kind: str, strict: bool, hit: Column, before: Column, after: Column) -> Column:
    """Four votes of 0..2 as the digits of a number to base 3, in the order of LABELERS."""
    digits = _digits(hit)
    if kind == "card":
        shape = F.when(F.length(digits).between(13, 19), F.when(_luhn(digits), 1).otherwise(2)).otherwise(2)
        gazetteer = F.when(digits.rlike(ISSUERS), 1).otherwise(2)
    elif kind == "phone":
        shape = F.when(hit.rlike(r"[().\x20-]"), 1).otherwise(2)
        gazetteer = F.when(hit.rlike(AREA), 1).otherwise(0 if strict else 2)
    elif kind == "email":
        shape = F.lit(1) if strict else F.when(hit.rlike(r"\[|\("), 1).otherwise(2)
        gazetteer = F.when(hit.rlike(DOMAINS), 1).otherwise(2)
    else:
        shape = F.when(hit.rlike(r"^0[0-9]|\.0[0-9]"), 2).otherwise(1)
        gazetteer = F.when(hit.rlike(RESERVED), 2).otherwise(1)
    near = F.when(before.rlike(CUES_FOR), 1).when(before.rlike(CUES_AGAINST), 2).otherwise(0)
    behind = F.when(after.rlike(AFTER_FOR), 1).when(after.rlike(AFTER_AGAINST), 2).otherwise(0)
    return (((shape * 3 + gazetteer) * 3 + near) * 3 + behind).cast("int")


def _matches(df: DataFrame, name: str, kind: str, pattern: str, guard: Column, strict: bool) -> DataFrame:
    """df with array column `name` (HIT) of the pattern's matches; text is cut at the matches, and lengths give positions."""
    found, pieces, starts = f"__{name}_f", f"__{name}_p", f"__{name}_s"
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(none))

    ends = _running(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: F.length(p) + F.length(f)), lambda a, x: a + x, 0)
    df = df.withColumn(starts, F.zip_with(ends, found, lambda e, f: e - F.length(f)))

    def one(start: Column, i: Column) -> Column:
        hit = F.get(found, i)
        before, after = F.right(F.get(pieces, i), F.lit(40)), F.left(F.get(pieces, i + 1), F.lit(16))
        form = _form(hit, before, after)
        good = _valid(kind, hit) if strict else _possible(kind, hit)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(hit)).alias("stop"), F.lit(strict).alias("strict"), _votes(kind, strict, hit, before, after).alias("votes"), form.alias("form"))
        return F.when(good, span)

    spans = F.filter(F.transform(starts, one), lambda x: x.isNotNull())
    return df.withColumn(name, F.when(F.size(starts) > 0, spans).otherwise(F.array()).cast(HIT)).drop(found, pieces, starts)


def candidates(docs: DataFrame) -> DataFrame:
    """docs(row, text) (null texts empty) with arrays `base` and `loose` of candidate spans in order."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    digit = F.col("text").rlike("[0-9]")
    guards = {"email": F.contains("text", F.lit("@")), "ip": digit & F.contains("text", F.lit(".")), "card": F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains("text", F.lit("+")) & digit}
    for kind, pattern in STRICT.items():
        df = _matches(df, f"__{kind}", kind, pattern, guards[kind], True)
    guards |= {"email": F.contains("text", F.lit("dot")), "ip": digit & F.col("text").rlike(r"[\[(](?:\.|dot)[\])]"), "card": F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){12}|[0-9]{4}[\x20._/-]{1,2}[0-9]{4}[\x20._/-]"), "phone": F.col("text").rlike(r"[0-9]{3}[\x20.-][0-9]{4}")}
    for kind, pattern in LOOSE.items():
        df = _matches(df, f"__loose_{kind}", kind, pattern, guards[kind], False)
    join = lambda names: F.sort_array(F.concat(*(F.col(n) for n in names)))
    df = df.withColumn("base", join(f"__{k}" for k in STRICT)).withColumn("loose", join(f"__loose_{k}" for k in LOOSE))
    return df.withColumn("loose", F.when(F.size("loose") > 0, _apart(F.sort_array(F.concat("base", "loose")))).otherwise(F.col("loose"))).select(*docs.columns, "base", "loose")


def _apart(spans: Column) -> Column:
    """Of spans in order the loose ones that overlap no strict one: the strict ones before end by their start, the next begins at their stop or later."""
    last = 2**31 - 1

    def alone(a: Column) -> Column:
        ended = _running(F.transform(a, lambda s: F.when(s["strict"], s["stop"]).otherwise(0)), lambda a, x: F.greatest(a, x), 0)
        begun = F.reverse(_running(F.reverse(F.transform(a, lambda s: F.when(s["strict"], s["start"]).otherwise(last))), lambda a, x: F.least(a, x), last))
        rows = F.arrays_zip(a.alias("s"), ended.alias("e"), begun.alias("b"))
        good = F.filter(rows, lambda r: ~r["s"]["strict"] & (r["e"] <= r["s"]["start"]) & (r["b"] >= r["s"]["stop"]))
        return F.transform(good, lambda r: r["s"])

    return _let(spans, alone)


def votes_of(code: int) -> tuple[int, ...]:
    return code // 27 % 3, code // 9 % 3, code // 3 % 3, code % 3


def expectation_maximisation(counts: dict[tuple[int, tuple[int, ...]], float], rounds: int = 100) -> tuple[dict, dict]:
    """Posterior of each (kind, votes), and each labeler's P(vote | class) by kind; counts: candidates by (kind, votes)."""
    post = {k: min(0.95, max(0.05, 0.5 + 0.2 * (k[1].count(1) - k[1].count(2)))) for k in counts}
    rates: dict = {}
    for _ in range(rounds):
        rates = {}
        for kind in {k for k, _ in counts}:
            mine = [(v, n, post[kind, v]) for (k, v), n in counts.items() if k == kind]
            total = sum(n for _, n, _ in mine)
            prior = (sum(n * p for _, n, p in mine) + 1) / (total + 2)
            tables = []
            for j in range(len(LABELERS)):
                table = []
                for c in (0, 1):
                    mass = [0.5 + (2.0 if v == 2 - c else 0.0) for v in range(3)]  # a labeler is taken to be better than chance
                    for v, n, p in mine:
                        mass[v[j]] += n * (p if c else 1 - p)
                    table.append([m / sum(mass) for m in mass])
                tables.append(table)
            rates[kind] = (prior, tables)
        moved = 0.0
        for kind, v in counts:
            prior, tables = rates[kind]
            z = math.log(prior / (1 - prior)) + sum(math.log(t[1][v[j]] / t[0][v[j]]) for j, t in enumerate(tables))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            moved, post[kind, v] = max(moved, abs(p - post[kind, v])), p
        if moved < 1e-9:
            break
    return post, rates


def features(kind: int, votes: tuple[int, ...], form: int) -> list[float]:
    """The classifier's inputs: the kind, each labeler's votes for and against, the length, and the classes of separators and neighbours."""
    length, *classes = form_of(form)
    return [float(kind == k) for k in range(len(KINDS))] + [float(v == x) for v in votes for x in (1, 2)] + [length / 3.0] + [float(c == x) for c in classes for x in (1, 2)]


RIDGE = 0.01


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b, for a symmetric positive definite matrix."""
    rows = [[*r, y] for r, y in zip(a, b, strict=True)]
    n = len(rows)
    for i in range(n):
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            if f:
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][j] * x[j] for j in range(i + 1, n))) / rows[i][i]
    return x


def train_classifier(rows: list[tuple[int, tuple[int, ...], int, float]], post: dict, rounds: int = 50) -> list[float]:
    """Logistic weights fitted to the posteriors by Newton's method, until no weight moves by 1e-9; rows: kind, votes, form and how many."""
    data = [(features(k, v, f), post[k, v], n) for k, v, f, n in rows]
    n_features = len(features(0, (0,) * len(LABELERS), 0))
    weights, total = [0.0] * n_features, sum(n for *_, n in data) or 1.0

    def loss(w: list[float]) -> float:
        z = [(sum(a * b for a, b in zip(x, w, strict=True)), p, n) for x, p, n in data]
        return sum((max(s, 0.0) + math.log1p(math.exp(-abs(s))) - p * s) * n for s, p, n in z) / total + RIDGE / 2 * sum(a * a for a in w)

    now = loss(weights)
    for _ in range(rounds):
        grad, curve = [RIDGE * w for w in weights], [[RIDGE * float(i == j) for j in range(n_features)] for i in range(n_features)]
        for x, p, n in data:
            s = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, weights, strict=True))))))
            on = [(i, a) for i, a in enumerate(x) if a]
            for i, a in on:
                grad[i] += (s - p) * a * n / total
                for j, b in on:
                    curve[i][j] += s * (1 - s) * a * b * n / total
        step = _solved(curve, grad)
        for _ in range(30):  # a whole step if it helps, else half of it
            tried = [w - d for w, d in zip(weights, step, strict=True)]
            if (after := loss(tried)) <= now:
                break
            step = [d / 2 for d in step]
        else:
            break
        weights, now = tried, after
        if max(map(abs, step)) < 1e-9:
            break
    return weights


def fit(found: DataFrame) -> list[float]:
    """The span classifier's weights, from all candidates of the corpus."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.kind", "s.votes", "s.form").agg(F.count("*").alias("n"))
    rows = [(r.kind, votes_of(r.votes), r.form, float(r.n)) for r in sorted(spans.collect(), key=lambda r: (r.kind, r.votes, r.form))]
    counts: dict = defaultdict(float)
    for kind, votes, _, n in rows:
        counts[kind, votes] += n
    return train_classifier(rows, expectation_maximisation(dict(counts))[0])


def accepted(span: Column, weights: list[float]) -> Column:
    """Whether the classifier takes a span for personal data; a card number whose digits fail Luhn it cannot take."""
    z, at = F.lit(0.0), iter(weights)
    for k in range(len(KINDS)):
        z = z + F.when(span["kind"] == k, next(at)).otherwise(0.0)
    vote = lambda j: F.floor(span["votes"] / 3 ** (len(LABELERS) - 1 - j)) % 3
    for j in range(len(LABELERS)):
        z = z + F.when(vote(j) == 1, next(at)).when(vote(j) == 2, next(at)).otherwise(0.0)
    z = z + F.floor(span["form"] / 27) / 3.0 * next(at)
    for unit in (9, 3, 1):
        of = F.floor(span["form"] / unit) % 3
        z = z + F.when(of == 1, next(at)).when(of == 2, next(at)).otherwise(0.0)
    return (z >= 0.0) & ~((span["kind"] == KINDS.index("card")) & (vote(LABELERS.index("shape")) == 2))


def _all_spans(weights: list[float]) -> Column:
    """Base and accepted loose spans by start, then kind."""
    taken = F.when(F.size("loose") > 0, F.filter("loose", lambda s: accepted(s, weights))).otherwise(F.col("loose"))
    return F.sort_array(F.concat("base", taken))


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts, base digest and all spans of each document's whole text."""
    found = stored(candidates(docs.select(F.col("doc_id").cast("bigint").alias("row"), "text")).drop("text"), "pii")
    weights = fit(found)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("row").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(_all_spans(weights)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by the first one's kind in angle brackets; spans are in order."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def between(blocks: Column, start: Column, stop: Column) -> Column:
        a, b = F.floor(start / BLOCK).cast("int"), F.floor(stop / BLOCK).cast("int")
        inside = F.substring(F.get(blocks, a), start % BLOCK + 1, stop - start)
        across = F.concat(F.substring(F.get(blocks, a), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, a + 2, b - a - 1), ""), F.coalesce(F.substring(F.get(blocks, b), F.lit(1), stop % BLOCK), F.lit("")))
        return F.when(stop <= start, "").when(a == b, inside).otherwise(across)

    def cut(blocks: Column, s: Column, ended: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), ended)
        heads = F.filter(F.zip_with(s, F.slice(before, 1, F.size(s)), lambda x, e: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), e.alias("ended"))), lambda h: h["start"] >= h["ended"])
        parts = F.transform(heads, lambda h: F.concat(between(blocks, h["ended"], h["start"]), F.get(names, h["kind"])))
        return F.concat(F.array_join(parts, ""), between(blocks, F.element_at(ended, -1), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ended = _running(F.transform(spans, lambda s: s["stop"]), lambda a, x: F.greatest(a, x), 0)
    return F.when(F.size(spans) > 0, _let(pieces, lambda p: _let(ended, lambda e: cut(p, spans, e)))).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span's text replaced by its kind in angle brackets (overlapping spans: the first's kind), n_chars renewed; null texts become empty.

    The other columns are kept as they are, whatever their names.
    """
    others = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"))
    found = stored(candidates(docs.select(others.alias("row"), "text")), "pii-redact")
    done = found.withColumn("spans", _all_spans(fit(found))).select("row", masked(F.col("text"), F.col("spans")).alias("text"))
    renewed = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return done.select(*(renewed.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)))
