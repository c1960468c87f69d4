"""The queries of this subpackage, by name; `__spark_entry__` registers them where the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, importance, jaccard, lexical, mixing, pii, sharding, substrings, topk, toxicity, warc
from .common import scratch, stored, table

#: The rank file of the encoder, read on the driver and broadcast.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles are alike by 0.85 or more."""
    return jaccard.group_documents(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str, rank_path: str | None = None) -> DataFrame:
    """Byte-level BPE round trip of every document."""
    import public_tokenizers

    ranks = bpe.read_ranks(rank_path or public_tokenizers.path(RANK_FILE))
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a temperature mixture of the sources has every document."""
    return mixing.plan(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of every document and of its edited text."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


#: Shards of the placement query.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by its id."""
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that smaller ids have."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's n-grams."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation whose texts are control strings, formatted beside the given ones.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, written, and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL_TEXT)).toDF(*given.columns)
    written = stored(chat.format_conversations(given.unionByName(added)), "chat")
    return chat.digests(chat.read_back(written))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_substrings": op2_substrings,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_jaccard": op8_jaccard,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_importance": op11_importance,
    "op12_chat": op12_chat,
    "op13_lexical": op13_lexical,
}
ORACLE_SQL: dict[str, str] = {
    "op11_importance": r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
every as (select r, ws from d union all select -1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
runs as (select r, ws, unnest(range(1, len(ws) + 1)) as i from every),
grams as (select r, ws[i] as g from runs union all select r, ws[i] || ' ' || ws[i + 1] from runs where i < len(ws) union all select r, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] from runs where i + 1 < len(ws)),
held as materialized (select r, g, count(*) as n from grams group by all),
hex as (select g, hex(encode(g)) as h from (select distinct g from held)),
hashed as materialized (select g, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda j: cast('0x' || h[j:j + 1] as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from hex, crc),
counts as materialized (select bucket, coalesce(sum(n) filter (r >= 0), 0) as s, coalesce(sum(n) filter (r < 0), 0) as t from held join hashed using (g) group by bucket),
gains as (select bucket, cast(floor(1000 * ln((cast(t + 1 as double) * cast((select sum(s) from counts) + 10000 as double)) / (cast(s + 1 as double) * cast((select sum(t) from counts) + 10000 as double)))) as bigint) as gain from counts),
w as (select r, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight from held join hashed using (g) join gains using (bucket) where r >= 0 group by r),
scored as (select d.r, d.doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score from d left join w using (r)),
able as (select r, row_number() over (order by score desc, doc_id nulls last) as k, count(*) over () as total from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when k <= 5 * total // 100 then k end as rank from scored left join able using (r)
""",
    "op12_chat": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i)
), p as (
  select *, lag(role) over (partition by conv_id order by turn, text) as prior,
    length(text) + len(regexp_extract_all(text, '\\|<\|turn\|>|<\|text\|>|<\|next\|>|<\|end\|>|</?s>|\[/?INST\]')) as chars
  from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars + case when prior is null or prior <> role then length(role) + 23 else 8 end) as bigint) as formatted_chars
from p group by conv_id
""",
    "op13_lexical": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws, row_number() over () as r from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from benchmark),
s as (select count(*) as n_docs, cast(sum(len(ws)) as bigint) as n_words from d where len(ws) > 0),
asked as (select item_id, term, count(*) as times from (select item_id, unnest(ws) as term from i) group by all),
held as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) where term in (select term from asked) group by all),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from held group by term), s),
e as (select h.r, h.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.ws) * n_docs) // n_words))) as e from held h join w using (term) join d on d.r = h.r, s),
x as (select a.item_id, e.r, cast(sum(a.times * e.e) as bigint) as score from asked a join e using (term) group by all),
o as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from x join d using (r) where score > 0)
select * from o where rank <= 10
""",
    "op2_substrings": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) as i from w)),
gone as (select doc_id, i from win join (select h, min(doc_id) as least from win group by h) using (h) where least < doc_id),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
marked as (select s.doc_id, s.pos, s.word, max(case when g.i is null then 0 else 1 end) over (partition by s.doc_id order by s.pos rows between 49 preceding and current row) as cut
  from words s left join gone g on g.doc_id = s.doc_id and g.i = s.pos)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, cast(coalesce(m.n, 0) as bigint) as n_removed, sha256(coalesce(m.kept, '')) as kept_sha256
from w left join (select doc_id, sum(cut) as n, string_agg(word, ' ' order by pos) filter (cut = 0) as kept from marked group by doc_id) m using (doc_id)
""",
    "op8_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, md5(array_to_string(ws[i:i + 3], ' ')) as h from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.h = b.h and a.doc_id > b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from n union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(r.component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join (select a as doc_id, min(b) as component_id from reach group by 1) r using (doc_id)
""",
    "op3_warc": """
with p as (
  select page_id, url, coalesce(html, '') as h, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes,
    max(page_id) over (partition by coalesce(html, '')) as top from pages
)
select page_id, payload_bytes, sha1(h) as payload_digest,
  case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < top then top end as refers_to, url
from p
""",
    "op5_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
""",
}
