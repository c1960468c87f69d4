"""For each query the SQL that must give the same rows; fragments are named relations that a statement pulls in as it uses them."""

from __future__ import annotations

import re

from ..operators.chains import PATHS, TEMPLATES
from ..operators.select import DEFAULTS, MODES

TOKEN = r"([A-Za-z0-9_]+|[?.,:;/()])"


def _tokens(col: str) -> str:
    return f"regexp_extract_all({col}, '{TOKEN}', 1)"


def _mix(*parts: str | int) -> str:
    out = "0"
    for p in parts:
        out = f"((({out}) * 31 + cast({p} as bigint)) % 2147483648 * 1103515245 + 12345) % 2147483648"
    return out


def _key(kind: str, col: str) -> str:
    return f"'{kind}_' || regexp_replace(cast({col} as varchar), '[^A-Za-z0-9]', '_', 'g')"


def _vocab(source: str) -> str:
    return f"""select token, cast(row_number() over (order by token) + 6 as integer) as id
      from (select distinct unnest({_tokens('text')}) as token from {source})
      union all select * from (values ('<pad>', 0), ('<bos>', 1), ('<eos>', 2), ('<ans>', 3), ('<q>', 4), ('<fact>', 5), ('<unk>', 6))"""


def _cosines(dims: str) -> str:
    return f"""select query_id, slot_id, hops, round(list_inner_product(q.v{dims}, s.v{dims}) / (sqrt(list_inner_product(q.v{dims}, q.v{dims})) * sqrt(list_inner_product(s.v{dims}, s.v{dims}))), 9) as score
      from qv q, sv s where query_id <> slot_id"""


def _rank(source: str, by: str = "score") -> str:
    return f"select query_id, slot_id, {by} as score, cast(row_number() over (partition by query_id order by {by} desc, slot_id) as integer) as rank from {source}"


_KS = "(values (1), (3), (8), (16), (32), (64)) as ks(k)"
_ADDRESS = "slot_id % 1024"

FRAGMENTS = {
    # vectors
    "vec": "select vec_id, cast(embedding as double[]) as v, label from embeddings",
    "qv": "select vec_id as query_id, v, cast((vec_id // 10) % 3 + 1 as integer) as hops from vec where vec_id % 10 = 0",
    "sv": "select vec_id as slot_id, v, label from vec",
    "cosines": _cosines(""),
    "ranked": _rank("cosines"),
    "dots": "select query_id, slot_id, round(list_inner_product(q.v, s.v), 9) as score from qv q, sv s where query_id <> slot_id",
    "ranked_dot": _rank("dots"),
    "halves": _cosines("[1:32]"),
    "teacher": "select query_id, slot_id, hops, score, cast(row_number() over (partition by query_id order by score desc, slot_id) as integer) as pos from halves",
    "required": "select query_id, pos, slot_id, hops from teacher where pos <= hops",
    "cand": """select r.query_id, r.rank, r.slot_id, r.score, q.hops, r.slot_id % 7 <> 3 as live, n.slot_id is not null as is_required
      from ranked r join qv q using (query_id) left join required n on n.query_id = r.query_id and n.slot_id = r.slot_id where r.rank <= 16""",
    "dims": "select cast(unnest(range(1, 65)) as integer) as dim",
    "slot_value": "select s.slot_id, d.dim, x.v[d.dim] as x from sv s join vec x on x.vec_id = s.label, dims d where s.slot_id % 7 <> 3",
    # product keys
    "codes": "select vec_id as k, v[1:32] as k1, v[33:64] as k2 from vec where vec_id < 32",
    "sub": """select query_id, 1 as side, k, round(list_inner_product(v[1:32], k1), 9) as score from qv, codes
      union all select query_id, 2, k, round(list_inner_product(v[33:64], k2), 9) from qv, codes""",
    "subrank": "select *, row_number() over (partition by query_id, side order by score desc, k) as nth from sub",
    "pkc": """select a.query_id, a.k * 32 + b.k as slot_id, round(a.score + b.score, 9) as score
      from subrank a join subrank b using (query_id) where a.side = 1 and b.side = 2 and a.nth <= 8 and b.nth <= 8""",
    "pk": _rank("pkc"),
    "address": f"select distinct query_id, {_ADDRESS} as slot_id from required",
    "address1": f"select query_id, {_ADDRESS} as slot_id from required where pos = 1",
    "addressed": """select a.query_id, a.slot_id, round(x.score + y.score, 9) as score from address a
      join sub x on x.query_id = a.query_id and x.side = 1 and x.k = a.slot_id // 32 join sub y on y.query_id = a.query_id and y.side = 2 and y.k = a.slot_id % 32""",
    # facts
    "named": f"select n_nationkey as nk, {_key('nation', 'n_name')} as object, n_regionkey from nation",
    "facts": f"""select {_key('nation', 'n_name')} as subject, 'in' as relation, {_key('region', 'r_name')} as object from nation join region on n_regionkey = r_regionkey
      union all select {_key('customer', 'c_custkey')}, 'from', object from customer join named on c_nationkey = nk
      union all select {_key('supplier', 's_suppkey')}, 'from', object from supplier join named on s_nationkey = nk
      union all select {_key('order', 'o_orderkey')}, 'by', {_key('customer', 'o_custkey')} from orders
      union all select 'line_' || l_orderkey || '_' || l_linenumber, 'of', {_key('supplier', 'l_suppkey')} from lineitem
      union all select {_key('part', 'p_partkey')}, 'made_as', {_key('brand', 'p_brand')} from part""",
    "kb": """select cast(row_number() over (order by text) - 1 as integer) as slot_id, text, embedding_target, subject
      from (select subject || ' ' || relation || ' ' || object || ' .' as text, min(object) as embedding_target, min(subject) as subject from facts group by all)""",
    "kb_vocab": _vocab("kb"),
    "part_chain": f"""select 'line_' || l_orderkey || '_' || l_linenumber as subject, 'line_' || l_orderkey || '_' || l_linenumber || '>' || {_key('part', 'p_partkey')} || '>' || {_key('brand', 'p_brand')} as path, {_key('brand', 'p_brand')} as answer
      from lineitem join part on l_partkey = p_partkey""",
    "two_hop": """select a.subject, a.object as mid, b.object as answer from facts a join facts b on b.subject = a.object
      where a.subject like 'customer%' and a.object like 'nation%' and b.object like 'region%'""",
    "asked": "select subject, mid, t.template, replace(replace(t.words, '{answer}', regexp_extract(answer, '^([a-z]+)_', 1)), '{subject}', mid) as question, answer from two_hop, (values "
    + ", ".join(f"({i}, '{w}')" for i, w in enumerate(TEMPLATES))
    + ") as t(template, words)",
    "parted": f"select distinct case when p < 8 then 'train' when p = 8 then 'val' else 'test' end as split, question from (select question, ({_mix('split_part(subject, chr(95), 2)')}) % 10 as p from asked)",
    # text
    "doc_vocab": _vocab("documents"),
    "doc_tokens": f"select doc_id, generate_subscripts({_tokens('text')}, 1) as pos, unnest({_tokens('text')}) as token from documents",
    "conv_vocab": _vocab("conversations"),
    "turns": """select conv_id, turn, text, next_text from (select *, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn))
      where role = 'user' and next_role = 'assistant'""",
    "turn_ids": f"""select conv_id, turn, part, list(id order by pos) as ids from (
        select t.conv_id, t.turn, t.part, t.pos, v.id from (
          select conv_id, turn, 1 as part, generate_subscripts({_tokens('text')}, 1) as pos, unnest({_tokens('text')}) as token from turns
          union all select conv_id, turn, 2, generate_subscripts({_tokens('next_text')}, 1), unnest({_tokens('next_text')}) from turns) t join conv_vocab v using (token)) group by all""",
    "prompts": """select t.conv_id, t.turn, list_concat([1], coalesce(q.ids, []), [3], coalesce(a.ids, []), [2]) as ids, 2 + coalesce(len(q.ids), 0) as prompt_len
      from turns t left join turn_ids q on q.conv_id = t.conv_id and q.turn = t.turn and q.part = 1 left join turn_ids a on a.conv_id = t.conv_id and a.turn = t.turn and a.part = 2""",
    # metrics
    "counts": f"""select q.query_id, q.hops, k, count(n.slot_id) as n_required, count(n.slot_id) filter (r.rank <= k) as n_found
      from qv q cross join {_KS} left join required n on n.query_id = q.query_id left join ranked r on r.query_id = n.query_id and r.slot_id = n.slot_id group by all""",
    "failed": """select query_id, case when max(n_required) = 0 then 'no_required_slots' when bool_or(k = 8 and n_found = n_required) then 'none_all_present'
        when bool_or(k = 32 and n_found = n_required) then 'ranked_too_low' when bool_or(k = 64 and n_found = n_required) then 'ranked_beyond_64'
        when bool_or(k = 64 and n_found > 0) then 'missing_required_slot' else 'no_required_in_top64' end as failure_type from counts group by query_id""",
    "gold": "select n.query_id, s.label as gold from required n join sv s using (slot_id) where n.pos = 1",
    "predicted": """select 'retrieved' as variant, query_id, label as predicted from ranked join sv using (slot_id) where rank = 1
      union all select 'dense', query_id, label from ranked_dot join sv using (slot_id) where rank = 1
      union all select 'oracle', query_id, gold from gold
      union all select 'core', query_id, cast((""" + _mix("query_id", 3) + """) % 10 as integer) from qv""",
    "judged": """select variant, hops, ['single_fact_recall', 'two_hop_reasoning', 'three_hop_reasoning'][hops] as task_type, case when predicted = gold then 1 else 0 end as ok
      from predicted join qv using (query_id) join gold using (query_id)""",
    "accuracies": """select variant, 'overall' as scope, count(*) as n, round(avg(ok), 6) as accuracy from judged group by variant
      union all select variant, ['single_hop', 'two_hop', 'three_hop'][hops], count(*), round(avg(ok), 6) from judged group by variant, hops
      union all select variant, task_type, count(*), round(avg(ok), 6) from judged group by variant, task_type""",
    # selection
    "feat": """select query_id, slot_id, hops, live, is_required, score, rank - 1 as place, round(max(score) over w - score, 9) as margin,
      round((score - min(score) over w) / greatest(max(score) over w - min(score) over w, 1e-8), 9) as normalised from cand window w as (partition by query_id)""",
    "probs": "select *, round(1 / (1 + exp(-(-1.0 + 6.0 * score - 0.15 * place - 4.0 * margin + 1.5 * normalised))), 9) as prob from feat",
    "taken": "select query_id, slot_id, is_required, prob, prob >= 0.5 or (not bool_or(prob >= 0.5) over (partition by query_id) and place = 0) as taken from probs",
    "scored": "select r.query_id, r.slot_id, r.score, n.slot_id is not null as positive from ranked r left join required n on n.query_id = r.query_id and n.slot_id = r.slot_id where r.rank <= 64",
}


def sql(statement: str, more: dict[str, str] | None = None, once: bool = False) -> str:
    """The statement with all fragments that it uses, in order of need; once: each is computed once, whatever the optimizer would do."""
    known, used = FRAGMENTS | (more or {}), {}

    def need(text: str) -> None:
        for name in known:
            if name not in used and re.search(rf"(?:from|join|,)\s+{name}\b", text):
                used[name] = ""
                need(known[name])
                del used[name]
                used[name] = known[name]

    need(statement)
    return ("with " + ",\n".join(f"{n} as {'materialized ' * once}({q})" for n, q in used.items()) + "\n" if used else "") + statement


def _shown(source: str, k: int) -> str:
    return sql(f"select query_id, rank, slot_id, round(score, 6) as score from {source} where rank <= {k}")


def _chain(task: str) -> str:
    names = PATHS[task]
    path, joins, where = "f1.subject || '>' || f1.object", "", f"f1.subject like '{names[0]}%' and f1.object like '{names[1]}%'"
    for i, name in enumerate(names[2:], 2):
        joins += f" join facts f{i} on f{i}.subject = f{i - 1}.object"
        path += f" || '>' || f{i}.object"
        where += f" and f{i}.object like '{name}%'"
    n = len(names) - 1
    return sql(f"select {n} as hops, f1.subject as subject, {path} as path, f{n}.object as answer from facts f1{joins} where {where}")


def _selection(mode: str) -> str:
    p = DEFAULTS
    soft = f"exp((score - max(score) over w) / {p['temperature']})"
    masks = {
        "uniform_mean": "1",
        "top1": "rank = 1",
        "top3": "rank <= 3",
        "fixed_top_n": f"rank <= {p['n']}",
        "fixed_top_by_hop": "rank <= greatest(1, hops)",
        "score_threshold_absolute": f"score >= {p['threshold']}",
        "score_threshold_relative": f"round(max(score) over w - score, 9) <= {p['delta']}",
        "softmax_mass": f"rank <= coalesce(min(case when mass >= {p['mass']} then rank end) over w, 1)",
        "score_gap": f"rank <= coalesce(min(case when gap > {p['gap']} then rank end) over w, 1)",
        "oracle_filter": "is_required or not bool_or(is_required) over w",
    }
    if mode in masks:
        more = {
            "soft": f"select *, {soft} as e, round(score - lead(score) over (partition by query_id order by rank), 9) as gap from cand window w as (partition by query_id)",
            "mass": "select *, round(sum(e / t) over (partition by query_id order by rank), 9) as mass from (select *, sum(e) over (partition by query_id) as t from soft)",
            "masked": f"select query_id, slot_id, case when live and ({masks[mode]}) then 1.0 else 0.0 end as m from mass window w as (partition by query_id)",
        }
    else:
        few = "where rank <= 3" if mode == "score_weighted_top3" else ""
        more = {
            "soft": f"select *, {soft} as e from (select * from cand {few}) window w as (partition by query_id)",
            "masked": "select query_id, slot_id, case when live then e / sum(e) over (partition by query_id) else 0.0 end as m from soft",
        }
    more["weighed"] = "select query_id, slot_id, m / greatest(sum(m) over (partition by query_id), 1.0) as w from masked"
    return sql("select q.query_id, d.dim, round(coalesce(sum(w.w * x.x), 0.0), 6) + 0.0 as value from (select distinct query_id from cand) q, dims d left join weighed w on w.query_id = q.query_id left join slot_value x on x.slot_id = w.slot_id and x.dim = d.dim group by all".replace("from (select distinct query_id from cand) q, dims d", "from (select * from (select distinct query_id from cand), dims) q").replace("d.dim", "q.dim"), more)


def _drawn(n: int, seed: int) -> str:
    return f"""select query_id, slot_id, row_number() over (partition by query_id order by try) as nth from (
        select q.query_id, p.slot_id, t.try from qv q cross join (select unnest(range(0, {n} + (select max(c) from (select count(*) as c from required group by query_id)))) as try) t
        join (select slot_id, row_number() over (order by {_mix('slot_id', seed)}, slot_id) - 1 as place, count(*) over () as total from sv where slot_id % 7 <> 3) p
          on p.place = (({_mix('q.query_id', seed + 1)}) % p.total + t.try) % p.total
        where t.try < p.total and not exists (select 1 from required n where n.query_id = q.query_id and n.slot_id = p.slot_id))"""


def _noisy(n: int, seed: int, own: float, other: float, k: int) -> str:
    return f"""select query_id, cast(row_number() over (partition by query_id order by part, place) as integer) as pos, slot_id, score, is_required from (
        select query_id, 0 as part, pos as place, slot_id, cast({own} as double) as score, true as is_required from required
        union all select query_id, 1, nth, slot_id, cast({other} as double), false from ({_drawn(n, seed)}) where nth <= {n}) qualify row_number() over (partition by query_id order by part, place) <= {k}"""


_FORMS = {"f0": "x", "f1": "case when i <= 32 then x else 0.0 end", "f2": "case when i > 32 then x else 0.0 end", "f3": "case when i % 2 = 1 then x else 0.0 end"}
_SOFTPLUS = "greatest({0}, 0.0) + ln(1 + exp(-abs({0})))"

def _info_nce(where: str) -> str:
    return sql(f"""select count(*) as rows, cast(sum(n) as bigint) as positives, round(avg(ln(total) - ln(pos)), 6) as loss from (
        select c.query_id, sum(exp(c.score / 0.07)) as total, sum(case when n.slot_id is not null then exp(c.score / 0.07) else 0.0 end) as pos, count(n.slot_id) as n
        from cosines c left join required n on n.query_id = c.query_id and n.slot_id = c.slot_id where {where} group by 1) where n > 0""")


ORACLE_SQL: dict[str, str] = {
    "tokenize_counts": f"select doc_id, cast(len({_tokens('text')}) as bigint) as n_tokens from documents",
    "vocab_build": sql("select * from both_vocab", {"both_vocab": _vocab("(select text from documents union all select text from conversations)")}),
    "encode_docs": sql("""select d.doc_id, count(v.id) as n_ids, md5(coalesce(string_agg(cast(v.id as varchar), ',' order by t.pos), '')) as ids_md5
      from documents d left join doc_tokens t using (doc_id) left join doc_vocab v on v.token = t.token group by d.doc_id"""),
    "decode_roundtrip": sql("select d.doc_id, md5(coalesce(string_agg(t.token, ' ' order by t.pos), '')) as text_md5 from documents d left join doc_tokens t using (doc_id) group by d.doc_id"),
    "unk_rate": f"""with t as (select lang, unnest({_tokens('text')}) as token from documents), known as (select distinct token from t where lang = 'en')
      select lang, count(*) as n_tokens, count(*) filter (k.token is null) as n_unk, round(avg(case when k.token is null then 1 else 0 end), 6) as unk_rate from t left join known k using (token) group by lang""",
    "prompt_assembly": sql("select conv_id, turn, cast(len(ids) as integer) as seq_len, cast(prompt_len as integer) as prompt_len, array_to_string(ids, ',') as ids from prompts"),
    "label_mask": sql("select conv_id, turn, array_to_string(list_concat(list_transform(range(0, prompt_len), lambda x: -100), ids[prompt_len + 1:]), ',') as labels, cast(prompt_len as integer) as n_masked from prompts"),
    "batch_pad": sql("""select conv_id, turn, cast(example_id as integer) as example_id, cast(batch_id as integer) as batch_id, cast(width as integer) as width,
        array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda x: 0)), ',') as padded, cast(width - len(ids) as integer) as n_pad
      from (select *, max(len(ids)) over (partition by batch_id) as width from (select *, example_id // 8 as batch_id from (select *, row_number() over (order by conv_id, turn) - 1 as example_id from prompts)))"""),
    "kb_dedup": sql("select * from kb"),
    "slot_id_codec": sql("select slot_id, 'slot_' || lpad(cast(slot_id as varchar), cast(greatest(6, length(cast(slot_id as varchar))) as integer), '0') as slot_name, slot_id as back from kb"),
    "kb_value_tokens": sql(f"select slot_id, token, coalesce(id, 6) as value_token from (select slot_id, coalesce({_tokens('embedding_target')}[1], '<unk>') as token from kb) left join kb_vocab using (token)", once=True),
    "live_dead_stats": "select count(*) as total, count(*) filter (vec_id % 7 <> 3) as live, count(*) filter (vec_id % 7 = 3) as dead, round(avg(case when vec_id % 7 <> 3 then 1 else 0 end), 6) as live_ratio from embeddings",
    "slot_contiguity": sql("select cast(min(slot_id) as bigint) as lowest, cast(max(slot_id) as bigint) as highest, count(distinct slot_id) as slots, min(slot_id) = 0 and max(slot_id) = count(distinct slot_id) - 1 as contiguous from kb"),
    "missing_slots": "select c_custkey, count(*) as uses from customer where not exists (select 1 from events where user_id = c_custkey) group by c_custkey",
    "examples_per_slot": "select min(n) as least, max(n) as most, round(avg(n), 6) as mean, count(*) as slots from (select l_partkey, count(distinct l_orderkey) as n from lineitem group by l_partkey)",
    "task_hop_histogram": sql("""select 'code_symbol_reasoning' as task_type, 2 as hops, count(*) as n from part_chain union all """ + " union all ".join(f"select '{t}', {len(PATHS[t]) - 1}, count(*) from c_{t}" for t in PATHS), {f"c_{t}": _chain(t).partition("\nselect")[1].strip() + _chain(t).partition("\nselect")[2] for t in PATHS}),
    "answer_leakage": "select distinct item_id, doc_id from benchmark b join documents d on contains(lower(d.text), lower(b.text))",
    "chain_1hop": _chain("single_fact_recall"),
    "chain_2hop": _chain("two_hop_reasoning"),
    "chain_3hop": _chain("three_hop_reasoning"),
    "chain_lines": _chain("api_usage_reasoning"),
    "chain_parts": sql("select * from part_chain"),
    "chain_examples": sql("select 2 as hops, subject, template, question, answer, cast(repeat as integer) as repeat from (select *, row_number() over (partition by question, answer order by subject) as repeat from asked) where repeat <= 5"),
    "split_overlap": sql("""select a.split as split_a, b.split as split_b, count(distinct a.question) as n_a, count(distinct b.question) as n_b, count(distinct case when a.question = b.question then a.question end) as common
      from parted a, parted b where a.split < b.split group by all"""),
    "top_targets": sql("select embedding_target, count(*) as n from kb group by 1 order by n desc, embedding_target limit 5"),
    "addressable_distractors": sql("""select a.subject, b.subject || ',' || c.subject as addressable, b.subject || ',' || c.subject as distractors
      from facts a join facts b on b.subject = a.object join facts c on c.subject = b.object where a.subject like 'order%' and c.object like 'region%'""", once=True),
    "fact_mix": sql("""select 'qa' as kind, replace(replace(t.words, '{answer}', 'nation'), '{subject}', subject) || ' ' || object as text, -1 as slot_id
      from facts, (values """ + ", ".join(f"('{w}')" for w in TEMPLATES) + """) as t(words) where subject like 'supplier%'
      union all select 'fact', text, slot_id from kb where slot_id < (select cast(floor(count(*) * 3 * 0.25 / 0.75) as bigint) from facts where subject like 'supplier%')"""),
    "iterative_chain": sql("""select start, reached, cast(min(hop) as integer) as hop from (
        select a.subject as start, a.object as reached, 1 as hop from facts a where a.subject like 'order%'
        union all select a.subject, b.object, 2 from facts a join facts b on b.subject = a.object where a.subject like 'order%'
        union all select a.subject, c.object, 3 from facts a join facts b on b.subject = a.object join facts c on c.subject = b.object where a.subject like 'order%') group by 1, 2"""),
    "cosine_topk": _shown("ranked", 8),
    "dot_topk": _shown("ranked_dot", 8),
    "score_given": sql("select n.query_id, n.slot_id, round(c.score, 6) as score from required n join cosines c on c.query_id = n.query_id and c.slot_id = n.slot_id"),
    "knn_hit_at_8": sql("select count(*) as queries, count(*) filter (hit) as hits, round(avg(case when hit then 1 else 0 end), 6) as hit_rate from (select r.query_id, bool_or(s.label = q.label) as hit from ranked r join sv s using (slot_id) join vec q on q.vec_id = r.query_id where rank <= 8 group by 1)"),
    "pk_subscores": sql("select query_id, side, k, round(score, 6) as score from sub"),
    "pk_topk": _shown("pk", 8),
    "pk_topk_slotkey": sql("select query_id, rank, slot_id, round(score, 6) as score from keyed_rank where rank <= 8", {"keyed": "select c.query_id, c.slot_id, round(c.score + 0.5 * coalesce(list_inner_product(q.v[1:32], e.v[1:32]), 0.0), 9) as score from pkc c join qv q using (query_id) left join vec e on e.vec_id = c.slot_id", "keyed_rank": _rank("keyed")}),
    "pk_score_slots": sql("select query_id, slot_id, round(score, 6) as score from addressed", once=True),
    "pk_softmax_read": sql("""select q.query_id, q.dim, round(coalesce(sum(p.w * x.v[q.dim]), 0.0), 6) + 0.0 as value from (select query_id, dim from qv, dims) q
      left join pw p on p.query_id = q.query_id and p.slot_id % 7 <> 3 left join vec x on x.vec_id = p.slot_id % 10 group by all""", {"pe": "select query_id, slot_id, exp(score - max(score) over (partition by query_id)) as e from pk where rank <= 8", "pw": "select query_id, slot_id, e / sum(e) over (partition by query_id) as w from pe"}),
    "compact_remap": "select slot_id, case when n < 256 then n end as compact_id from (select vec_id as slot_id, row_number() over (order by vec_id) - 1 as n from embeddings where vec_id % 7 <> 3)",
    "compact_dropped": "select least(count(*), 256) as mapped, greatest(count(*) - 256, 0) as dropped from embeddings where vec_id % 7 <> 3",
    "multi_query_union": sql("select query_id, rank, slot_id, round(score, 6) as score from best_rank where rank <= 16", {
        "forms": " union all ".join(f"select '{n}' as form, query_id, list_transform(v, lambda x, i: {e}) as v from qv" for n, e in _FORMS.items()),
        "form_scores": "select form, query_id, slot_id, round(list_inner_product(f.v, s.v) / (sqrt(list_inner_product(f.v, f.v)) * sqrt(list_inner_product(s.v, s.v))), 9) as score from forms f, sv s where query_id <> slot_id",
        "form_rank": "select *, row_number() over (partition by form, query_id order by score desc, slot_id) as nth from form_scores",
        "best": "select query_id, slot_id, max(score) as score from form_rank where nth <= 8 group by 1, 2",
        "best_rank": _rank("best"),
    }),
    "graph_expand": sql("""select query_id, cast(place as integer) as place, slot_id from (
        select query_id, slot_id, row_number() over (partition by query_id order by part, first, second, slot_id) as place from (
          select *, row_number() over (partition by query_id, slot_id order by part, first, second) as keep from (
            select query_id, slot_id, 0 as part, rank as first, 0 as second from ranked where rank <= 3
            union all select r.query_id, e.dst, 1, r.rank, e.nth from ranked r join near e on e.src = r.slot_id where r.rank <= 3 and e.nth <= 4)) where keep = 1) where place <= 10""", {
        "lines": "select distinct l_orderkey, l_partkey from lineitem",
        "edges": "select a.l_partkey as src, b.l_partkey as dst, count(*) as weight from lines a join lines b using (l_orderkey) where a.l_partkey <> b.l_partkey group by 1, 2",
        "near": "select src, dst, row_number() over (partition by src order by weight desc, dst) as nth from edges",
    }),
    "retriever_compare": sql("""select k, count(distinct query_id) as queries, round(avg(case when same then 1 else 0 end), 6) as identical, max(c) as correlation from (
        select k, query_id, bool_and(s1 = s2) as same, max(c) as c from (select *, round(corr(x, y) over (partition by k), 6) as c from both_ranks) group by 1, 2) group by k""", {
        "both_ranks": "select k, a.query_id, a.slot_id as s1, b.slot_id as s2, a.score as x, b.score as y from ranked a join ranked_dot b on a.query_id = b.query_id and a.rank = b.rank, (values (8), (32)) as ks(k) where a.rank <= k",
    }),
    "retrieval_diagnostics": sql("""select round(avg(in_a), 6) as k1_in_top, round(avg(in_b), 6) as k2_in_top, round(avg(in_c), 6) as in_candidates, round(coalesce(avg(place), -1.0), 6) as rank_mean,
        round(avg(positive), 6) as positive_mean, round(avg(negative), 6) as negative_mean, round(avg(positive - negative), 6) as margin, round(avg(live_rate), 6) as live_rate, round(avg(std), 6) as std_mean, round(avg(entropy), 6) as entropy_mean
      from (select w.query_id,
        (select case when count(*) > 0 then 1 else 0 end from subrank x where x.query_id = w.query_id and x.side = 1 and x.nth <= 8 and x.k = w.slot_id // 32) as in_a,
        (select case when count(*) > 0 then 1 else 0 end from subrank x where x.query_id = w.query_id and x.side = 2 and x.nth <= 8 and x.k = w.slot_id % 32) as in_b,
        (select count(*) from pkc c where c.query_id = w.query_id and c.slot_id = w.slot_id) as in_c,
        (select min(rank) - 1 from pk p where p.query_id = w.query_id and p.slot_id = w.slot_id and p.rank <= 32) as place,
        (select max(score) from addressed a where a.query_id = w.query_id and a.slot_id = w.slot_id) as positive,
        (select max(score) from pk p where p.query_id = w.query_id and p.rank = 2) as negative,
        (select avg(case when slot_id % 7 <> 3 then 1 else 0 end) from pkc c where c.query_id = w.query_id) as live_rate,
        (select stddev_samp(score) from pk p where p.query_id = w.query_id and p.rank <= 32) as std,
        (select sum(-p * ln(greatest(p, 1e-10))) from pp where pp.query_id = w.query_id) as entropy
      from address1 w)""", {
        "pe": "select query_id, slot_id, exp(score - max(score) over (partition by query_id)) as e from pk where rank <= 32",
        "pp": "select query_id, e / sum(e) over (partition by query_id) as p from pe",
    }),
    **{f"sel_{m}": _selection(m) for m in MODES},
    "sel_learned_features": sql("select query_id, slot_id, cast(place as integer) as place, round(score, 6) as score, round(margin, 6) as margin, round(normalised, 6) as normalised, is_required from feat"),
    "sel_learned_apply": sql("select query_id, slot_id, round(prob, 6) as prob, taken from taken"),
    "selector_prf_micro": sql("""select tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / greatest(p + r, 1e-8), 6) as f1 from (
        select *, tp / greatest(tp + fp, 1) as p, tp / greatest(tp + fn, 1) as r from (
          select count(*) filter (taken and is_required) as tp, count(*) filter (taken and not is_required) as fp, count(*) filter (not taken and is_required) as fn from taken))"""),
    "selector_prf_macro": sql("""select round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(2 * p * r / greatest(p + r, 1e-8)), 6) as f1, round(avg(s), 6) as selected, round(avg(tp), 6) as selected_required,
        round(avg(s - tp), 6) as selected_distractors, round(avg(case when tp = n then 1 else 0 end), 6) as all_present, round(sum(tp) / greatest(sum(n), 1), 6) as coverage, round((sum(s) - sum(tp)) / greatest(sum(s), 1), 6) as distractor_rate
      from (select *, tp / greatest(s, 1) as p, tp / n as r from (select n.query_id, count(*) as n, (select count(*) from taken t where t.query_id = n.query_id and t.taken) as s,
          count(*) filter (exists (select 1 from taken t where t.query_id = n.query_id and t.slot_id = n.slot_id and t.taken)) as tp from required n group by n.query_id))"""),
    "noisy_slots": sql(f"select * from ({_noisy(4, 42, 1.0, 0.5, 8)})"),
    "curriculum_slots": sql(" union all ".join(f"select *, {stage} as stage from ({_noisy(n, 7, 10.0, 0.0, 12)})" for stage, n in enumerate((0, 2, 8)))),
    "recall_at_k": sql("select k, count(*) as queries, round(avg(case when n_found > 0 then 1 else 0 end), 6) as recall from counts where n_required > 0 group by k"),
    "required_set_metrics": sql("""select k, coalesce(hops, -1) as hops, count(*) as examples, round(avg(case when n_found > 0 then 1 else 0 end), 6) as any_required, round(avg(case when n_required > 0 and n_found = n_required then 1 else 0 end), 6) as all_required,
        round(sum(n_found) / greatest(sum(n_required), 1), 6) as coverage, round(avg(n_required), 6) as mean_required, round(avg(n_found), 6) as mean_found, round(avg(n_required - n_found), 6) as mean_missing
      from counts group by grouping sets ((k), (k, hops))"""),
    "rank_metrics": sql("""select k, round(avg(1.0 / r[1]), 6) as mrr, round(avg(r[1]), 6) as mean_first, round(avg(r[2]), 6) as mean_second, round(avg(r[3]), 6) as mean_third, round(avg(r[-1]), 6) as mean_worst
      from (select n.query_id, k, list_sort(list(case when r.rank <= k then r.rank else k + 1 end)) as r from required n left join ranked r on r.query_id = n.query_id and r.slot_id = n.slot_id cross join """ + _KS + """ group by 1, 2) group by k"""),
    "failure_types": sql("select failure_type, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from failed group by failure_type"),
    "required_detail": sql("""select n.query_id, n.hops, string_agg(cast(n.slot_id as varchar), ',' order by n.pos) as required, coalesce(string_agg(cast(n.slot_id as varchar), ',' order by n.pos) filter (r.rank <= 8), '') as found,
        coalesce(string_agg(cast(n.slot_id as varchar), ',' order by n.pos) filter (r.rank is null or r.rank > 8), '') as missing, max(f.failure_type) as failure_type
      from required n left join ranked r on r.query_id = n.query_id and r.slot_id = n.slot_id join failed f on f.query_id = n.query_id group by 1, 2"""),
    "accuracy_by_hop": sql("select scope, n, accuracy from accuracies where variant = 'retrieved'"),
    "derived_metrics": sql("""select scope, round(o - r, 6) as oracle_gap, round(r - c, 6) as memory_gain, round(r - d, 6) as dense_gap from (
        select scope, coalesce(max(accuracy) filter (variant = 'oracle'), 0.0) as o, coalesce(max(accuracy) filter (variant = 'retrieved'), 0.0) as r, coalesce(max(accuracy) filter (variant = 'core'), 0.0) as c, coalesce(max(accuracy) filter (variant = 'dense'), 0.0) as d from accuracies group by scope)"""),
    "decision_gates": sql("""select unnest([1, 2, 3, 4, 5]) as gate, unnest([r8 >= 0.8, o > c, round(o - r, 9) <= 0.2, o2 > o1 * 0.5 and o3 > o1 * 0.15, r > d]) as passed from (
        select max(accuracy) filter (variant = 'oracle' and scope = 'overall') as o, max(accuracy) filter (variant = 'core' and scope = 'overall') as c, max(accuracy) filter (variant = 'retrieved' and scope = 'overall') as r,
          max(accuracy) filter (variant = 'dense' and scope = 'overall') as d, max(accuracy) filter (variant = 'oracle' and scope = 'single_hop') as o1, max(accuracy) filter (variant = 'oracle' and scope = 'two_hop') as o2,
          max(accuracy) filter (variant = 'oracle' and scope = 'three_hop') as o3, (select avg(case when n_found > 0 then 1 else 0 end) from counts where k = 8 and n_required > 0) as r8 from accuracies)"""),
    "comparison_table": sql("select variant, " + ", ".join(f"printf('%.3f', max(accuracy) filter (scope = '{s}')) as {s}" for s in ("overall", "single_hop", "two_hop", "three_hop")) + " from accuracies group by variant"),
    "pos_pairs": sql("select a.query_id, a.slot_id as src, b.slot_id as dst from required a join required b on a.query_id = b.query_id where a.pos <> b.pos"),
    "hard_negatives": """select a.p_partkey as positive, count(*) as negatives, min(b.p_partkey) as first_negative, cast(sum(b.p_partkey) as bigint) as sum_negative
      from part a join part b on b.p_partkey <> a.p_partkey and (a.p_brand = b.p_brand or a.p_type = b.p_type or a.p_size = b.p_size) group by 1""",
    "loss_contrastive": sql("""select count(*) as rows, round(avg(-ln(pos / total + 1e-10)), 6) as loss from (
        select a.vec_id, sum(case when a.label = b.label then e else 0.0 end) as pos, sum(e) as total from (
          select a, b, exp(round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) / 0.07) as e
          from vec a join vec b on a.vec_id // 32 = b.vec_id // 32 and a.vec_id <> b.vec_id) group by 1) where pos > 0"""),
    "loss_infonce": _info_nce("true"),
    "loss_infonce_live": _info_nce("c.slot_id % 7 <> 3"),
    "loss_bce": sql(f"select count(*) as rows, round(avg(case when positive then 5.0 * ({_SOFTPLUS.format('(-z)')}) else {_SOFTPLUS.format('z')} end), 6) as loss from (select n.slot_id is not null as positive, score / 0.07 as z from cosines c left join required n on n.query_id = c.query_id and n.slot_id = c.slot_id)"),
    "loss_margin": sql("""select count(*) as rows, count(distinct (p.query_id, p.slot_id)) as positives, round(avg(greatest(0.0, 0.5 - p.score + h.score)), 6) as loss from (select * from cosines semi join required using (query_id, slot_id)) p
      join (select query_id, score, row_number() over (partition by query_id order by score desc, slot_id) as nth from cosines anti join required using (query_id, slot_id)) h on h.query_id = p.query_id and h.nth <= 16"""),
    "loss_subkey": sql("""select max(rows) as rows, round(sum(ce), 6) as loss from (select side, count(*) as rows, avg(lse - score) as ce from (
        select s.*, m + ln(sum(exp(score - m)) over (partition by s.query_id, side)) as lse from (select *, max(score) over (partition by query_id, side) as m from sub) s) z
        join address1 w on w.query_id = z.query_id and z.k = case when side = 1 then w.slot_id // 32 else w.slot_id % 32 end group by side)"""),
    "metrics_running_best": """select event_type, event_id, value from (select event_type, event_id, round(value, 6) as value, max(round(value, 6)) over (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding) as before
      from events where value is not null) where before is null or value > before""",
    "lr_schedule": """select step, round(case when step < w then step / cast(greatest(1, w) as double) else greatest(0.0, 0.5 * (1.0 + cos(pi() * (step - w) / greatest(1, n - w)))) end, 6) + 0.0 as factor
      from (select event_id as step, max(event_id) over () + 1 as n, (max(event_id) over () + 1) // 10 as w from events)""",
    "run_priority": """select folder, name, cast(p as integer) as priority from (select *, row_number() over (partition by folder order by p, name) as nth from (
        select distinct 'runs/' || user_id as folder, case event_type when 'purchase' then 'best.pt' when 'error' then 'last.pt' else 'step_' || event_id || '.pt' end as name, case event_type when 'purchase' then 0 when 'error' then 1 else 2 end as p from events)) where nth = 1""",
    "doc_digest": "select doc_id, sha256(text) as sha256 from documents",
    "stream_metrics_tail": "select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(value) / count(*), 6) as mean_value from events group by 1, 2",
}
