"""The SQL of the queries in evaluation."""

from __future__ import annotations

from ..operators import generate as g
from ..sources.tables import MODE_WORDS, MODEL_WORDS
from .evaluation import ATTRIBUTES
from .oracle import _KS, _SOFTPLUS, _mix, _noisy, _rank, _tokens, _vocab, sql

_TOP = "rank <= {k}"


def _scores(queries: str, vec: str, slots: str = "sv", where: str = "where query_id <> slot_id") -> str:
    """Cosines of queries(query_id, v) and slots(slot_id, v), both through `vec`."""
    a, b = vec.format("q.v"), vec.format("s.v")
    return f"select query_id, slot_id, round(coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0.0), 9) as score from {queries} q, {slots} s {where}"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _norm(v: str) -> str:
    return f"sqrt(list_inner_product({v}, {v}))"


def _steps(k: int, forced: bool) -> dict[str, str]:
    """Relations h1, h2, h3 (ranked lists of the hops) and `walked`, their union with each slot at its first place."""
    out, tag = {}, "f" if forced else "i"
    asked = "qv"
    for hop in (1, 2, 3):
        out[f"{tag}s{hop}"] = _scores(asked, "{}")
        out[f"{tag}h{hop}"] = _rank(f"{tag}s{hop}")
        lead = f"(select query_id, slot_id from required where pos = {hop})" if forced else f"(select query_id, slot_id from {tag}h{hop} where rank = 1)"
        out[f"{tag}q{hop + 1}"] = f"select q.query_id, case when s.v is null then q.v else list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] + s.v[i]) end as v from qv q left join {lead} l using (query_id) left join sv s on s.slot_id = l.slot_id"
        asked = f"{tag}q{hop + 1}"
    every = " union all ".join(f"select query_id, slot_id, {h} as hop, rank from {tag}h{h} where rank <= {k}" for h in (1, 2, 3))
    out[f"{tag}walked"] = f"select query_id, slot_id, row_number() over (partition by query_id order by hop, rank, slot_id) as rank from (select query_id, slot_id, hop, rank, row_number() over (partition by query_id, slot_id order by hop, rank) as keep from ({every})) where keep = 1"
    return out


_EDGES = {
    "shared_lines": "select distinct l_orderkey, l_partkey from lineitem",
    "edges": "select a.l_partkey as src, b.l_partkey as dst, count(*) as weight from shared_lines a join shared_lines b using (l_orderkey) where a.l_partkey <> b.l_partkey group by 1, 2",
    "near": "select src, dst, row_number() over (partition by src order by weight desc, dst) as nth from edges",
}


def _expanded(ranked: str, anchors: int, per_anchor: int, k: int, near: str = "near") -> str:
    return f"""select query_id, place as rank, slot_id from (
        select query_id, slot_id, row_number() over (partition by query_id order by part, first, second, slot_id) as place from (
          select *, row_number() over (partition by query_id, slot_id order by part, first, second) as keep from (
            select query_id, slot_id, 0 as part, rank as first, 0 as second from {ranked} where rank <= {anchors}
            union all select r.query_id, e.dst, 1, r.rank, e.nth from {ranked} r join {near} e on e.src = r.slot_id where r.rank <= {anchors} and e.nth <= {per_anchor})) where keep = 1) where place <= {k}"""


_MODES = {
    **_EDGES,
    "chain_scores": _scores("qv", "{}[1:48]"),
    "chain_rank": _rank("chain_scores"),
    "info_scores": _scores("qv", "{}[17:64]"),
    "info_rank": _rank("info_scores"),
    "hard_scores": _scores("qv", "{}[1:40]"),
    "hard_rank": _rank("hard_scores"),
    **_steps(16, False),
    **_steps(16, True),
    "graph_rank": _expanded("ranked", 8, 8, 64),
    "chain_graph_rank": _expanded("chain_rank", 8, 8, 64),
    "modes": " union all ".join(f"select '{m}' as mode, query_id, slot_id, rank from {r} where rank <= 64" for m, r in {
        "dual_encoder_baseline": "ranked", "chain_set_bce": "chain_rank", "chain_set_infonce": "info_rank", "chain_set_bce_hardneg": "hard_rank", "slot_graph_expansion": "graph_rank",
        "chain_set_plus_graph_expansion": "chain_graph_rank", "iterative_chain": "iwalked", "iterative_chain_teacher_forced": "fwalked",
    }.items()),
    "mode_ranks": "select m.mode, n.query_id, list_sort(list(coalesce(r.rank, 2147483647))) as r from required n cross join (select distinct mode from modes) m left join (select mode, query_id, slot_id, min(rank) as rank from modes group by all) r on r.mode = m.mode and r.query_id = n.query_id and r.slot_id = n.slot_id group by 1, 2",
}


def _got(k: str) -> str:
    return f"len(list_filter(r, lambda x: x <= {k}))"


_LAYERS = {
    "normed": "select query_id, list_transform(v, lambda x: (x - list_sum(v) / len(v)) / sqrt(list_inner_product(v, v) / len(v) - power(list_sum(v) / len(v), 2) + 1e-5)) as v from qv",
    "hidden": "select n.query_id, list(greatest(list_inner_product(w.v, n.v), 0.0) order by w.vec_id) as h from normed n, vec w where w.vec_id < 16 group by 1",
    "outer_layer": "select h.query_id, list(list_inner_product(w.v[1:16], h.h) order by w.vec_id) as o from hidden h, vec w where w.vec_id between 16 and 79 group by 1",
    "adapted": f"select query_id, list_transform(o, lambda x: round(case when {_norm('o')} > 0 then x / {_norm('o')} else x end, 9)) as v from outer_layer",
    "adapted_scores": _scores("adapted", "{}"),
}


def _sampled(n: int, seed: int) -> dict[str, str]:
    return {
        "drawn_slots": _noisy(n, seed, 1.0, 0.0, 2**31 - 1),
        "sampled": "select d.query_id, d.slot_id, d.is_required as positive, c.score from drawn_slots d join own_scores c on c.query_id = d.query_id and c.slot_id = d.slot_id",
        "own_scores": _scores("qv", "{}", where=""),
    }


def _window(p: str, first: str, size: str, turn: int, seed: int) -> str:
    """The place of nth in a query's window over first..first+size-1."""
    return f"(({p} - {first} - ({_mix('q.query_id', seed + turn)}) % {size}) % {size} + {size}) % {size}"


def _structured(seed: int) -> dict[str, str]:
    out = {
        "slot_meta": "select s.slot_id, p_type as entity_type, p_brand as relation, cast(p_size as varchar) as api_family, cast(s.label as varchar) as answer_type, string_split(p_name, ' ')[1] as template, string_split(p_name, ' ')[-1] as output_family from sv s left join part on p_partkey = s.slot_id where s.slot_id % 7 <> 3",
        "own_req": "select query_id, count(*) as own, count(*) * 16 as total, cast(floor(count(*) * 16 * 0.5) as bigint) as want from required group by 1",
    }
    parts = []
    for i, a in enumerate(ATTRIBUTES):
        out[f"placed{i}"] = f"select slot_id, {a} as v, row_number() over (partition by {a} order by {_mix('slot_id', seed)}, slot_id) - 1 as nth, count(*) over (partition by {a}) as size from slot_meta where {a} is not null"
        parts.append(f"select q.query_id, p.slot_id from (select distinct r.query_id, m.{a} as v from required r join slot_meta m using (slot_id)) q join own_req o using (query_id) join placed{i} p on p.v = q.v where {_window('p.nth', '0', 'p.size', 1, seed)} < least(p.size, o.want + o.own)")
    out["hard_found"] = " union ".join(parts)
    out["hard_slots"] = f"select query_id, slot_id from (select f.*, row_number() over (partition by query_id order by {_mix('query_id', 'slot_id', seed + 2)}, slot_id) as nth from hard_found f where not exists (select 1 from required n where n.query_id = f.query_id and n.slot_id = f.slot_id)) join own_req using (query_id) where nth <= want"
    out["hard_counts"] = "select o.*, (select count(*) from hard_slots h where h.query_id = o.query_id) as n_hard from own_req o"
    out["any_placed"] = f"select slot_id, row_number() over (order by {_mix('slot_id', seed + 3)}, slot_id) - 1 as nth, count(*) over () as size from slot_meta"
    place = _window("p.nth", "0", "p.size", 4, seed)
    out["any_slots"] = f"select query_id, slot_id from (select q.query_id, p.slot_id, q.total - q.n_hard as wanted, row_number() over (partition by q.query_id order by {place}) as k from hard_counts q, any_placed p where {place} < least(p.size, q.total + q.own) and not exists (select 1 from required n where n.query_id = q.query_id and n.slot_id = p.slot_id) and not exists (select 1 from hard_slots h where h.query_id = q.query_id and h.slot_id = p.slot_id)) where k <= wanted"
    shared = " ".join(f"when bool_or(m.{a} = r.{a}) then '{a}'" for a in ATTRIBUTES)
    out["matching"] = f"select h.query_id, h.slot_id, case {shared} end as matched from hard_slots h join slot_meta m on m.slot_id = h.slot_id join required n on n.query_id = h.query_id join slot_meta r on r.slot_id = n.slot_id group by 1, 2"
    out["structured"] = "select query_id, slot_id, true as positive, false as hard, cast(null as varchar) as matched from required union all select query_id, slot_id, false, true, matched from matching union all select query_id, slot_id, false, false, null from any_slots"
    out["structured_scores"] = "select t.*, c.score from structured t join every_score c on c.query_id = t.query_id and c.slot_id = t.slot_id"
    out["every_score"] = _scores("qv", "{}", where="")
    return out


def _case(words, low: str, other: str = "") -> str:
    hits = " ".join(f"when contains({low}, '{w}')" + (f" and not contains({low}, 'pretrain')" if w == "memory_adapter" else "") + f" then '{m}'" for w, m in words)
    return f"case {hits}{other} end"


def _draw(n: str, *key) -> str:
    return f"(cast('0x' || substr(md5(concat_ws('-', {', '.join(map(str, key))})), 1, 7) as bigint) * ({n})) // 268435456"


_CUT = "case when n > 1 then greatest(1, least(n - 1, cast(floor(0.7 * n + 0.5) as bigint))) else n end"


def _entity(task: int, k: int) -> str:
    kind = g.PATHS[task][2 * k]
    return f"verb || '_{kind}_' || w0" if k == 0 else f"'{kind}_' || w{k}"


def _by_task(values) -> str:
    return "case task " + " ".join(f"when {t} then {v}" for t, v in enumerate(values)) + " end"


def _chain_rounds() -> dict[str, str]:
    """`chain_pool`, in rounds that each add what no accepted chain has."""
    test = lambda j, r: f"case when m.split = 'test' and z.n > 1 then {_draw('z.n - z.c', 'm.chain_id', 7, j, r)} + z.c else {_draw('z.c', 'm.chain_id', 7, j, r)} end"
    facts = _by_task(" || ' | ' || ".join(f"{_entity(t, k)} || ' {path[2 * k + 1]} ' || {_entity(t, k + 1)} || ' .'" for k in range(g.HOPS[t])) for t, path in enumerate(g.PATHS))
    subject, answer = (_by_task(_entity(t, k[t]) for t in range(len(g.TASKS))) for k in ([0] * len(g.TASKS), g.HOPS))
    split = "case {0} % 10 when 8 then 'val' when 9 then 'test' else 'train' end"
    out = {
        "nouns": "select row_number() over (order by word) - 1 as place, word from (select distinct regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g') as word from supplier where s_name is not null)",
        "verbs": "select row_number() over (order by word) - 1 as place, word from (select distinct lower(p_type) as word from part where p_type is not null)",
        "sizes": f"select n, {_CUT} as c, (select count(*) from verbs) as m from (select count(*) as n from nouns)",
        "left0": f"select p_partkey as chain_id, {split.format('p_partkey')} as split, (p_partkey // 10) % 5 as task from part",
    }
    for r in range(g.ROUNDS):
        words = " ".join(f"join nouns n{j} on n{j}.place = {test(j, r)}" for j in range(g.WORDS))
        out[f"drawn{r}"] = f"select chain_id, split, task, {facts} as facts, {subject} as subject, {answer} as answer from (select m.*, v.word as verb, " + ", ".join(f"n{j}.word as w{j}" for j in range(g.WORDS)) + f" from left{r} m, sizes z {words} join verbs v on v.place = {_draw('z.m', 'm.chain_id', 7, g.WORDS, r)})"
        fresh = f"select * from drawn{r}" + (f" where facts not in (select facts from accepted{r - 1})" if r else "")
        out[f"accepted{r}"] = (f"select * from accepted{r - 1} union all " if r else "") + f"select * from ({fresh} qualify row_number() over (partition by facts order by chain_id) = 1)"
        out[f"left{r + 1}"] = f"select * from left{r} where chain_id not in (select chain_id from accepted{r})"
    return out | {"chain_pool": f"select *, {_list(g.TASKS)}[task + 1] as task_type, {list(g.HOPS)}[task + 1] as hops from accepted{g.ROUNDS - 1}"}


def _example_rounds() -> dict[str, str]:
    """`kept_examples`, in rounds that each add questions that are not asked too often."""
    out = _chain_rounds() | {
        "chain_places": "select *, row_number() over (partition by split order by chain_id) - 1 as place, count(*) over (partition by split) as size from chain_pool",
        "asking0": "select c_custkey as example_id, case c_custkey % 10 when 8 then 'val' when 9 then 'test' else 'train' end as split from customer",
    }
    for r in range(g.ROUNDS):
        out[f"tried{r}"] = f"select e.example_id, e.split, p.chain_id, {_draw('2', 'e.example_id', 7, 2, r)} as template from asking{r} e join (select distinct split, size from chain_places) z on z.split = e.split join chain_places p on p.split = e.split and p.place = {_draw('z.size', 'e.example_id', 7, 1, r)}"
        held = f"left join (select chain_id, template, count(*) as held from asked{r - 1} group by 1, 2) h using (chain_id, template)" if r else ""
        out[f"asked{r}"] = (f"select * from asked{r - 1} union all " if r else "") + f"select example_id, split, chain_id, template from tried{r} {held} qualify row_number() over (partition by chain_id, template order by example_id) + {'coalesce(held, 0)' if r else '0'} <= case when split = 'train' then {g.TRAIN_REPEATS} else 1 end"
        out[f"asking{r + 1}"] = f"select * from asking{r} where example_id not in (select example_id from asked{r})"
    return out | {"kept_examples": f"select a.example_id, p.*, replace([" + ", ".join(_list(q) for q in g.QUESTIONS) + f"][p.task + 1][a.template + 1], '{{s}}', p.subject) as question from asked{g.ROUNDS - 1} a join chain_pool p using (chain_id)"}


def _steps_of(relations: dict[str, str], statement: str) -> str:
    """The statement over relations that are each computed once, in order."""
    return "with " + ",\n".join(f"{name} as materialized ({text})" for name, text in relations.items()) + "\n" + statement


_NAMES = ("oracle_text", "retrieved_oracle", "multi_query", "hidden_adapter", "memory_adapter", "memory_adapter_pretrain", "oracle", "retrieved", "random", "core_only", "dense", "exp_001_retrieval", "plain")
_PADDED = {"noised": _noisy(4, 42, 1.0, 0.5, 8), "padded_places": "select q.query_id, p.pos, coalesce(n.slot_id, -1) as slot_id, n.slot_id is null as is_pad, coalesce(n.is_required, false) as is_required from (select distinct query_id from noised) q cross join (select unnest(range(1, 9)) as pos) p left join noised n on n.query_id = q.query_id and n.pos = p.pos"}
_BOOK = {
    "book": "select a.subject as asked, a.template, a.question, a.answer, k.text from asked a join kb k on k.subject = a.subject",
    "book_vocab": _vocab("(select text || ' ' || question || ' ' || answer as text from book)"),
    "book_ids": f"""select asked, template, part, list(id order by pos) as ids from (
        select t.asked, t.template, t.part, t.pos, v.id from (""" + " union all ".join(f"select asked, template, '{c}' as part, generate_subscripts({_tokens(c)}, 1) as pos, unnest({_tokens(c)}) as token from book" for c in ("text", "question", "answer")) + """) t join book_vocab v using (token)) group by all""",
}
_FACTS = {
    "fact_ids": f"select slot_id, list(id order by pos) as ids from (select slot_id, generate_subscripts({_tokens('text')}, 1) as pos, unnest({_tokens('text')}) as token from kb) t join kb_vocab using (token) group by 1",
}


def _texts(of: str, source: str) -> dict[str, str]:
    """Relations that make `of`(query_id, v), the mean vectors of source(query_id, text)."""
    return {
        f"{of}_tokens": f"select query_id, unnest({_tokens('text')}) as token from {source}",
        f"{of}_vecs": f"select t.query_id, v.v from {of}_tokens t join vec v on v.vec_id = cast('0x' || substr(md5(t.token), 1, 7) as bigint) % (select count(*) from embeddings)",
        f"{of}_dims": f"select query_id, i, round(avg(v[i]), 12) as x from {of}_vecs, (select unnest(range(1, 65)) as i) group by 1, 2",
        of: f"select query_id, list(x order by i) as v from {of}_dims group by 1",
        f"{of}_scores": _scores(of, "{}", where=""),
        f"{of}_rank": _rank(f"{of}_scores"),
    }


_FORM_TEXTS = ("text", "text || ' reading task ' || (item_id % 5)", "text || ' ' || (item_id % 3 + 1) || ' hops'", "'reading task ' || (item_id % 5) || ' ' || (item_id % 3 + 1) || ' hops'")
_FORMS: dict[str, str] = {}
for _i, _t in enumerate(_FORM_TEXTS):
    _FORMS |= {f"asked{_i}": f"select item_id as query_id, {_t} as text from benchmark"} | _texts(f"form{_i}", f"asked{_i}")
_FORMS["form_best"] = "select query_id, slot_id, max(score) as score from (" + " union all ".join(f"select query_id, slot_id, score from form{i}_rank where rank <= 8" for i in range(4)) + ") group by 1, 2"
_COMPARED = {"other_scores": _scores("qv", "{}[1:48]"), "other_rank": _rank("other_scores")}


_DIGEST = "(select cast(sum(cast('0x' || substr(md5(slot_id || ':' || array_to_string(list_transform({}, lambda x: cast(floor(x * 1000000) as bigint)), ',')), 1, 7) as bigint)) as bigint) from sv)"


def _recall(ranked: str) -> str:
    return f"select k, round(avg(case when found then 1 else 0 end), 6) as recall from (select n.query_id, k, bool_or(r.rank <= k) as found from required n cross join (values (1), (8), (32)) as ks(k) left join {ranked} r on r.query_id = n.query_id and r.slot_id = n.slot_id group by 1, 2) group by k"


def _show(scores: str, k: int, more: dict[str, str]) -> str:
    return sql(f"select query_id, rank, slot_id, round(score, 6) as score from shown_rank where rank <= {k}", more | {"shown_rank": _rank(scores)})


ORACLE_SQL: dict[str, str] = {
    "classifier_topk": _show("logits", 8, {"logits": "select query_id, slot_id, round(list_inner_product(q.v, list_transform(s.v, lambda x: x * (1 + s.slot_id % 3))), 9) as score from qv q, sv s where query_id <> slot_id"}),
    "random_slots": sql(f"""select q.query_id, j.pos, p.slot_id from qv q cross join (select cast(unnest(range(1, 9)) as integer) as pos) j
      join (select slot_id, row_number() over (order by slot_id) - 1 as nth, count(*) over () as total from sv where slot_id % 7 <> 3) p on p.nth = ({_mix('q.query_id', 'j.pos', 11)}) % p.total"""),
    "text_query_topk": _show("form0_scores", 8, _FORMS),
    "multi_query_text": _show("form_best", 16, _FORMS),
    "legacy_topk": _show("legacy_scores", 4, {"legacy_scores": _scores("qv", "{}[1:16]")}),
    "interface_report": sql(f"""select c.k, c.queries, c.identical, c.correlation, a.recall as recall_one, b.recall as recall_two from (
        select k, count(distinct query_id) as queries, round(avg(case when same then 1 else 0 end), 6) as identical, max(c) as correlation from (
          select k, query_id, bool_and(s1 = s2) as same, max(c) as c from (select *, round(corr(x, y) over (partition by k), 6) as c from both_lists) group by 1, 2) group by k) c
      join ({_recall('ranked')}) a using (k) join ({_recall('other_rank')}) b using (k)""", _COMPARED | {
        "both_lists": "select k, a.query_id, a.slot_id as s1, b.slot_id as s2, a.score as x, b.score as y from ranked a join other_rank b on a.query_id = b.query_id and a.rank = b.rank, (values (1), (8), (32)) as ks(k) where a.rank <= k",
    }),
    "interface_questions": sql(f"""select b.item_id as query_id, b.text as question, max(case when o.rank = 1 then o.slot_id end) as first_one, max(case when t.rank = 1 then t.slot_id end) as first_two,
        (select cast(count(*) as integer) from form0_rank x join narrow_rank y on y.query_id = x.query_id and y.slot_id = x.slot_id where x.query_id = b.item_id and x.rank <= 8 and y.rank <= 8) as shared,
        bool_and(o.slot_id = t.slot_id) as identical, {_DIGEST.format("v")} as slots_one, {_DIGEST.format("v[1:48]")} as slots_two, {_DIGEST.format("v")} = {_DIGEST.format("v[1:48]")} as same_slots
      from benchmark b join form0_rank o on o.query_id = b.item_id and o.rank <= 8 join narrow_rank t on t.query_id = b.item_id and t.rank = o.rank group by b.item_id, b.text""", _FORMS | {"narrow_scores": _scores("form0", "{}[1:48]", where=""), "narrow_rank": _rank("narrow_scores")}),
    "adapter_topk": _show("adapted_scores", 8, _LAYERS),
    "pk_subscores_cosine": sql(" union all ".join(f"select query_id, {n} as side, k, round(round(list_inner_product(v[{a}:{b}], k{n}) / ({_norm(f'v[{a}:{b}]')} * {_norm(f'k{n}')}), 9), 6) as score from qv, codes" for n, a, b in ((1, 1, 32), (2, 33, 64)))),
    "graph_pairs": sql("select query_id, cast(rank as integer) as place, slot_id from paired", {
        **{k: v for k, v in _EDGES.items() if k != "near"},
        "pair_scores": "select src, dst, round(1 / (1 + exp(-(-0.5 + 0.8 * greatest(list_inner_product(a.v, b.v), 0.0) - 0.05 * greatest(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))), 0.0) + 0.1 * greatest(list_sum(a.v) + list_sum(b.v), 0.0)))), 9) as weight from edges join sv a on a.slot_id = src join sv b on b.slot_id = dst",
        "pair_near": "select src, dst, row_number() over (partition by src order by weight desc, dst) as nth from pair_scores",
        "paired": _expanded("ranked", 3, 4, 10, "pair_near"),
    }),
    "retriever_modes": sql(f"""select mode, k, count(*) as examples, round(avg(case when {_got('k')} > 0 then 1 else 0 end), 6) as any_required, round(avg(case when {_got('k')} = len(r) then 1 else 0 end), 6) as all_required, round(sum({_got('k')}) / sum(len(r)), 6) as coverage,
        round(avg(1.0 / case when r[1] <= k then r[1] else k + 1 end), 6) as mrr, round(avg(case when r[-1] <= k then r[-1] else k + 1 end), 6) as mean_worst from mode_ranks, {_KS} group by 1, 2""", _MODES),
    "retriever_mode_failures": sql(f"""select mode, failure_type, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (partition by mode), 6) as percent from (select mode,
        case when {_got('8')} = len(r) then 'none_all_present' when {_got('32')} = len(r) then 'ranked_too_low' when {_got('64')} = len(r) then 'ranked_beyond_64' when {_got('64')} > 0 then 'missing_required_slot' else 'no_required_in_topk' end as failure_type from mode_ranks) group by 1, 2""", _MODES),
    "iterative_retrieval": sql("select query_id, cast(rank as integer) as rank, slot_id from iwalked", _steps(8, False)),
    "structured_negatives": sql("select query_id, slot_id, positive, hard, matched from structured", _structured(5)),
    "loss_structured_bce": sql(f"select count(*) as queries, cast(sum(n) as bigint) as rows, round(avg(loss), 6) as loss from (select query_id, count(*) as n, avg(case when positive then 5.0 * ({_SOFTPLUS.format('(-z)')}) else {_SOFTPLUS.format('z')} end) as loss from (select *, score / 0.07 as z from structured_scores) group by 1)", _structured(5)),
    "loss_infonce_sampled": sql("""select count(*) as rows, round(avg(ln(total) - ln(pos)), 6) as loss from (
        select query_id, sum(e) as total, sum(case when positive then e else 0.0 end) as pos from (select *, exp((score - max(score) over (partition by query_id)) / 0.07) as e from sampled) group by 1) where pos > 0""", _sampled(48, 23)),
    "loss_margin_sampled": sql("""select count(*) as rows, round(avg(greatest(0.0, 0.5 - p.score + h.score)), 6) as loss from (select query_id, max(score) as score from sampled where positive group by 1) p
      join (select query_id, score, row_number() over (partition by query_id order by score desc, slot_id) as nth from sampled where not positive) h on h.query_id = p.query_id and h.nth <= 16""", _sampled(48, 23)),
    "loss_dual_encoder": sql(f"""select count(*) as rows, round(avg(-ln(pos / total + 1e-10)), 6) as loss from (select a, sum(case when same then e else 0.0 end) as pos, sum(e) as total from (
        select a.query_id as a, a.slot_id = b.slot_id as same, exp(round(list_inner_product(q.v, s.v) / ({_norm('q.v')} * {_norm('s.v')}), 9) / 0.07) as e
        from required a join required b on a.query_id // 320 = b.query_id // 320 join qv q on q.query_id = a.query_id join sv s on s.slot_id = b.slot_id where a.pos = 1 and b.pos = 1) group by 1) where pos > 0"""),
    "loss_selector_bce": sql(f"select count(*) as rows, round(avg(case when is_required then 3.0 * ({_SOFTPLUS.format('(-z)')}) else {_SOFTPLUS.format('z')} end), 6) as loss from (select is_required, -1.0 + 6.0 * score - 0.15 * place - 4.0 * margin + 1.5 * normalised as z from feat)"),
    "loss_adapter": sql("""select count(*) as rows, round(avg(ln(t.total) - s.score / 0.07), 6) as ce, round(avg(1.0 - s.score), 6) as alignment from required n join adapted_scores s on s.query_id = n.query_id and s.slot_id = n.slot_id
      join (select query_id, sum(exp(score / 0.07)) as total from adapted_scores group by 1) t on t.query_id = n.query_id where n.pos = 1""", _LAYERS),
    "loss_tokens": sql("""select cast(sum(a.times) as bigint) as rows, round(sum(-ln((coalesce(b.n, 0) + 1.0) / (coalesce(t.total, 0) + 1000.0)) * a.times) / sum(a.times), 6) as loss from asked_pairs a
      left join bigram b on b.prev = a.prev and b.next = a.next left join (select prev, sum(n) as total from bigram group by 1) t on t.prev = a.prev""", {
        "prompt_pairs": "select ids[i] as prev, ids[i + 1] as next, i + 1 > prompt_len as counts from prompts, (select unnest(range(1, 100000)) as i) where i < len(ids)",
        "bigram": "select prev, next, count(*) as n from prompt_pairs group by 1, 2",
        "asked_pairs": "select prev, next, count(*) as times from prompt_pairs where counts group by 1, 2",
    }),
    "dataset_alignment": _steps_of(_example_rounds(), """select split, count(*) as examples, count(*) filter (facts like '% ' || answer || ' .') as aligned, count(*) filter (contains(question, answer)) as leaked,
      count(*) filter (answer in (select answer from kept_examples where split = 'train')) as answers_in_train, count(distinct answer) as distinct_answers from kept_examples group by split"""),
    "weighted_loss": "select count(*) as batches, cast(sum(size) as bigint) as rows, round(sum(loss * size) / sum(size), 6) as loss from (select event_type, cast(ts as date) as day, avg(value) as loss, count(*) as size from events where value is not null group by 1, 2)",
    "batch_cosine_mean": sql("select count(*) as batches, round(avg(m), 6) as mean from (select query_id // 320 as batch, avg(score) as m from ranked where rank = 1 group by 1)"),
    "qa_report": sql("""select max(accuracy) filter (scope = 'overall') as overall, max(accuracy) filter (scope = 'single_hop') as single_hop, max(accuracy) filter (scope = 'two_hop') as two_hop, max(accuracy) filter (scope = 'three_hop') as three_hop, max(n) filter (scope = 'overall') as examples,
        (select round(avg(case when n_found > 0 then 1 else 0 end), 6) from counts where k = 8) as any_required, (select round(avg(case when n_required > 0 and n_found = n_required then 1 else 0 end), 6) from counts where k = 8) as all_required,
        (select round(sum(n_found) / greatest(sum(n_required), 1), 6) from counts where k = 8) as coverage, (select round(avg(case when n_found > 0 then 1 else 0 end), 6) from counts where k = 8 and n_required > 0) as recall from accuracies where variant = 'retrieved'"""),
    "comparison_report": sql("""select variant as model, (select cast(sum(m) as bigint) from (select max(len(embedding)) as m from embeddings group by label)) as params, """
      + ", ".join(f"printf('%.3f', max(accuracy) filter (scope = '{s}')) as {s}" for s in ("single_hop", "two_hop", "three_hop", "overall"))
      + """, printf('%.3f', (select round(avg(case when n_found > 0 then 1 else 0 end), 6) from counts where k = 8 and n_required > 0)) as recall_at_8,
        printf('%.3f', (select round(max(accuracy) filter (variant = 'oracle') - max(accuracy) filter (variant = 'retrieved'), 6) from accuracies where scope = 'overall')) as oracle_gap,
        printf('%.3f', (select round(max(accuracy) filter (variant = 'retrieved') - max(accuracy) filter (variant = 'dense'), 6) from accuracies where scope = 'overall')) as dense_gap from accuracies group by variant"""),
    "run_modes": f"select name, {_case(MODE_WORDS, 'name')} as mode, {_case(MODEL_WORDS, 'spaced', chr(32) + 'else' + chr(32) + chr(39) + 'sam' + chr(39))} as model_type from (select name, replace(lower(name), '_', ' ') as spaced from (select distinct event_type || '_' || {_list(_NAMES)}[user_id % {len(_NAMES)} + 1] as name from events where user_id is not null and event_type is not null))",
    "required_texts": sql("select n.query_id, n.pos, n.slot_id, coalesce(k.text, '<missing>') as text from required n left join (select slot_id, text from kb where slot_id % 7 <> 3) k on k.slot_id = n.slot_id"),
    "padded_slots": sql("select query_id, cast(pos as integer) as pos, slot_id, is_pad, is_required from padded_places", _PADDED),
    "unpadded_slots": sql("select query_id, string_agg(cast(slot_id as varchar), ',' order by pos) as slots, cast(count(*) as integer) as n from padded_places where slot_id >= 0 group by 1", _PADDED),
    "slots_in_range": sql("select query_id, pos, slot_id, slot_id < (select count(*) from sv where slot_id % 7 <> 3) as in_range from required"),
    "kb_tensor": sql(f"select greatest(count(*), 100000) as slots, count(*) as live, greatest(count(*), 100000) - 1 as last, cast(sum(value_token) as bigint) as token_sum from (select coalesce(id, 6) as value_token from (select slot_id, coalesce({_tokens('embedding_target')}[1], '<unk>') as token from kb) left join kb_vocab using (token))"),
    "shuffled_batches": f"select doc_id, cast(place as integer) as place, cast(place // 16 as integer) as batch_id from (select doc_id, row_number() over (order by {_mix('doc_id', 42)}, doc_id) - 1 as place from documents)",
    "collated_batches": sql("""select conv_id, turn, cast(batch_id as integer) as batch_id, array_to_string(list_concat(list_transform(range(0, len(ids)), lambda x: 1), list_transform(range(0, width - len(ids)), lambda x: 0)), '') as mask,
        array_to_string(list_concat(required, list_transform(range(0, most - len(required)), lambda x: -1)), ',') as required
      from (select *, max(len(ids)) over (partition by batch_id) as width, max(len(required)) over (partition by batch_id) as most from (select *, example_id // 8 as batch_id from (
        select p.*, r.required, row_number() over (order by p.conv_id, p.turn) - 1 as example_id from prompts p join (select conv_id, list(turn order by turn) as required from conversations group by 1) r on r.conv_id = p.conv_id)))"""),
    "open_book_prompts": sql("""select b.asked, b.template, cast(4 + len(t.ids) + len(q.ids) as integer) as prompt_len, array_to_string(list_concat([1, 5], t.ids, [4], q.ids, [3], a.ids, [2]), ',') as ids from book b
      join book_ids t on t.asked = b.asked and t.template = b.template and t.part = 'text' join book_ids q on q.asked = b.asked and q.template = b.template and q.part = 'question' join book_ids a on a.asked = b.asked and a.template = b.template and a.part = 'answer'""", _BOOK),
    "fact_sequences": sql("select slot_id, 1 as prompt_len, array_to_string(list_concat([1, 5], ids, [2]), ',') as ids from fact_ids", _FACTS | {"kb_vocab": _vocab("kb")}),
    "first_examples": sql("select subject, template, question, answer from (select *, row_number() over (partition by question, answer order by subject) as repeat from asked) where repeat <= 5 order by question, answer, subject, template limit 100"),
    "task_rotation": f"select p_partkey, {_list(g.TASKS)}[(row_number() over (order by p_partkey) - 1) % 5 + 1] as task_type from part",
    "stage_by_epoch": "select epoch, events, cast(case when epoch >= 5 then 2 when epoch >= 2 then 1 else 0 end as integer) as stage from (select cast(date_diff('day', (select min(cast(ts as date)) from events), cast(ts as date)) as integer) as epoch, count(*) as events from events where ts is not null group by 1)",
    "kb_first_seen": """select cast(row_number() over (order by first) - 1 as bigint) as slot_id, subject || ' orders_at ' || target || ' .' as text, target as embedding_target, subject from (
        select 'customer_' || o_custkey as subject, 'priority_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '_', 'g') as target, min(place) as first
        from (select *, row_number() over () as place from orders) where o_custkey is not null and o_orderpriority is not null group by 1, 2)""",
    "throughput_report": f"""select 'tokenize_counts' as query, (select count(*) from documents) as rows, 0 as tokens, true as has_row_rate, false as has_token_rate, false as has_peak
      union all select 'documents', count(*), cast(sum(coalesce(len({_tokens('text')}), 0)) as bigint), true, true, true from documents""",
    "generated_names": f"""with nouns as ({_chain_rounds()["nouns"]}), verbs as ({_chain_rounds()["verbs"]}),
      every as (select 'noun' as kind, place, word, count(*) over () as n from nouns union all select 'verb', place, word, count(*) over () from verbs)
      select separation, kind, word, case when separation = 'none' or (separation = 'soft' and kind = 'verb') then 'both' when place < {_CUT} then 'train' else 'test' end as pool
      from every, (values {", ".join(f"('{s}')" for s in g.SEPARATIONS)}) as s(separation)""",
    "generated_facts": _steps_of(_chain_rounds(), "select chain_id, split, task_type, cast(hops as integer) as hops, facts, subject, answer from chain_pool"),
    "generated_examples": _steps_of(_example_rounds(), "select example_id, chain_id, split, task_type, question, answer, cast(hops as integer) as hops from kept_examples"),
}
