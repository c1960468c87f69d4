"""The SQL of the queries in neural: layers as inner products of lists."""

from __future__ import annotations

from ..operators.neural import MODES
from .neural import ENCODER, HEAD, HEAD_SLOTS, HEADS, MODELS, PAIR, SELECTOR_MLP, TAKE
from .oracle import _SOFTPLUS, _rank, sql
from .oracle_evaluation import _EDGES, _PADDED, _expanded, _norm, _scores, _texts


def _rows(layout: dict, name: str) -> str:
    """A matrix as rows (row, v)."""
    first, n, start, dims = layout[name]
    return f"(select vec_id - {first} as row, v[{start}:{start + dims - 1}] as v from vec where vec_id >= {first} and vec_id < {first + n})"


def _vector(layout: dict, name: str) -> str:
    return f"(select v from {_rows(layout, name)})"


def _layer(layout: dict, name: str, source: str, keys: str, of: str, bias: str | None = None, f: str = "{}") -> str:
    """keys and `o`, the products of the matrix's rows with the list `of` of each row of source."""
    z = f"list_inner_product(w.v, s.{of})" + (f" + {_vector(layout, bias)}[w.row + 1]" if bias else "")
    return f"select {keys}, list({f.format(z)} order by w.row) as o from {source} s, {_rows(layout, name)} w group by all"


_SIGMOID = "1.0 / (1.0 + exp(-({})))"
_HEAD = {
    "head_slots": f"select query_id, rank, slot_id, live, (case when live then 1.0 else 0.0 end) / greatest(sum(case when live then 1.0 else 0.0 end) over (partition by query_id), 1.0) as w from cand where rank <= {HEAD_SLOTS}",
    "head_values": "select c.query_id, c.rank, c.w, case when c.live then x.v else list_transform(x.v, lambda y: 0.0) end as v from head_slots c join sv s on s.slot_id = c.slot_id join vec x on x.vec_id = s.label",
    "head_mean": "select query_id, list(m order by dim) as v from (select query_id, dim, sum(w * v[dim]) as m from head_values, dims group by all) group by 1",
    "head_read": _layer(HEAD, "memory", "head_mean", "query_id", "v"),
    "head_asked": _layer(HEAD, "query", "(select query_id, v[1:32] as v from qv)", "query_id", "v"),
    "head_keys": _layer(HEAD, "key", "head_values", "query_id, rank", "v"),
    "head_vals": _layer(HEAD, "value", "head_values", "query_id, rank", "v"),
    "head_att": "select query_id, k.rank, exp(list_inner_product(a.o, k.o) / sqrt(32)) as e from head_asked a join head_keys k using (query_id)",
    "head_context": "select query_id, list(m order by i) as o from (select query_id, i, sum(e * v.o[i]) / sum(e) as m from head_att join head_vals v using (query_id, rank), (select unnest(range(1, 33)) as i) group by all) group by 1",
}


def _head(mode: str) -> dict[str, str]:
    """`head_out`: query_id, the state x, what was read m, the gate g and the new state o."""
    read = "head_context" if mode == "cross_attention" else "head_read"
    both = f"select query_id, q.v[1:32] as x, r.o as m, list_concat(q.v[1:32], r.o) as b from qv q join {read} r using (query_id)"
    if mode == "concat_projection":
        return _HEAD | {"head_both": both, "head_out": _layer(HEAD, "joined", "head_both", "query_id, x, m, null as g", "b")}
    gated = _layer(HEAD, "gate", "head_both", "query_id, x, m", "b", "gate_bias", _SIGMOID)
    fixed = {"forced_gate_1": "1.0", "forced_gate_scalar": "0.5"}.get(mode)
    gate = f"select query_id, x, m, list_transform(m, lambda y: {fixed}) as o from head_both" if fixed else gated
    return _HEAD | {"head_both": both, "head_gate": gate, "head_out": "select query_id, x, m, o as g, list_transform(range(1, 33), lambda i: x[i] + o[i] * m[i]) as o from head_gate"}


def _stats(mode: str) -> str:
    change = "list_transform(range(1, 33), lambda i: o[i] - x[i])"
    gate = "cast(null as double)" if mode == "concat_projection" else "round(avg(list_avg(g)), 6)"
    return sql(f"select '{mode}' as mode, count(*) as rows, {gate} as gate_mean, round(avg({_norm('m')}), 6) as memory_norm, round(avg({_norm(change)} / {_norm('x')}), 6) as residual_ratio from head_out", _head(mode))


_SELECTOR = {
    "sel_in": "select f.query_id, f.slot_id, f.place, f.is_required, f.live, f.hops, q.v as q, s.v as s, case when f.live then x.v else list_transform(x.v, lambda y: 0.0) end as v, [f.score, f.place, f.margin, f.normalised] as f from feat f join qv q using (query_id) join sv s on s.slot_id = f.slot_id join vec x on x.vec_id = s.label",
    "sel_parts": " union all ".join(f"select query_id, slot_id, w.row, list_inner_product(w.v, i.{c}) as z from sel_in i, {_rows(SELECTOR_MLP, m)} w" for c, m in (("q", "w_query"), ("s", "w_slot"), ("v", "w_value"), ("f", "w_scalars")))
    + f" union all select query_id, slot_id, w.row, list_inner_product(w.v, h.v) from sel_in i join {_rows(SELECTOR_MLP, 'hops')} h on h.row = least(greatest(i.hops, 0), 3), {_rows(SELECTOR_MLP, 'w_hops')} w",
    "sel_first": f"select query_id, slot_id, list(greatest(z + {_vector(SELECTOR_MLP, 'b_first')}[row + 1], 0.0) order by row) as h from (select query_id, slot_id, row, sum(z) as z from sel_parts group by all) group by 1, 2",
    "sel_second": _layer(SELECTOR_MLP, "w_second", "sel_first", "query_id, slot_id", "h", "b_second", "greatest({}, 0.0)"),
    "sel_logit": f"select i.query_id, i.slot_id, i.place, i.is_required, i.live, i.v, round(list_inner_product({_vector(SELECTOR_MLP, 'w_last')}, h.o) + {_vector(SELECTOR_MLP, 'b_last')}[1], 9) as logit from sel_second h join sel_in i on i.query_id = h.query_id and i.slot_id = h.slot_id",
    "sel_prob": f"select *, round({_SIGMOID.format('logit')}, 9) as prob from sel_logit",
    "sel_taken": f"select *, prob >= {TAKE} or (not bool_or(prob >= {TAKE}) over (partition by query_id) and row_number() over (partition by query_id order by place) = 1) as taken from sel_prob",
}
_PAIR = {
    "pair_anchor": _layer(PAIR, "w_anchor", "(select distinct a.slot_id, a.v from sv a join ranked r on r.slot_id = a.slot_id where r.rank <= 3)", "slot_id", "v", "b_first"),
    "pair_slot": _layer(PAIR, "w_slot", "sv", "slot_id", "v"),
    "pair_first": "select a.slot_id as src, b.slot_id as dst, list_transform(range(1, 17), lambda i: greatest(a.o[i] + b.o[i], 0.0)) as h from pair_anchor a, pair_slot b",
    "pair_w": f"select list(v order by row) as w, {_vector(PAIR, 'b_second')} as b, {_vector(PAIR, 'w_last')} as l from {_rows(PAIR, 'w_second')}",
    "pair_score": "select src, dst, round(list_inner_product(l, list_transform(range(1, 17), lambda i: greatest(list_inner_product(w[i], h) + b[i], 0.0))), 9) as weight from pair_first, pair_w",
    "pair_rank": "select src, dst, weight, row_number() over (partition by src order by weight desc, dst) as nth from pair_score",
}

_FEW = {
    "few_facts": "select slot_id, text from (select cast(row_number() over (order by text) - 1 as integer) as slot_id, text from (select distinct subject || ' ' || relation || ' ' || object || ' .' as text from facts where regexp_matches(subject, '^(nation|customer|supplier|part)_')))",
    "few_texts": "select slot_id as query_id, text from few_facts",
    **_texts("few", "few_texts"),
    "few_slots": "select query_id as slot_id, v from few",
}


def _hops(forced: bool) -> dict[str, str]:
    """`thop1` to `thop3`, the ranked lists of the hops, and `twalked`, their union with each slot at its first place."""
    out = dict(_FEW)
    asked = "select item_id as query_id, text from benchmark"
    for hop in (1, 2, 3):
        out |= {f"task{hop}": asked} | _texts(f"tvec{hop}", f"task{hop}")
        out[f"tsc{hop}"] = _scores(f"tvec{hop}", "{}", "few_slots", "")
        out[f"thop{hop}"] = _rank(f"tsc{hop}")
        lead = f"(select item_id as query_id, item_id * {7 if hop == 1 else 11} % 100 as slot_id from benchmark)" if forced else f"(select query_id, slot_id from thop{hop} where rank = 1)"
        asked = f"select b.item_id as query_id, concat_ws(' ', b.text, f.text) as text from benchmark b left join {lead} l on l.query_id = b.item_id left join few_facts f on f.slot_id = l.slot_id"
    out["tfound"] = " union all ".join(f"select {h} as hop, query_id, rank, slot_id, score from thop{h} where rank <= 8" for h in (1, 2, 3))
    out["twalked"] = "select query_id, slot_id, cast(row_number() over (partition by query_id order by hop, rank, slot_id) as integer) as rank from (select *, row_number() over (partition by query_id, slot_id order by hop, rank) as keep from tfound) where keep = 1"
    return out


def _matrix(name: str) -> str:
    return f"(select list(v order by row) as w from {_rows(ENCODER, name)})"


def _encoder() -> dict[str, str]:
    """`encoded`(query_id, v): two layers of causal attention and gated products, read at the last position."""
    wide = "range(1, 17)"
    normed = f"list_transform({wide}, lambda i: x[i] / sqrt(list_inner_product(x, x) / 16 + 1e-6) * nw[i])"
    by = lambda name: f"(select v as nw from {_rows(ENCODER, name)})"
    out = {
        "enc_ids": "select conv_id * 4096 + turn as query_id, prompt_len as n, unnest(range(0, prompt_len)) as pos, ids from prompts",
        "enc_x0": f"select query_id, n, pos, list_transform({wide}, lambda i: t.v[i] + p.v[i]) as x from enc_ids join {_rows(ENCODER, 'tokens')} t on t.row = ids[pos + 1] % 256 join {_rows(ENCODER, 'positions')} p on p.row = pos % 64",
    }
    for layer in (0, 1):
        last = " and a.pos = a.n - 1" if layer else ""
        size = 16 // HEADS
        part = lambda side, first: f"{side}.o[{first} + {size} * g + 1:{first} + {size} * g + {size}]"
        out |= {
            f"enc_h{layer}": f"select query_id, n, pos, x, {normed} as h from enc_x{layer}, {by(f'norm1_{layer}')}",
            f"enc_qkv{layer}": f"select query_id, n, pos, x, list_transform(w, lambda r: list_inner_product(r, h)) as o from enc_h{layer}, {_matrix(f'qkv_{layer}')}",
            f"enc_pair{layer}": f"select a.query_id, a.pos, g, exp(list_inner_product({part('a', 0)}, {part('b', 16)}) / sqrt({size})) as e, {part('b', 32)} as v from enc_qkv{layer} a join enc_qkv{layer} b on a.query_id = b.query_id and b.pos <= a.pos{last}, (select unnest(range(0, {HEADS})) as g)",
            f"enc_att{layer}": "select query_id, pos, flatten(list(y order by g)) as y from (select query_id, pos, g, [" + ", ".join(f"sum(e * v[{i + 1}]) / sum(e)" for i in range(size)) + f"] as y from enc_pair{layer} group by all) group by 1, 2",
            f"enc_r{layer}": f"select query_id, n, pos, list_transform({wide}, lambda i: x[i] + list_inner_product(w[i], y)) as x from enc_qkv{layer} join enc_att{layer} using (query_id, pos), {_matrix(f'proj_{layer}')}",
            f"enc_n{layer}": f"select query_id, n, pos, x, {normed} as h from enc_r{layer}, {by(f'norm2_{layer}')}",
            f"enc_g{layer}": f"select query_id, n, pos, x, list_transform(range(1, 33), lambda i: list_inner_product(g.w[i], h) / (1 + exp(-list_inner_product(g.w[i], h))) * list_inner_product(u.w[i], h)) as m from enc_n{layer}, {_matrix(f'gate_{layer}')} g, {_matrix(f'up_{layer}')} u",
            f"enc_x{layer + 1}": f"select query_id, n, pos, list_transform({wide}, lambda i: x[i] + list_inner_product(w[i], m)) as x from enc_g{layer}, {_matrix(f'down_{layer}')}",
        }
    out["enc_last"] = f"select query_id, {normed} as h from enc_x2, {by('norm')} where pos = n - 1"
    return out | {"encoded": f"select query_id, list_transform(w, lambda r: list_inner_product(r, h)) as v from enc_last, {_matrix('out')}"}


_ENCODED = _encoder() | {"enc_rounded": "select query_id, list_transform(v, lambda x: round(x, 9)) as v from encoded", "enc_scores": _scores("enc_rounded", "{}", "enc_slots", ""), "enc_slots": "select slot_id, v[1:32] as v from sv", "enc_rank": _rank("enc_scores")}

ORACLE_SQL: dict[str, str] = {
    "encoded_prompts": sql("select query_id, i as dim, round(v[i], 6) + 0.0 as value from encoded, (select cast(unnest(range(1, 33)) as integer) as i)", _ENCODED),
    "encoded_topk": sql("select query_id, rank, slot_id, round(score, 6) as score from enc_rank where rank <= 8", _ENCODED),
    **{f"memory_{m}": sql("select query_id, i as dim, round(o[i], 6) + 0.0 as value from head_out, (select cast(unnest(range(1, 33)) as integer) as i)", _head(m)) for m in MODES},
    "memory_diagnostics": " union all ".join(f"select * from ({_stats(m)})" for m in MODES),
    "gate_stats": sql(f"""select count(*) as rows, round(avg(list_avg(g)), 6) as gate_mean, round(min(list_min(g)), 6) as gate_min, round(max(list_max(g)), 6) as gate_max, round(avg({_norm('m')}), 6) as memory_norm, round(avg({_norm('x')}), 6) as residual_norm,
      round(avg({_norm('m')} / greatest({_norm('x')}, 1e-8)), 6) as memory_residual_ratio from head_out""", _head("gated_sum")),
    "detailed_predictions": sql(f"""select g.query_id, g.hops, g.gold_answer, b.label as prediction, round(list_avg(h.g), 6) as gate_mean, round({_norm('h.m')}, 6) as memory_norm, round({_norm('h.m')} / greatest({_norm('h.x')}, 1e-8), 6) as memory_residual_ratio,
        n.required_slots, n.distractor_slots, cast(n.num_distractors as integer) as num_distractors, b.label = g.gold_answer as correct
      from (select r.query_id, r.hops, s.label as gold_answer from required r join sv s using (slot_id) where r.pos = 1) g
      join (select r.query_id, s.label from ranked r join sv s using (slot_id) where r.rank = 1) b using (query_id) join head_out h using (query_id)
      join (select query_id, string_agg(cast(slot_id as varchar), ',' order by pos) filter (is_required) as required_slots, coalesce(string_agg(cast(slot_id as varchar), ',' order by pos) filter (not is_required), '') as distractor_slots, count(*) filter (not is_required) as num_distractors from noised group by 1) n using (query_id)""", _PADDED | _head("gated_sum")),
    "parameter_count": sql("select cast(sum(names) as bigint) as names, count(*) as tensors, cast(sum(numel) as bigint) as parameters from (select tensor, count(*) as names, max(numel) as numel from (select name, tensor, sum(len(v[start:start + dims - 1])) as numel from vec join (values "
    + ", ".join(f"('{m}.{n}', '{'-'.join(map(str, at))}', {', '.join(map(str, at))})" for m, layout in MODELS.items() for n, at in layout.items())
    + ") as t(name, tensor, first, n, start, dims) on vec_id >= first and vec_id < first + n group by 1, 2) group by 1)"),
    "selector_mlp": sql("select query_id, slot_id, round(logit, 6) as logit, round(prob, 6) as prob, taken from sel_taken", _SELECTOR),
    "selector_mlp_top3": sql("select query_id, slot_id, place from (select *, row_number() over (partition by query_id order by prob desc, place) as nth from sel_prob) where nth <= 3", _SELECTOR),
    "selector_mlp_read": sql("select query_id, dim, round(sum(case when taken then v[dim] else 0.0 end) / greatest(count(*) filter (taken), 1), 6) + 0.0 as value from sel_taken, dims group by 1, 2", _SELECTOR),
    "selector_mlp_prf": sql("""select round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(2 * p * r / greatest(p + r, 1e-8)), 6) as f1, round(avg(s), 6) as selected, round(avg(tp), 6) as selected_required,
        round(avg(s - tp), 6) as selected_distractors, round(avg(case when tp = n then 1 else 0 end), 6) as all_present, round(sum(tp) / greatest(sum(n), 1), 6) as coverage, round((sum(s) - sum(tp)) / greatest(sum(s), 1), 6) as distractor_rate
      from (select *, tp / greatest(s, 1) as p, tp / n as r from (select n.query_id, n.n, t.s, t.tp from (select query_id, count(*) as n from required group by 1) n
        join (select query_id, count(*) filter (taken) as s, count(*) filter (taken and is_required) as tp from sel_taken group by 1) t using (query_id)))""", _SELECTOR),
    "loss_selector_mlp": sql(f"select count(*) as rows, round(avg(case when is_required then 3.0 * ({_SOFTPLUS.format('(-logit)')}) else {_SOFTPLUS.format('logit')} end), 6) as loss from sel_logit", _SELECTOR),
    "pair_mlp_topk": sql("select src, cast(nth as integer) as rank, dst, round(weight, 6) as weight from pair_rank where nth <= 4", _PAIR),
    "pair_mlp_expand": sql("select query_id, cast(rank as integer) as place, slot_id from paired_out", _EDGES | _PAIR | {"paired_out": _expanded("ranked", 3, 4, 10, "pair_rank")}),
    "iterative_text": sql("select query_id, rank, slot_id from twalked", _hops(False)),
    "iterative_text_hops": sql("select hop, query_id, rank, slot_id, round(score, 6) as score from tfound", _hops(False)),
    "iterative_text_forced": sql("select query_id, rank, slot_id from twalked", _hops(True)),
    "sql_score_given": sql("select query_id, slot_id, round(list_inner_product(q.v, s.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(s.v, s.v))), 6) as cosine, round(list_inner_product(q.v, s.v), 6) as dot from required join qv q using (query_id) join sv s using (slot_id)"),
    "sql_vec_wavg": sql("select query_id, dim, round(avg(s.v[dim]), 6) + 0.0 as value from ranked r join sv s on s.slot_id = r.slot_id, dims where r.rank <= 16 group by 1, 2"),
    "sql_topk_scan": sql("select query_id, rank, slot_id, round(score, 6) as score from ranked where rank <= 8"),
}
