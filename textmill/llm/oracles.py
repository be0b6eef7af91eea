"""The operators that SQL can express, as DuckDB SQL over the same tables."""

from . import audit, mixing, nearest, periodic, quality, warc

_WORD = r"'[^\x20\x09-\x0D]+'"


def _tail(count: str, total: str) -> str:
    risk = quality.RISK
    term = (
        f"exp(lgamma({total} + 1) - lgamma(i + 1) - lgamma({total} - i + 1) + i * ln({risk}) + ({total} - i) * ln(1 - {risk}))"
    )
    return (
        f"case when {total} = 0 or {count} >= {total} * {risk} then 1.0 "
        f"else list_sum(list_transform(range(0, cast({count} as bigint) + 1), lambda i: {term})) end"
    )


def _quality() -> str:
    level = quality.DELTA / (len(quality.RULES) * (len(quality.STRATA) + 1))
    rates = {rule: "{}::double / nullif({}, 0)".format(*text.split(" / ")) for rule, (text, _) in quality.RULES.items()}
    counts = ",\n".join(
        f"count(*) filter (rate_{rule} > {cutoff}) as {rule}_{i}"
        for rule, (_, cutoffs) in quality.RULES.items() for i, cutoff in enumerate(cutoffs)
    )
    cuts = ",\n".join(
        "case " + " ".join(
            f"when {_tail(f'{rule}_{i}', 'n_good')} <= {level} then {cutoff}" for i, cutoff in reversed(list(enumerate(cutoffs)))
        ) + f" end as cut_{rule}"
        for rule, (_, cutoffs) in quality.RULES.items()
    )
    broken = ", ".join(f"case when rate_{rule} > cut_{rule} then '{rule}' end" for rule in quality.RULES)
    strata = ", ".join(f"'{s}'" for s in quality.STRATA)
    return f"""
    with d as (
      select row_number() over () as rid, doc_id, coalesce(text, '') as text,
             case when lang in ({strata}) then lang else 'other' end as stratum
      from documents),
    w as (
      select rid, unnest(ws) as w, generate_subscripts(ws, 1) as i
      from (select rid, regexp_extract_all(text, {_WORD}) as ws from d)),
    windows as (
      select rid, i, w || ' ' || lead(w, 1) over p || ' ' || lead(w, 2) over p as g
      from w window p as (partition by rid order by i)),
    again as (select rid, i from windows where g is not null qualify count(*) over (partition by rid, g) > 1),
    covered as (select rid, count(distinct i + o) as n from again, (values (0), (1), (2)) t(o) group by rid),
    lines as (select rid, unnest(string_split(text, chr(10))) as line from d),
    kept_lines as (
      select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
      from lines where regexp_matches(line, {_WORD}) group by rid),
    m as (
      select d.rid, doc_id, stratum, len(regexp_extract_all(text, {_WORD})) as n_words,
             length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
             len(regexp_extract_all(text, '[!?]')) as n_marks, len(regexp_extract_all(text, '\\p{{Lu}}')) as n_upper,
             coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
             coalesce(covered.n, 0) as n_repeat_words
      from d left join kept_lines using (rid) left join covered using (rid)),
    r as (select *, {", ".join(f"{text} as rate_{rule}" for rule, text in rates.items())} from m),
    good as (
      select doc_id from labels where quality in (0, 1) and doc_id is not null group by doc_id having min(quality) = 1),
    counted as (
      select stratum, count(*) as n_good, {counts} from r where doc_id in (select doc_id from good) group by stratum),
    cuts as (select stratum, {cuts} from counted),
    judged as (
      select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, concat_ws(',', {broken}) as broken_rules
      from r left join cuts using (stratum))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and broken_rules = '' as kept, broken_rules
    from judged"""


_MIX = f"""
    with d as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) as size,
             md5('mix:' || coalesce(cast(doc_id as varchar), text, '')) as spot
      from documents),
    sources as (select source, cast(sum(size) as bigint) as source_size from d group by source),
    weighed as (
      select *, {list(mixing.WEIGHTS)}[(row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} + 1] as w
      from sources),
    limited as (select *, {mixing.MOST} * source_size as most, ({mixing.MOST} * source_size)::double / w as ratio from weighed),
    levels as (
      select *, (sum(source_size) over () - coalesce(sum(most) over earlier, 0))::double
                / (sum(w) over () - coalesce(sum(w) over earlier, 0))::double as level
      from limited
      window earlier as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
    shared as (select arg_min(level, ratio) as level from levels where ratio > level),
    targets as (
      select source, source_size, least(most::double, coalesce(w * (select level from shared), 0.0)) as target from levels),
    placed as (
      select d.*, source_size, target, cast(round(target) as bigint) as budget,
             coalesce(sum(size) over (partition by d.source order by spot, d.doc_id, size
                                      rows between unbounded preceding and 1 preceding), 0) as before
      from d join targets t on d.source is not distinct from t.source)
    select doc_id, source, size, source_size, target,
           cast(case when source_size > 0
                     then size * (budget // source_size) + greatest(0, least(size, budget % source_size - before))
                     else 0 end as bigint) as taken
    from placed"""

_TOP = f"""
    with v as (
      select row_number() over () as q, vec_id, list_transform(embedding, lambda x: floor({nearest.SCALE} * x::double)) as v
      from embeddings
      where vec_id is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (
      select q.q, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
      from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0)
    select query_id, rank, vec_id, score from (
      select *, cast(row_number() over (partition by q order by score desc, vec_id) as int) as rank from pairs)
    where rank <= 5"""

_WARC = f"""
    with p as (
      select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
    o as (
      select *, row_number() over same > 1 and payload_bytes >= {warc.LEAST} as again, first_value(page_id) over same as first
      from p window same as (partition by payload_digest order by page_id nulls last))
    select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
           case when again then first end as refers_to
    from o"""

# The CRC-32 polynomial is a fixed value of its definition.
_CRC = """xor(list_reduce(string_split(cast(doc_id as varchar), ''), lambda crc, c:
      list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end,
                  xor(crc, cast(ascii(c) as bigint))), 4294967295), 4294967295)"""

_RUNS = f"""
    with d as (
      select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents),
    h as (
      select *, len(ws) as n, crc % 10 = 0 and len(ws) > 0 as changed, (crc // 10) % greatest(len(ws), 1) as a, (crc // 10) % 8 as m
      from (select d.*, c.crc from d left join crcs c using (doc_id))),
    w as (
      select rid, i, ws[1 + case when changed and i >= a then a + (i - a) % (1 + (n - a) // (3 + m)) else i end] as w, n
      from (select *, unnest(range(n)) as i from h)),
    equal as (
      select x.rid, y.i - x.i as q, x.i from w x join w y on x.rid = y.rid and x.w = y.w and y.i > x.i and {periodic.TIMES} * (y.i - x.i) <= x.n),
    islands as (
      select rid, q, min(i) as s, count(*) + q as len
      from (select *, i - row_number() over (partition by rid, q order by i) as g from equal) group by rid, q, g),
    runs as (
      select rid, s, len, min(q) as q from islands where len >= greatest({periodic.LEAST}, {periodic.TIMES} * q) group by rid, s, len),
    dropped as (select distinct rid, unnest(range(s + q, s + len)) as i from runs),
    listed as (
      select rid, count(*) as n_runs, arg_max(struct_pack(s := s, l := len, q := q), (len::double / q, -s, -q)) as best,
             string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines
      from runs group by rid),
    kept as (
      select rid, string_agg(w, ' ' order by i) as text from w anti join dropped using (rid, i) group by rid)
    select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.q as period,
           best.l * 1000 // best.q as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
           sha256(coalesce(kept.text, '')) as collapsed_sha256, n as n_words
    from h left join listed using (rid) left join kept using (rid)"""
_RUNS = _RUNS.replace("with d as", f"with crcs as (select distinct doc_id, {_CRC} as crc from documents),\n    d as", 1)

_AUDIT = f"""
    with f as (
      select coalesce(source, '') as part, doc_id,
             case when len(ws) < 50 then 'A' else '' end
             || case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end
             || case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 'C' else '' end
             || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
             || case when coalesce(doc_id > first, first is not null) then 'E' else '' end as fails
      from (select *, regexp_extract_all(text, {_WORD}) as ws, min(doc_id) over (partition by text) as first
            from (select doc_id, source, coalesce(text, '') as text from documents))),
    l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
    c as (
      select part, fails, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
      from f left join l using (doc_id) group by part, fails),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as (
      select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
      where length('ABCDE') = len(list_distinct([a.x, b.x, c.x, d.x, e.x]))),
    steps as (
      select filter_order, cast(step as int) as step, substr(filter_order, step, 1) as filter, substr(filter_order, 1, step - 1) as earlier
      from (select filter_order, unnest([1, 2, 3, 4, 5]) as step from orders)),
    cases as (
      select part, filter_order, step, filter, n, n_good, n_toxic, contains(fails, filter) as own,
             translate(fails, earlier, '') <> fails as before, fails = filter as alone
      from c cross join steps),
    figures as (
      select part, filter_order, step, filter,
             coalesce(sum(n) filter (not own and not before), 0) as kept, coalesce(sum(n) filter (own and not before), 0) as removed,
             coalesce(sum(n) filter (own and before), 0) as redundant, coalesce(sum(n) filter (alone), 0) as unique_fails,
             coalesce(sum(n_good) filter (own and not before), 0) as good_lost,
             coalesce(sum(n_toxic) filter (own and not before), 0) as toxic_lost
      from cases group by part, filter_order, step, filter)
    select part, filter_order, step, filter,
           {", ".join(f"cast({name} as bigint) as {name}" for name in audit.FIGURES[:-1])},
           cast(sum(removed) over (partition by part, filter) as bigint) as shapley
    from figures"""

ORACLES = {
    "op1_quality_rules": _quality(), "op2_mix_sources": _MIX, "op5_exact_top_k": _TOP,
    "op11_warc": _WARC, "op12_periodic_runs": _RUNS, "op13_filter_audit": _AUDIT,
}
