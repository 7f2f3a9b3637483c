"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import DIMS, MixingParams


def mixing_sql(p: MixingParams = MixingParams()) -> str:
    """Raking to powers of the present shares and calibration, each sweep of each dimension a step of its own."""
    steps: list[str] = []

    def sweeps(name: str, start: str, column: str, total: str, bounded: bool) -> str:
        at = start
        for k in range(p.sweeps):
            for d in DIMS:
                now = f"sum(tokens * {column}) over (partition by {d})"
                new = f"case when {now} > 0 then {column} * {d}_goal * {total} / {now} else {column} end"
                steps.append(f"{name}_{k}_{d} as (select * replace ({f'least(1.0, {new})' if bounded else new} as {column}) from {at})")
                at = f"{name}_{k}_{d}"
        return at

    goals = ", ".join(f"case when {d}_n > 0 then pow({d}_n / total.n, {p.alpha}) else 0 end / (select sum(pow(m.n / total.n, {p.alpha})) from (select sum(tokens) as n from cells group by {d}) m, total) as {d}_goal" for d in DIMS)
    own = ", ".join(f"sum(tokens) over (partition by {d}) as {d}_n" for d in DIMS)
    raked = sweeps("r", "started", "weight", "(select n from total)", False)
    aim = "(select n * most from most)"
    steps.append(f"most as materialized (select total.n, least(1.0, {', '.join(f'min(case when {d}_n > 0 and {d}_goal > 0 then {d}_n / {d}_goal end) / total.n' for d in DIMS)}) as most from {raked}, total group by total.n)")
    steps.append(f"begun as (select *, least(1.0, weight * (select most from most)) as probability from {raked})")
    last = sweeps("u", sweeps("b", "begun", "probability", aim, True), "probability", aim, False)
    steps.append(f"done as (select *, least(1.0, probability / greatest(1.0, (select max(probability) from {last} where tokens > 0)) * {p.rate}) as p from {last})")
    words = "[^\\x20\\x09-\\x0D]+"
    return f"""
with texts as (select doc_id, coalesce(text, '') as t, coalesce(source, '<null>') as source, coalesce(lang, '<null>') as lang, len(regexp_extract_all(coalesce(text, ''), '{words}'))::bigint as n_tokens from documents),
celled as (select doc_id, source, lang, n_tokens, case when (length(t) - length(replace(t, '|', ''))) * 10 > n_tokens then 'tabular' when (length(t) - length(replace(t, '!', ''))) * 4 > n_tokens then 'shouting' when n_tokens < 100 then 'short' else 'prose' end as topic from texts),
cells as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from celled group by all),
total as materialized (select greatest(sum(tokens), 1.0) as n from cells),
sums as (select *, {own} from cells),
started as (select sums.*, {goals}, 1.0::double as weight from sums, total),
{", ".join(steps)}
select doc_id, c.source, c.lang, c.topic, n_tokens, round(weight, 6) as weight, round(p, 6) as probability, ('0x' || substring(md5(coalesce(doc_id::varchar, '<null>') || ':{p.seed}'), 1, 8))::bigint / 4294967296.0 < p as sampled
from celled c join done on done.source = c.source and done.lang = c.lang and done.topic = c.topic
"""


SQL: dict[str, str] = {
    "op7_mix_to_targets": mixing_sql(),
    # sets of equal content are compared once; sets that reach the threshold share one of the rarest shingles of each
    "op10_setsketch_dedup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words),
sizes as (select doc_id, len(s)::bigint as n from sets),
classes as (select min(doc_id) as id, any_value(s) as s from (select doc_id, list_sort(s) as s from sets where len(s) > 0) group by md5(s::varchar)),
items as (select id, len(s) as n, unnest(s) as x from classes),
ranked as (select id, n, x, row_number() over (partition by id order by f, x) as k from items join (select x, count(*) as f from items group by 1) using (x)),
rare as (select id, n, x from ranked where k <= n - (4 * n + 4) // 5 + 1),
near as (select distinct a.id as a, b.id as b from rare a join rare b on a.x = b.x and a.id < b.id where a.n * 100 >= 80 * b.n and b.n * 100 >= 80 * a.n),
links as (select a, b from near join classes p on p.id = a join classes q on q.id = b where 100 * len(list_intersect(p.s, q.s)) >= 80 * (len(p.s) + len(q.s) - len(list_intersect(p.s, q.s)))),
dual as (select a, b from links union all select b, a from links),
reach(root, id) as (select id as root, id from classes union select root, b from reach join dual on a = id where b > root),
least_ as (select id, min(root) as c from (select * from reach) group by 1),
member as (select doc_id, min(doc_id) over (partition by md5(list_sort(s)::varchar)) as id from sets where len(s) > 0)
select d.doc_id, n as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept from sizes d left join member m on m.doc_id = d.doc_id left join least_ on least_.id = m.id
""",
}
