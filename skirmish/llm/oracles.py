"""DuckDB SQL for the corpus queries that SQL can express."""

_SQL_NAME = "lower(regexp_replace(trim(regexp_replace({0}, ' +', ' ', 'g')), '[''`]s corpse$', '', 'i'))"


def _key(c: str) -> str:
    k = _SQL_NAME.format(c)
    return f"(case when {k} not like '% %' and length({k}) > 8 and {k} like '%scorpse' then left({k}, length({k}) - 7) else {k} end)"


def _term(c: str) -> str:
    return f"nullif(lower(trim(regexp_replace({c}, ' +', ' ', 'g'))), '')"


_ONCE = "(select * from combat_events qualify row_number() over (partition by log_id, line_no order by arrived_at) = 1)"

_P6 = f"""
with d as (select {_key('attacker')} as attacker, amount from {_ONCE} where action = 'damage' and amount > 0 and attacker is not null),
r as (select *, row_number() over (partition by attacker order by amount) as rn, count(*) over (partition by attacker) as n from d)
select r.attacker, p.pct, r.amount from r, (values (50), (90), (99)) p(pct)
where n >= 50 and rn = (p.pct * n + 99) // 100"""

ORACLES = {
    "p4_found": """
with b as (select * from sources qualify row_number() over (partition by log_id, enc_id, metric, fighter, category, source_name, pet order by revision desc, total desc nulls last) = 1),
r as (select *, row_number() over (partition by log_id, enc_id, metric order by total desc, fighter, category, source_name, coalesce(pet, '')) as rank_no from b where total is not null)
select log_id, enc_id, metric, fighter, category, source_name, coalesce(pet, '') as pet, rank_no from r where rank_no <= 5""",
    "p5_found": f"""
with e as (select log_id, enc_id, {_term('spell')} as spell, {_term('verb')} as verb from {_ONCE}),
t as (select 'spell' as field, spell as term, log_id, enc_id from e where spell is not null union all select 'verb', verb, log_id, enc_id from e where verb is not null),
a as (select count(*) as n from (select distinct log_id, enc_id from combat_events where enc_id is not null and log_id is not null)),
c as (select field, term, count(*) as n_events, count(distinct case when enc_id is not null then log_id || chr(1) || enc_id end) as n_encounters from t group by 1, 2)
select field, term, n_events, n_encounters, case when n_encounters < 3 then 'rare' when n_encounters > (select n from a) * 0.1 then 'common' else 'kept' end as mark from c""",
    "p6_found": _P6,
    "p6_merged_logs": _P6,
    "p8_planted": """
with i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
g as (select item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda s: list_aggregate(w[s:s + 11], 'string_agg', ' '))) as gram from i),
d as (select item_id * 100 + n as doc_id, w[(item_id + n) % greatest(len(w) - 12, 1) + 1:(item_id + n) % greatest(len(w) - 12, 1) + n] as w from i, range(30) t(n)),
e as (select doc_id, list_concat(list_concat(['planted', 'words'], w), ['planted', 'end']) as w from d),
h as (select doc_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda s: list_aggregate(w[s:s + 11], 'string_agg', ' '))) as gram from e)
select distinct doc_id, item_id from h join g using (gram)""",
    "p9_planted": """
select p_partkey as doc_id, unnest(['Part no. ' || p_partkey || ' is the ' || p_name || '.', 'Dr. Vexa paid 3.5 coins for it!', '"Where is it?" asked Bron.', '昨夜届いた。']) as sentence from part""",
    "p7_check": "select count(distinct doc_id) as n_messages, 0 as cut_but_fit, 0 as overfull, 0 as empty from documents",
    # the fewest containers that hold this sum
    "p7_quantities": """select count(*) as n_items, cast(sum(floor(l_quantity)) as bigint) as total, 120 as fullest, cast(ceil(sum(floor(l_quantity)) / 120) as bigint) as n_containers from lineitem""",
}
