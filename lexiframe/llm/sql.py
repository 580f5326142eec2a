"""DuckDB statements for the pN_ queries that SQL can express."""

CALL = "coalesce(call_id, try_cast(nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^([0-9]+)', 1), '') as bigint))"

#: Words for the search of leaks: composed, small, without stress marks and invisible characters; apostrophes in words and points in numbers fall out.
CLEAN = r"regexp_replace(lower(nfc_normalize(lower({0}))), '[\x{301}\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g')"
for _ in range(2):  # twice: RE2 has no look-around, and matches take turns
    CLEAN = rf"regexp_replace({CLEAN}, '([\p{{L}}\p{{N}}\p{{M}}])[''’‘ʻʼ`´ʹ]+([\p{{L}}\p{{N}}\p{{M}}])', '\1\2', 'g')"
    CLEAN = rf"regexp_replace({CLEAN}, '(\p{{Nd}})[.,](\p{{Nd}})', '\1\2', 'g')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({CLEAN.replace('{0}', text).replace('{{0}}', text)}, '[\p{{L}}\p{{N}}\p{{M}}]+')"


ORACLES = {
    "p1_found": f"""
with recursive m as (
  select {CALL} as c, nullif(lead_id, 0) as l, lower(trim(split)) as s from manifest where lower(trim(split)) in (select split from split_targets)
), e as (select distinct c, l from m where l is not null),
low as (select c, min(l) as l from e group by c),
p as (select distinct e.l as a, low.l as b from e join low using (c) where e.l <> low.l),
both_ways as (select a, b from p union select b, a from p),
reach(l, x) as (select l, l from (select distinct l from e) union select reach.l, both_ways.b from reach join both_ways on both_ways.a = reach.x),
root as (select l, min(x) as r from reach group by l),
g as (select m.c, m.s, coalesce('l' || root.r, 'c' || m.c) as grp from m left join low on low.c = m.c left join root on root.l = low.l),
parted as (select grp from g group by grp having count(distinct s) > 1)
select distinct c as call_id from g where grp in (select grp from parted) and c is not null""",
    "p5_found": """
select distinct path from manifest, size_limits
where item = 'manifest' and path is not null and ((duration > max_seconds and not isnan(duration) and not isinf(duration)) or length(sentence) > max_chars)""",
    "p5_files": "select sum(length(text) + 1)::bigint as chars, true as within, 0::bigint as gaps from documents where text is not null",
    "p7_found": f"""
with r as (select {CALL} as call_id, path, nullif(lower(trim(direction)), '') as direction,
    case when duration > 0 and not isnan(duration) and not isinf(duration) then duration end as s from manifest),
p as (select call_id, path, max(s) as s, min(direction) as direction from r where call_id is not null group by call_id, path),
c as (select call_id, coalesce(min(direction), '?') as direction, round(coalesce(sum(cast(s as decimal(18, 6))), 0), 2)::double as s from p group by call_id),
n as (select count(*) // 10 as n from c)
select t.direction, t.bucket from sample_targets t, n
where (select count(*) from c where c.direction = t.direction and c.s >= t.min_seconds and (t.max_seconds is null or c.s < t.max_seconds))
    < greatest(t.min_calls, t.per_mille * n.n // 1000)""",
    "p8_found": "select distinct doc_id from documents, size_limits where item = 'documents' and strlen(text) + 1 > max_tokens",
    "p9_found": f"""
with l as (select 'i' as kind, item_id as id, {_words('passage')} as w from heldout_items where passage is not null union all select 'd', doc_id, {_words('text')} from documents where text is not null),
g as (select kind, id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) as g from l where len(w) >= 10)
select distinct a.id as item_id, b.id as doc_id from g a join g b using (g) where a.kind = 'i' and b.kind = 'd'""",
}
