"""SQL equivalents of training-data queries."""

from cardloom.functions.words import ACCENTED, PLAIN

_HOST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^([a-z][a-z0-9+.-]*:)?//', ''), '[/?#].*$', ''), '(:[0-9]*)?\.*$', ''), '^www[0-9]?\.', '')"""

_SITED = f"""
sited as (
  select c.*, p.site from evidence_cards c left join source_profiles p
  on p.site = coalesce(nullif({_HOST.format("c.source_domain")}, ''), nullif({_HOST.format("c.url")}, '')))
"""

_WORDS = rf"list_filter(string_split_regex(translate(regexp_replace(lower(text), '[̀-ͯ]', '', 'g'), '{ACCENTED}', '{PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_LEAKS = f"""
d as (select doc_id, {_WORDS} as w from documents where text is not null),
i as (select item_id, {_WORDS} as w from benchmark where text is not null),
dt as (select doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] as h from (select doc_id, w, unnest(range(len(w) - 2)) as p from d where len(w) >= 3)),
it as (select item_id, n, p as place, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] as h from (select item_id, w, len(w) as n, unnest(range(len(w) - 2)) as p from i where len(w) >= 5)),
hits as (select item_id, doc_id, n, place, p // greatest(1, n // 2) as win from it join dt using (h)),
spread as (select item_id, doc_id, n, place, unnest([win, greatest(0, win - 1)]) as win from hits),
marked as (select distinct item_id, doc_id, n, win, unnest([place, place + 1, place + 2]) as word from spread),
good as (select item_id, doc_id, n, win from marked group by all having count(*) >= 5),
held as (select item_id, doc_id, count(distinct word) / n as share from marked join good using (item_id, doc_id, n, win) group by item_id, doc_id, n)
"""

SQL: dict[str, str] = {
    "p7_found": f"with {_LEAKS} select item_id, doc_id from held where share >= 0.5",
    "p7_items": f"with {_LEAKS} select item_id, count(*) as documents, max(share) as most from held where share >= 0.5 group by 1",
    "p2_found": f"""
with {_SITED}, firsts as (
  select * from sited qualify row_number() over (partition by coalesce(id, 'row ' || ingest_idx) order by ingest_idx) = 1),
scored as (
  select ingest_idx, id, request_id, site, case when not isnan(credibility_score) and credibility_score between 0 and 1 then credibility_score end as score
  from firsts where request_id is not null),
sized as (select request_id, count(distinct id) as n from scored group by 1),
ranked as (
  select s.*, z.n, row_number() over (partition by s.request_id, s.site order by score desc nulls last, ingest_idx) as rk
  from scored s join sized z using (request_id) where site is not null)
select ingest_idx from ranked where rk > greatest(1, floor(n / 4))
""",
}
