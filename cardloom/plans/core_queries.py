"""Queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import dimensions, privacy, quantities, text, urls, words
from cardloom.operators import claims, evidence, near_duplicates, neighbours, summaries
from cardloom.operators.normalise_time import changed_times
from cardloom.sources.tables import table
from cardloom.streaming import costs

REQUIRED = ["id", "url", "title", "snippet", "provider", "claim", "collected_at"]
SCORES = ["credibility_score", "relevance_score"]
GROUP_TOP = 3

_VALID = "case when {0} is not null and not isnan({0}) and {0} between 0 and 1 then {0} end"
_CRED, _CONF, _REL = (_VALID.format(c) for c in ("credibility_score", "confidence", "relevance_score"))
_DOMAIN = r"coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]+$', ''), '^www\.', ''), ''), 'unknown')"
_CLAIM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_TOKENS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
_MASKED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\b(?:19|20)\d{{2}}\b', 'year', 'g'), '\d+(?:[.,]\d+)*\s*(?:%|percent)', 'pct', 'g'), '\d+(?:[.,]\d+)*', 'num', 'g'), '\s+', ' ', 'g'))"
_FIRST_COSTS = "(select * from cost_records qualify row_number() over (partition by id order by recorded_at) = 1)"


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_UNIT_ROWS = ", ".join(f"('{w}', {r}, '{u}')" for w, (r, u) in quantities.UNITS.items())
_PART_ROWS = ", ".join(f"('{w}', {r}, '{c}')" for w, (r, c) in quantities.PARTS.items())


def _quantity_sql(source: str, text_column: str) -> str:
    """Common table expressions ``quantity`` (ingest_idx, value, unit) and ``span`` (ingest_idx, period) of a text column."""
    low = f"lower(coalesce({text_column}, ''))"
    return rf"""units(word, rank, unit) as (values {_UNIT_ROWS}), parts(word, rank, code) as (values {_PART_ROWS}),
    said as (select ingest_idx, unnest(regexp_extract_all({low}, '{quantities.NUMBER}', 1)) as n, unnest(regexp_extract_all({low}, '{quantities.NUMBER}', 2)) as w,
      unnest(range(len(regexp_extract_all({low}, '{quantities.NUMBER}', 1)))) as place from {source}),
    rated as (select ingest_idx, place, cast(replace(n, ',', '') as double) as value, unit, coalesce(rank, case when regexp_matches(w, '^\S') then null when contains(n, ',') then 7 when not regexp_full_match(n, '20\d\d') then 8 end) as rank
      from said left join units on word = regexp_replace(trim(w), '\s+', ' ', 'g')),
    quantity as (select ingest_idx, value, unit from rated where rank is not null qualify row_number() over (partition by ingest_idx order by rank, place) = 1),
    named as (select ingest_idx, unnest(regexp_extract_all({low}, '{quantities.PERIOD}', 1)) as p0, unnest(regexp_extract_all({low}, '{quantities.PERIOD}', 2)) as y,
      unnest(range(len(regexp_extract_all({low}, '{quantities.PERIOD}', 1)))) as place from {source}),
    span as (select ingest_idx, trim(code || ' ' || y) as period from (select *, coalesce(p0, '') as p from named) join parts
      on word = case when regexp_matches(p, '[-–]') then regexp_replace(p, '^.*[-–]\s*', '')[1:3] else regexp_replace(p, '\s+', ' ', 'g') end
      qualify row_number() over (partition by ingest_idx order by rank, place) = 1)"""


SqlQuery = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_cards")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_times(_cards(spark, sf_dir), table(spark, sf_dir, "source_profiles"))


def _url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _cards(spark, sf_dir).select("ingest_idx", urls.canonical_url(url).alias("canonical"), urls.domain(url).alias("domain"), F.sha1(urls.canonical_url(url)).alias("url_id"))


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.first_per_work(_cards(spark, sf_dir))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = text.normalised_claim(F.col("claim"))
    return _cards(spark, sf_dir).select("ingest_idx", F.sha2(claim, 256).alias("claim_hash"), F.substring(F.md5(claim), 1, 8).alias("claim_id"), F.substring(F.md5(claim), 1, 16).alias("long_id"))


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = F.col("claim")
    return _cards(spark, sf_dir).select(
        "ingest_idx", text.masked_numbers(claim).alias("masked"), F.array_join(text.without_stop_words(text.tokens(claim)), " ").alias("content_words"), text.truncated(claim, 40).alias("short"),
        F.array_join(text.number_tokens(claim), " ").alias("numbers"), F.round(text.jaccard(F.array_distinct(text.tokens(claim)), F.array_distinct(text.tokens(F.col("title")))), 6).alias("title_overlap"),
    )


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, unit = quantities.number_with_unit(F.col("claim"))
    return _cards(spark, sf_dir).select("ingest_idx", F.round(value, 6).alias("value"), F.coalesce(unit, F.lit("")).alias("unit"))


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cards(spark, sf_dir).select("ingest_idx", quantities.period(F.col("title")).alias("period"))


def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.backfilled(_cards(spark, sf_dir))
    return out.select("ingest_idx", "claim", "source_domain", F.md5("snippet").alias("snippet_md5"), F.length("supporting_text").alias("supporting_length"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.with_errors(_cards(spark, sf_dir))
    return out.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("cards"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "text", "lang")
    return docs.groupBy(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"), text.language_guess(F.col("text")).alias("guess")).agg(F.count(F.lit(1)).alias("documents"))


def _on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose claim shares at least a tenth of its words with the topic of their request."""
    topics = summaries.first_delivery(table(spark, sf_dir, "research_requests").select("id", "topic", "created_at"), "id", "created_at").select(F.col("id").alias("request_id"), F.col("topic").alias("wanted"))
    joined = _cards(spark, sf_dir).select("ingest_idx", "request_id", "claim").join(topics, "request_id")
    overlap = text.jaccard(F.array_distinct(text.tokens(F.col("claim"))), F.array_distinct(text.tokens(F.col("wanted"))))
    return joined.withColumn("overlap", F.round(overlap, 6)).where(F.col("overlap") >= 0.1).select("ingest_idx", "overlap")


def _events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of events: per hour and type."""
    ev = table(spark, sf_dir, "events", "ts", "event_type", "value")
    return ev.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join: line items are summed per supplier and year before they meet the dimensions."""
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    partial = lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10_000).cast("long")).alias("r"), F.count(F.lit(1)).alias("n"))
    named = partial.join(table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = named.join(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name", "year").agg((F.sum("r") / 10_000).alias("revenue"), F.sum("n").alias("lines"))


def _numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.numeric_claims(_cards(spark, sf_dir)).groupBy("unit", "period").agg(F.count(F.lit(1)).alias("claims"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"))


_CLAIMS = rf"""{_quantity_sql('evidence_cards', 'claim')},
claims as (select ingest_idx, {_DOMAIN} as domain, {_MASKED.format('claim')} as metric, coalesce(unit, '') as unit, period, value from evidence_cards join quantity using (ingest_idx) join span using (ingest_idx))"""
_CANONICAL = f"""
with parts as (
  select ingest_idx, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') as base, url,
    list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'),
      lambda p: p <> '' and lower(string_split(p, '=')[1]) not in ({_sql_list(urls.TRACKING)}))) as kept
  from evidence_cards),
built as (select ingest_idx, url, case when len(kept) > 0 then base || '?' || array_to_string(kept, '&') else base end as u from parts),
done as (select ingest_idx, url, regexp_replace(regexp_replace(u, '\\?.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/.*?)/+$', '\\1') || regexp_extract(u, '(\\?.*)$', 1) as canonical from built)
select ingest_idx, canonical, {_DOMAIN} as domain, sha1(canonical) as url_id from done
"""

_MIRROR_SQL = " ".join(f"when '{a}' then '{b}'" for a, b in urls.MIRRORS.items())
_REGISTRY_SQL = " ".join(
    f"when ({' or '.join(f"(host = '{h}' or ends_with(host, '.{h}'))" for h in hosts)}) and regexp_matches(url, '{pattern}') then '{prefix}:' || {'upper' if prefix == 'crs' else ''}(regexp_extract(url, '{pattern}', 1))"
    for prefix, hosts, pattern in urls.REGISTRIES
)
_DOI_SQL = r"nullif(regexp_replace(lower(regexp_extract(coalesce({0}, ''), '(10\.\d{{4,9}}/[^\s?#&\"<>]+)', 1)), '[.,;]+$', ''), '')"
_WORKS = rf"""with h as (select *, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as full_host from evidence_cards),
p as (select *, regexp_replace(full_host, ':[0-9]+$', '') as host from h),
w as (select ingest_idx, coalesce('doi:' || coalesce({_DOI_SQL.format('doi')}, {_DOI_SQL.format('url')}), case {_REGISTRY_SQL} end,
  lower('url:' || case full_host {_MIRROR_SQL} else full_host end || regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(?:/+|\.pdf)*$', ''))) as work from p)
select work, min(ingest_idx) as ingest_idx, count(*) as cards from w group by 1"""

_NEIGHBOURS = """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where embedding is not null),
s as (select q.vec_id as query_id, b.vec_id, round(coalesce(list_dot_product(q.v, b.v) / nullif(sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0), 6) as similarity
  from e q join e b on b.vec_id <> q.vec_id where q.vec_id % 100 = 0)
select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s qualify rank <= 5"""


def _near_sql(rows: str) -> str:
    """Classes of texts with a shingle similarity of 0.8 among ``rows`` (doc_id, text), by the definition: all pairs that share a shingle."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(5))
    return rf"""with recursive e as (select doc_id, min(doc_id) over (partition by text) as class_id, text from ({rows}) where text is not null),
    t as (select doc_id, list_filter(string_split_regex(translate(lower(text), '{words.ACCENTED}', '{words.PLAIN}'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from e where doc_id = class_id),
    s as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: {run})) as h from t where len(w) >= 5),
    n as (select doc_id, count(*) as n from s group by 1),
    p as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.h = y.h and x.doc_id < y.doc_id group by 1, 2),
    q as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where i >= 0.8 * (x.n + y.n - i)),
    both_ways as (select a, b from q union all select b, a from q),
    reach(node, other) as (select a, b from both_ways union select r.node, k.b from reach r join both_ways k on k.a = r.other),
    roots as (select node, least(node, min(other)) as root from reach group by node), links as (select a as node, count(*) as links from both_ways group by 1)
    select doc_id, coalesce(root, class_id) as class_id, coalesce(links, 0) as links from e left join roots r on r.node = class_id left join links l on l.node = class_id"""


def _structured(spark: SparkSession, sf_dir: str, source: str = "claim") -> DataFrame:
    return claims.structured_claims(_cards(spark, sf_dir), source)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user's events, at most ten minutes apart."""
    events = table(spark, sf_dir, "events", "user_id", "ts")
    own = costs.sessions(events, "user_id", "ts")
    return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


def _extra_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.coalesce(F.col("best_quote"), F.col("snippet"))
    return _cards(spark, sf_dir).select(
        "ingest_idx", F.md5(text.without_quotes(quote)).alias("bare_md5"), privacy.pseudonym(F.col("author")).alias("author_key"), F.round(text.numeric_density(F.col("claim")), 6).alias("density"), dimensions.direction(F.col("claim")).alias("direction")
    )


def _names_sql(names: dict[str, str], text_column: str) -> str:
    """(ingest_idx, name): the canonical name of the longest alias that stands in a text column."""
    rows = ", ".join(f"({k}, '{a.replace("'", "''")}', '{n}')" for k, (a, n) in enumerate(names.items()))
    low = f"lower(trim(coalesce({text_column}, '')))"
    spaced = rf"' ' || regexp_replace({low}, '[^\p{{L}}\p{{N}}.&''-]+|[.''-]+(?:\s|$)', ' ', 'g') || ' '"
    return f"""select ingest_idx, n.name from evidence_cards join (values {rows}) n(rank, alias, name) on contains({spaced}, ' ' || n.alias || ' ')
    qualify row_number() over (partition by ingest_idx order by n.rank) = 1"""


_STRUCTURED = f"""{_quantity_sql('evidence_cards', 'claim')}, entity as ({_names_sql(dimensions.ENTITIES, 'claim')}), metric as ({_names_sql(dimensions.METRICS, 'claim')}),
pieces as (select ingest_idx, {_DOMAIN} as domain, entity.name as entity, coalesce(metric.name, nullif({_MASKED.format('claim')}, '')) as metric, period, value, unit
  from evidence_cards left join entity using (ingest_idx) left join metric using (ingest_idx) left join span using (ingest_idx) left join quantity using (ingest_idx)),
structured as (select *, case when metric is not null and (entity is not null or period is not null) then concat_ws('|', entity, metric, period) end as key from pieces)"""
_PRIMARY = "(coalesce(case {0} " + " ".join(f"when '{a}' then '{b}'" for a, b in dimensions.PRIMARY_HOSTS.items()) + " end, {0}) in (" + _sql_list(sorted(set(dimensions.PRIMARY_HOSTS.values()))) + r") or regexp_matches({0}, '\.(?:gov|edu|int|mil)(?:\.[a-z]{{2}})?$'))"
_HOST_TESTS = [(f, f"ends_with({{0}}, '{h}')" if h[0] == "." else f"({{0}} = '{h}' or ends_with({{0}}, '.{h}'))") for f, hosts in dimensions.FAMILIES.items() for h in hosts]
_FAMILY = "case " + " ".join(f"when {test} then '{f}'" for f, test in _HOST_TESTS) + " else 'other' end"
_TWO = f"list_contains([{_sql_list(urls.TWO_PART)}], array_to_string(string_split({{0}}, '.')[-2:], '.'))"
_REGISTRABLE = f"array_to_string(string_split({{0}}, '.')[-(case when {_TWO} then 3 else 2 end):], '.')"
_WORDS_OF = "string_split_regex(lower(coalesce({0}, '')), '[^a-z]+')"
_SIDES = f"(list_has_any({_WORDS_OF}, [{_sql_list(dimensions.RISING)}])::int - list_has_any({_WORDS_OF}, [{_sql_list(dimensions.FALLING)}])::int)"


_FACTOR = "(case unit " + " ".join(f"when '{u}' then {f}" for u, f in quantities.SCALES.items()) + " else 1.0 end)"


def _agreeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.agreement(_structured(spark, sf_dir))


QUERIES: dict[str, SqlQuery] = {
    "source_quality": (
        lambda s, d: summaries.source_quality(_cards(s, d)),
        f"""select coalesce(source_domain, 'unknown') as domain, count(*) as total_cards, count(distinct coalesce(claim, snippet, title)) as unique_claims,
        round(avg(coalesce({_CRED}, 0.5)), 9) as avg_credibility, round(avg(coalesce({_CONF}, 0.5)), 9) as avg_confidence, min(date) as first_seen, max(date) as last_seen,
        count(distinct provider) as provider_count, round(count(distinct coalesce(claim, snippet, title)) / count(*), 4) as uniqueness_ratio from evidence_cards group by 1""",
    ),
    "claim_triangulation": (
        lambda s, d: summaries.claim_triangulation(_cards(s, d)),
        """with c as (select claim, count(*) as n, count(distinct source_domain) as domains from evidence_cards where claim is not null group by 1 having count(*) >= 2)
        select count(*) as total_claims, count(*) filter (domains >= 2) as on_two, count(*) filter (domains >= 3) as on_three, round(avg(domains), 4) as avg_domains, max(domains) as max_domains from c""",
    ),
    "evidence_counts": (
        lambda s, d: summaries.evidence_counts(_cards(s, d)),
        "select count(*) as cards, count(distinct source_domain) as source_domains, count(distinct provider) as providers, count(distinct claim) as claims, count(distinct request_id) as request_ids from evidence_cards",
    ),
    "quality_stats": (
        lambda s, d: summaries.quality_stats(_cards(s, d)),
        f"select round(avg(s), 6) as mean, round(stddev_samp(s), 6) as deviation, round(quantile_cont(s, 0.5), 6) as median, round(avg(f), 6) as confidence from (select {_CRED} as s, {_CONF} as f from evidence_cards)",
    ),
    "provider_distribution": (
        lambda s, d: summaries.distribution(_cards(s, d), "provider", 10),
        f"select provider, count(*) as cards, round(avg({_CRED}), 9) as avg_credibility from evidence_cards group by 1 order by 2 desc, 1 limit 10",
    ),
    "domain_distribution": (
        lambda s, d: summaries.distribution(_cards(s, d), "source_domain", 10),
        f"select source_domain, count(*) as cards, round(avg({_CRED}), 9) as avg_credibility from evidence_cards group by 1 order by 2 desc, 1 nulls last limit 10",
    ),
    "discipline_distribution": (
        lambda s, d: summaries.distribution(_cards(s, d), "discipline"),
        f"select discipline, count(*) as cards, round(avg({_CRED}), 9) as avg_credibility from evidence_cards group by 1",
    ),
    "stated_days": (
        lambda s, d: summaries.stated_days(_cards(s, d)),
        r"select min(d) as first_day, max(d) as last_day, count(distinct d) as days, count(d) as cards from (select case when regexp_full_match(date, '\d{4}-\d{2}-\d{2}') then date end as d from evidence_cards)",
    ),
    "schema_report": (
        lambda s, d: summaries.schema_report(_cards(s, d), REQUIRED, SCORES),
        " union all ".join(
            f"select '{c}' as column, count(*) as rows, count({c}) as filled, round(count({c}) / count(*), 4) as coverage, count({_VALID.format(c) if c in SCORES else c}) as in_range from evidence_cards" for c in [*REQUIRED, *SCORES]
        ),
    ),
    "cost_by_day": (
        lambda s, d: summaries.cost_rollup(table(s, d, "cost_records")),
        f"select date_trunc('day', recorded_at) as period, provider, operation, count(*) as records, round(sum(cost_usd), 6) as cost, sum(units) as units, count(*) filter (cost_usd < 0) as negative from {_FIRST_COSTS} group by 1, 2, 3",
    ),
    "running_cost": (
        lambda s, d: summaries.running_cost(table(s, d, "cost_records")),
        f"""with daily as (select provider, strftime(recorded_at, '%Y-%m-%d') as day, sum(cost_usd) as c from {_FIRST_COSTS} group by 1, 2)
        select provider, day, round(c, 6) as cost, round(sum(c) over (partition by provider order by day rows unbounded preceding), 6) as total,
        round(avg(c) over (partition by provider order by day rows between 6 preceding and current row), 6) as week_mean from daily""",
    ),
    "requests_with_counts": (
        lambda s, d: summaries.requests_with_counts(table(s, d, "research_requests"), _cards(s, d), table(s, d, "cost_records")),
        f"""with h as (select id, min(evidence_count) as stored, min(lower(status)) as status from research_requests group by 1),
        c as (select request_id, count(*) as cards from (select * from evidence_cards qualify row_number() over (partition by id order by ingest_idx) = 1) where request_id is not null group by 1),
        k as (select request_id, round(sum(cost_usd), 6) as cost from {_FIRST_COSTS} where request_id is not null group by 1)
        select h.id as request_id, h.status, h.stored, coalesce(c.cards, 0) as cards, coalesce(k.cost, 0.0) as cost from h left join c on c.request_id = h.id left join k on k.request_id = h.id""",
    ),
    "url_forms": (_url_forms, _CANONICAL),
    "works": (_works, _WORKS),
    "claim_hashes": (
        _hashes,
        f"select ingest_idx, sha256({_CLAIM.format('claim')}) as claim_hash, md5({_CLAIM.format('claim')})[1:8] as claim_id, md5({_CLAIM.format('claim')})[1:16] as long_id from evidence_cards",
    ),
    "text_scalars": (
        _scalars,
        rf"""select ingest_idx, {_MASKED.format('claim')} as masked, array_to_string(list_filter({_TOKENS.format('claim')}, lambda w: w not in ({_sql_list(text.STOP_WORDS)})), ' ') as content_words,
        case when length(claim) > 40 then claim[1:37] || '...' else claim end as short, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(claim, ''), '(\d+(?:[.,]\d+)*)', 1))), ' ') as numbers,
        round(case when len(list_distinct(list_concat({_TOKENS.format('claim')}, {_TOKENS.format('title')}))) = 0 then 0.0
        else len(list_intersect(list_distinct({_TOKENS.format('claim')}), list_distinct({_TOKENS.format('title')}))) / len(list_distinct(list_concat({_TOKENS.format('claim')}, {_TOKENS.format('title')}))) end, 6) as title_overlap from evidence_cards""",
    ),
    "claim_numbers": (_numbers, f"with {_quantity_sql('evidence_cards', 'claim')} select ingest_idx, round(value, 6) as value, coalesce(unit, '') as unit from evidence_cards left join quantity using (ingest_idx)"),
    "title_periods": (_periods, f"with {_quantity_sql('evidence_cards', 'title')} select ingest_idx, period from evidence_cards left join span using (ingest_idx)"),
    "backfilled_cards": (
        _backfill,
        f"""select ingest_idx, coalesce(nullif(claim, ''), nullif(title, ''), nullif(snippet, ''), '')[1:2000] as claim, coalesce(nullif(source_domain, ''), nullif({_DOMAIN}, ''), '') as source_domain,
        md5(coalesce(nullif(snippet, ''), nullif(best_quote, ''), nullif(supporting_text, ''), nullif(claim, ''), nullif(title, ''), '')[1:500]) as snippet_md5,
        length(coalesce(nullif(supporting_text, ''), nullif(snippet, ''), nullif(claim, ''), nullif(title, ''), '')[1:5000]) as supporting_length from evidence_cards""",
    ),
    "card_errors": (
        _errors,
        f"""with e as (select unnest([case when not coalesce(regexp_full_match(id, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}'), false) then 'id' end,
        case when not coalesce(regexp_matches(url, '^https?://'), false) then 'url' end, case when coalesce(trim(title), '') = '' then 'title' end, case when coalesce(trim(snippet), '') = '' then 'snippet' end,
        case when provider is null then 'provider' end, case when ({_CRED}) is null then 'credibility_score' end, case when ({_REL}) is null then 'relevance_score' end,
        case when coalesce(stance, 'neutral') <> 'neutral' and claim_id is null then 'stance_without_claim_id' end]) as error from evidence_cards)
        select error, count(*) as cards from e where error is not null group by 1""",
    ),
    "best_per_claim": (
        lambda s, d: evidence.best_per_key(_cards(s, d), F.nullif(text.normalised_claim(F.col("claim")), F.lit(""))),
        f"""with k as (select nullif({_CLAIM.format('claim')}, '') as key, ingest_idx, {_CRED} as s from evidence_cards),
        r as (select key, ingest_idx, row_number() over (partition by key order by s desc nulls last, ingest_idx) as rk, count(*) over (partition by key) as copies from k where key is not null)
        select key, ingest_idx, copies from r where rk = 1""",
    ),
    "syndicated_texts": (
        lambda s, d: evidence.syndicated(_cards(s, d)),
        f"""select sha256({_CLAIM.format('snippet')})[1:16] as hash, count(*) as cards, count(distinct {_DOMAIN}) as domains from evidence_cards where {_CLAIM.format('snippet')} <> '' group by 1 having count(distinct {_DOMAIN}) > 1""",
    ),
    "ranked_cards": (
        lambda s, d: evidence.ranked(_cards(s, d)),
        f"""select ingest_idx, round(least(1.0, case when coalesce(is_primary_source, false) then b * 1.05 else b end), 6) as score
        from (select ingest_idx, is_primary_source, cast(0.6 as double) * coalesce({_REL}, cast(0.5 as double)) + cast(0.3 as double) * coalesce({_CRED}, cast(0.5 as double)) + cast(0.05 as double) as b from evidence_cards)""",
    ),
    "top_per_request": (
        lambda s, d: evidence.top_per_group(_cards(s, d), "request_id", GROUP_TOP),
        f"select request_id, ingest_idx, rank from (select request_id, ingest_idx, row_number() over (partition by request_id order by {_CRED} desc nulls last, ingest_idx) as rank from evidence_cards) where rank <= {GROUP_TOP}",
    ),
    "provider_diversity": (
        lambda s, d: evidence.provider_diversity(_cards(s, d)),
        """with c as (select count(*) as n from evidence_cards where provider is not null group by provider), t as (select sum(n) as t, count(*) as k, max(n) as m from c),
        h as (select -sum(n / t * log2(n / t)) as bits from c, t)
        select k as providers, round(bits, 6) as bits, round(bits * ln(2), 6) as nats, round(case when k > 1 then bits / log2(k) else 0.0 end, 6) as evenness, round(m / t, 6) as top_share from t, h""",
    ),
    "numeric_claims": (_numeric_claims, f"with {_CLAIMS} select unit, period, count(*) as claims, round(min(value), 4) as low, round(max(value), 4) as high from claims group by 1, 2"),
    "numeric_consensus": (
        lambda s, d: evidence.consensus(evidence.numeric_claims(_cards(s, d))),
        f"""with {_CLAIMS}, middle as (select metric, unit, period, quantile_cont(value, 0.5) as median, count(*) as n, count(distinct domain) as domains, min(value) as low, max(value) as high from claims group by 1, 2, 3 having count(*) >= 2),
        votes as (select metric, unit, period, count(*) filter (abs(value - median) <= 0.03 * greatest(abs(median), 1e-9)) as support from claims join middle using (metric, unit, period) group by 1, 2, 3)
        select metric, unit, period, round(median, 6) as median, n as values, support, n - support as dissent, domains, support >= 2 and domains >= 2 and support * 2 >= n as triangulated,
        high - low > 0.1 * greatest(abs(high), abs(low), 1.0) as conflict from middle join votes using (metric, unit, period)""",
    ),
    "text_statistics": (
        lambda s, d: evidence.text_statistics(_cards(s, d)).drop("language"),
        f"""select ingest_idx, length(coalesce(supporting_text, '')) as characters, len({_TOKENS.format('supporting_text')}) as words, len(regexp_extract_all(coalesce(supporting_text, ''), '[.!?]+')) as sentences,
        len(list_distinct({_TOKENS.format('supporting_text')})) as distinct_words from evidence_cards""",
    ),
    "languages": (
        _languages,
        f"""with t as (select coalesce(lower(lang), 'none') as lang, {_TOKENS.format('text')} as w from documents),
        n as (select lang, {", ".join(f"len(list_filter(w, lambda x: x in ({_sql_list(own)}))) as n_{k}" for k, own in text.LANGUAGE_WORDS.items())} from t)
        select lang, case when greatest(n_en, n_es, n_fr, n_de) = 0 or n_en = greatest(n_en, n_es, n_fr, n_de) then 'en' when n_es = greatest(n_en, n_es, n_fr, n_de) then 'es'
        when n_fr = greatest(n_en, n_es, n_fr, n_de) then 'fr' else 'de' end as guess, count(*) as documents from n group by 1, 2""",
    ),
    "reading_ease": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.round(text.reading_ease(F.col("text")), 4).alias("ease")),
        """with t as (select doc_id, coalesce(text, '') as text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '') as w from documents),
        n as (select doc_id, len(w) as n, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) as e, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))))) as s from t)
        select doc_id, round(case when n = 0 then 0.0 else greatest(0.0, least(100.0, cast(206.835 as double) - cast(1.015 as double) * n / e - cast(84.6 as double) * s / n)) end, 4) as ease from n""",
    ),
    "top_phrases": (
        lambda s, d: evidence.phrases(_cards(s, d)),
        f"""with w as (select ingest_idx, list_filter({_TOKENS.format('claim')}, lambda x: not regexp_full_match(x, '[0-9]+') and x not in ({_sql_list(text.STOP_WORDS)})) as w from evidence_cards),
        p as (select unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as phrase from w where len(w) >= 2)
        select phrase, count(*) as texts from p group by 1 order by 2 desc, 1 limit 20""",
    ),
    "triangulated_union": (
        lambda s, d: evidence.triangulated_union(_cards(s, d)),
        f"""with r as (select ingest_idx, {_DOMAIN} as domain, 'claim' as kind, {_CLAIM.format('claim')} as key from evidence_cards
        union all select ingest_idx, {_DOMAIN}, 'cluster', lower(trim(cluster_id)) from evidence_cards where coalesce(trim(cluster_id), '') <> ''),
        g as (select kind, key from r where key <> '' group by 1, 2 having count(distinct domain) >= 2),
        t as (select count(distinct ingest_idx) as triangulated from r join g using (kind, key))
        select triangulated, (select count(*) from evidence_cards) as cards, round(triangulated / (select count(*) from evidence_cards), 6) as rate from t""",
    ),
    "on_topic_cards": (
        _on_topic,
        f"""with q as (select id, topic from research_requests qualify row_number() over (partition by id order by created_at) = 1),
        j as (select ingest_idx, list_distinct({_TOKENS.format('claim')}) as a, list_distinct({_TOKENS.format('q.topic')}) as b from evidence_cards c join q on q.id = c.request_id),
        o as (select ingest_idx, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as overlap from j)
        select ingest_idx, overlap from o where overlap >= 0.1""",
    ),
    "events_by_hour": (
        _events_sessions,
        "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    ),
    "exact_copies": (
        lambda s, d: near_duplicates.exact_classes(table(s, d, "documents", "doc_id", "text")),
        "select doc_id, min(doc_id) over (partition by text) as class_id, count(*) over (partition by text) as copies from documents where text is not null",
    ),
    "near_duplicates": (lambda s, d: near_duplicates.near_duplicate_classes(table(s, d, "documents", "doc_id", "text")), _near_sql("select doc_id, text from documents")),
    "vector_neighbours": (lambda s, d: neighbours.nearest(table(s, d, "embeddings", "vec_id", "embedding"), 5), _NEIGHBOURS),
    "claim_sentences": (
        lambda s, d: evidence.claim_sentences(_cards(s, d)),
        r"""with p as (select ingest_idx, unnest(string_split_regex(coalesce(supporting_text, ''), '[.!?]\s+|\n+')) as s, generate_subscripts(string_split_regex(coalesce(supporting_text, ''), '[.!?]\s+|\n+'), 1) - 1 as position from evidence_cards),
        r as (select ingest_idx, position, trim(s) as sentence, row_number() over (partition by ingest_idx order by case when regexp_matches(s, '\b(19|20)\d{2}\b') then 0 else 1 end, position) as rk from p where regexp_matches(s, '[0-9]'))
        select ingest_idx, position, sentence from r where rk <= 2""",
    ),
    "tone": (
        lambda s, d: evidence.tone(_cards(s, d)),
        f"""with t as (select ingest_idx, {_TOKENS.format('supporting_text')} as w from evidence_cards)
        select ingest_idx, round(case when len(w) = 0 then 0.0 else len(list_filter(w, lambda x: x in ({_sql_list(text.POSITIVE)}))) / len(w) end, 6) as positive,
        round(case when len(w) = 0 then 0.0 else len(list_filter(w, lambda x: x in ({_sql_list(text.NEGATIVE)}))) / len(w) end, 6) as negative from t""",
    ),
    "stances": (
        lambda s, d: evidence.stances(_cards(s, d)),
        """select claim_id, count(*) filter (stance = 'supports') as supports, count(*) filter (stance = 'disputes') as disputes, count(*) filter (stance = 'neutral') as neutral, count(*) as cards,
        round(count(*) filter (stance = 'disputes') / count(*), 6) as disputed from evidence_cards where claim_id is not null group by 1""",
    ),
    "stance_totals": (
        lambda s, d: evidence.stance_totals(_cards(s, d)),
        f"select discipline, stance, count(*) as cards, count(distinct {_DOMAIN}) as domains from evidence_cards group by 1, 2",
    ),
    "numeric_disagreements": (
        lambda s, d: evidence.numeric_disagreements(evidence.numeric_claims(_cards(s, d))).select("metric", "unit", "period", "domains"),
        f"""with {_CLAIMS}, sides as (select metric, unit, period, domain, min(value) as lo, max(value) as hi from claims group by 1, 2, 3, 4)
        select metric, unit, period, (select count(*) from sides s where s.metric = a.metric and s.unit = a.unit and s.period = a.period) as domains from sides a join sides b using (metric, unit, period)
        where a.domain <> b.domain and b.hi - a.lo > 0.1 * greatest(abs(b.hi), abs(a.lo), 1.0) group by metric, unit, period""",
    ),
    "sites_without_cards": (
        lambda s, d: table(s, d, "source_profiles", "site").subtract(_cards(s, d).select(urls.domain(F.col("url")).alias("site"))),
        f"select site from source_profiles except select {_DOMAIN} from evidence_cards",
    ),
    "sites_in_both": (
        lambda s, d: table(s, d, "source_profiles", "site").intersect(_cards(s, d).select(urls.domain(F.col("url")).alias("site"))),
        f"select site from source_profiles intersect select {_DOMAIN} from evidence_cards",
    ),
    "claim_classes": (lambda s, d: near_duplicates.near_duplicate_classes(_cards(s, d).select(F.col("ingest_idx").alias("doc_id"), F.col("claim").alias("text"))), _near_sql("select ingest_idx as doc_id, claim as text from evidence_cards")),
    "redacted_texts": (
        lambda s, d: _cards(s, d).select("ingest_idx", F.md5(privacy.redacted(F.col("supporting_text"))).alias("redacted_md5"), privacy.has_personal_data(F.col("supporting_text")).alias("personal")),
        "select ingest_idx, md5("
        + reduce(lambda inner, p: f"regexp_replace({inner}, '{p[1]}', '{p[0]}', 'g')", privacy.PATTERNS, "supporting_text")
        + ") as redacted_md5, ("
        + " or ".join(f"coalesce(regexp_matches(supporting_text, '{p}'), false)" for _, p in privacy.PATTERNS)
        + ") as personal from evidence_cards",
    ),
    "revenue_by_nation": (
        lambda s, d: _revenue(s, d),
        """select n_name, cast(year(l_shipdate) as int) as year, sum(cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint)) / 10000 as revenue, count(*) as lines
        from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2""",
    ),
    "structured_claims": (
        lambda s, d: _structured(s, d).withColumn("value", F.round("value", 6)),
        f"with {_STRUCTURED} select ingest_idx, domain, entity, metric, period, round(value, 6) as value, unit, key from structured",
    ),
    "claim_support": (
        lambda s, d: claims.claim_support(_structured(s, d)),
        f"""with {_STRUCTURED} select key, count(*) as claims, count(distinct domain) as domains, count(distinct domain) filter ({_PRIMARY.format('domain')}) as primaries,
        case when count(distinct domain) >= 2 then 'triangulated' else 'single' end as label from structured where key is not null group by 1""",
    ),
    "uncorroborated_claims": (
        lambda s, d: claims.uncorroborated(_structured(s, d)),
        f"""with {_STRUCTURED} select key, max((value is not null)::int + (entity is not null and period is not null)::int) as priority from structured where key is not null group by 1
        having count(distinct domain) < 2 order by 2 desc, 1 limit 20""",
    ),
    "primary_share": (
        lambda s, d: claims.primary_share(_cards(s, d), F.lower(F.trim("cluster_id"))),
        f"""with r as (select lower(trim(cluster_id)) as key, {_DOMAIN} as domain, coalesce(is_primary_source, false) as flag from evidence_cards where coalesce(trim(cluster_id), '') <> ''),
        g as (select key from r group by 1 having count(distinct domain) >= 2)
        select count(*) as cards, count(*) filter (flag or {_PRIMARY.format('domain')}) as primaries, round(case when count(*) > 0 then count(*) filter (flag or {_PRIMARY.format('domain')}) / count(*) else 0.0 end, 6) as share from r join g using (key)""",
    ),
    "source_kinds": (
        lambda s, d: claims.source_kinds(_cards(s, d)),
        f"""with r as (select {_DOMAIN} as domain, count(*) as n from evidence_cards group by 1)
        select {_FAMILY.format('domain')} as kind, cast(sum(n) as bigint) as cards, count(*) as domains, count(distinct {_REGISTRABLE.format('domain')}) as registered, count(*) filter ({_PRIMARY.format('domain')}) as primary_domains from r group by 1""",
    ),
    "direction_conflicts": (
        lambda s, d: claims.direction_conflicts(_cards(s, d), "request_id"),
        f"""select lower(trim(request_id)) as "group", count(*) filter ({_SIDES.format('claim')} > 0) as rising, count(*) filter ({_SIDES.format('claim')} < 0) as falling from evidence_cards
        where coalesce(trim(request_id), '') <> '' group by 1 having rising > 0 and falling > 0""",
    ),
    "paraphrase_classes": (
        lambda s, d: claims.paraphrase_classes(_cards(s, d).select(F.col("ingest_idx").alias("doc_id"), F.col("claim").alias("text"))),
        f"""with recursive e as (select ingest_idx as doc_id, list_sort(list_distinct({_TOKENS.format('claim')})) as s from evidence_cards), f as (select * from e where len(s) > 0),
        u as (select s, min(doc_id) as id from f group by 1), p as (select x.id as a, y.id as b from u x join u y on x.id < y.id
          where len(list_intersect(x.s, y.s)) >= 3 and len(list_intersect(x.s, y.s)) >= 0.82 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
        both_ways as (select a, b from p union all select b, a from p), reach(node, other) as (select a, b from both_ways union select r.node, k.b from reach r join both_ways k on k.a = r.other),
        roots as (select node, least(node, min(other)) as root from reach group by node), c as (select s, id, coalesce(root, id) as class_id from u left join roots on node = id),
        z as (select class_id, count(*) as size from c group by 1)
        select doc_id, class_id, size from f join c using (s) join z using (class_id)""",
    ),
    "event_sessions": (
        _sessions,
        """with m as (select user_id, ts, case when ts <= lag(ts) over w + interval 10 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
        n as (select user_id, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from m), c as (select user_id, k, count(*) as events from n group by 1, 2)
        select user_id, count(*) as sessions, max(events) as longest from c group by 1""",
    ),
    "spend_alerts": (
        lambda s, d: costs.spend_alerts(summaries.first_delivery(table(s, d, "cost_records"), "id", "recorded_at"), 0.05),
        f"select provider, date_trunc('day', recorded_at) as start, round(sum(coalesce(cost_usd, 0)), 6) as cost from {_FIRST_COSTS} group by 1, 2 having sum(coalesce(cost_usd, 0)) > 0.05",
    ),
    "extra_scalars": (
        _extra_scalars,
        rf"""select ingest_idx, md5(translate(coalesce(best_quote, snippet), '"''“”‘’„«»‹›', '')) as bare_md5, sha256(author)[1:16] as author_key,
        round(case when len(regexp_extract_all(coalesce(claim, ''), '[\p{{L}}\p{{N}}]+(?:[.,]\d+)*')) = 0 then 0.0 else len(regexp_extract_all(coalesce(claim, ''), '\b\d+(?:[.,]\d+)*')) / len(regexp_extract_all(coalesce(claim, ''), '[\p{{L}}\p{{N}}]+(?:[.,]\d+)*')) end, 6) as density,
        {_SIDES.format('claim')} as direction from evidence_cards""",
    ),
    "quote_windows": (
        lambda s, d: _cards(s, d).select("ingest_idx", text.best_window(F.col("supporting_text"), 280).alias("window")),
        r"""with p as (select ingest_idx, list_filter(list_transform(string_split(regexp_replace(coalesce(supporting_text, ''), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '' and length(s) <= 280) as p from evidence_cards)
        select ingest_idx, coalesce(list_filter(p, lambda s: regexp_matches(s, '[0-9]'))[1], p[1]) as window from p""",
    ),
    "plain_urls": (
        lambda s, d: _cards(s, d).select("ingest_idx", urls.url_without_campaign(F.col("url")).alias("plain"), privacy.redacted_url(F.col("url")).alias("redacted")),
        r"""with p as (select ingest_idx, url, regexp_replace(coalesce(url, ''), '#.*$', '') as u from evidence_cards),
        k as (select *, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' and not starts_with(lower(x), 'utm_')) as kept from p)
        select ingest_idx, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?]*)', 1) || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as plain,
        regexp_replace(url, '(?i)([?&](?:api_?key|token|secret|password|access_token|signature)=)[^&#]*', '\1REDACTED', 'g') as redacted from k""",
    ),
    "cards_off_blogs": (
        lambda s, d: evidence.without_banned(_cards(s, d), table(s, d, "source_profiles").where("site_kind = 'blog'").select(F.col("site").alias("domain"))).select("ingest_idx", "source_domain"),
        """select ingest_idx, source_domain from evidence_cards where coalesce(trim(source_domain), '') <> ''
        and lower(trim(source_domain)) not in (select site from source_profiles where site_kind = 'blog')""",
    ),
    "agreeing_claims": (
        _agreeing,
        f"""with {_STRUCTURED}, v as (select key, domain, min(value * {_FACTOR}) as low, max(value * {_FACTOR}) as high from structured where key is not null and value is not null group by 1, 2)
        select key, count(*) as domains, round(min(low), 4) as low, round(max(high), 4) as high, max(high) - min(low) <= 0.1 * greatest(abs(max(high)), abs(min(low)), 1.0) as agree from v group by 1 having count(*) >= 2""",
    ),
    "triangulation_by_discipline": (
        lambda s, d: evidence.triangulation_by(_cards(s, d), "discipline"),
        f"""with r as (select discipline, {_CLAIM.format('claim')} as key, {_DOMAIN} as domain from evidence_cards), g as (select key from r where key <> '' group by 1 having count(distinct domain) >= 2)
        select discipline, count(*) as cards, count(g.key) as triangulated, round(count(g.key) / count(*), 6) as rate from r left join g using (key) group by 1""",
    ),
    "hashed_sample": (
        lambda s, d: evidence.hashed_sample(_cards(s, d), "id", 50, "a"),
        "select id, md5('a' || id) as mark from (select distinct id from evidence_cards where id is not null) order by 2, 1 limit 50",
    ),
    "last_deliveries": (
        lambda s, d: evidence.last_per_key(_cards(s, d), "id"),
        "select id, max(ingest_idx) as ingest_idx, min(ingest_idx) as first from evidence_cards where id is not null group by 1",
    ),
    "quote_coverage": (
        lambda s, d: evidence.quote_coverage(_cards(s, d)),
        "select provider, count(*) as cards, round(count(*) filter (coalesce(trim(best_quote), '') <> '') / count(*), 6) as quoted from evidence_cards group by 1",
    ),
    "top_per_discipline": (
        lambda s, d: evidence.top_per_group(_cards(s, d), "discipline", 8),
        f"select discipline, ingest_idx, rank from (select discipline, ingest_idx, row_number() over (partition by discipline order by {_CRED} desc nulls last, ingest_idx) as rank from evidence_cards) where rank <= 8",
    ),
    "p1_found": (p1_found, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
