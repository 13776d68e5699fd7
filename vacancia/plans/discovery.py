"""Queries over discovery runs: filters, gates, provider health and target plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacancia.operators import discovery as D
from vacancia.operators import health as H
from vacancia.operators import planning as P
from vacancia.operators import summary as S
from vacancia.operators import tenants as T
from vacancia.operators.numbering import numbered
from vacancia.plans.fixtures import registrar, sql, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-25 00:00:00'"
POSITIVE, NEGATIVE = ("product manager", "international"), ("intern",)


def now() -> F.Column:
    return F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")


query = registrar(QUERIES, ORACLE_SQL)


def words(column: str, *terms: str) -> str:
    """DuckDB: whether any term stands in ``column`` as whole words. Other characters than letters and digits become single spaces."""
    padded = f"(' ' || trim(regexp_replace(lower(coalesce({column}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"
    return "(" + " OR ".join(f"contains({padded}, ' {t.lower()} ')" for t in terms) + ")"


@query(f"SELECT sequence, {words('title', 'product manager')} AS manager, {words('title', 'intern')} AS intern, {words('raw_location', 'us')} AS us FROM fx_candidates", "fx_candidates")
def keyword_match(c: DataFrame) -> DataFrame:
    return c.select("sequence", D.has_keyword(F.col("title"), "Product-Manager").alias("manager"), D.has_keyword(F.col("title"), "intern").alias("intern"), D.has_keyword(F.col("raw_location"), "US").alias("us"))


TITLE = f"({words('title', *POSITIVE)} AND NOT {words('title', *NEGATIVE)})"


@query(f"""SELECT sequence, {TITLE} AS allowed, concat_ws(',', CASE WHEN {words('title', 'product manager')} THEN 'product manager' END, CASE WHEN {words('title', 'international')} THEN 'international' END) AS positive,
    CASE WHEN {words('title', 'intern')} THEN 'intern' ELSE '' END AS negative FROM fx_candidates""", "fx_candidates")
def title_evaluate(c: DataFrame) -> DataFrame:
    title = F.col("title")
    return c.select("sequence", D.title_allowed(title, POSITIVE, NEGATIVE).alias("allowed"), F.array_join(D.matched(title, POSITIVE), ",").alias("positive"), F.array_join(D.matched(title, NEGATIVE), ",").alias("negative"))


PLACE = f"CASE WHEN trim(coalesce(raw_location, '')) = '' OR {words('raw_location', 'hybrid')} THEN true WHEN {words('raw_location', 'us', 'paris')} THEN false ELSE {words('raw_location', 'germany', 'hamburg', 'remote')} END"


@query(f"SELECT sequence, {PLACE} AS allowed FROM fx_candidates", "fx_candidates")
def location_filter(c: DataFrame) -> DataFrame:
    return c.select("sequence", D.location_allowed(F.col("raw_location"), ["hybrid"], ["US", "Paris"], ["Germany", "Hamburg", "remote"]).alias("allowed"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN true ELSE (contains(lower(text), 'license') OR contains(lower(text), 'er ')) AND NOT contains(lower(text), '@') END AS allowed FROM documents", "documents")
def content_filter(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", D.content_allowed(F.col("text"), ["license", "er "], ["@"]).alias("allowed"))


@query("SELECT sequence, CASE WHEN trim(coalesce(html, '')) = '' THEN true WHEN title LIKE 'Product%' THEN contains(lower(html), 'script') ELSE NOT contains(lower(html), 'nav') END AS allowed FROM fx_candidates", "fx_candidates")
def content_filter_overrides(c: DataFrame) -> DataFrame:
    return c.select("sequence", D.content_allowed(F.col("html"), [], ["nav"], D.matched(F.col("title"), POSITIVE), {"Product Manager": (["script"], [])}).alias("allowed"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END AS low, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice + p_size END AS high, CASE p_partkey % 3 WHEN 0 THEN 'eur' WHEN 1 THEN 'USD' END AS currency FROM part)
    SELECT p_partkey, CASE WHEN coalesce(low, high) IS NULL THEN true ELSE NOT (coalesce(currency, '') = 'USD') AND coalesce(high, low) >= 950 AND coalesce(low, high) <= 1500 END AS allowed FROM s""", "part")
def salary_filter(part: DataFrame) -> DataFrame:
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    currency = F.when(k % 3 == 0, "eur").when(k % 3 == 1, "USD")
    return part.select("p_partkey", D.salary_allowed(F.when(k % 5 > 0, price), F.when(k % 7 > 0, price + F.col("p_size")), currency, 950, 1500, "EUR").alias("allowed"))


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true ELSE ts >= {NOW} - INTERVAL '10' DAY END AS allowed FROM events", "events")
def posting_age(events: DataFrame) -> DataFrame:
    return events.select("event_id", D.age_allowed(F.when(F.col("event_id") % 4 != 0, F.col("ts")), now(), 10).alias("allowed"))


SCOPE = f"""CASE WHEN trim(raw_location) = '' THEN 'missing_scope' WHEN {words('raw_location', 'germany')} THEN 'compatible_scope_present' WHEN NOT {words('raw_location', 'us', 'paris')} THEN 'no_blocked_scope'
    WHEN regexp_matches(lower(raw_location), '\\bremote\\b\\s*[(\\[,:-]') OR contains(lower(raw_location), 'only') THEN 'explicit_blocked_remote_scope' ELSE 'blocked_scope_not_explicitly_restrictive' END"""


@query(f"SELECT sequence, {SCOPE} AS reason, {SCOPE} <> 'explicit_blocked_remote_scope' AS allowed FROM fx_candidates", "fx_candidates")
def scope_filter(c: DataFrame) -> DataFrame:
    scope = D.location_scope(F.col("raw_location"), ["Germany"], ["US", "Paris"])
    return c.select("sequence", scope["reason"].alias("reason"), scope["allowed"].alias("allowed"))


@query("SELECT sequence, CASE WHEN regexp_matches(lower(raw_location), '\\bhybrid\\b') THEN 'Hybrid' WHEN regexp_matches(lower(raw_location), '\\bremote\\b') THEN 'Remote' ELSE 'Unknown' END AS raw_type, CASE WHEN trim(raw_location) = '' THEN 'unknown' WHEN contains(lower(raw_location), 'hybrid') THEN 'hybrid' WHEN contains(lower(raw_location), 'remote') THEN 'remote' ELSE regexp_replace(lower(trim(raw_location)), '[^a-z0-9]+', '_', 'g') END AS match_type FROM fx_candidates", "fx_candidates")
def remote_types(c: DataFrame) -> DataFrame:
    return c.select("sequence", D.remote_type(F.col("raw_location")).alias("raw_type"), D.remote_key(F.col("raw_location")).alias("match_type"))


def _gated(c: DataFrame) -> DataFrame:
    scope = D.location_scope(F.col("raw_location"), ["Germany"], ["US", "Paris"])
    rows = c.select("sequence", F.when(F.col("sequence") % 17 != 0, F.col("source_provider")).alias("company"), F.regexp_replace("url", r"\?.*$", "").alias("url"), "title", "raw_location", "html")
    return D.gate(rows, [("title_filter", D.title_allowed(F.col("title"), (), NEGATIVE)), ("location_scope_filter", scope["allowed"]), ("content_filter", D.content_allowed(F.col("html"), [], ["cheap"]))]).select("sequence", "reject_reason")


GATED = f"""SELECT sequence, CASE WHEN missing IS NOT NULL THEN missing WHEN again THEN 'duplicate_url_in_run' WHEN {words('title', *NEGATIVE)} THEN 'title_filter' WHEN {SCOPE} = 'explicit_blocked_remote_scope' THEN 'location_scope_filter'
    WHEN trim(coalesce(html, '')) <> '' AND contains(lower(html), 'cheap') THEN 'content_filter' END AS reject_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY url, missing IS NULL ORDER BY sequence) > 1 AS again FROM (SELECT sequence, title, raw_location, html, regexp_replace(url, '\\?.*$', '') AS url,
      CASE WHEN trim(title) = '' THEN 'missing_title' WHEN sequence % 17 = 0 THEN 'missing_company' WHEN NOT regexp_matches(lower(url), '^https?://[^\\s/?#]+') THEN 'missing_or_invalid_url' END AS missing FROM fx_candidates))"""


@query(GATED, "fx_candidates")
def candidates_gate_reasons(c: DataFrame) -> DataFrame:
    return _gated(c)


@query(f"WITH g AS ({GATED}) SELECT sequence, CASE WHEN reject_reason IS NULL AND row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY sequence) > 40 THEN 'candidate_cap' ELSE reject_reason END AS reject_reason FROM g", "fx_candidates")
def candidates_cap(c: DataFrame) -> DataFrame:
    return D.capped(_gated(c), "sequence", 40, "reject_reason", "candidate_cap")


PROFILES = (
    {"user_id": 1, "has_saved_filters": True, "profiles": [{"profile": "a", "positive": ("lead",), "allow": ("germany",)}, {"profile": "b", "positive": ("product manager",), "remote_types": ("hybrid", "remote")}]},
    {"user_id": 2, "has_saved_filters": True, "profiles": [{"profile": "c", "negative": ("intern",), "block": ("us",), "company_block": ("prov3",)}]},
    {"user_id": 3, "has_saved_filters": False, "profiles": []},
    {"user_id": 4, "has_saved_filters": True, "profiles": []},
    {"user_id": 5, "has_saved_filters": True, "profiles": [{"profile": "d", "allow": ("remote", "bavaria"), "company_allow": ("prov1", "prov2")}]},
)


@query(f"""WITH c AS (SELECT sequence, title, raw_location, source_provider AS company, CASE WHEN regexp_matches(lower(raw_location), '\\bhybrid\\b') THEN 'Hybrid' WHEN regexp_matches(lower(raw_location), '\\bremote\\b') THEN 'Remote' END AS kind FROM fx_candidates),
    p AS (SELECT *, concat_ws(' | ', nullif(trim(raw_location), ''), kind, CASE WHEN sequence % 4 = 0 THEN 'Bavaria' END) AS place FROM c),
    m AS (SELECT sequence, 1 AS user_id, CASE WHEN {words('title', 'lead')} AND (place = '' OR {words('place', 'germany')}) THEN 'a' WHEN {words('title', 'product manager')} AND kind IS NOT NULL THEN 'b' END AS profile, false AS every FROM p
    UNION ALL SELECT sequence, 2, CASE WHEN NOT {words('title', 'intern')} AND (place = '' OR NOT {words('place', 'us')}) AND company <> 'prov3' THEN 'c' END, false FROM p UNION ALL SELECT sequence, 3, NULL, true FROM p
    UNION ALL SELECT sequence, 5, CASE WHEN (place = '' OR {words('place', 'remote')} OR {words('place', 'bavaria')}) AND company IN ('prov1', 'prov2') THEN 'd' END, false FROM p) SELECT sequence, user_id, profile FROM m WHERE profile IS NOT NULL OR every""", "fx_candidates")
def user_profile_match(c: DataFrame) -> DataFrame:
    kind = F.nullif(D.remote_type(F.col("raw_location")), F.lit("Unknown"))
    place = F.when(F.col("sequence") % 4 == 0, F.array(F.struct(*[F.lit("Bavaria" if n == "region" else None).cast("string").alias(n) for n in ("raw", "city", "region", "country", "country_code")])))
    return D.match_profiles(c.select("sequence", "title", "raw_location", F.col("source_provider").alias("company"), kind.alias("remote_type"), place.alias("locations")), PROFILES)


GATE = "CASE WHEN job_id % 9 = 0 THEN 'skipped_preflight_error' WHEN job_id % 4 = 0 THEN 'existing_preflight' WHEN job_id % 5 = 0 THEN 'skipped_detail_unavailable' WHEN job_id % 7 = 0 THEN 'skipped_location_ineligible' WHEN posting_company_name IS NULL AND job_id % 2 = 0 THEN 'skipped_missing_description' END"


@query(f"WITH g AS (SELECT job_id, {GATE} AS status FROM fx_jobs) SELECT job_id, coalesce(status, CASE WHEN row_number() OVER (PARTITION BY status IS NULL ORDER BY job_id) > 500 THEN 'skipped_create_limit' ELSE 'create' END) AS status FROM g", "fx_jobs")
def import_gate(jobs: DataFrame) -> DataFrame:
    k = F.col("job_id")
    text = F.when(~(F.col("posting_company_name").isNull() & (k % 2 == 0)), F.col("title"))
    status = D.import_gate(F.when(k % 9 != 0, "ok"), F.when(k % 4 == 0, k), F.when(k % 5 == 0, "unavailable"), F.when(k % 7 == 0, "ineligible"), text)
    rows = D.capped(jobs.select("job_id", status.alias("status")), "job_id", 500, "status", "skipped_create_limit")
    return rows.withColumn("status", F.coalesce("status", F.lit("create")))


@query("WITH g AS (SELECT job_id, CASE WHEN job_id % 9 = 0 THEN 'skipped_preflight_error' WHEN job_id % 4 = 0 THEN 'skipped_existing' WHEN posting_company_name IS NOT NULL THEN 'already_present' END AS status FROM fx_jobs) SELECT job_id, coalesce(status, CASE WHEN row_number() OVER (PARTITION BY status IS NULL ORDER BY job_id) > 50 THEN 'skipped_limit' ELSE 'fetch' END) AS status FROM g", "fx_jobs")
def detail_gate(jobs: DataFrame) -> DataFrame:
    k = F.col("job_id")
    rows = jobs.select("job_id", D.detail_gate(F.when(k % 9 != 0, "ok"), k % 4 == 0, F.col("posting_company_name")).alias("status"))
    return D.capped(rows, "job_id", 50, "status", "skipped_limit").withColumn("status", F.coalesce("status", F.lit("fetch")))


@query("SELECT DISTINCT job_id, u AS user_id FROM (SELECT job_id, unnest([job_id % 50, job_id % 77]) AS u FROM fx_jobs) WHERE u IN (SELECT c_custkey FROM customer)", "fx_jobs", "customer")
def compat_pairs(jobs: DataFrame, customer: DataFrame) -> DataFrame:
    imports = jobs.select("job_id", F.array(F.col("job_id") % 50, F.col("job_id") % 77).alias("matched_user_ids"))
    return D.compatibility_pairs(imports, customer.select(F.col("c_custkey").alias("user_id")))


DURABLE = "coalesce(error_class = 'http_4xx' AND http_status IN (404, 410), false)"
TRANSIENT = "coalesce(status = 'error' AND (error_class = 'rate_limited' OR (error_class = 'http_4xx' AND http_status IN (401, 403, 408))), false)"
WIDE = H.Policy(rate_limit_threshold=1400, transient_threshold=1900, minimum_for_ratio=100, ratio_threshold=0.32)
RUNNING = f"""SELECT sequence, health_partition, status, count(*) FILTER (WHERE status <> 'skipped') OVER w AS requests, count(*) FILTER (WHERE error_class = 'rate_limited' AND status <> 'skipped') OVER w AS rate_limited, count(*) FILTER (WHERE {TRANSIENT}) OVER w AS transient
    FROM fx_provider_results WINDOW w AS (PARTITION BY health_partition ORDER BY sequence)"""
TRIPPED = f"SELECT *, CASE WHEN rate_limited >= 1400 THEN 'rate_limit_threshold' WHEN transient >= 1900 THEN 'transient_error_threshold' WHEN requests >= 100 AND transient / requests >= 0.32 THEN 'transient_error_ratio' END AS reason FROM ({RUNNING})"
EVENTS = f"SELECT health_partition, sequence, reason, requests, rate_limited, transient FROM (SELECT *, row_number() OVER (PARTITION BY health_partition ORDER BY sequence) AS rn FROM ({TRIPPED}) WHERE reason IS NOT NULL) WHERE rn = 1"


@query(EVENTS, "fx_provider_results")
def breaker_trip(r: DataFrame) -> DataFrame:
    return H.breaker_events(r, WIDE)


@query(f"SELECT r.sequence, CASE WHEN r.sequence > e.sequence THEN 'skipped_by_circuit' ELSE r.status END AS outcome FROM fx_provider_results r LEFT JOIN ({EVENTS}) e USING (health_partition)", "fx_provider_results")
def breaker_skips(r: DataFrame) -> DataFrame:
    return H.after_breaker(r, WIDE).select("sequence", "outcome")


@query(f"""WITH o AS (SELECT health_partition, count(*) AS planned, count(*) FILTER (WHERE status <> 'skipped') AS attempted, count(*) FILTER (WHERE status = 'ok') AS successes, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE error_class = 'rate_limited') AS rate_limited,
      count(*) FILTER (WHERE {DURABLE}) AS durable, count(*) FILTER (WHERE {TRANSIENT}) AS transient, sum(jobs_returned) AS jobs, min(duration_ms) FILTER (WHERE status <> 'skipped') AS min_ms, round(sum(duration_ms) FILTER (WHERE status <> 'skipped') / count(*) FILTER (WHERE status <> 'skipped'), 3) AS average_ms,
      quantile_disc(duration_ms, 0.5) FILTER (WHERE status <> 'skipped') AS p50_ms, quantile_disc(duration_ms, 0.95) FILTER (WHERE status <> 'skipped') AS p95_ms, max(duration_ms) FILTER (WHERE status <> 'skipped') AS max_ms FROM fx_provider_results GROUP BY health_partition)
    SELECT *, CASE WHEN rate_limited > 0 OR (attempted >= 20 AND transient / attempted >= 0.1) THEN 'decrease' WHEN attempted >= 20 AND successes / attempted >= 0.98 AND p95_ms <= 5000 THEN 'consider_increase' ELSE 'hold' END AS action,
      CASE WHEN rate_limited > 0 OR (attempted >= 20 AND transient / attempted >= 0.1) THEN 2 WHEN attempted >= 20 AND successes / attempted >= 0.98 AND p95_ms <= 5000 THEN 4 ELSE 3 END AS concurrency FROM o""", "fx_provider_results")
def rate_observations(r: DataFrame) -> DataFrame:
    return H.rates(r)


@query(f"""WITH o AS (SELECT health_partition, count(*) AS planned, count(*) FILTER (WHERE status <> 'skipped') AS attempted, count(*) FILTER (WHERE status = 'ok') AS successes, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE {TRANSIENT}) AS health_errors, count(*) FILTER (WHERE {DURABLE} AND status <> 'skipped') AS durable, sum(jobs_returned) AS jobs FROM fx_provider_results GROUP BY health_partition)
    SELECT o.*, e.reason AS breaker_reason, round(health_errors / attempted, 4) AS health_error_ratio, CASE WHEN e.reason IS NOT NULL OR (attempted >= 2 AND health_errors / attempted >= 0.5) THEN 'degraded' ELSE 'healthy' END AS state FROM o LEFT JOIN ({EVENTS}) e USING (health_partition)""", "fx_provider_results")
def provider_health_rollup(r: DataFrame) -> DataFrame:
    return H.rollup(r, H.breaker_events(r, WIDE))


@query("SELECT health_partition, coalesce(error_class, 'unknown') AS outcome, count(*) AS n FROM fx_provider_results GROUP BY ALL", "fx_provider_results")
def outcome_histogram(r: DataFrame) -> DataFrame:
    return H.outcome_histogram(r, "error_class")


@query(f"""SELECT *, round(ok / attempted, 4) AS success_ratio, round(errors / attempted, 4) AS error_ratio, round(jobs / ok, 4) AS jobs_per_success FROM (SELECT count(*) AS targets, count(*) FILTER (WHERE status <> 'skipped') AS attempted, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'skipped') AS skipped,
    count(*) FILTER (WHERE {TRANSIENT}) AS transient, count(*) FILTER (WHERE {DURABLE}) AS durable, sum(jobs_returned) AS jobs, count(DISTINCT health_partition) AS partitions FROM fx_provider_results)""", "fx_provider_results")
def run_summary(r: DataFrame) -> DataFrame:
    return H.run_summary(r)


@query("""WITH t AS (SELECT min(sequence) AS sequence, 10 AS minimum_jobs, min(sequence) % 3 AS minimum_details FROM fx_provider_results GROUP BY tenant),
    d AS (SELECT first AS sequence, count(*) AS sampled, count(*) FILTER (WHERE k % 5 <> first % 5) AS ready, count(*) FILTER (WHERE k % 5 = first % 5) AS unavailable FROM (SELECT sequence AS k, min(sequence) OVER (PARTITION BY tenant) AS first FROM fx_provider_results) WHERE k <> first GROUP BY 1),
    j AS (SELECT t.sequence, coalesce(r.status = 'ok' AND jobs_returned >= 10, false) AS listed, CASE WHEN minimum_details <= 0 THEN 'not_required' WHEN coalesce(ready, 0) >= minimum_details THEN 'healthy' WHEN coalesce(sampled, 0) > 0 AND sampled = unavailable THEN 'inconclusive' ELSE 'degraded' END AS detail_state FROM t LEFT JOIN fx_provider_results r USING (sequence) LEFT JOIN d USING (sequence))
    SELECT sequence, detail_state, CASE WHEN NOT listed OR detail_state = 'degraded' THEN 'degraded' WHEN detail_state = 'inconclusive' THEN 'inconclusive' ELSE 'healthy' END AS verdict FROM j""", "fx_provider_results")
def canary_verdict(r: DataFrame) -> DataFrame:
    """The first result of each tenant is a canary, its other results are the details sampled."""
    first = r.groupBy("tenant").agg(F.min("sequence").alias("first"))
    targets = first.select(F.col("first").alias("sequence"), F.lit(10).alias("minimum_jobs"), (F.col("first") % 3).alias("minimum_details"))
    details = r.join(first, "tenant").where("sequence <> first").select(F.col("first").alias("sequence"), F.when(F.col("sequence") % 5 != F.col("first") % 5, "ready").otherwise("unavailable").alias("detail"))
    return H.canary_verdict(targets, r, details)


@query("SELECT sequence, health_partition, tenant FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY sequence) AS rn FROM fx_provider_results WHERE status = 'ok') WHERE rn <= 3", "fx_provider_results")
def canary_sample(r: DataFrame) -> DataFrame:
    """The first three results of each tenant as samples; Spark drops later ones before it shuffles."""
    w = Window.partitionBy("tenant").orderBy("sequence")
    return r.where("status = 'ok'").withColumn("_nth", F.row_number().over(w)).where("_nth <= 3").select("sequence", "health_partition", "tenant")


def _tenants(r: DataFrame) -> DataFrame:
    """A previous state and a result for each of the fixture's results."""
    k = F.col("sequence")
    return r.select(
        k.cast("string").alias("tenant"), "status", "error_class", "http_status", F.when(k % 4 == 0, 0).otherwise(F.col("jobs_returned")).alias("jobs_returned"), (k % 3).alias("matched"),
        F.when(k % 6 == 0, "priority").otherwise("normal").alias("target_class"), F.lit("healthy").alias("health"), (k % 4).alias("failures"), (k % 6).alias("durable"), (k % 2).alias("transient"), (k % 6).alias("empty"), (k % 2).alias("suspicious"),
        F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((k % 11).cast("int"), (k % 7).cast("int"), F.lit(9))).alias("recent_counts"),
        F.when(k % 2 == 0, H.hours(now(), -24 * 10)).otherwise(H.hours(now(), -24)).alias("last_relevant_at"), H.hours(now(), -1).alias("next_at"),
    )


@query(f"""WITH s AS (SELECT CAST(sequence AS VARCHAR) AS tenant, sequence AS k, status, error_class, http_status, CASE WHEN sequence % 4 = 0 THEN 0 ELSE jobs_returned END AS jobs, sequence % 3 AS matched, CASE WHEN sequence % 5 = 0 THEN [] ELSE [CAST(sequence % 11 AS INT), CAST(sequence % 7 AS INT), 9] END AS counts FROM fx_provider_results),
    b AS (SELECT *, {DURABLE} AS gone, status = 'ok' AND jobs = 0 AND coalesce(list_median(counts), 0) >= 5 AS suspicious, matched > 0 OR k % 2 = 1 AS recent, CASE WHEN jobs = 0 THEN k % 6 + 1 ELSE 0 END AS empties FROM s),
    v AS (SELECT *, suspicious AND k % 2 = 0 AS waiting FROM b)
    SELECT tenant, CASE WHEN status = 'skipped' THEN 'healthy' WHEN waiting THEN 'temporarily_failed' WHEN status = 'ok' THEN CASE WHEN k % 6 = 0 THEN CASE WHEN recent THEN 'active' ELSE 'healthy' END WHEN empties >= 5 THEN 'long_empty' WHEN recent THEN 'active' ELSE 'healthy' END
        WHEN gone THEN CASE WHEN k % 6 + 1 >= 5 THEN 'confirmed_dead' WHEN k % 6 + 1 >= 3 THEN 'suspected_dead' ELSE 'temporarily_failed' END WHEN error_class = 'rate_limited' THEN 'cooldown' ELSE 'temporarily_failed' END AS health,
      {NOW} + CASE WHEN status = 'skipped' THEN INTERVAL '-1' HOUR WHEN waiting THEN INTERVAL '60' MINUTE WHEN status = 'ok' THEN CASE WHEN k % 6 = 0 THEN INTERVAL '12' HOUR WHEN empties >= 5 THEN INTERVAL '336' HOUR WHEN recent THEN INTERVAL '24' HOUR ELSE INTERVAL '72' HOUR END
        WHEN gone THEN CASE WHEN k % 6 + 1 >= 3 THEN INTERVAL '720' HOUR ELSE INTERVAL '24' HOUR END WHEN error_class = 'rate_limited' THEN INTERVAL '120' MINUTE ELSE INTERVAL '60' MINUTE END AS next_at,
      CASE WHEN status = 'skipped' OR waiting THEN k % 4 WHEN status = 'ok' THEN 0 ELSE k % 4 + 1 END AS failures, CASE WHEN status = 'skipped' OR waiting THEN k % 6 WHEN status = 'ok' THEN 0 WHEN gone THEN k % 6 + 1 ELSE 0 END AS durable,
      CASE WHEN status = 'skipped' OR waiting THEN k % 2 WHEN status = 'ok' OR gone THEN 0 ELSE k % 2 + 1 END AS transient, CASE WHEN waiting THEN 1 WHEN status = 'ok' OR gone THEN 0 ELSE k % 2 END AS suspicious, CASE WHEN status = 'ok' AND NOT waiting THEN empties ELSE k % 6 END AS empty,
      array_to_string(CASE WHEN status = 'ok' AND suspicious AND NOT waiting THEN [0] WHEN status = 'ok' AND jobs > 0 THEN list_append(counts, jobs) ELSE counts END, ',') AS recent_counts FROM v""", "fx_provider_results")
def tenant_health_step(r: DataFrame) -> DataFrame:
    return T.tenant_step(_tenants(r), now()).withColumn("recent_counts", F.array_join("recent_counts", ","))


@query(f"""WITH e AS ({EVENTS}), k AS (SELECT DISTINCT health_partition FROM fx_provider_results) SELECT k.health_partition, CASE WHEN reason IS NOT NULL THEN 'cooldown' WHEN k.health_partition LIKE 'a%' THEN 'healthy' ELSE 'cooldown' END AS health,
    CASE WHEN reason IS NOT NULL THEN {NOW} + INTERVAL '60' MINUTE WHEN k.health_partition LIKE 'a%' THEN NULL ELSE {NOW} + INTERVAL '5' HOUR END AS cooldown_until, coalesce(reason, 'old') AS last_reason FROM k LEFT JOIN e USING (health_partition)""", "fx_provider_results")
def provider_cooldown(r: DataFrame) -> DataFrame:
    seen = r.select("health_partition").distinct()
    before = seen.select("health_partition", F.lit("cooldown").alias("health"), H.hours(now(), F.when(F.col("health_partition").startswith("a"), -1).otherwise(5)).alias("cooldown_until"), F.lit("old").alias("last_reason"))
    return H.provider_step(before, seen, H.breaker_events(r, WIDE), now())


TARGETS = f"SELECT concat('prov', s_suppkey % 3) AS provider, s_name AS tenant, CASE s_suppkey % 8 WHEN 0 THEN 'active' WHEN 1 THEN 'cooldown' WHEN 2 THEN 'confirmed_dead' WHEN 3 THEN 'long_empty' ELSE 'healthy' END AS health, CASE WHEN s_suppkey % 5 > 0 THEN {NOW} + (s_suppkey % 9 - 6) * INTERVAL '1' DAY END AS next_at, CASE WHEN s_suppkey % 7 > 0 THEN {NOW} - (s_suppkey % 4) * INTERVAL '1' DAY END AS last_attempt_at FROM supplier"


def _targets(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    day = lambda n: now() + F.make_dt_interval(n.cast("int"))
    health = F.when(k % 8 == 0, "active").when(k % 8 == 1, "cooldown").when(k % 8 == 2, "confirmed_dead").when(k % 8 == 3, "long_empty").otherwise("healthy")
    return supplier.select(F.concat(F.lit("prov"), (k % 3).cast("string")).alias("provider"), F.col("s_name").alias("tenant"), health.alias("health"), F.when(k % 5 > 0, day(k % 9 - 6)).alias("next_at"), F.when(k % 7 > 0, day(-(k % 4))).alias("last_attempt_at"))


BUCKET = "CASE health WHEN 'active' THEN 'recent_activity' WHEN 'cooldown' THEN 'recovery' WHEN 'confirmed_dead' THEN 'dead_reprobe' WHEN 'long_empty' THEN 'long_empty' ELSE 'healthy' END"
COUNTS = f"SELECT provider, {BUCKET} AS bucket, count(*) AS population, count(*) FILTER (WHERE coalesce(next_at <= {NOW}, true)) AS due FROM ({TARGETS}) GROUP BY ALL"


@query(COUNTS, "supplier")
def plan_due_buckets(supplier: DataFrame) -> DataFrame:
    return P.bucket_counts(_targets(supplier), now())


ORDERED = f"SELECT provider, tenant, {BUCKET} AS bucket, row_number() OVER (PARTITION BY provider, {BUCKET} ORDER BY next_at ASC NULLS FIRST, last_attempt_at ASC NULLS FIRST, sha256(provider || chr(0) || lower(tenant)), tenant) AS rank FROM ({TARGETS})"


@query(ORDERED, "supplier")
def plan_order(supplier: DataFrame) -> DataFrame:
    return P.schedule_rank(_targets(supplier).withColumn("bucket", P.bucket(F.col("health")))).select("provider", "tenant", "bucket", "rank")


@query(f"SELECT tenant, row_number() OVER (ORDER BY CASE bucket WHEN 'recent_activity' THEN 1 WHEN 'recovery' THEN 2 WHEN 'dead_reprobe' THEN 3 WHEN 'long_empty' THEN 4 ELSE 5 END, rank, provider) AS position FROM ({ORDERED})", "supplier")
def plan_round_robin(supplier: DataFrame) -> DataFrame:
    """Execution order: providers take turns within each bucket."""
    ranked = P.schedule_rank(_targets(supplier).withColumn("bucket", P.bucket(F.col("health"))))
    turn = F.array_position(F.array(*map(F.lit, P.BUCKETS)), F.col("bucket"))
    return numbered(ranked.select("tenant", turn.alias("turn"), "rank", "provider"), ["turn", "rank", "provider"], "position").select("tenant", "position")


@query(None, "supplier")
def plan_budgeted(supplier: DataFrame) -> DataFrame:
    budgets = {f"prov{i}": 12 for i in range(3)}
    return P.plan(_targets(supplier), now(), 19747, 30, budgets, 5).select("provider", "tenant", "bucket", "rank")


@query(f"""WITH c AS ({COUNTS}), w AS (SELECT provider, sum(population) FILTER (WHERE bucket = 'healthy') AS healthy, sum(population) FILTER (WHERE bucket = 'recent_activity') AS recent, sum(due) FILTER (WHERE bucket = 'recent_activity') AS due_recent, coalesce(sum(due) FILTER (WHERE bucket IN ('recovery', 'dead_reprobe', 'long_empty')), 0) AS exceptional FROM c GROUP BY provider),
    d AS (SELECT provider, coalesce(healthy, 0) AS healthy, ceil(coalesce(healthy, 0) / 5) AS healthy_per_run, coalesce(recent, 0) + exceptional + ceil(coalesce(healthy, 0) / 5) AS needed_per_run, least(ceil(coalesce(healthy, 0) / 5), greatest(0, 20 - coalesce(due_recent, 0))) AS reserved FROM w)
    SELECT provider, healthy, healthy_per_run, needed_per_run, CASE WHEN healthy = 0 THEN 0 WHEN reserved > 0 THEN ceil(healthy / reserved) END AS sweep_days, 20 >= needed_per_run AS feasible FROM d""", "supplier")
def sweep_feasibility(supplier: DataFrame) -> DataFrame:
    return P.sweep(P.bucket_counts(_targets(supplier), now()), 20, 5)


@query(f"SELECT tenant, CASE WHEN health <> 'confirmed_dead' THEN greatest({NOW} - INTERVAL '72' HOUR, coalesce(last_attempt_at - INTERVAL '12' HOUR, {NOW} - INTERVAL '48' HOUR)) END AS start FROM ({TARGETS})", "supplier")
def lookback_window(supplier: DataFrame) -> DataFrame:
    return _targets(supplier).select("tenant", P.lookback_start(F.col("last_attempt_at"), F.col("health"), now(), 72, 12, 48).alias("start"))


@query("SELECT job_id, provider, external_id, row_number() OVER (PARTITION BY provider, external_id ORDER BY job_id) > 1 AS duplicate FROM fx_jobs", "fx_jobs")
def targets_first_wins(jobs: DataFrame) -> DataFrame:
    return P.first_wins(jobs.select("job_id", "provider", "external_id"), ["provider", "external_id"], ["job_id"])


@query("SELECT sequence, CASE WHEN code = 'ETIMEDOUT' THEN 'timeout' WHEN http_status BETWEEN 400 AND 499 THEN 'http_4xx' WHEN code = 'ECONNRESET' THEN 'network' ELSE 'provider_error' END AS class, " + f"{DURABLE} AS durable, {TRANSIENT} AS transient FROM (SELECT *, CASE sequence % 4 WHEN 0 THEN 'ETIMEDOUT' WHEN 1 THEN 'ECONNRESET' END AS code FROM fx_provider_results)", "fx_provider_results")
def error_classes(r: DataFrame) -> DataFrame:
    code = F.when(F.col("sequence") % 4 == 0, "ETIMEDOUT").when(F.col("sequence") % 4 == 1, "ECONNRESET")
    e, h = F.col("error_class"), F.col("http_status")
    return r.select("sequence", H.error_class(code, h, F.lit("Error"), F.lit("")).alias("class"), H.is_durable(e, h).alias("durable"), H.is_transient(F.col("status"), e, h).alias("transient"))


@query("""WITH t AS (SELECT sequence, CASE sequence % 10 WHEN 0 THEN 'priority' WHEN 1 THEN 'canary' ELSE 'normal' END AS kind, CASE sequence % 7 WHEN 1 THEN 'not_due' WHEN 2 THEN 'provider_cooldown' WHEN 3 THEN 'disabled' END AS why, CASE WHEN sequence % 3 > 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(sequence % 9 AS INT)) END AS start FROM fx_provider_results),
    a AS (SELECT count(*) FILTER (WHERE why IS NULL) AS targets_planned, count(why) AS targets_skipped_by_schedule, count(*) FILTER (WHERE why IS NULL AND kind = 'priority') AS priority_targets, count(*) FILTER (WHERE why IS NULL AND kind = 'canary') AS canary_targets, count(*) FILTER (WHERE why IS NULL AND kind = 'normal') AS normal_targets,
      count(*) FILTER (WHERE why = 'not_due') AS skipped_not_due, count(*) FILTER (WHERE why = 'provider_cooldown') AS skipped_provider_cooldown, 0 AS skipped_normal_budget, count(*) FILTER (WHERE why = 'disabled') AS disabled_targets_removed, 0 AS planning_rejected, min(start) FILTER (WHERE why IS NULL) AS lookback_earliest, max(start) FILTER (WHERE why IS NULL) AS lookback_latest, count(*) FILTER (WHERE why IS NULL AND start IS NULL) AS unbounded_lookback_targets FROM t),
    b AS (SELECT count(*) FILTER (WHERE status <> 'skipped') AS targets_attempted, count(*) FILTER (WHERE status = 'skipped') AS targets_skipped_by_circuit, count(*) FILTER (WHERE status = 'ok') AS provider_successes, count(*) FILTER (WHERE status = 'error') AS provider_errors, count(*) FILTER (WHERE error_class = 'rate_limited') AS provider_rate_limited, sum(jobs_returned) AS raw_jobs_returned, sum(jobs_returned) AS candidates_matched_before_cap, sum(CASE WHEN sequence % 4 = 0 THEN 1 ELSE 0 END) AS candidates_dropped_by_cap FROM fx_provider_results),
    e AS (SELECT sequence % 3 > 0 AS cat, CASE WHEN sequence % 5 = 0 THEN 'error' ELSE 'ok' END AS pre, sequence % 4 = 0 AS here FROM fx_candidates),
    c AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE pre = 'ok') AS preflight_checked, count(*) FILTER (WHERE pre = 'ok' AND here) AS preflight_existing, count(*) FILTER (WHERE pre = 'ok' AND NOT here) AS preflight_missing, count(*) FILTER (WHERE pre = 'error') AS preflight_errors, count(*) FILTER (WHERE cat) AS catalog_candidates, count(*) FILTER (WHERE cat AND pre = 'ok') AS catalog_preflight_checked, count(*) FILTER (WHERE cat AND pre = 'ok' AND here) AS catalog_preflight_existing, count(*) FILTER (WHERE cat AND pre = 'ok' AND NOT here) AS catalog_preflight_missing, count(*) FILTER (WHERE cat AND pre = 'error') AS catalog_preflight_errors FROM e),
    d AS (SELECT count(*) AS tenant_state_changes, count(*) FILTER (WHERE sequence % 4 = 0) AS tenants_marked_active, count(*) FILTER (WHERE sequence % 4 = 1) AS tenants_marked_long_empty, count(*) FILTER (WHERE sequence % 4 = 2) AS tenants_marked_suspected_dead, 0 AS tenants_marked_confirmed_dead, count(*) FILTER (WHERE sequence % 6 = 0) AS tenants_scheduled_for_empty_reprobe, count(*) FILTER (WHERE sequence % 6 IN (0, 1)) AS tenants_scheduled_for_listing_reprobe FROM fx_provider_results WHERE status = 'ok'),
    f AS (SELECT count(*) AS provider_canaries, count(*) FILTER (WHERE status = 'ok') AS provider_canaries_healthy, count(*) FILTER (WHERE status = 'error') AS provider_canaries_degraded, count(*) FILTER (WHERE status = 'skipped') AS provider_canaries_inconclusive FROM fx_provider_results)
    SELECT *, round(preflight_existing / preflight_checked, 4) AS preflight_existing_ratio, round(catalog_preflight_existing / catalog_preflight_checked, 4) AS catalog_preflight_existing_ratio, round(provider_successes / targets_attempted, 4) AS provider_success_ratio, round(candidates / raw_jobs_returned, 4) AS candidate_ratio FROM a, b, c, d, f""", "fx_provider_results", "fx_candidates")
def run_report(r: DataFrame, c: DataFrame) -> DataFrame:
    k = F.col("sequence")
    start = F.when(k % 3 > 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 9).cast("int")))
    targets = r.select(F.when(k % 10 == 0, "priority").when(k % 10 == 1, "canary").otherwise("normal").alias("target_class"), F.when(k % 7 == 1, "not_due").when(k % 7 == 2, "provider_cooldown").when(k % 7 == 3, "disabled").alias("skip_reason"), start.alias("lookback_start"))
    results = r.select("status", "error_class", F.when(F.col("status") == "skipped", "provider_circuit_open").alias("skip_reason"), "jobs_returned", F.col("jobs_returned").alias("matched"), F.when(k % 4 == 0, 1).otherwise(0).alias("dropped_by_cap"))
    evaluated = c.select(F.when(k % 3 > 0, "catalog").otherwise("portal").alias("source_mode"), F.when(k % 5 == 0, "error").otherwise("ok").alias("preflight"), (k % 4 == 0).alias("exists"))
    changes = r.where("status = 'ok'").select(F.when(k % 4 == 0, "active").when(k % 4 == 1, "long_empty").when(k % 4 == 2, "suspected_dead").alias("health"), F.when(k % 6 == 0, "listing_empty_anomaly").when(k % 6 == 1, "listing_volume_anomaly").alias("listing_outcome"))
    canaries = r.select(F.when(F.col("status") == "ok", "healthy").when(F.col("status") == "error", "degraded").otherwise("inconclusive").alias("verdict"))
    return S.run_report(targets, results, evaluated, changes, canaries)


@query(f"""WITH s AS (SELECT CAST(sequence AS VARCHAR) AS tenant, sequence AS k, CASE sequence % 4 WHEN 0 THEN 'listing_empty_anomaly' WHEN 1 THEN 'listing_volume_anomaly' WHEN 2 THEN 'listing_ok' END AS outcome FROM fx_provider_results WHERE status = 'ok'), a AS (SELECT *, k % 4 < 2 AS odd FROM s)
    SELECT tenant, 'temporarily_failed' AS health, {NOW} + INTERVAL '60' MINUTE AS next_at, k % 4 + 1 AS failures, CASE WHEN odd THEN k % 6 ELSE 0 END AS durable, CASE WHEN odd THEN k % 2 ELSE k % 2 + 1 END AS transient, CASE WHEN odd THEN k % 2 + 1 ELSE k % 2 END AS suspicious, k % 6 AS empty FROM a""", "fx_provider_results")
def tenant_listing_anomalies(r: DataFrame) -> DataFrame:
    """Listings that a provider's check found odd, beside other failures of the same class: sound results taken as such."""
    k = F.col("tenant").cast("long") % 4
    rows = _tenants(r.where("status = 'ok'")).withColumns({"status": F.lit("error"), "error_class": F.lit("provider_anomaly"), "http_status": F.lit(None).cast("int")})
    rows = rows.withColumn("listing_outcome", F.when(k == 0, "listing_empty_anomaly").when(k == 1, "listing_volume_anomaly").when(k == 2, "listing_ok"))
    return T.tenant_step(rows, now()).drop("recent_counts")


@query("SELECT l_returnflag, quantile_disc(CAST(floor(l_extendedprice) AS BIGINT), 0.01) AS low, quantile_disc(CAST(floor(l_extendedprice) AS BIGINT), 0.5) AS middle, quantile_disc(CAST(floor(l_extendedprice) AS BIGINT), 1.0) AS high FROM lineitem GROUP BY l_returnflag", "lineitem")
def nearest_rank_prices(lineitem: DataFrame) -> DataFrame:
    """Nearest ranks of a wide range of values in few large groups."""
    rows = lineitem.select("l_returnflag", F.floor("l_extendedprice").alias("price"))
    return H.nearest_ranks(rows, "l_returnflag", "price", {"low": (1, 100), "middle": (1, 2), "high": (1, 1)})


# Statuses of candidates made of their number, so that every field of a report counts some and leaves out others.
DETAIL = ("ok", "already_present", "skipped_existing", "skipped_limit", "unsupported_provider", "unavailable", "error", None)
IMPORT = ("existing_preflight", "submitted", "reconciled_after_ambiguous_post", "skipped_detail_unavailable", "skipped_location_ineligible", "skipped_limit", "error", None, "planned")
LOCATION = ("provider_structured", "missing", "normalized_city_country", "normalized_country", "normalized_multiple", "unparsed_text", "unparsed_remote")
ELIGIBLE = ("eligible", "ineligible", "unclear", "not_applicable_existing", None)
PAIR = ("requested", "skipped_active", "skipped_succeeded_current_cv", "skipped_succeeded_unknown_cv", "skipped_request_limit", "error_latest_check", "error_request", None)


def _dealt(k: F.Column, names: tuple[str | None, ...]) -> F.Column:
    return F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (k % len(names) + 1).cast("int"))


def _dealt_sql(k: str, names: tuple[str | None, ...]) -> str:
    listed = ", ".join("NULL" if n is None else f"'{n}'" for n in names)
    return f"([{listed}])[{k} % {len(names)} + 1]"


def _filtered(column: str, *names: str) -> str:
    return f"count(*) FILTER (WHERE {column} IN ({', '.join(repr(n) for n in names)}))"


@query(f"""WITH e AS (SELECT {_dealt_sql('sequence', DETAIL)} AS detail, {_dealt_sql('sequence', IMPORT)} AS import, {_dealt_sql('sequence', LOCATION)} AS location, {_dealt_sql('sequence', ELIGIBLE)} AS eligible, sequence % 6 = 0 AS conflict, sequence % 4 AS open, sequence % 5 > 0 AS checked, sequence % 3 = 0 AS here, sequence % 7 < 2 AS blank FROM fx_candidates),
    a AS (SELECT {_filtered('detail', 'ok')} AS detail_ready, {_filtered('detail', 'already_present')} AS detail_already_present, {_filtered('detail', 'skipped_existing')} AS detail_existing_skipped, {_filtered('detail', 'skipped_limit')} AS detail_fetch_limited, {_filtered('detail', 'unsupported_provider')} AS detail_unsupported, {_filtered('detail', 'unavailable')} AS detail_unavailable, {_filtered('detail', 'error')} AS detail_errors,
      {_filtered('import', 'existing_preflight')} AS import_existing, {_filtered('import', 'submitted')} AS import_submitted, {_filtered('import', 'reconciled_after_ambiguous_post')} AS import_reconciled, {_filtered('import', 'skipped_detail_unavailable')} AS import_detail_unavailable_skipped, {_filtered('import', 'skipped_location_ineligible')} AS import_skipped_location_ineligible, {_filtered('import', 'error')} AS import_errors, count(*) FILTER (WHERE import LIKE 'skipped%') AS import_skipped,
      {_filtered('location', 'provider_structured')} AS location_provider_structured, {_filtered('location', 'missing')} AS location_missing, count(*) FILTER (WHERE location LIKE 'normalized%') AS location_normalized, count(*) FILTER (WHERE location LIKE 'unparsed%') AS location_unparsed, {_filtered('eligible', 'eligible')} AS location_eligible, {_filtered('eligible', 'ineligible')} AS location_ineligible, {_filtered('eligible', 'unclear')} AS location_unclear,
      count(*) FILTER (WHERE conflict) AS location_conflicting, sum(open) AS location_unresolved_observations, count(*) FILTER (WHERE blank) AS candidate_descriptions_missing, count(*) FILTER (WHERE blank AND checked AND NOT here AND detail IS DISTINCT FROM 'unavailable') AS missing_descriptions_for_import FROM e),
    p AS (SELECT {_dealt_sql('job_id', PAIR)} AS s FROM fx_jobs),
    b AS (SELECT count(*) AS compatibility_pairs, count(s) AS compatibility_evaluated, count(*) - count(s) AS compatibility_omitted_by_pair_limit, {_filtered('s', 'requested')} AS compatibility_requested, {_filtered('s', 'skipped_active')} AS compatibility_already_active, count(*) FILTER (WHERE s LIKE 'skipped_succeeded%') AS compatibility_already_succeeded, {_filtered('s', 'skipped_request_limit')} AS compatibility_skipped_request_limit, count(*) FILTER (WHERE s LIKE 'error%') AS compatibility_errors FROM p),
    u AS (SELECT count(*) AS discovery_users_eligible, count(*) FILTER (WHERE c_custkey % 3 > 0) AS discovery_users_with_saved_filters, count(*) FILTER (WHERE c_custkey % 4 > 0) AS discovery_users_with_valid_profiles, count(*) FILTER (WHERE c_custkey % 3 > 0 AND c_custkey % 4 = 0) AS discovery_users_failing_closed, 'ok' AS discovery_users_load_status, CAST(NULL AS VARCHAR) AS discovery_users_load_error FROM customer),
    r AS (SELECT count(*) AS candidates_rejected, count(*) FILTER (WHERE sequence % 12 = 0) AS candidates_rejected_no_user_match, count(*) FILTER (WHERE sequence % 12 = 4) AS location_scope_rejected FROM fx_candidates WHERE sequence % 4 = 0),
    x AS (SELECT count(*) FILTER (WHERE c_custkey % 5 = 0) AS rate_recommendations_decrease, count(*) FILTER (WHERE c_custkey % 5 = 1) AS rate_recommendations_increase FROM customer)
    SELECT * FROM a, b, u, r, x""", "fx_candidates", "fx_jobs", "customer")
def run_outcome_report(c: DataFrame, jobs: DataFrame, customer: DataFrame) -> DataFrame:
    """What became of candidates, pairs, users and rates in a run."""
    k, user = F.col("sequence"), F.col("c_custkey")
    evaluated = c.select(
        _dealt(k, DETAIL).alias("detail_status"), _dealt(k, IMPORT).alias("import_status"), _dealt(k, LOCATION).alias("location_status"), _dealt(k, ELIGIBLE).alias("eligibility"), F.when(k % 6 == 0, "conflicting").otherwise("consistent").alias("consistency"),
        (k % 4).alias("unresolved"), F.when(k % 5 > 0, "ok").otherwise("error").alias("preflight"), (k % 3 == 0).alias("exists"), F.when(k % 7 == 0, "  ").when(k % 7 > 1, F.col("title")).alias("description"),
    )
    evaluated = evaluated.withColumn("description", F.when(F.col("description") == "", "untitled").otherwise(F.col("description")))
    users = customer.select((user % 3 > 0).alias("saved_filters"), (user % 4).alias("profiles"))
    rejected = c.where("sequence % 4 = 0").select(F.when(k % 12 == 0, "no_user_match").when(k % 12 == 4, "location_scope_filter").otherwise("title_filter").alias("reason"))
    actions = customer.select(F.when(user % 5 == 0, "decrease").when(user % 5 == 1, "consider_increase").otherwise("keep").alias("action"))
    return S.outcome_report(evaluated, jobs.select(_dealt(F.col("job_id"), PAIR).alias("status")), users, rejected, actions)
