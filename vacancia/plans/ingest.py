"""Queries over events, constraints, catalogues and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import events as E
from vacancia.operators import reports, upserts
from vacancia.operators.tenants import COUNTERS
from vacancia.plans.fixtures import registrar, sql, table, view
from vacancia.sources import files
from vacancia.sources.shared import new_folder
from vacancia.streaming import ingest, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


query = registrar(QUERIES, ORACLE_SQL)


EVENT = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_name = 'error' THEN 'Odd Name' ELSE 'Job Created' END AS event_name, CASE WHEN event_id % 13 = 0 THEN 'mars' ELSE source_domain END AS source_domain, CASE event_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'moon' ELSE 'web' END AS source_surface,
    CASE WHEN event_id % 19 = 0 THEN 2 ELSE 1 END AS schema_version, event_id % 23 = 0 AS untimed, event_id % 29 = 0 AS naive, event_id % 31 = 0 AS odd_user, event_id % 37 = 0 AS long_subject, event_id % 41 = 0 AS listed, event_id % 43 = 0 AS secret, event_id % 47 = 0 AS wordy FROM fx_events"""


@query(f"""SELECT event_id, CASE WHEN trim(event_name) = '' THEN 'missing_eventname' WHEN event_name <> 'Job Created' THEN 'unknown_event_name' WHEN source_domain = 'mars' THEN 'invalid_source_domain' WHEN source_domain = 'users' THEN 'source_domain_key_mismatch'
    WHEN source_surface IS NULL THEN 'missing_sourcesurface' WHEN source_surface = 'moon' THEN 'invalid_source_surface' WHEN schema_version <> 1 THEN 'invalid_schema_version' WHEN untimed THEN 'missing_occurredatutc' WHEN naive THEN 'invalid_occurredatutc' WHEN odd_user THEN 'invalid_userid'
    WHEN long_subject THEN 'subjecttype_too_long' WHEN listed THEN 'invalid_properties' WHEN secret THEN 'forbidden_property' WHEN wordy THEN 'property_value_too_long' END AS error_code FROM ({EVENT})""", "fx_events")
def events_validate(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    text = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss")
    rows = events.select(
        "event_id",
        F.when(k % 11 == 0, " ").when(F.col("event_name") == "error", "Odd Name").otherwise("Job Created").alias("event_name"),
        F.when(k % 13 == 0, "mars").otherwise(F.col("source_domain")).alias("source_domain"),
        F.when(k % 17 == 1, "moon").when(k % 17 != 0, "web").alias("source_surface"),
        F.when(k % 19 == 0, 2).otherwise(1).alias("schema_version"),
        F.when(k % 23 == 0, "").when(k % 29 == 0, text).otherwise(F.concat(text, F.lit("Z"))).alias("occurred_at"),
        F.when(k % 31 == 0, "nobody").otherwise("6f1c2d3e-0000-4000-8000-0123456789ab").alias("user_id"),
        F.when(k % 37 == 0, F.repeat(F.lit("x"), 41)).alias("subject_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("subject_id", "correlation_id", "producer_event_id")],
        F.when(k % 41 == 0, "[1]").when(k % 43 == 0, '{"a":{"CV Text":1}}').when(k % 47 == 0, F.concat(F.lit('{"k":"'), F.repeat(F.lit("y"), 1001), F.lit('"}'))).otherwise(F.col("properties_json")).alias("properties_json"),
    )
    key = F.when(F.col("source_domain") == "users", "jobs").otherwise(F.col("source_domain"))
    return rows.select("event_id", E.error_code(key).alias("error_code"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source_domain, producer_event_id ORDER BY event_id) AS rn FROM fx_events WHERE event_id % 5 > 1 OR producer_event_id IS NULL),
    old AS (SELECT source_domain, producer_event_id FROM fx_events WHERE event_id % 5 = 1)
    SELECT event_id FROM n WHERE producer_event_id IS NULL OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.source_domain = n.source_domain AND old.producer_event_id = n.producer_event_id))""", "fx_events")
def events_dedupe(events: DataFrame) -> DataFrame:
    incoming = events.where("event_id % 5 > 1 or producer_event_id is null")
    return E.idempotent_insert(incoming, events.where("event_id % 5 = 1"))[0].select("event_id")


@query("SELECT event_id, event_name, epoch(date_trunc('second', occurred_at))::BIGINT AS time, source_domain, json_extract_string(properties_json, '$.k') AS k, 4 + CASE WHEN json_extract_string(properties_json, '$.k') IS NULL THEN 0 ELSE 1 END AS n FROM fx_events", "fx_events")
def sink_mapping(events: DataFrame) -> DataFrame:
    p = F.col("properties")
    rows = E.sink_properties(events)
    return rows.select("event_id", "event_name", p["time"].cast("long").alias("time"), p["source_domain"].alias("source_domain"), p["k"].alias("k"), F.size(p).alias("n"))


@query("""SELECT 'jobs: identity repeats' AS rule, (SELECT count(*) FROM (SELECT 1 FROM fx_jobs WHERE NOT is_deleted GROUP BY provider, provider_tenant, external_id HAVING count(*) > 1)) AS violations
    UNION ALL SELECT 'statuses: no job', (SELECT count(*) FROM fx_user_job_status s WHERE NOT EXISTS (SELECT 1 FROM fx_jobs j WHERE j.job_id = s.job_id))
    UNION ALL SELECT 'scores: out of range', (SELECT count(*) FROM fx_scores WHERE score NOT BETWEEN 0 AND 10) UNION ALL SELECT 'events: not JSON', (SELECT count(*) FROM fx_events WHERE properties_json IS NOT NULL AND NOT json_valid(properties_json))
    UNION ALL SELECT 'runs: several active', (SELECT count(*) FROM (SELECT 1 FROM fx_runs WHERE status IN ('Pending', 'Queued', 'Leased') GROUP BY enricher_type, subject_key HAVING count(*) > 1))""", "fx_jobs", "fx_user_job_status", "fx_scores", "fx_events", "fx_runs")
def constraint_audit(jobs: DataFrame, status: DataFrame, scores: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    return E.audit(
        {
            "jobs: identity repeats": E.repeated(jobs.where("not is_deleted"), "provider", "provider_tenant", "external_id"),
            "statuses: no job": E.orphans(status, jobs, "job_id"),
            "scores: out of range": scores.where("score not between 0 and 10"),
            "events: not JSON": events.where(F.col("properties_json").isNotNull() & F.try_parse_json("properties_json").isNull()),
            "runs: several active": E.repeated(runs.where("status in ('Pending', 'Queued', 'Leased')"), "enricher_type", "subject_key"),
        }
    )


@query("SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 'url is required' WHEN length(title) > 10 THEN 'title is too long' WHEN job_id % 7 = 0 THEN 'countryName is required' WHEN job_id % 6 = 0 THEN 'countryCode must have two letters' END AS error FROM fx_jobs", "fx_jobs")
def job_payload_validate(jobs: DataFrame) -> DataFrame:
    k = F.col("job_id")
    place = F.array(F.struct(F.when(k % 7 != 0, "Germany").alias("country_name"), F.when(k % 6 == 0, "DEU").otherwise("DE").alias("country_code")))
    return jobs.select("job_id", E.payload_error(F.when(k % 10 != 0, "https://x.example/1"), {"title": (F.col("title"), 10)}, place).alias("error"))


SLUG = "SELECT c_custkey, c_name AS name, CASE c_custkey % 6 WHEN 0 THEN '-bad-' WHEN 1 THEN upper(c_mktsegment) ELSE lower(replace(c_name, '#', '-')) END AS slug FROM customer"
JUDGED = f"SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN row_number() OVER (PARTITION BY slug, reason IS NULL ORDER BY c_custkey) > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict FROM (SELECT c_custkey, lower(slug) AS slug, CASE WHEN NOT regexp_matches(lower(slug), '^[a-z0-9]([a-z0-9._-]{{0,98}}[a-z0-9])?$') THEN 'invalid_slug' END AS reason FROM ({SLUG}))"


def _catalogue(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    slug = F.when(k % 6 == 0, "-bad-").when(k % 6 == 1, F.upper("c_mktsegment")).otherwise(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))))
    return files.catalogue_items(customer.select("c_custkey", F.col("c_name").alias("name"), slug.alias("slug")), "c_custkey")


@query(f"SELECT c_custkey, slug, reason, verdict FROM ({JUDGED})", "customer")
def catalog_slug_validate(customer: DataFrame) -> DataFrame:
    return _catalogue(customer).select("c_custkey", "slug", "reason", "verdict")


COUNTED = f"SELECT count(*) AS source, count(*) FILTER (WHERE verdict = 'accepted') AS accepted, count(*) FILTER (WHERE verdict = 'rejected') AS rejected, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicate FROM ({JUDGED})"


@query(COUNTED, "customer")
def catalog_build_counts(customer: DataFrame) -> DataFrame:
    return files.build_counts(_catalogue(customer))


@query(f"SELECT round((accepted + duplicate) / source, 4) AS ratio, source >= 100 AND (accepted + duplicate) / source >= 0.98 AS passes FROM ({COUNTED})", "customer")
def catalog_quality_gate(customer: DataFrame) -> DataFrame:
    return files.quality_gate(files.build_counts(_catalogue(customer)), 100, 0.98)


@query("SELECT job_id, list_aggregate(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), 'string_agg', ',') AS added, list_aggregate(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), 'string_agg', ',') AS removed FROM (SELECT job_id, list(country_code) AS b, list(CASE WHEN job_id % 2 = 0 THEN 'CA' ELSE country_code END) AS a FROM fx_locations GROUP BY job_id) WHERE len(list_filter(a, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0", "fx_locations")
def locations_diff(locations: DataFrame) -> DataFrame:
    before, after = F.collect_list("country_code"), F.collect_list(F.when(F.col("job_id") % 2 == 0, "CA").otherwise(F.col("country_code")))
    rows = locations.groupBy("job_id").agg(before.alias("b"), after.alias("a")).select("job_id", upserts.set_difference(F.col("b"), F.col("a")).alias("d")).where("d is not null")
    text = lambda c: F.nullif(F.array_join(F.col(f"d.{c}"), ","), F.lit(""))
    return rows.select("job_id", text("added").alias("added"), text("removed").alias("removed"))


@query(None, "fx_history", "fx_jobs")
def report_csv(history: DataFrame, jobs: DataFrame) -> DataFrame:
    """The lines of the CSV report, as its sink writes them."""
    from datetime import datetime

    rows = reports.status_changes(history, jobs, 3, datetime(2024, 1, 5), datetime(2024, 1, 20))
    full = rows.join(jobs.select("job_id", reports.company(F.col("hiring_company_name"), F.col("posting_company_name"), "talent agency").alias("company")), "job_id")
    return reports.report_lines(full, "Europe/Berlin")


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS title FROM pages", "pages")
def jsonld_postings(pages: DataFrame) -> DataFrame:
    """JobPosting blocks of the pages, to each of which the fixture adds one."""
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"'), F.col("page_id").cast("string"), F.lit('"}]}</script>'))
    return pages.select("page_id", F.get_json_object(files.job_posting(F.concat("html", block)), "$.title").alias("title"))


def stream_event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once a user and type within the watermark's delay, as a stream to its end."""
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.deduplicated(ingest.read_events(spark, sf_dir, schema), ["user_id", "event_type"])
    return ingest.to_table(stream.select("event_id", "user_id", "event_type"), new_folder(spark, "dedupe")).select("event_id", "user_id", "event_type")


def stream_rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = ingest.rolling_counts(ingest.read_events(spark, sf_dir, schema))
    rows = ingest.to_table(stream.select(F.col("window.end").alias("until"), "event_type", "n"), new_folder(spark, "rolling"))
    return rows.select("until", "event_type", "n")


QUERIES["stream_event_dedupe"] = stream_event_dedupe
QUERIES["stream_rolling_counts"] = stream_rolling_counts


def stream_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row, results and last health of each user, whose events stand for a target's results, as a stream folds
    them to its end."""
    schema = table(spark, sf_dir, "events").schema
    rows = ingest.read_events(spark, sf_dir, schema).select(
        F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("tenant"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("ok").alias("status")
    )
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.STATE_PROVIDER)
    try:
        found = ingest.to_table(ingest.fold_tenants(rows), new_folder(spark, "state"), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = found.groupBy("tenant").agg(F.max_by(F.struct("failures", "seen", "health"), "batch").alias("s"))
    return last.select("tenant", "s.*")


QUERIES["stream_state_counts"] = stream_state_counts
ORACLE_SQL["stream_state_counts"] = """WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS status FROM events),
    o AS (SELECT user_id, max(event_id) FILTER (WHERE status = 'ok') AS ok, count(*) AS seen FROM r GROUP BY 1), f AS (SELECT user_id, any_value(seen) AS seen, count(*) FILTER (WHERE status = 'error' AND event_id > coalesce(ok, -1)) AS failures FROM r JOIN o USING (user_id) GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS tenant, failures, seen, CASE WHEN failures = 0 THEN 'healthy' WHEN failures < 3 THEN 'temporarily_failed' WHEN failures < 5 THEN 'suspected_dead' ELSE 'confirmed_dead' END AS health FROM f"""


def stream_tenant_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole state of each user, whose events stand for a tenant's results, as a stream folds them to its end."""
    rows = ingest.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema)
    k, kind = F.col("event_id"), F.col("event_type")
    failure = F.when(k % 4 == 0, "rate_limited").when(k % 4 == 1, "provider_anomaly").when(k % 4 == 2, "timeout").otherwise("http_4xx")
    failed = kind == "error"
    results = rows.select(
        F.col("user_id").cast("string").alias("tenant"), F.col("ts").alias("at"), k.alias("sequence"), F.when(failed, "error").when(kind == "signup", "skipped").otherwise("ok").alias("status"),
        F.when(failed, failure).alias("error_class"), F.when(failed & (k % 4 == 3), 404).alias("http_status"), F.when(kind == "view", 0).when(kind.isin("click", "purchase"), (k % 13 + 1).cast("int")).otherwise(0).alias("jobs_returned"),
        F.when(kind == "purchase", 1).otherwise(0).alias("matched"), F.when(F.col("user_id") % 5 == 0, "priority").otherwise("normal").alias("target_class"), F.when(failed, "listing_volume_anomaly").alias("listing_outcome"),
    )
    found = state.with_rocksdb(spark, lambda: ingest.to_table(state.tenant_states(results), new_folder(spark, "tenants"), "update"))
    return found.groupBy("tenant").agg(F.max_by(F.struct("health", "next_at", *COUNTERS, F.array_join("recent_counts", ",").alias("recent_counts")), "batch").alias("s")).select("tenant", "s.*")


def stream_run_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of each user, whose events stand for the changes of a run, with those that timers ended."""
    rows = ingest.read_events(spark, sf_dir, table(spark, sf_dir, "events").schema)
    k, kind, ts = F.col("event_id"), F.col("event_type"), F.col("ts")
    changes = rows.select(
        F.col("user_id").alias("run_id"), ts.alias("changed_at"), k.alias("sequence"), F.when(kind == "click", "Queued").when(kind == "view", "Leased").when(kind == "signup", "Pending").when(kind == "purchase", "Succeeded").otherwise("Failed").alias("status"),
        (ts - F.make_dt_interval((k % 15).cast("int"))).alias("requested_at"), (ts + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))).alias("lease_until"), F.when((kind == "error") | (k % 3 == 0), "EARLIER").alias("error_code"),
    )
    found = state.with_rocksdb(spark, lambda: ingest.to_table(state.run_expiries(changes, pending_minutes=60 * 24 * 7), new_folder(spark, "expiry"), "update"))
    last = found.groupBy("key").agg(F.max_by(F.struct("status", "error_code"), F.struct("batch", "late")).alias("s"))
    return last.select(F.col("key").cast("long").alias("run_id"), "s.status", "s.error_code")


QUERIES["stream_tenant_states"] = stream_tenant_states
QUERIES["stream_run_expiry"] = stream_run_expiry
ORACLE_SQL["stream_run_expiry"] = """WITH l AS (SELECT user_id AS run_id, arg_max({'e': event_id, 't': event_type, 'ts': ts}, {'ts': ts, 'e': event_id}) AS r FROM events GROUP BY 1),
    n AS (SELECT run_id, r.ts AS ts, r.t AS t, r.ts - to_days(CAST(r.e % 15 AS INT)) AS requested_at, r.ts + to_hours(CAST(r.e % 48 AS INT)) AS lease_until, CASE WHEN r.t = 'error' OR r.e % 3 = 0 THEN 'EARLIER' END AS code FROM l),
    d AS (SELECT *, CASE t WHEN 'click' THEN requested_at + INTERVAL 14 DAY WHEN 'view' THEN lease_until + INTERVAL 10 MINUTE WHEN 'signup' THEN requested_at + INTERVAL 7 DAY END < (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS late FROM n)
    SELECT run_id, CASE WHEN late THEN CASE t WHEN 'signup' THEN 'Failed' ELSE 'Expired' END ELSE CASE t WHEN 'click' THEN 'Queued' WHEN 'view' THEN 'Leased' WHEN 'signup' THEN 'Pending' WHEN 'purchase' THEN 'Succeeded' ELSE 'Failed' END END AS status,
      coalesce(code, CASE WHEN late THEN CASE t WHEN 'click' THEN 'QueueTTLExceeded' WHEN 'view' THEN 'LeaseExpired' ELSE 'PendingTooLong' END END) AS error_code FROM d"""
