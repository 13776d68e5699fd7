"""Queries over job lists, lookups, histories and status reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import statuses
from vacancia.operators import job_lists as J
from vacancia.operators import reports as R
from vacancia.plans.fixtures import sql, view

USER = 3
LIST = ("fx_jobs", "fx_user_job_status", "fx_scores", "fx_locations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names or LIST]


def _pages(name: str, query: J.JobQuery, where: str, order: str, joins: str = "", limit: int = 25) -> None:
    """Registers a page of jobs, the number of all jobs that it is a page of, and the SQL of both."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        jobs, status, scores, locations = _views(spark, sf_dir)
        page = J.page(J.select_jobs(jobs, status, scores, locations, query), locations, query)
        full = J.hydrate(page, locations)
        return full.select("job_id", "title", "hiring_company_name", "remote_type", F.coalesce("status", F.lit("")).alias("status"), "created_at", J.location_text(F.coalesce("locations", F.array())).alias("locations"))

    def total(spark: SparkSession, sf_dir: str) -> DataFrame:
        return J.select_jobs(*_views(spark, sf_dir), query).agg(F.count("*").alias("total"))

    base = f"""SELECT j.*, us.status, us.last_updated AS status_updated FROM fx_jobs j
        LEFT JOIN fx_user_job_status us ON us.job_id = j.job_id AND us.user_id = {USER} {joins} WHERE NOT j.is_deleted AND ({where})"""
    QUERIES[name], QUERIES[f"{name}_total"] = run, total
    ORACLE_SQL[name] = sql(
        f"""WITH chosen AS ({base}), page AS (SELECT * FROM chosen ORDER BY {order}, job_id LIMIT {limit} OFFSET {query.offset})
        SELECT p.job_id, p.title, p.hiring_company_name, p.remote_type, coalesce(p.status, '') AS status, p.created_at,
          coalesce((SELECT string_agg(l.country_name || '/' || coalesce(l.city_name, ''), '; ' ORDER BY l.country_name, coalesce(l.city_name, '')) FROM fx_locations l WHERE l.job_id = p.job_id), '') AS locations
        FROM page p""",
        *LIST,
    )
    ORACLE_SQL[f"{name}_total"] = sql(f"SELECT count(*) AS total FROM ({base})", *LIST)


FINAL = ", ".join(f"'{s.lower()}'" for s in statuses.FINAL_STATUSES)
MY = f"(j.created_by_user_id = {USER} OR us.status IS NOT NULL) AND (us.status IS NULL OR lower(trim(us.status)) NOT IN ({FINAL}))"
OPEN = f"us.status IS NULL AND (j.created_by_user_id IS NULL OR j.created_by_user_id <> {USER})"
SCORED = f"JOIN fx_scores s ON s.job_id = j.job_id AND s.user_id = {USER} AND s.score > 5.0"
UPDATED = "coalesce(status_updated, updated_at, created_at)"
_pages("jobs_my_page", J.JobQuery(USER, "my", sort="updated_desc"), MY, f"{UPDATED} DESC")
_pages("jobs_open_page", J.JobQuery(USER, "open"), OPEN, "created_at DESC", SCORED)
_pages("jobs_all_page", J.JobQuery(USER, "all", sort="created_asc", offset=50), "true", "created_at ASC")
_pages("jobs_sort_updated", J.JobQuery(USER, "my", sort="updated_asc", limit=50), MY, f"{UPDATED} ASC", limit=50)
_pages(
    "jobs_sort_status", J.JobQuery(USER, "all", sort="status_progression", limit=100), "true",
    f"CASE lower(coalesce(status, '')) WHEN 'offer' THEN 6 WHEN 'interview' THEN 5 WHEN 'screening planned' THEN 4 WHEN 'applied' THEN 3 WHEN '' THEN 2 ELSE 1 END DESC, {UPDATED} DESC", limit=100,
)
_pages(
    "jobs_sort_location", J.JobQuery(USER, "my", sort="location_az"), MY,
    "(SELECT min(coalesce(l.country_name, '') || '|' || coalesce(l.city_name, '')) FROM fx_locations l WHERE l.job_id = chosen.job_id) ASC NULLS FIRST, created_at DESC",
)
_pages("jobs_search_title_company", J.JobQuery(USER, "all", search="urgent"), "j.title ILIKE '%urgent%' OR j.hiring_company_name ILIKE '%urgent%' OR coalesce(j.posting_company_name, '') ILIKE '%urgent%'", "created_at DESC")
_pages("jobs_search_company", J.JobQuery(USER, "all", search="auto_obile", search_in="company"), "j.hiring_company_name ILIKE '%auto_obile%' OR coalesce(j.posting_company_name, '') ILIKE '%auto_obile%'", "created_at DESC")
_pages(
    "jobs_search_location", J.JobQuery(USER, "all", search="nation_1", search_in="location"),
    "EXISTS (SELECT 1 FROM fx_locations l WHERE l.job_id = j.job_id AND (coalesce(l.country_name, '') ILIKE '%nation_1%' OR coalesce(l.city_name, '') ILIKE '%nation_1%' OR coalesce(l.region, '') ILIKE '%nation_1%'))", "created_at DESC",
)
_pages(
    "jobs_filter_mode_city_country", J.JobQuery(USER, "all", modes=("remote", "hybrid"), cities=("BUILDING", "MACHINERY"), countries=("CA", "NATION_5", "CH")),
    "j.remote_type IN ('Remote', 'Hybrid') AND EXISTS (SELECT 1 FROM fx_locations l WHERE l.job_id = j.job_id AND l.city_name IN ('BUILDING', 'MACHINERY')) AND EXISTS (SELECT 1 FROM fx_locations l WHERE l.job_id = j.job_id AND (l.country_code IN ('CA', 'CH') OR l.country_name = 'NATION_5'))", "created_at DESC",
)
_pages(
    "jobs_filter_dates", J.JobQuery(USER, "all", date_from=datetime(1995, 1, 1), date_to=datetime(1995, 3, 31), date_of="updated"),
    "coalesce(us.last_updated, j.updated_at, j.created_at) >= TIMESTAMP '1995-01-01' AND coalesce(us.last_updated, j.updated_at, j.created_at) < TIMESTAMP '1995-04-01'", "created_at DESC",
)
_pages(
    "jobs_ignore_status_anti", J.JobQuery(USER, "my", ignored_keys=("finished", "booked-more", "done-screen")),
    f"{MY} AND NOT EXISTS (SELECT 1 FROM fx_user_job_status x WHERE x.job_id = j.job_id AND x.user_id = {USER} AND lower(trim(x.status)) IN ('rejected with filled', 'rejected with unfortunately', 'turned down offer', 'withdrew applications', 'ignored', 'more interviews booked', 'more interview booked', 'screening done'))", "created_at DESC",
)


def jobs_search_multiterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's active jobs that match every term; labels count as final only as they are spelled."""
    jobs, status = _views(spark, sf_dir, "fx_jobs", "fx_user_job_status")
    own = status.where(F.col("user_id") == USER).select("job_id", "status")
    rows = jobs.where(~F.col("is_deleted")).join(own, "job_id").where(~F.col("status").isin(*statuses.FINAL_STATUSES))
    return J.search_all_terms(rows, "high x1 customer").select("job_id", "title", "external_id", "status")


TERMS = " AND ".join(f"(coalesce(title, '') ILIKE '%{t}%' OR coalesce(external_id, '') ILIKE '%{t}%' OR coalesce(hiring_company_name, '') ILIKE '%{t}%' OR coalesce(posting_company_name, '') ILIKE '%{t}%')" for t in ("high", "x1", "customer"))
LABELS = ", ".join(f"'{s}'" for s in statuses.FINAL_STATUSES)
ORACLE_SQL["jobs_search_multiterm"] = sql(f"SELECT j.job_id, title, external_id, status FROM fx_jobs j JOIN fx_user_job_status us ON us.job_id = j.job_id AND us.user_id = {USER} WHERE NOT is_deleted AND status NOT IN ({LABELS}) AND {TERMS}", "fx_jobs", "fx_user_job_status")


def jobs_hydrated_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, locations = _views(spark, sf_dir, "fx_jobs", "fx_locations")
    rows = J.hydrate(jobs.where(~F.col("is_deleted")).select("job_id"), locations)
    return rows.select("job_id", F.size("locations").alias("n"), J.location_text(F.col("locations")).alias("locations"))


ORACLE_SQL["jobs_hydrated_locations"] = sql("SELECT j.job_id, count(l.country_name) AS n, string_agg(l.country_name || '/' || coalesce(l.city_name, ''), '; ' ORDER BY l.country_name, coalesce(l.city_name, '')) AS locations FROM fx_jobs j JOIN fx_locations l ON l.job_id = j.job_id WHERE NOT is_deleted GROUP BY j.job_id", "fx_jobs", "fx_locations")


def status_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, status = _views(spark, sf_dir, "fx_jobs", "fx_user_job_status")
    return J.lookup(jobs, status.where(F.col("user_id") == USER), "status", F.lit("Unset"))


ORACLE_SQL["status_lookup_default"] = sql(f"SELECT j.job_id, coalesce(us.status, 'Unset') AS status FROM fx_jobs j LEFT JOIN fx_user_job_status us ON us.job_id = j.job_id AND us.user_id = {USER}", "fx_jobs", "fx_user_job_status")


def score_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, scores = _views(spark, sf_dir, "fx_jobs", "fx_scores")
    return J.lookup(jobs, scores.where(F.col("user_id") == USER), "score", F.lit(None))


ORACLE_SQL["score_lookup_default"] = sql(f"SELECT j.job_id, s.score FROM fx_jobs j LEFT JOIN fx_scores s ON s.job_id = j.job_id AND s.user_id = {USER}", "fx_jobs", "fx_scores")


def job_exists_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    (jobs,) = _views(spark, sf_dir, "fx_jobs")
    probes = jobs.select("provider", "provider_tenant", F.concat(F.lit("x"), (F.col("job_id") * 7 % 9000).cast("string")).alias("external_id")).distinct()
    return J.exists_probe(probes, jobs)


ORACLE_SQL["job_exists_probe"] = sql("SELECT p.*, (SELECT min(job_id) FROM fx_jobs j WHERE NOT is_deleted AND j.provider = p.provider AND j.provider_tenant = p.provider_tenant AND j.external_id = p.external_id) AS job_id, EXISTS (SELECT 1 FROM fx_jobs j WHERE NOT is_deleted AND j.provider = p.provider AND j.provider_tenant = p.provider_tenant AND j.external_id = p.external_id) AS found FROM (SELECT DISTINCT provider, provider_tenant, 'x' || (job_id * 7 % 9000) AS external_id FROM fx_jobs) p", "fx_jobs")


def job_get_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job, deleted or not, with its locations."""
    jobs, locations = _views(spark, sf_dir, "fx_jobs", "fx_locations")
    one = J.hydrate(jobs.where(F.col("job_id").isin(20, 60, 100)).select("job_id", "title", "is_deleted"), locations)
    return one.select("job_id", "title", "is_deleted", J.location_text(F.coalesce("locations", F.array())).alias("locations"))


ORACLE_SQL["job_get_children"] = sql("SELECT job_id, title, is_deleted, coalesce((SELECT string_agg(l.country_name || '/' || coalesce(l.city_name, ''), '; ' ORDER BY l.country_name, coalesce(l.city_name, '')) FROM fx_locations l WHERE l.job_id = j.job_id), '') AS locations FROM fx_jobs j WHERE job_id IN (20, 60, 100)", "fx_jobs", "fx_locations")


def job_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    (jobs,) = _views(spark, sf_dir, "fx_jobs")
    return R.snapshot(jobs)


ORACLE_SQL["job_snapshot"] = sql("SELECT job_id, title, CASE WHEN posting_company_name IS NULL OR trim(posting_company_name) = '' OR posting_company_name = hiring_company_name THEN hiring_company_name ELSE hiring_company_name || ' (through agency ' || posting_company_name || ')' END AS company FROM fx_jobs WHERE NOT is_deleted", "fx_jobs")


def history_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    (history,) = _views(spark, sf_dir, "fx_history")
    return J.keyset_page(history, 7, (datetime(2024, 1, 20), 5000), 100).select("history_id", "ts", "action", "cursor")


CURSOR = "translate(base64(encode(strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 > 0 THEN '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '|' || history_id)), '+/', '-_')"
ORACLE_SQL["history_keyset_page"] = sql(f"""SELECT history_id, ts, action, {CURSOR} AS cursor
    FROM fx_history WHERE job_id = 7 AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND history_id < 5000)) ORDER BY ts DESC, history_id DESC LIMIT 100""", "fx_history")


def history_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind the cursor of the first page's last row, over one job's history that holds all events; some times have
    fractions of a second."""
    (history,) = _views(spark, sf_dir, "fx_history")
    rows = history.withColumn("job_id", F.lit(7)).withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("history_id") % 3 / 8))
    last = J.keyset_page(rows, 7, None, 60).select("ts", "history_id", "cursor").orderBy("ts", "history_id").limit(1)
    at = last.select(J.read_cursor(F.col("cursor")).alias("c")).first()
    return J.keyset_page(rows, 7, (at.c.ts, at.c.id) if at else None, 60).select("history_id", "ts", "cursor")


ORACLE_SQL["history_next_page"] = sql(f"""WITH h AS (SELECT history_id, ts + (history_id % 3) * INTERVAL '125' MILLISECOND AS ts FROM fx_history)
    SELECT history_id, ts, {CURSOR} AS cursor FROM h ORDER BY ts DESC, history_id DESC LIMIT 60 OFFSET 60""", "fx_history")


def report_status_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, jobs = _views(spark, sf_dir, "fx_history", "fx_jobs")
    return R.status_changes(history, jobs, USER, datetime(2024, 1, 5), datetime(2024, 1, 20))


def report_status_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = R.grouped(report_status_flat(spark, sf_dir))
    return grouped.select("job_id", "n", F.array_join(F.transform("statuses", lambda s: F.concat_ws("@", s["status"], s["ts"].cast("string"))), "; ").alias("statuses"))


STATUS = """CASE WHEN action LIKE 'status:%' AND length(action) > 7 THEN substr(action, 8)
    WHEN action = 'status_changed' AND json_valid(details) THEN coalesce(
      CASE WHEN json_type(details, '$.to') = 'VARCHAR' THEN json_extract_string(details, '$.to') END, CASE WHEN json_type(details, '$.status') = 'VARCHAR' THEN json_extract_string(details, '$.status') END,
      CASE WHEN json_type(details, '$.data.to') = 'VARCHAR' THEN json_extract_string(details, '$.data.to') END, CASE WHEN json_type(details, '$.data.status') = 'VARCHAR' THEN json_extract_string(details, '$.data.status') END) END"""
FLAT = f"""SELECT h.job_id, j.title, h.ts, {STATUS} AS status, h.history_id FROM fx_history h JOIN fx_jobs j ON j.job_id = h.job_id
    WHERE actor_type = 'user' AND actor_id = {USER} AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND (action = 'status_changed' OR action LIKE 'status:%') AND {STATUS} IS NOT NULL"""
ORACLE_SQL["report_status_flat"] = sql(FLAT, "fx_history", "fx_jobs")
ORACLE_SQL["report_status_grouped"] = sql(f"SELECT job_id, count(*) AS n, string_agg(status || '@' || CAST(ts AS VARCHAR), '; ' ORDER BY ts, history_id) AS statuses FROM ({FLAT}) GROUP BY job_id", "fx_history", "fx_jobs")


def status_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    (status,) = _views(spark, sf_dir, "fx_user_job_status")
    label = F.col("status")
    return status.select("job_id", "user_id", statuses.status_key(label).alias("key"), statuses.status_key_sql(label).alias("key_sql"), statuses.suggest_next(label).alias("next"), F.element_at(statuses.suggest_actions(label), 2).alias("second"), statuses.clean_label(label).alias("label"))


BASE = "lower(trim(status))"
COMMON = f"""WHEN {BASE} = 'applied' THEN 'applied' WHEN {BASE} = 'screening booked' THEN 'booked-screen' WHEN {BASE} = 'screening done' THEN 'done-screen' WHEN {BASE} = 'got offer' THEN 'offer'
    WHEN {BASE} IN ('rejected with filled', 'ignored') THEN 'finished'"""
ORACLE_SQL["status_keys"] = sql(f"""SELECT job_id, user_id, CASE {COMMON} ELSE 'default' END AS key, CASE {COMMON} WHEN {BASE} = 'more interview booked' THEN 'booked-more' ELSE 'default' END AS key_sql,
    CASE {BASE} WHEN 'applied' THEN 'Screening Booked' WHEN 'screening booked' THEN 'Screening Done' WHEN 'screening done' THEN 'HM interview Booked' WHEN 'got offer' THEN 'Accepted Offer' ELSE 'Applied' END AS next,
    'Rejected with Unfortunately' AS second, trim(status) AS label FROM fx_user_job_status""", "fx_user_job_status")

for _f in (jobs_search_multiterm, jobs_hydrated_locations, status_lookup_default, score_lookup_default, job_exists_probe, job_get_children, job_snapshot, history_keyset_page, history_next_page, report_status_flat, report_status_grouped, status_keys):
    QUERIES[_f.__name__] = _f
