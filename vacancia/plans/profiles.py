"""Queries over saved filters, schedules, working times and the remaining state changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import profiles, texts
from vacancia.operators import discovery as D
from vacancia.operators import eligibility, job_lists, scheduling
from vacancia.operators import health as H
from vacancia.operators import upserts as U
from vacancia.operators.numbering import numbered
from vacancia.plans.fixtures import registrar, sql, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-25 00:00:00'"


def now() -> F.Column:
    return F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")


query = registrar(QUERIES, ORACLE_SQL)


def _last_sunday(month: int) -> str:
    return f"(make_date(year(ts), {month}, 31) - CAST(isodow(make_date(year(ts), {month}, 31)) % 7 AS INT))::TIMESTAMP + INTERVAL '1' HOUR"


@query(f"""WITH l AS (SELECT event_id, ts + CASE WHEN ts >= {_last_sunday(3)} AND ts < {_last_sunday(10)} THEN INTERVAL '2' HOUR ELSE INTERVAL '1' HOUR END AS t FROM events)
    SELECT event_id, (t::DATE - CASE WHEN t::TIME < TIME '06:30:00' THEN 1 ELSE 0 END)::VARCHAR AS daily,
    (CASE WHEN d = 0 AND t::TIME < TIME '06:30:00' THEN t::DATE - 7 ELSE t::DATE - d END)::VARCHAR AS weekly FROM (SELECT *, CAST((isodow(t::DATE) - 1 - 2 + 7) % 7 AS INT) AS d FROM l)""", "events")
def schedule_slots(events: DataFrame) -> DataFrame:
    """Slots in Berlin, an hour ahead of UTC and two in summer: daily at 6:30, weekly on Wednesdays."""
    slot = lambda day=None: scheduling.latest_slot(F.col("ts"), "Europe/Berlin", 6, 30, day).cast("string")
    return events.select("event_id", slot().alias("daily"), slot(2).alias("weekly"))


@query(f"SELECT run_id, CASE WHEN run_id % 9 = 0 THEN 'run' WHEN run_id % 4 = 0 THEN 'already_completed' WHEN requested_at > {NOW} - INTERVAL '2880' MINUTE THEN 'skipped_minimum_spacing' WHEN run_id % 5 >= 3 THEN 'retry_exhausted' ELSE 'run' END AS decision FROM fx_runs", "fx_runs")
def schedule_decision(runs: DataFrame) -> DataFrame:
    k = F.col("run_id")
    return runs.select("run_id", scheduling.task_decision(F.lit("a"), F.when(k % 4 == 0, "a").when(k % 4 == 1, "b"), F.col("requested_at"), k % 5, now(), 2880, 3, k % 9 == 0).alias("decision"))


@query(f"SELECT run_id, row_number() OVER (PARTITION BY status ORDER BY requested_at DESC, run_id DESC) <= 50 OR requested_at > {NOW} - INTERVAL '3' DAY AS keep FROM fx_runs", "fx_runs")
def runs_retained(runs: DataFrame) -> DataFrame:
    return scheduling.retained(runs, "status", "requested_at", "run_id", now(), 50, 3).select("run_id", "keep")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Screening Booked' WHEN 1 THEN NULL ELSE 'HM interview Done' END AS status, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'hello big ' || c_name ELSE '' END AS query, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name ELSE 'done' END AS fallback FROM customer", "customer")
def message_status(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit(" screening BOOKED  "), F.col("c_name"))).when(k == 1, F.concat(F.lit("hello big "), F.col("c_name"))).otherwise("HM interview done")
    found = profiles.leading_status(text)
    return customer.select("c_custkey", found["status"].alias("status"), found["query"].alias("query"), profiles.query_without_status(text).alias("fallback"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 4 = 2 THEN '' ELSE 'Dev,lead' END END AS title_positive, CASE WHEN c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE '' END END AS location_block, CASE WHEN c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 4 = 2 THEN 'remote' ELSE '' END END AS remote_types FROM customer", "customer")
def saved_filter_profile(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % 4
    text = (
        F.when(k == 0, '{"filters":{"titleFilter":{"include":["Dev"," dev ","lead",""]}}}')
        .when(k == 1, F.concat(F.lit('{"title":{"keywords":["Dev","lead"]},"location_filter":{"exclude":"'), F.col("c_mktsegment"), F.lit('"}}')))
        .when(k == 2, '{"remote":{"types":["remote"]}}')
        .otherwise('{"unknown":1}')
    )
    found = profiles.discovery_profiles(customer.select("c_custkey", text.alias("filter")), "filter")
    return found.select("c_custkey", *[F.array_join(n, ",").alias(n) for n in ("title_positive", "location_block", "remote_types")])


@query("SELECT l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'German:C1' WHEN 1 THEN 'German:B2,EN:B1' ELSE 'French:B1' END AS languages FROM (SELECT DISTINCT l_linenumber FROM lineitem)", "lineitem")
def language_lists(lineitem: DataFrame) -> DataFrame:
    n = F.col("l_linenumber") % 3
    text = F.when(n == 0, '{"german":"fluent"}').when(n == 1, '[{"Language":"German","CEFR":"B2"},{"name":"en"},{"level":"C1"}]').otherwise('["french"," "]')
    rows = lineitem.select("l_linenumber").distinct()
    return rows.select("l_linenumber", F.array_join(F.transform(profiles.language_list(text), lambda x: F.concat_ws(":", x["language"], x["level"])), ",").alias("languages"))


@query("SELECT c_custkey, c_name AS title, c_mktsegment AS company, CASE WHEN c_custkey % 2 = 0 THEN 'Applied' END AS status FROM customer", "customer")
def search_items(customer: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(F.col("c_name").alias("JobTitle"), F.col("c_mktsegment").alias("hiringCompanyName"), F.when(F.col("c_custkey") % 2 == 0, "Applied").alias("currentUserStatus")))
    item = profiles.search_item(body)
    return customer.select("c_custkey", *[item[c].alias(c) for c in ("title", "company", "status")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'europe' WHEN c_custkey % 3 = 1 THEN 'north_america_east' END AS region, CASE WHEN c_custkey % 3 = 0 THEN 'required' ELSE 'preferred' END AS strength FROM customer WHERE c_custkey % 3 < 2", "customer")
def work_time_regions(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "<p>Hello.</p>You must overlap with CET working hours. Budget is 5 ET.").when(k == 1, "Ideally available in Eastern  time.").otherwise("We met in the CET building.")
    return scheduling.work_time_regions(customer.select("c_custkey", text.alias("t")), "c_custkey", "t")


@query("SELECT count(*) FILTER (WHERE k = 0) AS eligible, count(*) FILTER (WHERE k = 1) AS missing_cv, count(*) FILTER (WHERE k = 2) AS missing_text, count(*) FILTER (WHERE k = 3) AS missing_version FROM (SELECT c_custkey % 4 AS k FROM customer)", "customer")
def eligibility_counts(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey") % 4
    return eligibility.status_counts(customer, F.when(k == 1, "missing_cv").when(k == 2, "missing_text").when(k == 3, "missing_version"))


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0", "customer")
def eligible_users(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    preferences = customer.select(k.alias("user_id"), F.when(k % 5 > 0, "cv").alias("cv_blob_path"), F.lit("t").alias("cv_text_blob_path"), F.when(k % 7 > 0, "v").otherwise(" ").alias("cv_version_id"))
    return eligibility.eligible(customer.select(k.alias("user_id"), F.col("c_name").alias("name")), preferences).select("user_id", "name")


@query("WITH p AS (SELECT c_custkey AS user_id, c_name AS cv FROM customer), c AS (SELECT c_custkey * 2 AS user_id, 'new' AS cv FROM customer WHERE c_custkey % 3 = 0) SELECT * FROM c UNION ALL SELECT * FROM p WHERE user_id NOT IN (SELECT user_id FROM c)", "customer")
def preferences_merge(customer: DataFrame) -> DataFrame:
    before = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("cv"))
    return U.merge(before, customer.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("user_id"), F.lit("new").alias("cv")), ["user_id"])


@query("SELECT run_id, subject_key FROM fx_runs WHERE NOT (run_id % 10 = 0 AND run_id % 20 = 0)", "fx_runs")
def filters_owned_delete(runs: DataFrame) -> DataFrame:
    wanted = runs.where("run_id % 10 = 0").select("run_id", F.when(F.col("run_id") % 20 == 0, F.col("subject_key")).otherwise("another").alias("subject_key"))
    return U.owned_delete(runs.select("run_id", "subject_key"), wanted, "run_id", "subject_key")


@query("SELECT job_id, quantile_cont(n, 0.5) AS median FROM (SELECT job_id, unnest(CASE job_id % 3 WHEN 0 THEN [1, 9, 4] WHEN 1 THEN [5, 2, 8, 1] ELSE [CAST(job_id % 7 AS INT)] END) AS n FROM fx_jobs) GROUP BY job_id", "fx_jobs")
def median_of_counts(jobs: DataFrame) -> DataFrame:
    k = F.col("job_id")
    ints = lambda *v: F.array(*map(F.lit, v))
    return jobs.select("job_id", H.median(F.when(k % 3 == 0, ints(1, 9, 4)).when(k % 3 == 1, ints(5, 2, 8, 1)).otherwise(F.array((k % 7).cast("int")))).alias("median"))


@query("SELECT sequence, phase, row_number() OVER (ORDER BY phase, sequence) AS position FROM (SELECT sequence, CASE WHEN sequence % 6 = 0 THEN 0 ELSE 1 END AS phase FROM fx_candidates)", "fx_candidates")
def two_phase_order(c: DataFrame) -> DataFrame:
    """Priority targets before normal ones, each in sequence."""
    rows = c.select("sequence", F.when(F.col("sequence") % 6 == 0, 0).otherwise(1).alias("phase"))
    return numbered(rows, ["phase", "sequence"], "position")


@query("SELECT user_id, job_id, status FROM (SELECT us.user_id, us.job_id, us.status, row_number() OVER (PARTITION BY us.user_id ORDER BY j.created_at DESC, j.job_id DESC) AS rn FROM fx_user_job_status us JOIN fx_jobs j USING (job_id) WHERE NOT is_deleted) WHERE rn <= 5", "fx_user_job_status", "fx_jobs")
def active_jobs_per_user(status: DataFrame, jobs: DataFrame) -> DataFrame:
    return job_lists.newest_per_user(status, jobs, 5)


@query("SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'unchanged' ELSE 'updated' END AS outcome FROM fx_jobs", "fx_jobs")
def description_repair(jobs: DataFrame) -> DataFrame:
    new = F.when(F.col("job_id") % 3 == 0, F.col("title")).otherwise(F.concat("title", F.lit("!")))
    return jobs.select("job_id", U.repair(F.col("title"), new).alias("outcome"))


@query("SELECT sequence, CASE WHEN sequence % 2 = 0 THEN TRY_CAST(sequence AS BIGINT) END AS telegram_id FROM fx_candidates", "fx_candidates")
def cast_backfill(c: DataFrame) -> DataFrame:
    text = F.when(F.col("sequence") % 2 == 0, F.col("sequence").cast("string")).otherwise("x1")
    return U.backfilled(c.select("sequence", text.alias("text")), "text", "telegram_id").drop("text")


@query("SELECT sequence, NOT contains(lower(source_provider), 'prov3') AND (contains(lower(source_provider), 'prov1') OR contains(lower(source_provider), 'prov2')) AS allowed FROM fx_candidates", "fx_candidates")
def company_filter(c: DataFrame) -> DataFrame:
    return c.select("sequence", D.title_allowed(F.col("source_provider"), ("prov1", "prov2"), ("prov3",)).alias("allowed"))


@query(None, "pages")
def safe_descriptions(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", profiles.safe_description(F.col("html")).alias("html"))


@query("SELECT doc_id, to_json({'v': 1, 'kind': 'k', 'data': lang}) AS envelope, lang AS data FROM documents", "documents")
def history_envelopes(documents: DataFrame) -> DataFrame:
    e = texts.history_envelope(F.lit("k"), F.col("lang"))
    return documents.select("doc_id", e.alias("envelope"), texts.unwrap_envelope(e).alias("data"))
