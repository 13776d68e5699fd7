"""Queries over users, forms, parameters, run projections, partitions, labels and catalogue metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import scores, texts, urls
from vacancia.operators import accounts as A
from vacancia.operators import discovery as D
from vacancia.operators import events as E
from vacancia.operators import health as H
from vacancia.operators import job_lists as J
from vacancia.operators import planning as P
from vacancia.operators import places
from vacancia.plans.fixtures import registrar
from vacancia.plans.state import NOW, now

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)


def _users(customer: DataFrame) -> DataFrame:
    """Two thirds of the customers as users, a third of whom have an account linked and a quarter a code."""
    k = F.col("c_custkey")
    return customer.where(k % 3 != 0).select(
        k.alias("user_id"), F.concat(F.lit("b2c"), k.cast("string")).alias("object_id"), F.col("c_name").alias("username"), F.when(k % 3 == 1, k + 1000).alias("account_id"),
        F.when(k % 4 == 0, F.concat(F.lit("code"), k.cast("string"))).alias("link_code"), F.lit(None).cast("timestamp_ntz").alias("linked_at"),
    )


USERS = "SELECT c_custkey AS user_id, 'b2c' || c_custkey AS object_id, c_name AS username, CASE WHEN c_custkey % 3 = 1 THEN c_custkey + 1000 END AS account_id, CASE WHEN c_custkey % 4 = 0 THEN 'code' || c_custkey END AS link_code FROM customer WHERE c_custkey % 3 <> 0"


@query(f"WITH u AS ({USERS}), a AS (SELECT DISTINCT o_custkey + 1000 AS account_id FROM orders) SELECT account_id, user_id, username FROM a LEFT JOIN u USING (account_id)", "customer", "orders")
def users_by_account(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return A.by_key(_users(customer), orders.select((F.col("o_custkey") + 1000).alias("account_id")), "account_id").select("account_id", "user_id", "username")


@query(f"WITH u AS ({USERS}), s AS (SELECT 'b2c' || c_custkey AS object_id, c_name || '!' AS username FROM customer) SELECT object_id, username, false AS created FROM u UNION ALL SELECT object_id, username, true FROM s WHERE object_id NOT IN (SELECT object_id FROM u)", "customer")
def users_get_or_create(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    rows = customer.select(F.concat(F.lit("b2c"), k.cast("string")).alias("object_id"), F.concat("c_name", F.lit("!")).alias("username"), F.lit(1).alias("nth"))
    again = rows.withColumns({"username": F.concat("username", F.lit("!")), "nth": F.lit(2)})
    return A.get_or_create(_users(customer), rows.unionByName(again), "object_id", "nth").select("object_id", "username", "created")


REQUESTS = "SELECT o_orderkey AS request_id, 'code' || o_custkey AS code, o_custkey + 1000 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS account_id FROM orders"
LINKED = f"""u AS ({USERS}), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY request_id) AS nth FROM ({REQUESTS})),
    j AS (SELECT r.request_id, u.user_id, r.account_id, CASE WHEN u.user_id IS NULL THEN 'invalid_code' WHEN u.account_id = r.account_id THEN 'already_linked' WHEN u.account_id IS NOT NULL THEN 'conflict' WHEN nth > 1 THEN 'invalid_code' ELSE 'linked' END AS outcome FROM r LEFT JOIN u ON u.link_code = r.code)"""


def _requests(orders: DataFrame) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return orders.select(k.alias("request_id"), F.concat(F.lit("code"), c.cast("string")).alias("code"), (c + 1000 + F.when(k % 5 == 0, 1).otherwise(0)).alias("account_id"))


@query(f"WITH {LINKED} SELECT request_id, user_id, outcome FROM j", "customer", "orders")
def link_outcomes(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return A.link(_users(customer), _requests(orders), now())[0]


@query(f"WITH {LINKED}, l AS (SELECT user_id, account_id AS new FROM j WHERE outcome = 'linked'), a AS (SELECT user_id, coalesce(new, account_id) AS account_id, CASE WHEN new IS NULL THEN link_code END AS link_code, CASE WHEN new IS NOT NULL THEN {NOW} END AS linked_at FROM u LEFT JOIN l USING (user_id)) SELECT user_id, CASE WHEN account_id % 7 <> 0 THEN account_id END AS account_id, link_code, CASE WHEN account_id % 7 <> 0 THEN linked_at END AS linked_at FROM a", "customer", "orders")
def link_then_unlink(customer: DataFrame, orders: DataFrame) -> DataFrame:
    users = A.link(_users(customer), _requests(orders), now())[1]
    gone = orders.select((F.col("o_custkey") + 1000).alias("account_id")).union(orders.select(F.col("o_custkey") + 1001)).where("account_id % 7 = 0")
    return A.unlink(users, gone).select("user_id", "account_id", "link_code", "linked_at")


@query("SELECT job_id, nullif(trim(title), '') AS title, hiring_company_name, CASE WHEN job_id % 2 = 0 THEN NULL ELSE posting_company_name END AS posting_company_name, remote_type FROM fx_jobs", "fx_jobs")
def form_update_fields(jobs: DataFrame) -> DataFrame:
    blank = F.when(F.col("job_id") % 2 == 0, "  ").otherwise(F.col("posting_company_name"))
    return A.form_fields(jobs.withColumns({"title": F.concat(F.lit(" "), F.col("title"), F.lit(" ")), "posting_company_name": blank}), "job_id", for_update=True)


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a,b c,d' WHEN 1 THEN 'x' ELSE '' END AS vals FROM pages", "pages")
def parameter_values(pages: DataFrame) -> DataFrame:
    k = F.col("page_id") % 3
    url = F.when(k == 0, "https://a.example/p?city=a,b%20c&q=1&city=d&city=").when(k == 1, "https://a.example/?city=,x,&citys=9").otherwise("https://a.example/?q=1")
    return pages.select("page_id", F.array_join(A.many_values(url, "city"), ",").alias("vals"))


@query("SELECT event_name AS name, count(*) AS n, max(occurred_at) AS last_at FROM fx_events WHERE event_name IN ('click', 'error') GROUP BY 1 UNION ALL SELECT 'never', 0, NULL", "fx_events")
def worker_counters(events: DataFrame) -> DataFrame:
    return A.counters(events.select(F.col("event_name").alias("name"), F.col("occurred_at").alias("at")), ["click", "error", "never"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"a\":1}' WHEN event_id % 3 = 1 THEN '\"not json\"' END AS result FROM fx_events", "fx_events")
def run_projection(events: DataFrame) -> DataFrame:
    k = F.col("event_id") % 3
    rows = events.select("event_id", F.when(k == 0, '{"a": 1}').when(k == 1, "not json").alias("result_json"), F.lit(None).cast("string").alias("enrichment_attributes_json"))
    return A.public_run(rows).select("event_id", F.to_json("result").alias("result"))


@query("SELECT job_id, CASE WHEN job_id % 5 = 0 THEN '(none)' ELSE CASE WHEN job_id % 2 = 0 THEN 'DE: Bonn' ELSE 'Germany: Hesse' END || ' · ' || 'France' END AS label FROM fx_jobs", "fx_jobs")
def locations_label(jobs: DataFrame) -> DataFrame:
    even = F.col("job_id") % 2 == 0
    text = lambda v: F.lit(v).cast("string")
    one = F.struct(F.when(even, "DE").otherwise("").alias("country_code"), F.lit("Germany").alias("country_name"), F.when(even, "Bonn").alias("city_name"), F.lit("Hesse").alias("region"))
    two = F.struct(text(None).alias("country_code"), F.lit("France").alias("country_name"), text("").alias("city_name"), text(None).alias("region"))
    return jobs.select("job_id", places.locations_label(F.when(F.col("job_id") % 5 != 0, F.array(one, two))).alias("label"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'successfactors:csb' WHEN 1 THEN 'successfactors:rmk' WHEN 2 THEN 'successfactors:csb' ELSE 'lever' END AS health_partition FROM supplier", "supplier")
def health_partitions(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey") % 4
    provider = F.when(k < 3, " SuccessFactors ").otherwise("Lever")
    variant = H.provider_variant(provider, F.when(k == 0, "CSB "), F.when(k == 2, "https://x.jobs.hr.cloud.sap/y").otherwise("https://career.example/"))
    return supplier.select("s_suppkey", H.health_partition(provider, variant).alias("health_partition"))


@query("""WITH c AS (SELECT 'prov' || k AS provider, k AS planned FROM range(10) t(k)), e AS (SELECT source_provider AS provider, count(*) AS candidates, count(*) FILTER (WHERE sequence % 4 <> 0) AS checked, count(*) FILTER (WHERE sequence % 4 <> 0 AND sequence % 3 = 0) AS existing, count(*) FILTER (WHERE sequence % 4 = 0) AS errors FROM fx_candidates WHERE sequence % 5 > 0 GROUP BY 1)
    SELECT provider, planned, coalesce(candidates, 0) AS candidates, coalesce(checked, 0) AS checked, coalesce(existing, 0) AS existing, coalesce(errors, 0) AS errors, coalesce(checked - existing, 0) AS missing, CASE WHEN checked > 0 THEN round(existing / checked, 4) END AS existing_ratio FROM c LEFT JOIN e USING (provider)""", "fx_candidates")
def catalogue_metrics(c: DataFrame) -> DataFrame:
    catalogues = c.sparkSession.range(10).select(F.concat(F.lit("prov"), F.col("id").cast("string")).alias("provider"), F.col("id").alias("planned"))
    k = F.col("sequence")
    rows = c.select("source_provider", F.when(k % 5 == 0, "portal").otherwise("catalog").alias("source_mode"), F.when(k % 4 == 0, "error").otherwise("ok").alias("status"), (k % 3 == 0).alias("exists"))
    return H.catalogue_metrics(catalogues, rows)


@query("SELECT s_suppkey, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS disabled FROM supplier", "supplier", "nation")
def disabled_targets(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    off = nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return P.without_disabled(supplier.select("s_suppkey", "s_nationkey"), off, ["s_nationkey"]).select("s_suppkey", "disabled")


@query("SELECT s_suppkey, s_suppkey % 10 <> 0 AS skipped FROM supplier", "supplier")
def targets_without_users(supplier: DataFrame) -> DataFrame:
    """A run for several users none of whom is eligible."""
    targets = supplier.select("s_suppkey", (F.col("s_suppkey") % 10 == 0).alias("health_only"))
    return D.execution_targets(targets, supplier.where("s_suppkey < 0")).select("s_suppkey", "skipped")


@query("SELECT count(*) AS eligible_users, count(*) FILTER (WHERE c_custkey % 3 > 0) AS users_with_saved_filters, count(*) FILTER (WHERE c_custkey % 3 = 1) AS users_with_valid_profiles, count(*) FILTER (WHERE c_custkey % 3 = 2) AS users_failing_closed, sum(CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 4 + 1 ELSE 0 END) AS profile_count FROM customer", "customer")
def matcher_stats(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return D.profile_stats(customer.select((k % 3 > 0).alias("has_saved_filters"), F.when(k % 3 == 1, k % 4 + 1).otherwise(0).alias("profiles")))


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'missing_external_id' WHEN 1 THEN 'missing_hiring_company' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'validation_failed' ELSE 'unknown' END AS failure FROM supplier", "supplier")
def create_failures(supplier: DataFrame) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("ExternalId is required", "Hiring Company is required", "Invalid JSON", "could not deduce it", "duplicate key", None))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return supplier.select("s_suppkey", E.create_failure(said).alias("failure"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'model_time_out_1' WHEN 1 THEN repeat('a', 80) WHEN 2 THEN NULL ELSE 'ab' END AS stage FROM supplier", "supplier")
def failure_stages(supplier: DataFrame) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, (" Model-time out.1 ", "A" * 90, "?!", "_a/b_"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return supplier.select("s_suppkey", texts.failure_stage(said).alias("stage"))


#: URLs with @ for the page's id; provider, tenant, job, confidence and warning.
PROXIED = [
    ("https://boards.greenhouse.io/acme@/jobs/4@", "greenhouse", "acme@", "4@", "high", None),
    ("https://boards.greenhouse.io/embed/job_app?for=acme@&token=7@", "greenhouse", "acme@", "7@", "high", None),
    ("https://boards.greenhouse.io/acme@", None, None, None, "none", "greenhouse_identity_not_found"),
    ("https://jobs.lever.co/acme@/ab-@", "lever", "acme@", "ab-@", "high", None),
    ("https://jobs.ashbyhq.com/acme@", None, None, None, "none", "ashby_identity_not_found"),
    ("https://acme@.wd3.myworkdayjobs.com/en/Dev_R-@", "workday", "acme@", "R-@", "high", None),
    ("https://acme@.wd3.myworkdayjobs.com/en/dev", "workday", "acme@", "dev", "medium", "workday_external_id_inferred_from_last_path_segment"),
    ("https://jobs.smartrecruiters.com/acme@/99@-dev-x", "smartrecruiters", "acme@", "99@", "medium", "smartrecruiters_external_id_inferred_from_slug_prefix"),
    ("https://example.com/acme@/1", None, None, None, "none", "unsupported_provider_url"),
]


def _case(nth: int) -> str:
    return "CASE page_id % 9 " + " ".join(f"WHEN {k} THEN " + ("NULL" if row[nth] is None else f"replace('{row[nth]}', '@', CAST(page_id AS VARCHAR))") for k, row in enumerate(PROXIED)) + " END"


@query("SELECT page_id, " + ", ".join(f"{_case(n)} AS {c}" for n, c in enumerate(("provider", "tenant", "external_id", "confidence", "warning"), 1)) + " FROM pages", "pages")
def proxy_identities(pages: DataFrame) -> DataFrame:
    url = F.replace(F.element_at(F.array(*[F.lit(row[0]) for row in PROXIED]), (F.col("page_id") % 9 + 1).cast("int")), F.lit("@"), F.col("page_id").cast("string"))
    return pages.select("page_id", urls.proxy_identity(url).alias("i")).select("page_id", "i.*")


@query("SELECT o_orderkey, j.job_id, j.job_id IS NOT NULL AS found, 'acme' || o_custkey % 40 AS tenant FROM (SELECT *, 'x' || o_orderkey % 9000 AS ext FROM orders) LEFT JOIN (SELECT 'acme' || substr(provider_tenant, 2) AS tenant, external_id, min(job_id) AS job_id FROM fx_jobs WHERE NOT is_deleted AND provider = 'prov1' GROUP BY ALL) j ON j.tenant = 'acme' || o_custkey % 40 AND j.external_id = ext", "orders", "fx_jobs")
def job_exists_by_url(orders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Orders as postings on a system, looked up among the jobs of one provider that stands for that system."""
    url = F.concat(F.lit("https://boards.greenhouse.io/acme"), (F.col("o_custkey") % 40).cast("string"), F.lit("/jobs/x"), (F.col("o_orderkey") % 9000).cast("string"))
    known = jobs.where("provider = 'prov1'").withColumns({"provider": F.lit("greenhouse"), "provider_tenant": F.concat(F.lit("acme"), F.substr("provider_tenant", F.lit(2)))})
    found = J.exists_probe_url(orders.select("o_orderkey", url.alias("url")), known, "url")
    return found.select("o_orderkey", "job_id", "found", F.col("provider_tenant").alias("tenant"))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 AS healthy, s_suppkey % 3 AS per_run, s_suppkey % 5 AS needed, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 4 END AS days FROM supplier)
    SELECT sum(healthy) AS healthy, sum(per_run) AS healthy_per_run, sum(needed) AS needed_per_run, max(days) AS sweep_days, 1000000 >= sum(needed) AS feasible FROM s""", "supplier")
def sweep_total(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    sweeps = supplier.select((k % 7).alias("healthy"), (k % 3).alias("healthy_per_run"), (k % 5).alias("needed_per_run"), F.when(k % 7 > 0, k % 4).alias("sweep_days"), F.lit(True).alias("feasible"))
    return P.whole_sweep(sweeps, 1_000_000)


@query("""WITH r AS (SELECT l.sequence, 'prov' || (sequence % 5) AS provider, tenant, CASE WHEN sequence % 3 > 0 THEN 'v' || (sequence % 3) END AS variant FROM fx_provider_results l),
    b AS (SELECT DISTINCT provider, tenant, variant, CASE WHEN variant IS NULL THEN 'old' ELSE 'new' END AS health FROM r WHERE variant IS NULL OR variant = 'v1')
    SELECT sequence, coalesce(e.health, p.health) AS health, e.health IS NULL AND p.health IS NOT NULL AS legacy FROM r LEFT JOIN b e ON e.provider = r.provider AND e.tenant = r.tenant AND e.variant IS NOT DISTINCT FROM r.variant LEFT JOIN b p ON p.provider = r.provider AND p.tenant = r.tenant AND p.variant IS NULL""", "fx_provider_results")
def tenant_previous_state(results: DataFrame) -> DataFrame:
    k = F.col("sequence")
    targets = results.select("sequence", F.concat(F.lit("prov"), (k % 5).cast("string")).alias("provider"), "tenant", F.when(k % 3 > 0, F.concat(F.lit("v"), (k % 3).cast("string"))).alias("variant"))
    before = targets.where("variant is null or variant = 'v1'").select("provider", "tenant", "variant").distinct().withColumn("health", F.when(F.col("variant").isNull(), "old").otherwise("new"))
    return H.with_previous(results.select("sequence", "status"), targets, before).select("sequence", "health", "legacy")


@query("WITH b AS (SELECT DISTINCT provider, CASE WHEN job_id % 2 = 0 THEN 'v' END AS variant FROM fx_jobs) SELECT provider, variant FROM b WHERE variant IS NOT NULL OR provider NOT IN ('prov2', 'prov4')", "fx_jobs")
def providers_retained(jobs: DataFrame) -> DataFrame:
    before = jobs.select("provider", F.when(F.col("job_id") % 2 == 0, "v").alias("variant")).distinct()
    seen = jobs.select("provider", F.when(F.col("provider").isin("prov2", "prov4"), "v").alias("variant"))
    return H.retained_providers(before, seen).select("provider", "variant")


@query("""WITH h AS (SELECT health_partition, CASE WHEN count(*) FILTER (WHERE status = 'error') * 4 > count(*) THEN 'degraded' ELSE 'healthy' END AS state FROM fx_provider_results WHERE health_partition <> 'a:f' GROUP BY 1),
    c AS (SELECT health_partition, CASE sequence % 3 WHEN 0 THEN 'listing_empty_anomaly' WHEN 1 THEN 'ok' END AS o, sequence FROM fx_provider_results WHERE health_partition NOT LIKE 'n%'),
    k AS (SELECT health_partition, count(*) AS canaries, count(*) FILTER (WHERE sequence % 2 = 0) AS degraded FROM fx_provider_results WHERE health_partition LIKE 'r%' GROUP BY 1),
    a AS (SELECT health_partition, count(*) FILTER (WHERE o = 'listing_empty_anomaly') AS empty, count(*) FILTER (WHERE o = 'ok') AS fine, count(*) FILTER (WHERE o IS NULL) AS unknown FROM c GROUP BY 1), p AS (SELECT DISTINCT health_partition FROM fx_provider_results)
    SELECT health_partition, coalesce(state, 'not_observed') AS state, coalesce(empty, 0) AS empty_anomalies, 0 AS volume_anomalies, coalesce(canaries, 0) AS canaries, coalesce(degraded, 0) AS degraded_canaries,
      array_to_string(list_filter([CASE WHEN empty > 0 THEN 'listing_empty_anomaly=' || empty END, CASE WHEN fine > 0 THEN 'ok=' || fine END, CASE WHEN unknown > 0 THEN 'unknown=' || unknown END], lambda x: x IS NOT NULL), ',') AS outcomes,
      array_to_string(list_filter([CASE WHEN state = 'degraded' THEN 'degraded' END, CASE WHEN empty > 0 THEN 'empty_listings' END, CASE WHEN degraded > 0 THEN 'canary_degraded' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM p LEFT JOIN h USING (health_partition) LEFT JOIN a USING (health_partition) LEFT JOIN k USING (health_partition)""", "fx_provider_results")
def partition_report(results: DataFrame) -> DataFrame:
    k = F.col("sequence")
    health = results.where("health_partition <> 'a:f'").groupBy("health_partition").agg(F.when(F.count_if(F.col("status") == "error") * 4 > F.count("*"), "degraded").otherwise("healthy").alias("state"))
    changes = results.where("health_partition NOT LIKE 'n%'").select("health_partition", F.when(k % 3 == 0, "listing_empty_anomaly").when(k % 3 == 1, "ok").alias("listing_outcome"))
    canaries = results.where("health_partition LIKE 'r%'").select("health_partition", F.when(k % 2 == 0, "degraded").otherwise("healthy").alias("verdict"))
    rows = H.partition_report(health, changes, canaries, results)
    text = F.coalesce(F.array_join(F.transform(F.map_entries("outcomes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), F.lit(""))
    return rows.withColumns({"outcomes": text, "warnings": F.array_join("warnings", ",")})


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'C' || chr(CAST(65 + c_nationkey AS INT)) WHEN 1 THEN 'CD' WHEN 2 THEN 'C' || chr(CAST(65 + c_nationkey AS INT)) WHEN 3 THEN 'CA' WHEN 5 THEN NULL END AS country_code FROM customer", "customer", "nation")
def country_typed(customer: DataFrame, nation: DataFrame) -> DataFrame:
    k, n = F.col("c_custkey") % 6, F.col("c_nationkey").cast("string")
    countries = nation.select(F.concat(F.lit("C"), F.char(65 + F.col("n_nationkey"))).alias("code"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("nth"))
    said = F.when(k == 0, F.concat(F.lit(" nation_"), n, F.lit(" "))).when(k == 1, "Anything (cd)").when(k == 2, F.concat(F.lit("c"), F.lower(F.char(65 + F.col("c_nationkey"))))).when(k == 3, "NAT").when(k == 4, "elsewhere").otherwise("x (zz)")
    return places.country_lookup(customer.select("c_custkey", said.alias("said")), "c_custkey", F.col("said"), countries)


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Fits well' WHEN 1 THEN repeat('d', 1800) || '... 200 symbols cut' ELSE 'Structured compatibility summary could not be reliably extracted.' END AS description,
    CASE WHEN s_suppkey % 3 = 0 THEN 'German=C1,English=B1' ELSE '' END AS applicant, CASE s_suppkey % 3 WHEN 0 THEN 7.3 WHEN 1 THEN 10 ELSE 0 END AS hard, CASE s_suppkey % 3 WHEN 0 THEN 'good' ELSE 'Hard skills match could not be reliably extracted.' END AS hard_text,
    CASE WHEN s_suppkey % 3 = 2 THEN 'description was absent|model output JSON parse failed: bad|raw model output snippet: {x' ELSE '' END AS notes FROM supplier""", "supplier")
def model_results(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey") % 3
    good = '{"Description":" Fits well ","Languages":{"Applicant":{"german":"advanced","English":""}},"HardSkills":{"Score":"7.26","summary":"good"}}'
    odd = F.concat(F.lit('{"summary":"'), F.repeat(F.lit("d"), 2000), F.lit('","hard_skills":{"value":12}}'))
    answer = F.when(k == 0, good).when(k == 1, odd).otherwise('{"__parse_error":"bad","__raw":"{x"}')
    rows = supplier.select("s_suppkey", scores.model_result(answer).alias("r"))
    spoken = F.array_join(F.transform("r.applicant_languages", lambda x: F.concat_ws("=", x["language"], x["level"])), ",")
    return rows.select("s_suppkey", "r.description", spoken.alias("applicant"), F.col("r.hard_skills.score").alias("hard"), F.col("r.hard_skills.description").alias("hard_text"), F.array_join("r.notes", "|").alias("notes"))


@query("SELECT c_custkey AS filter_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '!' END AS name FROM customer", "customer")
def filters_insert(customer: DataFrame) -> DataFrame:
    kept = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("filter_id"), F.col("c_name").alias("name"))
    new = customer.select(F.col("c_custkey").alias("filter_id"), F.concat("c_name", F.lit("!")).alias("name"))
    return A.add_filters(kept, new, "filter_id")


@query("SELECT c_custkey % 100 AS k, CASE k WHEN 3 THEN 'invalid_user_id' WHEN 4 THEN 'invalid_cv_version_id' WHEN 5 THEN 'duplicate_user' WHEN 6 THEN 'duplicate_user' WHEN 7 THEN 'missing_profiles' WHEN 8 THEN 'invalid_profile_count' WHEN 9 THEN 'invalid_cv_last_updated' WHEN 10 THEN 'invalid_profile' WHEN 11 THEN 'invalid_profile' WHEN 12 THEN 'too_many_profiles' END AS error FROM customer GROUP BY ALL", "customer")
def users_payload_errors(customer: DataFrame) -> DataFrame:
    """A payload of a hundred users, made of the customers' keys."""
    k = F.col("k")
    rows = customer.select((F.col("c_custkey") % 100).alias("k")).distinct()
    guid = lambda n: F.concat(F.lit("6F1C2D3E-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    profile = lambda terms: F.struct(F.lit(None).cast("string").alias("profile_id"), F.create_map(F.lit("title_positive"), terms).alias("lists"))
    one = F.array(profile(F.when(k == 10, F.array().cast("array<string>")).when(k == 11, F.array(F.repeat(F.lit("x"), 121))).otherwise(F.array(F.lit("lead")))))
    users = rows.select(
        F.when(k == 3, "nobody").when(k == 6, F.lower(guid(F.lit(5)))).otherwise(guid(k)).alias("user_id"), F.when(k == 4, " ").otherwise("v1").alias("cv_version_id"), F.when(k == 9, "yesterday").when(k == 2, "2024-01-01T00:00:00Z").alias("cv_last_updated"),
        F.lit(True).alias("has_saved_filters"), F.when(k == 8, 21).otherwise(0).alias("invalid_profile_count"), F.when(k == 12, F.array_repeat(F.get(one, F.lit(0)), 21)).when(k != 7, one).alias("profiles"), "k",
    )
    return D.users_error(users).withColumn("k", F.when(F.col("user_id") == "nobody", 3).when(F.col("user_id").contains("f1c"), 6).otherwise(F.substr("user_id", F.lit(25)).cast("int"))).select("k", "error")
