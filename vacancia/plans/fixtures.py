"""Stand-ins for the application's tables, derived from the driver's: one SQL text each for Spark and for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: Each view reads the driver's tables only.
VIEWS: dict[str, str] = {
    "fx_jobs": """
        SELECT o.o_orderkey AS job_id,
          CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_custkey % 50 END AS created_by_user_id,
          concat('prov', o.o_orderkey % 8) AS provider, concat('t', o.o_custkey % 40) AS provider_tenant,
          concat('x', o.o_orderkey % 9000) AS external_id,
          o.o_orderpriority AS title, c.c_name AS hiring_company_name,
          CASE WHEN o.o_orderkey % 5 = 0 THEN c.c_mktsegment END AS posting_company_name,
          CASE o.o_orderstatus WHEN 'F' THEN 'Remote' WHEN 'O' THEN 'Onsite' ELSE 'Hybrid' END AS remote_type,
          o.o_orderdate AS created_at,
          CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderdate + INTERVAL '30' DAY END AS updated_at,
          (o.o_orderkey % 20 = 0) AS is_deleted
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    """,
    "fx_locations": """
        SELECT o.o_orderkey AS job_id, n.n_name AS country_name,
          concat('C', chr(CAST(65 + n.n_nationkey AS INT))) AS country_code,
          CASE WHEN o.o_orderkey % 2 = 0 THEN c.c_mktsegment END AS city_name, r.r_name AS region
        FROM orders o JOIN customer c ON c.c_custkey = (o.o_custkey) JOIN nation n ON n.n_nationkey = c.c_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey
        UNION ALL
        SELECT o.o_orderkey, n.n_name, concat('C', chr(CAST(65 + n.n_nationkey AS INT))), CAST(NULL AS VARCHAR(20)), CAST(NULL AS VARCHAR(20))
        FROM orders o JOIN nation n ON n.n_nationkey = o.o_orderkey % 25 WHERE o.o_orderkey % 3 = 0
    """,
    "fx_user_job_status": """
        SELECT l_orderkey AS job_id, l_suppkey AS user_id,
          CASE max(l_linenumber) WHEN 1 THEN 'Applied' WHEN 2 THEN 'Screening Booked' WHEN 3 THEN ' screening done '
            WHEN 4 THEN 'Got Offer' WHEN 5 THEN 'Rejected with Filled' WHEN 6 THEN 'Ignored' ELSE 'More interview Booked' END AS status,
          max(l_shipdate) AS last_updated
        FROM lineitem GROUP BY l_orderkey, l_suppkey
    """,
    "fx_scores": """
        SELECT l_orderkey AS job_id, (l_suppkey + 1) % 50 AS user_id,
          CAST(round(max(l_discount) * 100, 1) AS DECIMAL(4,1)) AS score, max(l_shipdate) AS calculated_at
        FROM lineitem GROUP BY l_orderkey, (l_suppkey + 1) % 50
    """,
    "fx_history": """
        SELECT event_id AS history_id, event_id % 1500 AS job_id, ts, 'user' AS actor_type, user_id AS actor_id,
          CASE event_type WHEN 'click' THEN 'status_changed' WHEN 'signup' THEN 'status:Applied' WHEN 'purchase' THEN 'job_updated' ELSE 'status_changed' END AS action,
          CASE event_type WHEN 'click' THEN concat('{"v":1,"kind":"status_changed","data":{"from":"Unset","to":"S', event_id % 7, '"}}')
            WHEN 'error' THEN concat('{"to":"R', event_id % 5, '"}') ELSE props END AS details
        FROM events
    """,
    "fx_events": """
        SELECT event_id, ts AS occurred_at,
          CASE event_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'jobs' WHEN 2 THEN 'users' ELSE 'enrichers' END AS source_domain,
          CASE WHEN event_id % 5 <> 0 THEN concat('p', event_id % 3000) END AS producer_event_id,
          user_id, event_type AS event_name, props AS properties_json FROM events
    """,
    "fx_dispatch": """
        SELECT event_id AS dispatch_id, event_id,
          CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'sent' WHEN 2 THEN 'retry' WHEN 3 THEN 'dead' ELSE 'sending' END AS status,
          event_id % 10 AS attempt_count, ts + INTERVAL '1' HOUR AS next_attempt_at,
          CASE WHEN event_id % 5 = 1 THEN ts END AS sent_at FROM events
    """,
    "fx_runs": """
        SELECT event_id AS run_id, 'compatibility.v1' AS enricher_type, concat(user_id, ':', event_id % 7) AS subject_key,
          CASE event_type WHEN 'click' THEN 'Queued' WHEN 'signup' THEN 'Leased' WHEN 'purchase' THEN 'Succeeded' ELSE 'Pending' END AS status,
          ts AS requested_at, ts + INTERVAL '20' MINUTE AS lease_until FROM events
    """,
    "fx_provider_results": """
        SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS sequence,
          concat(lower(l_returnflag), ':', lower(l_linestatus)) AS health_partition, concat('tenant', l_suppkey) AS tenant,
          CASE WHEN l_linenumber = 7 THEN 'skipped' WHEN l_linenumber IN (5, 6) THEN 'error' ELSE 'ok' END AS status,
          CASE WHEN l_linenumber = 5 THEN 'rate_limited' WHEN l_linenumber = 6 THEN 'http_4xx' END AS error_class,
          CASE WHEN l_linenumber = 6 THEN CASE WHEN l_partkey % 2 = 0 THEN 404 ELSE 403 END END AS http_status,
          CAST(floor(CASE WHEN l_linenumber < 5 THEN l_quantity ELSE 0 END) AS INT) AS jobs_returned,
          CAST(floor(l_extendedprice) AS BIGINT) AS duration_ms
        FROM lineitem
    """,
    "fx_candidates": """
        SELECT page_id AS sequence, concat('prov', page_id % 8) AS source_provider, url,
          CASE WHEN page_id % 31 = 0 THEN '' ELSE concat(CASE page_id % 3 WHEN 0 THEN 'Product Manager ' WHEN 1 THEN 'Software Intern ' ELSE 'International Lead ' END, page_id) END AS title,
          CASE page_id % 5 WHEN 0 THEN 'Berlin, Germany' WHEN 1 THEN 'Remote (US only)' WHEN 2 THEN '' WHEN 3 THEN 'Munich; Hamburg' ELSE 'Hybrid - Paris' END AS raw_location,
          html FROM pages
    """,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the tables of ``sf_dir``."""
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if f" {t} " in f" {text} ".replace("\n", " ").replace(",", " ")]
    frames = {f"{t}_": table(spark, sf_dir, t) for t in used}
    for t in used:
        text = _named(text, t)
    return spark.sql(text, **frames)


def _named(text: str, name: str) -> str:
    """``FROM name`` and ``JOIN name`` as references to a frame that is passed along, so that no view is registered."""
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {name}", f"{word} {{{name}_}}")
    return text


def sql(body: str, *names: str) -> str:
    """``body`` with the views ``names`` in front of it, for DuckDB."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not views:
        return body
    text = body.strip()
    return f"WITH {views}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {views} {text}"


def registrar(queries: dict[str, Callable[[SparkSession, str], DataFrame]], oracle: dict[str, str]) -> Callable:
    """A decorator that registers a function of the named views and tables, and the SQL that says the same."""

    def query(text: str | None, *sources: str) -> Callable:
        def register(f: Callable[..., DataFrame]) -> Callable:
            queries[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, s) if s in VIEWS else table(spark, sf_dir, s) for s in sources])
            if text is not None:
                oracle[f.__name__] = sql(text, *[s for s in sources if s in VIEWS])
            return f

        return register

    return query
