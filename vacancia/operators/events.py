"""Analytics events: validation in a fixed order, idempotent ingest, and the shape that a sink takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.identity import canonical_uuid
from vacancia.functions.scores import strict_utc
from vacancia.functions.texts import property_key

# Accepted names, domains and surfaces, and property keys that must not arrive.
EVENT_NAMES = (
    "Job Creation Started", "Job Duplicate Checked", "Job List Viewed", "Job Detail Viewed", "Job Search Performed", "Job Created", "Job Creation Failed", "Job Updated", "Job Deleted",
    "Job Status Changed", "CV Updated", "Compatibility Requested", "Compatibility Completed", "Compatibility Failed",
)
SOURCE_DOMAINS = ("core", "jobs", "users", "enrichers")
SOURCE_SURFACES = ("web", "worker", "timer", "system")
FORBIDDEN_KEYS = (
    "email", "display_name", "name", "telegram_account_id", "telegram_username", "cv_text", "cv_plaintext", "cv_delta", "cv_length", "job_title", "job_name", "company_name",
    "job_description", "description", "summary", "raw_url", "url", "external_id", "provider_external_id", "link_code", "function_key", "access_token", "token", "password", "cookie", "exception", "stack_trace",
)
LONGEST_VALUE = 1000


def required(value: Column, name: str, most: int) -> list[tuple[Column, str]]:
    text = F.trim(F.coalesce(value, F.lit("")))
    return [(text == "", f"missing_{name}"), (F.length(text) > most, f"{name}_too_long")]


def optional(value: Column, name: str, most: int) -> list[tuple[Column, str]]:
    return [(F.coalesce(F.length(F.trim(value)) > most, F.lit(False)), f"{name}_too_long")]


def _strings(properties: Column, keys: bool) -> Column:
    """The strings of a JSON text that are keys, or those that are values, without their escapes.

    Every string is taken whole, from its first quote on, so that quotes within it begin no other."""
    tokens = F.regexp_extract_all(F.coalesce(properties, F.lit("")), F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    chosen = F.filter(tokens, lambda t: t.endswith(":") if keys else ~t.endswith(":"))
    plain = F.transform(chosen, lambda t: F.regexp_replace(t, r"\s*:$", ""))
    return F.coalesce(F.from_json(F.concat(F.lit("["), F.array_join(plain, ","), F.lit("]")), "array<string>"), plain)


def forbidden_keys(properties: Column) -> Column:
    """Forbidden keys anywhere in a JSON text: every key of every depth, normalised."""
    return F.array_intersect(F.transform(_strings(properties, True), property_key), F.array(*map(F.lit, FORBIDDEN_KEYS)))


def longest_text(properties: Column) -> Column:
    """The length of the longest string value in a JSON text, at any depth; keys don't count."""
    return F.coalesce(F.array_max(F.transform(_strings(properties, False), F.length)), F.lit(0))


def error_code(key_domain: Column, names: tuple[str, ...] = EVENT_NAMES) -> Column:
    """The first rule that an event breaks, null for a valid one. ``key_domain``: the domain that the sender's key is for.

    Reads event_name, source_domain, source_surface, schema_version, occurred_at, user_id, subject_type, subject_id,
    correlation_id, producer_event_id and properties_json.
    """
    c = F.col
    text = lambda n: F.trim(c(n))
    object_ = F.schema_of_variant(F.try_parse_json("properties_json"))
    given = F.trim(F.coalesce("properties_json", F.lit(""))) != ""
    rules = [
        *required(c("event_name"), "eventname", 80),
        (~text("event_name").isin(*names), "unknown_event_name"),
        *required(c("source_domain"), "sourcedomain", 40),
        (~text("source_domain").isin(*SOURCE_DOMAINS), "invalid_source_domain"),
        (~text("source_domain").eqNullSafe(key_domain), "source_domain_key_mismatch"),
        *required(c("source_surface"), "sourcesurface", 40),
        (~text("source_surface").isin(*SOURCE_SURFACES), "invalid_source_surface"),
        (~c("schema_version").eqNullSafe(F.lit(1)), "invalid_schema_version"),
        (F.trim(F.coalesce("occurred_at", F.lit(""))) == "", "missing_occurredatutc"),
        (strict_utc(c("occurred_at")).isNull(), "invalid_occurredatutc"),
        ((F.coalesce("user_id", F.lit("")) != "") & canonical_uuid(c("user_id")).isNull(), "invalid_userid"),
        *optional(c("subject_type"), "subjecttype", 40),
        *optional(c("subject_id"), "subjectid", 80),
        *optional(c("correlation_id"), "correlationid", 100),
        *optional(c("producer_event_id"), "producereventid", 120),
        (given & ~F.coalesce(object_.startswith("OBJECT"), F.lit(False)), "invalid_properties"),
        (F.size(forbidden_keys(c("properties_json"))) > 0, "forbidden_property"),
        (longest_text(c("properties_json")) > LONGEST_VALUE, "property_value_too_long"),
    ]
    out = None
    for broken, code in rules:
        out = F.when(broken, code) if out is None else out.when(broken, code)
    return out


def idempotent_insert(events: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that are new by domain and producer's id, first of each; and a pending dispatch row for each.

    Events without a producer's id are always new.
    """
    keys = ["source_domain", "producer_event_id"]
    w = Window.partitionBy(*keys).orderBy("event_id")
    keyed = events.where("producer_event_id is not null")
    first = keyed.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    new = first.join(existing.where("producer_event_id is not null").select(*keys), keys, "left_anti").select(*events.columns)
    new = new.unionByName(events.where("producer_event_id is null"))
    return new, new.select("event_id", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count"))


def sink_properties(events: DataFrame) -> DataFrame:
    """event_id, event_name and the sink's properties: stored ones override the base's, nulls are dropped."""
    base = F.create_map(
        F.lit("time"), F.unix_seconds(F.col("occurred_at").cast("timestamp")).cast("string"),
        F.lit("$insert_id"), F.col("event_id").cast("string"),
        F.lit("source_domain"), F.col("source_domain"),
        F.lit("ip"), F.lit("0"),
    )
    stored = F.map_filter(F.coalesce(F.from_json("properties_json", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, v: v.isNotNull() & ~F.map_contains_key(stored, k))
    return events.select("event_id", "event_name", F.map_concat(kept, stored).alias("properties"))


def payload_error(url: Column, lengths: dict[str, tuple[Column, int]], locations: Column, for_update: bool = False) -> Column:
    """The first thing wrong with a job's payload, null for a valid one."""
    out = F.when(F.lit(not for_update) & (F.trim(F.coalesce(url, F.lit(""))) == ""), "url is required")
    for name, (value, most) in lengths.items():
        out = out.when(F.length(value) > most, f"{name} is too long")
    nameless = F.exists(locations, lambda x: F.trim(F.coalesce(x["country_name"], F.lit(""))) == "")
    code = F.exists(locations, lambda x: x["country_code"].isNotNull() & (F.length(x["country_code"]) != 2))
    return out.when(F.coalesce(nameless, F.lit(False)), "countryName is required").when(F.coalesce(code, F.lit(False)), "countryCode must have two letters")


def create_failure(message: Column) -> Column:
    """What a failed creation of a job comes to, by its message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(low.contains("externalid"), "missing_external_id")
        .when(low.contains("hiringcompanyname") | low.contains("hiring company"), "missing_hiring_company")
        .when(low.contains("invalid json"), "invalid_json")
        .when(low.contains("required") | low.contains("invalid") | low.contains("deduce"), "validation_failed")
        .otherwise("unknown")
    )


def audit(rules: dict[str, DataFrame]) -> DataFrame:
    """How many rows break each named rule; a rule is a frame of those rows."""
    out = None
    for name, broken in rules.items():
        one = broken.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")
