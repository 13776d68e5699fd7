"""Job lists: categories, searches, filters, orders, pages and their child rows.

Every function takes and returns DataFrames. ``jobs`` has a row a job, ``statuses`` and ``scores`` a row a job and
user, ``locations`` any number of rows a job. Text comparisons ignore case, as the database's collation would.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.statuses import FINAL_STATUSES, status_key_sql

# Accepted spellings of remote modes.
REMOTE_MODES = {"remote": "Remote", "onsite": "Onsite", "hybrid": "Hybrid"}
OPEN_SCORE = 5.0
SEARCH_FIELDS = {"title": ["title"], "company": ["hiring_company_name", "posting_company_name"], "title_company": ["title", "hiring_company_name", "posting_company_name"], "description": ["description"]}


@dataclass(frozen=True)
class JobQuery:
    """One request for a page of jobs."""

    user_id: int | None = None
    category: str = "all"
    search: str | None = None
    search_in: str = "title_company"
    modes: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    date_from: datetime | None = None
    date_to: datetime | None = None
    date_of: str = "created"
    ignored_keys: tuple[str, ...] = ()
    sort: str = "created_desc"
    limit: int = 25
    offset: int = 0
    extra: dict = field(default_factory=dict)


def effective_update() -> Column:
    return F.coalesce("status_updated", "updated_at", "created_at")


def is_final(status: Column) -> Column:
    return F.lower(F.trim(status)).isin([s.lower() for s in FINAL_STATUSES])


def with_status(jobs: DataFrame, statuses: DataFrame, user_id: int | None) -> DataFrame:
    """Left join with the user's own statuses; without a user no job has one."""
    own = statuses.where(F.col("user_id") == F.lit(user_id)).select("job_id", F.col("status"), F.col("last_updated").alias("status_updated"))
    return jobs.join(own, "job_id", "left")


def in_category(rows: DataFrame, scores: DataFrame, query: JobQuery) -> DataFrame:
    """``my``: created by the user or with a status, none of them final. ``open``: unseen, not one's own, well scored."""
    if query.category == "my":
        mine = (F.col("created_by_user_id") == query.user_id) | F.col("status").isNotNull()
        return rows.where(mine & (F.col("status").isNull() | ~is_final(F.col("status"))))
    if query.category == "open":
        good = scores.where((F.col("user_id") == query.user_id) & (F.col("score") > OPEN_SCORE)).select("job_id")
        others = F.col("created_by_user_id").isNull() | (F.col("created_by_user_id") != query.user_id)
        return rows.join(good, "job_id").where(F.col("status").isNull() & others)
    return rows


def any_like(columns: list[str], term: str) -> Column:
    """``term`` within any of the columns. Its % and _ stay wildcards."""
    return reduce(or_, [F.coalesce(F.col(c), F.lit("")).ilike(f"%{term}%") for c in columns])


def search(rows: DataFrame, locations: DataFrame, term: str, where: str) -> DataFrame:
    if where == "location":
        hits = locations.where(any_like(["country_name", "city_name", "region"], term)).select("job_id")
        return rows.join(hits, "job_id", "left_semi")
    return rows.where(any_like(SEARCH_FIELDS[where], term))


def search_all_terms(rows: DataFrame, text: str, columns: tuple[str, ...] = ("title", "external_id", "hiring_company_name", "posting_company_name")) -> DataFrame:
    """Each term of ``text`` within any of ``columns``."""
    terms = text.split()
    return rows.where(reduce(and_, [any_like(list(columns), t) for t in terms])) if terms else rows


def with_modes(rows: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("remote_type").isin([REMOTE_MODES.get(m.lower(), m.title()) for m in modes]))


def in_places(rows: DataFrame, locations: DataFrame, cities: tuple[str, ...], countries: tuple[str, ...]) -> DataFrame:
    """Jobs with a location in one of the cities, and one in one of the countries (two letters: a code)."""
    if cities:
        rows = rows.join(locations.where(F.col("city_name").isin(*cities)).select("job_id"), "job_id", "left_semi")
    if countries:
        codes, names = [c.upper() for c in countries if len(c) == 2], [c for c in countries if len(c) != 2]
        rows = rows.join(locations.where(F.col("country_code").isin(codes) | F.col("country_name").isin(names)).select("job_id"), "job_id", "left_semi")
    return rows


def between_days(rows: DataFrame, query: JobQuery) -> DataFrame:
    """From the first day to the end of the last one."""
    when = F.col("created_at") if query.date_of == "created" else effective_update()
    if query.date_from:
        rows = rows.where(when >= F.lit(query.date_from).cast("timestamp_ntz"))
    if query.date_to:
        rows = rows.where(when < F.lit(query.date_to + timedelta(days=1)).cast("timestamp_ntz"))
    return rows


def without_ignored(rows: DataFrame, statuses: DataFrame, user_id: int | None, keys: tuple[str, ...]) -> DataFrame:
    ignored = statuses.where((F.col("user_id") == user_id) & status_key_sql(F.col("status")).isin(*keys)).select("job_id")
    return rows.join(ignored, "job_id", "left_anti")


def first_location(locations: DataFrame) -> DataFrame:
    """job_id and the least ``country|city`` of its locations, missing parts as blanks and first."""
    first = locations.groupBy("job_id").agg(F.min(F.struct(F.coalesce("country_name", F.lit("")).alias("c"), F.coalesce("city_name", F.lit("")).alias("t"))).alias("f"))
    return first.select("job_id", F.concat_ws("|", "f.c", "f.t").alias("first_location"))


def progression(status: Column) -> Column:
    """Rank of a status label in the progression order; labels beyond these rank 1, none ranks 2."""
    label = F.lower(F.coalesce(status, F.lit("")))
    return F.when(label == "offer", 6).when(label == "interview", 5).when(label == "screening planned", 4).when(label == "applied", 3).when(label == "", 2).otherwise(1)


def order(rows: DataFrame, locations: DataFrame, sort: str) -> tuple[DataFrame, list[Column]]:
    """Rows with what the order needs, and the order, down to the job's id."""
    last = F.col("job_id").asc()
    if sort == "created_asc":
        return rows, [F.col("created_at").asc(), last]
    if sort == "updated_desc":
        return rows, [effective_update().desc(), last]
    if sort == "updated_asc":
        return rows, [effective_update().asc(), last]
    if sort == "location_az":
        return rows.join(first_location(locations), "job_id", "left"), [F.col("first_location").asc_nulls_first(), F.col("created_at").desc(), last]
    if sort == "status_progression":
        return rows, [progression(F.col("status")).desc(), effective_update().desc(), last]
    return rows, [F.col("created_at").desc(), last]


def select_jobs(jobs: DataFrame, statuses: DataFrame, scores: DataFrame, locations: DataFrame, query: JobQuery) -> DataFrame:
    """All jobs that a request is about, with the user's status."""
    rows = in_category(with_status(jobs.where(~F.col("is_deleted")), statuses, query.user_id), scores, query)
    if query.search:
        rows = search(rows, locations, query.search, query.search_in)
    if query.modes:
        rows = with_modes(rows, query.modes)
    rows = between_days(in_places(rows, locations, query.cities, query.countries), query)
    return without_ignored(rows, statuses, query.user_id, query.ignored_keys) if query.ignored_keys else rows


def page(rows: DataFrame, locations: DataFrame, query: JobQuery) -> DataFrame:
    """The requested page of ``rows``, with ``position`` in the whole order."""
    ordered, by = order(rows, locations, query.sort)
    limit = query.limit if query.limit > 0 else 25
    return ordered.orderBy(*by).offset(max(query.offset, 0)).limit(limit)


def hydrate(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """``rows`` with all locations of each as an array, ordered by country and city. Children of other jobs aren't read on."""
    wanted = locations.join(rows.select("job_id"), "job_id", "left_semi")
    item = F.struct("country_name", F.coalesce("city_name", F.lit("")).alias("city_name"), "country_code", "region")
    children = wanted.groupBy("job_id").agg(F.sort_array(F.collect_list(item)).alias("locations"))
    return rows.join(children, "job_id", "left")


def location_text(locations: Column) -> Column:
    """An array of locations as one text."""
    return F.array_join(F.transform(locations, lambda x: F.concat_ws("/", x["country_name"], x["city_name"])), "; ")


def lookup(ids: DataFrame, rows: DataFrame, value: str, default: Column) -> DataFrame:
    """``value`` of each distinct id, or the default."""
    return ids.select("job_id").distinct().join(rows.select("job_id", value), "job_id", "left").withColumn(value, F.coalesce(F.col(value), default))


def keyset_page(history: DataFrame, job_id: int, after: tuple[datetime, int] | None, limit: int) -> DataFrame:
    """A job's history, newest first, after a cursor; each row with the cursor that continues behind it."""
    rows = history.where(F.col("job_id") == job_id)
    if after is not None:
        ts, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("history_id") < last)))
    ordered = rows.orderBy(F.col("ts").desc(), F.col("history_id").desc()).limit(min(max(limit, 1), 200))
    return ordered.withColumn("cursor", cursor(F.col("ts"), F.col("history_id")))


def cursor(ts: Column, row_id: Column) -> Column:
    """``time|id`` in URL-safe base64. The time has six digits of a second where it isn't a whole one."""
    part = F.date_format(ts, "SSSSSS")
    time = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)))
    return F.translate(F.base64(F.concat_ws("|", time, row_id.cast("string")).cast("binary")), "+/", "-_")


def read_cursor(value: Column) -> Column:
    """Struct of ts and id of a cursor; null where it isn't one."""
    padded = F.rpad(F.translate(value, "-_", "+/"), (F.ceil(F.length(value) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(text.contains("|"), F.struct(F.split_part(text, F.lit("|"), F.lit(1)).try_cast("timestamp_ntz").alias("ts"), F.split_part(text, F.lit("|"), F.lit(2)).try_cast("long").alias("id")))


def exists_probe(probes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each probed identity, whether a job that isn't deleted has it, and the least id of those."""
    key = ["provider", "provider_tenant", "external_id"]
    found = jobs.where(~F.col("is_deleted")).groupBy(*key).agg(F.min("job_id").alias("job_id"))
    return probes.join(found, key, "left").withColumn("found", F.col("job_id").isNotNull())


def exists_probe_url(probes: DataFrame, jobs: DataFrame, url: str) -> DataFrame:
    """As ``exists_probe``, by the identity of a URL, which is returned with the answer."""
    from vacancia.functions.urls import with_identity

    rows = with_identity(probes, url, "_identity")
    named = rows.withColumns({"provider": F.col("_identity.provider"), "provider_tenant": F.col("_identity.tenant"), "external_id": F.col("_identity.external_id")})
    return exists_probe(named.drop("_identity"), jobs)


def newest_per_user(status: DataFrame, jobs: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest jobs that each user has a status for; deleted jobs don't count. Spark drops later ones early."""
    rows = status.join(jobs.where(~F.col("is_deleted")).select("job_id", "created_at"), "job_id")
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).select("user_id", "job_id", "status")
