"""Users and what they send: lookups, first sign-in, account links, form fields, parameters and worker counters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields of the job form, those that an edit must not change, and the longest report.
FORM_FIELDS = ("url", "title", "hiring_company_name", "posting_company_name", "found_on", "provider", "provider_tenant", "external_id", "remote_type", "description", "locations")
READ_ONLY_ON_EDIT = ("provider", "provider_tenant", "external_id")
LONGEST_REPORT = timedelta(days=184)
RANGES = {"day": timedelta(days=1), "week": timedelta(days=7), "month": timedelta(days=30)}


def by_key(users: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each distinct asked key with the user that has it, nulls where none does."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(users, key, "left")


def get_or_create(users: DataFrame, signing_in: DataFrame, key: str, order: str) -> DataFrame:
    """Users by ``key`` after these sign in: those known stay as they are, of the others the first row is taken up.

    ``created`` says which came new.
    """
    w = Window.partitionBy(key).orderBy(order)
    fields = [c for c in users.columns if c in signing_in.columns]
    first = signing_in.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select(*fields)
    new = first.join(users.select(key), key, "left_anti")
    return users.withColumn("created", F.lit(False)).unionByName(new.withColumn("created", F.lit(True)), allowMissingColumns=True)


def link(users: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Outcome of each request (request_id, code, account_id), and the users after them.

    A code that no user has is invalid. A user that has the same account already stays linked, another account is a
    conflict. The first request with a code uses it up; later ones find it invalid.
    """
    w = Window.partitionBy("code").orderBy("request_id")
    owners = users.where("link_code is not null").select(F.col("link_code").alias("code"), F.col("user_id").alias("_user"), F.col("account_id").alias("_has"))
    tried = requests.withColumn("_nth", F.row_number().over(w)).join(owners, "code", "left")
    same = F.col("_has") == F.col("account_id")
    outcome = (
        F.when(F.col("_user").isNull(), "invalid_code")
        .when(F.col("_has").isNotNull(), F.when(same, "already_linked").otherwise("conflict"))
        .when(F.col("_nth") > 1, "invalid_code")
        .otherwise("linked")
    )
    judged = tried.select("request_id", F.col("_user").alias("user_id"), "account_id", outcome.alias("outcome"))
    linked = judged.where("outcome = 'linked'").select("user_id", F.col("account_id").alias("_new"))
    joined, new = users.join(linked, "user_id", "left"), F.col("_new")
    after = joined.withColumns(
        {
            "account_id": F.coalesce("_new", "account_id"),
            "linked_at": F.when(new.isNotNull(), now).otherwise(F.col("linked_at")),
            "link_code": F.when(new.isNull(), F.col("link_code")),
        }
    ).drop("_new")
    return judged.drop("account_id"), after


def unlink(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """``users`` without the links to these accounts."""
    gone = accounts.select(F.col("account_id")).distinct().withColumn("_gone", F.lit(True))
    joined = users.join(gone, "account_id", "left")
    return joined.withColumns({"account_id": F.when(F.col("_gone").isNull(), F.col("account_id")), "linked_at": F.when(F.col("_gone").isNull(), F.col("linked_at"))}).drop("_gone")


def form_fields(rows: DataFrame, key: str, for_update: bool = False) -> DataFrame:
    """``key`` and the fields that a form may send, texts trimmed, empty ones null; an edit leaves identities out."""
    fields = [c for c in FORM_FIELDS if c in rows.columns and not (for_update and c in READ_ONLY_ON_EDIT)]
    texts = {f.name for f in rows.schema.fields if f.dataType.typeName() == "string"}
    return rows.select(key, *[F.nullif(F.trim(c), F.lit("")).alias(c) if c in texts else F.col(c) for c in fields])


def form_locations(locations: Column) -> Column:
    """Places of a form: names trimmed, other empty fields null; null without any place."""
    clean = F.transform(
        F.filter(locations, lambda x: x.isNotNull()),
        lambda x: F.struct(F.trim(F.coalesce(x["country_name"], F.lit(""))).alias("country_name"), *[F.nullif(x[c], F.lit("")).alias(c) for c in ("country_code", "city_name", "region")]),
    )
    return F.when(F.size(clean) > 0, clean)


def many_values(url: Column, name: str) -> Column:
    """All values of a parameter in a URL's query: repeated keys, and lists with commas; blank ones are left out."""
    pairs = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    mine = F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == name)
    values = F.transform(mine, lambda p: F.split(F.try_url_decode(F.substring_index(p, "=", -1)), ","))
    return F.filter(F.transform(F.flatten(values), F.trim), lambda v: v != "")


def report_window(now: datetime, start: datetime | None = None, end: datetime | None = None, named: str | None = None) -> tuple[datetime, datetime]:
    """Start and end of a report: a named range up to now, or a start, and now as the end where none is given."""
    end = end or now
    start = now - RANGES[named] if named else start
    if start is None:
        raise ValueError("a start is needed")
    if end < start:
        raise ValueError("the end must not be before the start")
    if end - start > LONGEST_REPORT:
        raise ValueError("a report covers 184 days at most")
    return start, end


def add_filters(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with the saved filters of ``new`` whose key isn't there yet."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti").select(*rows.columns))


def counters(log: DataFrame, names: Sequence[str]) -> DataFrame:
    """How often each named event stands in the log (name, at), and when last; zeros for those that don't."""
    wanted = log.sparkSession.createDataFrame([(n,) for n in names], "name string")
    found = log.where(F.col("name").isin(*names)).groupBy("name").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return F.broadcast(wanted).join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "last_at")


def public_run(runs: DataFrame) -> DataFrame:
    """Runs as others may see them: parsed result and attributes (raw text where it isn't JSON) instead of JSON texts."""
    from vacancia.functions.texts import property_or_text

    parsed = {"result": property_or_text(F.col("result_json")), "enrichment_attributes": property_or_text(F.col("enrichment_attributes_json"))}
    return runs.withColumns(parsed).drop("result_json", "enrichment_attributes_json")
