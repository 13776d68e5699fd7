"""Queries over administrative regions, evidence in descriptions and candidates' places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import locations as L
from vacancia.operators import regions as R
from vacancia.operators import scope as S
from vacancia.plans.fixtures import registrar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)

#: A text, a country it is read in, and the region that it names.
NAMED = [
    ("bavaria", None, "DE", "Bavaria"), ("Thüringen", None, "DE", "Thuringia"), ("tx", None, "US", "Texas"), ("Berlin", None, None, None), ("berlin", "DE", "DE", "Berlin"), ("Georgia", None, None, None), ("Georgia", "US", "US", "Georgia"),
    ("Landkreis  Fulda.", None, "DE", "Landkreis Fulda"), ("Landkreis Fulda", "US", None, None), ("nowhere", None, None, None), ("washington dc", None, "US", "District of Columbia"),
]


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


@query("SELECT page_id, " + ", ".join("CASE page_id % 11 " + " ".join(f"WHEN {k} THEN {_quoted(row[n])}" for k, row in enumerate(NAMED)) + f" END AS {c}" for n, c in ((2, "country_code"), (3, "region_name"))) + " FROM pages", "pages")
def geo_regions(pages: DataFrame) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*[F.lit(row[n]).cast("string") for row in NAMED]), (F.col("page_id") % 11 + 1).cast("int"))
    return pages.select("page_id", R.resolve_region(pick(0), pick(1)).alias("r")).select("page_id", F.col("r.country_code").alias("country_code"), F.col("r.region_name").alias("region_name"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'US:Oregon,DE:North Rhine-Westphalia' WHEN 1 THEN '' ELSE 'US:New York' END AS found FROM pages", "pages")
def geo_region_mentions(pages: DataFrame) -> DataFrame:
    k = F.col("page_id") % 3
    text = F.when(k == 0, "Work from Oregon, or  Nordrhein-Westfalen.").when(k == 1, "in or Berlin, OK, Newyork").otherwise("new york or washington")
    return pages.select("page_id", F.array_join(F.transform(R.region_mentions(text), lambda r: F.concat_ws(":", r["country_code"], r["region_name"])), ",").alias("found"))


TEXTS = (
    "We are nice. Excluding Germany, all are welcome", "Only citizens of NATION_3 may apply.", "You must work from our office in Nation-4 weekly. Great tea", "<p>Location: NATION_5</p>",
    "Weekly office presence is not required here. Onsite attendance is mandatory!",
)
TOLD = [("explicit_exclusion", "incompatible", ""), ("citizenship_scope", "incompatible", "CD"), ("mandatory_presence", None, "CE"), ("declared_location", None, "CF"), ("mandatory_presence_unresolved", None, "")]


def _candidates(customer: DataFrame, nation: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("c_custkey")
    rows = customer.select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("raw_location"), F.when(k % 2 == 0, "Hybrid").otherwise("Remote").alias("remote_type"),
        F.element_at(F.array(*map(F.lit, TEXTS)), (k % 5 + 1).cast("int")).alias("description"),
    )
    code = lambda c: F.concat(F.lit("C"), F.char(65 + F.col(c)))
    return rows, nation.select(code("n_nationkey").alias("code"), F.col("n_name").alias("name")), nation.select(code("n_nationkey").alias("country_code"), F.lit("Somewhere").alias("city"), F.lit(1).alias("rank"))


@query("SELECT c_custkey, " + ", ".join("CASE c_custkey % 5 " + " ".join(f"WHEN {k} THEN {_quoted(row[n])}" for k, row in enumerate(TOLD)) + f" END AS {c}" for n, c in enumerate(("kind", "disposition", "codes"))) + " FROM customer", "customer", "nation")
def geo_evidence(customer: DataFrame, nation: DataFrame) -> DataFrame:
    rows, countries, _ = _candidates(customer, nation)
    found = R.description_evidence(rows, "c_custkey", "description", countries, ["CD"], ["CE"])
    return found.select("c_custkey", F.explode("evidence").alias("e")).select("c_custkey", "e.kind", "e.disposition", F.array_join("e.codes", ",").alias("codes"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, 'C' || chr(CAST(65 + c_nationkey AS INT)) AS p, CASE c_custkey % 5 WHEN 2 THEN 'CE' WHEN 3 THEN 'CF' END AS d FROM customer),
    a AS (SELECT *, CASE WHEN d IS NULL THEN 'consistent' WHEN d = p THEN 'refined' ELSE 'conflicting' END AS agreement, CASE WHEN d IS NULL OR d = p THEN p ELSE p || ',' || d END AS codes FROM c),
    r AS (SELECT *, CASE WHEN p = 'CD' THEN 'provider_location_scope' WHEN k = 0 THEN 'explicit_exclusion' WHEN k = 1 THEN 'citizenship_scope' WHEN k = 4 THEN 'mandatory_presence_location_unresolved' WHEN agreement = 'conflicting' THEN 'conflicting_without_decisive_restriction'
      WHEN p IN ('CE', 'CB') OR d = 'CE' THEN 'compatible_location_evidence' ELSE 'insufficient_explicit_location_evidence' END AS reason FROM a)
    SELECT c_custkey, codes, agreement, reason, CASE WHEN reason IN ('provider_location_scope', 'explicit_exclusion', 'citizenship_scope') THEN 'ineligible' WHEN reason = 'compatible_location_evidence' THEN 'eligible' ELSE 'unclear' END AS status FROM r""", "customer", "nation")
def geo_reconcile(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Candidates' places from raw location to verdict; the home country is the second nation."""
    rows, countries, cities = _candidates(customer, nation)
    done = R.normalise_candidates(rows, "c_custkey", countries, cities, ["CD"], ["CE"], "CB")
    return done.select("c_custkey", F.array_join("codes", ",").alias("codes"), "agreement", "status", "reason")


CODE = "'C' || chr(CAST(65 + {} AS INT))"
CITIES = "SELECT DISTINCT c_nationkey AS n, c_mktsegment AS city FROM customer WHERE c_custkey % 3 = 0"


def _gazetteer(customer: DataFrame, nation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nations as countries, and a market segment as a city of each nation that has every third customer there."""
    code = lambda c: F.concat(F.lit("C"), F.char(65 + F.col(c)))
    cities = customer.where("c_custkey % 3 = 0").select(code("c_nationkey").alias("country_code"), F.col("c_mktsegment").alias("city"), F.lit(1).alias("rank")).distinct()
    return nation.select(code("n_nationkey").alias("code"), F.col("n_name").alias("name")), cities


@query(f"""WITH ci AS ({CITIES}), co AS (SELECT trim(regexp_replace(lower(unnest([n_name, {CODE.format('n_nationkey')}])), '[^a-z0-9]+', ' ', 'g')) AS key, {CODE.format('n_nationkey')} AS code FROM nation UNION ALL SELECT unnest(['ivory coast', 'cote d ivoire']), 'CI'),
    c AS (SELECT lower(city) AS key, count(*) AS n_cities FROM ci GROUP BY ALL)
    SELECT coalesce(co.key, c.key) AS key, code AS country_code, coalesce(n_cities, 0) AS n_cities, coalesce(n_cities, 0) > 1 OR (coalesce(n_cities, 0) > 0 AND code IS NOT NULL) AS ambiguous FROM co FULL JOIN c ON co.key = c.key""", "customer", "nation")
def geo_place_dictionary(customer: DataFrame, nation: DataFrame) -> DataFrame:
    found = L.dictionary(*_gazetteer(customer, nation))
    return found.select("key", F.col("country.country_code").alias("country_code"), F.size("cities").cast("long").alias("n_cities"), "ambiguous")


@query(f"""WITH ci AS ({CITIES}), c AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey AS n, (c_nationkey + c_custkey) % 25 AS m, c_mktsegment AS city FROM customer),
    h AS (SELECT c.*, a.n IS NOT NULL AS here, b.n IS NOT NULL AS there FROM c LEFT JOIN ci a ON a.n = c.n AND a.city = c.city LEFT JOIN ci b ON b.n = c.m AND b.city = c.city AND c.m <> c.n),
    p AS (SELECT *, {CODE.format('n')} AS nc, {CODE.format('m')} AS mc FROM h)
    SELECT c_custkey, CASE k WHEN 3 THEN 'unparsed_single_value' WHEN 7 THEN 'missing' WHEN 2 THEN 'normalized_multiple' WHEN 5 THEN 'normalized_multiple' WHEN 4 THEN 'normalized_country_scope' WHEN 6 THEN 'normalized_country'
        ELSE CASE WHEN here THEN 'normalized_city_country' ELSE 'normalized_country' END END AS status,
      CASE WHEN k IN (3, 7) THEN '' WHEN k IN (4, 6) THEN nc WHEN k IN (0, 1, 2) THEN CASE WHEN here THEN nc || ':' || city ELSE nc END
        WHEN n = m THEN CASE WHEN here THEN nc || ':' || city ELSE nc END WHEN here AND NOT there THEN mc || ',' || nc || ':' || city WHEN there AND NOT here THEN nc || ',' || mc || ':' || city ELSE nc || ',' || mc END AS places,
      CASE WHEN k = 3 THEN 'segment_unresolved' WHEN k IN (0, 1) AND NOT here THEN 'city_unresolved_for_country' WHEN k = 2 AND NOT here OR k = 5 AND (CASE WHEN n = m THEN NOT here ELSE here = there END) THEN 'segment_unresolved' ELSE '' END AS unresolved
    FROM p""", "customer", "nation")
def geo_locations_read(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Raw locations of eight shapes: a colon, a comma, beside the country, a city alone, remote, several countries, a code, nothing."""
    known = L.dictionary(*_gazetteer(customer, nation))
    k, one = F.col("c_custkey") % 8, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    two, town = F.concat(F.lit("Nation-"), ((F.col("c_nationkey") + F.col("c_custkey")) % 25).cast("string")), F.initcap("c_mktsegment")
    shapes = (
        F.concat(one, F.lit(": "), town), F.concat(town, F.lit(", "), one), F.concat(town, F.lit(" Office · "), one), town, F.concat(F.lit("Remote - "), one), F.concat(one, F.lit(" · "), two, F.lit(" | "), town),
        F.concat(F.lit("C"), F.char(65 + F.col("c_nationkey")), F.lit(" (Hybrid)")), F.lit(" "),
    )
    found = L.parse_locations(customer.select("c_custkey", F.element_at(F.array(*shapes), (k + 1).cast("int")).alias("raw")), "c_custkey", "raw", known)
    places = F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["country_code"], x["city_name"])), ",")
    ordered = F.array_join(F.array_sort(F.split(places, ","), lambda a, b: F.when(F.contains(a, F.lit(":")) & ~F.contains(b, F.lit(":")), 1).when(F.contains(b, F.lit(":")) & ~F.contains(a, F.lit(":")), -1).otherwise(0)), ",")
    return found.select("c_custkey", "status", ordered.alias("places"), F.array_join(F.transform("unresolved", lambda u: u["reason"]), ",").alias("unresolved"))


#: Sentences on a candidate's country; the filter allows the first two nations and blocks the next three.
SENTENCES = ("Candidates must reside in {}.", "Only {} citizens may apply.", "Location: {}", "We are a company in {} and like tea.", "Excluding NATION_1, all may apply.", "Work authorization for {} is not required.", "Mandatory weekly presence in our {} office.", "Hiring in {} only.")


@query("""WITH c AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey AS n FROM customer),
    s AS (SELECT *, n < 2 AS allowed, n BETWEEN 2 AND 4 AS blocked, c_custkey % 11 = 0 AS existing FROM c),
    v AS (SELECT *, CASE WHEN existing THEN 'existing_job_not_reassessed' WHEN k = 4 THEN 'explicit_exclusion' WHEN k = 1 AND blocked THEN 'citizenship_scope' WHEN k IN (0, 7) AND blocked THEN 'restriction_scope' WHEN k = 6 AND blocked THEN 'mandatory_incompatible_office_presence'
      WHEN k = 2 AND blocked THEN 'declared_incompatible_location' WHEN allowed AND k IN (0, 1, 2, 6, 7) THEN 'compatible_location_evidence' ELSE 'insufficient_explicit_location_evidence' END AS reason FROM s)
    SELECT c_custkey, reason, CASE WHEN existing THEN 'not_applicable_existing' WHEN reason = 'compatible_location_evidence' THEN 'eligible' WHEN reason = 'insufficient_explicit_location_evidence' THEN 'unclear' ELSE 'ineligible' END AS eligibility,
      CASE WHEN k IN (1, 2, 6) OR k IN (0, 7) AND (allowed OR blocked) THEN 'C' || chr(CAST(65 + n AS INT)) ELSE '' END AS places FROM v""", "customer", "nation")
def geo_scope_verdicts(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """What one sentence of a description says of a candidate without a location, against a scope filter."""
    k, name = F.col("c_custkey") % 8, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    said = [F.concat(F.lit(s.split("{}")[0]), *([name, F.lit(s.split("{}")[1])] if "{}" in s else [])) for s in SENTENCES]
    rows = customer.select("c_custkey", F.lit("Remote").alias("raw_location"), F.lit("Unknown").alias("remote_type"), F.element_at(F.array(*said), (k + 1).cast("int")).alias("description"), (F.col("c_custkey") % 11 == 0).alias("exists"))
    scope = S.Scope(("NATION_0", "NATION_1"), ("NATION_2", "NATION_3", "NATION_4"), home="CB", home_names=("NATION_1",))
    done = S.judge_candidates(rows, "c_custkey", *_gazetteer(customer, nation), scope)
    return done.select("c_custkey", "reason", "eligibility", F.array_join(F.transform("locations", lambda x: x["country_code"]), ",").alias("places"))
