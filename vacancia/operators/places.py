"""A dictionary of countries and cities, and locations resolved with it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿŠšŽžČčĆćŁłŃńŚśŹźŻżĘęĄąŐőŰűŘřŮůĚě"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyySsZzCcCcLlNnSsZzZzEeAaOoUuRrUuEe"


def _words(text: Column) -> Column:
    folded = F.regexp_replace(F.regexp_replace(text, "[’‘`]", "'"), r"[.·_\-–—]", " ")
    return F.trim(F.regexp_replace(F.lower(F.translate(folded, _ACCENTED, _PLAIN)), r"[^\p{L}\p{N}']+", " "))


def lookup_key(text: Column) -> Column:
    """A name without case, accents and punctuation. Native, for Latin letters; ``lookup_key_any`` takes all scripts."""
    return _words(F.coalesce(text, F.lit("")))


def german_key(text: Column) -> Column:
    """As ``lookup_key``, with umlauts as two letters."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return _words(out)


@F.pandas_udf(StringType())
def lookup_key_any(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same by Unicode's compatibility decomposition, which Spark has no function for."""

    def one(text: str | None) -> str:
        kept = (c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c == "'" else " " for c in "".join(kept).lower()).split())

    for batch in batches:
        yield batch.map(one)


# Other names of countries, as keys, with their codes.
COUNTRY_ALIASES = {
    "deutschland": "DE", "german federal republic": "DE", "us": "US", "u s": "US", "usa": "US", "u s a": "US", "united states of america": "US", "uk": "GB", "u k": "GB", "great britain": "GB", "britain": "GB",
    "bosnia": "BA", "bosnia herzegovina": "BA", "uae": "AE", "u a e": "AE", "czech republic": "CZ", "republic of korea": "KR", "korea south": "KR", "south korea": "KR", "russian federation": "RU",
    "ivory coast": "CI", "cote d ivoire": "CI", "viet nam": "VN",
}


def country_keys(countries: DataFrame) -> DataFrame:
    """key, country_code, country_name and in_text of each other name, name and code, in this order of preference; the first
    code wins a key. Codes don't count in running text."""
    names = [F.struct(F.lit(1).alias("kind"), f(F.col("name")).alias("key")) for f in (lookup_key, german_key)]
    rows = countries.select(F.upper("code").alias("country_code"), F.col("name").alias("country_name"), F.explode(F.array(*names, F.struct(F.lit(2).alias("kind"), lookup_key(F.col("code")).alias("key")))).alias("e"))
    spark = countries.sparkSession
    aliases = spark.createDataFrame([(k, c) for k, c in COUNTRY_ALIASES.items()], "key string, country_code string")
    known = rows.select("country_code", "country_name").distinct().join(F.broadcast(aliases), "country_code")  # a row an alias of the table above
    rows = rows.select("e.key", "e.kind", "country_code", "country_name").unionByName(known.select("key", F.lit(0).alias("kind"), "country_code", "country_name")).where("key <> ''")
    found = rows.groupBy("key").agg(F.min(F.struct("kind", "country_code", "country_name")).alias("c"))
    return found.select("key", "c.country_code", "c.country_name", (F.col("c.kind") < 2).alias("in_text"))


def city_keys(cities: DataFrame) -> DataFrame:
    """key, country_code and city_name; of cities with one key in a country the first by ``rank`` wins."""
    names = F.array_distinct(F.array(lookup_key(F.col("city")), german_key(F.col("city"))))
    rows = cities.select(F.upper("country_code").alias("country_code"), F.col("city").alias("city_name"), "rank", F.explode(names).alias("key")).where("key <> ''")
    return rows.groupBy("country_code", "key").agg(F.min_by("city_name", F.struct("rank", "city_name")).alias("city_name"))


def unique_cities(keys: DataFrame) -> DataFrame:
    """Keys that only one country has a city for."""
    return keys.groupBy("key").agg(F.min("country_code").alias("country_code"), F.min("city_name").alias("city_name"), F.count_distinct("country_code").alias("_n")).where("_n = 1").drop("_n")


def build_cities(places: DataFrame, least_population: int = 0, top: int = 0) -> DataFrame:
    """country_code, city, population and rank out of a gazetteer: the most populous place of each folded name."""
    rows = places.where((F.col("feature_class") == "P") & (F.coalesce("population", F.lit(0)) >= least_population)).withColumn("key", lookup_key(F.col("name"))).where("key <> ''")
    best = rows.groupBy(F.upper("country_code").alias("country_code"), "key").agg(F.max_by(F.struct("name", "population"), F.struct("population", "name")).alias("b"))
    w = Window.partitionBy("country_code").orderBy(F.col("population").desc(), "city")
    ranked = best.select("country_code", F.col("b.name").alias("city"), F.col("b.population").alias("population")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top) if top > 0 else ranked


def canonical(locations: DataFrame, countries: DataFrame, cities: DataFrame) -> DataFrame:
    """``locations`` (country_code, country_name, city_name) with the dictionary's country and city, and what is unresolved.

    Joins are on keys; how Spark runs them follows the dictionary's size.
    """
    keys = country_keys(countries)
    code, name, city = keys.select(F.col("key").alias("_ck"), F.col("country_code").alias("_by_code")), keys.select(F.col("key").alias("_nk"), F.col("country_code").alias("_by_name")), city_keys(cities).select(F.col("country_code").alias("_cc"), F.col("key").alias("_tk"), F.col("city_name").alias("_city"))
    rows = locations.withColumns({"_a": lookup_key(F.col("country_code")), "_b": lookup_key(F.col("country_name")), "_t": lookup_key(F.col("city_name"))})
    rows = rows.join(code, rows._a == code._ck, "left").join(name, rows._b == name._nk, "left").withColumn("_country", F.coalesce("_by_code", "_by_name"))
    rows = rows.join(city, (F.col("_country") == F.col("_cc")) & (F.col("_t") == F.col("_tk")), "left")
    issues = F.array_compact(
        F.array(
            F.when((F.col("_a") != "") & F.col("_by_code").isNull(), "country_code_unresolved"),
            F.when(F.col("_country").isNull(), "country_unresolved"),
            F.when(F.col("_by_code") != F.col("_by_name"), "country_name_code_conflict"),
            F.when(F.col("_country").isNotNull() & (F.col("_t") != "") & F.col("_city").isNull(), "city_unresolved_for_country"),
        )
    )
    fatal = F.array_contains(F.col("issues"), "country_unresolved") | F.array_contains(F.col("issues"), "country_name_code_conflict")
    status = F.when(F.array_contains(F.col("issues"), "country_unresolved"), "country_unresolved").when(fatal, "country_name_code_conflict").when(F.size("issues") > 0, "normalized_with_unresolved").otherwise("normalized")
    rows = rows.withColumn("issues", issues).withColumn("geo_status", status)
    return rows.select(*locations.columns, F.when(~fatal, F.col("_country")).alias("geo_country"), F.when(~fatal, F.col("_city")).alias("geo_city"), "geo_status", "issues")


TERMS_HELD = 2000  # as many names, read out of a dictionary, go into an expression


def country_mentions(texts: DataFrame, key: str, text: str, countries: DataFrame) -> DataFrame:
    """key and country_code of each country that a text names, and the first such name (term)."""
    return country_terms(texts, key, text, countries).groupBy(key, "country_code").agg(F.min("term").alias("term"))


def country_terms(texts: DataFrame, key: str, text: str, countries: DataFrame) -> DataFrame:
    """key, country_code and term of each name of a country in a text, by its words: no text meets every name. Runs of as
    many words as the dictionary's names have are looked up, however long these are.

    A dictionary of few names is put into the expression; of more, runs of words are joined with it. Rows are the same.
    """
    names = country_keys(countries).where("in_text").where(F.length("key") > 1).select("key", "country_code")
    widths = sorted(r.w for r in names.select(F.size(F.split("key", " ")).alias("w")).distinct().collect())  # few: lengths of names in words
    held = names.limit(TERMS_HELD + 1).collect()
    words = texts.select(key, F.split(lookup_key(F.col(text)), " ").alias("_w"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("_w") - n + 1)
        return F.when(F.size("_w") >= n, F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i, n), " "))).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(*[runs(n) for n in widths])) if widths else F.array().cast("array<string>")
    if len(held) <= TERMS_HELD:
        code = F.create_map(*[F.lit(x) for r in held for x in r]) if held else F.create_map().cast("map<string,string>")
        terms = F.array(*[F.lit(r.key) for r in held]).cast("array<string>")
        found = words.select(F.col(key).alias("_k"), F.explode(F.array_intersect(every, terms)).alias("key")).withColumn("country_code", F.try_element_at(code, F.col("key"))).withColumnRenamed("_k", key)
    else:
        found = words.select(F.col(key).alias("_k"), F.explode(every).alias("key")).join(names, "key").withColumnRenamed("_k", key)
    return found.select(key, "country_code", F.col("key").alias("term"))


def country_lookup(rows: DataFrame, key: str, text: str, countries: DataFrame) -> DataFrame:
    """key and country_code of what a user typed: ``Name (CC)``, a code, a name, or the first country that begins so.

    ``countries``: code, name and nth, their order in the dictionary. Beginnings are looked up by an equi-join on all
    beginnings of names.
    """
    typed = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    in_brackets = F.nullif(F.regexp_extract(typed, r"\((\w{2})\)\s*$", 1), F.lit(""))
    asked = rows.select(key, typed.alias("_typed"), in_brackets.alias("_cc")).withColumn("_code", F.coalesce("_cc", "_typed"))
    first = lambda column: F.min_by("code", "nth").alias(column)
    codes = countries.groupBy(F.lower("code").alias("_code")).agg(first("_by_code"))
    names = countries.groupBy(F.lower("name").alias("_typed")).agg(first("_by_name"))
    begins = countries.select("code", "nth", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left(F.lower(F.col("name")), n))).alias("_typed")).groupBy("_typed").agg(first("_begins"))
    joined = asked.join(codes, "_code", "left").join(names, "_typed", "left").join(begins, "_typed", "left")
    return joined.select(key, F.when(F.col("_cc").isNotNull(), F.col("_by_code")).otherwise(F.coalesce("_by_code", "_by_name", "_begins")).alias("country_code"))


def consistency(primary: Column, secondary: Column) -> Column:
    """How two arrays of country codes agree: consistent, refined, conflicting or insufficient."""
    a, b = F.size(primary) > 0, F.size(secondary) > 0
    return F.when(a & ~b, "consistent").when(~a & b, "refined").when(a & b, F.when(F.arrays_overlap(primary, secondary), "refined").otherwise("conflicting")).otherwise("insufficient")


def combined_consistency(*values: Column) -> Column:
    each = F.array(*values)
    out = None
    for name in ("conflicting", "refined", "consistent"):
        out = F.when(F.array_contains(each, name), name) if out is None else out.when(F.array_contains(each, name), name)
    return out.otherwise("insufficient")


def locations_label(locations: Column) -> Column:
    """Places in one line for a history: ``CC: City · Country: Region``; ``(none)`` without any."""

    def one(x: Column) -> Column:
        left = F.coalesce(F.nullif(x["country_code"], F.lit("")), x["country_name"], F.lit(""))
        right = F.coalesce(F.nullif(x["city_name"], F.lit("")), F.nullif(x["region"], F.lit("")))
        return F.when(right.isNull(), left).otherwise(F.concat(left, F.lit(": "), right))

    return F.when(F.coalesce(F.size(locations), F.lit(0)) <= 0, "(none)").otherwise(F.array_join(F.transform(locations, one), " · "))


EVIDENCE = "array<struct<kind:string,disposition:string,codes:array<string>>>"


def eligibility(codes: Column, evidence: Column, agreement: Column, arrangement: Column, blocked: Column, compatible: Column, home: str = "DE") -> Column:
    """Struct of status and reason: the verdict on a candidate's places, by rules in order.

    ``codes``: countries of its places; ``evidence``: as ``EVIDENCE``, in order; ``blocked`` and ``compatible``: countries
    that the scope filter blocks and allows.
    """
    none = F.lit(False)

    def some(test) -> Column:
        return F.coalesce(F.exists(evidence, test), none)

    def all_blocked(places: Column) -> Column:
        return (F.size(places) > 0) & (F.size(F.array_except(places, blocked)) == 0)

    unfit = F.get(F.filter(evidence, lambda e: e["disposition"] == "incompatible"), F.lit(0))["kind"]
    present = some(lambda e: (e["kind"] == "mandatory_presence") & F.coalesce(F.arrays_overlap(e["codes"], blocked), none))
    constraint = lambda e: (e["kind"] == "declared_location") | ((e["kind"] == "citizenship_scope") & F.coalesce(e["disposition"] == "location_constraint", none))
    fits = lambda places: F.coalesce(F.arrays_overlap(places, F.array_append(compatible, home)), none)
    declared = some(lambda e: constraint(e) & F.coalesce(all_blocked(e["codes"]), none) & ~fits(e["codes"]))
    placed = F.coalesce(arrangement.isin("On-Site", "Hybrid"), none) & all_blocked(F.filter(codes, lambda x: x != "EU"))
    rules = [
        (unfit.isNotNull(), "ineligible", unfit),
        (present, "ineligible", F.lit("mandatory_incompatible_office_presence")),
        (declared, "ineligible", F.lit("declared_incompatible_location")),
        (placed, "ineligible", F.lit("explicit_incompatible_work_location")),
        (some(lambda e: e["kind"] == "mandatory_presence_unresolved"), "unclear", F.lit("mandatory_presence_location_unresolved")),
        (agreement == "conflicting", "unclear", F.lit("conflicting_without_decisive_restriction")),
        (some(lambda e: e["disposition"] == "compatible") | fits(codes), "eligible", F.lit("compatible_location_evidence")),
    ]
    out = None
    for holds, status, reason in rules:
        verdict = F.struct(F.lit(status).alias("status"), reason.alias("reason"))
        out = F.when(holds, verdict) if out is None else out.when(holds, verdict)
    return out.otherwise(F.struct(F.lit("unclear").alias("status"), F.lit("insufficient_explicit_location_evidence").alias("reason")))


def location_segments(raw: Column) -> Column:
    """The places that a raw location lists, without what stands in brackets and without words on remote work."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\([^)]*\)", " ")
    parts = F.split(bare, r"\s*(?:[·;|/]|\bor\b)\s*|\s+-\s+")
    plain = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?i)\b(remote|hybrid|on-?site)\b", "")))
    return F.filter(plain, lambda p: p != "")


def parse_location(rows: DataFrame, key: str, raw: str, countries: DataFrame, cities: DataFrame) -> DataFrame:
    """key, country_code and city_name of each place in a raw location: ``city, country``, a country, or a city of one country."""
    parts = rows.select(key, F.posexplode(location_segments(F.col(raw))).alias("_n", "_part"))
    parts = parts.select(key, "_n", lookup_key(F.split_part("_part", F.lit(","), F.lit(1))).alias("_one"), lookup_key(F.when(F.col("_part").contains(","), F.substring_index("_part", ",", -1))).alias("_two"))
    names, towns = country_keys(countries).select("key", "country_code"), city_keys(cities)
    two = parts.join(names.select(F.col("key").alias("_two"), F.col("country_code").alias("_c2")), "_two", "left").join(names.select(F.col("key").alias("_one"), F.col("country_code").alias("_c1")), "_one", "left")
    inside = towns.select(F.col("key").alias("_one"), F.col("country_code").alias("_c2"), F.col("city_name").alias("_in"))
    alone = unique_cities(towns).select(F.col("key").alias("_one"), F.col("country_code").alias("_cu"), F.col("city_name").alias("_cn"))
    joined = two.join(inside, ["_one", "_c2"], "left").join(alone, "_one", "left")
    code = F.coalesce("_c2", "_c1", "_cu")
    return joined.select(key, "_n", code.alias("country_code"), F.when(F.col("_c2").isNotNull(), F.col("_in")).when(F.col("_c1").isNull(), F.col("_cn")).alias("city_name")).where("country_code is not null").withColumnRenamed("_n", "nth")
