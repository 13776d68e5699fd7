"""Locations as postings write them: places out of free text, by a dictionary with other names and ambiguity.

A raw text is cut into segments, each segment is read by its form, and segments without a country are read again beside
the countries of the others. Every distinct text is read once, whatever the number of rows that have it; names are looked
up by an equi-join with the dictionary, and what was found goes along with the text as a map of few entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.operators.places import city_keys, country_keys, german_key, lookup_key
from vacancia.operators.regions import region_mentions, resolve_region

LOCATION = "struct<country_code:string,country_name:string,city_name:string,region:string>"
LOCATIONS = f"array<{LOCATION}>"
OBSERVATION = "struct<source:string,raw:string,kind:string,status:string,arrangement:string,location:" + LOCATION + ">"
OBSERVATIONS = f"array<{OBSERVATION}>"
UNRESOLVED = "array<struct<source:string,raw:string,reason:string>>"
ENTRY = "struct<country:struct<country_code:string,country_name:string>,cities:map<string,string>>"
SEGMENTS = "array<struct<place:string,code:string,cities:map<string,string>>>"

# Texts that are no city, words on where work is done, and what stands around a city's name.
NO_CITY = ("remote", "fully remote", "remote first", "distributed", "hybrid", "on site", "onsite", "office", "home office", "homeoffice", "worldwide", "anywhere", "global", "globally", "international")
BETWEEN_SEGMENTS = r"(?iu)\s*(?:[·;|]|\s+or\s+|\s+/\s+)\s*"
ARRANGEMENT_WORDS = r"(?iu)\b(?:fully\s+remote|remote[- ]first|remote|distributed|hybrid|on[- ]?site|onsite|home\s*office)\b"
ARRANGEMENTS = (("Hybrid", r"\bhybrid\b"), ("On-Site", r"\b(?:on site|onsite|office based)\b"), ("Remote", r"\b(?:remote|distributed|home office|homeoffice)\b"))
WHOLE_ARRANGEMENTS = (("Remote", r"^(?:(?:fully )?remote(?: first)?|distributed)$"), ("Hybrid", r"^hybrid$"), ("On-Site", r"^(?:on site|onsite|office based)$"))
OFFICE_AROUND = r"(?iu)\s+(?:office|hq|headquarters)$"
OFFICE_BEFORE = r"(?iu)^(?:office|hq|headquarters)\s+"
LOCAL_BEFORE = r"(?iu)^(?:location\s*[:\-–—]\s*|if\s+local\s+to\s+|local\s+to\s+)"


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _first_of(key: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(key.rlike(pattern), F.lit(name)) for name, pattern in patterns])


def arrangement(text: Column) -> Column:
    """Hybrid, On-Site or Remote, as a text says; null if it doesn't."""
    return _first_of(lookup_key(text), ARRANGEMENTS)


def whole_arrangement(text: Column) -> Column:
    """The same, of a text that says nothing else."""
    return _first_of(lookup_key(text), WHOLE_ARRANGEMENTS)


def title_arrangement(title: Column) -> Column:
    """What a part of a title says that nothing else is in: between bars and dots, or in brackets."""
    text = clean(title)
    parts = F.concat(F.split(text, r"\s*[|·•]\s*"), F.regexp_extract_all(text, F.lit(r"[(\[]\s*([^()\[\]]{2,40}?)\s*[)\]]"), F.lit(1)))
    return F.get(F.filter(F.transform(parts, whole_arrangement), lambda a: a.isNotNull()), F.lit(0))


def without_arrangement(text: Column) -> Column:
    """A text without words on where work is done, brackets, and separators at its ends."""
    bare = F.regexp_replace(F.regexp_replace(clean(text), ARRANGEMENT_WORDS, " "), r"[()\[\]]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[-,:/\s]+|[-,:/\s]+$", ""))


def place_name(text: Column) -> Column:
    """The name in a text that may call it an office."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_arrangement(text), OFFICE_AROUND, ""), OFFICE_BEFORE, ""))


def _split(text: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(text, by), clean), lambda p: p != "")


def segments(raw: Column) -> Column:
    return _split(clean(raw), BETWEEN_SEGMENTS)


def dictionary(countries: DataFrame, cities: DataFrame) -> DataFrame:
    """key; country (code and name, null if only cities are called so); cities, a map of country codes to names; ambiguous,
    whether cities of several countries, or a country and a city, are called so; in_text, for names of countries.

    ``countries``: code and name; ``cities``: country_code, city and rank. Cities of unknown countries are left out.
    """
    named = country_keys(countries).select("key", F.struct("country_code", "country_name").alias("country"), "in_text")
    known = countries.select(F.upper("code").alias("country_code")).distinct()
    towns = city_keys(cities).where("key <> ''").join(known, "country_code", "left_semi").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("country_code", "city_name"))).alias("cities"))  # a country each
    both = named.join(towns, "key", "full").withColumn("cities", F.coalesce("cities", F.create_map().cast("map<string,string>")))
    n = F.size("cities")
    return both.select("key", "country", "cities", ((n > 1) | ((n > 0) & F.col("country").isNotNull())).alias("ambiguous"), F.coalesce("in_text", F.lit(False)).alias("in_text"))


def _entry(text: Column, key=lookup_key) -> Column:
    return F.try_element_at(F.col("known"), key(text))


def country_of(text: Column) -> Column:
    """The country that a text is the name or code of, by the row's ``known`` entries."""
    return _entry(text)["country"]


def city_in(text: Column, code: Column) -> Column:
    """The name of the city of a country that a text names."""
    return F.coalesce(*[F.try_element_at(_entry(text, key)["cities"], code) for key in (lookup_key, german_key)])


def cities_of(text: Column) -> Column:
    """All cities that a text names, as a map of country codes to names."""
    empty = F.create_map().cast("map<string,string>")
    first, second = (F.coalesce(_entry(text, key)["cities"], empty) for key in (lookup_key, german_key))
    return F.map_concat(first, F.map_filter(second, lambda code, name: ~F.map_contains_key(first, code)))


def _location(country: Column, city: Column | None = None, region: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(country["country_code"].alias("country_code"), country["country_name"].alias("country_name"), (none if city is None else city).alias("city_name"), (none if region is None else region).alias("region"))


def observed(source: str, raw: Column, kind: Column | str, location: Column | None = None, arranged: Column | None = None, resolved: Column | bool = True) -> Column:
    status = F.when(resolved, "resolved").otherwise("unresolved") if isinstance(resolved, Column) else F.lit("resolved" if resolved else "unresolved")
    values = (F.lit(source), raw, F.lit(kind) if isinstance(kind, str) else kind, status, F.lit(None).cast("string") if arranged is None else arranged, F.lit(None).cast(LOCATION) if location is None else location)
    return F.struct(*[v.alias(n) for v, n in zip(values, ("source", "raw", "kind", "status", "arrangement", "location"), strict=True)])


def _open(source: str, raw: Column, reason: str) -> Column:
    return F.struct(F.lit(source).alias("source"), raw.alias("raw"), F.lit(reason).alias("reason"))


def distinct_locations(places: Column) -> Column:
    """The first of equal locations, in order; countries alone go if a city of theirs is there."""

    def same(x: Column, y: Column) -> Column:
        return (x["country_code"] == y["country_code"]) & (lookup_key(x["city_name"]) == lookup_key(y["city_name"])) & (lookup_key(x["region"]) == lookup_key(y["region"]))

    first = F.aggregate(places, F.array().cast(LOCATIONS), lambda kept, x: F.when(F.exists(kept, lambda y: same(x, y)), kept).otherwise(F.array_append(kept, x)))
    alone = lambda x: x["city_name"].isNull() & x["region"].isNull()
    return F.filter(first, lambda x: ~alone(x) | ~F.exists(first, lambda y: y["city_name"].isNotNull() & (y["country_code"] == x["country_code"])))


def look_up(rows: DataFrame, key: str, texts: Column, known: DataFrame) -> DataFrame:
    """``rows`` with ``known``: a map of those keys of ``texts``, an array, that the dictionary has, to their entries.

    Rows with one ``key`` share their map. Codes of the countries that regions are known of are looked up for all.
    """
    codes = F.array(F.lit("us"), F.lit("de"))
    keys = F.array_distinct(F.concat(F.flatten(F.transform(texts, lambda t: F.array(lookup_key(t), german_key(t)))), codes))
    asked = rows.select(key, F.explode(keys).alias("key")).distinct()
    found = asked.join(known.select("key", F.struct("country", "cities").alias("entry")), "key").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("key", "entry"))).alias("known"))  # keys of one text
    return rows.join(found, key, "left").withColumn("known", F.coalesce("known", F.create_map().cast(f"map<string,{ENTRY}>")))


def _read_segments(each: DataFrame, source: str) -> DataFrame:
    """``each`` (segment, bare, sides, parts, known) with locations, observations and unresolved of the segment alone."""
    side = lambda n: F.when(F.size("sides") == 2, F.get("sides", F.lit(n)))
    rows = each.withColumns({"whole": country_of(F.col("bare")), "left": country_of(side(0)), "right": country_of(side(1)), "named": F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("i"), country_of(p).alias("country"))), lambda p: p["country"].isNotNull())})
    pair = F.size("parts") == 2
    rows = rows.withColumns({"paired": F.when(pair, resolve_region(F.get("parts", F.lit(1)), None, True)), "exact": resolve_region(F.col("bare"))})
    told = F.when(F.col("exact").isNotNull(), F.array("exact")).otherwise(F.array_distinct(region_mentions(F.col("bare"))))
    by_form = (
        F.when((F.col("bare") == "") & F.col("arranged").isNotNull(), "work_arrangement")
        .when(F.col("whole").isNotNull(), "country_scope")
        .when(F.col("left").isNotNull(), "left")
        .when(F.col("right").isNotNull(), "right")
        .when(F.size("named") == 1, "comma")
        .when(F.col("paired").isNotNull() & country_of(F.col("paired.country_code")).isNotNull(), "pair")
    )
    rows = rows.withColumn("form", by_form).withColumn("told", F.when(F.col("form").isNull(), told))
    region = F.when(F.size("told") == 1, F.get("told", F.lit(0)))
    rows = rows.withColumn("region", F.when(F.col("form") == "pair", F.col("paired")).when(country_of(region["country_code"]).isNotNull(), region))
    form = F.coalesce("form", F.when(F.col("region").isNotNull(), "region"), F.lit("unknown"))
    country = F.when(F.col("form") == "left", F.col("left")).when(F.col("form") == "right", F.col("right")).when(F.col("form") == "comma", F.get("named", F.lit(0))["country"]).otherwise(F.coalesce("whole", country_of(F.col("region.country_code"))))
    at = F.get("named", F.lit(0))["i"]
    texts = F.when(F.col("form") == "left", F.split(F.get("sides", F.lit(1)), r"\s*,\s*")).when(F.col("form") == "right", F.split(F.get("sides", F.lit(0)), r"\s*,\s*")).when(F.col("form") == "comma", F.filter("parts", lambda p, i: i != at))
    names = F.filter(F.transform(texts, place_name), lambda n: (n != "") & ~lookup_key(n).isin(*NO_CITY))
    rows = rows.withColumns({"form": form, "country": country, "names": F.coalesce(names, F.array().cast("array<string>"))})
    code = F.col("country.country_code")
    rows = rows.withColumn("towns", F.transform("names", lambda n: F.struct(n.alias("name"), city_in(n, code).alias("city"))))
    rows = rows.withColumn("town", F.when(F.col("form") == "pair", city_in(F.get("parts", F.lit(0)), code)))

    listed = F.col("form").isin("left", "right", "comma")
    found = F.filter("towns", lambda t: t["city"].isNotNull())
    whole = observed(source, F.col("segment"), "country_scope", _location(F.col("country")))
    cities = F.transform("towns", lambda t: F.when(t["city"].isNotNull(), observed(source, F.col("segment"), "city_country", _location(F.col("country"), t["city"]))).otherwise(observed(source, t["name"], "locality", resolved=False)))
    regional = observed(source, F.col("segment"), F.when(F.col("town").isNotNull(), "city_region_country").otherwise("region_country"), _location(F.col("country"), F.col("town"), F.col("region.region_name")))
    observations = (
        F.when(F.col("form") == "work_arrangement", F.array(observed(source, F.col("segment"), "work_arrangement", arranged=F.col("arranged"))))
        .when(F.col("form") == "country_scope", F.array(whole))
        .when(listed, F.when(F.size(found) > 0, cities).otherwise(F.concat(cities, F.array(whole))))
        .when(F.col("form").isin("pair", "region"), F.array(regional))
        .otherwise(F.array(observed(source, F.col("segment"), "unknown", resolved=False)))
    )
    missing = F.transform(F.filter("towns", lambda t: t["city"].isNull()), lambda t: _open(source, t["name"], "city_unresolved_for_country"))
    unresolved = (
        F.when(listed, missing)
        .when((F.col("form") == "pair") & F.col("town").isNull(), F.array(_open(source, F.get("parts", F.lit(0)), "city_unresolved_for_region_country")))
        .when(F.col("form") == "unknown", F.array(_open(source, F.col("segment"), "segment_unresolved")))
        .otherwise(F.array().cast(UNRESOLVED))
    )
    rows = rows.withColumns({"observations": observations, "unresolved": unresolved})
    return rows.withColumn("locations", F.transform(F.filter("observations", lambda o: o["location"].isNotNull()), lambda o: o["location"]))


def parse_locations(rows: DataFrame, key: str, raw: str, known: DataFrame, source: str = "raw_location") -> DataFrame:
    """key, status, locations, observations, unresolved, arrangement, and segments (place, code and cities of each) of each
    row's raw text; ``known`` is a ``dictionary``.

    A city without its country is read as one of the country that the other segments name, if just one of these has it.
    """
    texts = rows.select(key, clean(F.col(raw)).alias("_raw"))
    each = texts.where("_raw <> ''").select("_raw").distinct().select("_raw", F.posexplode(segments(F.col("_raw"))).alias("nth", "segment"))
    each = each.withColumns({"arranged": arrangement(F.col("segment")), "bare": without_arrangement(F.col("segment")), "place": place_name(F.col("segment"))})
    each = each.withColumns({"local": F.trim(F.regexp_replace("place", LOCAL_BEFORE, "")), "sides": _split(F.col("bare"), r"\s*:\s*"), "parts": _split(F.col("bare"), r"\s*,\s*")})
    inner = F.concat("parts", F.flatten(F.transform("sides", lambda s: _split(s, r"\s*,\s*"))))
    asked = F.concat(F.array("bare", "place", "local"), "sides", inner, F.transform(inner, place_name))
    read = _read_segments(look_up(each, "_raw", asked, known), source)

    fields = ("segment", "place", "local", "arranged", "locations", "observations", "unresolved")
    merged = F.aggregate(F.collect_list("known"), F.create_map().cast(f"map<string,{ENTRY}>"), lambda a, x: x)  # one map for all segments of a text
    whole = read.groupBy("_raw").agg(F.sort_array(F.collect_list(F.struct("nth", *fields))).alias("parts"), merged.alias("known"))  # segments of one text
    codes = F.array_distinct(F.flatten(F.transform("parts", lambda p: F.transform(p["locations"], lambda x: x["country_code"]))))
    whole = whole.withColumn("codes", codes)

    def beside(p: Column) -> Column:
        fits = F.filter("codes", lambda c: city_in(p["place"], c).isNotNull())
        bare = (F.size(p["locations"]) == 0) & (F.size(p["unresolved"]) == 1) & (p["place"] != "") & ~p["place"].rlike("[:,]") & ~lookup_key(p["place"]).isin(*NO_CITY)
        return F.when(bare & (F.size(fits) == 1), F.get(fits, F.lit(0)))

    whole = whole.withColumn("beside", F.transform("parts", beside))
    kind = F.when(F.size("codes") == 1, "city_with_shared_country").otherwise("city_with_listed_country")

    def again(p: Column, code: Column) -> Column:
        country = F.element_at(F.filter(F.flatten(F.transform("parts", lambda q: q["locations"])), lambda x: x["country_code"] == code), 1)
        location = _location(country, city_in(p["place"], code))
        renewed = F.struct(F.array(location).alias("locations"), F.array(observed(source, p["segment"], kind, location)).alias("observations"), F.array().cast(UNRESOLVED).alias("unresolved"))
        return F.when(code.isNotNull(), renewed).otherwise(F.struct(p["locations"].alias("locations"), p["observations"].alias("observations"), p["unresolved"].alias("unresolved")))

    whole = whole.withColumn("read", F.zip_with("parts", "beside", again))
    gathered = {c: F.flatten(F.transform("read", lambda r: r[c])) for c in ("locations", "observations", "unresolved")}  # noqa: B023
    whole = whole.withColumns({**gathered, "arrangement": F.get(F.filter(F.transform("parts", lambda p: p["arranged"]), lambda a: a.isNotNull()), F.lit(0))})
    whole = whole.withColumn("locations", distinct_locations(F.col("locations")))
    several = F.size("parts") > 1
    status = (
        F.when(F.size("locations") == 0, F.when(several, "unparsed_multiple").otherwise("unparsed_single_value"))
        .when(several | (F.size("locations") > 1), "normalized_multiple")
        .when(F.get("locations", F.lit(0))["city_name"].isNotNull(), "normalized_city_country")
        .when(F.col("arrangement") == "Remote", "normalized_country_scope")
        .otherwise("normalized_country")
    )
    places = F.transform("parts", lambda p: F.struct(p["local"].alias("place"), country_of(p["local"])["country_code"].alias("code"), cities_of(p["local"]).alias("cities")))
    done = whole.select("_raw", status.alias("status"), "locations", "observations", "unresolved", "arrangement", places.alias("segments"))
    joined = texts.join(done, "_raw", "left")
    empty = {"locations": LOCATIONS, "observations": OBSERVATIONS, "unresolved": UNRESOLVED, "segments": SEGMENTS}
    filled = {c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in empty.items()}
    return joined.withColumns(filled).withColumn("status", F.coalesce("status", F.lit("missing"))).select(key, "status", "locations", "observations", "unresolved", "arrangement", "segments")
