"""Where a job may be done: provider's places, what the description says of places, and the verdict of a scope filter.

Descriptions are cut into sentences; a row a sentence is judged by its words, its countries and what it states as a
location, which is read by ``locations.parse_locations`` again. What all sentences of a candidate say is then held against
the provider's places. Sentences of one candidate are collected, never those of several.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.texts import description_windows
from vacancia.operators import locations as L
from vacancia.operators.places import combined_consistency, consistency, country_keys, country_terms, eligibility, lookup_key
from vacancia.operators.regions import about_citizenship, declares_location, excludes, mandatory_presence, negates_requirement, resolve_region

EVIDENCE = "array<struct<source:string,kind:string,disposition:string,allow_term:string,block_term:string,marker:string,codes:array<string>,text:string>>"
ADDED = {"detail_raw_location": "string", "title": "string", "remote_type": "string", "description": "string", "exists": "boolean", "locations": L.LOCATIONS}

# Words that restrict a scope, and sentences that such words, or places, count in.
MARKERS = (
    "only", "based", "resident", "residents", "reside", "residency", "located", "living", "live in", "within", "must be", "must reside", "must live", "candidates in", "applicants in", "hiring in", "remote from", "remote in",
    "eligible in", "restricted to", "exclusively", "work authorization", "work authorisation", "work permit", "right to work",
)
AUTHORISED = r"(?iu)\bauthori[sz](?:ed|ation)\s+to\s+work\b"
ABOUT_SCOPE = r"(?iu)\b(?:open\s+to|eligible|hiring|candidates?|applicants?|opportunity|remote|reside|residents?|citizens?|citizenship|work\s+authori[sz]ation|authori[sz](?:ed|ation)\s+to\s+work|right\s+to\s+work|work\s+permit|restricted)\b"
ABOUT_ROLE = r"(?iu)\b(?:role|position|job|you|employee|must|required|mandatory|expected)\b"
BASED_FIRST = (r"(?iu)^based\s+in\b", r"(?iu)^based\s+(?:in|at)\b")
BASED_PEOPLE = (
    r"(?iu)\bbased\b.{0,35}\b(?:candidates?|applicants?|employees?)\b",
    r"(?iu)\b(?:role|position|job|candidates?|applicants?|employees?)\b.{0,25}\b(?:is|are|must\s+be|need\s+to\s+be|will\s+be|should\s+be|required\s+to\s+be)\b.{0,10}\bbased\b",
    r"(?iu)\byou\b.{0,20}\b(?:are|must|need\s+to|will|should)\b.{0,15}\bbased\b",
)
ONLY_PLACED = (
    r"(?iu)\b(?:only|exclusively)\b.{0,35}\b(?:based|located|residents?|reside|residency|living|live\s+in|candidates?\s+in|applicants?\s+in|remote\s+(?:from|in)|eligible\s+in|restricted\s+to)\b",
    r"(?iu)\b(?:based|located|residents?|reside|residency|living|live\s+in|remote|hiring|eligible|restricted)\b.{0,35}\b(?:only|exclusively)\b",
)
STATED = (
    r"(?iu)\b(?:work\s+)?location\s*[:\-–—]\s*(.{2,120})$",
    r"(?iu)\b(?:role|position|job)\s+is\s+based\s+(?:in|at)\s+(.{2,100})$",
    r"(?iu)^(?:based|located)\s+(?:in|at)\s+(.{2,100})$",
    r"(?iu)\b(?:presence|attendance)\s+(?:in|at)\s+(?:our\s+)?(.{2,100}?)(?:\s+(?:office|hq|headquarters))?$",
    r"(?iu)\bwork(?:\s+[\p{L}\p{N}-]+){0,10}\s+from\s+(?:our\s+)?(.{2,100}?)(?:\s+(?:office|hq|headquarters))?$",
    r"(?iu)\b(?:once[- ]a[- ]week|weekly|\d+\s*(?:days?|times?)\s+(?:a|per)\s+week|required|mandatory|expected)\b.{0,100}\b(?:in|at)\s+(?:our\s+)?(.{2,100}?)(?:\s+(?:office|hq|headquarters))$",
    r"(?iu)\b(?:you|employee|candidate|applicant|must|required|mandatory|expected)\b.{0,80}\b(?:based|located)\s+(?:in|at)\s+(.{2,100})$",
)
EMPLOYER = (
    r"(?iu)\b(?:we\s+(?:are|'re)|our\s+(?:company|business|headquarters|hq)|company\s+(?:is|was)|headquartered|headquarters|hq)\b",
    r"(?iu)\b(?:company|companies|business|employer|organisation|organization|fintech|headquartered|headquarters|hq|based)\b",
)
US_EMPLOYMENT = r"(?iu)\b401\s*\(?k\)?\b|\b(?:public\s+trust|ofccp|federal\s+contractor|w-?2\s+employee)\b"
POLICY = r"(?iu)^(?:[-*•]\s*)?(?:location\s*(?:/|&)\s*hybrid\s+policy|work(?:place)?\s+(?:arrangement|model)|working\s+model|remote\s+policy|location\s+policy)\s*[:\-–—]\s*(.{2,60})$"


@dataclass(frozen=True)
class Scope:
    """Terms that a scope filter allows and blocks (places or others), and words that make a sentence a restriction."""

    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    markers: tuple[str, ...] = MARKERS
    enabled: bool = True
    home: str = "DE"
    home_names: tuple[str, ...] = ("germany", "deutschland")


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a text has a phrase as words of its own, points optional, its words apart by spaces, points or hyphens."""
    words = r"[\s.-]+".join(re.escape(w).replace(r"\.", r"\.?") for w in phrase.split())
    return text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}]){words}(?![\p{{L}}\p{{N}}])")


def first_phrase(text: Column, phrases: Sequence[str]) -> Column:
    found = [F.when(has_phrase(text, p), F.lit(p)) for p in phrases if p.split()]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _matches(text: Column, *patterns: str) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | text.rlike(p)
    return out


def countries_of(terms: Sequence[str], countries: DataFrame) -> dict[str, tuple[str, str]]:
    """Code and name of the country that each of a filter's terms is; a row a term at most comes to the driver."""
    if not terms:
        return {}
    rows = countries.sparkSession.createDataFrame([(t,) for t in set(terms)], "term string").withColumn("key", lookup_key(F.col("term")))
    return {r.term: (r.country_code, r.country_name) for r in rows.join(country_keys(countries), "key").collect()}


def _table(values: dict[str, tuple[str, str]]) -> Column:
    entries = [x for term, (code, name) in values.items() for x in (F.lit(term), F.struct(F.lit(code).alias("country_code"), F.lit(name).alias("country_name")))]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,struct<country_code:string,country_name:string>>")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _item(source: str, kind: str, disposition: Column | str | None, text: Column, codes: Column | None = None, allow: Column | None = None, block: Column | None = None, marker: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    values = (F.lit(source), F.lit(kind), F.lit(disposition).cast("string") if disposition is None or isinstance(disposition, str) else disposition, none if allow is None else allow, none if block is None else block, none if marker is None else marker, _strings(()) if codes is None else codes, text)
    return F.struct(*[v.alias(n) for v, n in zip(values, ("source", "kind", "disposition", "allow_term", "block_term", "marker", "codes", "text"), strict=True)])


def _with_terms(rows: DataFrame, text: str, scope: Scope, countries: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` (with ``_id``) with named (code and term of each country in the text), allowed and blocked (the first term
    of the filter in the text, or the name of a country that is one of its terms)."""
    named = country_terms(rows, "_id", text, countries).groupBy("_id").agg(F.sort_array(F.collect_set(F.struct("country_code", "term"))).alias("named"))  # countries in one sentence
    rows = rows.join(named, "_id", "left").withColumn("named", F.coalesce("named", F.array().cast("array<struct<country_code:string,term:string>>")))

    def term(terms: tuple[str, ...]) -> Column:
        codes = _strings([of[t][0] for t in terms if t in of])
        return F.coalesce(first_phrase(F.col(text), terms), F.get(F.filter("named", lambda m: F.array_contains(codes, m["country_code"])), F.lit(0))["term"])

    rows = rows.withColumns({"allowed": term(scope.allow if scope.enabled else ()), "blocked": term(scope.block if scope.enabled else ())})
    everywhere = (lookup_key(F.col("allowed")) == "anywhere") & F.col(text).rlike(r"(?iu)\banywhere\s+(?:in|within)\b")
    return rows.withColumn("allowed", F.when(~F.coalesce(everywhere, F.lit(False)), F.col("allowed")))


def _term_countries(of: dict[str, tuple[str, str]]) -> Column:
    """Countries of the terms allowed and blocked; a term may be a name in the text rather than one of the filter's."""
    table = _table({lookup: c for term, c in of.items() for lookup in {term, _plain(term)}})
    both = F.array_compact(F.array("allowed", "blocked"))
    return F.filter(F.transform(both, lambda t: F.coalesce(F.try_element_at(table, t), F.try_element_at(table, lookup_key(t)))), lambda c: c.isNotNull())


def _plain(term: str) -> str:
    return " ".join(re.sub(r"[^\w']+", " ", term.replace("_", " ").lower()).split())


def _terms_table(scope: Scope, countries: DataFrame) -> dict[str, tuple[str, str]]:
    """Countries of the filter's terms, and of all names that these countries have in a text."""
    of = countries_of((*scope.allow, *scope.block), countries)
    codes = {code for code, _ in of.values()}
    if codes:
        names = country_keys(countries).where("in_text").where(F.col("country_code").isin(*codes)).collect()  # names of the filter's countries
        of |= {r.key: (r.country_code, r.country_name) for r in names if r.key not in of}
    return of


def provider_evidence(rows: DataFrame, raw: str, scope: Scope, countries: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with scope_evidence and scope_locations of what the provider's location says of the filter."""
    told = _with_terms(rows.withColumn("_text", L.clean(F.col(raw))), "_text", scope, countries, of)
    text = F.col("_text")
    bad = F.col("blocked").isNotNull() & F.col("allowed").isNull()
    some = F.col("blocked").isNotNull() | F.col("allowed").isNotNull()
    located = _term_countries(of)
    item = _item("raw_location", "provider_location_scope", F.when(bad, "incompatible").otherwise("compatible"), text, F.transform(located, lambda c: c["country_code"]), F.col("allowed"), F.col("blocked"))
    out = excludes(text, scope.home_names)
    evidence = F.when(text == "", F.array().cast(EVIDENCE)).when(out, F.array(_item("raw_location", "explicit_exclusion", "incompatible", text))).when(some, F.array(item)).otherwise(F.array().cast(EVIDENCE))
    places = F.when((text != "") & ~out, F.transform(located, lambda c: L._location(c))).otherwise(F.array().cast(L.LOCATIONS))
    return told.withColumns({"scope_evidence": evidence, "scope_locations": places}).drop("_text", "named", "allowed", "blocked")


def sentence_evidence(rows: DataFrame, key: str, scope: Scope, countries: DataFrame, known: DataFrame, of: dict[str, tuple[str, str]]) -> DataFrame:
    """key, told_evidence, told_locations, told_observations, told_unresolved, policies and hints of each row of ``rows``
    (key, description, primary_codes): what its sentences say, in their order. Rows without sentences are left out."""
    each = rows.select(key, "primary_codes", F.posexplode(description_windows(F.col("description"))).alias("_n", "_w")).withColumn("_id", F.struct(key, "_n"))
    each = _with_terms(each, "_w", scope, countries, of)
    w = F.col("_w")
    stated = F.coalesce(*[F.nullif(F.regexp_extract(F.regexp_replace(w, r"[.;]+$", ""), p, 1), F.lit("")) for p in STATED])
    stated = F.regexp_replace(F.regexp_replace(L.clean(stated), L.OFFICE_AROUND, ""), r"[.;]+$", "")
    each = each.withColumn("stated", F.nullif(stated, F.lit("")))
    parsed = L.parse_locations(each.where("stated is not null").select("_id", "stated"), "_id", "stated", known, "description")
    names = parsed.select("_id", F.col("locations").alias("places"), F.col("observations").alias("seen"), "unresolved", "segments")
    each = each.join(names, "_id", "left").withColumns({"places": F.coalesce("places", F.array().cast(L.LOCATIONS)), "seen": F.coalesce("seen", F.array().cast(L.OBSERVATIONS)), "unresolved": F.coalesce("unresolved", F.array().cast(L.UNRESOLVED))})
    # A city alone is one of the country that the provider names, if that is one.
    primary = F.when(F.size("primary_codes") == 1, F.get("primary_codes", F.lit(0)))
    town = F.when((F.size("places") == 0) & (F.size("segments") == 1), F.try_element_at(F.get("segments", F.lit(0))["cities"], primary))
    each = each.join(countries.select(F.upper("code").alias("_code"), F.col("name").alias("_name")), primary == F.col("_code"), "left").withColumn("town", town)
    location = F.struct(primary.alias("country_code"), F.col("_name").alias("country_name"), F.col("town").alias("city_name"), F.lit(None).cast("string").alias("region"))
    here = F.col("town").isNotNull()
    each = each.withColumns({"seen": F.when(here, F.array(L.observed("description", F.col("stated"), "city_with_primary_country", location))).otherwise(F.col("seen")), "unresolved": F.when(here, F.array().cast(L.UNRESOLVED)).otherwise(F.col("unresolved")), "places": F.when(here, F.array(location)).otherwise(F.col("places"))})

    each = each.withColumns({"refused": F.coalesce(negates_requirement(w), F.lit(False)), "marker": F.coalesce(first_phrase(w, scope.markers), F.when(w.rlike(AUTHORISED), "authorized to work")), "one": F.array_distinct(F.transform("named", lambda m: m["country_code"])), "located": _term_countries(of)})
    padded = F.concat(F.lit(" "), lookup_key(w), F.lit(" "))
    codes = F.transform("located", lambda c: c["country_code"])
    near = F.array_compact(F.concat(F.array("allowed", "blocked"), F.transform(F.filter("named", lambda m: F.array_contains(codes, m["country_code"])), lambda m: m["term"])))
    beside = F.exists(near, lambda t: F.contains(padded, F.concat(F.lit(" only "), lookup_key(t), F.lit(" "))) | F.contains(padded, F.concat(F.lit(" exclusively "), lookup_key(t), F.lit(" "))) | F.contains(padded, F.concat(F.lit(" "), lookup_key(t), F.lit(" only "))) | F.contains(padded, F.concat(F.lit(" "), lookup_key(t), F.lit(" exclusively "))))
    short = F.length(w) <= 120
    counts = F.when(F.col("marker") == "based", _matches(w, *BASED_PEOPLE) | (w.rlike(BASED_FIRST[1]) & short)).when(F.col("marker").isin("only", "exclusively"), beside | _matches(w, *ONLY_PLACED)).otherwise(F.lit(True))
    about = _matches(w, ABOUT_SCOPE, ABOUT_ROLE) | (w.rlike(BASED_FIRST[0]) & short)
    known_term = F.col("allowed").isNotNull() | F.col("blocked").isNotNull()
    bad = F.col("blocked").isNotNull() & F.col("allowed").isNull()
    citizen = about_citizenship(w) & (F.size("one") == 1)
    case = F.when(excludes(w, scope.home_names), "explicit_exclusion").when(citizen, "citizenship_scope").when(~F.col("refused") & about & F.col("marker").isNotNull() & counts & known_term, "restriction_scope")
    each = each.withColumn("case", case).join(countries.select(F.upper("code").alias("_one"), F.col("name").alias("_one_name")), F.get("one", F.lit(0)) == F.col("_one"), "left")

    disposition = F.when(bad, "incompatible").when(F.col("allowed").isNotNull(), "compatible")
    first = (
        F.when(F.col("case") == "explicit_exclusion", F.array(_item("description", "explicit_exclusion", "incompatible", w)))
        .when(F.col("case") == "citizenship_scope", F.array(_item("description", "citizenship_scope", F.coalesce(disposition, F.lit("location_constraint")), w, F.col("one"), F.col("allowed"), F.col("blocked"), F.lit("citizenship"))))
        .when(F.col("case") == "restriction_scope", F.array(_item("description", "restriction_scope", disposition, w, codes, F.col("allowed"), F.col("blocked"), F.col("marker"))))
        .otherwise(F.array().cast(EVIDENCE))
    )
    at = F.array_distinct(F.transform("places", lambda x: x["country_code"]))
    asked, some = ~F.col("refused") & F.col("stated").isNotNull(), F.size("places") > 0
    declared = F.when(asked & declares_location(w) & some, F.array(_item("description", "declared_location", "location_constraint", w, at))).otherwise(F.array().cast(EVIDENCE))
    presence = F.when(asked & mandatory_presence(w), F.when(some, F.array(_item("description", "mandatory_presence", "location_constraint", w, at))).otherwise(F.array(_item("description", "mandatory_presence_unresolved", "unclear", w)))).otherwise(F.array().cast(EVIDENCE))
    one = F.struct(F.col("_one").alias("country_code"), F.col("_one_name").alias("country_name"))
    of_case = F.when(F.col("case") == "citizenship_scope", F.array(L._location(one))).when(F.col("case") == "restriction_scope", F.transform("located", lambda c: L._location(c))).otherwise(F.array().cast(L.LOCATIONS))
    policy = L.whole_arrangement(F.nullif(F.regexp_extract(w, POLICY, 1), F.lit("")))
    scoped = F.transform(of_case, lambda x: L.observed("description", x["country_name"], "eligibility_scope_location", x))
    ruled = F.when(policy.isNotNull(), F.array(L.observed("description", w, "work_arrangement", arranged=policy))).otherwise(F.array().cast(L.OBSERVATIONS))
    hints = F.concat(F.when(_matches(w, EMPLOYER[0]) & _matches(w, EMPLOYER[1]), F.col("one")).otherwise(_strings(())), F.when(w.rlike(US_EMPLOYMENT), _strings(("US",))).otherwise(_strings(())))
    parts = {"e": F.concat(first, declared, presence), "l": F.concat(of_case, "places"), "o": F.concat(ruled, scoped, "seen"), "u": F.col("unresolved"), "p": policy, "h": hints}
    told = each.select(key, F.struct("_n", *[v.alias(n) for n, v in parts.items()]).alias("s")).groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"))  # sentences of one description
    flat = lambda c: F.flatten(F.transform("s", lambda x: x[c]))
    policies = F.array_distinct(F.filter(F.transform("s", lambda x: x["p"]), lambda p: p.isNotNull()))
    return told.select(key, flat("e").alias("told_evidence"), L.distinct_locations(flat("l")).alias("told_locations"), flat("o").alias("told_observations"), flat("u").alias("told_unresolved"), policies.alias("policies"), F.array_distinct(flat("h")).alias("hints"))


def _codes(places: str | Column) -> Column:
    return F.array_distinct(F.transform(places, lambda x: x["country_code"]))


def structured_locations(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """key, given (the provider's own locations by the dictionary), given_observations and given_unresolved."""
    own = rows.where(F.size("locations") > 0).select(key, "locations")
    own = L.look_up(own, key, F.flatten(F.transform("locations", lambda x: F.array(F.coalesce(x["country_code"], F.lit("")), F.coalesce(x["country_name"], F.lit("")), F.coalesce(x["city_name"], F.lit(""))))), known)

    def judged(x: Column) -> Column:
        by_code, by_name, city = L.country_of(x["country_code"]), L.country_of(x["country_name"]), L.clean(x["city_name"])
        country = F.coalesce(by_code, by_name)
        town = F.when(city != "", L.city_in(city, country["country_code"]))
        conflict = F.coalesce(by_code["country_code"] != by_name["country_code"], F.lit(False))
        issues = F.array_compact(F.array(F.when((L.clean(x["country_code"]) != "") & by_code.isNull(), "country_code_unresolved"), F.when(country.isNull(), "country_unresolved").when(conflict, "country_name_code_conflict").when((city != "") & town.isNull(), "city_unresolved_for_country")))
        return F.struct(F.concat_ws(", ", x["city_name"], x["region"], x["country_name"], x["country_code"]).alias("raw"), F.when(country.isNotNull() & ~conflict, L._location(country, town, F.nullif(L.clean(x["region"]), F.lit("")))).alias("location"), issues.alias("issues"))

    own = own.withColumn("j", F.transform("locations", judged))
    seen = F.transform("j", lambda x: L.observed("provider_structured", x["raw"], "structured_location", x["location"], resolved=x["location"].isNotNull()))
    missing = F.flatten(F.transform("j", lambda x: F.transform(x["issues"], lambda i: F.struct(F.lit("provider_structured").alias("source"), x["raw"].alias("raw"), i.alias("reason")))))
    places = F.filter(F.transform("j", lambda x: x["location"]), lambda x: x.isNotNull())
    return own.select(key, L.distinct_locations(places).alias("given"), seen.alias("given_observations"), missing.alias("given_unresolved"))


def judge_candidates(candidates: DataFrame, key: str, countries: DataFrame, cities: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """key, remote_type, locations, location_status, consistency, observations, unresolved, and the verdict (eligibility,
    reason, evidence) of candidates: raw_location, and where given detail_raw_location, locations, remote_type, title,
    description and exists.

    Each key must stand once. Rows without any of these texts get a verdict too. Places are those that the provider states,
    in its fields and its location texts, with those that the description states; each step says whether they agree.
    """
    known = L.dictionary(countries, cities)
    of = _terms_table(scope, countries)
    rows = candidates.select(key, "raw_location", *[F.col(c).cast(kind).alias(c) if c in candidates.columns else F.lit(None).cast(kind).alias(c) for c, kind in ADDED.items()])
    parsed = {}
    for name, column, source in (("raw", "raw_location", "raw_location"), ("detail", "detail_raw_location", "provider_detail_location")):
        fields = ("status", "locations", "observations", "unresolved", "arrangement", "segments")
        one = L.parse_locations(rows, key, column, known, source) if column in candidates.columns else None
        parsed[name] = one.select(key, F.struct(*fields).alias(name)) if one is not None else None
    rows = rows.join(parsed["raw"], key)
    rows = rows.join(parsed["detail"], key) if parsed["detail"] is not None else rows.withColumn("detail", F.expr("named_struct('status', 'missing', 'locations', cast(array() as " + L.LOCATIONS + "), 'observations', cast(array() as " + L.OBSERVATIONS + "), 'unresolved', cast(array() as " + L.UNRESOLVED + "), 'arrangement', cast(null as string), 'segments', cast(array() as " + L.SEGMENTS + "))"))
    if "locations" in candidates.columns:
        rows = rows.join(structured_locations(rows, key, known), key, "left")
    else:
        rows = rows.withColumns({"given": F.lit(None).cast(L.LOCATIONS), "given_observations": F.lit(None).cast(L.OBSERVATIONS), "given_unresolved": F.lit(None).cast(L.UNRESOLVED)})
    has_given = F.col("given").isNotNull()
    texts_agree = F.when(F.col("detail.status") == "missing", "insufficient").otherwise(consistency(_codes("raw.locations"), _codes("detail.locations")))
    rows = rows.withColumns({"texts": L.distinct_locations(F.concat("raw.locations", "detail.locations")), "texts_agree": texts_agree})
    given_agree = F.when(has_given, consistency(_codes("given"), _codes("texts"))).otherwise(F.col("texts_agree"))
    rows = rows.withColumns({"provider": F.when(has_given, L.distinct_locations(F.concat("given", "texts"))).otherwise(F.col("texts")), "provider_agrees": given_agree})
    rows = provider_evidence(rows.withColumn("_id", F.struct(key)), "raw_location", scope, countries, of).drop("_id")
    rows = rows.withColumn("primary", L.distinct_locations(F.concat("provider", "scope_locations"))).withColumn("primary_codes", _codes("primary"))
    told = sentence_evidence(rows, key, scope, countries, known, of)
    kinds = {"told_evidence": EVIDENCE, "told_locations": L.LOCATIONS, "told_observations": L.OBSERVATIONS, "told_unresolved": L.UNRESOLVED, "policies": "array<string>", "hints": "array<string>"}
    rows = rows.join(told, key, "left").withColumns({c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in kinds.items()})

    # Cities and regions of the provider's texts in the one country that the description hints at.
    hint = F.when(F.size("hints") == 1, F.get("hints", F.lit(0)))
    rows = rows.withColumn("hint", hint).join(countries.select(F.upper("code").alias("_code"), F.col("name").alias("_name")), F.col("hint") == F.col("_code"), "left")
    plain = F.filter(F.concat("raw.segments", "detail.segments"), lambda s: (s["place"] != "") & ~s["place"].rlike("[:,]") & ~lookup_key(s["place"]).isin(*L.NO_CITY))
    read = F.transform(plain, lambda s: F.struct(s["place"].alias("place"), s["code"].alias("code"), F.try_element_at(s["cities"], F.col("_code")).alias("city"), resolve_region(s["place"], F.col("_code"))["region_name"].alias("region")))
    rows = rows.withColumn("local", F.when(F.col("_code").isNotNull(), read).otherwise(F.array().cast("array<struct<place:string,code:string,city:string,region:string>>")))
    instead = lambda s: s["code"].isNotNull() & (s["code"] != F.col("_code")) & s["region"].isNotNull()
    country = F.struct(F.col("_code").alias("country_code"), F.col("_name").alias("country_name"))
    refined = F.filter(F.transform("local", lambda s: F.when(s["city"].isNotNull() & ~instead(s), L.observed("description", s["place"], "provider_city_with_description_country_hint", L._location(country, s["city"]))).when(s["region"].isNotNull(), L.observed("description", s["place"], "provider_region_with_description_country_hint", L._location(country, None, s["region"])))), lambda o: o.isNotNull())
    rows = rows.withColumns({"refined": refined, "gone": F.transform(F.filter("local", instead), lambda s: s["code"])})
    first = F.filter("primary", lambda x: ~F.array_contains("gone", x["country_code"]))
    second = F.concat("told_locations", L.distinct_locations(F.transform("refined", lambda o: o["location"])))
    rows = rows.withColumns({"first": first, "second": second})
    told_arrangement = F.when(F.size("policies") == 1, F.get("policies", F.lit(0)))
    by_type, by_place, by_title = L.arrangement(F.col("remote_type")), F.coalesce(F.when(has_given, L.arrangement(F.col("remote_type"))), F.col("raw.arrangement"), F.col("detail.arrangement")), L.title_arrangement(F.col("title"))
    stronger = F.coalesce(by_type, by_place, by_title)
    arranged_agree = F.when(F.size("policies") > 1, "conflicting").when(told_arrangement.isNotNull(), F.when(stronger.isNull(), "refined").when(told_arrangement == stronger, "consistent").otherwise("conflicting")).otherwise("insufficient")
    rows = rows.withColumns({
        "locations": L.distinct_locations(F.concat("first", "second")),
        "consistency": combined_consistency(F.col("provider_agrees"), F.col("texts_agree"), consistency(_codes("first"), _codes("second")), arranged_agree),
        "titled": F.when(by_type.isNull() & by_place.isNull() & by_title.isNotNull(), F.array(L.observed("title", L.clean(F.col("title")), "work_arrangement", arranged=by_title))).otherwise(F.array().cast(L.OBSERVATIONS)),
        "remote_type": F.coalesce(stronger, told_arrangement, F.nullif(L.clean(F.col("remote_type")), F.lit("")), F.lit("Unknown")),
        "evidence": F.concat("scope_evidence", "told_evidence"),
    })
    codes = lambda terms: _strings(sorted({of[t][0] for t in terms if t in of}))
    verdict = eligibility(_codes("locations"), F.col("evidence"), F.col("consistency"), F.coalesce(L.arrangement(F.col("remote_type")), L.arrangement(F.col("raw_location"))), codes(scope.block), codes(scope.allow), scope.home)
    fixed = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    verdict = F.when(F.coalesce("exists", F.lit(False)), fixed("not_applicable_existing", "existing_job_not_reassessed")).when(F.lit(not scope.enabled), fixed("unclear", "location_scope_filter_disabled")).otherwise(verdict)
    status = F.when(has_given, "provider_structured").when(F.col("raw.status") != "missing", F.col("raw.status")).otherwise(F.col("detail.status"))
    none = F.array().cast(L.OBSERVATIONS)
    observations = F.concat(F.coalesce("given_observations", none), "raw.observations", "detail.observations", "titled", F.transform("scope_locations", lambda x: L.observed("raw_location", x["country_name"], "eligibility_scope_location", x)), "told_observations", "refined")
    unresolved = F.concat(F.coalesce("given_unresolved", F.array().cast(L.UNRESOLVED)), "raw.unresolved", "detail.unresolved", "told_unresolved")
    return rows.withColumn("_v", verdict).select(key, "remote_type", "locations", status.alias("location_status"), "consistency", observations.alias("observations"), unresolved.alias("unresolved"), F.col("_v.status").alias("eligibility"), "_v.reason", "evidence")
