"""Locations in free text, sentences about them, and verdicts: what each shape must give."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from vacancia.operators import locations, places, scope

COUNTRIES = [("US", "United States"), ("DE", "Germany"), ("FR", "France"), ("BA", "Bosnia and Herzegovina"), ("GB", "United Kingdom"), ("GE", "Georgia"), ("EU", "European Union"), ("CA", "Canada"), ("GS", "South Georgia and the South Sandwich Islands")]
CITIES = [("US", "Dallas"), ("US", "Dover"), ("US", "Austin"), ("US", "St. Petersburg"), ("US", "Berlin"), ("DE", "Berlin"), ("DE", "Munich"), ("DE", "Fulda"), ("DE", "Köln"), ("DE", "Garching"), ("GB", "Dover"), ("CA", "Dover"), ("ZZ", "Nowhere")]
FILTER = scope.Scope(
    ("Germany", "Europe", "EU", "Anywhere", "Global"), ("United States", "USA", "U.S.", "North America", "France"), ("only", "based", "residents", "reside", "located", "must be", "candidates in", "remote in", "work authorization", "right to work")
)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(COUNTRIES, "code string, name string"), spark.createDataFrame([(c, n, 1) for c, n in CITIES], "country_code string, city string, rank int")


@pytest.fixture(scope="module")
def known(spark, tables):
    frame = locations.dictionary(*tables).cache()
    yield frame
    frame.unpersist()


#: A raw location, its status, its places and what stays open.
READ = [
    ("USA: Dallas", "normalized_city_country", ["US:Dallas:"], []),
    ("de: Fulda, Munich · On-Site", "normalized_multiple", ["DE:Fulda:", "DE:Munich:"], []),
    ("Fulda, Nowhere: Germany", "normalized_city_country", ["DE:Fulda:"], ["Nowhere city_unresolved_for_country"]),
    ("Remote, Deutschland", "normalized_country_scope", ["DE::"], []),
    ("Berlin · Munich, Germany", "normalized_multiple", ["DE:Berlin:", "DE:Munich:"], []),
    ("Dover HQ; Canada | United Kingdom", "normalized_multiple", ["CA::", "GB::"], ["Dover HQ segment_unresolved"]),
    ("Dover or Germany or United Kingdom", "normalized_multiple", ["GB:Dover:", "DE::"], []),
    ("Berlin", "unparsed_single_value", [], ["Berlin segment_unresolved"]),
    ("Berlin / Atlantis", "unparsed_multiple", [], ["Berlin segment_unresolved", "Atlantis segment_unresolved"]),
    ("Frankfurt/Main", "unparsed_single_value", [], ["Frankfurt/Main segment_unresolved"]),
    ("Austin, TX", "normalized_city_country", ["US:Austin:Texas"], []),
    ("Springfield, IL", "normalized_country", ["US::Illinois"], ["Springfield city_unresolved_for_region_country"]),
    ("Remote/Hybrid if local to Maryland", "normalized_country", ["US::Maryland"], []),
    ("Landkreis Fulda", "normalized_country", ["DE::Landkreis Fulda"], []),
    ("Koeln, Germany", "normalized_city_country", ["DE:Köln:"], []),
    ("Bosnia-Herzegovina", "normalized_country", ["BA::"], []),
    ("South Georgia and the South Sandwich Islands (remote)", "normalized_country_scope", ["GS::"], []),
    ("Georgia", "normalized_country", ["GE::"], []),
    ("Fully remote", "unparsed_single_value", [], []),
    ("Office, Germany", "normalized_country", ["DE::"], []),
    ("Paris, Lyon", "unparsed_single_value", [], ["Paris, Lyon segment_unresolved"]),
    ("  ", "missing", [], []),
    (None, "missing", [], []),
]


def test_raw_locations(spark, known):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(READ)] + [(99, "Berlin")], "k int, raw string")
    got = {r.k: r for r in locations.parse_locations(rows, "k", "raw", known).collect()}
    assert len(got) == len(READ) + 1 and got[99].status == "unparsed_single_value"
    for i, (raw, status, want, left) in enumerate(READ):
        r = got[i]
        found = [f"{x.country_code}:{x.city_name or ''}:{x.region or ''}" for x in r.locations]
        assert (raw, r.status, found, [f"{u.raw} {u.reason}" for u in r.unresolved]) == (raw, status, want, left)
    kinds = {o.kind for r in got.values() for o in r.observations}
    assert kinds == {"city_country", "locality", "country_scope", "city_with_shared_country", "city_with_listed_country", "city_region_country", "region_country", "work_arrangement", "unknown"}


def test_dictionary_marks_ambiguity(known):
    marks = {r.key: (r.country and r.country.country_code, sorted(r.cities), r.ambiguous) for r in known.collect()}
    assert marks["dover"] == (None, ["CA", "GB", "US"], True)
    assert marks["munich"] == (None, ["DE"], False)
    assert marks["koeln"] == marks["koln"] == (None, ["DE"], False)
    assert marks["deutschland"] == marks["de"] == ("DE", [], False)
    assert "nowhere" not in marks


@pytest.mark.parametrize("held", [0, 2000])
def test_names_of_any_length_are_found(spark, tables, monkeypatch, held):
    monkeypatch.setattr(places, "TERMS_HELD", held)
    texts = ["Ships to South  Georgia and the South Sandwich-Islands", "Bosnia, U.S. or Deutschland", "Australian business", "de", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = sorted((r.k, r.country_code, r.term) for r in places.country_mentions(rows, "k", "text", tables[0]).collect())
    assert got == [(0, "GE", "georgia"), (0, "GS", "south georgia and the south sandwich islands"), (1, "BA", "bosnia"), (1, "DE", "deutschland"), (1, "US", "u s")]


#: raw location, remote type, description; verdict, reason, agreement and places.
JUDGED = [
    ("Germany", "Hybrid", "Required once-a-week presence in our Garching HQ.", "eligible", "compatible_location_evidence", "refined", ["DE:Garching:"]),
    ("Remote", "Remote", "The job is open to candidates anywhere in the US only.", "ineligible", "restriction_scope", "refined", ["US::"]),
    ("EU Remote", "Remote", "Staff must work two days per week from our Dallas, United States office.", "ineligible", "mandatory_incompatible_office_presence", "conflicting", ["EU::", "US:Dallas:"]),
    ("EU Remote", "Remote", "Staff are expected two days a week in our Dallas office.", "unclear", "mandatory_presence_location_unresolved", "consistent", ["EU::"]),
    ("EU Remote", "Remote", "You help customers in the United States and Canada.", "eligible", "compatible_location_evidence", "consistent", ["EU::"]),
    ("Up in the mountains", "Unknown", "", "unclear", "insufficient_explicit_location_evidence", "insufficient", []),
    ("Remote Europe", "Remote", "Our company is based in the United States and has many customers.", "eligible", "compatible_location_evidence", "insufficient", []),
    ("Remote Europe", "Remote", "US work authorization is not required here.", "eligible", "compatible_location_evidence", "insufficient", []),
    ("Remote Europe, excluding Germany", "Remote", "", "ineligible", "explicit_exclusion", "insufficient", []),
    ("Anywhere in the United States", "Remote", "", "ineligible", "provider_location_scope", "consistent", ["US::"]),
    ("Remote", "Remote", "<ul><li>Join our team.</li><li>Candidates must reside in the United States.</li></ul>", "ineligible", "restriction_scope", "refined", ["US::"]),
    ("Remote Europe", "Unknown", "Applicants must have authorization to work in the US.", "ineligible", "restriction_scope", "refined", ["US::"]),
    ("Remote Europe", "Unknown", "We work with people in Australia.", "eligible", "compatible_location_evidence", "insufficient", []),
    ("Remote Europe", "Unknown", "You join US-based engineering teams.", "eligible", "compatible_location_evidence", "insufficient", []),
    ("Remote Europe", "Unknown", "Based in the United States.", "ineligible", "restriction_scope", "refined", ["US::"]),
    ("Remote Europe", "Unknown", "Candidates only work with US partners.", "eligible", "compatible_location_evidence", "insufficient", []),
    ("Remote/Hybrid if local to Maryland", "Hybrid", "", "ineligible", "explicit_incompatible_work_location", "consistent", ["US::Maryland"]),
    ("Remote", "Unknown", "Location: Austin, TX", "ineligible", "declared_incompatible_location", "refined", ["US:Austin:Texas"]),
    ("Berlin", "Unknown", "We are one of the nicest companies in Germany.", "eligible", "compatible_location_evidence", "refined", ["DE:Berlin:"]),
    ("Remote", "Remote", "This opportunity is for US citizens only.", "ineligible", "citizenship_scope", "refined", ["US::"]),
    ("St. Petersburg", "Unknown", "We offer a 401(k) match.", "unclear", "insufficient_explicit_location_evidence", "refined", ["US:St. Petersburg:"]),
    ("Georgia", "Unknown", "We offer a 401(k) match.", "unclear", "insufficient_explicit_location_evidence", "refined", ["US::Georgia"]),
    ("Germany", "Remote", "Work model: hybrid", "unclear", "conflicting_without_decisive_restriction", "conflicting", ["DE::"]),
    (None, None, None, "unclear", "insufficient_explicit_location_evidence", "insufficient", []),
]


def judged(spark, tables, rows, filter_=FILTER, schema="k int, raw_location string, remote_type string, description string"):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    return {r.k: r for r in scope.judge_candidates(frame, "k", *tables, filter_).collect()}


def shown(row):
    return [f"{x.country_code}:{x.city_name or ''}:{x.region or ''}" for x in row.locations]


def test_verdicts(spark, tables):
    got = judged(spark, tables, [r[:3] for r in JUDGED])
    for i, (raw, kind, text, verdict, reason, agreement, places_) in enumerate(JUDGED):
        r = got[i]
        assert (raw, text, r.eligibility, r.reason, r.consistency, shown(r)) == (raw, text, verdict, reason, agreement, places_)


def test_filter_off_and_existing_jobs(spark, tables):
    rows = [("Remote", "Unknown", "This opportunity is for US citizens only.", None), ("Remote", "Unknown", "US residents only.", True)]
    schema = "k int, raw_location string, remote_type string, description string, exists boolean"
    off = judged(spark, tables, rows, dataclasses.replace(FILTER, enabled=False), schema)
    assert (off[0].eligibility, off[0].reason, shown(off[0])) == ("unclear", "location_scope_filter_disabled", ["US::"])
    assert judged(spark, tables, rows, FILTER, schema)[1].eligibility == "not_applicable_existing"


def test_providers_own_fields_and_titles(spark, tables):
    rows = [
        ("Remote, Germany", "Remote", [("", "Deutschland", "berlin", "Berlin-Brandenburg")], None, None),
        ("Germany: Berlin", "Unknown", [("DE", "Germany", None, None)], None, None),
        ("Remote Germany", "Remote", [("US", "United States", None, None)], None, None),
        ("Germany", "Unknown", [("US", "Germany", None, None), ("XX", None, None, None)], None, None),
        ("Germany", "Hybrid", None, "Manager | Remote", None),
        ("Germany", "Unknown", None, "Manager | Remote", "Munich, Germany"),
        ("Germany", "Unknown", None, "Remote Sensing Engineer", "France"),
    ]
    schema = "k int, raw_location string, remote_type string, locations array<struct<country_code:string,country_name:string,city_name:string,region:string>>, title string, detail_raw_location string"
    got = judged(spark, tables, rows, FILTER, schema)
    assert (shown(got[0]), got[0].location_status, got[0].consistency) == (["DE:Berlin:Berlin-Brandenburg"], "provider_structured", "refined")
    assert (shown(got[1]), got[1].consistency) == (["DE:Berlin:"], "refined")
    assert (shown(got[2]), got[2].consistency, got[2].eligibility) == (["US::", "DE::"], "conflicting", "unclear")
    assert [u.reason for u in got[3].unresolved] == ["country_name_code_conflict", "country_code_unresolved", "country_unresolved"]
    assert [got[i].remote_type for i in (4, 5, 6)] == ["Hybrid", "Remote", "Unknown"]
    assert (shown(got[5]), got[5].consistency) == (["DE:Munich:"], "refined")
    assert got[6].consistency == "conflicting"
    assert [o.source for o in got[5].observations if o.kind == "work_arrangement"] == ["title"]


def test_no_rows(spark, tables, known):
    none = spark.createDataFrame([], "k int, raw_location string")
    assert locations.parse_locations(none, "k", "raw_location", known).count() == 0
    assert scope.judge_candidates(none, "k", *tables, FILTER).count() == 0
    assert spark.range(1).select(locations.title_arrangement(F.lit("Lead (hybrid)"))).first()[0] == "Hybrid"
