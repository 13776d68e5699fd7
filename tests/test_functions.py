"""Examples for functions that SQL can't check in full."""

import base64
import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from vacancia.functions import identity, scores, statuses, texts, urls
from vacancia.operators import discovery, events, health, job_lists, places, planning
from vacancia.sources import files


def each(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


# URL, provider, tenant, job, where it was found, company.
URLS = [
    ("https://jobs.ashbyhq.com/acme/1234-5678", "ashby", "acme", "1234-5678", "corporate-site", "acme"),
    ("https://boards.greenhouse.io/acme/jobs/4012?source=LinkedIn", "greenhouse", "acme", "4012", "linkedin", "acme"),
    ("https://boards.greenhouse.io/embed/job_app?for=acme&token=77", "greenhouse", "acme", "77", "corporate-site", "acme"),
    ("https://jobs.eu.lever.co/acme/ab-cd", "lever", "acme", "ab-cd", "corporate-site", "acme"),
    ("https://acme.jobs.hr.cloud.sap/job/Engineer/1234-de_DE", "successfactors", "acme.jobs.hr.cloud.sap", "1234", "corporate-site", "acme"),
    ("https://acme.wd3.myworkdayjobs.com/en/site/job/Berlin/Dev_R-12", "workday", "acme", "Dev_R-12", "corporate-site", "acme"),
    ("https://acme.jobs.personio.de/job/99", "personio", "acme", "99", "corporate-site", "acme"),
    ("https://join.com/companies/acme/123-dev", "join", "acme", "123", "corporate-site", "acme"),
    ("https://careers.icims.com/jobs/5/x", "icims", "", "5", "corporate-site", None),
    ("https://www.linkedin.com/jobs/view/3812345678", "linkedin", "", "3812345678", "linkedin", None),
    ("https://de.indeed.com/viewjob?jk=abc123", "indeed", "", "abc123", "indeed", None),
    ("https://careers.acme.co.uk/job/42", "acme", "", "42", "corporate-site", "acme"),
    ("https://www.hays.com/job/7", "hays", "", "7", "corporate-site", None),
]


def test_url_identity(spark):
    values = [u[0] for u in URLS] + ["https://www.xing.com/jobs", None, "no url", ""]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, link string")
    got = [r.identity for r in urls.with_identity(rows, "link").orderBy("i").collect()]
    for found, (url, *want) in zip(got, URLS, strict=False):
        assert [found.provider, found.tenant, found.external_id, found.found_on, found.hiring_company] == want, url
    assert got[-4].external_id == hashlib.sha1(b"https://xing.com/jobs").hexdigest()[:16]
    assert got[-3:] == [None, None, None]


def test_public_urls(spark):
    values = ["https://a.example/x", "http://localhost/x", "http://10.0.0.1/", "http://172.20.1.1/", "http://172.40.1.1/", "ftp://a.example", "http://[::1]/", "http://x.internal/", None]
    assert each(spark, values, urls.is_public) == [True, False, False, False, True, False, False, False, False]


def test_pseudonym_is_hmac(spark):
    for salt in ("short", "long" * 30):
        want = base64.urlsafe_b64encode(hmac.new(salt.encode(), b"user@x", hashlib.sha256).digest()).decode().rstrip("=")[:43]
        assert each(spark, [" User@X ", "", None], lambda c, s=salt: identity.pseudonym(c, s)) == [f"u_{want}", None, None]


def test_uuid_forms(spark):
    raw = "6F1C2D3E-0000-4000-8000-0123456789AB"
    assert each(spark, [raw, "{" + raw + "}", raw.replace("-", ""), raw[:-1], None], identity.canonical_uuid) == [raw.lower()] * 3 + [None] * 2


def test_html_and_entities(spark):
    html = "<p>A &amp;lt; B<br>C</p><ul><li>x&nbsp;y</li></ul><script>no</script>&#8364;&#x41;&#1114112;"
    assert each(spark, [html, None, "  "], lambda c: texts.html_to_text(c, numeric=True)) == ["A &lt; B\nC\n\n- x y\n\n€A&#1114112;", "", ""]
    assert each(spark, ["&lt;p&gt;Hi&lt;/p&gt;"], texts.greenhouse_text) == ["Hi"]


def test_json_out_of_answers(spark):
    values = ['<think>{"a":1}</think>ok {"b": {"c": "}"}} rest', "none", '{broken {"x":1}', None]
    assert each(spark, values, texts.first_json_object) == ['{"b":{"c":"}"}}', None, '{"x":1}', None]


def test_canonical_version(spark):
    a, b, c = each(spark, ['{"b":1, "a":[2]}', '{"a":[2],"b":1}', "x"], texts.version_id)
    assert a == b == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest() and c is None


def test_quill(spark):
    assert each(spark, ['{"ops":[{"insert":"a"},{"insert":{"image":"x"}},{"insert":"b"}]}'], texts.quill_text) == ["a\nb"]


def test_cursor_round_trip(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05' AS ts, 77L AS id")
    got = rows.select(job_lists.read_cursor(job_lists.cursor(F.col("ts"), F.col("id"))).alias("c"), job_lists.read_cursor(F.lit("!!")).alias("d")).first()
    assert (str(got.c.ts), got.c.id, got.d) == ("2024-01-02 03:04:05", 77, None)
    for text in ("2024-01-02 03:04:05.120000", "2024-01-02 03:04:05"):
        at = dt.datetime.fromisoformat(text)
        rows = spark.sql(f"SELECT TIMESTAMP_NTZ '{text}' AS ts, 7L AS id").select(job_lists.cursor(F.col("ts"), F.col("id")).alias("c")).select("c", job_lists.read_cursor(F.col("c")).alias("back"))
        got = rows.first()
        assert got.c == base64.urlsafe_b64encode(f"{at.isoformat()}|7".encode()).decode() and (got.back.ts, got.back.id) == (at, 7)


def test_history_statuses(spark):
    rows = [("status:Applied", None), ("status_changed", '{"to":"A"}'), ("status_changed", '{"to":1,"status":"B"}'), ("status-changed", '{"data":{"to":"C"}}'), ("status_changed", "{bad"), ("other", '{"to":"A"}'), (None, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, d string")
    got = frame.orderBy("i").select(statuses.status_from_history(F.col("a"), F.col("d")).alias("s")).collect()
    assert [r.s for r in got] == ["Applied", "A", "B", "C", None, None, None]


def test_keywords_at_word_boundaries(spark):
    values = ["Internal Intern", "international", "Intern-Lead", "ünternintern", None, ""]
    assert each(spark, values, lambda c: discovery.has_keyword(c, "intern")) == [True, False, True, False, False, False]
    assert each(spark, ["C++ dev"], lambda c: discovery.has_keyword(c, "++")) == [False]


def test_forbidden_keys_at_any_depth(spark):
    texts_ = ['{"k":"a \\"b\\": c","d":{"e":["\\u00e9\\n"]}}', '{"a longer key than its value":"xyz"}', '{"n":1}', None]
    assert each(spark, texts_, events.longest_text) == [8, 3, 0, 0]
    assert each(spark, ['{"k":"say \\"email\\": me"}'], events.forbidden_keys) == [[]]
    got = each(spark, ['{"a":[{"Raw URL":1}]}', '{"k":"email"}', None], events.forbidden_keys)
    assert got == [["raw_url"], [], []]


def test_lookup_keys(spark):
    assert each(spark, ["Köln-Süd", "São  Paulo.", None], places.lookup_key) == ["koln sud", "sao paulo", ""]
    assert each(spark, ["Köln-Süd", "São  Paulo."], places.lookup_key_any) == ["koln sud", "sao paulo"]
    assert each(spark, ["Köln Straße"], places.german_key) == ["koeln strasse"]


def test_allotment_keeps_budgets_and_turns():
    due = {("a", "recent_activity"): 2, ("a", "healthy"): 9, ("a", "recovery"): 3, ("b", "healthy"): 5, ("b", "long_empty"): 1}
    got = planning.allot(due, {"a": 2, "b": 2}, {"a": 6, "b": 4}, 9, 0)
    assert sum(got.values()) == 9 and got["a", "recent_activity"] == 2 and got["b", "long_empty"] == 1
    assert sum(n for (p, _), n in got.items() if p == "a") <= 6


def test_levels_and_scores(spark):
    assert each(spark, ["Upper intermediate", "business level", None, "C2", "speaks some"], scores.level) == ["B2", "B2", "B1", "C2", "B1"]
    assert each(spark, ["7.25", "11", "x", None], scores.valid_score) == [7.2, None, None, None]
    assert each(spark, ["2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "2024-01-02T03:04Z", "x"], lambda c: scores.strict_utc(c).cast("string")) == ["2024-01-02 01:04:05", None, "2024-01-02 03:04:00", None]
    assert each(spark, ["31.12.23", "31.02.2024", "1/2/2024"], lambda c: scores.local_date(c).cast("string")) == ["2023-12-31", None, "2024-02-01"]


FEEDS = {
    "softgarden": '<li data-job-id="1"><a class="jobTitle" href="/job/1">Dev</a></li><li data-job-id="2">no link</li>',
    "greenhouse": '{"jobs":[{"id":1,"title":" Dev ","absolute_url":"https://x/1","location":{"name":"Berlin"},"content":"c","updated_at":"2024-01-01"}]}',
    "lever": '[{"id":"1","text":"Dev","hostedUrl":"https://x/1","categories":{"location":"A","allLocations":["Berlin","Berlin"]},"descriptionPlain":"c","createdAt":0}]',
    "ashby": '{"jobs":[{"id":"1","title":"Dev","jobUrl":"https://x/1","location":"Berlin","isListed":true},{"id":"2","title":"No","isListed":false}]}',
    "smartrecruiters": '{"content":[{"id":"1","name":"Dev","ref":"https://x/1","location":{"city":"Berlin","country":"de"}}]}',
    "workday": '{"jobPostings":[{"title":"Dev","externalPath":"/job/1","locationsText":"Berlin","postedOn":"Posted Today","bulletFields":["1"]}]}',
    "personio": "<x><!-- <position><id>9</id></position> --><position><id>1</id><name><![CDATA[Dev]]></name><office>Berlin</office></position><position><id>1</id><name>Again</name></position></x>",
    "successfactors": '<a class="jobTitle-link" href="/job/Dev/1/">Dev</a>',
}


@pytest.mark.parametrize("provider", sorted(files.PARSERS))
def test_feeds(spark, provider):
    rows = files.parse_feed(spark.createDataFrame([("t", FEEDS[provider])], "tenant string, payload string"), provider).collect()
    assert [(r.tenant, r.external_id, r.title) for r in rows] == [("t", "1", "Dev")]


def test_json_ld(spark):
    page = '<script type="application/ld+json">{bad</script><script type=\'application/ld+json\'>{"@graph":[{"@type":["Thing","JobPosting"],"title":"Dev"}]}</script>'
    assert [json.loads(x)["title"] if x else None for x in each(spark, [page, "<p>", None], files.job_posting)] == ["Dev", None, None]


def test_softgarden_widget(spark):
    html = """<ul><li data-job-id="7" class="x"><a class="jobTitle" href="/job/7/dev?x=1"><b>Dev &amp; Ops</b></a><span class="location-view-item">Bonn</span><span class="a location-view-item">bonn</span>
      <span class="location-view-item">Köln</span><span class="matchValue date">1.2.24</span></li><li data-job-id="8"><a href="/other">no</a></li><li data-job-id="7"><a href="/job/7">again</a></li></ul>"""
    rows = files.parse_feed(spark.createDataFrame([("s", html)], "tenant string, payload string"), "softgarden").collect()
    assert [(r.tenant, r.external_id, r.title, r.url, r.location, r.posted_at) for r in rows] == [("s", "7", "Dev & Ops", "/job/7/dev?x=1", "Bonn / Köln", "1.2.24")]


def test_policies_are_checked():
    got = health.policies({"defaults": {"concurrency": 4}, "lever": {"ratio_threshold": 0.25}, "ashby": None})
    assert (got["lever"].concurrency, got["lever"].ratio_threshold, got["ashby"].concurrency, got["defaults"].transient_threshold) == (4, 0.25, 4, 8)
    for bad in ({"x y": {}}, {"lever": {"speed": 1}}, {"lever": {"concurrency": 0}}, {"lever": {"concurrency": True}}, {"lever": {"concurrency": 2.5}}, {"lever": {"ratio_threshold": 1.5}}, {"lever": {"ratio_threshold": "1"}}):
        with pytest.raises(ValueError):
            health.policies(bad)


def test_envelope_and_csv(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schemaVersion":1,"items":[{"slug":"x"},{"slug":"y"}]}')
    assert files.read_envelope(spark, str(tmp_path / "a.json"), "slug string").count() == 2
    (tmp_path / "b.json").write_text('{"schemaVersion":2,"items":[]}')
    with pytest.raises(ValueError):
        files.read_envelope(spark, str(tmp_path / "b.json"), "slug string")
    files.write_envelope(spark.createDataFrame([("x",), ("y",)], "slug string").repartition(2), str(tmp_path / "w"))
    assert sorted(r.slug for r in files.read_envelope(spark, str(tmp_path / "w"), "slug string", lines=True).collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        files.read_envelope(spark, str(tmp_path / "w"), "slug string", version=2, lines=True)
    (tmp_path / "c.csv").write_text('﻿name,slug,url\n"A, ""B""",a,https://a\nshort,row\n', encoding="utf-8")
    good, bad = files.read_strict_csv(spark, str(tmp_path / "c.csv"))
    assert [r.name for r in good.collect()] == ['A, "B"'] and bad.count() == 1
    (tmp_path / "many").mkdir()
    (tmp_path / "many/one.csv").write_text("name,slug,url\nA,a,https://a\n")
    (tmp_path / "many/two.csv").write_text("name,slug,url\nB,b,https://b\n")
    assert files.read_strict_csv(spark, str(tmp_path / "many"))[0].count() == 2
    (tmp_path / "many/two.csv").write_text("name,url,slug\nB,https://b,b\n")
    with pytest.raises(ValueError):
        files.read_strict_csv(spark, str(tmp_path / "many"))
    (tmp_path / "d.csv").write_text("slug,name\na,b\n")
    with pytest.raises(ValueError):
        files.read_strict_csv(spark, str(tmp_path / "d.csv"))


def test_run_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t" * 900, "u", None)], "sequence int, title string, url string, reject_reason string")
    base = files.write_run(str(tmp_path), "r1", {"rejected": files.rejection_view(rows)}, rows.limit(1).select("sequence"))
    got = spark.read.json(f"{base}/rejected").first()
    assert len(got.title) == 500 and spark.read.json(f"{base}/summary").count() == 1


def test_report_of_a_run_without_rows(spark):
    from vacancia.operators import summary

    kinds = "detail_status string, import_status string, location_status string, eligibility string, consistency string, preflight string, exists boolean, description string, unresolved int"
    empty = spark.createDataFrame([], kinds)
    pairs, rejected, actions = (spark.createDataFrame([], f"{c} string") for c in ("status", "reason", "action"))
    (row,) = summary.outcome_report(empty, pairs, None, rejected, actions).collect()
    assert set(row.asDict().values()) == {0} and "discovery_users_eligible" not in row.asDict()
    one = spark.createDataFrame([(None, None, None, None, None, "ok", False, " ", None), ("unavailable", "skipped_x", "unparsed_y", None, None, "ok", False, None, 2)], kinds)
    got = summary.outcome_counts(one).first()
    assert (got.candidate_descriptions_missing, got.missing_descriptions_for_import, got.import_skipped, got.location_unparsed, got.location_unresolved_observations, got.detail_unavailable) == (2, 1, 1, 1, 2, 1)
    failed = summary.user_counts(spark.createDataFrame([(True, 0)], "saved_filters boolean, profiles int"), "no answer").first()
    assert (failed.discovery_users_load_status, failed.discovery_users_load_error, failed.discovery_users_failing_closed) == ("error", "no answer", 1)
