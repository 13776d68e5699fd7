"""Captured pages with an early stop, one JSON document of many tasks, mixed feeds, XML feeds and apply links."""

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from vacancia.functions import scores, urls
from vacancia.operators import details
from vacancia.sources import files, paged


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    """Three tenants of ten pages; a page's postings are three days older than the page before's."""
    root = tmp_path_factory.mktemp("pages")
    for tenant in ("a", "b", "c"):
        (root / tenant).mkdir()
        for n in range(10):
            day = dt.date(2024, 6, 30) - dt.timedelta(days=3 * n)
            dates = ["30+ Days Ago"] * 2 if tenant == "b" else [day.isoformat(), (day + dt.timedelta(days=1)).isoformat(), None]
            (root / tenant / f"{n}.json").write_text("oops" if tenant == "c" and n == 1 else json.dumps({"jobPostings": [{"title": f"{tenant}{n}", "postedOn": d} for d in dates]}))
        (root / tenant / "notes.txt").write_text("not a page")
    return root


def read_pages(spark, root, **options):
    paged.register(spark)
    rows = spark.read.format("captured_pages").options(path=str(root), **options).load().collect()
    return {t: sorted(r.page for r in rows if r.tenant == t) for t in ("a", "b", "c")}


def test_pages_stop_when_old(spark, pages):
    # 2024-06-24 less two days: the page of 06-21 (the fourth) is the first whose oldest posting lies before that.
    assert read_pages(spark, pages, since="2024-06-24T00:00:00Z") == {"a": [0, 1, 2, 3], "b": list(range(10)), "c": [0, 1, 2, 3]}
    assert read_pages(spark, pages) == {t: list(range(10)) for t in "abc"}
    assert read_pages(spark, pages, maxPages="2")["a"] == [0, 1]


def test_later_pages_are_not_opened(pages, monkeypatch):
    opened = []
    real = paged.open_store

    class Counting:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, what):
            return self.store.get_file_info(what)

        def open_input_stream(self, path):
            opened.append(pathlib.Path(path).name)
            return self.store.open_input_stream(path)

    monkeypatch.setattr(paged, "open_store", lambda path: (Counting(real(path)[0]), real(path)[1]))
    reader = paged.PageReader({"path": str(pages), "since": "2024-06-27"})
    kept = [page for _, page, _ in reader.read(paged.Tenant("a"))]
    assert kept == [0, 1, 2] and opened == ["0.json", "1.json", "2.json"]
    # What the early stop leaves out holds no posting within the window.
    assert all(not paged.is_old((pages / "a" / f"{n}.json").read_text(), "jobPostings", "postedOn", reader.start) for n in kept[:-1])


def test_page_caps():
    assert [paged.page_cap(x) for x in (None, "7", "0", "-1", "x", "9999")] == [100, 7, 100, 100, 100, 1500]
    assert paged.instant("30+ Days Ago") is None and paged.instant("2024-01-02") < paged.instant("2024-01-02T01:00:00+00:00")


def test_one_document_of_all_tasks(spark, tmp_path):
    paged.register(spark)
    path = tmp_path / "out.json"
    rows = spark.range(0, 50, numPartitions=7).select(F.col("id"), F.concat(F.lit('nä"me '), F.col("id").cast("string")).alias("name"))
    rows.write.format("json_envelope").mode("overwrite").save(str(path))
    found = json.loads(path.read_text())
    assert found["schemaVersion"] == 1 and [i["id"] for i in found["items"]] == list(range(50)) and found["items"][3]["name"] == 'nä"me 3'
    assert sorted(r.id for r in files.read_envelope(spark, str(path), "id long, name string").collect()) == list(range(50))
    assert [f.name for f in tmp_path.iterdir()] == ["out.json"]
    rows.limit(0).write.format("json_envelope").mode("overwrite").option("version", "2").save(str(path))
    assert json.loads(path.read_text()) == {"schemaVersion": 2, "items": []}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    paged.register(spark)
    path = tmp_path / "out.json"
    bad = spark.range(0, 20, numPartitions=4).select(F.when(F.col("id") < 15, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("json_envelope").mode("overwrite").save(str(path))
    assert not path.exists()


XML = """<?xml version="1.0"?><workzag-jobs><!-- <position><id>9</id></position> -->
<position><id>1</id><name><![CDATA[Dev </position> & more]]></name><office>Berlin</office><createdAt>2024-01-02</createdAt>
 <jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[<p>Do <b>this</b></p>]]></value></jobDescription>
 <jobDescription><name>You</name><value> </value></jobDescription><jobDescription><value>Plain &amp; simple</value></jobDescription></jobDescriptions></position>
<position><id>1</id><name>Again</name></position><position><id>x</id></position><position><id>2</id><name> Ops </name></position></workzag-jobs>"""


def test_positions_in_xml(spark):
    feeds = [XML, "<workzag-jobs></workzag-jobs>", "<workzag-jobs><position><id>7</id></position></workzag-jobs>", "not xml", "", None]
    rows = files.parse_feed(spark.createDataFrame(list(enumerate(feeds)), "k int, payload string"), "personio").orderBy("k", "external_id").collect()
    assert [(r.k, r.external_id, r.title, r.location, r.posted_at) for r in rows] == [(0, "1", "Dev </position> & more", "Berlin", "2024-01-02"), (0, "2", "Ops", None, None), (2, "7", None, None, None)]
    assert rows[0].description == "Tasks\nDo this\n\nPlain & simple" and rows[1].description is None


def test_mixed_feeds(spark):
    lever = json.dumps([{"id": "l1", "text": "Dev", "hostedUrl": "https://jobs.lever.co/a/l1", "categories": {"location": "Berlin"}}])
    green = json.dumps({"jobs": [{"id": 5, "title": " Ops "}, {"id": 6, "title": "QA"}]})
    rows = [(1, None, "https://jobs.lever.co/a", lever), (2, "Greenhouse", "https://careers.example.com", green), (3, None, "https://x.jobs.personio.de/xml", XML), (4, "nosuch", "https://jobs.lever.co/a", lever), (5, None, "https://eviljobs.lever.co/a", lever), (6, "", None, None), (7, None, "https://jobs.lever.co/b", "not json")]
    jobs, unknown = files.parse_feeds(spark.createDataFrame(rows, "k int, provider string, url string, payload string"), "provider", "url")
    assert sorted((r.k, r.provider, r.external_id) for r in jobs.select("k", "provider", "external_id").collect()) == [(1, "lever", "l1"), (2, "greenhouse", "5"), (2, "greenhouse", "6"), (3, "personio", "1"), (3, "personio", "2")]
    assert sorted((r.k, r.problem) for r in unknown.collect()) == [(4, "unknown provider: nosuch"), (5, "no provider"), (6, "no provider")]


PAGE = "https://p.example/jobs/list/one?x=1"
LINKS = [
    ('<a href="https://other.example/apply">Apply</a><a class="x" href="/apply/5"><b>Apply now</b> »</a>', "https://p.example/apply/5"),
    ('<a href="apply/5">APPLY NOW</a>', "https://p.example/jobs/list/apply/5"),
    ('<a href="../apply?id=../7#top">apply</a>', "https://p.example/jobs/apply?id=../7#top"),
    ('<a href="//p.example/a">Apply</a>', "https://p.example/a"),
    ('<a href="http://p.example/a">Apply</a>', None),
    ('<a href="?go=1">Apply</a>', "https://p.example/jobs/list/one?go=1"),
    ('<a href="mailto:a@p.example">Apply</a><a href="https://p.example:444/a">Apply</a>', None),
    ('<a href="/a">Apply here</a>', None),
    ('<a>Apply</a>', None),
    ("", None),
]


def test_apply_links(spark):
    rows = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(LINKS)], "k int, html string")
    got = {r.k: r.u for r in rows.select("k", details.apply_url(F.col("html"), F.lit(PAGE)).alias("u")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LINKS)}


def test_marked_elements(spark):
    open_, close = '<div class="jobdescription">', "</div>"
    texts = [f"<p>x</p>{open_}a<div>b</div>c{close}d{close}", f"{open_}<br/>a<img>{open_}b{close}c{close}", f"<!-- {open_}no{close} -->{open_}yes{close}", f"{open_}never closed <section id='job-content'>but this</section>", "<p>none</p>", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, html string")
    got = {r.k: r.m for r in rows.select("k", details.marked_element("html").alias("m")).collect()}
    assert got == {0: "a<div>b</div>c", 1: f"<br/>a<img>{open_}b{close}c", 2: "yes", 3: "but this", 4: "", 5: "", 6: ""}


def test_decisions_kept(spark):
    row = spark.range(1).select(
        scores.scored_section(F.lit('{"Skills":{"score":0,"value":5}}'), ("Skills",), "-")["score"].alias("later"), scores.scored_section(F.lit('{"Skills":{"score":0}}'), ("Skills",), "-")["score"].alias("zero"),
        urls.proxy_identity(F.lit("https://eviljobs.lever.co/a/b"))["provider"].alias("evil"), urls.proxy_identity(F.lit("https://jobs.eu.lever.co/a/b"))["provider"].alias("good"),
    ).first()
    assert tuple(row) == (5.0, 0.0, None, "lever")
