"""Queries over details of postings: the pages' ids stand in payloads as systems return them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import details as D
from vacancia.plans.fixtures import registrar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)
ID = "CAST(page_id AS VARCHAR)"


def _filled(text: str) -> Column:
    """``text`` with the page's id for each @."""
    return F.replace(F.lit(text), F.lit("@"), F.col("page_id").cast("string"))


def _flat(pages: DataFrame, detail: Column) -> DataFrame:
    place = lambda x: F.concat_ws("/", x["country_name"], x["country_code"], x["city_name"], x["region"])
    rows = pages.select("page_id", detail.alias("d")).where("d is not null")
    return rows.select("page_id", "d.description", "d.apply_url", "d.raw_location", F.array_join(F.transform("d.locations", place), "; ").alias("locations"), "d.remote_type")


def _expected(description: str, apply_url: str | None, raw: str | None, locations: str, remote: str | None) -> str:
    value = lambda v: "NULL" if v is None else "replace('" + v.replace("\n", "' || chr(10) || '") + f"', '@', {ID})"
    columns = zip(("description", "apply_url", "raw_location", "locations", "remote_type"), (description, apply_url, raw, locations, remote), strict=True)
    return "SELECT page_id, " + ", ".join(f"{value(v)} AS {c}" for c, v in columns) + " FROM pages"


@query(_expected("Job @\nand more", "https://x.example/@", "Bonn @", "", None), "pages")
def detail_greenhouse(pages: DataFrame) -> DataFrame:
    return _flat(pages, D.greenhouse(_filled('{"content":"&lt;p&gt;Job @&lt;/p&gt;&lt;p&gt;and more&lt;/p&gt;","absolute_url":" https://x.example/@ ","location":{"name":" Bonn @ "}}')))


@query(_expected("Plain @", "https://a.example/@", None, "Germany/Bonn@", "On-site"), "pages")
def detail_ashby(pages: DataFrame) -> DataFrame:
    return _flat(pages, D.ashby(_filled('{"descriptionPlain":" Plain @ ","descriptionHtml":"<p>no</p>","applyUrl":"https://a.example/@","workplaceType":"In_Office","address":{"postalAddress":{"addressCountry":"Germany","addressLocality":"Bonn@","addressRegion":" "}}}')))


@query(_expected("We\nAre @\n\nDo it\n\nOther\nzed", "https://s.example/@", None, "de/Bonn/NW", "Remote"), "pages")
def detail_smartrecruiters(pages: DataFrame) -> DataFrame:
    text = '{"jobAd":{"sections":{"zeta":{"title":"Other","text":"zed"},"jobDescription":{"text":"<p>Do it</p>"},"companyDescription":{"title":"We","text":"Are @"},"qualifications":{"title":"None","text":""}}},"applyUrl":"https://s.example/@","location":{"country":"de","city":"Bonn","region":"NW","remote":true}}'
    return _flat(pages, D.smartrecruiters(_filled(text)))


@query(_expected("Work @", "https://acme.wd3.myworkdayjobs.com/en-US/site/job/R@", "Bonn @; Köln (Hybrid)", "Germany/DE/Köln", "Hybrid") + " WHERE page_id % 3 > 0", "pages")
def detail_workday(pages: DataFrame) -> DataFrame:
    """Every third posting takes no applications."""
    text = '{"jobPostingInfo":{"canApply":CAN,"jobDescription":"<p>Work @</p>","location":"Bonn @","additionalLocations":[{"displayName":"Köln (Hybrid)","country":{"name":"Germany"},"countryCode":"DE","city":"Köln"},"Bonn @"],"externalUrl":"https://acme.wd3.myworkdayjobs.com/en-US/site/job/R@"}}'
    payload = F.replace(_filled(text), F.lit("CAN"), F.when(F.col("page_id") % 3 == 0, "false").otherwise("true"))
    return _flat(pages, D.workday(payload, _filled("https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/site/job/R@")))


@query(
    f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'In' || chr(10) || {ID} || chr(10) || 'box' ELSE 'After ' || {ID} END AS description, CASE page_id % 3 WHEN 0 THEN 'https://p.example/apply/' || {ID} ELSE 'https://p.example/job' END AS apply_url, CASE page_id % 3 WHEN 1 THEN 'Remote' END AS remote_type FROM pages WHERE page_id % 3 < 2",
    "pages",
)
def detail_pages(pages: DataFrame) -> DataFrame:
    """Pages with a marked element, with a heading, and with neither; tags nest."""
    k = F.col("page_id") % 3
    marked = '<body><div class="x jobDescription"><div>In</div> <div>@</div> box</div><div>out</div><a class="b" href="/apply/@"><b>Apply now</b></a></body>'
    headed = '<h2><b>Job description</b></h2><p>After @</p><section id="similar-jobs">no</section><p>Location: Berlin, remote</p><a href="https://evil.example/">apply</a>'
    html = F.when(k == 0, _filled(marked)).when(k == 1, _filled(headed)).otherwise(F.col("html"))
    return _flat(pages, D.page_detail(html, F.lit("https://p.example/job"))).drop("raw_location", "locations")
