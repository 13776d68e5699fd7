"""Queries over provider feeds, captured pages and one-document files, made out of the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.operators import details
from vacancia.operators.numbering import numbered
from vacancia.plans.fixtures import registrar
from vacancia.sources import files, paged
from vacancia.sources.shared import new_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
query = registrar(QUERIES, ORACLE_SQL)

PAGE_ROWS, SINCE = 200, "1999-06-01"


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _feeds(customer: DataFrame) -> DataFrame:
    """A payload a customer, in the form of one of four providers, a URL of it, and for some the provider's name."""
    k, key, name, segment = F.col("c_custkey") % 6, F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    lever = F.concat(F.lit("["), _json(id=F.concat(F.lit("l"), key), text=F.concat(name, F.lit("  ")), hostedUrl=F.concat(F.lit("https://jobs.lever.co/x/"), key), categories=F.struct(segment.alias("location"))), F.lit("]"))
    green = F.to_json(F.struct(F.array(F.struct(key.alias("id"), name.alias("title"), F.struct(segment.alias("name")).alias("location")), F.struct(F.concat(key, F.lit("00")).alias("id"), segment.alias("title"), F.struct(F.lit(None).cast("string").alias("name")).alias("location"))).alias("jobs")))
    xml = F.concat(F.lit("<jobs><!-- <position><id>1</id></position> --><position><id>"), key, F.lit("</id><name><![CDATA["), name, F.lit(" </position> & co]]></name><office>"), segment, F.lit("</office></position><position><id>"), key, F.lit("</id><name>Again</name></position></jobs>"))
    smart = F.to_json(F.struct(F.array(F.struct(key.alias("id"), name.alias("name"), F.struct(segment.alias("city"), F.lit("de").alias("country")).alias("location"))).alias("content")))
    url = F.element_at(F.array(*map(F.lit, ("https://jobs.lever.co/x", "https://careers.example.com/", "https://x.jobs.personio.de/xml", "https://api.smartrecruiters.com/v1", "https://jobs.lever.co.example/x", "https://jobs.lever.co/x"))), (k + 1).cast("int"))
    stated = F.when(k == 1, "GreenHouse ").when(k == 5, "nosuch")
    return customer.select("c_custkey", stated.alias("provider"), url.alias("url"), F.when(k == 0, lever).when(k == 1, green).when(k == 2, xml).when(k == 3, smart).otherwise(lever).alias("payload"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'personio' ELSE 'smartrecruiters' END AS provider, CASE WHEN c_custkey % 6 = 0 THEN 'l' ELSE '' END || c_custkey AS external_id,
      c_name || CASE WHEN c_custkey % 6 = 2 THEN ' </position> & co' ELSE '' END AS title, c_mktsegment || CASE WHEN c_custkey % 6 = 3 THEN ', DE' ELSE '' END AS location, CASE WHEN c_custkey % 6 = 0 THEN 'https://jobs.lever.co/x/' || c_custkey END AS url FROM customer WHERE c_custkey % 6 < 4
    UNION ALL SELECT c_custkey, 'greenhouse', c_custkey || '00', c_mktsegment, NULL, NULL FROM customer WHERE c_custkey % 6 = 1""", "customer")
def feed_mixed(customer: DataFrame) -> DataFrame:
    """Payloads of four providers in one pass; each provider is stated or told by its host."""
    jobs, _ = files.parse_feeds(_feeds(customer).withColumnRenamed("url", "board"), "provider", "board")
    return jobs.select("c_custkey", "provider", "external_id", "title", "location", "url")


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN 'unknown provider: nosuch' ELSE 'no provider' END AS problem FROM customer WHERE c_custkey % 6 >= 4", "customer")
def feed_unknown(customer: DataFrame) -> DataFrame:
    return files.parse_feeds(_feeds(customer), "provider", "url")[1].select("c_custkey", "problem")


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://p.example/apply/' || page_id WHEN 1 THEN 'https://p.example/jobs/' || page_id || '/apply' WHEN 2 THEN 'https://p.example/jobs/go?id=' || page_id WHEN 3 THEN NULL ELSE 'https://p.example/jobs/' || page_id || '/' || (page_id + 1) || '?a#b' END AS apply_url FROM pages""", "pages")
def detail_apply_links(pages: DataFrame) -> DataFrame:
    key, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    link = lambda href, label: F.concat(F.lit('<p><a class="b" href="'), href, F.lit('"><i>'), F.lit(label), F.lit("</i></a></p>"))
    foreign = link(F.lit("https://q.example/apply"), "Apply")
    shapes = (
        F.concat(foreign, link(F.concat(F.lit("/apply/"), key), "Apply now")), link(F.lit("apply"), "APPLY"), link(F.concat(F.lit("../go?id="), key), "apply now »"),
        F.concat(foreign, link(F.lit("http://p.example/apply"), "Apply"), link(F.lit("/apply"), "Apply later")), F.concat(link(F.lit("/apply"), "Read"), link(F.concat(F.lit("./"), (F.col("page_id") + 1).cast("string"), F.lit("?a#b")), "Apply")),
    )
    html = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    return pages.select("page_id", details.apply_url(F.concat(html, F.lit("<hr>"), F.lit("<a>Apply</a>")), F.concat(F.lit("https://p.example/jobs/"), key, F.lit("/"))).alias("apply_url"))


def _captured(customer: DataFrame, orders: DataFrame) -> str:
    """Orders of each nation, newest first, as pages of JSON in the shared folder, written by tasks; the folder's path."""
    spark = customer.sparkSession
    rows = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select("c_nationkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    placed = numbered(rows, [F.desc("day"), "o_orderkey"], "nth", ["c_nationkey"]).withColumn("page", F.floor((F.col("nth") - 1) / PAGE_ROWS))
    pages = placed.groupBy("c_nationkey", "page").agg(F.sort_array(F.collect_list(F.struct("nth", "o_orderkey", "day"))).alias("rows"))  # PAGE_ROWS a page
    payload = F.to_json(F.struct(F.transform("rows", lambda r: F.struct(r["o_orderkey"].alias("key"), r["day"].alias("postedOn"))).alias("jobPostings")))
    folder = new_folder(spark, "captured-pages")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = paged.open_store(folder)
        for batch in batches:
            for tenant, page, text in zip(*(batch.column(c).to_pylist() for c in ("tenant", "page", "payload")), strict=True):
                store.create_dir(f"{root}/{tenant}", recursive=True)
                with store.open_output_stream(f"{root}/{tenant}/{page}.json") as out:
                    out.write(text.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("page")], ["page"])

    written(pages.select(F.col("c_nationkey").cast("string").alias("tenant"), "page", payload.alias("payload")).mapInArrow(save, "page long"), "captured")
    return folder


@query(f"""WITH r AS (SELECT c_nationkey AS n, o_orderkey, o_orderdate, (row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) - 1) // {PAGE_ROWS} AS page FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT n, page, min(CAST(o_orderdate AS DATE)) < DATE '{SINCE}' - INTERVAL 2 DAY AS old FROM r GROUP BY ALL), s AS (SELECT n, coalesce(min(page) FILTER (WHERE old), 1499) AS last FROM p GROUP BY n)
    SELECT CAST(r.n AS VARCHAR) AS tenant, page, count(*) AS postings, min(o_orderkey) AS least_key FROM r JOIN s ON r.n = s.n AND page <= least(last, 1499) GROUP BY ALL""", "customer", "orders")
def pages_until_old(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Captured pages of each nation up to the first that is old; what lies behind isn't opened."""
    spark = customer.sparkSession
    paged.register(spark)
    found = spark.read.format("captured_pages").options(path=_captured(customer, orders), since=SINCE, maxPages="1500").load()
    jobs = F.from_json("payload", "jobPostings array<struct<key:long,postedOn:string>>")["jobPostings"]
    return found.select("tenant", F.col("page").cast("long").alias("page"), F.size(jobs).cast("long").alias("postings"), F.array_min(F.transform(jobs, lambda j: j["key"])).alias("least_key"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS customers FROM customer GROUP BY ALL", "customer")
def envelope_document(customer: DataFrame) -> DataFrame:
    """A report as one JSON document of many tasks, read back."""
    spark = customer.sparkSession
    paged.register(spark)
    path = new_folder(spark, "envelope") + ".json"
    customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("customers")).write.format("json_envelope").mode("overwrite").save(path)
    return files.read_envelope(spark, path, "c_nationkey long, c_mktsegment string, customers long")
