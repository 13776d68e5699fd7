"""Files in and out: JSON envelopes, strict CSV, provider feeds, run folders and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from vacancia.functions.texts import html_to_text

JOB = "external_id string, title string, url string, location string, description string, posted_at string"


def read_envelope(spark: SparkSession, path: str, item: str, version: int = 1, lines: bool = False) -> DataFrame:
    """Items of JSON documents ``{schemaVersion, items: [...]}``, or with ``lines`` of what write_envelope writes; another
    version is an error."""
    docs = spark.read.schema(f"schemaVersion int, items array<struct<{item}>>, item struct<{item}>").option("multiLine", not lines).json(path)
    wrong = docs.where(~F.col("schemaVersion").eqNullSafe(F.lit(version))).limit(1).count()
    if wrong:
        raise ValueError(f"an envelope's schemaVersion isn't {version}")
    return docs.select("item.*") if lines else docs.select(F.explode("items").alias("i")).select("i.*")


def write_envelope(rows: DataFrame, path: str, version: int = 1) -> None:
    """Rows as JSON lines under a folder, with the version on each; the commit protocol makes it appear at once."""
    rows.select(F.lit(version).alias("schemaVersion"), F.struct(*rows.columns).alias("item")).write.mode("overwrite").json(path)


def read_strict_csv(spark: SparkSession, path: str, header: Sequence[str] = ("name", "slug", "url")) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV with exactly this header, and the lines with another number of cells.

    Quotes follow RFC 4180, a byte-order mark is ignored; another header or a stray quote is an error.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    first = text.groupBy("file").agg(F.min_by("value", F.struct("block", "nth")).alias("line"))  # every file's first line
    cells = F.transform(F.split(F.regexp_replace("line", "^\ufeff", ""), ","), F.trim)
    if first.isEmpty() or not first.where(cells != F.array(*map(F.lit, header))).isEmpty():
        raise ValueError(f"the header of each file must be {','.join(header)}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", _bad string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "_bad").csv(path)
    open_quote = F.length(F.regexp_replace("_bad", '[^"]', "")) % 2 == 1
    if rows.where(open_quote).select(header[0], "_bad").limit(1).collect():
        raise ValueError("a quote isn't closed")
    read = F.length(F.coalesce(header[0], F.lit(""))) >= 0  # always true: Spark reads no corrupt-record column alone
    return rows.where(F.col("_bad").isNull() & read).drop("_bad"), rows.where(F.col("_bad").isNotNull() & read).withColumnRenamed("_bad", "line")


def valid_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike("^[a-z0-9](?:[a-z0-9._-]{0,98}[a-z0-9])?$"), F.lit(False))


def catalogue_items(rows: DataFrame, order: str) -> DataFrame:
    """Catalogue rows with slug and verdict: accepted, rejected with a reason, or duplicate of an earlier slug."""
    named = rows.withColumn("slug", F.lower(F.trim("slug")))
    reason = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "missing_name").when(~valid_slug(F.col("slug")), "invalid_slug")
    judged = named.withColumn("reason", reason)
    w = Window.partitionBy("slug").orderBy(order)
    good = judged.where(F.col("reason").isNull()).withColumn("verdict", F.when(F.row_number().over(w) > 1, "duplicate").otherwise("accepted"))
    return good.unionByName(judged.where(F.col("reason").isNotNull()).withColumn("verdict", F.lit("rejected")))  # they may share a slug


def build_counts(items: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return items.agg(F.count("*").alias("source"), n("accepted"), n("rejected"), n("duplicate"))


def quality_gate(counts: DataFrame, least_rows: int, least_ratio: float) -> DataFrame:
    """Whether a catalogue has rows enough, and enough of them accepted (duplicates count as such)."""
    ratio = F.when(F.col("source") > 0, (F.col("accepted") + F.col("duplicate")) / F.col("source")).otherwise(0.0)
    return counts.select(F.round(ratio, 4).alias("ratio"), ((F.col("source") >= least_rows) & (ratio >= least_ratio)).alias("passes"))


def catalogue_order(items: DataFrame) -> DataFrame:
    return items.orderBy("slug", F.to_json(F.struct("name", "url")))


# --- provider feeds: captured payloads in, job rows out -------------------------------------------------------------
PARSERS: dict[str, Callable[[Column], Column]] = {}


def parser(name: str) -> Callable:
    """Registers a provider's parser: from a payload column to an array of jobs."""

    def register(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        PARSERS[name] = f
        return f

    return register


def _jobs(items: Column, **fields: Callable[[Column], Column]) -> Column:
    names = [f.split(" ")[0] for f in JOB.split(", ")]
    return F.transform(items, lambda x: F.struct(*[(fields[n](x) if n in fields else F.lit(None).cast("string")).alias(n) for n in names]))


@parser("greenhouse")
def greenhouse(payload: Column) -> Column:
    items = F.from_json(F.get_json_object(payload, "$.jobs"), "array<struct<id:string,title:string,absolute_url:string,location:struct<name:string>,content:string,updated_at:string>>")
    return _jobs(items, external_id=lambda x: x["id"], title=lambda x: F.trim(x["title"]), url=lambda x: x["absolute_url"], location=lambda x: x["location"]["name"], description=lambda x: x["content"], posted_at=lambda x: x["updated_at"])


@parser("lever")
def lever(payload: Column) -> Column:
    items = F.from_json(payload, "array<struct<id:string,text:string,hostedUrl:string,categories:struct<location:string,allLocations:array<string>>,descriptionPlain:string,createdAt:bigint>>")
    place = lambda x: F.when(F.size(x["categories"]["allLocations"]) > 0, F.array_join(F.array_distinct(x["categories"]["allLocations"]), "; ")).otherwise(x["categories"]["location"])
    return _jobs(items, external_id=lambda x: x["id"], title=lambda x: F.trim(x["text"]), url=lambda x: x["hostedUrl"], location=place, description=lambda x: x["descriptionPlain"], posted_at=lambda x: F.timestamp_millis(x["createdAt"]).cast("string"))


@parser("ashby")
def ashby(payload: Column) -> Column:
    items = F.from_json(F.get_json_object(payload, "$.jobs"), "array<struct<id:string,title:string,jobUrl:string,location:string,descriptionHtml:string,publishedAt:string,isListed:boolean>>")
    listed = F.filter(items, lambda x: F.coalesce(x["isListed"], F.lit(True)))
    return _jobs(listed, external_id=lambda x: x["id"], title=lambda x: F.trim(x["title"]), url=lambda x: x["jobUrl"], location=lambda x: x["location"], description=lambda x: x["descriptionHtml"], posted_at=lambda x: x["publishedAt"])


@parser("smartrecruiters")
def smartrecruiters(payload: Column) -> Column:
    items = F.from_json(F.get_json_object(payload, "$.content"), "array<struct<id:string,name:string,ref:string,releasedDate:string,location:struct<city:string,region:string,country:string>>>")
    place = lambda x: F.concat_ws(", ", x["location"]["city"], x["location"]["region"], F.upper(x["location"]["country"]))
    return _jobs(items, external_id=lambda x: x["id"], title=lambda x: F.trim(x["name"]), url=lambda x: x["ref"], location=place, posted_at=lambda x: x["releasedDate"])


@parser("workday")
def workday(payload: Column) -> Column:
    items = F.from_json(F.get_json_object(payload, "$.jobPostings"), "array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>")
    return _jobs(items, external_id=lambda x: F.coalesce(F.get(x["bulletFields"], F.lit(0)), F.substring_index(x["externalPath"], "/", -1)), title=lambda x: F.trim(x["title"]), url=lambda x: x["externalPath"], location=lambda x: x["locationsText"], posted_at=lambda x: x["postedOn"])


@parser("personio")
def personio(payload: Column) -> Column:
    """An XML feed's positions, read as XML; the first of equal ids stays. Sections of a description under their headings."""
    section = "struct<jobDescription:array<struct<name:string,value:string>>>"
    kind = f"struct<position:array<struct<id:string,name:string,office:string,subcompany:string,department:string,employmentType:string,createdAt:string,jobDescriptions:{section}>>>"
    blocks = F.filter(F.coalesce(F.from_xml(F.trim(payload), kind, {"ignoreSurroundingSpaces": "true"})["position"], F.array()), lambda x: x.isNotNull())

    def sections(x: Column) -> Column:
        told = F.transform(x["jobDescriptions"]["jobDescription"], lambda d: F.struct(F.trim(d["name"]).alias("name"), html_to_text(d["value"]).alias("value")))
        told = F.filter(told, lambda d: F.coalesce(d["value"], F.lit("")) != "")
        texts = F.transform(told, lambda d: F.when(F.coalesce(d["name"], F.lit("")) != "", F.concat(d["name"], F.lit("\n"), d["value"])).otherwise(d["value"]))
        return F.nullif(F.array_join(texts, "\n\n"), F.lit(""))

    trimmed = lambda name: lambda x: F.nullif(F.trim(x[name]), F.lit(""))
    jobs = _jobs(blocks, external_id=trimmed("id"), title=trimmed("name"), location=trimmed("office"), description=sections, posted_at=trimmed("createdAt"))
    numeric = F.filter(jobs, lambda j: F.coalesce(j["external_id"].rlike("^[0-9]+$"), F.lit(False)))
    ids = F.transform(numeric, lambda j: j["external_id"])
    return F.filter(numeric, lambda j, i: F.array_position(ids, j["external_id"]) == i + 1)


@parser("successfactors")
def successfactors(payload: Column) -> Column:
    """Tiles of an HTML listing."""
    tiles = F.regexp_extract_all(payload, F.lit(r'(?is)(<a\b[^>]*class="[^"]*jobTitle-link[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    link = lambda x: F.regexp_extract(x, r'(?i)href="([^"]*)"', 1)
    return _jobs(tiles, external_id=lambda x: F.regexp_extract(link(x), r"/(\d+)(?:-[a-z]{2}_[A-Z]{2})?/?$", 1), title=html_to_text, url=link)


@parser("softgarden")
def softgarden(payload: Column) -> Column:
    """Blocks of an HTML widget, each with its job's id; a link with a title is its posting, the first of equal ids stays."""
    blocks = F.regexp_extract_all(payload, F.lit(r'(?is)(<[^>]*\bdata-job-id="[^"]+"[^>]*>.*?)(?=<[^>]*\bdata-job-id="|$)'), F.lit(1))
    href = lambda a: F.regexp_extract(a, r'(?is)^<a\b[^>]*\bhref="([^"]+)"', 1)

    def link(block: Column) -> Column:
        anchors = F.regexp_extract_all(block, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
        return F.get(F.filter(anchors, lambda a: (href(a) != "") & (a.rlike(r'(?is)^<a\b[^>]*\bclass="[^"]*job-?title') | href(a).rlike("(?i)/job/"))), F.lit(0))

    def places(block: Column) -> Column:
        found = F.regexp_extract_all(block, F.lit(r'(?is)class="[^"]*\blocation-view-item\b[^"]*"[^>]*>(.*?)</span>'), F.lit(1))
        names = F.filter(F.transform(found, lambda t: html_to_text(t)), lambda t: t != "")
        low = F.transform(names, F.lower)
        return F.array_join(F.filter(names, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), " / ")

    def date(block: Column) -> Column:
        either = r'(?is)class="[^"]*\b(?:matchValue\b[^"]*\bdate|date\b[^"]*\bmatchValue)\b[^"]*"[^>]*>(.*?)</'
        return F.nullif(html_to_text(F.regexp_extract(block, either, 1)), F.lit(""))

    jobs = _jobs(blocks, external_id=lambda x: F.regexp_extract(x, r'(?i)\bdata-job-id="([^"\s]+)"', 1), title=lambda x: html_to_text(link(x)), url=lambda x: href(link(x)), location=places, posted_at=date)
    whole = F.filter(jobs, lambda j: F.coalesce((j["title"] != "") & (j["external_id"] != ""), F.lit(False)))
    ids = F.transform(whole, lambda j: j["external_id"])
    return F.filter(whole, lambda j, i: F.array_position(ids, j["external_id"]) == i + 1)


def parse_feed(payloads: DataFrame, provider: str, payload: str = "payload") -> DataFrame:
    """A row a job of captured payloads, beside the payload's other columns."""
    rest = [c for c in payloads.columns if c != payload]
    return payloads.select(*rest, F.explode(PARSERS[provider](F.col(payload))).alias("job")).select(*rest, "job.*")


# Hosts of each provider's boards; a name with a leading dot stands for its subdomains.
HOSTS = {
    "ashby": ("jobs.ashbyhq.com", "api.ashbyhq.com"),
    "greenhouse": ("boards.greenhouse.io", "job-boards.greenhouse.io", "boards-api.greenhouse.io"),
    "lever": ("jobs.lever.co", "jobs.eu.lever.co", "api.lever.co"),
    "personio": (".jobs.personio.de", ".jobs.personio.com"),
    "smartrecruiters": ("jobs.smartrecruiters.com", "api.smartrecruiters.com", "careers.smartrecruiters.com"),
    "softgarden": (".softgarden.io",),
    "workday": (".myworkdayjobs.com",),
}


def detect(url: Column) -> Column:
    """The provider whose board a URL is on, by its host; null for others and for none."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    found = [F.when(host.endswith(h) if h.startswith(".") else host == h, F.lit(name)) for name, hosts in HOSTS.items() for h in hosts]
    return F.coalesce(*found)


def resolve_provider(provider: Column, url: Column) -> Column:
    """Struct of provider and problem: a stated provider that has a parser, else the one that the URL's host detects."""
    stated = F.nullif(F.lower(F.trim(provider)), F.lit(""))
    known = stated.isin(*PARSERS)
    name = F.when(stated.isNull(), detect(url)).when(known, stated)
    problem = F.when(stated.isNotNull() & ~known, F.concat(F.lit("unknown provider: "), stated)).when(name.isNull(), "no provider")
    return F.struct(name.alias("provider"), problem.alias("problem"))


def parse_feeds(payloads: DataFrame, provider: str, url: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """A row a job of captured payloads of any providers, each read by its own parser in one pass, and the payloads that no
    parser reads, with their problem. Other columns go along; ``provider`` holds the resolved one."""
    rest = [c for c in payloads.columns if c not in (payload, provider)]
    resolved = payloads.withColumn("_r", resolve_provider(F.col(provider), F.col(url)))
    jobs = None
    for name, parse in PARSERS.items():
        mine = F.col("_r.provider") == name
        read = parse(F.when(mine, F.col(payload)))
        jobs = F.when(mine, read) if jobs is None else jobs.when(mine, read)
    parsed = resolved.where("_r.provider is not null").select(*rest, F.col("_r.provider").alias(provider), F.explode(jobs).alias("job")).select(*rest, provider, "job.*")
    return parsed, resolved.where("_r.provider is null").select(*rest, F.col(provider), F.col("_r.problem").alias("problem"))


@F.pandas_udf(StringType())
def job_posting(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first JobPosting among a page's JSON-LD blocks, at whatever depth, as JSON; null without one."""
    import re

    blocks = re.compile(r'<script\b[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>', re.I | re.S)

    def kind(node: dict) -> bool:
        types = node.get("@type")
        return "JobPosting" in (types if isinstance(types, list) else [types])

    def one(html: str | None) -> str | None:
        for text in blocks.findall(html or "")[:100]:
            try:
                nodes = [json.loads(text)] if len(text) <= 2_000_000 else []
            except ValueError:
                continue
            seen = 0
            while nodes and seen < 10_000:
                node, seen = nodes.pop(0), seen + 1
                if isinstance(node, dict):
                    if kind(node):
                        return json.dumps(node, sort_keys=True, ensure_ascii=False)
                    nodes += node.values()
                elif isinstance(node, list):
                    nodes += node
        return None

    for batch in batches:
        yield batch.map(one)


def since(rows: DataFrame, posted_at: str, start: Column) -> DataFrame:
    """Rows posted from ``start`` on; undated ones stay. On a table sorted by time the filter prunes row groups."""
    return rows.where(F.col(posted_at).isNull() | (F.col(posted_at) >= start))


def write_run(folder: str, run_id: str, artifacts: dict[str, DataFrame], summary: DataFrame) -> str:
    """A run's artifacts under its own folder, the summary last: a run without it isn't complete."""
    base = f"{folder}/run_id={run_id}"
    for name, rows in artifacts.items():
        rows.write.mode("overwrite").json(f"{base}/{name}")
    summary.write.mode("overwrite").json(f"{base}/summary")
    return base


def rejection_view(rejected: DataFrame, columns: Sequence[str] = ("sequence", "title", "url", "reject_reason"), most: int = 500) -> DataFrame:
    """A fixed list of bounded columns of rejected rows."""
    return rejected.select(*[F.left(F.col(c).cast("string"), F.lit(most)).alias(c) for c in columns])


def write_report(lines: DataFrame, path: str, form: str = "csv") -> None:
    if form == "csv":
        lines.write.mode("overwrite").option("header", True).csv(path)
    else:
        lines.select("value").write.mode("overwrite").text(path)


def snapshot_path(run_id: Column, kind: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.left(F.sha2(run_id.cast("string"), 256), F.lit(2)), F.lit("/"), run_id.cast("string"), F.lit(".json"))


def read_schema(text: str) -> StructType:
    return StructType.fromDDL(text)
