"""Queries over scalar functions: URLs, texts, identifiers, languages, scores, dates and places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacancia.functions import identity, scores, texts, urls
from vacancia.operators import places, reports
from vacancia.plans.fixtures import registrar, sql, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


query = registrar(QUERIES, ORACLE_SQL)


HOST = "regexp_replace(trim(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '.'), '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
PARTS = f"list_filter(string_split({PATH}, '/'), lambda x: x <> '')"
LAST = f"{PARTS}[-1]"
SPARE = f"substr(sha1(lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || {HOST} || {PATH}), 1, 16)"
GENERIC = "('" + "', '".join(dict.fromkeys(urls.GENERIC_SEGMENTS + urls.GENERIC_LABELS)) + "')"
LABELS = "('" + "', '".join(urls.GENERIC_LABELS) + "')"


@query(f"SELECT page_id, {HOST} AS host, {SPARE} AS hash, len({PARTS}) AS parts, coalesce({LAST}, '') AS last FROM pages", "pages")
def url_hash_id(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select("page_id", urls.host(url).alias("host"), urls.path_hash(url).alias("hash"), F.size(urls.path_parts(url)).alias("parts"), F.coalesce(urls.last_part(urls.path_parts(url)), F.lit("")).alias("last"))


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'weworkremotely' END AS found_on FROM pages", "pages")  # noqa: F541
def url_referral(pages: DataFrame) -> DataFrame:
    k = F.col("page_id") % 3
    note = F.when(k == 0, "?source=https://www.LinkedIn.com/x").when(k == 1, "?q=1&utm_source=WWR").otherwise("?q=1")
    return pages.select("page_id", urls.referral(F.concat(F.regexp_replace("url", r"[?#].*$", ""), note)).alias("found_on"))


@query("SELECT page_id, regexp_replace(split_part(split_part(u, '?', 1) || CASE WHEN contains(u, '?') THEN '?' || replace(substr(u, strpos(u, '?') + 1), '?', '&') ELSE '' END, '#', 1), '&{2,}', '&', 'g') AS url FROM (SELECT page_id, url || CASE page_id % 2 WHEN 0 THEN '?a=1?b=2&&&c=3#top' ELSE '&&x' END AS u FROM pages)", "pages")
def url_normalise(pages: DataFrame) -> DataFrame:
    more = F.when(F.col("page_id") % 2 == 0, "?a=1?b=2&&&c=3#top").otherwise("&&x")
    return pages.select("page_id", urls.normalise_url(F.concat("url", more)).alias("url"))


FIRST = f"string_split({HOST}, '.')"


@query(
    f"""WITH p AS (SELECT *, {FIRST} AS hs, {PARTS} AS ps, {LAST} AS seg FROM pages), q AS (SELECT *, hs[:-2] AS pre, list_position(list_transform(ps, lambda x: lower(x)), 'job') AS nth FROM p)
    SELECT page_id, CASE WHEN hs[1] IN {LABELS} AND len(hs) > 2 THEN hs[2] ELSE hs[1] END AS provider, '' AS tenant,
      CASE WHEN nth > 0 AND nth < len(ps) THEN ps[nth + 1] WHEN seg IS NOT NULL AND lower(seg) NOT IN {GENERIC} THEN seg ELSE {SPARE} END AS external_id,
      coalesce(nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), ''), nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), 'corporate-site') AS found_on, list_filter(hs[:-2], lambda x: x NOT IN {LABELS})[-1] AS hiring_company FROM q""",
    "pages",
)
def url_identity(pages: DataFrame) -> DataFrame:
    """Identity of the pages' URLs, all of which are of the generic kind; tests hold the systems' own rules."""
    found = urls.with_identity(pages.select("page_id", "url"))
    return found.select("page_id", *[F.col(f"identity.{c}").alias(c) for c in ("provider", "tenant", "external_id", "found_on", "hiring_company")])


#: URLs of systems and boards, with @ for the page's id, and what identifies the job there.
SYSTEM_URLS = [
    ("https://boards.greenhouse.io/acme@/jobs/4@?source=LinkedIn", "greenhouse", "acme@", "4@", "linkedin", "acme@"),
    ("https://boards.greenhouse.io/embed/job_app?for=acme@&token=7@", "greenhouse", "acme@", "7@", "corporate-site", "acme@"),
    ("https://jobs.eu.lever.co/acme@/ab-@", "lever", "acme@", "ab-@", "corporate-site", "acme@"),
    ("https://acme@.lever.co/ab-@?ref=li", "lever", "acme@", "ab-@", "linkedin", "acme@"),
    ("https://acme@.wd3.myworkdayjobs.com/en/site/job/Berlin/Dev_R-@", "workday", "acme@", "Dev_R-@", "corporate-site", "acme@"),
    ("https://jobs.ashbyhq.com/acme@/id-@/application", "ashby", "acme@", "id-@", "corporate-site", "acme@"),
    ("https://acme@.jobs.personio.de/job/9@", "personio", "acme@", "9@", "corporate-site", "acme@"),
    ("https://jobs.smartrecruiters.com/company/acme@/job/5@", "smartrecruiters", "acme@", "5@", "corporate-site", "acme@"),
    ("https://join.com/companies/acme@/12@-dev", "join", "acme@", "12@", "corporate-site", "acme@"),
    ("https://acme@.jobs.hr.cloud.sap/site/job/Engineer/55@-de_DE", "successfactors", "acme@.jobs.hr.cloud.sap", "55@", "corporate-site", "acme@"),
    ("https://acme@.recruitee.com/o/jobs/dev-@", "recruitee", "acme@", "dev-@", "corporate-site", "acme@"),
    ("https://www.linkedin.com/jobs/view/381234@", "linkedin", "", "381234@", "linkedin", None),
    ("https://de.indeed.com/viewjob?vjk=k@&utm_source=xing", "indeed", "", "k@", "xing", None),
    ("https://www.stepstone.de/stellenangebote/dev-@", "stepstone", "", "dev-@", "stepstone", None),
    ("https://www.reed.co.uk/jobs/dev-@", "reed", "", "dev-@", "reed", None),
]


def _cases(nth: int) -> str:
    return "CASE page_id % 15 " + " ".join(f"WHEN {k} THEN " + ("NULL" if row[nth] is None else f"replace('{row[nth]}', '@', CAST(page_id AS VARCHAR))") for k, row in enumerate(SYSTEM_URLS)) + " END"


@query("SELECT page_id, " + ", ".join(f"{_cases(n)} AS {c}" for n, c in enumerate(("provider", "tenant", "external_id", "found_on", "hiring_company"), 1)) + " FROM pages", "pages")
def url_identity_systems(pages: DataFrame) -> DataFrame:
    shapes = F.array(*[F.lit(row[0]) for row in SYSTEM_URLS])
    url = F.replace(F.element_at(shapes, (F.col("page_id") % 15 + 1).cast("int")), F.lit("@"), F.col("page_id").cast("string"))
    found = urls.with_identity(pages.select("page_id", url.alias("url")))
    return found.select("page_id", *[F.col(f"identity.{c}").alias(c) for c in ("provider", "tenant", "external_id", "found_on", "hiring_company")])


@query(f"SELECT page_id, regexp_matches({HOST}, '^[a-z]') AS public FROM pages", "pages")
def url_public(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", urls.is_public(F.col("url")).alias("public"))


def _steps(column: str, *steps: tuple[str, str, str]) -> str:
    for pattern, by, flags in steps:
        pattern, by = pattern.replace("'", "''"), by.replace("\n", "\\n")
        column = f"regexp_replace({column}, '{pattern}', {_quoted(by)}, '{flags}')"
    return column


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\\n", "' || chr(10) || '") + "'"


HTML = _steps(
    "coalesce(html, '')",
    (r"<script\b[^>]*>.*?</script>", " ", "gis"), (r"<style\b[^>]*>.*?</style>", " ", "gis"), (r"<\s*br\s*/?>", "\n", "gi"), (r"<\s*li\b[^>]*>", "\n- ", "gi"),
    (r"</\s*(p|div|li|h[1-6]|section|article|tr|ul|ol)\s*>", "\n", "gi"), (r"<[^>]+>", " ", "gs"), ("&amp;", chr(1), "gi"), ("&lt;", "<", "gi"), ("&gt;", ">", "gi"), ("&quot;", '"', "gi"), ("&apos;", "'", "gi"), ("&nbsp;", " ", "gi"), (chr(1), "&", "g"),
    (r"\r", "", "g"), (r"[ \t]+\n", "\n", "g"), (r"\n[ \t]+", "\n", "g"), (r"[ \t]{2,}", " ", "g"), (r"\n{3,}", "\n\n", "g"), (r"^\s+|\s+$", "", "g"),
)


@query(f"SELECT page_id, {HTML} AS text FROM pages", "pages")
def html_to_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", texts.html_to_text(F.col("html")).alias("text"))


@query(None, "pages")
def html_to_text_numeric(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", texts.html_to_text(F.col("html"), numeric=True).alias("text"))


NORMAL = _steps("text", (r"\r\n?", "\n", "g"), (r"[ \t\f\v\r]+\n", "\n", "g"), (r"\n{3,}", "\n\n", "g"), (r"[ \t]{2,}", " ", "g"), (r"^\s+|\s+$", "", "g"))


@query(f"SELECT doc_id, {NORMAL} || chr(10) AS text FROM documents", "documents")
def text_normalise(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", texts.normalise_text(F.col("text")).alias("text"))


@query("""SELECT doc_id, CASE WHEN t = '' THEN '' ELSE '<p>' || array_to_string(list_transform(regexp_split_to_array(t, '\\n([ \\t]*\\n)+'), lambda x: replace(x, chr(10), '<br>')), '</p><p>') || '</p>' END AS html
    FROM (SELECT doc_id, replace(replace(replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM documents)""", "documents")
def safe_html(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", texts.text_to_html(F.col("text")).alias("html"))


MARKED = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '([.!?;])\\s+', '\\1' || chr(10), 'g')"


@query(f"""SELECT doc_id, count(*) AS n, sum(length(w)) AS chars, min(w) AS least FROM (SELECT doc_id, left(w, 500) AS w FROM (SELECT doc_id, trim(unnest(regexp_split_to_array({MARKED}, '\\n+'))) AS w FROM documents) WHERE length(w) >= 4) GROUP BY doc_id""", "documents")
def description_windows(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.explode(texts.description_windows(F.col("text"))).alias("w"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("w")).alias("chars"), F.min("w").alias("least"))


@query("SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\\b(https?://[^\\s?#]+)[?#][^\\s]*', '\\1', 'g'), '(?i)\\b(authorization|x-functions-key|api[-_ ]?key|token|code)(\\s*[:=]\\s*)[^\\s,;]+', '\\1\\2[redacted]', 'g'), '\\s+', ' ', 'g')), 500) AS text FROM documents", "documents")
def redact_diagnostics(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", urls.redact(F.col("text")).alias("text"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g'), '_') AS key, CASE WHEN length(s_name) > 12 THEN left(s_name, 12) || '... ' || (length(s_name) - 12) || ' symbols cut' ELSE s_name END AS short FROM supplier", "supplier")
def property_keys(supplier: DataFrame) -> DataFrame:
    return supplier.select("s_suppkey", texts.property_key(F.col("s_name")).alias("key"), texts.truncate_with_note(F.col("s_name"), 12).alias("short"))


RAW = "upper(md5(CAST(c_custkey AS VARCHAR)))"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN lower(regexp_replace({RAW}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')) END AS id, c_custkey % 3 < 2 AS valid FROM customer", "customer")
def guid_normalise(customer: DataFrame) -> DataFrame:
    raw = F.upper(F.md5(F.col("c_custkey").cast("string")))
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, raw).when(k == 1, F.concat(F.lit("{"), F.regexp_replace(raw, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit("}"))).otherwise(F.substring(raw, 1, 31))
    return customer.select("c_custkey", identity.canonical_uuid(text).alias("id"), identity.is_uuid(text).alias("valid"))


@query(None, "customer")
def pseudonymous_id(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", identity.pseudonym(F.col("c_name"), "a salt of the deployment").alias("distinct_id"))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS version FROM events", "events")
def canonical_hash(events: DataFrame) -> DataFrame:
    return events.select("event_id", texts.version_id(F.col("props")).alias("version"))


@query("""SELECT conv_id, turn, '{"role":"' || role || '","turn":' || turn || '}' AS object FROM conversations""", "conversations")
def llm_json_extract(conversations: DataFrame) -> DataFrame:
    answer = F.concat(F.lit("<think>{no}</think>Sure: "), F.to_json(F.struct("turn", "role")), F.lit(" and so on"))
    return conversations.select("conv_id", "turn", texts.first_json_object(answer).alias("object"))


LEVEL_IN = "CASE l_linenumber WHEN 1 THEN 'fluent' WHEN 2 THEN ' b2 ' WHEN 3 THEN 'Upper intermediate level' WHEN 4 THEN 'business fluent' WHEN 5 THEN '' WHEN 6 THEN 'native speaker' ELSE 'whatever' END"


@query(f"SELECT DISTINCT l_linenumber, CASE l_linenumber WHEN 1 THEN 'C1' WHEN 2 THEN 'B2' WHEN 3 THEN 'B2' WHEN 4 THEN 'B2' WHEN 5 THEN 'B1' WHEN 6 THEN 'C2' ELSE 'B1' END AS level, CASE l_linenumber % 3 WHEN 0 THEN 'German' WHEN 1 THEN 'EN' ELSE 'French' END AS language FROM lineitem", "lineitem")
def cefr_normalise(lineitem: DataFrame) -> DataFrame:
    n = F.col("l_linenumber")
    said = F.when(n == 1, "fluent").when(n == 2, " b2 ").when(n == 3, "Upper intermediate level").when(n == 4, "business fluent").when(n == 5, "").when(n == 6, "native speaker").otherwise("whatever")
    name = F.when(n % 3 == 0, " gERMAN").when(n % 3 == 1, "en").otherwise("french")
    return lineitem.select("l_linenumber", scores.level(said).alias("level"), scores.language(name).alias("language")).distinct()


@query("""WITH r AS (SELECT o_orderkey AS job_id, o_custkey % 50 AS applicant, CASE o_orderkey % 3 WHEN 0 THEN 'German' ELSE 'English' END AS language, o_orderkey % 6 + 1 AS need FROM orders UNION ALL SELECT o_orderkey, o_custkey % 50, 'French', 1 FROM orders WHERE o_orderkey % 7 = 0),
    s AS (SELECT c_custkey % 50 AS applicant, CASE c_custkey % 3 WHEN 0 THEN 'German' WHEN 1 THEN 'English' ELSE 'French' END AS language, max(c_custkey % 6 + 1) AS have FROM customer GROUP BY ALL)
    SELECT job_id, applicant, count(*) FILTER (WHERE NOT coalesce(have >= need, false)) AS missing, count(*) FILTER (WHERE coalesce(have >= need, false)) AS met, count(*) FILTER (WHERE NOT coalesce(have >= need, false)) > 0 AS disqualified FROM r LEFT JOIN s USING (applicant, language) GROUP BY ALL""", "orders", "customer")
def language_gate(orders: DataFrame, customer: DataFrame) -> DataFrame:
    levels = F.array(*map(F.lit, scores.LEVELS))
    job, who = F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 50).alias("applicant")
    need = orders.select(job, who, F.when(F.col("o_orderkey") % 3 == 0, "german").otherwise("ENGLISH").alias("language"), F.element_at(levels, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("level"))
    need = need.unionByName(orders.where("o_orderkey % 7 = 0").select(job, who, F.lit("french").alias("language"), F.lit("A1").alias("level")))
    c = F.col("c_custkey")
    have = customer.select((c % 50).alias("applicant"), F.when(c % 3 == 0, "German").when(c % 3 == 1, "English").otherwise("French").alias("language"), F.element_at(levels, (c % 6 + 1).cast("int")).alias("level"))
    return scores.language_gate(need, have, "job_id", "applicant")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0.5 ELSE round((p_partkey % 11) * 0.60 + (p_partkey % 5) * 2 * 0.25 + (p_partkey % 4) * 2 * 0.15, 1) END AS score, CASE WHEN p_size / 4 BETWEEN 0 AND 10 THEN round_even(CAST(p_size AS DOUBLE) / 4, 1) END AS valid FROM part", "part")
def final_score(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select("p_partkey", scores.final_score(k % 11, k % 5 * 2, k % 4 * 2, k % 11 == 0).alias("score"), scores.valid_score(F.col("p_size") / 4).alias("valid"))


@query("SELECT p_partkey, round_even(least(greatest(coalesce(TRY_CAST(v AS DOUBLE), 0), 0), 10), 1) AS score FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN '-3' WHEN 2 THEN CAST(p_size AS VARCHAR) || '.26' END AS v FROM part)", "part")
def score_clamp(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey") % 4
    return part.select("p_partkey", scores.clamp_score(F.when(k == 0, "x").when(k == 1, "-3").when(k == 2, F.concat(F.col("p_size").cast("string"), F.lit(".26")))).alias("score"))


@query("SELECT p_partkey, least(a, b) * f AS min, greatest(a, b) * f AS max FROM (SELECT p_partkey, p_retailprice AS a, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS b, CASE p_partkey % 4 WHEN 0 THEN 2080 WHEN 1 THEN 12 WHEN 2 THEN 1 END AS f FROM part) WHERE f IS NOT NULL", "part")
def pay_annual(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    interval = F.when(k % 4 == 0, "1 HOUR").when(k % 4 == 1, "1 MONTH").when(k % 4 == 3, "9 MOONS")
    pay = scores.annual_pay(F.col("p_retailprice"), F.when(k % 3 > 0, F.col("p_size")), interval, F.lit("eur"))
    return part.select("p_partkey", pay["min"].alias("min"), pay["max"].alias("max")).where("min is not null")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL '2' HOUR END AS strict, date_trunc('second', ts) AS lenient, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events", "events")
def datetime_parse(events: DataFrame) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    return events.select("event_id", scores.strict_utc(F.concat(text, zone)).alias("strict"), scores.lenient_time(F.concat(text, F.lit("Z"))).alias("lenient"), scores.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("seconds"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN DATE '2024-03-10' WHEN 1 THEN DATE '2024-03-09' WHEN 2 THEN DATE '2024-03-10' - CAST(p_size AS INT) END::VARCHAR AS posted, TRY_CAST(printf('2024-%02d-%02d', CAST(p_size % 13 AS INT), CAST(p_partkey % 32 AS INT)) AS DATE)::VARCHAR AS local FROM part", "part")
def dates_relative(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    label = F.when(k % 4 == 0, "Posted Today").when(k % 4 == 1, "posted yesterday").when(k % 4 == 2, F.concat(F.lit("Posted "), F.col("p_size").cast("string"), F.lit(" Days Ago"))).otherwise("Posted 30+ Days Ago")
    text = F.concat_ws(".", (k % 32).cast("string"), (F.col("p_size") % 13).cast("string"), F.lit("24"))
    return part.select("p_partkey", scores.posted_on(label, F.lit("2024-03-10").cast("date")).cast("string").alias("posted"), scores.local_date(text).cast("string").alias("local"))


@query("""SELECT event_id, CASE WHEN epoch(n) - epoch(ts) < 60 THEN 'just now' WHEN ts::DATE = n::DATE THEN 'today at ' || strftime(ts, '%H:%M') WHEN year(ts) = year(n) THEN 'on ' || strftime(ts, '%d %b') || ' at ' || strftime(ts, '%H:%M') ELSE 'on ' || strftime(ts, '%d %b %Y') END AS label
    FROM (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-10 23:00:00' ELSE TIMESTAMP '2025-02-01' END AS n FROM events) WHERE ts < n""", "events")
def relative_time(events: DataFrame) -> DataFrame:
    rows = events.withColumn("n", F.when(F.col("event_id") % 2 == 0, F.lit("2024-01-10 23:00:00")).otherwise(F.lit("2025-02-01 00:00:00")).cast("timestamp_ntz")).where("ts < n")
    return rows.select("event_id", reports.relative_label(F.col("ts"), F.col("n")).alias("label"))


# The dictionary stands on the nation table: every nation is a country of two letters, its cities are customers' market segments.
COUNTRIES = "SELECT 'C' || chr(CAST(65 + n_nationkey AS INT)) AS code, n_name AS name FROM nation"
CITIES = "SELECT DISTINCT 'C' || chr(CAST(65 + c_nationkey AS INT)) AS country_code, c_mktsegment AS city FROM customer WHERE c_custkey % 3 = 0"
FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _dictionary(nation: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    code = lambda k: F.concat(F.lit("C"), F.char(65 + F.col(k)))
    countries = nation.select(code("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    cities = customer.where("c_custkey % 3 = 0").select(code("c_nationkey").alias("country_code"), F.col("c_mktsegment").alias("city")).distinct().withColumn("rank", F.lit(1))
    return countries, cities


@query(f"""WITH co AS ({COUNTRIES}), ci AS ({CITIES}), r AS (SELECT job_id, CASE job_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ZZ' ELSE country_code END AS country_code, CASE job_id % 5 WHEN 0 THEN 'NATION_0' ELSE lower(country_name) END AS country_name, CASE job_id % 7 WHEN 0 THEN 'Nowhere' ELSE coalesce(lower(city_name), '') END AS city_name FROM fx_locations),
    k AS (SELECT r.*, a.code AS by_code, b.code AS by_name, coalesce(a.code, b.code) AS country FROM r LEFT JOIN co a ON a.code = r.country_code LEFT JOIN co b ON lower(b.name) = lower(r.country_name)),
    m AS (SELECT k.*, ci.city FROM k LEFT JOIN ci ON ci.country_code = k.country AND lower(ci.city) = k.city_name AND k.city_name <> '')
    SELECT job_id, country_code, country_name, city_name, CASE WHEN by_code <> by_name THEN NULL ELSE country END AS geo_country, CASE WHEN by_code <> by_name THEN NULL ELSE city END AS geo_city,
      CASE WHEN country IS NULL THEN 'country_unresolved' WHEN by_code <> by_name THEN 'country_name_code_conflict' WHEN (country_code <> '' AND by_code IS NULL) OR (city_name <> '' AND city IS NULL) THEN 'normalized_with_unresolved' ELSE 'normalized' END AS geo_status FROM m""", "fx_locations", "nation", "customer")
def geo_city_resolve(locations: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    k = F.col("job_id")
    rows = locations.select("job_id", F.when(k % 4 == 0, "").when(k % 4 == 1, "ZZ").otherwise(F.col("country_code")).alias("country_code"), F.when(k % 5 == 0, "NATION_0").otherwise(F.lower("country_name")).alias("country_name"), F.when(k % 7 == 0, "Nowhere").otherwise(F.coalesce(F.lower("city_name"), F.lit(""))).alias("city_name"))
    return places.canonical(rows, *_dictionary(nation, customer)).drop("issues")


@query(f"""WITH co AS ({COUNTRIES}), t AS (SELECT c_custkey, ' ' || {FOLD.format("'Remote within Nation-' || c_nationkey || ', or NATION_' || (c_custkey % 25) || ' (' || c_name || ')'")} || ' ' AS text FROM customer)
    SELECT c_custkey, code AS country_code FROM t JOIN co ON contains(t.text, ' ' || {FOLD.format('co.name')} || ' ')""", "customer", "nation")
def geo_country_mentions(customer: DataFrame, nation: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Remote within Nation-"), F.col("c_nationkey").cast("string"), F.lit(", or NATION_"), (F.col("c_custkey") % 25).cast("string"), F.lit(" ("), F.col("c_name"), F.lit(")"))
    return places.country_mentions(customer.select("c_custkey", text.alias("text")), "c_custkey", "text", _dictionary(nation, customer)[0]).drop("term")


@query("""WITH a AS (SELECT o_orderkey AS job_id, list_distinct(list_filter([CASE WHEN o_orderkey % 3 > 0 THEN 'C' || o_orderkey % 4 END], lambda x: x IS NOT NULL)) AS p, list_filter([CASE WHEN o_orderkey % 5 > 1 THEN 'C' || o_orderkey % 6 END], lambda x: x IS NOT NULL) AS s FROM orders),
    c AS (SELECT *, CASE WHEN len(p) > 0 AND len(s) = 0 THEN 'consistent' WHEN len(p) = 0 AND len(s) > 0 THEN 'refined' WHEN len(p) > 0 THEN CASE WHEN len(list_intersect(p, s)) > 0 THEN 'refined' ELSE 'conflicting' END ELSE 'insufficient' END AS agreement FROM a)
    SELECT job_id, agreement, CASE WHEN job_id % 8 = 0 OR job_id % 7 = 0 OR job_id % 11 = 0 OR (job_id % 2 = 0 AND p[1] IN ('C2', 'C3')) THEN 'ineligible' WHEN job_id % 13 = 0 OR agreement = 'conflicting' THEN 'unclear' WHEN p[1] IN ('C1', 'C0') THEN 'eligible' ELSE 'unclear' END AS status,
      CASE WHEN job_id % 8 = 0 THEN 'restriction' WHEN job_id % 7 = 0 THEN 'mandatory_incompatible_office_presence' WHEN job_id % 11 = 0 THEN 'declared_incompatible_location' WHEN job_id % 2 = 0 AND p[1] IN ('C2', 'C3') THEN 'explicit_incompatible_work_location' WHEN job_id % 13 = 0 THEN 'mandatory_presence_location_unresolved'
      WHEN agreement = 'conflicting' THEN 'conflicting_without_decisive_restriction' WHEN p[1] IN ('C1', 'C0') THEN 'compatible_location_evidence' ELSE 'insufficient_explicit_location_evidence' END AS reason FROM c""", "orders")
def geo_eligibility(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    one = lambda test, n: F.array_compact(F.array(F.when(test, F.concat(F.lit("C"), (k % n).cast("string")))))
    rows = orders.select(k.alias("job_id"), one(k % 3 > 0, 4).alias("p"), one(k % 5 > 1, 6).alias("s"), k)
    rows = rows.withColumn("agreement", places.consistency(F.col("p"), F.col("s")))
    item = lambda test, kind, disposition, code: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(disposition).cast("string").alias("disposition"), F.array(F.lit(code)).alias("codes")))
    evidence = F.array_compact(F.array(item(k % 13 == 0, "mandatory_presence_unresolved", None, "C9"), item(k % 11 == 0, "declared_location", None, "C3"), item(k % 7 == 0, "mandatory_presence", None, "C2"), item(k % 8 == 0, "restriction", "incompatible", "C1")))
    two = lambda *codes: F.array(*map(F.lit, codes))
    verdict = places.eligibility(F.col("p"), evidence, F.col("agreement"), F.when(k % 2 == 0, "Hybrid").otherwise("Remote"), two("C2", "C3"), two("C0"), "C1")
    return rows.select("job_id", "agreement", verdict.alias("v")).select("job_id", "agreement", "v.*")


@query("""WITH ci AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
    SELECT c_custkey, 0 AS nth, 'C' || chr(CAST(65 + c.c_nationkey AS INT)) AS country_code, ci.c_mktsegment AS city_name FROM customer c LEFT JOIN ci ON ci.c_nationkey = c.c_nationkey AND ci.c_mktsegment = c.c_mktsegment UNION ALL SELECT c_custkey, 1, 'CD', NULL FROM customer""", "customer", "nation")
def geo_raw_parse(customer: DataFrame, nation: DataFrame) -> DataFrame:
    raw = F.concat(F.initcap("c_mktsegment"), F.lit(", NATION_"), F.col("c_nationkey").cast("string"), F.lit(" (Remote) or Nation 3; Hybrid - Elsewhere"))
    return places.parse_location(customer.select("c_custkey", raw.alias("raw")), "c_custkey", "raw", *_dictionary(nation, customer))


@query(f"SELECT name, code AS country_code FROM ({COUNTRIES})", "nation")
def country_lookup(nation: DataFrame) -> DataFrame:
    code = F.concat(F.lit("C"), F.char(65 + F.col("n_nationkey")))
    countries = nation.select(code.alias("code"), F.col("n_name").alias("name"))
    keys = places.country_keys(countries)
    return countries.select("name", places.lookup_key(F.col("name")).alias("key")).join(keys.select("key", "country_code"), "key").drop("key")


@query("SELECT country_code, city, population, rank FROM (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY population DESC, city) AS rank FROM (SELECT 'C' || c_nationkey AS country_code, c_mktsegment AS city, max(CAST(floor(c_acctbal) AS BIGINT)) AS population FROM customer WHERE c_acctbal >= 500 GROUP BY ALL)) WHERE rank <= 3", "customer")
def geo_build_cities(customer: DataFrame) -> DataFrame:
    source = customer.select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("country_code"), F.col("c_mktsegment").alias("name"), F.floor("c_acctbal").alias("population"), F.lit("P").alias("feature_class"))
    return places.build_cities(source, 500, 3)
