"""Identity of job URLs: host rules of applicant-tracking systems and job boards."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host suffixes of two labels, generic labels and path segments, referral parameters and aliases,
# job boards, applicant-tracking systems that share one rule, and talent agencies.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "com.br", "co.nz", "com.sg", "com.tr", "com.mx", "co.jp", "co.kr", "com.cn", "com.hk", "com.tw", "com.pl")
GENERIC_LABELS = (
    "job", "jobs", "career", "careers", "karriere", "stellen", "stellenangebote", "arbeit", "emploi", "carriere", "carrieres",
    "praca", "kariera", "oferty", "ofertapracy", "ofertypracy", "oferta",
)
GENERIC_SEGMENTS = ("job", "jobs", "position", "positions", "career", "careers", "vacancy", "vacancies", "listing", "listings", "apply")
REFERRAL_KEYS = ("source", "src", "utm_source", "ref", "referrer")
SOURCE_ALIASES = {
    "li": "linkedin", "lnkd": "linkedin", "angellist": "wellfound", "angel": "wellfound", "angelco": "wellfound", "stackoverflowjobs": "stackoverflow",
    "stack-overflow": "stackoverflow", "wwr": "weworkremotely", "cvlibrary": "cv-library",
}
BOARDS = {
    "linkedin": ("linkedin.com",),
    "indeed": ("indeed.com", "indeed.co.uk", "indeed.de", "indeed.fr", "indeed.nl", "indeed.es", "indeed.it", "indeed.ie", "indeed.ca"),
    "stepstone": ("stepstone.de", "stepstone.fr", "stepstone.nl", "stepstone.co.uk", "stepstone.com"),
    "xing": ("xing.com",),
    "glassdoor": ("glassdoor.com", "glassdoor.de", "glassdoor.co.uk", "glassdoor.fr"),
    "monster": ("monster.com", "monster.de", "monster.co.uk", "monster.fr", "monster.it"),
    "weworkremotely": ("weworkremotely.com",),
    "dynamitejobs": ("dynamitejobs.com",),
    "remotive": ("remotive.com",),
    "ziprecruiter": ("ziprecruiter.com",),
    "reed": ("reed.co.uk",),
    "totaljobs": ("totaljobs.com", "totaljobs.com.au", "cwjobs.co.uk"),
    "cv-library": ("cv-library.co.uk",),
    "nofluffjobs": ("nofluffjobs.com",),
    "pracuj": ("pracuj.pl",),
    "wellfound": ("wellfound.com", "angel.co"),
}
SUFFIX_SYSTEMS = {
    "teamtailor": ("teamtailor.com",), "workable": ("workable.com", "applytojob.com"), "jazzhr": ("jazz.co",), "recruitee": ("recruitee.com",), "bamboohr": ("bamboohr.com",),
    "icims": ("icims.com",), "jobvite": ("jobvite.com",), "breezyhr": ("breezy.hr",), "comeet": ("comeet.co",), "pinpoint": ("pinpoint.jobs",),
}
OWN_RULES = {
    "ashbyhq.com": "ashby", "greenhouse.io": "greenhouse", "lever.co": "lever", "jobs.hr.cloud.sap": "successfactors", "jobs.hr.sapcloud.cn": "successfactors", "myworkdayjobs.com": "workday",
    "jobs.personio.de": "personio", "jobs.personio.com": "personio", "smartrecruiters.com": "smartrecruiters", "join.com": "join",
}
AGENCIES = (
    "adecco.com", "randstad.com", "manpowergroup.com", "hays.com", "tietalent.com", "aerotek.com", "pagepersonnel.com", "michaelpage.com",
    "robertwalters.com", "kornferry.com", "reedglobal.com", "alfredtalke.com",
)


def normalise_url(url: Column) -> Column:
    """Question marks after the first become ampersands, the fragment goes, repeated ampersands are one."""
    text = F.trim(F.coalesce(url, F.lit("")))
    at = F.locate("?", text)
    query = F.translate(F.substr(text, at + 1), "?", "&")
    one = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at), query)).otherwise(text)
    return F.regexp_replace(F.split_part(one, F.lit("#"), F.lit(1)), "&{2,}", "&")


def host(url: Column) -> Column:
    """Lower-case host without dots around it and without ``www.``; empty where there is none."""
    name = F.trim(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), F.lit("."))
    return F.regexp_replace(name, r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def path_parts(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def parameter(url: Column, name: str) -> Column:
    """A query parameter, null where it is missing or blank."""
    return F.nullif(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name))), F.lit(""))


def matches_host(name: Column, domains: tuple[str, ...] | list[str]) -> Column:
    return reduce(or_, [(name == d) | name.endswith("." + d) for d in domains])


def last_part(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.element_at(parts, F.when(F.size(parts) > 0, -1).otherwise(1)))


def first_part(parts: Column, n: int = 1) -> Column:
    return F.get(parts, F.lit(n - 1))


def path_hash(url: Column) -> Column:
    """The id of URLs that carry none: sixteen digits of SHA-1 of scheme, host and path."""
    scheme = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("")))
    return F.substring(F.sha1(F.concat(scheme, F.lit("://"), host(url), path(url))), 1, 16)


def _suffix_labels(name: Column) -> Column:
    parts = F.split(name, r"\.")
    two = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))
    return F.when((F.size(parts) >= 3) & two.isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)


def company_of_host(name: Column) -> Column:
    """The last label before the suffix that isn't generic; the very last one if all are."""
    parts = F.split(name, r"\.")
    before = F.slice(parts, 1, F.greatest(F.size(parts) - _suffix_labels(name), F.lit(1)))
    telling = F.filter(before, lambda x: (x != "") & ~x.isin(*GENERIC_LABELS))
    return F.coalesce(last_part(telling), last_part(before))


def provider_of_host(name: Column) -> Column:
    """The first label before the suffix, the second one if the first is generic."""
    parts = F.split(name, r"\.")
    before = F.slice(parts, 1, F.greatest(F.size(parts) - _suffix_labels(name), F.lit(1)))
    first, second = first_part(before), first_part(before, 2)
    return F.when(name == "", "corporate-site").when(first.isin(*GENERIC_LABELS) & second.isNotNull(), second).otherwise(first)


def source_name(value: Column) -> Column:
    text = F.lower(F.trim(value))
    text = F.when(text.rlike("^https?://"), F.coalesce(F.try_parse_url(text, F.lit("HOST")), text)).otherwise(text)
    label = F.split_part(F.regexp_replace(F.trim(text, F.lit(".")), r"^www\.", ""), F.lit("."), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in SOURCE_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(table, label), label)


def referral(url: Column) -> Column:
    """Where a visitor came from, by the first referral parameter that says so."""
    return F.coalesce(*[F.nullif(source_name(parameter(url, k)), F.lit("")) for k in REFERRAL_KEYS])


def _by_domain(name: Column, values: dict[str, str]) -> Column:
    """What a host's domain stands for: its last two, three or four labels are looked up, longer ones first."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(*[F.try_element_at(table, F.substring_index(name, ".", -n)) for n in (4, 3, 2)])


def agency(name: Column) -> Column:
    return _by_domain(name, {d: d.split(".")[0] for d in AGENCIES})


def is_generic(segment: Column) -> Column:
    return F.lower(segment).isin(*dict.fromkeys(GENERIC_SEGMENTS + GENERIC_LABELS))


def system_of_host(name: Column) -> Column:
    """The applicant-tracking system or job board that a host belongs to, null for any other host."""
    shared = {**SUFFIX_SYSTEMS, **BOARDS}
    return _by_domain(name, {**OWN_RULES, **{d: system for system, domains in shared.items() for d in domains}})


def with_identity(rows: DataFrame, url: str = "url", into: str = "identity") -> DataFrame:
    """``rows`` with a struct of provider, tenant, external_id, found_on, hiring and posting company; null without a host.

    Host, path and parameters are columns of their own first, so that no rule takes a URL apart again.
    """
    u, c = F.col(url), lambda name: F.col(f"__url_{name}")
    stages: list[dict[str, Column]] = [
        {"host": host(u), "parts": path_parts(u), "spare": path_hash(u), "referral": referral(u), "for": parameter(u, "for"), "token": parameter(u, "token"), "key": F.coalesce(parameter(u, "jk"), parameter(u, "vjk"))},
        {"label": F.split_part(c("host"), F.lit("."), F.lit(1)), "low": F.transform(c("parts"), F.lower), "n": F.size(c("parts")), "last": last_part(c("parts")), "system": system_of_host(c("host")), "agency": agency(c("host"))},
    ]
    number = F.nullif(F.regexp_extract(c("last"), r"^([0-9]+)-[a-z]{2}_[A-Z]{2}$", 1), F.lit(""))
    shaped = (c("n") >= 3) & (F.get(c("low"), c("n") - 3) == "job") & number.isNotNull() & ~c("host").isin("jobs.hr.cloud.sap", "jobs.hr.sapcloud.cn")
    told = F.when(~is_generic(c("last")), c("last"))

    def after(token: str) -> Column:
        at = F.array_position(c("low"), token)
        return F.when(at > 0, F.get(c("parts"), at.cast("int")))

    first, second = first_part(c("parts")), first_part(c("parts"), 2)
    stages.append({"after_job": after("job"), "after_jobs": after("jobs"), "number": number, "told": told, "system": F.when((c("system") != "successfactors") | F.coalesce(shaped, F.lit(False)), c("system")), "first": first, "second": second})

    system, label, last = c("system"), c("label"), c("last")
    on_jobs = (label == "jobs") & (c("n") >= 2)
    whole = c("host") == "lever.co"
    tenant = (
        F.when(system == "ashby", F.when(on_jobs, c("first")).when(label != "ashbyhq", label))
        .when(system == "greenhouse", F.coalesce(c("for"), after("boards"), F.when(~F.lower(c("first")).isin("jobs", "job", "embed"), c("first"))))
        .when(system == "lever", F.when(whole, None).when(label == "jobs", c("first")).otherwise(label))
        .when(system == "successfactors", c("host"))
        .when(system.isin("workday", "personio"), label)
        .when(system == "smartrecruiters", F.coalesce(after("smartrecruiters"), after("company")))
        .when(system == "join", after("companies"))
        .when((system == "icims") | matches_host(c("host"), ["applytojob.com"]), None)
        .when(system.isin(*SUFFIX_SYSTEMS), label)
    )
    job = (
        F.when(system == "ashby", F.when(on_jobs, c("second")).otherwise(last))
        .when(system == "greenhouse", F.coalesce(c("token"), c("after_jobs"), last))
        .when(system == "lever", F.when(~whole & (label == "jobs"), c("second")).otherwise(last))
        .when(system == "successfactors", c("number"))
        .when(system.isin("workday", "personio"), last)
        .when(system == "smartrecruiters", F.coalesce(c("after_job"), last))
        .when(system == "join", F.coalesce(F.nullif(F.regexp_extract(last, r"^(\d+)(?:-|$)", 1), F.lit("")), last))
        .when(system.isin(*SUFFIX_SYSTEMS), F.coalesce(c("after_jobs"), last))
        .when(system == "linkedin", F.regexp_extract(F.coalesce(after("view"), last), "^[0-9]{6,}$", 0))
        .when(system == "indeed", F.coalesce(c("key"), last))
        .when(system.isin(*BOARDS), c("told"))
        .otherwise(F.coalesce(c("after_job"), c("told")))
    )
    stages.append({"tenant": F.coalesce(tenant, F.lit("")), "job": F.coalesce(F.nullif(job, F.lit("")), c("spare")), "board": F.coalesce(system.isin(*BOARDS), F.lit(False))})
    company = (
        F.when(c("board"), None)
        .when(system == "successfactors", label)
        .when(system.isNotNull(), F.nullif(c("tenant"), F.lit("")))
        .when(c("agency").isNull(), company_of_host(c("host")))
    )
    found = F.coalesce(c("referral"), F.when(c("board"), system), F.lit("corporate-site"))
    provider = F.coalesce(system, provider_of_host(c("host")))
    item = F.struct(provider.alias("provider"), c("tenant").alias("tenant"), c("job").alias("external_id"), found.alias("found_on"), company.alias("hiring_company"), c("agency").alias("posting_company"))
    out = rows
    for stage in stages:
        out = out.withColumns({f"__url_{name}": value for name, value in stage.items()})
    out = out.withColumn(into, F.when(c("host") != "", item))
    return out.drop(*{f"__url_{name}" for stage in stages for name in stage})


def proxy_identity(url: Column) -> Column:
    """Struct of provider, tenant, external_id, confidence and warning, by the rules of the proxy for five systems."""
    name, parts = F.lower(F.coalesce(F.try_parse_url(F.trim(url), F.lit("HOST")), F.lit(""))), path_parts(F.trim(url))
    n, last = F.size(parts), last_part(parts)
    number = F.nullif(F.regexp_extract(last, r"_([A-Za-z]+[-_]?\d+[A-Za-z0-9_-]*)$", 1), F.lit(""))
    token, tenant = parameter(F.trim(url), "token"), parameter(F.trim(url), "for")

    def found(provider: str, owner: Column, job: Column, confidence: Column | str, warning: Column | None = None) -> Column:
        sure = F.lit(confidence) if isinstance(confidence, str) else confidence
        note = F.lit(None).cast("string") if warning is None else warning
        return F.struct(F.lit(provider).alias("provider"), owner.alias("tenant"), job.alias("external_id"), sure.alias("confidence"), note.alias("warning"))

    def missing(warning: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(none.alias("provider"), none.alias("tenant"), none.alias("external_id"), F.lit("none").alias("confidence"), F.lit(warning).alias("warning"))

    def two(provider: str, job: Column, confidence: str, warning: Column | None = None) -> Column:
        return F.when(n >= 2, found(provider, first_part(parts), job, confidence, warning)).otherwise(missing(f"{provider}_identity_not_found"))

    greenhouse = (
        F.when((n >= 3) & (first_part(parts, 2) == "jobs"), found("greenhouse", first_part(parts), first_part(parts, 3), "high"))
        .when(tenant.isNotNull() & token.isNotNull(), found("greenhouse", tenant, token, "high"))
        .otherwise(missing("greenhouse_identity_not_found"))
    )
    sure = F.when(number.isNotNull(), "high").otherwise("medium")
    guessed = F.when(number.isNull(), "workday_external_id_inferred_from_last_path_segment")
    workday = F.when(n > 0, found("workday", F.split_part(name, F.lit("."), F.lit(1)), F.coalesce(number, last), sure, guessed)).otherwise(missing("workday_identity_not_found"))
    smart = F.split_part(first_part(parts, 2), F.lit("-"), F.lit(1))
    return (
        F.when(name.isin("boards.greenhouse.io", "job-boards.greenhouse.io"), greenhouse)
        .when(matches_host(name, ["jobs.lever.co", "jobs.eu.lever.co"]), two("lever", first_part(parts, 2), "high"))
        .when(name == "jobs.ashbyhq.com", two("ashby", first_part(parts, 2), "high"))
        .when(name.endswith(".myworkdayjobs.com"), workday)
        .when(name.isin("jobs.smartrecruiters.com", "www.smartrecruiters.com"), two("smartrecruiters", smart, "medium", F.lit("smartrecruiters_external_id_inferred_from_slug_prefix")))
        .otherwise(missing("unsupported_provider_url"))
    )


def is_public(url: Column) -> Column:
    """Whether a URL is HTTP on a host that isn't local, internal or a private address."""
    raw = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    name = F.regexp_replace(raw, r"^\[|\]$", "")
    local = name.isin("localhost", "::1", "::", "0.0.0.0") | name.rlike(r"\.(local|internal|localhost)$")
    private = name.rlike(r"^(10|127)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:")
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit(""))).isin("http", "https") & (name != "") & ~local & ~private


def redact(text: Column, most: int = 500) -> Column:
    """A diagnostic without queries of URLs, secrets and control characters, of bounded length."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b(https?://[^\s?#]+)[?#][^\s]*", "$1")
    masked = F.regexp_replace(bare, r"(?i)\b(authorization|x-functions-key|api[-_ ]?key|token|code)(\s*[:=]\s*)[^\s,;]+", "$1$2[redacted]")
    plain = F.regexp_replace(F.regexp_replace(masked, r"[\x00-\x1f\x7f]+", " "), r"\s+", " ")
    return F.left(F.trim(plain), F.lit(most))
