"""Candidate filters and gates of discovery runs, and matching of candidates with users' profiles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that mark a location as a restriction of remote work.
RESTRICTION_MARKERS = ("only", "based", "residents", "resident", "located", "within", "must be", "work authorization")


def keyword_pattern(keyword: str) -> str | None:
    """A keyword as whole words in a row, whatever stands between them; None for one without letters or digits."""
    tokens = re.findall(r"[^\W_]+", keyword.strip().lower())
    if not tokens:
        return None
    return r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(map(re.escape, tokens)) + r"(?![\p{L}\p{N}])"


def has_keyword(text: Column, keyword: str) -> Column:
    pattern = keyword_pattern(keyword)
    return F.lit(False) if pattern is None else F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def matched(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords that ``text`` holds, in their order."""
    found = [F.when(has_keyword(text, k), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Whether ``text`` holds any of the keywords: one pattern for all."""
    patterns = [p for p in map(keyword_pattern, keywords) if p]
    return F.coalesce(F.lower(text).rlike("|".join(patterns)), F.lit(False)) if patterns else F.lit(False)


def title_allowed(title: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    wanted = any_keyword(title, positive) if positive else F.lit(True)
    return wanted & ~any_keyword(title, negative)


def location_allowed(location: Column, always: Sequence[str] = (), block: Sequence[str] = (), allow: Sequence[str] = ()) -> Column:
    """Blank passes; then always-allowed, blocked, and allowed places decide in this order."""
    blank = F.trim(F.coalesce(location, F.lit(""))) == ""
    rest = any_keyword(location, allow) if allow else F.lit(True)
    return F.when(blank | any_keyword(location, always), True).when(any_keyword(location, block), False).otherwise(rest)


def age_allowed(posted_at: Column, now: Column, most_days: int) -> Column:
    """Undated rows pass; a limit that isn't a positive whole number limits nothing."""
    if not isinstance(most_days, int) or most_days <= 0:
        return F.lit(True)
    return posted_at.isNull() | (posted_at >= now - F.expr(f"INTERVAL '{most_days}' DAY"))


def salary_allowed(low: Column, high: Column, currency: Column, least: float = 0, most: float = 0, wanted: str = "") -> Column:
    """Whether a pay range meets the wished one. Missing pay passes; currencies count only where both are known."""
    if least < 0 or most < 0 or (most > 0 and least > most):
        raise ValueError("the wished range must not be negative or reversed")
    if least == 0 and most == 0:
        return F.lit(True)
    bottom, top = F.coalesce(low, high), F.coalesce(high, low)
    known = F.upper(F.trim(F.coalesce(currency, F.lit(""))))
    other = F.lit(bool(wanted)) & (known != "") & (known != F.lit(wanted.strip().upper()))
    short = (top < least) if least > 0 else F.lit(False)
    beyond = (bottom > most) if most > 0 else F.lit(False)
    return F.when(bottom.isNull(), True).otherwise(~(other | short | beyond))


def content_allowed(text: Column, positive: Sequence[str], negative: Sequence[str], matched_titles: Column | None = None, overrides: Mapping[str, tuple[Sequence[str], Sequence[str]]] | None = None) -> Column:
    """Whether a description holds no unwanted and some wanted substring. Rules of matched title words replace these."""

    def passes(wanted: Sequence[str], unwanted: Sequence[str]) -> Column:
        low = F.lower(text)
        none = reduce(or_, [low.contains(k.lower()) for k in unwanted], F.lit(False))
        some = reduce(or_, [low.contains(k.lower()) for k in wanted]) if wanted else F.lit(True)
        return some & ~none

    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    verdict = passes(positive, negative)
    if overrides and matched_titles is not None:
        hits = {k: F.array_contains(F.transform(matched_titles, F.lower), k.strip().lower()) for k in overrides}
        applies = reduce(or_, hits.values())
        verdict = F.when(applies, reduce(or_, [hit & passes(*overrides[k]) for k, hit in hits.items()])).otherwise(verdict)
    return F.when(blank, True).otherwise(verdict)


def scope_pattern(term: str) -> str:
    return r"(?iu)(?:^|[^\p{L}\p{N}])" + r"\s+".join(re.escape(w) for w in term.strip().split()) + r"(?=$|[^\p{L}\p{N}])"


def location_scope(location: Column, allow: Sequence[str], block: Sequence[str], markers: Sequence[str] = RESTRICTION_MARKERS) -> Column:
    """Struct of allowed, reason and the matched terms: a blocked place counts only where remote work is restricted to it."""
    raw = F.trim(F.coalesce(location, F.lit("")))
    find = lambda terms: F.array_compact(F.array(*[F.when(raw.rlike(scope_pattern(t)), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")
    allowed, blocked = find(allow), find(block)
    marked = reduce(or_, [F.lower(raw).contains(m.lower()) for m in markers], F.lit(False))
    restricted = raw.rlike(r"(?i)\bremote\b\s*[(\[,:\-]") | marked
    reason = (
        F.when(raw == "", "missing_scope")
        .when(F.size(allowed) > 0, "compatible_scope_present")
        .when(F.size(blocked) == 0, "no_blocked_scope")
        .when(restricted, "explicit_blocked_remote_scope")
        .otherwise("blocked_scope_not_explicitly_restrictive")
    )
    return F.struct((reason != "explicit_blocked_remote_scope").alias("allowed"), reason.alias("reason"), allowed.alias("allowed_matches"), blocked.alias("blocked_matches"))


def remote_type(location: Column) -> Column:
    text = F.lower(F.coalesce(location, F.lit("")))
    return F.when(text.rlike(r"\bhybrid\b"), "Hybrid").when(text.rlike(r"\bremote\b|\bworldwide\b|\banywhere\b"), "Remote").when(text.rlike(r"\bon[- ]?site\b|\boffice[- ]?based\b"), "On-site").otherwise("Unknown")


def remote_key(value: Column) -> Column:
    """The matcher's own vocabulary of remote types."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    onsite = text.contains("on-site") | text.contains("onsite") | text.contains("on site") | text.contains("office")
    return F.when(text == "", "unknown").when(text.contains("hybrid"), "hybrid").when(text.contains("remote"), "remote").when(onsite, "onsite").otherwise(F.regexp_replace(text, "[^a-z0-9]+", "_"))


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/?#]+"), F.lit(False))


def gate(candidates: DataFrame, tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """``candidates`` with the first reason to reject each, null where none holds.

    ``tests`` are (reason, passes) in order. The URL of a candidate with title, company and valid URL counts as seen
    from its first row on, whatever later tests say of that row.
    """
    missing = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "missing_title").when(F.trim(F.coalesce("company", F.lit(""))) == "", "missing_company").when(~valid_url(F.col("url")), "missing_or_invalid_url")
    rows = candidates.withColumn("_missing", missing)
    whole = rows.where(F.col("_missing").isNull()).withColumn("_again", F.row_number().over(Window.partitionBy("url").orderBy("sequence")) > 1)
    reason = F.when(F.col("_again"), "duplicate_url_in_run")
    for name, passes in tests:
        reason = reason.when(~passes, name)
    judged = whole.withColumn("reject_reason", reason).drop("_missing", "_again")
    # Rows without a URL of their own may be many; they pass by the window.
    return judged.unionByName(rows.where(F.col("_missing").isNotNull()).withColumn("reject_reason", F.col("_missing")).drop("_missing"))


def capped(rows: DataFrame, order: str, most: int, into: str, value: str) -> DataFrame:
    """Rows beyond the first ``most`` that ``into`` leaves open get ``value`` there: classified, not dropped.

    The order is global, so the boundary row is found by a top-k, and no window over all rows is needed."""
    last = rows.where(F.col(into).isNull()).orderBy(order).limit(most).agg(F.max(order).alias("_last"), F.count("*").alias("_n"))
    beyond = F.col(into).isNull() & (F.col("_n") == most) & (F.col(order) > F.col("_last"))
    none = F.col(into).isNull() & F.lit(most <= 0)
    return rows.join(F.broadcast(last)).withColumn(into, F.when(beyond | none, value).otherwise(F.col(into))).drop("_last", "_n")  # one row


def location_text(raw: Column, remote: Column, locations: Column | None = None) -> Column:
    """All that a candidate says of its place, for matching: raw text, remote type, and each structured place's fields."""
    parts = F.array(raw, remote)
    if locations is not None:
        fields = ("raw", "city", "region", "country", "country_code")
        parts = F.concat(parts, F.coalesce(F.flatten(F.transform(locations, lambda x: F.array(*[x[f] for f in fields]))), F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), " | ")


def match_profiles(candidates: DataFrame, users: Sequence[dict]) -> DataFrame:
    """sequence, user_id and profile of each candidate's first matching profile a user.

    ``candidates``: sequence, title, company, raw_location, remote_type and, optionally, locations. A user is user_id,
    profiles and has_saved_filters. A profile is profile, and optionally positive, negative, always_allow, allow, block,
    company_allow, company_block and remote_types. A user without saved filters matches everything (with a null profile),
    one whose filters gave no profile nothing. Users are a bounded setting (a hundred); each becomes an expression, so
    that candidates are read once and don't move.
    """
    places = F.col("locations") if "locations" in candidates.columns else None
    rows = candidates.withColumns({"_remote": remote_key(F.col("remote_type")), "_place": location_text(F.col("raw_location"), F.col("remote_type"), places)})
    items = []
    for u in sorted(users, key=lambda u: u["user_id"]):
        tests = []
        for p in u["profiles"]:
            test = title_allowed(F.col("title"), p.get("positive", ()), p.get("negative", ())) & location_allowed(F.col("_place"), p.get("always_allow", ()), p.get("block", ()), p.get("allow", ()))
            if p.get("company_allow") or p.get("company_block"):
                test = test & title_allowed(F.coalesce("company", F.lit("")), p.get("company_allow", ()), p.get("company_block", ()))
            if p.get("remote_types"):
                test = test & F.col("_remote").isin(*p["remote_types"])
            tests.append(F.when(test, F.struct(F.lit(p["profile"]).alias("profile"))))
        if not tests and not u.get("has_saved_filters", False):
            tests.append(F.struct(F.lit(None).cast("string").alias("profile")))
        if tests:
            found = F.coalesce(*tests)
            items.append(F.when(found.isNotNull(), F.struct(F.lit(u["user_id"]).alias("user_id"), found["profile"].alias("profile"))))
    if not items:
        return rows.select("sequence", F.lit(None).cast("int").alias("user_id"), F.lit(None).cast("string").alias("profile")).limit(0)
    return rows.select("sequence", F.explode(F.array_compact(F.array(*items))).alias("m")).select("sequence", "m.*")


def users_error(users: DataFrame, most: int = 100) -> DataFrame:
    """user_id and the first thing wrong with each user of a payload, null for a valid one.

    Reads user_id, cv_version_id, cv_last_updated, has_saved_filters, invalid_profile_count and profiles: an array of
    profile_id and ``lists``, a map from a list's name to its terms. More than ``most`` users are an error as a whole.
    """
    if users.limit(most + 1).count() > most:
        raise ValueError(f"a payload holds {most} users at most")
    control = r"[\x00-\x1f\x7f]"
    key = F.lower("user_id")
    again = F.count("*").over(Window.partitionBy(key)) > 1

    def bounded(value: Column) -> Column:
        return (F.trim(value) != "") & (F.length(value) <= 128) & ~value.rlike(control)

    def long_list(name: Column, terms: Column) -> Column:
        few = F.when(name == "remote_types", 10).otherwise(50)
        length = F.when(name == "remote_types", 40).otherwise(120)
        return (F.size(terms) > few) | F.exists(terms, lambda t: t.isNull() | (F.trim(t) == "") | (F.length(t) > length))

    def bad(p: Column) -> Column:
        lists = F.map_entries(F.coalesce(p["lists"], F.create_map().cast("map<string,array<string>>")))
        empty = ~F.exists(lists, lambda e: F.size(e["value"]) > 0)
        return empty | F.exists(lists, lambda e: F.coalesce(long_list(e["key"], e["value"]), F.lit(False))) | (p["profile_id"].isNotNull() & ~bounded(p["profile_id"]))

    no = F.lit(False)
    rules = {
        "invalid_user_id": ~F.coalesce(key.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), no),
        "invalid_cv_version_id": ~F.coalesce(bounded(F.col("cv_version_id")), no),
        "duplicate_user": again,
        "missing_profiles": F.col("profiles").isNull(),
        "too_many_profiles": F.size("profiles") > 20,
        "missing_has_saved_filters": F.col("has_saved_filters").isNull(),
        "invalid_profile_count": ~F.coalesce(F.col("invalid_profile_count").between(0, 20), no),
        "invalid_cv_last_updated": F.col("cv_last_updated").isNotNull() & F.col("cv_last_updated").try_cast("timestamp").isNull(),
        "invalid_profile": F.coalesce(F.exists("profiles", bad), no),
    }
    out = None
    for code, broken in rules.items():
        out = F.when(broken, code) if out is None else out.when(broken, code)
    return users.select("user_id", out.alias("error"))


def profile_stats(users: DataFrame) -> DataFrame:
    """One row of counts over users (user_id, has_saved_filters, profiles as a count): eligible, with filters, failing closed."""
    n = F.col("profiles")
    return users.agg(
        F.count("*").alias("eligible_users"),
        F.count_if("has_saved_filters").alias("users_with_saved_filters"),
        F.count_if(n > 0).alias("users_with_valid_profiles"),
        F.count_if(F.col("has_saved_filters") & (n == 0)).alias("users_failing_closed"),
        F.coalesce(F.sum(n), F.lit(0)).alias("profile_count"),
    )


def execution_targets(targets: DataFrame, users: DataFrame | None) -> DataFrame:
    """Targets with ``skipped``: all but health-only ones where there is no eligible user. ``users`` None: one user's run."""
    if users is None or not users.isEmpty():
        return targets.withColumn("skipped", F.lit(False))
    return targets.withColumn("skipped", ~F.coalesce("health_only", F.lit(False)))


def import_gate(preflight: Column, existing: Column, detail: Column, eligibility: Column, description: Column) -> Column:
    """What an import comes to before any limit; null where the job is to be created."""
    return (
        F.when(~preflight.eqNullSafe(F.lit("ok")), "skipped_preflight_error")
        .when(existing.isNotNull(), "existing_preflight")
        .when(detail.eqNullSafe(F.lit("unavailable")), "skipped_detail_unavailable")
        .when(eligibility.eqNullSafe(F.lit("ineligible")), "skipped_location_ineligible")
        .when(F.trim(F.coalesce(description, F.lit(""))) == "", "skipped_missing_description")
    )


def detail_gate(preflight: Column, exists: Column, description: Column) -> Column:
    return F.when(~preflight.eqNullSafe(F.lit("ok")), "skipped_preflight_error").when(exists, "skipped_existing").when(F.trim(F.coalesce(description, F.lit(""))) != "", "already_present")


def compatibility_pairs(imports: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct pairs of imported job and matched user."""
    pairs = imports.select("job_id", F.explode("matched_user_ids").alias("user_id")).distinct()
    return pairs.join(users.select("user_id").distinct(), "user_id", "left_semi")
