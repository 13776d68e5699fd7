"""Users' saved filters, languages, search items and messages out of JSON and free text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vacancia.functions.scores import language, level
from vacancia.functions.statuses import STATUS_LABELS

MOST_TERMS, LONGEST_TERM = 50, 120

# Names under which parts of a saved filter may stand, the first one present counting.
SECTIONS = {
    "title": (("title", "titleFilter", "title_filter", "titleKeywords", "title_keywords"), {"positive": ("positive", "include", "allow", "required", "keywords"), "negative": ("negative", "exclude", "block", "forbidden")}),
    "location": (("location", "locationFilter", "location_filter", "locationKeywords", "location_keywords"), {"always": ("alwaysAllow", "always_allow"), "allow": ("allow", "include", "positive"), "block": ("block", "exclude", "negative")}),
    "company": (("company", "companyFilter", "company_filter", "companies"), {"allow": ("allow", "include", "positive"), "block": ("block", "exclude", "negative")}),
}
REMOTE_NAMES = ("remoteTypes", "remote_types", "workModes", "work_modes")
# Names under which a search result's parts may stand.
ITEM_NAMES = {
    "title": ("title", "Title", "jobName", "JobName", "jobTitle", "JobTitle", "name", "Name"),
    "company": ("company", "Company", "companyName", "CompanyName", "hiringCompanyName", "HiringCompanyName", "postingCompanyName", "PostingCompanyName"),
    "status": ("status", "Status", "currentStatus", "CurrentStatus", "userStatus", "UserStatus", "currentUserStatus", "CurrentUserStatus"),
    "provider": ("provider", "Provider"),
    "url": ("url", "Url", "applyUrl", "ApplyUrl"),
}


def first_of(json: Column, names: Sequence[str], base: str = "$") -> Column:
    """The first of several members of a JSON object that isn't null, as text."""
    return F.coalesce(*[F.get_json_object(json, f"{base}.{n}") for n in names])


def discovery_profiles(rows: DataFrame, json: str) -> DataFrame:
    """``rows`` with the terms of a saved filter by section and part, all null where it constrains nothing.

    Terms are distinct without regard to case, at most 50 of at most 120 characters. Each step is a projection of its
    own, so that no JSON text is parsed twice.
    """
    nested = F.get_json_object(json, "$.filters")
    rows = rows.withColumn("_root", F.when(nested.startswith("{"), nested).otherwise(F.col(json)))
    member = lambda n: F.get_json_object("_root", f"$.{n}")
    rows = rows.withColumns({f"_{section}_{n}": member(n) for section, (names, _) in SECTIONS.items() for n in names} | {f"_remote_{n}": member(n) for n in ("remote", "remoteFilter", "remote_filter")})
    rows = rows.withColumns({f"_in_{section}": F.coalesce(*[F.when(F.col(f"_{section}_{n}").startswith("{"), F.col(f"_{section}_{n}")) for n in names]) for section, (names, _) in SECTIONS.items()})
    values = {f"{section}_{part}": first_of(F.col(f"_in_{section}"), aliases) for section, (_, parts) in SECTIONS.items() for part, aliases in parts.items()}
    values["remote_types"] = F.coalesce(first_of(F.col("_root"), REMOTE_NAMES), *[first_of(F.col(f"_remote_{n}"), ("allow", "types")) for n in ("remote", "remoteFilter", "remote_filter")])
    rows = rows.withColumns({f"_v_{k}": v for k, v in values.items()})
    kept = [c for c in rows.columns if not c.startswith("_")]
    none = F.array().cast("array<string>")
    listed = lambda v: F.coalesce(F.from_json(v, "array<string>"), F.when(v.isNotNull() & ~v.rlike(r"^\s*[\[{]"), F.array(v)), none)
    rows = rows.select(*kept, *[listed(F.col(f"_v_{k}")).alias(k) for k in values])
    rows = rows.withColumns({k: F.filter(F.transform(k, lambda t: F.trim(t)), lambda t: (t != "") & (F.length(t) <= LONGEST_TERM)) for k in values})
    rows = rows.withColumns({f"_low_{k}": F.transform(k, lambda t: F.lower(t)) for k in values})
    one = lambda k: F.slice(F.filter(k, lambda t, i: F.array_position(F.col(f"_low_{k}"), F.lower(t)) == i + 1), 1, MOST_TERMS)
    constrained = F.greatest(*[F.size(k) for k in values]) > 0
    return rows.select(*kept, *[F.when(constrained, one(k)).alias(k) for k in values])


def language_list(json: Column, default: str = "B1") -> Column:
    """Array of language and level out of an object of levels, a list of objects, or a list of names."""
    pairs = F.map_entries(F.when(json.startswith("{"), F.from_json(json, "map<string,string>")))
    of_map = F.transform(pairs, lambda e: F.struct(language(e["key"]).alias("language"), level(e["value"], default).alias("level")))
    listed = F.from_json(F.when(json.startswith("["), json), "array<string>")

    def one(x: Column) -> Column:
        is_object = x.startswith("{")
        name = F.when(is_object, first_of(x, ("Language", "language", "Name", "name"))).otherwise(x)
        grade = F.when(is_object, first_of(x, ("Level", "level", "CEFR", "cefr")))
        return F.struct(language(name).alias("language"), level(grade, default).alias("level"))

    found = F.coalesce(of_map, F.transform(listed, one), F.array().cast("array<struct<language:string,level:string>>"))
    return F.filter(found, lambda x: x["language"] != "")


def search_item(json: Column) -> Column:
    """Struct of a search result's parts, whatever they are called."""
    return F.struct(*[first_of(json, names).alias(part) for part, names in ITEM_NAMES.items()])


def leading_status(text: Column) -> Column:
    """Struct of the status that a message begins with (the longest that fits) and the rest; no status leaves the message."""
    plain, out = F.trim(F.coalesce(text, F.lit(""))), None
    for label in sorted(STATUS_LABELS, key=lambda s: (-len(s), s)):
        item = F.struct(F.lit(label).alias("status"), F.trim(F.substr(plain, F.lit(len(label) + 1))).alias("query"))
        test = F.lower(plain).startswith(label.lower())
        out = F.when(test, item) if out is None else out.when(test, item)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("status"), plain.alias("query")))


def query_without_status(text: Column) -> Column:
    """A message without its first two words, or three after hm, mo and re; at least the last word stays."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    skip = F.when(F.lower(F.trim(text)).rlike("^(hm|mo|re)"), 3).otherwise(2)
    rest = F.slice(words, skip + 1, F.greatest(F.size(words) - skip, F.lit(1)))
    return F.when(F.size(words) == 0, "").when(F.size(words) <= skip, F.element_at(words, F.when(F.size(words) > 0, -1).otherwise(1))).otherwise(F.array_join(rest, " "))


# Tags and attributes that a description may hold.
TAGS = frozenset("p br hr span div b strong i em u code pre blockquote ul ol li h1 h2 h3 h4 a img".split())
ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt")}
PROTOCOLS = ("http:", "https:", "mailto:", "data:")


@F.pandas_udf(StringType())
def safe_description(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML with allowed tags and attributes only; images only as data, links to a new window. Other tags go, their text stays."""
    from html import escape
    from html.parser import HTMLParser

    class Keeper(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []

        def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
            if tag not in TAGS:
                return
            allowed = (*ATTRIBUTES.get(tag, ()), "class")
            kept = []
            for name, value in attrs:
                value = (value or "").strip()
                scheme = re.match(r"[a-z][a-z0-9+.-]*:", re.sub(r"[\x00-\x20]", "", value).lower())
                if name in allowed and not (name in ("href", "src") and scheme and scheme[0] not in PROTOCOLS):
                    kept.append((name, value))
            if tag == "img" and not dict(kept).get("src", "").startswith("data:"):
                return
            if tag == "a":
                kept += [("target", "_blank"), ("rel", "noopener noreferrer nofollow")]
            self.out.append(f"<{tag}{''.join(f' {n}="{escape(v)}"' for n, v in kept)}>")

        def handle_endtag(self, tag: str) -> None:
            if tag in TAGS and tag not in ("br", "hr", "img"):
                self.out.append(f"</{tag}>")

        def handle_data(self, data: str) -> None:
            self.out.append(escape(data, quote=False))

    def one(html: str | None) -> str:
        keeper = Keeper()
        keeper.feed(html or "")
        keeper.close()
        return "".join(keeper.out)

    for batch in batches:
        yield batch.map(one)
