"""Text, HTML and JSON functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The named entities that are decoded.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


@F.pandas_udf(StringType())
def decode_numeric_entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Decimal and hexadecimal entities as characters; ones beyond Unicode stay."""
    import re

    find = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")

    def one(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    for batch in batches:
        yield batch.map(lambda t: t if t is None else find.sub(one, t))


def decode_entities(text: Column, numeric: bool = False) -> Column:
    """Named entities, and numeric ones if asked for (those need Python), each decoded once."""
    held = F.regexp_replace(text, "(?i)&amp;", "\u0001")
    for name, value in ENTITIES.items():
        if name != "amp":
            held = F.regexp_replace(held, f"(?i)&{name};", value)
    held = decode_numeric_entities(held) if numeric else held
    return F.replace(held, F.lit("\u0001"), F.lit("&"))


def html_to_text(html: Column, numeric: bool = False) -> Column:
    """Plain text with line breaks where blocks end and dashes before list items."""
    bare = _chain(
        F.coalesce(html, F.lit("")),
        (r"(?is)<script\b[^>]*>.*?</script>", " "),
        (r"(?is)<style\b[^>]*>.*?</style>", " "),
        (r"(?i)<\s*br\s*/?>", "\n"),
        (r"(?i)<\s*li\b[^>]*>", "\n- "),
        (r"(?i)</\s*(p|div|li|h[1-6]|section|article|tr|ul|ol)\s*>", "\n"),
        (r"<[^>]+>", " "),
    )
    text = _chain(decode_entities(bare, numeric), ("\r", ""), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def greenhouse_text(html: Column) -> Column:
    """Text of a posting whose HTML may be encoded as entities as a whole."""
    encoded = html.rlike("(?i)&lt;/?[a-z]")
    return html_to_text(F.when(encoded, decode_entities(html)).otherwise(html))


def text_to_html(text: Column) -> Column:
    """Paragraphs and line breaks of a plain text as HTML; markup in it stays text."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?| | ", "\n"), r"^\s+|\s+$", "")
    safe = F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.transform(F.split(safe, r"\n(?:[ \t]*\n)+"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return F.when(plain == "", "").otherwise(F.array_join(paragraphs, ""))


def normalise_text(text: Column) -> Column:
    """Line ends as newlines, no white space at them, two blank lines at most, single spaces, one newline at the end."""
    lines = _chain(text, ("\r\n?", "\n"), (r"[^\S\n]+(?=\n|$)", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "))
    return F.concat(F.regexp_replace(lines, r"^\s+|\s+$", ""), F.lit("\n"))


def quill_text(delta: Column) -> Column:
    """Text of an editor's delta document: its inserts in a row, embeds as newlines."""
    ops = F.from_json(F.get_json_object(delta, "$.ops"), "array<struct<insert:string>>")
    return F.array_join(F.transform(ops, lambda o: F.when(o["insert"].startswith("{"), "\n").otherwise(o["insert"])), "")


def description_windows(description: Column, least: int = 4, most: int = 500) -> Column:
    """Sentences and lines of a description, those of ``least`` characters on, each cut at ``most``."""
    text = _chain(
        F.coalesce(description, F.lit("")),
        (r"(?i)<br\s*/?\s*>", "\n"),
        (r"(?i)</(?:p|li|div|section|article|h[1-6])\s*>", "\n"),
        (r"<[^>]+>", " "),
        ("\r\n?", "\n"),
        (r"[ \t\f\x0b]+", " "),
        (r" *\n *", "\n"),
    )
    parts = F.transform(F.split(text, r"\n+|(?<=[.!?;])\s+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.transform(F.filter(parts, lambda p: F.length(p) >= least), lambda p: F.left(p, F.lit(most)))


def truncate_with_note(text: Column, most: int) -> Column:
    """The text, cut if it is longer, with a note of how much is gone; empty for null."""
    note = F.concat(F.lit("... "), (F.length(text) - most).cast("string"), F.lit(" symbols cut"))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), note)).otherwise(F.coalesce(text, F.lit("")))


def property_key(key: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none around."""
    return F.trim(F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9]+", "_"), F.lit("_"))


def failure_stage(value: Column) -> Column:
    """Letters and digits of the first 80 characters in lower case, separators as underscores, none around; null if empty."""
    spaced = F.regexp_replace(F.left(F.trim(value), F.lit(80)), "[-_ .]", "_")
    return F.nullif(F.trim(F.lower(F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", "")), F.lit("_")), F.lit(""))


def distinct_terms(text: Column, most: int = 50, length: int = 120) -> Column:
    """Lines of a text as terms: trimmed, cut, the first of equal ones, at most so many."""
    lines = F.transform(F.split(text, r"[\n,;]"), lambda t: F.left(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(length)))
    return F.slice(F.array_distinct(F.filter(lines, lambda t: t != "")), 1, most)


def join_distinct(parts: Column, by: str = ", ") -> Column:
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (F.trim(p) != ""))), by)


@F.pandas_udf(StringType())
def first_json_object(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first balanced JSON object of a model's answer, without what it thought aloud; null without one."""
    import json
    import re

    thoughts = re.compile(r"<think>.*?(?:</think>|$)", re.S)
    decode = json.JSONDecoder().raw_decode

    def one(text: str | None) -> str | None:
        text = thoughts.sub("", text or "")
        at = text.find("{")
        while at >= 0:
            try:
                value, _ = decode(text, at)
                return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                at = text.find("{", at + 1)
        return None

    for batch in batches:
        yield batch.map(one)


@F.pandas_udf(StringType())
def canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with sorted keys and no spaces; null where it isn't JSON."""
    import json

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    for batch in batches:
        yield batch.map(one)


def version_id(text: Column) -> Column:
    """SHA-256 of canonical JSON: equal for documents that differ in spaces or the order of keys only."""
    return F.sha2(canonical_json(text), 256)


def history_envelope(kind: Column, data: Column) -> Column:
    return F.to_json(F.struct(F.lit(1).alias("v"), kind.alias("kind"), data.alias("data")))


def unwrap_envelope(details: Column) -> Column:
    """The data of a wrapped history detail, the detail itself where it isn't wrapped."""
    return F.coalesce(F.get_json_object(details, "$.data"), details)


def property_or_text(text: Column) -> Column:
    """Parsed JSON, or the text as a JSON string where it isn't JSON; null for null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.coalesce(F.try_parse_json(text), F.parse_json(F.substr(listed, F.lit(2), F.length(listed) - 2))))
