"""Scores, languages, pay and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.texts import truncate_with_note

# The longest summary and the longest piece of raw output that are stored.
LONGEST_SUMMARY, LONGEST_SNIPPET = 1800, 400
# Levels, what other words for them mean, and in which order parts of longer phrases are tried.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
LEVEL_ALIASES = {
    "NATIVE": "C2", "BILINGUAL": "C2", "FLUENT": "C1", "ADVANCED": "C1", "UPPER-INTERMEDIATE": "B2", "UPPER INTERMEDIATE": "B2", "INTERMEDIATE": "B1", "PROFESSIONAL": "B1",
    "PROFESSIONAL WORKING": "B1", "WORKING": "B1", "CONVERSATIONAL": "B1", "BUSINESS": "B2", "NEGOTIATION": "C1", "NEGOTIATION LEVEL": "C1", "GOOD": "B1", "BASIC": "A2", "ELEMENTARY": "A1", "BEGINNER": "A1",
}
LEVEL_PHRASES = (
    (("NEGOTIATION",), "C1"), (("BUSINESS",), "B2"), (("PROFESSIONAL",), "B1"), (("FLUENT",), "C1"), (("ADVANCED",), "C1"), (("UPPER", "INTERMEDIATE"), "B2"), (("INTERMEDIATE",), "B1"),
    (("CONVERSATIONAL",), "B1"), (("BASIC",), "A2"), (("BEGINNER",), "A1"), (("ELEMENTARY",), "A1"), (("NATIVE",), "C2"), (("BILINGUAL",), "C2"),
)
PAY_INTERVALS = {"1 HOUR": 2080, "1 DAY": 260, "1 WEEK": 52, "2 WEEK": 26, "0.5 MONTH": 24, "1 MONTH": 12, "2 MONTH": 6, "3 MONTH": 4, "6 MONTH": 2, "1 YEAR": 1}
WEIGHTS = {"hard_skills": 0.60, "experience": 0.25, "soft_skills": 0.15}


def level(value: Column, default: str = "B1") -> Column:
    """One of the six levels, by its name, an alias, or a word within a phrase."""
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    out = F.when(text.isin(*LEVELS), text).when(text == "", default)
    for alias, meant in LEVEL_ALIASES.items():
        out = out.when(text == alias, meant)
    for words, meant in LEVEL_PHRASES:
        test = text.contains(words[0])
        for w in words[1:]:
            test = test & text.contains(w)
        out = out.when(test, meant)
    return out.otherwise(default)


def level_rank(value: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), value)


def language(value: Column) -> Column:
    """Capitalised name; codes of two letters in upper case."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.length(text) <= 2, F.upper(text)).otherwise(F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2)))))


def language_gate(required: DataFrame, spoken: DataFrame, key: str, applicant: str) -> DataFrame:
    """Whether each applicant misses a language that a job requires: pairs of both, missing and met requirements.

    ``required``: key, applicant, language, level. ``spoken``: applicant, language, level; the best one counts.
    """
    best = spoken.select(applicant, language(F.col("language")).alias("language"), level_rank(level(F.col("level"))).alias("have")).groupBy(applicant, "language").agg(F.max("have").alias("have"))
    need = required.select(key, applicant, language(F.col("language")).alias("language"), level_rank(level(F.col("level"))).alias("need"))
    rows = need.join(best, [applicant, "language"], "left")
    met = F.coalesce(F.col("have") >= F.col("need"), F.lit(False))
    return rows.groupBy(key, applicant).agg(F.count_if(~met).alias("missing"), F.count_if(met).alias("met")).withColumn("disqualified", F.col("missing") > 0)


def scored_section(answer: Column, names: tuple[str, ...], missing: str) -> Column:
    """Struct of score and description of a section of a model's answer, under any of its names."""
    path = lambda *parts: F.get_json_object(answer, "$." + ".".join(parts))
    told = F.coalesce(*[F.when(path(n).startswith("{"), F.lit(True)) for n in names], F.lit(False))
    first = lambda fields: F.coalesce(*[F.nullif(path(n, f), F.lit("")) for n in names for f in fields])
    zero = lambda text: F.when(F.coalesce(text.try_cast("double") == 0, F.lit(False)), None).otherwise(text)  # noqa: E731  a score of 0 leaves the place to other names
    scores = F.coalesce(*[zero(F.nullif(path(n, f), F.lit(""))) for n in names for f in ("score", "Score", "value", "Value")])
    score = F.when(told, F.coalesce(clamp_score(scores), F.lit(0.0))).otherwise(0.0)
    text = F.when(told, F.trim(F.coalesce(first(("description", "Description", "summary", "Summary")), F.lit(missing)))).otherwise(missing)
    return F.struct(score.alias("score"), truncate_with_note(text, LONGEST_SUMMARY).alias("description"))


def model_result(answer: Column) -> Column:
    """A model's answer (a JSON object) in the form that is stored: description, languages, three scored sections, notes."""
    from vacancia.functions.profiles import language_list

    either = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(answer, f"$.{n}"), F.lit("")) for n in names])
    told = F.trim(F.coalesce(either("Description", "description", "summary", "Summary"), F.lit("")))
    description = F.when(told == "", "Structured compatibility summary could not be reliably extracted.").otherwise(truncate_with_note(told, LONGEST_SUMMARY))
    listed = lambda part: language_list(F.coalesce(*[F.get_json_object(answer, f"$.{n}.{part}") for n in ("Languages", "languages")]))
    failed, raw = F.get_json_object(answer, "$.__parse_error"), F.get_json_object(answer, "$.__raw")
    notes = F.array(
        F.when(told == "", "description was absent"),
        F.when(failed != "", F.concat(F.lit("model output JSON parse failed: "), failed)),
        F.when((failed != "") & (raw != ""), F.concat(F.lit("raw model output snippet: "), truncate_with_note(raw, LONGEST_SNIPPET))),
    )
    sections = {
        "hard_skills": (("HardSkills", "hardSkills", "hard_skills"), "Hard skills match could not be reliably extracted."),
        "experience": (("Experience", "experience"), "Experience match could not be reliably extracted."),
        "soft_skills": (("SoftSkills", "softSkills", "soft_skills"), "Soft skills match could not be reliably extracted."),
    }
    return F.struct(
        description.alias("description"), listed("Applicant").alias("applicant_languages"), listed("Job.Mandatory").alias("mandatory_languages"), listed("Job.Optional").alias("optional_languages"),
        *[scored_section(answer, names, missing).alias(part) for part, (names, missing) in sections.items()], F.array_compact(notes).alias("notes"),
    )


def valid_score(value: Column) -> Column:
    """A score from 0 to 10 to one decimal, half to even; null outside."""
    number = value.try_cast("double")
    return F.when(number.between(0, 10), F.bround(number, 1))


def clamp_score(value: Column, default: float = 0.0) -> Column:
    number = F.coalesce(value.try_cast("double"), F.lit(default))
    return F.when(F.isnan(number), F.lit(default)).otherwise(F.bround(F.least(F.greatest(number, F.lit(0.0)), F.lit(10.0)), 1))


def final_score(hard: Column, experience: Column, soft: Column, disqualified: Column) -> Column:
    """Weighted score to one decimal, half to even; 0.5 for those without a required language."""
    total = clamp_score(hard) * WEIGHTS["hard_skills"] + clamp_score(experience) * WEIGHTS["experience"] + clamp_score(soft) * WEIGHTS["soft_skills"]
    return F.when(disqualified, F.lit(0.5)).otherwise(F.bround(total, 1))


def annual_pay(low: Column, high: Column, interval: Column, currency: Column) -> Column:
    """Struct of min, max and currency a year; null for unknown intervals or without numbers."""
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in PAY_INTERVALS.items() for x in pair]), F.coalesce(interval, F.lit("1 YEAR")))
    a, b = (F.when(x.try_cast("double") >= 0, x.try_cast("double")) for x in (low, high))
    bottom, top = F.coalesce(a, b) * factor, F.coalesce(b, a) * factor
    return F.when(bottom.isNotNull(), F.struct(F.least(bottom, top).alias("min"), F.greatest(bottom, top).alias("max"), F.upper(F.trim(F.coalesce(currency, F.lit("")))).alias("currency")))


def strict_utc(text: Column) -> Column:
    """An ISO time with a zone as naive UTC; null without a zone or where it isn't one."""
    raw = F.trim(text)
    zoned = raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    full = F.regexp_replace(F.regexp_replace(raw, r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(zoned, F.try_to_timestamp(full).cast("timestamp_ntz"))


def lenient_time(text: Column) -> Column:
    """A naive time in one of four layouts, a final Z ignored."""
    raw = F.regexp_replace(F.trim(text), "Z$", "")
    layouts = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(x)) for x in layouts]).cast("timestamp_ntz")


def posted_on(label: Column, today: Column) -> Column:
    """The day of "Posted N Days Ago"; null for open-ended labels."""
    n = F.nullif(F.regexp_extract(label, r"(?i)posted\s+(\d+)\s*day", 1), F.lit("")).cast("int")
    return F.when(label.rlike(r"(?i)posted\s+today"), today).when(label.rlike(r"(?i)posted\s+yesterday"), F.date_sub(today, 1)).otherwise(F.date_sub(today, n))


def local_date(text: Column, order: str = "dmy") -> Column:
    """A date as d.m.y or m/d/y, years of two digits in this century; null where there is no such day."""
    pattern = r"^\s*(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})\s*$"
    part = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int") for i in (1, 2, 3)]
    day, month = (part[0], part[1]) if order == "dmy" else (part[1], part[0])
    year = F.when(part[2] < 100, part[2] + 2000).otherwise(part[2])
    return F.to_date(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)))


def report_start(name: str, end: Column) -> Column:
    days = {"day": 1, "week": 7, "month": 30}[name]
    return end - F.expr(f"INTERVAL '{days}' DAY")


def unix_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def zoned(ts: Column, zone: str) -> Column:
    """A naive UTC time as it reads on the clocks of ``zone``."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")
