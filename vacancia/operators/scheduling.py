"""Scheduled tasks: the slot that is due, whether to run it, and which runs to keep; and working times in descriptions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.functions.texts import description_windows

# Regions by names of their time zones.
TIME_ZONES = {
    "north_america_west": ("Pacific Time", "Pacific timezone", "Mountain Time", "Mountain timezone", "PST", "PDT", "MST", "MDT", "PT", "MT"),
    "north_america_east": ("Eastern Time", "Eastern timezone", "Central Time", "Central timezone", "EST", "EDT", "CST", "CDT", "ET", "CT"),
    "europe": ("Central European Time", "Western European Time", "Greenwich Mean Time", "British Summer Time", "CET", "CEST", "GMT", "BST", "European working hours", "Europe hours"),
    "west_asia": ("Gulf Standard Time", "Arabia Standard Time", "India Standard Time"),
    "east_asia": ("China Standard Time", "Singapore Time", "Hong Kong Time", "Korea Standard Time"),
    "australia_japan": ("Japan Standard Time", "JST", "Australian Eastern Time", "AEST", "AEDT"),
}


def latest_slot(now_utc: Column, zone: str, hour: int, minute: int, weekday: int | None = None) -> Column:
    """The local day of the latest slot at or before ``now_utc``: daily, or weekly on ``weekday`` (0 is Monday)."""
    local = F.from_utc_timestamp(now_utc.cast("timestamp"), zone).cast("timestamp_ntz")
    day = F.to_date(local)
    early = F.hour(local) * 60 + F.minute(local) < hour * 60 + minute
    if weekday is None:
        return F.when(early, F.date_sub(day, 1)).otherwise(day)
    since = F.pmod(F.weekday(day) - weekday, F.lit(7))
    slot = F.date_sub(day, since)
    return F.when(early & (since == 0), F.date_sub(slot, 7)).otherwise(slot)


def task_decision(slot: Column, completed_slot: Column, completed_at: Column, attempts: Column, now: Column, spacing_minutes: int, most_attempts: int, force: Column | None = None) -> Column:
    """already_completed, skipped_minimum_spacing, retry_exhausted or run; a forced task runs."""
    recent = F.coalesce(completed_at > now - F.expr(f"INTERVAL '{spacing_minutes}' MINUTE"), F.lit(False))
    decided = F.when(completed_slot.eqNullSafe(slot), "already_completed").when(recent, "skipped_minimum_spacing").when(attempts >= most_attempts, "retry_exhausted").otherwise("run")
    return decided if force is None else F.when(force, "run").otherwise(decided)


def retained(runs: DataFrame, kind: str, started_at: str, run_id: str, now: Column, least_runs: int, most_days: int) -> DataFrame:
    """``runs`` with ``keep``: the newest few of each kind, and all that are young enough.

    The oldest of a kind's newest few is found by a limited rank, so that no task holds all runs of a kind."""
    place = F.struct(started_at, run_id)
    newest = runs.select(kind, place.alias("_place")).select(kind, "_place", F.row_number().over(Window.partitionBy(kind).orderBy(F.col("_place").desc())).alias("_nth")).where(F.col("_nth") <= least_runs)
    last = newest.groupBy(F.col(kind).alias("_kind")).agg(F.min("_place").alias("_last"))
    young = F.col(started_at) > now - F.expr(f"INTERVAL '{most_days}' DAY")
    joined = runs.join(last, F.col(kind).eqNullSafe(F.col("_kind")), "left")
    return joined.withColumn("keep", (place >= F.col("_last")) | young).drop("_kind", "_last")


def _names(terms: tuple[str, ...]) -> str:
    bodies = [r"[\s.-]+".join(map(re.escape, t.split())) for t in terms]
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(bodies) + r")(?![\p{L}\p{N}])"


def work_time_regions(rows: DataFrame, key: str, description: str) -> DataFrame:
    """key, region and strength of each region whose hours a sentence on working times names."""
    windows = rows.select(key, F.explode(description_windows(F.col(description))).alias("_w"))
    w = F.col("_w")
    about = w.rlike(r"(?iu)\b(?:work|working|business|office|team|core)\s+hours?\b") | w.rlike(r"(?iu)\b(?:available|availability|active|online|overlap|schedule|timezone|time\s+zone)\b")
    found = F.array_compact(F.array(*[F.when(w.rlike(_names(terms)), F.lit(region)) for region, terms in TIME_ZONES.items()]))
    strength = F.when(w.rlike(r"(?iu)\b(?:must|required|mandatory|need(?:ed)?|expected|at\s+least)\b"), "required").when(w.rlike(r"(?iu)\b(?:preferred|ideally|nice\s+to\s+have)\b"), "preferred").otherwise("stated")
    return windows.where(about).select(key, F.explode(found).alias("region"), strength.alias("strength")).distinct()


def work_time_status(regions: DataFrame, key: str) -> DataFrame:
    return regions.groupBy(key).agg(F.when(F.count_distinct("region") == 1, "resolved").otherwise("multiple").alias("status"))


def resolved_regions(values: Column, table: dict[str, str]) -> Column:
    """Administrative regions named in a text, by a table from name to code."""
    hits = [F.when(values.rlike(_names((name,))), F.lit(code)) for name, code in table.items()]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(or_, [F.lower(text).contains(t.lower()) for t in terms])
