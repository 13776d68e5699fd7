"""Status reports out of the history log, and their text forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.functions.statuses import status_from_history

MOST_DAYS = 184


def company(hiring: Column, posting: Column, word: str = "agency") -> Column:
    """The hiring company, with the one that posted the job if that is another."""
    own = posting.isNull() | (F.trim(posting) == "") | (posting == hiring)
    return F.when(own, hiring).otherwise(F.concat(hiring, F.lit(f" (through {word} "), posting, F.lit(")")))


def snapshot(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("is_deleted")).select("job_id", "title", company(F.col("hiring_company_name"), F.col("posting_company_name")).alias("company"))


def status_changes(history: DataFrame, jobs: DataFrame, user_id: int, start: datetime, end: datetime) -> DataFrame:
    """A user's status changes within a window of at most 184 days, of deleted jobs too."""
    if end < start or (end - start).days > MOST_DAYS:
        raise ValueError("the window must end after it starts, within 184 days")
    ts = F.col("ts")
    kept = history.where((F.col("actor_type") == "user") & (F.col("actor_id") == user_id) & ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    kept = kept.where((F.col("action") == "status_changed") | F.col("action").startswith("status:"))
    rows = kept.select("job_id", "ts", "history_id", status_from_history(F.col("action"), F.col("details")).alias("status")).where("status is not null")
    return rows.join(jobs.select("job_id", "title"), "job_id").select("job_id", "title", "ts", "status", "history_id")


def grouped(changes: DataFrame) -> DataFrame:
    """A row a job with its changes in order."""
    item = F.struct("ts", "history_id", "status")
    return changes.groupBy("job_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("statuses"))


def report_lines(changes: DataFrame, zone: str = "UTC") -> DataFrame:
    """The four columns of the CSV report: time in ``zone``, status, title and company."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    return changes.select(F.date_format(local, "yyyy-MM-dd HH:mm").alias("time"), "status", "title", "company")


def report_text(changes: DataFrame, zone: str = "UTC") -> DataFrame:
    """The bullets of the text report, one a row."""
    lines = report_lines(changes, zone)
    return lines.select(F.format_string("- %s: %s (%s, %s)", "time", "status", "title", "company").alias("value"))


def relative_label(ts: Column, now: Column) -> Column:
    """``just now``, ``today at 14:05``, ``on 03 Mar at 14:05`` or ``on 03 Mar 2023``."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(ts)
    same_year = F.year(ts) == F.year(now)
    return (
        F.when(seconds < 60, "just now")
        .when(F.to_date(ts) == F.to_date(now), F.concat(F.lit("today at "), F.date_format(ts, "HH:mm")))
        .when(same_year, F.concat(F.lit("on "), F.date_format(ts, "dd MMM"), F.lit(" at "), F.date_format(ts, "HH:mm")))
        .otherwise(F.concat(F.lit("on "), F.date_format(ts, "dd MMM yyyy")))
    )
