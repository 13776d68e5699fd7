"""Users who take part in discovery, with their newest filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """Users with a CV, its text and its version."""
    full = [F.trim(F.coalesce(c, F.lit(""))) != "" for c in ("cv_blob_path", "cv_text_blob_path", "cv_version_id")]
    return users.join(preferences.where(full[0] & full[1] & full[2]), "user_id")


def top_filters(users: DataFrame, filters: DataFrame, most_users: int, most_filters: int) -> DataFrame:
    """The first users by id, each with its newest filters; users without any stay with an empty row.

    The users are limited before filters are ranked, so that only their filters are."""
    chosen = users.select("user_id").orderBy("user_id").limit(most_users)
    own = filters.join(chosen, "user_id", "left_semi")
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("filter_id").desc())
    ranked = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most_filters)
    return chosen.join(ranked.select("user_id", "filter_id", "rank"), "user_id", "left")


def status_counts(rows: DataFrame, reason: Column) -> DataFrame:
    """How many are eligible, and how many fail for each reason; reason is null for the eligible."""
    return rows.agg(F.count_if(reason.isNull()).alias("eligible"), *[F.count_if(reason == r).alias(r) for r in ("missing_cv", "missing_text", "missing_version")])
