"""State changes as pure functions: the state before and the changes in, the state after and what happened out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, by one aggregation that combines before it shuffles."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("best"))
    return best.select(*keys, "best.*").select(*rows.columns)


def merge(before: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: the changes' rows, and the rows before whose keys have none."""
    kept = before.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes.select(*before.columns))


def merge_status(before: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statuses after an upsert by job and user, and a history row a change that says from what to what."""
    keys = ["job_id", "user_id"]
    joined = changes.join(before.select(*keys, F.col("status").alias("from")), keys, "left")
    history = joined.select(*keys, F.coalesce("from", F.lit("Unset")).alias("from"), F.col("status").alias("to"), F.col("last_updated").alias("ts"))
    return merge(before, changes, keys), history


def transitions(history: DataFrame, keys: Sequence[str], status: Column, order: Sequence[str]) -> DataFrame:
    """What each change came from: the status before it, Unset for a first one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return history.withColumn("to", status).withColumn("from", F.lag("to", 1, "Unset").over(w))


def bulk_upsert(existing: DataFrame, items: DataFrame, keys: Sequence[str], value: str, at: str, index: str) -> DataFrame:
    """Newest item a key (a later index settles ties) against what exists: Inserted, Updated or IgnoredStale.

    An item as old as what exists replaces it; an older one is ignored. The row carries the value that stands after.
    """
    new = newest(items, keys, [at, index])
    old = existing.select(*keys, F.col(value).alias("_value"), F.col(at).alias("_at"))
    joined = new.join(old, list(keys), "left")
    stale = F.col("_at").isNotNull() & (F.col("_at") > F.col(at))
    outcome = F.when(F.col("_at").isNull(), "Inserted").when(stale, "IgnoredStale").otherwise("Updated")
    return joined.select(*keys, outcome.alias("disposition"), F.when(stale, F.col("_value")).otherwise(F.col(value)).alias(value), F.when(stale, F.col("_at")).otherwise(F.col(at)).alias(at))


def insert_disposition(existing: DataFrame, incoming: DataFrame, identity: Sequence[str], id_column: str) -> DataFrame:
    """Idempotent insert by identity: ``existing`` with the id that it has, or ``created``; repeats within the batch are ``repeated``."""
    w = Window.partitionBy(*identity).orderBy(id_column)
    first = F.min(id_column).over(Window.partitionBy(*identity))
    rows = incoming.withColumn("_nth", F.row_number().over(w)).withColumn("_first", first)
    known = existing.groupBy(*identity).agg(F.min(id_column).alias("_known"))
    joined = rows.join(known, list(identity), "left")
    outcome = F.when(F.col("_known").isNotNull(), "existing").when(F.col("_nth") == 1, "created").otherwise("repeated")
    return joined.select(id_column, *identity, outcome.alias("disposition"), F.coalesce("_known", "_first").alias("stands_as"))


def append_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct incoming rows that don't exist yet, missing parts of a key being equal to each other."""
    one = incoming.dropDuplicates(list(keys))
    e = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = test if on is None else on & test
    return one.join(e, on, "left_anti")


def collapse_country_only(locations: DataFrame, key: str = "job_id") -> DataFrame:
    """Distinct locations without those that name only a country of which a city stands there too."""
    one = locations.select(key, "country_name", "city_name").distinct()
    cities = one.where("city_name is not null").select(key, "country_name").distinct().withColumn("_has", F.lit(True))
    return one.join(cities, [key, "country_name"], "left").where("city_name is not null or _has is null").drop("_has")


def field_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str], flagged: Sequence[str] = ()) -> DataFrame:
    """A row a field that changed: from and to as text; of ``flagged`` fields only that they did."""
    pairs = before.alias("b").join(after.alias("a"), key)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("from"), F.col(f"a.{f}").cast("string").alias("to")) for f in fields])
    rows = pairs.select(key, F.explode(F.filter(each, lambda x: ~x["from"].eqNullSafe(x["to"]))).alias("d")).select(key, "d.*")
    shown = ~F.col("field").isin(*flagged) if flagged else F.lit(True)
    return rows.select(key, "field", F.when(shown, F.col("from")).alias("from"), F.when(shown, F.col("to")).alias("to"))


def soft_delete(rows: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = rows.join(hit, key, "left")
    gone = F.col("_hit").isNotNull() & ~F.col("is_deleted")
    return joined.withColumn("updated_at", F.when(gone, now).otherwise(F.col("updated_at"))).withColumn("is_deleted", F.col("is_deleted") | gone).drop("_hit")


def owned_delete(rows: DataFrame, wanted: DataFrame, key: str, owner: str) -> DataFrame:
    """``rows`` without those that ``wanted`` names by key and owner; another's rows stay."""
    return rows.join(wanted.select(key, owner), [key, owner], "left_anti")


def repair(before: Column, after: Column) -> Column:
    """Whether a repaired text differs from the stored one: updated or unchanged."""
    return F.when(after.eqNullSafe(before), "unchanged").otherwise("updated")


def backfilled(rows: DataFrame, source: str, into: str, kind: str = "bigint") -> DataFrame:
    """``rows`` with ``into`` filled from a text column where it casts, null elsewhere."""
    return rows.withColumn(into, F.col(source).try_cast(kind))


def set_difference(before: Column, after: Column) -> Column:
    """What came and what went between two arrays, each sorted, as a struct; null where they hold the same."""
    came, went = F.sort_array(F.array_except(after, before)), F.sort_array(F.array_except(before, after))
    return F.when((F.size(came) > 0) | (F.size(went) > 0), F.struct(came.alias("added"), went.alias("removed")))
