"""Target plans of discovery runs: buckets, budgets, orders and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.operators.numbering import numbered

BUCKETS = ("recent_activity", "recovery", "dead_reprobe", "long_empty", "healthy")
MAINTENANCE = ("recovery", "dead_reprobe", "long_empty")


def bucket(health: Column) -> Column:
    return F.when(health == "active", "recent_activity").when(health.isin("cooldown", "temporarily_failed"), "recovery").when(health.isin("suspected_dead", "confirmed_dead"), "dead_reprobe").when(health == "long_empty", "long_empty").otherwise("healthy")


def is_due(next_at: Column, now: Column) -> Column:
    return F.coalesce(next_at <= now, F.lit(True))


def cooling_down(health: Column, until: Column, now: Column) -> Column:
    return F.coalesce((health == "cooldown") & (until > now), F.lit(False))


def bucket_counts(targets: DataFrame, now: Column) -> DataFrame:
    """Population and due targets of each provider and bucket."""
    rows = targets.withColumn("bucket", bucket(F.col("health")))
    return rows.groupBy("provider", "bucket").agg(F.count("*").alias("population"), F.count_if(is_due(F.col("next_at"), now)).alias("due"))


def first_wins(targets: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``targets`` with ``duplicate``: true for all but the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return targets.withColumn("duplicate", F.row_number().over(w) > 1)


def without_disabled(targets: DataFrame, disabled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``targets`` with ``disabled``: true for those whose key is switched off."""
    off = disabled.select(*keys).distinct().withColumn("disabled", F.lit(True))
    return targets.join(off, list(keys), "left").withColumn("disabled", F.coalesce("disabled", F.lit(False)))


def schedule_rank(targets: DataFrame, most: int | None = None) -> DataFrame:
    """``targets`` with ``rank`` in their provider and bucket: longest due, longest not tried, then by a hash of the name.

    With ``most``, only the first ones of each are kept; Spark drops the others before it shuffles."""
    name = F.sha2(F.concat(F.col("provider"), F.decode(F.unhex(F.lit("00")), "UTF-8"), F.lower("tenant")), 256)
    order = [F.col("next_at").asc_nulls_first(), F.col("last_attempt_at").asc_nulls_first(), name, "tenant"]
    if most is None:
        return numbered(targets, order, "rank", ["provider", "bucket"])
    w = Window.partitionBy("provider", "bucket").orderBy(*order)
    return targets.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def healthy_reservation(healthy: Column, due_recent: Column, most: Column, days: int) -> Column:
    """Healthy targets a run so that all come round within ``days``, as far as recent ones leave room."""
    wanted = F.ceil(healthy / F.lit(days))
    return F.least(wanted, F.greatest(F.lit(0), most - due_recent))


def sweep(counts: DataFrame, most: int, days: int) -> DataFrame:
    """Whether each provider's healthy targets come round in time at its budget, and how long they take."""
    wide = counts.groupBy("provider").agg(
        *[F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col(c))), F.lit(0)).alias(f"{c}_{b}") for b in BUCKETS for c in ("population", "due")]
    )
    exceptional = sum((F.col(f"due_{b}") for b in MAINTENANCE), F.lit(0))
    wanted = F.ceil(F.col("population_healthy") / F.lit(days))
    needed = F.col("population_recent_activity") + exceptional + wanted
    reserved = healthy_reservation(F.col("population_healthy"), F.col("due_recent_activity"), F.lit(most), days)
    estimate = F.when(F.col("population_healthy") == 0, 0).when(reserved > 0, F.ceil(F.col("population_healthy") / reserved))
    return wide.select("provider", F.col("population_healthy").alias("healthy"), wanted.alias("healthy_per_run"), needed.alias("needed_per_run"), estimate.alias("sweep_days"), (F.lit(most) >= needed).alias("feasible"))


def whole_sweep(sweeps: DataFrame, most: int) -> DataFrame:
    """One row over all providers' sweeps: sums, the longest sweep (null if any provider never comes round), feasibility."""
    stuck = (F.col("healthy") > 0) & F.col("sweep_days").isNull()
    sums = sweeps.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("healthy", "healthy_per_run", "needed_per_run")],
        F.coalesce(F.bool_or(stuck), F.lit(False)).alias("_stuck"), F.max("sweep_days").alias("_days"), F.coalesce(F.bool_and("feasible"), F.lit(True)).alias("_feasible"),
    )
    days = F.when(~F.col("_stuck"), F.coalesce("_days", F.lit(0)))
    return sums.select("healthy", "healthy_per_run", "needed_per_run", days.alias("sweep_days"), (F.col("_feasible") & (F.lit(most) >= F.col("needed_per_run"))).alias("feasible"))


def allot(due: dict[tuple[str, str], int], quotas: dict[str, int], budgets: dict[str, int], most: int, day: int) -> dict[tuple[str, str], int]:
    """How many targets each provider and bucket gets, from their counts alone (a number a provider and bucket).

    Recent targets come first, then the healthy quota, then maintenance in turns that start on another bucket each day,
    then what healthy ones are left; providers take turns throughout.
    """
    providers = sorted(budgets)
    left, got = dict(due), {key: 0 for key in due}
    used = dict.fromkeys(providers, 0)
    turn = {p: (day + i) % len(MAINTENANCE) for i, p in enumerate(providers)}

    def take(p: str, b: str) -> bool:
        if sum(used.values()) >= most or used[p] >= budgets[p] or not left.get((p, b), 0):
            return False
        left[p, b] -= 1
        got[p, b] += 1
        used[p] += 1
        return True

    def round_of(choose) -> None:
        while any([choose(p) for p in providers]):
            pass

    round_of(lambda p: take(p, "recent_activity"))
    round_of(lambda p: got.get((p, "healthy"), 0) < quotas.get(p, 0) and take(p, "healthy"))

    def maintain(p: str) -> bool:
        for k in range(len(MAINTENANCE)):
            at = (turn[p] + k) % len(MAINTENANCE)
            if take(p, MAINTENANCE[at]):
                turn[p] = (at + 1) % len(MAINTENANCE)
                return True
        return False

    round_of(maintain)
    round_of(lambda p: take(p, "healthy"))
    return got


def plan(targets: DataFrame, now: Column, day: int, most: int, budgets: dict[str, int], days: int) -> DataFrame:
    """Chosen targets in execution order: buckets in turn, within one the providers in turn, each in schedule order.

    Only counts a provider and bucket come to the driver; which targets are chosen follows from their ranks.
    """
    due = targets.withColumn("bucket", bucket(F.col("health"))).where(is_due(F.col("next_at"), now))
    counts = {(r["provider"], r["bucket"]): r for r in bucket_counts(targets, now).collect()}
    quotas = {}
    for p in budgets:
        healthy, recent = counts.get((p, "healthy")), counts.get((p, "recent_activity"))
        wanted = -(-(healthy["population"] if healthy else 0) // days)
        quotas[p] = min(healthy["due"] if healthy else 0, wanted, max(0, budgets[p] - (recent["due"] if recent else 0)))
    got = allot({key: r["due"] for key, r in counts.items()}, quotas, budgets, most, day)
    limits = targets.sparkSession.createDataFrame([(p, b, n) for (p, b), n in sorted(got.items()) if n] or [("", "", 0)], "provider string, bucket string, allotted int")
    chosen = schedule_rank(due, max(got.values(), default=0)).join(F.broadcast(limits), ["provider", "bucket"]).where("rank <= allotted")  # a row a provider and bucket
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return chosen.select("provider", "tenant", "bucket", "rank", F.struct(order, "rank", "provider").alias("turn"))


def lookback_start(last_success: Column, health: Column, now: Column, most_hours: int, overlap_hours: int, initial_hours: int) -> Column:
    """From when on a target is read; null (unbounded) for dead ones."""
    from vacancia.operators.health import hours

    asked = F.coalesce(hours(last_success, -overlap_hours), hours(now, -initial_hours))
    dead = F.coalesce(health.isin("suspected_dead", "confirmed_dead"), F.lit(False))
    return F.when(~dead, F.greatest(hours(now, -most_hours), asked))
