"""Streams over small files, run to their end."""

from pyspark.sql import functions as F

from vacancia.operators import runs, tenants
from vacancia.streaming import ingest, state


def test_deduplication(spark, tmp_path):
    rows = [(i, i % 3, "click", f"2024-01-01 00:00:{i:02d}") for i in range(9)]
    frame = spark.createDataFrame(rows, "event_id int, user_id int, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_events(spark, str(tmp_path / "in"), frame.schema, "*.parquet")
    got = ingest.to_table(ingest.deduplicated(stream, ["user_id"]).select("user_id"), f"file://{tmp_path}/out")
    assert sorted(r.user_id for r in got.collect()) == [0, 1, 2]


def test_folded_state(spark, tmp_path):
    rows = [(1, "a", "error"), (2, "a", "error"), (3, "a", "skipped"), (4, "a", "error"), (5, "b", "error"), (6, "b", "ok")]
    frame = spark.createDataFrame(rows, "sequence int, tenant string, status string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = ingest.to_table(ingest.fold_tenants(stream), f"file://{tmp_path}/out", "update")
    assert {(r.tenant, r.failures, r.seen, r.health) for r in got.collect()} == {("a", 3, 4, "suspected_dead"), ("b", 0, 2, "healthy")}


STEPS = [
    # sequence, day, tenant, status, error_class, http_status, jobs_returned, matched, listing_outcome
    *[(i, i, "a", "ok", None, None, 9, 1 if i == 2 else 0, "listing_ok") for i in range(1, 4)],
    (4, 4, "a", "ok", None, None, 0, 0, None),  # doubtful: a first empty listing
    (5, 5, "a", "skipped", None, None, 0, 0, None),
    (6, 6, "a", "ok", None, None, 0, 0, None),  # taken as such
    *[(i, i, "a", "ok", None, None, 0, 0, None) for i in range(7, 12)],  # long_empty in the end
    *[(20 + i, i, "b", "error", "http_4xx", 404, 0, 0, None) for i in range(1, 6)],  # suspected_dead, confirmed_dead
    (30, 1, "c", "error", "rate_limited", 429, 0, 0, None),
    (31, 2, "c", "error", "provider_anomaly", None, 3, 0, "listing_volume_anomaly"),
    (32, 3, "c", "error", "timeout", None, 0, 0, None),
    (40, 1, "d", "ok", None, None, 4, 2, "listing_ok"),  # active
    (41, 9, "d", "ok", None, None, None, None, "listing_ok"),  # a number that isn't known; no more active
    *[(50 + i, i, "e", "ok", None, None, i, 0, None) for i in range(1, 12)],  # the window of counts
    (70, 3, None, "error", "timeout", None, 0, 0, None),
]
STEP = "sequence int, day int, tenant string, status string, error_class string, http_status int, jobs_returned int, matched int, listing_outcome string"


def _folded(frame, before=None):
    """A step a day over all tenants: the states after the last one."""
    days = sorted({r.day for r in frame.select("day").collect()})
    state = before
    for day in days:
        today = frame.where(F.col("day") == day).drop("day", "sequence")
        rows = today if state is None else today.withColumnRenamed("tenant", "t").join(state, F.col("t").eqNullSafe(F.col("tenant")), "left").drop("tenant").withColumnRenamed("t", "tenant")
        stepped = tenants.next_states(rows, F.lit(f"2024-01-{day:02d}").cast("timestamp"))
        rest = None if state is None else state.join(today.select(F.col("tenant").alias("t")), F.col("t").eqNullSafe(F.col("tenant")), "left_anti")
        state = stepped if rest is None else stepped.unionByName(rest.select(*stepped.columns))
        kinds = ", ".join(f"{c} {t}" for c, t in {"tenant": "string", **tenants.STATE}.items())
        state = frame.sparkSession.createDataFrame([tuple(r) for r in state.collect()], kinds)
    return {r.tenant: tuple(r) for r in state.select("tenant", *tenants.STATE).collect()}


def _dated(frame):
    return frame.withColumn("at", F.make_timestamp(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0))).drop("day")


def test_tenants_of_a_stream_are_those_of_steps(spark, tmp_path):
    frame = spark.createDataFrame(STEPS, STEP)
    expected = _folded(frame)
    assert {expected[t][1] for t in "abcde"} == {"long_empty", "confirmed_dead", "temporarily_failed", "healthy"}
    assert [r.health for r in tenants.next_states(frame.where("sequence in (30, 40)").drop("day"), F.lit("2024-01-01").cast("timestamp")).orderBy("tenant").collect()] == ["cooldown", "active"]
    frame = _dated(frame)
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    # A restart from the checkpoint in between: the first days, then the others.
    for first, last in ((1, 4), (5, 31)):
        frame.where(F.dayofmonth("at").between(first, last)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frame.schema).parquet(folder)
        got = ingest.to_table(state.tenant_states(stream), out, "update")
    last = got.groupBy("tenant").agg(F.max_by(F.struct(*tenants.STATE), "batch").alias("s")).select("tenant", "s.*")
    assert {r.tenant: tuple(r) for r in last.collect()} == expected
    assert got.select("batch").distinct().count() == 2


def test_states_go_on_from_a_table(spark, tmp_path):
    frame = spark.createDataFrame(STEPS, STEP)
    kinds = ", ".join(f"{c} {t}" for c, t in {"tenant": "string", **tenants.STATE}.items())
    before = spark.createDataFrame(list(_folded(frame.where("day <= 4")).values()), kinds)
    rest = _dated(frame.where("day > 4 and tenant is not null"))
    rest.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rest.schema).parquet(str(tmp_path / "in"))
    got = ingest.to_table(state.tenant_states(stream, initial=before), f"file://{tmp_path}/out", "update")
    expected = _folded(frame)
    rows = {r.tenant: tuple(r) for r in got.select("tenant", *tenants.STATE).collect()}
    assert rows and rows == {t: expected[t] for t in rows}


def test_canaries_have_their_own_interval(spark):
    rows = [("a", "ok", 3, True, 6, "canary"), ("b", "ok", 3, False, 6, "priority"), ("c", "ok", 3, False, 24, "priority"), ("d", "ok", 3, True, None, "normal")]
    frame = spark.createDataFrame(rows, "tenant string, status string, jobs_returned int, health_only boolean, canary_hours int, target_class string").withColumns({"error_class": F.lit(None).cast("string"), "http_status": F.lit(None).cast("int")})
    got = tenants.next_states(frame, F.lit("2024-01-01").cast("timestamp")).orderBy("tenant").collect()
    assert [(r.health, int((r.next_at - r.last_attempt_at).total_seconds() // 3600)) for r in got] == [("healthy", 6), ("healthy", 6), ("healthy", 12), ("healthy", 72)]


def test_forgotten_tenants(spark, tmp_path):
    rest = _dated(spark.createDataFrame(STEPS[:3], STEP))
    rest.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rest.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = state.tenant_states(stream, ttl_ms=86_400_000).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/at").foreachBatch(lambda batch, _: seen.extend(batch.collect())).start()
    try:
        for _ in range(60):  # such a stream doesn't end by itself
            if seen or query.awaitTermination(1):
                break
    finally:
        query.stop()
    assert [(r.tenant, r.results, r.health) for r in seen] == [("a", 3, "active")]


RUNS = [
    # sequence, hours, run_id, status, requested hours, leased until hours, error_code
    (1, 0, 1, "Queued", 0, None, None),  # fourteen days on: Expired
    (2, 0, 2, "Leased", 0, 2, None),  # ten minutes after hour 2
    (3, 0, 3, "Leased", 0, 2, "EARLIER"),
    (4, 0, 4, "Leased", 0, 2, None),
    (5, 1, 4, "Succeeded", 0, 2, None),  # done before
    (6, 1, 5, "Pending", 1, None, None),
    (7, 1, 6, "Leased", 1, 2, None),
    (8, 1, 6, "Leased", 1, 900, None),  # drawn out
    (9, 400, 7, "Queued", 400, None, None),
    (10, 420, 8, "Succeeded", 420, None, None),
]


def test_runs_end_by_timers_as_in_batch(spark, tmp_path):
    start = F.lit("2024-01-01").cast("timestamp")
    plus = lambda c: start + F.make_dt_interval(F.lit(0), F.col(c))
    frame = spark.createDataFrame(RUNS, "sequence int, h int, run_id int, status string, r int, l int, error_code string")
    frame = frame.select("sequence", "run_id", "status", "error_code", plus("h").alias("changed_at"), plus("r").alias("requested_at"), plus("l").alias("lease_until"))
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for low, high in ((1, 8), (9, 9), (10, 10)):
        frame.where(F.col("sequence").between(low, high)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(frame.schema).parquet(folder)
        got = ingest.to_table(state.run_expiries(stream, pending_minutes=600, delay="1 hour"), out, "update")
    last = got.groupBy("key").agg(F.max_by(F.struct("status", "error_code"), F.struct("batch", "late")).alias("s"))
    newest = frame.groupBy("run_id").agg(F.max_by(F.struct("status", "error_code", "requested_at", "lease_until"), "sequence").alias("s")).select("run_id", "s.*")
    now = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(419))  # the watermark in the end
    expected = {(str(r.run_id), r.status, r.error_code) for r in runs.expire(newest, now, pending_minutes=600).collect()}
    assert {(r.key, r.s.status, r.s.error_code) for r in last.collect()} == expected
    assert {e[1:] for e in expected} >= {("Expired", "QueueTTLExceeded"), ("Expired", "LeaseExpired"), ("Expired", "EARLIER"), ("Failed", "PendingTooLong"), ("Succeeded", None), ("Leased", None), ("Queued", None)}


def test_cooldowns_end_by_themselves(spark, tmp_path):
    rows = [(1, 0, "a", "ratio"), (2, 0, "b", "rate"), (3, 30, "b", "transient"), (4, 200, "c", "rate")]
    frame = spark.createDataFrame(rows, "sequence int, m int, health_partition string, reason string")
    frame = frame.select("sequence", "health_partition", "reason", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"))).alias("at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = ingest.to_table(state.cooldowns(stream, delay="0 minutes"), f"file://{tmp_path}/out", "update").withColumn("m", (F.unix_seconds("at") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 60)
    assert {(r.key, r.health, r.reason, int(r.m)) for r in got.collect()} == {("a", "cooldown", "ratio", 0), ("b", "cooldown", "transient", 30), ("c", "cooldown", "rate", 200), ("a", "healthy", "ratio", 60), ("b", "healthy", "transient", 90)}
