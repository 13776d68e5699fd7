"""Keyed state with timers: the whole state of tenants over a stream of results, and rows that end at a deadline.

Times are microseconds of UTC within the processors, so that they are the same numbers whatever the session's zone.
RocksDB must hold the state (``STATE_PROVIDER``); it spills, so the keys needn't fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vacancia.operators.health import Policy
from vacancia.operators.tenants import COUNTERS, RESULT, STATE, Values, prepared, step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KINDS = {"timestamp": "long"}
_STATE = ", ".join(f"{c} {_KINDS.get(t, t)}" for c, t in STATE.items())
_NEVER = {c: 0 if c in COUNTERS else [] if c == "recent_counts" else "healthy" if c == "health" else None for c in STATE}


def with_rocksdb(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """What ``run`` gives while the session's state provider is RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_PROVIDER)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _clean(row: dict[str, Any]) -> dict[str, Any]:
    """A row of pandas with Python's own numbers, and None for what is missing."""
    out = {}
    for name, value in row.items():
        if isinstance(value, list | tuple | np.ndarray):
            out[name] = [int(v) for v in value]
        elif pd.isna(value):
            out[name] = None
        elif isinstance(value, float):
            out[name] = int(value)  # a column of whole numbers with gaps
        else:
            out[name] = value.item() if hasattr(value, "item") else value
    return out


def _one(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows by time and sequence; most keys have one frame, and many one row."""
    found = list(frames)
    rows = found[0] if len(found) == 1 else pd.concat(found)
    return rows if len(rows) == 1 else rows.sort_values(["at", "sequence"])


def _out(row: dict[str, Any]) -> pd.DataFrame:
    return pd.DataFrame([list(row.values())], columns=list(row), dtype=object)


class TenantStates(StatefulProcessor):
    """The state of each tenant after all its results, in the order of their time and sequence.

    States of ``initial`` (tenant and the columns of ``STATE``) count as what was there before the first batch.
    """

    def __init__(self, policy: Policy, ttl_ms: int | None):
        self.policy, self.ttl_ms = policy, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tenant", _STATE, self.ttl_ms)

    def _known(self) -> dict[str, Any]:
        return _clean(dict(zip(STATE, self.state.get(), strict=True))) if self.state.exists() else dict(_NEVER)

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timer_values: Any) -> None:  # noqa: N802
        for row in initial.to_dict("records"):
            given = {c: v for c, v in _clean(row).items() if v is not None}
            self.state.update(tuple({**_NEVER, **given}[c] for c in STATE))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        found = _one(rows)
        state = self._known()
        for row in map(_clean, found.to_dict("records")):
            state = step(Values, state, row, row["at"], self.policy)
        self.state.update(tuple(state[c] for c in STATE))
        yield _out({"tenant": key[0], "results": len(found), **{c: state[c] for c in STATE}})

    def close(self) -> None:
        pass


def tenant_states(results: DataFrame, policy: Policy = Policy(), initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """After each micro-batch the state of the tenants in it: tenant, results (how many there were) and ``STATE``.

    ``results`` is a stream with tenant, at (the time of the result), sequence, and what ``tenants.tenant_step`` reads of a
    result. ``ttl_ms`` forgets tenants without a result for so long, by the clock; such a stream
    has batches without rows and runs until it is stopped.
    """
    at = F.unix_micros(F.col("at").cast("timestamp")).alias("at")
    rows = prepared(results).select("tenant", at, "sequence", *RESULT)
    before = None
    if initial is not None:
        before = initial.select("tenant", *[(F.unix_micros(F.col(c).cast("timestamp")) if t == "timestamp" else F.col(c).cast(t)).alias(c) for c, t in STATE.items() if c in initial.columns]).groupBy("tenant")
    found = rows.groupBy("tenant").transformWithStateInPandas(
        TenantStates(policy, ttl_ms), outputStructType=f"tenant string, results long, {_STATE}", outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None", initialState=before
    )
    return found.select("tenant", "results", *[(F.timestamp_micros(c) if t == "timestamp" else F.col(c)).alias(c) for c, t in STATE.items()])


class Deadlines(StatefulProcessor):
    """The newest row of each key; a timer at its deadline gives the key's later values."""

    def __init__(self, now_: tuple[str, ...], late: tuple[str, ...], schema: str):
        self.now_, self.late, self.schema = now_, late, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"at long, sequence long, deadline long, {self.schema}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        newest = _one(rows).iloc[[-1]].to_dict("records")[0]
        row = _clean({c: newest[c] for c in ("at", "sequence", "deadline")}) | {c: None if pd.isna(newest[c]) else newest[c] for c in (*self.now_, *self.late)}
        if self.held.exists() and tuple(self.held.get()[:2]) >= (row["at"], row["sequence"]):
            return  # older than what is known
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update(tuple(row.values()))
        if row["deadline"] is not None:
            self.handle.registerTimer(row["deadline"])
        yield _out({"key": key[0], "at": row["at"], "late": False, **{c: row[c] for c in self.now_}})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, sequence, deadline, *values = self.held.get()
        late = values[len(self.now_) :]
        self.held.update((at, sequence, None, *late, *late))
        yield _out({"key": key[0], "at": deadline * 1000, "late": True, **dict(zip(self.now_, late, strict=True))})

    def close(self) -> None:
        pass


def with_deadlines(rows: DataFrame, key: str, time: str, order: str, deadline: Column, columns: dict[str, Column], late: dict[str, Column], delay: str) -> DataFrame:
    """key, at, late and ``columns`` (strings) for each newest row of a key, and once its deadline is behind the watermark the
    key's values of ``late`` under the same names. A newer row of the key moves the deadline or, without one, ends it.

    ``rows`` is a stream; ``time`` is when a row was written and carries the watermark, ``order`` (a whole number) settles
    equal times. A row older than what is known of its key changes nothing.
    """
    names = {c: f"late_{c}" for c in columns}
    marked = rows.withWatermark(time, delay).select(
        F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).alias("at"), F.col(order).cast("long").alias("sequence"),
        # Timers are in whole milliseconds: up, so that none rings too early.
        F.ceil(F.unix_micros(deadline) / 1000).cast("long").alias("deadline"),
        *[e.cast("string").alias(c) for c, e in columns.items()], *[late[c].cast("string").alias(n) for c, n in names.items()],
    )
    texts = [f"{c} string" for c in columns]
    held = ", ".join([*texts, *[f"{n} string" for n in names.values()]])
    found = marked.groupBy("key").transformWithStateInPandas(
        Deadlines(tuple(columns), tuple(names.values()), held), outputStructType=", ".join(["key string, at long, late boolean", *texts]), outputMode="Update", timeMode="EventTime"
    )
    return found.select("key", F.timestamp_micros("at").alias("at"), "late", *columns)


def run_expiries(runs: DataFrame, queued_days: int = 14, grace_minutes: int = 10, pending_minutes: int = 0, delay: str = "1 hour") -> DataFrame:
    """key (the run), at, late, status and error_code of each run as it changes, and once its time is up as
    ``runs.expire`` would have it: Expired, or Failed for a pending one. ``runs``: a stream of run_id, changed_at, sequence,
    status, requested_at, lease_until, error_code."""
    status = F.col("status")
    # How long a run may be in a status, and the error code after that.
    waits = [("Queued", F.col("requested_at") + F.expr(f"INTERVAL '{queued_days}' DAY"), "QueueTTLExceeded"), ("Leased", F.col("lease_until") + F.expr(f"INTERVAL '{grace_minutes}' MINUTE"), "LeaseExpired")]
    if pending_minutes > 0:
        waits.append(("Pending", F.col("requested_at") + F.expr(f"INTERVAL '{pending_minutes}' MINUTE"), "PendingTooLong"))
    deadline, code = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    for name, end, why in waits:
        deadline, code = F.when(status == name, end).otherwise(deadline), F.when(status == name, F.lit(why)).otherwise(code)
    late = {"status": F.when(status == "Pending", "Failed").otherwise("Expired"), "error_code": F.coalesce("error_code", code)}
    # Later than its end, not at it: a millisecond on.
    return with_deadlines(runs, "run_id", "changed_at", "sequence", deadline + F.expr("INTERVAL '0.001' SECOND"), {"status": status, "error_code": F.col("error_code")}, late, delay)


def cooldowns(events: DataFrame, p: Policy = Policy(), delay: str = "1 hour") -> DataFrame:
    """key (the health partition), at, late, health and reason: a breaker's event starts a cooldown, which a later one draws
    out and which ends by itself. ``events``: a stream of health_partition, at, sequence, reason."""
    rows = events.withColumnRenamed("at", "opened_at")
    end = F.col("opened_at") + F.expr(f"INTERVAL '{p.breaker_cooldown_minutes}' MINUTE")
    reason = F.col("reason")
    return with_deadlines(rows, "health_partition", "opened_at", "sequence", end, {"health": F.lit("cooldown"), "reason": reason}, {"health": F.lit("healthy"), "reason": reason}, delay)
