"""Keyed state with timers and expiry: retries and leases of jobs, revoked tokens; reviews as a join of two streams, and
memories taken once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweave.functions import text as fx
from docweave.operators import conversation

#: The state store that timers and expiring state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Retries(StatefulProcessor):
    """Jobs that fail wait longer each time and are due again when their timer fires; after ``most`` failures in a row a job is
    failed for good. Emits every change of status."""

    SCHEMA = "job_id long, at long, status string, failures int"

    def __init__(self, most: int, base: float, cap: float) -> None:
        self.most, self.base, self.cap = most, base, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "failures int, status string, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        failures, status, due = self.state.get() if self.state.exists() else (0, "new", 0)
        for r in sorted(rows, key=lambda r: (r["at"], r["n"])):
            if status == "failed":
                break
            if status == "retry" and due <= r["at"]:  # what the timer would have said by now
                status = "pending"
                yield Row(job_id=key[0], at=due, status=status, failures=failures)
            if r["failed"]:
                failures += 1
                status = "failed" if failures >= self.most else "retry"
                due = r["at"] + int(1000 * min(self.base * 2 ** (failures - 1), self.cap))
            else:
                failures, status = 0, "done"
            yield Row(job_id=key[0], at=r["at"], status=status, failures=failures)
        self.state.update((failures, status, due))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status == "retry":
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        failures, status, due = self.state.get()
        if status == "retry" and due == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((failures, "pending", due))
            yield Row(job_id=key[0], at=due, status="pending", failures=failures)


class Leases(StatefulProcessor):
    """A claim holds its key until its lease is over; claims that come before that are refused. The timer gives the lease back."""

    SCHEMA = "job_id long, at long, claim long, status string"

    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "claim long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        held = self.state.get() if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["claim"])):
            if held and held[1] <= r["at"]:
                yield Row(job_id=key[0], at=held[1], claim=held[0], status="expired")
                held = None
            if held is None:
                held = (r["claim"], r["at"] + self.lease_ms)
                yield Row(job_id=key[0], at=r["at"], claim=r["claim"], status="granted")
            else:
                yield Row(job_id=key[0], at=r["at"], claim=r["claim"], status="refused")
        self.state.update(held)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(held[1])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.state.exists() and self.state.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            claim, until = self.state.get()
            self.state.clear()
            yield Row(job_id=key[0], at=until, claim=claim, status="expired")


class Revocations(StatefulProcessor):
    """Revoked tokens by user, each until its life is over. Checks come out with the answer; a revocation that does not say how
    long the token lives holds for the longest life. An entry leaves the state by a timer behind the watermark, or, where the
    clock rules (``by_clock``), by the map's own time to live."""

    SCHEMA = "user_id long, token long, at long, revoked boolean"

    def __init__(self, life_ms: int, by_clock: bool) -> None:
        self.life_ms, self.by_clock = life_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.revoked = handle.getMapState("revoked", "token long", "until long", self.life_ms if self.by_clock else None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        for r in sorted(rows, key=lambda r: (r["at"], not r["revoke"])):  # a revocation of the same moment counts
            token = (r["token"],)
            if r["revoke"]:
                until = r["until"] if r["until"] is not None else r["at"] + self.life_ms
                self.revoked.updateValue(token, (until,))
                if not self.by_clock:
                    self.handle.registerTimer(until)
            else:
                found = self.revoked.getValue(token) if self.revoked.containsKey(token) else None
                yield Row(user_id=key[0], token=r["token"], at=r["at"], revoked=found is not None and r["at"] < found[0])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        for token in [token for token, (until,) in self.revoked.iterator() if until <= now]:
            self.revoked.removeKey(token)
        return iter(())


def _keyed(events: DataFrame, key: str, processor: StatefulProcessor, delay: str | None, event_time: str = "ts") -> DataFrame:
    """With a delay, timers go by event time behind the watermark; without one by the clock."""
    use_store(events.sparkSession)
    if delay:
        events = events.withWatermark(event_time, delay)
    return events.groupBy(key).transformWithState(processor, processor.SCHEMA, "append", "EventTime" if delay else "ProcessingTime")


def retries(events: DataFrame, delay: str | None = "1 hour", most: int = 5, base: float = 5.0, cap: float = 300.0) -> DataFrame:
    """Changes of status (job_id, at in milliseconds, status, failures) of a stream of (job_id, n, ts, at, failed)."""
    return _keyed(events, "job_id", Retries(most, base, cap), delay)


def leases(claims: DataFrame, lease_seconds: int, delay: str | None = "1 hour") -> DataFrame:
    """What becomes of each claim (job_id, at, claim, status) of a stream of (job_id, ts, at, claim)."""
    return _keyed(claims, "job_id", Leases(1000 * lease_seconds), delay)


def revocations(events: DataFrame, life_seconds: int, delay: str | None = "1 hour") -> DataFrame:
    """Answers to checks of a stream of (user_id, token, ts, at, revoke, until). Without a delay state expires by the clock; such
    a stream runs on until it is stopped."""
    return _keyed(events, "user_id", Revocations(1000 * life_seconds, not delay), delay)


def reviews(asked: DataFrame, decided: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Review requests (review, thread, asked_at) with the decisions (decision, decided_for, decided_at) on their thread within
    a time: a join of two streams with watermarks on both, so that a request that nobody decided comes out once no
    decision can come in time any more. Requests that may still be decided are not out yet."""
    a, d = asked.withWatermark("asked_at", delay), decided.withWatermark("decided_at", delay)
    in_time = (F.col("thread") == F.col("decided_for")) & (F.col("decided_at") >= F.col("asked_at")) & (F.col("decided_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    return a.join(d, in_time, "left_outer").select("review", "thread", "asked_at", "decision", "decided_at")


def review_status(asked: DataFrame, out: DataFrame) -> DataFrame:
    """Where each request stands by what the join has given out so far: resumed (by its first decision), timed_out or pending."""
    first = out.groupBy("review").agg(F.min_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    met = asked.join(first.withColumn("__out", F.lit(True)), "review", "left")
    status = F.when(F.col("__out").isNull(), "pending").when(F.col("decision").isNull(), "timed_out").otherwise("resumed")
    return met.select("review", "thread", "decision", status.alias("status"))


def memories(messages: DataFrame, text: Column, delay: str = "1 day") -> DataFrame:
    """Explicit memories of a stream of user messages (conv_id, turn, at), each taken once for a conversation: equal ones
    (case and white space aside) that come within the delay are dropped."""
    m = messages.withColumn("m", conversation.memory(text)).filter("m is not null").select("conv_id", "turn", "at", "m.kind", "m.content")
    keyed = m.withColumn("key", fx.squeeze(F.col("content"))).withWatermark("at", delay)
    return keyed.dropDuplicatesWithinWatermark(["conv_id", "key"])
