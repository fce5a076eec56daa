"""Delivery ledger: what became of every operation sent to the index."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RETRY_SECONDS = 60
#: How long a settled operation keeps its answer after its last attempt.
SETTLED_SECONDS = 7 * 24 * 3600


def outcome(code: Column | str) -> Column:
    """done for 2xx, failed for 4xx, pending for anything else and for no answer."""
    code = F.col(code) if isinstance(code, str) else code
    return (
        F.when(code.between(200, 299), "done").when(code.between(400, 499), "failed").otherwise("pending")
    )


def ledger_state(ops: DataFrame, attempts: DataFrame) -> DataFrame:
    """Status per operation: pending until its first final answer, which then stands for good.

    ``ops`` has op_id and the delivery columns; ``attempts`` has op_id, attempt_ts and http_code.
    """
    state = attempt_state(attempts).withColumnRenamed("status", "_status")
    return (
        ops.join(state, "op_id", "left")
        .withColumn("status", F.coalesce("_status", F.lit("pending")))
        .withColumn("attempts", F.coalesce("attempts", F.lit(0)).cast("long"))
        .drop("_status")
    )


def attempt_state(attempts: DataFrame) -> DataFrame:
    """op_id, status, attempts, last_error from the attempts alone.

    Works on a table and, in update mode, on a stream. The first final attempt is found by a
    minimum, so an operation with very many attempts is combined before the shuffle.
    """
    kind = outcome("http_code")
    final = F.when(kind != "pending", F.struct("attempt_ts", kind.alias("status"), "http_code"))
    per_op = attempts.groupBy("op_id").agg(
        F.min(final).alias("f"), F.count(F.lit(1)).alias("attempts")
    )
    failed = F.col("f")["status"] == "failed"
    return per_op.select(
        "op_id",
        F.coalesce(F.col("f")["status"], F.lit("pending")).alias("status"),
        "attempts",
        F.when(failed, F.concat(F.lit("HTTP "), F.col("f")["http_code"].cast("string"))).alias("last_error"),
    )


def replay(state: DataFrame) -> DataFrame:
    """Operations still to be delivered, oldest first."""
    return state.where("status = 'pending'").orderBy("op_id")


_OUTPUT = "op_id long, status string, attempts long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Delivery(StatefulProcessor):
    """One operation: a count while it is pending, its answer for some time once it is settled.

    With ``retry_ms`` time is the clock's: a timer asks for retries, the state store drops settled answers by their
    age. Without, time is the attempts': a timer drops a settled answer once the watermark has passed it.
    """

    def __init__(self, retry_ms: int | None, settled_ms: int):
        self.retry_ms, self.settled_ms = retry_ms, settled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempts long")
        age = None if self.retry_ms is None else self.settled_ms
        self.settled = handle.getValueState("settled", "status string, attempts long, final_us long, last_us long", age)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Every call to the state is a message to the JVM: none is made whose answer is known.
        before = self.settled.get()
        pending = self.open.get() if before is None else None
        status, attempts, final_us, last_us = before or ("pending", pending[0] if pending else 0, None, 0)
        first = None
        for row in rows:
            attempts += 1
            at_us = row["at_us"]
            if at_us is None:
                continue
            last_us = max(last_us, at_us)
            if row["outcome"] != "pending":
                answer = (at_us, row["outcome"])
                first = answer if first is None else min(first, answer)
        if first is not None and (final_us is None or first[0] < final_us):
            final_us, status = first
        if status == "pending":
            self.open.update((attempts,))
            if self.retry_ms is not None and pending is None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
        else:
            # A settled operation leaves no pending state and no earlier timer behind.
            if pending is not None:
                self.open.clear()
            if before is not None or (pending is not None and self.retry_ms is not None):
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            self.settled.update((status, attempts, final_us, last_us))
            if self.retry_ms is None:
                self.handle.registerTimer(last_us // 1000)
        yield Row(op_id=key[0], status=status, attempts=attempts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.retry_ms is None:
            self.settled.clear()
        elif self.open.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
            yield Row(op_id=key[0], status="retry", attempts=self.open.get()[0])

    def close(self) -> None:
        pass


def ledger_stream(
    attempts: DataFrame, retry_seconds: int | None = RETRY_SECONDS, settled_seconds: int = SETTLED_SECONDS
) -> DataFrame:
    """Status changes of operations as attempts arrive, and ``retry`` when a pending one is due again.

    Retries are timers on the clock and keep a query alive for good; pass None for a run that ends with its input.
    Attempts are read one by one; an operation sends the state a few messages, whatever its attempts. A pending operation
    holds one number; once it is settled that and its timer go, and its first final answer stands for ``settled_seconds``
    after its last attempt, by the clock or, without retries, by the times of the attempts: then an attempt that is older
    than that beside the newest one is too late to count. Afterwards the answer leaves the state, and an attempt would be
    one of a new operation. Output mode ``update``; the state lies in RocksDB, which is set in the session.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    at = F.col("attempt_ts").cast("timestamp")
    answers = attempts.select(
        F.col("op_id").cast("long").alias("op_id"), outcome("http_code").alias("outcome"), F.unix_micros(at).alias("at_us"),
        at.alias("at"),
    )
    clock = retry_seconds is not None
    timed = answers.drop("at") if clock else answers.withWatermark("at", f"{int(settled_seconds)} seconds")
    tracker = _Delivery(int(retry_seconds * 1000) if clock else None, int(settled_seconds * 1000))
    return timed.groupBy("op_id").transformWithState(
        tracker, _OUTPUT, "Update", "processingTime" if clock else "eventTime")
