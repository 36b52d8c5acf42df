"""The job ledger on streams: keyed state applies the rules of `operators.ledger` message by message.

Each operator keeps one value for a key in Spark's state store and gives a row for
each message that it takes, so a stream over any number of micro-batches gives
what the batch operator gives over the whole table, as long as the messages of a
key come in order from batch to batch (within a batch they are put in order).
Messages of one key within one batch are held in memory: maxFilesPerTrigger or
maxBytesPerTrigger at the source bound them.

Retention is counted in event time, by timers behind the watermark. A stream
whose source has ended ends then as well, and a replay forgets the same keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from leafwise.operators.ledger import MOVES, TERMINAL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store; queries started after this use it."""
    spark.conf.set(PROVIDER, ROCKS)


class Timed(StatefulProcessor):
    """State of one value (`schema`) that is given up `retention_s` after the last message in event time (None: never).

    Rows carry their event time in milliseconds in the last place (NULL where it plays no part).
    """

    schema = ""
    #: Names of the columns that go out.
    names: list[str]

    def __init__(self, order: str, retention_s: int | None) -> None:
        self.order, self.retention_s = order, retention_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.row = Row(*self.names)

    def ordered(self, rows: Iterator[Row]) -> list[Row]:
        return sorted(rows, key=lambda r: r[self.order])

    def renew(self, rows: list[Row]) -> None:
        """Count retention anew from the last of `rows`."""
        if self.retention_s is None:
            return
        self.still()
        self.handle.registerTimer(max(r[-1] for r in rows) + self.retention_s * 1000)

    def still(self) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class Fence(Timed):
    """Keeps the newest generation of a job; older messages give no row."""

    schema = "newest long"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        newest = self.held.get()[0] if self.held.exists() else None
        taken = self.ordered(rows)
        for r in taken:
            if newest is None or r["generation"] >= newest:
                newest = r["generation"]
                yield self.row(*r[:-1])
        self.held.update((newest,))
        self.renew(taken)


class Create(Timed):
    """Keeps the fingerprint of a key's first request; each request gives a row with its outcome."""

    schema = "fingerprint string"

    def __init__(self, order: str, retention_s: int | None, fingerprint: str) -> None:
        super().__init__(order, retention_s)
        self.fingerprint = fingerprint

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = self.held.get()[0] if self.held.exists() else None
        known = self.held.exists()
        taken = self.ordered(rows)
        for r in taken:
            own = r[self.fingerprint]
            if not known:
                known, first = True, own
                self.held.update((own,))
                outcome = "created"
            else:
                outcome = "same" if own is not None and own == first else "conflict"
            yield self.row(*r[:-1], outcome)
        self.renew(taken)


class Moves(Timed):
    """Keeps a job's state; legal moves are applied, others are told. A job in a final state becomes a tombstone after the retention, and is forgotten after another."""

    schema = "state string"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = self.held.get()[0] if self.held.exists() else None
        taken = self.ordered(rows)
        for r in taken:
            to = r["state"]
            legal = to == "PENDING" if now is None else to == now or to in MOVES.get(now, ())
            yield self.row(key[0], r[self.order], r[-1], now, to, legal)
            now = to if legal else now
        if now is not None:
            self.held.update((now,))
            if now in TERMINAL:
                self.renew(taken)
            elif self.retention_s is not None:
                self.still()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state, due = self.held.get()[0], expiredTimerInfo.getExpiryTimeInMs()
        if state == "EXPIRED":
            self.held.clear()
            return
        self.held.update(("EXPIRED",))
        self.handle.registerTimer(due + self.retention_s * 1000)
        yield self.row(key[0], None, due, state, "EXPIRED", True)


def _kept(messages: DataFrame, key: str, processor: Timed, schema: StructType, ts: str | None, watermark: str) -> DataFrame:
    state_store(messages.sparkSession)
    processor.names = schema.names
    if processor.retention_s is not None:
        if ts is None:
            raise ValueError("retention is counted in event time: ts must name its column")
        messages = messages.withWatermark(ts, watermark)
    timed = messages.withColumn("_ms", F.unix_millis(ts) if ts else F.lit(None).cast("long"))
    return timed.groupBy(key).transformWithState(processor, schema, "append", "none" if processor.retention_s is None else "eventTime")


def fenced(messages: DataFrame, *, key: str = "job_id", order: str = "seq", ts: str | None = None, retention_s: int | None = None, watermark: str = "1 day") -> DataFrame:
    """The messages (job_id, generation, ...) that are not late: none of an older generation than the newest seen before them.

    With `ts` and `retention_s` a job is forgotten so long after its last message.
    """
    return _kept(messages, key, Fence(order, retention_s), messages.schema, ts, watermark)


def created(requests: DataFrame, *, key: str = "key", order: str = "ts", fingerprint: str = "fingerprint", ts: str | None = None, retention_s: int | None = None, watermark: str = "1 day") -> DataFrame:
    """`requests` with outcome: created (the first of its key), same (equal fingerprint) or conflict; nothing is swallowed."""
    schema = requests.withColumn("outcome", F.lit("")).schema
    return _kept(requests, key, Create(order, retention_s, fingerprint), schema, ts, watermark)


def moved(messages: DataFrame, *, key: str = "job_id", order: str = "seq", ts: str | None = None, retention_s: int | None = None, watermark: str = "1 day") -> DataFrame:
    """job_id, seq, ts, before, state, applied: every message with the state it met and whether its move is legal; and tombstones (seq NULL)."""
    kinds = dict(messages.dtypes)
    schema = StructType.fromDDL(f"{key} {kinds[key]}, {order} {kinds[order]}, ms long, before string, state string, applied boolean")
    out = _kept(messages, key, Moves(order, retention_s), schema, ts, watermark)
    return out.select(key, order, F.timestamp_millis("ms").alias("ts"), "before", "state", "applied")


def latest(messages: DataFrame) -> DataFrame:
    """job_id, state, n_messages: a running aggregate for update or complete output."""
    return messages.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("n_messages"))


def write_split(stream: DataFrame, path: str, outputs: dict[str, str], *, checkpoint: str, name: str = "split") -> StreamingQuery:
    """Start writing `stream` to several tables under `path`: `outputs` maps a table's name to the condition of its rows.

    A batch writes a folder of its own in each table and replaces it when it is
    done again, so a replay after a failure leaves each row once. Ends with its
    source (availableNow).
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for table, condition in outputs.items():
                held.filter(condition).write.mode("overwrite").parquet(f"{path}/{table}/stream={name}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(outbox: DataFrame, path: str, send: Callable[[DataFrame, str], None], *, checkpoint: str, name: str = "outbox") -> StreamingQuery:
    """Start handing over the messages (job_id, generation, ...) of `outbox`, each batch under an id of its own.

    Before a batch is sent, its claims are written (its messages are `uncertain`
    from then on), behind it its receipts (`published`). `send(rows, id)` must
    replace what was sent under the same id; Spark gives a batch that failed
    anywhere between the same rows and number again, so a message that was sent
    without a receipt is not there twice afterwards.
    """

    def hand_over(batch: DataFrame, number: int) -> None:
        at = f"stream={name}/batch={number}"
        own = batch.select("job_id", "generation").distinct()
        own.write.mode("overwrite").parquet(f"{path}/claims/{at}")
        send(batch, f"{name}-{number}")
        own.sparkSession.read.schema(own.schema).parquet(f"{path}/claims/{at}").write.mode("overwrite").parquet(f"{path}/receipts/{at}")

    return outbox.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
