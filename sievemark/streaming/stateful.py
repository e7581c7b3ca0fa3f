"""Streaming forms of the stateful operators. Each gives what its batch twin in ``operators.state`` gives over the same rows, in whatever
batches and order these arrive within the watermark (see ``ordered``).

State is keyed and bounded: one slot per session for monitoring, the last status per subscription, event ids within the
watermark for idempotence, one status per delivery key for as long as it may be retried, a lead's live tokens until they expire.
Checkpoints and state live where the query's ``checkpointLocation`` says; the state store must be RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions import urls
from ..operators import state as batch
from . import ordered

MONITOR_OUT = "session string, us bigint, tie bigint, url string, score int, eligible boolean, previous_score int, delta int, alert boolean"
SUBSCRIPTION_OUT = "subscription string, status string, customer string, lead_id string, place bigint"
DELIVERY_OUT = "delivery_key string, us bigint, tie bigint, event string, granted boolean, status string"
LEAD = StructType([StructField("website_url", StringType()), StructField("good", BooleanType())])
TOKEN = StructType([StructField("website_url", StringType()), StructField("exp", LongType())])
ACTIVE = StructType([StructField("active", BooleanType())])
TOKEN_OUT = "lead_id string, website_url string, exp bigint, active boolean, us bigint"


def watermarked(events: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Event time must be a TIMESTAMP; tables may hold it without a zone."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def deduplicated(events: DataFrame, key: str = "event_id", column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return watermarked(events, column, delay).dropDuplicatesWithinWatermark([key])


def _slot(key: tuple, last: tuple | None, row: dict) -> tuple[list[tuple], tuple]:
    score, ok = row["score"], bool(row["eligible"])
    same = bool(last and ok and last[2] and last[0] == row["url"])
    delta = score - last[1] if same else None
    alert = bool(ok and (score < 60 or (delta is not None and delta < 0)))
    return [(key[0], row["us"], row["tie"], row["url"], score, ok, last[1] if same else None, delta, alert)], (row["url"], score, ok)


def monitoring(history: DataFrame, tie: str | None = None) -> DataFrame:
    """Each audit with the session's one before it, once the watermark on ``at`` has passed it; ``tie`` orders audits of one time."""
    columns = {"url": F.col("url"), "score": F.col("score").cast("int"), "eligible": batch.eligible()}
    out = ordered.fold(history, "session", MONITOR_OUT, "url string, score int, eligible boolean", _slot, columns, tie=tie)
    return out.select("session", F.timestamp_micros("us").alias("at"), "tie", "url", "score", "eligible", "previous_score", "delta", "alert")


def _subscription(key: tuple, kept: tuple | None, row: dict) -> tuple[list[tuple], tuple]:
    status, customer, lead = kept or (None, None, None)
    lead = row["lead_id"] or lead
    new = "active" if row["type"] == "invoice.paid" else row["status"] or ("canceled" if row["type"] == "customer.subscription.deleted" else None)
    if row["type"] in batch.SUBSCRIPTION_EVENTS and new and (row["type"] != "invoice.paid" or lead):
        return [(key[0], new, row["customer"] or customer, lead, row["tie"])], (new, row["customer"] or customer, lead)
    return [], (status, customer, lead)


def subscription_states(events: DataFrame, time: str = "at") -> DataFrame:
    """A row for each event that changed a subscription, in order of event time and then ``ord``; a subscription's last row is its current state."""
    columns = {c: F.col(c) for c in ("type", "status", "customer", "lead_id")}
    return ordered.fold(events, "subscription", SUBSCRIPTION_OUT, "status string, customer string, lead_id string", _subscription, columns, time=time, tie="ord", mode="Update")


def _delivery(key: tuple, kept: tuple | None, row: dict) -> tuple[list[tuple], tuple | None]:
    event = row["event"]
    out = lambda granted, status: [(key[0], row["us"], row["tie"], event, granted, status)]
    if event == "reserve":
        granted = kept is None or kept[1] == "failed"
        status = "pending" if granted else kept[0]
        return out(granted, status), (status, event)
    return ([], None) if kept is None else (out(None, event), (event, event))


def deliveries(events: DataFrame, time: str = "at", life_seconds: int = batch.DELIVERY_SECONDS) -> DataFrame:
    """The delivery ledger as a stream of (delivery_key, event, at, ord): which reservations are granted, and each key's status."""
    out = ordered.fold(events, "delivery_key", DELIVERY_OUT, "status string, last_event string", _delivery, {"event": F.col("event")}, time=time, tie="ord", life=life_seconds * 1_000_000)
    return out.select("delivery_key", F.timestamp_micros("us").alias("at"), F.col("tie").alias("ord"), "event", "granted", "status")


class _Tokens(ordered.InOrder):
    """A lead as it stands, and its tokens until they expire."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.lead = handle.getValueState("lead", LEAD)
        self.tokens = handle.getMapState("tokens", TOKEN, ACTIVE)

    def _judged(self, key: tuple, token: tuple, us: int, known: bool | None) -> Iterator[tuple]:
        lead = self.lead.get() if self.lead.exists() else None
        active = bool(lead and lead[1] and lead[0] is not None and lead[0] == token[0])
        if active != known:
            self.tokens.updateValue(token, (active,))
            yield (key[0], *token, active, us)

    def due(self, key: tuple, row: dict) -> Iterator[tuple]:
        if row["exp"] is None:
            self.lead.update((row["website_url"], row["good"]))
            for token, (active,) in [(tuple(t), tuple(v)) for t, v in self.tokens.iterator()]:
                if token[1] * 1_000_000 > row["us"]:
                    yield from self._judged(key, token, row["us"], active)
        elif row["exp"] * 1_000_000 > row["us"]:
            token = (row["website_url"], row["exp"])
            yield from self._judged(key, token, row["us"], self.tokens.getValue(token)[0] if self.tokens.containsKey(token) else None)
        else:
            yield (key[0], row["website_url"], row["exp"], False, row["us"])

    def idle(self, key: tuple, now: int) -> Iterator[tuple]:
        for token, (active,) in [(tuple(t), tuple(v)) for t, v in self.tokens.iterator()]:
            if token[1] * 1_000_000 <= now:
                self.tokens.removeKey(token)
                if active:
                    yield (key[0], *token, False, token[1] * 1_000_000)

    def wake(self) -> int | None:
        return min((tuple(t)[1] * 1_000_000 for t in self.tokens.keys()), default=None)


def entitlements(events: DataFrame, time: str = "at") -> DataFrame:
    """A row whenever a token's ``active`` changes, and a last one when an active token expires.

    ``events``: lead_id, at, ord, website_url; a token has ``exp``, a lead's new state has none but subscription_status, price_locked and
    subscription_id. The batch twin is ``operators.state.entitlements`` with the leads as they last stood.
    """
    good = F.coalesce((F.col("subscription_status") == "active") & F.col("price_locked") & (F.coalesce("subscription_id", F.lit("")) != ""), F.lit(False))
    site = F.when(F.col("exp").isNull(), F.col("website_url")).otherwise(urls.with_scheme(F.col("website_url")))
    df, waiting = ordered.slim(events, "lead_id", time, "ord", website_url=site, good=good, exp=F.col("exp").cast("bigint"))
    out = StructType.fromDDL(TOKEN_OUT)
    return ordered.run(df, _Tokens(waiting, out), out, "Update").withColumn("at", F.timestamp_micros("us")).drop("us")


def upsert_into(path: str, key: tuple[str, ...], order: str):
    """A ``foreachBatch`` function that keeps the latest row per key as a log: each batch adds its own latest rows, a batch run again replaces them."""

    def write(frame: DataFrame, batch_id: int) -> None:
        batch.upserted(frame, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return write


def current(spark: SparkSession, path: str, key: tuple[str, ...], order: str) -> DataFrame:
    """The latest row per key of such a log."""
    return batch.upserted(spark.read.parquet(path).drop("batch"), key, order)


def windowed_counts(events: DataFrame, column: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events per type and window of event time, closed by the watermark."""
    return watermarked(events, column, delay).groupBy(F.window(column, width), "event_type").agg(F.count("*").alias("n"))
