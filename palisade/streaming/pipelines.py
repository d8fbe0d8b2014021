"""Structured Streaming: verdicts, windowed block rates, joins, and keyed state with timers for rate limits and approvals.

Keyed state needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.operators.approval import TTL
from palisade.operators.ratelimit import window_step
from palisade.operators.screen import screened
from palisade.operators.truth import TOOLS


def verdict_stream(stream: DataFrame, text: str, **options) -> DataFrame:
    """Stateless: one verdict per record."""
    return screened(stream, text, **options)


def block_rates(stream: DataFrame, ts: str, blocked: str, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests and blocks by window; records later than `late` are dropped by the watermark on a stream."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col(blocked)).alias("n_blocked")).select(F.col("w.start").alias("start"), "n", "n_blocked")


def sessions(stream: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def retained_stream(stream: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Records of a stream that are at most `days` old when they arrive; with a watermark of that age for what follows."""
    young = F.col(ts) >= F.current_timestamp() - F.make_dt_interval(F.lit(days))
    return stream.withWatermark(ts, f"{days} days").where(young)


def _millis(seconds: float) -> int:
    return math.ceil(seconds * 1000)


class RateLimiter(StatefulProcessor):
    """window_step() with its state kept per user; a timer frees it once neither a kept time nor a penalty matters any more."""

    def __init__(self, limit: int, window: float, block: float):
        self.limit, self.window, self.block = limit, window, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "times array<double>, blocked_until double, ends bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else None
        times, until, ends = (list(kept[0]), kept[1], kept[2]) if kept else ([], 0.0, 0)
        pdf = pd.concat(rows).sort_values(["ts", "event_id"])
        allowed = []
        for t in pdf["ts"]:
            ok, times, until = window_step(times, until, t.timestamp(), self.limit, self.window, self.block)
            allowed.append(ok)
        if ends:
            self.handle.deleteTimer(ends)
        ends = max(_millis(max([until, *(t + self.window for t in times)])), timerValues.getCurrentWatermarkInMs()) + 1
        self.handle.registerTimer(ends)
        self.state.update((times, until, ends))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "user_id": key[0], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"event_id": [], "user_id": [], "allowed": []}).astype({"event_id": "int64", "user_id": "int64", "allowed": "bool"})

    def close(self) -> None:
        pass


def rate_limit_stream(stream: DataFrame, limit: int = 60, window: float = 60.0, block: float = 300.0, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, allowed) of a stream of (event_id, user_id, ts); state of users who have gone quiet is freed."""
    return stream.select("event_id", "user_id", "ts").withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(
        RateLimiter(limit, window, block), outputStructType="event_id long, user_id long, allowed boolean", outputMode="Append", timeMode="EventTime")


class ApprovalTracker(StatefulProcessor):
    """The decision of one approval; emits each change of status, expiry by a timer included."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, requested double, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else (None, 0.0, None)
        status, requested, hash_ = kept[0], kept[1], kept[2]
        out = []
        order = {"request": 0, "approve": 1, "deny": 2, "execute": 3}
        for r in sorted(pd.concat(rows).itertuples(), key=lambda r: (r.ts, order.get(r.op, 9))):
            now, before = r.ts.timestamp(), status
            status, requested, hash_ = approval_step(status, requested, hash_, r.op, now, r.hash, self.ttl)
            if status != before:
                out.append((key[0], r.ts, status))
            if status == "pending" and before is None:
                self.handle.registerTimer(max(_millis(requested + self.ttl), timerValues.getCurrentWatermarkInMs()) + 1)
        self.state.update((status, requested, hash_))
        yield pd.DataFrame(out, columns=["approval_id", "ts", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What is open when its time is over has expired; what is settled stays, so that late events find it so."""
        status, requested, hash_ = self.state.get()
        rows = []
        if status in ("pending", "approved"):
            self.state.update(("expired", requested, hash_))
            rows = [(key[0], pd.Timestamp(requested + self.ttl, unit="s"), "expired")]
        yield pd.DataFrame(rows, columns=["approval_id", "ts", "status"])

    def close(self) -> None:
        pass


def approval_step(status: str | None, requested: float, hash_: str | None, op: str, now: float, hash_now: str, ttl: float) -> tuple[str | None, float, str | None]:
    """(status, time of request, parameters) after one event."""
    if status is None:
        return ("pending", now, hash_now) if op == "request" else (None, 0.0, None)
    if status == "pending" and op == "approve":
        return ("approved" if now <= requested + ttl else "expired"), requested, hash_
    if status == "pending" and op == "deny":
        return "denied", requested, hash_
    if status == "approved" and op == "execute" and now <= requested + ttl and hash_now == hash_:
        return "consumed", requested, hash_
    return status, requested, hash_


def approval_stream(events: DataFrame, ttl: float = TTL, late: str = "10 minutes") -> DataFrame:
    """(approval_id, ts, status) at each change, of a stream of (approval_id, ts, op, hash)."""
    return events.select("approval_id", "ts", "op", "hash").withWatermark("ts", late).groupBy("approval_id").transformWithStateInPandas(
        ApprovalTracker(ttl), outputStructType="approval_id string, ts timestamp, status string", outputMode="Append", timeMode="EventTime")


def verified_stream(answers: DataFrame, tools: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """answers (answer_id, session_id, ts) that a verifying tool in the same session, used at most `within` before, backs: a join of two streams."""
    used = tools.where(F.upper("tool_name").isin(*TOOLS)).select(F.col("session_id").alias("_session"), F.col("ts").alias("used_at")).withWatermark("used_at", late)
    near = (F.col("used_at") <= F.col("ts")) & (F.col("used_at") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    return answers.withWatermark("ts", late).join(used, (F.col("session_id") == F.col("_session")) & near).select("answer_id", "session_id", "ts", "used_at")
