"""Request gates per user: identity list, sliding window with a penalty box, and a minimum interval.

The transitions are plain functions shared by the batch fold here and the processor in palisade.streaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_step(times: list[float], blocked_until: float, now: float, limit: int, window: float, block: float) -> tuple[bool, list[float], float]:
    """(allowed, kept times, blocked until) after a request at `now`; denied requests aren't recorded."""
    if now < blocked_until:
        return False, times, blocked_until
    kept = [t for t in times if now - t < window]
    if len(kept) >= limit:
        return False, kept, now + block
    return True, [*kept, now], 0.0


def interval_step(last: float, now: float, interval: float) -> tuple[bool, float]:
    """(allowed, time of the last allowed request)."""
    return (False, last) if now - last < interval else (True, now)


def admitted(df: DataFrame, user: str, users: list | DataFrame | None) -> DataFrame:
    """df with admitted: whether the user is on the list (values, or the first column of a DataFrame); none admits everyone."""
    if users is None:
        return df.withColumn("admitted", F.lit(True))
    if isinstance(users, DataFrame):
        known = users.select(F.col(users.columns[0]).alias("_user")).distinct().withColumn("admitted", F.lit(True))
        return df.join(known, F.col(user) == F.col("_user"), "left").drop("_user").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
    return df.withColumn("admitted", F.coalesce(F.col(user).isin(*users), F.lit(False)))


def gated(df: DataFrame, user: str, ts: str, key: str, users: list | DataFrame | None = None, **limits) -> DataFrame:
    """(key, user, ts, allowed, reason): the identity list first, then rate limits, which only admitted requests use up."""
    rows = admitted(df.select(key, user, ts), user, users)
    refused = rows.where(~F.col("admitted")).select(key, user, ts, F.lit(False).alias("allowed"), F.lit("identity").alias("reason"))
    return refused.unionByName(rate_limited(rows.where("admitted").drop("admitted"), user, ts, key, **limits))


def rate_limited(df: DataFrame, user: str, ts: str, key: str, limit: int = 60, window: float = 60.0, block: float = 300.0, interval: float = 0.0) -> DataFrame:
    """(key, user, ts, allowed, reason) of every request with a user, in order of (ts, key) per user.

    A user's requests are read as a stream of batches sorted by Spark, so a user with a third of all requests needs memory
    for one batch and `limit` times only. They are dealt by a hash of the user: a repartition by the user itself is dropped over a
    join on the user, whose own exchange adaptive execution may then read map by map, which splits users.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, {user} {dict(df.dtypes)[user]}, {ts} timestamp, allowed boolean, reason string"
    rows = df.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(key, user, ts)
    rows = rows.repartition(F.xxhash64(user)).sortWithinPartitions(user, ts, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, times, until, last = object(), [], 0.0, float("-inf")
        for pdf in batches:
            allowed, reasons = [], []
            for u, t in zip(pdf[user], pdf[ts].astype("int64").to_numpy() / (1e9 if pdf[ts].dtype == "datetime64[ns]" else 1e6), strict=True):
                if u != who:
                    who, times, until, last = u, [], 0.0, float("-inf")
                was = until
                ok, times, until = window_step(times, until, t, limit, window, block)
                reason = None if ok else ("blocked" if t < was else "limit")
                if ok and interval:
                    ok, last = interval_step(last, t, interval)
                    reason = None if ok else "interval"
                    if not ok:
                        times.pop()
                allowed.append(ok)
                reasons.append(reason)
            yield pdf.assign(allowed=allowed, reason=reasons)

    return rows.mapInPandas(run, schema)
