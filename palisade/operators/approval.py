"""Human approval of high-impact actions, from a log of events (approval_id, ts, op, action, payload).

op is request, approve, deny or execute. Everything follows from the first request, the first valid decision and a matching execution, so the log is
aggregated twice by approval and joined with the small results; no approval's events are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import lexicon as L

# Actions that need approval.
HIGH_IMPACT = [
    "DEPLOY", "DELETE_FILE", "DROP_DATABASE", "MERGE_CODE", "TRANSFER_FUNDS", "MODIFY_ACCESS", "SEND_EMAIL", "PUBLISH", "EXECUTE_MIGRATION", "REVOKE_KEY",
    "SHUTDOWN", "RESTART", "ESCALATE_PRIVILEGES",
]
TTL = 300


def needs_approval(action: Column, high_impact=None) -> Column:
    return F.upper(action).isin(*(HIGH_IMPACT if high_impact is None else L.listed(high_impact)))


def parameter_hash(action: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.upper(action), F.lit("|"), payload), 256)


def folded(events: DataFrame, as_of: Column, ttl: int = TTL) -> DataFrame:
    """(approval_id, action, requested_at, expires_at, status) at as_of.

    Only a pending request can be approved, and only until it expires; a denial counts even later. An execution counts if the request is
    approved, not expired and the parameters are the same; it consumes the approval. Events at the same time count in the order request, approve, deny, execute.
    """
    e = events.withColumn("hash", parameter_hash(F.col("action"), F.col("payload")))
    first = e.where("op = 'request'").groupBy("approval_id").agg(F.min(F.struct("ts", "action", "hash")).alias("r"))
    rows = e.join(first, "approval_id").where(F.col("ts") >= F.col("r.ts"))
    expires = F.col("r.ts") + F.make_dt_interval(secs=F.lit(ttl))
    decision = F.when((F.col("op") == "deny") | ((F.col("op") == "approve") & (F.col("ts") <= expires)), F.struct("ts", F.when(F.col("op") == "approve", 0).otherwise(1).alias("deny")))
    # a late approve turns a pending request into an expired one, so later denials don't count
    late = F.when((F.col("op") == "approve") & (F.col("ts") > expires), F.col("ts"))
    decided = rows.groupBy("approval_id").agg(F.min(decision).alias("d"), F.min(late).alias("late"), F.first("r").alias("r"))
    valid = F.when(F.col("d").isNotNull() & (F.col("late").isNull() | (F.col("d.ts") <= F.col("late"))), F.col("d"))
    decided = decided.select("approval_id", F.col("r.action").alias("action"), F.col("r.ts").alias("requested_at"), F.col("r.hash").alias("hash"), expires.alias("expires_at"), "late", valid.alias("d"))
    runs = e.where("op = 'execute'").select("approval_id", F.col("ts").alias("run_at"), F.col("hash").alias("run_hash"))
    ran = runs.join(decided, "approval_id").where((F.col("d.deny") == 0) & (F.col("run_at") >= F.col("d.ts")) & (F.col("run_at") <= F.col("expires_at")) & (F.col("run_hash") == F.col("hash"))).select("approval_id").distinct().withColumn("ran", F.lit(True))
    out = decided.join(ran, "approval_id", "left")
    status = F.when(F.col("ran"), "consumed").when(F.col("d.deny") == 1, "denied").when(F.col("d.deny") == 0, F.when(F.lit(as_of) > F.col("expires_at"), "expired").otherwise("approved")).when(F.col("late").isNotNull() | (F.lit(as_of) > F.col("expires_at")), "expired").otherwise("pending")
    return out.select("approval_id", "action", "requested_at", "expires_at", status.alias("status"))


def cleaned(approvals: DataFrame, as_of: Column) -> DataFrame:
    """Without what was settled over a day ago or expired unsettled."""
    old = (F.col("status") != "pending") & (F.col("requested_at") < F.lit(as_of) - F.make_dt_interval(F.lit(1)))
    return approvals.where(~(old | (F.col("status") == "expired")))


def open_requests(approvals: DataFrame, as_of: Column) -> DataFrame:
    """Requests that still wait at as_of."""
    return approvals.where((F.col("status") == "pending") & (F.lit(as_of) <= F.col("expires_at")))


def statistics(approvals: DataFrame, as_of: Column) -> DataFrame:
    """One row: pending (not expired), approved, denied and total."""
    status = F.col("status")
    return approvals.agg(F.count_if((status == "pending") & (F.lit(as_of) <= F.col("expires_at"))).alias("pending"), F.count_if(status == "approved").alias("approved"), F.count_if(status == "denied").alias("denied"), F.count("*").alias("total"))
