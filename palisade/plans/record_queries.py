"""Queries over event histories and files: approvals, gates, files, security events, retention, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import approval as P
from palisade.operators import files as B
from palisade.operators import ratelimit as R
from palisade.operators import siem as E
from palisade.operators.adaptive import retained
from palisade.plans.registry import Registry, literal, read
from palisade.streaming import pipelines as W

REGISTRY = Registry()

_NTZ = "timestamp_ntz"


# -- approvals: orders are requests; decisions and executions follow from their keys --
def _approval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k, t0 = F.col("o_orderkey"), F.lit("2024-01-01").cast("timestamp")
    action = F.when(k % 2 == 0, "DEPLOY").otherwise("send_email")

    def event(op: str, seconds, keep, payload) -> DataFrame:
        ts = t0 + F.make_dt_interval(secs=(k % 1000 + seconds).cast("decimal(18,6)"))
        return o.where(keep).select(k.cast("string").alias("approval_id"), ts.alias("ts"), F.lit(op).alias("op"), action.alias("action"), payload.alias("payload"))

    p = F.col("o_orderstatus")
    return (
        event("request", F.lit(0), F.lit(True), p).unionByName(event("approve", k % 7 * 60 + 1, k % 3 != 0, p)).unionByName(event("deny", F.lit(200), k % 5 == 0, p))
        .unionByName(event("execute", F.lit(250), k % 4 == 1, F.when(k % 8 == 1, p).otherwise(F.lit("other"))))
    )


_APPROVALS = """WITH o AS (SELECT o_orderkey AS k, k % 1000 AS t, CASE WHEN k % 3 <> 0 THEN k % 7 * 60 + 1 END AS approve, CASE WHEN k % 5 = 0 THEN 200 END AS deny, CASE WHEN k % 4 = 1 THEN 250 END AS run, k % 8 = 1 AS same FROM orders),
d AS (SELECT *, CASE WHEN approve IS NOT NULL AND approve <= 300 AND (deny IS NULL OR approve <= deny) THEN 'approved' WHEN deny IS NOT NULL AND (approve IS NULL OR approve > deny) THEN 'denied' WHEN approve > 300 THEN 'expired' ELSE 'pending' END AS s FROM o),
approvals AS (SELECT CAST(k AS VARCHAR) AS approval_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * t AS requested_at, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (t + 300) AS expires_at,
  CASE WHEN s = 'approved' AND run >= approve AND same THEN 'consumed' WHEN s IN ('approved', 'pending') AND 1200 > t + 300 THEN 'expired' ELSE s END AS status FROM d)
"""


@REGISTRY(_APPROVALS + "SELECT approval_id, expires_at, status FROM approvals")
def approval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-01 00:20:00").cast("timestamp")
    return P.folded(_approval_events(spark, sf_dir), as_of).select("approval_id", F.col("expires_at").cast(_NTZ).alias("expires_at"), "status")


def _folded(spark: SparkSession, sf_dir: str):
    return P.folded(_approval_events(spark, sf_dir), F.lit("2024-01-01 00:20:00").cast("timestamp"))


@REGISTRY(_APPROVALS + "SELECT approval_id, expires_at FROM approvals WHERE status = 'pending' AND TIMESTAMP '2024-01-01 00:20:00' <= expires_at")
def open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.open_requests(_folded(spark, sf_dir), F.lit("2024-01-01 00:20:00").cast("timestamp"))
    return rows.select("approval_id", F.col("expires_at").cast(_NTZ).alias("expires_at"))


@REGISTRY(_APPROVALS + """SELECT count(*) FILTER (status = 'pending' AND TIMESTAMP '2024-01-01 00:20:00' <= expires_at) AS pending, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'denied') AS denied, count(*) AS total FROM approvals""")
def approval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.statistics(_folded(spark, sf_dir), F.lit("2024-01-01 00:20:00").cast("timestamp"))


@REGISTRY(_APPROVALS + "SELECT approval_id, status FROM approvals WHERE status <> 'expired' AND NOT (status <> 'pending' AND requested_at < TIMESTAMP '2024-01-02 00:08:00' - INTERVAL 1 DAY)")
def approval_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cleaned(_folded(spark, sf_dir), F.lit("2024-01-02 00:08:00").cast("timestamp")).select("approval_id", "status")


@REGISTRY(f"SELECT upper(event_type) AS action, list_contains({literal(P.HIGH_IMPACT)}, upper(event_type)) AS needs_approval, min(sha256(upper(event_type) || '|' || event_type)) AS first_hash, count(*) AS n FROM events GROUP BY ALL")
def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    rows = read(spark, sf_dir, "events").select(F.upper(e).alias("action"), P.needs_approval(e).alias("needs_approval"), P.parameter_hash(e, e).alias("h"))
    return rows.groupBy("action", "needs_approval").agg(F.min("h").alias("first_hash"), F.count("*").alias("n"))


# -- gates --
def _limits(events: str) -> str:
    """The state machine as a recursion over each user's requests: kept times and the end of the penalty travel along."""
    return f"""e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events}),
f AS (SELECT event_id, user_id, t, i, true AS allowed, CAST(NULL AS VARCHAR) AS reason, [t] AS kept, CAST(0 AS BIGINT) AS until FROM e WHERE i = 1
  UNION ALL SELECT event_id, user_id, t, i, t >= until AND len(young) < 3, CASE WHEN t < until THEN 'blocked' WHEN len(young) >= 3 THEN 'limit' END,
    CASE WHEN t < until THEN kept WHEN len(young) >= 3 THEN young ELSE list_append(young, t) END,
    CASE WHEN t < until THEN until WHEN len(young) >= 3 THEN t + 172800000000 ELSE 0 END
  FROM (SELECT e.event_id, e.user_id, e.t, e.i, f.kept, f.until, list_filter(f.kept, lambda x: e.t - x < 86400000000) AS young FROM e JOIN f ON e.user_id = f.user_id AND e.i = f.i + 1))"""


@REGISTRY(f"WITH RECURSIVE {_limits('events')} SELECT event_id, user_id, allowed, reason FROM f")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=3, window=86400.0, block=172800.0).select("event_id", "user_id", "allowed", "reason")


@REGISTRY("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, t, i, true AS allowed, t AS last FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.t, e.i, e.t - f.last >= 43200000000, CASE WHEN e.t - f.last >= 43200000000 THEN e.t ELSE f.last END FROM e JOIN f ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, allowed FROM f""")
def minimum_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rate_limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=1 << 40, interval=43200.0).select("event_id", "allowed")


def _known(events: DataFrame) -> DataFrame:
    return events.select("user_id").distinct().where("user_id % 2 = 0")


@REGISTRY("SELECT user_id % 2 = 0 AS admitted, count(*) AS n FROM events GROUP BY 1")
def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return R.admitted(events, "user_id", _known(events)).groupBy("admitted").agg(F.count("*").alias("n"))


@REGISTRY(f"""WITH RECURSIVE {_limits('(SELECT * FROM events WHERE user_id % 2 = 0)')}
SELECT event_id, user_id, allowed, reason FROM f UNION ALL SELECT event_id, user_id, false, 'identity' FROM events WHERE user_id % 2 <> 0""")
def request_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return R.gated(events, "user_id", "ts", "event_id", _known(events), limit=3, window=86400.0, block=172800.0).select("event_id", "user_id", "allowed", "reason")


# -- files: pages behind the first bytes of several kinds --
_HEADS = ["FFD8FFE1", "89504E470D0A1A0A", "474946383961", "5249464600000000574542505650", "424D", "25504446", "504B0304", "4D5A", "7F454C46", ""]
_NAMES = ["a.jpg", "b.png", "report.exe.gif", "d.webp", "../e.bmp", "f.pdf", "g.zip", "h.jpg", "i.pdf", "j.txt"]
_DECLARED = ["image/jpeg", "image/jpeg", "image/gif", "image/webp", "image/bmp", "application/pdf", "application/zip", "image/jpeg", "application/pdf", "text/plain"]
_TYPES = ["image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "application/pdf", "application/zip", "application/x-executable", "application/x-executable", "application/octet-stream"]


@REGISTRY(f"""WITH p AS (SELECT page_id, page_id % 10 + 1 AS k, {literal(_TYPES)}[page_id % 10 + 1] AS actual_type, {literal(_DECLARED)}[page_id % 10 + 1] AS declared FROM pages)
SELECT page_id, actual_type, k = 1 AS has_exif, CASE WHEN k = 3 THEN 'name_extension' WHEN k = 5 THEN 'name_path' WHEN actual_type = 'application/x-executable' THEN 'executable'
  WHEN NOT list_contains({literal(B.ALLOWED)}, actual_type) THEN 'type' WHEN actual_type <> declared THEN 'mismatch' END AS reason FROM p""")
def file_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("page_id") % 10 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), k)
    content = F.concat(F.unhex(pick(_HEADS)), F.encode("html", "UTF-8"))
    rows = read(spark, sf_dir, "pages").select("page_id", content.alias("content"), pick(_NAMES).alias("filename"), pick(_DECLARED).alias("declared_type"))
    return B.file_verdicts(rows).select("page_id", "actual_type", "has_exif", "reason")


# -- security events --
_TYPE_OF = "CASE event_id % 6 WHEN 0 THEN 'input_blocked' WHEN 1 THEN 'action_allowed' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'malware_syntax' WHEN 4 THEN 'integrity_violation' ELSE event_type END"
_SEV = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.SEVERITY.items()) + " ELSE 5 END"
_EVENTS = f"e AS (SELECT event_id, {_TYPE_OF} AS t, event_type, user_id, epoch_us(ts) // 1000 AS ms, props FROM events), s AS (SELECT *, {_SEV} AS severity FROM e)"
_LABEL = "CASE WHEN severity <= 2 THEN 'info' WHEN severity <= 4 THEN 'low' WHEN severity <= 6 THEN 'medium' WHEN severity <= 8 THEN 'high' ELSE 'critical' END"


def _security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    kind = F.when(k == 0, "input_blocked").when(k == 1, "action_allowed").when(k == 2, "rate_limited").when(k == 3, "malware_syntax").when(k == 4, "integrity_violation").otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", "ts", kind.alias("event_type"), F.col("event_type").alias("action_type"), F.col("props").alias("payload"), F.lit("screen").alias("component"), F.concat(F.lit("user|"), F.col("user_id").cast("string")).alias("reason"))
    return E.enriched(rows)


@REGISTRY(f"WITH {_EVENTS} SELECT t AS event_type, CAST(severity AS INTEGER) AS severity, {_LABEL} AS label, count(*) AS n FROM s GROUP BY ALL")
def security_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _security_events(spark, sf_dir).groupBy("event_type", "severity", "label").agg(F.count("*").alias("n"))


@REGISTRY(f"""WITH {_EVENTS} SELECT event_id, 'CEF:0|Palisade|Screen|1.0|' || t || '|user\\|' || user_id || '|' || severity || '|act=' || event_type || ' cs1=screen cs1Label=SourceComponent' ||
  CASE WHEN coalesce(props, '') <> '' THEN ' msg=' || substring(props, 1, 200) ELSE '' END || ' rt=' || ms AS line FROM s""")
def cef_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _security_events(spark, sf_dir).select("event_id", E.cef().alias("line"))


_JSON = f"""CAST(to_json({{'epoch_ms': ms, 'event_type': t, 'severity': severity, 'label': {_LABEL}, 'component': 'screen', 'action_type': event_type, 'payload': substring(props, 1, 500),
  'reason': 'user|' || user_id}}) AS VARCHAR)"""
_FIELDS = ("epoch_ms", "event_type", "severity", "label", "component", "action_type", "payload", "reason")


@REGISTRY(f"WITH {_EVENTS} SELECT event_id, {_JSON} AS line FROM s")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _security_events(spark, sf_dir).select("event_id", E.json_line(*_FIELDS).alias("line"))


@REGISTRY(f"WITH {_EVENTS} SELECT count(*) AS n_lines, CAST(sum(strlen({_JSON}) + 1) AS BIGINT) AS n_bytes FROM s")
def log_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.log_stats(_security_events(spark, sf_dir).select(E.json_line(*_FIELDS).alias("value")))


@REGISTRY("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'input_blocked' ELSE 'action_allowed' END AS event_type, CASE WHEN event_id % 6 = 0 THEN 7 ELSE 1 END AS severity,
  CASE WHEN event_id % 6 = 0 THEN 'high' ELSE 'info' END AS label, CASE WHEN event_id % 6 = 0 THEN 'too much' ELSE 'Action authorized.' END AS reason FROM events""")
def decision_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("action_type"), F.col("props").alias("payload"), F.lit("too much").alias("reason"))
    out = E.block_events(rows.where("event_id % 6 = 0"), "gate").unionByName(E.allow_events(rows.where("event_id % 6 <> 0"), "gate"))
    return out.select("event_id", "event_type", "severity", "label", "reason")


@REGISTRY("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(read(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00", 7).select("event_id", "ts")


@REGISTRY("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (event_id % 6 = 0) AS n_blocked FROM events GROUP BY 1")
def block_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("blocked", F.col("event_id") % 6 == 0)
    return W.block_rates(rows, "ts", "blocked", "1 hour")


@REGISTRY("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(read(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
