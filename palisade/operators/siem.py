"""Security events: severities, CEF and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity of each event type; any other has 5.
SEVERITY = {
    "action_allowed": 1, "rate_limited": 3, "input_blocked": 7, "injection_detected": 7, "ethical_violation": 5, "code_exfiltration": 8, "integrity_violation": 10,
    "killswitch_activated": 10, "malware_syntax": 8, "privilege_violation": 10,
}


def severity(event_type: Column, table: dict[str, int] | None = None) -> Column:
    table = SEVERITY if table is None else table
    return F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), lambda k, _: k == event_type)), F.lit(0)), F.lit(5))


def severity_label(s: Column) -> Column:
    return F.when(s <= 2, "info").when(s <= 4, "low").when(s <= 6, "medium").when(s <= 8, "high").otherwise("critical")


def enriched(df: DataFrame) -> DataFrame:
    """Events (ts, event_type, action_type, payload, component, reason, ...) with severity, label, epoch_ms and a payload of 500 characters."""
    out = df.withColumn("severity", severity(F.col("event_type"))).withColumn("label", severity_label(F.col("severity")))
    return out.withColumn("epoch_ms", F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))).withColumn("payload", F.substring("payload", 1, 500))


def block_events(df: DataFrame, component: str, action: str = "action_type", reason: str = "reason") -> DataFrame:
    """df as events of blocked actions, enriched."""
    return enriched(df.select("*").withColumns({"event_type": F.lit("input_blocked"), "component": F.lit(component), "action_type": F.col(action), "reason": F.col(reason)}))


def allow_events(df: DataFrame, component: str, action: str = "action_type", reason: str = "Action authorized.") -> DataFrame:
    """df as events of allowed actions, enriched."""
    return enriched(df.select("*").withColumns({"event_type": F.lit("action_allowed"), "component": F.lit(component), "action_type": F.col(action), "reason": F.lit(reason)}))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def cef(vendor: str = "Palisade", product: str = "Screen", version: str = "1.0") -> Column:
    """The CEF line of an enriched event; header fields are escaped, extensions as they are."""
    parts = [
        F.when(F.col("action_type") != "", F.concat(F.lit("act="), "action_type")), F.when(F.col("component") != "", F.concat(F.lit("cs1="), "component", F.lit(" cs1Label=SourceComponent"))),
        F.when(F.col("payload") != "", F.concat(F.lit("msg="), F.substring("payload", 1, 200))), F.concat(F.lit("rt="), F.col("epoch_ms").cast("string")),
    ]
    name = _escaped(F.substring(F.coalesce("reason", "event_type"), 1, 200))
    head = F.concat_ws("|", F.lit("CEF:0"), _escaped(F.lit(vendor)), _escaped(F.lit(product)), _escaped(F.lit(version)), "event_type", name, F.col("severity").cast("string"))
    return F.concat(head, F.lit("|"), F.concat_ws(" ", *parts))


def json_line(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_lines(df: DataFrame, line: Column, path: str, bytes_per_file: int = 50 << 20) -> None:
    """Appends lines as text; files are rotated at about so many bytes, by the lines' mean length."""
    lines = df.select(line.alias("value"))
    mean = lines.agg(F.avg(F.octet_length("value") + 1)).first()[0] or 1
    lines.write.mode("append").option("maxRecordsPerFile", max(1, int(bytes_per_file // mean))).text(path)


def log_stats(lines: DataFrame) -> DataFrame:
    """Lines and bytes of a log."""
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))
