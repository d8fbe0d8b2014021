"""File screening over binary columns: type by first bytes, size, name, declared type and EXIF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes (hex) and their types; what is allowed; extensions that may not stand before the last.
SIGNATURES = [
    ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("52494646", "image/webp"),
    ("424D", "image/bmp"), ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("4D5A", "application/x-executable"), ("7F454C46", "application/x-executable"),
    ("FEEDFA", "application/x-executable"), ("CFFAEDFE", "application/x-executable"),
]
ALLOWED = ["image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "application/pdf"]
DANGEROUS = [
    "exe", "bat", "cmd", "com", "msi", "scr", "pif", "sh", "bash", "ps1", "vbs", "js", "ws", "wsf", "dll", "sys", "drv", "cpl", "py", "rb", "pl", "php",
]
MAX_BYTES = 25 * 1024 * 1024


def file_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for start, name in reversed(SIGNATURES):
        hit = head.startswith(start)
        if name == "image/webp":
            hit &= (F.length(content) < 12) | (F.substring(head, 17, 8) == "57454250")
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.lit("application/octet-stream"))


def name_reason(name: Column) -> Column:
    parts = F.split(F.lower(name), r"\.")
    middle = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(F.length(name) > 255, "name_length").when(F.contains(name, F.lit("\0")), "name_null").when(F.contains(name, F.lit("..")) | name.rlike(r"[/\\]"), "name_path")
        .when(F.arrays_overlap(middle, F.array(*(F.lit(x) for x in DANGEROUS))), "name_extension")
    )


def file_verdicts(df: DataFrame, content: str = "content", filename: str = "filename", declared: str = "declared_type", allowed: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df with actual_type, has_exif, reason (first check that fails, or null) and allowed."""
    data = F.col(content)
    out = df.withColumn("actual_type", file_type(data)).withColumn("has_exif", F.coalesce((F.hex(F.substring(data, 1, 4)) == "FFD8FFE1"), F.lit(False)))
    kind = F.col("actual_type")
    reason = (
        F.when(data.isNull() | (F.length(data) == 0), "empty").when(F.length(data) > max_bytes, "size").otherwise(F.coalesce(
            name_reason(F.col(filename)), F.when(kind == "application/x-executable", "executable").when(~kind.isin(*(ALLOWED if allowed is None else allowed)), "type").when(F.col(declared) != kind, "mismatch")))
    )
    return out.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())
