"""Tables of the engine: schemas, readers and idempotent writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.adaptive import added

SCHEMAS = {
    "scan_log": "scan_id string, input_text string, allowed boolean, stage string, reason string, ts timestamp",
    "reports": "report_id string, scan_id string, reported_input string, reason string, ts timestamp, status string",
    "rules": "rule_id string, pattern string, source_report_id string, false_positive_rate double, tested_against bigint, status string, created_at timestamp",
    "attack_categories": "category string, keyword string, source_report_id string, created_at timestamp",
    "session_tools": "session_id string, tool_name string, query string, result_summary string, ts timestamp",
    "verified_facts": "claim_hash string, claim_text string, verified_at timestamp, ttl_days int, expires_at timestamp",
    "approval_events": "approval_id string, ts timestamp, op string, action string, payload string, actor string",
}


def create(spark: SparkSession, root: str, name: str) -> None:
    """An empty table folder, if there is none."""
    spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


#: What tells a row of a table, if anything does.
KEYS = {"scan_log": ["scan_id"], "reports": ["report_id"], "rules": ["rule_id"], "attack_categories": ["category", "keyword"], "verified_facts": ["claim_hash", "verified_at"]}


def append(df: DataFrame, root: str, name: str) -> None:
    """Adds rows, of tables with a key only those that aren't there yet; so a write that is repeated changes nothing."""
    if keys := KEYS.get(name):
        df = df.dropDuplicates(keys).join(read(df.sparkSession, root, name).select(*keys), keys, "left_anti").select(*df.columns)
    df.write.mode("append").parquet(f"{root}/{name}")


def baseline_words(spark: SparkSession, path: str | None) -> DataFrame:
    """(word) of a JSON array of words, upper-case; empty without a path."""
    if path is None:
        return spark.createDataFrame([], "word string")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("word")).select(F.upper("word").alias("word")).distinct()


def imported_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(category, keyword) and (pattern) of a rules file {category_keywords: {name: [..]}, approved_rules: [..]}."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "category_keywords map<string,array<string>>, approved_rules array<string>").alias("x"))
    words = rows.select(F.explode("x.category_keywords").alias("category", "k")).select("category", F.explode("k").alias("keyword")).select("category", F.lower("keyword").alias("keyword")).distinct()
    return words, rows.select(F.explode("x.approved_rules").alias("pattern")).select(F.lower("pattern").alias("pattern")).distinct()


def merge_keywords(known: DataFrame, new: DataFrame) -> DataFrame:
    return added(known, new, ["category", "keyword"])


def approved_rules(rules: DataFrame) -> DataFrame:
    return rules.where("status = 'approved'").select(F.lower("pattern").alias("pattern")).distinct()


def files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, length) of a folder of files."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "content", "length")


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Scan requests in JSON lines {tool, args, text}, as the daemon's body has them."""
    return spark.read.text(path).select(F.from_json("value", "tool string, args string, text string").alias("r")).select("r.*")
