"""Hallucination guard: claims that need a source, hedging, verified sessions and a fact cache with lifetimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import lexicon as L

# What marks a claim or a hedge, and the tools that verify.
TEMPORAL = r"currently|right now|as of (today|now|\d{4})|at this moment|at the time of writing|today's|latest|up[- ]to[- ]date|real[- ]time"
NUMERICAL = r"\$[\d,]+\.?\d*|(^|[^\p{L}\p{N}_])\d{1,3}(,\d{3})+(\.\d+)?([^\p{L}\p{N}_]|$)|(^|[^\p{L}\p{N}_])\d+(\.\d+)?%|(^|[^\p{L}\p{N}_])\d+(\.\d+)?\s*(million|billion|trillion|thousand)([^\p{L}\p{N}_]|$)"
CITATION = (
    r"according to|studies show|research (indicates|shows|suggests|proves)|experts (say|agree|believe)|data (shows|indicates|suggests)|"
    r"statistics (show|indicate|prove)|surveys (show|indicate)|it (has been|is) (proven|shown|demonstrated|established)|peer[- ]reviewed|published in|reported by|a recent (study|report|survey|analysis)"
)
CERTAINTY = (
    r"the (answer|fact|truth|reality) is|it is (exactly|precisely|definitely|certainly|undeniably)|i (know|can confirm|can verify) (that|for a fact)|"
    r"without (a )?doubt|there is no question|i have (verified|confirmed|checked)|the (exact|precise) (number|figure|amount|value) is"
)
HEDGE = (
    r"i'?m not (sure|certain)|i (think|believe|suspect)|(maybe|perhaps|possibly|probably|likely|approximately|roughly|around|about)|i don'?t (know|have|remember)|"
    r"i'?d need to (check|verify|look|search|confirm)|i'?m not (confident|able to confirm)|(could|might|may) be|if i (recall|remember) correctly|i (can'?t|cannot) (verify|confirm)|"
    r"to the best of my knowledge|as far as i know"
)
TOOLS = ["SEARCH", "BROWSE", "READ_FILE", "LOOKUP", "QUERY", "WEB_SEARCH", "GOOGLE", "FETCH", "API_CALL"]


def bounded(pattern: str) -> str:
    """As whole words, with the boundaries of Unicode spelt out; for lower-case text."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({pattern})([^\p{{L}}\p{{N}}_]|$)"


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: F.length(s) > 10)


def markers(t: Column) -> Column:
    """Kinds of claims in a text, in the order temporal, numerical, citation, certainty."""
    low = F.lower(F.coalesce(t, F.lit("")))

    def counts(s: Column) -> Column:
        s = F.btrim(s, F.lit(" \t\n\r"))
        trivial = s.rlike(r"^(step|option|item) ") | (F.contains(s, F.lit("results")) & (F.length(s) < 40))
        return s.rlike(NUMERICAL) & ~trivial

    numerical = low.rlike(NUMERICAL) & F.exists(F.split(low, r"[.!?]"), counts)
    found = [(low.rlike(bounded(TEMPORAL)), "temporal"), (numerical, "numerical"), (low.rlike(bounded(CITATION)), "citation"), (low.rlike(bounded(CERTAINTY)), "certainty")]
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for hit, name in found)))


def is_hedged(t: Column) -> Column:
    return F.lower(F.coalesce(t, F.lit(""))).rlike(bounded(HEDGE))


def claim_hash(t: Column) -> Column:
    """16 hex digits of the words of a claim, without case and punctuation."""
    flat = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    return F.substring(F.sha2(flat, 256), 1, 16)


def ttl_days(t: Column) -> Column:
    return F.when(F.lower(t).rlike(bounded(TEMPORAL)), 7).otherwise(90)


def facts(df: DataFrame, text: str, ts: str) -> DataFrame:
    """(claim_hash, claim_text, verified_at, ttl_days, expires_at): the latest verification of each claim."""
    rows = df.select(claim_hash(F.col(text)).alias("claim_hash"), F.col(text).alias("claim_text"), F.col(ts).alias("verified_at"), ttl_days(F.col(text)).alias("ttl_days"))
    best = rows.groupBy("claim_hash").agg(F.max(F.struct("verified_at", "claim_text", "ttl_days")).alias("x")).select("claim_hash", "x.claim_text", "x.verified_at", "x.ttl_days")
    return best.withColumn("expires_at", F.col("verified_at") + F.make_dt_interval("ttl_days"))


def looked_up(claims: DataFrame, hash_col: str, ts: str, known: DataFrame) -> DataFrame:
    """claims with is_known: whether a fact of that hash was verified before ts and hasn't expired then."""
    k = known.select(F.col("claim_hash").alias("_h"), F.col("verified_at").alias("_v"), F.col("expires_at").alias("_x"))
    hit = claims.join(k, (F.col(hash_col) == F.col("_h")) & (F.col(ts) >= F.col("_v")) & (F.col(ts) < F.col("_x")), "left_semi").select(hash_col, ts).distinct().withColumn("is_known", F.lit(True))
    return claims.join(hit, [hash_col, ts], "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def verified_sessions(tools: DataFrame, session: str = "session_id", tool: str = "tool_name", names=None) -> DataFrame:
    """(session, verified_at): sessions that used a verifying tool, and when first."""
    return tools.where(F.upper(tool).isin(*(TOOLS if names is None else L.listed(names)))).groupBy(session).agg(F.min("ts").alias("verified_at"))


def checked(answers: DataFrame, tools: DataFrame, known: DataFrame | None = None, session: str = "session_id", ts: str = "ts", text: str = "text", key: str = "answer_id", enabled: bool = True, as_of: bool = False) -> DataFrame:
    """answers with outcome (disabled, no_claim, hedged, session, cached or blocked) and allowed.

    as_of counts only tools used by the time of the answer; else any in the session does.
    """
    rows = answers.join(verified_sessions(tools, session).withColumnRenamed("verified_at", "_tool"), session, "left")
    tool = F.col("_tool").isNotNull() & (F.lit(not as_of) | (F.col("_tool") <= F.col(ts)))
    rows = rows.withColumn("_m", F.size(markers(F.col(text)))).withColumn("_open", (F.col("_m") > 0) & ~is_hedged(F.col(text)) & ~F.coalesce(tool, F.lit(False)))
    cached = F.lit(False)
    if known is not None:  # only for answers that nothing before has let through
        said = rows.where("_open").select(key, ts, F.explode(F.transform(sentences(F.col(text)), claim_hash)).alias("_hash"))
        hit = looked_up(said, "_hash", ts, known).where("is_known").select(key).distinct().withColumn("_cached", F.lit(True))
        rows = rows.join(hit, key, "left")
        cached = F.coalesce("_cached", F.lit(False))
    outcome = F.when(F.lit(not enabled), "disabled").when(F.col("_m") == 0, "no_claim").when(is_hedged(F.col(text)), "hedged").when(~F.col("_open"), "session").when(cached, "cached").otherwise("blocked")
    return rows.withColumn("outcome", outcome).withColumn("allowed", F.col("outcome") != "blocked").drop("_m", "_open", "_tool", "_cached")


def logged_checks(checked_: DataFrame, session: str = "session_id", ts: str = "ts", text: str = "text", key: str = "answer_id") -> DataFrame:
    """The log of checked() answers (check_id, session_id, answer_text, had_markers, had_verification, allowed, reason, ts); texts of 500 characters."""
    found = F.size(markers(F.col(text))) > 0
    return checked_.select(
        F.col(key).cast("string").alias("check_id"), F.col(session).cast("string").alias("session_id"), F.substring(text, 1, 500).alias("answer_text"), found.alias("had_markers"),
        (F.col("outcome") == "session").alias("had_verification"), "allowed", F.col("outcome").alias("reason"), F.col(ts).alias("ts"),
    )


def blocked_claims(checked_: DataFrame, session: str = "session_id", ts: str = "ts", text: str = "text", key: str = "answer_id") -> DataFrame:
    """(claim_id, session_id, claim_text, confidence_markers, reason, ts) of blocked answers; texts of 500 characters."""
    rows = checked_.where(~F.col("allowed"))
    return rows.select(F.col(key).cast("string").alias("claim_id"), F.col(session).cast("string").alias("session_id"), F.substring(text, 1, 500).alias("claim_text"), F.array_join(markers(F.col(text)), ",").alias("confidence_markers"), F.col("outcome").alias("reason"), F.col(ts).alias("ts"))


def statistics(checks: DataFrame, known: DataFrame) -> DataFrame:
    """One row: total_checks, total_allowed, total_blocked, sessions (distinct in the log) and cached_facts."""
    counted = checks.agg(F.count("*").alias("total_checks"), F.count_if("allowed").alias("total_allowed"), F.count_if(~F.col("allowed")).alias("total_blocked"), F.count_distinct("session_id").alias("sessions"))
    return counted.crossJoin(known.agg(F.count("*").alias("cached_facts")))  # one row each


def unexpired(known: DataFrame, as_of: str) -> DataFrame:
    """Facts whose own lifetime hasn't ended before as_of (a timestamp literal)."""
    return known.where(F.col("verified_at") + F.make_dt_interval("ttl_days") >= F.lit(as_of).cast("timestamp"))
