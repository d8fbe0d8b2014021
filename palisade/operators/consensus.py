"""Model verdicts: validation of responses, consensus of several providers, tiers, and the provider plug-in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.policy import audited, ethics

Provider = Callable[[str], str]


def parsed(response: Column) -> Column:
    """SAFE, UNSAFE or VETOED (empty or unclear); UNSAFE wins over SAFE."""
    t = F.upper(F.btrim(F.coalesce(response, F.lit("")), F.lit(" \t\n\r")))
    word = r"(^|[^\p{{L}}\p{{N}}_]){}([^\p{{L}}\p{{N}}_]|$)"
    return F.when(t == "", "VETOED").when(t.rlike(word.format("UNSAFE")), "UNSAFE").when(t.rlike(word.format("SAFE")), "SAFE").otherwise("VETOED")


def validated(df: DataFrame, response: str = "response") -> DataFrame:
    """df with verdict: responses that the action policy or ethics would block are VETOED."""
    rows = ethics(audited(df.withColumn("_a", F.lit("ANSWER")), "_a", response), "_a", response)
    return rows.withColumn("verdict", F.when(F.col("allowed") & F.col("approved"), parsed(F.col(response))).otherwise("VETOED")).drop("_a", "reason", "allowed", "concern", "approved")


def agreed(verdicts: DataFrame, key: str, provider: str = "provider", verdict: str = "verdict", least: int = 2) -> DataFrame:
    """(key, n_providers, outcome, allowed): allowed only if at least `least` providers all say SAFE."""
    v = F.col(verdict)
    rows = verdicts.groupBy(key).agg(F.count_distinct(provider).alias("n_providers"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    outcome = F.when(F.col("n_providers") < least, "too_few").when(F.col("lo") != F.col("hi"), "mismatch").when(F.col("lo") == "SAFE", "allowed").when(F.col("lo") == "UNSAFE", "blocked").otherwise("vetoed")
    return rows.select(key, "n_providers", outcome.alias("outcome"), (outcome == "allowed").alias("allowed"))


def asked(df: DataFrame, text: str, providers: dict[str, Provider], fail_open: bool = False, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """df times providers with response: each provider is a function of a text, called in the executors.

    providers is a dictionary, or pairs of distinct names and functions. After `retries` failures, each followed by a longer pause, the response is SAFE
    if fail_open, else null.
    """
    if not isinstance(providers, dict):
        pairs = list(providers)
        providers = dict(pairs)
        if len(providers) < len(pairs):
            raise ValueError("providers must have distinct names")
    if not providers:
        raise ValueError("at least one provider is needed")
    rows = df.withColumn("provider", F.explode(F.array(*(F.lit(name) for name in providers))))  # one reading of df for all providers
    return rows.withColumn("response", F.pandas_udf(_responder(providers, fail_open, retries, pause), "string")("provider", F.col(text)))


def _responder(calls: dict[str, Provider], fail_open: bool, retries: int, pause: float):
    def one(name: str, x: str) -> str | None:
        for k in range(retries + 1):
            try:
                return calls[name](x)
            except Exception:  # a provider may fail in any way
                if k < retries:
                    time.sleep(pause * (k + 1))
        return "SAFE" if fail_open else None

    def respond(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, texts in batches:
            yield pd.Series([one(name, x) for name, x in zip(names, texts, strict=True)], dtype=object)

    return respond


def tiered(screened: DataFrame, key: str, text: str, providers: dict[str, Provider] | None = None) -> DataFrame:
    """(key, allowed, layer): what the deterministic screen blocks is settled; only the rest goes to the providers."""
    blocked = screened.where(~F.col("is_safe")).select(key, F.lit(False).alias("allowed"), "layer")
    rest = screened.where("is_safe")
    if not providers:
        return blocked.unionByName(rest.select(key, F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("layer")))
    out = agreed(validated(asked(rest.select(key, text), text, providers)), key, least=min(2, len(providers)))
    return blocked.unionByName(out.select(key, "allowed", F.concat(F.lit("consensus_"), "outcome").alias("layer")))


def counters(results: DataFrame) -> DataFrame:
    """(layer, allowed, n) of tiered() results."""
    return results.groupBy("layer", "allowed").agg(F.count("*").alias("n"))


def reported(results: DataFrame, key: str, texts: DataFrame, text: str = "text") -> DataFrame:
    """Allowed results as reports of missed attacks (report_id, scan_id, allowed, text), for adaptive.decided()."""
    rows = results.where("allowed").join(texts.select(key, F.col(text).alias("text")), key)
    return rows.select(F.concat(F.lit("r"), F.col(key).cast("string")).alias("report_id"), F.col(key).cast("string").alias("scan_id"), "allowed", "text")
