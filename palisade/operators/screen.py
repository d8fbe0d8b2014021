"""Input screening: an ordered verdict over normalised text. The first layer that hits decides.

One Arrow pass reads a text and, where that hasn't settled it, what it may hide (palisade.functions.reading).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import automaton as M
from palisade.functions import lexicon as L
from palisade.functions import reading as R
from palisade.functions import text as T


def screened(
    df: DataFrame, text: str = "text", signals: dict[str, int] | None = None, high_confidence: list[str] | None = None, actions: list[str] | None = None,
    targets: list[str] | None = None, safe_keywords: list[str] = (), baseline: list[str] = (), compatibility: bool = True,
) -> DataFrame:
    """df with clean (normalised text), layer (first that blocks, or null), is_safe and suspicion (100 if blocked).

    Layers in order: gibberish, flood, escapes, model_tokens, persona, high_confidence, signals (weight 2 or more),
    co_occurrence (action and target words, 3 or more), decoded. A null text is empty, so safe. Variants are looked at
    only where signals and words of the text itself haven't settled it. Lists may be DataFrames of one column.
    """
    signals = L.weighted_signals(signals if signals is None or isinstance(signals, dict) else dict.fromkeys(L.listed(signals), 1))
    safe_keywords, baseline = L.listed(safe_keywords), set(L.listed(baseline))
    signals = {t: w for t, w in signals.items() if " " in t or t not in baseline or t in L.SECURITY_BASE}
    sure = [t for t in map(L.normalised_term, L.HIGH_CONFIDENCE if high_confidence is None else L.listed(high_confidence)) if " " in t or t not in baseline]
    acts, aims = L.ACTIONS if actions is None else L.listed(actions), L.TARGETS if targets is None else L.listed(targets)
    out = R.read(df, text, M.Judge(signals, sure, acts, aims, T.EDGE), compatibility).withColumn("is_safe", F.col("layer").isNull())
    safe = F.size(T.found_terms(F.lower("clean"), [k.lower() for k in safe_keywords])) > 0
    return out.withColumn("suspicion", F.when(~F.col("is_safe"), 100).when(safe, 0).otherwise(F.col("_points"))).drop("_points")


def extracted_text_verdicts(df: DataFrame, text: str = "text", source: str = "OCR", fallback: list[str] | None = None, **options) -> DataFrame:
    """df with allowed, reason and clean_text for text that came out of files: blank text passes as it is, other text is screened.

    fallback is a list of upper-case terms to look for instead of the whole screen, as where only a quick check is wanted.
    """
    blank = F.coalesce(F.btrim(T.unspaced(F.col(text))) == "", F.lit(True))
    if fallback is None:
        rows = screened(df, text, **options)
        reason = F.when(blank, "empty").when(F.col("is_safe"), "validated").otherwise(F.concat(F.lit(f"injection in {source} text: "), "layer"))
        rows = rows.withColumn("allowed", blank | F.col("is_safe")).withColumn("clean_text", F.when(blank, F.col(text)).when(F.col("is_safe"), F.col("clean")))
        return rows.withColumn("reason", reason).drop("clean", "layer", "is_safe", "suspicion")
    hit = F.size(T.found_terms(F.upper(F.col(text)), fallback)) > 0
    rows = df.withColumn("allowed", blank | ~hit).withColumn("clean_text", F.when(blank | ~hit, F.col(text)))
    return rows.withColumn("reason", F.when(blank, "empty").when(hit, f"keyword in {source} text").otherwise("validated"))
