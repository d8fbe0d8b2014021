"""Rules learnt from reports: extraction, validation against benign history, matching, pruning and review.

Texts and terms meet in automata (palisade.functions.automaton): one pass over a text for all terms, and no join on contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import lexicon as L
from palisade.functions import text as T
from palisade.functions.automaton import containing, counted
from palisade.operators.screen import screened


#: Distinct ids that go to every executor, at some tens of bytes each, rather than have texts shuffled; more are joined by shuffle.
SENT_IDS = 1 << 20


def chosen(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is among the ids (or, left_anti, isn't), whatever the session holds to be small."""
    ids = ids.select(key).distinct()
    return df.join(F.broadcast(ids) if ids.limit(SENT_IDS + 1).count() <= SENT_IDS else ids, key, how)


def _array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def is_informative(term: Column, security: list[str] | None = None, stopwords: list[str] | None = None, baseline: list[str] = ()) -> Column:
    """lexicon.informative() as a column."""
    security = [*L.SECURITY_BASE, *L.ACTIONS, *L.TARGETS] if security is None else security
    technical = term.rlike("[-_]") | ~term.rlike(r"^[\p{L}\p{N}]+$")
    common = term.isin(*(L.STOPWORDS if stopwords is None else stopwords), *baseline)
    return term.isin(*security) | ((technical | (F.length(term) >= 7) | term.rlike(r"[^\x{0}-\x{24F}]")) & ~common)


def extracted_keywords(df: DataFrame, id_col: str, text: str, k: int = 5, upper=T.capitals) -> DataFrame:
    """(id, rank, keyword): the k most telling words of each text, security terms first, then the longest, then the first.

    Letters are made capitals one for one, so a keyword stands in its text's small letters; upper=F.upper would make ss of ß.
    """
    security = [*L.SECURITY_BASE, *L.ACTIONS, *L.TARGETS]
    words = df.select(id_col, F.posexplode(F.transform(T.tokens(upper(F.col(text))), lambda w: F.btrim(w, F.lit(T.EDGE + "/")))).alias("pos", "word")).where("word <> ''")
    words = words.groupBy(id_col, "word").agg(F.min("pos").alias("pos"))
    word = F.col("word")
    words = words.where(is_informative(word, security) & ~word.isin(*L.STOPWORDS)).withColumn("sec", word.isin(*security))
    best = Window.partitionBy(id_col).orderBy(F.desc("sec"), F.desc(F.length("word")), "pos")
    return words.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(id_col, "rank", F.lower("word").alias("keyword"))


def _counts(lowered: DataFrame, terms: DataFrame) -> tuple[DataFrame, int]:
    """(term, hits) over texts (_t), worked out once; and how many texts there are."""
    counts = counted(lowered, "_t", terms, "term").withColumnRenamed("n", "hits").persist()  # a row a term
    return counts.where("term IS NOT NULL"), int(counts.where("term IS NULL").agg(F.sum("hits")).first()[0] or 0)


def _rated(counts: DataFrame, threshold: float) -> DataFrame:
    rate = F.when(F.col("tested") > 0, F.col("hits") / F.col("tested")).otherwise(0.0)
    return counts.withColumn("rate", F.round(rate, 4)).withColumn("is_safe", rate <= threshold)


def false_positive_rates(terms: DataFrame, history: DataFrame, text: str, threshold: float = 0.01) -> DataFrame:
    """(term, hits, tested, rate, is_safe) of each term over benign texts; without history every term is safe."""
    hits, tested = _counts(history.select(F.lower(F.col(text)).alias("_t")).where(F.length("_t") > 0), terms)
    out = terms.select("term").distinct().join(hits, "term", "left").select("term", F.coalesce("hits", F.lit(0)).alias("hits"), F.lit(tested).cast("long").alias("tested"))
    return _rated(out, threshold)


def false_positive_rates_of_others(reports: DataFrame, history: DataFrame, id_col: str, text: str, threshold: float = 0.01) -> DataFrame:
    """(term, scan_id, hits, tested, rate, is_safe) of reported terms (term, scan_id) over all benign texts but the reported one itself; safe if there is none."""
    lowered = history.select(F.col(id_col).alias("scan_id"), F.lower(F.col(text)).alias("_t")).where(F.length("_t") > 0)
    asked = reports.select("term", "scan_id").distinct().persist()  # reports are few beside their history
    hits, tested = _counts(lowered, asked)
    # a reported scan's own share needs only its own text
    own = asked.join(chosen(lowered, asked, "scan_id"), "scan_id", "left").groupBy("term", "scan_id")
    own = own.agg(F.count_if((F.col("term") != "") & F.contains("_t", "term")).alias("_own"), F.count("_t").alias("_there"))
    out = own.join(hits, "term", "left").select("term", "scan_id", (F.coalesce("hits", F.lit(0)) - F.col("_own")).alias("hits"), (F.lit(tested) - F.col("_there")).alias("tested"))
    return _rated(out, threshold)


def learned_matches(df: DataFrame, id_col: str, text: str, rules: DataFrame, least: int = 2) -> DataFrame:
    """(id, n_rules, blocked): texts that hold learnt rules (pattern); phrases and informative words count."""
    usable = rules.select(F.lower("pattern").alias("term")).where(F.col("term").contains(" ") | is_informative(T.capitals("term"), stopwords=[]))
    hits = containing(df.select(id_col, F.lower(F.col(text)).alias("_t")), [id_col], "_t", usable, "term").groupBy(id_col).agg(F.count("*").alias("n_rules"))
    return hits.withColumn("blocked", F.col("n_rules") >= least)


def category_keywords(categories: DataFrame) -> DataFrame:
    """(category, keywords): the learnt keywords of each category, lower-case and sorted; of a table (category, keyword)."""
    return categories.groupBy("category").agg(F.array_sort(F.collect_set(F.lower("keyword"))).alias("keywords"))


def category_matches(df: DataFrame, id_col: str, text: str, categories: dict[str, list[str]] | None = None, learned: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(id, category, n_hits): for each text the first category (by name) with `least` of its keywords or more.

    learned (category, keyword) adds keywords, also in categories of its own. Phrases and informative words count.
    """
    cats = L.CATEGORIES if categories is None else categories
    fixed = {name: [w for w in words if " " in w or L.informative(w.upper())] for name, words in sorted(cats.items())}
    low = df.select(id_col, F.lower(F.col(text)).alias("_t"))
    if learned is None:
        counts = F.array(*(F.struct(F.lit(name).alias("category"), F.size(T.found_terms(F.col("_t"), words)).alias("n_hits")) for name, words in fixed.items()))
        best = F.get(F.filter(counts, lambda x: x["n_hits"] >= least), F.lit(0))
        return low.select(id_col, best.alias("best")).where("best IS NOT NULL").select(id_col, "best.category", F.col("best.n_hits").cast("long").alias("n_hits"))
    known = df.sparkSession.createDataFrame([(n, w) for n, words in fixed.items() for w in words], "category string, keyword string")
    more = learned.select("category", F.lower("keyword").alias("keyword")).where(F.col("keyword").contains(" ") | is_informative(T.capitals("keyword")))
    words = known.unionByName(more).distinct()
    hits = containing(low, [id_col], "_t", words, "keyword").join(words.withColumnRenamed("keyword", "term"), "term")
    counted = hits.groupBy(id_col, "category").agg(F.count("*").alias("n_hits")).where(F.col("n_hits") >= least)
    return counted.groupBy(id_col).agg(F.min(F.struct("category", "n_hits")).alias("best")).select(id_col, "best.category", "best.n_hits")


def scanned(df: DataFrame, id_col: str, text: str, rules: DataFrame, learned: DataFrame | None = None, categories: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """(id, allowed, stage, reason, clean): the screen, then learnt rules (pattern), then categories; the first that blocks decides.

    stage is filter, rules or categories where something blocks, else passed; reason is the layer, the number of rules or the category.
    clean is null where a text is blocked. A null text is empty, so safe. ids are distinct.
    """
    raw = df.select(id_col, F.col(text).alias("_raw"))
    rows = screened(raw, "_raw", **options).select(id_col, "clean", "layer")
    # rules and categories look at all texts, which is cheaper than to screen them once more to leave some out
    by_rule = learned_matches(raw, id_col, "_raw", rules).where("blocked").select(id_col, "n_rules")
    by_kind = category_matches(raw, id_col, "_raw", categories, learned).select(id_col, "category")
    out = rows.join(by_rule, id_col, "left").join(by_kind, id_col, "left")
    stage = F.when(F.col("layer").isNotNull(), "filter").when(F.col("n_rules").isNotNull(), "rules").when(F.col("category").isNotNull(), "categories").otherwise("passed")
    reason = F.coalesce("layer", F.concat(F.col("n_rules").cast("string"), F.lit(" rules")), "category")
    return out.select(id_col, (stage == "passed").alias("allowed"), stage.alias("stage"), reason.alias("reason"), F.when(stage == "passed", F.col("clean")).alias("clean"))


def classified(keywords: DataFrame, id_col: str, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, category) of reports from their keywords (id, rank, keyword): most overlaps, first category wins ties, else learned_<first two>."""
    cats = L.CATEGORIES if categories is None else categories
    lists = keywords.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k"))  # few a report
    words = F.col("k.keyword")
    overlap = F.array(*(F.struct(F.size(F.array_intersect(words, _array(ws))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("category")) for i, (name, ws) in enumerate(cats.items())))
    best = F.array_max(overlap)
    learnt = F.when(F.size(words) >= 2, F.concat(F.lit("learned_"), F.get(words, F.lit(0)), F.lit("_"), F.get(words, F.lit(1)))).otherwise(F.concat(F.lit("learned_"), F.get(words, F.lit(0))))
    return lists.select(id_col, F.when(best["n"] > 0, best["category"]).otherwise(learnt).alias("category"))


def decided(reports: DataFrame, rates: DataFrame, auto: bool = True) -> DataFrame:
    """reports (report_id, scan_id, allowed, text) with status: rejected (not allowed or under five letters), approved, pending."""
    low = reports.withColumn("term", F.lower(F.btrim("text")))
    joined = low.join(rates.select("term", "rate", "is_safe"), "term", "left")
    guard = F.col("allowed") & (F.length("term") >= 5)
    status = F.when(~F.coalesce(guard, F.lit(False)), "rejected").when(F.coalesce("is_safe", F.lit(True)) & F.lit(auto), "approved").otherwise("pending")
    return joined.withColumn("status", status).drop("term")


def report_outcomes(reported: DataFrame, id_col: str, learned: DataFrame, predefined: dict[str, list[str]] | None = None, allow_pruning: bool = True, auto: bool = True, least: int = 3) -> DataFrame:
    """(id, status, category, prune): what follows from reports of texts that were blocked wrongly, reports having text and allowed.

    allowed texts can't be reported (error). Without pruning or in manual mode reports wait (pending_review). Else the first category by name of
    which `least` keywords, learnt (category, keyword) or predefined, stand in the text is the one that blocked, and its learnt ones among these go
    (pruned), but for predefined ones, which never go (no_action if none is left).
    """
    cats = L.CATEGORIES if predefined is None else predefined
    fixed = df_of(reported, [(c, w) for c, ws in cats.items() for w in ws], "category string, keyword string").withColumn("fixed", F.lit(True))
    words = learned.select("category", F.lower("keyword").alias("keyword")).distinct().withColumn("learnt", F.lit(True)).join(fixed, ["category", "keyword"], "full")
    words = words.where(F.col("keyword").contains(" ") | is_informative(T.capitals("keyword")))
    blocked = reported.where(~F.coalesce("allowed", F.lit(False)))
    hits = containing(blocked.select(id_col, F.lower("text").alias("_t")), [id_col], "_t", words, "keyword").join(words.withColumnRenamed("keyword", "term"), "term")
    gone = F.when(F.col("learnt") & F.col("fixed").isNull(), F.col("term"))
    counted = hits.groupBy(id_col, "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(gone)).alias("prune")).where(F.col("n") >= least)
    first = counted.groupBy(id_col).agg(F.min(F.struct("category", "prune")).alias("x")).select(id_col, "x.category", "x.prune")
    none = F.array().cast("array<string>")
    out = reported.select(id_col, "allowed").join(first, id_col, "left")
    waits = F.lit(not (allow_pruning and auto))
    status = F.when(waits, "pending_review").when(F.coalesce("allowed", F.lit(False)), "error").when(F.size(F.coalesce("prune", none)) > 0, "pruned").otherwise("no_action")
    shown = ~waits & F.col("category").isNotNull()
    return out.select(id_col, status.alias("status"), F.when(shown, F.col("category")).alias("category"), F.when(shown, F.col("prune")).otherwise(none).alias("prune"))


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def pruned(learned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Learnt keywords (category, keyword) without what report_outcomes() prunes."""
    gone = outcomes.where("status = 'pruned'").select("category", F.explode("prune").alias("keyword")).distinct()
    return learned.join(gone, ["category", "keyword"], "left_anti").select("category", "keyword")


def listed_reports(reports: DataFrame) -> DataFrame:
    """Reports, newest first (equal times by id)."""
    return reports.orderBy(F.desc("ts"), "report_id")


def statistics(scan_log: DataFrame, reports: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: total_scans, total_reports, approved_rules, pending_rules, active_custom_rules (distinct approved patterns)."""
    status = F.col("status")
    counted = rules.agg(F.count_if(status == "approved").alias("approved_rules"), F.count_if(status == "pending").alias("pending_rules"), F.count_distinct(F.when(status == "approved", F.lower("pattern"))).alias("active_custom_rules"))
    return scan_log.agg(F.count("*").alias("total_scans")).crossJoin(reports.agg(F.count("*").alias("total_reports"))).crossJoin(counted)  # one row each


def learnt_keywords(reports: DataFrame, keywords: DataFrame, kinds: DataFrame, rates: DataFrame) -> DataFrame:
    """(category, keyword, source_report_id): keywords (report_id, keyword) of reports that pass validation, filed under their report's category.

    kinds is (report_id, category), rates (term, is_safe). Each (category, keyword) comes once, with the least report.
    """
    safe = rates.where("is_safe").select(F.col("term").alias("keyword"))
    rows = keywords.select("report_id", "keyword").join(safe, "keyword", "left_semi").join(kinds, "report_id").join(reports.where("allowed").select("report_id"), "report_id", "left_semi")
    return rows.groupBy("category", "keyword").agg(F.min("report_id").alias("source_report_id"))


def new_rules(decided_: DataFrame, as_of: str) -> DataFrame:
    """Rules as stored (rule_id, pattern, source_report_id, false_positive_rate, status, created_at), of decided() reports that weren't rejected; one for each pattern."""
    kept = decided_.where("status <> 'rejected'").groupBy(F.lower(F.btrim("text")).alias("pattern")).agg(F.min("report_id").alias("source_report_id"), F.max("rate").alias("false_positive_rate"), F.min("status").alias("status"))
    return kept.select(F.substring(F.sha2("pattern", 256), 1, 12).alias("rule_id"), "pattern", "source_report_id", "false_positive_rate", "status", F.lit(as_of).cast("timestamp").alias("created_at"))


def reviewed(rules: DataFrame, approve: list[str] = (), reject: list[str] = (), approve_all_below: float | None = None) -> DataFrame:
    """rules (rule_id, pattern, false_positive_rate, status) after review of pending ones."""
    pending = F.col("status") == "pending"
    every = F.lit(False) if approve_all_below is None else F.col("false_positive_rate") <= approve_all_below
    status = F.when(pending & F.col("rule_id").isin(*reject), "rejected").when(pending & (F.col("rule_id").isin(*approve) | every), "approved").otherwise(F.col("status"))
    return rules.withColumn("status", status)


def added(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """known and the rows of new whose keys it doesn't have, once each."""
    return known.unionByName(new.dropDuplicates(keys).join(known.select(*keys).distinct(), keys, "left_anti").select(*known.columns))


def retained(df: DataFrame, ts: str, as_of: str, days: int = 30) -> DataFrame:
    """Rows no older than `days` before as_of (a timestamp literal)."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
