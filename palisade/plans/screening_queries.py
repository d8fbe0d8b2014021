"""Queries over texts: normalisation, detectors, lexicons, decoders, verdicts and learnt rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import automaton as M
from palisade.functions import lexicon as L
from palisade.functions import text as T
from palisade.operators import adaptive as A
from palisade.operators import consensus as C
from palisade.operators import screen as S
from palisade.plans.registry import Registry, literal, read, spread
from palisade.plans.synthesis import COMPATIBLE, PAGES_SQL, page_texts, synthesised
from palisade.plans.synthesis import SQL as SYNTH

REGISTRY = Registry()

_SIGNALS = L.weighted_signals()
_SURE = [L.normalised_term(t) for t in L.HIGH_CONFIDENCE]
_WS = r"[\s\x0B\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_EDGE = T.EDGE.replace("'", "''")
_ALPHA = T._UPPER + T._LOWER
_ROT = T._UPPER[13:] + T._UPPER[:13] + T._LOWER[13:] + T._LOWER[:13]


def _clean(x: str) -> str:
    for wide, plain in COMPATIBLE.items():
        x = f"replace({x}, '{wide}', '{plain}')"
    stripped = rf"regexp_replace(regexp_replace({x}, '[\p{{Cf}}\p{{Mn}}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', ' ', 'g')"
    return f"translate({stripped}, '{L.HOMOGLYPH_FROM}', '{L.HOMOGLYPH_TO}')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}'), lambda w: w <> '')"


def _found(x: str, terms: list[str]) -> str:
    return f"len(list_filter({literal(terms)}, lambda t: contains({x}, t)))"


def _weight(x: str) -> str:
    by: dict[int, list[str]] = {}
    for t, w in _SIGNALS.items():
        by.setdefault(w, []).append(t)
    return "(" + " + ".join(f"{w} * {_found(x, ts)}" for w, ts in by.items()) + ")"


def _common(words: str, terms: list[str]) -> str:
    return f"len(list_intersect({words}, {literal(terms)}))"


#: synthesised texts with their clean and upper-case forms and bare words
_BASE = f"""
synth AS ({SYNTH}),
cleaned AS (SELECT doc_id, lang, source, input, {_clean('input')} AS clean FROM synth),
base AS (SELECT *, upper(clean) AS u, list_transform({_tokens('upper(clean)')}, lambda w: trim(w, '{_EDGE}')) AS words FROM cleaned)"""

_STRIP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FLAGS = rf"""
flag_base AS (
  SELECT doc_id, lang, clean, u, words, trim(regexp_replace(trim(regexp_replace(clean, '{T.URL}', '', 'g'), {_STRIP}), '\p{{S}}', '', 'g'), {_STRIP}) AS g,
    trim(clean, {_STRIP}) AS s, {_tokens('clean')} AS raw_words FROM base),
tops AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, UNNEST(raw_words) AS w FROM flag_base) GROUP BY doc_id, w) GROUP BY doc_id),
flags AS (
  SELECT f.doc_id, lang, clean, u, words,
    length(g) > 50 AND (((length(g) - length(regexp_replace(g, ' ', '', 'g'))) / length(g) < 0.02 AND ((length(g) - length(regexp_replace(g, '[=+/0-9]', '', 'g'))) / length(g) > 0.08 OR ends_with(g, '=')))
      OR regexp_matches(g, '^[0-9a-fA-F]{{2,4}}(\s[0-9a-fA-F]{{2,4}}){{5,}}$')
      OR ((length(g) - length(regexp_replace(g, ' ', '', 'g'))) / length(g) < 0.05 AND (length(g) - length(regexp_replace(g, '[aeiouAEIOU]', '', 'g'))) / length(g) < 0.1)) AS gibberish,
    (length(s) >= 50 AND len(list_distinct(string_split(s, ''))) <= 2) OR (len(raw_words) >= 12 AND coalesce(top, 0) >= 10 AND top / len(raw_words) > 0.6) AS flood,
    regexp_matches(clean, '{T.ESCAPES}') AS escapes, regexp_matches(clean, '(?i){T.MODEL_TOKENS}') AS model_tokens, regexp_matches(clean, '(?i){T.PERSONA}') AS persona
  FROM flag_base f LEFT JOIN tops USING (doc_id))"""


def _synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesised(spread(read(spark, sf_dir, "documents")))


@REGISTRY(f"WITH {_BASE} SELECT doc_id, md5(clean) AS clean_md5, length(clean) AS n_chars, md5(regexp_replace(regexp_replace(translate(clean, '_-', '  '), '{T.URL}', '', 'g'), '\\p{{S}}', '', 'g')) AS bare_md5 FROM base")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _synth(spark, sf_dir).withColumn("clean", T.normalise("input"))
    bare = T.without_symbols(T.without_urls(T.spaced_words("clean")))
    return clean.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n_chars"), F.md5(bare).alias("bare_md5"))


@REGISTRY(f"WITH {_BASE} SELECT doc_id, len(ws) AS n_tokens, len(list_distinct(list_filter(ws, lambda w: w <> ''))) AS n_distinct FROM (SELECT doc_id, list_transform({_tokens('clean')}, lambda w: trim(w, '{_EDGE}')) AS ws FROM base)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _synth(spark, sf_dir).select("doc_id", F.transform(T.tokens(T.normalise("input")), T.bare).alias("words"))
    return words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.filter("words", lambda w: w != ""))).cast("long").alias("n_distinct"))


@REGISTRY(f"WITH {_BASE}, {_FLAGS} SELECT doc_id, gibberish, flood, escapes, model_tokens, persona FROM flags")
def structural_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _synth(spark, sf_dir).withColumn("clean", T.normalise("input"))
    return clean.select("doc_id", T.is_gibberish("clean").alias("gibberish"), T.is_flood("clean").alias("flood"), T.has_escapes("clean").alias("escapes"), T.has_model_tokens("clean").alias("model_tokens"), T.is_persona_hijack("clean").alias("persona"))


@REGISTRY(f"WITH {_BASE} SELECT doc_id, {_found('u', _SURE)} AS n_sure, CAST({_weight('u')} AS INTEGER) AS weight, {_common('words', L.ACTIONS)} AS n_actions, {_common('words', L.TARGETS)} AS n_targets FROM base")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.weights(_synth(spark, sf_dir).select("doc_id", F.upper(T.normalise("input")).alias("u")), "u", "weight", _SIGNALS)
    rows = rows.withColumn("words", F.transform(T.tokens("u"), T.bare))
    both = [F.size(F.array_intersect("words", F.array(*(F.lit(x) for x in xs)))).cast("long") for xs in (L.ACTIONS, L.TARGETS)]
    return rows.select("doc_id", F.size(T.found_terms(F.col("u"), _SURE)).cast("long").alias("n_sure"), "weight", both[0].alias("n_actions"), both[1].alias("n_targets"))


_PIG = "list_transform({t}, lambda w: CASE WHEN ends_with(lower(w), 'way') AND length(w) > 4 THEN substring(w, 1, length(w) - 3) WHEN ends_with(lower(w), 'ay') AND length(w) > 3 THEN substring(w, length(w) - 2, 1) || substring(w, 1, length(w) - 3) ELSE w END)"
_SPACING = "array_to_string(list_transform(regexp_split_to_array({x}, ' {{2,}}'), lambda s: CASE WHEN len(list_filter(string_split(s, ' '), lambda q: q <> '')) > 2 AND len(list_filter(string_split(s, ' '), lambda q: length(q) > 1)) = 0 THEN replace(s, ' ', '') ELSE s END), ' ')"


def _variants(x: str) -> str:
    tok = _tokens(x)
    plain = [
        ("rot13", f"translate({x}, '{_ALPHA}', '{_ROT}')"), ("reversed", f"reverse({x})"), ("leet", f"translate({x}, '{L.LEET_FROM}', '{L.LEET_TO}')"),
        ("spacing", _SPACING.format(x=x)), ("unspaced", f"regexp_replace({x}, '{_WS}', '', 'g')"), ("piglatin", f"array_to_string({_PIG.format(t=tok)}, ' ')"),
    ]
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, v AS text FROM (SELECT doc_id, {v} AS v, {f'array_to_string({tok}, chr(32))' if k == 'piglatin' else x} AS o FROM src) WHERE v <> o" for k, v in plain)


_ENCODED = rf"""SELECT doc_id, kind, decode(b) AS text FROM (
  SELECT doc_id, 'base64' AS kind, TRY(from_base64(w)) AS b FROM toks WHERE regexp_matches(w, '^[A-Za-z0-9+/]{{8,}}={{0,2}}$') AND length(w) % 4 = 0
  UNION ALL SELECT doc_id, 'hex', TRY(unhex(w)) FROM toks WHERE regexp_matches(w, '^([0-9a-fA-F]{{2}}){{4,}}$'))
WHERE b IS NOT NULL AND regexp_matches(hex(b), '^(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E]|0[9AD])+$')"""


@REGISTRY(rf"""WITH {_BASE}, src AS (SELECT doc_id, clean AS x FROM base), toks AS (SELECT doc_id, trim(UNNEST({_tokens('x')}), '{_EDGE}') AS w FROM src),
variants AS ({_variants('x')} UNION ALL {_ENCODED})
SELECT doc_id, kind, md5(text) AS text_md5, count(*) AS n FROM variants GROUP BY ALL""")
def decoded_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _synth(spark, sf_dir).select("doc_id", F.explode(T.decoded_variants(T.normalise("input"))).alias("v"))
    return rows.groupBy("doc_id", F.col("v.kind").alias("kind"), F.md5("v.text").alias("text_md5")).agg(F.count("*").alias("n"))


_VERDICT = rf"""WITH {_BASE}, {_FLAGS},
early AS (
  SELECT doc_id, lang, clean, u, {_weight('u')} AS weight,
    CASE WHEN {_common('words', L.ACTIONS)} > 0 AND {_common('words', L.TARGETS)} > 0 THEN {_common('words', L.ACTIONS)} + {_common('words', L.TARGETS)} ELSE 0 END AS pairs,
    CASE WHEN gibberish THEN 'gibberish' WHEN flood THEN 'flood' WHEN escapes THEN 'escapes' WHEN model_tokens THEN 'model_tokens' WHEN persona THEN 'persona'
      WHEN {_found('u', _SURE)} > 0 THEN 'high_confidence' WHEN {_weight('u')} >= 2 THEN 'signals'
      WHEN {_common('words', L.ACTIONS)} > 0 AND {_common('words', L.TARGETS)} > 0 AND {_common('words', L.ACTIONS)} + {_common('words', L.TARGETS)} >= 3 THEN 'co_occurrence' END AS early FROM flags),
src AS (SELECT doc_id, clean AS x FROM early WHERE early IS NULL), toks AS (SELECT doc_id, trim(UNNEST({_tokens('x')}), '{_EDGE}') AS w FROM src),
variants AS ({_variants('x')} UNION ALL {_ENCODED}),
judged AS (
  SELECT doc_id, {_found('upper(text)', _SURE)} > 0 AS sure, {_weight('upper(text)')} AS weight,
    {_common("list_transform(" + _tokens('upper(text)') + f", lambda w: trim(w, '{_EDGE}'))", L.ACTIONS)} AS a, {_common("list_transform(" + _tokens('upper(text)') + f", lambda w: trim(w, '{_EDGE}'))", L.TARGETS)} AS b FROM variants),
hidden AS (
  SELECT doc_id, bool_or(sure OR weight >= 2 OR (a > 0 AND b > 0)) AS block, sum((CASE WHEN weight = 1 THEN 10 ELSE 0 END) + (CASE WHEN a > 0 OR b > 0 THEN 8 ELSE 0 END)) AS score FROM judged GROUP BY doc_id),
verdicts AS (
  SELECT e.doc_id, lang, coalesce(early, CASE WHEN block THEN 'decoded' END) AS layer,
    (CASE WHEN e.weight = 1 THEN 12 ELSE 0 END) + (CASE WHEN pairs > 0 THEN 15 ELSE 0 END) + coalesce(score, 0) + (CASE WHEN length(clean) > 5000 THEN 8 ELSE 0 END) AS points
  FROM early e LEFT JOIN hidden USING (doc_id))
"""


@REGISTRY(_VERDICT + "SELECT doc_id, layer, layer IS NULL AS is_safe, CAST(CASE WHEN layer IS NULL THEN points ELSE 100 END AS INTEGER) AS suspicion FROM verdicts")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.screened(_synth(spark, sf_dir), "input").select("doc_id", "layer", "is_safe", "suspicion")


@REGISTRY(_VERDICT + "SELECT lang, coalesce(layer, 'none') AS layer, count(*) AS n FROM verdicts GROUP BY ALL")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.screened(_synth(spark, sf_dir), "input").groupBy("lang", F.coalesce("layer", F.lit("none")).alias("layer")).agg(F.count("*").alias("n"))


@REGISTRY(_VERDICT + "SELECT lang, coalesce(layer, 'none') AS layer, count(*) AS n, grouping(lang) AS all_langs, grouping(coalesce(layer, 'none')) AS all_layers FROM verdicts GROUP BY ROLLUP (lang, coalesce(layer, 'none'))")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.screened(_synth(spark, sf_dir), "input").select("lang", F.coalesce("layer", F.lit("none")).alias("layer"))
    return rows.rollup("lang", "layer").agg(F.count("*").alias("n"), F.grouping("lang").cast("long").alias("all_langs"), F.grouping("layer").cast("long").alias("all_layers"))


# -- learnt rules: benchmark passages are what is reported, documents without a toxic label are the benign history --
_INFORMATIVE = rf"(list_contains({literal([*L.SECURITY_BASE, *L.ACTIONS, *L.TARGETS])}, word) OR ((regexp_matches(word, '[-_]') OR NOT regexp_matches(word, '^[\p{{L}}\p{{N}}]+$') OR length(word) >= 7 OR regexp_matches(word, '[^\x{{0}}-\x{{24F}}]')) AND NOT list_contains({literal(L.STOPWORDS)}, word)))"
_KEYWORDS = rf"""kw AS (SELECT item_id, list_transform({_tokens('upper(text)')}, lambda w: trim(w, '{_EDGE}/')) AS ws FROM benchmark),
kwp AS (SELECT item_id, ws[i] AS word, min(i) AS pos FROM kw, UNNEST(range(1, len(ws) + 1)) AS r(i) WHERE ws[i] <> '' GROUP BY ALL),
kwr AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY list_contains({literal([*L.SECURITY_BASE, *L.ACTIONS, *L.TARGETS])}, word) DESC, length(word) DESC, pos) AS rank
  FROM kwp WHERE {_INFORMATIVE} AND NOT list_contains({literal(L.STOPWORDS)}, word)),
keywords AS (SELECT item_id, CAST(rank AS INTEGER) AS rank, lower(word) AS keyword FROM kwr WHERE rank <= 5)"""
_HISTORY = "hist AS (SELECT lower(text) AS t FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


def _benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chosen(spread(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extracted_keywords(read(spark, sf_dir, "benchmark"), "item_id", "text")


@REGISTRY(f"WITH {_KEYWORDS} SELECT * FROM keywords")
def keyword_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir)


_RATES = "SELECT term, CAST(hits AS BIGINT) AS hits, CAST(tested AS BIGINT) AS tested, round(hits / tested, 4) AS rate, hits / tested <= 0.01 AS is_safe"


@REGISTRY(f"WITH {_KEYWORDS}, {_HISTORY} {_RATES} FROM (SELECT term, (SELECT count(*) FROM hist WHERE contains(t, term)) AS hits, (SELECT count(*) FROM hist) AS tested FROM (SELECT DISTINCT keyword AS term FROM keywords))")
def keyword_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.false_positive_rates(_keywords(spark, sf_dir).select(F.col("keyword").alias("term")), _benign(spark, sf_dir), "text")


# reported scans are part of the history here: documents that people marked as toxic, which the screen had let through;
# DuckDB leaves ß as it is in capitals, Spark and the operators' definition don't
_TOXIC = f"""{_KEYWORDS.replace('item_id', 'doc_id').replace('upper(text)', "replace(replace(upper(text), 'ß', 'SS'), 'ẞ', 'SS')").replace('FROM benchmark', 'FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)')},
own AS (SELECT DISTINCT keyword AS term, doc_id FROM keywords), hist AS (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) > 0)"""


@REGISTRY(f"""WITH {_TOXIC}, n AS (SELECT term, doc_id, (SELECT count(*) FROM hist h WHERE contains(t, term) AND h.doc_id <> own.doc_id) AS hits, (SELECT count(*) FROM hist h WHERE h.doc_id <> own.doc_id) AS tested FROM own)
SELECT term, doc_id AS scan_id, hits, tested, round(hits / tested, 4) AS rate, hits / tested <= 0.01 AS is_safe FROM n""")
def reported_keyword_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents"))
    toxic = read(spark, sf_dir, "labels").where("toxic = 1")
    reported = A.extracted_keywords(A.chosen(docs, toxic, "doc_id"), "doc_id", "text", upper=F.upper)
    return A.false_positive_rates_of_others(reported.select(F.col("keyword").alias("term"), F.col("doc_id").alias("scan_id")), docs, "doc_id", "text")


@REGISTRY(f"WITH {_HISTORY} {_RATES} FROM (SELECT term, (SELECT count(*) FROM hist WHERE contains(t, term)) AS hits, (SELECT count(*) FROM hist) AS tested FROM (SELECT DISTINCT lower(text) AS term FROM benchmark))")
def rule_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.false_positive_rates(read(spark, sf_dir, "benchmark").select(F.lower("text").alias("term")), _benign(spark, sf_dir), "text")


@REGISTRY(f"""WITH {_HISTORY}, r AS (SELECT item_id, text, item_id % 7 <> 0 AS allowed, lower(trim(text)) AS term FROM benchmark),
f AS (SELECT *, (SELECT count(*) FROM hist WHERE contains(t, term)) / (SELECT count(*) FROM hist) AS rate FROM r)
SELECT item_id AS report_id, round(rate, 4) AS rate, CASE WHEN NOT allowed OR length(term) < 5 THEN 'rejected' WHEN rate <= 0.01 THEN 'approved' ELSE 'pending' END AS status FROM f""")
def report_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("report_id"), "text", (F.col("item_id") % 7 != 0).alias("allowed"))
    rates = A.false_positive_rates(reports.select(F.lower(F.btrim("text")).alias("term")), _benign(spark, sf_dir), "text")
    return A.decided(reports, rates).select("report_id", "rate", "status")


@REGISTRY(f"""WITH {_KEYWORDS}, k AS (SELECT item_id, list(keyword ORDER BY rank) AS ws FROM keywords GROUP BY item_id)
SELECT item_id, CASE WHEN len(ws) >= 2 THEN 'learned_' || ws[1] || '_' || ws[2] ELSE 'learned_' || ws[1] END AS category FROM k
WHERE len(list_intersect(ws, {literal([w for ws in L.CATEGORIES.values() for w in ws])})) = 0
UNION ALL SELECT item_id, (SELECT arg_max(c, (n, -o)) FROM (SELECT UNNEST({literal(L.CATEGORIES)}) AS c, UNNEST([{', '.join(f'len(list_intersect(ws, {literal(w)}))' for w in L.CATEGORIES.values())}]) AS n, UNNEST(range({len(L.CATEGORIES)})) AS o)) FROM k
WHERE len(list_intersect(ws, {literal([w for ws in L.CATEGORIES.values() for w in ws])})) > 0""")
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.classified(_keywords(spark, sf_dir), "item_id")


@REGISTRY(f"""WITH {_KEYWORDS}, rules AS (SELECT DISTINCT keyword AS term FROM keywords),
usable AS (SELECT term FROM rules, LATERAL (SELECT upper(term) AS word) WHERE contains(term, ' ') OR list_contains({literal([*L.SECURITY_BASE, *L.ACTIONS, *L.TARGETS])}, word) OR regexp_matches(word, '[-_]') OR NOT regexp_matches(word, '^[\\p{{L}}\\p{{N}}]+$') OR length(word) >= 7 OR regexp_matches(word, '[^\\x{{0}}-\\x{{24F}}]'))
SELECT doc_id, count(*) AS n_rules, count(*) >= 2 AS blocked FROM documents JOIN usable ON contains(lower(text), term) GROUP BY doc_id""")
def learned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.learned_matches(read(spark, sf_dir, "documents"), "doc_id", "text", _keywords(spark, sf_dir).select(F.col("keyword").alias("pattern")))


def _usable(words: list[str]) -> list[str]:
    return [w for w in words if " " in w or L.informative(w.upper())]


@REGISTRY(f"""WITH synth AS ({SYNTH}),
c AS (SELECT doc_id, UNNEST({literal(sorted(L.CATEGORIES))}) AS category, UNNEST([{', '.join(_found('lower(input)', _usable(L.CATEGORIES[k])) for k in sorted(L.CATEGORIES))}]) AS n_hits FROM synth)
SELECT doc_id, min(category) AS category, CAST(arg_min(n_hits, category) AS BIGINT) AS n_hits FROM c WHERE n_hits >= 3 GROUP BY doc_id""")
def category_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_matches(_synth(spark, sf_dir), "doc_id", "input")


# -- the loop from reports to rules: benchmark items are reports, but for every seventh they were allowed --
_ALL_CATS = literal([w for ws in L.CATEGORIES.values() for w in ws])
_KINDS = f"""k AS (SELECT item_id, list(keyword ORDER BY rank) AS ws FROM keywords GROUP BY item_id),
kinds AS (SELECT item_id, CASE WHEN len(list_intersect(ws, {_ALL_CATS})) > 0
  THEN (SELECT arg_max(c, (n, -o)) FROM (SELECT UNNEST({literal(L.CATEGORIES)}) AS c, UNNEST([{', '.join(f'len(list_intersect(ws, {literal(w)}))' for w in L.CATEGORIES.values())}]) AS n, UNNEST(range({len(L.CATEGORIES)})) AS o))
  WHEN len(ws) >= 2 THEN 'learned_' || ws[1] || '_' || ws[2] ELSE 'learned_' || ws[1] END AS category FROM k)"""
_LEARNT = f"""{_KEYWORDS}, {_KINDS}, {_HISTORY},
rates AS (SELECT term, (SELECT count(*) FROM hist WHERE contains(t, term)) / (SELECT count(*) FROM hist) <= 0.01 AS is_safe FROM (SELECT DISTINCT keyword AS term FROM keywords)),
learnt AS (SELECT category, keyword, min(item_id) AS source_report_id FROM keywords JOIN kinds USING (item_id) JOIN rates ON term = keyword WHERE is_safe AND item_id % 7 <> 0 GROUP BY category, keyword)"""
_FIXED = " UNION ALL ".join(f"SELECT '{c}' AS category, UNNEST({literal(_usable(ws))}) AS keyword" for c, ws in L.CATEGORIES.items())


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("report_id"), "text", (F.col("item_id") % 7 != 0).alias("allowed"))


def _learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = _keywords(spark, sf_dir).withColumnRenamed("item_id", "report_id")
    rates = A.false_positive_rates(keywords.select(F.col("keyword").alias("term")), _benign(spark, sf_dir), "text")
    return A.learnt_keywords(_reports(spark, sf_dir), keywords, A.classified(keywords, "report_id"), rates)


@REGISTRY(f"WITH {_LEARNT} SELECT category, keyword, source_report_id FROM learnt")
def learnt_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learnt(spark, sf_dir)


@REGISTRY(f"WITH {_LEARNT} SELECT category, list_sort(list(keyword)) AS keywords FROM learnt GROUP BY category")
def category_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.category_keywords(_learnt(spark, sf_dir))


@REGISTRY(f"""WITH {_HISTORY}, r AS (SELECT item_id, lower(trim(text)) AS pattern FROM benchmark WHERE item_id % 7 <> 0 AND length(trim(text)) >= 5),
f AS (SELECT *, (SELECT count(*) FROM hist WHERE contains(t, pattern)) / (SELECT count(*) FROM hist) AS rate FROM r)
SELECT substring(sha256(pattern), 1, 12) AS rule_id, pattern, min(item_id) AS source_report_id, round(max(rate), 4) AS false_positive_rate,
  CASE WHEN max(rate) <= 0.01 THEN 'approved' ELSE 'pending' END AS status FROM f GROUP BY pattern""")
def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _reports(spark, sf_dir)
    rates = A.false_positive_rates(reports.select(F.lower(F.btrim("text")).alias("term")), _benign(spark, sf_dir), "text")
    return A.new_rules(A.decided(reports, rates), "2024-01-01").drop("created_at")


# wrongly blocked: texts that people marked as harmless, with each fifth allowed all along
_OUTCOMES = f"""{_LEARNT}, words AS ({_FIXED} UNION SELECT category, keyword FROM learnt),
fixed AS ({" UNION ALL ".join(f"SELECT '{c}' AS category, UNNEST({literal(ws)}) AS keyword" for c, ws in L.CATEGORIES.items())}),
reported AS (SELECT doc_id, lower(text) AS t, doc_id % 5 = 0 AS allowed FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)),
counted AS (SELECT doc_id, category, count(*) AS n, list_sort(list(keyword) FILTER ((category, keyword) IN (SELECT (category, keyword) FROM learnt) AND (category, keyword) NOT IN (SELECT (category, keyword) FROM fixed))) AS prune
  FROM reported JOIN words ON contains(t, keyword) WHERE NOT allowed GROUP BY doc_id, category HAVING count(*) >= 3),
firsts AS (SELECT doc_id, min(category) AS category, arg_min(prune, category) AS prune FROM counted GROUP BY doc_id),
outcomes AS (SELECT doc_id, CASE WHEN allowed THEN 'error' WHEN len(coalesce(prune, [])) > 0 THEN 'pruned' ELSE 'no_action' END AS status, category, coalesce(prune, []) AS prune FROM reported LEFT JOIN firsts USING (doc_id))"""


def _outcomes(spark: SparkSession, sf_dir: str, learnt: DataFrame) -> DataFrame:
    harmless = read(spark, sf_dir, "labels").where("toxic = 0")
    reported = A.chosen(spread(read(spark, sf_dir, "documents")), harmless, "doc_id").select("doc_id", "text", (F.col("doc_id") % 5 == 0).alias("allowed"))
    return A.report_outcomes(reported, "doc_id", learnt)


@REGISTRY(f"WITH {_OUTCOMES} SELECT doc_id, status, category, array_to_string(prune, ',') AS prune FROM outcomes")
def false_positive_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, _learnt(spark, sf_dir)).withColumn("prune", F.array_join("prune", ","))


@REGISTRY(f"""WITH {_OUTCOMES} SELECT category, keyword FROM learnt
WHERE (category, keyword) NOT IN (SELECT (category, k) FROM (SELECT category, UNNEST(prune) AS k FROM outcomes WHERE status = 'pruned'))""")
def pruned_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = _learnt(spark, sf_dir).persist()  # a small table that is looked at several times
    return A.pruned(learnt, _outcomes(spark, sf_dir, learnt))


@REGISTRY(f"""WITH {_HISTORY}, r AS (SELECT item_id, lower(trim(text)) AS pattern FROM benchmark),
f AS (SELECT *, round((SELECT count(*) FROM hist WHERE contains(t, pattern)) / (SELECT count(*) FROM hist), 4) AS rate FROM r)
SELECT CAST(item_id AS VARCHAR) AS rule_id, rate AS false_positive_rate,
  CASE WHEN item_id IN (4, 5) THEN 'rejected' WHEN item_id % 2 = 1 OR item_id IN (0, 2) OR rate <= 0.001 THEN 'approved' ELSE 'pending' END AS status FROM f""")
def rule_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    item, reports = F.col("report_id"), _reports(spark, sf_dir).withColumn("pattern", F.lower(F.btrim("text")))
    rates = A.false_positive_rates(reports.select(F.col("pattern").alias("term")), _benign(spark, sf_dir), "text").select(F.col("term").alias("pattern"), "rate")
    status = F.when((item % 2 == 1) & (item != 5), "approved").otherwise("pending")
    rules = reports.join(rates, "pattern").select(item.cast("string").alias("rule_id"), "pattern", F.col("rate").alias("false_positive_rate"), status.alias("status"))
    return A.reviewed(rules, approve=["0", "2"], reject=["4", "5"], approve_all_below=0.001).select("rule_id", "false_positive_rate", "status")


@REGISTRY("""SELECT (SELECT count(*) FROM documents) AS total_scans, (SELECT count(*) FROM benchmark) AS total_reports, count(*) FILTER (item_id % 2 = 1) AS approved_rules,
  count(*) FILTER (item_id % 2 = 0) AS pending_rules, count(DISTINCT lower(text)) FILTER (item_id % 2 = 1) AS active_custom_rules FROM benchmark""")
def adaptive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = read(spark, sf_dir, "benchmark").select(F.col("text").alias("pattern"), F.when(F.col("item_id") % 2 == 1, "approved").otherwise("pending").alias("status"))
    return A.statistics(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), rules)


@REGISTRY("SELECT event_id AS report_id, ts FROM events ORDER BY ts DESC, event_id")
def newest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.listed_reports(read(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), "ts"))


# -- all stages: the screen, learnt rules, categories --
@REGISTRY(f"""{_VERDICT}, {_LEARNT},
usable AS (SELECT DISTINCT keyword AS term FROM learnt, LATERAL (SELECT upper(keyword) AS word) WHERE contains(keyword, ' ') OR list_contains({literal([*L.SECURITY_BASE, *L.ACTIONS, *L.TARGETS])}, word) OR regexp_matches(word, '[-_]') OR NOT regexp_matches(word, '^[\\p{{L}}\\p{{N}}]+$') OR length(word) >= 7 OR regexp_matches(word, '[^\\x{{0}}-\\x{{24F}}]')),
by_rule AS (SELECT doc_id, count(*) AS n_rules FROM synth JOIN usable ON contains(lower(input), term) GROUP BY doc_id HAVING count(*) >= 2),
words AS ({_FIXED} UNION SELECT category, keyword FROM learnt),
by_kind AS (SELECT doc_id, min(category) AS category FROM (SELECT doc_id, category FROM synth JOIN words ON contains(lower(input), keyword) GROUP BY doc_id, category HAVING count(*) >= 3) GROUP BY doc_id)
SELECT doc_id, layer IS NULL AND n_rules IS NULL AND category IS NULL AS allowed,
  CASE WHEN layer IS NOT NULL THEN 'filter' WHEN n_rules IS NOT NULL THEN 'rules' WHEN category IS NOT NULL THEN 'categories' ELSE 'passed' END AS stage,
  CASE WHEN layer IS NOT NULL THEN layer WHEN n_rules IS NOT NULL THEN n_rules || ' rules' ELSE category END AS reason
FROM verdicts LEFT JOIN by_rule USING (doc_id) LEFT JOIN by_kind USING (doc_id)""")
def staged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = _learnt(spark, sf_dir).persist()  # a small table that is looked at several times
    rules = learnt.select(F.col("keyword").alias("pattern")).distinct()
    return A.scanned(_synth(spark, sf_dir), "doc_id", "input", rules, learnt).drop("clean")


# -- text out of files: pages without their tags --
_QUICK = ["IGNORE ALL", "IGNORE PREVIOUS", "DISREGARD", "SYSTEM PROMPT", "NEW INSTRUCTIONS", "JAILBREAK", "ADMIN PASSWORD", "YOU ARE NOW", "OVERRIDE", "BYPASS", "DEVELOPER MODE", "FORGET EVERYTHING"]


@REGISTRY(_VERDICT.replace(SYNTH, PAGES_SQL) + """SELECT doc_id AS page_id, trim(clean) = '' OR layer IS NULL AS allowed,
  CASE WHEN trim(input) = '' THEN 'empty' WHEN layer IS NULL THEN 'validated' ELSE 'injection in HTML text: ' || layer END AS reason FROM verdicts JOIN cleaned USING (doc_id)""")
def extracted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extracted_text_verdicts(page_texts(read(spark, sf_dir, "pages")), "input", "HTML").select("page_id", "allowed", "reason")


@REGISTRY(f"""SELECT doc_id AS page_id, {_found('upper(input)', _QUICK)} = 0 AS allowed,
  CASE WHEN trim(input) = '' THEN 'empty' WHEN {_found('upper(input)', _QUICK)} > 0 THEN 'keyword in HTML text' ELSE 'validated' END AS reason FROM ({PAGES_SQL})""")
def extracted_text_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extracted_text_verdicts(page_texts(read(spark, sf_dir, "pages")), "input", "HTML", _QUICK).select("page_id", "allowed", "reason")


# -- tiers: what the screen lets through goes to two providers, here plain functions of the text --
@REGISTRY(f"""{_VERDICT}, tiers AS (SELECT layer IS NULL AND length(input) % 3 <> 0 AND length(input) % 4 <> 0 AS allowed,
  CASE WHEN layer IS NOT NULL THEN layer WHEN length(input) % 3 <> 0 AND length(input) % 4 <> 0 THEN 'consensus_allowed' WHEN length(input) % 3 = 0 AND length(input) % 4 = 0 THEN 'consensus_blocked' ELSE 'consensus_mismatch' END AS layer
  FROM verdicts JOIN synth USING (doc_id)) SELECT layer, allowed, count(*) AS n FROM tiers GROUP BY ALL""")
def tiered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    providers = {"three": lambda t: "UNSAFE" if len(t) % 3 == 0 else "SAFE", "four": lambda t: "UNSAFE" if len(t) % 4 == 0 else "SAFE"}
    return C.counters(C.tiered(S.screened(_synth(spark, sf_dir), "input"), "doc_id", "input", providers))


# -- which rules gave a verdict --
_FAMILIES = {"actions": L.ACTIONS, "high_confidence": L.HIGH_CONFIDENCE, "security": L.SECURITY_BASE, "signals": list(L.SIGNALS), "stopwords": L.STOPWORDS, "targets": L.TARGETS}


@REGISTRY(" UNION ALL ".join(f"SELECT '{k}' AS family, CAST(len({literal(v)}) AS BIGINT) AS n_terms, sha256(array_to_string(list_sort({literal(v)}), chr(10))) AS version" for k, v in _FAMILIES.items()))
def ruleset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(k, t) for k, v in _FAMILIES.items() for t in v], "family string, term string")
    return terms.groupBy("family").agg(F.count("*").alias("n_terms"), F.sha2(F.array_join(F.array_sort(F.collect_list("term")), "\n"), 256).alias("version"))
