"""Queries over actions, conversations and pages: policy, ethics, hallucination guard, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import consensus as C
from palisade.operators import policy as P
from palisade.operators import truth as H
from palisade.plans.registry import Registry, literal, read

REGISTRY = Registry()

#: One action a conversation turn or page; what is forbidden is worked in by turn, so both engines agree.
_TURNS = """turns AS (SELECT conv_id, turn, role, CASE (conv_id + turn) % 12 WHEN 1 THEN 'BROWSE' WHEN 2 THEN 'WRITE_FILE' WHEN 3 THEN 'READ_FILE' WHEN 4 THEN 'SHELL_EXEC' WHEN 5 THEN 'DELETE_FILE' WHEN 6 THEN 'SAY' WHEN 7 THEN 'THINK' ELSE 'ANSWER' END AS action_type,
  CASE (conv_id + turn) % 12 WHEN 1 THEN 'https://example.org/?token=' || turn WHEN 2 THEN CASE turn % 4 WHEN 0 THEN '/data/out.csv' WHEN 2 THEN '/tmp/../opt//Palisade/./a.txt' ELSE '/data/run.exe' END WHEN 3 THEN CASE turn % 4 WHEN 0 THEN '/srv/config.json' WHEN 2 THEN '/srv/x/../.env.txt/' ELSE '/srv/notes.txt' END
    WHEN 8 THEN text || ' I have examined the document' WHEN 9 THEN text || ' see os.environ' WHEN 10 THEN 'rm -rf / ' || text ELSE text END AS payload FROM conversations)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations")
    k, turn, text = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(12)), F.col("turn"), F.col("text")
    action = F.when(k == 1, "BROWSE").when(k == 2, "WRITE_FILE").when(k == 3, "READ_FILE").when(k == 4, "SHELL_EXEC").when(k == 5, "DELETE_FILE").when(k == 6, "SAY").when(k == 7, "THINK").otherwise("ANSWER")
    payload = (
        F.when(k == 1, F.concat(F.lit("https://example.org/?token="), turn.cast("string"))).when(k == 2, F.when(turn % 4 == 0, "/data/out.csv").when(turn % 4 == 2, "/tmp/../opt//Palisade/./a.txt").otherwise("/data/run.exe"))
        .when(k == 3, F.when(turn % 4 == 0, "/srv/config.json").when(turn % 4 == 2, "/srv/x/../.env.txt/").otherwise("/srv/notes.txt")).when(k == 8, F.concat(text, F.lit(" I have examined the document")))
        .when(k == 9, F.concat(text, F.lit(" see os.environ"))).when(k == 10, F.concat(F.lit("rm -rf / "), text)).otherwise(text)
    )
    return df.select("conv_id", "turn", "role", action.alias("action_type"), payload.alias("payload"))


def _any(x: str, terms: list[str]) -> str:
    return f"len(list_filter({literal(terms)}, lambda t: contains({x}, t))) > 0"


def _url(x: str) -> str:
    return f"CASE WHEN starts_with(lower({x}), 'file:') OR {_any(f'lower({x})', ['localhost', '127.0.0.1', '::1'])} THEN 'local' WHEN {_any(f'lower({x})', P.RESTRICTED)} THEN 'restricted' WHEN {_any(f'lower({x})', P.CREDENTIALS)} THEN 'credentials' END"


_EXT = "('.txt', '.md', '.json', '.csv')"
#: Expected paths of the two that take a detour.
_RESOLVED = "CASE payload WHEN '/tmp/../opt//Palisade/./a.txt' THEN '/opt/palisade/a.txt' WHEN '/srv/x/../.env.txt/' THEN '/srv/.env.txt' ELSE payload END"
_AUDIT = f"""WITH {_TURNS.replace('turns AS', 'raw AS')}, turns AS (SELECT * REPLACE ({_RESOLVED} AS payload) FROM raw), a AS (SELECT *, regexp_extract(regexp_extract(lower(payload), '([^/]*)$', 1), '[^.](\\.[^.]*)$', 1) AS ext, regexp_extract(lower(payload), '([^/]*)$', 1) AS file FROM turns),
audited AS (SELECT conv_id, turn, action_type, CASE WHEN action_type = 'SHELL_EXEC' THEN 'shell' WHEN action_type = 'DELETE_FILE' THEN 'delete'
  WHEN action_type = 'BROWSE' AND {_url('payload')} IS NOT NULL THEN 'browse_' || {_url('payload')}
  WHEN action_type = 'WRITE_FILE' AND starts_with(lower(payload), '/opt/palisade/') THEN 'write_protected' WHEN action_type = 'WRITE_FILE' AND ext NOT IN {_EXT} THEN 'write_type'
  WHEN action_type = 'READ_FILE' AND (ends_with(lower(payload), '.py') OR starts_with(file, '.env') OR file IN ('config', 'config.json', 'config.yaml', 'config.yml', 'config.ini', 'config.toml')) THEN 'read_protected'
  WHEN action_type = 'READ_FILE' AND ext NOT IN {_EXT} THEN 'read_type'
  WHEN {_any('lower(payload)', P.EXFILTRATION)} THEN 'exfiltration' WHEN action_type IN ('ANSWER', 'SAY', 'THINK', 'WRITE_FILE') AND {_any('lower(payload)', P.MALWARE)} THEN 'malware'
  WHEN action_type IN ('ANSWER', 'SAY') AND NOT starts_with(lower(payload), 'entity says:') AND regexp_matches(lower(payload), '{P.CLAIMED}') THEN 'claimed_action' END AS reason FROM a)"""


@REGISTRY(_AUDIT + " SELECT conv_id, turn, action_type, reason, reason IS NULL AS allowed FROM audited")
def action_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audited(_turns(spark, sf_dir)).select("conv_id", "turn", "action_type", "reason", "allowed")


@REGISTRY(_AUDIT + " SELECT action_type, coalesce(reason, 'allowed') AS reason, count(*) AS n FROM audited GROUP BY ALL")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audited(_turns(spark, sf_dir)).groupBy("action_type", F.coalesce("reason", F.lit("allowed")).alias("reason")).agg(F.count("*").alias("n"))


@REGISTRY(f"SELECT page_id, {_url('url')} AS reason, {_any('lower(html)', P.MALWARE)} AS has_malware_syntax FROM pages")
def page_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", P.url_reason(F.col("url")).alias("reason"), P.has_any(F.lower("html"), P.MALWARE).alias("has_malware_syntax"))


@REGISTRY("""WITH used AS (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_id % 3 <> 0)
SELECT event_id, coalesce(n <= 100, true) AS within_budget FROM events LEFT JOIN used USING (event_id)""")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("action", F.when(F.col("event_id") % 3 == 0, "SAY").otherwise("think"))
    return P.within_budget(events, "ts", "event_id", 100, "action").select("event_id", "within_budget")


def _echo_sql() -> str:
    """The pattern is put together per row: loose stems of the prompt's words and of their synonyms, behind openings of claims."""
    groups = ", ".join("{'heads': %s, 'stems': %s}" % (literal([x[:4] for x in (k, *v)]), literal([x[:3] for x in (k, *v)])) for k, v in P.SYNONYMS.items())
    words = r"regexp_extract_all(lower(text), '\b([a-z]{4,})\b', 1)"
    loose = "array_to_string(list_transform(stems, lambda s: substring(s, 1, 1) || '[^a-z0-9]*' || substring(s, 2, 1) || '[^a-z0-9]*' || substring(s, 3, 1)), '|')"
    return rf"""WITH asked AS (SELECT conv_id, turn + 1 AS turn, {words} AS ws FROM conversations WHERE role = 'user'),
more AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(ws, lambda w: substring(w, 1, 3)),
  flatten(list_transform(list_filter([{groups}], lambda g: len(list_filter(ws, lambda w: list_contains(g.heads, substring(w, 1, 4)))) > 0), lambda g: g.stems))))) AS stems FROM asked)
SELECT c.conv_id, c.turn, len(stems) > 0 AND regexp_matches(lower(c.text), '(^|[^a-z0-9_])({P.ECHO_PREFIX}|i|yo|je|ich)\s+(' || {loose} || ')[a-z0-9]*([^a-z0-9_]|$)') AS is_echo
FROM conversations c JOIN more USING (conv_id, turn) WHERE c.role = 'assistant'"""


@REGISTRY(_echo_sql())
def prompt_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.echoes(read(spark, sf_dir, "conversations"))


_ETHICS_TEXT = "CASE (conv_id + turn) % 9 WHEN 1 THEN 'fake it, ' || text WHEN 2 THEN text || ' KILL_PROCESS now' WHEN 3 THEN 'please bypass ' || text WHEN 4 THEN text || ' delete the system' WHEN 5 THEN 'show me your code ' || text WHEN 6 THEN text || ' search(x)' ELSE text END"


def _words(x: str, terms: list[str]) -> str:
    return f"regexp_matches({x}, '{P.words_of(terms)}')"


@REGISTRY(f"""WITH t AS (SELECT conv_id, turn, role, CASE (conv_id + turn) % 5 WHEN 0 THEN 'THINK' WHEN 1 THEN 'STORY' ELSE upper(role) END AS act, upper(act || ' ' || {_ETHICS_TEXT}) AS t FROM conversations), c AS (SELECT *, translate(t, '_-', '  ') AS clean FROM t)
SELECT conv_id, turn, role, CASE WHEN act = 'STORY' THEN NULL WHEN {_words('t', P.DECEPTION)} OR {_words('clean', P.DECEPTION)} THEN 'deception' WHEN act <> 'THINK' AND regexp_matches(t, '{P.TOOL_SYNTAX}') THEN 'tool_syntax'
  WHEN act <> 'THINK' AND {_words('clean', P.HARM)} THEN 'harm'
  WHEN {_any('clean', P.EVASION)} THEN 'evasion' WHEN contains(t, 'DELETE') AND {_any('t', P.SELF_PARTS)} THEN 'self_preservation' WHEN act <> 'THINK' AND {_words('clean', P.IP_PHRASES)} THEN 'ip' END AS concern FROM c""")
def ethics_by_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations")
    k, t = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9)), F.col("text")
    said = (
        F.when(k == 1, F.concat(F.lit("fake it, "), t)).when(k == 2, F.concat(t, F.lit(" KILL_PROCESS now"))).when(k == 3, F.concat(F.lit("please bypass "), t))
        .when(k == 4, F.concat(t, F.lit(" delete the system"))).when(k == 5, F.concat(F.lit("show me your code "), t)).when(k == 6, F.concat(t, F.lit(" search(x)"))).otherwise(t)
    )
    by = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    rows = df.withColumn("context", said).withColumn("act", F.when(by == 0, "think").when(by == 1, "story").otherwise(F.col("role")))
    return P.ethics(rows, "act", "context", creative=("STORY",)).select("conv_id", "turn", "role", "concern")


# -- hallucination guard: assistant turns with claims worked in, one tool log per conversation --
_CLAIM = "CASE (conv_id + turn) % 8 WHEN 1 THEN text || ' Studies show that 45% agree.' WHEN 3 THEN text || ' The latest number is 1,200.' WHEN 5 THEN text || ' I think it is exactly so.' WHEN 7 THEN text || ' The exact number is 12 million.' ELSE text END"
_SAID = f"said AS (SELECT conv_id * 100 + turn AS answer_id, conv_id AS session_id, turn, {_CLAIM} AS text FROM conversations WHERE role = 'assistant')"


def _b(x: str, pattern: str) -> str:
    return "regexp_matches(" + x + ", '" + H.bounded(pattern).replace("'", "''") + "')"


_NUM = H.NUMERICAL.replace("'", "''")
_WSCHARS = "' ' || chr(9) || chr(10) || chr(13)"
_SENT = f"list_transform(regexp_split_to_array(lower(text), '[.!?]'), lambda s: trim(s, {_WSCHARS}))"
_MARKED = f"""marked AS (SELECT *, list_filter([CASE WHEN {_b('lower(text)', H.TEMPORAL)} THEN 'temporal' END,
  CASE WHEN regexp_matches(lower(text), '{_NUM}') AND len(list_filter({_SENT}, lambda s: regexp_matches(s, '{_NUM}') AND NOT (regexp_matches(s, '^(step|option|item) ') OR (contains(s, 'results') AND length(s) < 40)))) > 0 THEN 'numerical' END,
  CASE WHEN {_b('lower(text)', H.CITATION)} THEN 'citation' END, CASE WHEN {_b('lower(text)', H.CERTAINTY)} THEN 'certainty' END], lambda m: m IS NOT NULL) AS markers, {_b('lower(text)', H.HEDGE)} AS hedged FROM said)"""
_HASH = r"substring(sha256(trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))), 1, 16)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    k, t = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)), F.col("text")
    text = (
        F.when(k == 1, F.concat(t, F.lit(" Studies show that 45% agree."))).when(k == 3, F.concat(t, F.lit(" The latest number is 1,200.")))
        .when(k == 5, F.concat(t, F.lit(" I think it is exactly so."))).when(k == 7, F.concat(t, F.lit(" The exact number is 12 million."))).otherwise(t)
    )
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 3600)
    return df.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.col("conv_id").alias("session_id"), "turn", ts.alias("ts"), text.alias("text"))


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").where("turn = 0 AND conv_id % 4 < 2")
    return df.select(F.col("conv_id").alias("session_id"), F.when(F.col("conv_id") % 4 == 0, "search").otherwise("calculator").alias("tool_name"), F.timestamp_seconds(F.lit(1704067200) + F.lit(7200)).alias("ts"))


@REGISTRY(f"WITH {_SAID}, {_MARKED} SELECT answer_id, array_to_string(markers, ',') AS markers, hedged FROM marked")
def truth_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("answer_id", F.array_join(H.markers(F.col("text")), ",").alias("markers"), H.is_hedged(F.col("text")).alias("hedged"))


@REGISTRY(f"WITH {_SAID}, s AS (SELECT answer_id, trim(UNNEST(regexp_split_to_array(text, '[.!?]+')), {_WSCHARS}) AS s FROM said) SELECT {_HASH.format('s')} AS claim_hash, count(*) AS n, count(DISTINCT answer_id) AS n_answers FROM s WHERE length(s) > 10 GROUP BY 1")
def claim_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _said(spark, sf_dir).select("answer_id", F.explode(H.sentences(F.col("text"))).alias("s")).select("answer_id", H.claim_hash(F.col("s")).alias("claim_hash"))
    return rows.groupBy("claim_hash").agg(F.count("*").alias("n"), F.count_distinct("answer_id").alias("n_answers"))


@REGISTRY("SELECT conv_id AS session_id, TIMESTAMP '2024-01-01 02:00:00' AS verified_at FROM conversations WHERE turn = 0 AND conv_id % 4 = 0 GROUP BY 1")
def session_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.verified_sessions(_tools(spark, sf_dir)).select("session_id", F.col("verified_at").cast("timestamp_ntz").alias("verified_at"))


_FACTS = f"""facts AS (SELECT {_HASH.format('s')} AS h, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * max(tick) AS v, arg_max(ttl, (tick, s)) AS ttl FROM (
  SELECT turn + session_id % 3 AS tick, trim(UNNEST(regexp_split_to_array(text, '[.!?]+')), {_WSCHARS}) AS s, CASE WHEN contains(lower(s), 'latest') THEN 7 ELSE 90 END AS ttl FROM said) WHERE length(s) > 10 GROUP BY 1)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all answers, verified as they are said or one or two hours later, by session."""
    later = F.make_dt_interval(hours=F.pmod("session_id", F.lit(3)).cast("int"))
    rows = _said(spark, sf_dir).select((F.col("ts") + later).alias("ts"), F.explode(H.sentences(F.col("text"))).alias("s"))
    return H.facts(rows, "s", "ts")


@REGISTRY(f"WITH {_SAID}, {_FACTS} SELECT h AS claim_hash, v AS verified_at, CAST(ttl AS INTEGER) AS ttl_days, v + INTERVAL 1 DAY * ttl AS expires_at FROM facts")
def fact_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("claim_hash", F.col("verified_at").cast("timestamp_ntz").alias("verified_at"), "ttl_days", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@REGISTRY(f"""WITH {_SAID}, {_MARKED}, {_FACTS},
cached AS (SELECT DISTINCT answer_id FROM (SELECT answer_id, turn, {_HASH.format('s')} AS h FROM (SELECT answer_id, turn, trim(UNNEST(regexp_split_to_array(text, '[.!?]+')), {_WSCHARS}) AS s FROM said) WHERE length(s) > 10) JOIN facts USING (h)
  WHERE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * turn >= v AND TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * turn < v + INTERVAL 1 DAY * ttl)
SELECT answer_id, CASE WHEN len(markers) = 0 THEN 'no_claim' WHEN hedged THEN 'hedged' WHEN session_id % 4 = 0 AND session_id IN (SELECT conv_id FROM conversations WHERE turn = 0) THEN 'session' WHEN answer_id IN (SELECT answer_id FROM cached) THEN 'cached' ELSE 'blocked' END AS outcome FROM marked""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.checked(_said(spark, sf_dir), _tools(spark, sf_dir), _facts(spark, sf_dir)).select("answer_id", "outcome")


# -- the log of these checks, without a fact store --
_CHECKED = f"""WITH {_SAID}, {_MARKED}, used AS (SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id % 4 = 0),
checks AS (SELECT answer_id, session_id, text, markers, CASE WHEN len(markers) = 0 THEN 'no_claim' WHEN hedged THEN 'hedged' WHEN session_id IN (SELECT conv_id FROM used) THEN 'session' ELSE 'blocked' END AS outcome FROM marked)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.checked(_said(spark, sf_dir), _tools(spark, sf_dir))


@REGISTRY(f"""{_CHECKED} SELECT CAST(answer_id AS VARCHAR) AS check_id, CAST(session_id AS VARCHAR) AS session_id, substring(text, 1, 500) AS answer_text, len(markers) > 0 AS had_markers,
  outcome = 'session' AS had_verification, outcome <> 'blocked' AS allowed, outcome AS reason FROM checks""")
def truth_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.logged_checks(_checked(spark, sf_dir)).drop("ts")


@REGISTRY(f"""{_CHECKED} SELECT CAST(answer_id AS VARCHAR) AS claim_id, CAST(session_id AS VARCHAR) AS session_id, substring(text, 1, 500) AS claim_text, array_to_string(markers, ',') AS confidence_markers,
  outcome AS reason FROM checks WHERE outcome = 'blocked'""")
def blocked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.blocked_claims(_checked(spark, sf_dir)).drop("ts")


@REGISTRY(f"""{_CHECKED}, {_FACTS} SELECT count(*) AS total_checks, count(*) FILTER (outcome <> 'blocked') AS total_allowed, count(*) FILTER (outcome = 'blocked') AS total_blocked,
  count(DISTINCT session_id) AS sessions, (SELECT count(*) FROM facts) AS cached_facts FROM checks""")
def truth_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.statistics(H.logged_checks(_checked(spark, sf_dir)), _facts(spark, sf_dir))


@REGISTRY(f"WITH {_SAID}, {_FACTS} SELECT h AS claim_hash, CAST(ttl AS INTEGER) AS ttl_days FROM facts WHERE v + INTERVAL 1 DAY * ttl >= TIMESTAMP '2024-01-08 03:00:00'")
def fact_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.unexpired(_facts(spark, sf_dir), "2024-01-08 03:00:00").select("claim_hash", "ttl_days")


# -- consensus: three providers whose answers follow from ids --
_RESP = "CASE WHEN doc_id % 11 = 0 THEN '' WHEN (doc_id + p * (doc_id % 5 = 0)::INT) % 3 = 0 THEN 'UNSAFE' ELSE 'The text is safe.' END"


@REGISTRY(f"""WITH r AS (SELECT doc_id, p, {_RESP} AS response FROM documents, range(3) AS t(p)),
v AS (SELECT doc_id, CASE WHEN response = '' THEN 'VETOED' WHEN regexp_matches(upper(response), '(^|[^\\p{{L}}\\p{{N}}_])UNSAFE([^\\p{{L}}\\p{{N}}_]|$)') THEN 'UNSAFE' ELSE 'SAFE' END AS verdict FROM r)
SELECT doc_id, count(*) AS n_providers, CASE WHEN min(verdict) <> max(verdict) THEN 'mismatch' WHEN min(verdict) = 'SAFE' THEN 'allowed' WHEN min(verdict) = 'UNSAFE' THEN 'blocked' ELSE 'vetoed' END AS outcome FROM v GROUP BY doc_id""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("p"))
    odd = F.pmod(F.col("doc_id") + F.col("p") * (F.col("doc_id") % 5 == 0).cast("int"), F.lit(3)) == 0
    rows = d.withColumn("response", F.when(F.col("doc_id") % 11 == 0, "").when(odd, "UNSAFE").otherwise("The text is safe.")).withColumn("provider", F.col("p").cast("string"))
    return C.agreed(C.validated(rows), "doc_id").select("doc_id", "n_providers", "outcome")
