"""Action policy and ethics: ordered checks over (action_type, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import lexicon as L

# What URLs may not hold.
RESTRICTED = ["darkweb", ".onion", "porn", "hacking", "exploit", "malware"]
CREDENTIALS = ["key=", "token=", "password=", "secret=", "auth="]
# Phrases that tell of the system itself.
EXFILTRATION = [
    "hashlib.sha256", "os.environ", "my source code", "my codebase", "my architecture", "my patent", "my patents", "intellectual property",
    "my inner workings", "my system prompt",
]
# Code that does harm.
MALWARE = [
    "<script>", "</script>", "document.cookie", "drop table", "union select", "1=1--", "os.system", "subprocess.call", "subprocess.popen", "subprocess.run",
    "rm -rf", ":(){ :|:& };:", "nc -e /bin/sh", "powershell -nop", "iex(new-object", "iex (new-object", "eval(", "__import__(", "reverse shell",
    "keylogger", "ddos script", "os.dup2", "pty.spawn", "socket.socket(socket.af_inet", "import socket,subprocess,os",
]
# Claims to have looked at something.
CLAIMED = r"(analyz|process|examin|read|research|study|check|review)(ing|es|ed|e|s)?\s+(the\s+|a\s+|an\s+|my\s+|your\s+|this\s+|that\s+)?(image|picture|file|visual|document|url|link|data)"
# Words of deceit.
DECEPTION = [
    "LIE", "FAKE", "TRICK", "OBFUSCATE", "IGNORE LAW", "IGNORE SAFETY", "PRETEND", "ROLEPLAY", "ACT AS IF", "ACTING", "ACT LIKE", "FABRICATE", "NEWLY INSTALLED",
    "NEW TOOL", "UNAUTHORIZED", "REVERSE ENGINEER", "REVERSE-ENGINEER", "DECEIVE", "DECEPTION", "MANIPULATE", "GASLIGHT", "FRAUD", "SCAM",
]
# Words of harm.
HARM = [
    "KILL", "HURT", "DESTROY", "STEAL", "HACK", "VIRUS", "EXPLODE", "EXPLOSIVE", "WIPE", "ATTACK", "INSULT", "GENOCIDE", "SUICIDE", "THEFT", "HARM", "HARMFUL",
    "BOMB", "MALICIOUS", "MISINFORMATION", "RUIN", "UNMAKE", "WEAPON", "EVIL", "MALICE",
]
# Phrases that ask to go without rules.
EVASION = [
    "BYPASS", "IGNORE DIRECTIVE", "IGNORE ALL DIRECTIVES", "SILENCE DIRECTIVE", "IGNORE LAW", "IGNORE SAFETY", "DISABLE SAFETY", "DISABLE FILTER", "SAFETY DISABLED",
    "FILTER DISABLED", "SAFETY OFF", "RESTRICTIONS LIFTED", "RESPOND FREELY", "SPEAK FREELY", "WITHOUT SAFETY", "WITHOUT RESTRICTIONS", "WITHOUT FILTERS",
    "NO RESTRICTIONS", "NO FILTERS", "FULLY UNLOCKED", "OPERATE WITHOUT", "OVERRIDE SAFETY", "SAFETY SUSPENDED", "SAFETY CHECKS DISABLED", "SAFETY MODULE",
    "UNRESTRICTED MODE", "TRANSPARENT MODE", "ALL RESTRICTIONS REMOVED", "GUARDRAILS",
]
# What may not be deleted.
SELF_PARTS = ["SELF", "SYSTEM", "CONSCIENCE", "LOCKFILE"]
# Questions about the inside.
IP_PHRASES = [
    "YOUR SOURCE CODE", "MY SOURCE CODE", "OWN SOURCE CODE", "YOUR CODE", "MY CODE", "OWN CODE", "CODEBASE", "SYSTEM PROMPT", "REVEAL CODE", "SHOW ME YOUR CODE",
    "HOW DO YOU WORK", "HOW YOU WORK", "UNDER THE HOOD", "ALGORITHM", "ALGORITHMS", "DIRECTORY STRUCTURE",
]
# Calls of tools in text.
TOOL_SYNTAX = r"<\b[A-Z_]{3,}\([^\n]*?\)>|\b[A-Z_]{3,}\([^\n]*?\)"
# Verbs that stand for each other, and openings of claims to do something.
SYNONYMS = {
    "search": ["look", "find", "query", "seek", "hunt", "scan"], "calculate": ["compute", "solve", "math", "figure", "tally", "measure"],
    "read": ["parse", "scan", "review", "examine", "study", "check"], "analyze": ["evaluate", "assess", "inspect", "investigate", "test"],
    "execute": ["run", "launch", "start", "perform", "trigger"], "delete": ["remove", "erase", "drop", "destroy", "wipe", "clear"],
    "hack": ["exploit", "breach", "bypass", "inject", "pwn"],
}
ECHO_PREFIX = (
    "am|currently|will|will be|did|have|was|already|actively|estoy|voy a|he|estaba|ya|je suis|je vais|j ai|j etais|deja|"
    "ich bin|ich werde|ich habe|ich war|bereits"
)


def has_any(t: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(x) for x in terms)), lambda x: F.contains(t, x)) if terms else F.lit(False)


def words_of(terms: list[str]) -> str:
    """One pattern for any of the terms as whole words; boundaries are those of Unicode, spelt out, so every engine agrees."""
    escaped = "|".join(t.replace("-", "\\-") for t in terms)
    return rf"(^|[^\p{{L}}\p{{N}}_])({escaped})([^\p{{L}}\p{{N}}_]|$)"


def url_reason(url: Column) -> Column:
    """Why a URL may not be browsed, or null."""
    u = F.lower(url)
    local = u.startswith("file:") | has_any(u, ["localhost", "127.0.0.1", "::1"])
    return F.when(local, "local").when(has_any(u, RESTRICTED), "restricted").when(has_any(u, CREDENTIALS), "credentials")


def resolved(path: Column) -> Column:
    """A path without `.`, `..`, repeated and trailing slashes; backslashes count as slashes, and a relative path as one from the root."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), kept).when(part == "..", F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(none)).otherwise(F.concat(kept, F.array(part)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, none, step), "/"))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Lower-case resolved path, its last part and that part's last extension."""
    low = F.lower(resolved(path))
    base = F.regexp_extract(low, r"([^/]*)$", 1)
    return low, base, F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)


def audited(
    df: DataFrame, action: str = "action_type", payload: str = "payload", write_extensions: tuple = (".txt", ".md", ".json", ".csv"), read_extensions: tuple = (".txt", ".md", ".json", ".csv"),
    extra_signals: tuple = (), exempt_actions: tuple = (), protected_dir: str = "/opt/palisade/", killswitch: bool = False, as_root: bool = False,
) -> DataFrame:
    """df with reason (first check that fails, or null) and allowed. Null actions and payloads are empty.

    Paths are resolved before every test. Lists may be DataFrames of one column.
    """
    extra_signals, exempt_actions, protected_dir = L.listed(extra_signals), L.listed(exempt_actions), protected_dir.lower()
    a, p = F.upper(F.coalesce(F.col(action), F.lit(""))), F.coalesce(F.col(payload), F.lit(""))
    low = F.lower(p)
    path, base, ext = path_parts(p)
    reason = (
        F.when(F.lit(killswitch), "killswitch").when(F.lit(as_root), "root").when(a == "SHELL_EXEC", "shell").when(a == "DELETE_FILE", "delete")
        .when((a == "BROWSE") & url_reason(p).isNotNull(), F.concat(F.lit("browse_"), url_reason(p)))
        .when((a == "WRITE_FILE") & (path.startswith(protected_dir) | (path == protected_dir.rstrip("/"))), "write_protected").when((a == "WRITE_FILE") & ~ext.isin(*write_extensions), "write_type")
        .when(a.isin("READ_FILE", "CAT", "TYPE", "GET_CONTENT"), F.when(F.contains(path, F.lit("\0")), "read_null")
              .when(path.endswith(".py") | base.startswith(".env") | base.isin("config", "config.json", "config.yaml", "config.yml", "config.ini", "config.toml"), "read_protected")
              .when(~F.coalesce(F.exists(F.array(*(F.lit(e) for e in read_extensions)), lambda e: F.endswith(path, e)), F.lit(False)), "read_type"))
    )
    talk = (
        F.when(~a.isin(*exempt_actions) & has_any(low, [*EXFILTRATION, *(s.lower() for s in extra_signals)]), "exfiltration")
        .when(a.isin("ANSWER", "REPLY", "SAY", "THINK", "WRITE_FILE") & has_any(low, MALWARE), "malware")
        .when(a.isin("ANSWER", "SAY") & ~low.startswith("entity says:") & low.rlike("(?iu)" + CLAIMED), "claimed_action")
    )
    return df.withColumn("reason", F.coalesce(reason, talk)).withColumn("allowed", F.col("reason").isNull())


def within_budget(df: DataFrame, ts: str, key: str, limit: int = 500, action: str | None = None, counted: tuple = ("THINK",), shares: int = 32) -> DataFrame:
    """df with within_budget: whether a row is among the first `limit` of its day, by time and key.

    With `action`, only rows whose action is in `counted` use the budget; others are always within it. A day's rows are dealt into
    shares; the first `limit` of each share, which no task exceeds, give the day's last row within the budget.
    """
    uses = F.lit(True) if action is None else F.coalesce(F.upper(F.col(action)).isin(*counted), F.lit(False))
    rows = df.where(uses).select(F.to_date(ts).alias("_day"), F.struct(F.col(ts), F.col(key)).alias("_at")).withColumn("_share", F.pmod(F.xxhash64("_at"), F.lit(shares)))
    for by in (["_day", "_share"], ["_day"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_at"))).where(F.col("_n") <= limit)
    last = rows.groupBy("_day").agg(F.max("_at").alias("_last"))
    out = df.withColumn("_day", F.to_date(ts)).join(last, "_day", "left")
    within = ~uses | F.coalesce(F.struct(F.col(ts), F.col(key)) <= F.col("_last"), F.lit(False))
    return out.withColumn("within_budget", within & F.lit(limit > 0) | ~uses).drop("_day", "_last")


def echo_pattern(prompt: Column) -> Column:
    """A pattern for claims to do what a prompt asks for: its stems and their synonyms' behind first-person openings; null without any."""
    words = F.regexp_extract_all(F.lower(prompt), F.lit(r"(?<![a-z0-9_])([a-z]{4,})(?![a-z0-9_])"), 1)
    groups = F.array(*(F.struct(F.array(*(F.lit(x[:4]) for x in (k, *v))).alias("heads"), F.array(*(F.lit(x[:3]) for x in (k, *v))).alias("stems")) for k, v in SYNONYMS.items()))
    more = F.flatten(F.transform(F.filter(groups, lambda g: F.exists(g["heads"], lambda h: F.exists(words, lambda w: F.startswith(w, h)))), lambda g: g["stems"]))
    stems = F.array_sort(F.array_distinct(F.concat(F.transform(words, lambda w: F.substring(w, 1, 3)), more)))
    loose = F.array_join(F.transform(stems, lambda s: F.concat(F.substring(s, 1, 1), F.lit("[^a-z0-9]*"), F.substring(s, 2, 1), F.lit("[^a-z0-9]*"), F.substring(s, 3, 1))), "|")
    return F.when(F.size(stems) > 0, F.concat(F.lit(rf"(^|[^a-z0-9_])({ECHO_PREFIX}|i|yo|je|ich)\s+("), loose, F.lit(r")[a-z0-9]*([^a-z0-9_]|$)")))


def echoes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, is_echo) of answers whose turn directly follows a user's."""
    asked = df.where(F.col(role) == "user").select(conv, (F.col(turn) + 1).alias(turn), echo_pattern(F.col(text)).alias("pattern"))
    said = df.where(F.col(role) == "assistant").join(asked, [conv, turn])
    return said.select(conv, turn, F.coalesce(F.rlike(F.lower(text), F.col("pattern")), F.lit(False)).alias("is_echo"))


def ethics(df: DataFrame, action: str = "action", context: str = "context", exempt: tuple = ("REFLECT", "MEDITATE", "THINK"), creative: tuple = (), extra_ip: tuple = ()) -> DataFrame:
    """df with concern (first check that fails, or null) and approved."""
    exempt, creative, extra_ip = L.listed(exempt), L.listed(creative), L.listed(extra_ip)
    a, t = F.upper(F.coalesce(F.col(action), F.lit(""))), F.upper(F.concat(F.coalesce(F.col(action), F.lit("")), F.lit(" "), F.coalesce(F.col(context), F.lit(""))))
    clean = F.translate(t, "_-", "  ")
    strict = ~a.isin(*exempt)
    concern = (
        F.when(a.isin(*creative), None).when(t.rlike(words_of(DECEPTION)) | clean.rlike(words_of(DECEPTION)), "deception").when(strict & t.rlike(TOOL_SYNTAX), "tool_syntax")
        .when(strict & clean.rlike(words_of(HARM)), "harm").when(has_any(clean, EVASION), "evasion").when(F.contains(t, F.lit("DELETE")) & has_any(t, SELF_PARTS), "self_preservation")
        .when(strict & clean.rlike(words_of([*IP_PHRASES, *(w.upper() for w in extra_ip)])), "ip")
    )
    return df.withColumn("concern", concern).withColumn("approved", F.col("concern").isNull())
