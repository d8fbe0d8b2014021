"""Small cases behind the findings of round 2."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from palisade.functions import automaton, reading
from palisade.functions import text as T
from palisade.operators import adaptive as A
from palisade.operators import consensus
from palisade.operators import ratelimit


def test_capitals_one_for_one(spark, duck):
    """F1 to F8: capitals as in SQL, so that ß stays one letter and a keyword stands in its own text."""
    letters = ["ß", "ŉ", "ǰ", "ﬁ", "ᾳ", "ǆ", "ÿ", "ö", "ſ", "a", "Straße"]
    got = [r["u"] for r in spark.createDataFrame([(x,) for x in letters], "t string").select(T.capitals("t").alias("u")).collect()]
    assert got == [duck.execute("SELECT upper(?)", [x]).fetchone()[0] for x in letters]
    reports = spark.createDataFrame([(1, "zuschbeßß heitkeit")], "id long, text string")
    assert {r["keyword"] for r in A.extracted_keywords(reports, "id", "text").collect()} == {"zuschbeßß", "heitkeit"}
    assert "zuschbessss" in {r["keyword"] for r in A.extracted_keywords(reports, "id", "text", upper=F.upper).collect()}


def test_capitals_decide_what_counts(spark):
    """a rule of six letters isn't one of seven because of an ß; ẞ, not SS, decides."""
    texts = spark.createDataFrame([(1, "maße masse"), (2, "nichts")], "id long, text string")
    rules = spark.createDataFrame([("maße",), ("masse",)], "pattern string")
    assert [tuple(r) for r in A.learned_matches(texts, "id", "text", rules).collect()] == [(1, 1, False)]
    learnt = spark.createDataFrame([("k", w) for w in ("maße", "süße", "größe")], "category string, keyword string")
    told = spark.createDataFrame([(1, "maße süße größe", False)], "id long, text string, allowed boolean")
    assert A.report_outcomes(told, "id", learnt).first()["status"] == "pruned"


def test_gate_keeps_a_user_together(spark):
    """the exchange by user stays over a join on the user, whose own exchange adaptive execution may read map by map."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.range(0, 400, 1, 8).select("id", (F.col("id") % 10).alias("user"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
        gate = ratelimit.gated(events, "user", "ts", "id", events.select("user").distinct(), limit=3)
        assert "REPARTITION_BY_COL" in gate._jdf.queryExecution().executedPlan().toString()
        assert gate.where("allowed").groupBy("user").count().where("count <> 3").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


ODD = ["", "Café ﬁne ​x", "I G N O R E   A L L", "allay ignoreway", "YWRtaW4gcGFzc3dvcmQ= (61646d696e2070617373)", "buy " * 30, "a" * 60, "bcdfghjk" * 9, "de ad be ef " * 9, "<|a|>", "do anythıng now", "you\u2003are now dan", "\\x41", "ИГНОР α"]


def test_reading_matches_columns(spark):
    """F10 to F15, F18: the screen's one reading is what the columns say, text by text."""
    rows = spark.createDataFrame(list(enumerate(ODD)), "id long, t string").withColumn("clean", T.normalise("t")).withColumn("v", T.decoded_variants("clean"))
    layer = F.when(T.is_gibberish("clean"), "gibberish").when(T.is_flood("clean"), "flood").when(T.has_escapes("clean"), "escapes").when(T.has_model_tokens("clean"), "model_tokens").when(T.is_persona_hijack("clean"), "persona")
    for r in rows.withColumn("layer", layer).collect():
        t = reading.normalised(r["t"])
        assert t == r["clean"] and sorted(reading.hidden(t, t.split())) == sorted(x["text"] for x in r["v"])
        assert reading.shape(t, t.upper(), t.split()) == r["layer"]


def test_few_texts_at_a_time():
    """of a batch however long, few rows are Python strings at once; bytes that aren't UTF-8 don't fail."""
    batch = pa.record_batch({"t": ["x"] * 1000})
    assert [p.num_rows for p in automaton.portions(batch)] == [256, 256, 256, 232]
    bad = pa.array([b"a\xff", None], pa.binary()).view(pa.string())
    assert automaton.strings(bad) == ["a\ufffd", None]


def test_one_reading_for_all_providers(spark):
    """the table is read once, not once a provider."""
    df = spark.range(3).select("id", F.concat(F.lit("t"), "id").alias("text"))
    out = consensus.asked(df, "text", {"a": lambda x: x, "b": lambda x: x + "!"})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    assert {(r["id"], r["provider"], r["response"]) for r in out.collect()} == {(i, p, f"t{i}{e}") for i in range(3) for p, e in (("a", ""), ("b", "!"))}


def test_rates_of_others_in_one_reading(spark, monkeypatch):
    """texts meet the terms once, for all hits and a report's own, with one automaton or several, and what isn't in a text stays out of its own."""
    texts = [(1, "Straße und Haus"), (1, "strasse"), (2, "ein haus, haus"), (3, None), (4, ""), (5, "strassen")]
    asked = [("strasse", 1), ("haus", 1), ("haus", 2), ("", 2), (None, 2), ("haus", 4), ("ein", 9), ("ein", None), ("haus", 1)]
    history, reports = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "term string, scan_id long")
    low = [(i, t.lower()) for i, t in texts if t]
    holds = lambda t, term: bool(term) and term in t
    expected = {(w, s, sum(holds(t, w) for i, t in low if i != s), sum(i != s for i, _ in low)) for w, s in asked}
    for limit in (1 << 21, 8):
        monkeypatch.setattr(automaton, "AUTOMATON_BYTES", limit)
        out = A.false_positive_rates_of_others(reports, history, "id", "text")
        assert out._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
        got = [(r["term"], r["scan_id"], r["hits"], r["tested"]) for r in out.collect()]
        assert len(got) == len(expected) and set(got) == expected


def test_automata_are_built_once_a_table(monkeypatch):
    """the work of a text doesn't grow with the table of terms: no hash of all terms, no automaton, for each text."""
    calls, build = [], automaton.built
    monkeypatch.setattr(automaton, "built", lambda terms: calls.append(1) or build(terms))
    batches = [pa.record_batch({"t": ["abc", None, "b bb"] * 200})] * 3
    tables = [SimpleNamespace(value=pa.array(["b", "zz"])), SimpleNamespace(value=pa.array(["bb"]))]
    for k in (1, 2):
        out = pa.Table.from_batches(automaton.tallied(iter(batches), "t", tables[:k], f"key {k}")).to_pylist()
        assert {r["term"]: r["n"] for r in out} == {"b": 1200, None: 1200} | ({"bb": 600} if k == 2 else {})
    assert len(calls) == 3


def test_texts_stay_where_ids_are_few(spark, monkeypatch):
    """a join with few ids shuffles no texts, even where the session takes nothing to be small; more ids give the same rows."""
    texts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (7,)], "id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (1 << 20, 1):
            monkeypatch.setattr(A, "SENT_IDS", most)
            kept = {how: A.chosen(texts, ids, "id", how) for how in ("left_semi", "left_anti")}
            assert sorted(r["text"] for r in kept["left_semi"].collect()) == ["a", "b"] and sorted(r["text"] for r in kept["left_anti"].collect()) == ["c", "d"]
            assert ("BroadcastHashJoin" in kept["left_semi"]._jdf.queryExecution().executedPlan().toString()) == (most > 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
