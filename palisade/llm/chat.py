"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines are parsed for nested quote marks; runs of lines of one level are passages. Quoted passages are
normalised, hashed and joined to the passages that earlier messages of the conversation say themselves; what a message
quotes at the first level is what it replies to. Conversations are then put in order of reply, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import _session as S

#: Turns that are counted together, and messages of one row: a chat of more is cut into rows that follow each other.
COUNTED_TURNS, PART_MESSAGES = 64, 4096
_MARKS = r"^[ \t]*>[> \t]*"
_WROTE = r"^.{0,200}\bwrote:[ \t]*$"


def passages(text: Column) -> Column:
    """array<struct<level int, text string>> of a text: runs of lines with equally many leading `>`.

    A line that ends in `wrote:` just before a quoted line belongs to the quote and is left out.
    """
    lines = F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("text")))

    def kept(lines: Column) -> Column:
        return F.filter(lines, lambda x, i: ~(x["text"].rlike(_WROTE) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > x["level"])))

    def runs(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
        return _let(heads, lambda heads: F.transform(heads, lambda at, k: F.struct(F.get(lines, at)["level"].alias("level"), F.array_join(F.slice(lines["text"], at + 1, F.coalesce(F.get(heads, k + 1), F.size(lines)) - at), "\n").alias("text"))))

    quoted = _let(lines, lambda x: _let(kept(x), lambda y: F.when(F.size(y) == 0, F.array().cast("array<struct<level:int,text:string>>")).otherwise(runs(y))))
    return F.when(text.contains(">"), quoted).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("text"))))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_hash(text: Column) -> Column:
    """Of the words of a passage, without regard to case and spaces; null for a blank one."""
    flat = F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(flat != "", F.substring(F.sha2(flat, 256), 1, 32))


def units(text: Column) -> Column:
    """array<struct<whole, lines array>> of a text: the hashes of each paragraph and of its lines, without blank ones."""

    def unit(p: Column) -> Column:
        return F.struct(normal_hash(p).alias("whole"), F.filter(F.transform(F.split(p, r"\n"), normal_hash), lambda h: h.isNotNull()).alias("lines"))

    return F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n"), unit), lambda u: u["whole"].isNotNull())


def places(units: Column) -> Column:
    """array<struct<hash, start, end>> of the paragraphs and lines of a text, in numbers that rise along it."""
    far = F.lit(1 << 31)
    return F.flatten(F.transform(units, lambda u, j: F.concat(
        F.array(F.struct(u["whole"].alias("hash"), (j * far).alias("start"), ((j + 1) * far).alias("end"))),
        F.transform(u["lines"], lambda h, i: F.struct(h.alias("hash"), (j * far + i).alias("start"), (j * far + i + 1).alias("end"))),
    )))


def in_order(units: Column, places: Column) -> Column:
    """Whether a text says all paragraphs of a quote, or else all of their lines, one after the other."""

    def end(h: Column, at: Column) -> Column:
        return F.array_min(F.transform(F.filter(places, lambda x: (x["hash"] == h) & (x["start"] >= at)), lambda x: x["end"]))

    return F.aggregate(units, F.lit(0).cast("long"), lambda at, u: F.least(end(u["whole"], at), F.aggregate(u["lines"], at, lambda k, h: end(h, k)))).isNotNull()


def trimmed(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, hash, turn): the turns that say all of a quoted passage of several lines in order, with others before, between or after.

    Passages and messages meet by the paragraph or line of a passage that the fewest messages say.
    """
    asked = quotes.select("conv_id", "hash", units(F.col("text")).alias("units")).where(F.aggregate("units", F.lit(0), lambda n, u: n + F.size(u["lines"])) > 1).distinct()
    asked = asked.withColumn("quote", F.xxhash64(F.to_json("units")))
    says = rows.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("body", F.sha2("said", 256))
    bodies = says.select("conv_id", "body", "said").distinct().select("conv_id", "body", places(units(F.col("said"))).alias("places"))
    keys = asked.select("conv_id", "hash", "quote", F.posexplode("units").alias("unit", "u")).select("conv_id", "hash", "quote", "unit", F.explode(F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("u.whole").alias("key"))), F.transform("u.lines", lambda h: F.struct(F.lit(False).alias("whole"), h.alias("key"))),
    )).alias("k")).select("conv_id", "hash", "quote", "unit", "k.*")
    held = bodies.select("conv_id", "body", F.explode(F.array_distinct(F.transform("places", lambda x: x["hash"]))).alias("key")).join(keys.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    keys = keys.join(held.groupBy("conv_id", "key").agg(F.count("*").alias("n")), ["conv_id", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # of each paragraph: itself and its rarest line, one of which a message must say; of each passage: the rarest such two
    ends = keys.groupBy("conv_id", "hash", "quote", "unit").agg(F.min(F.when(F.col("whole"), F.struct("n", "key"))).alias("a"), F.min(F.when(~F.col("whole"), F.struct("n", "key"))).alias("b"))
    ends = ends.groupBy("conv_id", "hash", "quote").agg(F.min(F.struct((F.col("a.n") + F.col("b.n")).alias("n"), F.col("a.key").alias("a"), F.col("b.key").alias("b"))).alias("least"))
    pairs = ends.select("conv_id", "hash", "quote", F.explode(F.array_distinct(F.array("least.a", "least.b"))).alias("key")).join(held, ["conv_id", "key"]).select("conv_id", "hash", "quote", "body").distinct()
    pairs = pairs.join(asked, ["conv_id", "hash", "quote"]).join(bodies, ["conv_id", "body"]).where(in_order(F.col("units"), F.col("places")))
    return pairs.select("conv_id", "hash", "body").distinct().join(says, ["conv_id", "body"]).select("conv_id", "hash", "turn").distinct()


def _key(*columns: str) -> Column:
    """Columns as one that joins null with null."""
    return F.struct(*(F.coalesce(F.col(k), F.lit(S.LOWEST_ID)).alias(k) for k in columns))


def cuts(rows: DataFrame, part_messages: int) -> DataFrame:
    """(key, part, shares) for the buckets of turns of threads with more than part_messages messages; others have none.

    Buckets are counted before they meet; a part is a run of them that begins within the same multiple of part_messages. A bucket that is
    more by itself is a part of its own, in shares.
    """
    counted = rows.groupBy("conv_id", "thread", "bucket").agg(F.count("*").alias("n"))
    thread = Window.partitionBy("conv_id", "thread")
    so_far = F.sum("n").over(thread.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = counted.withColumn("total", F.sum("n").over(thread)).withColumn("from", so_far - F.col("n")).where(F.col("total") > part_messages)
    crowded = F.col("n") > part_messages
    # twice the multiple, so that a crowded bucket stands between the parts before and behind it
    part = 2 * F.floor(F.col("from") / part_messages) + crowded.cast("int")
    return counted.select(_key("conv_id", "thread", "bucket").alias("key"), part.alias("part"), F.when(crowded, F.ceil(F.col("n") / part_messages)).otherwise(1).alias("shares"))


def conversations(messages: DataFrame, part_messages: int = PART_MESSAGES, counted_turns: int = COUNTED_TURNS) -> DataFrame:
    """Messages (conv_id, turn, role, text) as chats in order of reply.

    A message replies to the latest earlier turn of its conversation that says one of the passages that it quotes at
    the first level: the whole message without quotes, one of its runs of unquoted lines, a paragraph or a line of it; or,
    if no earlier turn says the passage so, the latest that says all of its paragraphs or lines in order, so that text
    cut from a quote's ends or middle doesn't matter (text cut within a line does).
    A message that others reply to begins a thread, which holds what replies to it, directly or not, in order of turn, so
    after what it replies to. Messages without replies that reply to nothing make up the thread null, in order of turn.

    Returns conv_id, thread (its first turn), part, share, n_messages, n_replies (that are linked), n_quotes and n_linked
    (quoted passages of any level, and those found in earlier turns) and chat: a `<|role|>` line, the text without
    quotes and an `<|end|>` line of each message. A thread of up to part_messages messages is one row, part 0 and share 0. A longer one, which may
    hold a third of all rows, is cut between turns into parts of about so many messages: in order of (part, share) they are the chat without a break.
    Only where a single turn is repeated more often than that, its equals are dealt out by a hash. Nothing is dropped: null roles are `unknown`,
    null texts empty, null ids and turns groups of their own (a null turn comes first and neither replies nor is
    replied to). Repeated rows stay. An empty table gives an empty one. Other columns are ignored.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("passages", passages(F.col("text")))
    rows = rows.withColumn("said", F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n"))
    rows = rows.select("conv_id", "turn", "role", F.btrim(F.col("said"), F.lit(" \t\n")).alias("said"), F.filter("passages", lambda p: p["level"] == 0).alias("own"), F.filter("passages", lambda p: (p["level"] > 0) & (F.btrim(p["text"]) != "")).alias("quotes"))

    quotes = rows.where((F.size("quotes") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", F.explode("quotes").alias("q"))
    quotes = quotes.select("conv_id", "turn", F.col("q.level").alias("level"), F.col("q.text").alias("text"), normal_hash(F.col("q.text")).alias("hash")).where("hash IS NOT NULL")
    quotes = S.checkpointed(quotes)
    # what is quoted anywhere in a conversation: one row for each passage, so a common one isn't multiplied
    asked = quotes.select("conv_id", "hash").distinct()
    lines = F.flatten(F.transform("own", lambda p: F.concat(F.array(p["text"]), F.split(p["text"], r"\n[ \t]*\n"), F.split(p["text"], r"\n"))))
    # what is said in conversations with quotes, kept for the two ways of linking
    spoken = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & (F.col("said") != "")).select("conv_id", "turn", "own")
    spoken = S.checkpointed(spoken.join(asked.select("conv_id").distinct(), "conv_id", "left_semi"))
    says = spoken = spoken.withColumn("said", F.btrim(F.array_join(F.transform("own", lambda p: p["text"]), "\n"), F.lit(" \t\n")))
    says = says.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.concat(F.array("said"), lines), normal_hash))).alias("hash")).where("hash IS NOT NULL")
    says = says.join(asked, ["conv_id", "hash"], "left_semi").distinct()
    nothing = F.lit(None).cast("long")
    events = says.select("conv_id", "hash", "turn", F.col("turn").alias("said_at"), nothing.alias("part_at"), F.lit(None).cast("int").alias("level"))
    events = events.unionByName(trimmed(spoken.select("conv_id", "turn", "said"), quotes).select("conv_id", "hash", "turn", nothing.alias("said_at"), F.col("turn").alias("part_at"), F.lit(None).cast("int").alias("level")))
    events = events.unionByName(quotes.select("conv_id", "hash", "turn", nothing.alias("said_at"), nothing.alias("part_at"), "level"))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = events.withColumn("source", F.coalesce(F.max("said_at").over(before), F.max("part_at").over(before))).where("level IS NOT NULL")
    linked = linked.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("level") == 1, F.col("source"))).alias("parent"), F.count("*").alias("quoted"), F.count("source").alias("linked"))

    linked = S.checkpointed(linked.where("quoted > 0"))
    parents = linked.where("parent IS NOT NULL").select("conv_id", "turn", F.col("parent").alias("thread"))
    moved = parents.limit(1).count()
    while moved:  # halves the way to the first message each time
        up = parents.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        parents = S.checkpointed(parents.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved")))
        moved = parents.where("moved").limit(1).count()
        parents = parents.drop("moved")

    known = linked.join(parents, ["conv_id", "turn"], "left")
    out = rows.select("conv_id", "turn", "role", "said").join(known, ["conv_id", "turn"], "left")
    out = out.withColumn("thread", F.coalesce("thread", "turn"))
    # in linear chats every message would be a thread of its own: threads without replies stay together
    busy = parents.select("conv_id", "thread").distinct().withColumn("busy", F.lit(True))
    out = out.join(busy, ["conv_id", "thread"], "left").withColumn("thread", F.when(F.col("busy"), F.col("thread")))
    out = out.withColumn("bucket", F.floor(F.col("turn") / counted_turns))
    parts = cuts(out, part_messages)
    out = out.withColumn("key", _key("conv_id", "thread", "bucket")).join(parts, "key", "left")
    # in a crowded bucket each turn is a share, and a turn by itself too crowded is dealt out by a hash
    offset = F.coalesce(F.col("turn") - F.col("bucket") * counted_turns, F.lit(0))
    spread = F.pmod(F.xxhash64("turn", "role", "said"), F.greatest(F.col("shares"), F.lit(1)))
    out = out.withColumn("part", F.coalesce("part", F.lit(0))).withColumn("share", F.when(F.col("shares") > 1, offset * F.col("shares") + spread).otherwise(F.lit(0)))
    chats = out.groupBy("conv_id", "thread", "part", "share").agg(
        F.count("*").alias("n_messages"), F.count("parent").alias("n_replies"), F.coalesce(F.sum("quoted"), F.lit(0)).alias("n_quotes"), F.coalesce(F.sum("linked"), F.lit(0)).alias("n_linked"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(S.LOWEST_ID)).alias("turn"), "role", "said"))).alias("messages"),
    )
    chat = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["said"], F.lit("\n<|end|>\n"))), "")
    return chats.select("conv_id", "thread", "part", "share", "n_messages", "n_replies", "n_quotes", "n_linked", chat.alias("chat"))
