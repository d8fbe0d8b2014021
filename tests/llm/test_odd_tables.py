"""Every operator and every pipeline stage on null and repeated ids, repeated rows, extra columns with clashing names, empty tables, and very long texts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import _exchange as X
from palisade.llm import bpe, chat, decontam, jaccard, licenses, lm, quality, substring_dedup, suffix_dedup, topk
from palisade.llm._kernels import Texts, Words
from tests.conftest import DATA

RNG = random.Random(11)
PROSE = " ".join(RNG.choice(["stone", "river", "cloud", "grass", "ember"]) + str(RNG.randint(0, 99)) for _ in range(150))
#: Names that operators use inside.
EXTRA = ["block", "shard", "body", "words", "places", "terms", "row", "query", "rank", "score", "n", "key", "kept", "set_id", "tokens", "said", "part", "_id", "component", "quality"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, PROSE), (1, PROSE), (1, PROSE), (1, None), (None, None), (2, "the MIT License applies " + PROSE[:200]), (3, ""), (4, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def vocabulary():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN


def by_id(df, *columns):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, *(r[c] for c in columns)) for r in df.collect())


def test_removal(odd):
    """Rows of one id are successive documents for strings, but don't remove each other's words."""
    out = suffix_dedup.repeated_strings(odd, 100)
    assert out.count() == 8 and sorted(r["n_removed"] for r in out.collect())[-2:] == [len(PROSE)] * 2
    assert sum(r["n_removed"] > 0 for r in substring_dedup.repeated_windows(odd).collect()) == 3


def test_scans(odd, vocabulary):
    got = by_id(licenses.license_scan(odd), "n_words", "labels")
    assert len(got) == 8 and got.count((True, 1, 150, "")) == 2 and (True, 2, 4 + len(PROSE[:200].split()), "mit") in got
    ids = by_id(bpe.round_trip(odd, *vocabulary), "n_tokens", "same")
    assert len(ids) == 8 and all(x[3] for x in ids) and sum(x[2] == 0 for x in ids) == 3


def test_models(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    runs = [by_id(quality.quality_scores(odd.repartition(k), labels), "score", "predicted") for k in (1, 5)]
    assert len(runs[0]) == 8 and all(0 <= x[2] <= 1 for x in runs[0]) and np.allclose([x[2] for x in runs[0]], [x[2] for x in runs[1]], atol=1e-5)
    scores = [by_id(lm.lm_scores(odd.repartition(k)), "n_tokens", "score") for k in (1, 5)]
    assert scores[0] == scores[1] and len(scores[0]) == 8 and sum(x[3] == 0 for x in scores[0]) == 3  # empty texts


def test_pairs(spark, odd):
    out = by_id(jaccard.similar_documents(odd), "n_shingles")
    assert len(out) == 8 and out.count((True, 1, 146)) == 2
    items = spark.createDataFrame([(None, PROSE[:120]), (7, PROSE[:120]), (7, PROSE[:120]), (8, None)], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("at", F.lit(2))
    for limit in (decontam.BROADCAST_BYTES, 0):
        found = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontam.contaminated(odd, items, broadcast_bytes=limit).collect())
        assert found == sorted((d, i) for d in ("None", "1", "2") for i in ("None", "7"))


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, [], "x")], "vec_id long, embedding array<double>, row string").withColumns({c: F.lit("y") for c in EXTRA if c != "row"})
    assert [(r["rank"], r["vec_id"], r["score"]) for r in topk.inner_product_top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 5 << 16), (2, 2, 0)]


def test_chats(spark):
    rows = [(1, 0, "user", "hello"), (1, 0, "user", "hello"), (None, 1, "user", "> hello"), (1, None, None, None), (1, 1, "assistant", "> hello\nhi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("y") for c in EXTRA + ["thread", "turns", "quotes", "share", "bucket"]})
    out = chat.conversations(df).collect()
    assert sum(r["n_messages"] for r in out) == 5 and sum(r["n_linked"] for r in out) == 1


def stages():
    pipeline = pytest.importorskip("corpus_pipeline")
    return pipeline, pipeline.STAGES


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_documents(spark, odd, k):
    """Rows that share an id stay or go together; a null id is an id of its own; nothing crashes on extra columns and empty tables."""
    pipeline, known = stages()
    docs = odd.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    out = known[k][1](spark, docs, str(DATA))
    rows = out.collect()
    assert k == 4 or out.columns == list(pipeline.COLUMNS)
    ids = [r["doc_id"] for r in rows]
    if k in (0, 1, 3):
        kept = {i: sum(r["doc_id"] == i for r in docs.collect()) for i in set(ids)}
        assert all(ids.count(i) == n for i, n in kept.items())
    if k == 4:
        assert len(rows) == 8
    assert known[k][1](spark, docs.limit(0), str(DATA)).count() == 0


@pytest.mark.parametrize("size", [20 << 20])
def test_very_long_text(spark, vocabulary, size):
    """A text of 20 MB, and a short one that repeats its end."""
    rng = np.random.default_rng(2)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**7, size // 8).tolist())
    end = text[-3000:]
    df = spark.createDataFrame([(1, text), (2, end), (3, "x" * 70 + " " + "y" * (1 << 20))], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_strings(df, 100, emit_text=False).collect()}
    assert removed[1] == 0 and removed[2] == 3000 and removed[3] == (1 << 20) - 1  # all but the first byte
    words = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_windows(df, 13, emit_text=False).collect()}
    n = len(end.split())
    assert words[1] == (len(text.split()), 0) and words[2][0] == n and n - 1 <= words[2][1] <= n
    assert {r["doc_id"]: r["n_shingles"] > 0 for r in jaccard.similar_documents(df).collect()} == {1: True, 2: True, 3: True}
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.quality_scores(df, labels).count() == 3
    assert {r["doc_id"]: r["n_tokens"] for r in lm.lm_scores(df).collect()} == {1: len(text.split()) + 1, 2: n + 1, 3: 3}
    short = df.where("doc_id > 1")
    assert all(r["same"] for r in bpe.round_trip(short, *vocabulary).collect())


def test_equal_polynomials_are_told_apart(spark):
    """Words whose polynomials modulo a power of two are equal by construction (Thue-Morse)."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    table = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similar_documents(table).collect()} == {1, 2}
    got = lm.lm_scores(table).collect()
    assert {r["n_known"] for r in got} == {2}
    assert decontam.contaminated(table.where("doc_id = 1"), table.where("doc_id = 2").withColumnRenamed("doc_id", "item_id")).count() == 0


def test_words_across_pieces(monkeypatch):
    """Words are the same wherever the pieces are cut."""
    import pyarrow as pa

    from palisade.llm import _kernels

    texts = ["".join(RNG.choice(["a", "Bc", " ", "\n", "é", "x" * 90]) for _ in range(RNG.randint(0, 60))) for _ in range(50)]
    block = Texts(pa.table({"doc_id": list(range(50)), "text": texts}))
    whole = Words(block, fold=True)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(_kernels, "CHUNK", size)
        cut = Words(block, fold=True)
        assert all((getattr(whole, k) == getattr(cut, k)).all() for k in ("begin", "end", "doc", "hash", "count"))
    data = block.data.tobytes()
    assert [data[a:b].decode() for a, b in zip(whole.begin, whole.end)] == [w for t in texts for w in t.replace("\n", " ").split(" ") if w]
    long = next(k for k, (a, b) in enumerate(zip(whole.begin, whole.end)) if b - a > _kernels.LONG_WORD)
    word = data[whole.begin[long] : whole.end[long]].lower()
    assert int(whole.hash[long]) == int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def test_count_min_never_underestimates():
    """Blocks' estimates against exact counts, and the share of overestimates."""
    rng = np.random.default_rng(4)
    sketch = X.CountMin(60_000)
    blocks = [rng.integers(0, 1 << 40, 1000, np.uint64) for _ in range(9)] + [np.arange(300, dtype=np.uint64)] * 2
    sent = [m for b, keys in enumerate(blocks) for m in sketch.add(b, keys)]
    table = X.messages(sent)
    replies = {}
    for s in set(table.column("shard").to_pylist()):
        import pyarrow.compute as pc

        for row in sketch.merge(table.filter(pc.equal(table.column("shard"), s))).to_pylist():
            replies.setdefault(row["block"], {})[row["shard"]] = row["body"]
    keys, counts = np.unique(np.concatenate(blocks), return_counts=True)
    over = 0
    for b, own in enumerate(blocks):
        true = counts[np.searchsorted(keys, own)]
        got = sketch.estimates(own, replies[b])
        assert (got >= true).all()
        over += int((got > true).sum())
    assert over < 0.1 * sum(map(len, blocks))
