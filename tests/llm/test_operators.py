"""Every operator against a brute-force version on tables with nulls, ties, repeats, empty and long texts, and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import bpe, chat, decontam, jaccard, licenses, lm, quality, substring_dedup, suffix_dedup, topk

RNG = random.Random(3)
WORDS = ["the", "of", "Thor", "über", "naïve", "a", "cat", "dog", "日本", "re-do", "x1", "end."]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n: int) -> str:
    return RNG.choice([" ", "  ", "\n"]).join(RNG.choice(WORDS) + str(RNG.randint(0, 400)) for _ in range(n))


def corpus() -> list[tuple]:
    passage, base = prose(60), prose(120).split()
    rows = [prose(RNG.randint(1, 150)) for _ in range(60)] + [prose(20) + "\n" + passage + "\n" + prose(20) for _ in range(20)]
    for _ in range(25):  # near copies
        words = list(base)
        for _ in range(RNG.randint(0, 9)):
            words[RNG.randrange(len(words))] = "new" + str(RNG.randint(0, 99))
        rows.append(" ".join(words))
    rows += [rows[0]] * 7 + ["", "   ", None, "a", "A", "a b", "aaaa" * 100, "ab " * 300, prose(3000), "x" * 3000]
    RNG.shuffle(rows)
    return [(i * 3, t, "en", "s", 1, "block", "n") for i, t in enumerate(rows)]


#: Further columns have the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, training string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, rows that share an id."""
    text = prose(200)
    return spark.createDataFrame([(None, text), (1, text), (1, text), (1, None), (None, None), (2, prose(40))], "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, odd, empty):
    rows, df = docs
    first: dict[tuple, int] = {}
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeated_windows(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert substring_dedup.repeated_windows(empty).count() == 0
    out = substring_dedup.repeated_windows(odd).collect()
    assert len(out) == 6 and sorted(r["n_removed"] for r in out) == [0, 0, 0, 0, 200, 200]


def test_suffix_dedup(docs, odd, empty):
    rows, df = docs
    seen, want = set(), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_strings(df, 100, emit_text=False).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert suffix_dedup.repeated_strings(empty).count() == 0
    assert suffix_dedup.repeated_strings(odd).count() == 6


def test_suffix_ranks():
    for _ in range(40):
        data = np.array([RNG.choice([0, 1, 97, 98]) for _ in range(RNG.randint(1, 60))], np.uint8)
        depth = RNG.randint(1, 40)
        cut = [tuple(x + 1 for x in data[i : i + depth].tolist()) for i in range(len(data))]
        assert suffix_dedup.suffix_ranks(data, depth).tolist() == [sum(a < b for a in cut) for b in cut]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 6])
def test_jaccard(docs, empty, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows, df = docs
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets} and len(links) > 40
    assert jaccard.similar_documents(empty).count() == 0


def test_jaccard_odd_ids(odd):
    out = jaccard.similar_documents(odd).collect()
    assert len(out) == 6 and {r["component_id"] for r in out if r["n_shingles"] == 196} == {None}


def test_top_k(spark):
    vectors = [(i, [RNG.choice([0.0, 0.5, -0.25, 0.126]) for _ in range(RNG.choice([0, 3, 4]))]) for i in range(70)] + [(100, None), (101, [1.0, None]), (102, [float("nan")])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors[:70]}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = [tuple(r) for r in topk.inner_product_top_k(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(want)
    # rows that share an id, equal rows, a null id
    twice = spark.createDataFrame([(50, [1.0], 3), (50, [1.0], 4), (1, [1.0], 1), (1, [2.0], 1), (None, [2.0], 1), (2, None, 1)], "vec_id long, embedding array<float>, row int")
    got = sorted(tuple(r) for r in topk.inner_product_top_k(twice, F.col("vec_id") == 50).select("query_id", "rank", F.coalesce("vec_id", F.lit(-1)), "score").collect())
    assert got == [(50, k, i, s) for k, i, s in ((1, -1, 131072), (2, 1, 131072), (3, 1, 65536), (4, 50, 65536)) for _ in range(2)]
    assert topk.inner_product_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.inner_product_top_k(df.where("vec_id = 10"), F.col("vec_id") % 10 == 0).count() == 0


def test_licenses(spark, empty):
    texts = ["Licensed under the Apache License, Version 2.0.", "MIT license; CC BY-NC 4.0 and mit License", "gnu General\nPublic license", "the GNU Lesser General Public License", "licence apache", "", None, "CC-BY", "x " * 5000 + "MIT License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:7] for r in licenses.license_scan(df).collect()}
    assert got[0] == (8, 1, 3, 3, "apache", "apache,apache-2.0")
    assert got[1] == (10, 3, 0, 8, "cc-by,mit", "cc-by,cc-by-nc-4.0,mit")
    assert got[2][:5] == (4, 1, 0, 0, "gpl") and got[3][1:] == (0, None, None, "", "lgpl")
    assert got[4][1] == 0 and got[5] == got[6] == (0, 0, None, None, "", "") and got[7][4] == "cc-by" and got[8][1:4] == (1, 5000, 5000)
    assert licenses.license_scan(empty).count() == 0


def test_license_templates(spark, duck):
    """Near copies of templates against brute force; key phrases decide between versions, and reject copies that lack them."""
    gpl = next(t for t, label, _ in licenses.TEMPLATES if label == "gpl-3.0" and len(t) > 50)
    mit = next(t for t, label, _ in licenses.TEMPLATES if label == "mit-text")
    texts = [gpl.upper(), gpl.replace("3", "2"), gpl.replace("version 3", "version 4"), mit, mit.replace("free of charge", "without any fee"), mit.replace("files", "things").replace("copy", "print"), mit[: mit.index("documentation")], "x " + mit.replace("obtaining", "getting", 1)]
    for _ in range(200):
        t = RNG.choice(licenses.TEMPLATES)[0].split()
        for _ in range(RNG.randint(0, 6)):
            t[RNG.randrange(len(t))] = RNG.choice(["the", "x", "license"])
        texts.append(" ".join(prose(RNG.randint(0, 3)).split() + t[RNG.choice([0, 0, 2]) :] + prose(RNG.randint(0, 3)).split()))
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(FOLD))
        want = {label for p, label in licenses.BASE.items() if any(ws[k : k + len(p.split())] == p.split() for k in range(len(ws)))}
        for t, label, keys in licenses.TEMPLATES:
            t = t.split()
            for k in range(len(ws)):
                here = ws[k : k + len(t)]
                if sum(a == b for a, b in zip(here, t)) >= len(t) - licenses.may_differ(" ".join(t)) and all(f" {p} " in " " + " ".join(here) + " " for p in keys):
                    want.add(label)
        assert got[i] == want, text
    assert got[0] == {"gpl", "gpl-3.0"} and got[1] == {"gpl", "gpl-2.0"} and got[2] == {"gpl"} and got[3] == got[5] == got[6] == got[7] == {"mit-text"} and got[4] == set()


def test_quality(spark, empty):
    good, bad = [prose(80) for _ in range(150)], [" ".join(w.upper() + "!!" for w in prose(60).split()) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    df = spark.createDataFrame([*rows, (None, None), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = [r for r in quality.quality_scores(df, labels).collect()]
    held = [r for r in out if r["held_out"] and r["doc_id"] < 300]
    assert len(out) == 302 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert len(held) > 30 and sum(r["predicted"] == 1 - r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    tokens = pytest.importorskip("public_tokenizers")
    with open(tokens.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return tokens, bpe.Vocabulary.parse(f.read(), tokens.PATTERN)


def test_bpe_as_tiktoken(vocabulary):
    import tiktoken

    tokens, v = vocabulary
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "'s", "1", "23", "!", " ", " ", "日本", " ing", "\x00", "😀", "'", "<|endoftext|>"]
    texts = ["".join(RNG.choice(bits) for _ in range(RNG.randint(0, 25))) for _ in range(3000)] + ["ab" * 3000 + "thea" * 5000 + "x" * 10001, prose(4000)]
    for text in texts:
        ids = [i for _, part in v.pieces([text]) for i in part]
        assert ids == enc.encode_ordinary(text) and v.decode(ids) == text.encode()


def test_bpe_round_trip(docs, empty, vocabulary):
    tokens, v = vocabulary
    rows, df = docs
    out = {r["doc_id"]: r for r in bpe.round_trip(df, tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN).collect()}
    assert len(out) == len(rows) and all(r["same"] for r in out.values())
    for i, t, *_ in rows[:20]:
        ids = [k for _, part in v.pieces([t or ""]) for k in part]
        assert out[i]["n_tokens"] == len(ids) and out[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(empty, tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN).count() == 0


def test_lm(docs, empty):
    rows, df = docs
    split = {i: [*WORD.findall((t or "").translate(FOLD)), None] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in split}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, unit = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    got = {r["doc_id"]: r for r in lm.lm_scores(df).collect()}
    assert len(got) == len(rows)
    for i, ws in split.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / unit) for w in ws))
    scored = [r for r in got.values() if r["bits_per_byte"] is not None]
    assert all(r["score"] <= 0 for r in got.values()) and np.mean([r["bits_per_byte"] for r in scored]) < 4.5
    assert lm.lm_scores(empty).count() == 0


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, empty, limit):
    items = [prose(30) for _ in range(20)] + ["tiny item here", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def changed(t: str, every: int) -> str:
        return " ".join("other" if k % every == every - 1 else w for k, w in enumerate(t.split()))

    texts = [prose(100) + " " + items[0] + " " + prose(50), prose(10) + " " + changed(items[1], 6), items[2].upper(), prose(200), "a tiny item here b", None, "", changed(items[3], 2)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    out = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(df, bench, broadcast_bytes=limit).collect()}
    assert set(out) == {(0, 0), (1, 1), (2, 2), (4, 20)}
    assert (out[0, 0]["n_same"], out[0, 0]["last_word"] - out[0, 0]["first_word"] + 1) == (len(re.findall(r"[^\W_]+", items[0])),) * 2
    assert decontam.contaminated(empty, bench, broadcast_bytes=limit).count() == 0
    assert decontam.contaminated(df, bench.limit(0), broadcast_bytes=limit).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there.\nSecond line"), (1, 1, "assistant", "Ann wrote:\n> hello   there.\n> Second line\nHi!"), (1, 2, "user", "Unrelated"),
        (1, 3, "user", ">> Hello there.\n>> second line\n> Hi!\nthanks"), (1, 4, "user", "> nothing known\nx > y"), (None, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    out = {(r["conv_id"], r["thread"]): r for r in chat.conversations(df).collect()}
    assert out[1, 0]["chat"] == "<|user|>\nHello there.\nSecond line\n<|end|>\n<|assistant|>\nHi!\n<|end|>\n<|user|>\nthanks\n<|end|>\n"
    assert (out[1, 0]["n_messages"], out[1, 0]["n_replies"], out[1, 0]["n_quotes"], out[1, 0]["n_linked"]) == (3, 2, 3, 3)
    assert out[1, None]["n_messages"] == 2 and out[1, None]["n_linked"] == 0 and out[2, None]["n_messages"] == 2 and out[None, None]["n_messages"] == 1
    assert chat.conversations(df.limit(0)).count() == 0
    crowded = chat.conversations(spark.createDataFrame([(1, 0, "user", f"m{i}") for i in range(50)], "conv_id long, turn long, role string, text string"), part_messages=10).collect()
    assert sum(r["n_messages"] for r in crowded) == 50 and len(crowded) > 1


@pytest.mark.parametrize(("part_messages", "counted", "rows"), [(4096, 64, 1), (20, 4, None), (3, 4, None)])
def test_long_chats_stay_in_order(spark, part_messages, counted, rows):
    """A conversation of 130 turns, some of them repeated, read in order of its rows."""
    said = [(1, i, "user", f"message {i}") for i in range(130)] + [(1, 70, "assistant", f"again {k}") for k in range(9)] + [(2, 0, "user", "other")]
    out = chat.conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), part_messages, counted).where("conv_id = 1").orderBy("part", "share").collect()
    assert rows is None or len(out) == rows
    assert max(r["n_messages"] for r in out) <= max(2 * part_messages, 9) and sum(r["n_messages"] for r in out) == 139
    turns = [int(x) for x in re.findall(r"message (\d+)", "".join(r["chat"] for r in out))]
    assert turns == list(range(130))
