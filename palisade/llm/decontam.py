"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over successive words: hashes of the words at its 1s, whatever stands at its 0s, so a changed
word at a 0 doesn't hide a copy. Seeds of the documents are joined to those of the benchmark; around each hit the
two texts are laid side by side and the overlap counts if enough of its words agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import _session as S
from palisade.llm._kernels import U64, Texts, Words, text_slices, mixed, powers

#: Masks at most for windows of one length, and patterns of changed words that are tried out to choose them.
MOST_MASKS, MOST_PATTERNS = 8, 5000
#: Text bytes of a benchmark that is sent to the executors whole; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Bits that tell documents which seeds a large benchmark may have, whatever its size; sent in pieces.
MARK_BITS, MARK_PIECES = 1 << 28, 64
HITS = "doc_id long, item_id long, first_word long, last_word long, n_same long"
_HIT_NAMES = ("doc_id", "item_id", "first_word", "last_word", "n_same")


def allowed(words: int, share: float) -> int:
    """Words of a window that may differ."""
    return words - math.ceil(share * words - 1e-9)


@cache
def masks(words: int, changes: int) -> tuple[str, ...]:
    """Masks (words that count are 1, ignored ones 0) of which one fits between the changes, wherever `changes` of `words` words differ.

    They are chosen greedily among the masks of the greatest weight for which few do. With too many patterns to try out it is one
    run of words, which some gap between the changes always holds.
    """
    run = "1" * max(1, math.ceil((words - changes) / (changes + 1)))
    if words > 16 or math.comb(words, changes) > MOST_PATTERNS:
        return (run,)
    equal = np.array([[i not in c for i in range(words)] for c in combinations(range(words), changes)])
    for weight in range(words - changes, len(run), -1):
        places = [(0, *inner, n - 1) for n in range(weight, words + 1) for inner in combinations(range(1, n - 1), weight - 2)]
        hit = np.array([np.any([equal[:, [at + i for i in p]].all(1) for at in range(words - p[-1])], axis=0) for p in places])
        chosen, left = [], np.ones(len(equal), bool)
        while left.any() and len(chosen) < MOST_MASKS:
            best = int((hit & left).sum(1).argmax())
            chosen.append(best)
            left &= ~hit[best]
        if not left.any():
            return tuple("".join("01"[i in places[c]] for i in range(places[c][-1] + 1)) for c in chosen)
    return (run,)


def masks_of(lengths: set[int], window: int, share: float) -> dict[str, set[int]]:
    """The masks that find overlaps with items of some lengths, and the lengths (the window for longer items) that each is for."""
    out: dict[str, set[int]] = {}
    for n in sorted({min(n, window) for n in lengths if n > 0}):
        for mask in masks(n, allowed(n, share)):
            out.setdefault(mask, set()).add(n)
    return out


def seeds(hashes: np.ndarray, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first words, seed hashes) of a mask over words of texts; none crosses two texts."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    factor = powers(len(mask) + 2)[0]
    total = np.full(n, int(mask, 2), U64)
    for j in (j for j, bit in enumerate(mask) if bit == "1"):
        total += hashes[j : j + n] * factor[j + 1]
    return at, mixed(total)[at]


class Benchmark:
    """Words and seeds of benchmark items, by the masks that their lengths ask for."""

    def __init__(self, items: pa.Table, window: int, share: float):
        texts = Texts(items)
        words = Words(texts, fold=True, alnum=True)
        self.ids, self.hash = texts.ids, words.hash
        self.first = np.concatenate(([0], np.cumsum(words.count)))
        wanted = masks_of(set(words.count.tolist()), window, share)
        self.masks = list(wanted)
        self.seeds, self.marks = [], []
        for mask, lengths in wanted.items():
            at, h = seeds(words.hash, words.doc, mask)
            fit = np.isin(np.minimum(words.count[words.doc[at]], window), list(lengths))
            at, h = at[fit], h[fit]
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], words.doc[at][order], at[order] - self.first[words.doc[at]][order]))
            mark = np.zeros(1 << 20, bool)
            mark[(h >> U64(44)).astype(np.int64)] = True
            self.marks.append(mark)

    def words(self, item: int) -> np.ndarray:
        return self.hash[self.first[item] : self.first[item + 1]]

    def hits(self, hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Distinct (text, item, first word of the item's place in all words) that share a seed."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, (keys, item, place), mark in zip(self.masks, self.seeds, self.marks, strict=True):
            at, h = seeds(hashes, text, mask)
            likely = mark[(h >> U64(44)).astype(np.int64)]
            at, h = at[likely], h[likely]
            a, b = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
            n = b - a
            if n.sum():
                which = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = np.repeat(at, n)
                found.append(np.unique(np.stack([text[at], item[which], at - place[which]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)


def overlap(words: np.ndarray, item: np.ndarray, at: int, window: int, share: float) -> tuple[int, int, int] | None:
    """(first word, last word, equal words) of the overlap of an item laid at word `at` of a text, or None.

    It holds each run of `window` words (all of a shorter item's) in which at least `share` are equal, and is cut to
    equal words at both ends.
    """
    a, b = max(at, 0), min(at + len(item), len(words))
    same = words[a:b] == item[a - at : b - at]
    w = min(window, len(item))
    if len(same) < w or not w:
        return None
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[w:] - sums[:-w] >= share * w - 1e-9)
    if not len(good):
        return None
    inside = np.flatnonzero(same[good[0] : good[-1] + w]) + good[0]
    return a + int(inside[0]), a + int(inside[-1]), len(inside)


def _rows(found: dict[tuple[int, int, int], tuple]) -> pa.Table:
    cols = list(zip(*found.values(), strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(_HIT_NAMES, cols, strict=True)})


def _better(found: dict, key: tuple, row: tuple) -> None:
    if key not in found or (-row[4], row[2]) < (-found[key][4], found[key][2]):
        found[key] = row


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 12, share: float = 0.75, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Overlaps of documents (doc_id, text) with benchmark items (item_id, text), one row per pair that overlaps.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z as a-z. An overlap is a run of at least `window`
    words (all of a shorter item's) at the same distance in both, of which at least `share` are equal. first_word and
    last_word (from 0) are its place in the document, n_same its equal words; of several the one with most equal
    words, then the first. All of them are found: the seeds' masks hit every window that may differ so far. Null or empty texts overlap nothing; rows that share a doc_id or item_id give one row;
    null ids come out as null. No rows come out if either table is empty. Other columns are ignored.
    """
    S.ship(docs.sparkSession)
    docs, items = S.documents(docs), S.documents(benchmark, "item_id")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = _sent(docs, items, window, share) if size <= broadcast_bytes else _joined(docs, items, window, share)
    # rows that share ids: the best of all
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_same", (-F.col("first_word")).alias("at"), "last_word")).alias("x"))
    return best.select(S.public_id(), S.public_id("item_id"), (-F.col("x.at")).alias("first_word"), F.col("x.last_word").alias("last_word"), F.col("x.n_same").alias("n_same"))


class Sent:
    """A benchmark as it is broadcast; its seeds are made once in a Python worker."""

    def __init__(self, table: pa.Table, window: int, share: float):
        self.table, self.window, self.share, self.made = table, window, share, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def benchmark(self) -> Benchmark:
        if self.made is None:
            self.made = Benchmark(self.table, self.window, self.share)
        return self.made


def _sent(docs: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """The benchmark, whose size has been checked, goes to the documents."""
    table = pa.Table.from_pylist([r.asDict() for r in items.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    sent = docs.sparkSession.sparkContext.broadcast(Sent(table, window, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value.benchmark()
        for texts in text_slices(batches):
            words = Words(texts, fold=True, alnum=True)
            first = np.concatenate(([0], np.cumsum(words.count)))
            out: dict = {}
            for text, item, at in b.hits(words.hash, words.doc).tolist():
                if got := overlap(words.hash[first[text] : first[text + 1]], b.words(item), at - int(first[text]), window, share):
                    _better(out, (text, item), (int(texts.ids[text]), int(b.ids[item]), *got))
            yield from _rows(out).to_batches()

    return docs.mapInArrow(run, HITS)


def _joined(docs: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """Both sides' seeds meet by a shuffle join; pairs get their texts by further joins.

    What documents send is cut down by a bitmap of the benchmark's seeds, of a fixed size; nothing else is broadcast.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_slices(batches):
            n = np.unique(np.minimum(Words(texts, hashes=False, alnum=True).count, window))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    # at most one for each length up to the window
    wanted = masks_of({r["n"] for r in items.mapInArrow(lengths, "n long").distinct().collect()}, window, share)

    def of(item: bool, marks=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None if item else marks.value
            for texts in text_slices(batches):
                words = Words(texts, fold=True, alnum=True)
                first = np.concatenate(([0], np.cumsum(words.count)))
                for mask, lengths in wanted.items():
                    at, h = seeds(words.hash, words.doc, mask)
                    if item:
                        fit = np.isin(np.minimum(words.count[words.doc[at]], window), list(lengths))
                    else:
                        place = h % U64(MARK_BITS)
                        fit = (bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 > 0
                    at, h = at[fit], h[fit]
                    d = words.doc[at]
                    yield from pa.table({"id": texts.ids[d], "seed": h.view(np.int64), "at": at - first[d]}).to_batches(max_chunksize=1 << 16)

        return run

    piece_bits = MARK_BITS // MARK_PIECES

    def marked(table: pa.Table) -> pa.Table:
        bits = np.zeros(piece_bits, bool)
        bits[(table.column("seed").to_numpy().view(U64) % U64(piece_bits)).astype(np.int64)] = True
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {}
            cols = [c.to_pylist() for c in batch.columns]
            for n, (doc, item, ats, text, item_text) in enumerate(zip(*cols, strict=True)):
                a, b = (Words(Texts(pa.table({"doc_id": [0], "text": [t]})), fold=True, alnum=True).hash for t in (text, item_text))
                for at in sorted(set(ats)):
                    if got := overlap(a, b, at, window, share):
                        _better(out, (n, 0), (doc, item, *got))
            yield from _rows(out).to_batches()

    schema = "id long, seed long, at long"
    theirs = items.mapInArrow(of(True), schema).select(F.col("id").alias("item_id"), "seed", F.col("at").alias("place")).distinct()
    theirs = S.checkpointed(theirs)
    place = F.col("seed").bitwiseAND(F.lit(MARK_BITS - 1).cast("long"))
    pieces = theirs.select(F.floor(place / piece_bits).cast("int").alias("piece"), "seed").distinct().groupBy("piece").applyInArrow(marked, "piece int, bits binary")
    flat = np.zeros(MARK_BITS // 8, np.uint8)
    for r in pieces.collect():  # MARK_PIECES rows of a fixed size
        flat[r["piece"] * piece_bits // 8 : (r["piece"] + 1) * piece_bits // 8] = np.frombuffer(r["bits"], np.uint8)
    marks = docs.sparkSession.sparkContext.broadcast(flat)
    pairs = docs.mapInArrow(of(False, marks), schema).join(theirs, "seed").select(F.col("id").alias("doc_id"), "item_id", (F.col("at") - F.col("place")).alias("at")).distinct()
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.collect_set("at").alias("ats"))
    full = pairs.join(docs, "doc_id").join(items.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
    return full.select("doc_id", "item_id", "ats", "text", "item_text").mapInArrow(verify, HITS)
