"""Byte-level BPE by a rank queue, and its inverse.

The pre-tokens of many texts that aren't known yet are merged together: a linked list of parts runs through each,
and every adjacent pair that is in the vocabulary stands in the bucket of its rank. A two-level bitmap over the ranks
says which buckets hold something, so the next rank is found by two find-first-set steps whatever the vocabulary's
size. Entries aren't deleted when a neighbour merges: an entry counts only if its pair still has the bucket's rank.
n bytes take O(n log n) steps however they are cut, so megabytes without a space are fine.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from palisade.llm import _session as S
from palisade.llm._kernels import slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean"
#: Parts of texts remembered by a worker, four times this at most, each of up to LONG characters.
REMEMBERED, LONG = 200_000, 64
#: Characters whose unknown pre-tokens are merged together.
TOGETHER = 1 << 21


class Memo:
    """What was found for short texts; the older half is forgotten when `size` newer ones are there."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Those of the keys that aren't known; the others are in `new` from now on."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for key in set(keys).difference(new):
            if (got := old.get(key)) is None:
                out.append(key)
            else:
                new[key] = got
        return out

    def trim(self, keys: Iterable[str]) -> None:
        for key in keys:
            if len(key) > LONG:
                del self.new[key]


class Vocabulary:
    """Merge ranks by token bytes; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.digits = {i: str(i) for i in self.token}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.parts, self.matches = Memo(REMEMBERED), Memo(REMEMBERED)
        self._cut = regex.compile(r"(?<=\S) (?=\S)")

    @classmethod
    def parse(cls, text: bytes, pattern: str) -> Vocabulary:
        """From lines of base64 token and rank."""
        lines = (line.split() for line in text.splitlines() if line.strip())
        return cls({base64.b64decode(a): int(b) for a, b in lines}, pattern)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece: in every piece always the pair of lowest rank first, leftmost first."""
        if not pieces:
            return []
        rank_of = self.ranks.get
        data = b"".join(pieces)
        n = len(data)
        stops = np.cumsum([len(p) for p in pieces])
        last = bytearray(n + 1)  # 1 where a piece ends
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        pair = np.full(n, -1)
        pair[:-1] = self.pair[raw[:-1] << 8 | raw[1:]]
        pair[stops[stops > 0] - 1] = -1
        np.frombuffer(last, np.uint8)[stops] = 1
        np.frombuffer(last, np.uint8)[0] = 1
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        found, at = np.unique(pair[order], return_index=True)
        buckets = dict(zip(found.tolist(), (x.tolist() for x in np.split(order, at[1:])), strict=False))  # places by rank
        low: dict[int, int] = {}  # bit r % 256 of word r // 256: bucket r isn't empty
        for r in buckets:
            low[r >> 8] = low.get(r >> 8, 0) | 1 << (r & 255)
        top = sum(1 << w for w in low)  # bit w: word w isn't 0
        rank_at = pair.tolist()  # of the pair that begins here; -1: none, or no part begins here
        id_at = [self.byte[b] for b in data]  # of the part that begins here
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n))  # where the part before begins
        while top:
            w = (top & -top).bit_length() - 1
            word = low[w]
            bit = word & -word
            rank = (w << 8) + bit.bit_length() - 1
            word ^= bit
            low[w] = word
            if not word:
                top ^= 1 << w
            places = buckets.pop(rank)
            places.sort()
            for x, i in enumerate(places):
                if rank_at[i] != rank:
                    continue
                j = end[i]
                end[i] = k = end[j]
                id_at[i] = rank
                rank_at[j] = rank_at[i] = -1
                lower = False
                if not last[k]:
                    before[k] = i
                    r = rank_of(data[i : end[k]])
                    if r is not None:
                        rank_at[i] = r
                        lower = r < rank
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            low[r >> 8] = low.get(r >> 8, 0) | 1 << (r & 255)
                            top |= 1 << (r >> 8)
                if not last[i]:
                    h = before[i]
                    r = rank_of(data[h:k])
                    if r is None:
                        rank_at[h] = -1
                    else:
                        rank_at[h] = r
                        lower |= r < rank
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            buckets[r] = [h]
                            low[r >> 8] = low.get(r >> 8, 0) | 1 << (r & 255)
                            top |= 1 << (r >> 8)
                if lower and x + 1 < len(places):  # a lower rank goes first
                    buckets[rank] = places[x + 1 :]
                    low[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                    break
        out, i = [], 0
        for stop in stops.tolist():
            ids = []
            while i < stop:
                ids.append(id_at[i])
                i = end[i]
            out.append(tuple(ids))
        return out

    def _learn(self, matches: Iterable[str]) -> list[str]:
        fresh = self.matches.missing(matches)
        self.matches.new.update(zip(fresh, self.merge([m.encode("utf-8", "replace") for m in fresh]), strict=True))
        return fresh

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; texts that are long together should come through pieces().

        Where a single space stands between two other characters than white space, no match of the pattern crosses
        the place before it, so such a text is cut there and equal parts are looked up as wholes.
        """
        split = [t.split(" ") for t in texts]
        fresh = self.parts.missing(chain.from_iterable(parts[1:] for parts in split))
        part_ids, findall = self.parts.new, self.pattern.findall
        # a part that is empty or has white space at an end doesn't stand between safe cuts: its text is matched whole
        even = [p for p in fresh if p and not p[0].isspace() and not p[-1].isspace()]
        part_ids.update(dict.fromkeys(set(fresh).difference(even)))
        found = [findall(" " + p) for p in even]
        part_ids.update(dict.fromkeys(even, ()))
        whole = [len(ps) > 1 and (ps[0][-1:].isspace() or None in map(part_ids.__getitem__, ps[1:])) for ps in split]
        heads = [findall(t if w else ps[0]) for t, ps, w in zip(texts, split, whole, strict=True)]
        learnt = self._learn(chain.from_iterable(chain(found, heads)))
        ids_of = self.matches.new.__getitem__
        for p, ms in zip(even, found, strict=True):
            part_ids[p] = ids_of(ms[0]) if len(ms) == 1 else tuple(chain.from_iterable(map(ids_of, ms)))
        out = []
        for ms, ps, w in zip(heads, split, whole, strict=True):
            out.append(list(chain.from_iterable(chain(map(ids_of, ms), () if w else map(part_ids.__getitem__, ps[1:])))))
        self.parts.trim(fresh)
        self.matches.trim(learnt)
        return out

    def pieces(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, some of its ids), in order; each text comes at least once."""
        group, of, size = [], [], 0
        for k, text in enumerate(texts):
            at = 0
            while at < len(text) or not at:
                to = len(text)
                if to - at > TOGETHER and (m := self._cut.search(text, at + TOGETHER)):
                    to = m.start()
                group.append(text[at:to])
                of.append(k)
                size += to - at
                at = max(to, 1)
                if size >= TOGETHER:
                    yield from zip(of, self.encode(group), strict=True)
                    group, of, size = [], [], 0
        yield from zip(of, self.encode(group), strict=True)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def _load(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary.parse(f.read(), pattern)


def _vocabulary(spark, vocabulary: str):
    """A function that gives the vocabulary on an executor; the file travels with the application."""
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    return lambda pattern: _load(SparkFiles.get(name), pattern)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encodes each text with the rank file `vocabulary`, then decodes the ids.

    Each match of `pattern` is encoded separately; no special tokens. Returns doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by one space), decoded_sha256 (of the decoded bytes; both lowercase hex) and same (whether those
    are the text's bytes). Null texts are empty: no tokens. One row per input row, ties and repeats included; an
    empty table gives an empty one. Other columns are ignored.
    """
    S.ship(docs.sparkSession)
    load = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(pattern)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sums = [[hashlib.sha256(), hashlib.sha256(), 0] for _ in texts]
            for k, ids in v.pieces(texts):
                at = sums[k]
                at[0].update(((" " if at[2] and ids else "") + " ".join(map(v.digits.__getitem__, ids))).encode())
                at[1].update(v.decode(ids))
                at[2] += len(ids)
            rows = [(i, n, a.hexdigest(), d := b.hexdigest(), d == hashlib.sha256(t.encode("utf-8", "replace")).hexdigest()) for i, t, (a, b, n) in zip(batch.column(0).to_pylist(), texts, sums, strict=True)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, types, strict=True)], names)

    out = S.documents(docs).mapInArrow(run, SCHEMA)
    return out.select(S.public_id(), "n_tokens", "ids_sha256", "decoded_sha256", "same")
