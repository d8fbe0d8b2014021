"""LM scoring by online logistic context mixing.

Text is predicted bit by bit. Bit predictors are counts of 0s and 1s after hashed contexts (the last 1 to 4 bytes, and the word so far, each with the
bits so far). They follow from how often each byte comes after each context in all training texts, counted exactly by context hash, whose
width grows with the corpus; the counts travel by a two-way exchange: a block sends its distinct contexts with the bytes after them, and gets
for each the log odds of its bits by the counts of all other blocks. So no text is predicted from itself, and scores of training texts and of
held-out ones compare. In each block a mixer adds the log odds with weights that a gate selects (which bit, how much the long contexts have
seen), learnt online over the block's training texts in a fixed order, and an adaptive map of its output refines it. As a bit depends on
these contexts alone, each distinct case of contexts and byte is learnt and scored once. A unigram model of tokens, whose counts travel along, is the base.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import _exchange as X
from palisade.llm import _session as S
from palisade.llm._kernels import _SPACE, _VALUES, U64, Texts, Words, mixed, prefix_sums, spans
from palisade.llm.quality import remainder

#: Bytes of text of a block; the larger, the fewer distinct contexts travel.
BLOCK_BYTES = 6 << 20
#: Bytes of text whose cases are found at a time.
PIECE = 1 << 18
#: Contexts: 1 to 4 bytes, the word so far.
ORDERS = 5
GATES, INPUTS, BUCKETS = 64, 6, 33
#: Log odds travel as whole numbers, so many to one.
STEPS = 5
_MULTIPLY = [U64(m) for m in (0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts, each distinct case of a byte after what it depends on: its 64-bit hash (sorted), the byte and the
    four before it as a number, a hash of the word so far; and for every byte the index of its case.

    Before a text stand zero bytes. A word begins after a space or with the text and lasts to the next space or end.
    """
    n = len(data)
    place = np.arange(n)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    raw = data.astype(U64)
    for k in range(1, 5):
        old = np.zeros(n, U64)
        old[k:] = data[:-k]
        old[place - start < k] = 0
        raw |= old << U64(8 * k)
    begin = start.copy()
    begin[1:] = np.where(_SPACE[data[:-1]], place[1:], begin[1:])
    begin = np.maximum.accumulate(begin)
    word = spans(prefix_sums(_VALUES[data]), begin, place)
    h = mixed(word + raw * _MULTIPLY[2])
    bits = max(1, n.bit_length())
    both = np.sort(((h >> U64(bits)) << U64(bits)) | place.astype(U64))
    key, place = both >> U64(bits), (both & U64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    index = np.empty(n, np.int32)
    index[place] = np.cumsum(new) - 1
    one = place[new]
    return h[one], raw[one], word[one], index


def context_bits(text_bytes: int) -> int:
    """Bits of a context's hash: so many that one in some thousands shares its hash with another, whatever the size of the corpus."""
    return min(56, max(24, text_bytes.bit_length() + 13))


def pairs_of(raw: np.ndarray, word: np.ndarray, order: int, bits: int = 56) -> np.ndarray:
    """Each case's context as a hash of so many bits, then its byte."""
    context = word if order == 4 else (raw >> U64(8)) & U64((1 << (8 * order + 8)) - 1)
    return (mixed(context + _MULTIPLY[order]) >> U64(64 - bits) << U64(8)) | (raw & U64(255))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their counts, and the index of every key in them."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    index = np.empty(len(keys), np.int32)
    index[order] = np.cumsum(new) - 1
    return sorted_[new], np.bincount(index, counts, int(new.sum())).astype(np.int64), index


def distinct_contexts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted pairs: the distinct contexts, and where each begins and the last ends."""
    context = pairs >> U64(8)
    new = np.ones(len(pairs), bool)
    new[1:] = context[1:] != context[:-1]
    return context[new], np.append(np.flatnonzero(new), len(pairs))


def node_totals(pairs: np.ndarray, counts: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """(9, n): for each of sorted pairs, how often its context (row 0) and its context with each further bit of its byte (row 8: the whole byte) occur.

    group, if given, keeps apart runs of pairs that are sorted each by itself.
    """
    out = np.empty((9, len(pairs)))
    for k in range(9):
        node = pairs >> U64(8 - k)
        new = np.ones(len(pairs), bool)
        new[1:] = node[1:] != node[:-1]
        if group is not None:
            new[1:] |= group[1:] != group[:-1]
        index = np.cumsum(new) - 1
        out[k] = np.bincount(index, counts)[index] if len(pairs) else 0
    return out


def path_odds(totals: np.ndarray) -> np.ndarray:
    """(8, n): log odds of each bit of a pair's byte, towards the bit that it has, as whole numbers."""
    yes, no = totals[1:], totals[:-1] - totals[1:]
    return np.clip(np.rint(STEPS * np.log((yes + 0.05) / (no + 0.05))), -127, 127).astype(np.int8)


def confidence(total: np.ndarray) -> np.ndarray:
    """How much a context has seen, in eighths of powers of two."""
    return np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)


class Cases:
    """Distinct cases of some texts: bytes, count in training texts; for every byte of text its case; for every order distinct pairs with counts, and each case's pair."""

    def __init__(self, texts: Texts, training: np.ndarray, bits: int):
        parts, at, size = [], [], 0
        for first, last, data, offsets in texts.chunks(PIECE):
            h, raw, word, index = grams(data, offsets)
            parts.append((h, raw, word, np.bincount(index, np.repeat(training[first:last], np.diff(offsets)), len(h))))
            at.append(index + np.int32(size))
            size += len(h)
        h, raw, word, count = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((U64, U64, U64, np.float64), zip(*parts, strict=True) if parts else ((),) * 4, strict=True))
        del parts
        _, one, same = np.unique(h, return_index=True, return_inverse=True)
        self.index = same.astype(np.int32)[np.concatenate([np.zeros(0, np.int32), *at])]
        self.count = np.bincount(same, count, len(one))
        raw, word = raw[one], word[one]
        self.byte = (raw & U64(255)).astype(np.uint8)
        # the last bytes are the same in many cases, so shorter contexts follow from few
        short, many, at = merged(raw, self.count)
        self.pairs = []
        for order in range(ORDERS - 1):
            pairs, counts, index = merged(pairs_of(short, short, order, bits), many)
            self.pairs.append((pairs, counts, index[at]))
        self.pairs.append(merged(pairs_of(raw, word, ORDERS - 1, bits), self.count))


class Mixer:
    """Weights by gate, and the adaptive map: 1s and all by bits so far and log odds."""

    def __init__(self):
        self.weights = np.full((GATES, INPUTS), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.seen = np.zeros((2, 256 * BUCKETS))

    def inputs(self, cases: Cases, odds: list[np.ndarray], sure: list[np.ndarray], part: slice | np.ndarray) -> tuple[np.ndarray, ...]:
        """Of some cases, for each of their eight bits: its value, the bits before it (with a leading 1), the mixer's inputs and gates.

        odds holds eight signed bytes in one number for each pair.
        """
        byte = cases.byte[part].astype(np.int64)[:, None]
        bit = np.arange(8)
        value = (byte >> (7 - bit)) & 1
        sign = (2 * value - 1).astype(np.float32) / np.float32(STEPS)
        x = np.empty((INPUTS, len(byte), 8), np.float32)
        at = [index[part] for _, _, index in cases.pairs]
        for i in range(ORDERS):
            np.multiply(odds[i][at[i]].view(np.int8).reshape(-1, 8), sign, out=x[i])
        x[-1] = 0.3
        word, four = sure[4][at[4]], sure[3][at[3]]
        level = 2 * ((word >= 8).astype(np.int64) + (word >= 18) + (word >= 40)) + (four >= 18)
        gate = bit * 8 + level[:, None]
        return value.reshape(-1).astype(np.float32), ((byte | 256) >> (8 - bit)).reshape(-1), x.reshape(INPUTS, -1), gate.reshape(-1)

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gate), np.float32)
        for i in range(INPUTS):
            out += x[i] * self.weights[:, i][gate]
        return out.clip(-12, 12)

    def learn(self, cases: Cases, odds: list[np.ndarray], sure: list[np.ndarray], step: int = 4096, rate: float = 0.5) -> None:
        """Online: each batch of cases is predicted, counted in the adaptive map, and then changes the weights by its mean error."""
        known = np.flatnonzero(cases.count)  # in order of a hash, so well mixed
        for first in range(0, len(known), step):
            part = known[first : first + step]
            value, node, x, gate = self.inputs(cases, odds, sure, part)
            c = np.repeat(cases.count[part].astype(np.float32), 8)
            mixed_ = self.mix(x, gate)
            cell = self._cell(node, mixed_)
            self.seen[0] += np.bincount(cell, value * c, 256 * BUCKETS)
            self.seen[1] += np.bincount(cell, c, 256 * BUCKETS)
            error = (value - 1 / (1 + np.exp(-mixed_))) * c
            mass = np.bincount(gate, c, GATES) + 50
            for i in range(INPUTS):
                self.weights[:, i] += (rate * np.bincount(gate, error * x[i], GATES) / mass).astype(np.float32)

    @staticmethod
    def _cell(node: np.ndarray, odds: np.ndarray) -> np.ndarray:
        return node * BUCKETS + np.rint(odds * np.float32(BUCKETS // 2 / 12) + np.float32(BUCKETS // 2)).astype(np.int64)

    def log2(self, cases: Cases, odds: list[np.ndarray], sure: list[np.ndarray], step: int = 1 << 14) -> np.ndarray:
        """log2 of the probability of each case's byte."""
        out = np.empty(len(cases.byte))
        for first in range(0, len(out), step):
            part = slice(first, first + step)
            value, node, x, gate = self.inputs(cases, odds, sure, part)
            mixed_ = self.mix(x, gate)
            p = 1 / (1 + np.exp(-mixed_.astype(np.float64)))
            cell = self._cell(node, mixed_)
            p = (0.5 * p + 0.5 * (self.seen[0][cell] + 20 * p) / (self.seen[1][cell] + 20)).clip(1e-6, 1 - 1e-6)
            out[part] = np.log2(np.where(value > 0, p, 1 - p)).reshape(-1, 8).sum(1)
        return out


def steps(keys: np.ndarray, n: int) -> np.ndarray:
    """Sorted keys of one of n shards (equal modulo n) by their distances; keys_of() gives them back."""
    return np.diff(keys // U64(n), prepend=U64(0))


def keys_of(steps_: np.ndarray, n: int, shard: int) -> np.ndarray:
    return np.cumsum(steps_, dtype=U64) * U64(n) + U64(shard)


def lm_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Log10 probabilities of every text under two models learnt from the texts with crc32(id) % folds != 0.

    Returns doc_id, held_out (that remainder is 0), n_tokens and n_known (tokens, and those in training; tokens are runs of other than ASCII
    white space, A-Z as a-z, then one end), train_tokens (tokens of the training texts), base_score (unigrams with 0.1 added to every
    count and one unknown token), score (the mixed model, over the text's bytes) and bits_per_byte (of score; null
    for an empty text). A block's texts (dealt by a hash of their id; twelve blocks at least) are scored by the counts of all other blocks, so a training
    text never predicts itself; copies of it in other blocks do. Scores don't depend on how the input is partitioned. Null texts are empty: an end only, score 0.
    A null id is learnt from. One row per input row, rows that share an id included; an empty table gives an empty one. Other columns are ignored.
    """
    S.ship(docs.sparkSession)
    size = S.text_bytes(docs)
    n, bits = S.block_count(size, block=BLOCK_BYTES), context_bits(size)
    held = F.coalesce(remainder(S.public_id(), folds) == 0, F.lit(False))
    blocks = S.blocked(S.documents(docs), n)

    def training_of(texts: Texts) -> np.ndarray:
        return np.array([i == S.LOWEST_ID or zlib.crc32(str(i).encode()) % folds != 0 for i in texts.ids.tolist()], bool)

    def tokens(texts: Texts) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words, their distinct hashes in order of shard, and each word's place among these."""
        words = Words(texts, fold=True)
        key, inverse = np.unique(words.hash, return_inverse=True)
        order = np.argsort(key % U64(n), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return words, key[order], rank[inverse]

    def by_shard(cases: Cases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All orders' pairs and counts in order of shard, and where each stood before."""
        pairs, counts = (np.concatenate([p[i] for p in cases.pairs]) for i in (0, 1))
        order = np.lexsort((pairs, (pairs >> U64(8)) % U64(n)))
        return pairs[order], counts[order], order

    def count(block: int, table: pa.Table):
        texts = Texts(table)
        training = training_of(texts)
        words, key, entry = tokens(texts)
        own = np.bincount(entry, training[words.doc], len(key)).astype(np.uint32)
        edges = np.searchsorted(key % U64(n), np.arange(n + 1, dtype=U64))
        pairs, counts, _ = by_shard(Cases(texts, training, bits))
        counts = counts.astype(np.uint32)
        cuts = np.searchsorted((pairs >> U64(8)) % U64(n), np.arange(n + 1, dtype=U64))
        rows = []
        for s in range(n):  # to every shard, as every shard tells its totals
            a, b = slice(edges[s], edges[s + 1]), slice(cuts[s], cuts[s + 1])
            contexts, begin = distinct_contexts(pairs[b])
            ends = np.array([training.sum() if s == block % n else 0], np.int64)
            rows.append((s, block, X.packed(ends, steps(key[a], n), own[a], steps(contexts, n), np.diff(begin).astype(np.uint16), pairs[b].astype(np.uint8), counts[b])))
        return rows

    def total(table: pa.Table) -> pa.Table:
        shard, blocks_, parts, ends = table.column("shard")[0].as_py(), table.column("block").to_pylist(), [], 0
        for body in table.column("body"):
            end, key, own, contexts, many, after, times = X.unpacked(body.as_py(), np.int64, np.uint64, np.uint32, np.uint64, np.uint16, np.uint8, np.uint32)
            ends += int(end[0])
            parts.append((keys_of(key, n, shard), own, (np.repeat(keys_of(contexts, n, shard), many) << U64(8)) | after.astype(U64), times))
        key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)
        edges = np.cumsum([0, *(len(p[0]) for p in parts)])
        group = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
        pairs, times = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        cuts = np.cumsum([0, *(len(p[2]) for p in parts)])
        del parts
        every, counts, at = merged(pairs, times)
        left = node_totals(every, counts)[:, at] - node_totals(pairs, times, group)
        odds, sure = path_odds(left), confidence(left[0])
        facts = np.array([ends, sums.sum(), (sums > 0).sum()], np.int64)
        rows = []
        for block, a, b, c, d in zip(blocks_, edges, edges[1:], cuts, cuts[1:], strict=False):
            rows.append((shard, block, X.packed(facts, sums[inverse[a:b]], odds[:, c:d].reshape(-1), sure[c:d])))
        return X.messages(rows)

    def score(docs_: pa.Table, got: pa.Table) -> pa.Table:
        texts = Texts(docs_)
        training = training_of(texts)
        cases = Cases(texts, training, bits)
        _, _, order = by_shard(cases)
        bodies = X.answers(got)
        facts, known, odds, sure = zip(*(X.unpacked(bodies[s], np.int64, np.int64, np.int8, np.uint8) for s in range(n)), strict=True)
        ends, train_words, kinds = np.sum(facts, axis=0).tolist()
        all_ = np.empty(len(order), np.uint64)
        all_[order] = np.concatenate([np.ascontiguousarray(o.reshape(8, -1).T).view(np.uint64).ravel() for o in odds])
        seen = np.empty(len(order), np.uint8)
        seen[order] = np.concatenate(sure)
        cuts = np.cumsum([0, *(len(p[0]) for p in cases.pairs)])
        odds, sure = ([x[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for x in (all_, seen))
        mixer = Mixer()
        mixer.learn(cases, odds, sure)
        running = np.concatenate(([0.0], np.cumsum(mixer.log2(cases, odds, sure)[cases.index])))
        score_ = np.diff(running[texts.offsets]) * math.log10(2)
        words, _, entry = tokens(texts)
        train_tokens = train_words + ends
        unit = train_tokens + 0.1 * (kinds + (ends > 0) + 1)
        count_ = np.concatenate(known)[entry]
        base = np.bincount(words.doc, np.log10((count_ + 0.1) / unit), len(texts)) + math.log10((ends + 0.1) / unit)
        n_known = np.bincount(words.doc, count_ > 0, len(texts)).astype(np.int64) + (ends > 0)
        cols = [texts.ids, words.count + 1, n_known, np.full(len(texts), train_tokens)]
        return pa.Table.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols), pa.array(base), pa.array(score_), pa.array(np.diff(texts.offsets), pa.int64())],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
        )

    scored = X.back(blocks, X.meet(X.send(blocks, count), n, total), n, score, SCHEMA)
    bits_ = F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))
    return scored.select(S.public_id(), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits_.alias("bits_per_byte"))
