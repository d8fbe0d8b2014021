"""Substring dedup behind a count-min prefilter.

Pass 1: each block of documents makes a count-min sketch of its word windows (two rows of counters); the sketches are merged region by
region and give each block an estimate for each window, never below how often it occurs. Pass 2: only windows estimated to occur twice
are grouped exactly, by a 128-bit digest of their words, to the smallest document that holds each. Both passes send
one entry per window and block, so neither a window in a third of all documents nor a document of copies gathers rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm import _exchange as X
from palisade.llm import _session as S
from palisade.llm._kernels import Texts, Words, covered

SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def repeated_windows(docs: DataFrame, width: int = 13, emit_text: bool = True) -> DataFrame:
    """Removes each word of a text that a window of `width` words covers whose words also stand together in a
    document of smaller doc_id.

    Returns doc_id, n_words, n_removed and, of the words left (joined by one space), kept: the text, or with
    emit_text=False the lowercase hex SHA-256 of its UTF-8 bytes. Words are runs of other than ASCII white space.
    Null or blank texts have no words (kept is empty). Rows with the same doc_id don't remove each other's words.
    Null ids rank first. An empty table gives an empty one. Other columns are ignored.
    """
    S.ship(docs.sparkSession)
    size = S.text_bytes(docs)
    n = shards = S.block_count(size)
    docs = S.blocked(S.documents(docs), n)
    sketch = X.CountMin(size)

    def count(block: int, table: pa.Table):
        return sketch.add(block, Words(Texts(table)).windows(width)[1])

    def choose(docs_: pa.Table, got: pa.Table) -> pa.Table:
        block, texts = X.block_of(docs_, got), Texts(docs_)
        words = Words(texts)
        first, hashes = words.windows(width)
        likely = sketch.estimates(hashes, X.answers(got)) >= 2
        first = first[likely]
        joined, begin, end = words.joined(texts.data)
        joined, blake = joined.tobytes(), hashlib.blake2b
        entries: dict[bytes, int] = {}
        entry = np.fromiter((entries.setdefault(blake(joined[a:b], digest_size=16).digest(), len(entries)) for a, b in zip(begin[first].tolist(), end[first + width - 1].tolist(), strict=True)), np.int64, len(first))
        _, at = np.unique(entry, return_index=True)  # documents come in order of doc_id
        least = texts.ids[words.doc[first[at]]]
        digests = np.frombuffer(b"".join(entries), np.uint8).reshape(-1, 16)
        shard = (digests[:, :4].copy().view(np.uint32)[:, 0] % shards).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        # to itself: which windows are likely, which of those come first in the block, the entries of the others, the entries' shards
        again = np.ones(len(first), bool)
        again[at] = False
        rows = [(block % shards, block, b"S" + X.pack(np.packbits(likely), np.packbits(again), entry[again].astype(np.uint32), shard.astype(np.uint32)))]
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            part = order[edges[s] : edges[s + 1]]
            rows.append((s, block, b"K" + X.pack(digests[part].reshape(-1).view(np.uint64), least[part])))
        return X.messages(rows)

    def group(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        sent = list(zip(table.column("block").to_pylist(), table.column("body").to_pylist(), strict=True))
        rows = [(shard, k, b) for k, b in sent if b[:1] == b"S"]
        keyed = [(k, *X.unpack(b[1:], np.uint64, np.int64)) for k, b in sent if b[:1] == b"K"]
        if keyed:
            pairs = np.concatenate([d for _, d, _ in keyed]).reshape(-1, 2)
            least = np.concatenate([m for _, _, m in keyed])
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (pairs[order][1:] != pairs[order][:-1]).any(1)
            smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
            earlier = np.empty(len(order), bool)
            earlier[order] = smallest[np.cumsum(new) - 1] < least[order]
            edges = np.cumsum([0, *(len(m) for _, _, m in keyed)])
            rows += [(shard, k, b"K" + earlier[a:b].tobytes()) for (k, _, _), a, b in zip(keyed, edges, edges[1:], strict=False)]
        return X.messages(rows)

    def remove(docs_: pa.Table, got: pa.Table) -> pa.Table:
        texts = Texts(docs_)
        words = Words(texts, hashes=False)
        bodies = sorted(zip(got.column("shard").to_pylist(), got.column("body").to_pylist(), strict=True))
        earlier = np.frombuffer(b"".join(b[1:] for _, b in bodies if b[:1] == b"K"), bool)
        hit = np.zeros(0, np.int64)
        for likely, again, known, shard in (X.unpack(b[1:], np.uint8, np.uint8, np.uint32, np.uint32) for _, b in bodies if b[:1] == b"S"):
            first, _ = words.windows(width, hashes=False)
            first = first[np.unpackbits(likely, count=len(first)).astype(bool)]
            again = np.unpackbits(again, count=len(first)).astype(bool)
            entry = np.empty(len(first), np.int64)
            entry[again], entry[~again] = known, np.arange(len(shard))
            at_shard = np.empty(len(shard), np.int64)
            at_shard[np.argsort(shard, kind="stable")] = np.arange(len(shard))
            ids = texts.ids[words.doc[first]]
            hit = first[(ids > ids[~again][entry]) | earlier[at_shard[entry]]]
        gone = covered(hit, width, len(words))
        joined, begin, end = words.joined(texts.data, ~gone)
        doc = words.doc[~gone]
        a, b = np.searchsorted(doc, np.arange(len(texts))), np.searchsorted(doc, np.arange(len(texts)), "right")
        joined = joined.tobytes()
        kept = [joined[begin[i] : end[j - 1]] if j > i else b"" for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        kept = [x.decode() for x in kept] if emit_text else [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table({"doc_id": pa.array(texts.ids, pa.int64()), "n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(words.count - (b - a), pa.int64()), "kept": pa.array(kept, pa.string())})

    marks = X.meet(X.send(docs, count), sketch.shards, sketch.merge)
    sent = X.back(docs, marks, n, choose, X.MESSAGE)
    out = X.back(docs, X.meet(sent, shards, group), n, remove, SCHEMA)
    return out.select(S.public_id(), "n_words", "n_removed", "kept")
