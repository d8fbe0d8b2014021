"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Texts become term vectors: hashed words, and the shapes of words and their repetition, which tell prose from noise.
IDF weights count every document. A bounded sample of labelled texts is factored (truncated SVD) and sent to the
executors as vectors of a few dozen components; every document's cosine to all of them is computed in blocks, and the
nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm import _exchange as X
from palisade.llm import _session as S
from palisade.llm._kernels import U64, Texts, Words, text_slices

#: Terms: hashed words, hashed word shapes, repetition.
WORDS, SHAPES, REPEATS = 2048, 1024, 32
TERMS = WORDS + SHAPES + REPEATS
#: Labelled texts that are learnt from at most; latent components; votes.
SAMPLE, LATENT, VOTES = 4000, 48, 15
#: Weight of the groups of terms.
_GROUP = np.repeat(np.array([0.5, 1.0, 1.5], np.float32), [WORDS, SHAPES, REPEATS])

_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
for _k, _c in enumerate(range(33, 127)):
    if not chr(_c).isalnum():
        _KIND[_c] = 5 + _k


def term_counts(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of all terms that occur, sorted."""
    w = Words(texts, fold=True)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last, second = (_KIND[texts.data[x]].astype(U64) for x in (w.begin, w.end - 1, np.minimum(w.begin + 1, w.end - 1)))
    length = np.minimum(w.end - w.begin, 20).astype(U64)
    shape = (((first * U64(128) + last) * U64(128) + second) * U64(4) + length // U64(6)) * U64(0x9E3779B97F4A7C15) >> U64(40)
    terms = [(w.hash >> U64(32)) % U64(WORDS), U64(WORDS) + shape % U64(SHAPES)]
    # how often the word stood 1, 2, 3 places before, and among all words of the text
    near = np.zeros(len(w), np.int64)
    for back in (3, 2, 1):
        same = np.zeros(len(w), bool)
        same[back:] = (w.hash[back:] == w.hash[:-back]) & (w.doc[back:] == w.doc[:-back])
        near[same] = back
    key = np.unique((w.doc.astype(U64) << U64(40)) | (w.hash >> U64(24)))
    distinct = np.bincount((key >> U64(40)).astype(np.int64), minlength=len(texts))
    share = np.minimum(9 - 10 * distinct / np.maximum(w.count, 1), 9).astype(np.int64).clip(0) + 1
    size = np.minimum(np.log2(w.count + 1), 15).astype(np.int64)
    terms += [U64(WORDS + SHAPES) + near.astype(U64), U64(WORDS + SHAPES + 4) + share[w.doc].astype(U64), U64(WORDS + SHAPES + 16) + size[w.doc].astype(U64)]
    cell, count = np.unique(np.concatenate([w.doc.astype(U64) * U64(TERMS) + t for t in terms]), return_counts=True)
    return (cell // U64(TERMS)).astype(np.int64), (cell % U64(TERMS)).astype(np.int64), count


def vectors(n: int, text: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Dense term vectors of length 1 (0 for an empty text)."""
    total = np.bincount(text, np.where(term < WORDS, count, 0), n)
    out = np.zeros((n, len(idf)), np.float32)
    out[text, term] = np.sqrt(count / np.maximum(total[text], 1)) * idf[term] * _GROUP[term]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Voters:
    """Labelled latent vectors. score() is the votes' share of label 1."""

    def __init__(self, idf: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.idf, self.labels = idf, labels.astype(np.float32)
        rank = min(LATENT, *rows.shape) if len(rows) else 0
        if rank:
            rng = np.random.default_rng(7)
            q = rows @ rng.standard_normal((rows.shape[1], min(rank + 16, len(rows))), np.float32)
            for _ in range(3):
                q, _ = np.linalg.qr(rows @ (rows.T @ q))
            _, _, v = np.linalg.svd(q.T @ rows, full_matrices=False)
            self.axes = v[:rank].T.astype(np.float32)
            self.latent = self._unit(rows @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, n: int, text: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(n, 0.5)
        out = np.empty(n)
        votes = min(VOTES, len(self.labels))
        for first in range(0, n, 256):
            a, b = np.searchsorted(text, [first, first + 256])
            m = min(256, n - first)
            cosine = self._unit(vectors(m, text[a:b] - first, term[a:b], count[a:b], self.idf) @ self.axes) @ self.latent.T
            near = np.argpartition(cosine, cosine.shape[1] - votes, axis=1)[:, -votes:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 8 + 1e-6
            out[first : first + m] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out.clip(0, 1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Quality of every text, learnt from labels (doc_id, quality) of the ids with crc32(id) % folds != 0.

    Returns doc_id, held_out (that remainder is 0), score (0 to 1; higher: label 1 is likelier) and predicted (1 if
    score >= threshold, else 0). At most `sample` labelled texts are learnt from, chosen by a hash of their id; ids
    with several labels count as the largest, ids with several texts as the least of them. A text that is learnt from is among its own
    neighbours, so only held-out scores tell how good they are. Null texts are empty and get the score of texts without words. Without
    usable labels every score is 0.5. A null id is never learnt from and not held out. One row per input row; an
    empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    S.ship(spark)
    docs = S.documents(docs)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, np.int64), 0
        for texts in text_slices(batches):
            df += np.bincount(term_counts(texts)[1], minlength=TERMS)
            n += len(texts)
        yield from pa.table({"term": np.arange(-1, TERMS), "n": np.concatenate(([n], df))}).to_batches()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_slices(batches):
            text, term, count = term_counts(texts)
            cut = np.searchsorted(text, np.arange(len(texts) + 1))
            bodies = [X.pack(term[a:b].astype(np.uint16), count[a:b].astype(np.uint32)) for a, b in zip(cut, cut[1:], strict=False)]
            yield from pa.table({"doc_id": texts.ids, "body": pa.array(bodies, pa.binary())}).to_batches()

    counted = dict(docs.mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # TERMS + 1 rows at most
    df = np.array([counted.get(t, 0) for t in range(TERMS)])
    idf = np.log((counted.get(-1, 0) + 1) / (df + 1)).astype(np.float32) + 0.1

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.where(remainder(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    label = {r["doc_id"]: int(r["quality"] > 0) for r in chosen.collect()}  # `sample` rows at most
    ids = spark.createDataFrame([(i,) for i in label], "doc_id long")
    texts = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # of texts that share an id the least
    got = sorted((r["doc_id"], bytes(r["body"])) for r in texts.mapInArrow(found, "doc_id long, body binary").collect())  # a row for each of them
    parts = [tuple(X.unpack(b, np.uint16, np.uint32)) for _, b in got]
    row = np.repeat(np.arange(len(parts)), [len(t) for t, _ in parts])
    term, count = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (zip(*parts, strict=True) if parts else ((), ())))
    rows = vectors(len(parts), row, term, count, idf)
    voters = spark.sparkContext.broadcast(Voters(idf, rows, np.array([label[i] for i, _ in got])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_slices(batches):
            score = voters.value.score(len(texts), *term_counts(texts))
            yield from pa.table({"doc_id": texts.ids, "score": score}).to_batches()

    scored = docs.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(S.public_id(), folds) == 0, F.lit(False))
    return scored.select(S.public_id(), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
