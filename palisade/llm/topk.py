"""Exact top-k search by term-at-a-time accumulation.

Vectors are packed into blocks of sparse rows. Every block of queries meets every block of candidates once, as two
rows of a grid cell, so a task holds one block of each whatever the table's size. In a cell the candidates are an
inverted file; each query row scatters its weighted postings, one term after another, into a dense array of scores,
from which partition selection takes the k best. The k best of all cells are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import _exchange as X
from palisade.llm import _session as S

#: Candidates and queries of a grid cell; queries whose scores are held at a time.
CANDIDATES, QUERIES, HELD = 8192, 4096, 128
_BLOCK = "c int, q int, body binary"


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as long; null if the vector or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def cell_top_k(queries: tuple, candidates: tuple, k: int):
    """(query rows, candidate rows, candidate ids, scores) of the k best of each query; both sides are (rows, ids, sizes, terms, weights).

    Equal scores go to the smaller candidate id, then the smaller row; a query never meets its own row.
    """
    rows, ids, sizes, terms, weights = candidates
    order = np.lexsort((rows, ids))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    rows, ids = rows[order], ids[order]
    doc = np.repeat(place, sizes)
    by = np.lexsort((doc, terms))
    terms, doc, weights = terms[by], doc[by], weights[by]
    names, at = np.unique(terms, return_index=True)
    postings = {int(t): (doc[a:b], weights[a:b]) for t, a, b in zip(names, at, [*at[1:], len(terms)], strict=True)}
    q_rows, _, q_sizes, q_terms, q_weights = queries
    q_row = np.repeat(np.arange(len(q_rows)), q_sizes)
    found = []
    for first in range(0, len(q_rows), HELD):
        own = q_rows[first : first + HELD]
        part = (q_row >= first) & (q_row < first + HELD)
        at_row, ts, ws = q_row[part] - first, q_terms[part], q_weights[part]
        scores = np.zeros((len(own), len(ids)), np.int64)
        for t in np.unique(ts).tolist():
            if t in postings:
                docs, values = postings[t]
                who = ts == t
                if len(docs) == len(ids):
                    scores[at_row[who]] += ws[who][:, None] * values[None, :]
                else:
                    scores[np.ix_(at_row[who], docs)] += ws[who][:, None] * values[None, :]
        for q, row in zip(own.tolist(), scores, strict=True):
            other = np.flatnonzero(rows != q)
            row = row[other]
            m = min(k, len(row))
            if not m:
                continue
            least = np.partition(row, len(row) - m)[len(row) - m]
            more = np.flatnonzero(row > least)
            best = np.concatenate([more, np.flatnonzero(row == least)[: m - len(more)]])
            found.append((np.full(m, q), rows[other][best], ids[other][best], row[best]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def inner_product_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k candidates of highest integer inner product for each row where is_query (a condition on vec_id) holds.

    Returns query_id, rank (from 1), vec_id and score; ties go to the smaller vec_id, fewer than k rows if there are
    fewer candidates. Components beyond a shorter vector count as 0; sums are 64-bit. Vectors that are null or
    hold null or non-finite components take no part. Rows that share an id are rows of their own, as queries and as candidates: a
    query meets every row but itself. A null id ranks first and comes out as null. An empty table gives an empty one. Other columns are ignored.
    """
    S.ship(vectors.sparkSession)
    rows = vectors.select(F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(S.LOWEST_ID)).alias("vec_id"), quantised(F.col(f"`{embedding}`"), scale).alias("terms"))
    # numbers of rows, written down: both sides must see the same ones
    rows = S.checkpointed(rows.where("terms IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    is_query = F.coalesce(is_query, F.lit(False)) & (F.col("vec_id") != F.lit(S.LOWEST_ID))
    total, asked = rows.select(F.count("*"), F.count_if(is_query)).first()
    nc, nq = max(1, math.ceil(total / CANDIDATES)), max(1, math.ceil(asked / QUERIES))

    def packed(table: pa.Table, c: int, q: int) -> pa.Table:
        vectors_ = table.column("terms").combine_chunks()
        flat, sizes = vectors_.flatten().to_numpy(zero_copy_only=False), np.diff(vectors_.offsets.to_numpy())
        first = np.cumsum(sizes) - sizes
        terms = np.arange(len(flat)) - np.repeat(first, sizes)
        used = flat != 0
        row = np.repeat(np.arange(len(sizes)), sizes)[used]
        body = X.pack(table.column("row").to_numpy(), table.column("vec_id").to_numpy(), np.bincount(row, minlength=len(sizes)), terms[used], flat[used])
        return pa.table({"c": pa.array([c], pa.int32()), "q": pa.array([q], pa.int32()), "body": pa.array([body], pa.binary())})

    def grid(side: DataFrame, name: str, n: int, other: str, m: int) -> DataFrame:
        numbered = side.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
        make = (lambda t: packed(t, t.column("c")[0].as_py(), -1)) if name == "c" else (lambda t: packed(t, -1, t.column("q")[0].as_py()))
        blocks = numbered.groupBy(name).applyInArrow(make, _BLOCK)
        return blocks.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("query", F.lit(name == "q")).select("c", "q", "query", "body")

    def meet(table: pa.Table) -> pa.Table:
        sides = {s: tuple(X.unpack(b, *[np.int64] * 5)) for s, b in zip(table.column("query").to_pylist(), table.column("body").to_pylist(), strict=True)}
        found = cell_top_k(sides[True], sides[False], k) if len(sides) == 2 else [np.zeros(0, np.int64)] * 4
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query", "row", "vec_id", "score"), found, strict=True)})

    cells = grid(rows, "c", nc, "q", nq).unionByName(grid(rows.where(is_query), "q", nq, "c", nc))
    found = cells.groupBy("c", "q").applyInArrow(meet, "query long, row long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked_ids = rows.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return found.join(asked_ids, "query").select("query_id", "rank", S.public_id("vec_id"), "score")
