"""Grouped prefix join for Jaccard similarity of word shingles.

Shingles are ordered by an estimate of how many documents hold them (a count-min sketch), rarest first, so a link needs a common shingle in both prefixes.
Documents with the same set are one class; classes with the same prefix and size are one group, and only groups enter
the inverted lists. Groups that lists connect form a family; families are expanded to classes and verified exactly,
small ones whole, large ones in blocks: there a first pass verifies each class against the heads of its lists, and pairs
of blocks are then verified only where they still hold different components. No list, family or copy is turned into all
its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import _exchange as X
from palisade.llm import _session as S
from palisade.llm._components import components
from palisade.llm._kernels import U64, Texts, Words, mixed, powers

#: Classes of a block, and of small families that are verified in one call.
BLOCK, TOGETHER = 256, 2000
_ROWS = "doc_id long, n long, set_id binary, prefix_id binary, tokens array<long>, shingles binary"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: Texts, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; of a text with fewer words, of all its words."""
    words = Words(texts, fold=True)
    first, hashes = words.windows(width)
    edges = np.searchsorted(words.doc[first], np.arange(len(texts) + 1))
    begin = np.concatenate(([0], np.cumsum(words.count)))
    out = []
    for i, n in enumerate(words.count.tolist()):
        if n >= width:
            out.append(np.unique(hashes[edges[i] : edges[i + 1]]))
        elif n:
            whole = words.hash[begin[i] : begin[i + 1]]
            out.append(mixed((whole * powers(n + 1)[0][1:]).sum(keepdims=True) + U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


def similar(a: np.ndarray | int, b: np.ndarray | int, common: np.ndarray | int, percent: int):
    """Whether common / (a + b - common) reaches percent, in whole numbers."""
    return (100 + percent) * common >= percent * (a + b)


def verified(ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of all rows: each row with the first row of its component, unless `known` has both."""
    size = np.array([len(s) for s in sets])
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[term] >= 2
    term, row = term[shared], row[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    names, term = np.unique(term, return_inverse=True)
    for low in range(0, len(names), 4096):
        part = (term >= low) & (term < low + 4096)
        held = np.zeros((len(sets), min(4096, len(names) - low)), np.float32)
        held[row[part], term[part] - low] = 1
        common += held @ held.T
    link = similar(size[:, None], size[None, :], common, percent) & (common > 0)
    link |= known[:, None] == known[None, :]
    label = np.arange(len(sets))
    while True:
        near = np.where(link, label[None, :], len(sets)).min(1)
        near = near[near]
        if (near == label).all():
            break
        label = near
    return [(int(ids[i]), int(ids[k])) for i, k in enumerate(label.tolist()) if i != k and known[i] != known[k]]


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents whose sets of `width`-word shingles have a Jaccard similarity of percent / 100 or more.

    Returns doc_id, n_shingles (of the set) and component_id (smallest doc_id that links reach, itself included). Words are
    runs of other than ASCII white space, A-Z as a-z; a text of fewer than `width` words has all of them as one
    shingle; a null or blank text has none and links with nothing, not even its like. Rows that share a doc_id
    keep one row each and count as linked. Null ids rank first. An empty table gives an empty one. Other columns are ignored.
    """
    S.ship(docs.sparkSession)
    size = S.text_bytes(docs)
    n = S.block_count(size)
    docs = S.blocked(S.documents(docs), n)
    sketch = X.CountMin(size)

    def count(block: int, table: pa.Table):
        return sketch.add(block, np.concatenate([np.zeros(0, U64), *shingle_sets(Texts(table), width)]))

    def rows(docs_: pa.Table, got: pa.Table) -> pa.Table:
        texts = Texts(docs_)
        sets = shingle_sets(texts, width)
        code = sketch.estimates(np.concatenate([np.zeros(0, U64), *sets]), X.answers(got))
        out, seen, at = [], set(), 0
        for doc_id, s in zip(texts.ids.tolist(), sets, strict=True):
            size = len(s)
            c = code[at : at + size]
            at += size
            least = -(-percent * size // 100)
            order = np.lexsort((s, c))[: size - least + 1] if size else np.zeros(0, np.int64)
            tokens = s[order][c[order] >= 2]
            if not len(tokens):
                out.append((doc_id, size, None, None, None, None))
                continue
            body = s.tobytes()
            set_id = hashlib.blake2b(body, digest_size=16).digest()
            if set_id in seen:
                out.append((doc_id, size, set_id, None, None, None))
            else:
                seen.add(set_id)
                prefix = hashlib.blake2b(s[order].tobytes() + size.to_bytes(8, "little"), digest_size=16).digest()
                out.append((doc_id, size, set_id, prefix, tokens.view(np.int64), body))
        cols = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n", "set_id", "prefix_id", "tokens", "shingles"])

    marks = X.meet(X.send(docs, count), sketch.shards, sketch.merge)
    table = S.checkpointed(X.back(docs, marks, n, rows, _ROWS))

    # classes: the first document of each set; then groups of classes with the same prefix and size
    first = Window.partitionBy("set_id").orderBy("id")
    held = table.where("shingles IS NOT NULL").withColumnRenamed("doc_id", "id")  # a row a block and set
    narrow = held.select("id", "set_id", "prefix_id").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    classes = S.checkpointed(narrow)
    groups = classes.groupBy("prefix_id").agg(F.min("id").alias("gid"))
    member = classes.select("id", "prefix_id").join(groups, "prefix_id").select("id", "gid")
    lists = held.select("id", "tokens").join(groups.select(F.col("gid").alias("id")), "id", "left_semi").select("id", F.explode("tokens").alias("token"))
    heads = lists.groupBy("token").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("token", "head")
    lists = S.checkpointed(lists.join(heads, "token").groupBy("id", "head").agg(F.count("*").alias("n")))
    families = components(lists.select(F.col("id").alias("a"), F.col("head").alias("b")))
    # groups of several classes are families of their own at least
    families = member.join(families.withColumnRenamed("id", "gid"), "gid", "left").select("id", F.coalesce("component", "gid").alias("family"))
    sizes = families.groupBy("family").agg(F.count("*").alias("size")).where("size > 1")
    families = S.checkpointed(families.join(sizes, "family"))

    sets = held.select("id", "n", "shingles")  # sets travel only when a family needs them
    small = families.where(F.col("size") <= BLOCK)
    calls = max(1, math.ceil(small.count() / TOGETHER))
    links = [_small(small.join(sets, "id").withColumn("call", F.pmod(F.xxhash64("family"), F.lit(calls))), percent)]
    large = families.where(F.col("size") > BLOCK)
    if large.limit(1).count():
        links += _large(large.join(sets, "id"), lists, member, percent)
    joined = links[0]
    for more in links[1:]:
        joined = joined.unionByName(more)
    found = components(joined)

    same = classes.select("set_id", "id").join(found, "id", "left").select("set_id", F.coalesce("component", "id").alias("component"))
    out = table.select("doc_id", "n", "set_id").join(same, "set_id", "left")
    return out.select(S.public_id(), F.col("n").alias("n_shingles"), F.when(F.coalesce("component", "doc_id") != F.lit(S.LOWEST_ID), F.coalesce("component", "doc_id")).alias("component_id"))


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def _columns(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return table.column("id").to_numpy(), [np.frombuffer(b, U64) for b in table.column("shingles").to_pylist()]


def _small(rows: DataFrame, percent: int) -> DataFrame:
    """Links within whole families."""

    def run(table: pa.Table) -> pa.Table:
        ids, sets = _columns(table)
        family = table.column("family").to_numpy()
        order = np.lexsort((ids, family))
        cut = np.flatnonzero(np.diff(family[order])) + 1
        out = []
        for x in np.split(order, cut):
            out += verified(ids[x], ids[x], [sets[i] for i in x], percent)
        return _links(out)

    return rows.groupBy("call").applyInArrow(run, "a long, b long")


def _large(rows: DataFrame, lists: DataFrame, member: DataFrame, percent: int) -> list[DataFrame]:
    """Links within families of more than a block: with the heads of lists first, then between blocks."""
    rows = S.checkpointed(rows)

    def pairs(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for i, j, s, t in zip(a, b, x, y, strict=True):
                s, t = np.frombuffer(s, U64), np.frombuffer(t, U64)
                if similar(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True)), percent):
                    keep.append((i, j))
            yield from _links(keep).to_batches()

    # each class with the first class of its group and the two heads that most of its group's lists have
    common = Window.partitionBy("id").orderBy(F.desc("n"), "head")
    lists = lists.where("id <> head").withColumn("k", F.row_number().over(common)).where("k <= 2").select(F.col("id").alias("gid"), "head")
    heads = member.join(lists, "gid").select("id", "head").unionByName(member.select("id", F.col("gid").alias("head"))).where("id <> head").distinct()
    sets = rows.select("id", "n", "shingles")
    near = rows.select("id", "n", "shingles").join(heads, "id").join(sets.toDF("head", "m", "other"), "head")
    near = near.where((F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent))
    stars = S.checkpointed(near.select("id", "head", "shingles", "other").mapInArrow(pairs, "a long, b long"))

    known = components(stars)
    narrow = rows.select("family", "id", "n").join(known, "id", "left").withColumn("known", F.coalesce("component", "id")).drop("component")
    # a block holds about BLOCK classes of like sizes, of one component if that has as many; numbers come from counts, so no family is sorted in one task
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / min(percent, 99))))
    large = narrow.groupBy("family", "known").agg(F.count("*").alias("m")).where(F.col("m") >= BLOCK).drop("m").withColumn("alone", F.col("known"))
    narrow = narrow.join(large, ["family", "known"], "left").withColumn("alone", F.coalesce("alone", F.lit(S.LOWEST_ID))).withColumn("band", band)
    shares = narrow.groupBy("family", "alone", "band").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
    narrow = narrow.join(shares, ["family", "alone", "band"])
    block = F.xxhash64("family", "alone", "band", F.pmod(F.xxhash64("id"), F.col("shares")))
    rows = S.checkpointed(rows.select("id", "shingles").join(narrow.select("family", block.alias("block"), "id", "n", "known"), "id").select("family", "block", "id", "n", "known", "shingles"))
    blocks = rows.groupBy("family", "block").agg(F.min("known").alias("lo"), F.max("known").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = blocks.alias("a"), blocks.alias("b")
    open_ = ~((F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo")))
    near = (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    cells = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.block") <= F.col("b.block")) & open_ & near)
    cells = cells.select(F.col("a.family").alias("family"), F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    sides = cells.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))

    def run(table: pa.Table) -> pa.Table:
        ids, sets = _columns(table)
        return _links(verified(ids, table.column("known").to_numpy(), sets, percent))

    between = rows.join(sides, ["family", "block"]).groupBy("family", "i", "j").applyInArrow(run, "a long, b long")
    return [stars, between]
