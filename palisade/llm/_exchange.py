"""Two-way exchange between blocks of documents and shards of a hash space.

A block sends each shard one row that holds its distinct keys there; a shard answers with one row for each block. So a
key costs a few bytes per block however often it occurs, no key gathers its documents in one task, and both ends are of
bounded size. Shards have a size of their own, apart from the blocks'; both are dealt one to a partition.

CountMin is the commonest use: rows of counters, cut into regions, to which every block adds its non-zero counters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm._kernels import U64, mixed, release

MESSAGE = "shard int, block int, body binary"
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("body", pa.binary())])


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types, strict=True)], schema=_ARROW)


def answers(table: pa.Table) -> dict[int, bytes]:
    """The answers that a block got, by shard."""
    return dict(zip(table.column("shard").to_pylist(), table.column("body").to_pylist(), strict=True))


def block_of(*tables: pa.Table) -> int:
    return next(t.column("block")[0].as_py() for t in tables if t.num_rows)


def _lean(out: pa.Table) -> pa.Table:
    """out, after what its making has freed went back to the system."""
    release()
    return out


def send(docs: DataFrame, make) -> DataFrame:
    """make(block, table of its documents) -> rows for messages()."""
    return docs.groupBy("block").applyInArrow(lambda table: _lean(messages(make(block_of(table), table))), MESSAGE)


def meet(sent: DataFrame, shards: int, work) -> DataFrame:
    """work(table of a shard's messages) -> table of answers."""
    return sent.repartitionById(shards, "shard").groupBy("shard").applyInArrow(lambda table: _lean(work(table)), MESSAGE)


def back(docs: DataFrame, replies: DataFrame, blocks: int, work, schema: str) -> DataFrame:
    """work(table of a block's documents, its answers) -> table of the given schema."""
    return docs.groupBy("block").cogroup(replies.repartitionById(blocks, "block").groupBy("block")).applyInArrow(lambda a, b: _lean(work(a, b)), schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one string of bytes; unpack() with the same types gives them back."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(body: bytes, *types) -> Iterator[np.ndarray]:
    sizes, at = np.frombuffer(body, np.int64, len(types)), 8 * len(types)
    for n, t in zip(sizes, types, strict=True):
        yield np.frombuffer(body, t, int(n), at)
        at += int(n) * np.dtype(t).itemsize


def packed(*arrays: np.ndarray) -> bytes:
    """As pack(), compressed (all first bytes of the numbers, then all second ones); unpacked() gives the arrays back."""
    body = pack(*(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.ravel() for a in arrays))
    return np.int64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpacked(body: bytes, *types) -> list[np.ndarray]:
    plain = pa.decompress(body[8:], int(np.frombuffer(body, np.int64, 1)[0]), codec="zstd", asbytes=True)
    return [np.ascontiguousarray(a.reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() for a, t in zip(unpack(plain, *[np.uint8] * len(types)), types, strict=True)]


class CountMin:
    """A count-min sketch: `rows` rows of counters, `per_byte` to each byte of all texts, cut into regions.

    A block adds its counters to each region that it has any in (without the zero ones; each up to 255); a region is one dense array
    in one task, and answers with the block's counters' sums up to 255. A key's estimate is the least of its counters, one in
    each row: never below how often it occurs, and above it only where others share its counter in every row.
    """

    #: Counters of a region at most, a byte each: what a task holds.
    REGION = 1 << 26

    def __init__(self, text_bytes: int, rows: int = 2, per_byte: float = 1.0, least: int = 6):
        self.rows = rows
        self.regions = max(least, math.ceil(text_bytes * per_byte / self.REGION))
        self.size = max(1024, math.ceil(text_bytes * per_byte / self.regions))
        #: Regions of all rows.
        self.shards = rows * self.regions

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        """The counter of each key in a row, numbered over all rows."""
        width = U64(self.regions * self.size)
        return mixed(keys + U64((row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % width + U64(row) * width

    def _cuts(self, cells: np.ndarray) -> list[tuple[int, int, int]]:
        """(shard, first, one after the last) of the regions in sorted cells."""
        shard = (cells // U64(self.size)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(cells)] if len(cells) else []
        return [(int(shard[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def add(self, block: int, keys: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Messages that add a block's keys (as often as they stand there)."""
        out = []
        for row in range(self.rows):
            cells, counts = np.unique(self.cells(keys, row), return_counts=True)
            few = np.minimum(counts, 255).astype(np.uint8)
            out += [(s, block, packed(np.diff(cells[a:b] - U64(s * self.size), prepend=U64(0)).astype(np.uint32), few[a:b])) for s, a, b in self._cuts(cells)]
        return out

    def merge(self, table: pa.Table) -> pa.Table:
        """The sums of a region's counters, for each block those that it has."""
        shard, blocks, bodies = table.column("shard")[0].as_py(), table.column("block").to_pylist(), table.column("body")
        counters = np.zeros(self.size, np.uint8)
        for body in bodies:
            steps, few = unpacked(body.as_py(), np.uint32, np.uint8)
            at = np.cumsum(steps, dtype=np.int64)
            counters[at] = np.minimum(counters[at].astype(np.uint16) + few, 255)
        rows = []
        for block, body in zip(blocks, bodies, strict=True):
            at = np.cumsum(unpacked(body.as_py(), np.uint32, np.uint8)[0], dtype=np.int64)
            rows.append((shard, block, packed(counters[at])))
        return messages(rows)

    def estimates(self, keys: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
        """Of a block's keys (all that it added), how often they occur in all blocks: at least so often, and up to 255."""
        out = np.full(len(keys), 255, np.uint8)
        for row in range(self.rows):
            cells, inverse = np.unique(self.cells(keys, row), return_inverse=True)
            found = np.zeros(len(cells), np.uint8)
            for s, a, b in self._cuts(cells):
                found[a:b] = unpacked(got[s], np.uint8)[0]
            np.minimum(out, found[inverse], out=out)
        return out
