"""Suffix-array dedup of byte strings: longest-previous-factor arrays remove later copies and keep the first.

Every string of `width` bytes is filed under its anchor, the least hash among its `seed`-byte substrings: equal strings
have the same anchor, so suffix arrays can be built apart for each shard of the anchors' hash space. Pass 1 counts
anchors (a count-min sketch, see _exchange); text without a repeated anchor holds no repeated string and is left out.
Pass 2 sorts the suffixes of what remains, first in each block of documents, piece by piece, which resolves local copies,
then, for strings that are first in their piece, in the anchor's shard. In both, the previous and the next smaller position
in suffix order give each suffix its longest previous factor, and where that reaches `width` the string is a later copy.
A passage in a third of all documents reaches its shard once per piece.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm import _exchange as X
from palisade.llm import _session as S
from palisade.llm._kernels import _VALUES, CHUNK, U64, Texts, prefix_sums, spans

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept string"
#: Bytes of text whose suffixes are sorted at a time, in a block and in a shard; and of text that a shard stands for.
SORTED, PIECE, SHARD_BYTES = 1 << 20, 1 << 20, 12 << 20


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and where each stood (equal keys: in order of place if the places fit beside the key)."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()) >> (64 - bits) == 0:
        both = np.sort((key << U64(bits)) | np.arange(len(key), dtype=U64))
        return both >> U64(bits), (both & U64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], order


def first_codes(code: np.ndarray, base: np.uint64, step: int) -> np.ndarray:
    """The first `step` codes of each suffix as one number to that base; past the end stand zeros."""
    n = len(code)
    part = np.zeros(n + step, U64)
    part[:n] = code
    out, size, width = None, 0, 1
    while True:
        if step & width:
            out = part[:n].copy() if out is None else out * base ** U64(width) + part[size : size + n]
            size += width
        if size == step:
            return out
        more = np.zeros(n + step, U64)
        more[: n + step - width] = part[width:]
        part = part * base ** U64(width) + more
        width *= 2


def suffix_ranks(data: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """For each suffix, how many suffixes are smaller in their first `depth` bytes (prefix doubling).

    Past the end counts as smaller than any byte. Classes of one suffix are not sorted again. With `starts`, only the suffixes there are
    ranked, among themselves in the right order; a round sorts only suffixes that a later one looks at.
    """
    n = len(data)
    used = np.bincount(data, minlength=256) > 0
    code = np.cumsum(used)[data].astype(U64)
    base = int(used.sum()) + 1
    wide = (n + 1).bit_length()
    step = 1
    while step < depth and base ** (step + 1) < 1 << max(42, 64 - wide):
        step += 1
    # the rounds' steps, and from the last to the first which suffixes they need
    rounds = [step]
    while sum(rounds) < depth:
        rounds.append(min(sum(rounds), depth - sum(rounds)))
    needed = [np.ones(n, bool)]
    if starts is not None:
        needed[0][:] = False
        needed[0][starts] = True
    for ahead in rounds[:0:-1]:
        more = needed[0].copy()
        more[ahead:] |= needed[0][:-ahead]
        needed.insert(0, more)
    active = np.flatnonzero(needed[0]).astype(np.int32)
    key = first_codes(code, U64(base), step)[active]
    rank, done = np.zeros(n, np.int32), 0
    while True:
        key, order = ordered(key)
        at = active[order]
        old, i = rank[at], np.arange(len(at), dtype=np.int32)
        head, sub = np.ones(len(at), bool), np.ones(len(at), bool)
        head[1:], sub[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
        rank[at] = old + np.maximum.accumulate(np.where(sub, i, 0)) - np.maximum.accumulate(np.where(head, i, 0))
        done += step
        alone = sub & np.append(sub[1:], True)
        active = at[~alone]
        if done >= depth or not len(active):
            return rank
        step = min(done, depth - done)
        needed.pop(0)
        active = active[needed[0][active]]
        beyond = active + np.int32(step)
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = (rank[active].astype(U64) << U64(wide)) | second.astype(U64)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to `most`, the suffixes at a and b have in common, each pair for itself."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):
        at = out[active]
        x, y = a[active] + at, b[active] + at
        left = np.minimum(most - at, n - np.maximum(x, y))
        differ = eight[np.minimum(x, n)] ^ eight[np.minimum(y, n)]
        equal = np.bitwise_count((differ & (~differ + U64(1))) - U64(1)).astype(np.int64) >> 3  # bytes below the lowest bit that differs; 8 if none does
        out[active] = at + np.minimum(equal, left)
        active = active[(equal == 8) & (left > 8)]
    return out


def smaller_before(position: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a suffix array (its position): the nearest entry before with a smaller position, -1 without one,
    and the least of the common prefixes on the way (shared[i]: of entries i - 1 and i).

    Every entry points to the one before it; while that has a greater position, the pointer goes on to where that one points, and
    all between are greater too, so pointers double their reach in each round.
    """
    n = len(position)
    position, at, least = position.astype(np.int32), np.arange(-1, n - 1, dtype=np.int32), shared.astype(np.int32)
    active = np.flatnonzero(at >= 0)
    active = active[position[at[active]] > position[active]]
    while len(active):
        over = at[active]
        to, low = at[over], np.minimum(least[active], least[over])
        at[active], least[active] = to, low
        ends = to < 0
        least[active[ends]] = 0
        active = active[~ends]
        active = active[position[at[active]] > position[active]]
    least[at < 0] = 0
    return at, least


def previous_factor(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors: for each of the ascending starts, how many bytes (up to `width`) its suffix shares with one
    at a smaller start, and a smaller start that shares most (-1 where none shares any).

    In suffix order, the smaller starts that share most are the nearest before and the nearest behind.
    """
    length, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    if not len(starts):
        return length, source
    rank, order = ordered(suffix_ranks(data, width, starts)[starts].astype(U64))
    position = starts[order]
    shared = np.full(len(order), width, np.int64)
    apart = np.flatnonzero(rank[1:] != rank[:-1]) + 1  # the others agree in all their `width` bytes
    shared[apart], shared[0] = common_prefix(data, position[apart - 1], position[apart], width), 0
    before, long_before = smaller_before(position, shared)
    behind, long_behind = smaller_before(position[::-1], np.append(0, shared[1:][::-1]))
    behind, long_behind = len(order) - 1 - behind[::-1], long_behind[::-1]  # entries without one point past the end
    best = np.maximum(long_before, long_behind)
    from_ = np.where(long_before >= long_behind, before, behind)
    length[order] = best
    source[order] = np.where(best > 0, position[np.clip(from_, 0, len(order) - 1)], -1)
    return length, source


def _anchors(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    if len(data) < width or sizes.max() < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = width - seed + 1
    h = spans(prefix_sums(_VALUES[data]), np.arange(len(data) - seed + 1), np.arange(seed, len(data) + 1))
    bits = max(24, len(data).bit_length())
    low = U64((1 << bits) - 1)
    n = len(h)
    packed = np.full(-(-n // each) * each + each, ~U64(0))
    packed[:n] = (h & ~low) | np.arange(n, dtype=U64)
    rows = packed.reshape(-1, each)
    fore = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    valid = np.zeros(len(data) + 1, np.int8)
    long = sizes >= width
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - width + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    place = (np.minimum(back[start], fore[start + each - 1]) & low).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return h[place[first]], start[first], start[last]


def anchors(texts: Texts, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive strings with one anchor: the anchor's hash, first start and last start, in bytes of the block.

    A long text is taken in turns, each with the bytes that its last string needs from the next.
    """
    found = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for first, last, data, offsets in texts.chunks():
        at = int(texts.offsets[first])
        for a in range(0, len(data), CHUNK) if last == first + 1 else (0,):
            part = data[a : a + CHUNK + width - 1] if last == first + 1 else data
            key, begin, end = _anchors(part, np.array([0, len(part)]) if last == first + 1 else offsets, width, seed)
            found.append((key, begin + at + a, end + at + a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all [b, b + c), one range after the other."""
    if not len(begin):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)


def runs(starts: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first and last of each run of consecutive ascending starts (with equal values in `same`)."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] != starts[:-1] + 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(starts))[: len(first)] - 1


def repeated_strings(docs: DataFrame, width: int = 100, emit_text: bool = True) -> DataFrame:
    """Removes each byte that a string of `width` bytes covers which also starts earlier: in a document of smaller
    doc_id, or before in the same one. Strings are judged on the input; matches never cross documents.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept: the bytes left as text (bytes of a
    character that was cut through go), or with emit_text=False the lowercase hex SHA-256 of exactly the bytes left.
    Null texts are empty. Rows of one doc_id count as successive documents in order of their text. Null ids rank
    first. An empty table gives an empty one. Other columns are ignored.
    """
    S.ship(docs.sparkSession)
    size = S.text_bytes(docs)
    n, shards = S.block_count(size), S.block_count(size, block=SHARD_BYTES)
    docs = S.blocked(S.documents(docs), n)
    seed = max(1, min(24, width // 2))
    sketch = X.CountMin(size, per_byte=0.2)  # an anchor stands for some forty strings

    def count(block: int, table: pa.Table):
        return sketch.add(block, anchors(Texts(table), width, seed)[0])

    def local(docs_: pa.Table, got: pa.Table) -> pa.Table:
        block, texts = X.block_of(docs_, got), Texts(docs_)
        key, first, last = anchors(texts, width, seed)
        total = sketch.estimates(key, X.answers(got))
        likely = total >= 2
        key, first, last, total = key[likely], first[likely], last[likely], total[likely]
        sent, copies = [], []
        bytes_ = np.cumsum(last - first + 1)
        for a, b in pairwise([*(np.searchsorted(bytes_, np.arange(0, bytes_[-1], PIECE)).tolist() if len(first) else ()), len(first)]):
            copy, open_ = piece(texts, key[a:b], first[a:b], last[a:b], total[a:b])
            copies.append(copy)
            sent.append(open_)
        copies = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.uint32) for x in (zip(*copies, strict=True) if copies else ((), ()))]
        rows = [(block % shards, block, b"S" + X.packed(*copies))]
        key, begin, many = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((U64, np.int64, np.int64), zip(*sent, strict=True) if sent else ((),) * 3, strict=True))
        shard = (key >> U64(32)) % U64(shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=U64))
        ids = texts.ids[np.searchsorted(texts.offsets, begin, "right") - 1]
        for s in np.flatnonzero(np.diff(edges)).tolist():
            x = order[edges[s] : edges[s + 1]]
            rows.append((s, block, b"K" + X.pack(key[x].astype(np.uint32), ids[x], begin[x].astype(np.uint32), many[x].astype(np.uint32), texts.data[ranges(begin[x], many[x] + width - 1)])))
        return X.messages(rows)

    def piece(texts: Texts, key: np.ndarray, first: np.ndarray, last: np.ndarray, total: np.ndarray):
        """Of some runs of likely strings: copies of earlier ones among them (first, how many), and runs that others may hold too."""
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        elsewhere = (total > np.minimum(own, 255)[inverse]) | (total == 255)
        run = np.repeat(np.arange(len(first)), last - first + 1)
        start = ranges(first, last - first + 1)
        # the text of all these strings, without the gaps between
        a, b = runs(start)
        doc = np.searchsorted(texts.offsets, start[a], "right")
        begin, end = start[a], start[b] + width
        touch = np.zeros(len(begin), bool)
        touch[1:] = (begin[1:] <= end[:-1]) & (doc[1:] == doc[:-1])
        overlap = np.zeros(len(begin), np.int64)
        overlap[1:] = np.where(touch[1:], end[:-1] - begin[1:], 0)
        size = end - begin - overlap
        gathered = texts.data[ranges(begin + overlap, size)]
        shift = np.cumsum(size) - size - begin - overlap
        copy = previous_factor(gathered, start + np.repeat(shift, b - a + 1), width)[0] >= width
        a, b = runs(start[copy])
        copies = (start[copy][a], b - a + 1)
        open_ = ~copy & elsewhere[run]
        start, run = start[open_], run[open_]
        a, b = runs(start, run)
        return copies, (key[run[a]], start[a], b - a + 1)

    def across(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        sent = list(zip(table.column("block").to_pylist(), table.column("body").to_pylist(), strict=True))
        rows = [(shard, k, b) for k, b in sent if b[:1] == b"S"]
        parts = [(k, *X.unpack(b[1:], np.uint32, np.int64, np.uint32, np.uint32, np.uint8)) for k, b in sent if b[:1] == b"K"]
        if parts:
            home, ids, begin, many = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3, 4))
            data = np.concatenate([p[5] for p in parts])
            block = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
            del sent, parts
            size = many + width - 1
            at = np.cumsum(size) - size
            group = home % (1 + len(data) // SORTED)
            gone: dict[int, list] = {}
            for g in range(int(group.max()) + 1):
                x = np.flatnonzero(group == g)
                x = x[np.lexsort((begin[x], ids[x]))]
                text = data[ranges(at[x], size[x])]
                place = np.cumsum(size[x]) - size[x]
                copy = previous_factor(text, ranges(place, many[x]), width)[0] >= width
                start, source = ranges(begin[x], many[x])[copy], np.repeat(block[x], many[x])[copy]
                order = np.lexsort((start, source))
                start, source = start[order], source[order]
                a, b = runs(start, source)
                cut = [*np.flatnonzero(np.diff(source[a], prepend=-1)).tolist(), len(a)]
                for y, z in pairwise(cut):
                    gone.setdefault(int(source[a[y]]), []).append((start[a[y:z]], (b - a + 1)[y:z]))
            rows += [(shard, k, b"K" + X.packed(*(np.concatenate(v).astype(np.uint32) for v in zip(*p, strict=True)))) for k, p in gone.items()]
        return X.messages(rows)

    def remove(docs_: pa.Table, got: pa.Table) -> pa.Table:
        texts = Texts(docs_)
        d = np.zeros(len(texts.data) + 1, np.int32)
        for body in got.column("body").to_pylist():
            begin, many = (v.astype(np.int64) for v in X.unpacked(body[1:], np.uint32, np.uint32))
            np.add.at(d, begin, 1)
            np.add.at(d, begin + many - 1 + width, -1)
        gone = np.cumsum(d[:-1], dtype=np.int32) > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        edge = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        head[edge] = gone[edge]
        sums = [np.concatenate(([0], np.cumsum(v, dtype=np.int64)))[texts.offsets] for v in (gone, head)]
        keep, kept = ~gone, []
        for a, b in zip(texts.offsets.tolist(), texts.offsets[1:].tolist(), strict=False):
            left = texts.data[a:b][keep[a:b]].tobytes()
            kept.append(left.decode(errors="ignore") if emit_text else hashlib.sha256(left).hexdigest())
        cols = [texts.ids, np.diff(texts.offsets), *(np.diff(s) for s in sums)]
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    marks = X.meet(X.send(docs, count), sketch.shards, sketch.merge)
    sent = X.back(docs, marks, n, local, X.MESSAGE)
    out = X.back(docs, X.meet(sent, shards, across), n, remove, SCHEMA)
    return out.select(S.public_id(), "n_bytes", "n_removed", "n_spans", "kept")
