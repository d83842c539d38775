"""Benchmark decontamination: suffix arrays of training shards, searched by every test suffix."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SHARD_BYTES = 16 << 20  # text per suffix array
BLOCK_BYTES = 32 << 20  # benchmark text per broadcast; a larger benchmark is searched in several blocks
EXPAND = 4_000_000  # matched positions listed at once

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case, and where their words begin and end."""
    low = np.frombuffer(data.lower(), np.uint8)
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = WORD_BYTES[low]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return low, edges[::2], edges[1::2]


def words(text: str | None) -> list[bytes]:
    low, starts, ends = word_bounds((text or "").encode())
    data = low.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


class TestSet:
    """A bounded block of benchmark items: word numbers, one zero after each item."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        split = [(i, words(t)) for i, t in items]
        split = [(i, w) for i, w in split if i is not None and w]
        self.names = [str(i) for i, _ in split]
        self.vocabulary = sorted({x for _, w in split for x in w})
        number = {w: n + 1 for n, w in enumerate(self.vocabulary)}
        text, item, left, span = [], [], [], []
        for n, (_, w) in enumerate(split):
            text += [number[x] for x in w] + [0]
            item += [n] * (len(w) + 1)
            left += range(len(w), -1, -1)
            span += [min(window, len(w))] * (len(w) + 1)
        self.text, self.item = np.array(text, np.int32), np.array(item, np.int64)
        self.left, self.span = np.array(left, np.int64), np.array(span, np.int64)
        self.shortest = int(self.span.min()) if len(self.span) else 0


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of the non-zero positions in order; a suffix ends before the next zero (``left`` words on).

    Ranks by prefix doubling: each round sorts by the ranks of two halves; suffixes that are equal to their ends tie.
    """
    at = np.flatnonzero(text)
    rank = text.astype(np.int64)
    step, longest = 1, int(left.max(initial=0))
    order = at[np.argsort(rank[at], kind="stable")]
    while step < longest:
        second = np.zeros(len(at), np.int64)
        far = left[at] > step
        second[far] = rank[at[far] + step]
        key = rank[at] << np.int64(32) | second
        place = np.argsort(key, kind="stable")
        order, key = at[place], key[place]
        fresh = np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)]) if len(key) else np.zeros(0, np.int64)
        rank[order] = np.cumsum(fresh)
        if int(fresh.sum()) == len(order):
            break
        step *= 2
    return order


def _bound(column: np.ndarray, sa: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Binary search in each interval of the array for the first suffix whose word ``k`` is at least ``value``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        less = np.zeros(len(low), bool)
        less[open_] = column[sa[mid[open_]] + k] < value[open_]
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the intervals, and the number of the interval of each."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner], owner


def search(column: np.ndarray, sa: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every test suffix against one suffix array.

    Returns the length of the longest match of each suffix in the array (zero below a window), and, for each test
    position whose window occurs, that position with the interval of the array that holds all its occurrences.
    """
    at = np.flatnonzero(test.text)
    depth = np.zeros(len(sa), np.int64)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    k = 0
    while len(at):
        value = test.text[at + k].astype(np.int64)
        low = _bound(column, sa, k, low, high, value)
        high = _bound(column, sa, k, low, high, value + 1)
        alive = low < high
        at, low, high = at[alive], low[alive], high[alive]
        k += 1
        full = test.span[at] == k
        found.append((at[full], low[full], high[full]))
        # Equal prefixes have equal intervals and others are disjoint; deeper ones lie inside, so they overwrite.
        here, one = np.unique(low[test.span[at] <= k], return_index=True)
        depth[_ranges(here, high[test.span[at] <= k][one])[0]] = k
        more = test.left[at] > k
        at, low, high = at[more], low[more], high[more]
    starts, lows, highs = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return depth, starts, lows, highs


def match_shard(texts: list[bytes], test: TestSet) -> list[dict]:
    """Per text: words, merged hit spans (in words), numbers of the items whose windows occur, longest match and its start."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    low, starts, ends = word_bounds(b"\0".join(texts))
    doc = np.searchsorted(np.cumsum(sizes), starts, "right")
    counts = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(counts) - counts
    out = [{"n_words": int(n), "spans": [], "items": [], "longest": 0, "longest_at": None} for n in counts]
    if not len(starts) or not test.names:
        return out
    offsets = np.empty(2 * len(starts), np.int64)
    offsets[::2], offsets[1::2] = starts, ends
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low)])
    known = pc.index_in(pieces, value_set=pa.array(test.vocabulary, pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False)[::2].astype(np.int64) + 1

    # Runs of benchmark words within a document; shorter ones than the shortest window cannot hold any.
    breaks = np.flatnonzero((known == 0) | np.concatenate([[False], doc[1:] != doc[:-1]]))
    run_start = np.unique(np.concatenate([[0], breaks, breaks[known[breaks] == 0] + 1]))
    run_start = run_start[run_start < len(known)]
    run_end = np.append(run_start[1:], len(known))
    good = (known[run_start] > 0) & (run_end - run_start >= test.shortest)
    run_start, run_end = run_start[good], run_end[good]
    if not len(run_start):
        return out
    word, run = _ranges(run_start, run_end)
    spot = np.arange(len(word)) + run  # one zero after each run
    column = np.zeros(len(word) + len(run_start) + int(test.left.max()) + 1, np.int64)
    column[spot] = known[word]
    left = np.zeros(len(column), np.int64)
    left[spot] = run_end[run] - word
    source = np.zeros(len(column), np.int64)
    source[spot] = word
    sa = suffix_array(column, left)
    depth, at, lo, hi = search(column, sa, test)

    deep = np.flatnonzero(depth)
    spot = source[sa[deep]]
    order = np.lexsort([spot, -depth[deep], doc[spot]])
    for d, i in zip(*np.unique(doc[spot][order], return_index=True)):
        out[d]["longest"], out[d]["longest_at"] = int(depth[deep][order][i]), int(spot[order][i] - first[d])

    # Equal windows share an interval: list its positions once, then its items.
    key, inverse = np.unique(np.column_stack([lo, test.span[at]]), axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    top = np.zeros(len(key), np.int64)
    top[inverse] = hi
    window_item = np.unique(np.column_stack([inverse, test.item[at]]), axis=0)
    cover = np.zeros(len(known) + 1, np.int64)
    pairs = [np.zeros((0, 2), np.int64)]
    begin = 0
    sizes = top - key[:, 0] if len(key) else np.zeros(0, np.int64)
    while begin < len(key):
        stop = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:]), EXPAND, "right")))
        rows, owner = _ranges(key[begin:stop, 0], top[begin:stop])
        pos = source[sa[rows]]
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + key[begin:stop, 1][owner], -1)
        held = np.unique(np.column_stack([owner + begin, doc[pos]]), axis=0)
        a, b = np.searchsorted(window_item[:, 0], held[:, 0], "left"), np.searchsorted(window_item[:, 0], held[:, 0], "right")
        which, who = _ranges(a, b)
        pairs = [np.unique(np.concatenate([*pairs, np.column_stack([held[who, 1], window_item[which, 1]])]), axis=0)]
        begin = stop
    hit = np.cumsum(cover)[:-1] > 0
    for d, i in pairs[0].tolist():
        out[d]["items"].append(i)
    for d in np.unique(doc[hit]).tolist():
        own = np.concatenate([[False], hit[first[d]:first[d] + counts[d]], [False]])
        out[d]["spans"] = np.flatnonzero(own[1:] != own[:-1]).tolist()
    return out


def _joined(a: list[int], b: list[int]) -> list[int]:
    """The union of two sorted lists of spans, each laid out as start, end, start, end."""
    if not a or not b:
        return a or b
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks(benchmark: DataFrame, id: str, text: str, window: int, block_bytes: int) -> Iterator[TestSet]:
    """The benchmark in blocks of bounded size, in order of arrival; at least one."""
    held, size, any_ = [], 0, False
    for row in benchmark.select(id, text).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "") + 16
        if size >= block_bytes:
            yield TestSet(held, window)
            held, size, any_ = [], 0, True
    if held or not any_:
        yield TestSet(held, window)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with verbatim benchmark matches: ``n_words``, ``spans``, ``items``, ``longest``, ``longest_at``.

    Words are runs of bytes other than ASCII non-alphanumerics, A-Z in lower case. Each task cuts its documents into
    shards of bounded text, builds a suffix array over the words of each (restricted to runs of benchmark words that
    are long enough to hold a window, as no other suffix can match one) and binary-searches every test suffix in it.
    A window is ``window`` consecutive words of an item, or a shorter item as a whole. ``spans`` are the word
    positions covered by occurrences (start, end, start, end, ...), ``items`` the ids of the items as strings in
    order, ``longest`` and ``longest_at`` the longest match of a test suffix (at least a window) and its first place.

    No shuffle. The benchmark is sent in blocks of at most ``block_bytes`` of text, one pass over the rows each, whose
    results are merged row by row. Intervals of the array are shared by equal windows and listed in bounded pieces, so
    a passage in very many documents costs its occurrences once.

    Defined cases: null has no words; items without words or id are ignored, rows with one id are one item; an empty
    benchmark gives no matches; equal rows give equal results; existing columns of these names are replaced.
    """
    added = "n_words long, spans array<int>, items array<string>, longest int, longest_at int"
    new = T._parse_datatype_string(added)
    arrow = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.int32()]
    spark, frame = docs.sparkSession, docs
    for number, test in enumerate(blocks(benchmark, item_id, item_text, window, block_bytes)):
        sent, names = spark.sparkContext.broadcast(SimpleNamespace(**vars(test))), new.fieldNames()
        kept = [f for f in frame.schema.fields if f.name not in names]
        merge = number > 0

        def run(batches: Iterator[pa.RecordBatch], sent=sent, kept=kept, merge=merge) -> Iterator[pa.RecordBatch]:
            test = sent.value

            def done(batch: pa.RecordBatch, encoded: list[bytes]) -> pa.RecordBatch:
                found = match_shard(encoded, test)
                for f in found:
                    f["items"] = sorted({test.names[i] for i in f["items"]})
                if merge:
                    for f, (n, spans, items, longest, at) in zip(found, zip(*(batch.column(c).to_pylist() for c in names))):
                        f["spans"], f["items"] = _joined(spans, f["spans"]), sorted({*items, *f["items"]})
                        if longest >= f["longest"]:
                            f["longest"], f["longest_at"] = longest, at
                made = [pa.array([f[c] for f in found], t) for c, t in zip(names, arrow)]
                return pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, names=[f.name for f in kept] + names)

            for batch in batches:
                encoded = [(t or "").encode() for t in batch.column(text).to_pylist()]
                begin, size = 0, 0
                for i, t in enumerate(encoded):
                    size += len(t)
                    if size >= shard_bytes or i == len(encoded) - 1:
                        yield done(batch.slice(begin, i + 1 - begin), encoded[begin:i + 1])
                        begin, size = i + 1, 0

        frame = frame.mapInArrow(run, T.StructType(kept + new.fields))
    return frame
