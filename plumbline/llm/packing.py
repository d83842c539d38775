"""Best-fit packing of tokenized documents after dominance reduction."""

from __future__ import annotations

import re
import sys
import types
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import release_memory
from plumbline.session import stage

BATCH_CHARS = 2 << 20  # text that is tokenized at once
CACHE = 450_000  # pieces whose ids a worker remembers
OWN_CHARS, OWN_CACHE = 1 << 19, 100_000  # the same for an encoder that lives for one task in workers that do other things
LATIN = 0x250  # below this code point all Unicode versions agree on letters and numbers
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4

Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, number of such sequences


def _classes() -> np.ndarray:
    import regex

    chars = [chr(c) for c in range(LATIN)]
    kinds = ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))
    return np.array([next((k for k, p in kinds if regex.match(p, c)), OTHER) for c in chars], np.uint8)


def piece_starts(chars: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE begin in Latin texts laid end to end (``firsts``: starts of non-empty texts).

    Runs of letters, numbers, other signs and white space; a plain space joins the run after it; of white space before
    a run only the last character is parted from the rest; the English contractions are pieces of their own.
    """
    n = len(chars)
    kind = classes[chars]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, bool)
    first[firsts] = first[n] = True
    start |= first[:n]
    space = kind == SPACE
    # The last of several white-space characters before another run of the same text.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    joins = last & (chars == 32)
    start |= last
    start[1:] &= ~joins[:-1]
    quote = np.flatnonzero((chars == 39) & start)
    if len(quote):
        padded = np.concatenate([chars, np.zeros(3, chars.dtype)])
        ends = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~ends[quote + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~ends[quote + 1] & ~ends[quote + 2] & (
            ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((one, 2), (two & ~one, 3)):
            start[quote[hit] + 1] = False
            after = quote[hit] + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Byte-level BPE ids of many texts at once, all given by the ``tokenizers`` file.

    Latin texts are cut into pieces with array operations, as the file's own pattern cuts them, and the library
    encodes each distinct piece once; texts with other characters or with the string of a special token go to it whole.
    Words after a space, which part from each other by themselves, go to it end to end. Pieces met again are kept
    from the last ``keep`` to twice as many.
    """

    def __init__(self, file: str, keep: int = CACHE):
        from tokenizers import Tokenizer

        self.keep = keep
        self.library = Tokenizer.from_file(file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.foreign = re.compile(f"[^\\0-{chr(LATIN - 1)}]").search
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A byte is one character of a token's text, so the bytes of ids tell which piece they belong to.
        size = self.library.get_vocab_size()
        self.bytes = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)

    @staticmethod
    def of_worker(file: str) -> Encoder:
        """The encoder of this Python process, which later tasks find with the pieces it knows."""
        held = sys.modules.setdefault("plumbline_worker", types.ModuleType("plumbline_worker")).__dict__
        if held.get("file") != file:
            held["file"], held["encoder"] = file, Encoder(file)
        return held["encoder"]

    def _learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        if words:
            ids = np.array(self.library.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(w.encode()) for w in words])
            self._keep(words, ids, np.append(0, np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1))
        rest = [p for p in pieces if p not in self.cache] if len(words) < len(pieces) else []
        if rest:
            found = self.library.encode_batch([rest], is_pretokenized=True, add_special_tokens=False)[0]
            self._keep(rest, np.array(found.ids, np.uint32), np.searchsorted(found.word_ids, np.arange(len(rest) + 1)))

    def _keep(self, pieces: list[str], ids: np.ndarray, cuts: np.ndarray) -> None:
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        for p, a, b in zip(pieces, cuts, cuts[1:]):
            self.cache[p] = raw[a:b]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as u32 in bytes, which take a quarter of the room of lists."""
        if len(self.cache) >= self.keep:
            self.older, self.cache = self.cache, {}
        cache, older, new = self.cache, self.older, []
        for p in pieces:
            if p not in cache:
                if p in older:
                    cache[p] = older[p]
                else:
                    new.append(p)
        if new:
            self._learn(new)
        return [cache[p] for p in pieces]

    def latin(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = piece_starts(chars, np.unique(begins[sizes > 0]), self.classes)
        raw = joined.encode()
        wide = np.concatenate([[0], np.cumsum(chars >= 128)])  # characters of two bytes so far
        offsets = np.append(at + wide[at], len(raw)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        codes = pieces.indices.to_numpy()
        ids = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        base = np.cumsum(length) - length
        per = length[codes]
        upto = np.cumsum(per)
        out = flat[np.repeat(base[codes] - (upto - per), per) + np.arange(int(upto[-1]))]
        cuts = np.concatenate([[0], upto])[np.searchsorted(at, np.append(begins, len(chars)))]
        return [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if (t.isascii() or not self.foreign(t)) and not any(s in t for s in self.special)]
        for i, ids in zip(plain, self.latin([texts[i] for i in plain])):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        return out


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth dominance on a histogram of lengths: fixed sequences, and what is left.

    For each length, longest first, a set that holds it is fixed as often as counts allow when it dominates every other
    feasible set with it (removing documents only makes each of these tests easier to meet): the document alone if nothing fits beside it; with the one that fills the sequence; with the
    longest that fits if no two others fit, or if that is at least as long as any two that fit together; with the two
    longest that fit one after the other if at most two fit and no fitting pair has a longer second.
    """
    left, fixed = {s: n for s, n in counts.items() if n}, []
    sizes = sorted(left)

    def take(pattern: tuple[int, ...], times: int) -> None:
        fixed.append((pattern, times))
        for s in pattern:
            left[s] -= times
        for s in {*pattern}:
            if not left[s]:
                del left[s]
                sizes.remove(s)

    def smallest(n: int, without: int) -> int | None:
        """Total of the ``n`` smallest documents besides one of length ``without``."""
        total = 0
        for s in sizes:
            have = min(n, left[s] - (s == without))
            total, n = total + s * have, n - have
            if not n:
                return total
        return None

    def fitting(room: int, *used: int) -> int | None:
        """The longest document of at most ``room`` besides those used."""
        for i in range(bisect_right(sizes, room) - 1, -1, -1):
            if left[sizes[i]] > used.count(sizes[i]):
                return sizes[i]
        return None

    def best_pair(room: int, without: int) -> int:
        spare = [s for s in sizes for _ in range(min(2, left[s] - (s == without)))]
        best, low, high = 0, 0, len(spare) - 1
        while low < high:
            both = spare[low] + spare[high]
            if both > room:
                high -= 1
            else:
                best, low = max(best, both), low + 1
        return best

    def most(pattern: tuple[int, ...]) -> int:
        return min(left[s] // pattern.count(s) for s in pattern)

    for size in sorted(left, reverse=True):
        room = capacity - size
        while left.get(size):
            one = smallest(1, size)
            if one is None or one > room:
                take((size,), left[size])
                continue
            mate = fitting(room, size)
            two, three = smallest(2, size), smallest(3, size)
            if mate == room or two is None or two > room:
                take((size, mate), most((size, mate)))
                continue
            if three is None or three > room:
                if mate >= best_pair(room, size):
                    take((size, mate), most((size, mate)))
                    continue
                second = fitting(room - mate, size, mate)
                if second is not None:
                    longer = [s for s in sizes[bisect_right(sizes, second):] for _ in range(min(2, left[s] - (s == size)))][:2]
                    if len(longer) < 2 or sum(longer) > room:
                        take((size, mate, second), most((size, mate, second)))
                        continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, of a histogram: equal sequences are kept as one pattern with a number."""
    open_: dict[int, list[list]] = {}  # room -> [pattern, number]
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], number: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, number])

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                if n >= per:
                    put((size,) * per, n // per)
                if n % per:
                    put((size,) * (n % per), 1)
                break
            group = open_[rooms[i]][-1]
            times = min(n, group[1])
            group[1] -= times
            if not group[1]:
                open_[rooms[i]].pop()
                if not open_[rooms[i]]:
                    del open_[rooms[i]], rooms[i]
            put(group[0] + (size,), times)
            n -= times
    return [(p, n) for groups in open_.values() for p, n in groups]


def plan_sequences(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _placement(plan: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and the first sequence and the offset of the documents from there on."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, number in plan:
        offset = 0
        for size in pattern:
            rank = used.get(size, 0)
            rows.append(((size << 44) + rank, sequence, offset))
            used[size] = rank + number
            offset += size
        sequence += number
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def tokenize(docs: DataFrame, id: str, text: str, file: str, capacity: int, end: int, keep_ids: bool, share: bool) -> DataFrame:
    """The pieces of all documents, numbered within their task and length."""
    id_type = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.of_worker(file) if share else Encoder(file, OWN_CACHE), TaskContext.get().partitionId()
        at_once = BATCH_CHARS if share else OWN_CHARS
        seen = np.zeros(capacity + 1, np.int64)

        def pieces(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            rows, index = [], []
            for i, tokens in enumerate(encoder.encode(texts)):
                tokens = np.append(tokens, np.uint32(end)).astype("<u4")
                head = len(tokens) % capacity
                cuts = ([0] if head else []) + list(range(head, len(tokens), capacity))
                for n, (a, b) in enumerate(zip(cuts, cuts[1:] + [len(tokens)])):
                    part = tokens[a:b]
                    index.append(i)
                    rows.append((n, a, b - a, zlib.crc32(part.tobytes()), part.astype(np.int64) if keep_ids else None))
            size = np.array([r[2] for r in rows], np.int64)
            order = np.argsort(size, kind="stable")
            first = np.searchsorted(size[order], size[order], "left")
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first
            rank += seen[size]
            seen[:] += np.bincount(size, minlength=capacity + 1)
            columns = [
                ids.take(pa.array(index, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array(size), pa.array([r[3] for r in rows], pa.int64()), pa.array(np.full(len(rows), shard, np.int32)), pa.array(rank),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32", "shard", "rank"]
            if keep_ids:
                columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= at_once or i == len(texts) - 1:
                    yield pieces(ids.slice(begin, i + 1 - begin), texts[begin:i + 1])
                    begin, size = i + 1, 0
        if not share:
            encoder = None
            release_memory()

    shape = f"id {id_type}, piece int, start long, length long, ids_crc32 long, shard int, rank long"
    return docs.select(id, text).mapInArrow(run, shape + (", ids array<long>" if keep_ids else ""))


def pack_documents(
    docs: DataFrame, file: str, id: str = "doc_id", text: str = "text",
    capacity: int = 2048, end: int = 0, keep_ids: bool = False, share: bool = True,
) -> DataFrame:
    """All documents in few sequences of at most ``capacity`` tokens: a row per piece, with ``ids`` if asked for.

    A document is its ids and ``end``; longer ones are cut into pieces of ``capacity``, the first of which may be
    shorter. Packing depends on the lengths only, so the driver sees a histogram of at most ``capacity`` rows, whatever
    the corpus: dominance reduction fixes sets of lengths, best fit packs the rest, and both yield patterns with
    multiplicities. A piece finds its sequence by its rank among equal lengths: a number within its task plus the
    counts of the tasks before, which no single task has to sort. The table of patterns that is broadcast has a bounded
    number of rows, as each step of the two algorithms adds one and steps are bounded by the lengths.

    With ``share`` a Python worker keeps the pieces it has learnt for later tasks, some 100 MB as long as it lives;
    without, each task learns its own, fewer and from smaller batches, and gives the room back when it ends, for jobs that
    do other things in the same workers: Spark keeps idle ones, more than there are cores.

    Defined cases: null is an empty text, a document of ``end`` alone; rows are documents, also if ids repeat or are
    null; which of equal lengths goes where is arbitrary; an empty table gives no rows. Only id and text are read.
    """
    spark = docs.sparkSession
    pieces = stage(tokenize(docs, id, text, file, capacity, end, keep_ids, share), "pieces")
    counts = stage(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(_placement(plan_sequences(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["shard", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, places = table.value
        for b in batches:
            key = (b.column("length").to_numpy() << 44) + b.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            names = [n for n in b.schema.names if n not in ("rank", "shard", "before")]
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [pa.array(sequences[at] + key - keys[at]), pa.array(places[at])],
                names=names + ["sequence_id", "offset"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name not in ("rank", "shard", "before")]
    out = ranked.mapInArrow(place, ", ".join(kept) + ", sequence_id long, offset long")
    order = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if keep_ids else [])
    return out.select(F.col("id").alias(id), *order[1:])
