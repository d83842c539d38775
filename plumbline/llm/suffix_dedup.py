"""Removal of long repeated byte strings, decided by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import MAX_BITS, map_rows, may_have, pack, seen_filter, unpack
from plumbline.llm.suffixes import repeated_starts
from plumbline.session import stage

CHUNK = 1 << 20  # bytes that are anchored at once; longer texts overlap from chunk to chunk
SHARD = 1 << 20  # bytes per suffix array
CROWD = 1024  # different segments of one anchor that a shard takes
REMEMBERED = 200_000  # segments that a task has sent and does not send again
POSITION = 24  # low bits of an order key that hold the position in a chunk

TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Hashes of all ``gram``-byte strings of a chunk: differences of one running polynomial sum modulo 2^64."""

    def __init__(self, gram: int, longest: int):
        self.gram = gram
        self.up = _powers(int(BASE), longest)
        self.down = _powers(pow(int(BASE), -1, 1 << 64), longest)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * self.up[:len(data)], out=total[1:])
        h = (total[self.gram:] - total[:-self.gram]) * self.down[:len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive values: running minima from both ends of blocks of ``w``."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def segments(texts: list[bytes], length: int, anchors: Anchors, chunk: int = CHUNK) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The segments of texts, chunk by chunk: (buffer, text number, start in the text, end in the text, anchor hash, place in buffer).

    Every ``length``-byte string belongs to the least hash of its shorter strings (the first of equal ones). A
    segment is the span of consecutive strings of one anchor, so equal strings lie in segments with equal anchors.
    """
    w = length - anchors.gram + 1
    pieces: list[tuple[int, int, bytes]] = []

    def cut():
        for i, t in enumerate(texts):
            for begin in range(0, max(1, len(t) - length + 1), chunk):
                part = t[begin:begin + chunk + length - 1]
                if len(part) >= length:
                    yield i, begin, part

    def work(pieces):
        raw = b"".join(p for _, _, p in pieces)
        data = np.frombuffer(raw, np.uint8)
        size = np.array([len(p) for _, _, p in pieces], np.int64)
        first = np.cumsum(size) - size
        h = anchors.hashes(data)
        key = (h >> np.uint64(POSITION) << np.uint64(POSITION)) | np.arange(len(h), dtype=np.uint64)
        at = (_window_min(key, w) & np.uint64((1 << POSITION) - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), size)[:len(at)]
        valid = np.arange(len(at)) <= (first + size - length)[owner]
        fresh = valid.copy()
        fresh[1:] &= (at[1:] != at[:-1]) | ~valid[:-1] | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(fresh)
        stop = np.ones(len(at) + 1, bool)
        stop[:-1] = fresh | ~valid
        stops = np.flatnonzero(stop)
        end = stops[np.searchsorted(stops, begin, "right")]
        which = owner[begin]
        text = np.array([i for i, _, _ in pieces], np.int64)[which]
        base = (np.array([b for _, b, _ in pieces], np.int64) - first)[which]
        return raw, text, begin + base, end - begin, h[at[begin]].view(np.int64), begin

    total = 0
    for piece in cut():
        pieces.append(piece)
        total += len(piece[2])
        if total >= chunk:
            yield work(pieces)
            pieces, total = [], 0
    if pieces:
        yield work(pieces)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slices(raw: bytes, begin: np.ndarray, strings: np.ndarray, length: int) -> list[bytes]:
    return [raw[a:a + n + length - 1] for a, n in zip(begin.tolist(), strings.tolist())]


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """``(id, hash, start, strings, anchor, body)``: every segment of every text by the hashes of its anchor and its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length // 3, 2 * CHUNK + length)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for raw, text, start, strings, anchor, begin in segments(texts, length, anchors):
                index = pa.array(text)
                body = [_signed(xxhash.xxh3_64_intdigest(x)) for x in _slices(raw, begin, strings, length)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(index), batch.column("hash").take(index), pa.array(start), pa.array(strings.astype(np.int32)),
                     pa.array(anchor), pa.array(body, pa.int64())], names=["id", "hash", "start", "strings", "anchor", "body"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, hash long, start long, strings int, anchor long, body long")


def _bodies(docs: DataFrame, length: int, shared: np.ndarray, crowded: np.ndarray) -> DataFrame:
    """``(anchor, body, crowd, bytes)``: segments whose anchor has other segments too, each once per task."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((shared, crowded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, crowded = sent.value
        anchors, seen = Anchors(length // 3, 2 * CHUNK + length), set()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for raw, _, _, strings, anchor, begin in segments(texts, length, anchors):
                chosen = np.flatnonzero(may_have(shared, anchor.view(np.uint64)))
                crowd = may_have(crowded, anchor[chosen].view(np.uint64))
                rows = []
                for a, c, x in zip(anchor[chosen].tolist(), crowd.tolist(), _slices(raw, begin[chosen], strings[chosen], length)):
                    body = _signed(xxhash.xxh3_64_intdigest(x))
                    if (a, body) not in seen:
                        seen.add((a, body))
                        rows.append((a, body, c, x))
                if len(seen) > REMEMBERED:
                    seen.clear()
                columns = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["anchor", "body", "crowd", "bytes"])

    return docs.mapInArrow(run, "anchor long, body long, crowd boolean, bytes binary")


def _runs(flags: np.ndarray) -> list[int]:
    """Maximal runs of true values as start, end, start, end, ..."""
    edge = np.zeros(len(flags) + 2, bool)
    edge[1:-1] = flags
    return np.flatnonzero(edge[1:] != edge[:-1]).tolist()


def _shards(bodies: DataFrame, length: int, shard: int) -> DataFrame:
    """``(anchor, body, runs)``: repeated strings of segments, from one suffix array per shard of whole anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def decide() -> pa.RecordBatch:
            flags = repeated_starts([x for _, _, x in held], length)
            rows = [(a, b, _runs(f)) for (a, b, _), f in zip(held, flags) if f.any()]
            columns = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["anchor", "body", "runs"])

        for batch in batches:
            for a, b, x in zip(*(batch.column(n).to_pylist() for n in ("anchor", "body", "bytes"))):
                if (a, b) == last:
                    continue
                if size >= shard and a != last[0]:
                    yield decide()
                    held, size = [], 0
                held.append((a, b, x))
                size += len(x)
                last = (a, b)
        if held:
            yield decide()

    ordered = bodies.repartition("anchor").sortWithinPartitions("anchor", "body")
    return ordered.mapInArrow(run, "anchor long, body long, runs array<int>")


def _crowds(bodies: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors, whose segments exceed a shard: strings are counted by their 128-bit hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in zip(*(batch.column(n).to_pylist() for n in ("anchor", "body", "bytes"))):
                n = len(x) - length + 1
                w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[i:i + length]) for i in range(n)), "<i8").reshape(n, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, a)), pa.array(np.full(n, b)), pa.array(np.arange(n, dtype=np.int32)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())],
                    names=["anchor", "body", "at", "w0", "w1"])

    def spans(batch: pa.RecordBatch) -> dict:
        out = []
        for at in batch.column("ats").to_pylist():
            flags = np.zeros(max(at) + 1, bool)
            flags[at] = True
            out.append(_runs(flags))
        return {"runs": pa.array(out, pa.list_(pa.int32()))}

    strings = stage(bodies.dropDuplicates(["anchor", "body"]).mapInArrow(run, "anchor long, body long, at int, w0 long, w1 long"), "strings")
    twice = strings.groupBy("w0", "w1").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = strings.join(twice, ["w0", "w1"]).groupBy("anchor", "body").agg(F.collect_list("at").alias("ats"))
    return map_rows(found, "runs array<int>", spans, drop=("ats",))


def drop_repeated_strings(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 400, shard: int = SHARD, crowd: int = CROWD, max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with ``kept`` (binary, what is left of the UTF-8 bytes), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A byte goes if any ``length``-byte string over it starts anywhere else too, in another text or the same one.
    Strings do not cross texts and are judged on the input.

    Equal strings must meet, so each is assigned to an anchor, the least hash of its strings of a third of the length; consecutive
    strings of one anchor form a segment. Segments are counted by hashes alone: equal ones repeat as a whole, and an
    anchor with one segment repeats nothing else. Only segments that share an anchor with different ones travel as
    bytes, once per task and found by a Bloom filter of bounded size; whole anchors are dealt out to shards, and a
    suffix array of each shard (induced sorting) with its permuted longest common prefixes tells which strings
    repeat. An anchor with more than ``crowd`` different segments would exceed a shard: its strings are counted one by one
    with partial aggregation instead, which is as exact. Texts are shuffled once, to meet their results.

    Defined cases: null is an empty text; texts under ``length`` bytes stay whole; repeated rows repeat each other;
    rows with equal ids are told apart by their text; null ids work like others; an empty table gives no rows; existing
    columns named like an added one are replaced.
    """
    if length < 3:
        raise ValueError("strings must have at least 3 bytes")
    added = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in docs.columns if c not in added]
    text_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    narrow = docs.select(F.col(id).alias("id"), text_hash.alias("hash"), F.col(text).alias("text"))
    occurrences = stage(_occurrences(narrow, length), "segments")

    bodies = occurrences.groupBy("anchor", "body").agg(F.count("*").alias("n"))
    kinds = bodies.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    known = stage(bodies.join(kinds, "anchor").select("anchor", "body", "kinds", (F.col("n") > 1).alias("whole")), "known")
    counts = known.agg(F.count_if(F.col("kinds") > 1), F.count_if(F.col("kinds") > crowd)).first()
    hashes = lambda b: b.column(0).to_numpy().view(np.uint64)
    filters = [seen_filter(known.where(F.col("kinds") > k).select("anchor").distinct(), hashes, n, max_bits) for k, n in zip((1, crowd), counts)]

    sent = stage(_bodies(narrow.select("text"), length, *filters), "bodies")
    found = _shards(sent.where("not crowd"), length, shard).unionByName(_crowds(sent.where("crowd"), length))
    # Staged, so that both sides of the join are shuffled for it alone and a segment of very many copies can be split.
    result = stage(known.join(stage(found, "repeats"), ["anchor", "body"], "left").where("whole or runs is not null"), "results")
    hit = occurrences.join(result, ["anchor", "body"])
    pairs = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("a"), F.col("strings").alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(F.get("runs", i).alias("a"), F.get("runs", i + 1).alias("b"))))
    spans = (hit.select(F.col("id").alias("__id"), F.col("hash").alias("__of"), "start", F.explode(pairs).alias("p"))
             .select("__id", "__of", F.struct((F.col("start") + F.col("p.a")).alias("a"), (F.col("start") + F.col("p.b") + (length - 1)).alias("b")).alias("span"))
             .groupBy("__id", "__of").agg(F.collect_set("span").alias("__spans")))

    packed = pack(docs.select(*[F.col(f"`{c}`") for c in names]), id, text).withColumn("__hash", text_hash)
    joined = packed.join(spans, (packed["__hash"] == spans["__of"]) & packed[id].eqNullSafe(spans["__id"]), "left").drop("__id", "__of", "__hash")

    def cut(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in added}
        for t, spans in zip(batch.column(text).to_pylist(), batch.column("__spans")):
            data = (t or "").encode()
            kept, runs, at = [], 0, 0
            spans = sorted((s["a"], s["b"]) for s in spans.as_py() or [])
            end = -1
            for a, b in spans:
                if a > end:
                    kept.append(data[at:a])
                    runs += 1
                end = max(end, b)
                at = end
            kept.append(data[at:])
            left = b"".join(kept)
            for k, v in zip(added, (left, len(data), len(data) - len(left), runs)):
                out[k].append(v)
        return {k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()}

    done = map_rows(joined, "kept binary, n_bytes long, n_removed long, n_spans long", cut, drop=("__spans",))
    return unpack(done, names, *added)


def sha256(batch: pa.RecordBatch) -> dict:
    return {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()], pa.string())}
