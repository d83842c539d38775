"""Token ids in directly addressable codes: chunk levels with continuation bitmaps and rank directories.

A file holds the ids of consecutive documents. An id is cut into chunks, lowest bits first. Level 0 has the first chunk
of every id; a bit beside each chunk tells whether the id goes on in the next level, which holds chunks of those ids
only. The place of an id in the next level is the number of set bits before its own (its rank), and a directory of
counts per block of bits gives that number without reading the bits before the block. So any id is found by a few
reads of fixed size, whatever its place, and no block is ever decoded.

File, little-endian: ``MAGIC``; u32 levels, u32 with ids, u64 tokens, u64 documents; the chunk widths as u32; doc ids
as i64; a byte per document, 1 where its id is null; ends of the documents as u64, counted from the file's first
token; then per level the chunks, packed, and, but for the last, the bitmap and the directory, each in u64 words.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import open_uri
from plumbline.llm.packing import BATCH_CHARS, Encoder
from plumbline.session import stage

MAGIC = b"tokdac\x00\x01"
HEAD = "<8sIIQQ"
BLOCK = 8  # words of a bitmap per count of the directory
FILE_TOKENS = 1 << 22  # a file is closed once it holds so many
PIECE = 1 << 20  # tokens that are cut at once


def widths_for(ids: np.ndarray) -> list[int]:
    """Chunk widths that take the fewest bits for ``ids``, by dynamic programming over their bit lengths."""
    bits = np.frexp(ids.astype(np.float64))[1]
    longer = len(ids) - np.cumsum(np.bincount(bits, minlength=33))  # ids of more than b bits
    top = max(1, int(bits.max(initial=0)))
    beside = 1 + 1 / BLOCK  # bitmap and directory, per chunk
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for b in range(1, top + 1):
        best.append(min(
            (best[a][0] + float(longer[a] if a else len(ids)) * (b - a + (beside if b < top else 0)), best[a][1] + [b - a])
            for a in range(b)))
    return best[top][1]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each, end to end in u64 words: 64 values fill ``width`` words."""
    groups = -(-len(values) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[:len(values)] = values
    rows = np.ascontiguousarray(padded.reshape(groups, 64).T)
    words = np.zeros((width, groups), np.uint64)
    for i in range(64):
        word, off = divmod(i * width, 64)
        words[word] |= rows[i] << np.uint64(off)
        if off + width > 64:
            words[word + 1] |= rows[i] >> np.uint64(64 - off)
    return np.ascontiguousarray(words.T).ravel()


def unpack_bits(words: np.ndarray, width: int, first: int, count: int) -> np.ndarray:
    """``count`` values from value ``first`` on: only the groups of 64 that hold them are read."""
    begin, end = first // 64, -(-(first + count) // 64)
    rows = np.ascontiguousarray(words[begin * width:end * width].reshape(-1, width).T)
    out = np.empty((64, rows.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, off = divmod(i * width, 64)
        v = rows[word] >> np.uint64(off)
        if off + width > 64:
            v = v | (rows[word + 1] << np.uint64(64 - off))
        out[i] = v & mask
    return np.ascontiguousarray(out.T).ravel()[first - begin * 64:first - begin * 64 + count]


def _bitmap(more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in words and, per block of words, the set bits before it."""
    raw = np.packbits(more, bitorder="little")
    words = np.zeros((-(-len(raw) // (8 * BLOCK)) or 1) * BLOCK, np.uint64)
    words.view(np.uint8)[:len(raw)] = raw
    per = np.bitwise_count(words).astype(np.uint64).reshape(-1, BLOCK).sum(axis=1)
    return words, (np.cumsum(per) - per).astype(np.uint64)


def encode_file(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """The file of some consecutive documents; the widths are the best for their ids."""
    ids = np.concatenate([np.zeros(0, np.uint32), *documents]).astype(np.uint32)
    widths = widths_for(ids)
    ends = np.cumsum([len(d) for d in documents], dtype=np.uint64) if documents else np.zeros(0, np.uint64)
    out = [
        struct.pack(HEAD, MAGIC, len(widths), 0, len(ids), len(documents)), np.array(widths, "<u4").tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is None for i in doc_ids], np.uint8).tobytes(), ends.tobytes(),
    ]
    rest = ids
    for level, width in enumerate(widths):
        last = level == len(widths) - 1
        chunks = [pack_bits(rest[i:i + PIECE] & np.uint32((1 << width) - 1), width) for i in range(0, len(rest), PIECE)]
        out += [c.tobytes() for c in chunks]
        if not last:
            rest = rest >> np.uint32(width)
            more = rest != 0
            out += [part.tobytes() for part in _bitmap(more)]
            rest = rest[more]
    return b"".join(out)


class TokenFile:
    """Random access to a file of documents; ``read(offset, size)`` gives bytes of it."""

    def __init__(self, read):
        self.read = read
        magic, levels, _, self.n_tokens, self.n_docs = struct.unpack(HEAD, read(0, struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError("not a file of token codes")
        at = struct.calcsize(HEAD)
        self.widths = np.frombuffer(read(at, 4 * levels), "<u4").tolist()
        at += 4 * levels
        self._docs = at
        at += 17 * self.n_docs
        self.levels, count = [], self.n_tokens
        for i, width in enumerate(self.widths):
            bits = at + 8 * width * (-(-count // 64))
            words = (-(-count // (64 * BLOCK)) or 1) * BLOCK
            ranks = bits + 8 * words
            self.levels.append((at, bits, ranks, count))
            if i < levels - 1:
                at = ranks + 8 * (words // BLOCK)
                count = self._rank(i, count)

    def _words(self, at: int, first: int, count: int) -> np.ndarray:
        return np.frombuffer(self.read(at + 8 * first, 8 * count), "<u8")

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i`` of a level: one count of the directory and at most one block of bits."""
        _, bits, ranks, count = self.levels[level]
        if not count:
            return 0
        block = min(i, count - 1) // (64 * BLOCK)
        before = int(self._words(ranks, block, 1)[0])
        inside = i - block * 64 * BLOCK
        words = self._words(bits, block * BLOCK, BLOCK)
        whole = inside // 64
        n = before + int(np.bitwise_count(words[:whole]).sum())
        return n + (int(words[whole]) & ((1 << inside % 64) - 1)).bit_count() if inside % 64 else n

    def token(self, i: int) -> int:
        """The id at place ``i``: two words of chunks, one of the bitmap, one block of the directory per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level, width in enumerate(self.widths):
            chunks, bits, _, count = self.levels[level]
            word, off = divmod(i * width, 64)
            both = self._words(chunks, word, 2 if off + width > 64 else 1)
            value |= ((int(both[0]) | (int(both[1]) << 64 if len(both) > 1 else 0)) >> off & ((1 << width) - 1)) << shift
            if level == len(self.widths) - 1 or not int(self._words(bits, i // 64, 1)[0]) >> i % 64 & 1:
                return value
            i, shift = self._rank(level, i), shift + width
        return value

    def tokens(self, first: int, end: int) -> np.ndarray:
        """The ids of places ``first`` to ``end``, as u32; in each level only the chunks of these are read."""
        first, end = max(0, first), min(end, self.n_tokens)
        out, held, shift = np.zeros(max(0, end - first), np.uint32), None, 0
        for level, width in enumerate(self.widths):
            if end <= first:
                break
            chunks, bits, _, _ = self.levels[level]
            begin = first // 64
            words = self._words(chunks, begin * width, (-(-end // 64) - begin) * width)
            part = unpack_bits(words, width, first - begin * 64, end - first).astype(np.uint32) << np.uint32(shift)
            held = np.arange(len(out)) if held is None else held
            out[held] |= part
            if level == len(self.widths) - 1:
                break
            raw = self._words(bits, begin, -(-end // 64) - begin).view(np.uint8)
            more = np.unpackbits(raw, bitorder="little")[first - begin * 64:end - begin * 64].astype(bool)
            held = held[more]
            first, end, shift = self._rank(level, first), self._rank(level, end), shift + width
        return out

    def doc_ids(self) -> list[int | None]:
        raw = self.read(self._docs, 9 * self.n_docs)
        ids = np.frombuffer(raw[:8 * self.n_docs], "<i8").tolist()
        return [None if null else i for i, null in zip(ids, raw[8 * self.n_docs:])]

    def ends(self) -> np.ndarray:
        return np.frombuffer(self.read(self._docs + 9 * self.n_docs, 8 * self.n_docs), "<u8").astype(np.int64)

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        view = memoryview(data)
        return cls(lambda at, size: bytes(view[at:at + size]))


def write_tokens(docs: DataFrame, folder: str, file: str, id: str = "doc_id", text: str = "text", end: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode all texts with the ``tokenizers`` file and write their ids, each document closed by ``end``; the list of files.

    The rows are range-partitioned and sorted by id (null first), equal ids by a hash of their text, and each task
    streams its range into files of about ``file_tokens`` ids, of which it holds one at a time; a longer document is a
    file of its own. The list ``(part, path, first, docs, tokens, bytes)`` is staged; ``first`` is the place of the
    file's first token in the whole corpus: the tokens of earlier tasks, one row of which per task passes the driver,
    and those before it in its own. Files are named by attempt and listed only if their task succeeds, so a repeated
    task leaves no double documents.

    Defined cases: a null text is empty, a document of ``end`` alone; rows are documents, also if ids repeat; other
    columns are not read; an empty table gives no files.
    """
    spark, target = docs.sparkSession, folder.rstrip("/")
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = Encoder.of_worker(file), TaskContext.get()
        part, before, held, ids, size, number = context.partitionId(), 0, [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal before, held, ids, size, number
            path = f"{target}/part-{part:06d}-{number:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tok"
            data = encode_file(ids, held)
            system, name = open_uri(path)
            system.create_dir(name.rpartition("/")[0], recursive=True)
            with system.open_output_stream(name, compression=None) as out:
                out.write(data)
            row = {"part": [part], "path": [path], "first": [before], "docs": [len(held)], "tokens": [size], "bytes": [len(data)]}
            before, held, ids, size, number = before + size, [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("path", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            begin = chars = 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars < BATCH_CHARS and i < len(texts) - 1:
                    continue
                for doc, tokens in zip(names[begin:i + 1], encoder.encode(texts[begin:i + 1])):
                    ids.append(doc)
                    held.append(np.append(tokens, np.uint32(end)).astype(np.uint32))
                    size += len(held[-1])
                    if size >= file_tokens:
                        yield close()
                begin, chars = i + 1, 0
        if held:
            yield close()

    files = stage(ranged.mapInArrow(write, "part int, path string, first long, docs long, tokens long, bytes long"), "tokens")
    before, at = [], 0
    for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():
        before.append((r.part, at))
        at += r.n
    bases = spark.createDataFrame(before, "part int, base long")
    return files.join(bases, "part").select("part", "path", (F.col("first") + F.col("base")).alias("first"), "docs", "tokens", "bytes")


def read_tokens(files: DataFrame) -> DataFrame:
    """The documents of the listed files: ``(doc_id, start, n_tokens, ids)``, ids as little-endian u32 in one binary.

    ``start`` counts the ids of all documents before. Each file is one read of a task, its documents leave in batches.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, name = open_uri(path)
                with system.open_input_file(name) as f:
                    codes = TokenFile.of(f.read())
                docs, ends = codes.doc_ids(), codes.ends()
                begins = np.append(0, ends)[:-1]
                begin = 0
                while begin < len(docs):  # so many documents as hold PIECE tokens, one at least
                    end = max(begin + 1, int(np.searchsorted(ends, begins[begin] + PIECE, "right")))
                    low, high = int(begins[begin]), int(ends[end - 1])
                    ids = codes.tokens(low, high).astype("<u4").tobytes()
                    cuts = 4 * (np.append(begins[begin:end], high) - low)
                    data = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids)]) \
                        if len(ids) < 1 << 31 else pa.array([ids], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[begin:end], pa.int64()), pa.array(begins[begin:end] + first), pa.array((ends - begins)[begin:end]), data], schema=schema)
                    begin = end

    listed = files.select("path", "first")
    return listed.repartition(max(1, files.count()), F.xxhash64("path")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(files: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """``places`` with the ``token`` at each place of the corpus (null outside it), by random access to the files.

    Places meet their file by equal spans of ``FILE_TOKENS`` places, so the join is on a key and no file is scanned.
    """
    spans = files.where("tokens > 0").select("path", "first", "tokens", F.explode(F.sequence(
        F.expr(f"first div {FILE_TOKENS}"), F.expr(f"(first + tokens - 1) div {FILE_TOKENS}"))).alias("span"))
    wanted = places.select(F.col(place).cast("long").alias("at")).distinct()
    found = wanted.withColumn("span", F.expr(f"at div {FILE_TOKENS}")).join(spans, "span").where("at >= first and at < first + tokens")
    sorted_ = found.select("path", (F.col("at") - F.col("first")).alias("local"), "at").repartition("path").sortWithinPartitions("path", "local")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = codes = None
        for b in batches:
            out = []
            for path, local in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path != last:
                    system, name = open_uri(path)
                    f = system.open_input_file(name)
                    codes, last = TokenFile(lambda at, size, f=f: f.read_at(size, at)), path
                out.append(codes.token(local))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(out, pa.int64())], names=["at", "token"])

    tokens = sorted_.mapInArrow(fetch, "at long, token long")
    return places.join(tokens, F.col(place).cast("long") == F.col("at"), "left").drop("at")
