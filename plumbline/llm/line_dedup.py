"""Removal of lines that many documents share, found with two Bloom filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import MAX_BITS, map_rows, may_have, pack, seen_filter, unpack
from plumbline.session import stage

BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> list[tuple[str, bytes | None]]:
    """Each line with its key: stripped, A-Z in lower case; None where the key is too short to count."""
    out = []
    for line in (text or "").split("\n"):
        bare = line.strip(BLANKS)
        out.append((line, bare.encode("utf-8", "surrogatepass").lower() if len(bare) >= min_chars else None))
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def twice_seen(docs: DataFrame, text: str, min_chars: int, max_bits: int) -> np.ndarray:
    """Bits of the filter of line hashes that may occur in two documents; never misses one.

    Each document counts a line once. The filter has 16 bits a line up to ``max_bits``; beyond that more lines are
    suspected, which costs shuffle but changes no result.
    """
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> list[int]:
        out = []
        for t in batch.column(0).to_pylist():
            out += [xxhash.xxh3_64_intdigest(k) for k in {k for _, k in line_keys(t, min_chars) if k is not None}]
        return out

    return seen_filter(docs.select(text), hashes, lines, max_bits, twice=True)


def drop_repeated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents share, and counts of what was done.

    A line's key is the line stripped of ASCII white space with A-Z in lower case; keys under ``min_chars`` code
    points always stay. A repeated key keeps its lines in the document of the largest id only. Returns the columns of
    ``docs`` with ``text`` rewritten, ``n_lines`` (before) and ``n_dropped``.

    Two Bloom filters decide which lines are suspected of a second occurrence; only their 128-bit digests are shuffled
    and counted exactly, with partial aggregation, so a line that a third of all documents hold is one row per task.
    Defined cases: null or empty text is one empty line; each row is a document of its own, also if it repeats an id;
    rows with a null id lose repeated lines unless all holders have null ids; an empty table gives no rows; existing
    columns named like an added one are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = pack(docs.select(*[F.col(f"`{c}`") for c in names]), id, text)
    narrow = docs.select(id, text)
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(narrow, text, min_chars, max_bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = twice.value
        for batch in batches:
            ids, keys = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = list({k for _, k in line_keys(t, min_chars) if k is not None})
                ids += [i] * len(own)
                keys += own
            found = np.flatnonzero(may_have(seen, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
            owners = batch.column(0).take(pa.array(np.array(ids, np.int64)[found]))
            yield pa.RecordBatch.from_arrays([owners, pa.array([digest(keys[i]) for i in found], pa.binary())], names=["id", "key"])

    id_type = docs.schema[id].dataType.simpleString()
    suspects = stage(narrow.mapInArrow(suspected, f"id {id_type}, key binary"), "suspects")
    repeated = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs)
    repeated = stage(repeated, "repeated")  # else the join has one shuffle, and the rows of a common line could not be split
    drops = (suspects.join(repeated, "key").where("keep is not null and not (id <=> keep)")
             .groupBy(F.col("id").alias("__id")).agg(F.collect_set("key").alias("__keys")))
    joined = packed.join(drops, packed[id].eqNullSafe(drops["__id"]), "left").drop("__id")

    def rewrite(batch: pa.RecordBatch) -> dict:
        kept, lines, dropped = [], [], []
        for t, keys in zip(batch.column(text).to_pylist(), batch.column("__keys").to_pylist()):
            if not keys:
                kept.append(t)
                lines.append((t or "").count("\n") + 1)
                dropped.append(0)
                continue
            gone = set(keys)
            pairs = line_keys(t, min_chars)
            rest = [line for line, k in pairs if k is None or digest(k) not in gone]
            kept.append("\n".join(rest))
            lines.append(len(pairs))
            dropped.append(len(pairs) - len(rest))
        return {text: pa.array(kept, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}

    done = map_rows(joined, f"`{text}` string, n_lines long, n_dropped long", compute=rewrite, drop=("__keys",))
    return unpack(done, names, "n_lines", "n_dropped")
