"""Helpers shared by the operators: carried columns, Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.session import scratch_path, stage

REST = "__rest"
SEGMENT = 1 << 16  # bits of a filter that travel in one row
MAX_BITS = 1 << 29  # 64 MB: the bound of a broadcast filter


def pack(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` as they are and all others in one struct, so that added columns cannot clash with them."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*columns, F.struct(F.lit(0).alias("__none"), *others).alias(REST))


def unpack(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns ``names`` of a packed frame in their order, followed by those of ``more``."""
    plain = [c for c in df.columns if c != REST]
    return df.select(*[F.col(c) if c in plain else F.col(f"{REST}.`{c}`").alias(c) for c in names], *more)


def map_rows(df: DataFrame, add: str, compute: Callable[[pa.RecordBatch], dict], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of the schema ``add`` that ``compute`` derives from each Arrow batch.

    Row by row, without a shuffle. A computed column replaces one of the same name.
    """
    new = T._parse_datatype_string(add)
    kept = [f for f in df.schema.fields if f.name not in new.fieldNames() and f.name not in drop]
    names, wanted = [f.name for f in kept], new.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = compute(b)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [made[n] for n in wanted], names=names + wanted)

    return df.mapInArrow(run, T.StructType(kept + new.fields))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows per Arrow batch, for tables whose rows hold whole texts: both sides of the transfer hold a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release_memory() -> None:
    """Hands what Arrow and the C library hold of freed memory back to the system: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the scratch folder as a full URI, so that tasks find the same store as Spark does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a full URI; a bare path is local."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [(hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)]


def _set(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _has(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def may_have(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes a Bloom filter may hold; none that it holds is missed."""
    a, b = _positions(hashes, 8 * len(filter_))
    return _has(filter_, a) & _has(filter_, b)


def seen_filter(df: DataFrame, hashes: Callable[[pa.RecordBatch], list], count: int, max_bits: int = MAX_BITS, twice: bool = False) -> np.ndarray:
    """A Bloom filter of the 64-bit hashes that occur in ``df``, or of those that may occur twice.

    Every task fills two filters, for hashes seen once and seen twice; a hash in the first filter of two tasks has been
    seen twice. Segments of the filters are merged in two levels, each with a bounded number of rows per group. There
    are 16 bits per expected hash, ``max_bits`` at most: that bounds what the driver holds and broadcasts, and a fuller
    filter only has more false hits.
    """
    bits = min(max_bits, max(SEGMENT, 1 << math.ceil(math.log2(16 * count + 1))))
    step = SEGMENT // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            values, counts = np.unique(np.asarray(hashes(batch), np.uint64), return_counts=True)
            again = (counts > 1) | may_have(one, values)
            for at in _positions(values, bits):
                _set(one, at)
                _set(two, at[again])
        used = np.flatnonzero(one.reshape(-1, step).any(axis=1))
        task = TaskContext.get().partitionId()
        for s in range(0, len(used), 256):
            ids = used[s:s + 256]
            packed = [[zlib.compress(f[i * step:(i + 1) * step], 1) for i in ids] for f in (one, two)]
            yield pa.RecordBatch.from_pydict({"segment": ids.astype(np.int32), "task": np.full(len(ids), task, np.int32), "one": packed[0], "two": packed[1]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, two = np.zeros(step, np.uint8), np.zeros(step, np.uint8)
        for a, b in zip(rows["one"], rows["two"]):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            two |= b | (one & a)
            one |= a
        return pd.DataFrame({"segment": [key[0]], "one": [zlib.compress(one, 1)], "two": [zlib.compress(two, 1)]})

    shape = "segment int, one binary, two binary"
    fan = math.isqrt(max(1, df.rdd.getNumPartitions())) + 1
    parts = df.mapInArrow(fill, "segment int, task int, one binary, two binary")
    parts = parts.groupBy("segment", (F.col("task") % fan).alias("part")).applyInPandas(merge, shape)
    merged = parts.groupBy("segment").applyInPandas(merge, shape)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", F.col("two" if twice else "one").alias("bits")).toLocalIterator():
        out[row.segment * step:(row.segment + 1) * step] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's edges as stars around the smallest node of their local component; bounded buffers."""
    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ids[: len(a)], ids[len(a):]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            np.minimum.at(root, before, root)
            root = root[root]
            if np.array_equal(root, before):
                break
        out = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= 1_000_000:
            yield stars(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield stars(*map(np.concatenate, zip(*held)))


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of undirected long edges ``(a, b)``: the smallest node reachable from each node.

    Rounds of large and small stars: every node hooks its larger neighbours, then its smaller ones, to the smallest
    of them. Each round groups with partial aggregation and joins on the node; the grouped side is staged, so that the other has
    a shuffle of its own and adaptive execution may split a hub; nothing is gathered. Rounds grow with the logarithm of the longest chain; each is staged in the shared folder,
    so a lost executor repeats one round. Self-loops and null ends are ignored; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_local_forest, "a long, b long")
    edges = stage(edges.distinct(), "edges")
    previous = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        low = stage(down.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stage(small.select("e.a", "e.b").where("a > b").distinct(), "edges")
        state = _state(edges)
        if state == previous:  # a fixed point: every node hangs on one smaller node, and none of those on another
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        previous = state
