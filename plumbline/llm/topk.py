"""Exact top-k by inner product: sorted lists read without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import stage

QUERIES = 256  # queries in a block
ITEMS = 4096  # vectors in a block
FIRST = 1 / 16  # part of each list that is read before bounds are first compared; doubled until decided
EXACT = float(1 << 52)  # sums of floats below this are exact


class SortedLists:
    """A block of vectors as one list of (value, vector) per component, in falling order.

    Lists are read in step from both ends: from the top for positive weights, from the bottom for negative ones. What has been
    read of a vector is known; of the rest only the frontier and the end of the list are.
    """

    def __init__(self, items: np.ndarray):
        self.n, self.dims = items.shape
        self.order = np.argsort(-items, axis=0, kind="stable")
        self.values = np.take_along_axis(items, self.order, axis=0)
        self.read = 0
        self.top_seen = np.zeros(items.shape, bool)
        self.bottom_seen = np.zeros(items.shape, bool)
        self.seen = np.zeros(items.shape)

    def advance(self, depth: int) -> None:
        columns = np.arange(self.dims)[None, :]
        for part, seen in ((slice(self.read, depth), self.top_seen), (slice(self.n - depth, self.n - self.read), self.bottom_seen)):
            rows = self.order[part]
            seen[rows, columns] = True
            self.seen[rows, columns] = self.values[part]
        self.read = depth

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores from what has been read."""
        high, low = self.values[0], self.values[-1]
        top, bottom = self.values[self.read - 1], self.values[self.n - self.read]
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        a, b = self.top_seen, self.bottom_seen
        upper = up @ np.where(a, self.seen, top).T + down @ np.where(b, self.seen, bottom).T
        lower = up @ np.where(a, self.seen, low).T + down @ np.where(b, self.seen, high).T
        return lower, upper


def search_block(queries: np.ndarray, items: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a block that may be among the ``k`` best of each query, as (query, item, score).

    ``own`` marks pairs that do not count. Lists are read until no vector outside a query's candidates has an upper
    bound above the k-th largest lower bound (nor equal to it, as ties go by id); the candidates' remaining components
    are resolved at the end. At full depth the bounds meet, so this always stops.
    """
    lists, depth = SortedLists(items), max(1, int(len(items) * FIRST))
    open_ = np.arange(len(queries))
    rows, found = [], []
    while len(open_):
        depth = min(depth, len(items))
        lists.advance(depth)
        lower, upper = lists.bounds(queries[open_])
        lower[own[open_]] = upper[own[open_]] = -np.inf
        if lower.shape[1] > k:
            least = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
        else:
            least = np.full(len(open_), -np.inf)
        may = (upper >= least[:, None]) & (upper > -np.inf)
        done = (may.sum(axis=1) <= 2 * k) | (depth == len(items))
        q, i = np.nonzero(may & done[:, None])
        rows.append(open_[q])
        found.append(i)
        open_ = open_[~done]
        depth *= 2
    q, i = np.concatenate(rows), np.concatenate(found)
    return q, i, np.einsum("nd,nd->n", queries[q], items[i])


def _exact_scores(queries: np.ndarray, items: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scores in Python integers, where floats would round."""
    scores = queries.astype(object) @ items.astype(object).T
    q, i = np.nonzero(~own)
    return q, i, scores[q, i]


def top_k(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, every: int = 100, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, its ``k`` best among all others.

    Components become ``floor(scale * x)``; scores are integer inner products; ties go to the smaller id. Queries and
    vectors are packed into blocks, and each pair of blocks is one row of an equi-join on the pair of block numbers: the
    stated query set against all rows, in blocks, spread evenly over tasks. A task reads the sorted lists of its
    block and keeps at most a few candidates per query; the best of all blocks follow by a ranked window, which Spark
    cuts per task before the shuffle.

    Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of
    different lengths do not meet; repeated rows are one vector; rows with one id but different vectors are queries of
    their own whose results share that id's ranks, and never candidates of each other; null ids are neither queries nor
    candidates; fewer candidates than ``k`` give all; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    parts = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = vectors.where(F.col(id).isNotNull() & good).select(F.col(id).cast("long").alias("id"), parts.alias("x"))
    whole = whole.dropDuplicates(["id", "x"]).withColumn("size", F.size("x")).withColumn("query", F.col("id") % every == 0)
    rows = stage(whole, "vectors")
    per_size = rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("query").alias("q"))
    per_size = {r["size"]: (-(-r.n // ITEMS), -(-r.q // QUERIES)) for r in per_size.collect() if r.q}
    shape = spark.createDataFrame([(s, i, q) for s, (i, q) in per_size.items()] or [], "size int, items int, queries int")

    def pack(df: DataFrame, blocks: str, name: str) -> DataFrame:
        """One row per block: ids and components as bytes."""
        def run(key: tuple, t: pa.Table) -> pa.Table:
            x = t.column("x").combine_chunks()
            return pa.table({"size": pa.array([key[0].as_py()], pa.int32()), name: pa.array([key[1].as_py()], pa.int64()),
                             f"{name}_ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()),
                             f"{name}_x": pa.array([np.ascontiguousarray(x.flatten().to_numpy()).tobytes()], pa.binary())})

        # Hashed block numbers; blocks are of about equal size.
        dealt = df.join(F.broadcast(shape), "size").withColumn(name, F.pmod(F.xxhash64("id", "x"), F.col(blocks)))
        return dealt.select("size", name, "id", "x").groupBy("size", name).applyInArrow(run, f"size int, {name} long, {name}_ids binary, {name}_x binary")

    items = pack(rows, "items", "item_block").join(F.broadcast(shape), "size").withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("queries").cast("long") - 1))).drop("items", "queries")
    queries = pack(rows.where("query"), "queries", "query_block").join(F.broadcast(shape), "size").withColumn("item_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("items").cast("long") - 1))).drop("items", "queries")
    grid = items.join(queries, ["size", "item_block", "query_block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                dims = cell["size"]
                qid, iid = (np.frombuffer(cell[n], np.int64) for n in ("query_block_ids", "item_block_ids"))
                q, x = (np.frombuffer(cell[n], np.int64).reshape(-1, dims) for n in ("query_block_x", "item_block_x"))
                own = qid[:, None] == iid[None, :]
                if float(np.abs(q).max()) * float(np.abs(x).max()) * dims < EXACT:
                    a, b, score = search_block(q.astype(float), x.astype(float), own, k)
                else:
                    a, b, score = _exact_scores(q, x, own)
                order = np.lexsort([iid[b], -score.astype(np.int64), a])
                a, b, score = a[order], b[order], score[order]
                first = np.searchsorted(a, a, "left")
                best = np.arange(len(a)) - first < k
                a, b, score = a[best], b[best], score[best]
                version = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in q], np.uint64).view(np.int64)  # rows of one id stay apart
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[a]), pa.array(version[a]), pa.array(iid[b]), pa.array(score.astype(np.int64))],
                    names=["query_id", "version", "vec_id", "score"])

    found = grid.mapInArrow(search, "query_id long, version long, vec_id long, score long")
    order = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
