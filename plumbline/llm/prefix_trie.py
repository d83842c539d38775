"""A trie of conversation prefixes: minimal perfect hashes per shard, counts in flat arrays, sums in depth order.

A prefix of d turns is named by a 127-bit polynomial of the digests of its turns, so a conversation that lies in many
tasks needs only one number from the task before. Equal prefixes are one node, counted with partial aggregation.
Nodes that more than ``limit`` conversations share (the limit grows with the table so that few are) form a table
of bounded size; below it hang subtrees of few conversations, which are cut again every ``BAND`` turns. Whole subtrees
are dealt to shards, and in a shard each node gets a slot of a minimal perfect hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.session import stage

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big")
ROOT = bytes(16)
BAND = 1 << 15  # turns after which a subtree is cut
SHARD = 1 << 16  # nodes of a shard, about
SHARED = 1 << 17  # the most nodes of the table of shared prefixes
LEAST = 1 << 11  # subtrees of so many conversations are never cut for their breadth
JOINED = 512  # ids that are joined to one text


def number_turns(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, pos, digest, bytes)``: the place of each turn from 1, a digest of role and text, UTF-8 bytes of the text.

    Order is by turn (null first), then role, then text; null role or text is empty; rows without a conversation belong
    to none. Rows are range-partitioned, so a conversation may lie in many tasks: each counts its own rows, and the
    counts of the tasks before (one row per task) are added.
    """
    rows = conversations.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            local, digests, sizes = [], [], []
            for conv, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                n = n + 1 if conv == last else 1
                last = conv
                r, t = r.encode(), t.encode()
                local.append(n)
                digests.append(hashlib.blake2b(b"%d:%b%b" % (len(r), r, t), digest_size=15).digest())
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(local), part, np.int32)), b.column(0), pa.array(local, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())],
                names=["part", "conv_id", "local", "digest", "bytes"])

    staged = stage(ranged.mapInArrow(run, "part int, conv_id long, local long, digest binary, bytes long"), "turns")
    ends = staged.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last"))
    carry, open_, n = [], None, 0
    for r in ends.orderBy("part").collect():
        if r.first == open_:
            carry.append((r.part, open_, n))
        n = r.last.local + (n if r.first == open_ == r.last.conv_id else 0)
        open_ = r.last.conv_id
    before = staged.sparkSession.createDataFrame(carry, "part int, conv_id long, before long")
    pos = F.col("local") + F.coalesce("before", F.lit(0))
    return staged.join(F.broadcast(before), ["part", "conv_id"], "left").select("conv_id", pos.alias("pos"), "digest", "bytes")


def prefix_names(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, node, parent, bytes)``: a row per prefix of every conversation, named by 16 bytes."""
    ranged = turns.select("conv_id", "pos", "digest", "bytes").repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, name = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            local, names = [], []
            for conv, digest in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if conv != last:
                    last, n, name = conv, 0, 0
                n, name = n + 1, (name * BASE + int.from_bytes(digest, "big") + 1) % PRIME
                local.append(n)
                names.append((name.to_bytes(16, "big")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(local), part, np.int32)), b.column(0), b.column(1), pa.array(local, pa.int64()), pa.array(names, pa.binary()), b.column(2), b.column(3)],
                names=["part", "conv_id", "depth", "local", "name", "digest", "bytes"])

    staged = stage(ranged.mapInArrow(run, "part int, conv_id long, depth long, local long, name binary, digest binary, bytes long"), "names")
    ends = staged.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local", "name")).alias("last"))
    carry, open_, name = {}, None, 0
    for r in ends.orderBy("part").collect():
        if r.first == open_:
            carry[r.part] = (open_, name)
        own = int.from_bytes(r.last.name, "big")
        name = (own + name * pow(BASE, r.last.local, PRIME)) % PRIME if r.first == open_ == r.last.conv_id else own
        open_ = r.last.conv_id
    inverse = pow(BASE, -1, PRIME)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, parents = [], []
            columns = [b.column(n).to_pylist() for n in ("part", "conv_id", "local", "name", "digest")]
            for part, conv, local, name, digest in zip(*columns):
                open_, before = carry.get(part, (None, 0))
                value = int.from_bytes(name, "big")
                if conv == open_:
                    value = (value + before * pow(BASE, local, PRIME)) % PRIME
                nodes.append(value.to_bytes(16, "big"))
                parents.append(((value - int.from_bytes(digest, "big") - 1) * inverse % PRIME).to_bytes(16, "big"))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("depth"), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), b.column("bytes")],
                names=["conv_id", "depth", "node", "parent", "bytes"])

    return stage(staged.mapInArrow(join, "conv_id long, depth long, node binary, parent binary, bytes long"), "prefixes")


class SlotTable:
    """A minimal perfect hash of different 16-byte names; every slot keeps its name, so a foreign name is told from them.

    Level by level each name not placed yet is hashed to a bit of a bitmap twice their number; bits that one name hits
    are kept. A name's slot is the number of kept bits before its own.
    """

    def __init__(self, names: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        left, base = names, 0
        while len(left):
            size = 2 * len(left) + 1
            at = self._hash(left, len(self.levels), size)
            single = np.bincount(at, minlength=size) == 1
            self.levels.append((np.where(single, base + np.cumsum(single) - 1, -1), size))
            base += int(single.sum())
            left = left[~single[at]]
        self.names = np.zeros((len(names), 2), np.uint64)
        slots = self._slots(names)
        if len(names) and (slots.min() < 0 or np.bincount(slots, minlength=len(names)).max() > 1):
            raise ValueError("two names share a slot")
        self.names[slots] = names

    @staticmethod
    def _hash(names: np.ndarray, level: int, size: int) -> np.ndarray:
        x = names[:, 0] ^ (names[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _slots(self, names: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(names), -1, np.int64), np.arange(len(names))
        for level, (ranks, size) in enumerate(self.levels):
            found = ranks[self._hash(names[open_], level, size)]
            out[open_[found >= 0]] = found[found >= 0]
            open_ = open_[found < 0]
        return out

    def slots(self, names: np.ndarray) -> np.ndarray:
        """The slot of each name, -1 where the slot that it hashes to keeps another."""
        out = self._slots(names)
        hit = np.flatnonzero(out >= 0)
        out[hit[(self.names[out[hit]] != names[hit]).any(axis=1)]] = -1
        return out


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


INPUT = "node binary, parent binary, depth long, conv_id long, n_convs long, bytes long, x_children long, x_leaves long, x_saved long"
OUTPUT = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, inside boolean, n_convs long, n_children long, n_leaves long, saved long"


def accumulate(table: pa.Table) -> pa.Table:
    """The nodes of a shard with their children, leaves and savings; ``x_`` columns are what lower shards found below a node.

    ``inside`` tells whether the parent is in the shard; else its conversation is not known here.
    """
    names = _words(table.column("node"))
    slots = SlotTable(names)
    at, n = slots.slots(names), len(names)

    def scatter(column: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[at] = table.column(column).to_numpy()
        return out

    parent = np.full(n, -1, np.int64)
    parent[at] = slots.slots(_words(table.column("parent")))
    depth, conv, convs = scatter("depth"), scatter("conv_id"), scatter("n_convs")
    parent[(parent >= 0) & (depth == 0)] = -1  # the root is its own parent by name
    has = np.flatnonzero(parent >= 0)
    children = scatter("x_children") + np.bincount(parent[has], minlength=n)
    leaves = scatter("x_leaves") + (children == 0)
    saved = scatter("x_saved") + (convs - 1) * scatter("bytes")
    order = has[np.argsort(-depth[has], kind="stable")]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pa.array(conv[parent], mask=parent < 0)
    columns = {"parent_conv_id": above.take(pa.array(at)), "inside": pa.array(parent[at] >= 0)}
    columns |= {k: pa.array(v[at]) for k, v in (("n_children", children), ("n_leaves", leaves), ("saved", saved))}
    kept = {k: table.column(k) for k in ("node", "parent", "depth", "conv_id", "n_convs")}
    wanted = [part.split()[0] for part in OUTPUT.split(", ")]
    return pa.table({k: {**kept, **columns}[k] for k in wanted})


def prefix_trie(turns: DataFrame, members: DataFrame, limit: int | None = None, band: int = BAND, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of all conversations, and ``(conv_id, node)``: where each conversation ends.

    ``turns`` are numbered (``conv_id, pos, digest, bytes``, places from 1 without gaps), ``members`` are all
    conversations, also those without turns. A node is a different sequence of first turns: ``(node, parent, depth,
    conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved)`` with ``conv_id`` its smallest member, ``n_leaves`` the nodes
    without children in its subtree and ``saved`` the bytes of last turns that members share, (n_convs - 1) times each,
    summed over the subtree. The root has depth 0. No conversation gives no node.

    What passes the driver: one row per task and the at most ``SHARED`` prefixes above ``limit`` conversations. A
    subtree of a shard has at most ``limit`` conversations and ``band`` turns of depth; longer ones take a round per band,
    lowest first.
    """
    spark = turns.sparkSession
    members = stage(members.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct(), "members")
    rows = prefix_names(turns)
    whole = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    nodes = stage(rows.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes")), "nodes")
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("x")).select("conv_id", F.col("x.node").alias("node"))
    ends = members.join(last, "conv_id", "left").select("conv_id", F.coalesce("node", F.lit(bytearray(ROOT))).alias("node"))

    size = nodes.agg(F.count("*").alias("nodes"), F.sum("n_convs").alias("rows"), F.max("depth").alias("depth")).first()
    limit = limit or max(LEAST, (size.rows or 0) // SHARED)
    top = nodes.where(F.col("n_convs") > limit)
    shared = {bytes(r.node): r.conv_id for r in top.select("node", "conv_id").toLocalIterator()} | {ROOT: whole.least}
    known = spark.sparkContext.broadcast(shared)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each conversation enters a subtree of few: below a shared prefix and at the begin of each band."""
        names = known.value
        for b in batches:
            depth = b.column("depth").to_pylist()
            light = [n not in names for n in b.column("node").to_pylist()]
            first = [k for k, (x, p, d) in enumerate(zip(light, b.column("parent").to_pylist(), depth)) if x and (p in names or d % band == 0)]
            part = b.take(pa.array(first, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), pa.array([depth[k] // band for k in first], pa.int64()), part.column("node")], names=["conv_id", "band", "piece"])

    pieces = stage(rows.select("conv_id", "depth", "node", "parent").mapInArrow(tops, "conv_id long, band long, piece binary"), "pieces")
    placed = nodes.withColumn("band", F.expr(f"depth div {band}")).join(pieces, ["conv_id", "band"])
    shards = max(1, -(-size.nodes // shard))
    light = stage(placed.where(F.col("n_convs") <= limit).withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))), "light")

    def solve(frame: DataFrame, below: DataFrame | None) -> DataFrame:
        columns = [c.split()[0] for c in INPUT.split(", ")]
        if below is None:
            frame = frame.withColumns({c: F.lit(0).cast("long") for c in columns[-3:]})
        else:
            found = stage(below.groupBy(F.col("parent").alias("node")).agg(
                F.count("*").alias("x_children"), F.sum("n_leaves").alias("x_leaves"), F.sum("saved").alias("x_saved")), "below")
            frame = frame.join(found, "node", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in columns[-3:]})
        return stage(frame.select("shard", *columns).groupBy("shard").applyInArrow(lambda t: accumulate(t), OUTPUT), "solved")

    found, below = [], None
    for number in range((size.depth or 0) // band, -1, -1):
        done = solve(light.where(F.col("band") == number), below)
        found.append(done)
        outside = done.where("not inside")
        below = outside if below is None else below.unionByName(outside)
    root = spark.createDataFrame([(bytearray(ROOT), bytearray(ROOT), 0, whole.least, whole.n, 0)] if whole.n else [], "node binary, parent binary, depth long, conv_id long, n_convs long, bytes long")
    found.append(solve(top.select(root.columns).unionByName(root).withColumn("shard", F.lit(0)), below))

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = known.value
        for b in batches:
            inside, own = b.column("inside").to_pylist(), b.column("parent_conv_id").to_pylist()
            depth = b.column("depth").to_pylist()
            conv = [c if i or not d else names.get(p) for c, i, d, p in zip(own, inside, depth, b.column("parent").to_pylist())]
            yield b.set_column(b.schema.get_field_index("parent_conv_id"), "parent_conv_id", pa.array(conv, pa.int64()))

    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.mapInArrow(parents, OUTPUT)
    if len(found) > 2:  # heads of lower bands hang on prefixes that are not shared by many
        heads = stage(out.where("parent_conv_id is null and depth > 0").select("node", "parent"), "heads")
        named = heads.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), "parent").select("node", "above")
        out = out.join(stage(named, "heads"), "node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above")
    return out.drop("inside"), ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: the hash of the ids that end at a node, ascending, in decimal, joined by commas.

    Ids are put in order by ranges and joined per task and node, so the task that hashes a node reads few rows of it;
    it reads them one after the other.
    """
    ranged = ends.repartitionByRange("conv_id").sortWithinPartitions("node", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, open_, held = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            rows = []
            for conv, node in zip(b.column("conv_id").to_pylist(), b.column("node").to_pylist()):
                if held and (node != open_ or len(held) == JOINED):
                    rows.append((open_, part, seq, ",".join(held)))
                    seq, held = seq + 1, []
                open_ = node
                held.append(str(conv))
            yield batch_of(rows)
        if held:
            yield batch_of([(open_, part, seq, ",".join(held))])

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.string()))], names=["node", "part", "seq", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sha = None, None
        for b in batches:
            nodes, digests = [], []
            for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if node != open_:
                    if sha is not None:
                        nodes.append(open_)
                        digests.append(sha.hexdigest())
                    open_, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    texts = stage(ranged.mapInArrow(joined, "node binary, part int, seq long, ids string"), "ends")
    return texts.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def splice_heads(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of rebuilt conversations, and their ids: c takes its first h turns from c - c % group, h = crc32(c) % heads.

    All turns of the other if it has fewer, none if there is no such conversation; then follow its own turns after
    its first h. At most ``heads - 1`` turns of a conversation are ever gathered.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.groupBy("conv_id").count().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("other"), taken.alias("h"))
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).groupBy(F.col("conv_id").alias("other")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    made = own.join(first, "other", "left").select("conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array()).alias("head"))
    made = stage(made, "heads")
    begun = made.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.pos", "x.digest", "x.bytes")
    shift = made.select("conv_id", (F.size("head") - F.col("h")).alias("shift"))
    rest = turns.where(F.col("pos") > taken).join(shift, "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "bytes")
    return begun.unionByName(rest), made.select("conv_id")
