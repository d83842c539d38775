"""SimHash near-duplicates by anchor points of the binary Golay code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import REST, components, map_rows, pack, unpack
from plumbline.session import stage

LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b110001110101  # the perfect binary Golay code [23, 12]
ROWS = 20_000  # fingerprints per batch of replicas

# A band: its first bit, the number of exact bits after the 23 of the code, and the threshold it covers.
Band = tuple[int, int, int]
# Of two halves of 64 bits one differs in at most 1 bit if all differ in at most 3.
PAIR_OF_HALVES: tuple[Band, ...] = ((0, 9, 1), (32, 9, 1))


def _remainder(x: np.ndarray) -> np.ndarray:
    """Numbers as polynomials over GF(2), modulo the generator."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        x = np.where((x >> bit) & 1 == 1, x ^ (GENERATOR << (bit - CHECKS)), x)
    return x


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of each syndrome: every word has one codeword within 3."""
    low, high = _remainder(np.arange(1 << 12, dtype=np.int64)), _remainder(np.arange(1 << 11, dtype=np.int64) << 12)
    errors = np.zeros(1 << CHECKS, np.int64)
    for weight in range(1, RADIUS + 1):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            errors[low[e & 0xFFF] ^ high[e >> 12]] = e
    return low, high, errors


def anchors(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of the codeword nearest to each 23-bit word."""
    low, high, errors = tables
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECKS


def visited(words: np.ndarray, threshold: int, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of all codewords within covering radius plus ``threshold`` of each word.

    A codeword at distance 3 + t is the nearest to the word with t of the bits flipped in which they differ.
    """
    found = [anchors(words, tables)]
    for t in range(1, threshold + 1):
        for bits in combinations(range(LENGTH), t):
            found.append(anchors(words ^ np.int64(sum(1 << b for b in bits)), tables))
    grid = np.sort(np.stack(found, axis=1), axis=1)
    fresh = np.ones(grid.shape, bool)
    fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
    row, _ = np.nonzero(fresh)
    return row, grid[fresh]


def _bits(words: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` bits from ``first`` on of fingerprints laid out in 64-bit words (rows)."""
    w, shift = divmod(first, 64)
    out = words[:, w] >> np.uint64(shift)
    if shift + count > 64:
        out = out | (words[:, w + 1] << np.uint64(64 - shift))
    return (out & np.uint64((1 << count) - 1)).astype(np.int64)


def places(words: np.ndarray, number: int, band: Band, tables, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the anchors of one band: the home of each fingerprint, or all that it must visit.

    The anchors are the direct sum of the Golay code and all words of the exact bits; a bit of the threshold spent on
    the exact bits is not left for the code.
    """
    first, exact, threshold = band
    code, rest = _bits(words, first, LENGTH), _bits(words, first + LENGTH, exact) if exact else np.zeros(len(words), np.int64)
    key = lambda anchor, tail: ((np.int64(number) << 12 | anchor) << exact) | tail
    if home:
        return np.arange(len(words)), key(anchors(code, tables), rest)
    rows, keys = [], []
    for spent in range(min(threshold, exact) + 1):
        row, anchor = visited(code, threshold - spent, tables)
        for bits in combinations(range(exact), spent):
            rows.append(row)
            keys.append(key(anchor, rest[row] ^ np.int64(sum(1 << b for b in bits))))
    return np.concatenate(rows), np.concatenate(keys)


COUNTS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle: int, width: int) -> np.ndarray:
    """The hashes of the word shingles as rows of bytes.

    Words are divided by ASCII white space, A-Z in lower case; fewer words than a shingle are one shingle, none give no
    row. 64 bits are XXH64 with seed 42, one row per place; wider ones are XXH3-128 with seeds 42, 43, ..., one row per
    distinct shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, width // 8), np.uint8)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    spans = zip((ends - size)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    if width == 64:
        hash_ = xxhash.xxh64_intdigest
        return np.array([hash_(joined[a:b], 42) for a, b in spans], np.uint64).view(np.uint8).reshape(-1, 8)
    hash_, seeds = xxhash.xxh3_128_digest, range(42, 42 + width // 128)
    data = b"".join([hash_(x, s) for x in {joined[a:b] for a, b in spans} for s in seeds])
    return np.frombuffer(data, np.uint8).reshape(-1, width // 8)


def majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash as 64-bit words: a bit is set if more than half of the rows of bytes have it; no rows give zero."""
    columns = hashes.shape[1]
    votes = np.bincount((hashes + np.arange(columns) * 256).ravel(), minlength=256 * columns).reshape(columns, 256) @ COUNTS
    return np.packbits(votes.ravel() * 2 > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int, width: int) -> np.ndarray:
    """SimHash of the word shingles of a text; repeated ones vote each time for 64 bits, once for more."""
    return majority(shingle_hashes(text, shingle, width))


def word_names(width: int) -> list[str]:
    return [f"f{i}" for i in range(width // 64)]


def fingerprints(docs: DataFrame, text: str, shingle: int = 3, width: int = 64) -> DataFrame:
    """``docs`` with the words of the fingerprint in ``f0``, ``f1``, ... (as signed longs) in place of the text."""
    names = word_names(width)

    def compute(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, shingle, width) for t in batch.column(text).to_pylist()], np.uint64).reshape(-1, len(names))
        return {n: pa.array(found[:, i].view(np.int64) if len(found) else [], pa.int64()) for i, n in enumerate(np.array(names).tolist())}

    return map_rows(docs, ", ".join(f"{n} long" for n in names), compute, drop=(text,))


def links(classes: DataFrame, node: str, width: int, bands: tuple[Band, ...], most: int) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that meet at an anchor and differ in at most ``most`` bits.

    Each fingerprint has one home anchor per band and visits every anchor within covering radius plus threshold; homes
    are joined with visitors per anchor. If ``most`` bits must leave some band within its threshold, no pair is missed.
    The join compares in place and emits links only; a crowded anchor is a skewed key, which adaptive execution splits.
    Spark sizes replicas like the fingerprints they come from, a row each, and would broadcast them: so it is told to merge.
    """
    names = word_names(width)

    def spread(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = golay_tables()
            for whole in batches:
                for begin in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(begin, ROWS)
                    words = np.stack([batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1)
                    for number, band in enumerate(bands):
                        row, key = places(words, number, band, tables, home)
                        for at in range(0, len(row), 8 * ROWS):
                            index = pa.array(row[at:at + 8 * ROWS])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(key[at:at + 8 * ROWS])] + [batch.column(n).take(index) for n in [node, *names]], names=["anchor", node, *names])

        return classes.mapInArrow(run, ", ".join(["anchor long", f"{node} long", *[f"{n} long" for n in names]]))

    h, v = spread(True).hint("merge").alias("h"), spread(False).hint("merge").alias("v")
    distance = sum((F.bit_count(F.col(f"h.{n}").bitwiseXOR(F.col(f"v.{n}"))) for n in names), F.lit(0))
    return (h.join(v, (F.col("h.anchor") == F.col("v.anchor")) & (F.col(f"h.{node}") != F.col(f"v.{node}")) & (distance <= most))
            .select(F.least(f"h.{node}", f"v.{node}").alias("a"), F.greatest(f"h.{node}", f"v.{node}").alias("b")))


def simhash_components(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row: linked are fingerprints with at most 3 different bits.

    ``component_id`` is the smallest id reachable over links, the row's own included. Equal fingerprints are one class,
    found with partial aggregation, so copies cost one row per task; classes meet at anchors of a code over each half
    of the 64 bits (see ``links``), and components are found in rounds over the linked classes only.

    Defined cases: null or empty texts have fingerprint zero and are linked like any other; fewer words than a shingle
    are one shingle; each row has a result, also if it repeats an id; null ids are never a component's id unless all
    are null; an empty table gives no rows. Other columns are not read.
    """
    if most > 3:
        raise ValueError("two halves with threshold 1 cover at most 3 different bits")
    rows = stage(fingerprints(docs.select(id, text), text, shingle), "fingerprints")
    classes = stage(rows.groupBy("f0").agg(F.min(id).alias("first")), "classes")
    parts = components(links(classes.select(F.col("f0").alias("node"), "f0"), "node", 64, PAIR_OF_HALVES, most))
    joined = parts.join(classes, parts["node"] == classes["f0"]).select("node", "component", "first")
    smallest = joined.groupBy("component").agg(F.min("first").alias("least"))
    merged = joined.join(smallest, "component").select(F.col("node").alias("f0"), "least")
    known = stage(classes.join(merged, "f0", "left").select("f0", F.coalesce("least", "first").alias("component_id")), "known")
    return rows.join(known, "f0").select(id, F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


# 10 bands of 23 bits of a 256-bit fingerprint. Similar sets differ in few bits of some band.
WIDE, WIDE_BANDS = 256, tuple((23 * i, 0, 1) for i in range(10))
WIDE_MOST = 60


TILE = 20_000  # homes or visitors of an anchor that meet in one tile
STEP = 128  # homes that are compared with all visitors of a tile at once
EDGES = 2_000_000  # links of a tile that are held before they are thinned
SHINGLES = 1_000_000  # shingles of the homes or visitors of a tile whose sets are compared at once


def shortest_forest(a: np.ndarray, b: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges of a minimum spanning forest over ``n`` nodes: every component takes its shortest edge out, again and again."""
    key = length.astype(np.int64) << 40 | np.arange(len(a))
    none, part, chosen = np.iinfo(np.int64).max, np.arange(n), []
    while True:
        x, y = part[a], part[b]
        out = np.flatnonzero(x != y)
        if not len(out):
            return np.unique(np.concatenate(chosen)) if chosen else out
        best = np.full(n, none)
        np.minimum.at(best, x[out], key[out])
        np.minimum.at(best, y[out], key[out])
        pick = np.unique(best[best < none] & ((1 << 40) - 1))
        chosen.append(pick)
        while True:
            x, y = part[a[pick]], part[b[pick]]
            low = np.minimum(x, y)
            if np.array_equal(x, y):
                break
            root = np.arange(n)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            part = root[part]


def met_before(words: np.ndarray, earlier: tuple[Band, ...], tables) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which of the pairs of rows of ``words`` met at an anchor of one of the ``earlier`` bands."""
    held = []
    for first, _, threshold in earlier:
        code = _bits(words, first, LENGTH)
        low, high, errors = tables
        held.append((code, code ^ errors[low[code & 0xFFF] ^ high[code >> 12]], RADIUS + threshold))

    def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for code, nearest, reach in held:
            out |= (np.bitwise_count(code[b] ^ nearest[a]) <= reach) | (np.bitwise_count(code[a] ^ nearest[b]) <= reach)
        return out

    return met


def tile_edges(
    nodes: np.ndarray, words: np.ndarray, home: np.ndarray, most: int, earlier: tuple[Band, ...] = (), tables=None
) -> tuple[np.ndarray, np.ndarray]:
    """The shortest links that connect what homes and visitors of one tile within ``most`` bits connect.

    A pair that met at an anchor of one of the ``earlier`` bands is connected there already and left out here.
    """
    ids, place = np.unique(nodes, return_inverse=True)
    h, v = np.flatnonzero(home), np.flatnonzero(~home)
    held = [np.zeros((0, 3), np.int64)]
    before = met_before(words, earlier, tables)

    def thinned() -> np.ndarray:
        rest = np.concatenate(held)
        return rest[shortest_forest(rest[:, 0], rest[:, 1], rest[:, 2], len(ids))]

    for begin in range(0, len(h), STEP):
        rows = h[begin:begin + STEP]
        distance = np.zeros((len(rows), len(v)), np.uint16)
        for w in range(words.shape[1]):
            distance += np.bitwise_count(words[rows, w, None] ^ words[None, v, w])
        i, j = np.nonzero(distance <= most)
        x, y = place[rows[i]], place[v[j]]
        other = (x != y) & ~before(rows[i], v[j])
        held.append(np.column_stack([x, y, distance[i, j]])[other].astype(np.int64))
        if sum(map(len, held)) > EDGES:
            held = [thinned()]
    e = thinned()
    return ids[e[:, 0]], ids[e[:, 1]]


def by_tile(key: list[str], shape: str, compute: Callable[[pa.Table], pa.RecordBatch]):
    """A function for ``mapInArrow`` that gives ``compute`` all rows of each tile; they come sorted by ``key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.column_stack([batch.column(n).to_numpy() for n in key])
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if last is not None and tuple(at[begin]) != last:
                    yield compute(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = tuple(at[begin])
        if held:
            yield compute(pa.Table.from_batches(held))

    return run, shape


def meet(classes: DataFrame, node: str, width: int, bands: tuple[Band, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """Homes and visitors of each anchor with the fingerprints and the long columns ``more``, sorted by ``(anchor, tile)``.

    Those of a crowded anchor are dealt out to tiles of bounded size, every home tile against every visitor tile; the
    number of anchors is fixed by the code, so the table of their tiles has a bounded size. Bands have no exact bits.
    """
    names = word_names(width)
    carried = [node, *more, *names]
    number = len(bands) << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, seen = golay_tables(), np.zeros((2, number), np.int64)
        for batch in batches:
            for i, band in enumerate(bands):
                for home in (0, 1):
                    seen[home] += np.bincount(places(_words(batch, names), i, band, tables, bool(home))[1], minlength=number)
        used = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[1][used]), pa.array(seen[0][used])], names=["anchor", "homes", "visitors"])

    counts = classes.mapInArrow(count, "anchor long, homes long, visitors long").groupBy("anchor").agg(F.sum("homes").alias("homes"), F.sum("visitors").alias("visitors"))
    tiles = np.ones((2, number), np.int64)
    for r in counts.where((F.col("homes") > TILE) | (F.col("visitors") > TILE)).collect():
        tiles[1, r.anchor], tiles[0, r.anchor] = -(-r.homes // TILE), -(-r.visitors // TILE)
    sent = classes.sparkSession.sparkContext.broadcast(tiles)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts = golay_tables(), sent.value
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS // 10):
                batch = whole.slice(begin, ROWS // 10)
                words, ids = _words(batch, names), batch.column(node).to_numpy()
                for i, band in enumerate(bands):
                    for home in (True, False):
                        row, anchor = places(words, i, band, tables, home)
                        own, other = parts[int(home), anchor], parts[int(not home), anchor]
                        part = np.abs(ids[row]) % own
                        row, anchor, part, own = (np.repeat(x, other) for x in (row, anchor, part, own))
                        turn = np.arange(len(row)) - np.repeat(np.cumsum(other) - other, other)
                        # Tile numbers: home part times visitor parts plus visitor part.
                        tile = part * np.repeat(other, other) + turn if home else turn * own + part
                        index = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchor), pa.array(tile), pa.array(np.full(len(row), home))] + [batch.column(n).take(index) for n in carried],
                            names=["anchor", "tile", "home", *carried])

    shape = ", ".join(["anchor long", "tile long", "home boolean", *[f"{n} long" for n in carried]])
    return classes.mapInArrow(deal, shape).repartition("anchor", "tile").sortWithinPartitions("anchor", "tile")


def _words(rows: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names], axis=1)


def near_edges(classes: DataFrame, node: str, width: int, bands: tuple[Band, ...], most: int) -> DataFrame:
    """Edges ``(a, b)`` that connect the fingerprints which meet at an anchor within ``most`` bits.

    As ``links``, but a group of mutual near-copies yields the shortest edges that connect it instead of all its pairs. A
    pair counts in the first band only whose anchors it meets at.
    """
    names = word_names(width)
    tables = golay_tables()

    def edges(rows: pa.Table) -> pa.RecordBatch:
        earlier = bands[:rows.column("anchor")[0].as_py() >> 12]
        a, b = tile_edges(rows.column(node).to_numpy(), _words(rows, names), rows.column("home").to_numpy(), most, earlier, tables)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return meet(classes, node, width, bands).mapInArrow(*by_tile(["anchor", "tile"], "a long, b long", edges))


def pieces(sizes: np.ndarray, room: int) -> np.ndarray:
    """Numbers of consecutive pieces in which the sizes add up to ``room``, give or take one."""
    return (np.cumsum(sizes) - sizes) // room


def similar_edges(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], width: int, bands: tuple[Band, ...], most: int, least: float) -> DataFrame:
    """Edges ``(a, b)`` of a Jaccard similarity of at least ``least`` that connect what all such pairs connect.

    The pairs are those that meet at an anchor within ``most`` bits and are not in one ``part`` yet. ``classes`` have
    ``node``, ``part``, ``size`` (of the set) and the fingerprint; ``sets_of`` gives the sets ``s`` of nodes. A first pass
    over the tiles finds who has such a pair there. Only those bring their sets, to tiles of a bounded number of
    shingles, where every pair is compared unless confirmed edges join its ends; so no pair is left out undecided, and one
    that met in an earlier band was decided there.
    """
    names = word_names(width)
    tables = golay_tables()
    carried = ["node", "part", "size", *names]

    def candidates(h: np.ndarray, v: np.ndarray, words: np.ndarray, part: np.ndarray, size: np.ndarray, before) -> tuple[np.ndarray, np.ndarray]:
        distance = np.zeros((len(h), len(v)), np.uint16)
        for w in range(words.shape[1]):
            distance += np.bitwise_count(words[h, w, None] ^ words[None, v, w])
        i, j = np.nonzero(distance <= most)
        a, b = h[i], v[j]
        ok = (part[a] != part[b]) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        ok = ~before(a, b)
        return a[ok], b[ok]

    def opened(rows: pa.Table):
        home = rows.column("home").to_numpy()
        words = _words(rows, names)
        before = met_before(words, bands[:rows.column("anchor")[0].as_py() >> 12], tables)
        return np.flatnonzero(home), np.flatnonzero(~home), words, rows.column("part").to_numpy(), rows.column("size").to_numpy(), before

    def who(rows: pa.Table) -> pa.RecordBatch:
        h, v, words, part, size, before = opened(rows)
        used = np.zeros(len(words), bool)
        for begin in range(0, len(h), STEP):
            a, b = candidates(h[begin:begin + STEP], v, words, part, size, before)
            used[a] = used[b] = True
        h, v = h[used[h]], v[used[v]]
        p, q = pieces(size[h], SHINGLES), pieces(size[v], SHINGLES)
        n, m = (p[-1] + 1, q[-1] + 1) if len(h) else (0, 0)
        index = np.concatenate([np.repeat(h, m), np.repeat(v, n)])
        sub = np.concatenate([np.repeat(p * m, m) + np.tile(np.arange(m), len(h)), np.repeat(q, n) + np.tile(np.arange(n) * m, len(v))])
        kept = rows.select(["anchor", "tile", "home", *carried]).take(pa.array(index)).combine_chunks()
        return kept.append_column("sub", pa.array(sub, pa.int64())).to_batches()[0] if len(index) else empty

    shape = ", ".join(["anchor long", "tile long", "home boolean", *[f"{n} long" for n in carried], "sub long"])
    longs = ["anchor", "tile", *carried, "sub"]
    empty = pa.RecordBatch.from_pylist([], pa.schema([(n, pa.int64() if n in longs else pa.bool_()) for n in ["anchor", "tile", "home", *carried, "sub"]]))
    guests = stage(meet(classes, "node", width, bands, ("part", "size")).mapInArrow(*by_tile(["anchor", "tile"], shape, who)), "guests")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        h, v, words, part, size, before = opened(rows)
        nodes = rows.column("node").to_numpy()
        shingles = np.unique(np.concatenate([c.flatten().to_numpy() for c in rows.column("s").chunks]), return_inverse=True)[1]
        begins = np.cumsum(size) - size
        part = np.unique(part, return_inverse=True)[1]
        mark, found = np.zeros(len(shingles) + 1, bool), []
        for begin in range(0, len(h), STEP):
            a, b = candidates(h[begin:begin + STEP], v, words, part, size, before)
            cuts = np.searchsorted(a, h[begin:begin + STEP + 1])
            for x, y in ((x, b[lo:hi]) for x, lo, hi in zip(h[begin:begin + STEP], cuts, [*cuts[1:], len(a)]) if lo < hi):
                own = shingles[begins[x]:begins[x] + size[x]]
                mark[own] = True
                for some in np.split(y, np.flatnonzero(np.diff(pieces(size[y], SHINGLES))) + 1):
                    some = some[part[some] != part[x]]
                    if not len(some):
                        continue
                    starts = np.cumsum(size[some]) - size[some]
                    at = np.repeat(begins[some] - starts, size[some]) + np.arange(size[some].sum())
                    both = np.add.reduceat(mark[shingles[at]], starts, dtype=np.int64)
                    some = some[both >= least * (size[x] + size[some] - both)]
                    joined, first = np.unique(part[some], return_index=True)
                    found += [(nodes[x], nodes[z]) for z in some[first]]
                    if len(joined):
                        part[np.isin(part, joined)] = part[x]
                mark[own] = False
        e = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e.min(axis=1)), pa.array(e.max(axis=1))], names=["a", "b"])

    met = guests.join(sets_of(guests), "node").repartition("anchor", "tile", "sub").sortWithinPartitions("anchor", "tile", "sub")
    return met.mapInArrow(*by_tile(["anchor", "tile", "sub"], "a long, b long", compare))


def members(hashes: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of the rows that ``shingle_hashes`` gives for wide fingerprints."""
    return np.unique(np.ascontiguousarray(hashes[:, :8]).view(np.int64).ravel())


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles in order."""
    return members(shingle_hashes(text, shingle, 128))


def set_prints(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` with the wide fingerprint, a 128-bit hash ``s0``, ``s1`` of the shingle set and its ``size`` in place of the text."""
    names = word_names(WIDE)

    def compute(batch: pa.RecordBatch) -> dict:
        prints, keys, sizes = [], [], []
        for t in batch.column(text).to_pylist():
            hashes = shingle_hashes(t, shingle, WIDE)
            held = members(hashes)
            prints.append(majority(hashes))
            keys.append(xxhash.xxh3_128_digest(held.tobytes(), 42))
            sizes.append(len(held))
        found = np.array(prints, np.uint64).reshape(-1, len(names)).view(np.int64)
        key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        columns = {n: pa.array(found[:, i]) for i, n in enumerate(names)} | {n: pa.array(key[:, i]) for i, n in enumerate(("s0", "s1"))}
        return columns | {"size": pa.array(sizes, pa.int64())}

    return map_rows(docs, ", ".join(f"{n} long" for n in [*names, "s0", "s1", "size"]), compute, drop=(text,))


def _similar(least: float):
    def compute(batch: pa.RecordBatch) -> dict:
        out = []
        x, y = batch.column("sa"), batch.column("sb")
        for p, q in zip(x, y):
            p, q = p.values.to_numpy(), q.values.to_numpy()
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= least * (len(p) + len(q) - both))
        return {"similar": pa.array(out, pa.bool_())}

    return compute


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without near-copies: of each group one row stays, that with the smallest id.

    Groups are components of pairs whose sets of five-word shingles have a Jaccard similarity of at least ``least``.
    Candidates meet at Golay anchors of ten bands of a 256-bit SimHash and differ in at most 60 bits (such pairs of
    similarity 0.8 differ in 39 on average, with a deviation of 6). First the shortest edges of the first band are compared
    exactly, which joins most of a crowd of near-copies; then every candidate pair whose ends are not joined by confirmed
    edges yet (see ``similar_edges``). A lone pair of similarity 0.8 is missed by all ten bands about once in thirty; more
    similar pairs more rarely.

    Equal sets are one class, known by 128 bits of hash; different sets with one fingerprint are candidates like others.
    Only classes in a candidate pair have their sets built. Defined cases: null and
    empty texts are equal to each other; repeated rows are copies; rows without id stay only if no row of their group
    has one; an empty table gives no rows; columns are kept as they are.
    """
    names = word_names(WIDE)
    text_hash_of = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    given = docs.select(F.col(id).alias("__id"), text_hash_of(F.col(text)).alias("__text"), F.col(text).alias("__words"))
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__text").alias("text")))
    classes = set_prints(given, "__words", shingle).groupBy("s0", "s1", "size", *names).agg(first.alias("of"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The set of each node, from one text of its class."""
        wanted = nodes.select("node").distinct().join(classes, "node").select("node", F.col("of.id").alias("__of"), F.col("of.text").alias("__text"))
        texts = given.join(wanted, (given["__text"] == wanted["__text"]) & given["__id"].eqNullSafe(wanted["__of"])).select("node", "__words").dropDuplicates(["node"])
        return stage(map_rows(
            texts, "s array<long>", lambda b: {"s": pa.array([shingle_set(t, shingle) for t in b.column("__words").to_pylist()], pa.list_(pa.int64()))},
            drop=("__words",)), "sets")

    def joined(edges: DataFrame) -> DataFrame:
        return classes.join(components(edges), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    # Crowds of near-copies come together by their shortest edges.
    pairs = stage(near_edges(classes, "node", WIDE, WIDE_BANDS[:1], WIDE_MOST).distinct(), "candidates")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"))
    short = stage(map_rows(full, "similar boolean", _similar(least), drop=("sa", "sb")).where("similar").select("a", "b"), "short")
    # All other pairs.
    others = similar_edges(stage(joined(short), "parts"), sets_of, WIDE, WIDE_BANDS, WIDE_MOST, least)

    keep = joined(short.unionByName(others)).groupBy("part").agg(F.min("of").alias("k"))
    keep = keep.select(F.col("k.id").alias("__keep"), F.col("k.text").alias("__text"))
    kept = pack(docs, id).withColumn("__text", text_hash_of(F.col(id if text == id else f"{REST}.`{text}`")))
    kept = kept.join(keep, (kept["__text"] == keep["__text"]) & kept[id].eqNullSafe(keep["__keep"]), "left_semi")
    return unpack(kept.dropDuplicates([id, "__text"]), docs.columns)
