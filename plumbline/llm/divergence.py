"""How far the sources of a language are apart in their words: term frequencies by single-pass in-memory indexing.

Each task indexes documents in memory (counts per group and term, documents per term). When the index is full it is
spilled as a run: blocks of terms in ascending order, one sequence of blocks per hash shard. The blocks of a shard meet
in one task in the order of their first terms, and a heap merges them; it holds at most one open block per run. What
comes out is a row per term with its counts in all sources, from which pairs of sources are corrected term by term.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import stage

ENTRIES = 600_000  # postings that an index holds before it is spilled
BLOCK = 5_000  # terms per block of a run
PAIRS = 1_000_000  # pairs of counts that are computed at once
SCALE = 1_000_000_000

# Letters A to Z become small; what cannot be part of a term becomes a space. Bytes from 128 on belong to terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))

RUN = "shard int, run string, lang string, first binary, terms array<binary>, docs array<bigint>, sizes array<int>, names array<string>, sources array<int>, counts array<bigint>"
RUN_TYPES = [
    pa.int32(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()),
    pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()),
]
RUN_SCHEMA = pa.schema([(part.split()[0], t) for part, t in zip(RUN.split(", "), RUN_TYPES)])


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


class Index:
    """Postings of documents in memory: counts per (language, source) and documents per language."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[str, Counter] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        terms = terms_of(text)
        self.counts.setdefault((lang, source), Counter()).update(terms)
        self.docs.setdefault(lang, Counter()).update(set(terms))

    def entries(self) -> int:
        return sum(map(len, self.counts.values())) + sum(map(len, self.docs.values()))

    def spill(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The run of this index. The empty term, which no text holds, stands for the groups that occur."""
        run = uuid.uuid4().hex
        for lang in sorted(self.docs):
            docs = self.docs[lang]
            names = sorted(s for g, s in self.counts if g == lang)
            postings: dict[bytes, list[tuple[int, int]]] = {b"": [(i, 0) for i in range(len(names))]}
            for i, s in enumerate(names):
                for term, n in self.counts[lang, s].items():
                    postings.setdefault(term, []).append((i, n))
            by_shard: dict[int, list[bytes]] = {}
            seed = zlib.crc32(lang.encode())
            for term in sorted(postings):
                by_shard.setdefault(zlib.crc32(term, seed) % shards, []).append(term)
            rows = []
            for shard, terms in by_shard.items():
                for i in range(0, len(terms), BLOCK):
                    part = terms[i:i + BLOCK]
                    flat = [x for t in part for x in postings[t]]
                    rows.append((
                        shard, run, lang, part[0], part, [docs.get(t, 0) for t in part], [len(postings[t]) for t in part],
                        names, [s for s, _ in flat], [n for _, n in flat]))
                    if len(rows) >= 64:
                        yield _run_batch(rows)
                        rows = []
            if rows:
                yield _run_batch(rows)
        self.counts.clear()
        self.docs.clear()


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RUN_TYPES)], schema=RUN_SCHEMA)


def build_runs(docs: DataFrame, text: str, lang: str, source: str, shards: int, entries: int) -> DataFrame:
    """The runs of all documents, spilled whenever an index holds ``entries`` postings and at the end of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, since = Index(), 0
        for b in batches:
            for language, site, body in zip(*(c.to_pylist() for c in b.columns)):
                index.add(language, site, body)
                since += len(body) + 100
                if since >= entries:  # no text adds more postings than it has characters
                    since = index.entries()
                    if since >= entries:
                        yield from index.spill(shards)
                        since = 0
        yield from index.spill(shards)

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)]
    return docs.select(*[c.alias(n) for c, n in zip(plain, ("lang", "source", "text"))]).mapInArrow(run, RUN)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int, dict[str, int]]]:
    """Terms in ascending order with all their counts, from blocks in the order of their first terms."""
    heap: list[tuple] = []

    def entries(block: dict) -> Iterator[tuple[bytes, int, list, list]]:
        at = 0
        for term, docs, size in zip(block["terms"], block["docs"], block["sizes"]):
            yield term, docs, [block["names"][s] for s in block["sources"][at:at + size]], block["counts"][at:at + size]
            at += size

    def drain(until: tuple | None) -> Iterator[tuple]:
        while heap and (until is None or heap[0][0] < until):
            key, serial, entry, rest = heap[0]
            following = next(rest, None)
            if following is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, ((*key[:2], following[0]), serial, following, rest))
            yield key, entry

    def opened() -> Iterator[tuple]:
        serial = 0
        for b in batches:
            for i in range(b.num_rows):
                block = {n: b.column(n)[i].as_py() for n in b.schema.names}
                key = (block["shard"], block["lang"].encode(), block["first"])
                yield from drain(key)
                rest = entries(block)
                heapq.heappush(heap, (key, serial, next(rest), rest))
                serial += 1
        yield from drain(None)

    for (_, lang, term), group in groupby(opened(), key=lambda x: x[0]):
        docs, counts = 0, {}
        for _, (_, n, sources, numbers) in group:
            docs += n
            for s, c in zip(sources, numbers):
                counts[s] = counts.get(s, 0) + c
        yield lang.decode(), term, docs, counts


def term_frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10,
                     shards: int | None = None, entries: int = ENTRIES) -> DataFrame:
    """``(lang, term, docs, sources, counts)`` of the terms that at least ``min_docs`` documents of a language hold.

    Rows with the empty term list the groups of a language that occur, also those whose documents have no terms.
    Only postings of runs are shuffled: a term that every document holds is one posting per run and source.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = build_runs(docs, text, lang, source, shards, entries)
    order = ["shard", F.encode("lang", "utf-8"), "first"]
    sorted_ = runs.repartition(shards, "shard").sortWithinPartitions(*order)
    out = [("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for language, term, n, counts in _merged(batches):
            if n < min_docs and term:
                continue
            names = sorted(counts)
            rows.append((language, term.decode(), n, names, [counts[s] for s in names]))
            size += 1 + len(names)
            if size >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), out)], schema=pa.schema(out))
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), out)], schema=pa.schema(out))

    return sorted_.mapInArrow(merge, "lang string, term string, docs long, sources array<string>, counts array<long>")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for 0 <= count <= total, by long division so that nothing overflows."""
    left, out = np.asarray(count, np.int64), 0
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Groups:
    """The groups of all languages as arrays: totals and vocabularies, and where each language begins."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        rows = sorted(rows)
        self.lang, self.source = [r[0] for r in rows], [r[1] for r in rows]
        self.total = np.array([r[2] + 2 * r[3] for r in rows], np.int64)  # N + 2V
        self.terms = np.array([r[3] for r in rows], np.int64)
        self.number = {r[:2]: i for i, r in enumerate(rows)}
        self.span: dict[str, tuple[int, int]] = {}
        for i, r in enumerate(rows):
            self.span[r[0]] = (self.span.get(r[0], (i, i))[0], i + 1)
        self.lang_total = {g: int((self.total[a:b] - 2 * self.terms[a:b]).sum() + 2 * self.terms[a]) for g, (a, b) in self.span.items()}
        self.rest = share(np.full(len(rows), 2), np.maximum(self.total, 2)) if rows else np.zeros(0, np.int64)  # of a term that is not there


def _sums(a: np.ndarray, b: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact sums of ``value`` by (a, b)."""
    code = a * n + b
    order = np.argsort(code, kind="stable")
    code, first = np.unique(code[order], return_index=True)
    return code // n, code % n, np.add.reduceat(value[order], first) if len(first) else value[:0]


PAIR = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def _corrections(groups: Groups, owner: np.ndarray, count: np.ndarray, row: np.ndarray) -> Iterator[tuple]:
    """For all pairs of sources that share a term: what both counts change against one of them at a time."""
    p = share(count + 2, groups.total[owner])
    last = np.searchsorted(row, row, "right")  # entries of a term lie together
    later = last - np.arange(len(row)) - 1
    upto = np.cumsum(later)
    begin = 0
    while begin < len(row):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        n = later[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        a, b = owner[i], owner[j]
        pa_, pb, qa, qb = p[i], p[j], groups.rest[a], groups.rest[b]
        if len(i):
            yield _sums(a, b, distance(pa_, pb) - distance(pa_, qb) - distance(qa, pb) + distance(qa, qb), len(groups.rest))
        begin = end


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10,
                      shards: int | None = None, entries: int = ENTRIES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of all pairs of sources of a language and their typical terms.

    With p = 1 + floor(10^9 (count + 2) / (N + 2V)) and the distance floor((p - q)^2 / (p + q)): part ``pair`` sums it
    over the V terms of the language for each other source; part ``term`` has the ``top`` terms whose p is above that
    of the whole language. All sums are exact integers. A pair's sum is that of two sources that hold no term at all,
    plus what each source's counts change (from the histogram of its counts), plus corrections for terms that both hold;
    the latter are streamed from the merged rows in pieces of ``PAIRS`` and combined per task before the shuffle. The
    groups are broadcast: the result has their number squared as rows per language, so they are the lesser part of it.

    Defined cases: null text, language or source is empty; groups whose documents hold no term take part; a language
    without frequent terms gives pairs of value 0; a source alone in its language has no pairs; repeated rows count
    as documents of their own; no rows give none. Other columns are not read.
    """
    spark = docs.sparkSession
    terms = stage(term_frequencies(docs, text, lang, source, min_docs, shards, entries), "terms")
    each = terms.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    histogram = stage(each.groupBy("lang", "source", "n").agg(F.count("*").alias("times")), "counts")
    size = {r.lang: r.n for r in terms.where("term <> ''").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    totals = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total")).collect()
    held = Groups([(r.lang, r.source, r.total, size.get(r.lang, 0)) for r in totals])
    shared = spark.sparkContext.broadcast(held)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the counts of one source change against sources without them, both ways."""
        groups = shared.value
        for b in batches:
            for language, site, n, times in zip(*(c.to_pylist() for c in b.columns)):
                a = groups.number[language, site]
                first, end = groups.span[language]
                others = np.concatenate([np.arange(first, a), np.arange(a + 1, end)])
                q = groups.rest[others]
                value = times * (distance(share(n + 2, groups.total[a:a + 1]), q) - distance(groups.rest[a], q))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), a), pa.int32()), pa.array(others, pa.int32()), pa.array(value)], schema=PAIR)

    def entries_of(b: pa.RecordBatch, groups: Groups) -> tuple:
        """Per count of a batch of terms: group, count, row; and per row the language and the count in all of it."""
        lists = b.column("sources")
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), sizes)
        langs, names = b.column("lang").dictionary_encode(), lists.flatten().dictionary_encode()
        table = np.array([[groups.number.get((g, s), -1) for s in names.dictionary.to_pylist()] for g in langs.dictionary.to_pylist()], np.int64)
        owner = table[langs.indices.to_numpy()[row], names.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
        count = b.column("counts").flatten().to_numpy()
        total = np.add.reduceat(count, np.cumsum(sizes) - sizes) if len(row) else count
        return owner, count, row, total, langs

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, n = shared.value, [], 0

        def combined(parts: list) -> tuple:
            return _sums(*map(np.concatenate, zip(*parts)), len(groups.rest))

        def batch(parts: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int32()), pa.array(parts[1], pa.int32()), pa.array(parts[2])], schema=PAIR)

        for b in batches:
            owner, count, row, _, _ = entries_of(b, groups)
            for part in _corrections(groups, owner, count, row):
                held.append(part)
                n += len(part[0])
                if n >= 4 * PAIRS:
                    held = [combined(held)]
                    n = len(held[0][0])
                    if n >= 2 * PAIRS:
                        yield batch(held[0])
                        held, n = [], 0
        if held:
            yield batch(combined(held))

    def typical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts whose share is above the language's; per batch and group only those as far off as the last of ``top``."""
        groups = shared.value
        for b in batches:
            owner, count, row, total, langs = entries_of(b, groups)
            whole = np.array([groups.lang_total[g] for g in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
            p, q = share(count + 2, groups.total[owner]), share(total + 2, whole)[row]
            at = np.flatnonzero(p > q)
            value = distance(p[at], q[at])
            order = np.lexsort((-value, owner[at]))
            at, value = at[order], value[order]
            first = np.searchsorted(owner[at], owner[at], "left")
            bar = value[np.minimum(first + top, np.searchsorted(owner[at], owner[at], "right")) - 1]
            keep = value >= bar
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[at][keep], pa.int32()), b.column("term").take(pa.array(row[at][keep])), pa.array(value[keep])], names=["a", "item", "value"])

    real = terms.where("term <> ''")
    one = histogram.where("n > 0").select("lang", "source", "n", "times").mapInArrow(alone, "a int, b int, value long")
    two = real.select("lang", "sources", "counts").mapInArrow(both, "a int, b int, value long")
    half = one.unionByName(two)
    sums = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = spark.createDataFrame(
        [(i, g, s, int(held.rest[i]), int(held.terms[i])) for i, (g, s) in enumerate(zip(held.lang, held.source))], "a int, lang string, source string, p long, v long")
    other = names.select(F.col("a").alias("b"), "lang", F.col("source").alias("item"), F.col("p").alias("q"))
    empty = names.join(other, "lang").where("a <> b").select("a", "b", F.expr("v * ((p - q) * (p - q) div (p + q))").alias("value"))
    pairs = sums.unionByName(empty).groupBy("a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.join(names.select("a", "lang", "source"), "a").join(other.select("b", "item"), "b")
    of = Window.partitionBy("a").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(of)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    found = real.select("lang", "term", "sources", "counts").mapInArrow(typical, "a int, item string, value long")
    found = found.withColumn("rank", F.row_number().over(of)).where(F.col("rank") <= top).join(names.select("a", "lang", "source"), "a")
    return pairs.unionByName(found.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
