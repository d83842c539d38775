import random
import re

import numpy as np
import xxhash

from plumbline.llm.common import components
from plumbline.llm.simhash import (
    LENGTH, PAIR_OF_HALVES, anchors, drop_near_duplicates, fingerprint, golay_tables, places, simhash_components,
)


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def smallest_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges + [(None, 3)], "a long, b long").repartition(7)
    real = [(a, b) for a, b in edges if a != b]
    want = smallest_reachable({x for e in real for x in e}, real)
    assert {r.node: r.component for r in components(frame).collect()} == want
    assert components(frame.limit(0)).collect() == []


def test_golay_code_is_perfect_and_halves_cover():
    tables = golay_tables()
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << LENGTH, 500)
    assert len(np.unique(anchors(np.arange(1 << LENGTH), tables))) == 1 << 12
    near = words ^ (1 << rng.integers(0, LENGTH, 500))
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)[:, None]
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3000, 3)).astype(np.uint64), axis=1)[:, None]
    met = np.zeros(3000, bool)
    for number, band in enumerate(PAIR_OF_HALVES):
        _, home = places(x, number, band, tables, True)
        rows, keys = places(x ^ flips, number, band, tables, False)
        met[rows[keys == home[rows]]] = True
    assert met.all() and len(near) == 500


def test_fingerprints():
    for t in [None, "", " \n", "one", "One two", "a b c", "É b c d\x0be f\x1cg", "x " * 50, "日本 語 text more words here"]:
        assert int(fingerprint(t, 3, 64)[0]) == plain_fingerprint(t)


def test_replicas_are_not_broadcast(spark):
    from plumbline.llm.simhash import links
    from plumbline.session import stage

    classes = stage(spark.range(1, 5000).selectExpr("id as node", "xxhash64(id) as f0"))
    met = links(classes, "node", 64, PAIR_OF_HALVES, 3)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    near = spark.createDataFrame([(1, 0), (2, 1), (3, 1 << 40), (4, -1)], "node long, f0 long")
    assert {tuple(r) for r in links(near, "node", 64, PAIR_OF_HALVES, 3).distinct().collect()} == {(1, 2), (1, 3), (2, 3)}


def variants(rng, n):
    base = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(4)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice("xyz") * 3
        out.append(" ".join(w))
    return out


def test_simhash_components(spark, documents):
    rng = random.Random(4)
    texts = [None, "", " ", "one", "two words", "ONE"] + variants(rng, 120)
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)] + [(3, "repeated id"), (13, "")]
    fp = {}
    for i, t in rows:
        fp.setdefault(plain_fingerprint(t), []).append(i)
    prints = list(fp)
    edges = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]
    root = smallest_reachable(prints, edges)
    least = {}
    for p in prints:
        least[root[p]] = min(least.get(root[p], 10**9), min(fp[p]))
    want = sorted((i, f"{plain_fingerprint(t):016x}", least[root[plain_fingerprint(t)]]) for i, t in rows)
    got = simhash_components(documents(rows).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == want and len(edges) > 5
    assert simhash_components(documents([])).collect() == []


def jaccard(a, b):
    s = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_drop_near_duplicates(spark, documents):
    rng = random.Random(9)
    texts = variants(rng, 100) + ["short text", "short text", "", "unlike " + " ".join(str(i) for i in range(90))]
    rows = list(enumerate(texts)) + [(50, texts[50]), (None, texts[3]), (900, None), (None, "only here without id")]
    docs = documents(rows).repartition(3)
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept))
    ids = list(range(len(texts)))
    edges = [(a, b) for a in ids for b in ids[:a] if jaccard(texts[a], texts[b]) >= 0.8]
    root = smallest_reachable(ids, edges)
    want = {i for i in ids if root[i] == i}
    assert {i for i, _ in kept if i is not None} == want and (None, "only here without id") in kept and len(kept) == len(want) + 1
    assert drop_near_duplicates(documents([])).collect() == []


def test_shortest_edges_connect_what_all_links_connect(spark, monkeypatch):
    import plumbline.llm.simhash as sh

    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 62), 1 << 62, (6, 4))
    rows = []
    for i in range(300):
        f = base[i % 6].copy().view(np.uint64)
        for bit in rng.choice(256, rng.integers(0, 20), replace=False):
            f[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        rows.append((i + 1, *map(int, f.view(np.int64))))
    classes = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long").repartition(3)
    nodes = [r[0] for r in rows]
    pairs = [(r.a, r.b) for r in sh.links(classes, "node", 256, sh.WIDE_BANDS, 40).collect()]
    want = smallest_reachable(nodes, pairs)
    plain = [(r.a, r.b) for r in sh.near_edges(classes, "node", 256, sh.WIDE_BANDS, 40).collect()]
    assert set(plain) <= set(pairs) and smallest_reachable(nodes, plain) == want
    monkeypatch.setattr(sh, "TILE", 7)
    monkeypatch.setattr(sh, "EDGES", 10)
    tiled = [(r.a, r.b) for r in sh.near_edges(classes, "node", 256, sh.WIDE_BANDS, 40).collect()]
    assert set(tiled) <= set(pairs) and smallest_reachable(nodes, tiled) == want


def kept_ids(docs):
    return {r.doc_id for r in drop_near_duplicates(docs).collect()}


def test_repetition_does_not_hide_equal_sets(spark, documents):
    rng = random.Random(11)
    rows = []
    for i in range(0, 40, 2):
        line, rest = (" ".join(str(rng.random()) for _ in range(n)) for n in (12, 300))
        rows += [(i, f"{line} {rest}"), (i + 1, " ".join([line] * 100 + [rest]))]
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.95 for i in range(0, 40, 2))
    assert kept_ids(documents(rows)) == set(range(0, 40, 2))


def test_equal_fingerprints_are_compared(spark, documents, monkeypatch):
    import plumbline.llm.simhash as sh

    rng = random.Random(12)
    filler = [(i, " ".join(["."] * 2000 + [str(rng.random()) for _ in range(60)])) for i in range(6)]
    assert kept_ids(documents(filler)) == set(range(6))
    # Whatever the texts: one fingerprint for all.
    plain = [(i, " ".join(str(rng.random()) for _ in range(60))) for i in range(5)]
    copy = (9, plain[3][1] + " one more")
    monkeypatch.setattr(sh, "majority", lambda hashes: np.zeros(hashes.shape[1] // 8, np.uint64))
    assert kept_ids(documents(plain + [copy])) == set(range(5))


def test_crowd_around_the_limit(spark, documents, monkeypatch):
    import plumbline.llm.simhash as sh

    rng = random.Random(13)
    rows = []
    for g in range(4):
        base = [str(rng.random()) for _ in range(300)]
        for i in range(60):
            w = list(base)
            for _ in range(rng.randint(3, 9)):
                w[rng.randrange(len(w))] = str(rng.random())
            rows.append((100 * g + i, " ".join(w)))
    rng.shuffle(rows)
    text = dict(rows)
    prints = [(i, *map(int, fingerprint(t, 5, 256).view(np.int64))) for i, t in rows]
    classes = spark.createDataFrame(prints, "node long, f0 long, f1 long, f2 long, f3 long").repartition(3)
    met = {(r.a, r.b) for r in sh.links(classes, "node", 256, sh.WIDE_BANDS, sh.WIDE_MOST).collect()}
    edges = [(a, b) for a, b in met if jaccard(text[a], text[b]) >= 0.8]
    root = smallest_reachable(list(text), edges)
    want = {i for i in text if root[i] == i}
    assert 20 < len(want) < len(text) - 20 and len(edges) * 5 < len(met)
    assert kept_ids(documents(rows)) == want
    monkeypatch.setattr(sh, "TILE", 9)
    monkeypatch.setattr(sh, "SHINGLES", 1000)
    assert kept_ids(documents(rows)) == want
