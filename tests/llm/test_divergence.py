"""Source divergence against its definition, with runs that are spilled early and shards that are merged."""

import random
import re

import numpy as np
import pytest

from plumbline.llm.divergence import Index, distance, share, source_divergence, term_frequencies, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, value string"


def brute(rows, min_docs, top):
    docs, counts, groups = {}, {}, set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)
        groups.add((lang, source))
        for t in set(terms):
            docs[lang, t] = docs.get((lang, t), 0) + 1
        for t in terms:
            counts[lang, source, t] = counts.get((lang, source, t), 0) + 1
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        p = {}
        for s in [None, *sources]:
            n = {t: sum(counts.get((lang, x, t), 0) for x in (sources if s is None else [s])) for t in kept}
            below = sum(n.values()) + 2 * len(kept)
            p[s] = {t: (1 + 10**9 * (n[t] + 2) // below, n[t]) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t][0], p[o][t][0]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t][0], p[None][t][0])) for t in kept if p[s][t][1] and p[s][t][0] > p[None][t][0]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(found) if part == "pair" or r < top]
    return sorted(out)


def cases(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "ÉCOLE", "zeta", "x", "don't", "日本", "a1b", "_", "  ", "\n", "\x7f"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "b", "ü", None, "hot", "hot", "hot"]), "x") for i in range(250)]
    rows += [(900, None, "en", "silent", "x"), (901, "", "mute", "s1", "x"), (902, "...", "mute", "s2", "x"), (903, "only here", "solo", "s", "x")]
    return rows + [(7, "the same row", "en", "a", "x")] * 5 + [(None, "the " * 20_000 + "qq " * 5, "en", "long", None)]


@pytest.mark.parametrize("entries,shards", [(40, 3), (1000, 1), (600_000, None)])
def test_equals_the_definition(spark, entries, shards):
    rows = cases(entries)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = source_divergence(docs, min_docs=4, top=3, entries=entries, shards=shards)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 4, 3)


def test_frequencies(spark):
    docs = spark.createDataFrame([(1, "b a A", "en", "s", ""), (2, "a", "en", "t", ""), (3, "c", "en", "s", "")], SCHEMA).repartition(3)
    got = {(r.lang, r.term): (r.docs, dict(zip(r.sources, r.counts))) for r in term_frequencies(docs, min_docs=2).collect()}
    assert got == {("en", ""): (0, {"s": 0, "t": 0}), ("en", "a"): (2, {"s": 2, "t": 1})}


def test_no_rows_and_no_frequent_terms(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "x", "en", "s", ""), (2, "y", "en", "t", "")], SCHEMA)
    assert sorted(tuple(r) for r in source_divergence(docs).collect()) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_of_huge_counts_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randint(2, 9 * 10**15)
        n = rng.randint(0, total)
        p = share(np.array([n]), np.array([total]))[0]
        assert p == 1 + 10**9 * n // total
        assert distance(p, np.int64(1)) == (int(p) - 1) ** 2 // (int(p) + 1)


def test_terms_and_runs():
    assert terms_of("Don't ÉCOLE éa1B\x7fzz@Q") == [b"don", b"t", "École".replace("É", "É").encode()[:2] + b"cole", "éa".encode(), b"b", b"zz", b"q"]
    index = Index()
    for i in range(50):
        index.add("en", f"s{i % 3}", f"a b{i} w")
    blocks = [b for batch in index.spill(4) for b in batch.to_pylist()]
    assert all(b["terms"] == sorted(b["terms"]) and b["first"] == b["terms"][0] for b in blocks)
    assert index.entries() == 0 and len({b["shard"] for b in blocks}) > 1
