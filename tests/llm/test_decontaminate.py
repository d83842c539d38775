import random
import re

from plumbline.llm.decontaminate import find_overlaps

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(text, items, window):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        q = words(t)
        if i is None or not q:
            continue
        size = min(window, len(q))
        for j in range(len(q) - size + 1):
            for p in range(len(w) - size + 1):
                if w[p:p + size] == q[j:j + size]:
                    hit.update(range(p, p + size))
                    found.add(str(i))
    return len(w), hit, sorted(found)


def check(spark, documents, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string, spans string")
    docs = documents(rows).repartition(3)
    out = find_overlaps(docs, bench, window=4, **options).collect()
    assert len(out) == len(rows)
    by = {i: t for i, t in rows}
    for r in out:
        n, hit, found = brute(by[r.doc_id], [x[:2] for x in items], 4)
        assert r.n_words == n and r["items"] == found
        assert {p for a, b in zip(r.spans[::2], r.spans[1::2]) for p in range(a, b)} == hit
        if found:
            assert r.longest >= min(4, min(len(words(t)) for i, t, _ in items if str(i) in found))
    return out


def test_random_texts(spark, documents):
    rng = random.Random(11)
    vocabulary = ["a", "b", "C", "é", "x1", "ünder", "long-er", "d"]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, some(rng.randint(1, 9)), None) for i in range(12)] + [(3, some(6), None), (50, None, None), (51, " .,", None), (None, "a", None)]
    rows = [(i, some(rng.randint(0, 80)) + rng.choice(["", "\n", " — "])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a " * 3000), (203, " ".join(t for _, t, _ in items[:5]))]
    check(spark, documents, rows, items)
    check(spark, documents, rows, items, shard_bytes=200, block_bytes=40)


def test_long_windows_only(spark, documents):
    items = [(1, "one two three four five six", None), (10, "q r s t", None), (2, "three four five six seven", None)]
    rows = [(1, "x One, two THREE four y"), (2, "three four five six"), (3, "one two three"), (4, "q r s t q r s t")]
    out = {r.doc_id: r for r in check(spark, documents, rows, items)}
    assert out[2]["items"] == ["1", "2"] and out[4].spans == [0, 8] and out[1].longest == 4 and out[1].longest_at == 1


def test_empty_tables(spark, documents):
    check(spark, documents, [(1, "a b c d e")], [])
    check(spark, documents, [], [(1, "a b c d e", None)])
