import random
from collections import Counter

import numpy as np

from plumbline.llm.suffix_dedup import drop_repeated_strings
from plumbline.llm.suffixes import repeated_starts, suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        n, k = rng.randint(1, 60), rng.randint(1, 4)
        s = [rng.randint(1, k) for _ in range(n)] + [0]
        assert suffix_array(np.array(s, np.int16), 6).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(200):
        pieces = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        length = rng.randint(1, 8)
        count = Counter(p[i:i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[count[p[i:i + length]] > 1 for i in range(len(p) - length + 1)] for p in pieces]
        assert [x.tolist() for x in repeated_starts(pieces, length)] == want


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and (not i or not gone[i - 1]) for i in range(len(d)))
        out.append((bytes(c for c, g in zip(d, gone) if not g), len(d), sum(gone), spans))
    return out


def rows_of(rng):
    some = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = [some(n) for n in (150, 170, 130, 400, 128, 220)]
    texts = [None, "", "short", "ab" * 300, "x" * 1000, some(3000)]
    for _ in range(60):
        texts.append("".join(rng.choice([some(rng.randint(0, 200)), rng.choice(shared)[rng.randint(0, 20):]]) for _ in range(rng.randint(1, 6))))
    return [(i, t) for i, t in enumerate(texts + texts[10:14] + [texts[5][500:900]])] + [(3, "other text of a repeated id" * 9), (None, texts[20]), (None, "no id " * 40), (20, texts[20])]


def check(spark, documents, rows, **options):
    got = drop_repeated_strings(documents(rows).repartition(5), length=128, **options).collect()
    want = sorted(((i or -1, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 128))), key=repr)
    have = sorted(((r.doc_id or -1, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got), key=repr)
    assert have == want


def test_whole_table(spark, documents):
    check(spark, documents, rows_of(random.Random(3)))


def test_small_shards_and_crowds(spark, documents):
    check(spark, documents, rows_of(random.Random(4)), shard=300, crowd=3, max_bits=1 << 16)


def test_empty(spark, documents):
    assert drop_repeated_strings(documents([])).collect() == []
    assert drop_repeated_strings(documents([(1, "a")])).first().kept == b"a"
