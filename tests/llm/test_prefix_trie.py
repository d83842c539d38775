"""The prefix trie against a dictionary of prefixes, cut in small bands, shards and limits."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from plumbline.llm.prefix_trie import SlotTable, ends_digest, number_turns, prefix_trie, splice_heads

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def rebuilt(rows, splice):
    own = {}
    for c, turn, role, text, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if not splice:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - int(np.fmod(c, 5)), [])[:h[c]] + v[h[c]:] for c, v in own.items()}


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = {}, {}
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    pool = [("user", "hello"), ("assistant", "hi é"), ("user", None), (None, "x" * 300), ("user", ""), ("usera", ""), ("user", "a")]
    rows = []
    for c in [*range(-12, 40), *range(60, 90, 3), 10**15]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            role, text = rng.choice(pool[:2] if t < 3 else pool)
            rows.append((c, rng.choice([t, t, t, None]), role, text, "z"))
    rows += [(500, t // 2, "user", f"turn {t % 3}", "z") for t in range(60)]  # a long conversation, with ties
    rows += [(c, t, "user", "same", "z") for c in range(600, 640) for t in range(3)] + [(7, 1, "user", "again", "z")] * 4
    return rows + [(None, 1, "user", "nobody", "z")]


def answer(spark, rows, splice, **how):
    turns = number_turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
    parts = splice_heads(turns) if splice else (turns, turns.select("conv_id"))
    nodes, ends = prefix_trie(*parts, **how)
    digests = {bytes(r.node): r.ends_sha256 for r in ends_digest(ends).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, digests.get(bytes(r.node), nothing)) for r in nodes.collect()], key=repr)


@pytest.mark.parametrize("how", [{}, {"limit": 3, "band": 20, "shard": 20}])
def test_equals_the_definition(spark, how):
    rows = conversations(len(how))
    for splice in (False, True):
        assert answer(spark, rows, splice, **how) == brute(rebuilt(rows, splice))


def test_conversation_over_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(1, t, "user", f"turn {t % 5}", "z") for t in range(300)] + [(0, 0, "user", "turn 0", "z"), (2, 0, "user", "turn 0", "z"), (2, 1, "user", "b", "z")]
        assert answer(spark, rows, False, band=100) == brute(rebuilt(rows, False))
        assert answer(spark, rows, True) == brute(rebuilt(rows, True))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_few_rows(spark):
    assert answer(spark, [], True) == []
    for rows in ([(None, 0, "user", "a", "z")], [(c, None, None, None, None) for c in (4, 4, 6)]):
        assert answer(spark, rows, True) == brute(rebuilt(rows, True))


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        names = np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
        table = SlotTable(names)
        assert sorted(table.slots(names).tolist()) == list(range(len(names)))
        assert (table.slots(rng.integers(0, 1 << 63, (100, 2)).astype(np.uint64)) == -1).all()
