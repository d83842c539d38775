"""Small tests of the row-wise operators and archives, with null, empty, repeated and long rows."""

import hashlib
import io
import random
import re

import pytest

from plumbline.llm.line_dedup import drop_repeated_lines
from plumbline.llm.secrets import scan_secrets
from plumbline.llm.warc import read_records, read_warc, record, sha1_base32, write_warc
from plumbline.session import scratch_path


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k in held and len(held[k]) >= min_docs and any(x is not None for x in held[k]) and max(x for x in held[k] if x is not None) != i for k in map(key, lines)]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return out


@pytest.mark.parametrize("max_bits", [1 << 20, 1 << 16])
def test_line_dedup(spark, documents, max_bits):
    rng = random.Random(5)
    pool = ["a shared line", "A Shared LINE", "short", "x" * 12, "éééééééééé", "only once more", "", "  a shared line\t", "p" * 9, "\x0bvertical one\x0c"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8)) + [f"unique line number {i}"])) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "a shared line\nkeep me please"), (7, "a shared line\nof a repeated id"), (102, "a shared line\n" * 500)]
    docs = documents(rows).repartition(4).withColumnRenamed("lang", "n_lines")
    out = drop_repeated_lines(docs, min_chars=10, min_docs=4, max_bits=max_bits)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    assert got == sorted(brute_lines(rows, 10, 4), key=repr)
    assert drop_repeated_lines(documents([])).collect() == []


def test_secrets(spark, documents):
    access, secret = "AKIA" + "A1B2C3D4E5F6", "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY0"
    cases = [
        ("password = hunter2hunter2 and Token:abc", (1, 0, 0)), (f"id {access} key {secret} at https://db.example.org:5432/x", (0, 1, 0)),
        (f"loose {secret} alone", (0, 0, 0)), ("0123456789abcdef" * 2 + "g " + "a" * 31, (0, 0, 1)), ("token: secret: abcdefghijk", (0, 0, 0)),
        ("PASSWORD\"  : 'abcdefgh+/='  ſecret=abcdefghij", (1, 0, 0)), (None, (0, 0, 0)), ("", (0, 0, 0)), ("é" * 50 + " api_key=12345678", (1, 0, 0)),
        (f"login: bob\n\n{secret}", (0, 0, 0)), ("x" * 200_000 + " secret=abcdefgh", (1, 0, 0)),
    ]
    rows = list(enumerate(t for t, _ in cases)) + [(0, cases[0][0])]
    out = scan_secrets(documents(rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, (_, counts) in enumerate(cases):
        assert (by[i].n_assign, by[i].n_access, by[i].n_hex) == counts
    assert by[2].spans == "" and by[6].base_sha256 == hashlib.sha256(b"").hexdigest()
    kinds = re.findall(r"[a-z]+", by[1].spans)
    assert kinds == ["access", "key", "endpoint"]
    assert by[9].spans == ""  # another paragraph is another scope
    assert by[8].spans == "assign:51:67" and by[8].base_sha256 == hashlib.sha256(b"assign:51:67").hexdigest()
    assert scan_secrets(documents([])).collect() == []


def test_long_loose_secret():
    import time

    from plumbline.llm.secrets import base_spans, linked_spans

    access = "AKIA" + "A1B2C3D4E5F6"
    for n in (128, 129, 164, 5000):
        text = f"{access} {'Ab1' * n} =".replace("Ab1" * n, ("Ab1" * n)[:n]) + " https://db.example.org"
        assert [(k, e - s) for s, k, e in sorted(linked_spans(text, base_spans(text), 400))] == [("key", n), ("endpoint", 22)][:1 if n > 400 else 2]
    began = time.time()
    for text in ("a" * 300_000, "aB1" * 100_000 + "=====", "A1b/" * 100_000 + "é"):
        linked_spans(text, base_spans(text), 400)
    assert time.time() - began < 5


@pytest.mark.parametrize("n", [3, 63, 64, 65, 254, 500])
def test_long_weak_parts_end_where_they_end(n):
    from plumbline.llm.secrets import base_spans, linked_spans

    name, host, secret = "u" * n, "h" * n + ".example.org", "password=hunter2hunter2"
    text = f"login: {name} {secret} https://{host}:{'9' * min(n, 31)}/x"
    found = {k: text[s:e] for s, k, e in linked_spans(text, base_spans(text), 5000)}
    assert found == {"id": f"login: {name}", "endpoint": f"https://{host}:{'9' * min(n, 31)}"}


def test_interval_join_equals_all_pairs():
    import numpy as np

    from plumbline.llm.secrets import _near

    rng = np.random.default_rng(3)
    for _ in range(50):
        side = lambda n: np.sort(np.column_stack([rng.integers(0, 3, n), (s := rng.integers(0, 100, n)), s + rng.integers(1, 9, n)]), axis=0)
        a, b = side(8), side(6)
        want = [any(x[0] == y[0] and x[1] - 10 <= y[1] <= x[2] + 10 for y in b) for x in a]
        assert _near(a, b, 10).tolist() == want


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "b" * 300_000, "", None, "é" * 10, "<p>a</p>"]
    rows = [(i, f"http://x.org/{i} ü\n", html[i % 6]) for i in range(40)] + [(39, "dup", html[3]), (None, None, "<p>a</p>"), (None, "z", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for least in (0, 5):
        archives = write_warc(pages, scratch_path(spark, "warc"), min_bytes=least)
        assert sum(r.records for r in archives.collect()) == len(rows)
        got = read_warc(archives).collect()
        assert len(got) == len(rows)
        for r in got:
            body = next((h or "").encode() for i, u, h in rows if i == r.page_id and (u or "").split("/")[-1][:1] in (r.url or "")) if r.payload is None else bytes(r.payload)
            assert r.payload_bytes == len(body) and r.payload_digest == sha1_base32(body)
            top = last[body.decode()]
            response = len(body) < least or top < 0 or r.page_id == top
            assert r.record_type == ("response" if response else "revisit") and r.refers_to == (None if response else top)
    assert read_warc(write_warc(pages.limit(0), scratch_path(spark, "warc"))).collect() == []


def test_warc_reader_checks():
    good = b"".join(record("response", i, "u", p, sha1_base32(p), None, "2000-01-01T00:00:00Z") for i, p in enumerate([b"", b"x" * 1_000_000, b"\r\n\r\nWARC/1.1"]))
    for chunk in (1, 1000, 1 << 20):
        if chunk > 1 or len(good) < 10_000:
            assert [r["payload"] for r in read_records(io.BytesIO(good), chunk)] == [b"", b"x" * 1_000_000, b"\r\n\r\nWARC/1.1"]
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(good[:-9])))
    wrong = record("response", 1, "u", b"abc", sha1_base32(b"abd"), None, "2000-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(wrong)))
