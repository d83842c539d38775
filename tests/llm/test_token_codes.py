"""Directly addressable codes: every access path against plain arrays, and the files against the library's own ids."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from plumbline.llm.common import shared_folder
from plumbline.llm.queries import QUERIES
from plumbline.llm.token_codes import TokenFile, encode_file, pack_bits, read_tokens, tokens_at, unpack_bits, widths_for, write_tokens

FILE = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("width", [1, 3, 8, 11, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 1 << width, n).astype(np.uint64)
        words = pack_bits(values, width)
        assert len(words) == width * -(-n // 64)
        for a, b in ((0, n), (n // 3, n // 2), (max(0, n - 1), n)):
            assert unpack_bits(words, width, a, b - a).tolist() == values[a:b].tolist()


def cost(ids, widths):
    total, shift = 0, 0
    for k, w in enumerate(widths):
        here = ids if k == 0 else ids[ids >> shift > 0]
        total += len(here) * (w + (1.125 if k < len(widths) - 1 else 0))
        shift += w
    return total


def test_widths_are_the_cheapest():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(0.6, 5000) * 3).clip(0, 255).astype(np.uint32)
    best = min((cost(ids, w) for w in splits(int(ids.max()).bit_length())))
    assert abs(cost(ids, widths_for(ids)) - best) < 1e-6 and len(widths_for(ids)) > 1


def splits(bits):
    return [[bits]] + [[a, *rest] for a in range(1, bits) for rest in splits(bits - a)]


@pytest.mark.parametrize("ids", [[], [0], [2**32 - 1], list(range(3000)), [0] * 5000, [50256] * 700 + [1] * 700])
def test_any_token_is_found(ids):
    rng = random.Random(len(ids))
    cuts = sorted(rng.randint(0, len(ids)) for _ in range(4)) + [len(ids)]
    documents = [np.array(ids[a:b], np.uint32) for a, b in zip([0] + cuts, cuts)]
    codes = TokenFile.of(encode_file([5, None, 7, 7, -1], documents))
    assert codes.doc_ids() == [5, None, 7, 7, -1] and codes.ends().tolist() == cuts
    assert [codes.token(i) for i in range(len(ids))] == ids
    for _ in range(20):
        a, b = sorted(rng.randint(0, len(ids)) for _ in range(2))
        assert codes.tokens(a, b).tolist() == ids[a:b]
    with pytest.raises(IndexError):
        codes.token(len(ids))


def test_reads_of_one_token_are_few_and_small():
    rng = np.random.default_rng(0)
    ids = (rng.pareto(0.5, 200_000) * 20).clip(0, 50_000).astype(np.uint32)
    data, seen = encode_file([1], [ids]), []

    def read(at, size):
        seen.append(size)
        return data[at:at + size]

    codes = TokenFile(read)
    assert len(codes.widths) > 1
    for i in (0, 77_777, 199_999):
        seen.clear()
        assert codes.token(i) == ids[i] and sum(seen) <= 100 * len(codes.widths)


def test_written_files(spark, documents):
    rng = random.Random(4)
    texts = [None, "", "a", "word " * 3000, "日本 " * 50, "x <|endoftext|> y"] + [" ".join(rng.choices(["the", "of", "xyz", "12"], k=rng.randint(1, 200))) for _ in range(60)]
    rows = [(i * 3 % 67, t) for i, t in enumerate(texts)] + [(3, "twice"), (3, "twice"), (None, "nobody"), (-5, "below")]
    docs = documents(rows).withColumnRenamed("lang", "start").repartition(5)
    files = write_tokens(docs, shared_folder(spark, "codes"), FILE, file_tokens=400)
    assert files.count() > 8
    got = sorted(read_tokens(files).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(FILE)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at, flat = 0, []
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in want[r.doc_id]
        want[r.doc_id].remove(ids)
        at += len(ids)
        flat += ids
    places = spark.createDataFrame([(p,) for p in [*range(0, at, 37), at - 1, at, -1, None, 5, 5]], "place long")
    for r in tokens_at(files, places).collect():
        assert r.token == (flat[r.place] if r.place is not None and 0 <= r.place < at else None)
    assert read_tokens(write_tokens(documents([]), shared_folder(spark, "codes"), FILE)).collect() == []


def test_query_on_whole_table(spark):
    sf, library = "/root/testdata/sf0.001", Tokenizer.from_file(FILE)
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op13_token_codes"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
