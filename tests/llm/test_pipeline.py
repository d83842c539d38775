"""The pipeline, stage by stage, against brute-force versions on the smallest tables."""

import os

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.session import stage
from tests.llm.test_decontaminate import brute as windows
from tests.llm.test_rows import brute_lines
from tests.llm.test_simhash import jaccard, smallest_reachable

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, seen = dict(corpus_pipeline.STAGES), [rows_of(docs)]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(rows_of(docs))
    raw, good, lines, single, clean = seen
    assert set(good) < set(raw) and all(raw[i] == t for i, t in good.items())
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(r.doc_id in good for r in labels if r.quality == 1 and r.toxic == 0)
    assert lines == {i: t for i, t, _, _ in brute_lines(list(good.items()), 40, 5)}
    ids = sorted(lines)
    edges = [(a, b) for a in ids for b in ids if b < a and jaccard(lines[a], lines[b]) >= 0.8]
    root = smallest_reachable(ids, edges)
    assert set(single) == {i for i in ids if root[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, t in single.items() if not windows(t, items, 10)[1]}
    packed = steps["best-fit packing"](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == length


def test_run_gives_pieces_of_kept_documents(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 50


def test_null_and_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "x", 0), (2, "a b c", "en", None, 5), (2, "a b c", "en", None, 5), (3, "w " * 5000, None, "y/z", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        current = table
        for _, step in corpus_pipeline.STAGES:
            current = stage(step(spark, current, str(tmp_path)), "test")
        assert (current.count() > 0) == (table is docs)
