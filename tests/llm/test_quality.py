import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.train(docs, labels.where(~held))
    out = quality.classify(docs, model).join(labels.where(held), "doc_id")
    n, good, q, t, kept_bad, lost = out.agg(
        F.count("*"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)),
        F.avg(((F.col("p_quality") >= 0.5).cast("int") == F.col("quality")).cast("int")), F.avg(((F.col("p_toxic") >= 0.5).cast("int") == F.col("toxic")).cast("int")),
        F.avg(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("keep").cast("int"))),
        F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), (~F.col("keep")).cast("int")))).first()
    assert n > 800 and good > 500 and q > 0.98 and t > 0.96 and kept_bad < 0.12 and lost < 0.01


def model():
    rng = np.random.default_rng(1)
    words = ["sun", "tree", "river", "stone", "cloud", "field", "path", "light"]
    texts = [" ".join(rng.choice(words, 60)) + ("" if i % 3 else " vile") + (" " + "## $$ %% " * 20 if i % 4 == 0 else "") for i in range(400)]
    return quality.fit(texts, np.array([[i % 4 != 0, i % 3 == 0] for i in range(400)], float))


def test_posteriors_shrink_sites(spark):
    rows = [("good.org", "a", 0.9, 0.02 if i % 20 else 0.9) for i in range(300)] + [("good.org", "b", 0.9, 0.05), (None, None, 0.9, 0.5)]
    rows += [("bad.org", "a", 0.9, 0.95) for _ in range(100)] + [("bad.org", "b", 0.9, 0.05), ("one.org", "a", 0.9, 0.05)]
    sites = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, q double, t double"))
    t = {(r.host, r.path): r.t for r in sites.collect()}
    assert len(t) == 6 and (None, None) in t
    # A lone document's site follows its host, and without one the whole.
    assert t["bad.org", "a"] > 0.9 > t["bad.org", "b"] > t["one.org", "a"] > t["good.org", "b"] > 0 and t["good.org", "a"] < 0.1


def test_edges(spark, documents):
    docs = documents([(1, None), (1, None), (None, "sun"), (2, "")]).withColumn("source", F.when(F.col("doc_id") == 2, "x"))
    assert quality.classify(docs, model()).count() == 4
    assert quality.classify(documents([]), model()).collect() == []
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0)], LABELS)
    untrained = quality.train(docs, labels)
    assert quality.classify(docs, untrained).count() == 4
    assert quality.distinct(["a b c d e f g h", "a b c d e f g h", "x"]) == [0, 2]


def test_posteriors_equal_plain_arithmetic(spark):
    """Site rates and document posteriors recomputed in plain Python from the classifier's log odds."""
    from math import exp, log

    rng = np.random.default_rng(6)
    words = ["sun", "tree", "vile", "##", "$$", "river", "stone"]
    rows = [(i, None if i % 40 == 7 else " ".join(rng.choice(words, rng.integers(1, 30))), ["en", "de"][i % 3 == 0], [None, "a/x", "a/y", "b/z", "b/z", "b/z"][i % 6], "k") for i in range(300)]
    rows += [rows[5]] * 9
    made = model()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep string").repartition(7)
    out = sorted(quality.classify(docs, made, trust=0.7).collect(), key=lambda r: (r.doc_id, r.p_quality))
    sigmoid, logit = lambda z: 1 / (1 + exp(-z)), lambda p: log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    z = made.logits([t or "" for _, t, *_ in rows])
    site = [((s or "").split("/")[0] if s else None, f"{s} {g}" if s else g) for _, _, g, s, _ in rows]
    rates = []
    for k in range(2):
        p = np.array([sigmoid(x) for x in z[:, k]])
        mean, n = p.mean(), len(p)
        within = max(1e-6, (p * p).mean() - mean**2)

        def strength(keys):
            groups = [p[[i for i, x in enumerate(keys) if x == key]] for key in set(keys)]
            size = max(1.0, n - sum(len(g) ** 2 for g in groups) / n)
            between = max(1e-6, (sum(len(g) * (g.mean() - mean) ** 2 for g in groups) - (len(groups) - 1) * within) / size)
            return min(1e4, within / between)

        hosts = [h for h, _ in site]
        at_host, at_path, found = strength(hosts), strength(site), {}
        for h, path in set(site):
            of_host = p[[i for i, x in enumerate(hosts) if x == h]]
            of_path = p[[i for i, x in enumerate(site) if x == (h, path)]]
            pulled = (of_host.sum() + at_host * mean) / (len(of_host) + at_host)
            found[h, path] = (of_path.sum() + at_path * pulled) / (len(of_path) + at_path)
        rates.append((mean, found))
    want = sorted((rows[i][0], *(sigmoid(z[i, k] + 0.7 * (logit(rates[k][1][site[i]]) - logit(rates[k][0]))) for k in range(2)), *(rates[k][1][site[i]] for k in range(2))) for i in range(len(rows)))
    assert len(out) == len(want)
    for r, (i, *figures) in zip(out, want):
        assert r.doc_id == i and [r.p_quality, r.p_toxic, r.site_quality, r.site_toxic] == pytest.approx(figures, abs=1e-9)
        assert r.keep == (figures[0] >= 0.5 and figures[1] < 0.4)
