"""Document quality by hierarchical empirical Bayes: text evidence with host and path posteriors."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import map_rows, pack, unpack
from plumbline.session import stage

SAMPLE = 6000  # labelled documents that the classifier is fitted on
VOCABULARY = 4096  # words that are features
RARE = 8  # documents of the sample that a feature word must be in
ROUNDS = 250
SALTS = 16  # parts of a site's rows in the join with its posterior
WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)  # lengths of word beginnings that are features
STRONG = 5.0  # deviations beyond which a feature is a marker of its label
SYMBOLS = b"#$%&*@^~|<>{}[]\\=+_"


def style(text: str) -> list[float]:
    """Length, kinds of characters, repetition and shape of lines."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    kinds = len(set(words))
    letters = int(counts[65:91].sum() + counts[97:123].sum())
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), counts[65:91].sum() / max(1, letters), counts[48:58].sum() / n,
        sum(int(counts[c]) for c in SYMBOLS) / n, counts[33] / n, counts[124] / w, kinds / w, float(np.log1p(w) - np.log1p(kinds)),
        (len(data) - w) / w / 10, (counts[44] + counts[46]) / w, len(lines) / w, len(set(lines)) / len(lines),
    ]


STYLES = 13


def tokens(text: str) -> set[str]:
    """The words of a text in lower case and their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({"^" + w[:k] for w in words if len(w) > k} for k in STEMS))


def distinct(texts: list[str]) -> list[int]:
    """Numbers of the texts that are no near-copy of an earlier one: fewer than two of four least shingle hashes were seen."""
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        w = t.lower().split()
        least = heapq.nsmallest(4, {zlib.crc32(" ".join(w[j:j + 5]).encode()) for j in range(max(1, len(w) - 4))})
        if sum(h in seen for h in least) < min(2, len(least)):
            out.append(i)
        seen.update(least)
    return out


@dataclass
class TextModel:
    """Two logistic regressions, for quality and toxicity.

    Features are words and word beginnings, how many markers of either side of either label a text has, and
    standardized style figures.
    """

    words: dict[str, int]
    markers: np.ndarray  # (4, words): which words mark low or high quality, no or some toxicity
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (2, words + dense figures + 1)

    def dense(self, known: list[int], text: str) -> np.ndarray:
        figures = np.clip((np.array(style(text)) - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.log1p(self.markers[:, known].sum(axis=1)), figures, [1.0]])

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            known = [self.words[x] for x in self.words.keys() & tokens(t)]
            out[i] = self.weights[:, known].sum(axis=1) + self.weights[:, len(self.words):] @ self.dense(known, t)
        return out


def fit(texts: list[str], labels: np.ndarray, rounds: int = ROUNDS, penalty: float = 0.3) -> TextModel:
    """Penalized maximum likelihood by Adam; ``labels`` has a column for quality and one for toxicity.

    Near-copies in the sample count once, so that the words of one much copied text are not taken for markers.
    """
    kept = distinct(texts)
    texts, labels = [texts[i] for i in kept], labels[kept]
    # Texts are read again in each pass: sets of all tokens would be many times their size.
    bins = np.zeros(1 << 20, np.int32)
    for t in texts:
        bins[list({zlib.crc32(x.encode()) & 0xFFFFF for x in tokens(t)})] += 1
    often = {int(i) for i in np.flatnonzero(bins >= RARE)}
    seen, held = Counter(), [Counter(), Counter()]
    for t, y in zip(texts, labels):
        w = [x for x in tokens(t) if zlib.crc32(x.encode()) & 0xFFFFF in often]
        seen.update(w)
        for k in (0, 1):
            if y[k]:
                held[k].update(w)
    n, totals = max(1, len(texts)), labels.sum(axis=0)
    common = [x for x, c in seen.items() if c >= RARE]
    count = np.array([seen[x] for x in common], float)
    rate = totals / n
    # Deviations of each word's rate of either label from the overall rate.
    z = np.array([(np.array([held[k][x] for x in common]) - count * rate[k]) / np.sqrt(np.maximum(0.5, count * rate[k] * (1 - rate[k]))) for k in (0, 1)]).reshape(2, -1)
    order = sorted(range(len(common)), key=lambda i: (-np.abs(z[:, i]).max(), common[i]))[:VOCABULARY]
    words = {common[i]: j for j, i in enumerate(order)}
    z = z[:, order]
    markers = np.concatenate([z <= -STRONG, z >= STRONG])[[0, 2, 1, 3]].astype(float)
    figures = np.array([style(t) for t in texts]).reshape(-1, STYLES)
    mean, scale = (figures.mean(axis=0), figures.std(axis=0) + 1e-6) if len(texts) else (np.zeros(STYLES), np.ones(STYLES))
    model = TextModel(words, markers, mean, scale, np.zeros((2, len(words) + 4 + STYLES + 1)))
    rows, columns, dense = array("q"), array("q"), []
    for i, t in enumerate(texts):
        known = sorted(words[x] for x in words.keys() & tokens(t))
        rows.extend([i] * len(known))
        columns.extend(known)
        dense.append(model.dense(known, t))
    rows, columns, dense = np.array(rows), np.array(columns), np.array(dense).reshape(len(texts), 4 + STYLES + 1)
    for k in range(2 if len(texts) else 0):
        w = model.weights[k]
        m, v = np.zeros(len(w)), np.zeros(len(w))
        for step in range(1, rounds + 1):
            score = np.bincount(rows, w[columns], len(texts)) + dense @ w[len(words):]
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[:, k]
            g = np.concatenate([np.bincount(columns, error[rows], len(words)), error @ dense]) / n
            g[:len(words)] += penalty * w[:len(words)] / n
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return model


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> TextModel:
    """A model fitted on at most ``sample`` labelled documents, those with the smallest hashes of their ids.

    Only the ids and labels of that sample are sent to the documents, so no text is shuffled for it.
    """
    chosen = (labels.where(F.col(id).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
              .select(F.col(id).alias("__id"), "quality", "toxic").orderBy(F.xxhash64("__id"), "__id").limit(sample))
    rows = docs.select(id, text).join(F.broadcast(chosen), F.col(id) == F.col("__id")).select(text, "quality", "toxic").orderBy(F.xxhash64(text), text).limit(sample).collect()
    return fit([r[0] or "" for r in rows], np.array([[r[1], r[2]] for r in rows], float).reshape(-1, 2))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """``(host, path, q, t, n)``: shrunken rates of quality and toxicity of each path, from all documents' evidence.

    Empirical Bayes at two levels. The prior strength of a level is a ratio of variances, as in the method of moments: what
    sites differ by among themselves beyond what their documents' spread explains. A host's mean is pulled to the
    global mean, a path's to its host's, the more the fewer documents they have. Everything is grouped aggregation
    with partial sums.
    """
    sums = [F.count("*").alias("n")] + [f(c).alias(a) for c in ("q", "t") for f, a in ((F.sum, f"s{c}"), (lambda x: F.sum(F.col(x) * F.col(x)), f"r{c}"))]
    paths = stage(scored.groupBy("host", "path").agg(*sums), "sites")
    totals = [F.sum(c).alias(c) for c in ("n", "sq", "rq", "st", "rt")]
    hosts = paths.groupBy("host").agg(*totals)
    overall = paths.agg(*totals).first()
    if not overall.n:
        return paths.select("host", "path", *[F.lit(0.5).alias(c) for c in ("q", "t")], "n", *[F.lit(0.5).alias(c) for c in ("mq", "mt")])
    mean = {c: overall[f"s{c}"] / overall.n for c in "qt"}
    within = {c: max(1e-6, overall[f"r{c}"] / overall.n - mean[c] ** 2) for c in "qt"}

    def strength(level: DataFrame) -> dict[str, float]:
        spread = level.agg(F.count("*").alias("k"), *[F.sum(F.col("n") * F.pow(F.col(f"s{c}") / F.col("n") - mean[c], 2)).alias(c) for c in "qt"],
                           F.sum(F.col("n") * F.col("n")).alias("nn")).first()
        size = max(1.0, overall.n - spread.nn / overall.n)
        between = {c: max(1e-6, (spread[c] - (spread.k - 1) * within[c]) / size) for c in "qt"}
        return {c: min(1e4, within[c] / between[c]) for c in "qt"}

    at_host, at_path = strength(hosts), strength(paths)
    pulled = hosts.select(F.col("host").alias("__host"), *[((F.col(f"s{c}") + at_host[c] * mean[c]) / (F.col("n") + at_host[c])).alias(f"h{c}") for c in "qt"])
    return paths.join(pulled, paths["host"].eqNullSafe(pulled["__host"])).select(
        "host", "path", *[((F.col(f"s{c}") + at_path[c] * F.col(f"h{c}")) / (F.col("n") + at_path[c])).alias(c) for c in "qt"], "n",
        *[F.lit(mean[c]).alias(f"m{c}") for c in "qt"])


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(q / (1 - q))


def classify(
    docs: DataFrame, model: TextModel, host: Column | None = None, path: Column | None = None, text: str = "text", trust: float = 0.5,
    least_quality: float = 0.5, most_toxic: float = 0.4,
) -> DataFrame:
    """``docs`` with ``p_quality``, ``p_toxic`` (posteriors), ``site_quality``, ``site_toxic`` and ``keep``.

    A classifier gives each text its log odds; the sites' shrunken rates move them by the difference of the site's log odds from the
    global ones, weighted by ``trust`` since a site's rate comes from the same classifier. ``keep`` is quality of at
    least ``least_quality`` and toxicity below ``most_toxic``, where no clean held-out document was lost. By default the host is ``source`` up to the first slash and the path is
    ``source`` with the language.

    The join with the sites is on site and salt, so the rows of a site that holds a third of the corpus are dealt out
    to sixteen parts besides adaptive splitting; no broadcast grows with the sites.

    Defined cases: null text is empty; null hosts or paths are sites of their own; repeated rows count as often as they
    occur; a corpus of one site leaves the classifier's odds as they are; existing columns of these names are replaced; an
    empty table gives no rows.
    """
    added = ("p_quality", "p_toxic", "site_quality", "site_toxic", "keep")
    names = [c for c in docs.columns if c not in added]
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    host = F.substring_index(source, "/", 1) if host is None else host
    path = F.concat_ws(" ", source, lang) if path is None else path
    base = docs.select(*[F.col(f"`{c}`") for c in names], host.alias("__host"), path.alias("__path"))
    packed = pack(base, text, "__host", "__path")
    sent = docs.sparkSession.sparkContext.broadcast((model.words, model.markers, model.mean, model.scale, model.weights))

    def score(batch: pa.RecordBatch) -> dict:
        z = TextModel(*sent.value).logits([t or "" for t in batch.column(text).to_pylist()])
        return {"__zq": pa.array(z[:, 0], pa.float64()), "__zt": pa.array(z[:, 1], pa.float64())}

    # Written once, since sites and rows both need the scores.
    scored = stage(map_rows(packed, "__zq double, __zt double", score), "scored")
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    sites = site_posteriors(scored.select(F.col("__host").alias("host"), F.col("__path").alias("path"), sigmoid(F.col("__zq")).alias("q"), sigmoid(F.col("__zt")).alias("t")))
    spread = sites.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = scored.withColumn("__salt", F.pmod(F.xxhash64(text, "__zq", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    joined = left.join(spread, left["__host"].eqNullSafe(spread["host"]) & left["__path"].eqNullSafe(spread["path"]) & (left["__salt"] == spread["__part"]), "left")
    move = lambda z, c: sigmoid(F.col(z) + trust * (_logit(F.col(f"{c}")) - _logit(F.col(f"m{c}"))))
    done = joined.withColumns({
        "p_quality": F.coalesce(move("__zq", "q"), sigmoid(F.col("__zq"))), "p_toxic": F.coalesce(move("__zt", "t"), sigmoid(F.col("__zt"))),
        "site_quality": F.col("q"), "site_toxic": F.col("t"),
    }).withColumn("keep", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic))
    return unpack(done.select(*[c for c in packed.columns], *added), names, *added)
