"""Quality classification by positive-unlabelled learning.

Trusted positives are texts labelled good; the unlabelled are web texts without a label. Texts labelled bad teach nothing.
With the class prior pi, the share of good texts among the unlabelled, the risk of a scorer g on positives P and unlabelled
U is

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

with the logistic loss l: an unbiased estimate of the risk on labelled classes, kept from going negative (then the step goes
against the negative part). The scorer is a small network over statistics of bytes, words, lines and repetition of the whole
text; under this loss its output is the log odds of a good text.

pi is estimated from positives and unlabelled texts alone: a scorer first learns to tell the two apart; where it is surest
of a positive, hardly any bad text is left, so the share of U above a threshold divided by the share of P above it comes down
to pi. The threshold is the one with the least upper confidence bound. Both shares are counted over all positives and all
unlabelled texts of the corpus but for those that the scorer has learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, table, written

#: Scores are counted in BINS bins between -REACH and REACH; priors lie between 1 - LARGEST and LARGEST.
BINS, REACH, LARGEST = 2000, 20.0, 0.98
_CLASS = np.full(256, 7, np.uint8)  # letters beyond ASCII
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 0 if _ch.islower() else 1 if _ch.isupper() else 2 if _ch.isdigit() else 3 if _ch == " " else 4 if _ch == "\n" else 5 if _ch in ".,;:'\"-?!()" else 6
#: Every ASCII character that is neither letter, digit nor control has a column of its own.
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])


class Features:
    """Of one text: about a hundred numbers, defined for the empty text too."""

    def __init__(self):
        self.compress = zstandard.ZstdCompressor(level=1, write_content_size=False).compress

    def __call__(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        n = len(text)
        b = np.frombuffer(text, np.uint8)
        k = _CLASS[b]
        share = np.bincount(k, minlength=8) / max(1, n)
        pairs = np.bincount(k[:-1].astype(np.int64) * 8 + k[1:], minlength=64) / max(1, n - 1) if n > 1 else np.zeros(64)
        marks = np.bincount(b, minlength=256)[_MARKS] / max(1, n)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        w, d = len(words), len(set(words))
        size = np.array([len(x) for x in words]) if w else np.zeros(1)
        rest = [
            np.log1p(n), np.log1p(w), d / max(1, w), np.log1p(w) - np.log1p(d), len(self.compress(text)) / (n + 64), size.mean(), size.std(), size.max() / 100, len(lines) / max(1, w),
            len(set(lines)) / max(1, len(lines)), float(np.log1p(len(lines))), len({*zip(words, words[1:], words[2:], strict=False)}) / max(1, w - 2), float(n == 0),
        ]
        return np.concatenate([np.sqrt(share), np.sqrt(pairs), np.sqrt(marks), rest]).astype(np.float32)


class Network:
    """One hidden layer, trained to the non-negative unbiased risk by Adam."""

    def __init__(self, p: np.ndarray, u: np.ndarray, prior: float, hidden: int = 24, steps: int = 500, rate: float = 0.01, ridge: float = 1e-4, seed: int = 3):
        r = np.random.default_rng(seed)
        x = np.concatenate([p, u])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        p, u = self._z(p), self._z(u)
        self.w = [r.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        self.risk = []
        for t in range(1, steps + 1):
            i, j = r.integers(0, len(p), min(len(p), 2048)), r.integers(0, len(u), min(len(u), 2048))
            (hp, gp), (hu, gu) = self._forward(p[i]), self._forward(u[j])
            s = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            self.risk.append(prior * np.logaddexp(0, -gp).mean() + max(0.0, negative))
            if negative >= 0:
                dp, du = prior * (-(1 - s(gp)) - s(gp)) / len(i), s(gu) / len(j)
            else:
                dp, du = prior * s(gp) / len(i), -s(gu) / len(j)
            grad = [a + b + ridge * c for a, b, c in zip(self._back(p[i], hp, dp), self._back(u[j], hu, du), self.w, strict=True)]
            for k, g in enumerate(grad):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _forward(self, z: np.ndarray):
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3][0]

    def _back(self, z, h, d):
        dh = d[:, None] * self.w[2] * (1 - h * h)
        return [z.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()])]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._forward(self._z(x))[1]


def probability(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, from the numbers of either in bins of rising score."""
    p, u = (np.cumsum(x[::-1]).astype(float) for x in (positive, unlabelled))  # above each threshold, the highest first
    if not len(p) or not p[-1] or not u[-1]:
        return 0.5
    slack = sum(np.sqrt(np.log(4 / delta) / (2 * n)) for n in (p[-1], u[-1]))
    some = p > 0
    p, u = p[some] / p[-1], u[some] / u[-1]
    best = int(np.argmin(u / p + (1 + gamma) / p * slack))
    return float(min(LARGEST, max(1 - LARGEST, u[best] / p[best])))


def _features(batches):
    f = Features()
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([f(x.as_py()) for x in b.column(3)], pa.list_(pa.float32()))], ["label", "half", "doc_id", "x"])


def _binned(net: Network):
    def run(batches):
        f = Features()
        for b in batches:
            if b.num_rows:
                g = net(np.array([f(x.as_py()) for x in b.column(1)], np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.floor((np.clip(g, -REACH, REACH) + REACH) * (BINS / (2 * REACH))).astype(np.int32))], ["doc_id", "bin"])

    return run


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, label): 1 for a trusted positive, 0 for any other id that the labels name. Of several labels of one id the
    largest counts; labels of fold 0 and labels other than 1 only tell that the text isn't unlabelled."""
    good = (F.col("quality") == 1) & (fold(F.col("doc_id"), 5) != 0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(good, F.lit(False)).cast("int")).alias("label"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, most_unlabelled: int = 12_000) -> tuple[Network | None, float]:
    """(network, prior). The network learns from at most `most` positives and `most_unlabelled` unlabelled texts, the first
    by a hash of their ids. The scorer for the prior learns from half of these; the prior is counted over all other texts.
    Without texts of both kinds: (None, 0.5)."""
    bounded_batches(docs.sparkSession)
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    known = written(_known(labels), "quality-known")
    order = [F.xxhash64("doc_id", F.lit(12)), F.col("doc_id")]
    p = known.where("label = 1").orderBy(*order).limit(most).select("doc_id", F.lit(1).alias("label"))
    u = d.select("doc_id").join(known, "doc_id", "left_anti").orderBy(*order).limit(most_unlabelled).distinct().select("doc_id", F.lit(-1).alias("label"))
    ids = written(p.unionByName(u).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)).cast("int")), "quality-ids")
    sample = written(d.join(F.broadcast(ids), "doc_id"), "quality-sample")  # most + most_unlabelled ids
    rows = sample.select("label", "half", "doc_id", "text").mapInArrow(_features, "label int, half int, doc_id long, x array<float>").toArrow().sort_by("doc_id")
    y, half = (rows.column(k).to_numpy() for k in ("label", "half"))
    if not (y == 1).any() or not (y == -1).any():
        return None, 0.5
    x = rows.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(y), -1)
    p, u = x[(y == 1) & (half == 0)], x[(y == -1) & (half == 0)]
    if not len(p) or not len(u):
        return Network(x[y == 1], x[y == -1], 0.5), 0.5
    bins = d.mapInArrow(_binned(Network(p, u, 0.5, steps=300)), "doc_id long, bin int")
    rest = bins.join(F.broadcast(ids.where("half = 0").select("doc_id")), "doc_id", "left_anti").join(known, "doc_id", "left")
    counts = np.zeros((2, BINS + 1), np.int64)
    for r in rest.where("label is null or label = 1").groupBy(F.col("label").isNull().cast("int").alias("free"), "bin").count().collect():  # 2 * (BINS + 1) rows
        counts[r.free, r.bin] = r["count"]
    prior = estimated_prior(*counts)
    return Network(x[y == 1], x[y == -1], prior), prior


def _scores(model: Network):
    def run(batches):
        f = Features()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probability(model(np.array([f(x.as_py()) for x in b.column(1)], np.float64))))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 6000, most_unlabelled: int = 12_000) -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from `threshold` on).

    Scores depend on the text alone; null and empty texts have the features of the empty text. Repeated rows are scored
    each, equal texts equally; an empty table gives an empty one. Without positives or unlabelled texts every score is the
    prior, 0.5. Further columns of docs are left out.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    model, prior = fit(docs, labels, most, most_unlabelled)
    out = d.select("doc_id", F.lit(float(prior)).alias("score")) if model is None else d.mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keeps(model: Network | None, prior: float, threshold: float, at: int):
    def run(batches):
        f = Features()
        for b in batches:
            if model is None:
                keep = np.full(b.num_rows, prior >= threshold)
            else:
                keep = probability(model(np.array([f(None if x is None else x.encode()) for x in b.column(at).to_pylist()], np.float64))) >= threshold if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(keep))

    return run


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 6000, most_unlabelled: int = 12_000) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns: scored as they stream by, without a join."""
    model, prior = fit(docs, labels, most, most_unlabelled)
    return docs.mapInArrow(_keeps(model, prior, threshold, docs.columns.index("text")), docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
