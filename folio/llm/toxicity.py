"""Compression-distance classification: zstandard dictionaries of ordinary and of toxic text.

Both dictionaries end with the words that most ordinary training texts hold. The toxic one has, before these, the words that
many toxic and few ordinary training texts hold; so the same text meets the ordinary content at the same distance under
either, and a window comes out shorter under the toxic dictionary by what the toxic content alone explains. A text is cut
into windows of a few words; how much shorter they get, on average and at most, and the share of windows beyond thresholds,
are calibrated on labelled texts that the dictionaries haven't seen.

The library's own trainer keeps what is frequent, which the two kinds of text share; contents chosen as above take its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, labelled_sample, table, written

WINDOW = 8
#: Words in the ordinary dictionary; least odds of, and least share of toxic texts with, a word of the toxic one; its bytes.
ORDINARY, ODDS, SHARE, LEAST, TOXIC_BYTES = 4000, 12.0, 0.01, 5, 16_000
#: ASCII other than letters and digits stands between words.
SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return [b" " + w + b" " for w in (text or b"").lower().translate(SPACED).split()]


class Dictionaries:
    """Compressors with the two contents; only the contents travel to the executors."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = ordinary, toxic
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(toxic[-TOXIC_BYTES:] + ordinary)

    def __reduce__(self):
        return type(self), self.contents

    @staticmethod
    def _compressor(content: bytes):
        p = zstandard.ZstdCompressionParameters(compression_level=3, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, window_log=20, hash_log=17, chain_log=17, search_log=4, target_length=32, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def gains(self, text: bytes | None) -> np.ndarray:
        """By how many bytes each window is shorter under the toxic dictionary."""
        w = words(text)
        a, b = self.ordinary.compress, self.toxic.compress
        return np.array([len(a(x)) - len(b(x)) for x in (b"".join(w[k : k + WINDOW]) for k in range(0, len(w), WINDOW))] or [0], float)

    def features(self, text: bytes | None) -> list[float]:
        g = self.gains(text)
        return [g.mean(), g.max(), (g >= 4).mean(), (g >= 3).mean(), float(np.log1p((g >= 4).sum())), float(np.log1p(len(g))), float(np.sort(g)[-3:].sum())]


class Logistic:
    """Weights by Newton's method, with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, self.w = self._z(x), np.zeros(x.shape[1] + 1)
        weight = np.ones(len(y)) if weight is None else weight
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (p - y)) + 0.01 * self.w
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(self.w))
            self.w -= np.linalg.solve(h, g)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000):
    """(Dictionaries, Logistic) from at most `most` labelled texts of either kind: two thirds of them give the contents,
    the rest the thresholds. Without texts of both kinds, the share of toxic ones and no model."""
    bounded_batches(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, "toxic", most), "toxic-sample").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) > 0)
    n = {(r.label, r.half): r["count"] for r in sample.groupBy("label", "half").count().collect()}
    if len(n) < 4:
        return None, sum(v for (k, _), v in n.items() if k == 1) / max(1, sum(n.values()))

    def split(batches):
        for b in batches:
            w = [list(set(words(x.as_py()))) for x in b.column(1)]
            at = np.repeat(np.arange(len(w)), [len(x) for x in w])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([y for x in w for y in x], pa.binary())], ["label", "word"])

    counts = sample.where("half").select("label", "text").mapInArrow(split, "label int, word binary").groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))
    counts = written(counts, "toxic-words")
    odds = (F.col("toxic") / F.lit(n[1, True])) / ((F.col("ordinary") + 0.5) / F.lit(n[0, True]))
    told = (F.col("toxic") >= max(LEAST, SHARE * n[1, True])) & (odds > ODDS)
    telling = counts.where(told).orderBy(F.desc("toxic"), "word").limit(TOXIC_BYTES // 4)
    # What only toxic texts hold must not stand among the ordinary words, however few these are.
    usual = [bytes(r.word) for r in counts.where(~told & (F.col("ordinary") > 0)).orderBy(F.desc("ordinary"), "word").limit(ORDINARY).collect()]
    d = Dictionaries(b"".join(usual[::-1]), b"".join(bytes(r.word) for r in telling.collect()[::-1]))
    rest = sample.where("not half").select("label", "text").mapInArrow(_features(d), "label int, x array<double>").toPandas()  # at most 2 * most rows
    y = rest["label"].to_numpy(float)
    # Labels are sampled by kind; weights restore their shares.
    share = {r.toxic: r["count"] for r in labels.where(fold(F.col("doc_id"), 5) != 0).groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()}
    weight = np.array([share[int(v)] / max(1, (y == v).sum()) for v in y])
    return d, Logistic(np.array(rest["x"].tolist()), y, weight / weight.mean())


def _features(d: Dictionaries):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d.features(x.as_py()) for x in b.column(1)], pa.list_(pa.float64()))], ["label", "x"])

    return run


def _scores(d: Dictionaries, rule: Logistic):
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rule(np.array([d.features(x.as_py()) for x in b.column(1)])))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = 6000) -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1), predicted.

    Scores depend on the text alone. Null and empty texts have one empty window. Repeated rows are scored each; an empty
    table gives an empty one. Further columns of docs are left out.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    model, rule = fit(docs, labels, most)
    if model is None:
        out = d.select("doc_id", F.lit(float(rule)).alias("score"))
    else:
        out = d.mapInArrow(_scores(model, rule), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
