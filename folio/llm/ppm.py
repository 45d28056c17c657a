"""Prediction by partial matching over bytes: pretrained code length of each document.

The trie holds every context of up to `order` bytes with the counts of the symbols that followed it in the training texts.
A symbol unseen in the longest context escapes to the next shorter one, where the symbols of the longer context are
excluded; the last resort is a uniform choice among the symbols seen nowhere. Escapes use method D: with total T and D
distinct symbols after exclusion, a symbol of count n has (2n - 1) / 2T and the escape D / 2T.

A node's symbols all occur after its suffixes too, so what is excluded at a node depends on the next longer context alone.
That makes the code length of (context, symbol) a value of the gram: it is worked out once for each distinct gram, in groups
that share their last two context symbols and so hold all the longer contexts they need. Documents then look their grams up.
Where the table fits `most_rows`, it is broadcast; else the distinct grams of each document are joined with it.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import bounded_batches, fold, table, written

ORDER = 5
pa = G.pa
GRAM, WORD = 0, 1
#: The key of the token that ends a text among the hashes of words.
END_WORD = -1


def word_hashes(text: bytes | None) -> np.ndarray:
    w = (text or b"").split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)).view(np.int64)
    return np.append(np.where(h == END_WORD, np.int64(1), h), np.int64(END_WORD))


def _count(order: int):
    def run(batches):
        found = {GRAM: G.Counter(), WORD: G.Counter()}

        def flush(kind):
            key, m, n = found[kind].take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(m), pa.array(n)], ["kind", "key", "n_train", "n_all"])

        for b in G.batch_of(batches, 0):
            for train in (True, False):
                texts = [(x.as_py() or b"").lower() for x, t in zip(b.column(0), b.column(1).to_pylist(), strict=True) if t == train]
                if texts:
                    found[GRAM].add(G.keys([p for x in texts for p in G.symbols(x, order)], order), train)
                    found[WORD].add(np.concatenate([word_hashes(x) for x in texts]), train)
            for kind, c in found.items():
                if c.size >= G.FLUSH:
                    yield flush(kind)
        for kind, c in found.items():
            if c.size:
                yield flush(kind)

    return run


class Level:
    """The trie's nodes of one order: counts by (context, symbol) and totals by context."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n = key, n
        ctx = key >> G.BITS
        self.at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
        self.ctx = ctx[self.at]
        self.total = np.add.reduceat(n, self.at) if len(ctx) else n
        self.distinct = np.diff(np.append(self.at, len(ctx)))

    @staticmethod
    def where(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't there."""
        if not len(sorted_keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == key, at, -1)


def code_lengths(gram: np.ndarray, levels: list[Level], order: int) -> np.ndarray:
    """log10 probability of each gram's symbol after its context; levels[k] has the contexts of k symbols."""
    out = np.zeros(len(gram))
    alive = np.arange(len(gram))
    for k in range(order, -1, -1):
        g, level = gram[alive], levels[k]
        node = Level.where(level.ctx, (g & G.mask(k + 1)) >> G.BITS)
        total = np.where(node >= 0, level.total[node] if len(level.total) else 0, 0).astype(np.float64)
        distinct = np.where(node >= 0, level.distinct[node] if len(level.ctx) else 0, 0).astype(np.float64)
        if k < order:
            above = levels[k + 1]
            child = Level.where(above.ctx, (g & G.mask(k + 2)) >> G.BITS)
            if len(above.ctx):
                at = Level.where(level.key, above.key & G.mask(k + 1))
                hidden = np.add.reduceat(level.n[at], above.at)
                total -= np.where(child >= 0, hidden[child], 0)
                distinct -= np.where(child >= 0, above.distinct[child], 0)
        row = Level.where(level.key, g & G.mask(k + 1))
        n = np.where(row >= 0, level.n[row] if len(level.n) else 0, 0)
        hit = row >= 0
        out[alive[hit]] += np.log10((2 * n[hit] - 1) / (2 * total[hit]))
        escape = ~hit & (distinct > 0)
        out[alive[escape]] += np.log10(distinct[escape] / (2 * total[escape]))
        alive = alive[~hit]
    seen = len(levels[0].key)
    out[alive] -= np.log10(max(1, G.END - seen))
    return out


def _levels(gram: np.ndarray, n: np.ndarray, order: int, least: int) -> list[Level | None]:
    out: list[Level | None] = [None] * (order + 1)
    key, n = gram[n > 0], n[n > 0]
    for k in range(order, least - 1, -1):
        key, n = G.totals(key & G.mask(k + 1), n)
        out[k] = Level(key, n)
    return out


def _table(order: int, low):
    def run(key, t):
        gram, n = t.column("key").to_numpy(), t.column("n_train").to_numpy()
        sort = np.argsort(gram, kind="stable")
        gram, n = gram[sort], n[sort]
        levels = _levels(gram, n, order, 2)
        levels[:2] = low.value
        return pa.table({"key": gram, "value": code_lengths(gram, levels, order).astype(np.float32)})

    return run


def trie_table(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 probability of each gram in `counts` (key, n_train), in the trie of those with n_train > 0."""
    pair = F.col("key").bitwiseAND(F.lit(int(G.mask(2))))
    both = counts.where("n_train > 0").groupBy(pair.alias("key")).agg(F.sum("n_train").alias("n"))  # at most 258 * 258 rows
    key, n = G.fetched(both, [np.int64, np.int64])
    one = Level(*G.totals(key, n))
    zero = Level(*G.totals(key & G.mask(1), n))
    low = counts.sparkSession.sparkContext.broadcast([zero, one])
    group = F.shiftright("key", G.BITS).bitwiseAND(F.lit(int(G.mask(2))))
    return counts.select("key", "n_train", group.alias("tail")).groupBy("tail").applyInArrow(_table(order, low), "key long, value float")


def _score(order: int, trie, counts, total: int, distinct: int):
    def run(batches):
        t, c = trie.value, counts.value
        for b in G.batch_of(batches, 2):
            train = np.array(b.column(1).to_pylist(), bool)
            texts = [(x.as_py() or b"").lower() for x in b.column(2)]
            g = G.keys([p for x in texts for p in G.symbols(x, order)], order)
            score = G.sums_by_text(t.values[0][t.find(g)], [len(x) + 1 for x in texts])
            w = [word_hashes(x) for x in texts]
            size = [len(x) for x in w]
            at = c.find(np.concatenate(w))
            # A word that isn't in the table has its one training occurrence in this training text, or none.
            n = np.where(at >= 0, c.values[0][at] if len(c.values[0]) else 0, np.repeat(train, size).astype(np.int64))
            base = G.sums_by_text(np.log10((n + 1) / (total + distinct + 1)), size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(~train), pa.array(size, pa.int64()), pa.array(G.sums_by_text(n > 0, size).astype(np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _own_keys(order: int):
    """The distinct grams and words of each document, for the join."""

    def run(batches):
        for b in G.batch_of(batches, 3, 1 << 19):
            cols: list[list] = [[], [], [], [], [], [], []]
            for d, k, train, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = (x or b"").lower()
                g = G.keys(list(G.symbols(x, order)), order)
                for kind, (key, n) in ((GRAM, np.unique(g, return_counts=True)), (WORD, np.unique(word_hashes(x), return_counts=True))):
                    for col, v in zip(cols, (np.full(len(key), d if d is not None else 0), np.full(len(key), d is None), np.full(len(key), k), np.full(len(key), train), np.full(len(key), kind), key, n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(kind)) for c, kind in zip(cols, (np.int64, bool, np.int64, bool, np.int32, np.int64, np.int64), strict=True)], ["doc_id", "no_id", "text_key", "train", "kind", "key", "times"])

    return run


def score_corpus(docs: DataFrame, train: Column, order: int = ORDER, most_rows: int = 16_000_000) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `train` marks the rows that the model learns from. A-Z are lower-cased. score is the log10 probability of all bytes of
    the text and its end under the trie; base_score that of its words (split at ASCII white space) and its end under the
    add-one unigram model. Null and empty texts consist of their end. Repeated rows count, and are scored, each; without
    training rows every symbol is equally likely. Further columns of docs are left out. `most_rows` is the size up to
    which tables are broadcast; it changes no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("binary").alias("text"))
    counts = written(G.summed(d.select("text", "train").mapInArrow(_count(order), "kind int, key long, n_train long, n_all long"), ["kind", "key"]), "ppm-counts")
    words = counts.where(F.col("kind") == WORD)
    total, distinct = words.where("n_train > 0").select(F.coalesce(F.sum("n_train"), F.lit(0)), F.count(F.lit(1))).first()
    trie = written(trie_table(counts.where(F.col("kind") == GRAM).select("key", "n_train"), order), "ppm-trie")
    # Words with one training occurrence and no other are told from the text they stand in.
    known = words.where("n_train > 1 or (n_train = 1 and n_all > 1)").select("key", F.col("n_train").alias("value"))
    if trie.count() <= most_rows and known.count() <= most_rows:
        t = spark.sparkContext.broadcast(G.Lookup(*G.fetched(trie, [np.int64, np.float32])))
        c = spark.sparkContext.broadcast(G.Lookup(*G.fetched(known, [np.int64, np.int64])))
        out = d.mapInArrow(_score(order, t, c, total, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    else:
        own = d.select("doc_id", F.xxhash64("text").alias("text_key"), "train", "text").mapInArrow(_own_keys(order), "doc_id long, no_id boolean, text_key long, train boolean, kind int, key long, times long")
        value = trie.select(F.lit(GRAM).alias("kind"), "key", F.col("value").cast("double")).unionByName(words.select(F.lit(WORD).alias("kind"), "key", F.col("n_train").cast("double").alias("value")))
        j = own.join(value, ["kind", "key"])
        is_word = F.col("kind") == WORD
        out = j.groupBy("doc_id", "no_id", "text_key", "train").agg(
            F.sum(F.when(is_word, F.col("times"))).alias("n_tokens"),
            F.sum(F.when(is_word & (F.col("value") > 0), F.col("times")).otherwise(0)).alias("n_known"),
            F.sum(F.when(is_word, F.col("times") * F.log10((F.col("value") + 1) / (total + distinct + 1)))).alias("base_score"),
            F.sum(F.when(~is_word, F.col("times") * F.col("value"))).alias("score"),
            F.sum(F.when(is_word & (F.col("key") == END_WORD), F.col("times"))).alias("copies"),
        )
        # Repeated rows were added up; each has one end, and each gets its share.
        each = [(F.col(c) / F.col("copies")).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]
        out = out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), (~F.col("train")).alias("held_out"), *each, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
