"""Quality rules: n-gram perplexity under a modified Kneser-Ney model of bytes, with bands for each language.

Spark counts the grams of `order` + 1 bytes of every language over all documents. Lower orders use continuation counts: in
how many different contexts a gram occurs. Discounts for counts of one, two and more come from the counts of counts of each
order and language. Orders are interpolated, so a gram has one probability; it is worked out in groups that share their last
two context bytes, which hold all the longer contexts they need.

The table goes to the tasks as arrays sorted by a hash of the gram. Documents get their cross entropy (log10 a byte), and
those outside their language's band are rejected: it reaches as far from the median as `upper` and `lower` times the distance
of the quartile on that side, and further for short texts, whose averages scatter more.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import bounded_batches, table, written
from .ppm import Level

ORDER = 4
pa = G.pa
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
SPACE = np.array([9, 10, 11, 12, 13, 32])


def _count(order: int):
    def run(batches):
        found: dict[str | None, G.Counter] = {}

        def flush(lang):
            key, m, n = found.pop(lang).take()
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "key", "n_train"])

        for b in G.batch_of(batches, 1):
            texts: dict[str | None, list[bytes]] = {}
            for lang, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                texts.setdefault(lang, []).append(x.as_py() or b"")
            for lang, t in texts.items():
                found.setdefault(lang, G.Counter()).add(G.keys([p for x in t for p in G.symbols(x, order)], order), True)
            # The largest count goes out when all together hold too much, so many languages don't add up.
            while sum(c.size for c in found.values()) >= G.FLUSH:
                yield flush(max(found, key=lambda k: found[k].size))
        for lang in list(found):
            yield flush(lang)

    return run


def _levels(gram: np.ndarray, n: np.ndarray, order: int) -> list[Level | None]:
    """The highest order by counts, those down to 2 by continuation counts; gram is sorted and distinct."""
    out: list[Level | None] = [None] * (order + 1)
    key = gram[n > 0]
    out[order] = Level(key, n[n > 0])
    for k in range(order - 1, 1, -1):
        key, c = G.totals(key & G.mask(k + 1), np.ones(len(key), np.int64))
        out[k] = Level(key, c)
    return out


def _sorted(t):
    gram, n = t.column("key").to_numpy(), t.column("n_train").to_numpy()
    at = np.argsort(gram, kind="stable")
    return gram[at], n[at]


def _counts_of_counts(order: int):
    def run(key, t):
        levels = _levels(*_sorted(t), order)
        rows = [(k, c, int((levels[k].n == c).sum())) for k in range(2, order + 1) for c in (1, 2, 3, 4)]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(rows), pa.string()), "level": pa.array([r[0] for r in rows], pa.int32()), "c": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """For counts of 0, 1, 2 and 3 or more, from the numbers of grams with counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [(c + 1) - (c + 2) * y * n[c + 1] / n[c] if n[c] else (c + 1) / 2 for c in range(3)]
    return np.array([0.0, *(min(max(x, 0.0), c + 0.9) for c, x in enumerate(d))])


def log_probabilities(gram: np.ndarray, levels: list[Level], d: list[np.ndarray], order: int) -> np.ndarray:
    p = np.full(len(gram), 1 / G.END)
    for k in range(order + 1):
        level, g = levels[k], gram & G.mask(k + 1)
        if not len(level.ctx):
            continue
        taken = np.add.reduceat(d[k][np.minimum(level.n, 3)], level.at) / level.total
        node = Level.where(level.ctx, g >> G.BITS)
        row = Level.where(level.key, g)
        n = np.where(row >= 0, level.n[row], 0)
        own = np.where(node >= 0, (n - d[k][np.minimum(n, 3)]) / level.total[node], 0)
        p = own + np.where(node >= 0, taken[node], 1) * p
    return np.log10(p)


def _table(order: int, low):
    def run(key, t):
        gram, n = _sorted(t)
        levels = _levels(gram, n, order)
        levels[:2], d = low.value[key[0].as_py()]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(gram), pa.string()), "key": gram, "value": log_probabilities(gram, levels, d, order).astype(np.float32)})

    return run


def model_table(counts: DataFrame, order: int = ORDER, block_rows: int = 1_000_000) -> DataFrame:
    """(lang, key, value): log10 probability of each gram in counts (lang, key, n_train).

    The two lowest orders of a language (258 * 258 rows at most) are broadcast; where there are very many languages, in
    blocks of languages of about `block_rows` rows together.
    """
    tail = F.shiftright("key", G.BITS).bitwiseAND(F.lit(int(G.mask(2))))
    grouped = counts.select("lang", "key", "n_train", tail.alias("tail"))
    coc = grouped.groupBy("lang", "tail").applyInArrow(_counts_of_counts(order), "lang string, level int, c int, n long").groupBy("lang", "level", "c").agg(F.sum("n").alias("n"))
    coc = written(coc, "kn-discounts")
    three = counts.where("n_train > 0").select("lang", F.col("key").bitwiseAND(F.lit(int(G.mask(3)))).alias("key")).distinct()
    two = written(three.groupBy("lang", F.col("key").bitwiseAND(F.lit(int(G.mask(2)))).alias("key")).agg(F.count(F.lit(1)).alias("n")), "kn-pairs")
    blocks = max(1, math.ceil((two.count() + coc.count()) / block_rows))
    tables = []
    for k in range(blocks):
        here = F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k if blocks > 1 else F.lit(True)
        low = counts.sparkSession.sparkContext.broadcast(_low_orders(two.where(here), coc.where(here), order))
        tables.append(grouped.where(here).groupBy("lang", "tail").applyInArrow(_table(order, low), "lang string, key long, value float"))
    return reduce(DataFrame.unionByName, tables)


def _by_language(lang: pa.Array) -> list[tuple[str | None, np.ndarray]]:
    """(language, its rows) of a column."""
    d = lang.dictionary_encode()
    number = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
    at = np.argsort(number, kind="stable")
    names = [*d.dictionary.to_pylist(), None]
    cut = np.searchsorted(number[at], np.arange(len(names) + 1))
    return [(x, at[lo:hi]) for x, lo, hi in zip(names, cut[:-1], cut[1:], strict=True) if hi > lo]


def _low_orders(two: DataFrame, coc: DataFrame, order: int) -> dict:
    """By language: the two lowest orders, and the discounts of all."""
    t = two.select("lang", "key", "n").toArrow().combine_chunks()
    keys, n = (t.column(k).to_numpy().astype(np.int64) for k in (1, 2))
    seen: dict = defaultdict(dict)
    for r in coc.collect():
        seen[r.lang][r.level, r.c] = r.n
    low = {}
    for lang, at in _by_language(_whole(t.column(0))):
        one = Level(*G.totals(keys[at], n[at]))
        zero = Level(*G.totals(one.key & G.mask(1), np.ones(len(one.key), np.int64)))
        d = [discounts([int((x.n == c).sum()) for c in (1, 2, 3, 4)]) for x in (zero, one)]
        low[lang] = [zero, one], d + [discounts([seen[lang].get((k, c), 0) for c in (1, 2, 3, 4)]) for k in range(2, order + 1)]
    return low


def _whole(c) -> pa.Array:
    return pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    w = text.split()
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(b[128:192].sum()) - int(b[SPACE].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(w) > 3:
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        if len(seen) < len(w) - 2:
            end = 0
            for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
                if seen[x] > 1:
                    repeated += k + 3 - max(end, k)
                    end = k + 3
    return len(w), chars, int(b[np.frombuffer(SYMBOLS, np.uint8)].sum()), len(lines) - len(set(lines)), repeated


def _score(order: int, models):
    def run(batches):
        known = models.value
        for b in G.batch_of(batches, 2):
            langs = b.column(1).to_pylist()
            texts = [x.as_py() or b"" for x in b.column(2)]
            total = np.zeros(len(texts))
            for lang in set(langs):
                at = [k for k, x in enumerate(langs) if x == lang]
                g = G.keys([p for k in at for p in G.symbols(texts[k], order)], order)
                t = known[lang]
                total[at] = G.sums_by_text(t.values[0][t.find(g)], [len(texts[k]) + 1 for k in at])
            cols = list(zip(*map(rule_counts, texts), strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols), pa.array([len(x) + 1 for x in texts], pa.int64()), pa.array(total)], ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "size", "total"]
            )

    return run


def _by_join(d: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """Total log10 probability and rules of each document where the model is too large to broadcast."""

    def own(batches):
        for b in G.batch_of(batches, 2, 1 << 19):
            rows = []
            for x in b.column(2):
                rows.append(np.unique(G.keys(list(G.symbols(x.as_py(), order)), order), return_counts=True))
            at = pa.array(np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array(np.concatenate([k for k, _ in rows])), pa.array(np.concatenate([n for _, n in rows]))], ["doc_id", "lang", "text_key", "key", "times"])

    def rules(batches):
        for b in G.batch_of(batches, 2):
            cols = zip(*(rule_counts(x.as_py() or b"") for x in b.column(2)), strict=True)
            size = [len(x.as_py() or b"") + 1 for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array(c, pa.int64()) for c in cols), pa.array(size, pa.int64())], ["doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "size"])

    k = d.withColumn("text_key", F.xxhash64("text"))
    keys = ["doc_id", "lang", "text_key"]
    grams = k.dropDuplicates(keys).mapInArrow(own, "doc_id long, lang string, text_key long, key long, times long")
    same = lambda a, b, names: [a[x].eqNullSafe(b[x]) for x in names]
    j = grams.join(model, same(grams, model, ["lang", "key"])).groupBy(grams["doc_id"], grams["lang"], "text_key").agg(F.sum(F.col("times") * F.col("value").cast("double")).alias("total"))
    r = k.mapInArrow(rules, "doc_id long, lang string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, size long")
    return r.join(j, same(r, j, keys)).select(r["doc_id"], r["lang"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "size", "total")


def perplexity_rules(docs: DataFrame, order: int = ORDER, lower: float = 8.0, upper: float = 6.0, short: float = 200.0, most_rows: int = 16_000_000, most_languages: int = 10_000, block_rows: int = 1_000_000) -> DataFrame:
    """Per document row: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, entropy
    (log10 a byte), low and high (the band for a text of this length), kept.

    Null and empty texts have no words and fail the base rule; a null language is a language. Repeated rows count, and are
    judged, each; an empty table gives an empty one. Further columns of docs are left out. `most_rows` and `most_languages`
    are the size of the model up to which it is broadcast; beyond, grams are joined with it. They and `block_rows` (see
    model_table) change no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counts = d.select("lang", "text").mapInArrow(_count(order), "lang string, key long, n_train long").groupBy("lang", "key").agg(F.sum("n_train").alias("n_train"))
    counts = written(counts, "kn-counts")
    model = written(model_table(counts, order, block_rows), "kn-model")
    langs = model.select("lang").distinct()
    if model.count() <= most_rows and langs.count() <= most_languages:
        # Languages travel as numbers: a row takes 16 bytes on the driver.
        names = [r.lang for r in langs.collect()]
        number = spark.createDataFrame(list(enumerate(names)), "number int, name string")
        rows = model.join(F.broadcast(number), model["lang"].eqNullSafe(number["name"])).select("number", "key", "value")
        lang, key, value = G.fetched(rows, [np.int32, np.int64, np.float32])
        at = np.argsort(lang, kind="stable")
        cut = np.searchsorted(lang[at], np.arange(len(names) + 1))
        models = {x: G.Lookup(key[at[lo:hi]], value[at[lo:hi]]) for x, lo, hi in zip(names, cut[:-1], cut[1:], strict=True)}
        out = d.mapInArrow(_score(order, spark.sparkContext.broadcast(models)), "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, size long, total double")
    else:
        out = _by_join(d, model, order)
    out = written(out.withColumn("entropy", -F.col("total") / F.col("size")), "kn-scores")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", base_failed)
    # A fixed number of quantiles a language; texts that fail the base rule don't shape the bands.
    bands = out.where("not base_failed").groupBy("lang").agg(F.percentile_approx("entropy", [0.25, 0.5, 0.75], 10_000).alias("q"))
    bands = bands.select(F.col("lang").alias("_lang"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))
    out = out.join(bands, out["lang"].eqNullSafe(bands["_lang"]), "left")
    wider = F.sqrt(1 + F.lit(short) / F.col("size"))
    least = F.lit(0.002)  # of log10 a byte, in languages with hardly any scatter
    out = out.withColumn("low", F.col("q2") - lower * wider * F.greatest(F.col("q2") - F.col("q1"), least)).withColumn("high", F.col("q2") + upper * wider * F.greatest(F.col("q3") - F.col("q2"), least))
    kept = ~F.col("base_failed") & F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", kept).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "entropy", "low", "high", "kept")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    r = perplexity_rules(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "entropy", "low", "high")
