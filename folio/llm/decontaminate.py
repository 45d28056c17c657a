"""Benchmark decontamination: a prefix-filtered join of documents with item windows, in DataFrame functions only.

A window is `width` consecutive words of a benchmark item (the whole item if it is shorter). For exact containment the
necessary prefix of a window, with its words ordered by rarity, is its rarest word alone; so each window is indexed by
that word and its offset. Rarity is counted over all documents. A document word that equals the prefix word of a window
gives the one start at which the window could lie there; length and position bounds discard starts outside the text and
the words are then compared exactly.

Windows are broadcast in blocks of at most `block` rows, whatever the size of the benchmark; each block is one scan.
Documents are never shuffled: only verified occurrences and one row for each document are.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_join, lower_ascii, table, written

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No word holds this character; as a token it stands for the end of a document.
END = "\x00"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def item_windows(items: DataFrame, width: int = 13) -> DataFrame:
    """(window array<string>, item_ids array<string>): the distinct windows and the items that have them."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    return (
        w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.least(F.lit(width), F.size("w"))))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def _tokens(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))


def _indexed(docs: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """Windows with their rarest word and its offset; rarity is the count of the word over all documents."""
    vocab = written(windows.select(F.explode("window").alias("token")).distinct(), "decon-vocab", narrow=True)
    parts = -(-vocab.count() // block) or 1
    counts = None
    for k in range(parts):
        part = vocab if parts == 1 else vocab.where(F.pmod(F.hash("token"), F.lit(parts)) == k)
        # Joined by a hash of the word, which is faster; should two words share one, only the estimate of rarity is off.
        seen = _tokens(docs).select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("h"))
        seen = seen.join(F.broadcast(part.select(F.xxhash64("token").alias("h")).distinct()), "h").groupBy("h").count()
        counts = seen if counts is None else counts.unionByName(seen)
    rarity = vocab.withColumn("h", F.xxhash64("token")).join(counts.groupBy("h").agg(F.sum("count").alias("count")), "h", "left").select("token", F.coalesce("count", F.lit(0)).alias("n"))
    placed = windows.withColumn("key", F.xxhash64("window")).select("key", "window", "item_ids", F.posexplode("window").alias("off", "token"))
    rarest = placed.join(rarity, "token").groupBy("key", "window").agg(F.min(F.struct("n", "token", "off")).alias("p"), F.first("item_ids").alias("item_ids"))
    return rarest.select(F.col("p.token").alias("token"), F.col("p.off").alias("off"), F.size("window").alias("len"), "window", "item_ids")


def occurrences(docs: DataFrame, items: DataFrame, width: int = 13, block: int = 200_000) -> DataFrame:
    """One row for each document row and each occurrence of a window in it.

    docs needs doc_id and text; further columns are left out. Returns doc_id, text_key (tells texts with one doc_id
    apart), n_words, start (first word, from 0), len and item_ids. Each document also gives one row with n_words set and
    start null. Null or empty texts have no words; items without words have no windows; repeated rows repeat their rows.
    """
    # The windows are few, so each of the two small joins stays small; the table cuts the lineage before the second scan.
    indexed = written(_indexed(docs, written(item_windows(items, width), "decon-windows", narrow=True), block), "decon-index", narrow=True)
    parts = -(-indexed.count() // block) or 1
    out = None
    for k in range(parts):
        part = indexed if parts == 1 else indexed.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k)
        if k == 0:
            none = "cast(null as array<string>)"
            end = docs.sparkSession.range(1).select(F.lit(END).alias("token"), F.lit(0).alias("off"), F.lit(0).alias("len"), F.expr(none).alias("window"), F.expr(none).alias("item_ids"))
            part = part.unionByName(end)
        d = _tokens(docs, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
        d = d.select("doc_id", "text_key", "words", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "word"))
        part = part.withColumn("h", F.xxhash64("token"))
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.col("len") <= F.size("words"))
        same = F.slice(F.col("words"), F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("window")
        last = F.col("len") == 0
        hit = d.join(F.broadcast(part), (F.xxhash64("word") == F.col("h")) & F.when(last, F.col("pos") == F.size("words")).otherwise(fits & same))
        hit = hit.select(
            "doc_id",
            "text_key",
            F.when(last, F.col("pos").cast("long")).alias("n_words"),
            F.when(~last, start).alias("start"),
            "len",
            "item_ids",
        )
        out = hit if out is None else out.unionByName(hit)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, min_share: float | Fraction = 0.05, block: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated, and the hit word spans.

    contaminated: at least one word is hit and the hit words are at least min_share of all, compared in whole numbers (a
    float counts as the decimal it is written as; 0 asks for one hit word). Rows that repeat a doc_id with the same text
    give one row each with equal results; rows with null doc_id are documents of their own text. Empty tables give no rows
    or no hits, and further columns are left out.
    """
    occ = occurrences(docs, items, width, block)
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("len")).alias("end"))
    g = occ.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
    )["n"].cast("long")
    g = g.withColumn("n_hit", merged).withColumn("n_items", F.size("item_ids").cast("long"))
    share = Fraction(str(min_share))
    g = g.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(share.denominator) >= F.col("n_words") * F.lit(share.numerator)))
    g = g.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return g.select("doc_id", "text_key", "n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated")


def clean(docs: DataFrame, items: DataFrame, width: int = 13, min_share: float | Fraction = 0) -> DataFrame:
    """The documents that are not contaminated, with their columns; by default those in which no window occurs.

    Null and empty texts, null ids and repeated rows stay unless their own text is contaminated; columns of any name stay.
    """
    bad = decontaminate(docs, items, width, min_share).where("contaminated").select("doc_id", "text_key").distinct()
    return anti_join(docs, {"doc_id": F.col("doc_id"), "text_key": F.xxhash64(F.coalesce("text", F.lit("")))}, written(bad, "decon-bad"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    r = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
