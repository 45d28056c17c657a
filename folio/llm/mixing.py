"""Mixing sources to target weights: temperature mixing, realised by budgeted block permutations.

A source with share p of all tokens gets the weight p**a / sum(p**a). The exponent a is bisected between 1 (natural shares)
and 0 (equal shares): the smallest one, that is the flattest mix, whose weights keep a limit on repetition, or the largest
one whose weights reach a target entropy. The budget is such that the least repeated source is read once, so no document is
left out; others are read up to `most_repeats` times.

A source's documents fall into blocks by hash. Each pass over a source takes its blocks in an order of its own; the last
pass, if it is not whole, takes blocks in order until the source's budget is met, and the documents of the block where that
happens in order of a hash likewise. Where it happens is found with sums by block, then by range of the hash, then in the one
range that is left; so the plan is one row a source, and the documents are read once more and moved nowhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCKS = 256
RANGE_SHIFT = 52  # the signed hash falls into 2**12 ranges
#: Stands for a null source among the names.
NO_SOURCE = "\x00null"


def token_count(text: Column) -> Column:
    """Words between ASCII white space, and one end."""
    return (F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")) + 1).cast("long")


def entropy(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Of the weights for each exponent; shares (p) may have any number of sources."""
    cols = [x for a in exponents for x in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")))]
    r = shares.agg(*cols).first()
    return [math.log(r[2 * k]) - a * r[2 * k + 1] / r[2 * k] for k, a in enumerate(exponents)]


def exponent(shares: DataFrame, most_repeats: float | None = 2.0, target_entropy: float | None = None, steps: int = 40) -> float:
    """The exponent that meets the limits; shares has the columns source and p > 0.

    With both, the target is met only as far as the limit on repetition lets it.
    """
    low = 0.0
    if most_repeats is not None:
        least, most = shares.agg(F.min("p"), F.max("p")).first()
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            # p**(a - 1) is how often a source is read, but for a factor.
            lo, hi = (lo, mid) if (mid - 1) * (math.log(least) - math.log(most)) <= math.log(most_repeats) else (mid, hi)
        low = hi
        if math.log(most) - math.log(least) <= math.log(most_repeats):
            low = 0.0
    if target_entropy is None:
        return low
    lo, hi = low, 1.0  # the entropy falls as the exponent grows
    for _ in range(5):  # each step splits the range in 17 with one aggregation
        grid = [lo + (hi - lo) * k / 16 for k in range(17)]
        reached = [h >= target_entropy for h in entropy(shares, grid)]
        if reached[-1]:
            return hi
        if not reached[0]:
            return lo
        k = max(i for i, x in enumerate(reached) if x)
        lo, hi = grid[k], grid[k + 1]
    return lo


def _order(*c) -> Column:
    return F.xxhash64(*c)


def _cuts(d: DataFrame, cut: DataFrame, few: bool) -> DataFrame:
    """Where the last pass ends inside the block `cut` (_source, cut_block, whole, left): (_source, cut_range, cut_turn).

    Documents before cut_range are taken, and those in it up to cut_turn (null: none). Rows equal in id and text share a turn
    and are taken together, or not at all."""
    turns = d.select("_source", F.col("_block").alias("cut_block"), "_h", "_tokens").join(F.broadcast(cut) if few else cut, ["_source", "cut_block"])
    turns = turns.groupBy("_source", "left", _order("_h", "whole").alias("turn")).agg(F.sum("_tokens").alias("n"))
    turns = written(turns.withColumn("range", F.shiftright("turn", RANGE_SHIFT)), "mix-turns")
    before = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2**12 rows a source at most
    sums = turns.groupBy("_source", "left", "range").agg(F.sum("n").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = sums.where("start <= left and start + n > left").select("_source", "range", "start")
    inner = Window.partitionBy("_source").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)  # one range of 2**12
    ends = turns.join(F.broadcast(at) if few else at, ["_source", "range"]).withColumn("end", F.col("start") + F.sum("n").over(inner))
    return ends.groupBy("_source").agg(F.first("range").alias("cut_range"), F.max(F.when(F.col("end") <= F.col("left"), F.col("turn"))).alias("cut_turn"))


def mix(docs: DataFrame, source: str = "source", most_repeats: float | None = 2.0, target_entropy: float | None = None, seed: int = 1, blocks: int = BLOCKS, most_sources: int = 200_000) -> DataFrame:
    """docs, each row once for each pass that takes it, with mix_pass (from 0), mix_block (its place in the pass) and
    mix_position in [0, 1): sorting by the latter interleaves the sources by their weights all along.

    Null sources are a source. Every row comes at least once: repeated rows count as rows of their own (those equal in id
    and text share their passes) and null or empty texts as one token. An empty table gives an empty table. Columns of docs
    with those names are replaced. The plan is broadcast for up to `most_sources` sources, and joined beyond.
    """
    d = docs.drop("mix_pass", "mix_block", "mix_position")
    d = d.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))).withColumn("_tokens", token_count(F.col("text")))
    d = d.withColumn("_h", _order("doc_id", "text", F.lit(seed))).withColumn("_block", F.pmod("_h", F.lit(blocks)).cast("int"))
    sizes = written(d.groupBy("_source", "_block").agg(F.sum("_tokens").alias("tokens")), "mix-blocks")
    sources = sizes.groupBy("_source").agg(F.sum("tokens").alias("total"))
    everything = sources.agg(F.sum("total")).first()[0]
    if everything is None:
        none = d.drop("_source", "_tokens", "_h", "_block")
        return none.withColumn("mix_pass", F.lit(0)).withColumn("mix_block", F.lit(0)).withColumn("mix_position", F.lit(0.0))
    shares = sources.withColumn("p", F.col("total") / F.lit(everything))
    a = exponent(shares, most_repeats, target_entropy)
    top = shares.agg(F.max("p")).first()[0]  # of the source that is read once
    repeats = F.pow(F.col("p") / F.lit(top), F.lit(a - 1.0))
    plan = shares.withColumn("repeats", repeats).withColumn("whole", F.floor(F.col("repeats") + 1e-9).cast("int"))
    plan = plan.withColumn("extra", F.greatest(F.lit(0), F.floor((F.col("repeats") - F.col("whole")) * F.col("total"))).cast("long"))
    # The last pass: blocks in its order until the budget `extra` is met.
    place_in_pass = F.struct(_order("_source", "_block", "whole", F.lit(seed)).alias("turn"), F.col("_block").alias("block"))
    in_order = Window.partitionBy("_source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # `blocks` rows a source
    b = sizes.join(plan.drop("p"), "_source").withColumn("place", place_in_pass)
    b = b.withColumn("left", F.col("extra") - (F.sum("tokens").over(in_order) - F.col("tokens")))
    ends = b.groupBy("_source", "repeats", "whole").agg(
        F.max(F.when(F.col("left") >= F.col("tokens"), F.col("place"))).alias("last"),
        F.max(F.when((F.col("left") > 0) & (F.col("left") < F.col("tokens")), F.struct(F.col("_block").alias("block"), "left"))).alias("cut"),
    )
    ends = written(ends.select("_source", "repeats", "whole", "last", F.col("cut.block").alias("cut_block"), F.col("cut.left").alias("left")), "mix-ends")
    few = ends.count() <= most_sources
    cuts = _cuts(d, ends.where("cut_block is not null").select("_source", "cut_block", "whole", "left"), few)
    ends = ends.drop("left").join(cuts, "_source", "left")
    j = d.join(F.broadcast(ends) if few else ends, "_source")
    turn = _order("_h", "whole")
    inside = (F.col("_block") == F.col("cut_block")) & ((F.shiftright(turn, RANGE_SHIFT) < F.col("cut_range")) | ((F.shiftright(turn, RANGE_SHIFT) == F.col("cut_range")) & (turn <= F.col("cut_turn"))))
    again = F.coalesce(place_in_pass <= F.col("last"), F.lit(False)) | F.coalesce(inside, F.lit(False))
    out = j.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("whole") - F.when(again, 0).otherwise(1))))
    # A block's place among the blocks of its pass, and a document's within the block, by hash.
    place = F.pmod(_order("_source", "_block", "mix_pass", F.lit(seed)), F.lit(1 << 20))
    within = F.pmod(_order("_h", "mix_pass"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = out.withColumn("mix_block", place.cast("int")).withColumn("mix_position", F.least((F.col("mix_pass") + (F.col("mix_block") + within) / F.lit(float(1 << 20))) / F.greatest("repeats", F.col("mix_pass") + 1), F.lit(1 - 1e-12)))
    return out.drop("_source", "_tokens", "_h", "_block", "repeats", "whole", "last", "cut_block", "cut_range", "cut_turn")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_pass", "mix_block", "mix_position", token_count(F.col("text")).alias("tokens"))
