"""MinHash near-duplicate detection by min-max hashing.

Each hash function gives two signature values, the least and the largest hash of the set, so half as many functions are
evaluated. Documents with equal shingle sets are one class from the start; only one of each class goes on. A band is three
functions (six values); classes that share a band meet in a bucket. There are so many bands that a pair at the wanted
similarity shares none with a chance of 1e-5 (26 bands at 0.85).

No bucket is expanded into all its pairs. Its members are compared with a few pivots, the shared full sets decide, and the
links found so far are joined into components: pairs already connected need no comparison. Buckets that still hold more
than one component go on with more pivots (those with the most links first) until every pair in them is connected or has
been compared. No candidate is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import anti_join, bounded_batches, remove, semi_join, table, written
from .components import components
from .shingles import shingle_set

PER_BAND, MISSED = 3, 1e-5
_rng = np.random.default_rng(20240607)
#: Buckets of up to so many members have all their pairs compared in the first round.
SMALL = 6
#: The later rounds compare bits of BIT_FUNCTIONS further functions, one of each least and one of each largest hash, before
#: full sets. Bits of two sets of similarity s agree with chance (1 + s) / 2; a pair is passed on up to SIGMAS standard
#: deviations beyond the expected difference at the wanted similarity, so that about one linked pair in 1e6 is missed.
BIT_FUNCTIONS, WORDS, SIGMAS = 1024, 32, 5
BIT_FACTORS, BIT_OFFSETS = (_rng.integers(0, 2**63, BIT_FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def bands_for(percent: int) -> int:
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - min(0.999, percent / 100) ** (2 * PER_BAND))))


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n hash functions, always the same."""
    r = np.random.default_rng(7)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def signature(s: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(functions, 2) uint32: the least and the largest value of each hash function over the set."""
    low, high = np.full(len(factors), 2**32 - 1, np.uint32), np.zeros(len(factors), np.uint32)
    step = 300_000 // len(factors)
    for k in range(0, len(s), step):
        v = ((s[None, k : k + step] * factors[:, None] + offsets[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def band_keys(sig: np.ndarray) -> list[int]:
    rows = sig.reshape(-1, PER_BAND * 2)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=k) - 2**63 for k, r in enumerate(rows)]


def signature_bits(s: np.ndarray) -> np.ndarray:
    return np.packbits((signature(s, BIT_FACTORS, BIT_OFFSETS) & np.uint32(1)).astype(np.uint8).ravel()).view(np.int64)


def most_different(percent: int) -> int:
    """Bits in which sets of that similarity differ at most, but for one pair in 1e6 or so."""
    n, p = 2 * BIT_FUNCTIONS, (1 - percent / 100) / 2
    return int(n * p + SIGMAS * (n * p * (1 - p)) ** 0.5)


def _sketches(width: int, bands_wanted: int):
    factors, offsets = functions(bands_wanted * PER_BAND)

    def run(batches):
        for b in batches:
            keys, n, bands = [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), width)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                n.append(len(s))
                bands.append(band_keys(signature(s, factors, offsets)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "set_key", "n", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in b.column(1)], pa.binary())], ["id", "shingles"])

    return run


def _bits(batches):
    for b in batches:
        w = np.array([signature_bits(np.frombuffer(x.as_buffer(), np.uint64)) for x in b.column(1)]).reshape(-1, WORDS)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(w[:, k]) for k in range(WORDS))], ["id", *(f"w{k}" for k in range(WORDS))])


def _confirmed(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            held, s = None, np.zeros(0, np.uint64)
            for x, y in zip(b.column(2), b.column(3), strict=True):
                if held is None or not x.as_buffer().equals(held):
                    held = x.as_buffer()
                    s = np.frombuffer(held, np.uint64)
                t = np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (s, t) if len(s) < len(t) else (t, s)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def links(docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """(id, component) of the classes in a link. classes: id, n, bands."""
    rows = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(rows.join(shared, "key"), "dedup-buckets")
    ids = written(buckets.select("id").distinct(), "dedup-ids", narrow=True)
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    # The ids are broadcast only where they are few; else both sides are shuffled.
    sets = written(d.join(F.broadcast(ids) if ids.count() <= 2_000_000 else ids, "id", "left_semi").mapInArrow(_sets(width), "id long, shingles binary"), "dedup-sets")
    words = [f"w{k}" for k in range(WORDS)]
    found = joined = tested = bits = None
    held: list[str] = []  # further columns of the rows, from the second round on
    pivots = 1
    active = buckets.withColumn("component", F.col("id")).withColumn("degree", F.lit(0).cast("long"))
    while True:
        order = Window.partitionBy("key").orderBy(F.desc("degree"), F.xxhash64("id", "key"))
        # Of a large bucket, each task passes `pivots` rows on at most; all members of a small one are pivots.
        lead = active.where(F.col("size") > SMALL).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots).drop("rank")
        lead = lead.unionByName(active.where(F.col("size") <= SMALL)) if bits is None else lead
        lead = written(lead.select("key", F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("component").alias("pivot_component"), *(F.col(w).alias(f"pivot_{w}") for w in held)), "dedup-pivots", narrow=True)
        near = (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")) & (F.col("id") != F.col("pivot")) & (F.col("component") != F.col("pivot_component"))
        if bits:
            near &= sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"pivot_{w}"))) for w in words), F.lit(0)) <= most_different(percent)
            # A pair is compared in the first bucket that both are in, and there only.
            near &= F.array_position(F.zip_with("bands", "pivot_bands", lambda x, y: x == y), F.lit(True)) == F.array_position("bands", F.col("key"))
        pairs = active.join(lead, "key").where(near).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "dedup-pairs", narrow=True)
        tested = pairs if tested is None else tested.unionByName(pairs)
        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        new = written(full.select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long").distinct(), "dedup-links", narrow=True)
        found = new if found is None else found.unionByName(new)
        if joined is None or not new.isEmpty():
            joined = components(new if joined is None else new.unionByName(joined.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        # What is left: large buckets with members of two components at least, without the pivots, which met all of them.
        rest = active.select("id", "n", "key", "size", *held).where(F.col("size") > SMALL).join(lead.select("key", F.col("pivot").alias("id")), ["key", "id"], "left_anti")
        degree = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        rest = rest.join(joined.join(degree, "id", "left"), "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
        rest = written(rest, "dedup-active", narrow=True)
        several = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        active = rest.join(several, "key")
        if bits is None:
            bits = active.select("id").distinct().join(sets, "id").mapInArrow(_bits, "id long, " + ", ".join(f"{w} long" for w in words))
            active = active.join(bits, "id").join(classes.select("id", "bands"), "id")
            held = [*words, "bands"]
        active = written(active, "dedup-active", narrow=True)
        remove(docs.sparkSession, rest)
        if active.isEmpty():
            return joined
        pivots *= 64


def _classified(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Per document row: doc_id, text_key (a hash of the text), n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    sketch = written(narrow.mapInArrow(_sketches(width, bands_for(percent)), "doc_id long, text_key long, set_key binary, n long, bands array<long>"), "dedup-sketch")
    # One row a set: the bands are those of any document that has it.
    classes = sketch.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "dedup-classes")
    joined = links(docs, classes, percent, width)
    label = classes.select("set_key", "id").join(joined, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    out = sketch.select("doc_id", "text_key", "set_key", "n").join(label, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of distinct shingles have 100 * intersection >= percent * union; component_id is
    the least doc_id that links reach. Null, empty and white texts have no shingles and no links. A null doc_id links
    nothing by itself: it takes the component of the documents with its set, else null. Rows that share a doc_id are one
    document: repeated rows give equal rows. Further columns of docs are left out.
    """
    return _classified(docs, percent, width).drop("text_key")


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs without the documents whose component is kept through another; of rows equal in id and text one stays.
    Rows without an id have no component of their own to go by, so they all stay, but for repeated ones.

    Decided on ids and hashes of texts; texts are shuffled only where they are repeated under one id, and where the lost ids
    are too many to broadcast."""
    rows = written(_classified(docs, percent, width).select("doc_id", "text_key", "kept"), "dedup-kept")
    lost = written(rows.where("not kept and doc_id is not null").select("doc_id").distinct(), "dedup-lost", narrow=True)
    out = anti_join(docs, {"doc_id": F.col("doc_id")}, lost)
    again = written(rows.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "dedup-again", narrow=True)
    if again.isEmpty():
        return out
    key = {"doc_id": F.col("doc_id"), "text_key": F.xxhash64("text")}
    return anti_join(out, key, again).unionByName(semi_join(out, key, again).dropDuplicates(["doc_id", "text"]))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
