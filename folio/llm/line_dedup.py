"""Line de-duplication with two Bloom filters.

1. Each task hashes the keys of its lines, once per document, and sends the 64-bit hashes by segment of the hash space.
   A segment's reducer keeps a once-seen and a twice-seen Bloom filter: a hash that the first already holds enters the
   second. There are no false negatives.
2. The twice-seen filters (a fixed number of bytes at most; fewer bits only mean more suspects) go to all tasks. Only lines
   that they hold are shuffled, by their exact key: the smallest and the largest document of a key tell whether it
   repeats and who keeps it.
3. Documents that lose lines meet the numbers of these and are put together again; the others are passed on where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, table, written

PROBES = 4
SALTS = 32  # tasks that the documents of one key are dealt over, at most
NO_ID = 2**63 - 1  # stands for a null doc_id: the last document of all


def line_keys(text: bytes) -> list[bytes]:
    """The keys of the lines: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip() for x in text.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) bit numbers below 2**bits: double hashing with the low half and a mixed value."""
    step = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64((1 << bits) - 1) for i in range(PROBES)]).astype(np.int64)


def _in_filters(known: dict[int, tuple[int, np.ndarray]], h: np.ndarray, segments: int) -> np.ndarray:
    """Which hashes the filters of their segments hold; known: segment -> (bits, packed filter)."""
    out = np.zeros(len(h), bool)
    seg = _segment(h, segments)
    order = np.argsort(seg, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(seg[order])) + 1) if len(h) else []:
        if (f := known.get(int(seg[part[0]]))) is not None:
            at = _positions(h[part], f[0])
            out[part] = (f[1][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)
    return out


def _hashes(least: int, segments: int, flush: int = 1_000_000):
    def run(batches):
        held, n = [], 0

        def emit():
            h, times = np.unique(np.concatenate(held), return_counts=True)  # sorted, so each segment is one slice
            cut = np.searchsorted(_segment(h, segments), np.arange(segments + 1))
            full = [k for k in range(segments) if cut[k] < cut[k + 1]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([h[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()),
                    pa.array([np.packbits(times[cut[k] : cut[k + 1]] > 1).tobytes() for k in full], pa.binary()),
                ],
                ["segment", "hashes", "again"],
            )

        for b in batches:
            for text in b.column(0):
                keys = {xxhash.xxh3_64_intdigest(x) for x in set(line_keys(text.as_py() or b"")) if long_enough(x, least)}
                if keys:
                    held.append(np.fromiter(keys, np.uint64, len(keys)))
                    n += len(keys)
            if n >= flush:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    return run


def _filters(most_bytes: int, segments: int):
    """Of one segment: the twice-seen filter. Its size follows the hashes that came, within the segment's share of bytes."""

    def run(key, t):
        rows = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("hashes")]
        total = sum(map(len, rows))
        bits = max(10, min(int(total * 10).bit_length(), int(most_bytes * 8 // segments).bit_length() - 1))
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for h, again in zip(rows, t.column("again"), strict=True):
            at = _positions(h, bits)
            seen = once[at].all(axis=0) | np.unpackbits(np.frombuffer(again.as_py(), np.uint8), count=len(h)).astype(bool)
            twice[at[:, seen]] = True
            once[at] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.int32()), "twice": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    return run


def _suspects(filters, segments: int, least: int):
    def run(batches):
        known: dict[int, tuple[int, np.ndarray]] = {k: (bits, np.frombuffer(x, np.uint8)) for k, bits, x in filters.value}

        for b in batches:
            row, no, keys = [], [], []
            for r, text in enumerate(b.column(2)):
                for k, x in enumerate(line_keys(text.as_py() or b"")):
                    if long_enough(x, least):
                        row.append(r)
                        no.append(k)
                        keys.append(x)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            lines: dict[tuple[int, bytes], list[int]] = {}
            for i in np.flatnonzero(_in_filters(known, h, segments)):
                lines.setdefault((row[i], keys[i]), []).append(no[i])
            at = pa.array([r for r, _ in lines], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([x for _, x in lines], pa.binary()), pa.array(list(lines.values()), pa.list_(pa.int32()))], ["doc_id", "text_key", "key", "lines"])

    return run


def repeated_lines(docs: DataFrame, least: int = 10, filter_bytes: int = 1 << 28) -> DataFrame:
    """(doc_id, text_key, dropped array<int>): the line numbers, from 0, that each document loses.

    doc_id is NO_ID for null ids. `filter_bytes` bounds what is broadcast, not what is found.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    segments = 4 * partitions(spark)
    narrow = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    hashes = narrow.select("text").mapInArrow(_hashes(least, segments), "segment int, hashes binary, again binary")
    twice = hashes.groupBy("segment").applyInArrow(_filters(filter_bytes, segments), "segment int, bits int, twice binary")
    filters = spark.sparkContext.broadcast([(r.segment, r.bits, bytes(r.twice)) for r in twice.collect()])  # filter_bytes at most
    suspects = written(narrow.mapInArrow(_suspects(filters, segments, least), "doc_id long, text_key long, key binary, lines array<int>"), "line-suspects")
    # A key is dealt over SALTS tasks by document; its parts' smallest and largest ids are brought together, and go back out.
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("key", "salt").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    keepers = parts.groupBy("key").agg(F.min("low").alias("keeper"), F.max("high").alias("last"), F.collect_list("salt").alias("salts")).where("keeper < last")
    lost = salted.join(keepers.select("key", "keeper", F.explode("salts").alias("salt")), ["key", "salt"]).where("doc_id <> keeper")
    return lost.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("lines")).alias("dropped"))


def _loser_filter(most_bytes: int, segments: int):
    """Of one segment: a Bloom filter of the hashes of its documents that lose lines."""

    def run(key, t):
        h = t.column("h").to_numpy().view(np.uint64)
        bits = max(10, min(int(len(h) * 10).bit_length(), int(most_bytes * 8 // segments).bit_length() - 1))
        held = np.zeros(1 << bits, bool)
        held[_positions(h, bits)] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.int32()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    return run


def _held_back(filters, segments: int, want: bool):
    """The rows of docs whose hash the filters hold (`want`) or don't."""

    def run(batches):
        known = {k: (bits, np.frombuffer(x, np.uint8)) for k, bits, x in filters.value}
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            yield b.filter(pa.array(_in_filters(known, h, segments) == want))

    return run


def dedup_lines(docs: DataFrame, least: int = 10, filter_bytes: int = 1 << 28) -> DataFrame:
    """Per document row: doc_id, n_lines, n_dropped and kept, the text without the lines that an earlier document keeps.

    Lines end at line feeds; a null or empty text is one empty line. Lines with the same key (stripped, A-Z lower-cased)
    of at least `least` code points in two or more documents stay in the one with the smallest doc_id only; a null id
    counts as the largest. Rows that share a doc_id are one document. Further columns of docs are left out.

    Only texts that a Bloom filter of the losing documents lets through meet the line numbers in a shuffle.
    """
    spark = docs.sparkSession
    segments = 4 * partitions(spark)
    lost = written(repeated_lines(docs, least, filter_bytes).withColumn("h", F.xxhash64("doc_id", "text_key")), "line-lost")
    segment = F.floor(F.shiftrightunsigned("h", 32).cast("double") * segments / 2**32).cast("int")
    made = lost.select(segment.alias("segment"), "h").groupBy("segment").applyInArrow(_loser_filter(filter_bytes, segments), "segment int, bits int, held binary")
    filters = spark.sparkContext.broadcast([(r.segment, r.bits, bytes(r.held)) for r in made.collect()])  # filter_bytes at most
    text_key, doc_id = F.xxhash64("text"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long")
    d = docs.select(F.xxhash64(doc_id, text_key).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "h long, doc_id long, text_key long, text string"
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    whole = [n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept")]
    untouched = d.mapInArrow(_held_back(filters, segments, False), schema).select("doc_id", *whole)
    d = d.mapInArrow(_held_back(filters, segments, True), schema).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    d = d.join(lost.select(F.col("doc_id").alias("_id"), "text_key", "dropped"), ["_id", "text_key"], "left").withColumn("all", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("all")[i]), "\n"))
    cut = d.select("doc_id", F.size("all").cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"), kept.alias("kept"))
    return untouched.unionByName(cut)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    r = dedup_lines(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
