"""Token ids as length-delimited binary records.

A data file is a run of records, each the ids of one document as little-endian unsigned integers, framed as

    length (uint64) | masked checksum of length (uint32) | payload | masked checksum of payload (uint32)

The checksum is CRC-32; masking rotates it right by 15 bits and adds a constant, so that checksums of data that holds
checksums stay sound. Beside each data file lies an index: one (doc_id int64, null flag uint8, offset uint64, n_ids uint64)
entry a record, for reads in any order. Files follow each other in ascending doc_id order.

Integers have 16 bits where the vocabulary has at most 65536 ids, else 32; the index tells which, as it has the count.

A task writes its file under a name of its own attempt and then renames it, so a task that runs again or twice leaves
either the whole file or none. The writer and the reader use pyarrow's file systems, which take file, hdfs, s3 and gs paths.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, partitions, table
from .grams import batch_of

MASK = 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n_ids", "<u8")])


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int = 0) -> tuple[bytes, int]:
    """The payload of the record at `at` and where the next begins. Raises ValueError if a checksum or length is wrong."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"the length at byte {at} is damaged")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12 : end])
    if end + 4 > len(data) or struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"the record at byte {at} is damaged")
    return payload, end + 4


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Encoder:
    """Ids of texts by a tokenizers file, without its special tokens.

    Byte-level BPE splits a text before it merges. Between characters that are no white space it always splits before a
    single space and around a single line feed, and before a comma or full stop after a letter or digit. So the ids of what
    lies between such places don't depend on the rest of the text: they are worked out once and kept. Texts with runs of
    white space, or with a special token's string, and files of other kinds are encoded whole.
    """

    def __init__(self, file: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(file)
        self.keep, self.known = keep, {}
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        pre = t.pre_tokenizer
        self.apart = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and t.normalizer is None and isinstance(t.model, models.BPE)
        vocab = t.get_vocab()
        size = 1 + max(vocab.values())
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # Byte-level vocabularies write a space as this letter: such tokens begin a piece.
        self.begins = np.zeros(size, bool)
        self.begins[[i for x, i in vocab.items() if x.startswith("\u0120")]] = True
        # White space other than spaces and line feeds; a comma or full stop that follows neither a letter nor a digit.
        self.rare = re.compile("[\0\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.marks = re.compile(r"[,.](?<![^\W_][,.])").search

    def _learn(self, pieces: list[str]) -> None:
        spaced = [x for x in pieces if x[:1] == " "]
        rest = [x for x in pieces if x[:1] != " "]
        for k in range(0, len(spaced), 20_000):
            part = spaced[k : k + 20_000]
            joined = ["".join(part[i : i + 1000]) for i in range(0, len(part), 1000)]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            at = np.flatnonzero(self.begins[ids]) * self.kind.itemsize
            if len(at) != len(part):
                raise ValueError("the pieces of a text were not encoded apart")
            data = ids.tobytes()
            self.known.update(zip(part, map(data.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), len(data)])), strict=True))
        for k in range(0, len(rest), 5000):
            part = rest[k : k + 5000]
            for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[x] = np.array(e.ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as integers of the kind `self.kind`."""
        pieces = [self._pieces(x) or [] for x in texts]
        found = [list(map(self.known.get, p)) for p in pieces]
        missing = [(p, f, [i for i, v in enumerate(f) if v is None]) for p, f in zip(pieces, found, strict=True) if None in f]
        new = {p[i] for p, _, at in missing for i in at}
        if len(self.known) + len(new) > self.keep:  # what these texts have in it is what comes again most
            self.known = {q: v for p, f in zip(pieces, found, strict=True) for q, v in zip(p, f, strict=True) if v is not None}
        self._learn(list(new))
        for p, f, at in missing:
            for i in at:
                f[i] = self.known[p[i]]
        return [b"".join(f) if f else self.whole(x) if x else b"" for f, x in zip(found, texts, strict=True)]

    def _pieces(self, x: str) -> list[str] | None:
        if not self.apart or not x or any(r in x for r in ("  ", " \n", "\n ", "\n\n")) or self.rare(x) or x[0].isspace() or x[-1].isspace() or any(s in x for s in self.special):
            return None
        marked = x.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not self.marks(x):
            marked = marked.replace(",", "\0,").replace(".", "\0.")
        return marked.split("\0")


def encoder(file: str) -> Encoder:
    """The encoder of this worker process; what it has learned serves all tasks that the process runs."""
    kept = sys.modules.setdefault("_folio_worker", types.ModuleType("_folio_worker"))
    if getattr(kept, "file", None) != file:
        kept.file, kept.encoder = file, Encoder(file)
    return kept.encoder


def _write(path: str, file: str | None, end_id: int):
    def run(batches):
        k, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, root = place(path)
        encode = None
        data = index = None
        at = n = tokens = 0
        for b in batch_of(batches, 1):
            if encode is None:
                encode = encoder(file)
                end, width = np.array([end_id], encode.kind).tobytes(), encode.kind.itemsize
                data = system.open_output_stream(f"{root}/.{attempt}.records")
                index = system.open_output_stream(f"{root}/.{attempt}.index")
            texts = [x or "" for x in b.column(1).to_pylist()]
            for d, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                r = frame(ids)
                data.write(r)
                index.write(np.array([(d or 0, d is None, at, len(ids) // width)], INDEX).tobytes())
                at, n, tokens = at + len(r), n + 1, tokens + len(ids) // width
        if data is not None:
            data.close()
            index.close()
            for kind in ("records", "index"):
                system.move(f"{root}/.{attempt}.{kind}", f"{root}/{k:08d}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": [k], "n_docs": [n], "n_ids": [tokens]})

    return run


def write_records(docs: DataFrame, path: str, file: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write the ids of every whole text, `end_id` appended; returns the manifest (shard, n_docs, n_ids, start), a row a file.

    docs needs doc_id and text; rows go by ascending doc_id, nulls first, then by text. A null or empty text is the end id
    alone, repeated rows are records of their own, an empty table writes no file. Further columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    system, root = place(path)
    system.create_dir(root, recursive=True)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # xxhash64 tells rows of one doc_id apart, so that a much repeated id is dealt over several files.
    order = ["doc_id", F.xxhash64("text")]
    d = d.repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    parts = d.mapInArrow(_write(path, file, end_id), "shard long, n_docs long, n_ids long").collect()  # a row a file
    rows, start = [], 0
    for r in sorted(parts, key=lambda r: r.shard):
        rows.append((r.shard, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "shard long, n_docs long, n_ids long, start long")


def _read(path: str):
    def run(batches):
        system, root = place(path)
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{shard:08d}.index") as f:
                    index = np.frombuffer(f.read(), INDEX)
                begin = start + np.concatenate([[0], np.cumsum(index["n_ids"].astype(np.int64))[:-1]]).astype(np.int64)
                with system.open_input_file(f"{root}/{shard:08d}.records") as f:
                    for lo in range(0, len(index), 1000):
                        part = index[lo : lo + 1000]
                        first, last = int(part["offset"][0]), int(index["offset"][lo + 1000]) if lo + 1000 < len(index) else f.size()
                        f.seek(first)
                        data = memoryview(f.read(last - first))
                        ids = [unframe(data, int(x["offset"]) - first)[0] for x in part]
                        width = len(ids[0]) // int(part["n_ids"][0])  # a text has its end id at least
                        if width not in (2, 4) or any(len(p) != width * int(x["n_ids"]) for p, x in zip(ids, part, strict=True)):
                            raise ValueError(f"the index of shard {shard} doesn't fit its records")
                        ids = [np.frombuffer(p, f"<u{width}").astype("<u4").tobytes() for p in ids]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["doc_id"], pa.int64(), mask=part["null"].astype(bool)), pa.array(begin[lo : lo + 1000], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"]
                        )

    return run


def read_records(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary, 32 bits each) of each record: read through the index, checksums verified."""
    m = manifest.select("shard", "start").repartition(max(1, min(manifest.count(), 4 * partitions(spark))))
    return m.mapInArrow(_read(path), "doc_id long, start long, ids binary")


def op4_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    r = read_records(spark, path, manifest)
    return r.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
