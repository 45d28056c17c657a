"""Sources to chunks to vectors, with failures kept apart from what succeeds."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from copy import copy
from dataclasses import fields

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_CHARACTERS, Collection
from ..functions.embedding import Metrics
from ..functions.markdown import FIELDS, chunk_document, metadata_json

CHUNK_COLUMNS = "doc_type string, publication string, source_path string, release string, chunk_type string, chunk_index int, title string, heading string, content string, topic_type string, product string, classification string, last_updated string, object_name string, method_name string, metadata string, content_hash string"
PARSED = f"path string, blob_sha string, content_hash string, source_content string, n_chunks int, stage string, error string, chunks array<struct<{', '.join(c.replace(' ', ':', 1) for c in CHUNK_COLUMNS.split(', '))}>>"
_ARROW = pa.list_(pa.struct([(c.split()[0], pa.int32() if c.endswith("int") else pa.string()) for c in CHUNK_COLUMNS.split(", ")]))


def parse(sources: DataFrame, branch: str, family: str, most: int = CHUNK_CHARACTERS, collection: Collection = Collection()) -> DataFrame:
    """sources (path, blob_sha, content[, error]) -> a row a source: its chunks, or the stage and error that kept it from
    them. A chunk of another release than the family's is an error, told as one of embedding."""
    columns = ["path", "blob_sha", "content"] + (["error"] if "error" in sources.columns else [])

    def one(path, sha, content, error=None):
        if error is not None or content is None:
            return path, sha, None, None, None, "download", error or "no content", None
        try:
            chunks = chunk_document(path, content, branch, family, most, collection)
        except Exception as e:  # noqa: BLE001  told in the row
            return path, sha, None, None, None, "chunk", str(e), None
        if any(c["release"] != family for c in chunks):
            return path, sha, None, None, None, "embed", f"chunk source identity mismatch for {path}", None
        whole = next((c["metadata"]["full_content"] for c in chunks if isinstance(c["metadata"].get("full_content"), str)), content)
        rows = [{k: metadata_json(c[k]) if k == "metadata" else c[k] for k in FIELDS} for c in chunks]
        return path, sha, hashlib.sha1(content.encode(), usedforsecurity=False).hexdigest(), whole, len(rows), None, None, rows

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), _ARROW]
        names = [c.split()[0] for c in PARSED.split(", ")[:7]] + ["chunks"]
        for b in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return sources.select(columns).mapInArrow(run, PARSED)


def chunk_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").select("path", F.explode("chunks").alias("c")).select("path", "c.*")


def embed(chunks: DataFrame, provider, text: str = "content", counters: Mapping[str, Accumulator] | None = None) -> DataFrame:
    """chunks with embedding and error: batches sorted by length within each partition. Where a batch fails, the provider
    tells which texts did (`embed_some`), or its texts are embedded one by one; so one bad text costs only itself.

    counters: accumulators by the names of the provider's metrics, which get what the tasks have counted."""
    ordered = chunks.sortWithinPartitions(F.length(text))
    at = chunks.columns.index(text)
    schema = chunks.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("error", F.lit(None).cast("string")).schema

    def some(texts: list[str]) -> tuple[list, dict[int, Exception]]:
        try:
            return (provider.embed_some(texts) if hasattr(provider, "embed_some") else (list(provider.embed(texts)), {})) if texts else ([], {})
        except Exception as e:  # noqa: BLE001  told in the row
            if len(texts) == 1:
                return [None], {0: e}
        each = [some([t]) for t in texts]
        return [v[0] for v, _ in each], {k: x[0] for k, (_, x) in enumerate(each) if x}

    def run(batches):
        metrics = getattr(provider, "metrics", None)
        for b in batches:
            before = copy(metrics)
            vectors, lost = some(b.column(at).to_pylist())
            if counters and metrics is not None:
                for name, n in metrics.since(before).items():
                    counters[name].add(n)
            v = pa.array([None if x is None else [float(y) for y in x] for x in vectors], pa.list_(pa.float32()))
            errors = pa.array([str(lost[k]) if k in lost else None for k in range(b.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, v, errors], [*b.schema.names, "embedding", "error"])

    return ordered.mapInArrow(run, schema)


def metric_counters(spark: SparkSession) -> dict[str, Accumulator]:
    return {f.name: spark.sparkContext.accumulator(0) for f in fields(Metrics)}
