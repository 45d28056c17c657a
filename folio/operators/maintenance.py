"""Index maintenance as DataFrames: change and deletion detection, replacement of sources, counters, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def changed_sources(listing: DataFrame, stored: DataFrame, refresh: bool = False) -> DataFrame:
    """Listing rows whose hash differs from the stored one, or that aren't stored; all of them to refresh."""
    if refresh:
        return listing
    known = stored.select("path", F.col("blob_sha").alias("_known"))
    return listing.join(known, "path", "left").where(~F.col("blob_sha").eqNullSafe(F.col("_known"))).drop("_known")


def deleted_sources(listing: DataFrame, stored: DataFrame, limited: bool = False) -> DataFrame:
    """Stored paths that the listing lacks; none if the listing was cut short."""
    gone = stored.select("path").join(listing.select("path"), "path", "left_anti")
    return gone.limit(0) if limited else gone


def replaced(existing: DataFrame, affected: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing without the affected keys, and the new rows: both by one anti-join, in one new table."""
    return existing.join(affected.select(keys).distinct(), keys, "left_anti").unionByName(new)


def chunk_id(release: Column, path: Column, index: Column) -> Column:
    """The same for the same chunk, in whatever order sources come."""
    return F.xxhash64(release, path, index.cast("int"))


def complete_sources(expected: DataFrame, embedded: DataFrame) -> DataFrame:
    """Paths of which every chunk has a vector; expected (path, n_chunks), embedded (path, ...) one row a vector. Sources
    without chunks are complete."""
    got = embedded.groupBy("path").agg(F.count(F.lit(1)).alias("_got"))
    return expected.join(got, "path", "left").where(F.coalesce("_got", F.lit(0)) == F.col("n_chunks")).select("path")


def update_counts(prepared: DataFrame, stored: DataFrame) -> DataFrame:
    """added, changed and chunks of the prepared sources (path, n_chunks)."""
    known = stored.select("path", F.lit(True).alias("_known"))
    j = prepared.join(known, "path", "left")
    return j.agg(F.count_if(F.col("_known").isNull()).alias("added"), F.count_if(F.col("_known").isNotNull()).alias("changed"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))


def documents_of(chunks: DataFrame, path: str, release: str | None = None) -> DataFrame:
    """The chunks of a source in order; without a release, those of all releases, the last release first."""
    d = chunks.where(F.col("source_path") == path)
    return d.where(F.col("release") == release.lower()).orderBy("chunk_index") if release else d.orderBy(F.desc("release"), "chunk_index")


def content_of(sources: DataFrame, path: str, release: str | None = None) -> DataFrame:
    """The stored text of a source: of the release, or of the last that has it."""
    d = sources.where(F.col("source_path") == path)
    d = d.where(F.col("release") == release.lower()) if release else d
    return d.orderBy(F.desc("release")).limit(1).select("content")


def publications(chunks: DataFrame, release: str | None = None) -> DataFrame:
    d = chunks.where(F.col("chunk_type") == "overview")
    d = d.where(F.col("release") == release.lower()) if release else d
    return d.groupBy("publication", "doc_type", "release").agg(F.count_distinct("source_path").alias("document_count")).orderBy("doc_type", "publication", "release")


def stats(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, releases."""
    a = sources.agg(F.count(F.lit(1)).alias("documents"), F.array_sort(F.collect_set("release")).alias("releases"))
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(a).select("documents", "chunks", "releases")  # one row each


def compact_results(results: DataFrame, metadata: bool = False) -> DataFrame:
    """Hits for a reader: without metadata and hash, with the source's address; with `metadata`, as they are."""
    url = F.get_json_object("metadata", "$.url")
    return results.withColumn("source_url", blank_to_null(url)) if metadata else results.withColumn("source_url", blank_to_null(url)).drop("metadata", "content_hash")
