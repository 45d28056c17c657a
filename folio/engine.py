"""The engine: update an index from sources, search it and read from it."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FAMILY, FAMILY_NAME, LIMIT, LIMIT_RANGE, OVERSAMPLE, OVERSAMPLE_RANGE, PER_SOURCE, PER_SOURCE_RANGE, PREVIEW_CHARACTERS, SEARCH_SCHEMA_VERSION, THRESHOLD, THRESHOLD_RANGE, Collection
from .functions.embedding import HashProvider, chunk_budget, embed_query
from .operators import fulltext, maintenance
from .plans.ingest import chunk_rows, embed, metric_counters, parse
from .plans.search import search, search_many
from .sources.index import IndexStore
from .sources.listing import first_sources


@contextmanager
def pool(spark: SparkSession, name: str):
    """Run what is started inside in a scheduler pool of its own (`search`, `update`): with spark.scheduler.mode=FAIR a query
    gets its share of the cluster while an update runs. Results of `search` are plans; start them inside too."""
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"folio-{name}")
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)


def _in_range(name: str, value: Any, low: float, high: float, whole: bool) -> None:
    if isinstance(value, bool) or not isinstance(value, int if whole else (int, float)) or not low <= value <= high:
        raise ValueError(f"{name} must be {'an integer' if whole else 'a number'} from {low} to {high}")


class Engine:
    """An index in `root`, with one embedding provider for documents and queries.

    Without `embeds` the provider isn't held against the index: for reading and for a reset.
    """

    def __init__(self, spark: SparkSession, root: str, provider=None, profile: str | None = None, oversample: int = OVERSAMPLE, collection: Collection = Collection(), embeds: bool = True):
        _in_range("oversample", oversample, *OVERSAMPLE_RANGE, True)
        self.spark, self.provider, self.profile, self.oversample, self.collection = spark, provider or HashProvider(), profile, oversample, collection
        self.store = IndexStore(spark, root)
        self.embeds = embeds
        if embeds:
            self.store.check(self._configuration())

    def _configuration(self) -> dict[str, Any]:
        p = self.provider
        get = lambda name, default=None: getattr(p, name, default)
        return {"embedding_profile": self.profile, "embedding_provider": p.name, "embedding_model": p.model, "document_embedding_model": get("endpoint_model"), "dimensions": p.dimensions, "pooling": get("pooling", "mean"), "layer_norm": get("layer_norm"), "document_prefix": get("document_prefix", ""), "query_prefix": get("query_prefix", ""), "max_characters": get("max_characters"), "dtype": get("dtype")}

    # --- update ---------------------------------------------------------------------------------------------------------

    def update(self, listing: DataFrame, family: str = FAMILY, branch: str | None = None, limit: int | None = None, refresh: bool = False, commit: str | None = None, partial: bool = False, fetch=None) -> dict[str, Any]:
        """Bring the release `family` up to the listing (path, blob_sha, content); returns counts and failures.

        Sources that fail keep the version they had and are tried again by the next update. `partial` listings delete
        nothing; without a content column, `fetch` (a function of a listing) gets content and errors for changed sources.
        """
        family = family.lower()
        if not FAMILY_NAME.match(family):
            raise ValueError(f"invalid family name: {family}")
        if limit is not None:
            _in_range("limit", limit, 1, 2**31, True)
        listing = first_sources(listing, limit)
        stored = self.store.table("sources", family).select(F.col("source_path").alias("path"), "blob_sha")
        deleted = maintenance.deleted_sources(listing, stored, limited=limit is not None or partial)
        changed = maintenance.changed_sources(listing, stored, refresh)
        if "content" not in changed.columns:
            changed = fetch(changed)
        # Parsed and embedded rows are used several times. They are written, so that a lost executor has nothing embedded again.
        counters = metric_counters(self.spark)
        with self.store.staged() as stage, pool(self.spark, "update"):
            parsed = stage(parse(changed, branch or family, family, chunk_budget(getattr(self.provider, "max_characters", None)), self.collection), "parsed")
            vectors = stage(embed(chunk_rows(parsed), self.provider, counters=counters), "vectors")
            done = self._commit(listing, stored, deleted, parsed, vectors, family, branch or family, commit)
        return done | {"metrics": {k: c.value for k, c in counters.items()}}

    def _commit(self, listing, stored, deleted, parsed, vectors, family, branch, commit) -> dict[str, Any]:
        failed = vectors.where("error is not null").groupBy("path").agg(F.first("error").alias("error")).select(F.col("path").alias("source_path"), F.lit("embed").alias("stage"), "error")
        failures = parsed.where("error is not null").select(F.col("path").alias("source_path"), "stage", "error").unionByName(failed)
        fine = parsed.where("error is null")
        done = maintenance.complete_sources(fine.select("path", "n_chunks"), vectors.where("error is null").select("path"))
        prepared = fine.join(done, "path")
        affected = done.unionByName(deleted).select(F.col("path").alias("source_path"))
        chunks = vectors.join(done, "path", "left_semi").drop("path", "error").withColumn("id", maintenance.chunk_id(F.col("release"), F.col("source_path"), F.col("chunk_index")))
        old = {name: self.store.table(name, family) for name in ("sources", "chunks", "vectors", "postings", "lengths")}
        gone = old["chunks"].join(affected, "source_path", "left_semi").select("id")
        new_chunks = chunks.drop("embedding")
        tables = {
            "sources": maintenance.replaced(old["sources"], affected, prepared.select(F.lit(family).alias("release"), F.col("path").alias("source_path"), "blob_sha", "content_hash", F.col("source_content").alias("content")), ["source_path"]),
            "chunks": maintenance.replaced(old["chunks"], affected, new_chunks.select(old["chunks"].columns), ["source_path"]),
            "vectors": maintenance.replaced(old["vectors"], gone, chunks.select(old["vectors"].columns), ["id"]),
            "postings": maintenance.replaced(old["postings"], gone, fulltext.postings(new_chunks), ["id"]),
            "lengths": maintenance.replaced(old["lengths"], gone, fulltext.lengths(new_chunks), ["id"]),
        }
        counts = maintenance.update_counts(prepared.select("path", "n_chunks"), stored).first()
        discovered, n_deleted = listing.count(), deleted.count()
        told = [r.asDict() for r in failures.collect()]
        manifest = self._configuration() | {"search_schema_version": SEARCH_SCHEMA_VERSION, "family": family, "branch": branch, "normalized": True, "updated_at": datetime.now(UTC).isoformat(), "source_commit": commit}
        if counts.added or counts.changed or n_deleted:
            self.store.commit(family, tables, manifest)
            self.store.optimize(family)
        self.store.set(manifest=manifest, embedding_profile=self.profile, dimensions=self.provider.dimensions)
        return {"family": family, "discovered": discovered, "added": counts.added, "changed": counts.changed, "deleted": n_deleted, "chunks": counts.chunks, "failures": told}

    # --- reading --------------------------------------------------------------------------------------------------------

    def search(self, query: str, limit: int = LIMIT, threshold: float = THRESHOLD, deduplicate_releases: bool = False, max_per_source: int = PER_SOURCE, release: str | None = None, doc_type: str | None = None, publication: str | None = None, chunk_type: str | None = None, topic_type: str | None = None) -> DataFrame:
        """The best chunks for a query, in order; threshold is the least similarity of semantic hits."""
        if not query.strip():
            raise ValueError("the query is empty")
        _in_range("limit", limit, *LIMIT_RANGE, True)
        _in_range("threshold", threshold, *THRESHOLD_RANGE, False)
        _in_range("max_per_source", max_per_source, *PER_SOURCE_RANGE, True)
        t = self.store.table
        # With a release, only its partitions are read; the statistics of the full text are of the whole index.
        return search(t("chunks", release), t("vectors", release), t("postings"), t("lengths"), query, embed_query(self.provider, query), limit, threshold, deduplicate_releases, max_per_source, release, self.oversample, releases=len(self.store.releases()), doc_type=doc_type, publication=publication, chunk_type=chunk_type, topic_type=topic_type)

    def search_many(self, queries: list[str], limit: int = LIMIT, threshold: float = THRESHOLD, deduplicate_releases: bool = False, max_per_source: int = PER_SOURCE) -> DataFrame:
        """The results of many queries at once; query_id is the place in the list."""
        rows = [(k, q, [float(x) for x in embed_query(self.provider, q)]) for k, q in enumerate(queries)]
        q = self.spark.createDataFrame(rows, "query_id long, text string, embedding array<double>")
        t = self.store.table
        return search_many(t("chunks"), t("vectors"), t("postings"), t("lengths"), q, limit, threshold, deduplicate_releases, max_per_source)

    def get_document(self, path: str, release: str | None = None) -> list[dict[str, Any]]:
        """The chunks of a source; the first has the whole source as its content."""
        rows = [r.asDict() for r in maintenance.documents_of(self.store.table("chunks", release), path, release).collect()]
        whole = maintenance.content_of(self.store.table("sources", release), path, release).first()
        if rows and whole and whole.content is not None:
            rows[0]["content"] = whole.content
        return rows

    def get_outline(self, path: str, release: str | None = None) -> DataFrame:
        c = maintenance.documents_of(self.store.table("chunks", release), path, release)
        return c.select("chunk_index", "chunk_type", "heading", F.substring("content", 1, PREVIEW_CHARACTERS).alias("preview"))

    def list_publications(self, release: str | None = None) -> DataFrame:
        return maintenance.publications(self.store.table("chunks", release), release)

    def status(self) -> dict[str, Any]:
        s = maintenance.stats(self.store.table("sources"), self.store.table("chunks")).first()
        embedding = self._configuration() | {"device": getattr(self.provider, "device", None)} if self.embeds else None
        return s.asDict() | {"manifest": self.store.manifest(), "embedding": embedding}

    def reset(self, yes: bool = False) -> None:
        self.store.reset(yes)
