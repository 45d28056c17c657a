"""The index on disk: snapshots of one release each, and a manifest that names the current ones.

    <root>/manifest.json                       what is current, swapped in one rename
    <root>/snapshots/<release>/<id>/<table>    sources, chunks, vectors, postings, lengths

An update writes the tables of its release beside the old ones and then swaps the manifest: readers see one whole state or
the other, and other releases are not touched. All but the last two snapshots of a release are removed by `optimize`.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SCHEMA_VERSION, SEARCH_SCHEMA_VERSION
from . import hadoop

TABLES = {
    "sources": "release string, source_path string, blob_sha string, content_hash string, content string",
    "chunks": "id long, doc_type string, publication string, source_path string, release string, chunk_type string, chunk_index int, title string, heading string, content string, topic_type string, product string, classification string, last_updated string, object_name string, method_name string, metadata string, content_hash string",
    "vectors": "id long, embedding array<float>, release string, doc_type string, publication string, chunk_type string, topic_type string",
    "postings": "token string, id long, field string, positions array<int>",
    "lengths": "id long, n_tokens long",
}
#: Settings that must agree between an index and who opens it.
COMPARED = ("embedding_provider", "embedding_model", "document_embedding_model", "dimensions", "pooling", "layer_norm", "document_prefix", "query_prefix", "max_characters", "dtype")


@dataclass
class IndexStore:
    spark: SparkSession
    root: str

    def _state(self) -> dict:
        text = hadoop.read_text(self.spark, f"{self.root}/manifest.json")
        return json.loads(text) if text else {"schema_version": SCHEMA_VERSION, "settings": {}, "releases": {}}

    def _swap(self, state: dict) -> None:
        hadoop.write_text(self.spark, f"{self.root}/manifest.json", json.dumps(state, indent=1, sort_keys=True))

    def settings(self) -> dict:
        return self._state()["settings"]

    def manifest(self) -> dict | None:
        return self._state()["settings"].get("manifest")

    def releases(self) -> list[str]:
        return sorted(self._state()["releases"])

    def check(self, wanted: dict) -> None:
        """Raise if the index was built in another way than `wanted` says; read only."""
        state = self._state()
        if state["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"the index has schema {state['schema_version']}, not {SCHEMA_VERSION}; remove and rebuild it")
        known = state["settings"]
        if known.get("embedding_profile") and wanted.get("embedding_profile") and known["embedding_profile"] != wanted["embedding_profile"]:
            raise ValueError(f"the index uses the embedding profile {known['embedding_profile']}, not {wanted['embedding_profile']}; use it, another folder, or reset the index")
        if known.get("dimensions") not in (None, wanted.get("dimensions")):
            raise ValueError(f"the index has {known['dimensions']} dimensions, not {wanted.get('dimensions')}")
        m = known.get("manifest")
        if m and m.get("search_schema_version") != SEARCH_SCHEMA_VERSION:
            raise ValueError(f"the index has search schema {m.get('search_schema_version')}, not {SEARCH_SCHEMA_VERSION}; reset it before rebuilding")
        if m:
            either = lambda k: k == "document_embedding_model" and None in (m.get(k), wanted.get(k))
            apart = [k for k in COMPARED if m.get(k) != wanted.get(k) and not either(k)]
            if apart:
                raise ValueError(f"the index was built with {', '.join(f'{k} {m.get(k)}' for k in apart)}; now it is {', '.join(f'{wanted.get(k)}' for k in apart)}")

    def set(self, **settings) -> None:
        state = self._state()
        state["settings"] |= settings
        self._swap(state)

    def table(self, name: str, release: str | None = None) -> DataFrame:
        """A table of one release or of all; with no index, empty."""
        releases = self._state()["releases"]
        paths = [p for r, p in releases.items() if release is None or r == release.lower()]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{p}/{name}" for p in paths])

    @contextmanager
    def staged(self):
        """A function that writes a table beside the index and reads it back; all such tables go at the end."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"

        def stage(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{path}/{name}")

        try:
            yield stage
        finally:
            hadoop.delete(self.spark, path)

    def commit(self, release: str, tables: dict[str, DataFrame], manifest: dict) -> None:
        """Write the tables of a release and make them current; with an error, or after another writer's commit, nothing
        changes. Postings are sorted by token, so that a search reads few row groups."""
        before = self._state()
        path = f"{self.root}/snapshots/{release}/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df = df.select(*[F.col(f.split()[0]) for f in TABLES[name].split(", ")])
            if name == "postings":
                df = df.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "token", "id").sortWithinPartitions("token", "id")
            df.write.parquet(f"{path}/{name}")
        state = self._state()
        if state["releases"].get(release) != before["releases"].get(release):
            hadoop.delete(self.spark, path)
            raise RuntimeError(f"another update of {release} was committed in the meantime; run this one again")
        state["previous"] = state.get("previous", {}) | {release: state["releases"].get(release)}
        state["releases"][release] = path
        state["settings"]["manifest"] = manifest
        self._swap(state)

    def optimize(self, release: str) -> None:
        """Remove the snapshots of a release but for the current one and the one before it, which readers may still hold."""
        state = self._state()
        keep = {p.rsplit("/", 1)[-1] for p in (state["releases"].get(release), state.get("previous", {}).get(release)) if p}
        if not keep:
            return
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/snapshots/{release}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for x in fs.listStatus(p):
            if x.getPath().getName() not in keep:
                fs.delete(x.getPath(), True)

    def reset(self, yes: bool = False) -> None:
        """Delete the index and nothing else."""
        if not yes:
            raise ValueError("confirm the removal of the index with yes=True")
        hadoop.delete(self.spark, self.root)


def stored_profile(spark: SparkSession, root: str) -> str | None:
    return IndexStore(spark, root).settings().get("embedding_profile") if hadoop.exists(spark, f"{root}/manifest.json") else None


def stored_dimensions(spark: SparkSession, root: str) -> int | None:
    return IndexStore(spark, root).settings().get("dimensions") if hadoop.exists(spark, f"{root}/manifest.json") else None
