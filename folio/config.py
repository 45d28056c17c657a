"""Settings and fixed values of the document collection.

The values under "fixed" decide results and are kept as they are; names of one collection's publisher are parameters.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path

# --- fixed values -------------------------------------------------------------------------------------------------------
API_PREFIXES = (
    "markdown/api-reference/server-api-reference/",
    "markdown/api-reference/cllent-mobile-api-reference/",
    "markdown/api-reference/ui-builder-api-reference/",
    "markdown/api-reference/rest-apis/",
)
GLOSSARY_PREFIX = "markdown/glossary/"
TOP_LEVEL_API = r"^markdown/api-reference/[^/]+\.md$"
DOC_TYPES = ("scripting-api", "scripting-guide", "rest-api", "developer-guide", "product-doc", "glossary", "release-notes")
CHUNK_TYPES = ("overview", "section", "method", "endpoint", "parameter", "returns", "example", "definition")
AREAS = ("scripting", "server", "client", "scripts", "all-docs")
CHUNK_CHARACTERS, OVERLAP, CHUNK_FLOOR = 1792, 200, 256
SUMMARY_CHARACTERS, SUMMARY_BOUNDARY = 500, 250
RESULT_CHARACTERS, PREVIEW_CHARACTERS = 1000, 240
RRF_K, API_WEIGHT = 60, 1.25
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
FIELD_WEIGHTS = {"title": 10.0, "heading": 7.0, "object_name": 9.0, "method_name": 9.0, "content": 1.0}
CANDIDATE_FLOOR, CANDIDATES_PER_RESULT = 100, 20
OVERSAMPLE, OVERSAMPLE_RANGE = 8, (1, 64)
LIMIT_RANGE, PER_SOURCE_RANGE, THRESHOLD_RANGE = (1, 50), (1, 10), (-1.0, 1.0)
LIMIT, THRESHOLD, PER_SOURCE = 10, 0.3, 3
SCHEMA_VERSION, SEARCH_SCHEMA_VERSION = 2, 6
FAMILY = "australia"
FAMILY_NAME = re.compile(r"^[a-z0-9][a-z0-9._-]*$")
WINDOW_SOURCES = 128
# ------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Collection:
    """What depends on the publisher of a collection."""

    fallback_title: str = "Untitled document"
    glossary_product: str = "Platform"
    raw_base: str = "https://example.invalid/raw"


@dataclass(frozen=True)
class Paths:
    """Where an index, its source tree and its models lie."""

    root: str
    index: str = field(init=False)
    sources: str = field(init=False)
    models: str = field(init=False)

    def __post_init__(self):
        for name in ("index", "sources", "models"):
            object.__setattr__(self, name, f"{self.root.rstrip('/')}/{name}")


def default_root() -> str:
    """FOLIO_HOME, else the cache folder of the operating system."""
    if home := os.environ.get("FOLIO_HOME"):
        return home
    cache = os.environ.get("XDG_CACHE_HOME") or str(Path.home() / ".cache")
    return f"{cache}/folio"


def resolve_paths(root: str | None = None) -> Paths:
    return Paths(root or default_root())
