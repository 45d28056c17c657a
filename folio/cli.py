"""Command line: python -m folio.cli <command>. Results and errors are JSON with --json."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import re
import sys
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from .config import AREAS, CHUNK_TYPES, DOC_TYPES, FAMILY, LIMIT, LIMIT_RANGE, OVERSAMPLE, OVERSAMPLE_RANGE, PER_SOURCE, PER_SOURCE_RANGE, THRESHOLD, THRESHOLD_RANGE, resolve_paths
from .functions.embedding import DEFAULT_PROFILE, PROFILES, EndpointProvider, HashProvider, ModelProvider, profile

HASH_DIMENSIONS = 64


def ranged(kind: type, low: float, high: float) -> Callable[[str], Any]:
    def parse(text: str):
        try:
            value = kind(text)
        except ValueError:
            value = None
        if value is None or not low <= value <= high:
            raise argparse.ArgumentTypeError(f"must be {'an integer' if kind is int else 'a number'} from {low} to {high}, not {text}")
        return value

    return parse


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="folio", description=__doc__)
    p.add_argument("--data-dir", help="folder of the index")
    p.add_argument("--json", action="store_true")
    p.add_argument("--deterministic-embeddings", action="store_true", help="embed by hash, whatever the profile (as without a loader)")
    p.add_argument("--embedding-profile", choices=list(PROFILES), help="what a new index is built with; a stored index knows its own")
    p.add_argument("--embedding-loader", metavar="MODULE:FUNCTION", help="called with the profile, the dtype and the number of threads; gives a function of a device that loads the model")
    p.add_argument("--embedding-dimensions", type=ranged(int, 1, 4096))
    p.add_argument("--device", default="cpu")
    p.add_argument("--embedding-dtype", choices=("auto", "fp32", "fp16", "q8", "q4", "q4f16"))
    p.add_argument("--embedding-batch-size", type=ranged(int, 1, 1024), default=32)
    p.add_argument("--embedding-max-characters", type=ranged(int, 256, 1_000_000))
    p.add_argument("--embedding-threads", type=ranged(int, 1, 1024))
    p.add_argument("--embedding-endpoint", metavar="URL", help="embeds documents; queries go to the loaded model or the hash")
    p.add_argument("--embedding-endpoint-model")
    p.add_argument("--embedding-api-key-env", default="EMBEDDING_API_KEY", help="name of the variable that holds the endpoint's key")
    p.add_argument("--embedding-endpoint-batch-size", type=ranged(int, 1, 1024), default=64)
    p.add_argument("--embedding-endpoint-concurrency", type=ranged(int, 1, 32), default=4)
    p.add_argument("--embedding-endpoint-timeout", type=ranged(int, 1, 600), default=30)
    p.add_argument("--vector-oversample", type=ranged(int, *OVERSAMPLE_RANGE), default=OVERSAMPLE)
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("init", "update"):
        c = sub.add_parser(name, help="bring the index up to a tree of documents")
        c.add_argument("--tree", required=True, help="folder that holds markdown/")
        c.add_argument("--family", default=FAMILY)
        c.add_argument("--branch")
        c.add_argument("--area", choices=AREAS, default="all-docs")
        c.add_argument("--limit", type=ranged(int, 1, 2**31))
        c.add_argument("--refresh", action="store_true")
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--family")
    c.add_argument("--doc-type", choices=DOC_TYPES)
    c.add_argument("--publication")
    c.add_argument("--chunk-type", choices=CHUNK_TYPES)
    c.add_argument("--topic-type")
    c.add_argument("--limit", type=ranged(int, *LIMIT_RANGE), default=LIMIT)
    c.add_argument("--threshold", type=ranged(float, *THRESHOLD_RANGE), default=THRESHOLD)
    c.add_argument("--max-per-source", type=ranged(int, *PER_SOURCE_RANGE), default=PER_SOURCE)
    c.add_argument("--deduplicate-releases", action="store_true")
    c.add_argument("--include-metadata", action="store_true")
    c = sub.add_parser("get")
    c.add_argument("path")
    c.add_argument("--family")
    c.add_argument("--outline", action="store_true")
    c = sub.add_parser("publications")
    c.add_argument("--family")
    sub.add_parser("status")
    c = sub.add_parser("reset-index")
    c.add_argument("--yes", action="store_true")
    return p


def provider_for(args: argparse.Namespace, stored: str | None = None, dimensions: int | None = None):
    """(provider, profile name) that the options ask for; `stored` and `dimensions` are those of an index that exists."""
    dimensions = args.embedding_dimensions or dimensions
    name = args.embedding_profile or stored
    if args.embedding_loader and not args.deterministic_embeddings:
        name = name or DEFAULT_PROFILE
        module, colon, function = args.embedding_loader.partition(":")
        if not (module and colon and function):
            raise ValueError(f"--embedding-loader must be MODULE:FUNCTION, not {args.embedding_loader}")
        p = profile(name, dimensions)
        p = replace(p, max_characters=args.embedding_max_characters or p.max_characters)
        load = getattr(importlib.import_module(module), function)(p, args.embedding_dtype, args.embedding_threads)
        local = ModelProvider(p, load, args.device, args.embedding_batch_size, dtype=args.embedding_dtype)
    elif args.embedding_profile and not args.deterministic_embeddings:
        raise ValueError("--embedding-profile needs --embedding-loader: no model is shipped")
    else:
        name, local = None, HashProvider(dimensions or HASH_DIMENSIONS, max_characters=args.embedding_max_characters)
    if bool(args.embedding_endpoint) != bool(args.embedding_endpoint_model):
        raise ValueError("--embedding-endpoint and --embedding-endpoint-model go together")
    if not args.embedding_endpoint:
        return local, name
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", args.embedding_api_key_env):
        raise ValueError("--embedding-api-key-env must be the name of an environment variable")
    if not (key := os.environ.get(args.embedding_api_key_env, "").strip()):
        raise ValueError(f"the environment variable {args.embedding_api_key_env} is not set")
    sizes = {"batch_size": args.embedding_endpoint_batch_size, "concurrency": args.embedding_endpoint_concurrency, "timeout": float(args.embedding_endpoint_timeout)}
    return EndpointProvider(args.embedding_endpoint, args.embedding_endpoint_model, local.dimensions, local, key, local.document_prefix, local.max_characters, **sizes), name


def run(args: argparse.Namespace, spark=None) -> Any:
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .operators.maintenance import compact_results
    from .sources.index import stored_dimensions, stored_profile
    from .sources.listing import read_tree

    spark = spark or SparkSession.builder.appName("folio").getOrCreate()
    root = resolve_paths(args.data_dir).index
    embeds = args.command in ("init", "update", "search")
    provider, name = provider_for(args, stored_profile(spark, root), stored_dimensions(spark, root)) if embeds else (None, None)
    engine = Engine(spark, root, provider, name, args.vector_oversample, embeds=embeds)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  results are bounded by their limits
    match args.command:
        case "init" | "update":
            return engine.update(read_tree(spark, args.tree, args.area), args.family, args.branch, args.limit, args.refresh)
        case "search":
            found = engine.search(args.query, args.limit, args.threshold, args.deduplicate_releases, args.max_per_source, args.family, args.doc_type, args.publication, args.chunk_type, args.topic_type)
            return rows(compact_results(found, args.include_metadata))
        case "get":
            return rows(engine.get_outline(args.path, args.family)) if args.outline else engine.get_document(args.path, args.family)
        case "publications":
            return rows(engine.list_publications(args.family))
        case "status":
            return engine.status()
        case "reset-index":
            engine.reset(args.yes)
            return {"reset": True}


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        args = parser().parse_args(argv)
        print(json.dumps(run(args), ensure_ascii=False, default=str, indent=None if args.json else 2))
        return 0
    except Exception as e:  # noqa: BLE001  told to the caller
        print(json.dumps({"error": str(e)}) if "--json" in argv else f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
