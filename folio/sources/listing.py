"""Where documents come from: a tree of Markdown files, a git checkout, or a remote tree with retries."""

from __future__ import annotations

import json
import re
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import included

LISTING = "path string, blob_sha string"
TRANSIENT = (408, 429)


def read_tree(spark: SparkSession, root: str, area: str = "all-docs") -> DataFrame:
    """(path, blob_sha, content) of the documents under a folder of any of Spark's file systems; paths are relative.

    The hash is git's own of a blob, so listings from either side compare equal.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    # Qualified paths differ in how many slashes follow the scheme.
    tail = re.sub(r"^[a-z0-9]+:/*", "", base)
    path = F.substring(F.col("path"), F.instr("path", tail) + len(tail) + 1, F.length("path"))
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.col("length").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.col("content")))
    rows = files.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), blob.alias("blob_sha"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(included(F.col("path"), area))


def first_sources(listing: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` documents by path, in the order of the locale."""
    return listing if limit is None else listing.orderBy(F.collate("path", "UNICODE"), "path").limit(limit)


def git_sync(url: str, branch: str, folder: str) -> str:
    """A shallow checkout of one branch; returns its commit. A new one is made aside and renamed when it is whole."""
    def git(*args: str, cwd: str | None = None) -> str:
        return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True).stdout.strip()  # noqa: S603, S607

    if (Path(folder) / ".git").exists():
        git("fetch", "--depth", "1", "origin", branch, cwd=folder)
        git("reset", "--hard", "FETCH_HEAD", cwd=folder)
    else:
        aside = f"{folder}.part-{time.time_ns()}"
        git("clone", "--depth", "1", "--single-branch", "--branch", branch, url, aside)
        Path(aside).rename(folder)
    return git("rev-parse", "HEAD", cwd=folder)


def git_listing(spark: SparkSession, folder: str, area: str = "all-docs") -> DataFrame:
    tree = subprocess.run(["git", "ls-tree", "-r", "-z", "HEAD"], cwd=folder, check=True, capture_output=True, text=True).stdout  # noqa: S603, S607
    rows = [(m[2], m[1]) for x in tree.split("\0") if (m := re.match(r"\d+ blob ([0-9a-f]+)\t(.*)$", x))]
    return spark.createDataFrame(rows, LISTING).where(included(F.col("path"), area))


def retry_delay(retry_after: str | None, attempt: int, base: float) -> float:
    return float(retry_after) if retry_after and retry_after.isdigit() else min(base * 2 ** (attempt - 1), 8.0)


def _open(url: str, timeout: float) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as a:  # noqa: S310
            return a.status, {k.lower(): v for k, v in a.headers.items()}, a.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def fetch(url: str, label: str, attempts: int = 5, base: float = 0.5, timeout: float = 30.0, get: Callable = _open, sleep: Callable = time.sleep) -> bytes:
    """The content of a URL; again after network errors, 408, 429 and 5xx."""
    said, used = "no answer", 0
    for used in range(1, max(1, attempts) + 1):
        wait = None
        try:
            status, headers, content = get(url, timeout)
            if 200 <= status < 300:
                return content
            said, wait = f"HTTP {status}", headers.get("retry-after")
            if status not in TRANSIENT and status < 500:
                break
        except OSError as e:
            said = str(e)
        if used < attempts:
            sleep(retry_delay(wait, used, base))
    raise RuntimeError(f"request for {label} failed after {used} attempt{'s' if used > 1 else ''} ({said})")


def remote_listing(spark: SparkSession, tree_url: str, area: str = "all-docs", get: Callable = _open, **how) -> DataFrame:
    """(path, blob_sha) from a tree answered as JSON; a truncated tree is an error."""
    tree = json.loads(fetch(tree_url, "the source tree", get=get, **how))
    if tree.get("truncated"):
        raise RuntimeError("the source tree is truncated")
    rows = [(x["path"], x["sha"]) for x in tree.get("tree", []) if x.get("type") == "blob"]
    return spark.createDataFrame(rows, LISTING).where(included(F.col("path"), area))


def download(listing: DataFrame, raw_url: Callable[[str], str], concurrency: int = 8, get: Callable = _open, **how) -> DataFrame:
    """listing with content, or the error that kept it away: fetched by the tasks, up to `concurrency` at once in each."""
    import pyarrow as pa

    if not 1 <= concurrency <= 64:
        raise ValueError("concurrency must be an integer from 1 to 64")

    def one(path: str) -> tuple[str | None, str | None]:
        try:
            return fetch(raw_url(path), path, get=get, **how).decode("utf-8", "replace"), None
        except Exception as e:  # noqa: BLE001  told in the row
            return None, str(e)

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = list(pool.map(one, b.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["path", "blob_sha", "content", "error"])

    return listing.select("path", "blob_sha").mapInArrow(run, "path string, blob_sha string, content string, error string")
