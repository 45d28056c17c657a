"""What the operators share: tables, the shared folder, lineage cuts and text conventions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word between ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        root = tempfile.mkdtemp(prefix="folio-checkpoint-")
        sc.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, below one of this application that goes when the driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/folio/{spark.sparkContext.applicationId}"
    if root not in _to_remove:
        _to_remove.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


_to_remove: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it outlives any executor.

    `narrow` tables are small against the input: an eighth of the shuffle partitions writes them, in as many files.
    """
    if narrow:
        df = df.coalesce(max(16, partitions(df.sparkSession) // 8))
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by `written`, when nothing needs them any longer."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            if "/folio/" in path.toString():
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def anti_join(docs: DataFrame, keys: dict[str, Column], marked: DataFrame, most: int = 1_000_000) -> DataFrame:
    """docs without the rows whose keys are in `marked`, a written table with columns of the dict's names; nulls equal nulls.

    Up to `most` rows of `marked` are broadcast, so that texts stay where they are; beyond, both sides are shuffled.
    """
    return _marked(docs, keys, marked, most, "left_anti")


def semi_join(docs: DataFrame, keys: dict[str, Column], marked: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows that `anti_join` leaves out."""
    return _marked(docs, keys, marked, most, "left_semi")


def _marked(docs: DataFrame, keys: dict[str, Column], marked: DataFrame, most: int, how: str) -> DataFrame:
    few = marked.count() <= most
    marked = marked.select(*[F.col(k).alias(f"_marked_{k}") for k in keys])
    on = [c.eqNullSafe(F.col(f"_marked_{k}")) for k, c in keys.items()]
    return docs.join(F.broadcast(marked) if few else marked, on, how)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod` (null id: 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0))


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts don't add up: a task holds two or so at once.

    A setting of the user's own stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "64m"):
        spark.conf.set(name, most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 5) -> DataFrame:
    """(doc_id, text, label): at most `most` labelled documents of either label, the first by a hash of the id, of the
    folds other than 0. Rows without id or label teach nothing; of several labels of one id the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    picked = None
    for v in (0, 1):
        part = known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * most rows
