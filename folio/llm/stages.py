"""The stages of the corpus pipeline, each one operator at work on what the stage before it kept.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, mixing, near_dedup, quality, sharding
from .common import table, written


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, however small a part of their text it is."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's weight asks, each at least once and at most twice."""
    return mixing.mix(docs).select(docs.columns)


def shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal texts move together into 40 shards of even counts; the shard and the place in it are added."""
    return sharding.balanced_shards(docs, F.xxhash64(F.coalesce("text", F.lit(""))), [F.col("doc_id")])


STAGES = [("quality", keep_good), ("near_dedup", keep_one_of_each), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", shard)]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; the last is left for the caller to run."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
