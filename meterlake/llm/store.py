"""Tables that cut lineage, membership filters of fixed size, and connected components.

Intermediate tables are written below spark.checkpoint.dir, so they survive the loss of an executor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.sources.files import work_dir

FILTER_BITS = 23
FILTER_PROBES = 3


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a frame to the shared work folder and reads it back."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def probes(hashes: np.ndarray, bits: int = FILTER_BITS) -> list[np.ndarray]:
    """Bit positions of 64-bit hashes in a membership filter of 2**bits bits."""
    h = hashes.astype(np.uint64)
    return [(h >> np.uint64(20 * k)) & np.uint64((1 << bits) - 1) for k in range(FILTER_PROBES)]


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((1 << bits) // 64, dtype=np.uint64)
        for batch in batches:
            for at in probes(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        filled = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(words[filled].view(np.int64), pa.int64())], ["word", "mask"])

    return run


def membership_filter(df: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the longs of a column, as 64-bit words of fixed number (1 MB by default).

    Every task sets the bits of its rows, and the words of all tasks are joined by an aggregation, so
    what a task and the driver hold is at most 2**bits / 64 words, whatever the number of rows. A full
    filter lets everything pass and costs time, not results."""
    words = (
        df.select(F.col(column).cast("long"))
        .mapInArrow(_filter_words(bits), "word int, mask long")
        .groupBy("word").agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    out = np.zeros((1 << bits) // 64, dtype=np.uint64)
    out[np.asarray(words.column("word")).astype(np.int64)] = np.asarray(words.column("mask")).astype(np.int64).view(np.uint64)
    return out


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = int(words.size * 64).bit_length() - 1
    found = np.ones(hashes.size, dtype=bool)
    for at in probes(hashes, bits):
        found &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def screened(df: DataFrame, key: Column, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key, a hash, may be in the one column of longs of `listed`, and all other
    rows, which are surely not. A join with what is listed then moves the former only."""
    words = df.sparkSession.sparkContext.broadcast(membership_filter(listed, listed.columns[0]))

    @F.pandas_udf("boolean")
    def may_be_listed(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(words.value, hashes.to_numpy()))

    return df.where(may_be_listed(key)), df.where(~may_be_listed(key))


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of longs; root is the least node
    that can be reached. An edge with a null end is left out.

    In each round every node points at its least neighbour, if that is less than itself; pointers
    are followed to their ends, and the edges are moved to these ends, where loops and repeated
    edges go. So every round works on what the last one has left, and all tables of a round are
    written. The least node of a component points nowhere, so it is the last one left."""
    edges = edges.where("a is not null and b is not null and a <> b")
    links = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{purpose}-edges")
    nodes = kept(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node")), f"{purpose}-nodes")
    while not links.isEmpty():
        ends = _followed(kept(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), f"{purpose}-pointers"), purpose)
        a, b = (ends.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
        moved = links.join(b, "b").join(a, "a", "left").select(F.coalesce("a_root", "a").alias("x"), F.col("b_root").alias("y")).where("x <> y")
        links = kept(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{purpose}-edges")
        last = ends.select(F.col("node").alias("root"), F.col("root").alias("end"))
        nodes = kept(nodes.join(last, "root", "left").select("node", F.coalesce("end", "root").alias("root")), f"{purpose}-nodes")
    return nodes


def _followed(pointers: DataFrame, purpose: str) -> DataFrame:
    """Pointers (node, root) to lesser nodes, each followed to a node that points nowhere. Every
    step doubles the way that a pointer goes."""
    while True:
        onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("end"))
        after = pointers.join(onward, "root", "left").select("node", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        after = kept(after, f"{purpose}-pointers")
        pointers = after.select("node", "root")
        if after.where("moved").isEmpty():
            return pointers
