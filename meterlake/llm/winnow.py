"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the least is kept as a fingerprint, so two texts that
share SPAN = GRAM + WINDOW - 1 words share a fingerprint. The fingerprints of documents are joined
with those of the benchmark; each hit is extended to the runs of SPAN words around it, and these
are joined with the runs of the items, so exactly the shared runs are found.

Items of fewer than SPAN words are one run of their own length; documents post their runs of those
lengths (only lengths that the benchmark has). Items without words are never found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.store import kept, membership_filter, passes, screened
from meterlake.llm.text import LETTERS, LOWER, gram_hashes, lists, signed, texts, word_hashes

GRAM = 6
WINDOW = 5
SPAN = GRAM + WINDOW - 1


def words_of(text: bytes | None) -> np.ndarray:
    return word_hashes(text.translate(LOWER), LETTERS) if text else np.zeros(0, np.uint64)


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Start positions of the k-grams that are least in a window of WINDOW k-grams (the last one of
    equals), for a text of SPAN words or more."""
    grams = gram_hashes(words, GRAM)
    if grams.size < WINDOW:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    least = WINDOW - 1 - windows[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(windows.shape[0]) + least)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, runs, sizes = [], [], []
        for text in texts(batch.column(1)):
            words = words_of(text)
            size = min(SPAN, words.size)
            sizes.append(size)
            runs.append(signed(np.unique(gram_hashes(words, size))) if size else np.zeros(0, np.int64))
            prints.append(signed(np.unique(gram_hashes(words, GRAM)[fingerprints(words)])) if size == SPAN else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int32()), lists(prints, pa.int64()), lists(runs, pa.int64())], ["item_id", "size", "prints", "runs"]
        )


def _posts(prints, short_runs, lengths: list[int]):
    """Of each document: the number of words, and fingerprints that the benchmark may have, with
    the runs around them. A run of a short item is its own fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rows = [], {name: [] for name in ("print", "start", "size", "run")}
            for text in texts(batch.column(1)):
                words = words_of(text)
                counts.append(words.size)
                found = {name: [] for name in rows}
                at = fingerprints(words)
                hashes = gram_hashes(words, GRAM)[at] if at.size else np.zeros(0, np.uint64)
                hit = passes(prints.value, hashes)
                if hit.any():
                    long = gram_hashes(words, SPAN)
                    for shift in range(WINDOW):
                        start = at[hit] - shift
                        inside = (start >= 0) & (start < long.size)
                        found["print"].append(hashes[hit][inside])
                        found["start"].append(start[inside])
                        found["size"].append(np.full(inside.sum(), SPAN))
                        found["run"].append(long[start[inside]])
                for size in lengths:
                    short = gram_hashes(words, size)
                    start = np.flatnonzero(passes(short_runs.value, short))
                    for name, values in (("print", short[start]), ("start", start), ("size", np.full(start.size, size)), ("run", short[start])):
                        found[name].append(values)
                for name, parts in found.items():
                    rows[name].append(np.concatenate(parts) if parts else np.zeros(0, np.uint64 if name in ("print", "run") else np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:1], pa.array(counts, pa.int64()), lists([signed(p) for p in rows["print"]], pa.int64()),
                    lists([p.astype(np.int64) for p in rows["start"]], pa.int64()), lists([p.astype(np.int32) for p in rows["size"]], pa.int32()),
                    lists([signed(p) for p in rows["run"]], pa.int64()),
                ],
                ["doc_id", "n_words", "print", "start", "size", "run"],
            )

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, found): rows has (row, doc_id, n_words) of every document row; hits has the
    (row, start, size) of every run of words shared with the benchmark; found has the distinct
    (row, item_id). Positions count words from 0."""
    spark = docs.sparkSession
    items = kept(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_items, "item_id string, size int, prints array<long>, runs array<long>"), "winnow-items")
    short = items.where(f"size between 1 and {SPAN - 1}").select("item_id", "size", F.explode("runs").alias("print"))
    prints = items.select("item_id", F.lit(SPAN).alias("size"), F.explode("prints").alias("print")).union(short).select("size", "print").distinct()
    runs = items.where("size > 0").select("item_id", "size", F.explode("runs").alias("run"))
    lengths = sorted(r[0] for r in short.select("size").distinct().collect())  # at most SPAN - 1
    shared = [spark.sparkContext.broadcast(membership_filter(p, "print")) for p in (prints.where(f"size = {SPAN}"), short)]
    posted = kept(
        docs.select("doc_id", "text")
        .mapInArrow(_posts(*shared, lengths), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, print array<long>, start array<long>, size array<int>, run array<long>")
        .withColumn("row", F.monotonically_increasing_id()),
        "winnow-posts",
    )
    for sent in shared:
        sent.destroy()
    hits = (
        posted.where("size(run) > 0").select("row", F.explode(F.arrays_zip("print", "start", "size", "run")).alias("p")).select("row", "p.*")
        .join(prints, ["size", "print"], "left_semi").select("row", "start", "size", "run").distinct()
    )
    hits = kept(hits.join(runs.select("size", "run").distinct(), ["size", "run"], "left_semi").select("row", "start", "size", "run"), "winnow-hits")
    found = hits.select("row", "size", "run").distinct().join(runs, ["size", "run"]).select("row", "item_id").distinct()
    return posted.select("row", "doc_id", "n_words"), hits.select("row", "start", "size"), found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of (doc_id, text)
    against the items (item_id, text).

    Texts are lower-cased in A-Z; a word is a run of digits, letters a-z and characters beyond
    ASCII. n_hit counts the words inside any shared run. Null and wordless texts have no words and
    no hits; repeated rows are judged each on its own; several items of one id count once; a null
    item_id is left out of the list of items; other columns are ignored."""
    rows, hits, found = contaminated_spans(docs, benchmark)
    before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    covered = hits.withColumn("seen", F.coalesce(F.max(end).over(before), F.lit(0))).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), end - F.greatest("start", "seen"))).alias("n_hit")
    )
    named = found.where("item_id is not null").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    return rows.join(covered, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no run with the benchmark, with all their columns. Rows are judged
    by their text alone, so a null doc_id or one that several rows share makes no difference. Null
    and wordless texts stay."""
    key = F.sha2("text", 256)
    rows, hits, _ = contaminated_spans(docs.select(key.alias("doc_id"), "text"), benchmark)
    bad = kept(rows.join(hits.select("row").distinct(), "row", "left_semi").select(F.col("doc_id").alias("_bad")).distinct(), "winnow-bad")
    some, rest = screened(docs, F.xxhash64(key), bad.select(F.xxhash64("_bad")))
    return rest.union(some.join(bad, key == F.col("_bad"), "left_anti"))
