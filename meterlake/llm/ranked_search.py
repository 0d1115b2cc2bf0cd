"""Ranked lexical search by best positions.

1. One pass over the documents counts terms; of each document it keeps its length and the counts of
   the terms that a fixed-size filter says some query may have. Corpus counts are Spark aggregates.
2. Queries go in blocks of a bounded number of terms; each block is sent to all tasks, which read
   the kept counts as segments of bounded size. A segment has an impact list for each term: its
   documents by falling impact, equal impacts by row. A document knows its place in every list.
3. For each query the lists are read side by side. A document that turns up is looked up directly in
   all lists, which gives its whole score and marks its place in each. The best position of a list
   is the last one before its first unmarked place: a document not seen yet has no higher impact
   there. Reading ends when the sum of the impacts at the best positions is strictly below the k-th
   score found, or is 0; a document that ties with the k-th can thus still come in by its id. The
   k-th score is carried from segment to segment of a task.
4. The best k of every task are ranked in Spark.

Impacts are integers, so every sum is exact. Terms are 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.store import kept, membership_filter, passes
from meterlake.llm.text import LETTERS, LOWER, lists, signed, texts, word_hashes

#: Query terms sent to all tasks at a time, and postings of a segment.
BLOCK_TERMS = 200_000
SEGMENT_POSTINGS = 1_000_000
SEGMENT_ROWS = 1 << 19
#: Places read from each list at first; every step reads twice as many.
FIRST_STEP = 32
_BITS = 20  # of a row of a segment and of an impact in a packed sort key


def _terms(text: bytes | None) -> np.ndarray:
    return word_hashes(text.translate(LOWER), LETTERS) if text else np.zeros(0, np.uint64)


def _term_counts(wanted=None):
    """Of each text the number of terms, and its distinct terms (that pass the filter) with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in texts(batch.column(1)):
                words = _terms(text)
                sizes.append(words.size)
                found, times = np.unique(signed(words if wanted is None else words[passes(wanted.value, words)]), return_counts=True)
                terms.append(found)
                counts.append(times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), lists(terms, pa.int64()), lists(counts, pa.int64())], ["id", "n", "terms", "counts"]
            )

    return run


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Impact of tf occurrences in a document of n terms, of a corpus of so many documents and terms."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))


def weight(df: Column, docs: int) -> Column:
    return F.floor(1000 * F.log((2.0 * docs + 2) / (2 * df + 1)))


class Segment:
    """Impact lists of some documents, and the place of each document in them."""

    def __init__(self, batches: list[pa.RecordBatch], vocabulary: np.ndarray, docs: int, terms: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("id")
        self.no_id = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        term = np.asarray(pc.list_flatten(table.column("terms")))
        tf = np.asarray(pc.list_flatten(table.column("counts")))
        row = np.repeat(np.arange(self.ids.size), np.asarray(pc.list_value_length(table.column("terms"))))
        at = np.minimum(np.searchsorted(vocabulary, term), vocabulary.size - 1)
        known = vocabulary[at] == term
        self.term, tf, row = at[known], tf[known], row[known]
        self.impact = impacts(tf, np.asarray(table.column("n"))[row], docs, terms)
        self.first = np.searchsorted(row, np.arange(self.ids.size + 1))  # of each document's entries
        packed = (self.term << (2 * _BITS)) | (((1 << _BITS) - 1 - self.impact) << _BITS) | row
        order = np.argsort(packed)
        self.list_row, self.list_impact = row[order], self.impact[order]
        self.start = np.searchsorted(self.term[order], np.arange(vocabulary.size + 1))
        self.place = np.empty(order.size, np.int64)
        self.place[order] = np.arange(order.size) - self.start[self.term[order]]
        self.slot = np.full(vocabulary.size, -1, np.int64)  # list of each term in the query at hand


@dataclass
class Best:
    """The best k documents of a query so far: higher scores first, then lower ids, null ids last."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def kth(self) -> int:
        return int(self.score[-1]) if self.score.size == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray, no_id: np.ndarray) -> None:
        good = (score > 0) & (score >= self.kth)
        if not good.any():
            return
        score, doc, no_id = np.append(self.score, score[good]), np.append(self.doc, doc[good]), np.append(self.no_id, no_id[good])
        order = np.lexsort((doc, no_id, -score))[: self.k]
        self.score, self.doc, self.no_id = score[order], doc[order], no_id[order]


def best_positions(segment: Segment, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the segment's documents to the best of a query; returns how many were looked up."""
    length = segment.start[terms + 1] - segment.start[terms]
    terms, weights, length = terms[length > 0], weights[length > 0], length[length > 0]
    if terms.size == 0:
        return 0
    start, offset = segment.start[terms], np.cumsum(length) - length
    segment.slot[terms] = np.arange(terms.size)
    marked, known = np.zeros(int(length.sum()), bool), np.zeros(segment.ids.size, bool)
    position = np.zeros(terms.size, np.int64)  # places marked without a gap
    depth, step = 0, FIRST_STEP
    while True:
        read = [segment.list_row[s + depth : s + min(n, depth + step)] for s, n in zip(start, length, strict=True) if n > depth]
        rows = np.concatenate(read)
        rows = np.unique(rows[~known[rows]])
        if rows.size:  # direct access: all of the query's lists
            known[rows] = True
            size = segment.first[rows + 1] - segment.first[rows]
            entry = np.repeat(segment.first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            slot = segment.slot[segment.term[entry]]
            of = np.repeat(np.arange(rows.size), size)[slot >= 0]
            entry, slot = entry[slot >= 0], slot[slot >= 0]
            marked[offset[slot] + segment.place[entry]] = True
            score = np.add.reduceat(weights[slot] * segment.impact[entry], np.flatnonzero(np.diff(of, prepend=-1)))
            best.add(score, segment.ids[rows], segment.no_id[rows])
        depth, step = depth + step, 2 * step
        threshold = 0
        for i in range(terms.size):
            left = marked[offset[i] + position[i] : offset[i] + length[i]]
            gap = int(left.argmin()) if left.size else 0
            position[i] = length[i] if not left.size or left[gap] else position[i] + gap
            if position[i] < length[i]:
                threshold += int(weights[i]) * int(segment.list_impact[start[i] + position[i] - 1])
        if threshold == 0 or threshold < best.kth:
            break
    segment.slot[terms] = -1
    return int(known.sum())


def _search(block, docs: int, terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries = block.value
        best = {item: Best(k) for item, _, _ in queries}
        held: list[pa.RecordBatch] = []
        postings = rows = 0

        def search() -> None:
            segment = Segment(held, vocabulary, docs, terms)
            for item, at, weights in queries:
                best_positions(segment, at, weights, best[item])

        for batch in batches:
            held.append(batch)
            postings, rows = postings + len(pc.list_flatten(batch.column(2))), rows + batch.num_rows
            if postings >= SEGMENT_POSTINGS or rows >= SEGMENT_ROWS:
                search()
                held, postings, rows = [], 0, 0
        if held:
            search()
        found = {item: b for item, b in best.items() if b.score.size}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(list(found), [b.score.size for b in found.values()]) if found else [], pa.int64()),
                pa.array(np.concatenate([b.doc for b in found.values()]) if found else [], pa.int64(), mask=np.concatenate([b.no_id for b in found.values()]) if found else None),
                pa.array(np.concatenate([b.score for b in found.values()]) if found else [], pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )

    return run


def _block(weights: DataFrame, number: int, blocks: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The terms of a block of queries (BLOCK_TERMS or about as many, by hash) and each query's
    terms, as positions among them, with weights."""
    rows = weights.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number).select("item", "term", "weight").toArrow()
    item, term, value = (np.asarray(rows.column(i)) for i in range(3))
    order = np.argsort(item, kind="stable")
    item, term, value = item[order], term[order], value[order]
    vocabulary = np.unique(term)
    at = np.searchsorted(vocabulary, term)
    edges = np.flatnonzero(np.diff(item, prepend=item[:1] - 1)) if item.size else np.zeros(0, np.int64)
    ends = np.append(edges[1:], item.size)
    return vocabulary, [(int(item[a]), at[a:b], value[a:b]) for a, b in zip(edges, ends, strict=False)]


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of (doc_id, text) with the highest scores above
    0 for each row of queries (item_id, text), fewer if there are fewer.

    Terms are runs of digits, letters A-Z in either case and characters beyond ASCII. Null and
    termless texts have no terms: such documents are never found and count nowhere, such queries
    find nothing. Every row is a document, and every row of queries is a query, also if it is
    repeated or shares its id; equal scores go by ascending doc_id, a null doc_id last. A null
    item_id is an id like any other. Empty tables give no rows; other columns are ignored."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = docs.sparkSession
    asked = queries.select("item_id", "text").withColumn("id", F.monotonically_increasing_id())
    asked = kept(asked, "search-queries")  # the numbers are read from a table, so they stay
    terms = asked.select("id", "text").mapInArrow(_term_counts(), "id long, n long, terms array<long>, counts array<long>")
    terms = kept(terms.select(F.col("id").alias("item"), F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.counts").alias("times")), "search-terms")
    wanted = spark.sparkContext.broadcast(membership_filter(terms, "term"))
    posts = kept(
        docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_term_counts(wanted), "id long, n long, terms array<long>, counts array<long>"),
        "search-posts",
    )
    wanted.unpersist()
    n_docs, n_terms = posts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held_by = posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(held_by, "term").select("item", "term", (F.col("times") * weight(F.col("df"), n_docs)).cast("long").alias("weight"))
    weights = kept(weights.where("weight > 0"), "search-weights")
    blocks = -(-weights.count() // BLOCK_TERMS)
    result = "item long, doc_id long, score long"
    found = [spark.createDataFrame([], result)]
    for b in range(blocks):
        asked_here = _block(weights, b, blocks)
        if not asked_here[1]:
            continue
        block = spark.sparkContext.broadcast(asked_here)
        counted = posts.where("n > 0").select("id", "n", "terms", "counts")
        found.append(kept(counted.mapInArrow(_search(block, n_docs, n_terms, k), result), "search-found"))
        block.destroy()
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("id").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")
