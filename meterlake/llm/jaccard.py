"""N-gram Jaccard join: links between documents whose sets of word n-grams are nearly equal.

1. Documents with equal sets form one class; all later work is on classes.
2. Blocks. Two sets that link differ in at most d n-grams, where d follows from their sizes. The
   n-grams are dealt by hash over segments so that linked sets agree in at least one whole segment:
   its hash is the block's key. d + 1 segments make that certain, and small sets use as many. Large
   sets use fewer and larger ones, so that unlike sets rarely meet, yet enough that a pair at the
   limit agrees in SURE of them on average: it meets in none with a probability of exp(-SURE), less
   than one in 10**15, which is of the order of a collision of hashes. Classes that share a block
   are candidates.
3. A connected group of candidates that fits is one cell. A larger one is taken apart into the
   classes that share a block with the same least class, and these are cut into tiles by size and
   hash; a pair of tiles is one cell: the sparse incidence matrix (classes by n-grams) times its transpose, accumulated over
   slices of n-grams, holds the overlap of every pair; pairs of tiles and pairs of classes whose
   sizes alone forbid a link are discarded. Every pair of candidates is in a cell, and is counted in
   one of them.
4. A cell gives out links as a spanning forest and the number of links of each class; the
   components of the forest are the groups of near duplicates.

See `Blocks` for empty segments. What a task holds is bounded by the tile size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.store import components, kept, membership_filter, passes, screened
from meterlake.llm.text import LOWER, gram_hashes, lists, mix, signed, texts, word_hashes

#: Sizes of one instance of blocks lie within this factor.
SPREAD = 1.3
#: Segments that a pair at the limit agrees in on average, where not all of them need be used.
SURE = 36
#: Classes in a tile, and n-grams in a tile.
TILE_ROWS = 768
TILE_GRAMS = 2_000_000
#: Columns of the incidence matrix that are multiplied at a time.
SLICE = 4096


@dataclass(frozen=True)
class Blocks:
    """Segments for a join at `percent`. An instance serves the pairs whose smaller set has a size
    from `low` to `high`; a class takes part in every instance that may hold a partner."""

    percent: int

    @lru_cache(maxsize=4096)  # noqa: B019
    def instance(self, i: int) -> tuple[int, int, int, int]:
        """low, high, segments, spare segments.

        Sets that link agree in more segments than are spare, so if at most `spare` segments of a
        class are empty, one it agrees in is not empty, and its empty segments need no block. A
        class with more empty segments also blocks on those, and so does any partner that agrees
        with it in empty segments alone, as that has as many."""
        p = self.percent
        low = math.floor(SPREAD**i + 1e-9)
        high = max(low, math.floor(SPREAD ** (i + 1) + 1e-9) - 1)
        most = (high + high * 100 // p) * (100 - p) // (100 + p)
        sure = self._sure_segments(low, high)
        if sure < most + 3:
            return low, high, sure, sure
        spare = 2
        while True:
            segments = most + 1 + spare
            empty = segments * math.exp(-low / segments)
            need = 1 + math.ceil(empty + 2 * math.sqrt(empty))
            if need <= spare or most == 0 or spare > most // 2 + 2:
                return low, high, segments, spare
            spare += max(1, (need - spare) // 2)

    def _sure_segments(self, low: int, high: int) -> int:
        """The least number of segments in which sets that just link agree in SURE filled segments
        on average: a segment agrees unless one of the d n-grams that differ falls into it. As the
        hashes are spread evenly, a pair that agrees in none is as likely as exp(-SURE)."""
        p, segments = self.percent / 100, 1
        while True:
            agreed = []
            for n in (low, high):
                d = (1 - p) / (1 + p) * (n + n / p)
                agreed.append(segments * (math.exp(-d / segments) - math.exp(-(n + n / p + d) / 2 / segments)))
            if min(agreed) >= SURE or segments > 4 * high:
                return segments
            segments += max(1, segments // 50)

    def instances(self, n: int) -> range:
        def of(size: int) -> int:
            i = max(0, int(math.log(size) / math.log(SPREAD)) - 1)
            while self.instance(i)[1] < size:
                i += 1
            return i

        return range(of(max(1, -(-n * self.percent // 100))), of(n) + 1)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Block keys of one set."""
        out = []
        values, place = mix(grams ^ np.uint64(0x5851F42D4C957F2D)), grams >> np.uint64(24)
        for i in self.instances(grams.size):
            _, high, segments, spare = self.instance(i)
            if (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent) == 0:
                continue  # only equal sets link, and those are one class
            at = (place % np.uint64(segments)).astype(np.int64)
            sums = np.zeros(segments, np.uint64)
            np.add.at(sums, at, values)
            filled = np.bincount(at, minlength=segments) > 0
            chosen = np.flatnonzero(filled) if (~filled).sum() <= spare else np.arange(segments)
            out.append(mix(sums[chosen] + mix(chosen.astype(np.uint64) + np.uint64((i + 1) << 32))))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_set(text: bytes | None, n: int) -> np.ndarray:
    """Distinct n-gram hashes; with fewer words the whole sequence is the one n-gram."""
    words = word_hashes(text.translate(LOWER)) if text else np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, n if words.size >= n else max(1, words.size)))


def set_key(grams: np.ndarray) -> int:
    return int(signed(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(grams.size)], np.uint64)))[0])


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *ids, text = batch.columns
            sets = [gram_set(t, n) for t in texts(text)]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array([s.size for s in sets], pa.int64()), pa.array([set_key(s) if s.size else None for s in sets], pa.int64())],
                [*batch.schema.names[:-1], "n_shingles", "key"],
            )

    return run


def _block_keys(n: int, blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, rows = [], []
            for text in texts(batch.column(0)):
                grams = gram_set(text, n)
                key = set_key(grams) if grams.size else None
                if key is not None and key not in seen:  # a class once for each task
                    seen.add(key)
                    keys.append(key)
                    rows.append(signed(blocks.keys(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists(rows, pa.int64())], ["key", "blocks"])

    return run


def _sets(n: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, rows = [], []
            for text in texts(batch.column(0)):
                grams = gram_set(text, n)
                key = set_key(grams) if grams.size else None
                if key is not None and key not in seen and passes(wanted.value, np.array([key]))[0]:
                    seen.add(key)
                    keys.append(key)
                    rows.append(signed(grams))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists(rows, pa.int64())], ["key", "grams"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap of every two sets: the incidence matrix times its transpose, slice by slice of the
    n-grams that two sets have at least."""
    rows = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    of_shared = shared[columns]
    rows, columns = rows[of_shared], place[columns[of_shared]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = int(shared.sum())
    for low in range(0, width, SLICE):
        a, b = np.searchsorted(columns, (low, low + SLICE))
        part = np.zeros((len(sets), min(SLICE, width - low)), dtype=np.float32)
        part[rows[a:b], columns[a:b] - low] = 1.0
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def cell_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one cell: rows (a, b, 0) of a spanning forest and (a, null, links). A pair that
    has several groups in common is counted in the least of them."""
    frame = frame.sort_values("key", kind="stable").drop_duplicates("key")
    keys, tile, weight = frame["key"].to_numpy(np.int64), frame["second"].to_numpy(bool), frame["copies"].to_numpy(np.int64)
    sets = [np.asarray(g, dtype=np.int64) for g in frame["grams"]]
    size = np.array([s.size for s in sets], dtype=np.int64)
    both = overlaps(sets)
    joined = size[:, None] + size[None, :] - both
    link = (100 * both >= percent * joined) & (100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size))
    np.fill_diagonal(link, False)
    if tile.any() and not tile.all():  # two tiles: pairs within one of them are in another cell
        link &= tile[:, None] != tile[None, :]
    counted = link.copy()
    groups, own = [frozenset(g) for g in frame["groups"]], int(frame["root"].iloc[0])
    if any(len(g) > 1 for g in groups):
        for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
            if min(groups[i] & groups[j]) != own:
                counted[i, j] = counted[j, i] = False
    degree = counted.astype(np.int64) @ weight
    a, b, left = [], [], np.ones(keys.size, dtype=bool)
    for start in range(keys.size):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            for other in np.flatnonzero(link[at] & left):
                left[other] = False
                a.append(keys[at])
                b.append(keys[other])
                queue.append(int(other))
    linked = np.flatnonzero(degree)
    return pd.DataFrame({
        "a": np.concatenate([np.array(a, np.int64), keys[linked]]),
        "b": pd.array([*b, *[None] * linked.size], dtype="Int64"),
        "links": np.concatenate([np.zeros(len(a), np.int64), degree[linked]]),
    })


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """Cells of each class: members has key, n, copies, root (a group) and groups (all groups of
    the key). A group that fits is one cell. Else a tile is a range of sizes, in which partners are at most one range
    away, and a slice of the hashes."""
    groups = members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    step = math.log(100 / percent) if percent < 100 else 1.0
    level = members.join(groups, "root").withColumn(
        "level", F.when((F.col("rows") <= TILE_ROWS) & (F.col("grams") <= TILE_GRAMS), -1).otherwise(F.floor(F.log("n") / F.lit(step))).cast("int")
    )
    tiles = level.groupBy("root", "level").agg(F.greatest(F.ceil(F.count("*") / F.lit(TILE_ROWS)), F.ceil(F.sum("n") / F.lit(TILE_GRAMS))).cast("int").alias("tiles"))
    tiles = tiles.withColumn("tiles", F.when(F.col("level") < 0, 1).otherwise(F.col("tiles")))
    near = [tiles.select("root", (F.col("level") - d).alias("level"), F.col("tiles").alias(name)) for d, name in ((1, "above"), (-1, "below"))]
    placed = level.join(tiles, ["root", "level"])
    for frame in near:
        placed = placed.join(frame, ["root", "level"], "left")
    own = F.expr("cast(pmod(shiftright(key, 7), tiles) as int)")
    same = "struct(level as l, least(own, t) as s, level as m, greatest(own, t) as t, own > t as second)"
    up = "struct(level as l, own as s, level + 1 as m, t as t, false as second)"
    down = "struct(level - 1 as l, t as s, level as m, own as t, true as second)"
    cells = (
        f"concat(transform(sequence(0, tiles - 1), t -> {same}),"
        f" filter(transform(sequence(0, coalesce(above, 1) - 1), t -> {up}), c -> above is not null and level >= 0),"
        f" filter(transform(sequence(0, coalesce(below, 1) - 1), t -> {down}), c -> below is not null and level >= 0))"
    )
    return placed.withColumn("own", own).select("key", "copies", "root", "groups", F.explode(F.expr(cells)).alias("cell")).select("key", "copies", "root", "groups", "cell.*")


def _groups(connected: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """key, n, copies, root, groups: the groups in which a class meets its candidates."""
    placed = connected.withColumnRenamed("node", "key").join(classes, "key")
    sizes = placed.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    fits = sizes.withColumn("fits", (F.col("rows") <= TILE_ROWS) & (F.col("grams") <= TILE_GRAMS)).select("root", "fits")
    placed = placed.join(fits, "root")
    whole = placed.where("fits").select("key", "n", "copies", "root", F.array("root").alias("groups"))
    hubs = candidates.select(F.col("a").alias("key"), F.col("b").alias("hub")).union(candidates.select("b", "b")).distinct()
    of_hub = hubs.groupBy("key").agg(F.collect_set("hub").alias("groups"))  # at most one for each block of a class
    apart = placed.where("not fits").select("key", "n", "copies").join(of_hub, "key")
    return whole.union(apart.select("key", "n", "copies", F.explode("groups").alias("root"), "groups"))


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The columns of docs but the last, `text`, with n_shingles, root and n_links: root names the
    group of near duplicates, null for a text without words."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark, blocks = docs.sparkSession, Blocks(percent)
    text, ids = docs.select("text"), docs.columns[:-1]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    rows = kept(docs.mapInArrow(_sizes(n), f"{kinds}, n_shingles long, key long"), "jaccard-rows")
    classes = kept(rows.where("key is not null").groupBy("key").agg(F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "jaccard-classes")

    posted = text.mapInArrow(_block_keys(n, blocks), "key long, blocks array<long>").select(F.explode("blocks").alias("block"), "key")
    candidates = kept(
        posted.withColumn("hub", F.expr("min(key) over (partition by block)"))
        .where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct(),
        "jaccard-pairs",
    )
    # a class is connected to its least hub, and through that to its other ones
    own = kept(candidates.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("hubs")), "jaccard-hubs")  # at most one hub for each block of a class
    between = own.select(F.col("least").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct()
    connected = components(own.select("a", F.col("least").alias("b")).union(between), "jaccard-candidates")
    members = kept(_groups(connected, candidates, classes), "jaccard-members")
    wanted = spark.sparkContext.broadcast(membership_filter(members.select("key").distinct(), "key"))
    sets = text.mapInArrow(_sets(n, wanted), "key long, grams array<long>").groupBy("key").agg(F.first("grams").alias("grams"))
    cells = _cells(members, percent).join(sets, "key")
    links = kept(
        cells.groupBy("root", "l", "s", "m", "t").applyInPandas(
            lambda frame: cell_links(frame, percent), "a long, b long, links long"
        ),
        "jaccard-links",
    )
    wanted.destroy()
    roots = components(links.select("a", "b"), "jaccard-groups").withColumnRenamed("node", "key")
    degrees = links.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    of_class = classes.join(roots, "key", "left").join(degrees, "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return rows.join(of_class, "key", "left").select(*ids, "n_shingles", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of (doc_id, text).

    Texts are lower-cased in A-Z and split at white space. Two documents link if 100 times the
    common n-grams are at least `percent` times all of both; component_id is the least doc_id that
    links reach, n_links the number of rows a row links to. A text without words links to nothing
    and is its own component. Repeated rows are rows that link to each other. A null doc_id takes
    part and is never least; a component of null ids only has a null id. Other columns are ignored."""
    placed = _grouped(docs.select("doc_id", "text"), n, percent)
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "n_links",
    )


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with its columns: that with the least doc_id (a
    null one last), of equal ids that with the least hash of the text, and one of rows that repeat
    both. Rows are told apart by id and text, so a text that shares its id with another one stays if
    it is in another group. Texts without words stay, each row of them."""
    row = [F.col("doc_id"), F.sha2("text", 256).alias("_text_key")]
    placed = kept(_grouped(docs.select(*row, "text"), n, percent).where("root is not null"), "jaccard-placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text_key")).alias("first")
    groups = kept(placed.groupBy("root").agg(first, F.count("*").alias("rows")).where("rows > 1").select("root", "first.doc_id", "first._text_key"), "jaccard-first")
    others = placed.select("root", F.col("doc_id").alias("d"), F.col("_text_key").alias("t")).join(groups, "root")
    is_first = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_text_key") == F.col("t"))
    drop = kept(others.where(~is_first).select("d", "t").distinct(), "jaccard-drop")
    again = kept(others.where(is_first).groupBy("d", "t").count().where("count > 1").select("d", "t"), "jaccard-again")
    listed = drop.union(again).select(F.xxhash64("d", "t"))
    keyed, rest = screened(docs.withColumn("_text_key", F.sha2("text", 256)), F.xxhash64("doc_id", "_text_key"), listed)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_text_key") == F.col("t"))
    stay = keyed.join(drop, same, "left_anti")
    if not again.isEmpty():
        stay = stay.join(again, same, "left_anti").union(stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "_text_key"]))
    return rest.union(stay).select(*docs.columns)
