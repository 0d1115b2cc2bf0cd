"""Conversation prefix trie: how many conversations share their first turns.

1. Rebuilding: the first turns of some conversations come from another one (`rebuilt_turns`).
2. A node is the sequence of its turns; its 128-bit digest is chained from its parent's. A task
   streams the turns of its conversations in order and writes the digests of each conversation.
3. Nodes that HEAVY or more conversations share, and all nodes above them, are the top of the trie:
   Spark groups them by digest, and there is about one for every HEAVY turns at most. A fixed-size
   filter tells all tasks which they are; a light node that passes it by chance counts as top,
   everywhere, and nothing changes but where it is counted. Below the top, each subtree has fewer
   than HEAVY conversations; subtrees are dealt to shards by the digest of their own root, so no
   first turn, however common, makes a large shard.
4. A shard builds a minimal perfect hash over its distinct digests (`PerfectHash`), which gives
   every node a slot; the digest stored there is compared at each look-up. Counts are scattered into
   flat arrays by slot, and sums run up through the array of parent slots, deepest nodes first.
5. The roots of the light subtrees add to their parents in the top, and every node of the top adds
   to the nodes on its path. The ids of conversations that end in the top are gathered in runs of
   RUN ids, and a task streams the runs of a node through its hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.store import kept, membership_filter, passes
from meterlake.llm.text import mix

HEAVY = 256
#: Turns in a shard, on average.
SHARD_TURNS = 8192
#: A run of conversation ids spans so many numbers.
RUN = 4096
GROUP, MOST_SHARED = 5, 9
ROOT = bytes(16)
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def shared_turns(conv_id):
    """The number of first turns that a conversation takes from the first one of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, nth, turn_hash, bytes: the turns of every rebuilt conversation, ordered by part
    and nth. Turns with one number are ordered by role and the hash of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("text_hash"), F.octet_length(text).cast("long").alias("bytes")
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text_hash")
    turns = turns.select(
        "conv_id", (F.row_number().over(in_order) - 1).alias("nth"), "bytes",
        F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text_hash"), 256)).alias("turn_hash"),
    )
    turns = kept(turns, "trie-turns")
    own = turns.where(F.col("nth") >= shared_turns(F.col("conv_id"))).withColumn("part", F.lit(1))
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"))
    lent = turns.where((F.col("nth") < MOST_SHARED - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "first")
    taken = ids.join(lent, "first").where(F.col("nth") < shared_turns(F.col("conv_id"))).withColumn("part", F.lit(0))
    return own.unionByName(taken.drop("first")).select("conv_id", "part", "nth", "turn_hash", "bytes")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation: digests of its prefixes (two longs each) and bytes of its turns."""
    conv, digest, rows = None, ROOT, []

    def written() -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "high", "low", "bytes"])

    for batch in batches:
        if len(rows) > 1:  # the last conversation may go on
            going = rows.pop()
            yield written()
            rows = [going]
        for c, turn, size in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn_hash", "bytes")), strict=True):
            if c != conv:
                conv, digest = c, ROOT
                rows.append((c, [], [], []))
            if turn is None:  # stands for a conversation that may have no turns
                continue
            digest = hashlib.blake2b(digest + turn, digest_size=16).digest()
            for out, value in zip(rows[-1][1:], (*np.frombuffer(digest, np.int64).tolist(), size), strict=True):
                out.append(value)
    yield written()


def _top_depth(top):
    """Adds to each path the number of its nodes in the top, and the node below them, the root of a
    light subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = batch.column(1), batch.column(2)
            ends = np.cumsum(np.asarray(pc.list_value_length(high)))
            all_high, all_low = np.asarray(pc.list_flatten(high)), np.asarray(pc.list_flatten(low))
            light = np.append(np.flatnonzero(~passes(top.value, _one(all_high, all_low).view(np.int64))), ends[-1:])
            starts = ends - np.asarray(pc.list_value_length(high))
            depth = np.minimum(light[np.searchsorted(light, starts)], ends) - starts if ends.size else ends
            below = starts + depth < ends
            at = np.where(below, starts + depth, 0)
            root_high = pa.array(all_high[at] if all_high.size else np.zeros(ends.size, np.int64), pa.int64(), mask=~below)
            root_low = pa.array(all_low[at] if all_low.size else np.zeros(ends.size, np.int64), pa.int64(), mask=~below)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(depth, pa.int32()), root_high, root_low], [*batch.schema.names, "top", "root_high", "root_low"])

    return run


def _one(high: np.ndarray, low: np.ndarray, seed: int = 0) -> np.ndarray:
    """One well mixed number for two longs and a seed."""
    salt = np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1)
    return mix(high.view(np.uint64) ^ mix(low.view(np.uint64) + salt))


class PerfectHash:
    """A minimal perfect hash of n distinct digests: level by level, a digest that falls alone on its
    place in a bit array has its slot there, and the others go to the next level. The slot is the
    number of taken places before it, so the slots are 0 to n - 1."""

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        left_high, left_low, before = high, low, 0
        while left_high.size:
            size = left_high.size + left_high.size // 2 + 1
            at = (_one(left_high, left_low, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            rank = before + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            placed = alone[at]
            slots = rank[at[placed]]
            self.high[slots], self.low[slots] = left_high[placed], left_low[placed]
            before += int(alone.sum())
            left_high, left_low = left_high[~placed], left_low[~placed]

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that has none: the digest stored in it must be equal."""
        out, left = np.full(high.size, -1, np.int64), np.arange(high.size)
        for level, (size, alone, rank) in enumerate(self.levels):
            at = (_one(high[left], low[left], level) % np.uint64(size)).astype(np.int64)
            out[left[alone[at]]] = rank[at[alone[at]]]
            left = left[~alone[at]]
        found = out >= 0
        found[found] = (self.high[out[found]] == high[found]) & (self.low[out[found]] == low[found])
        return np.where(found, out, -1)


def ends_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _shard(rows: pa.Table) -> pa.Table:
    """Nodes of the light subtrees of a shard, of which it has all conversations."""
    rows = rows.combine_chunks()
    conv, top = np.asarray(rows.column("conv_id")), np.asarray(rows.column("top")).astype(np.int64)
    length = np.asarray(pc.list_value_length(rows.column("high"))).astype(np.int64)
    high, low, size = (np.asarray(pc.list_flatten(rows.column(c))) for c in ("high", "low", "bytes"))
    row = np.repeat(np.arange(conv.size), length)
    depth = np.arange(high.size) - np.repeat(np.cumsum(length) - length, length) + 1
    light = np.flatnonzero(depth > top[row])

    order = np.lexsort((low[light], high[light]))
    sorted_high, sorted_low = high[light][order], low[light][order]
    new = np.ones(order.size, bool)
    new[1:] = (sorted_high[1:] != sorted_high[:-1]) | (sorted_low[1:] != sorted_low[:-1])
    table = PerfectHash(sorted_high[new], sorted_low[new])
    n = int(new.sum())
    slot = table.slots(high[light], low[light])
    is_root = depth[light] == top[row[light]] + 1
    parent_of = np.where(is_root, -1, np.concatenate([[-1], slot[:-1]]))
    node_depth, parent, node_bytes = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    node_depth[slot], parent[slot], node_bytes[slot] = depth[light], parent_of, size[light]
    if (slot < 0).any() or (node_depth[slot] != depth[light]).any() or (parent[slot] != parent_of).any():
        raise ValueError("two prefixes have one digest")

    n_convs = np.bincount(slot, minlength=n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv[row[light]])
    n_children = np.bincount(parent[parent >= 0], minlength=n)
    n_leaves, saved = (n_children == 0).astype(np.int64), (n_convs - 1) * node_bytes
    by_depth = np.argsort(-node_depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(node_depth[by_depth])) + 1):
        inner = level[parent[level] >= 0]
        np.add.at(n_leaves, parent[inner], n_leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])

    ends = np.append(np.flatnonzero(np.diff(row[light])), light.size - 1)  # the last turn of each row
    of, who = slot[ends], conv[row[light[ends]]]
    order = np.lexsort((who, of))
    starts = np.searchsorted(of[order], np.arange(n + 1))
    digests = [ends_digest(who[order[a:b]].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    up_high, up_low = np.zeros(n, np.int64), np.zeros(n, np.int64)
    deep = is_root & (depth[light] > 1)  # above a root of depth 1 is the root of the trie
    up_high[slot[deep]], up_low[slot[deep]] = high[light[deep] - 1], low[light[deep] - 1]
    none = parent < 0
    return pa.table({
        "conv_id": pa.array(least), "depth": pa.array(node_depth), "parent_conv_id": pa.array(least[np.maximum(parent, 0)], mask=none),
        "n_convs": pa.array(n_convs), "n_children": pa.array(n_children), "n_leaves": pa.array(n_leaves), "saved_tokens": pa.array(saved),
        "ends_sha256": pa.array(digests, pa.string()), "up_high": pa.array(up_high, mask=~none), "up_low": pa.array(up_low, mask=~none),
    })


def _run_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (high, low, run, ids) in the order of nodes and runs: the hash over each node's runs."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["high", "low", "ends_sha256"])

    for batch in batches:
        for high, low, ids in zip(*(batch.column(n).to_pylist() for n in ("high", "low", "ids")), strict=True):
            if (high, low) != node:
                if node is not None:
                    yield row()
                node, state = (high, low), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield row()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for
    every node of the trie of the rebuilt conversations of (conv_id, turn, role, text).

    Turns go by number, null first; turns with one number go by role and the hash of the text, so
    repeated rows are turns of their own. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation. A conversation left without turns ends in the root. An empty table
    gives no rows, as its root has no members; other columns are ignored."""
    spark = conversations.sparkSession
    turns = rebuilt_turns(conversations)
    with_none = turns.unionByName(
        conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        .select("conv_id", F.lit(0).alias("part"), F.lit(-1).alias("nth"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(None).cast("long").alias("bytes"))
    )
    in_order = with_none.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    paths = kept(in_order.mapInArrow(_paths, "conv_id long, high array<long>, low array<long>, bytes array<long>"), "trie-paths")

    node = F.explode(F.arrays_zip("high", "low")).alias("d")
    heavy = paths.select(node).select("d.high", "d.low").groupBy("high", "low").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY)
    keys = heavy.mapInArrow(_keys, "key long")
    top_filter = spark.sparkContext.broadcast(membership_filter(kept(keys, "trie-top"), "key"))
    placed = kept(
        paths.mapInArrow(_top_depth(top_filter), "conv_id long, high array<long>, low array<long>, bytes array<long>, top int, root_high long, root_low long"),
        "trie-placed",
    )
    top_filter.destroy()

    n_turns = placed.agg(F.coalesce(F.sum(F.size("high")), F.lit(0))).first()[0]
    shards = max(1, -(-n_turns // SHARD_TURNS))
    light = placed.where("root_high is not null").withColumn("shard", F.pmod(F.xxhash64("root_high", "root_low"), F.lit(shards)))
    below = kept(light.groupBy("shard").applyInArrow(_shard, f"{_NODE}, up_high long, up_low long"), "trie-light")

    # The top: the root of the trie is its first node, with a digest of zeros.
    zero = F.lit(0).cast("long")
    path = F.concat(
        F.array(F.struct(zero.alias("high"), zero.alias("low"), zero.alias("bytes"))),
        F.slice(F.arrays_zip("high", "low", "bytes"), F.lit(1), F.col("top")),
    )
    last = F.element_at("path", -1)
    paths_above = placed.select("conv_id", path.alias("path")).groupBy(last["high"].alias("high"), last["low"].alias("low"))
    paths_above = kept(paths_above.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path")), "trie-top-paths")
    steps = paths_above.select("n", "conv_id", "path", F.posexplode("path").alias("depth", "d"))
    to_here = F.expr("transform(slice(path, 1, depth + 1), x -> struct(x.high as high, x.low as low))")
    top = steps.groupBy("d.high", "d.low").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.col("depth").cast("long")).alias("depth"),
        F.first("d.bytes").alias("bytes"), F.first(to_here).alias("path"),
    )
    top = kept(top, "trie-top-nodes")
    up = F.get("path", F.col("depth").cast("int") - 1)
    inner = top.select(up["high"].alias("high"), up["low"].alias("low"), F.lit(1).alias("children"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")).where("high is not null")
    outer = below.where("up_high is not null").select(F.col("up_high").alias("high"), F.col("up_low").alias("low"), F.lit(1).alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    added = inner.unionByName(outer).groupBy("high", "low").agg(F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    full = top.join(added, ["high", "low"], "left").select(
        *top.columns, F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce(F.when(F.col("children").isNotNull(), F.col("leaves")), F.lit(1)).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    full = kept(full, "trie-top-own")
    sums = full.select("leaves", "saved", F.explode("path").alias("d")).groupBy("d.high", "d.low").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ending = placed.where("root_high is null").select("conv_id", F.element_at(path, -1).alias("d"), F.expr(f"conv_id div {RUN} - if(conv_id % {RUN} < 0, 1, 0)").alias("run"))
    runs = ending.groupBy("d.high", "d.low", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    hashed = runs.repartition("high", "low").sortWithinPartitions("high", "low", "run").mapInArrow(_run_digests, "high long, low long, ends_sha256 string")
    names = full.select(F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("up_conv_id"))
    above = full.select("high", "low", "conv_id", "depth", "n_convs", "n_children", up["high"].alias("up_high"), up["low"].alias("up_low"))
    above = above.join(sums, ["high", "low"]).join(hashed, ["high", "low"], "left").join(names, ["up_high", "up_low"], "left").select(
        "conv_id", "depth", F.col("up_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(ends_digest([]))).alias("ends_sha256"),
    )
    columns = above.columns
    roots = below.where("up_high is not null").drop("parent_conv_id").join(names, ["up_high", "up_low"]).withColumnRenamed("up_conv_id", "parent_conv_id")
    return above.unionByName(roots.select(*columns)).unionByName(below.where("up_high is null").select(*columns))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        high, low = (np.asarray(batch.column(n)) for n in ("high", "low"))
        yield pa.RecordBatch.from_arrays([pa.array(_one(high, low).view(np.int64))], ["key"])
