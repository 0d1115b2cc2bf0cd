import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = sum(saved[b] for b in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(node)).encode()).hexdigest(),
    ) for node, m in members.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations():
    rows = []
    for c in range(400):
        first = "common first turn" if c % 3 else f"first {c % 7}"
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else "ä same" if c % 4 == 0 else f"turn {t} {c % 50}") for t in range(1 + c % 8)]
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(90) for t in range(5)]  # copies of one conversation
    rows += [(2000, t, "user", "x" * (t % 3)) for t in range(3000)]  # a long one
    rows += [(2001, None, None, None), (2001, 0, "user", None), (2001, 0, "user", None), (2001, 0, "a", "tie"), (2002, 3, "user", "")]
    return rows


@pytest.mark.parametrize(("heavy", "run", "shard"), [(256, 4096, 8192), (40, 7, 100), (2, 3, 50)])
def test_equals_brute_force(spark, monkeypatch, heavy, run, shard):
    monkeypatch.setattr(P, "HEAVY", heavy)
    monkeypatch.setattr(P, "RUN", run)
    monkeypatch.setattr(P, "SHARD_TURNS", shard)
    rows = [*conversations(), (None, 0, "user", "no conversation")]
    assert got(P.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_conversation_without_turns_clashing_columns_and_empty_table(spark):
    lonely = next(c for c in range(11, 400, 5) if zlib.crc32(str(c).encode()) % 9 >= 1)  # its first turns would come from one that is not there
    rows = [(lonely, 0, "user", "gone")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as high", "2 as low", "3 as nth", "4 as part", "5 as depth", "6 as bytes")
    assert got(P.prefix_trie(df)) == brute(rows) and len(brute(rows)) == 1
    assert got(P.prefix_trie(df.limit(0))) == []


def test_perfect_hash_is_minimal_and_knows_its_digests():
    rng = np.random.default_rng(3)
    high, low = (rng.integers(-(1 << 63), (1 << 63) - 1, 5000) for _ in range(2))
    table = P.PerfectHash(high, low)
    assert sorted(table.slots(high, low)) == list(range(5000))
    assert (table.slots(high ^ 1, low) == -1).all()
    assert P.PerfectHash(high[:0], low[:0]).slots(high[:3], low[:3]).tolist() == [-1] * 3


def test_two_prefixes_with_one_digest_are_noticed():
    rows = pa.table({  # the same digest at two depths
        "conv_id": [1, 2], "high": pa.array([[7, 8], [8, 9]], pa.list_(pa.int64())), "low": pa.array([[1, 1], [1, 1]], pa.list_(pa.int64())),
        "bytes": pa.array([[1, 1], [1, 1]], pa.list_(pa.int64())), "top": pa.array([0, 0], pa.int32()),
    })
    with pytest.raises(ValueError, match="one digest"):
        P._shard(rows)
