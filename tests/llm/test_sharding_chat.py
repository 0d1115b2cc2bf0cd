import hashlib
import random
import zlib
from collections import defaultdict

from meterlake.llm import chat, sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 256, *[r.randrange(-(2**63), 2**63) for _ in range(300)]]
    frame = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    for n in (1, 2, 24, 25, 1000):
        got = {x.k: x.s for x in frame.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {**{k: jump(k, n) for k in keys}, None: jump(0, n)}


def test_shards(documents):
    rows = [(i, f"text {i % 7} é") for i in range(700)] + [(None, "x"), (3, None), (4, ""), (5, "text 5 é"), (5, "text 5 é")]
    got = sharding.shard_documents(documents(rows)).collect()
    assert sorted((repr(g.doc_id), g.size, g.text_crc32) for g in got) == sorted(
        (repr(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    slots = defaultdict(list)
    for g in got:
        assert g.law == "key" and g.shard == jump(g.doc_id or 0, 24)
        assert g.grown_shard in (g.shard, 24)
        slots[g.shard].append(g.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 5 < sum(g.grown_shard == 24 for g in got) < 60
    assert sharding.shard_documents(documents([])).collect() == []


ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x|> <|", "plain", "", None, "line\nbreak\r\n", "end\\", "<", "|>", "你<|𝄞"]


def conversations(spark):
    r = random.Random(6)
    rows = []
    for c in range(60):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(ODD)))
    rows += [(100, 0, "user", "u"), (101, 0, "assistant", "a"), (102, None, None, None), (103, 1, "a\n%0A<|b", "x"), (103, 1, "assistant", "y"), (103, 1, "assistant", "y"), (None, 0, "assistant", "null id")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_digests_equal_brute_force(spark):
    rows, frame = conversations(spark)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t if t is not None else -1, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = chat.conversation_digests(frame).collect()
    want = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        want.append((repr(c), len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)), len(loss), sha(loss)))
    assert sorted((repr(g.conv_id), *g[1:5]) for g in got) == sorted(want)


def test_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "r<|s"), (1, 2, "user", "q2"), (1, 3, "assistant", "r2"), (1, 4, "user", "bye")]
    got = chat.training_examples(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("example").collect()
    m = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    first = m("user", "q") + m("assistant", "r<\\|s")
    second = first + m("user", "q2") + m("assistant", "r2")
    assert [g.text for g in got] == [first, second, second + m("user", "bye")]
    assert [[g.text[s.start : s.end] for s in g.loss_spans] for g in got] == [["r<\\|s"], ["r2"], []]
    assert chat.training_examples(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []


def test_slots_are_in_order_for_hot_ids(documents):
    """Ids that are multiples of 64, null ids and copies of one row: no place in a shard is special."""
    rows = [(64 * i, f"t{i % 3}") for i in range(400)] + [(None, "n")] * 300 + [(128, "t2")] * 200 + [(None, None)]
    got = sharding.shard_documents(documents(rows), 5).collect()
    assert len(got) == len(rows)
    key = lambda g: (g.doc_id is not None, g.doc_id or 0, g.text_crc32, g.size)
    for shard in range(5):
        own = sorted((g for g in got if g.shard == shard), key=lambda g: g.slot)
        assert [g.slot for g in own] == list(range(len(own))) and [key(g) for g in own] == sorted(map(key, own))
