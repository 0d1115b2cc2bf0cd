import numpy as np
import test_jaccard
from pyspark.sql import functions as F

from meterlake.llm import jaccard, store, winnow


def test_filter_holds_every_key_and_few_others(spark):
    keys = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 4000)
    frame = spark.createDataFrame([(int(k),) for k in keys[:2000]] * 2 + [(None,), (0,), (-1,)], "key long").repartition(5)
    words = store.membership_filter(frame, "key")
    want = np.zeros_like(words)
    for at in store.probes(np.append(keys[:2000], [0, -1])):
        np.bitwise_or.at(want, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    assert (words == want).all()
    assert store.passes(words, keys[:2000]).all()
    assert store.passes(words, keys[2000:]).sum() < 5
    assert not store.membership_filter(frame.where("false"), "key").any()


def test_screened_splits_the_rows(spark):
    rows = spark.range(3000).withColumn("name", F.expr("if(id % 7 = 0, null, id)"))
    listed = rows.where("id < 60").select(F.xxhash64("id"))
    some, rest = store.screened(rows, F.xxhash64("id"), listed)
    first, others = [r.id for r in some.collect()], [r.id for r in rest.collect()]
    assert sorted(first + others) == list(range(3000))
    assert set(range(60)) <= set(first) and len(first) < 70


def test_only_listed_rows_are_joined(spark, documents, monkeypatch):
    """What near-duplicate removal and decontamination shuffle whole is what they may take out."""
    joined = []

    def spy(*args):
        some, rest = store.screened(*args)
        joined.append((some.count(), rest.count()))
        return some, rest

    monkeypatch.setattr(jaccard, "screened", spy)
    monkeypatch.setattr(winnow, "screened", spy)
    texts = test_jaccard.family(9, 30, 200, 2)
    lone = [(1000 + i, " ".join(f"{x}{i}" for x in "abcdefghijkl")) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + lone + [(1000, lone[0][1]), (None, None), (2, None)]
    left = jaccard.one_of_each_group(documents(rows)).collect()
    assert sorted(map(repr, (r.doc_id for r in left))) == sorted(map(repr, [0, *(d for d, _ in lone), None, 2]))
    items = spark.createDataFrame([(1, lone[5][1]), (2, "b6 c6")], "item_id long, text string")
    left = winnow.clean_documents(documents(rows), items).collect()
    assert {d for d, _ in rows} - {r.doc_id for r in left} == {1005, 1006}
    assert len(left) == len(rows) - 2
    assert len(joined) == 2 and all(some < 40 and some + rest == len(rows) for some, rest in joined)


def test_filter_of_sets_takes_a_class_once(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 16)  # groups are taken apart, and a class is in several
    seen = []

    def spy(df, column):
        seen.append((df.count(), df.select(column).distinct().count()))
        return store.membership_filter(df, column)

    monkeypatch.setattr(jaccard, "membership_filter", spy)
    jaccard.jaccard_groups(documents([(i, t) for i, t in enumerate(test_jaccard.family(1, 60, 120, 6))]), 5, 80).collect()
    assert seen and all(rows == keys for rows, keys in seen)
