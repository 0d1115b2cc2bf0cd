import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import ranked_search as R

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def brute(docs, items, k):
    words = [terms(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for (doc, _), ws in zip(docs, words):
            tf, score = Counter(ws), 0
            for w, times in asked.items():
                if tf[w]:
                    m = 25 + (75 * len(ws) * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, size):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "ñandú", "x9"]
    shares = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i * 3, " ".join(rnd.choices(vocabulary, shares, k=rnd.randrange(1, 40)))) for i in range(size)]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(R, "SEGMENT_POSTINGS", 50)
    monkeypatch.setattr(R, "FIRST_STEP", 1)
    monkeypatch.setattr(R, "BLOCK_TERMS", 8)


def test_equals_brute_force_over_segments_and_blocks(spark, documents, small):
    docs = corpus(1, 300) + [(1, None), (2, ""), (4, "...")]
    docs += [(docs[7][0] + 1, docs[7][1])] * 12 + [(None, docs[7][1]), (9000, "w1 " * 5000)]  # ties, repeats, a null id, a long text
    items = [(i, t) for i, (_, t) in enumerate(corpus(2, 12))] + [(50, docs[7][1]), (51, None), (52, "unheard of"), (53, ""), (None, "W1 w2"), (7, "w1 w1 w3")]
    got = R.ranked_search(documents(docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert found(got) == brute(docs, items, 10)


def test_columns_that_clash_and_empty_tables(spark, documents):
    docs = documents([(1, "a b"), (2, "b")]).selectExpr("doc_id", "text", "'x' as item_id", "1 as id", "2 as score", "3 as term", "4 as n", "5 as rank")
    items = spark.createDataFrame([(1, "b", 5, 6)], "item_id long, text string, doc_id long, weight long")
    assert found(R.ranked_search(docs, items)) == brute([(1, "a b"), (2, "b")], [(1, "b")], 10)
    assert found(R.ranked_search(docs.limit(0), items)) == [] == found(R.ranked_search(docs, items.limit(0)))
    assert dict(R.ranked_search(docs.limit(0), items).dtypes) == dict(R.ranked_search(docs, items).dtypes)
    with pytest.raises(ValueError):
        R.ranked_search(docs, items, 0)


def segment(rows, vocabulary):
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
        ["id", "n", "terms", "counts"],
    )
    return R.Segment([batch], np.array(vocabulary), len(rows), sum(r[1] for r in rows))


def test_reading_stops_early_but_not_at_a_tie():
    # 2000 documents hold the common term once, ten of them also a rare one
    rows = [(2000 - i, 10, [1, 2] if i % 200 == 3 else [1], [1, 1] if i % 200 == 3 else [1]) for i in range(2000)]
    part = segment(rows, [1, 2])
    best = R.Best(10)
    looked_up = R.best_positions(part, np.array([0, 1]), np.array([10, 5000]), best)
    assert looked_up < 200 and sorted(best.doc) == sorted(r[0] for r in rows if len(r[2]) == 2)
    # all equal: the least ids are last in the list, so all of it must be read
    best = R.Best(10)
    assert R.best_positions(part, np.array([0]), np.array([10]), best) == 2000
    assert best.doc.tolist() == list(range(1, 11))
