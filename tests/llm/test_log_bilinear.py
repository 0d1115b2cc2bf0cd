import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterlake.llm import log_bilinear as L
from meterlake.llm import text as T


def corpus(rows):
    r = random.Random(8)
    names = [f"w{i}" for i in range(60)]
    out = []
    for i in range(rows):
        w = [r.choice(names)]
        for _ in range(r.randrange(60)):  # a word tells which ten can follow
            k = int(w[-1][1:])
            w.append(names[(k * 7 + r.randrange(6)) % 60] if r.random() < 0.9 else names[r.randrange(60)])
        out.append((i, " ".join(x.upper() if r.random() < 0.1 else x for x in w) + (f" once{i}" if i % 3 == 0 else "")))
    return out


def brute(rows):
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]
    out = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter(x for d, t in rows if not out(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((repr(d), out(d), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for d, t in rows)


def test_base_equals_brute_force_and_model_is_better(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 40)
    rows = corpus(1500) + [(9000, None), (9001, ""), (None, "w1 w2 never"), (5, "w3"), (5, "w3")]
    got = L.score_documents(documents(rows).coalesce(1)).collect()
    want = brute(rows)
    key = lambda g: (repr(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens)
    assert sorted(map(key, got)) == [w[:5] for w in want]
    assert np.allclose([g.base_score for g in sorted(got, key=key)], [w[5] for w in want])
    held = [g for g in got if g.held_out]
    assert len(held) > 100 and sum(g.score for g in held) > sum(g.base_score for g in held)
    assert L.score_documents(documents([])).collect() == []


def small_vocabulary():
    counts = np.arange(L.CLASSES, 0, -1).astype(np.int64)
    return L.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), int(counts.sum()), L.CLASSES, counts, np.ones(L.CLASSES, np.int64))


def test_probabilities_add_up_to_one():
    p = L.Parameters.start(small_vocabulary())
    contexts = np.random.default_rng(1).integers(0, L.CLASSES, (1, L.CONTEXT))
    every = p.log_probabilities(np.repeat(contexts, L.CLASSES, axis=0), np.arange(L.CLASSES))
    assert abs(np.exp(every).sum() - 1) < 1e-5
    flat = p.flat()
    assert (L.Parameters.of_flat(flat).flat() == flat).all()


def test_gradients_equal_differences():
    v = small_vocabulary()
    p = L.Parameters.start(v)
    for name in ("inputs", "places", "outputs", "bias"):
        setattr(p, name, getattr(p, name).astype(np.float64))
    t = L.Trainer(p, v.noise(), 1)
    r = np.random.default_rng(2)
    contexts, targets, drawn = r.integers(0, L.CLASSES, (40, L.CONTEXT)), r.integers(0, L.CLASSES, 40), r.integers(0, L.CLASSES, L.NOISE)

    def gain():
        q = p.query(contexts)
        true = np.einsum("ij,ij->i", q, p.outputs[targets]) + p.bias[targets] - t.log_noise[targets]
        false = q @ p.outputs[drawn].T + p.bias[drawn] - t.log_noise[drawn]
        return -np.log1p(np.exp(-true)).sum() - np.log1p(np.exp(false)).sum()

    for x, g in zip((p.inputs, p.places, p.outputs, p.bias), t.gradients(contexts, targets, drawn), strict=True):
        for at in ((targets[0], 3), (1, 2), (drawn[0], 5), (contexts[0, 1], 0)):
            at = at[:1] if x.ndim == 1 else at
            if at[0] >= x.shape[0]:
                continue
            was, h = x[at], 1e-5
            x[at] = was + h
            up = gain()
            x[at] = was - h
            down = gain()
            x[at] = was
            assert abs((up - down) / (2 * h) - g[at]) < 1e-3


def test_contexts_stop_at_the_start_of_a_text():
    got = L.contexts_of(np.array([5, 6, 7, 8, 9]), np.array([0, 3]))
    s = L.START_CLASS
    assert got.tolist() == [[s, s, s], [5, s, s], [6, 5, s], [s, s, s], [8, s, s]]


def test_frequent_words_have_classes_of_their_own(spark, documents):
    rows = [(i, " ".join(f"w{k}" for k in range(600) if k < 300 or k % 7 == i % 7)) for i in range(40)]
    counted = documents(rows).select("text").mapInArrow(L._count, "word long, bucket short, n long").groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n"))
    v = L.Vocabulary.of(counted)
    classes, _ = v.classes(*L.tokens_of(" ".join(f"w{k}" for k in range(300)).encode()))
    assert len(set(classes.tolist())) == 301 and classes.max() < L.OWN and L.CLASSES >= 512


def test_wild_scores_stay_finite():
    p = L.Parameters.start(small_vocabulary())
    p.bias[:] = 0
    p.bias[5] = 500
    contexts = np.zeros((L.BLOCK + 3, L.CONTEXT), np.int64)
    got = p.log_probabilities(contexts, np.full(L.BLOCK + 3, 5))
    assert np.allclose(got, 0, atol=1e-4)
    assert np.allclose(p.log_probabilities(contexts[:1], np.array([6])), -500, atol=5)


def test_layout_does_not_change_scores(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 3000)  # some shards in every round
    rows = corpus(700) + [(None, "w1 w2 w3")] * 900 + [(9, None), (10, ""), (11, "w5 " * 20_000)]
    runs = [documents(rows).repartition(1), documents(rows[::-1]).repartition(8), documents(rows).repartition(5, F.crc32(F.col("text")))]
    found = [sorted(((str(g.doc_id), g.n_tokens, round(g.base_score, 6)), g.score) for g in L.score_documents(r).collect()) for r in runs]
    for other in found[1:]:
        assert [k for k, _ in other] == [k for k, _ in found[0]]
        assert np.allclose([v for _, v in other], [v for _, v in found[0]], rtol=1e-6)


def test_every_training_row_is_dealt_once(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 50)
    docs = documents([(None, "w1 w2 w3")] * 100 + [(i, f"w{i % 7} w2") for i in range(60)] + [(1, None)])
    counted = docs.select("text").mapInArrow(L._count, "word long, bucket short, n long").groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n"))
    got = L.dealt(docs, L.Vocabulary.of(counted)).collect()
    assert sum(g.copies for g in got) == 161 and sum(g.copies * len(g.classes) for g in got) == 400 + 180 + 1
    assert max(g.copies * len(g.classes) for g in got) <= 50 and {g.round for g in got} == set(range(L.ROUNDS))
    assert len({g.shard for g in got}) == 3


def test_state_and_steps_go_on():
    v = small_vocabulary()
    t = L.Trainer(L.Parameters.start(v), v.noise(), 1)
    r = np.random.default_rng(2)
    t.step(r.integers(0, L.CLASSES, (40, L.CONTEXT)), r.integers(0, L.CLASSES, 40))
    again = L.Trainer.of_state(t.state(), v.noise(), 1)
    assert again.steps == 1 and (again.state() == t.state()).all()


def odd_texts():
    r = random.Random(4)
    short = [" ".join(f"w{r.randrange(50)}é"[: r.randrange(1, 6)] for _ in range(r.randrange(9))) for _ in range(300)]
    return [None, "", "  ", "a", " B", "c\n", "É", *short, "long " * 40_000, "x" * 200_000, "", "end"]


def test_texts_that_are_worked_on_together_have_the_same_words():
    rows = [(t or "").encode() for t in odd_texts()]
    for some in (rows, rows[3:4], rows[1:3], [], rows[-4:]):
        words, tails, counts = T.words_and_tails_of_rows(some)
        each = [T.words_and_tails(t) for t in some]
        assert counts.tolist() == [w.size for w, _ in each]
        assert words.tolist() == [w for x, _ in each for w in x.tolist()] and tails.tolist() == [w for _, x in each for w in x.tolist()]
    sizes, words, buckets = L.tokens_of_rows([None, b"Ab a", b""])
    assert sizes.tolist() == [1, 3, 1] and (words[[0, 3, 4]] == L.END_TOKEN).all() and words.size == buckets.size == 5
    assert words[1:3].tolist() == T.word_hashes(b"ab a").tolist()


def test_short_texts_cost_no_pass_each(monkeypatch):
    calls = []
    spans = T.word_spans
    monkeypatch.setattr(T, "word_spans", lambda *a: calls.append(1) or spans(*a))
    rows = [f"word{i} and more" for i in range(3000)]
    got = list(L._count(iter([pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])])))
    assert len(calls) <= 10  # one for each text before
    assert sum(b.column(2).to_numpy().sum() for b in got) == 12_000 and sum(b.num_rows for b in got) == 3003
    assert list(L._count(iter([pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])]))) == []


def test_head_words_are_found_by_their_leading_bits():
    r = np.random.default_rng(5)
    close = np.uint64(7 << 40) + np.arange(40, dtype=np.uint64)  # of equal leading bits
    some = r.integers(0, 1 << 64, 900, dtype=np.uint64)
    edges = np.array([0, (1 << 64) - 1], np.uint64)
    for words in (np.unique(np.concatenate([close[::2], some[:500], edges])), np.unique(some[:3]), some[:1], np.sort(close)):
        own = np.where(np.arange(words.size) % 2 == 0, np.arange(words.size) % L.OWN, -1)
        v = L.Vocabulary(words, np.arange(words.size) + 1, own, 1, 1, np.ones(L.CLASSES, np.int64), np.ones(L.CLASSES, np.int64))
        asked = np.concatenate([close, some, edges, words])
        classes, counts = v.classes(asked, np.full(asked.size, 3))
        place = {w: i for i, w in enumerate(words.tolist())}
        at = [place.get(w, -1) for w in asked.tolist()]
        assert counts.tolist() == [i + 1 if i >= 0 else -1 for i in at]
        assert classes.tolist() == [own[i] if i >= 0 and own[i] >= 0 else L.OWN + 3 for i in at]


def test_rare_words_of_each_row():
    words, counts = np.array([9, 4, 9, 4, 4, 1, 1 << 63], np.uint64), np.array([-1, 2, -1, -1, -1, 5, -1])
    row, rare, often = L._rare(np.array([3, 2, 1, 1]), words, counts)
    assert (row.tolist(), rare.tolist(), often.tolist()) == ([0, 1, 3], [9, 4, 1 << 63], [2, 2, 1])
    assert [x.size for x in L._rare(np.array([1, 1]), words[:2], np.array([1, 1]))] == [0, 0, 0]
