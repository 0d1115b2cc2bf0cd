import random
import zlib

import numpy as np

from meterlake.llm import bayes_svm as B


def corpus(rows, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(rows):
        w = ["".join(r.choice("aeiounrst") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(1, 120))]
        bad = i % 5 == 1
        kind = r.randrange(3)
        if bad:
            w = [x + "***" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else w[:9] * 30
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, documents):
    docs, labels = corpus(600)
    extra = [(9000, None), (9001, ""), (None, "one text"), (9002, "a"), (7, docs[7][1])]
    got = B.score_documents(documents(docs + extra), frame(spark, labels + [(8, None, 0), (None, 1, 0), (9, 0, 1), (9, 1, 1)])).collect()
    assert len(got) == 605
    truth = {i: q for i, q, _ in labels}
    out = [g for g in got if g.doc_id in truth and g.held_out and len(docs[g.doc_id][1].split()) > 8]
    assert len(out) > 80
    assert np.mean([g.predicted == truth[g.doc_id] for g in out]) > 0.95
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.3) for g in got)
    a, b = (g.score for g in got if g.doc_id in (9000, 9001))
    assert a == b


def test_held_out_labels_do_not_matter(spark, documents):
    docs, labels = corpus(200, 2)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    one, two = (sorted((g.doc_id, g.score) for g in B.score_documents(documents(docs), frame(spark, x)).collect()) for x in (labels, turned))
    assert one == two


def test_fit_is_the_minimum(monkeypatch):
    """The dual's value equals the primal's: the fit is the optimum."""
    monkeypatch.setattr(B, "FEATURES", 30)
    r = np.random.default_rng(1)
    rows = [np.flatnonzero(r.random(30) < 0.3) for _ in range(60)]
    sign = np.where([x.sum() % 2 for x in rows], 1.0, -1.0)
    values = [np.ones(x.size) / np.sqrt(max(1, x.size)) for x in rows]
    costs = np.full(60, 0.7)
    w, b = B.hinge_fit(rows, values, sign, costs, epochs=3000)
    objective = lambda w, b: (w @ w + b * b) / 2 + sum(c * max(0, 1 - s * (v @ w[x] + b)) for x, v, s, c in zip(rows, values, sign, costs))
    best = objective(w, b)
    for _ in range(300):
        assert objective(w + r.normal(size=30) * 0.05, b + r.normal() * 0.05) >= best - 1e-3


def test_few_or_no_labels(spark, documents):
    docs, labels = corpus(20, 3)
    assert {round(g.score, 6) for g in B.score_documents(documents(docs), frame(spark, [])).collect()} == {0.5}
    assert B.score_documents(documents([]), frame(spark, labels)).collect() == []
    good = B.good_documents(documents(docs), frame(spark, labels))
    scores = {g.doc_id for g in B.score_documents(documents(docs), frame(spark, labels)).where("predicted = 1").collect()}
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {g.doc_id for g in good.collect()} == scores


def test_rare_class_is_in_the_sample(spark, documents):
    """Some bad rows among many good ones: a sample of a tenth still has all of them."""
    docs, labels = corpus(900, 4)
    bad = [i for i, q, _ in labels if not q and i % 3 == 0 and zlib.crc32(str(i).encode()) % 5][:12]
    keep = [i for i, q, _ in labels if q or i in bad]
    rows = [docs[i] for i in keep] + [docs[bad[0]]] * 200  # one id in many rows
    known = frame(spark, [labels[i] for i in keep])
    assert B.class_sizes({True: len(keep) - 12, False: 12}, 90) == {False: 12, True: 78}
    assert B.class_sizes({True: 3}, 90) == {False: 0, True: 3} and B.class_sizes({True: 99, False: 98}, 90) == {False: 45, True: 45}
    model = B.train(documents(rows), known, rows=90)
    score = lambda i: model.score(B.indicators((docs[i][1] or "").encode()))
    low = [score(i) for i in bad]
    high = [score(i) for i in keep if i not in bad and len(docs[i][1].split()) > 8]
    assert np.mean(np.array(high) >= B.THRESHOLD) > 0.97
    assert np.median(low) < np.quantile(high, 0.02)


def test_weights_of_a_thinned_class_move_the_curve_only():
    r = np.random.default_rng(5)
    good = r.random(400) < 0.5
    margins = np.where(good, 1.0, -1.0) + r.normal(size=400)
    times = np.where(good, 3.0, 1.0)
    slope, offset = B.logistic_curve(margins, good, times)
    thrice = np.concatenate([np.flatnonzero(good)] * 3 + [np.flatnonzero(~good)])
    other = B.logistic_curve(margins[thrice], good[thrice], np.ones(thrice.size))
    assert np.allclose((slope, offset), other, atol=1e-6) and offset > B.logistic_curve(margins, good, np.ones(400))[1]
