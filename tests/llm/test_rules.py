import random
import re
from collections import Counter

import numpy as np

from meterlake.llm import rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = list(zip(words, words[1:], words[2:]))
    seen, cover = Counter(runs), set()
    for i, r in enumerate(runs):
        if seen[r] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n)


def corpus(seed, rows):
    r = random.Random(seed)
    out = []
    for i in range(rows):
        w = ["".join(r.choice("aeiounrst") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 200))]
        if i % 6 == 0:
            w = [x + "***" for x in w]
        if i % 11 == 0:
            w = w[:20] * 5
        out.append((i, " ".join(x + ("\n" if r.random() < 0.05 else "") for x in w)))
    return out


EDGE = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "a\n a\na\r\na\x0b"), (9004, "a b c a b c"), (9005, "ü é x 你"), (None, "x " * 60), (9006, "one\n\none\n")]


def test_counts_equal_brute_force(documents):
    many = " ".join(f"w{i % 90}" for i in range(400))
    rows = corpus(1, 80) + EDGE + [(9100, many + " x " + many), (9101, f"a b {many} c")]
    got = rules.quality_rules(documents(rows)).collect()
    want = sorted((repr(d), *brute(t)) for d, t in rows)
    assert sorted((repr(g.doc_id), *g[1:7]) for g in got) == want
    assert not any(g.kept for g in got if g.base_failed)


def test_outliers_equal_numpy(spark, documents):
    rows = corpus(2, 400)
    frame = documents(rows, source="a")
    got = {g.doc_id: g for g in rules.quality_rules(frame).collect()}
    x = []
    ids = []
    for d, t in rows:
        n, chars, symbols, dup, rep, failed = brute(t)
        lines = len([v for v in t.split("\n") if v.strip()])
        if not failed:
            ids.append(d)
            x.append([np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(dup / lines), np.sqrt(rep / n)])
    x, floor = np.array(x), np.array(list(rules.FLOORS.values()))
    centre = np.sort(x, axis=0)[(len(x) - 1) // 2]
    spread = np.sqrt((1.4826 * np.sort(np.abs(x - centre), axis=0)[(len(x) - 1) // 2]) ** 2 + floor**2)
    cov = np.diag(spread**2)
    for _ in range(rules.STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        bins = np.floor(np.log2(d2 + 1e-6) * rules.BINS)
        limit = np.sort(bins)[-(-len(x) // 2) - 1]
        near = x[bins <= limit]
        centre, cov = near.mean(axis=0), rules.HALF_FACTOR * np.cov(near.T, bias=True) + np.diag(floor**2)
    d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    near = x[d2 <= rules.REWEIGHT]
    centre, cov = near.mean(axis=0), rules.REWEIGHT_FACTOR * np.cov(near.T, bias=True) + np.diag(floor**2)
    d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    assert np.allclose(d2, [got[d].distance for d in ids], rtol=1e-6)
    assert [got[d].kept for d in ids] == list(d2 <= rules.REJECT)
    assert {d for d in ids if not got[d].kept} >= {d for d in ids if d % 6 == 0}


def test_pipeline_form_agrees(spark, documents):
    frame = documents(corpus(3, 120) + EDGE).union(documents(corpus(4, 40), lang=None, source=None)).union(documents(corpus(5, 8), lang="fr", source="b"))
    want = sorted(repr(g.doc_id) for g in rules.quality_rules(frame).where("kept").collect())
    got = rules.good_documents(frame)
    assert got.columns == frame.columns
    assert sorted(repr(g.doc_id) for g in got.collect()) == want
    assert rules.quality_rules(documents([])).collect() == []
    assert rules.good_documents(documents([])).collect() == []
