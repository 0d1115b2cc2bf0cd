import random
import re

import numpy as np
import pytest

from meterlake.llm import jaccard
from meterlake.llm.store import components
from meterlake.llm.text import LOWER, VISIBLE, word_hashes


def brute(rows, n, percent):
    def grams(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((repr(d), len(sets[i]), least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows))


def family(seed, count, size, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(r.randrange(edits + 1)):
            words[r.randrange(size)] = f"x{r.randrange(10_000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_equals_brute_force(spark, documents, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 16)  # more than one tile
    texts = family(1, 60, 120, 6) + family(2, 40, 30, 3) + family(3, 25, 12, 1) + family(4, 20, 400, 20)
    texts += ["a b c", "A  b\tc", "", None, "one", "one two", "a b", " \n ", "a b c d " * 40, texts[0].upper(), texts[3], texts[3]]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (None, texts[5]), (None, "lone text of its own kind")]
    got = jaccard.jaccard_groups(documents(rows), n, percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in got) == brute(rows, n, percent)


def test_block_keys_of_linked_sets_meet():
    r = np.random.default_rng(5)
    for percent in (80, 90):
        blocks = jaccard.Blocks(percent)
        for size in [*range(5, 60), 100, 500, 3000]:
            a = r.integers(0, 1 << 63, size, dtype=np.uint64)
            for extra in (0, 1, size // 20, size // 12):
                cut = r.integers(0, size // 10 + 1)
                b = np.concatenate([a[cut:], r.integers(0, 1 << 63, extra, dtype=np.uint64)])
                both = size - cut
                if 100 * both >= percent * (size + b.size - both) and (cut or extra):
                    assert np.intersect1d(blocks.keys(np.unique(a)), blocks.keys(np.unique(b))).size, (percent, size, cut, extra)


def test_one_of_each_group(spark, documents):
    texts = family(9, 30, 200, 2)
    rows = [(i + 3, t) for i, t in enumerate(texts)] + [(3, texts[0]), (900, None), (901, ""), (902, "short text"), (None, texts[2])]
    got = jaccard.one_of_each_group(documents(rows)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(["3", "900", "901", "902"])
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_one_of_each_group_tells_rows_apart_by_id_and_text(documents):
    b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "bcd")
    rows = [(1, b), (1, c), (2, b), (None, d), (None, d + " more"), (None, "alone " * 9), (4, c), (4, c), (5, None), (5, None)]
    got = sorted(((x.doc_id, x.text) for x in jaccard.one_of_each_group(documents(rows)).collect()), key=repr)
    want = [(1, b), (1, c), (None, "alone " * 9), (5, None), (5, None)]
    assert [r for r in got if not (r[1] or "").startswith("d0")] == sorted(want, key=repr)
    assert len(got) == len(want) + 1  # one of the two null ids
    assert len(jaccard.one_of_each_group(documents([(9, c), (9, c)])).collect()) == 1


def test_components_against_a_search(spark, tmp_path):
    r = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(100, 400)] + [(i + 1, i) for i in range(900, 500, -2)] + [(1000, i) for i in range(1001, 1400)]  # paths and a star
    edges += [(int(a), int(b)) for a, b in r.integers(2000, 2300, (200, 2))] + [(5, 5), (None, 7), (7, None)]
    want = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            want.setdefault(a, {a}).add(b)
            want.setdefault(b, {b}).add(a)
    roots = {}
    for start in sorted(want):
        queue = [start] if start not in roots else []
        while queue:
            node = queue.pop()
            if node not in roots:
                roots[node] = start
                queue += want[node]
    got = components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {x.node: x.root for x in got.collect()} == roots
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_no_rows(spark, documents):
    assert jaccard.jaccard_groups(documents([])).collect() == []
    assert jaccard.one_of_each_group(documents([])).collect() == []


def test_long_text_goes_in_pieces(monkeypatch):
    from meterlake.llm import text

    data = b" ".join(b"word%d" % (i % 97) for i in range(5000)) + b"x" * 3000 + b" end"
    whole = word_hashes(data)
    monkeypatch.setattr(text, "PIECE", 256)
    assert (word_hashes(data, VISIBLE) == whole).all()
    assert whole.size == 5001
