import hashlib
import random
import re

from meterlake.llm import winnow


def brute(docs, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = tokens(t), set(), set()
        for size in range(1, 11):
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    ids |= windows[tuple(w[k : k + size])]
        names = sorted(map(str, ids))
        out.append((repr(d), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_equals_brute_force(spark, documents):
    r = random.Random(3)
    word = lambda: r.choice(["la", "Über", "x9", "the", "of", "ca", f"w{r.randrange(300)}"])
    items = [(i, " ".join(word() for _ in range(r.choice([10, 11, 25, 40])))) for i in range(30)]
    items += [(100, "only four short words"), (101, "uniqueword"), (102, ""), (103, None), (104, "!!! ..."), (5, "an item of the same id with ten words and more of it"), (200, items[3][1])]
    docs = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            t = re.split(r"\W+", r.choice(items)[1] or "")
            k = r.randrange(len(t))
            w[r.randrange(len(w) + 1) : 0] = t[k : k + r.choice([9, 10, 14, 40])]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (502, "a uniqueWord here"), (502, "a uniqueWord here"), (503, items[0][1] * 1), (None, items[1][1].upper()), (504, "Only-four SHORT words, only four short words")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.decontaminate(documents(docs), frame).collect()
    assert sorted((repr(x.doc_id), *x[1:]) for x in got) == brute(docs, items)
    clean = winnow.clean_documents(documents(docs), frame)
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [d for d in docs if not brute([d], items)[0][5]]
    assert sorted(((x.doc_id, x.text) for x in clean.collect()), key=repr) == sorted(want, key=repr)


def test_clean_rows_stay_whatever_ids_they_share(spark, documents):
    item = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(5, f"a {item}"), (5, "clean"), (None, f"b {item}"), (None, "clean too"), (6, None), (6, ""), (7, "clean"), (7, "clean")]
    got = winnow.clean_documents(documents(rows), frame).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)


def test_no_rows(spark, documents):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert winnow.decontaminate(documents([]), empty).collect() == []
    assert [r.contaminated for r in winnow.decontaminate(documents([(1, "some words")]), empty).collect()] == [False]
