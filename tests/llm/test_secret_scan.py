import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from meterlake.llm import secret_scan as S

PATTERNS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute_base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, good) in enumerate(PATTERNS) for m in p.finditer(text or "") if good(m)]
    return sorted(found)


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def brute(docs):
    """Base spans by the patterns as given; the others by sorting the p-values of each stratum."""
    base = [brute_base(t) for _, t in docs]
    found = [S.candidates(t or "", b) for (_, t), b in zip(docs, base)]
    tokens = defaultdict(dict)
    for (_, text), cs in zip(docs, found):
        for a, b, stratum, step, _ in cs:
            tokens[stratum][text[a:b]] = 10 ** (-step / 100)
    limit = {}
    for stratum, ps in tokens.items():
        values = sorted(ps.values())
        good = [p for i, p in enumerate(values) if p <= S.DISCOVERY_RATE * (i + 1) / len(values)]
        limit[stratum] = max(good, default=-1)
    out = []
    for (doc, _), bs, cs in zip(docs, base, found):
        new = [(a, 3, b) for a, b, stratum, step, _ in cs if 10 ** (-step / 100) <= limit[stratum]]
        out.append((doc, *(sum(k == i for _, k, _ in bs) for i in range(3)), hashlib.sha256(joined(bs).encode()).hexdigest(), joined(sorted(bs + new))))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


RND = random.Random(5)


def key(alphabet, n):
    return "".join(RND.choice(alphabet) for _ in range(n))


KEYS = [key(S.ALPHABETS[6], n) for n in (24, 32, 40, 64)] + [key(S.ALPHABETS[7], 48), key(S.ALPHABETS[2], 64), key(S.ALPHABETS[4], 64)]
WORDS = ["internationalisierungen", "electroencephalographically", "the_quick_and_the_lazy", "articles/2024/about_us", "Donaudampfschifffahrt", "aaaaaaaaaaaaaaaaaaaaaa", "ABABABABABABABABABABAB", "abcdefghijklmnopqrstuvwxyz"]
ODD = [
    'Password = "hunter2hunter2!"', "token: secret: abcdefghijklmnop", "api_key=abc", "APIKEY:'0123456789ab'", "tOkEn==abcdefghijkl", "passwdſ=abcdefghijklmn",
    "toKen=abcdefghijklmnop", "AKIA" + "Z" * 13, "AKIA" + "Z" * 14, "AKIAAKIA" + "Q" * 12, "xAKIA" + "B" * 16 + "y", "0123456789abcde", "é0123456789abcdefg", "F" * 20, "deadbeef" * 3 + "G" + "cafe" * 4,
    "secret:\n abcdefghijklmnop", "token = token = 0123456789abcdef01", "=" * 40, "-" * 30,
]


def test_equals_brute_force(documents):
    docs = [(i, f"Étion {t} fin") for i, t in enumerate([*ODD, *KEYS, *WORDS])]
    docs += [(100, None), (101, ""), (102, " ".join([*KEYS, *ODD, *WORDS])), (None, KEYS[0]), (103, KEYS[0]), (103, KEYS[0])]
    rows = got(S.scan_secrets(documents(docs).repartition(3)))
    assert rows == brute(docs)
    random_spans = {d: s for d, *_, s in rows}
    for i, k in enumerate(KEYS):
        assert f"random:6:{6 + len(k)}" in random_spans[len(ODD) + i]
    for i in range(len(ODD) + len(KEYS), len(ODD) + len(KEYS) + len(WORDS)):
        assert "random" not in random_spans[i]


def test_many_copies_of_a_token_count_once(documents):
    docs = [(i, KEYS[1]) for i in range(200)] + [(200 + i, w) for i, w in enumerate(WORDS)]
    rows = got(S.scan_secrets(documents(docs)))
    assert rows == brute(docs) and sum("random" in r[-1] for r in rows) == 200


def test_long_text_empty_table_and_columns_that_clash(documents):
    long = "palabra " * 100_000 + KEYS[0] + " x" * 50_000
    docs = documents([(1, long)]).selectExpr("doc_id", "text", "1 as base", "2 as found", "3 as spans", "4 as n_hex")
    (row,) = got(S.scan_secrets(docs))
    assert row == brute([(1, long)])[0] and row[-1] == f"random:800000:{800000 + len(KEYS[0])}"
    assert got(S.scan_secrets(docs.limit(0))) == []


def test_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(S.scan_secrets(docs)) == brute(rows)


def test_battery_against_its_definitions():
    symbols = np.frombuffer(KEYS[0].encode(), np.uint8)
    e = S.encoding_of(symbols)
    assert S.ALPHABETS[e] == S.ALPHABETS[6]
    text, alphabet = symbols.tobytes().decode(), S.ALPHABETS[e]
    n, size = len(text), len(alphabet)
    chi = sum((text.count(c) - n / size) ** 2 / (n / size) for c in alphabet)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in text]
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    codes = [alphabet.index(c) for c in text]
    serial = float(np.corrcoef(codes[:-1], codes[1:])[0, 1])
    excess = n * (size * S.TEXT_AGREE - 1)
    z = (size - 1 + excess - chi) / math.sqrt(2 * (size - 1) + 4 * excess)
    z += (changes - (n - 1) * 0.4) / math.sqrt((n - 1) * 0.24) + (math.atanh(0.4) - math.atanh(serial)) * math.sqrt(n - 3)
    random_p, text_p = S.battery(symbols, e)
    assert text_p == pytest.approx(0.5 * math.erfc(z / 2 / math.sqrt(2)))
    assert random_p > S.RANDOM_LEVEL


def test_random_tokens_pass_and_regular_ones_do_not():
    for alphabet in S.ALPHABETS:
        tokens = [key(alphabet, 40) for _ in range(300)]
        codes = [np.frombuffer(t.encode(), np.uint8) for t in tokens]
        passed = sum(S.battery(c, S.ALPHABETS.index(alphabet))[0] >= S.RANDOM_LEVEL for c in codes)
        assert passed >= 294
    for text in ("0123456789" * 5, "a" * 40, "ab" * 20, "A1" * 16):
        symbols = np.frombuffer(text.encode(), np.uint8)
        assert S.battery(symbols, S.encoding_of(symbols))[0] < S.RANDOM_LEVEL
