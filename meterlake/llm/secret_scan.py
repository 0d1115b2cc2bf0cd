"""Secret scans: fixed patterns, and a battery of randomness tests on the other tokens.

1. Patterns (`base_spans`): assignments to secret names, access keys, runs of hex digits.
2. Every other run of 16 or more letters, digits, +, /, - and _ is a candidate. Its encoding is the
   smallest alphabet that holds its symbols.
3. Three tests: chi-squared of the symbol counts against equal shares, the number of runs of digits,
   capitals and small letters, and the serial correlation of neighbouring symbols. Each is held
   against two hypotheses. "Random": all symbols equally likely and independent; a token that any
   test rejects at RANDOM_LEVEL in all is no secret (repeats, counters, ids with fixed groups).
   "Text": symbols as unequal as TEXT_AGREE says, class changes and correlation as in names and
   words; the p-value is that of looking so random under it. Both expectations follow the length of
   the token, so a short one needs more evidence.
4. False discoveries are controlled over the distinct tokens of the whole corpus by the step-up
   procedure at DISCOVERY_RATE, for every encoding and doubling of the length on its own: many short
   words do not loosen the limit of long keys, nor the reverse. p-values count in steps of a
   hundredth of their logarithm, so the corpus counts are a table of bounded size."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.store import kept

KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])
_ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# A run is taken whole or not at all, so its least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
MIN_ASSIGNED = 12
_HINTS = ("passw", "secret", "token", "api")

_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
_DIGITS, _LARGE, _SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in the order in which they are tried, by size.
ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LARGE + "234567", _DIGITS + _SMALL, _DIGITS + _LARGE,
    _DIGITS + _LARGE + _SMALL, _LARGE + _SMALL + _DIGITS + "+/", _LARGE + _SMALL + _DIGITS + "-_",
)
#: Text: the chance that two letters agree, the correlation of neighbours, the rate of class changes
#: (alphabets with letters of one case; of both, where a capital in the middle makes two changes).
TEXT_AGREE, TEXT_SERIAL = 0.065, 0.4
TEXT_CHANGES, TEXT_CHANGES_TWO_CASES = 0.2, 0.4
RANDOM_LEVEL = 0.001
DISCOVERY_RATE = 0.01
LENGTH_CLASSES = 48
MAX_STEP = 30_000


def _codes() -> tuple[list[np.ndarray], np.ndarray]:
    places = []
    for alphabet in ALPHABETS:
        at = np.full(128, -1, np.int64)
        at[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        places.append(at)
    kind = np.full(128, 3, np.int64)
    for k, symbols in enumerate((_DIGITS, _LARGE, _SMALL)):
        kind[[ord(c) for c in symbols]] = k
    return places, kind


_PLACES, _CLASS = _codes()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; offsets are code points."""
    found = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGNED]
    return sorted(found)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(symbols: np.ndarray) -> int:
    """The first alphabet that holds all symbols (ASCII codes), or -1."""
    return next((e for e, at in enumerate(_PLACES) if (at[symbols] >= 0).all()), -1)


def battery(symbols: np.ndarray, encoding: int) -> tuple[float, float]:
    """(p of the least random test under "random", times three; p under "text") of a token."""
    code, size, n = _PLACES[encoding][symbols], len(ALPHABETS[encoding]), symbols.size
    counts = np.bincount(code, minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    kinds = _CLASS[symbols]
    changes = int((kinds[1:] != kinds[:-1]).sum())
    share = np.bincount(_CLASS[[ord(c) for c in ALPHABETS[encoding]]], minlength=4) / size
    a, b = code[:-1] - code[:-1].mean(), code[1:] - code[1:].mean()
    spread = math.sqrt(float((a * a).sum()) * float((b * b).sum()))
    serial = float((a * b).sum()) / spread if spread else 1.0
    z_serial = math.atanh(max(-0.999999, min(0.999999, serial)))

    free = size - 1
    cube = (chi / free) ** (1 / 3)  # nearly normal
    p_chi = 2 * _normal_tail(abs(cube - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))  # too equal is not random either
    rate = 1 - float((share * share).sum())
    p_runs = 1.0
    if rate > 0:
        p_runs = 2 * _normal_tail(abs(changes - (n - 1) * rate) / math.sqrt((n - 1) * rate * (1 - rate)))
    p_serial = 2 * _normal_tail(abs(z_serial) * math.sqrt(n - 3))
    random = min(1.0, 3 * min(p_chi, p_runs, p_serial))

    # Digits and hex digits of text (dates, counters) are half as unequal again as equal shares.
    excess = n * max(size * TEXT_AGREE - 1, 0.5)
    z = ((free + excess) - chi) / math.sqrt(2 * free + 4 * excess)
    if rate > 0:
        usual = TEXT_CHANGES_TWO_CASES if share[1] > 0 and share[2] > 0 else TEXT_CHANGES
        z += (changes - (n - 1) * usual) / math.sqrt((n - 1) * usual * (1 - usual))
    z += (math.atanh(TEXT_SERIAL) - z_serial) * math.sqrt(n - 3)
    # The last two both see the order of symbols: their correlation is taken as one half.
    return random, _normal_tail(z / (2 if rate > 0 else math.sqrt(2)))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, stratum, step, key) of each token that is in no base span. The step is the p-value
    under "text" in hundredths of its negative logarithm, rounded up in p, or 0 for a token that
    "random" is rejected for; the key tells tokens apart."""
    out = []
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if any(s <= start and end <= e for s, _, e in base):
            continue
        symbols = np.frombuffer(m[0].encode(), np.uint8)
        encoding = encoding_of(symbols)
        if encoding < 0:
            continue
        random, text_p = battery(symbols, encoding)
        step = 0 if random < RANDOM_LEVEL else MAX_STEP if text_p <= 0 else min(MAX_STEP, int(-100 * math.log10(text_p)))
        key = int.from_bytes(hashlib.blake2b(m[0].encode(), digest_size=8).digest(), "little", signed=True)
        out.append((start, end, encoding * LENGTH_CLASSES + min(LENGTH_CLASSES, len(m[0]).bit_length()) - 1, step, key))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("step", pa.int32()), ("key", pa.int64())]))
_SCHEMA = (
    "doc_id long, base array<struct<start: long, kind: int, end: long>>,"
    " found array<struct<start: long, end: long, stratum: int, step: int, key: long>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, found = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
            found.append([dict(zip(("start", "end", "stratum", "step", "key"), c, strict=True)) for c in candidates(text or "", spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _SPANS), pa.array(found, _FOUND)], ["doc_id", "base", "found"])


def limits(scanned: DataFrame) -> list[int]:
    """By stratum the least step that counts as a discovery, MAX_STEP + 1 where none does.

    Step-up procedure: the largest p-value that is at most DISCOVERY_RATE times the share of the
    stratum's distinct tokens with that p-value or a smaller one."""
    tokens = scanned.select(F.explode("found").alias("c")).select("c.stratum", "c.step", "c.key").distinct()
    steps = tokens.groupBy("stratum", "step").agg(F.count("*").alias("n"))  # at most MAX_STEP rows a stratum
    up_to = Window.partitionBy("stratum").orderBy(F.desc("step"))
    share = F.sum("n").over(up_to) / F.sum("n").over(Window.partitionBy("stratum"))
    good = steps.withColumn("share", share).where(F.pow(F.lit(10.0), -F.col("step") / 100) <= DISCOVERY_RATE * F.col("share"))
    out = [MAX_STEP + 1] * (len(ALPHABETS) * LENGTH_CLASSES)
    for stratum, step in good.groupBy("stratum").agg(F.min("step")).collect():  # one row a stratum
        out[stratum] = step
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of (doc_id, text).

    Spans are whole matches, kind:start:end in code points, joined by commas in the order of start
    and kind; kind random is a token that the tests found. A token inside a base span is not judged.
    Null and empty texts have no spans. Repeated rows are scanned each on its own, and their tokens
    count once for the false discoveries; an empty table gives no rows; a null doc_id stays null;
    other columns are ignored."""
    scanned = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA), "secrets-scanned")
    least = F.array(*[F.lit(s) for s in limits(scanned)])
    new = F.transform(
        F.filter("found", lambda c: c["step"] >= F.get(least, c["stratum"])),
        lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")),
    )
    counts = [_count_of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return scanned.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", new))).alias("spans"))
