"""LM scoring: a log-bilinear neural model, trained with noise-contrastive estimation in numpy.

Words have classes: each of the most frequent words is one, and so is every bucket of the last two
bytes of the others. The vector of a context is the sum of the vectors of the classes before, each
weighted by its place; its product with the output vectors gives the probabilities of all classes,
normalised. Within a class a word has its smoothed share of the class's count; each bucket of
endings also has one unknown word, so the probabilities of all words add up to one.

Counts are exact and distributed. Training passes over every training token once. Rows are dealt to
rounds, and within a round to shards, by a hash of the row: their number follows from the count of
tokens, so neither the partitions nor the order of the input decide what is learnt. A shard runs
stochastic steps from the state that the round before left; the states of the shards are averaged,
weighted with their tokens, in whole numbers, whose sum no order changes. Only tables of fixed size
reach the driver: counts of the HEAD most frequent words, totals of the classes, and the state.
Counts of rarer words are joined."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.store import kept
from meterlake.llm.text import LOWER, lists, mix, signed, texts, words_and_tails_of_rows
from meterlake.sources.files import work_dir

#: Words with a class of their own, buckets of endings, and a bound of the words whose counts go to
#: every task.
OWN = 384
ENDINGS = 128
CLASSES = OWN + ENDINGS
HEAD = 65_536
CONTEXT = 3
WIDTH = 16
NOISE = 48
#: Tokens of a step: the first ones are small, and every DOUBLE steps the size doubles up to BATCH.
FIRST_BATCH, BATCH, DOUBLE = 64, 2048, 100
RATE = 0.1
#: Averages of the shards' states, each after another part of the rows.
ROUNDS = 4
#: Tokens of a shard in a round, on average, and tokens that are mixed before they make up steps.
SHARD = 500_000
MIXED = 1 << 18
#: Parts of one that the states are averaged in.
UNIT = 1 << 40
BLOCK = 512

END_TOKEN = mix(np.array([0xE0D], np.uint64))[0]
START_CLASS = CLASSES  # only in contexts
#: Bucket of an ending, by the number of its two bytes.
BUCKETS = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(ENDINGS)).astype(np.int64)


def tokens_of_rows(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and hashes and ending buckets of the lower-cased words and one end of
    every text, laid end to end."""
    words, tails, counts = words_and_tails_of_rows([(t or b"").translate(LOWER) for t in rows])
    ends = np.cumsum(counts)
    return counts + 1, np.insert(words, ends, END_TOKEN), np.insert(BUCKETS[tails], ends, 0)


def tokens_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ending buckets of the lower-cased words and one end."""
    return tokens_of_rows([text])[1:]


def training_rows():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2


def _sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _distinct(tokens: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the bucket of each, and how often it occurs."""
    found = pa.array(tokens).dictionary_encode()
    words, at = found.dictionary.to_numpy(), found.indices.to_numpy()
    of_words = np.zeros(words.size, np.int64)
    of_words[at] = buckets
    return words, of_words, np.bincount(at, minlength=words.size)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_distinct(*tokens_of_rows(texts(part.column(0)))[1:]) for part in _sliced([batch])]
        if not parts:
            continue
        words, first, place = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        buckets, counts = np.concatenate([p[1] for p in parts])[first], np.zeros(words.size, np.int64)
        np.add.at(counts, place, np.concatenate([p[2] for p in parts]))
        for low in range(0, words.size, 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(words[part]), pa.int64()), pa.array(buckets[part], pa.int16()), pa.array(counts[part], pa.int64())], ["word", "bucket", "n"]
            )


@dataclass(frozen=True)
class Vocabulary:
    """The HEAD words by hash, with counts and classes; totals of all training tokens."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    own: np.ndarray  # class of a head word, or -1
    total: int
    distinct: int
    class_counts: np.ndarray  # tokens of a class
    class_words: np.ndarray  # distinct words of a class

    @classmethod
    def of(cls, counted: DataFrame) -> Vocabulary:
        # the least bin of counts that keeps the head within its bound; bins are under 3000
        bins = counted.groupBy(F.floor(F.log2("n") * 64).alias("bin")).count().toPandas().sort_values("bin", ascending=False)
        fits = bins["bin"][bins["count"].cumsum() <= HEAD]
        head = counted.where(F.floor(F.log2("n") * 64) >= int(fits.min())) if len(fits) else counted.limit(0)
        top = head.toPandas().sort_values(["n", "word"], ascending=[False, True])
        words, counts, buckets = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["bucket"].to_numpy(np.int64)
        own = np.where(np.arange(words.size) < OWN, np.arange(words.size), -1)
        sums = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
        class_counts, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        at = OWN + sums["bucket"].to_numpy(np.int64)
        class_counts[at], class_words[at] = sums["n"].to_numpy(np.int64), sums["words"].to_numpy(np.int64)
        total, distinct = int(class_counts.sum()), int(class_words.sum())
        for i in np.flatnonzero(own >= 0):
            class_counts[own[i]], class_words[own[i]] = counts[i], 1
            class_counts[OWN + buckets[i]] -= counts[i]
            class_words[OWN + buckets[i]] -= 1
        order = np.argsort(words.view(np.uint64))
        return cls(words.view(np.uint64)[order], counts[order], own[order], total, distinct, class_counts, class_words)

    @cached_property
    def firsts(self) -> tuple[np.uint64, np.ndarray]:
        """How many bits of a hash do not lead, and for each value of the leading ones the place of the
        first head word that is not below it, or the last place."""
        bits = max(1, self.words.size.bit_length() + 1)
        shift = np.uint64(64 - bits)
        return shift, np.minimum(np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << shift), self.words.size - 1)

    def classes(self, words: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its count where it is a head word, else -1."""
        if self.words.size == 0:
            return OWN + buckets, np.full(words.size, -1, np.int64)
        shift, firsts = self.firsts
        at, last = firsts[words >> shift], self.words.size - 1
        late = np.flatnonzero(self.words[at] < words)
        while late.size:
            late = late[at[late] < last]
            at[late] += 1
            late = late[self.words[at[late]] < words[late]]
        found = self.words[at] == words
        own = np.where(found, self.own[at], -1)
        return np.where(own >= 0, own, OWN + buckets), np.where(found, self.counts[at], -1)

    def noise(self) -> np.ndarray:
        weights = self.class_counts + 1.0
        return weights / weights.sum()


@dataclass
class Parameters:
    inputs: np.ndarray  # context vectors of the classes and of the start
    places: np.ndarray  # weights of a place in the context
    outputs: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Parameters:
        r = np.random.default_rng(7)
        vectors = lambda n: (r.normal(size=(n, WIDTH)) * 0.1).astype(np.float32)
        return cls(vectors(CLASSES + 1), np.ones((CONTEXT, WIDTH), np.float32), vectors(CLASSES), np.log(vocabulary.noise()).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inputs, self.places, self.outputs, self.bias)])

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> Parameters:
        shapes = [(CLASSES + 1, WIDTH), (CONTEXT, WIDTH), (CLASSES, WIDTH), (CLASSES,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*[p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends), shapes, strict=True)])

    def seen(self, contexts: np.ndarray) -> list[np.ndarray]:
        """Vectors of the classes before, nearest first."""
        return [self.inputs.take(contexts[:, k], axis=0) for k in range(CONTEXT)]

    def query(self, contexts: np.ndarray) -> np.ndarray:
        return self.weighted(self.seen(contexts))

    def weighted(self, seen: list[np.ndarray]) -> np.ndarray:
        """Sums of the vectors of the classes before, each weighted by its place."""
        out = seen[0] * self.places[0]
        for k in range(1, CONTEXT):
            out += seen[k] * self.places[k]
        return out

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the normalised probabilities of the target classes."""
        out = np.empty(targets.size)
        outputs = np.concatenate([self.outputs, self.bias[:, None]], axis=1).T
        placed = [self.inputs * place for place in self.places]
        query = np.ones((BLOCK, WIDTH + 1), dtype=self.outputs.dtype)
        room = np.empty((BLOCK, outputs.shape[1]), dtype=self.outputs.dtype)
        ones = np.ones(outputs.shape[1], dtype=self.outputs.dtype)
        at = np.arange(BLOCK) * outputs.shape[1]
        for low in range(0, targets.size, BLOCK):
            n = min(BLOCK, targets.size - low)
            part = slice(low, low + n)
            vectors = placed[0].take(contexts[part, 0], axis=0)
            for k in range(1, CONTEXT):
                vectors += placed[k].take(contexts[part, k], axis=0)
            query[:n, :WIDTH] = vectors
            scores = np.matmul(query[:n], outputs, out=room[:n])
            own = scores.take(at[:n] + targets[part])
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                total = np.log(np.exp(scores, out=scores) @ ones)
            wild = np.flatnonzero(~np.isfinite(total))  # out of the range of single precision
            if wild.size:
                again = query[wild] @ outputs
                top = again.max(axis=1)
                total[wild] = top + np.log(np.exp(again - top[:, None]).sum(axis=1))
            out[part] = own - total
        return out


def contexts_of(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Classes before each token, nearest first; nothing is seen across the start of a text."""
    place = np.arange(classes.size) - np.repeat(starts, np.diff(np.append(starts, classes.size)))
    out = np.full((classes.size, CONTEXT), START_CLASS, dtype=np.int64)
    for k in range(CONTEXT):
        inside = np.flatnonzero(place > k)
        out[inside, k] = classes[inside - k - 1]
    return out


def _added(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by index, of less than 2**15: a sort and running sums per index."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # by digits
    ordered = rows.take(order)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out = np.zeros((size, values.shape[1]), dtype=np.float32)
    out[ordered[first]] = np.add.reduceat(values.take(order, axis=0), first, axis=0)
    return out


class Trainer:
    """Stochastic steps on batches of (context, class): true classes against noise classes that a
    batch shares, with step sizes scaled by past gradients."""

    def __init__(self, parameters: Parameters, noise: np.ndarray, seed: int):
        self.p, self.noise, self.random = parameters, noise, np.random.default_rng(seed)
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.past = [np.full(x.shape, 1e-2, np.float32) for x in (parameters.inputs, parameters.places, parameters.outputs, parameters.bias)]
        self.tokens = self.steps = 0

    def state(self) -> np.ndarray:
        """Parameters, scales of past gradients and the number of steps as one vector."""
        return np.concatenate([self.p.flat(), *[x.ravel() for x in self.past], [self.steps]]).astype(np.float64)

    @classmethod
    def of_state(cls, state: np.ndarray, noise: np.ndarray, seed: int) -> Trainer:
        half = state.size // 2
        out = cls(Parameters.of_flat(state[:half]), noise, seed)
        past = Parameters.of_flat(state[half:-1])
        out.past = [past.inputs, past.places, past.outputs, past.bias]
        out.steps = int(round(state[-1]))
        return out

    def gradients(self, contexts: np.ndarray, targets: np.ndarray, drawn: np.ndarray) -> list[np.ndarray]:
        p = self.p
        seen = p.seen(contexts)
        q, wanted, unwanted = p.weighted(seen), p.outputs.take(targets, axis=0), p.outputs[drawn]
        true = np.einsum("ij,ij->i", q, wanted) + p.bias[targets] - self.log_noise[targets]
        g_true = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # uphill
        g_false = q @ -unwanted.T  # the scores of the noise, with their sign turned; then in place
        g_false -= p.bias[drawn]
        g_false += self.log_noise[drawn]
        np.exp(np.clip(g_false, -30, 30, out=g_false), out=g_false)
        g_false += 1
        np.divide(-1, g_false, out=g_false)
        d_query = g_true[:, None] * wanted
        d_query += g_false @ unwanted
        d_outputs = _added(targets, g_true[:, None] * q, CLASSES)
        np.add.at(d_outputs, drawn, g_false.T @ q)
        d_bias = np.bincount(targets, weights=g_true, minlength=CLASSES) + np.bincount(drawn, weights=g_false.sum(axis=0), minlength=CLASSES)
        d_places = np.stack([(d_query * seen[k]).sum(axis=0) for k in range(CONTEXT)])
        d_inputs = sum(_added(contexts[:, k], d_query * p.places[k], CLASSES + 1) for k in range(CONTEXT))
        return [d_inputs, d_places, d_outputs, d_bias.astype(np.float32)]

    def step(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        drawn = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), CLASSES - 1)
        for x, past, g in zip((self.p.inputs, self.p.places, self.p.outputs, self.p.bias), self.past, self.gradients(contexts, targets, drawn), strict=True):
            g = g / targets.size
            past += g * g
            x += RATE * g / np.sqrt(past)
        self.tokens += targets.size
        self.steps += 1


def _classed(batch: pa.RecordBatch, column: int, vocabulary: Vocabulary):
    """Tokens of a batch's texts, laid end to end."""
    sizes, words, buckets = tokens_of_rows(texts(batch.column(column)))
    classes, counts = vocabulary.classes(words, buckets)
    starts = np.cumsum(sizes) - sizes
    return sizes, starts, words, classes, counts


def _class_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sizes, _, _, classes, _ = _classed(batch, 1, shared.value)
            rows = np.split(classes.astype(np.int16), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(rows, pa.int16())], ["deal", "classes"])

    return run


def dealt(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(deal, slice, copies, classes, shard, round): the class sequences of docs, each in one shard of
    one round by the hash of its row. Rows that repeat id and text are one with a count before they
    are shuffled; more copies than a shard has room for are slices that go to different shards."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("deal"), "text").mapInArrow(_class_rows(shared), "deal long, classes array<short>")
    counted = rows.groupBy("deal").agg(F.first("classes").alias("classes"), F.count("*").alias("n"))
    room = F.greatest(F.lit(1), F.floor(F.lit(SHARD) / F.size("classes"))).cast("long")
    sliced = counted.withColumn("room", room).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("room")))))
    place, shards = F.xxhash64("deal", "slice"), max(1, -(-vocabulary.total // (ROUNDS * SHARD)))
    out = sliced.select(
        "deal", "slice", F.least("room", F.col("n") - F.col("slice") * F.col("room")).alias("copies"), "classes",
        F.pmod(F.shiftrightunsigned(place, 8), F.lit(shards)).alias("shard"), F.pmod(place, F.lit(ROUNDS)).cast("int").alias("round"),
    )
    path = work_dir(docs.sparkSession, "lm-dealt")
    out.write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _mixed(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and starts of the rows, copies included, in blocks of about MIXED tokens. Equal hashes
    and slices are in the order of nothing else, so the order of the input is gone."""
    table = table.sort_by([("deal", "ascending"), ("slice", "ascending")]).combine_chunks()
    column = pa.concat_arrays(table.column("classes").chunks)
    flat, ends = column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    rows = np.repeat(np.arange(len(column)), table.column("copies").to_numpy())
    sizes = np.diff(ends)[rows]
    block = (np.cumsum(sizes) - sizes) // MIXED
    for part in np.split(np.arange(rows.size), np.flatnonzero(np.diff(block)) + 1):
        classes = np.concatenate([flat[ends[i] : ends[i + 1]] for i in rows[part]]).astype(np.int64)
        yield classes, np.cumsum(sizes[part]) - sizes[part]


def _train(shared):
    def run(table: pa.Table) -> pa.Table:
        noise, state, total = shared.value
        trainer = Trainer.of_state(state, noise, int(table.column("shard")[0].as_py()) + 11)
        for classes, starts in _mixed(table):
            contexts = contexts_of(classes, starts).T.copy()
            order = trainer.random.permutation(classes.size)
            low = 0
            while low < order.size:
                part = order[low : low + min(BATCH, FIRST_BATCH << min(trainer.steps // DOUBLE, 20))]
                trainer.step(contexts.take(part, axis=1).T, classes.take(part))
                low += part.size
        share = np.rint(trainer.state() * (trainer.tokens / total * UNIT)).astype(np.int64)
        return pa.table([pa.array([trainer.tokens], pa.int64()), lists([share], pa.int64())], ["weight", "state"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all states of a task."""
    weight, state = 0, None
    for batch in batches:
        for row in range(batch.num_rows):
            weight += batch.column(0)[row].as_py()
            values = batch.column(1)[row].values.to_numpy()
            state = values.copy() if state is None else state + values
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), lists([state], pa.int64())], ["weight", "state"])


def train(docs: DataFrame, vocabulary: Vocabulary) -> Parameters:
    """Parameters after one pass over the texts of docs in ROUNDS rounds. A round without rows leaves
    the state as it is."""
    spark = docs.sparkSession
    state = Trainer(Parameters.start(vocabulary), vocabulary.noise(), 0).state()
    rows = dealt(docs, vocabulary)
    shards = max(1, -(-vocabulary.total // (ROUNDS * SHARD)))
    tasks = min(shards, 8 * spark.sparkContext.defaultParallelism)
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary.noise(), state, max(vocabulary.total, 1)))
        of_round = rows.where(F.col("round") == number).select("shard", "deal", "slice", "copies", "classes").repartition(tasks, "shard")
        states = of_round.groupBy("shard").applyInArrow(_train(shared), "weight long, state array<long>").mapInArrow(_summed, "weight long, state array<long>")
        mean = (
            states.select("weight", F.posexplode("state").alias("at", "x")).groupBy("at")
            .agg(F.sum("x").alias("x"), F.sum("weight").alias("weight")).toPandas()  # one row a number of the state
        )
        if len(mean):
            part = mean["weight"].to_numpy(np.int64) / max(vocabulary.total, 1) * UNIT
            state = np.zeros(state.size)
            state[mean["at"].to_numpy(np.int64)] = mean["x"].to_numpy(np.int64) / part
        shared.destroy()
    return Trainer.of_state(state, vocabulary.noise(), 0).p


def _rare(sizes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of the distinct words of each row that are no head words, in this order."""
    at = np.flatnonzero(counts < 0)
    row, rare = np.repeat(np.arange(sizes.size), sizes)[at], words[at]
    order = np.lexsort((rare, row))
    row, rare = row[order], rare[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (rare[1:] != rare[:-1])) if at.size else at)
    return row[first], rare[first], np.diff(np.append(first, at.size)).astype(np.int32)


def _score(shared):
    """Of each text: what is known without the counts of rarer words, and the rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, parameters = shared.value
        within = np.zeros(CLASSES)
        within[OWN:] = -np.log10(vocabulary.class_counts[OWN:] + vocabulary.class_words[OWN:] + 1)
        for batch in _sliced(batches):
            sizes, starts, words, classes, counts = _classed(batch, 2, vocabulary)
            logs = parameters.log_probabilities(contexts_of(classes, starts), classes) / np.log(10) + within[classes]
            common = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 1), 0.0)
            logs += np.where(classes >= OWN, common, 0.0)
            total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            row, rare, often = _rare(sizes, words, counts)
            ends = np.searchsorted(row, np.arange(1, sizes.size))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(total((counts >= 0).astype(np.int64)), pa.int64()),
                    pa.array(total(common)), pa.array(total(logs)), lists(np.split(signed(rare), ends), pa.int64()), lists(np.split(often, ends), pa.int32()),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "common", "logs", "rare", "often"],
            )

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of
    (doc_id, text), learnt from the rows that are not held out.

    Null and empty texts are one end token; without training rows every word is unknown. A null
    doc_id has the CRC of no bytes. Repeated rows are scored, and counted in training, each on its
    own; other columns are ignored. Scores are sums of logarithms to base 10, and the same however
    the rows are partitioned and ordered (but for the last digits of a product of matrices)."""
    spark, training = docs.sparkSession, docs.where(training_rows())
    counted = kept(
        training.select("text").mapInArrow(_count, "word long, bucket short, n long").groupBy("word").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")),
        "lm-words",
    )
    vocabulary = Vocabulary.of(counted)
    shared = spark.sparkContext.broadcast((vocabulary, train(training, vocabulary)))
    rows = kept(
        docs.select("doc_id", (~training_rows()).alias("held_out"), "text")
        .mapInArrow(_score(shared), "doc_id long, held_out boolean, n_tokens long, known long, common double, logs double, rare array<long>, often array<int>")
        .withColumn("row", F.monotonically_increasing_id()),
        "lm-rows",
    )
    rare = rows.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "often")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.often")
    found = rare.join(counted.select("word", "n"), "word").groupBy("row").agg(
        F.sum("often").alias("also_known"), F.sum(F.col("often") * F.log10(F.col("n") + 1)).alias("more")
    )
    more, per_token = F.coalesce("more", F.lit(0.0)), F.log10(F.lit(float(vocabulary.total + vocabulary.distinct + 1)))
    return rows.drop("rare", "often").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("common") + more - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("logs") + more).alias("score"),
    )
