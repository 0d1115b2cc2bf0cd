"""SentencePiece encoding and decoding: the best path over the pieces of a model file.

White space becomes the marker of the pieces, and a marker stands before the text. The path with
the greatest sum of log scores is found by dynamic programming (Viterbi) over a double-array trie
of the pieces, for many words at a time; a character that no piece has falls back to its bytes.

The pieces of the file are in order of their merges; the log score of a piece is that of Zipf's
law for its rank, unless the scores of the file are asked for. Nothing is trained."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from meterlake.llm.text import lists, texts

MARK = "▁".encode()
#: A character without a piece scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
CACHE_UNITS = 400_000
#: Texts that are encoded together.
ROWS = 256
#: Bytes of units whose paths are searched at a time.
AREA = 1 << 19


class DoubleArray:
    """Trie of byte strings: the child of state s by byte c is base[s] + c if check of it is s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, number in words.items():
            node = 0
            for c in word:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = number
        size = 1024
        base, check, leaf = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        place = {0: 0}
        queue, low = [0], 1
        for node in queue:
            codes = sorted(children[node])
            if not codes:
                continue
            while low < size and check[low] >= 0:
                low += 1
            b, tries = max(1, low - codes[0]), 0
            while True:
                need = b + 257 - size
                if need > 0:
                    grow = max(need, size)
                    base += [0] * grow
                    check += [-1] * grow
                    leaf += [-1] * grow
                    size += grow
                if all(check[b + c] < 0 for c in codes):
                    break
                b += 1
                tries += 1
            if tries > 200:
                low += 1  # crowded: start further on
            state = place[node]
            base[state] = b
            for c in codes:
                child = children[node][c]
                check[b + c], leaf[b + c], place[child] = state, value[child], b + c
                queue.append(child)
        self.base, self.check, self.leaf = (np.array(x, dtype=np.int32) for x in (base, check, leaf))


@dataclass
class Pieces:
    trie: DoubleArray
    scores: np.ndarray  # by id
    surface: list[bytes]  # bytes that an id stands for
    byte_ids: np.ndarray
    unknown: float
    inside: np.ndarray  # of two bytes (first * 256 + second): true if a piece may go across them

    @classmethod
    def load(cls, path: str, file_scores: bool = False) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        words, surface, byte_ids, scores = {}, [b""] * count, np.full(256, -1, np.int32), np.zeros(count)
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                words[piece.encode()] = i
                surface[i] = piece.encode().replace(MARK, b" ")
                scores[i] = model.get_score(i)
        if not file_scores:
            for rank, i in enumerate(words.values()):
                scores[i] = -math.log(rank + 1)
        if (byte_ids < 0).any() or any("▁" in w.decode().lstrip("▁") for w in words):
            raise ValueError("the model needs all byte pieces, and markers only in front")
        unknown = min(scores[i] for i in words.values()) - UNKNOWN_PENALTY
        inside = np.zeros(1 << 16, dtype=bool)
        for i in words.values():
            for a, b in zip(surface[i], surface[i][1:], strict=False):
                inside[a * 256 + b] = True
        for second in range(128, 192):  # never within a character
            inside[second::256] = True
        return cls(DoubleArray(words), scores, surface, byte_ids, unknown, inside)

    def units(self, text: bytes) -> list[bytes]:
        """Parts of a text that no piece crosses; together they are the marked text. A space is
        the marker, so a text that has markers decodes to spaces."""
        if not text:
            return []
        marked = b" " + text.replace(MARK, b" ")
        data = np.frombuffer(marked, dtype=np.uint8)
        cuts = [0, *(np.flatnonzero(~self.inside[data[:-1].astype(np.uint16) * 256 + data[1:]]) + 1).tolist(), len(marked)]
        return [marked[a:b] for a, b in zip(cuts, cuts[1:])]

    def paths(self, units: list[bytes]) -> list[list[int]]:
        """Ids of the best path of each unit."""
        out: list[list[int]] = [[]] * len(units)
        marked = [u.replace(b" ", MARK) for u in units]
        order = sorted(range(len(units)), key=lambda i: len(marked[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(marked[order[end]]) <= AREA:
                end += 1
            for i, ids in zip(order[at:end], self._search([marked[i] for i in order[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out

    def _search(self, words: list[bytes]) -> list[list[int]]:
        width = len(words[-1])
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width).T.astype(np.int32)
        length = np.array([len(w) for w in words])
        # width of the character that starts at a byte
        chars = np.where(data < 128, 1, np.where(data < 224, 2, np.where(data < 240, 3, 4)))
        best = np.full((width + 1, len(words)), -np.inf)
        best[0] = 0.0
        piece = np.full((width + 1, len(words)), -1, dtype=np.int32)
        start = np.zeros((width + 1, len(words)), dtype=np.int32)
        base, check, leaf = self.trie.base, self.trie.check, self.trie.leaf
        for i in range(width):
            rows = np.flatnonzero((length > i) & (best[i] > -np.inf))
            if rows.size == 0:
                continue
            here, single = rows, np.zeros(len(words), dtype=bool)
            state = np.zeros(rows.size, dtype=np.int32)
            for k in range(i, width):
                child = base[state] + data[k, rows]
                on = (check[child] == state) & (length[rows] > k) & (base[state] > 0)
                rows, state = rows[on], child[on]
                if rows.size == 0:
                    break
                found = leaf[state]
                ends = np.flatnonzero(found >= 0)
                if ends.size:
                    r, ids = rows[ends], found[ends]
                    total = best[i, r] + self.scores[ids]
                    better = total > best[k + 1, r]
                    r, ids = r[better], ids[better]
                    best[k + 1, r], piece[k + 1, r], start[k + 1, r] = total[better], ids, i
                    single[rows[ends]] |= chars[i, rows[ends]] == k + 1 - i
            lone = here[~single[here]]
            if lone.size:
                end = i + chars[i, lone]
                total = best[i, lone] + self.unknown
                better = total > best[end, lone]
                lone, end = lone[better], end[better]
                best[end, lone], piece[end, lone], start[end, lone] = total[better], -1, i
        out = []
        pieces, starts = piece.T.tolist(), start.T.tolist()
        for w, p, s in zip(words, pieces, starts, strict=True):
            at, ids = len(w), []
            while at > 0:
                if p[at] >= 0:
                    ids.append(p[at])
                else:
                    ids.extend(int(self.byte_ids[c]) for c in w[s[at] : at][::-1])
                at = s[at]
            ids.reverse()
            out.append(ids)
        return out

    def encoder(self):
        """A function from texts to their ids that remembers the paths of recent units. The paths
        of all new units of the texts are searched together."""
        memory: dict[bytes, bytes] = {}

        def encode(many: list[bytes]) -> list[np.ndarray]:
            units = [self.units(t) for t in many]
            new = list(set().union(*units) - memory.keys())
            if len(memory) + len(new) > CACHE_UNITS:
                memory.clear()
                new = list(set().union(*units))
            found = self.paths(new)
            flat, at = np.fromiter((i for ids in found for i in ids), dtype=np.int32).tobytes(), 0
            for unit, ids in zip(new, found, strict=True):
                memory[unit] = flat[at : at + 4 * len(ids)]
                at += 4 * len(ids)
            return [np.frombuffer(b"".join(map(memory.__getitem__, u)), dtype=np.int32) for u in units]

        return encode

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the text of ids: markers become spaces and the first one goes."""
        return b"".join(map(self.surface.__getitem__, ids.tolist())).removeprefix(b" ")


def encode_documents(docs: DataFrame, model_path: str, file_scores: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, piece_ids for every row of (doc_id, text). A null text is
    encoded as an empty one, which has no pieces; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path, file_scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        encode, is_byte = pieces.encoder(), np.zeros(pieces.scores.size, dtype=bool)
        is_byte[pieces.byte_ids] = True
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                ids = encode([t or b"" for t in texts(batch.column(1))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([i.size for i in ids], pa.int64()), pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()), lists(ids, pa.int32())],
                    ["doc_id", "n_pieces", "n_byte_pieces", "piece_ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, piece_ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of encoded and `text`, decoded from piece_ids; null ids give an empty text, and
    bytes that are no UTF-8 become replacement characters."""
    held = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model_path))
    names = encoded.columns
    place = names.index("piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                column = batch.column(place)
                flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())])
                out = [held.value.decode(flat[a:b]).decode(errors="replace") for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, text string")


def piece_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_sha256 (of the ids, comma-joined) and round_trip: the
    decoded text is the text, with markers as spaces and null as empty."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        encode, is_byte = pieces.encoder(), np.zeros(pieces.scores.size, dtype=bool)
        is_byte[pieces.byte_ids] = True
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                given = [t or b"" for t in texts(batch.column(1))]
                ids = encode(given)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([i.size for i in ids], pa.int64()), pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(str, i.tolist())).encode()).hexdigest() for i in ids], pa.string()),
                        pa.array([pieces.decode(i) == t.replace(MARK, b" ") for i, t in zip(ids, given, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
