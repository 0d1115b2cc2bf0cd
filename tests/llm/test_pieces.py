import random

import numpy as np
import pytest

from meterlake.llm.pieces import MARK, DoubleArray, Pieces, decode_documents, encode_documents, piece_counts

PATH = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", "a", "  Hello  wörld 你𝄞\n x", "the erthion of ñandú\n\n\nção", "   ", "x" * 3000, "tab\there\x00\x7f", "a▁b", "ends \n", "日本語 テキスト",
         " ".join(random.Random(1).choice(["the", "ing", "Über", "ción", "x%%%", "12.5"]) + random.Random(i).choice("abc") for i in range(400))]


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(PATH)


def test_paths_equal_the_library(pieces):
    """The library's own best path, for a model of the same pieces with our log scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = float(pieces.scores[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encode_all, score = pieces.encoder(), lambda ids: sum(pieces.scores[i] for i in ids)
    for t, ids in zip(TEXTS, encode_all([t.encode() for t in TEXTS]), strict=True):
        own, theirs = ids.tolist(), library.encode(t)
        assert own == theirs or abs(score(own) - score(theirs)) < 1e-3, t


def test_file_scores_are_no_worse_than_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=open(PATH, "rb").read() + b"\x12\x02\x18\x01")
    own = Pieces.load(PATH, file_scores=True)
    encode_all, score = own.encoder(), lambda ids: sum(own.scores[i] for i in ids)
    for t, ids in zip(TEXTS, encode_all([t.encode() for t in TEXTS]), strict=True):  # the library adds scores of -1e9 in single precision, so its path may score less
        assert ids.tolist() == library.encode(t) or score(ids) >= score(library.encode(t)), t


def test_path_is_the_best_of_all(pieces):
    words = {w.replace(b" ", MARK): i for i, w in enumerate(pieces.surface) if w and i > 258}

    def best(unit):
        top = [0.0] + [-np.inf] * len(unit)
        for i in range(len(unit)):
            for j in range(i + 1, len(unit) + 1):
                if unit[i:j] in words:
                    top[j] = max(top[j], top[i] + pieces.scores[words[unit[i:j]]])
        return top[-1]

    r = random.Random(2)
    units = [b" " + "".join(r.choice("theraingos") for _ in range(r.randrange(1, 14))).encode() for _ in range(200)]
    for unit, ids in zip(units, pieces.paths(units), strict=True):
        assert abs(sum(pieces.scores[i] for i in ids) - best(unit.replace(b" ", MARK))) < 1e-9


def test_double_array_finds_its_words_only():
    words = {b"a": 0, b"ab": 1, b"abc": 2, b"b\xff": 3, b"zz": 4}
    trie = DoubleArray(words)

    def find(word):
        s = 0
        for c in word:
            n = trie.base[s] + c
            if trie.base[s] <= 0 or trie.check[n] != s:
                return -1
            s = n
        return trie.leaf[s]

    assert {w: find(w) for w in words} == words
    assert [find(w) for w in (b"abcd", b"b", b"z", b"c", b"")] == [-1] * 5


def test_documents_round_trip(spark, documents):
    rows = list(enumerate(TEXTS)) + [(90, None), (None, "again"), (3, TEXTS[3])]
    counts = {repr(r.doc_id): r for r in piece_counts(documents(rows), PATH).collect()}
    assert all(r.round_trip for r in counts.values())
    assert counts["90"].n_pieces == 0 and counts["2"].n_byte_pieces == 5
    encoded = encode_documents(documents(rows), PATH)
    decoded = decode_documents(encoded, PATH).collect()
    assert sorted((repr(r.doc_id), r.text) for r in decoded) == sorted((repr(d), (t or "").replace("▁", " ")) for d, t in rows)
    assert all(len(r.piece_ids) == r.n_pieces for r in decoded)
    assert piece_counts(documents([]), PATH).collect() == []
