"""The unigram Viterbi against the sentencepiece library, its model file given the same log scores."""

import struct

import numpy as np
import pytest
import sentencepiece
from sphaera.llm import queries
from sphaera.llm.unigram import Unigram

PATH = queries.tokenizer_path("piece_bpe_32k.model")


def fields(data: bytes):
    """(number, wire type, value, raw) of a protocol buffer's fields."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte, at = data[at], at + 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        begin, tag = at, varint()
        if tag & 7 == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            value, at = data[at : at + n], at + n
        yield tag >> 3, tag & 7, value, data[begin:at]


def varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def as_unigram(path: str, scores: np.ndarray, known: set[int]) -> bytes:
    """The model file with other scores and the model type UNIGRAM."""
    out, k = b"", 0
    for number, _, value, raw in fields(open(path, "rb").read()):
        if number == 1:
            rest = b"".join(r for n, _, _, r in fields(value) if n != 2)
            inner = rest + b"\x15" + struct.pack("<f", scores[k] if k in known else 0)
            raw, k = b"\x0a" + varint(len(inner)) + inner, k + 1
        elif number == 2:
            inner = b"".join(r for n, _, _, r in fields(value) if n != 3) + b"\x18\x01"
            raw = b"\x12" + varint(len(inner)) + inner
        out += raw
    return out


@pytest.fixture(scope="module")
def model():
    return Unigram.from_model(PATH)


@pytest.fixture(scope="module")
def library(model):
    known = {k for k, b in enumerate(model.bytes) if b and not model.fallback[k]}
    return sentencepiece.SentencePieceProcessor(model_proto=as_unigram(PATH, model.scores, known))


TEXTS = ["", " ", "a", "Hello world", "  two  spaces ", "line\nbreak \n x", "été naïve Straße", "日本語 текст 😀🏳️‍🌈", "x" * 300, "▁ mark", "tab\tand\x00nul", "a" * 5 + " " * 16 + "b"]


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(model, library, text):
    assert model.encode(text, model.memo()).tolist() == library.encode(text)


def by_brute_force(model, score_of, text: str) -> float:
    """The highest sum of scores over all segmentations of a text."""
    text = "▁" + text.replace(" ", "▁")
    longest, best = max(map(len, score_of)), [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            score = score_of.get(text[start:end])
            if score is None and end - start == 1:
                score = float(model.unknown)
            if score is not None and best[start] + score > best[end]:
                best[end] = best[start] + score
    return best[-1]


def test_documents(model, library, spark, sf_dir):
    """Whole documents: the highest total by brute force, which is never below that of the library's own search, and the way back."""
    from sphaera.llm.unigram import decode_documents, encode_documents

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    encoded = encode_documents(docs, PATH, with_ids=True)
    score_of = {b.decode().replace(" ", "▁"): float(model.scores[k]) for k, b in enumerate(model.bytes) if b and not model.fallback[k]}
    for row in encoded.collect():
        ids = np.array(row.ids, int)
        unknown = sum((c not in score_of) for c in "▁" + texts[row.doc_id].replace(" ", "▁")) if texts[row.doc_id] else 0
        total = model.scores.astype(float)[ids[~model.fallback[ids]]].sum() + unknown * float(model.unknown)
        assert total == (by_brute_force(model, score_of, texts[row.doc_id]) if texts[row.doc_id] else 0)
        assert row.round_trip and row.n_tokens == len(row.ids) and row.n_fallback == model.fallback[ids].sum()
        theirs = np.array(library.encode(texts[row.doc_id]), int)
        assert total >= model.scores.astype(float)[theirs[~model.fallback[theirs]]].sum() + unknown * float(model.unknown) - 1e-2
    assert dict(decode_documents(encoded, PATH).collect()) == texts
    assert decode_documents(encoded.limit(0), PATH).count() == 0


def test_nulls_and_repeats(spark):
    from sphaera.llm.unigram import encode_documents

    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "a b", None), (2, "a b", None)], "doc_id long, text string, n_tokens string")
    assert sorted((r.doc_id, r.n_tokens) for r in encode_documents(docs, PATH).collect()) == [(1, 0), (1, 0), (2, 2), (2, 2)]
    assert encode_documents(docs.limit(0), PATH).count() == 0


def test_long_words_are_walked_as_the_viterbi_has_them(model, library):
    import random

    rng = random.Random(2)
    units = ["日本語", "テキスト", "abc", "the", "straße", "x", "é", "😀", "ing", "0", "한", "\x00"]
    for n in (1, 3, 30, 300):
        word = "".join(rng.choices(units, k=n)).encode()
        assert model.walk(word).tolist() == model.viterbi([word])[0].tolist()
    assert model.walk(b"").tolist() == []
    text = "日本語テキスト" * 4000  # unbroken
    ids = model.encode(text, model.memo())
    assert model.decode(ids) == text and ids.tolist() == library.encode(text)
    assert len(model.encode("x" * 5000 + "日本" * 500, model.memo())) > 0
