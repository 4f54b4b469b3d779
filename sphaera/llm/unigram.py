"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text's spaces become white-space markers, one marker goes before it, and the segmentation
with the highest sum of log scores is taken; a character that no piece covers costs the
smallest score less UNKNOWN_PENALTY and falls back to its UTF-8 bytes.  Decoding joins the
pieces and bytes and turns markers back into spaces.

The Viterbi runs over many distinct words at once, in numpy: no piece has a marker after
another character, so a text's best segmentation is that of its words, one after another.
Words of more than LONG characters, such as prose without spaces, are walked one by one instead.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, documents, small, worker_memo

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of text in one run of the Viterbi.
BLOCK_BYTES = 1 << 18
CHUNK_BYTES = 1 << 21
#: Characters of a word from which on it is walked alone: the numpy steps of a block are as many as its longest word has bytes.
LONG = 64

_UNITS = re.compile(r"\n| *[^ \n]+| +")


class Trie:
    """A double-array trie over bytes: from node s, byte c leads to ``t = base[s] + c`` if ``check[t] == s``; ``value[t]`` is an id or -1."""

    def __init__(self, keys: Iterable[tuple[bytes, int]]):
        nested: list = [{}, -1]
        for key, ident in keys:
            node = nested
            for c in key:
                node = node[0].setdefault(c, [{}, -1])
            node[1] = ident
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken, queue = bytearray(size), [(0, nested)]
        free = dict.fromkeys(range(1, 257), 1)  # where nodes of so many children are looked for from; gaps before may stay
        taken[0] = 1
        for at, (children, _) in queue:
            if not children:
                continue
            codes = sorted(children)
            slot = free[len(codes)]
            while True:
                base = slot - codes[0]
                if base + 256 >= len(taken):
                    more = len(taken)
                    taken.extend(bytes(more))
                    self.base, self.check, self.value = (np.concatenate([x, np.full(more, fill, np.int32)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
                if base > 0 and not taken[slot] and not any(taken[base + c] for c in codes):
                    break
                slot += 1
            free[len(codes)] = slot
            self.base[at] = base
            for c in codes:
                taken[base + c] = 1
                self.check[base + c], self.value[base + c] = at, children[c][1]
                queue.append((base + c, children[c]))


class Unigram:
    """Pieces with log scores.  ``pieces`` are texts with markers, ``byte_ids`` the ids of the 256 byte pieces."""

    def __init__(self, pieces: dict[int, str], scores: dict[int, float], byte_ids: list[int]):
        for piece in pieces.values():
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"a piece spans a word's end: {piece!r}")
        self.scores = np.zeros(max([*pieces, *byte_ids]) + 1, np.float32)
        self.scores[list(pieces)] = [scores[k] for k in pieces]
        self.unknown = np.float32(min(scores[k] for k in pieces) - UNKNOWN_PENALTY)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.bytes = [b""] * len(self.scores)
        for k, piece in pieces.items():
            self.bytes[k] = piece.replace(MARK, " ").encode()
        for byte, k in enumerate(byte_ids):
            self.bytes[k] = bytes([byte])
        self.fallback = np.zeros(len(self.scores), bool)
        self.fallback[byte_ids] = True
        self.trie = Trie((piece.encode(), k) for k, piece in pieces.items())
        self._quick = self._scores = None

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        """The pieces of a SentencePiece file with the scores that the file holds."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [k for k in range(len(model)) if model.is_control(k) or model.is_unknown(k) or model.is_unused(k)]
        byte_ids = sorted((k for k in range(len(model)) if model.is_byte(k)), key=lambda k: int(model.id_to_piece(k)[3:-1], 16))
        pieces = {k: model.id_to_piece(k) for k in sorted({*range(len(model))} - {*special, *byte_ids})}
        return cls(pieces, {k: model.get_score(k) for k in pieces}, byte_ids)

    def walk(self, word: bytes) -> np.ndarray:
        """The ids of the best segmentation of one word, however long; the same as ``viterbi`` gives."""
        base, check, value = self._lists()
        scores, n, worst = self._scores, len(word), float(self.unknown)
        best, back, ids = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            lead = word[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, to, single = best[at], 0, at, False
            while to < n:
                slot = base[node] + word[to]
                if check[slot] != node or slot <= 0:
                    break
                node, to = slot, to + 1
                k = value[node]
                if k >= 0:
                    if here + scores[k] > best[to]:
                        best[to], back[to], ids[to] = here + scores[k], at, k
                    single = single or to - at == width
            if not single and here + worst > best[at + width]:
                best[at + width], back[at + width], ids[at + width] = here + worst, at, -1
            at += width
        out, to = [], n
        while to:
            out.append([ids[to]] if ids[to] >= 0 else self.byte_ids[list(word[back[to] : to])])
            to = back[to]
        return np.concatenate(out[::-1]).astype("<i4") if out else np.empty(0, "<i4")

    def _lists(self) -> tuple:
        """The trie as arrays whose elements Python reads quickly; made once a worker."""
        if self._quick is None:
            self._quick = tuple(array("i", x.tobytes()) for x in (self.trie.base, self.trie.check, self.trie.value))
            self._scores = array("d", self.scores.astype(float).tobytes())
        return self._quick

    def viterbi(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of the best segmentation of each of the words (UTF-8, with markers)."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        start = np.concatenate([[0], np.cumsum(length)])
        ends, starts = start[1:], start[:-1]
        best = np.full(len(flat), -np.inf)  # of what ends before a place, but for a word's end
        from_, ident = np.full(len(flat), -1, np.int64), np.full(len(flat), -1, np.int32)
        last, last_from, last_id = np.full(n, -np.inf), np.full(n, -1, np.int64), np.full(n, -1, np.int32)
        begins = (flat & 0xC0) != 0x80
        width = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
        best[starts[length > 0]] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value

        def offer(w, at, to, score, k):
            done = to == ends[w]
            i, j = np.flatnonzero(~done), np.flatnonzero(done)
            i = i[score[i] > best[to[i]]]
            best[to[i]], from_[to[i]], ident[to[i]] = score[i], at[i], k[i]
            j = j[score[j] > last[w[j]]]
            last[w[j]], last_from[w[j]], last_id[w[j]] = score[j], at[j], k[j]

        for place in range(int(length.max(initial=0))):
            w = np.flatnonzero(length > place)
            w = w[begins[starts[w] + place]]
            at = starts[w] + place
            single = np.zeros(len(w), bool)
            row, node, to = np.arange(len(w)), np.zeros(len(w), np.int32), at
            while len(row):
                slot = base[node] + flat[to]
                ok = (check[slot] == node) & (slot > 0)
                row, node, to = row[ok], slot[ok], to[ok] + 1
                k = value[node]
                hit = np.flatnonzero(k >= 0)
                if len(hit):
                    r = row[hit]
                    offer(w[r], at[r], to[hit], self.scores[k[hit]] + best[at[r]], k[hit])
                    single[r[to[hit] - at[r] == width[at[r]]]] = True
                more = to < ends[w[row]]
                row, node, to = row[more], node[more], to[more]
            r = np.flatnonzero(~single)
            if len(r):
                to = at[r] + width[at[r]]
                offer(w[r], at[r], to, self.unknown + best[at[r]], np.full(len(r), -1, np.int32))
        out: list[np.ndarray] = []
        for w in range(n):
            ids, at, k, to = [], last_from[w], last_id[w], ends[w]
            while at >= 0:
                ids.append(self.byte_ids[flat[at:to]] if k < 0 else [k])
                to, k, at = at, ident[at], (from_[at] if at > starts[w] else -1)
            out.append(np.concatenate(ids[::-1]).astype("<i4") if ids else np.empty(0, "<i4"))
        return out

    def memo(self) -> Memo:
        """unit of a text -> its ids as little-endian 32-bit numbers."""

        def learn(units: list[str]) -> Iterator[bytes]:
            block, size, order = [], 0, sorted(range(len(units)), key=lambda k: len(units[k]))
            out: list[bytes] = [b""] * len(units)

            def flush():
                for k, ids in zip(block, self.viterbi([units[k].replace(" ", MARK).encode("utf-8", "surrogatepass") for k in block]), strict=True):
                    out[k] = ids.tobytes()

            for k in order:
                if len(units[k]) > LONG:
                    out[k] = self.walk(units[k].replace(" ", MARK).encode("utf-8", "surrogatepass")).tobytes()
                    continue
                block.append(k)
                size += len(units[k])
                if size >= BLOCK_BYTES:
                    flush()
                    block, size = [], 0
            flush()
            return iter(out)

        return Memo(learn)

    def encode(self, text: str | None, memo: Memo) -> np.ndarray:
        """The ids of a text; none for an empty one."""
        return next(self.encode_all([text], memo))

    def encode_all(self, texts: Iterable[str | None], memo: Memo) -> Iterator[np.ndarray]:
        """The ids of texts; their words are learnt together for about CHUNK_BYTES of text, as the Viterbi is quickest over many."""
        units, size = [], 0
        for text in texts:
            units.append(_UNITS.findall(" " + text) if text else [])
            size += len(text or "")
            if size >= CHUNK_BYTES:
                yield from self._encoded(units, memo)
                units, size = [], 0
        yield from self._encoded(units, memo)

    @staticmethod
    def _encoded(units: list[list[str]], memo: Memo) -> Iterator[np.ndarray]:
        memo.know(chain.from_iterable(units))
        for u in units:
            yield np.frombuffer(b"".join(memo.values(u)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


SCHEMA = "doc_id long, n_tokens long, n_fallback long, ids_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_fallback (byte pieces), ids_crc32 (of the little-endian 32-bit ids), round_trip of each row of docs.

    round_trip: decoding gives the text back; it doesn't where the text itself holds the
    marker.  A null or empty text has no tokens.  Rows that repeat, or have no doc_id, are each
    returned; other columns are ignored; an empty table gives no rows.  ``with_ids`` adds the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Unigram.from_model(path))

    def run(batches):
        model = shared.value
        memo = worker_memo(("unigram", path), model.memo)  # kept for a worker's later tasks
        for batch in small(batches, 1000):
            rows, every = [], []
            texts = batch.column(1).to_pylist()
            for doc_id, text, ids in zip(batch.column(0).to_pylist(), texts, model.encode_all(texts, memo), strict=True):
                rows.append((doc_id, len(ids), int(model.fallback[ids].sum()), zlib.crc32(ids.tobytes()), model.decode(ids) == (text or "")))
                every.append(ids)
            columns = list(zip(*rows)) if rows else [()] * 5
            out = [pa.array(c, pa.bool_() if k == 4 else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(every, pa.list_(pa.int32()))] * with_ids, [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

    return documents(docs).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give a null text, no ids an empty one.

    Rows that repeat, or have no doc_id, are each returned; other columns are ignored; an empty
    table gives no rows.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Unigram.from_model(path))

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else shared.value.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
