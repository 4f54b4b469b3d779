"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document's ids are cut into full
windows and a rest; the rest goes to the open window that it fills best.  Where none has
room, the fullest open window is emitted.  What stays open at a partition's end is merged:
the leftovers of many partitions meet in bounded groups and are packed again, whole pieces
only.  The space of a task is OPEN windows, whatever its input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, durable, small, worker_memo
from .tokens import _byte_of, balanced, load_tokenizer, setup

SIZE = 2048
END_ID = 1
OPEN = 64
#: Partitions whose leftovers meet in one group.
FAN_IN = 8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, sequence long, offset long, full boolean"
_FIELDS = [x.split()[0] for x in PIECES.split(", ")]

#: How a tokenizer's file says that it lower-cases, drops white space and cuts letters, single digits and marks apart.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Letters before this one (Latin ones) have one composed form, and are letters to any version of Unicode.
LATIN_END = "\u0250"


def _core(word: str) -> tuple[str, str]:
    """A word without case and the comma or full stop after it, which such a vocabulary's pre-tokens are apart from letters."""
    body, end = (word[:-1], word[-1]) if word[-1:] in (",", ".") else (word, "")
    core = body.lower()
    if not core.isalpha() or "\u03a3" in body:  # a lower case may end in a mark, which joins those after it; only the capital sigma's depends on what is around it
        return word, ""
    return core, end


@cache
def _latin() -> dict[int, str]:
    """Letters before LATIN_END as byte-level vocabularies write their bytes."""
    shown = {b: c for c, b in _byte_of().items()}
    return {k: "".join(shown[b] for b in chr(k).encode()) for k in range(ord(LATIN_END))}


class Ids:
    """The ids of texts, as little-endian unsigned 32-bit numbers, by the tokenizer file at path."""

    def __init__(self, path: str):
        about = setup(path)
        self.tokenizer = load_tokenizer(path)
        first, *rest = (about["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        pieces = first.get("pattern") == {"Regex": WORD_PATTERN} and [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        self.by_words = about["plain"] and about["normalizer"] == WORD_NORMALIZER and pieces
        self.ends = dict(zip(("", ",", "."), self._encoded(["", ",", "."]), strict=True)) if self.by_words else {}
        self.memo, self.cores = Memo(self._learn), Memo(self._learn_cores)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for batch in balanced(texts):
            for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                yield np.array(x.ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Words that differ in case and the mark after them only are encoded once."""
        cores, ends = zip(*map(_core, words)) if words else ((), ())
        return [ids + self.ends[end] for ids, end in zip(self.cores.values(list(cores)), ends, strict=True)]

    def _learn_cores(self, cores: list[str]) -> list[bytes]:
        """Lower-case Latin letters are one pre-token, so they go straight to the merges; the rest to the library."""
        out, rest, tokenize = [b""] * len(cores), [], self.tokenizer.model.tokenize
        for k, core in enumerate(cores):
            if core.isalpha() and core.islower() and max(core) < LATIN_END:
                out[k] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(core if core.isascii() else core.translate(_latin()))])
            else:
                rest.append(k)
        for k, ids in zip(rest, self._encoded([cores[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def of(self, text: str | None) -> bytes:
        """The ids of a text and END_ID.  Where the vocabulary drops white space, words are encoded apart at spaces and line ends."""
        text = text or ""
        ids = b"".join(self.memo.values(text.replace("\n", " ").split(" "))) if self.by_words else next(self._encoded([text]))
        return ids + END_ID.to_bytes(4, "little")


def encoder(path: str) -> Ids:
    """Kept for a worker's later tasks."""
    return worker_memo(("ids", path), lambda: Ids(path))


class Windows:
    """At most ``most`` open windows of ``size`` tokens (None: any number); ``emitted`` gets the lists of pieces of those that were closed.

    Open windows lie in lists by how full they are; the bits of ``levels`` say which lists hold one.
    """

    def __init__(self, size: int, most: int | None):
        self.size, self.most, self.count, self.levels, self.by_level, self.emitted = size, most, 0, 0, {}, []

    def _take(self, level: int) -> list[tuple]:
        """The pieces of an open window of this level, which is open no more."""
        held = self.by_level[level]
        pieces = held.pop()
        if not held:
            del self.by_level[level]
            self.levels ^= 1 << level
        self.count -= 1
        return pieces

    def place(self, piece: tuple, length: int) -> None:
        """Into the open window that has the least room left after it."""
        fitting = self.levels & ((1 << max(0, self.size - length + 1)) - 1)
        level, pieces = 0, []
        if fitting:
            level = fitting.bit_length() - 1
            pieces = self._take(level)
        elif self.most is not None and self.count >= self.most:
            self.emitted.append(self._take(self.levels.bit_length() - 1))
        pieces.append(piece)
        level += length
        if level == self.size:
            self.emitted.append(pieces)
            return
        self.by_level.setdefault(level, []).append(pieces)
        self.levels |= 1 << level
        self.count += 1

    def left(self) -> list[list[tuple]]:
        """The pieces of the windows that are still open, fullest first."""
        return [w for level in sorted(self.by_level, reverse=True) for w in self.by_level[level]]


def _rows(windows: list[list[tuple]], task: int, first: int, full: bool) -> list[tuple]:
    """Windows of pieces (doc_id, start, length, crc, doc_tokens) as rows."""
    out = []
    for n, pieces in enumerate(windows, first):
        at = 0
        for p in pieces:
            out.append((*p, task, n, at, full))
            at += p[2]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    kinds = [pa.int64()] * (len(_FIELDS) - 1) + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)


def _packed(df: DataFrame, path: str, size: int, most: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        ids_of, task, n = encoder(path).of, TaskContext.get().partitionId(), 0
        windows = Windows(size, most)
        for batch in small(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text)
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    windows.place((doc_id, start, len(part) // 4, zlib.crc32(part), total), len(part) // 4)
            yield _batch(_rows(windows.emitted, task, n, True))
            n += len(windows.emitted)
            windows.emitted = []
        yield _batch(_rows(windows.left(), task, n, False))

    return df.mapInArrow(run, PIECES)


def _merged(size: int):
    """The pieces of one group's leftovers, packed anew, long ones first."""

    def f(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "task", "sequence", "offset"], ascending=[False, True, True, True])
        windows = Windows(size, None)
        for p in zip(*(pdf[c].tolist() for c in _FIELDS[:5])):
            windows.place(p, p[2])
        rows = _rows(windows.emitted + windows.left(), -1 - int(key[0]), 0, True)
        return pd.DataFrame(rows, columns=_FIELDS)

    return f


def pack(docs: DataFrame, path: str, size: int = SIZE, open_windows: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each row of docs (doc_id, text, ...).

    path is a tokenizer file; where it drops white space as word_bpe_49k.json does, distinct
    words are encoded once, else texts are encoded whole.  A null or empty text has the end id
    only.  Each id lies in one piece; a sequence's pieces lie gapless from offset 0 and hold
    at most ``size`` ids.  Rows that repeat, or have no doc_id, are each packed (a repeated
    doc_id repeats its pieces); other columns are ignored; an empty table gives no rows.

    A group of the last step holds the leftovers of ``fan_in`` partitions, ``fan_in *
    open_windows`` windows; as a piece has an id at least, these are at most
    ``fan_in * open_windows * size`` pieces (a million rows), at any size of the input.
    """
    pieces = durable(_packed(documents(docs), path, size, open_windows))
    left = pieces.where("NOT full").groupBy((F.floor(F.col("task") / fan_in)).alias("grp")).applyInPandas(_merged(size), PIECES)
    every = pieces.where("full").unionByName(left)
    return every.select(*_FIELDS[:5], (F.shiftleft("task", 40) + F.col("sequence")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """The packed sequences of docs, as ``pack`` has them (no rows for an empty table), with their pieces: sequence_id, used, pieces (array of structs in order of offset)."""
    fields = ("offset", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return pack(docs, path, size).groupBy("sequence_id").agg(F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct(*fields))).alias("pieces"))
