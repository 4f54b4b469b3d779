"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries: a space after a character that is no white space.  No
pre-token, contraction or special token of the byte-level vocabularies spans one, so a text
has as many tokens as its parts.  What is still long after that, such as prose without
spaces, is cut between two characters whose adjacent bytes stand side by side in no token
(and not before an apostrophe, which may begin a contraction): no merge crosses such a place.  Long texts thereby never go to the encoder whole (a run of
one letter does), and a worker encodes each distinct part once, in batches balanced by bytes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, documents, worker_memo

LIMIT = 512
BATCH_BYTES = 1 << 18
#: Characters of a part from which on it is cut within words.
LONG = 512

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S)(?= )")
_WHITE = np.array([k for k in range(0x3001) if chr(k).isspace()] + [0x180E, 0x200B, 0xFEFF], np.uint32)
#: How a byte-level tokenizer's file says that it cuts texts as described above.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def parts(text: str) -> list[str]:
    """The parts of a text between its safe spaces, in order."""
    if _SPACE_AFTER_SPACE.search(text) or text[:1] == " ":
        return _SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive batches of about ``most`` bytes each."""
    batch, size = [], 0
    for text in texts:
        batch.append(text)
        size += n_bytes(text) + 16
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def load_tokenizer(path: str):
    """A ``tokenizers`` tokenizer without truncation and padding; Spark's tasks are the only threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def setup(path: str) -> dict:
    """The parts of a tokenizer's file but its vocabulary and merges; plain: a BPE without dropout, unknown token or prefixes."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    spaced = any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in data.get("added_tokens", ()))
    return {"normalizer": data.get("normalizer"), "pre_tokenizer": data.get("pre_tokenizer"), "suffix": model.get("end_of_word_suffix") or "", "plain": plain and not spaced, "special": [t["content"] for t in data.get("added_tokens", ())]}


@cache
def _byte_of() -> dict[str, int]:
    """The letter that byte-level vocabularies write for a byte -> the byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def adjacent(tokenizer) -> np.ndarray:
    """Whether two bytes (256 * first + second) stand side by side in any token."""
    out, byte_of = np.zeros(1 << 16, bool), _byte_of()
    for token in tokenizer.get_vocab():
        data = [byte_of[c] for c in token if c in byte_of]
        out[[256 * a + b for a, b in zip(data, data[1:])]] = True
    return out


def cut(part: str, together: np.ndarray, most: int = LONG) -> list[str]:
    """A part in pieces of ``most`` characters and what follows up to the next place that no token spans."""
    code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
    left, right = code[:-1], code[1:]
    ends = np.where(left < 0x80, left, 0x80 | left & 0x3F)
    begins = np.where(right < 0x80, right, np.where(right < 0x800, 0xC0 | right >> 6, np.where(right < 0x10000, 0xE0 | right >> 12, 0xF0 | right >> 18)))
    white = np.isin(code, _WHITE)
    places = np.flatnonzero(~together[256 * ends + begins] & ~white[:-1] & ~white[1:] & (right != ord("'"))) + 1
    out, at = [], 0
    while (k := np.searchsorted(places, at + most)) < len(places):
        out.append(part[at : places[k]])
        at = int(places[k])
    return [*out, part[at:]]


def _split_core(word: str) -> tuple[str, int]:
    """A word without the comma or full stop after it, and how many of these there were: a pre-token and token of its own."""
    return (word[:-1], 1) if word[-1:] in (",", ".") else (word, 0)


class Lengths:
    """How many tokens a text has by the tokenizer file at path."""

    def __init__(self, path: str):
        about = setup(path)
        self.tokenizer = load_tokenizer(path)
        pre = about["pre_tokenizer"] or {}
        self.by_parts = about["plain"] and about["normalizer"] is None and not about["suffix"] and {k: pre.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL
        self.special = about["special"]
        self.together = adjacent(self.tokenizer) if self.by_parts else None
        self.memo = Memo(self._learn)

    def _learn(self, words: list[str]) -> list[int]:
        """ASCII letters after a space or none are one pre-token, so they go straight to the merges; the rest to the library."""
        out, rest, tokenize = [0] * len(words), [], self.tokenizer.model.tokenize
        for k, word in enumerate(words):
            core, more = _split_core(word)
            letters = core[1:] if core[:1] == " " else core
            if letters.isascii() and letters.isalpha():
                out[k] = len(tokenize("Ġ" + letters if core[:1] == " " else letters)) + more
            else:
                rest.append(k)
        lengths = (n for batch in balanced([words[k] for k in rest]) for n in self._encoded(batch))
        for k, n in zip(rest, lengths, strict=True):
            out[k] = n
        return out

    def _encoded(self, batch: list[str]) -> Iterator[int]:
        return map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))

    def parts(self, text: str) -> list[str]:
        """A text's parts by a byte-level file; their tokens are those of the text."""
        found = parts(text)
        if max(map(len, found)) <= LONG:
            return found
        whole = lambda p: len(p) <= LONG or any(s in p for s in self.special)
        return [x for p in found for x in ([p] if whole(p) else cut(p, self.together))]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(self.memo.values(self.parts(text)) if self.by_parts else self._encoded([text]))


def counter(path: str) -> Lengths:
    """The lengths of parts, kept for a worker's later tasks."""
    return worker_memo(("lengths", path), lambda: Lengths(path))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text, ...), by the tokenizer file at path.

    A null or empty text has no bytes and no tokens.  Special strings in a text count as
    the library's default has them.  Texts are split as above for byte-level files only; by
    another kind of file they are encoded whole.  Rows that repeat, or have no doc_id, are
    each returned; other columns are ignored; an empty table gives no rows.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: Callable[[str | None], int] = counter(path).count
        counts = [count(text) for text in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = documents(docs).select("doc_id", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), "text")
    return arrow_map(docs, f, "doc_id long, n_bytes long, n_tokens long", memo=True).withColumn("over_limit", F.col("n_tokens") > limit)
