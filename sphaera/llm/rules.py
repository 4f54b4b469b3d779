"""Quality rules by compression bands.

zstandard ratios (original bytes over compressed bytes) of the whole document and of fixed
chunks.  Text that compresses too well is repetitive, text that hardly compresses is noise;
where the bounds lie depends on the length, as short texts compress less.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_map, documents, filter_texts

LEVEL = 3
CHUNK = 4096
#: Up to so many bytes | least | most ratio of a whole document.  A document of no bytes has the ratio 1.
#: The range of the labelled clean texts that aren't held out (sf0.1; up to 256 bytes of the ends of
#: texts), with a margin of 0.05 to 0.08,
#: 0.1 from 257 to 512 bytes, where texts are few and differ most.  Beyond 32 KB there are none: the growth is carried on.
BANDS = (
    (16, 0.0, 0.6),
    (32, 0.5, 0.8),
    (64, 0.6, 0.95),
    (128, 0.8, 1.4),
    (256, 1.12, 1.6),
    (384, 1.28, 1.77),
    (512, 1.33, 1.94),
    (768, 1.41, 1.95),
    (1024, 1.55, 2.03),
    (1536, 1.67, 2.1),
    (2048, 1.79, 2.2),
    (3072, 1.86, 2.21),
    (4096, 1.97, 2.26),
    (6144, 2.06, 2.34),
    (8192, 2.12, 2.4),
    (12288, 2.16, 2.43),
    (16384, 2.21, 2.46),
    (32768, 2.26, 2.51),
    (65536, 2.27, 2.6),
    (float("inf"), 2.3, 2.8),
)
#: A document's end of fewer bytes is measured with the full chunk before it, a longer one as a chunk of its own, by BANDS.
SHORT_END = 256
#: Least and most ratio of a chunk of CHUNK bytes or more (clean texts: 2.07 to 2.25), and the share of a document's chunks
#: that may lie outside (of 3,243 clean labelled texts none has one).
CHUNK_BAND, CHUNKS_OUTSIDE = (2.0, 2.31), 0.2
MIN_WORDS = 50
REPEATED_PERCENT = 50

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = b"#*$%&|<>"
#: What str.split takes for white space besides the ASCII kinds.
_ODD_SPACE = re.compile("[\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000]")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, chunks long, chunks_outside long, base_failed boolean, kept boolean"
_FIELDS = [tuple(x.split()) for x in SCHEMA.split(", ")]
_KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def words_of(text: str) -> list[str]:
    """Maximal runs without ASCII white space."""
    return _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split()


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            seen.add(line)
    return n


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    grams = list(zip(*(words[k:] for k in range(width))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    n = end = 0
    for k, gram in enumerate(grams):
        if counts[gram] > 1:
            n += k + width - max(end, k)
            end = k + width
    return n


def chunk_ends(n_bytes: int, chunk: int = CHUNK) -> list[int]:
    """Where the chunks of so many bytes end; together they are the whole."""
    ends = list(range(chunk, n_bytes + 1, chunk))
    if not ends:
        return [n_bytes] if n_bytes else []
    return [*ends, n_bytes] if n_bytes - ends[-1] >= SHORT_END else [*ends[:-1], n_bytes]


def ratios(data: bytes, compressor, chunk: int = CHUNK) -> tuple[float, list[tuple[int, float]]]:
    """The ratio of the whole (1 for no bytes), and length and ratio of each chunk."""
    whole = len(data) / len(compressor.compress(data)) if data else 1.0
    ends = chunk_ends(len(data), chunk)
    if len(ends) == 1:
        return whole, [(len(data), whole)]
    return whole, [(b - a, (b - a) / len(compressor.compress(data[a:b]))) for a, b in zip([0, *ends], ends)]


def in_band(n_bytes: int, ratio: float) -> bool:
    return next(least <= ratio <= most for end, least, most in BANDS if n_bytes <= end)


def chunk_in_band(n_bytes: int, ratio: float, chunk: int = CHUNK) -> bool:
    return CHUNK_BAND[0] <= ratio <= CHUNK_BAND[1] if n_bytes >= chunk else in_band(n_bytes, ratio)


def measure(text: str | None, compressor, chunk: int = CHUNK) -> tuple:
    """The counts, ratios and verdicts of one text, in the order of SCHEMA without doc_id."""
    text = text or ""
    data, words = text.encode("utf-8", "surrogatepass"), words_of(text)
    whole, parts = ratios(data, compressor, chunk)
    outside = sum(not chunk_in_band(n, r, chunk) for n, r in parts)
    n, repeated = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > REPEATED_PERCENT * n
    kept = not failed and in_band(len(data), whole) and outside <= CHUNKS_OUTSIDE * len(parts)
    return n, sum(map(len, words)), len(data) - len(data.translate(None, _SYMBOLS)), duplicate_lines(text), repeated, len(data), whole, len(parts), outside, failed, kept


def measures(docs: DataFrame, level: int = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, counts, ratios and verdicts of each row of docs (doc_id, text, ...).

    A null text counts as empty; an empty one has no words, no chunks, the ratio 1 and fails
    the base rules.  Rows that repeat, or have no doc_id, are each returned; other columns are
    ignored; an empty table gives no rows.
    """

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        rows = [(doc_id, *measure(text, compressor, chunk)) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    return arrow_map(documents(docs), f, SCHEMA)


def keep_by_rules(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """The rows of docs that the rules keep, with their columns; each row is judged by its own text.

    Null and empty texts fail the base rules and go.  Rows that repeat all stay or go, doc_id
    and other columns don't matter, an empty table gives no rows.
    """

    def keep():
        compressor = zstandard.ZstdCompressor(level=level, write_checksum=False)
        return lambda texts: [measure(t, compressor)[-1] for t in texts]

    return filter_texts(docs, keep)
