"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a worker's memo, both generations together.
MEMO_BYTES = 128 << 20
#: What a dictionary's entry takes beside its key and value.
ENTRY_BYTES = 100
#: Rows that a worker takes at once.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only on one machine (a master ``local``) a temporary folder takes its place where none is set.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder, their lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, memo: bool = False) -> DataFrame:
    """f over every Arrow batch of df, without a shuffle; memo: f keeps a worker_memo."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not memo:
            drop_memos()
        for batch in small(batches):
            yield f(batch)

    return df.mapInArrow(run, schema)


class Memo:
    """word -> value (a number or bytes), learnt by ``learn(list of words)`` in one batch.

    Two generations of up to half of ``most`` bytes: when the young one is full it becomes the
    old one, whose words come back as they are met, so frequent words are learnt once.  What
    one call needs is kept whatever it takes, until the next.
    """

    def __init__(self, learn: Callable[[list], Iterable], most: int = MEMO_BYTES):
        self.learn, self.most, self.known, self.old, self.size = learn, most, {}, {}, 0

    def _keep(self, word, value) -> None:
        self.known[word] = value
        self.size += getsizeof(word) + getsizeof(value) + ENTRY_BYTES

    def know(self, words: Iterable) -> None:
        missing = set(words).difference(self.known)
        if not missing:
            return
        if self.size > self.most // 2:
            self.old, self.known, self.size = self.known if self.size <= self.most else {}, {}, 0
            missing = set(words)
        new = []
        for w in missing:
            value = self.old.get(w)
            if value is None:
                new.append(w)
            else:
                self._keep(w, value)
        for w, value in zip(new, self.learn(new), strict=True):
            self._keep(w, value)

    def values(self, words: list) -> Iterator:
        """The values of the words, in their order."""
        self.know(words)
        return map(self.known.__getitem__, words)


_kept: dict = {}


def worker_memo(key: tuple, make: Callable):
    """A memo, or what holds one, that lasts beyond a task.  A worker keeps one at a time: another operator's tasks drop it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def drop_memos() -> None:
    _kept.clear()


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text as the operators take them, whatever other columns stand beside them."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def filter_texts(df: DataFrame, keep: Callable[[], Callable[[list], Iterable[bool]]]) -> DataFrame:
    """The rows of df whose text is kept, with all their columns; a narrow pass, each row judged by its own text.

    keep() is called once a task and gives a function from texts (None among them) to verdicts.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        verdicts = keep()
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(verdicts(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)
