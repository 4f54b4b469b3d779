"""WARC records and a Merkle fixity audit of their replicas.

Records lie in files (shards) of SHARD_RECORDS consecutive page ids, in the order of the
ids.  A leaf of a shard's tree is a record: the SHA-256 of its bytes and its range of offsets
in the file.  FANOUT nodes next to one another make a parent, which covers their ranges and
hashes each child's place, offset, length and digest; LEVELS levels above the leaves is the
shard's root.  So roots agree only if all records agree and lie at the same offsets.  An audit
compares roots, then the children of nodes that differ, level by level, and so reads the
leaves of damaged branches only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

SHARD_RECORDS, FANOUT, LEVELS = 1000, 16, 3
#: Bytes of a file that make a row of ``files``; a record lies in one row whole, whatever its size.
PART_BYTES = 16 << 20
#: The date of records whose table has no column ``date``.
DATE = "1970-01-01T00:00:00Z"

#: What stands between page id, url, date, length and body of a record.
_HEAD = ("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", ">\r\nWARC-Target-URI: ", "\r\nWARC-Date: ", "\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", "\r\n\r\n", "\r\n\r\n")
_URN = "urn:page:"
#: The end of a record's head, the first of either kind: sought apart, the one that a file lacks is sought to the file's end for each record.
_GAP = re.compile(rb"\r\n\r\n|\n\n")


def record(page_id: Column, url: Column, html: Column, date: Column | None = None) -> Column:
    """A record's text: head, body, two line ends.  Nulls count as empty, a null date as DATE."""
    html = F.coalesce(html, F.lit(""))
    when = F.lit(DATE) if date is None else F.coalesce(date.cast("string"), F.lit(DATE))
    parts = (page_id.cast("string"), F.coalesce(url, F.lit("")), when, F.octet_length(html).cast("string"), html)
    return F.concat(*(x for pair in zip((F.lit(h) for h in _HEAD), parts) for x in pair), F.lit(_HEAD[-1]))


def _records(pages: DataFrame) -> DataFrame:
    """page_id, length, digest, r (the record's text) of each row that has a page_id."""
    r = record(F.col("page_id"), F.col("url"), F.col("html"), F.col("date") if "date" in pages.columns else None)
    rows = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("page_id"), r.alias("r"))
    return rows.select("page_id", F.octet_length("r").cast("long").alias("length"), F.sha2(F.col("r").cast("binary"), 256).alias("digest"), "r")


def _members(data: bytes) -> bytes:
    """The bytes of gzip members one after another, as compressed files have one for each record; a cut one as far as it goes."""
    out = []
    while data[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)
        try:
            out.append(unzip.decompress(data))
        except zlib.error:
            break
        data = unzip.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head with lower-case names, body) of the records of a file, gzip or not; one that is cut short, or has no length, ends them."""
    data = _members(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if data[at : at + 5] != b"WARC/":
            return
        gap = _GAP.search(data, at)
        if not gap:
            return
        head, last = {}, None
        for line in data[at : gap.start()].decode("utf-8", "replace").splitlines()[1:]:
            if line[:1] in (" ", "\t") and last:  # a folded line
                head[last] += " " + line.strip()
            elif ":" in line:
                last, value = line.split(":", 1)
                last = last.strip().lower()
                head[last] = value.strip()
        size = head.get("content-length", "")
        if not size.isdecimal() or len(body := data[gap.end() : gap.end() + int(size)]) < int(size):
            return
        yield head, body
        at = gap.end() + int(size)


def page_of(head: dict[str, str], body: bytes) -> tuple[str, int | None, str, str | None, str | None]:
    """record_id, page_id (null where the id is another tool's), url, date and html of a record; a response's own head is left out."""
    ident = head.get("warc-record-id", "").strip("<>")
    number = ident.removeprefix(_URN) if ident.startswith(_URN) else ""
    page_id = int(number) if number.removeprefix("-").isdecimal() and number.isascii() and len(number) < 20 else None
    if head.get("warc-type") == "response" and body[:5] == b"HTTP/":
        body = body.partition(b"\r\n\r\n")[2]
    return ident, page_id, head.get("warc-target-uri", "").strip("<>"), head.get("warc-date"), body.decode("utf-8", "replace")


def files(pages: DataFrame, shard_records: int = SHARD_RECORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """shard, part, content (binary) of pages (page_id, url, html): the files, in parts of whole records.

    The parts of a shard, one after another, are its file; each begins with a record, and
    holds those that start within its ``part_bytes`` bytes.  Nulls count as empty; rows without
    page_id are no records; rows that repeat are each written; other columns are ignored; an
    empty table gives no rows.
    """
    rows = _records(pages).withColumn("shard", F.floor(F.col("page_id") / shard_records))
    w = W.partitionBy("shard").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("start", F.sum("length").over(w) - F.col("length")).withColumn("part", F.floor(F.col("start") / part_bytes))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", "r"))), lambda x: x["r"])
    return rows.groupBy("shard", "part").agg(F.encode(F.array_join(ordered, ""), "UTF-8").alias("content"))


def read_files(content: DataFrame) -> DataFrame:
    """record_id, page_id, url, date, html of the records of files with a column content, such as Spark's binaryFile source gives.

    Files may be compressed record by record; heads may be of any tool.  A null or empty
    content has no records; an empty table gives no rows.
    """
    names = ["record_id", "page_id", "url", "date", "html"]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):  # one file's bytes at a time
                rows = [page_of(*r) for r in parse_records(data.as_py() or b"")]
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "page_id" else pa.string()) for n, c in zip(names, columns, strict=True)], names)

    return content.select("content").mapInArrow(run, "record_id string, page_id long, url string, date string, html string")


def leaves(pages: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """page_id, shard, idx (place in the shard), start, length, digest, copies of each record; only these narrow rows are shuffled.

    idx is the id's place among the shard's possible ids, so that a missing record leaves a
    gap and shifts no other's place.  Rows of one page_id are one record, that with the smallest
    digest; copies says how many they are, and its range is so many times the length.
    """
    rows = _records(pages).groupBy("page_id").agg(F.min(F.struct("digest", "length")).alias("x"), F.count("*").alias("copies"))
    shard = F.floor(F.col("page_id") / shard_records)
    rows = rows.select("page_id", shard.alias("shard"), (F.col("page_id") - shard * shard_records).alias("idx"), (F.col("x.length") * F.col("copies")).alias("length"), "x.digest", "copies")
    w = W.partitionBy("shard").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)  # a bounded group
    return rows.withColumn("start", F.sum("length").over(w) - F.col("length"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """shard, idx, start, length, digest of the level above rows of these columns.

    A digest is of ``idx:start:length:digest`` of the children in their order, comma-joined.
    """
    up = nodes.groupBy("shard", F.floor(F.col("idx") / fanout).alias("up")).agg(
        F.min("start").alias("start"),
        F.sum("length").alias("length"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "start", "length", "digest"))), lambda x: F.concat_ws(":", x["idx"], x["start"], x["length"], x["digest"])), ",").alias("text"),
    )
    return up.select("shard", F.col("up").alias("idx"), "start", "length", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def tree(pages: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The levels of the shards' trees, leaves first, roots last; each level is written to the shared folder once."""
    out = [durable(leaves(pages))]
    for _ in range(levels):
        out.append(durable(parents(out[-1])))
    return out


_NODE = ("start", "length", "digest")


def audit(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """shard, idx, and start, length, digest in either tree (_a, _b; null where it has none) of the leaves that differ.

    Starts at the roots and takes from each level below only the children of nodes that differ.
    """
    differing = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if differing is not None:
            under = differing.select("shard", F.col("idx").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("idx") / fanout)).join(under, ["shard", "up"], "left_semi").drop("up") for t in (x, y))
        sides = (t.select("shard", "idx", *(F.col(c).alias(f"{c}_{side}") for c in _NODE)) for t, side in ((x, "a"), (y, "b")))
        same = [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in _NODE]
        differing = next(sides).join(next(sides), ["shard", "idx"], "full").where(~(same[0] & same[1] & same[2]))
    return differing


def fixity(pages: DataFrame, replica: DataFrame, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """page_id, shard, warc_offset, length, sha256, shard_root, status, replica_offset, intact of each record of pages or its replica.

    status is intact, moved (the same bytes at another offset), corrupt (other bytes),
    missing (not in the replica) or extra (in the replica only; offset, length and sha256 are
    then the replica's, and shard_root is null if pages have no such shard).  Rows of one
    page_id are one record, see ``leaves``.  A null url or html counts as empty; rows without
    page_id are no records.  Other columns are ignored; two empty tables give no rows.
    """
    a, b = tree(pages), tree(replica)
    differing = audit(a, b)
    roots = a[-1].select("shard", F.col("digest").alias("shard_root"))
    bad = differing.where("digest_a IS NOT NULL").select("shard", "idx", F.col("start_b"), F.when(F.col("digest_b").isNull(), "missing").when((F.col("digest_a") == F.col("digest_b")) & (F.col("length_a") == F.col("length_b")), "moved").otherwise("corrupt").alias("status"))
    ours = a[0].join(bad, ["shard", "idx"], "left").select("page_id", "shard", "start", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"), F.when(F.col("status").isNull(), F.col("start")).otherwise(F.col("start_b")).alias("at"))
    extra = differing.where("digest_a IS NULL").select((F.col("shard") * shard_records + F.col("idx")).alias("page_id"), "shard", F.col("start_b").alias("start"), F.col("length_b").alias("length"), F.col("digest_b").alias("digest"), F.lit("extra").alias("status"), F.col("start_b").alias("at"))
    out = ours.unionByName(extra).join(roots, "shard", "left")
    return out.select("page_id", "shard", F.col("start").alias("warc_offset"), "length", F.col("digest").alias("sha256"), "shard_root", "status", F.col("at").alias("replica_offset"), (F.col("status") == "intact").alias("intact"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica to audit, by page_id: the last letter changed where it is 7 modulo 97, a letter more where it is 13 modulo 2003
    (which moves what follows in the file), lost where it is 11 modulo 4001, and a copy under the id -1 - page_id where it is 5 modulo 389.
    """
    html, p = F.coalesce("html", F.lit("")), F.col("page_id")
    changed = F.when(p % 97 == 7, F.concat(F.expr("substring(coalesce(html, ''), 1, length(coalesce(html, '')) - 1)"), F.lit("~"))).when(p % 2003 == 13, F.concat(html, F.lit("+"))).otherwise(html)
    kept = pages.where("page_id % 4001 <> 11").select("page_id", "url", changed.alias("html"))
    return kept.unionByName(pages.where("page_id % 389 = 5").select((-1 - p).alias("page_id"), "url", html.alias("html")))
