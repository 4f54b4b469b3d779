"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document is the set of its distinct word shingles.  Two documents are linked when
``100 * |A & B| >= percent * |A | B|``; copies of one another are in one component.

How the links are found:

1. Documents with equal sets become one class, represented by its smallest id (a hash
   aggregate with map-side combine, so thousands of copies cost one row each map task).
2. Each class gets a signature of PLACES b-bit minima.  Its first CHUNKS x WIDTH places are
   split into CHUNKS chunks.  Two that differ there in fewer than ``CHUNKS * (ERRORS + 1)``
   places have, by the pigeonhole principle, a chunk with at most ERRORS differing places;
   the allowed errors are enumerated by leaving out each choice of ERRORS places, so each
   such pair shares a key.  At a similarity of exactly 0.75 a pair without a common key has
   a probability of about 4e-8 (0.367 ** 17); every key's whole bucket is used, whatever its size.
3. The members of the buckets with the same smallest member form a group: (group, member)
   rows are a few per near copy, and two documents that share a key share a group.  A group
   is dealt out in blocks of about BLOCK members.  Each member's sketch is compared with those of
   a few leaders of its group (linear in the group) and its set with that of the smallest
   near one, so that a set is sent once; the links found are contracted, members that are
   near another leader are compared with that too, and the groups that
   still hold several components compare their members across components.  Within a component
   no further link can change the result, so only members outside a group's largest
   component are compared with the others, block by block: by sketches, then, if any is near,
   by full sets.  Where a large group has over MINOR such members, as
   millions of unlike documents with one passage would, its members are joined on the rarest
   shingles of each set instead: two sets of the wanted similarity share one among the
   ``n - ceil(n * percent / 100) + 1`` shingles that fewest of these sets have, so a common
   passage joins nothing.  Pairs whose sketches differ in more than SKETCH_APART bits are
   beyond the signature distance (at a similarity of 0.75 that is over six deviations off);
   all others are decided on their full shingle sets.  No group is capped.
4. Components come from alternating star contraction, its state in the checkpoint folder.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, documents, drop_memos, durable, small

WORDS = 5
PERCENT = 75
CHUNKS = 17
WIDTH = 5
#: Places that may differ within the chunk that the pigeonhole principle promises.
ERRORS = 1
#: Two bits of each place.  Of these 256 bits, pairs at a similarity of 0.75
#: differ in 32 on average (deviation 6.4), so that 74 is over six deviations off.
SKETCHES = ("s0", "s1", "s2", "s3")
SKETCH_APART = 74
#: Members of a group, besides its smallest, with which all its members are compared first.
LEADERS = 4
#: Members of a group, or of those that share a shingle, that meet in one task.
BLOCK = 512
#: Members outside the largest component of a group with which all of its members are compared by sketch.
MINOR = 16_384
PLACES = 128
#: Up to so many ids (8 bytes each) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_U = np.uint64


@cache
def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _word_memo() -> Memo:
    return Memo(lambda words: map(xxhash.xxh64_intdigest, words))


def shingles(text: str | None, memo: Memo, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; its lower-cased words are cut at ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(memo.values(found), np.uint64, len(found))
    n = min(words, len(found))
    m = _constants(words, 11)
    out = np.zeros(len(h) - n + 1, np.uint64) + _U(n)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * m[k]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """PLACES minima of 16 bits each."""
    a, b = _constants(PLACES, 12)[:, None], _constants(PLACES, 13)[:, None]
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        x = hashes[None, k : k + 512] * a
        x += b
        np.minimum(low, x.min(axis=1), out=low)
    return (_mix(low) >> _U(48)).astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """Rows of signatures -> rows of bucket keys: each chunk without each choice of ERRORS (one) places."""
    n = CHUNKS * WIDTH
    v = signatures[:, :n].reshape(-1, CHUNKS, WIDTH).astype(np.uint64) + _U(1)
    part = v * _constants(n, 14).reshape(CHUNKS, WIDTH)
    out = part.sum(axis=2, dtype=np.uint64)[:, :, None] - part + _constants(n, 15).reshape(CHUNKS, WIDTH)
    return _mix(out).reshape(len(v), n).view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Two bits of each place, in four longs."""
    bits = np.concatenate([(signatures >> k & 1).astype(np.uint8) for k in (0, 1)], axis=1)
    return np.packbits(bits, axis=1).view(np.int64).reshape(-1, len(SKETCHES))


def _identity(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist())


def _sets(df: DataFrame, words: int) -> DataFrame:
    """doc_id -> its set's identity, size, signature and sketch; a row for each row."""

    def run(batches):
        drop_memos()
        memo = _word_memo()
        for batch in small(batches):
            sigs, ids, n = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, memo, words)
                n.append(len(s))
                ids.append(_identity(s))
                sigs.append(signature(s))
            sigs = np.array(sigs, np.uint16).reshape(-1, PLACES)
            bits, key = sketches(sigs), np.array(ids, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(np.array(n, np.int64)), pa.array([x.tobytes() for x in sigs], pa.binary()), *(pa.array(x.copy()) for x in bits.T)], ["doc_id", "set0", "set1", "n_shingles", "sig", *SKETCHES])

    return df.mapInArrow(run, "doc_id long, set0 long, set1 long, n_shingles long, sig binary, " + ", ".join(f"{x} long" for x in SKETCHES))


def _keys(classes: DataFrame) -> DataFrame:
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, PLACES)
        k = keys(sigs)
        return pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k.shape[1]))], ["key", "rep"])

    return arrow_map(classes.select("rep", "sig"), f, "key long, rep long")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """The hashes of the set of each row of docs, with its doc_id and its set's identity."""

    def run(batches):
        drop_memos()
        memo = _word_memo()
        for batch in small(batches):
            every = [shingles(t, memo, words) for t in batch.column(1).to_pylist()]
            key = np.array([_identity(s) for s in every], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([s.view(np.int64) for s in every], pa.list_(pa.int64()))], ["doc_id", "set0", "set1", "hashes"])

    return docs.mapInArrow(run, "doc_id long, set0 long, set1 long, hashes array<long>")


def _near(percent: int) -> F.Column:
    """What a row's size and sketch and another's, whose columns start with o_, allow; the cheap tests."""
    apart = sum(F.bit_count(F.col(s).bitwiseXOR(F.col(f"o_{s}"))) for s in SKETCHES)
    return (100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")) & (apart <= SKETCH_APART)


def _linked(percent: int) -> F.Column:
    """A row and another row, whose columns start with o_, are linked; the cheap tests come first."""
    common = F.size(F.array_intersect("hashes", "o_hashes"))
    return _near(percent) & ((100 + percent) * common >= percent * (F.col("n") + F.col("o_n")))


def _other(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *(F.col(c).alias(f"o_{c}") for c in rows.columns if c not in keys))


def bounded(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """rows, to be broadcast if they are ``most`` at most; else they are joined by a shuffle.  Written once, so that they can be counted."""
    rows = durable(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def _dealt(rows: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """rows (key, rep, ...) with the number of blocks of their key, if its size is over one block, and each row's block."""
    large = bounded(sizes.where(F.col("size") > block).select(key, "size"))
    blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    return rows.join(large, key, "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).drop("size")


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """key, size, giant (the component that most rows have), minor (the rows of others) of the keys whose rows are of several components."""
    counts = rows.groupBy(key, "component").agg(F.count("*").alias("k"))
    out = counts.groupBy(key).agg(F.sum("k").alias("size"), F.max_by("component", F.struct("k", "component")).alias("giant"), (F.sum("k") - F.max("k")).alias("minor"), F.count("*").alias("parts"))
    return out.where("parts > 1").drop("parts")


def _dealt_out(rows: DataFrame) -> DataFrame:
    """rows (..., blocks, block), each once for each block of its key."""
    return rows.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _minor(rows: DataFrame) -> DataFrame:
    """The rows that aren't of their key's giant component; they alone are sent to every block."""
    return _dealt_out(rows.where("component != giant")).drop("giant")


def _met(rows: DataFrame, others: DataFrame, key: str, test: F.Column, how: str = "inner") -> DataFrame:
    """The pairs of a row (key, block, rep, component, ...) and one of others with its key and block that are of different components and pass the test.

    how ``left_semi``: the rows that are in such a pair, each once, so that what is found stays in proportion to the rows.
    """
    other = _other(others, key, "block").withColumnsRenamed({key: "o_key", "block": "o_block"})
    same = (F.col(key) == F.col("o_key")) & (F.col("block") == F.col("o_block"))
    return rows.join(other, same & (F.col("component") != F.col("o_component")) & test, how)


def _involved(rows: DataFrame, others: DataFrame, hashes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows and the others (first, block, rep, component, ...) that are near one another by sketch, with their sets."""
    near = _near(percent)
    found = (_met(rows, others, "first", near, "left_semi"), _met(others, rows, "first", near, "left_semi"))
    return tuple(hashes.join(bounded(x), "rep") for x in found)


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, of the pairs of rep and o_rep; each once."""
    return pairs.select(F.least("rep", "o_rep").alias("a"), F.greatest("rep", "o_rep").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (rep, to) that are linked by their full sets; a rep has one pair, a ``to`` any number, which are dealt out in blocks.

    Each rep's set is sent once, that of a ``to`` once a block.
    """
    dealt = durable(_dealt(pairs, "to", pairs.groupBy("to").agg(F.count("*").alias("size")), block))
    ends = dealt.select("to", "blocks").distinct().select(F.col("to").alias("rep"), "to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = sets.join(bounded(dealt.drop("blocks")), "rep").join(_other(sets.join(bounded(ends), "rep"), "to", "block"), ["to", "block"])
    return met.where(_linked(percent)).select("rep", "to")


def _by_rare_shingles(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b) of the near pairs of rows (rep, component, n, sketches, hashes) that are of different components and share a rare shingle.

    Every pair that is linked shares one of the shingles that lie first in either set, by how many of the rows have them.
    """
    light = [c for c in rows.columns if c != "hashes"]
    single = rows.select("rep", F.explode("hashes").alias("h"))
    frequent = single.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle of one row alone can't be shared, but is first in the order, so it counts among the first ones
    held = single.join(frequent, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("hs"))
    chosen = held.join(rows.select(*light), "rep").withColumn("first", first.cast("int")).where("first > 0").select(*light, F.explode(F.expr("slice(hs, 1, least(size(hs), first))")).alias("x"))
    chosen = durable(chosen.select(*light, F.col("x.h").alias("h")))
    parts = durable(_parts(chosen, "h"))
    rows = _dealt(chosen.join(parts.select("h", "giant"), "h"), "h", parts, block)
    return _ordered(_met(rows, _minor(rows), "h", _near(percent)))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component): every id of the edges with the smallest id that it reaches.

    Alternates large-star and small-star steps (a neighbour's smallest neighbour takes
    over), each a map-side combined minimum and a join on the vertex.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        facts = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if facts == state or not facts[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = facts
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = durable(small.where("u != v").distinct())


def _labelled(docs: DataFrame, percent: int, words: int, block: int, minor: int) -> tuple[DataFrame, bool]:
    """doc_id, set0, set1, n_shingles, rid, component for each row of docs, and whether the doc_ids tell the rows apart.

    rid is the row's doc_id if they do, else a number of its own; component is the smallest rid reachable.
    """
    sets = durable(_sets(docs, words))
    rows = sets.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    unique = rows.n == rows.ids
    sets = sets.withColumn("rid", F.col("doc_id") if unique else F.monotonically_increasing_id())
    classes = durable(sets.where("n_shingles > 0").groupBy("set0", "set1").agg(F.min("rid").alias("rep"), *(F.first(x).alias(y) for x, y in (("n_shingles", "n"), ("sig", "sig"), *((s, s) for s in SKETCHES)))))
    lowest = _keys(classes).groupBy("key").agg(F.min("rep").alias("first"))
    pairs = _keys(classes).join(lowest, "key").where("first != rep")
    groups = durable(pairs.select("first", F.explode(F.array("rep", "first")).alias("rep")).distinct())

    wanted = groups.select(F.col("rep").alias("rid")).distinct()
    wanted = wanted.select(F.col("rid").alias("id")) if unique else sets.select("rid", F.col("doc_id").alias("id")).join(wanted, "rid").select("id").distinct()
    hashes = _full_sets(docs.join(bounded(wanted), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), words)
    if unique:  # a class's rep is the doc_id of one of its rows
        hashes = hashes.select(F.col("doc_id").alias("rep"), "hashes")
    else:
        hashes = hashes.drop("doc_id").dropDuplicates(["set0", "set1"]).join(classes.select("rep", "set0", "set1"), ["set0", "set1"]).select("rep", "hashes")
    hashes = durable(hashes)  # the only copy of the sets of all members
    facts = classes.select("rep", "n", *SKETCHES)
    dealt = durable(_dealt(groups, "first", groups.groupBy("first").agg(F.count("*").alias("size")), block).join(facts, "rep"))

    places = [F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
    leaders = groups.groupBy("first").agg(*places).select("first", F.explode(F.array("first", *(f"l{k}" for k in range(LEADERS)))).alias("rep")).distinct()
    led = durable(dealt.join(leaders, ["first", "rep"]))
    met = dealt.drop("blocks").join(_other(_dealt_out(led), "first", "block"), ["first", "block"]).where((F.col("rep") != F.col("o_rep")) & _near(percent))
    nearest = met.select(F.greatest("rep", "o_rep").alias("rep"), F.least("rep", "o_rep").alias("to")).groupBy("rep").agg(F.min("to").alias("to"))
    full = hashes.join(bounded(facts.join(groups.select("rep").distinct(), "rep", "left_semi")), "rep")
    labels = components(_confirmed(durable(nearest), full, percent, block).toDF("a", "b"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    # the other leaders, for what the first contraction left apart
    rows, others = _involved(placed(dealt).drop("blocks"), _dealt_out(placed(led)), hashes, percent)
    labels = components(labels.toDF("a", "b").union(_ordered(_met(rows, others, "first", _linked(percent)))))

    mixed = bounded(_parts(placed(dealt), "first").drop("size"))
    open_ = durable(placed(dealt).join(mixed, "first"))
    few = open_.where((F.col("blocks") == 1) | (F.col("minor") <= minor)).drop("minor")
    rows, others = _involved(few.drop("blocks", "giant"), _minor(few), hashes, percent)
    found = labels.toDF("a", "b").union(_ordered(_met(rows, others, "first", _linked(percent))))
    many = open_.where((F.col("blocks") > 1) & (F.col("minor") > minor))
    if not many.isEmpty():
        many = durable(many.select("rep", "component").distinct())
        sets_of_many = durable(full.join(bounded(many.select("rep")), "rep", "left_semi"))
        pairs = durable(_by_rare_shingles(many.join(sets_of_many, "rep"), percent, block))
        confirmed = pairs.join(sets_of_many.withColumnRenamed("rep", "a"), "a").join(_other(sets_of_many).withColumnRenamed("o_rep", "b"), "b").where(_linked(percent))
        found = found.union(confirmed.select("a", "b"))
    labels = components(found)

    ends = classes.select("set0", "set1", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set0", "set1", F.coalesce("component", "rep").alias("end"))
    out = sets.select("doc_id", "set0", "set1", "n_shingles", "rid").join(ends, ["set0", "set1"], "left").withColumn("component", F.coalesce("end", "rid"))
    return out.drop("end"), unique


def _kept(docs: DataFrame, percent: int, words: int, block: int, minor: int) -> tuple[DataFrame, bool]:
    """The rows of _labelled with component_id (a doc_id, if any) and first: whether the row is the one of its component to keep."""
    rows, unique = _labelled(docs, percent, words, block, minor)
    if unique:
        return rows.withColumn("component_id", F.col("component")).withColumn("first", F.col("component") == F.col("doc_id")), True
    rows = durable(rows)
    ids = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("lead"))
    return rows.join(ids, "component").withColumn("first", F.col("lead.rid") == F.col("rid")).drop("lead"), False


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, minor: int = MINOR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links, kept marks the rows of that
    doc_id.  A null or empty text has no shingles and is linked with nothing; fewer than
    ``words`` words make one shingle of the whole sequence.  Every row takes part with its own
    text, also where a doc_id repeats.  A row without a doc_id takes part too; where no row of
    its component has one, component_id is null and one of these rows is kept.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows, _ = _kept(documents(docs), percent, words, block, minor)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull() & F.col("first")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, minor: int = MINOR) -> DataFrame:
    """One row of docs for each component, with its columns: that of the smallest doc_id; a text without words is a component.

    What goes is broadcast behind a count, so that texts aren't shuffled once more; beyond it
    they are joined by a shuffle.  Where doc_ids repeat or are null, rows are told apart by
    doc_id and shingle set, so unlike texts of one doc_id both stay; of rows that agree in both
    one stays.  An empty table gives no rows.
    """
    rows, unique = _kept(documents(docs), percent, words, block, minor)
    if unique:
        gone = bounded(rows.where("NOT first").select("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    gone = bounded(rows.where("n_shingles > 0").groupBy("doc_id", "set0", "set1").agg(F.max("first").alias("f")).where("NOT f").select(F.col("doc_id").alias("gone_id"), F.col("set0").alias("gone0"), F.col("set1").alias("gone1")))
    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}  # the columns' names may clash with ours
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"), *(F.col(c).alias(names[c]) for c in docs.columns))
    known = _with_identity(plain, words)
    rest = known.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("s0") == F.col("gone0")) & (F.col("s1") == F.col("gone1")), "left_anti")
    own = F.when(F.col("empty"), F.monotonically_increasing_id())  # texts without words are linked with nothing, not even a copy
    return rest.withColumn("own", own).dropDuplicates(["id", "s0", "s1", "own"]).select(*(F.col(names[c]).alias(c) for c in docs.columns))


def _with_identity(rows: DataFrame, words: int) -> DataFrame:
    """rows (id, t, ...) without t, with the identity of the text's set and whether it is empty."""
    rest = [c for c in rows.columns if c != "t"]

    def run(batches):
        drop_memos()
        memo = _word_memo()
        for batch in small(batches):
            every = [shingles(t, memo, words) for t in batch.column(batch.schema.get_field_index("t")).to_pylist()]
            key = np.array([_identity(s) for s in every], np.int64).reshape(-1, 2)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([len(s) == 0 for s in every], pa.bool_())], [*rest, "s0", "s1", "empty"])

    schema = rows.select(*rest).schema
    for name, kind in (("s0", "long"), ("s1", "long"), ("empty", "boolean")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
