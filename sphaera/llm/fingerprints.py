"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its words: term -> count.  For each of SAMPLES hash functions
a term with weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash alone; with
``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b + 1)`` the term with the smallest a is
sampled, as the pair (term, t).  Two documents get the same sample with a probability equal
to their generalised Jaccard similarity, the sum of the smaller over the sum of the larger
weights.  The likeness of two fingerprints is the share of equal samples.

DataFrame functions only.  Counting happens within a row (sort the hashes, find where runs
begin), so the words of a document are never shuffled; the minima are plain long columns of
a hash aggregate whose input already lies by doc_id.  A text and its edited text share what
they have in common: each term's draws are worked out once for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, durable

#: The standard error of a likeness is at most 0.5 / sqrt(SAMPLES).
SAMPLES = 64
#: Hash functions whose samples a row takes at once.
AT_ONCE = 4
WORD_GAP = "[ \\t-\\r]+"
#: A text up to its last gap.
SHARED = "(?s)^.*[ \\t-\\r]"


def _weights(rows: DataFrame, keys: list[str], pieces: list[tuple[Column, tuple[int, ...]]]) -> DataFrame:
    """keys, term, ln_w0, ln_w1, ...: a row for each distinct word of the sides' texts together, one of nulls where there is none.

    pieces: up to four texts that end at word boundaries, each with the numbers of the sides
    in whose text it stands; ln_w is null on a side that lacks the word.  A word's hash gives
    its last two bits to the number of its piece, so each term is a run of up to four runs.
    """
    words = lambda text: F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    tagged = lambda j: lambda w: F.xxhash64(w).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(j))
    hashes = (F.transform(words(text), tagged(j)) for j, (text, _) in enumerate(pieces))
    rows = rows.select(*keys, F.sort_array(F.concat(*hashes)).alias("h"))
    begins = F.filter(F.transform("h", lambda x, i: F.when((i == 0) | (F.get("h", i - 1) != x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("b", begins).select(*keys, "h", "b", F.posexplode_outer("b").alias("k", "at"))
    term = lambda at: F.get("h", at).bitwiseAND(F.lit(-4))
    rows = rows.where(F.col("at").isNull() | (F.col("at") == 0) | (term(F.col("at") - 1) != term(F.col("at"))))
    runs = []
    for j in range(len(pieces)):
        at, to = F.get("b", F.col("k") + j), F.coalesce(F.get("b", F.col("k") + j + 1), F.size("h"))
        runs.append((F.when(term(at) == term(F.col("at")), to - at).otherwise(0), F.get("h", at).bitwiseAND(F.lit(3))))
    sides = sorted({side for _, stands in pieces for side in stands})
    weight = lambda side: sum(F.when(piece.isin([j for j, (_, stands) in enumerate(pieces) if side in stands]), n).otherwise(0) for n, piece in runs)
    return rows.select(*keys, term(F.col("at")).alias("term"), *(F.log(weight(side).cast("double")).alias(f"ln_w{side}") for side in sides))


def _draws(j: int) -> list[Column]:
    """r, ln c and b of a term's j-th hash in its row."""
    x = F.col(f"x{j}")
    u = lambda shift: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(4095)) + F.lit(0.5)) / F.lit(4096.0)
    return [(-F.log(u(0) * u(12))).alias(f"r{j}"), F.log(-F.log(u(24) * u(36))).alias(f"ln_c{j}"), (F.shiftrightunsigned(x, 48) / F.lit(65536.0)).alias(f"b{j}")]


def _sample(j: int, side: int) -> Column:
    """For the j-th hash function of the row: ln a, then 24 bits of (term, t), in one long whose order is that of a; null where the side lacks the term."""
    r, ln_c, b = (F.col(f"{c}{j}") for c in ("r", "ln_c", "b"))
    t = F.floor(F.col(f"ln_w{side}") / r + b)
    ln_a = ln_c - r * (t - b + 1)
    place = F.floor((ln_a + F.lit(64.0)) * F.lit(float(1 << 31)))
    return F.shiftleft(place, 24).bitwiseOR(F.col("term").bitwiseXOR(F.shiftleft(t, 3)).bitwiseAND(F.lit((1 << 24) - 1)))


def _prints(rows: DataFrame, keys: list[str], pieces: list[tuple[Column, tuple[int, ...]]], samples: int) -> DataFrame:
    """keys, print0, print1, ...: each side's samples, 3 bytes each; empty where its text has no word.

    The sides' words are taken together, so what a term draws is worked out once for all of
    them.  A term's row is repeated for each AT_ONCE hash functions: the code of all of them
    side by side is too long for the JVM to compile.
    """
    sides = sorted({side for _, stands in pieces for side in stands})
    rows = _weights(rows, keys, pieces).withColumn("first", F.explode(F.array(*(F.lit(k) for k in range(0, samples, AT_ONCE)))))
    given = [*keys, "first", "term", *(f"ln_w{side}" for side in sides)]
    rows = rows.select(*given, *(F.xxhash64("term", F.col("first") + j).alias(f"x{j}") for j in range(AT_ONCE)))
    rows = rows.select(*given, *(c for j in range(AT_ONCE) for c in _draws(j)))
    minima = rows.groupBy(*keys, "first").agg(*(F.min(_sample(j, side)).alias(f"m{side}_{j}") for side in sides for j in range(AT_ONCE)))
    digits = lambda side, j: F.lpad(F.hex(F.col(f"m{side}_{j}").bitwiseAND(F.lit((1 << 24) - 1))), 6, "0")
    part = lambda side: F.concat(*(F.when(F.col("first") + j < samples, digits(side, j)).otherwise("") for j in range(AT_ONCE)))
    parts = F.sort_array(F.collect_list(F.struct("first", *(part(side).alias(f"part{side}") for side in sides)))).alias("parts")
    return minima.groupBy(*keys).agg(parts).select(*keys, *(F.unhex(F.array_join(F.col(f"parts.part{side}"), "")).alias(f"print{side}") for side in sides))


def fingerprint(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint: the samples of each row's text in hex, 6 digits each; empty where the text has no word.

    keys must tell the rows apart.
    """
    return _prints(rows, keys, [(F.col("text"), (0,))], samples).select(*keys, F.lower(F.hex("print0")).alias("fingerprint"))


def likeness(a: str | Column, b: str | Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints: 1 for two empty ones, 0 where one is."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = sum(F.when((a != "") & (F.substring(a, 6 * k + 1, 6) == F.substring(b, 6 * k + 1, 6)), 1).otherwise(0) for k in range(samples))
    return F.when((a == "") & (b == ""), 1.0).otherwise(same / F.lit(float(samples)))


def successors(ids: DataFrame, order: list[str]) -> DataFrame:
    """rid, doc_id, n_chars, next_id, prior_id, prior_chars of rows (rid, doc_id, n_chars), in the order of the columns ``order``, the last before the first.

    The ids alone are sorted by range; neighbours within a partition come from a window over
    it, those across from a table of a row for each partition.  The partition of an id is
    written down once, as a partitioning may differ from run to run.
    """
    ids = durable(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    w = W.partitionBy("part").orderBy(*order)
    inner = ids.select("*", F.lead("rid").over(w).alias("next_id"), F.lag("rid").over(w).alias("prior_id"), F.lag("n_chars").over(w).alias("prior_chars"))
    place = F.struct(*(x for c in order for x in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c))))  # null ids first
    ends = ids.groupBy("part").agg(F.min_by("rid", place).alias("low"), F.max_by(F.struct("rid", "n_chars"), place).alias("high"))
    w = W.partitionBy(F.lit(0)).orderBy("part")  # a row for each partition
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    around = [F.lead("low").over(w), F.first("low").over(whole), F.lag("high").over(w), F.last("high").over(whole)]
    ring = ends.select("part", F.coalesce(*around[:2]).alias("after"), F.coalesce(*around[2:]).alias("before"))
    out = inner.join(F.broadcast(ring), "part")
    return out.select("rid", "doc_id", "n_chars", F.coalesce("next_id", "after").alias("next_id"), F.coalesce("prior_id", "before.rid").alias("prior_id"), F.coalesce("prior_chars", "before.n_chars").alias("prior_chars"))


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text, ...).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document's.  A null text counts as empty: no words, an empty
    fingerprint, which is alike to another empty one (1) and to no other (0).  A table of one
    document is its own next.  Rows that repeat a doc_id are each a document, in the order of
    the SHA-256 of their texts; rows without doc_id come first, in that order.  Other columns
    are ignored; an empty table gives no rows.
    """
    docs = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = durable(docs.select("doc_id", F.length("text").cast("long").alias("n_chars")))
    rows = ids.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if rows.n == rows.ids:
        texts, ids, order = docs.select(F.col("doc_id").alias("rid"), "text"), ids.withColumn("rid", F.col("doc_id")), ["doc_id"]
    else:
        docs = durable(docs.withColumn("rid", F.monotonically_increasing_id()))
        texts, ids, order = docs.select("rid", "text"), docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "rid", F.sha2("text", 256).alias("sha")), ["doc_id", "sha", "rid"]
    order = durable(successors(ids, order))
    # Both joins take the same columns of texts, so that the texts are shuffled once.
    heads = texts.join(order, "rid").select(F.col("prior_id").alias("rid"), F.expr("substring(text, 1, int(prior_chars div 4))").alias("head"))
    both = texts.join(heads, "rid").withColumn("kept", F.expr("substring(text, 1, int(length(text) - length(text) div 4))"))
    both = both.withColumn("shared", F.regexp_extract("kept", SHARED, 0))  # up to the last gap; a word may go on beyond the cut
    own, other = F.expr("substring(text, length(shared) + 1)"), F.concat(F.expr("substring(kept, length(shared) + 1)"), "head")
    both = both.select("rid", F.unhex(F.sha2(F.concat("kept", "head").cast("binary"), 256)).alias("sha"), "shared", own.alias("own"), other.alias("other"))
    pieces = [(F.col("shared"), (0, 1)), (F.col("own"), (0,)), (F.col("other"), (1,))]
    prints = durable(_prints(both, ["rid", "sha"], pieces, samples))
    out = prints.join(order.select("rid", "doc_id", "n_chars", "next_id"), "rid").join(prints.select(F.col("rid").alias("next_id"), F.col("print0").alias("print2")), "next_id")
    out = out.select("doc_id", "n_chars", "sha", *(F.lower(F.hex(f"print{k}")).alias(c) for k, c in enumerate(("fingerprint", "edited_fingerprint", "next"))))
    return out.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next", samples).alias("near_next"))
