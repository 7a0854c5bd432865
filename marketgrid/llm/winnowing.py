"""Document fingerprints by winnowing, with DataFrame functions only.

The words of a text (cut after 32 characters) are hashed, every run of ``k``
hashes is hashed again, and in every window of ``w`` such k-grams the smallest
one is chosen, the rightmost of equals.  The chosen (hash, position) pairs are
the fingerprint.  Two texts that share ``w + k - 1`` words in a row share a
chosen k-gram, and the positions say where.

A pair is held in one long: 31 bits of hash above 32 bits that count down with
the position, so that the smallest long is the smallest hash and, among
equals, the rightmost.  Window minima come from doubling: the minimum over 2s
positions is the least of two minima over s.

Edge cases: a null or empty text, or one without words, has the empty
fingerprint ''; a text with fewer than ``k`` words has one hash over all of
them; with fewer than ``w`` k-grams the one window is the whole text.  The
likeness of two fingerprints is the Jaccard index of their hash sets; of two
empty ones 1.  Where doc_ids repeat, the next document is the one with the
smallest text among the next larger doc_id.  A row without a doc_id has no
next document: its last quarter is replaced by nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialize
from .common import id_and_text

K, W = 4, 8                       # W: a power of two
PIECES = r"[^\x20\x09-\x0D]{1,32}"
_LOW = (1 << 32) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once per row, not once per use."""
    return F.transform(F.array(value), use)[0]


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """Chosen (hash, position) longs of a text, in text order."""
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    words = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))

    def grams(h: Column) -> Column:
        whole = F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: F.xxhash64(acc, x))
        return (F.when(F.size(h) >= k, F.transform(
                    F.slice(h, F.lit(1), F.size(h) - (k - 1)),
                    lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])))
                .when(F.size(h) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>")))

    chosen = _let(F.transform(words, lambda x: F.xxhash64(x)), grams)
    chosen = F.transform(chosen, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32)
                         .bitwiseOR(F.lit(_LOW) - i))

    def least_over(step: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + step)))

    span = 1
    while span < w:
        chosen = _let(chosen, least_over(span))
        span *= 2
    return F.array_distinct(_let(chosen, lambda a: F.slice(
        a, F.lit(1), F.greatest(F.lit(1), F.size(a) - (w - 1)))))


def hashes(chosen: Column) -> Column:
    """The set of hashes of chosen longs."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 32).cast("int")))


def as_string(chosen: Column) -> Column:
    """``hash@position`` terms, hash in hex."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, 32))), F.lit("@"),
        (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two hash sets."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def predecessors(ids: DataFrame) -> DataFrame:
    """(doc_id, need) -> doc_id, prev_id, prev_need, in ascending doc_id order
    with the last before the first.  Rows are range-partitioned; only one row
    per partition meets in one task."""
    ranged = materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("doc_id")
    lasts = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "need")).alias("last"))
    along = Window.orderBy("part")
    end = F.last("last").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = lasts.select("part", F.coalesce(F.lag("last").over(along), end).alias("before"))
    row = F.struct("doc_id", "need")
    return (ranged.withColumn("own", F.lag(row).over(inside))
            .join(F.broadcast(before), "part")
            .withColumn("prev", F.coalesce("own", "before"))
            .select("doc_id", F.col("prev.doc_id").alias("prev_id"),
                    F.col("prev.need").alias("prev_need")))


def fingerprint(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, fingerprint of every text."""
    return id_and_text(docs).select("doc_id", as_string(winnow(F.col("text"), k, w))
                                    .alias("fingerprint"))


def edited_and_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Compare every document with an edited text of its own, whose last
    quarter is the beginning of the next document, and with that document.

    doc_id, n_chars, edited, chosen, edited_chosen, near_edited, near_next.

    Texts are shuffled once, by doc_id.  Each document sends to the one
    before it what that one needs: as many characters as are replaced there,
    and its own hash set."""
    texts = id_and_text(docs)
    quarter = F.expr("char_length(text) div 4")
    ids = texts.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(quarter).alias("need"))
    placed = (texts.join(predecessors(ids), "doc_id")
              .groupBy("doc_id").agg(F.first("prev_id").alias("prev_id"),
                                     F.first("prev_need").alias("prev_need"),
                                     F.min("text").alias("text")))
    sent = placed.select(F.col("prev_id").alias("doc_id"),
                         F.expr("substring(text, 1, cast(prev_need as int))").alias("head"),
                         hashes(winnow(F.col("text"), k, w)).alias("next_hashes"))
    cut = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), "
                 "substring(head, 1, cast(n_chars div 4 as int)))")
    # an inner join, so that both of its sides read one shuffle of the texts
    nameless = texts.filter(F.col("doc_id").isNull()).select(
        "doc_id", "text", F.lit("").alias("head"), F.array().cast("array<int>").alias("next_hashes"))
    found = (texts.join(sent, "doc_id").select("doc_id", "text", "head", "next_hashes")
             .union(nameless)
             .withColumn("n_chars", F.char_length("text").cast("bigint"))
             .withColumn("edited", cut)
             .select("doc_id", "n_chars", "edited", "next_hashes",
                     winnow(F.col("text"), k, w).alias("chosen"),
                     winnow(F.col("edited"), k, w).alias("edited_chosen")))
    return found.select("doc_id", "n_chars", "edited", "chosen", "edited_chosen",
                        _let(F.struct(hashes(F.col("chosen")).alias("a"),
                                      hashes(F.col("edited_chosen")).alias("e"),
                                      F.col("next_hashes").alias("n")),
                             lambda s: F.struct(likeness(s["a"], s["e"]).alias("edited"),
                                                likeness(s["a"], s["n"]).alias("next"))
                             ).alias("near")).select(
        "doc_id", "n_chars", "edited", "chosen", "edited_chosen",
        F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))
