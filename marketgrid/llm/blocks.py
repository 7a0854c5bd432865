"""Blocks of documents that ask questions about their contents.

Two operators look for passages that documents share.  Neither can gather the
passages of the corpus in one place, and neither needs to: the documents are
dealt into blocks of a few MB and written once as a bucketed table, so that a
block is read back as one group without a shuffle.  A file of the table holds
the blocks whose numbers hash alike; there are ``FILES`` files at most, however
many blocks.  Rows are dealt by doc_id and place in the scan, so rows without a
doc_id, or of one doc_id, spread over the blocks like others.  A step then has
three parts:

* ``send``: every block computes the keys it wants to ask about and sends one
  message per bucket of keys (each key once, however often the block has it);
* ``decide``: the messages of one bucket meet in one group, which answers
  every sender.  A key arrives at most once per block, so a key that a third
  of all documents hold is no heavier than its number of blocks;
* the answers go back to the blocks, which compute the same keys again and
  read the answers in the same order.

Blocks, answers and the order of keys are functions of the documents alone, so
any task may be run again after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialize, table_dir, table_name
from .hashing import mix, window_sums

#: Files of a table; Spark allows 100,000 buckets.
FILES = 40_000
MESSAGE = "_block int, bucket int, payload binary"
NEVER = np.iinfo(np.int64).max     # stands for a null doc_id: after all others


class Blocks:
    """``docs`` dealt into ``count`` blocks, with ``buckets`` buckets of keys
    (fewer, so that messages do not become tiny)."""

    def __init__(self, docs: DataFrame, bytes_each: int):
        spark = docs.sparkSession
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if "_block" in docs.columns:
            raise ValueError("_block is a working name")
        self.count = max(1, -(-int(total) // bytes_each))
        self.buckets = -(-self.count // 4)
        number = F.xxhash64("doc_id", F.monotonically_increasing_id())
        dealt = docs.withColumn("_block", F.pmod(number, F.lit(self.count)).cast("int"))
        files = min(self.count, FILES)
        self.name = table_name("blocks")
        (dealt.repartition(files, "_block").write.format("parquet")
         .bucketBy(files, "_block").option("path", table_dir(docs))
         .option("compression", "zstd").saveAsTable(self.name))
        self.table = spark.table(self.name)
        self.columns = docs.columns

    def ask(self, send: Callable, decide: Callable, answers: DataFrame | None = None) -> DataFrame:
        """One step.  ``send(rows, answers)`` gives (bucket, payload) pairs;
        ``decide(payloads)`` gives one reply per payload."""
        texts = self.table.select("_block", "doc_id", "text").groupBy("_block")

        def messages(block: int, rows: pa.Table, got: dict[int, bytes]) -> pa.Table:
            out = send(rows, got)
            return pa.table({"_block": pa.array([block] * len(out), pa.int32()),
                             "bucket": pa.array([b for b, _ in out], pa.int32()),
                             "payload": pa.array([p for _, p in out], pa.binary())})

        if answers is None:
            sent = texts.applyInArrow(
                lambda key, rows: messages(key[0].as_py(), rows, {}), MESSAGE)
        else:
            sent = texts.cogroup(answers.groupBy("_block")).applyInArrow(
                lambda key, rows, got: messages(key[0].as_py(), rows, _by_bucket(got)), MESSAGE)

        def answer(rows: pa.Table) -> pa.Table:
            order = np.argsort(np.asarray(rows["_block"]), kind="stable")
            rows = rows.take(pa.array(order))
            replies = decide(rows["payload"].to_pylist())
            return pa.table({"_block": rows["_block"], "bucket": rows["bucket"],
                             "payload": pa.array(replies, pa.binary())})

        return materialize(sent.groupBy("bucket").applyInArrow(answer, MESSAGE))

    def finish(self, use: Callable, answers: DataFrame, fields: str) -> DataFrame:
        """All columns of the documents with those that ``use(rows, answers)``
        gives (arrays in the order of ``rows``)."""
        from pyspark.sql.types import StructType
        extra = StructType.fromDDL(fields).fields
        kept = [f for f in self.table.schema.fields if f.name != "_block"]

        def run(key, rows: pa.Table, got: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.table({f.name: [] for f in kept + extra})
            rows, columns = use(rows, _by_bucket(got))
            out = {f.name: rows[f.name] for f in kept}
            return pa.table(out | {f.name: c for f, c in zip(extra, columns)})

        return self.table.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(
            run, StructType(kept + extra))


def _by_bucket(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist()))


def in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """Rows by (doc_id, text), their ids and their texts as UTF-8.  The order
    of rows in a block's files is not fixed, this one is."""
    ids = rows["doc_id"].cast(pa.int64()).fill_null(NEVER).to_numpy()
    raw = [t or b"" for t in rows["text"].cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(raw)), key=lambda k: (ids[k], raw[k]))
    return rows.take(pa.array(order, pa.int64())), ids[order], [raw[k] for k in order]


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while 2 * span <= size and len(x) > span:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    if span < size and len(x) > size - span:
        x = np.minimum(x[:len(x) - (size - span)], x[size - span:])
    return x


class Anchors:
    """Windows of ``size`` values and what stands for them.

    The anchor of a window is its smallest hash of ``part`` values in a row.
    Equal windows have equal anchors wherever they stand, and neighbouring
    windows mostly share theirs, so few anchors stand for all windows.
    ``pieces``: (values, number of values per document) of whole documents.
    ``start``, ``many``: first window and number of windows of every run with
    one anchor; ``key``: the anchor; ``doc``: index of the document."""

    def __init__(self, pieces: Iterable[tuple[np.ndarray, np.ndarray]], size: int, part: int):
        found, at, docs = [], 0, 0
        for values, sizes in pieces:
            start, many, key = _runs(values, sizes, size, part)
            doc = np.searchsorted(np.cumsum(sizes), start, "right")
            found.append((start + at, many, key, doc + docs))
            at, docs = at + len(values), docs + len(sizes)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64),
                np.zeros(0, np.int64))
        self.start, self.many, self.key, self.doc = (
            np.concatenate(c) for c in zip(none, *found))


def _runs(values, sizes, size, part):
    # sums of random values are random enough to choose by; keys are mixed
    least = sliding_min(window_sums(values, part, mixed=False), size - part + 1)
    n = max(0, len(values) - size + 1)
    least = least[:n]
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    inside = np.ones(n, bool)
    for e in np.cumsum(sizes).tolist():
        inside[max(0, e - size + 1):e] = False       # would cross into the next document
        if e < n:
            new[e] = True
    start = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)[:n]) + 1
    return start, stop - start, mix(least[start])


def _sorted(keys: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys, and where in it a new one begins."""
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    new = np.zeros(len(keys), bool)
    new[:1] = True
    for k in (keys,) if second is None else (keys, second):
        ordered = k[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order, new


class KeySet:
    """Distinct keys of a block in bucket order.  ``of`` gives the index of
    the distinct key for every given one; ``first`` the given index of the
    first occurrence, ``last`` of the last.  With ``second`` a key is the 128
    bits of both."""

    def __init__(self, keys: np.ndarray, buckets: int, second: np.ndarray | None = None):
        order, new = _sorted(keys, second)
        ordered = keys[order]
        begin = np.flatnonzero(new)
        distinct = ordered[begin]
        first = order[begin]
        last = order[np.append(begin[1:], len(keys)) - 1] if len(keys) else order
        bucket = ((distinct >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        place = np.argsort(bucket, kind="stable")
        self.keys, self.first, self.last = distinct[place], first[place], last[place]
        self.second = None if second is None else second[self.first]
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        self.of = np.empty(len(keys), np.int64)
        self.of[order] = rank[np.cumsum(new) - 1]
        found, at = np.unique(bucket[place], return_index=True)
        self.parts = [(int(b), slice(int(a), int(e))) for b, a, e in
                      zip(found, at, np.append(at[1:], len(place)))]

    def answers(self, got: dict[int, bytes]) -> np.ndarray:
        """The reply bit of every distinct key."""
        out = np.zeros(len(self.keys), bool)
        for b, part in self.parts:
            bits = np.unpackbits(np.frombuffer(got[b], np.uint8), count=part.stop - part.start)
            out[part] = bits.astype(bool)
        return out


def grouped(keys: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys and the begin of each group of equals."""
    order, new = _sorted(keys, second)
    return order, np.flatnonzero(new)


def spread(per_group: np.ndarray, begin: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A value per group -> a value per key."""
    out = np.empty(len(order), per_group.dtype)
    out[order] = np.repeat(per_group, np.diff(np.append(begin, len(order))))
    return out


# -- which anchors stand in two documents -------------------------------------

def anchor_messages(anchors: Anchors, ids: np.ndarray, buckets: int
                    ) -> tuple[KeySet, list[tuple[int, bytes]]]:
    """Every distinct anchor, with a bit that tells whether two documents of
    the block hold it."""
    known = KeySet(anchors.key, buckets)
    two = ids[anchors.doc[known.first]] != ids[anchors.doc[known.last]]
    return known, [(b, known.keys[p].tobytes() + np.packbits(two[p]).tobytes())
                   for b, p in known.parts]


def shared_anchors(payloads: list[bytes]) -> tuple[list[slice], np.ndarray, np.ndarray]:
    """Per message its place in the joined keys; per key whether two
    documents hold it, and how many blocks do."""
    keys, two, places, at = [], [], [], 0
    for p in payloads:
        n = len(p) * 8 // 65               # 8 bytes and a bit each
        keys.append(np.frombuffer(p, np.uint64, n))
        two.append(np.unpackbits(np.frombuffer(p, np.uint8, offset=8 * n), count=n))
        places.append(slice(at, at + n))
        at += n
    order, begin = grouped(np.concatenate(keys))
    flags = np.concatenate(two)[order]
    blocks = np.diff(np.append(begin, len(order)))
    shared = (blocks > 1) | (np.maximum.reduceat(flags, begin) > 0)
    return places, spread(shared, begin, order), spread(blocks, begin, order)


def bits(flags: np.ndarray, places: list[slice]) -> list[bytes]:
    return [np.packbits(flags[p]).tobytes() for p in places]


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie within ``size`` places from one of ``starts``."""
    begun = np.zeros(n, np.int32)
    begun[starts] = 1
    np.cumsum(begun, out=begun)
    out = begun > 0
    out[size:] = begun[size:] != begun[:-size]
    return out
