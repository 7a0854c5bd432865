"""Substring deduplication over words by level-wise doubling.

A word is removed if it is covered by a window of ``size`` words whose words
also start in a document with a smaller doc_id.

A level has a length: the first is ``size / 2^DOUBLINGS``, each next one twice
the one before, the last ``size`` itself.  A full window holds several parts of
a level's length; the one with the smallest hash stands for it (equal windows
choose equally, and neighbours mostly share theirs).  Windows whose part is
repeated in another document survive the level, and only survivors are asked
about at twice the length, until none survive or the full length is reached;
there the windows themselves are asked about, with the smallest doc_id that has
each.  A window that is single at any length has been dropped by then.  All
levels are steps of ``blocks.Blocks``: distinct keys meet by hash, bits come
back.  Full windows are told apart by 128 bits, from two independent hashes of
every word.

Edge cases: a null or empty text has no words; documents of fewer than
``size`` words lose nothing; a passage repeated inside one document only, or
in rows with the same doc_id, stays; the smallest doc_id keeps its copy;
windows are judged on the input.  A null doc_id comes after all others.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (Anchors, Blocks, KeySet, anchor_messages, bits, covered, grouped,
                     in_order, shared_anchors, spread)
from .common import carried, restored
from .hashing import chunks, window_sums, word_hashes

SIZE, DOUBLINGS = 50, 2
BLOCK_BYTES = 4 << 20


def lengths(size: int, doublings: int = DOUBLINGS) -> list[int]:
    """Lengths of the levels, ascending; the last is ``size``."""
    return sorted({-(-size // 2 ** k) for k in range(doublings + 1)})


class _Words:
    """The words of a block and the windows that survive levels."""

    def __init__(self, rows: pa.Table, size: int):
        self.rows, self.ids, self.raw = in_order(rows)
        self.pieces = [word_hashes(self.raw[a:b]) for a, b in chunks(self.raw)]
        self.values = np.concatenate([p[0] for p in self.pieces] or [np.zeros(0, np.uint64)])
        self.sizes = np.concatenate([p[1] for p in self.pieces] or [np.zeros(0, np.int64)])
        self.size = size
        self.alive: np.ndarray | None = None         # by first word; None: all

    def level(self, part: int) -> Anchors:
        """Runs of windows with one part, those that hold a survivor."""
        runs = Anchors(self.pieces, self.size, part)
        if self.alive is not None and len(runs.start):
            upto = np.append(0, np.cumsum(self.alive))
            some = upto[np.minimum(runs.start + runs.many, len(self.alive))] > upto[runs.start]
            runs.start, runs.many, runs.key, runs.doc = (
                x[some] for x in (runs.start, runs.many, runs.key, runs.doc))
        return runs

    def keep(self, runs: Anchors, shared: np.ndarray) -> None:
        """Of the survivors those in runs whose part is repeated survive."""
        inside = np.zeros(len(self.values) + 1, np.int32)
        np.add.at(inside, runs.start[shared], 1)
        np.add.at(inside, (runs.start + runs.many)[shared], -1)
        now = np.cumsum(inside[:-1]) > 0
        self.alive = now if self.alive is None else now & self.alive

    def full(self, buckets: int) -> tuple[np.ndarray, np.ndarray, KeySet]:
        """Starts, documents and keys of the surviving windows."""
        if self.alive is None:
            runs = self.level(self.size)
            self.keep(runs, np.ones(len(runs.start), bool))
        start = np.flatnonzero(self.alive)
        doc = np.searchsorted(np.cumsum(self.sizes), start, "right")
        second = np.concatenate([word_hashes(self.raw[x:y], 1)[0] for x, y in chunks(self.raw)]
                                or [np.zeros(0, np.uint64)])
        keys = KeySet(window_sums(self.values, self.size)[start], buckets,
                      window_sums(second, self.size)[start])
        return start, doc, keys


def repeated(docs: DataFrame, size: int = SIZE, bytes_each: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with _n_words, _n_removed and _kept (the words
    that stay, joined by one space)."""
    if size < 2 or {"_n_words", "_n_removed", "_kept"} & set(docs.columns):
        raise ValueError("size must be at least 2, and the columns' names be free")
    blocks = Blocks(docs, bytes_each)
    buckets = blocks.buckets
    *parts, _ = lengths(size)

    def after(rows: pa.Table, got: dict[int, bytes], levels: int) -> _Words:
        """The words with what survives the first ``levels`` levels."""
        w = _Words(rows, size)
        for k, part in enumerate(parts[:levels]):
            runs = w.level(part)
            keys = KeySet(runs.key, buckets)
            w.keep(runs, keys.answers(_of_level(got, k, buckets))[keys.of])
        return w

    def ask_level(k: int):
        def send(rows, got):
            w = after(rows, got, k)
            return anchor_messages(w.level(parts[k]), w.ids, buckets)[1]
        return send

    def decide_level(payloads):
        places, shared, _ = shared_anchors(payloads)
        return bits(shared, places)

    def send_full(rows, got):
        w = after(rows, got, len(parts))
        _, doc, full = w.full(buckets)
        # documents stand in ascending order, so the first has the smallest id
        owner = w.ids[doc[full.first]]
        return [(b, full.keys[p].tobytes() + full.second[p].tobytes() + owner[p].tobytes())
                for b, p in full.parts]

    def decide_full(payloads):
        fields = [np.frombuffer(p, np.uint64).reshape(3, -1) for p in payloads]
        first, second, owners = np.concatenate(fields, 1)
        owners = owners.view(np.int64)
        order, begin = grouped(first, second)
        least = spread(np.minimum.reduceat(owners[order], begin), begin, order)
        ends = np.cumsum([f.shape[1] for f in fields])
        return bits(least < owners, [slice(e - f.shape[1], e) for f, e in zip(fields, ends)])

    answers = None
    for k in range(len(parts) + 1):
        last = k == len(parts)
        found = blocks.ask(send_full if last else ask_level(k), decide_full if last else decide_level, answers)
        found = found.select("_block", (F.col("bucket") + k * buckets).alias("bucket"), "payload")
        answers = found if answers is None else answers.union(found)

    def use(rows, got):
        w = after(rows, got, len(parts))
        start, doc, known = w.full(buckets)
        earlier = known.answers(_of_level(got, len(parts), buckets))[known.of]
        earlier |= w.ids[doc] > w.ids[doc[known.first]][known.of]
        stays = ~covered(len(w.values), start[earlier], size)
        ends = np.cumsum(w.sizes)
        kept, removed = [], []
        for text, e, n in zip(w.raw, ends.tolist(), w.sizes.tolist()):
            own = stays[e - n:e]
            out = n - int(own.sum())
            words = text.split()
            kept.append(b" ".join(compress(words, own.tolist()) if out else words).decode())
            removed.append(out)
        return w.rows, [pa.array(w.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

    return blocks.finish(use, answers, "_n_words bigint, _n_removed bigint, _kept string")


def _of_level(got: dict[int, bytes], level: int, buckets: int) -> dict[int, bytes]:
    """A level's answers by bucket."""
    return {b - level * buckets: p for b, p in got.items() if b // buckets == level}


def remove_repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``; texts that lose words hold the words that stay,
    other texts are unchanged."""
    out = repeated(carried(docs, "doc_id", "text"), size)
    text = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    return restored(out.withColumn("text", text), docs)
