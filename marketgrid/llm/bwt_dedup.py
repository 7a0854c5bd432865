"""Substring deduplication over bytes by merging Burrows-Wheeler transforms.

A byte is removed if it is covered by a string of ``size`` bytes that also
starts in a document with a smaller doc_id.

1. Of equal texts the one with the smallest doc_id goes on; the others, if
   long enough, go whole.  Windows that cannot repeat are set aside: every window of ``size`` bytes is
   stood for by the smallest hash of ``PART`` bytes in it (equal windows
   choose equally), and hashes found in one document only are dropped.
2. Neighbouring windows with one surviving hash make a snippet of text.
   Blocks send every distinct snippet once, with the smallest doc_id that has
   it, to the bucket of its hash; equal windows always meet in one bucket.
   If very many blocks hold a hash, its windows are sent one by one to the
   buckets of their own hashes instead, so that no bucket gets them all.
3. In a bucket, equal snippets become one.  Snippets are dealt into shards of
   ``SHARD`` bytes, and each shard gets its suffixes sorted to ``size`` bytes
   and its Burrows-Wheeler transform.  The shards are then merged without
   sorting their suffixes again: an interleave, which names the shard of each
   place in the merged order, starts from the shards' sorted heads of ``HEAD``
   symbols and is refined by two symbols at a time: the places are dealt stably by the
   two symbols that precede them in the transform.  After t rounds it orders
   the suffixes of all shards by their first 32 + 2t symbols, and the places
   where a new prefix begins are known, which is what common prefix lengths
   capped there say.  At ``size`` symbols the runs without a new prefix are the
   intervals of equal strings of ``size`` bytes.
4. The smallest doc_id of each interval goes back as one bit per window.

A snippet whose hash no other snippet shares needs no merge: its windows
stand in no other snippet.

Edge cases: a null or empty text has no bytes; matches never cross documents;
a string repeated inside one document only, or in rows with the same doc_id,
stays; the smallest doc_id keeps its copy; strings are judged on the input.
What stays of a text may end inside a character, so it is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (Anchors, Blocks, KeySet, anchor_messages, bits, covered, grouped, in_order,
                     shared_anchors, spread)
from .hashing import byte_values, chunks, mix, window_sums

SIZE, PART = 50, 20
BLOCK_BYTES = 2 << 20
PIECE = 128 << 10                   # bytes hashed at once
SHARD = 64 << 10
#: Blocks that hold a hash before its windows are sent one by one.  Below that
#: the snippets of one hash are some ten MB at most (blocks x documents a block
#: x 70 bytes), which a bucket can hold; sent one by one they would be several
#: times as large.
MANY_BLOCKS = 1024
HEAD = 32                           # symbols that the interleave starts with
END = 0xFF                          # ends a snippet; never a byte of UTF-8


# -- shards and their merge --------------------------------------------------

class Shard:
    """Snippets with their suffixes sorted to ``size`` symbols.  ``suffix``:
    places in the text; ``head``: the first ``HEAD`` symbols (or ``size``) of
    each; ``pair``: the two symbols before each."""

    def __init__(self, snippets: list[bytes], size: int):
        text = np.frombuffer(bytes([END]).join(snippets) + bytes([END]), np.uint8)
        lengths = np.array([len(s) + 1 for s in snippets])
        ends = np.cumsum(lengths)
        place = np.arange(len(text))
        begin = np.repeat(ends - lengths, lengths)
        # symbols of the rotation of each snippet: before its begin comes its end
        one = np.where(place - 1 < begin, place - 1 + np.repeat(lengths, lengths), place - 1)
        two = one[one]
        # order by the first 8 symbols, then by twice as many from the ranks of
        # two halves; what stands behind a snippet's end orders no whole window
        padded = np.concatenate([text, np.full(8, END, np.uint8)])
        words = np.ndarray((len(text),), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
        known = min(8, size)
        words >>= np.uint64(64 - 8 * known)
        order, rank = _ranked(words)
        while known < size:
            step = min(known, size - known)
            behind = np.zeros(len(rank), np.int64)
            behind[:-step] = rank[step:]
            order, rank = _ranked(rank * np.int64(len(rank) + 1) + behind)
            known += step
        self.suffix = order
        head = min(HEAD, size)
        padded = np.concatenate([text, np.full(head, END, np.uint8)])
        heads = np.lib.stride_tricks.sliding_window_view(padded, head)
        self.head = np.ascontiguousarray(heads[order]).view(f"S{head}").ravel()
        self.pair = text[two[order]].astype(np.uint16) << 8 | text[one[order]]
        self.text, self.ends = text, ends


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the rank of each (equal keys, equal ranks)."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return order, rank


def merge(shards: list[Shard], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all shards' suffixes in the merged order to ``size`` symbols
    (shard after shard, in each shard's own order), and where in that order a
    new string of ``size`` symbols begins."""
    pairs = np.concatenate([s.pair for s in shards])
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.pair) for s in shards])
    # the interleave by the first symbols: a merge of sorted runs
    heads = np.concatenate([s.head for s in shards])
    order = np.argsort(heads, kind="stable")
    shard, dealt = shard[order], heads[order]
    begins = np.ones(len(heads), bool)
    begins[1:] = dealt[1:] != dealt[:-1]
    group = np.cumsum(begins, dtype=np.int32)
    before = np.empty_like(pairs)
    known = min(HEAD, size)
    while known < size:
        if known + 1 == size:                   # the last of an odd number
            pairs = pairs & 0xFF
        # the r-th place of a shard in the interleave is its r-th suffix
        before[np.argsort(shard, kind="stable")] = pairs
        order = np.argsort(before, kind="stable")
        shard, group, dealt = shard[order], group[order], before[order]
        begins[1:] = (dealt[1:] != dealt[:-1]) | (group[1:] != group[:-1])
        np.cumsum(begins, out=group)
        known += 2
    return np.argsort(shard, kind="stable"), begins


def smallest_owner(snippets: list[bytes], owners: np.ndarray, size: int,
                   shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each window of each snippet, the smallest owner of a snippet that
    holds the same window."""
    shards, counts, part, weight = [], [], [], 0
    limit = max(shard_bytes, sum(map(len, snippets)) // 200)  # at most 201 shards
    for s in snippets:
        part.append(s)
        weight += len(s)
        if weight >= limit:
            shards.append(Shard(part, size))
            counts.append(len(part))
            part, weight = [], 0
    if part:
        shards.append(Shard(part, size))
    place, begins = merge(shards, size)
    # owners by place in the merged order, their least per interval, and back
    lengths = np.array([len(s) + 1 for s in snippets])
    owner = np.repeat(owners, lengths)           # by place in the text
    offsets = np.cumsum([0] + [len(s.suffix) for s in shards])
    suffix = np.concatenate([s.suffix + o for s, o in zip(shards, offsets)])
    merged = np.empty_like(owner)
    merged[place] = owner[suffix]
    begin = np.flatnonzero(begins)
    least = np.repeat(np.minimum.reduceat(merged, begin), np.diff(np.append(begin, len(merged))))
    by_text = np.empty_like(owner)
    by_text[suffix] = least[place]
    ends = np.cumsum(lengths)
    return [by_text[e - n:e - size] for e, n in zip(ends.tolist(), lengths.tolist())]


# -- messages ------------------------------------------------------------------

def _pack(snippets: list[bytes], keys: np.ndarray, owners: np.ndarray) -> bytes:
    lengths = np.array([len(s) for s in snippets], np.uint32)
    return zstandard.compress(b"".join([len(snippets).to_bytes(4, "little"), lengths.tobytes(),
                                        keys.tobytes(), owners.tobytes(), *snippets]), 1)


def _unpack(payload: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(payload)
    n = int.from_bytes(raw[:4], "little")
    lengths = np.frombuffer(raw, np.uint32, n, 4)
    keys = np.frombuffer(raw, np.uint64, n, 4 + 4 * n)
    owners = np.frombuffer(raw, np.int64, n, 4 + 12 * n)
    ends = (np.cumsum(lengths, dtype=np.int64) + 4 + 20 * n).tolist()
    return [raw[e - k:e] for e, k in zip(ends, lengths.tolist())], keys, owners


def decide_windows(payloads: list[bytes], size: int, shard_bytes: int = SHARD) -> list[bytes]:
    """One bit per window of every snippet of every message: whether a
    document before its sender's first holder has the window."""
    number: dict[bytes, int] = {}
    messages, keys, owners = [], [], []
    for p in payloads:
        snippets, key, owner = _unpack(p)
        messages.append(([number.setdefault(s, len(number)) for s in snippets], owner))
        keys.append(key)
        owners.append(owner)
    of = np.array([g for gs, _ in messages for g in gs])
    order, begin = grouped(of)
    owner = np.minimum.reduceat(np.concatenate(owners)[order], begin)
    key = np.concatenate(keys)[order[begin]]
    same, first = grouped(key)                   # snippets that share a hash
    many = np.diff(np.append(first, len(key)))
    rivals = np.sort(same[np.repeat(many > 1, many)])
    known = list(number)
    earlier: dict[int, np.ndarray] = {}
    if len(rivals):
        least = smallest_owner([known[g] for g in rivals], owner[rivals], size, shard_bytes)
        earlier = {g: x < owner[g] for g, x in zip(rivals.tolist(), least)}
    nothing = np.zeros(max(map(len, known), default=0), bool)
    every = ~nothing
    replies = []
    for gs, own in messages:
        late = (own > owner[gs]).tolist()
        flags = [every[:len(known[g]) - size + 1] if l else
                 earlier[g] if g in earlier else nothing[:len(known[g]) - size + 1]
                 for g, l in zip(gs, late)]
        replies.append(np.packbits(np.concatenate(flags)).tobytes())
    return replies


class _Bytes:
    """The bytes of a block.  Texts that are copies of an earlier document's
    are left out of ``text`` once ``without_copies`` knows them."""

    def __init__(self, rows: pa.Table, size: int, buckets: int):
        self.rows, self.ids, self.raw = in_order(rows)
        self.size, self.buckets = size, buckets
        long = [k for k, t in enumerate(self.raw) if len(t) >= size]
        self.long = np.array(long, np.int64)
        digests = b"".join([xxhash.xxh3_128_digest(self.raw[k]) for k in long])
        a, b = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
        self.second = b
        self.texts = KeySet(a ^ mix(b), buckets)     # one key per distinct text

    def text_messages(self) -> list[tuple[int, bytes]]:
        first = self.texts.first                     # ids ascend, so the smallest id
        return [(b, self.texts.keys[p].tobytes() + self.second[first[p]].tobytes()
                 + self.ids[self.long[first[p]]].tobytes()) for b, p in self.texts.parts]

    def without_copies(self, got: dict[int, bytes]) -> None:
        owner = self.ids[self.long[self.texts.first]]
        copy = self.texts.answers(got)[self.texts.of]
        copy |= self.ids[self.long] > owner[self.texts.of]
        self.copy = np.zeros(len(self.raw), bool)
        self.copy[self.long[copy]] = True
        own = [b"" if c else t for t, c in zip(self.raw, self.copy.tolist())]
        self.sizes = np.fromiter(map(len, own), np.int64, len(own))
        self.text = b"".join(own)
        pieces = ((byte_values(b"".join(own[a:b])), self.sizes[a:b])
                  for a, b in chunks(own, PIECE))
        self.anchors = Anchors(pieces, self.size, min(PART, self.size))

    def snippets(self, got: dict[int, bytes]) -> None:
        """Distinct snippets below shared anchors: ``known`` in bucket order,
        with ``key``, ``owner`` and ``parts``; per run ``of``, the snippet."""
        a, size, text = self.anchors, self.size, self.text
        keys = KeySet(a.key, self.buckets)
        shared, split = _two_flags(keys, got)
        once = np.flatnonzero(shared[keys.of] & ~split[keys.of])
        start, many, key, doc = a.start[once], a.many[once], a.key[once], a.doc[once]
        apart = np.flatnonzero(split[keys.of])
        if len(apart):                           # window by window
            n = a.many[apart]
            first = np.repeat(a.start[apart] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = np.concatenate([start, first])
            many = np.concatenate([many, np.ones(len(first), np.int64)])
            key = np.concatenate([key, window_sums(byte_values(text), size)[first]])
            doc = np.concatenate([doc, np.repeat(a.doc[apart], n)])
            order = np.argsort(start, kind="stable")
            start, many, key, doc = start[order], many[order], key[order], doc[order]
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(text[s:e], len(number)) for s, e in
                       zip(start.tolist(), (start + many + size - 1).tolist())], np.int64)
        first = grouped(of)
        first = first[0][first[1]] if len(of) else of
        bucket = ((key[first] >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)
        place = np.argsort(bucket, kind="stable")
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        found = list(number)
        self.known = [found[k] for k in place.tolist()]
        self.key, self.owner = key[first][place], self.ids[doc[first]][place]
        self.windows = many[first][place]
        names, at = np.unique(bucket[place], return_index=True)
        self.parts = [(int(b), slice(int(x), int(y))) for b, x, y in
                      zip(names, at, np.append(at[1:], len(place)))]
        self.start, self.many, self.doc, self.of = start, many, doc, rank[of]


def _two_flags(keys: KeySet, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, len(keys.keys)), bool)
    for b, part in keys.parts:
        n = part.stop - part.start
        out[:, part] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=2 * n).reshape(2, n)
    return out[0], out[1]


def repeated(docs: DataFrame, size: int = SIZE, bytes_each: int = BLOCK_BYTES,
             many_blocks: int = MANY_BLOCKS) -> DataFrame:
    """All columns of ``docs`` with _n_bytes, _n_removed, _n_spans (runs of
    removed bytes) and _kept (binary, the bytes that stay)."""
    blocks = Blocks(docs, bytes_each)
    buckets = blocks.buckets

    def later(answers: DataFrame, by: int) -> DataFrame:
        """Answers of an earlier step, under bucket numbers of their own."""
        return answers.select("_block", (F.col("bucket") - by * buckets).alias("bucket"), "payload")

    def of_step(got: dict[int, bytes], by: int) -> dict[int, bytes]:
        return {k + by * buckets: p for k, p in got.items()
                if -by * buckets <= k < (1 - by) * buckets}

    def send_texts(rows, got):
        return _Bytes(rows, size, buckets).text_messages()

    def decide_texts(payloads):
        fields = [np.frombuffer(p, np.uint64).reshape(3, -1) for p in payloads]
        a, b, owner = np.concatenate(fields, 1)
        owner = owner.view(np.int64)
        order = np.lexsort((b, a))                   # all 128 bits count
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        begin = np.flatnonzero(new)
        least = spread(np.minimum.reduceat(owner[order], begin), begin, order)
        ends = np.cumsum([f.shape[1] for f in fields])
        return bits(least < owner, [slice(e - f.shape[1], e) for f, e in zip(fields, ends)])

    def send_anchors(rows, got):
        b = _Bytes(rows, size, buckets)
        b.without_copies(of_step(got, 1))
        return anchor_messages(b.anchors, b.ids, buckets)[1]

    def decide_anchors(payloads):
        places, shared, holders = shared_anchors(payloads)
        split = shared & (holders > many_blocks)
        return [np.packbits(np.concatenate([shared[p], split[p]])).tobytes() for p in places]

    def send_snippets(rows, got):
        b = _Bytes(rows, size, buckets)
        b.without_copies(of_step(got, 2))
        b.snippets(of_step(got, 1))
        return [(k, _pack(b.known[p], b.key[p], b.owner[p])) for k, p in b.parts]

    copies = blocks.ask(send_texts, decide_texts)
    anchors = blocks.ask(send_anchors, decide_anchors, later(copies, 1))
    windows = blocks.ask(send_snippets, lambda payloads: decide_windows(payloads, size),
                         later(copies, 2).union(later(anchors, 1)))
    every = later(copies, 2).union(later(anchors, 1)).union(windows)

    def use(rows, got):
        b = _Bytes(rows, size, buckets)
        b.without_copies(of_step(got, 2))
        b.snippets(of_step(got, 1))
        first = np.cumsum(b.windows) - b.windows
        flags = np.zeros(int(b.windows.sum()), bool)
        for k, p in b.parts:
            n = int(b.windows[p].sum())
            flags[first[p.start]:first[p.start] + n] = np.unpackbits(
                np.frombuffer(got[k], np.uint8), count=n)
        step = np.arange(int(b.many.sum())) - np.repeat(np.cumsum(b.many) - b.many, b.many)
        earlier = flags[np.repeat(first[b.of], b.many) + step]
        earlier |= np.repeat(b.ids[b.doc] > b.owner[b.of], b.many)
        starts = (np.repeat(b.start, b.many) + step)[earlier]
        out = covered(len(b.text), starts, size)
        begins = out.copy()
        begins[1:] &= ~out[:-1]
        ends = np.cumsum(b.sizes)
        heads = (ends - b.sizes)[b.sizes > 0]
        begins[heads] = out[heads]
        text = np.frombuffer(b.text, np.uint8)
        kept, removed, spans = [], [], []
        for raw, copy, e, n in zip(b.raw, b.copy.tolist(), ends.tolist(), b.sizes.tolist()):
            own = out[e - n:e]
            gone = len(raw) if copy else int(own.sum())
            kept.append(b"" if copy else text[e - n:e][~own].tobytes() if gone else raw)
            removed.append(gone)
            spans.append(1 if copy else int(begins[e - n:e].sum()))
        return b.rows, [pa.array([len(t) for t in b.raw], pa.int64()), pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]

    return blocks.finish(use, every, "_n_bytes bigint, _n_removed bigint, _n_spans bigint, _kept binary")
