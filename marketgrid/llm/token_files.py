"""Token-ID files: frequency-ranked ids in byte-aligned variable-length code.

Writing (``write``):

1. every text is encoded with the tokenizers library; ids are written once;
2. all ids are counted; rank 0 is the most frequent id (ties: smaller id).
   The rank table has one entry per vocabulary id, which bounds it;
3. documents are dealt into shards by ranges of doc_id, sorted, and their
   ranks are coded: each rank takes 1 to 4 data bytes, and its length minus 1
   is a two-bit field of a separate control byte (four ranks a byte, first in
   the low bits).

A token folder holds ``shards`` (Parquet rows shard, start_in_shard, doc_id,
n_tokens, control, data in doc_id order) and ``ranks`` (rank, id, n).
Parquet's commit protocol makes the write safe against lost executors.

Reading (``read``): lengths of four ranks come from a 256-row table, their
sums give the place of every rank, and ids come from the rank table; all by
numpy over whole batches.

Edge cases: a null or empty text holds just the end id; repeated doc_ids stand
side by side, ordered by their ids; rows without a doc_id come first; an empty
table gives empty shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialize, table_dir
from .common import id_and_text, partitions_for, slices

#: Words remembered per generation in a worker; words above FAR bytes are
#: forgotten with the batch, so this bounds the memory.
MEMO_WORDS, FAR = 400_000, 64
#: Bytes of text encoded at once: the more, the fewer times a word is looked up.
SLICE = 8 << 20
#: Documents per shard (a shard is one range of doc_id and one file), and the
#: most shards: the table of their offsets, which is broadcast, has as many rows.
SHARD_DOCS, SHARDS = 8_000, 20_000

#: Words of these characters are lower-cased one to one and cut the same way
#: by the pre-tokenizer, so many of them can be encoded as one text.  (With an
#: apostrophe the cut depends on more than the classes of characters.)
_PLAIN = re.compile(r"[ !-&(-~À-ÖØ-öø-ÿ]*")
_WORD_END = "</w>"
#: Class of a byte in such text: space 0, letter 1, digit 2, sign 3.
_CLASS = np.full(256, 1, np.uint8)
_CLASS[0x21:0x7F] = [1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3
                     for b in range(0x21, 0x7F)]
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASSES, _SPACES = _CLASS.tobytes(), np.flatnonzero(_CLASS == 0).astype(np.uint8).tobytes()
_ODD = r"[^ \t\n\x0b\x0c\r!-&(-~À-ÖØ-öø-ÿ]"


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The values of a string or binary array without nulls, one after the
    other, and where each begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return b"", np.zeros(1, kind)
    _, places, data = column.buffers()
    at = np.frombuffer(places, kind, len(column) + 1, column.offset * kind().itemsize)
    first, last = int(at[0]), int(at[-1])
    return data[first:last].to_pybytes() if last > first else b"", at - at[0]


def _values(column: pa.Array) -> list[bytes]:
    """The same as a list; many times as fast as ``to_pylist`` on short values."""
    data, at = _joined(column)
    at = at.tolist()
    return [data[x:y] for x, y in zip(at, at[1:])]


def _cut(text: bytes) -> tuple[list[bytes], list[int]]:
    """Pre-tokens of plain text (runs of letters, single digits, runs of
    signs), and their running number at the end of every word."""
    kind = _CLASS[np.frombuffer(text, np.uint8)]
    begins = kind > 0
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    stops = kind > 0
    stops[:-1] &= begins[1:] | (kind[1:] == 0)
    at = zip(np.flatnonzero(begins).tolist(), (np.flatnonzero(stops) + 1).tolist())
    upto = np.cumsum(begins)
    return [text[x:y] for x, y in at], [*upto[np.flatnonzero(kind == 0) - 1].tolist(), int(upto[-1])]


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct word once.

    The tokenizer never lets a token reach across white space, so the ids of
    a text are those of its words one after the other.  ASCII capitals are
    folded first (the tokenizer does so itself), except near strings that
    could spell an added token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(_WORD_END)
        self.added = [t.content.lower().encode() for t in
                      self.lib.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        # the same model for pre-tokens that are cut and folded already
        self.bare = Tokenizer.from_file(path)
        self.bare.no_truncation()
        self.bare.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(),
             pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces: dict[bytes, bytes] = {}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.far: list[tuple[dict, bytes]] = []

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {b"": b""}       # beside leading or trailing space
        words = [w for w in words if w]
        for k in range(0, len(words), 2000):
            found.update(self._learn_some(words[k:k + 2000]))
        return found

    def _learn_some(self, words: list[bytes]) -> dict[bytes, bytes]:
        text = b" ".join(words).decode()
        low = text.lower()
        if _PLAIN.fullmatch(text) and not any(a.decode() in low for a in self.added):
            pieces, upto = _cut(low.encode())
            if len(self.pieces) > MEMO_WORDS:
                self.pieces.clear()
            self._learn_pieces(list(set(pieces).difference(self.pieces)))
            ids = list(map(self.pieces.__getitem__, pieces))
            return {w: ids[x] if y == x + 1 else b"".join(ids[x:y])
                    for w, x, y in zip(words, [0, *upto], upto)}
        plain = [w for w in words if _PLAIN.fullmatch(w.decode())]
        if 0 < len(plain) < len(words):
            rest = set(words).difference(plain)
            return self._learn_some(plain) | self._learn_some(list(rest))
        coded = self.lib.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, self.kind).tobytes() for w, e in zip(words, coded)}

    def _learn_pieces(self, pieces: list[bytes]) -> None:
        """The library encodes many pre-tokens as one text; the word ends in
        its ids tell them apart."""
        size = self.kind.itemsize
        for k in range(0, len(pieces), 5000):
            part = pieces[k:k + 5000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()],
                                                       add_special_tokens=False)[0].ids, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            if len(ends) != len(part):
                raise RuntimeError("pre-tokens and word ends do not agree")
            data = ids.tobytes()
            self.pieces.update(zip(part, [data[x:y] for x, y in zip([0, *ends], ends)]))
        self.far += [(self.pieces, p) for p in pieces if len(p) > FAR]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        found = list(map(self.young.get, words))
        if None in found:
            need = [w for w, x in zip(words, found) if x is None]
            self.young.update((w, self.old[w]) for w in need if w in self.old)
            self.young.update(self._learn([w for w in need if w not in self.young]))
            self.far += [(self.young, w) for w in need if len(w) > FAR]
            found = list(map(self.young.__getitem__, words))
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text of a string array.  Plain texts are cut into
        pre-tokens, others into words; Arrow numbers the distinct ones, and
        their ids are laid out by numpy."""
        for memory, word in self.far:
            memory.pop(word, None)
        self.far = []
        low = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)             # could hold an added token
        whole, _ = _joined(low)
        for a in self.added:
            if a in whole:
                odd |= pc.match_substring(low, a.decode()).to_numpy(zero_copy_only=False)
        plain = ~odd & ~pc.match_substring_regex(low, _ODD).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for mask, encode, source in ((plain, self._encode_plain, low), (odd, self._encode_words, texts),
                                     (~plain & ~odd, self._encode_words, low)):
            rows = np.flatnonzero(mask)
            if len(rows):
                for k, x in zip(rows.tolist(), encode(source.filter(pa.array(mask)))):
                    out[k] = x
        return out

    def _encode_plain(self, texts: pa.Array) -> list[bytes]:
        text, at = _joined(texts)
        sizes, ends = np.diff(at).astype(np.int64), at[1:].astype(np.int64)
        if b"\xc3" in text:
            # capitals beyond ASCII: in UTF-8, C3 80..9E but 97 become C3 A0..BE
            folded = np.frombuffer(text, np.uint8).copy()
            second = np.flatnonzero(folded[:-1] == 0xC3) + 1
            second = second[(folded[second] <= 0x9E) & (folded[second] != 0x97)]
            folded[second] += 0x20
            text = folded.tobytes()
        kind = np.frombuffer(text.translate(_CLASSES), np.uint8)
        solid = kind > 0
        begins = solid.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        heads = (ends - sizes)[sizes > 0]
        begins[heads] = solid[heads]
        stops = solid.copy()
        stops[:-1] &= begins[1:] | ~solid[1:]
        start = np.flatnonzero(begins)
        body = text.translate(None, _SPACES)
        offsets = np.append(0, np.cumsum(np.flatnonzero(stops) + 1 - start)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start),
                                       [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        pieces = pieces.dictionary_encode()
        distinct = _values(pieces.dictionary)
        known = list(map(self.pieces.get, distinct))
        new = [k for k, x in enumerate(known) if x is None]
        if new:
            if len(self.pieces) > 2 * MEMO_WORDS:    # what is in use stays
                self.pieces.clear()
                self.pieces.update((w, x) for w, x in zip(distinct, known) if x is not None)
            self._learn_pieces([distinct[k] for k in new])
            for k in new:
                known[k] = self.pieces[distinct[k]]
        return self._laid_out(known, pieces.indices,
                              np.append(0, np.searchsorted(start, ends)))

    def _encode_words(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy()
        return self._laid_out(self._ids_of(_values(words.dictionary)), words.indices,
                              offsets - offsets[0])

    def _laid_out(self, known: list[bytes], at: pa.Array, cuts: np.ndarray) -> list[bytes]:
        """Ids of the units ``at``, cut into documents."""
        ids, places = _joined(pa.array(known, pa.large_binary()).take(at))
        bounds = places[cuts].tolist()
        return [ids[x:y] for x, y in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- the code ---------------------------------------------------------------

_LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks below 2^32."""
    control, data = pack_rows(ranks, np.array([len(ranks)], np.int64))
    return control[0].as_py(), data[0].as_py()


def pack_rows(ranks: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(control, data) of several documents whose ranks lie one after the
    other; every document's control stream begins a byte of its own."""
    wide = ranks.max(initial=0) > 0xFFFF
    ranks = np.ascontiguousarray(ranks, "<u4" if wide else "<u2")
    extra = (ranks > 0xFF).astype(np.uint8)
    if wide:
        extra += ranks > 0xFFFF
        extra += ranks > 0xFFFFFF
    ends, controls = np.cumsum(counts), np.cumsum(-(-counts // 4))
    fields = np.zeros(4 * int(controls[-1]) if len(counts) else 0, np.uint8)
    at = 0
    for n, e, c in zip(counts.tolist(), ends.tolist(), controls.tolist()):
        fields[at:at + n] = extra[e - n:e]
        at = 4 * c
    f = fields.reshape(-1, 4)
    control = f[:, 0] | f[:, 1] << 2 | f[:, 2] << 4 | f[:, 3] << 6
    keep = np.empty((len(ranks), ranks.itemsize), bool)
    for k in range(ranks.itemsize):
        np.greater_equal(extra, k, out=keep[:, k])
    data = ranks.view(np.uint8)[keep.ravel()]
    upto = np.append(0, np.cumsum(extra, dtype=np.int64))[ends] + ends

    def column(upto: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(counts), [
            None, pa.py_buffer(np.append(0, upto).astype(np.int32)), pa.py_buffer(values.tobytes())])

    return column(controls, control), column(upto, data)


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """Ranks of several documents whose streams lie one after the other;
    every document's control stream starts at a byte of its own."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    if len(counts) and (counts % 4).any():      # fields that only fill up a byte
        slots = -(-counts // 4) * 4
        first = np.cumsum(slots) - slots
        used = np.zeros(len(lengths) + 1, np.int32)
        np.add.at(used, first, 1)
        np.add.at(used, first + counts, -1)
        lengths = lengths[np.cumsum(used[:-1]) > 0]
    at = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


# -- files ------------------------------------------------------------------

def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary; the tokenizer's ids in two or four bytes each,
    little-endian, with ``end_id`` at the end), wide (whether four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        for b in slices(batches, limit=SLICE):
            ids = [x + end for x in enc.encode(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()),
                 pa.array(np.full(len(ids), enc.kind.itemsize == 4))],
                names=["doc_id", "ids", "wide"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids binary, wide boolean")


def _ids(b: pa.RecordBatch) -> tuple[list[bytes], np.dtype]:
    wide = b.num_rows and b.column(b.schema.get_field_index("wide"))[0].as_py()
    return b.column(b.schema.get_field_index("ids")).to_pylist(), np.dtype("<u4" if wide else "<u2")


def count_ids(encoded: DataFrame) -> DataFrame:
    """id, n over all documents; each task sends one row per id it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches, "ids"):
            raw, kind = _ids(b)
            n = np.bincount(np.frombuffer(b"".join(raw), kind), minlength=len(total))
            n[:len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return (encoded.mapInArrow(run, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("n")))


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str,
          shard_docs: int = SHARD_DOCS) -> None:
    spark = docs.sparkSession
    encoded = materialize(encode(docs, tokenizer, end_id))
    # bounded by the vocabulary, so it may pass through the driver
    ranked = sorted(((-r.n, r.id) for r in count_ids(encoded).collect()))
    ids = [i for _, i in ranked]
    spark.createDataFrame([(k, i, -n) for k, (n, i) in enumerate(ranked)],
                          "rank bigint, id bigint, n bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for b in slices(batches, "ids"):
            raw, kind = _ids(b)
            counts = np.array([len(x) // kind.itemsize for x in raw], np.int64)
            ends = np.cumsum(counts)
            control, data = pack_rows(rank_of[np.frombuffer(b"".join(raw), kind)], counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(raw), shard, np.int32)), pa.array(start + ends - counts),
                 b.column(0), pa.array(counts), control, data],
                names=["shard", "start_in_shard", "doc_id", "n_tokens", "control", "data"])
            start += int(ends[-1])

    shards = min(partitions_for(encoded, shard_docs), SHARDS)
    (encoded.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
     .mapInArrow(run, "shard int, start_in_shard bigint, doc_id bigint, n_tokens bigint, "
                      "control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{folder}/shards"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32) from a
    token folder; start counts the ids of all documents before."""
    ranked = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()
    id_of = np.array([r.id for r in ranked], np.uint32)
    shards = spark.read.parquet(f"{folder}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            counts = np.asarray(b.column(3))
            ids = id_of[unpack(b"".join(b.column(4).to_pylist()),
                               b"".join(b.column(5).to_pylist()), counts)].tobytes()
            ends = (np.cumsum(counts) * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(4)]
                + [pa.array([ids[e - 4 * c:e] for c, e in zip(counts.tolist(), ends)], pa.binary())],
                names=["shard", "start_in_shard", "doc_id", "n_tokens", "ids"])

    # one row per shard, SHARDS at most
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (shards.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
               .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    rows = shards.mapInArrow(run, "shard int, start_in_shard bigint, doc_id bigint, "
                                  "n_tokens bigint, ids binary")
    return rows.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("offset") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


def new_folder(docs: DataFrame) -> str:
    """A fresh token folder in the shared scratch folder."""
    return table_dir(docs)
