"""Alignment of two tokenizers over the same bytes.

Both tokenizers read ' ' + text: A (byte-level BPE, a JSON file) as it is, B
(sentencepiece, which puts the space in front itself) the text.  A token is a
range of bytes.  Per batch two calls of ``pandas.merge_asof``, keyed by
document, find for the start of every token of A the token of B that covers
it, and the other way round; together these are all overlaps.  Overlaps whose
ends are equal are the *links*; the ends of links cut a document's tokens into
*groups*, the smallest runs of either side that hold the same bytes.

``align`` gives groups, links and, if wanted, overlaps.  ``with_counts`` holds
the links of a document against how often each id pair is linked in the corpus.
It never joins link by link: a batch of documents asks once about each of its
distinct pairs (numpy, in the task), the counts are summed and joined by
Spark, and the answers meet the batch again.  A pair that all documents hold
weighs one row per batch, and Spark splits even those (skew join).

Both tokenizers cut a text wherever a space follows a character that is not
white space.  So the segments between such places are numbered, the distinct
ones of a batch are encoded as one text, and their ids are laid out by numpy.
Files whose vocabulary does not guarantee this are encoded text by text.

Edge cases: texts that are null or empty, or whose bytes A's or B's tokens do
not give back (B rewrites U+2581), have no tokens: zeros, groups ''.  Special
tokens' strings are plain text.  Repeated rows give repeated rows, a null
doc_id stays null, other columns never reach the operator, an empty table
gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lineage import materialize
from .bpe_automaton import byte_alphabet
from .common import id_and_text, raw_texts, slices

#: Bytes of text aligned at once, and how many such slices ask about pairs together.
SLICE, TOGETHER = 1 << 20, 4
#: Segments longer than this are encoded one by one, others some KB together.
LONG, PART = 20_000, 8_000
#: Fixed value: the byte-level pre-tokenizer's split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

ALIGNED = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "groups string, link_a binary, link_b binary, batch bigint")


class ByteSide:
    """A: ids and byte lengths by a byte-level BPE file."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
        if not (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                and not pre.get("add_prefix_space") and pre.get("use_regex", True)):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        alphabet = byte_alphabet()
        label = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.size = np.zeros(max(label) + 1, np.int64)
        for i, t in label.items():
            self.size[i] = len(t)
        self.path = path
        # where ids are ranks of merges, the ranks alone say the same and are faster
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)]
                for m in spec["model"]["merges"]]
        self.ranked = None
        if made == sorted(made) and len(made) + 256 == len(vocab):
            self.ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, special_tokens={},
                                            mergeable_ranks={t: i for i, t in label.items()})

    @cached_property
    def lib(self):
        from tokenizers import Tokenizer
        lib = Tokenizer.from_file(self.path)
        lib.encode_special_tokens = True
        lib.no_truncation()
        lib.no_padding()
        return lib

    def ids(self, text: str, long: bool) -> np.ndarray:
        """Of a text that begins with the space.  ``long``: with runs that the
        faster library's pattern matcher may not bear."""
        if self.ranked is not None and not long:
            return np.array(self.ranked.encode_ordinary(text), np.int64)
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.int64)


class PieceSide:
    """B: ids and byte lengths by a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(n)]
        self.label = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i)
                      else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(x) for x in self.label], np.int64)
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids(self, text: str, long: bool) -> np.ndarray:
        return np.array(self.lib.encode(text[1:], num_threads=1), np.int64)

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        return (int(self.size[ids].sum()) == len(raw)
                and b"".join(map(self.label.__getitem__, ids.tolist())) == raw)


def _segments(joined: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Begins of segments: the texts' begins, and every space behind a
    character that is surely not white space and not last in its text."""
    n = len(joined)
    padded = np.concatenate([np.zeros(3, np.uint8), joined])
    one, two, three = padded[2:n + 2], padded[1:n + 1], padded[:n]     # the bytes before
    plain = (one > 0x20) & (one != 0x7F)
    # characters led by C2, E1, E2 and E3 may be white space
    plain &= (one < 0x80) | (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3))
    cut = plain & (joined == 0x20)
    cut[ends - 1] = False
    cut[np.append(0, ends[:-1])] = True
    return np.flatnonzero(cut)


class Encoded:
    """Tokens of one side: ids, their byte sizes, and tokens per text."""

    def __init__(self, ids: np.ndarray, many: np.ndarray, size: np.ndarray):
        self.ids, self.many = ids, many
        self.end = np.cumsum(size[ids])
        self.start = self.end - size[ids]
        self.doc = np.repeat(np.arange(len(many), dtype=np.int32), many)


def _of_segments(side, distinct: Distinct, at: np.ndarray, first: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the distinct segments, laid-out ids of all, tokens per text)."""
    ids = np.concatenate([side.ids(t, long) for t, long in distinct.parts] or [np.zeros(0, np.int64)])
    ends = np.cumsum(distinct.sizes)
    token_end = np.cumsum(side.size[ids])
    upto = np.searchsorted(token_end, ends)
    if len(ends) and (upto[-1] >= len(ids) or (token_end[upto] != ends).any()):
        raise _Crossed
    many, begin = np.diff(upto, prepend=-1), np.append(0, upto[:-1] + 1)
    per = many[at]
    ends = np.cumsum(per)
    place = np.repeat(begin[at] - (ends - per), per)
    place += np.arange(len(place))
    total = np.append(0, ends)
    return ids, ids[place], np.diff(total[np.append(first, len(at))])


class Distinct:
    """Distinct segments: byte sizes, and texts to encode, each of some whole
    segments: about ``PART`` bytes, or one long segment."""

    def __init__(self, segments: pa.LargeBinaryArray):
        offsets = np.frombuffer(segments.buffers()[1], np.int64, len(segments) + 1)
        self.raw = segments.buffers()[2].to_pybytes()[:int(offsets[-1])] if len(segments) else b""
        self.sizes = np.diff(offsets)
        long = self.sizes > LONG
        new = np.diff(offsets[1:] // PART, prepend=-1) != 0
        new |= long
        new[1:] |= long[:-1]
        cuts = [*offsets[:-1][new].tolist(), len(self.raw)]
        self.parts = [(self.raw[x:y].decode(), y - x > LONG + PART) for x, y in zip(cuts, cuts[1:])]


class _Crossed(Exception):
    """A token reaches across segments, or the tokens are not the text."""


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.kind = np.dtype("<u2" if max(len(self.a.size), len(self.b.size)) <= 1 << 16 else "<u4")
        # a token's text in a group string: with the sign that follows it
        self.shift = 3 * len(self.a.size)
        self.words = pa.array([f"{i}{s}" for i in range(len(self.a.size)) for s in (",", "|", "")]
                              + [f"{i}{s}" for i in range(len(self.b.size)) for s in (",", ";", "")],
                              pa.large_string())

    def encode(self, raw: list[bytes]) -> tuple[Encoded, Encoded, np.ndarray]:
        """Tokens of both sides, and which texts have any."""
        alive = np.array([bool(t) for t in raw], bool)
        if self.b.splits:
            try:
                return *self._by_segments([t for t in raw if t]), alive
            except _Crossed:
                pass
        none = np.zeros(0, np.int64)
        found = []
        for k, t in enumerate(raw):
            text = " " + t.decode()
            pair = (self.a.ids(text, True), self.b.ids(text, True)) if t else (none, none)
            alive[k] = bool(t) and self.b.spells(pair[1], b" " + t) \
                and int(self.a.size[pair[0]].sum()) == len(t) + 1
            found.append(pair if alive[k] else (none, none))
        many = [np.array([len(p[s]) for p, x in zip(found, alive) if x], np.int64) for s in (0, 1)]
        ids = [np.concatenate([p[s] for p in found] or [none]) for s in (0, 1)]
        return Encoded(ids[0], many[0], self.a.size), Encoded(ids[1], many[1], self.b.size), alive

    def _by_segments(self, raw: list[bytes]) -> tuple[Encoded, Encoded]:
        if not raw:
            none = np.zeros(0, np.int64)
            return Encoded(none, none, self.a.size), Encoded(none, none, self.b.size)
        joined = np.frombuffer(b" " + b" ".join(raw), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in raw])
        begin = _segments(joined, ends)
        offsets = np.append(begin, len(joined)).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(begin),
                                    [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        cut = cut.dictionary_encode()
        distinct, at = Distinct(cut.dictionary), cut.indices.to_numpy()
        first = np.searchsorted(begin, np.append(0, ends[:-1]))
        _, ids_a, many_a = _of_segments(self.a, distinct, at, first)
        own, ids_b, many_b = _of_segments(self.b, distinct, at, first)
        if b"".join(map(self.b.label.__getitem__, own.tolist())) != distinct.raw:
            raise _Crossed
        return Encoded(ids_a, many_a, self.a.size), Encoded(ids_b, many_b, self.b.size)

    def overlaps(self, a: Encoded, b: Encoded) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of overlapping tokens, as indices."""
        import pandas as pd          # only where texts are aligned
        left = pd.DataFrame({"doc": a.doc, "start": a.start, "a": np.arange(len(a.ids))}, copy=False)
        right = pd.DataFrame({"doc": b.doc, "start": b.start, "b": np.arange(len(b.ids))}, copy=False)
        over = pd.merge_asof(left, right, on="start", by="doc")["b"].to_numpy()
        back = pd.merge_asof(right, left, on="start", by="doc")["a"].to_numpy()
        new = a.start[back] != b.start         # else the first direction has it
        return (np.concatenate([np.arange(len(over)), back[new]]),
                np.concatenate([over, np.flatnonzero(new)]))

    def align(self, raw: list[bytes], overlaps: bool = False) -> dict[str, pa.Array | np.ndarray]:
        a, b, alive = self.encode(raw)
        i, j = self.overlaps(a, b)
        equal = a.end[i] == b.end[j]
        with_b = np.full(len(a.ids), -1)
        with_b[i[equal]] = j[equal]
        link_a = np.flatnonzero(with_b >= 0)
        link_b = with_b[link_a]
        # group strings: tokens of both sides in the order of groups, A before B
        last_a, last_b = with_b >= 0, np.zeros(len(b.ids), bool)
        last_b[link_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.append(0, link_a + 1), np.append(0, link_b + 1)
        sign_b = last_b.astype(np.int64)
        sign_b[np.cumsum(b.many) - 1] = 2      # nothing behind a text's last token
        word = np.empty(len(a.ids) + len(b.ids), np.int64)
        word[np.arange(len(a.ids)) + upto_b[group_a]] = 3 * a.ids + last_a
        word[np.arange(len(b.ids)) + upto_a[group_b + 1]] = self.shift + 3 * b.ids + sign_b
        spelled = self.words.take(pa.array(word))
        offsets = np.frombuffer(spelled.buffers()[1], np.int64, len(word) + 1)

        def per_text(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(raw), np.int64)
            out[alive] = values
            return out

        n_a, n_b = per_text(a.many), per_text(b.many)
        n_links = per_text(np.bincount(a.doc[link_a], minlength=len(a.many)))
        ends = offsets[np.append(0, np.cumsum(n_a + n_b))]
        links = [(x.ids[k].astype(self.kind).tobytes(), self.kind.itemsize) for x, k in
                 ((a, link_a), (b, link_b))]
        cuts = np.append(0, np.cumsum(n_links)).tolist()
        out = {"n_a": n_a, "n_b": n_b, "n_links": n_links,
               "groups": pa.Array.from_buffers(pa.large_string(), len(raw),
                                               [None, pa.py_buffer(ends), spelled.buffers()[2]])}
        for name, (data, w) in zip(("link_a", "link_b"), links):
            out[name] = pa.array([data[x * w:y * w] for x, y in zip(cuts, cuts[1:])], pa.binary())
        if overlaps:
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            per = per_text(np.bincount(a.doc[i], minlength=len(a.many)))
            # indices within the text
            base_a, base_b = np.cumsum(a.many) - a.many, np.cumsum(b.many) - b.many
            pair = pa.StructArray.from_arrays(
                [pa.array((i - base_a[a.doc[i]]).astype(np.int32)),
                 pa.array((j - base_b[a.doc[i]]).astype(np.int32))], names=["a", "b"])
            out["overlaps"] = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pair)
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, overlaps: bool = False) -> DataFrame:
    """Per document the columns of ``ALIGNED``: the numbers of tokens, groups
    and links, ``groups`` as `a1,a2|b1;a3|b2`, and the linked ids in order
    (little-endian, two bytes each, or four where a vocabulary needs them).
    ``batch`` numbers what was aligned together.  ``overlaps`` adds an array
    of overlapping (a, b) token indices."""
    fields = ALIGNED + (", overlaps array<struct<a: int, b: int>>" if overlaps else "")
    names = [f.name for f in StructType.fromDDL(fields).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(slices(batches, limit=SLICE)):
            got = aligner(path_a, path_b).align(raw_texts(rows), overlaps)
            got |= {"doc_id": rows.column(0), "n_groups": got["n_links"],
                    "batch": np.full(rows.num_rows, task | k // TOGETHER),
                    "groups": got["groups"].cast(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := got[n], pa.Array) else pa.array(x) for n in names], names=names)

    return id_and_text(docs).mapInArrow(run, fields)


def _codes(table, n: np.ndarray) -> np.ndarray:
    """Pairs of ids as one number each, of all rows one after the other."""
    total = int(n.sum())
    out = []
    for name in ("link_a", "link_b"):
        data = b"".join(table.column(name).to_pylist())
        out.append(np.frombuffer(data, f"<u{len(data) // max(total, 1) or 2}", total))
    return out[0].astype(np.int64) << 32 | out[1]


def _runs_of(batch: np.ndarray) -> list[slice]:
    cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(batch)]
    return [slice(x, y) for x, y in zip(cuts, cuts[1:])]


def _coded(aligned: DataFrame) -> tuple[DataFrame, list]:
    """``aligned`` with ``link``, the places of a document's links in its
    batch's list of distinct pairs (two bytes each, or four), instead of the
    ids, and a row for each batch with that list and how often each occurs."""
    fields = [f for f in aligned.schema.fields if f.name not in ("link_a", "link_b", "batch")]
    names = [f.name for f in fields] + ["batch", "link", "pairs", "counts"]
    schema = StructType(fields + StructType.fromDDL(
        "batch bigint, link binary, pairs binary, counts binary").fields)
    columns = aligned.select("batch", *[f.name for f in fields], "link_a", "link_b")

    def told(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(rows)
        n = np.asarray(found["n_links"], np.int64)
        pairs, at, counts = np.unique(_codes(found, n), return_inverse=True, return_counts=True)
        kind = np.dtype("<u2" if len(pairs) <= 1 << 16 else "<u4")
        data, ends = at.astype(kind).tobytes(), (np.cumsum(n) * kind.itemsize).tolist()
        links = [data[e - k * kind.itemsize:e] for e, k in zip(ends, n.tolist())]
        none = pa.nulls(len(links), pa.binary())
        yield from pa.table([*[found[f.name] for f in fields], found["batch"], pa.array(links, pa.binary()),
                             none, none], names).to_batches()
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, found[f.name].type) for f in fields], found["batch"].chunk(0)[:1],
             pa.nulls(1, pa.binary()), pa.array([pairs.tobytes()], pa.binary()),
             pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            for part in _runs_of(np.asarray(rows.column(0))) if rows.num_rows else []:
                if held and held[0].column(0)[0] != rows.column(0)[part.start]:
                    yield from told(held)
                    held = []
                held.append(rows.slice(part.start, part.stop - part.start))
        if held:
            yield from told(held)

    return columns.mapInArrow(run, schema), fields


def with_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` (doc_id, n_links, link_a, link_b, batch and more) without
    links and batch, with n_best, the links whose id pair is counted as often
    as any pair of its B id, and count_sum, the sum of the links' counts.  The
    count of a pair is its number of links in the corpus."""
    coded, fields = _coded(aligned)
    coded = materialize(coded)
    schema = StructType(fields + StructType.fromDDL("n_best bigint, count_sum bigint").fields)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, pairs, n in zip(*(c.to_pylist() for c in rows.columns)):
                pairs, n = np.frombuffer(pairs, np.int64), np.frombuffer(n, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), batch)), pa.array(pairs), pa.array(n)], ["batch", "pair", "n"])

    asked = (coded.filter(F.col("pairs").isNotNull()).select("batch", "pairs", "counts")
             .mapInArrow(spell, "batch bigint, pair bigint, n bigint"))
    counts = (asked.groupBy("pair").agg(F.sum("n").alias("total"))
              .withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("total").alias("most"))
    best = counts.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = asked.select("batch", "pair").join(best, "pair")

    def use(key, rows: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("pair")              # the order of the batch's list
        n = np.asarray(rows["n_links"], np.int64)
        kind, ends = "<u2" if got.num_rows <= 1 << 16 else "<u4", np.cumsum(n)
        at = np.frombuffer(b"".join(rows["link"].to_pylist()), kind)

        def summed(x: np.ndarray) -> pa.Array:
            run = np.append(0, np.cumsum(x[at], dtype=np.int64))
            return pa.array(run[ends] - run[ends - n])

        return pa.table({f.name: rows[f.name] for f in fields}
                        | {"n_best": summed(np.asarray(got["best"])), "count_sum": summed(np.asarray(got["total"]))})

    rows = coded.filter(F.col("link").isNotNull()).drop("pairs", "counts")
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(use, schema)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """a, b, n: how many links of all documents hold the id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "link_a"):
            code, n = np.unique(_codes(rows, np.asarray(rows.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

    return (aligned.select("n_links", "link_a", "link_b").mapInArrow(run, "a bigint, b bigint, n bigint")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))
