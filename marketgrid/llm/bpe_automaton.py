"""BPE encoding and decoding with a token automaton.

The merge list is compiled into a deterministic automaton whose arcs are
labelled with tokens.  At the start there is one arc per byte and every arc
may follow every other one.  Merge rule number k, (u, v) -> uv, adds one
gadget to the automaton:

* the step from u to v is closed (a text in which u meets v holds uv instead);
* the arc uv leaves every state that u may leave after that closing (the
  *column* of uv is a copy of u's);
* uv enters a copy of the state that v entered before the closing (the *row*
  of uv is a copy of v's).

After the last rule the paths of the automaton are exactly the right
tokenizations, and every string has one path.  A copy is kept as a reference
(which arc, as of which rule), and an entry of the transition table is filled
from those references the first time it is used: the whole table would have
|V|^2 entries, of which a corpus touches a tiny part.

Encoding a pre-split word looks for its only path: from each state the longest
arc that the table allows is tried first, and a (position, arc) pair found
without a way on is never entered again, so the work is bounded by the word's
length times the longest label.  Decoding emits the labels of the arcs.

Edge cases: a null or empty text has no ids and decodes to ''.  Strings of
added tokens inside a text become their ids, as the tokenizers library does
with default settings.  A file with another normalizer, pre-tokenizer or
model option than byte-level BPE is refused with ValueError.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import TwoGenerations, id_and_text, slices

#: Fixed value: the byte-level pre-tokenizer's split pattern.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Bytes of words and their ids remembered per generation in a worker.
MEMO_BYTES = 36 << 20


def byte_alphabet() -> dict[str, int]:
    """Character of a vocabulary file -> byte: visible Latin-1 characters
    stand for themselves, the other bytes for U+0100, U+0101, ..."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list, added: dict[str, int]):
        alphabet = byte_alphabet()
        self.label: dict[int, bytes] = {
            i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.added = added
        self.added_split = (re.compile("(" + "|".join(
            re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None)
        # gadgets: rule number, left and right part of every arc
        self.born: dict[int, int] = {i: -1 for i in vocab.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.closed: dict[tuple[int, int], int] = {}
        for k, rule in enumerate(merges):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            u, v, uv = vocab[left], vocab[right], vocab[left + right]
            if uv in self.parts:
                raise ValueError(f"two merges make {left + right!r}")
            self.closed[u, v] = k
            self.born[uv], self.parts[uv] = k, (u, v)
        self.rules = len(merges)
        self.arc_of = self._arcs()
        self.longest = max(map(len, self.arc_of), default=1)
        self.label |= {i: token.encode() for token, i in added.items()}
        self.table: dict[int, bool] = {}
        self.words = TwoGenerations(self._encode_word, MEMO_BYTES)
        self.pattern = regex.compile(SPLIT)

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "end_of_word_suffix",
                                               "continuing_subword_prefix", "ignore_merges"))
        if not (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        return cls(model["vocab"], model["merges"],
                   {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def _open(self, u: int, v: int, before: int) -> bool:
        """Whether arc v may follow arc u as of rule ``before``: follow the
        copies back to the rules that made them."""
        born, parts, closed = self.born, self.parts, self.closed
        while True:
            if closed.get((u, v), before) < before:
                return False
            bu, bv = born[u], born[v]
            if bu < 0 and bv < 0:
                return True
            if bu == bv:                        # an arc after itself
                u, v, before = parts[u][1], parts[v][0], bu
            elif bu > bv:                       # row copied before the closing
                u, before = parts[u][1], bu
            else:                               # column copied after it
                v, before = parts[v][0], bv + 1

    def _arcs(self) -> dict[bytes, int]:
        """Label -> arc, without arcs whose gadget found no path from u to v
        (the rule never applies, so no text holds the token)."""
        made = {i for i, b in self.born.items() if b < 0}
        for uv, (u, v) in self.parts.items():   # in the order of the rules
            if u in made and v in made and self._open(u, v, self.born[uv]):
                made.add(uv)
        return {label: i for i, label in self.label.items() if i in made}

    def _encode_word(self, word: str) -> bytes:
        text = word.encode()
        n, pos, state = len(text), 0, -1
        arc_of, longest, table = self.arc_of.get, self.longest, self.table
        if len(table) > 1_000_000:
            table.clear()
        path: list[int] = []
        dead: set[tuple[int, int]] = set()      # (position, arc) without a way on
        size = min(n, longest)
        while pos < n:
            while size:
                arc = arc_of(text[pos:pos + size])
                if arc is not None and (pos + size, arc) not in dead:
                    if state < 0:
                        break
                    key = state << 24 | arc
                    ok = table.get(key)
                    if ok is None:
                        ok = table[key] = self._open(state, arc, self.rules)
                    if ok:
                        break
                size -= 1
            if size:
                path.append(arc)
                pos, state, size = pos + size, arc, min(longest, n - pos - size)
            else:                               # back to the arc before, then a shorter one
                arc = path.pop()
                dead.add((pos, arc))
                size = len(self.label[arc])
                pos, state, size = pos - size, path[-1] if path else -1, size - 1
        return b"".join([i.to_bytes(4, "little") for i in path])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.added_split is not None:
            pieces = self.added_split.split(text)
            if len(pieces) > 1:
                return b"".join(self.added[p].to_bytes(4, "little") if k % 2 else self._plain(p)
                                for k, p in enumerate(pieces))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist())
                        ).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    """One compiled automaton per worker process and file."""
    return Automaton.from_file(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), decoded (string) of every
    whole text.  Null text: no ids, ''.  Repeated rows give repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in slices(batches):
            ids = [a.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()),
                 pa.array([a.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids (as ``round_trip`` makes them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([a.decode(x or b"") for x in b.column(1).to_pylist()],
                                       pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
