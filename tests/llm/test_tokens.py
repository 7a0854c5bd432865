import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from helpers import SF_SMALL
from tokenizers import Tokenizer

from marketgrid.llm import bpe_automaton as ba
from marketgrid.llm import token_files as tf

from .conftest import odd_rows

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PARTS = list("aaabbcdeSTVLRMDZQ  \n\t'stlvrmd.,!?0159éèÉßŒµªº日本語  \u0085\x1c\x1f​😀́İΣ<|>ÀÖ×÷K") + [
    "<|endoftext|>", "<|STARTOFTEXT|>", " the", "'ll", " 's", "'S", "     "]


def fuzz(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_automaton_equals_library():
    lib, a = Tokenizer.from_file(BYTE_BPE), ba.automaton(BYTE_BPE)
    texts = fuzz(1, 4000) + ["a" * 3000, " " * 500, "\n\n\n x"]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        ids = a.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert a.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_gadgets_give_exactly_the_right_paths():
    """Small merge lists, all strings: the automaton accepts one path, the one
    that merging in rule order gives."""
    import itertools
    vocab = {c: k for k, c in enumerate("abc")}
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "c"), ("aa", "aa"), ("ab", "c")]
    for k, (u, v) in enumerate(merges):
        vocab[u + v] = 3 + k
    a = ba.Automaton(vocab, [list(m) for m in merges], {})
    for n in range(1, 8):
        for letters in itertools.product("abc", repeat=n):
            parts = list(letters)
            for u, v in merges:                  # textbook order of rules, left to right
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (u, v):
                        parts[k:k + 2] = [u + v]
                    k += 1
            ids = np.frombuffer(a._encode_word("".join(letters)), "<u4").tolist()
            assert ids == [vocab[p] for p in parts]


def test_round_trip_odd(odd, empty):
    lib = Tokenizer.from_file(BYTE_BPE)
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    got = ba.round_trip(odd, BYTE_BPE)
    assert {r.doc_id: r.text for r in ba.decode_ids(got, BYTE_BPE).collect()} == texts
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode(
            texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == texts[r.doc_id]
    assert ba.round_trip(empty, BYTE_BPE).count() == 0


def test_op3_query(spark):
    from marketgrid.llm.queries import QUERIES
    lib = Tokenizer.from_file(BYTE_BPE)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op3_bpe_round_trip"](spark, SF_SMALL).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_code_round_trip():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2 ** int(rng.integers(1, 33)), int(rng.integers(0, 60))).astype(np.uint32)
            for _ in range(400)]
    coded = [tf.pack(d) for d in docs]
    back = tf.unpack(b"".join(c for c, _ in coded), b"".join(d for _, d in coded),
                     np.array([len(d) for d in docs]))
    assert (back == np.concatenate(docs)).all()
    assert len(tf.unpack(b"", b"", np.zeros(3, np.int64))) == 0


def test_words_equal_library():
    lib, enc = Tokenizer.from_file(WORD_BPE), tf.WordEncoder(WORD_BPE)
    texts = fuzz(2, 6000)
    got = [x for k in range(0, len(texts), 500) for x in enc.encode(pa.array(texts[k:k + 500]))]
    for x, e in zip(got, lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(x, enc.kind).tolist() == e.ids


def check_files(spark, docs, shard_docs):
    lib = Tokenizer.from_file(WORD_BPE)
    folder = tf.new_folder(docs)
    tf.write(docs, WORD_BPE, 2, folder, shard_docs)
    rows = sorted(tf.read(spark, folder).collect(), key=lambda r: (r.doc_id, r.start))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    start = 0
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    counts = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.n for r in counts] == sorted((r.n for r in counts), reverse=True)
    return len(rows)


def test_files(spark, odd, empty):
    assert check_files(spark, odd, 4) == len(odd_rows())
    assert check_files(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"), 50) == 200
    assert check_files(spark, empty, 4) == 0


def test_op4_query(spark):
    from marketgrid.llm.queries import QUERIES
    lib = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in QUERIES["op4_token_files"](spark, SF_SMALL).collect()}
    start = 0
    for d in docs:
        ids = lib.encode(d.text, add_special_tokens=False).ids + [2]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_memories_are_bounded_by_bytes():
    """Long words do not stay: base64, unspaced scripts."""
    from marketgrid.llm.common import TwoGenerations
    memo = TwoGenerations(lambda w: w.encode(), 100_000)
    for k in range(300):
        assert memo[f"{k}" * 2000] == (f"{k}" * 2000).encode()
        assert memo["again"] == b"again"
        assert memo.held <= 100_000 + 13_000
    assert len(memo) + len(memo.old) < 300
    enc = tf.WordEncoder(WORD_BPE)
    lib = Tokenizer.from_file(WORD_BPE)
    for k in range(5):
        texts = [f"x{k}" * 300 + " the cat", "日本" * 200 + f" {k}", "qwertz" * 50 + f"{k}é " + "ab" * 100]
        for t, ids in zip(texts, enc.encode(pa.array(texts))):
            assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids
    enc.encode(pa.array(["the end"]))
    assert max(map(len, [*enc.pieces, *enc.young, *enc.old])) <= tf.FAR


def test_shards_are_bounded(spark, odd, monkeypatch):
    monkeypatch.setattr(tf, "SHARDS", 3)
    folder = tf.new_folder(odd)
    tf.write(odd, WORD_BPE, 2, folder, shard_docs=1)
    shards = {r.shard for r in spark.read.parquet(f"{folder}/shards").select("shard").collect()}
    assert len(shards) <= 3
    rows = tf.read(spark, folder).orderBy("start").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_words_in_use_survive_a_full_memory(monkeypatch):
    """Only words that are new are learned, also when the memory is emptied."""
    monkeypatch.setattr(tf, "MEMO_WORDS", 10)
    lib, enc = Tokenizer.from_file(WORD_BPE), tf.WordEncoder(WORD_BPE)
    learned, learn = [], enc._learn_pieces
    monkeypatch.setattr(enc, "_learn_pieces", lambda pieces: (learned.append(sorted(pieces)), learn(pieces)))
    same = " ".join(f"{a}{b}" for a in ("the", "cat", "ran") for b in "abcdefghi")
    for k in range(4):
        text = f"{same} new{'xyzw'[k]}"
        ids, = enc.encode(pa.array([text]))
        assert np.frombuffer(ids, enc.kind).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(enc.pieces) > 2 * tf.MEMO_WORDS
    assert learned[1:] == [[b"newy"], [b"newz"], [b"neww"]]


def test_rows_packed_at_once_equal_rows_packed_alone():
    rng = np.random.default_rng(1)
    for top in (8, 16, 17, 32):
        docs = [rng.integers(0, 2 ** top, int(n)).astype(np.uint32) for n in rng.integers(0, 40, 200)]
        counts = np.array([len(d) for d in docs], np.int64)
        control, data = tf.pack_rows(np.concatenate(docs), counts)
        assert list(zip(control.to_pylist(), data.to_pylist())) == [tf.pack(d) for d in docs]
        assert (tf.unpack(b"".join(control.to_pylist()), b"".join(data.to_pylist()), counts)
                == np.concatenate(docs)).all()
    control, data = tf.pack_rows(np.zeros(0, np.uint32), np.zeros(0, np.int64))
    assert len(control) == len(data) == 0


def test_slices_and_wide_strings():
    lib, enc = Tokenizer.from_file(WORD_BPE), tf.WordEncoder(WORD_BPE)
    texts = ["gone", "École 12 cats!", "", "<|endoftext|> x", "日本 the", " ÀÉ\t", "gone"]
    for kind in (pa.string(), pa.large_string()):
        for part in (pa.array(texts, kind).slice(1, 5), pa.array(texts, kind).slice(2, 1), pa.array([], kind)):
            for x, t in zip(enc.encode(part), part.to_pylist(), strict=True):
                assert np.frombuffer(x, enc.kind).tolist() == lib.encode(t, add_special_tokens=False).ids
