import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import SF_SMALL
from tokenizers import Tokenizer

from marketgrid.llm import alignment as al
from marketgrid.llm.bpe_automaton import byte_alphabet
from marketgrid.llm.queries import QUERIES

from .conftest import odd_rows
from .test_tokens import fuzz

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    alphabet = byte_alphabet()
    label = {i: bytes(alphabet[c] for c in t)
             for t, i in a.get_vocab(with_added_tokens=True).items() if set(t) <= set(alphabet)}
    return a, label, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, libs):
    """(ids, ends) of both sides, by the libraries alone."""
    a, label, b = libs
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = ([label[i] for i in ids[0]],
           [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
            else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]])
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    return [(i, np.cumsum([len(t) for t in r]).tolist()) for i, r in zip(ids, raw)]


def brute(text, libs):
    """(n_a, n_b, groups, links, overlaps)"""
    got = tokens(text, libs)
    if got is None:
        return 0, 0, "", [], []
    (a, ea), (b, eb) = got
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] == eb[j]]
    groups, x, y = [], 0, 0
    for i, j in links:
        groups.append(",".join(map(str, a[x:i + 1])) + "|" + ",".join(map(str, b[y:j + 1])))
        x, y = i + 1, j + 1
    sa, sb = [0, *ea], [0, *eb]
    over = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(ea[i], eb[j])]
    return len(a), len(b), ";".join(groups), [(a[i], b[j]) for i, j in links], over


def held(got, k, texts, libs):
    n_a, n_b, groups, links, over = brute(texts[k], libs)
    assert (got["n_a"][k], got["n_b"][k], got["n_links"][k]) == (n_a, n_b, len(links))
    assert got["groups"][k].as_py() == groups
    ids = [np.frombuffer(got[c][k].as_py(), "<u2").tolist() for c in ("link_a", "link_b")]
    assert list(zip(*ids)) == links
    assert [(o["a"], o["b"]) for o in got["overlaps"][k].as_py()] == over


def test_groups_links_overlaps_equal_brute_force(libs):
    aligner = al.aligner(A, B)
    texts = fuzz(7, 1200) + ["", " ", "a", "a ", " a", "  ", "x" * 300, "漢字 漢字 " * 20, "a  b   c \n d",
                             "<|endoftext|> <s></s> <0x41>", "é ﬁ 　 x"]
    for k in range(0, len(texts), 150):
        part = texts[k:k + 150]
        got = aligner.align([t.encode() for t in part], overlaps=True)
        for i in range(len(part)):
            held(got, i, part, libs)


def test_texts_that_are_not_given_back_have_no_tokens(libs):
    texts = ["plain words here", "a▁b c", "▁", "", "more plain words"]
    got = al.aligner(A, B).align([t.encode() for t in texts], overlaps=True)
    for i in range(len(texts)):
        held(got, i, texts, libs)
    assert got["n_a"].tolist()[1:4] == [0, 0, 0] and got["n_a"][0] > 0
    assert al.aligner(A, B).align([], overlaps=True)["n_a"].tolist() == []


@pytest.mark.parametrize("text", [" " * 40_000 + "x", "ab" * 30_000, "\n \t" * 9_000 + "y z",
                                  "w " + "é" * 25_000 + " v"])
def test_long_runs(text, libs):
    got = al.aligner(A, B).align([b"some words", text.encode(), b"others"])
    (a, ea), (b, eb) = tokens(text, libs)
    assert (got["n_a"][1], got["n_b"][1]) == (len(a), len(b))
    assert got["n_links"][1] == len(set(ea) & set(eb))


def digests(texts, libs):
    """The columns of op11 for {doc_id: text}."""
    rows = [brute(t, libs) for _, t in texts]
    count = Counter(p for r in rows for p in r[3])
    most = Counter()
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted((d, r[0], r[1], len(r[3]), len(r[3]), sum(count[p] == most[p[1]] for p in r[3]),
                   sum(count[p] for p in r[3]),
                   hashlib.sha256(r[2].encode()).hexdigest() if r[2] else "") for (d, _), r in zip(texts, rows))


def query(docs):
    from pyspark.sql import functions as F
    aligned = al.align(docs, A, B)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    out = al.with_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))
    return sorted(map(tuple, out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                        "groups_sha256").collect()))


def test_odd_rows(odd, empty, libs):
    assert query(odd) == digests([(r[0], r[1]) for r in odd_rows()], libs)
    assert query(empty) == []


def test_counts_over_many_batches(odd, libs, monkeypatch):
    monkeypatch.setattr(al, "SLICE", 500)
    monkeypatch.setattr(al, "TOGETHER", 1)
    assert query(odd) == digests([(r[0], r[1]) for r in odd_rows()], libs)
    pairs = {(r.a, r.b): r.n for r in al.count_pairs(al.align(odd, A, B)).collect()}
    assert pairs == Counter(p for r in odd_rows() for p in brute(r[1], libs)[3])


def test_query_equals_brute_force(spark, libs):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows]
    got = sorted(map(tuple, QUERIES["op11_token_alignment"](spark, SF_SMALL).collect()))
    assert got == digests_fast(rows, libs)


def digests_fast(rows, libs):
    """As ``digests``, with sets of ends instead of all pairs of tokens."""
    per, count, most = [], Counter(), Counter()
    for d, t in rows:
        got = tokens(t, libs)
        if got is None:
            per.append((d, 0, 0, [], ""))
            continue
        (a, ea), (b, eb) = got
        at_b = {e: j for j, e in enumerate(eb)}
        links, groups, x, y = [], [], 0, 0
        for i, e in enumerate(ea):
            if e in at_b:
                j = at_b[e]
                links.append((a[i], b[j]))
                groups.append(",".join(map(str, a[x:i + 1])) + "|" + ",".join(map(str, b[y:j + 1])))
                x, y = i + 1, j + 1
        count.update(links)
        per.append((d, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted((d, na, nb, len(ls), len(ls), sum(count[p] == most[p[1]] for p in ls),
                   sum(count[p] for p in ls), h) for d, na, nb, ls, h in per)
