"""Language identification with a bidirectional gated recurrent network.

The network reads the bytes of a lower-cased word, once forwards and once
backwards, and labels every position with a distribution over the languages.
A document's distribution pools the log probabilities of all its positions
(their mean, normalised).  It is trained here, in numpy, by backpropagation
through time, on a bounded sample of labelled documents.

One more class, noise, is trained beside the languages on drawn letters of
many scripts (``noise_words``).  It never takes a label away: the label is the
likeliest language of every text that has a letter, the score its probability
among the languages, and the noise's own probability stands beside them, for
filters (``keep_known``).

The context is a parameter, ``PIECE``: state starts anew at every word and
after so many bytes of one, so equal words have equal labels.  Each distinct
word is run through the network once per task's memory, whatever the number of
documents, and the whole of every text counts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
noise 0; repeated rows are labelled alike; without labelled documents
everything is ``und``.  A language that is not learned gets the label of one
that is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, carried, restored, texts

#: Bounds of the training sample: documents, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 2_000, 4_000
#: A language sends so many documents, if it has them, however many there are.
LEAST_DOCS = 50
HIDDEN, STEPS, BATCH, RATE = 12, 260, 512, 0.02
PIECE = 20
MEMO_WORDS = 100_000
UNKNOWN = "und"
#: A document goes when noise is at least so likely.  Held-out documents of
#: sf0.1 reach 0.31, single sentences of everyday prose 0.6; letter gibberish
#: in four alphabets starts at 0.99.
NOISE = 0.9
#: Noise words drawn for training, and first and last letters of the scripts
#: they are drawn from besides the letters of the sample.
NOISE_WORDS = 20_000
_SCRIPTS = ("az", "az", "αω", "ая", "את", "ءي", "अह", "กฮ", "ぁん", "一龥", "가힣")
_LETTER = re.compile(r"[^\W\d_]")


def word_pieces(text: str) -> list[bytes]:
    words = text.lower().encode().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[k:k + PIECE] for w in words for k in range(0, len(w), PIECE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer.  Gates: update z, reset r, candidate n."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
        return {"x": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),
                "u": rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden)).astype(np.float32),
                "b": np.zeros(3 * hidden, np.float32)}

    def forward(self, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
        """seq: (positions, batch) bytes -> (positions, batch, hidden)."""
        x, u, b = self.w["x"], self.w["u"], self.w["b"]
        m = u.shape[0]
        h = np.zeros((seq.shape[1], m), np.float32)
        out = np.empty((*seq.shape, m), np.float32)
        given = x + b
        for t, column in enumerate(seq):
            a, g = given[column], h @ u
            zr = _sigmoid(a[:, :2 * m] + g[:, :2 * m])
            z, r = zr[:, :m], zr[:, m:]
            n = np.tanh(a[:, 2 * m:] + r * g[:, 2 * m:])
            if keep is not None:
                keep.append((h, zr, n, g[:, 2 * m:]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def backward(self, seq: np.ndarray, keep: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        u = self.w["u"]
        m = u.shape[0]
        d_u, d_in = np.zeros_like(u), np.empty((*seq.shape, 3 * m), np.float32)
        d_h = np.zeros_like(d_out[0])
        for t in range(len(seq) - 1, -1, -1):
            before, zr, n, gn = keep[t]
            z, r = zr[:, :m], zr[:, m:]
            d_h = d_h + d_out[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (before - n) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_in[t] = np.concatenate([d_z, d_r, d_n], 1)
            d_g = np.concatenate([d_z, d_r, d_n * r], 1)
            d_u += before.T @ d_g
            d_h = d_h * z + d_g @ u.T
        flat, rows = seq.ravel(), d_in.reshape(-1, 3 * m)
        d_x = np.zeros_like(self.w["x"])
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        d_x[values] = np.add.reduceat(rows[order], first)
        return {"x": d_x, "u": d_u, "b": rows.sum(0)}


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    def _directions(self) -> tuple[Direction, Direction]:
        return tuple(Direction({k[2:]: v for k, v in self.weights.items() if k.startswith(d)})
                     for d in ("f.", "b."))

    def label(self, seq: np.ndarray, keeps: tuple[list, list] | None = None):
        """Log probabilities of every position: (positions, batch, languages
        and noise)."""
        forth, back = self._directions()
        kf, kb = keeps or (None, None)
        h = np.concatenate([forth.forward(seq, kf), back.forward(seq[::-1], kb)[::-1]], 2)
        logits = h @ self.weights["o.w"] + self.weights["o.b"]
        logits -= logits.max(2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(2, keepdims=True)), h

    def word_scores(self, words: list[bytes], block: int = 2048) -> np.ndarray:
        """Per word: summed log probabilities of its positions, and their
        number.  Words of one length go through the network together."""
        out = np.empty((len(words), len(self.languages) + 2), np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            n = int(sizes[order[at]])
            upto = min(at + block, int(np.searchsorted(sizes[order], n, "right")))
            rows = order[at:upto]
            seq = np.frombuffer(b"".join([words[k] for k in rows]), np.uint8).reshape(-1, n).T
            out[rows, :-1] = self.label(seq)[0].sum(0)
            out[rows, -1] = n
            at = upto
        return out


def noise_words(rng: np.random.Generator, letters: str, n: int = NOISE_WORDS) -> list[bytes]:
    """Words of 2 to 12 letters, drawn evenly from one alphabet each: a third
    from ``letters``, the rest from ``_SCRIPTS``; half of the words use only
    some letters of it."""
    out = []
    for _ in range(n):
        first, last = map(ord, _SCRIPTS[rng.integers(len(_SCRIPTS))])
        some = rng.integers(0, 1 << 30, rng.integers(1, 9) if rng.random() < 0.5 else 64)
        own = letters and rng.random() < 1 / 3
        alphabet = [letters[k % len(letters)] if own else chr(first + k % (last - first + 1))
                    for k in some]
        word = "".join(alphabet[k] for k in rng.integers(0, len(alphabet), rng.integers(2, 13)))
        out += word_pieces(word)
    return out


def fit(samples: list[tuple[str, str]], steps: int = STEPS, hidden: int = HIDDEN,
        seed: int = 7) -> Network:
    """Train on (text, language) pairs and on noise, the last class.  Every
    step takes words of one length, drawn by their frequency, as many from
    each language that has the length."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return Network([], {})
    rng = np.random.default_rng(seed)
    by_size: dict[int, list[list[bytes]]] = {}
    for text, lang in samples:
        for w in word_pieces(text):
            by_size.setdefault(len(w), [[] for _ in languages])[languages.index(lang)].append(w)
    sizes = list(by_size)
    mass = np.array([n * sum(map(len, by_size[n])) for n in sizes], float)
    letters = "".join(sorted({c for text, _ in samples for c in text.lower() if _LETTER.match(c)}))
    noise: dict[int, list[bytes]] = {}
    for w in noise_words(rng, letters):
        noise.setdefault(len(w), []).append(w)
    for n, groups in by_size.items():
        groups.append(noise.get(n, []))
    classes = len(languages) + 1
    weights = {f"{d}{k}": v for d in ("f.", "b.") for k, v in Direction.fresh(rng, hidden).items()}
    weights["o.w"] = rng.normal(0, hidden ** -0.5, (2 * hidden, classes)).astype(np.float32)
    weights["o.b"] = np.zeros(classes, np.float32)
    net = Network(languages, weights)
    mean = {k: np.zeros_like(v) for k, v in weights.items()}
    square = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, steps + 1) if sizes else ():
        n = sizes[rng.choice(len(sizes), p=mass / mass.sum())]
        groups = [(k, g) for k, g in enumerate(by_size[n]) if g]
        words, target = [], []
        for k, g in groups:
            take = rng.integers(0, len(g), BATCH // len(groups) + 1)
            words += [g[i] for i in take]
            target += [k] * len(take)
        seq = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).T
        target = np.array(target)
        keeps: tuple[list, list] = ([], [])
        logp, h = net.label(seq, keeps)
        d = np.exp(logp)
        d[:, np.arange(len(target)), target] -= 1
        d /= d.shape[0] * d.shape[1]
        grads = {"o.w": h.reshape(-1, 2 * hidden).T @ d.reshape(-1, d.shape[2]),
                 "o.b": d.sum((0, 1))}
        d_h = d @ weights["o.w"].T
        forth, back = net._directions()
        grads |= {f"f.{k}": v for k, v in forth.backward(seq, keeps[0], d_h[:, :, :hidden]).items()}
        grads |= {f"b.{k}": v for k, v in
                  back.backward(seq[::-1], keeps[1], d_h[::-1, :, hidden:]).items()}
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            weights[k] -= (rate * (mean[k] / (1 - 0.9 ** step))
                           / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shares(counts: dict[str, int], n_docs: int, least: int = LEAST_DOCS) -> int:
    """The number of documents each language may send so that all together
    are about ``n_docs``: what small languages leave goes to the others.  At
    least ``least``, so that every language is learned."""
    left, sizes = n_docs, sorted(counts.values())
    for k, n in enumerate(sizes):
        each = left // (len(sizes) - k)
        if n > each:
            return max(each, least)
        left -= n
    return max(sizes, default=0)


def train(docs: DataFrame, n_docs: int = TRAIN_DOCS, n_chars: int = TRAIN_CHARS) -> Network:
    """Fit on the labelled documents with the smallest hash of doc_id in each
    language among those that are not held out, about ``n_docs`` in all,
    ``n_chars`` characters each.  ``lang`` is taken to have few values."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()
                           & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    each = shares(counts, n_docs)
    # only documents below a language's hash bound with half as many again as
    # needed are looked at, so what partitions send does not grow with their number
    bounds = docs.sparkSession.createDataFrame(
        [(lang, int(min(1.0, 1.5 * each / n) * (1 << 40))) for lang, n in counts.items()],
        "lang string, _bound bigint")
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = (labelled.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"), "doc_id", "lang",
                            F.substring("text", 1, n_chars).alias("text"))
            .join(F.broadcast(bounds), "lang").filter(F.col("h") < F.col("_bound"))
            .withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= each)
            .orderBy("h", "doc_id", "lang", "text").collect())
    return fit([(r["text"], r["lang"]) for r in rows])


class Labeller:
    """A network with a bounded memory of words."""

    def __init__(self, net: Network):
        self.net, self.young, self.old = net, {}, {}

    def scores(self, docs: list[str]) -> np.ndarray:
        """(documents, languages and noise): pooled log probabilities."""
        words = [word_pieces(t) for t in docs]
        need = set().union(*words).difference(self.young)
        for w in need.intersection(self.old):
            self.young[w] = self.old[w]
        new = list(need.difference(self.old))
        width = 4 * (len(self.net.languages) + 2)
        data = self.net.word_scores(new).tobytes()
        self.young.update((w, data[k * width:(k + 1) * width]) for k, w in enumerate(new))
        out = np.zeros((len(docs), len(self.net.languages) + 1))
        for k, ws in enumerate(words):
            if ws:
                total = np.frombuffer(b"".join(map(self.young.__getitem__, ws)), np.float32
                                      ).reshape(len(ws), -1).sum(0, dtype=np.float64)
                out[k] = total[:-1] / total[-1]
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
        return out

    def predict(self, docs: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, their probabilities among the languages, and the noise's
        probability among all classes."""
        known = [k for k, t in enumerate(docs) if t and _LETTER.search(t)]
        labels, sure, noise = [UNKNOWN] * len(docs), np.zeros(len(docs)), np.zeros(len(docs))
        if known and self.net.languages:
            logs = self.scores([docs[k] for k in known])
            every = np.exp(logs - logs.max(1, keepdims=True))
            noise[known] = every[:, -1] / every.sum(1)
            own = np.exp(logs[:, :-1] - logs[:, :-1].max(1, keepdims=True))
            sure[known] = own.max(1) / own.sum(1)
            for k, best in zip(known, own.argmax(1).tolist()):
                labels[k] = self.net.languages[best]
        return labels, sure, noise


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with lang_pred, score and noise.  Only the text is read."""

    def make():
        labeller = Labeller(net)                 # its memory ends with the task

        def compute(b: pa.RecordBatch) -> list:
            labels, sure, noise = labeller.predict(texts(b))
            return [pa.array(labels, pa.string()), pa.array(sure, pa.float64()), pa.array(noise, pa.float64())]

        return compute

    return append_columns(docs, "lang_pred string, score double, noise double", make)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, noise."""
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"),
                   train(docs)).drop("text")


def keep_known(docs: DataFrame, noise: float = NOISE) -> DataFrame:
    """The rows of ``docs`` that have a letter and are noise with less
    probability than ``noise``."""
    net = train(docs)
    if not net.languages:                        # nothing to learn from: any letter will do
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(carried(docs, "text"), net)
    return restored(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("noise") < noise)), docs)
