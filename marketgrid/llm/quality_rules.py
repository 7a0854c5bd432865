"""Quality rules with thresholds that follow the data.

Every text gets counts of words, symbols, repeated lines and repeated 3-word
windows, and ratios of them.  For each (language, source) a quantile sketch of
every ratio is built; the sketches are mergeable, so each task sends one small
sketch per group and no group has to sit in one place.  The fence of a ratio
is its upper quartile plus ``width`` times the spread (upper minus lower
quartile, at least a floor per ratio); the mean word length has a lower fence
too.  The fences are joined back to the documents, and a document outside any
fence, or one that fails the base rule, is rejected.

A group's own quartile is a junk value once a quarter of the group is junk, so
the sketches are merged upwards as well, per language and over the corpus, and
no group's fence lies outside a merged one.  The merged fences are built from
the median and twice the distance to its nearer quartile in place of the
quartiles, so they hold up to about half of junk.  The mean word length, which
has usual values on both sides of a median, keeps its quartiles there and so
holds up to a quarter.  The corpus bounds only the ratios that do not depend
on the script and spelling of a language (``ANY_LANGUAGE``).

The base rule: fewer than 50 words, or more than half of the words in
repeated 3-word windows.  Sketches cover the documents that pass it.

Edge cases: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; a group of one document keeps
it within the merged fences (its ratios are its quartiles); a source that is
unusual for its language and for the corpus is rejected however uniform it
is; repeated rows are judged alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach_scalars
from ..operators.lineage import materialize
from .common import append_columns, carried, restored, texts

_SPACE = b"\t\n\v\f\r "
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")

#: ratio -> smallest spread; with a width of 3 no fence is nearer than three
#: times this to the quartile.
FLOORS = {"symbol_ratio": 0.02, "dup_line_ratio": 0.12, "repeat_ratio": 0.1,
          "capital_ratio": 0.04, "mean_word": 0.5}
#: ratios with a lower fence as well
TWO_SIDED = ("mean_word",)
#: ratios bounded over the whole corpus as well
ANY_LANGUAGE = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "n_lines", "n_capitals")
_TAG = "_quality_"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    v = len(numbers)
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * v + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_COUNTS``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(raw.translate(None, _SPACE + _CONTINUED)),
            len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(_CAPITALS.findall(text)))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with its counts (columns ``_quality_*``)."""

    def compute(b: pa.RecordBatch) -> list:
        table = np.array([counts(t) for t in texts(b)], np.int64).reshape(-1, len(_COUNTS))
        return [pa.array(table[:, k]) for k in range(len(_COUNTS))]

    return append_columns(docs, ", ".join(f"{_TAG}{c} bigint" for c in _COUNTS), lambda: compute)


def _count(name: str) -> Column:
    return F.col(_TAG + name)


def _ratio(top: str, bottom: str) -> Column:
    return F.when(_count(bottom) > 0, _count(top) / _count(bottom)).otherwise(F.lit(0.0))


def _ratios() -> dict[str, Column]:
    return {"symbol_ratio": _ratio("n_symbols", "word_chars"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": _ratio("n_repeat_words", "n_words"),
            "capital_ratio": _ratio("n_capitals", "word_chars"),
            "mean_word": _ratio("word_chars", "n_words")}


def base_failed() -> Column:
    return (_count("n_words") < 50) | (100 * _count("n_repeat_words") > 50 * _count("n_words"))


def _fence(name: str, lo: Column, hi: Column, width: float) -> tuple[Column, Column]:
    spread = F.greatest(hi - lo, F.lit(FLOORS[name])) * width
    return lo - spread, hi + spread


def _merged_fence(name: str, width: float) -> tuple[Column, Column]:
    lo, mid, hi = (F.col(name)[k] for k in range(3))
    if name in TWO_SIDED:
        return _fence(name, lo, hi, width)
    half = F.least(mid - lo, hi - mid)
    return _fence(name, mid - half, mid + half, width)


def fences(measured: DataFrame, width: float = 3.0, accuracy: int = 10_000) -> DataFrame:
    """One row per (lang, source): _lang, _source, and per ratio its fences."""
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    passed = measured.filter(~base_failed()).select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        *[c.alias(name) for name, c in _ratios().items()])
    keys = [F.col("_lang"), F.col("_source")]
    sketched = materialize(
        passed.groupingSets([keys, keys[:1], []], *keys)
        .agg(F.grouping_id().cast("int").alias("_level"),
             *[F.percentile_approx(name, quartiles, accuracy).alias(name) for name in FLOORS]))

    def merged(tag: str, names) -> list[Column]:
        return [c.alias(f"{tag}{name}_{side}") for name in names
                for side, c in zip(("low", "high"), _merged_fence(name, width))]

    per_group = sketched.filter(F.col("_level") == 0)
    per_lang = sketched.filter(F.col("_level") == 1).select(
        F.col("_lang").alias("_of_lang"), *merged("_lang_", FLOORS))
    corpus = sketched.filter(F.col("_level") == 3).select(*merged("_corpus_", ANY_LANGUAGE))
    out = []
    for name in FLOORS:
        low, high = _fence(name, F.col(name)[0], F.col(name)[2], width)
        tags = ["_lang_", "_corpus_"] if name in ANY_LANGUAGE else ["_lang_"]
        out += [F.greatest(low, *[F.col(f"{t}{name}_low") for t in tags]).alias(f"{name}_low"),
                F.least(high, *[F.col(f"{t}{name}_high") for t in tags]).alias(f"{name}_high")]
    return (per_group.join(F.broadcast(per_lang), F.col("_lang").eqNullSafe(F.col("_of_lang")), "left")
            .transform(attach_scalars, corpus).select("_lang", "_source", *out))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, the ratios and ``kept``."""
    outside = F.lit(False)
    for name, ratio in _ratios().items():
        outside = outside | F.coalesce(ratio > F.col(f"{name}_high"), F.lit(False))
        if name in TWO_SIDED:
            outside = outside | F.coalesce(ratio < F.col(f"{name}_low"), F.lit(False))
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["_lang"])
                           & measured["source"].eqNullSafe(limits["_source"]), "left")
    return joined.select(*[measured[c] for c in measured.columns],
                         base_failed().alias(f"{_TAG}base_failed"),
                         *[r.alias(_TAG + name) for name, r in _ratios().items()],
                         (~base_failed() & ~outside).alias(f"{_TAG}kept"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the ratios and kept."""
    measured = materialize(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    judged = judge(measured, fences(measured))
    return judged.select("doc_id", *[F.col(c).alias(c[len(_TAG):]) for c in judged.columns
                                     if c.startswith(_TAG)])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged.  Texts are counted
    twice (for the fences, and again beside the verdict) so that they need
    not be shuffled."""
    limits = materialize(fences(measure(docs.select("text", "lang", "source"))))
    own = carried(docs, "text", "lang", "source")
    return restored(judge(measure(own), limits).filter(F.col(f"{_TAG}kept")), docs)
