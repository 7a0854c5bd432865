"""Rows without a doc_id, beside others and alone."""

import public_tokenizers
import pytest

import corpus_pipeline as cp
from marketgrid.llm import (bpe_automaton, bwt_dedup, language_id, near_dedup, packing,
                            quality_rules, substring_dedup, token_files, winnowing)

from .conftest import words

TEXT = words(7, 90)
ROWS = [(None, TEXT, "en", "s", 1), (1, TEXT, "en", "s", 1), (None, None, None, None, None),
        (2, TEXT, None, None, None), (None, TEXT, "en", "s", 1)]


@pytest.fixture(scope="module", params=[ROWS, ROWS[:1]])
def rows(request, spark):
    return spark.createDataFrame(request.param, "doc_id bigint, text string, lang string, "
                                                "source string, n_chars bigint")


def test_row_counts(spark, rows):
    n = rows.count()
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (near_dedup.near_duplicates(rows), winnowing.edited_and_next(rows),
                bpe_automaton.round_trip(rows, path), substring_dedup.repeated(rows),
                bwt_dedup.repeated(rows), quality_rules.quality(rows),
                language_id.identify(rows), packing.pack(rows)):
        assert out.count() == n
    folder = token_files.new_folder(rows)
    token_files.write(rows, public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    assert token_files.read(spark, folder).count() == n


def test_order_and_links(rows):
    if rows.count() == 1:
        return
    links = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect()}
    assert links == {(None, None, True), (1, 1, True), (2, 1, False)}
    gone = sorted((str(r.doc_id), r._n_removed) for r in substring_dedup.repeated(rows).collect())
    assert gone == [("1", 0), ("2", 90), ("None", 0), ("None", 90), ("None", 90)]


def test_stages(spark, rows):
    for name, stage in cp.STAGES:
        out = stage(spark, rows, "")
        assert out.count() <= rows.count()
