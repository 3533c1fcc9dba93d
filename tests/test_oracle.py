"""Registered queries against their SQL on the smallest tables.

``python tests/oracle_check.py`` runs all of them at sf0.01.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "phrase_extraction", "phrase_extraction_one_to_one", "code_switch_bilingual", "code_switch_multilingual",
    "switch_report", "lexicon_substitution_per_word", "lexicon_read", "read_lines", "write_parallel", "load_split",
    "generation_log", "mix_training_one_part", "bidirectional_pairs", "slice_by_language", "build_vocabulary",
    "encode_ids", "decode_ids", "bpe_round_trip", "subsample_weighted", "subsample_replace_weighted", "pack_batches",
    "zip_lines", "subsample_replace_fractions", "segment_words", "prepare_ids", "subword_seeds", "subword_em_round", "score_log", "switch_totals",
    "alignment_dropped", "compatible_sets", "corpus_bleu_13a", "corpus_bleu_zh", "corpus_bleu_pieces", "upsample_concat",
    "length_buckets", "corpus_bleu", "contrastive_loss", "align_embeddings", "tokenize_corpus",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
