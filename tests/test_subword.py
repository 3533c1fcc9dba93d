"""Subword learning: sorted suffixes, tries, lattices and EM rounds against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemix.operators import lattice, subword
from codemix.session import stored

WORDS = "word string, cnt bigint"


def plain_substrings(words, longest, least):
    found = Counter()
    for w, c in words:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if longest is None or j - i <= longest:
                    found[w[i:j]] += c
    return {p: n for p, n in found.items() if len(p) == 1 or n >= least}


def random_words(rng, n, letters="ab▁é😀"):
    return list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): rng.randint(1, 3) for _ in range(n)}.items())


@pytest.mark.parametrize("longest, least, cells", [(16, 2, 1 << 21), (3, 1, 40), (None, 2, 60), (2, 5, 1)])
def test_substrings_equal_brute_force(spark, monkeypatch, longest, least, cells):
    monkeypatch.setattr(subword, "RUN_CELLS", cells)
    monkeypatch.setattr(subword, "SUFFIX_ROWS", 7)
    words = random_words(random.Random(5), 120) + [("x" * 40, 1), ("ab" * 30, 2)]
    got = subword.substrings(spark.createDataFrame(words, WORDS), longest, least).collect()
    assert len(got) == len({r["piece"] for r in got})
    assert {r["piece"]: r["freq"] for r in got} == plain_substrings(words, longest, least)
    assert all(r["len"] == len(r["piece"]) for r in got)


def test_substrings_of_nothing(spark):
    assert subword.substrings(spark.createDataFrame([], WORDS)).collect() == []


def test_suffixes_travel_cut(spark):
    got = subword.suffixes(spark.createDataFrame([("abcdef", 2), ("ef", 1)], WORDS), 3).collect()
    assert {r["suffix"]: r["cnt"] for r in got} == {"abc": 2, "bcd": 2, "cde": 2, "def": 2, "ef": 3, "f": 3}


def random_model(rng, words):
    pieces = {c for w, _ in words for c in w if c != "😀"}
    pieces |= {w[i:i + rng.randint(1, 5)] for w, _ in words for i in range(len(w)) if rng.random() < 0.3}
    return {p: -rng.random() * 9 - 0.5 for p in pieces}


def test_lattice_equals_the_word_by_word_sums():
    rng = random.Random(8)
    words = random_words(rng, 300) + [("ab" * 400, 1)]
    model = random_model(rng, words)
    trie = lattice.Trie(list(model), np.array(list(model.values())))
    lat = lattice.Lattice([w for w, _ in words], trie)
    uses, likelihood = lat.expected(np.array([c for _, c in words], float), len(trie.piece))
    want = Counter()
    for w, c in words:
        for p, x in subword.expected_pieces(w, model).items():
            want[p] += c * x
    got = {trie.pieces[trie.piece[k]]: uses[k] for k in np.flatnonzero(uses)}
    assert got.keys() == {p for p, x in want.items() if x > 0}
    assert all(got[p] == pytest.approx(want[p]) for p in got)
    assert math.isfinite(likelihood) and likelihood < 0


def test_segments_equal_the_word_by_word_search(monkeypatch):
    rng = random.Random(2)
    words = random_words(rng, 300)
    model = random_model(rng, words)
    model |= {p: -2.0 * len(p) for p in ("a", "b", "ab", "aba", "bab")}  # ties
    trie = lattice.Trie(list(model), np.array(list(model.values())))
    texts = [w for w, _ in words] + [""]
    monkeypatch.setattr(lattice, "BATCH_CHARS", 50)
    assert lattice.segment(texts, trie) == [subword.viterbi(w, model)[0] for w in texts]
    split = lattice.Lattice(texts, trie, whole=False, unknown=lattice.UNKNOWN_COST)
    score = split.best()[0][split.last]
    assert [pytest.approx(subword.viterbi(w, model, w)[1]) for w in texts if len(w) > 1] == [
        s for w, s in zip(texts, score) if len(w) > 1]


def test_no_model_and_no_words():
    empty = lattice.Trie([], np.zeros(0))
    assert lattice.segment(["ab", ""], empty) == [["a", "b"], []]
    assert lattice.segment([], empty) == []


def test_em_never_lowers_the_likelihood(spark):
    counts = spark.createDataFrame(random_words(random.Random(4), 80, "abc"), WORDS)
    model = subword.normalised(subword.substrings(counts, 4, 1).select("piece", F.lit(1.0).alias("expected")), 0.0)
    last = -math.inf
    for _ in range(4):
        found = stored(subword.expectation(counts, model))
        now = found.filter("piece IS NULL").first()["expected"]
        assert now >= last - 1e-9
        last = now
        model = subword.normalised(found, 1e-12)
    assert model.agg(F.sum(F.exp("logp"))).first()[0] == pytest.approx(1.0)


def test_learned_model_keeps_characters_and_its_size(spark):
    text = ["low lower lowest", "new newer newest", "slow slower", "wide wider widest"] * 3
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(text)], "sent_id bigint, words array<string>")
    model = {r["piece"]: r["logp"] for r in subword.learn_model(df, 30, seed_size=60).collect()}
    assert len(model) <= 30 and set("lowernstid" + subword.MARK) <= set(model)
    assert subword.learn_model(df.limit(0), 30).collect() == []
