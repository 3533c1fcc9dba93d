"""Subword vocabularies: unigram model learning, encoding, BPE application.

Counting, expectation and selection are Spark jobs over distinct words; the
model is a stored table bounded by a size parameter, which workers read.
Lattices are walked for whole batches of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codemix.operators.lattice import UNKNOWN_COST, Lattice, batches as lattice_batches, load, repeats, segment
from codemix.operators.sample import sample_n, smallest
from codemix.session import discard, stored

MARK = "▁"
#: Longest piece that is proposed when a model is learned; models with longer pieces are used in full.
MAX_PIECE = 16
SEED_SIZE = 1_000_000
#: Suffixes a task holds before it sends them, and characters of a sorted run that are compared at once.
SUFFIX_ROWS, RUN_CELLS = 1 << 14, 1 << 21
MIN_EXPECTED = 0.5


def longest_piece(model: dict[str, float]) -> int:
    return max(map(len, model), default=1)


def viterbi(word: str, model: dict[str, float], skip: str | None = None,
            longest: int | None = None) -> tuple[list[str], float]:
    """Best segmentation; a character without a piece stands alone at a high cost.

    ``longest`` is the length of the model's longest piece; it is looked up when not given.
    """
    longest = longest_piece(model) if longest is None else longest
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            piece = word[start:end]
            logp = model.get(piece) if piece != skip else None
            if logp is None:
                if end - start > 1:
                    continue
                logp = UNKNOWN_COST
            score = best[start][0] + logp
            if score > best[end][0]:
                best[end] = (score, start)
    pieces, end = [], len(word)
    while end:
        start = best[end][1]
        pieces.append(word[start:end])
        end = start
    return pieces[::-1], best[len(word)][0]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def expected_pieces(word: str, model: dict[str, float], longest: int | None = None) -> dict[str, float]:
    """Expected piece counts of one word under the model: forward-backward sums of logarithms."""
    n = len(word)
    longest = longest_piece(model) if longest is None else longest
    arcs = [(s, e, model[word[s:e]]) for e in range(1, n + 1) for s in range(max(0, e - longest), e)
            if word[s:e] in model]
    ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = back[n] = 0.0
    for s, e, logp in arcs:
        ahead[e] = _log_add(ahead[e], ahead[s] + logp)
    for s, e, logp in sorted(arcs, reverse=True):
        back[s] = _log_add(back[s], logp + back[e])
    out: dict[str, float] = {}
    if ahead[n] > -math.inf:
        for s, e, logp in arcs:
            p = math.exp(ahead[s] + logp + back[e] - ahead[n])
            out[word[s:e]] = out.get(word[s:e], 0.0) + p
    return out


def word_counts(df: DataFrame, words: str = "words") -> DataFrame:
    """Distinct marked words with counts (combined before the shuffle)."""
    marked = F.concat(F.lit(MARK), F.col("w"))
    return df.select(F.explode(words).alias("w")).groupBy(marked.alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def suffixes(counts: DataFrame, max_piece: int | None = MAX_PIECE) -> DataFrame:
    """Distinct suffixes of the words, cut to ``max_piece`` characters, with their counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, cnt in zip(batch["word"].to_pylist(), batch["cnt"].to_pylist(), strict=True):
                for lo in range(0, len(word), SUFFIX_ROWS):
                    tails = [word[k:None if max_piece is None else k + max_piece]
                             for k in range(lo, min(len(word), lo + SUFFIX_ROWS))]
                    yield tails, cnt

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails, weights = [], []
        for more, cnt in cut(batches):
            tails += more
            weights += [cnt] * len(more)
            if len(tails) >= SUFFIX_ROWS:
                yield pa.record_batch({"suffix": pa.array(tails, pa.string()), "cnt": pa.array(weights, pa.int64())})
                tails, weights = [], []
        if tails:
            yield pa.record_batch({"suffix": pa.array(tails, pa.string()), "cnt": pa.array(weights, pa.int64())})

    return (counts.select("word", F.col("cnt").cast("bigint").alias("cnt"))
            .mapInArrow(packed, "suffix string, cnt bigint").groupBy("suffix").agg(F.sum("cnt").alias("cnt")))


def substrings(counts: DataFrame, max_piece: int | None = MAX_PIECE, min_count: int = 2) -> DataFrame:
    """``piece, len, freq``: every character, and every longer substring that occurs ``min_count`` times.

    The suffixes are sorted by a range exchange; the common prefixes of neighbours give the
    intervals of equal substrings.  What lies inside a sorted run is complete there; only
    the prefixes of its first and last suffix are added up over runs.  So the exchange grows
    with the text and not with the number of substrings.  Without ``max_piece`` whole
    suffixes travel: any length is found, at a cost that grows with the square of a word.
    """
    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, weights = batch["suffix"].to_pylist(), batch["cnt"].to_numpy()
            rows = max(1, RUN_CELLS // max(map(len, tails), default=1))
            for lo in range(0, len(tails), rows):
                for pieces, freq, is_open in repeats(tails[lo:lo + rows], weights[lo:lo + rows], min_count):
                    if pieces:
                        yield pa.record_batch({"piece": pa.array(pieces, pa.string()), "freq": pa.array(freq, pa.int64()),
                                               "open": pa.array(is_open)})

    found = stored(suffixes(counts, max_piece).repartitionByRange("suffix").sortWithinPartitions("suffix")
                   .mapInArrow(intervals, "piece string, freq bigint, open boolean"), "substrings")
    merged = found.filter("open").groupBy("piece").agg(F.sum("freq").alias("freq"))
    size = F.length("piece").alias("len")
    return (found.filter("NOT open").select("piece", size, "freq").unionByName(merged.select("piece", size, "freq"))
            .filter((F.col("len") == 1) | (F.col("freq") >= min_count)))


def seed_pieces(counts: DataFrame, seed_size: int = SEED_SIZE, max_piece: int | None = MAX_PIECE,
                min_count: int = 2) -> DataFrame:
    """Every single character, and the ``seed_size`` best substrings by count x length.

    Substrings have at most ``max_piece`` characters and occur ``min_count`` times at least.
    """
    pieces = substrings(counts, max_piece, min_count)
    longer = smallest(pieces.filter("len > 1"), -F.col("freq") * F.col("len"), "piece", seed_size)
    return pieces.filter("len = 1").unionByName(longer)


def expectation(counts: DataFrame, model: DataFrame) -> DataFrame:
    """``piece, expected`` summed over the corpus; sums within a task come first.

    ``model`` is a ``stored`` table of ``piece, logp``; the row of a null piece holds the log
    likelihood of all words.
    """
    path = model._scratch

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = load(path)
        uses, likelihood = np.zeros(len(trie.piece)), 0.0
        for pdf in batches:
            words, cnt = pdf["word"].tolist(), pdf["cnt"].to_numpy(float)
            for lo, hi in lattice_batches(words):
                more, logs = Lattice(words[lo:hi], trie).expected(cnt[lo:hi], len(uses))
                uses += more
                likelihood += logs
        nodes = np.flatnonzero(uses > 0)
        yield pd.DataFrame({"piece": [trie.pieces[k] for k in trie.piece[nodes]] + [None],
                            "expected": np.append(uses[nodes], likelihood)})

    return (counts.select("word", "cnt").mapInPandas(walk, "piece string, expected double")
            .groupBy("piece").agg(F.sum("expected").alias("expected")))


def normalised(expected: DataFrame, least: float = MIN_EXPECTED) -> DataFrame:
    """The stored model ``piece, logp`` of expected counts.

    Pieces expected less than ``least`` times go; characters stay with that count.
    """
    weights = (expected.filter("piece IS NOT NULL")
               .filter((F.col("expected") >= least) | (F.length("piece") == 1))
               .select("piece", F.greatest("expected", F.lit(least)).alias("w")))
    weights = stored(weights, "weights")
    total = weights.agg(F.sum("w")).first()[0] or 1.0
    model = stored(weights.select("piece", F.log(F.col("w") / F.lit(float(total))).alias("logp")), "subword-model")
    discard(weights)
    return model


def prune(expected: DataFrame, model: DataFrame, keep: int) -> DataFrame:
    """Keep characters and the pieces whose loss from removal is largest.

    The loss is the expected count times the gap to the best split of the
    piece into other pieces.
    """
    path = model._scratch

    def gap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = load(path)
        for pdf in batches:
            pieces, own, split = pdf["piece"].tolist(), [], []
            for lo, hi in lattice_batches(pieces):
                lattice = Lattice(pieces[lo:hi], trie, whole=False, unknown=UNKNOWN_COST)
                split.append(lattice.best()[0][lattice.last])
            yield pdf.assign(loss=pdf["expected"] * (pdf["logp"] - np.concatenate(split)))

    scored = stored(expected.join(model, "piece").select("piece", "expected", "logp")
                    .mapInPandas(gap, "piece string, expected double, logp double, loss double"), "losses")
    single = scored.filter(F.length("piece") == 1)
    n_single = single.count()
    longer = smallest(scored.filter(F.length("piece") > 1), -F.col("loss"), "piece", max(0, keep - n_single))
    return single.unionByName(longer).select("piece", "expected")


def learn_model(df: DataFrame, vocab_size: int = 32000, words: str = "words", seed_size: int = SEED_SIZE,
                rounds: int = 2, shrink: float = 0.75, max_sentences: int | None = None,
                row_id: str = "sent_id", seed: int = 0, max_piece: int | None = MAX_PIECE, min_count: int = 2,
                min_expected: float = MIN_EXPECTED) -> DataFrame:
    """Unigram model as a stored table ``piece, logp``, by EM and pruning (Kudo 2018).

    ``seed_size``, ``max_piece``, ``min_count`` and ``min_expected`` bound the pieces that are tried.

    Every round is a job over the distinct words.  The model of a round is a table in the shared
    folder, which workers read; the driver sees only its number of rows and its total.
    """
    if max_sentences is not None:
        df = sample_n(df, row_id, max_sentences, seed)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # distinct words are few bytes but much work: keep them on all cores
    counts = stored(word_counts(df, words).repartition(parts, "word"), "word-counts")
    seeds = seed_pieces(counts, seed_size, max_piece, min_count)
    model = normalised(seeds.select("piece", F.col("freq").cast("double").alias("expected")), min_expected)

    def step(model: DataFrame, select) -> DataFrame:
        expected = stored(expectation(counts, model).filter("piece IS NOT NULL"), "expected")
        following = normalised(_with_characters(select(expected), model), min_expected)
        discard(expected)
        discard(model)
        return following

    while True:
        for _ in range(rounds):
            model = step(model, lambda expected: expected)
        size = model.count()
        if size <= vocab_size:
            discard(counts)
            return model
        keep = max(vocab_size, int(size * shrink))
        model = step(model, lambda expected, old=model: prune(expected, old, keep))
        if model.count() >= size:  # only characters are left
            discard(counts)
            return model


def _with_characters(expected: DataFrame, model: DataFrame) -> DataFrame:
    """Characters of the model stay, also where nothing was expected of them."""
    kept = model.filter(F.length("piece") == 1).select("piece", F.lit(0.0).alias("expected"))
    return expected.select("piece", "expected").unionByName(kept).groupBy("piece").agg(F.max("expected").alias("expected"))


def learn_subwords(df: DataFrame, vocab_size: int = 32000, words: str = "words", **options) -> dict[str, float]:
    """The model of ``learn_model`` as a dictionary: at most ``vocab_size`` pieces and the characters."""
    return {r["piece"]: r["logp"] for r in learn_model(df, vocab_size, words, **options).collect()}


def segmenter(segment) -> Column:
    """Iterator UDF from word arrays to piece arrays; each distinct word is segmented once per task."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, list[str]] = {}
        for col in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            out = []
            for ws in col:
                pieces: list[str] = []
                for w in ws:
                    got = seen.get(w)
                    if got is None:
                        got = seen[w] = segment(w)
                    pieces.extend(got)
                out.append(pieces)
            yield pd.Series(out)

    return run


def encode_subwords(df: DataFrame, model: dict[str, float] | DataFrame, words: str = "words") -> DataFrame:
    """Add ``pieces``: best segmentation of every word.  Narrow: no exchange, no join.

    ``model`` is a stored table ``piece, logp``, which workers read, or a dictionary.  The
    distinct words of a batch are segmented together.
    """
    if isinstance(model, dict):
        rows = [(p, float(v)) for p, v in model.items()]
        model = stored(df.sparkSession.createDataFrame(rows, "piece string, logp double"), "subword-model")
    path = model._scratch

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = load(path)
        for col in batches:
            known = list(dict.fromkeys(w for ws in col for w in ws))
            cut = dict(zip(known, segment([MARK + w for w in known], trie), strict=True))
            yield pd.Series([[p for w in ws for p in cut[w]] for ws in col], dtype=object)

    return df.withColumn("pieces", run(F.col(words)))


def bpe_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the best-ranked adjacent pair until none is left; marks all units but the last."""
    units = list(word[:-1]) + [word[-1] + "</w>"]
    while len(units) > 1:
        rank, pair = min((ranks.get(p, math.inf), p) for p in zip(units, units[1:]))
        if rank == math.inf:
            break
        merged, i = [], 0
        while i < len(units):
            if i + 1 < len(units) and (units[i], units[i + 1]) == pair:
                merged.append(units[i] + units[i + 1])
                i += 2
            else:
                merged.append(units[i])
                i += 1
        units = merged
    units[-1] = units[-1][: -len("</w>")]
    return [u + "@@" for u in units[:-1]] + units[-1:]


def apply_bpe(df: DataFrame, merges: list[tuple[str, str]], words: str = "words") -> DataFrame:
    """Add ``pieces``: units after applying a ranked merge list, ``@@`` on all but word ends."""
    shared = df.sparkSession.sparkContext.broadcast({m: k for k, m in reversed(list(enumerate(merges)))})
    return df.withColumn("pieces", segmenter(lambda w: bpe_word(w, shared.value))(F.col(words)))
