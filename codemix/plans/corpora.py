"""Parallel corpora derived from the ``documents`` table.

Translations, alignments, dictionaries and hypotheses are inputs of this
library.  The registered queries derive them from the documents with keyed
draws: tokens get lost, swapped and joined, some candidates are damaged on
purpose.  All of it is row-local apart from the dictionary counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codemix.functions.arrays import HALF
from codemix.functions.batches import SLICE_BYTES, SPACES, count_words, in_slices, n_words
from codemix.functions.digests import md5_words
from codemix.functions.draw import draw
from codemix.functions.text import BLANK_CHARS, LINE_END
from codemix.operators.lexsub import dictionary_entries
from codemix.session import dense_order, files_cleaned, scratch_path

TARGETS = ("xx", "yy", "zz")
BAD_ONE_IN = 30
#: Words parted by anything but one space.
UNEVEN = SPACES[:-1] + "{2}|" + SPACES[:-1].replace(re.escape(" "), "", 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give an input of few or uneven splits to all cores; others stay as they are.

    A row group belongs to one split, so a file of few row groups leaves most of its splits empty.
    Rows are counted per split without reading a column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    per_split = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    filled, most, total = per_split.agg(F.count("n"), F.max("n"), F.sum("n")).first()
    if filled >= cores and most * cores <= 2 * total:
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()), key)


_STORED: dict[tuple, str] = {}
#: Bytes of a row group of a stored input: its splits hold several, so that tasks get even shares.
ROW_GROUP = 16 << 20


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived input as a parquet table in the shared scratch folder, built once per session.

    Sentences, translations and dictionaries are given as files in practice, so
    the queries read them as such, with column pruning.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        with files_cleaned(spark):
            (build(spark, sf_dir).write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd")
             .option("parquet.compression.codec.zstd.level", "6").parquet(path))
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of every document: ``sent_id, lang, words, n, text``.

    The words are the parts of the text, so the table does not hold them again.
    """
    lines = stored(spark, sf_dir, "sentences", _build_sentences)
    return lines.select("sent_id", "lang", F.split("text", " ").alias("words"), "n", "text")


#: Line numbers of a document; a longer one is an error and no clash of ids.
LINES_PER_DOC = 10_000_000


def sentence_id(doc_id: Column, pos: Column) -> Column:
    fits = F.assert_true(pos + 1 < LINES_PER_DOC, F.lit(f"a document of {LINES_PER_DOC} lines or more")).isNull()
    return F.when(fits, doc_id * LINES_PER_DOC + pos + 1)


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-blank lines with their position, their words joined by one space and the number of these."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        yield from in_slices(sizes, SLICE_BYTES, lambda lo, hi: _lines(batch.slice(lo, hi - lo)))


def _lines(docs: pa.RecordBatch) -> pa.RecordBatch:
    parts = pc.split_pattern_regex(docs["text"], LINE_END)
    doc, text = pc.list_parent_indices(parts), pc.utf8_trim(parts.flatten(), characters=BLANK_CHARS)
    size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    pos = pa.array(np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size), pa.int32())
    some = pc.not_equal(text, "")
    doc, text, pos = doc.filter(some), text.filter(some), pos.filter(some)
    uneven = pc.match_substring_regex(text, UNEVEN)
    if pc.any(uneven).as_py():
        text = pc.replace_with_mask(text, uneven, pc.replace_substring_regex(text.filter(uneven), SPACES, " "))
    return pa.RecordBatch.from_arrays(
        [docs["doc_id"].take(doc), docs["lang"].take(doc), pos, pa.array(count_words(text), pa.int32()), text],
        names=["doc_id", "lang", "pos", "n", "text"])


def _build_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    lines = docs.mapInArrow(_line_batches, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, pos int, n int, text string")
    return lines.select(sentence_id(F.col("doc_id"), F.col("pos")).alias("sent_id"), "lang", "n", "text")


# First byte of a draw, below these bounds: lost tokens and the two kinds of extra edges.
LOST, JOINED, GAPPED = 0x1A, 0x25, 0x14


#: Words of the sentences that are worked on at a time.
SLICE = 1 << 17
CANDIDATES = "sent_id bigint, lang_idx int, lang string, text string, alignment string"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def _joined(parts: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Consecutive strings joined by one space, ``sizes`` of them a row."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), parts), " ")


def _translations(prefix: pa.Array, text: pa.Array, words: pa.Array, n: np.ndarray, tgt: str) -> tuple[pa.Array, pa.Array]:
    """Texts and alignments of sentences for one target; every word has one digest for all its draws."""
    rows, total = len(n), int(n.sum())
    row, start = np.repeat(np.arange(rows), n), _starts(n)
    i = np.arange(total) - start[row]
    number = pa.array(np.arange(n.max() + 1)).cast(pa.string())
    lost, order, joined, gapped = md5_words(pc.binary_join_element_wise(
        prefix.take(pa.array(row)), number.take(pa.array(i)), tgt, ":"))
    first = lambda word: word >> np.uint32(24)  # the first two hex digits
    kept = np.flatnonzero(first(lost) >= LOST)
    # in target order: by blocks of two source words, each block by its draws
    here, there = kept[:-1], kept[1:]
    turn = np.flatnonzero((row[here] == row[there]) & (i[here] >> 1 == i[there] >> 1) & (order[there] < order[here]))
    kept[turn], kept[turn + 1] = kept[turn + 1], kept[turn]
    size = np.bincount(row[kept], minlength=rows)
    j = np.arange(len(kept)) - _starts(size)[row[kept]]

    bad = md5_words(pc.binary_join_element_wise(prefix, "0", f"bad:{tgt}", ":"))[0] % BAD_ONE_IN
    limit = np.where(bad == 0, (size + 2) // 3, size)
    inside = j < limit[row[kept]]
    kept, j = kept[inside], j[inside]
    out = _joined(pc.binary_join_element_wise(words.take(pa.array(kept)), tgt, "_"), limit)
    out = pc.if_else(pa.array(bad == 2), text, out)

    # a row has n + 1 source places: the last one is beyond the sentence
    place = kept + row[kept]
    back = lambda k, word, bound: (first(word[kept]) < bound) & (i[kept] >= k)
    one, two = back(1, joined, JOINED), back(2, gapped, GAPPED)
    source = np.concatenate((place, place[one] - 1, place[two] - 2))
    target = np.concatenate((j, j[one], j[two]))
    owner = np.repeat(np.arange(rows), n + 1)
    some = bad[owner[source]] != 1
    beyond = (start[1:] + np.arange(rows))[bad == 3]
    edges = np.sort(np.concatenate(((source[some] << 31) | target[some], beyond << 31)))
    source, target = edges >> 31, edges & (HALF - 1)
    s = source - (start[:-1] + np.arange(rows))[owner[source]]
    texts = pc.binary_join_element_wise(number.take(pa.array(s)), number.take(pa.array(target)), "-")
    return out, _joined(texts, np.bincount(owner[source], minlength=rows))


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pc.split_pattern(batch["text"], " ")
        upto = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(words):
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE, side="right")))
            ids, text, some = batch["sent_id"][lo:hi], batch["text"][lo:hi], words[lo:hi]
            n = np.diff(upto[lo:hi], prepend=before)
            prefix = pc.binary_join_element_wise("0", ids.cast(pa.string()), ":", null_handling="skip")
            parts = [_translations(prefix, text, some.flatten(), n, tgt) for tgt in TARGETS]
            # the candidates of a sentence stand together
            mixed = pa.array(np.arange(len(n) * len(TARGETS)).reshape(len(TARGETS), -1).T.reshape(-1))
            together = lambda k: pa.concat_arrays([part[k] for part in parts]).take(mixed)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(len(n)), len(TARGETS)))),
                pa.array(np.tile(np.arange(len(TARGETS), dtype=np.int32), len(n))),
                pa.array(TARGETS).take(pa.array(np.tile(np.arange(len(TARGETS)), len(n)))),
                together(0), together(1)], names=["sent_id", "lang_idx", "lang", "text", "alignment"])
            lo = hi


def hashed_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition early, so that later grouping and joining on the keys need no exchange."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sent_id, lang_idx, lang, text, alignment`` in long form, derived where they are read.

    They are four times the text, and every query exchanges them: a stored table would hold them twice.
    """
    return _build_candidates(spark, sf_dir)


def _build_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("sent_id", "text").mapInArrow(_candidate_batches, CANDIDATES)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean target side: the words in reverse order."""
    return sentences(spark, sf_dir).select("sent_id", F.array_join(F.reverse("words"), " ").alias("ref"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a dense 0-based ``line_no`` inside their language corpus."""
    ordered = dense_order(sentences(spark, sf_dir), F.col("lang"), F.col("sent_id"))
    starts = ordered.groupBy("lang").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n_lines"))
    return (ordered.join(F.broadcast(starts), "lang")  # one row per language
            .withColumn("line_no", F.col("rank") - F.col("start")).drop("rank", "start"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of every word; Spanish has none for ``zz``."""
    return stored(spark, sf_dir, "lexicon", _build_lexicon)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary's entries with their weighted translations, as a stored table."""
    return stored(spark, sf_dir, "entries", lambda spark, sf_dir: dictionary_entries(lexicon(spark, sf_dir)))


def _build_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = (sentences(spark, sf_dir).select("lang", F.explode("words").alias("word"))
               .distinct())
    target = F.explode(F.array(*[F.lit(t) for t in TARGETS]))
    rolled = counted.select(F.col("lang").alias("src_lang"), "word", target.alias("tgt_lang")).filter(
        "NOT (src_lang = 'es' AND tgt_lang = 'zz')").withColumn(
        "d", draw(0, F.concat_ws(":", "src_lang", "word"), F.col("tgt_lang"), "lex"))
    forms = F.concat(F.sequence(F.lit(1), (F.col("d") % 3 + 1).cast("int")),
                     F.when(F.col("d") % 5 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return (rolled.select("src_lang", "tgt_lang", "word", F.explode(forms).alias("r"))
            .select("src_lang", "tgt_lang", "word",
                    F.concat("word", F.lit("_"), "tgt_lang", F.col("r").cast("string")).alias("translation")))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation log: S, T, H and P lines per sentence and some noise; scores of many digits or with exponents."""
    s = sentences(spark, sf_dir)
    sid = F.col("sent_id").cast("string")
    drawn = draw(0, F.col("sent_id"), 0, "score")
    score = (F.when(drawn % 3 == 0, F.concat(F.lit("-0."), F.lpad(drawn.cast("string"), 16, "0")))
             .when(drawn % 3 == 1, F.concat(F.lit("-"), drawn.cast("string"), F.lit("e-12")))
             .otherwise(F.concat(F.lit("-0."), F.lpad((drawn % 10000).cast("string"), 4, "0"))))
    tab = F.lit("\t")
    kinds = F.array(
        F.concat(F.lit("S-"), sid, tab, F.col("text")),
        F.concat(F.lit("T-"), sid, tab, F.col("text")),
        F.concat(F.lit("H-"), sid, tab, score, tab, F.lit("LANG_TOK_XX "), F.col("text")),
        F.concat(F.lit("P-"), sid, tab, score),
        F.concat(F.lit("| note "), sid))
    return s.select("sent_id", F.explode(kinds).alias("value"))


def ref_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference text and a hypothesis that lost about every eighth word; drawn over Arrow batches."""
    rows = sentences(spark, sf_dir).select("sent_id", "lang", "text")
    return rows.mapInArrow(_hypothesis_batches, "sent_id bigint, grp string, ref string, hyp string")


def _hypothesis_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)
        yield from in_slices(sizes, SLICE_BYTES, lambda lo, hi: _hypotheses(batch.slice(lo, hi - lo)))


def _hypotheses(rows: pa.RecordBatch) -> pa.RecordBatch:
    words = pc.split_pattern(rows["text"], " ")
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    i = pa.array(np.arange(len(row)) - _starts(n)[row]).cast(pa.string())
    ids = rows["sent_id"].cast(pa.string()).take(pa.array(row))
    kept = np.flatnonzero(md5_words(pc.binary_join_element_wise("0", ids, i, "H", ":", null_handling="skip"))[0] % 8 != 0)
    hyp = _joined(words.flatten().take(pa.array(kept)), np.bincount(row[kept], minlength=len(n)))
    return pa.RecordBatch.from_arrays([rows["sent_id"], rows["lang"], rows["text"], hyp], names=["sent_id", "grp", "ref", "hyp"])


def pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths with end mark of every sentence and each of its candidates."""
    src = sentences(spark, sf_dir).select("sent_id", (F.col("n") + 1).alias("src_len"))
    tgt = candidates(spark, sf_dir).select(
        "sent_id", "lang_idx", (n_words(F.col("text")) + 1).alias("tgt_len"))
    return src.join(tgt, "sent_id").select(
        (F.col("sent_id") * len(TARGETS) + F.col("lang_idx")).alias("ex_id"), "src_len", "tgt_len")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_id, pos, a, c`` from neighbouring vectors; batches of 16."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("k"), (F.col("vec_id") % 2).alias("side"), "embedding")
    a = emb.filter("side = 0").select("k", F.col("embedding").alias("a"))
    c = emb.filter("side = 1").select("k", F.col("embedding").alias("c"))
    return a.join(c, "k").select(F.floor(F.col("k") / 16).alias("batch_id"), (F.col("k") % 16).alias("pos"), "a", "c")


def mono_and_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with ``kind`` (parallel: en and fr), ``split`` and ``part``."""
    s = sentences(spark, sf_dir)
    d = draw(0, F.col("sent_id"), 0, "split")
    return s.select(
        F.col("sent_id").alias("ex_id"), "lang", "n",
        F.when(F.col("lang").isin("en", "fr"), "parallel").otherwise("mono").alias("kind"),
        F.when(d % 20 == 0, "valid").otherwise("train").alias("split"),
        (F.floor(d / 32) % 3).cast("int").alias("part"))
