"""Dictionary substitution: replace words by entries of bilingual dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from codemix.functions.digests import md5_words
from codemix.functions.draw import SPAN, digest, draw, hex_word
from codemix.operators import blocks
from codemix.operators.compiled import Dictionary, compile_table
from codemix.operators.lookup import lookup
from codemix.session import BROADCAST_BYTES, files_cleaned, fits_broadcast, stored

SEP = "\x00"
KEY = ["src_lang", "tgt_lang", "word"]
ENTRIES = "src_lang string, tgt_lang string, word string, choices array<struct<upto:bigint,translation:string>>"
#: Chunks of sentences per shuffle partition, in a lookup of a large dictionary.
CHUNKS = 2
#: Bytes of a dictionary that a task may hold, at least, to look up by chunks; below, words are joined one by one.
LEAST = 1 << 20


@dataclass(frozen=True)
class LexiconOptions:
    ratio: float = 0.63
    seed: int = 0
    per: str = "sentence"  # or "word": how often the target language is drawn
    broadcast_limit: int = BROADCAST_BYTES


def dictionary_entries(lexicon: DataFrame) -> DataFrame:
    """One row per (src_lang, tgt_lang, word) with weighted translations.

    Repeated entries weigh the draw.  They are counted before the lists are
    built, so a list holds each translation once: ``choices`` is an
    ``array<struct<translation, upto>>`` with cumulative counts.
    """
    if not lexicon.isStreaming and all(lexicon.schema[c].dataType == StringType() for c in (*KEY, "translation")):
        n = blocks.places(lexicon)
        # all entries of a word stand together: they are much alike
        rows = blocks.packed(lexicon.select(*KEY, "translation"), blocks.place(n, "src_lang", "word"), 0)
        return blocks.merged([rows], n, _listed, ENTRIES)
    counted = lexicon.groupBy("src_lang", "tgt_lang", "word", "translation").agg(F.count(F.lit(1)).alias("c"))
    listed = counted.groupBy("src_lang", "tgt_lang", "word").agg(
        F.sort_array(F.collect_list(F.struct("translation", "c"))).alias("forms"))

    def add(done: Column, form: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["upto"], F.lit(0).cast("bigint"))
        return F.concat(done, F.array(F.struct(
            (before + form["c"]).alias("upto"), form["translation"].alias("translation"))))

    empty = F.array().cast("array<struct<upto:bigint,translation:string>>")
    return listed.select("src_lang", "tgt_lang", "word", F.aggregate("forms", empty, add).alias("choices"))


def _codes(*parts: pa.Array) -> list[np.ndarray]:
    """Numbers of the values over all parts together, equal for equal values; null has one of its own."""
    coded = pc.fill_null(pa.concat_arrays(parts).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return np.split(coded.astype(np.int64) + 1, np.cumsum([len(p) for p in parts])[:-1])


def _listed(pid: int, lexicon: pa.Table) -> Iterator[pa.RecordBatch]:
    """Entries of a place: equal rows counted, their translations in order with cumulative counts."""
    keys = [_codes(blocks.column(lexicon, c))[0] for c in KEY]
    text = blocks.ranks(blocks.column(lexicon, "translation"))
    order = np.lexsort((text, *keys))
    new = lambda *columns: np.concatenate(([True], np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])))
    form = np.flatnonzero(new(*keys, text))
    first = np.flatnonzero(new(*keys))
    upto = np.append(form[1:], len(order))
    entry = np.searchsorted(first, form, side="right") - 1
    bounds = np.searchsorted(form, np.append(first, len(order)))
    done = pa.StructArray.from_arrays(
        [pa.array(upto - first[entry]), blocks.column(lexicon, "translation").take(pa.array(order[form]))], names=["upto", "translation"])
    some = lexicon.select(KEY).take(pa.array(order[first]))
    yield from blocks.in_batches(some.append_column("choices", pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), done)))


def dictionary_languages(lexicon: DataFrame) -> DataFrame:
    """Target languages that have a dictionary, per source language (a handful of rows)."""
    return lexicon.groupBy("src_lang").agg(F.sort_array(F.collect_set("tgt_lang")).alias("tgt_langs"))


def _chunk_entries(rows: DataFrame, entries: DataFrame, n: int, ask: Callable[[pa.Table], tuple]) -> DataFrame:
    """Blocks of the entries (``src_lang, tgt_lang, word, value``) that each of the ``n`` chunks of ``rows`` asks for.

    ``ask`` gives the source languages, target languages and words of a chunk's rows, and draws (null without).  A
    chunk asks for an entry once, whatever the number of its words, so no word is asked for more than ``n``
    times a language.  An entry that serves one draw only comes with the translation that is drawn.
    """

    def distinct(chunk: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        *keys, draws = ask(rows)
        some = reduce(pc.and_, [k.is_valid() for k in keys])
        keys, draws = [k.filter(some) for k in keys], draws.filter(some)
        code = np.zeros(len(draws), np.int64)
        for (c,) in map(_codes, keys):
            code = code * (c.max(initial=0) + 1) + c
        _, first, times = np.unique(code, return_index=True, return_counts=True)
        at = pa.array(first)
        drawn = pc.if_else(pa.array(times == 1), draws.take(at), pa.scalar(None, pa.int64()))
        yield from blocks.in_batches(pa.table([
            pa.array(np.full(len(first), chunk, np.int32)), *(k.take(at) for k in keys), drawn], names=["chunk", *KEY, "d"]))

    needed = blocks.merged([blocks.packed(rows, F.col("_chunk"), 0)], n, distinct,
                           "chunk int, src_lang string, tgt_lang string, word string, d bigint")
    k = blocks.places(rows)
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in KEY])
    return blocks.merged([blocks.packed(needed, blocks.place(k, "src_lang", "word"), 0),
                          blocks.packed(entries.filter(there), blocks.place(k, "src_lang", "word"), 1)], k, _asked, blocks.BLOCKS)


def _asked(place: int, needed: pa.Table, entries: pa.Table | None) -> Iterator[pa.RecordBatch]:
    if entries is None:
        return
    a, b = np.zeros(len(needed), np.int64), np.zeros(len(entries), np.int64)
    for name in KEY:
        c, d = _codes(blocks.column(needed, name), blocks.column(entries, name))
        kinds = max(c.max(initial=0), d.max(initial=0)) + 1
        a, b = a * kinds + c, b * kinds + d
    i, j = blocks.matching(a, b)
    if not len(i):
        return
    values, draws = blocks.column(entries, "value"), blocks.column(needed, "d").take(pa.array(i))
    one = draws.is_valid().to_numpy(zero_copy_only=False)
    found = _chosen(values, j, one, pc.fill_null(draws, 0).to_numpy()) if one.any() else values.take(pa.array(j))
    out = entries.select(KEY).take(pa.array(j)).append_column("value", found)
    yield from blocks.blocks(out, blocks.column(needed, "chunk").to_numpy()[i], 1)


def _chosen(values: pa.Array, at: np.ndarray, one: np.ndarray, draws: np.ndarray) -> pa.Array:
    """The lists of choices at some places, those with ``one`` draw cut to the choice that it takes."""
    choices = _Choices(values)
    size = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    first = (np.cumsum(size) - size)[at]
    pick = np.searchsorted(choices.ends, choices.before[at] + draws % choices.totals[at], "right")
    many = np.where(one, 1, size[at])
    upto = np.concatenate(([0], np.cumsum(many)))
    flat = np.repeat(np.where(one, pick, first) - upto[:-1], many) + np.arange(upto[-1])
    ends = np.where(np.repeat(one, many), 1, (choices.ends - np.repeat(choices.before, size))[flat])
    rows = pa.StructArray.from_arrays([pa.array(ends), choices.translations.take(pa.array(flat))], names=["upto", "translation"])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows)


def _asked_words(rows: pa.Table) -> tuple:
    words, row = _words_of(rows)
    return (*(blocks.column(rows, c).take(pa.array(row)) for c in ("src_lang", "tgt_lang")), words, pa.nulls(len(words), pa.int64()))


def _words_of(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows and the row of each."""
    words = blocks.column(rows, "words")
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return words.flatten(), np.repeat(np.arange(len(words)), size)


def _found(entries: pa.Table | None, src: pa.Array, langs: pa.Array, words: pa.Array) -> np.ndarray:
    """The entry of every word for its languages, -1 where there is none."""
    if entries is None:
        return np.full(len(words), -1)
    known, asked = np.zeros(len(entries), np.int64), np.zeros(len(words), np.int64)
    valid = np.ones(len(words), bool)
    for name, values in (("word", words), ("src_lang", src), ("tgt_lang", langs)):
        a, b = _codes(blocks.column(entries, name), values)
        kinds = max(a.max(initial=0), b.max(initial=0)) + 1
        known, asked, valid = known * kinds + a, asked * kinds + b, valid & (values.is_valid().to_numpy(zero_copy_only=False))
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], asked), len(known) - 1)
    return np.where(valid & (known[order][at] == asked), order[at], -1)


def lookup_lexicon(tokens: DataFrame, lexicon: DataFrame, limit: int = BROADCAST_BYTES, value: Column | None = None) -> DataFrame:
    """Add ``choices`` (null when absent) to rows ``sent_id, i, src_lang, tgt_lang, word``.

    The entries are stored: they are measured first and joined after.  Rows ``sent_id, src_lang, tgt_lang, words``
    stay whole: with ``value``, a bigint made of ``choices``, they get it for all their words as the array ``found``.  They
    travel by chunks, and every chunk with the entries of its distinct words.
    """
    if "words" in tokens.columns:
        n = blocks.places(tokens, CHUNKS)
        rows = tokens.withColumn("_chunk", blocks.place(n, "sent_id"))
        entries = dictionary_entries(lexicon).select(*KEY, value.cast("bigint").alias("value"))
        found = _chunk_entries(rows.drop("sent_id"), entries, n, _asked_words)
        return blocks.merged([blocks.packed(tokens, blocks.place(n, "sent_id"), 0), found], n, _with_values,
                             StructType([*tokens.schema.fields, StructField("found", ArrayType(LongType()))]))
    return lookup(tokens, stored(dictionary_entries(lexicon)), ["src_lang", "tgt_lang", "word"],
                  F.struct("sent_id", "i"), limit)


def _with_values(chunk: int, rows: pa.Table, entries: pa.Table | None) -> Iterator[pa.RecordBatch]:
    words, row = _words_of(rows)
    at = pa.array(row)
    entry = _found(entries, blocks.column(rows, "src_lang").take(at), blocks.column(rows, "tgt_lang").take(at), words)
    values = pa.array([], pa.int64()) if entries is None else blocks.column(entries, "value")
    size = np.bincount(row, minlength=len(rows))
    found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()),
                                     values.take(pa.array(entry, mask=entry < 0)))
    yield from blocks.in_batches(rows.append_column("found", found))


def found_sums(found: Column) -> Column:
    """Of an array of values: their number, how many are not null and the sum of those."""

    @F.arrow_udf("struct<n:bigint,found:bigint,total:bigint>")
    def run(found: pa.Array) -> pa.Array:
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))))
        flat = found.flatten()
        sums = lambda values: pa.array(np.diff(np.concatenate(([0], np.cumsum(values.astype(np.int64))))[upto]))
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(upto)), sums(flat.is_valid().to_numpy(zero_copy_only=False)),
             sums(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False))], names=["n", "found", "total"])

    return run.asNondeterministic()(found)  # a pure function, marked so that the optimizer does not copy the call


class _Choices:
    """A compiled dictionary with the cumulative counts of its translations in one array."""

    def __init__(self, lists: pa.Array, entries: Dictionary | None = None):
        self.entries = entries
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = flat.field("upto").to_numpy(zero_copy_only=False).astype(np.int64)
        self.totals = upto[np.cumsum(sizes) - 1] if len(sizes) else np.zeros(0, np.int64)
        self.before = np.cumsum(self.totals) - self.totals
        self.ends, self.translations = upto + np.repeat(self.before, sizes), flat.field("translation")
        if entries is not None:
            entries.values = None


def compiled_dictionary(entries: DataFrame, limit: int = BROADCAST_BYTES) -> Dictionary | None:
    """Entries keyed by (src_lang, tgt_lang, word), compiled; None above ``limit`` bytes."""
    key = ["src_lang", "tgt_lang", "word"]
    return compile_table(entries.select(F.xxhash64(*key).alias("hash"), F.concat_ws(SEP, *key).alias("key"),
                                        F.col("choices").alias("value")), limit)


def _in_rows(rows: DataFrame, known: Dictionary) -> Column:
    """The drawn translation of every word, from a compiled dictionary; no exchange."""
    shared = rows.sparkSession.sparkContext.broadcast(_Choices(known.values, known))

    def run(src: pa.Array, words: pa.Array, langs: pa.Array, draws: pa.Array, hashes: pa.Array) -> pa.Array:
        choices = shared.value
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, langs, words = np.repeat(np.arange(len(size)), size), langs.flatten(), words.flatten()
        name = lambda at: pc.binary_join_element_wise(
            src.take(pa.array(row).take(at)), langs.take(at), words.take(at), SEP)
        entry = choices.entries.entries(hashes.flatten(), name)
        hit = entry >= 0
        drawn, entry = draws.flatten().to_numpy(zero_copy_only=False)[hit].astype(np.int64), entry[hit]
        place = np.full(len(hit), -1, np.int64)
        place[hit] = np.searchsorted(choices.ends, choices.before[entry] + drawn % choices.totals[entry], "right")
        found = choices.translations.take(pa.array(place, mask=~hit))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), found)

    hashes = F.zip_with("langs", "words", lambda g, w: F.xxhash64("src_lang", g, w))
    return F.arrow_udf(run, "array<string>")("src_lang", "words", "langs", "draws", hashes)


def _placed(words: pa.Array, at: pa.Array, entries: pa.Array) -> pa.Array:
    """Entries at their positions of the words, null elsewhere."""
    length = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(length(words))))
    place = np.full(starts[-1], -1, np.int64)
    found = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(starts[:-1], length(at))
    place[found] = np.arange(len(found))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entries.flatten().take(pa.array(place, mask=place < 0)))


def _by_join(rows: DataFrame, drawn: Callable[[DataFrame], DataFrame], accepted: Callable[[Column], Column],
             entries: DataFrame, limit: int) -> DataFrame:
    """The same for a dictionary too large to broadcast: words are exploded, joined and grouped again.

    Only words whose draw accepts an entry are looked up and only found ones return.  The digests,
    languages and draws do not travel: they are drawn again after the join.
    """
    # a lookup of a row without id would find no row again
    rows = rows.filter(F.col("sent_id").isNotNull())
    # zipped outside of the lambda: an array named inside would be computed once per word
    cells = F.filter(F.transform(F.arrays_zip("words", "langs", "draws", "digests"), lambda c, i: F.struct(
        c["words"].alias("word"), i.cast("int").alias("i"), c["langs"].alias("tgt_lang"), c["draws"].alias("d"),
        accepted(c["digests"]).alias("ok"))), lambda c: c["ok"])
    flat = drawn(rows).select("sent_id", "src_lang", F.explode(cells).alias("c")).select(
        "sent_id", "src_lang", "c.word", "c.i", "c.tgt_lang", "c.d")
    found = lookup(flat, entries, ["src_lang", "tgt_lang", "word"], F.struct("sent_id", "i"), limit)
    at = F.pmod("d", F.element_at("choices", -1)["upto"])
    entry = F.get(F.filter("choices", lambda c: c["upto"] > F.col("at")), F.lit(0))["translation"]
    grouped = (found.withColumn("at", at).withColumn("entry", entry).filter(F.col("entry").isNotNull())
               .groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("i", "entry"))).alias("hits")))
    return drawn(rows.join(grouped, "sent_id", "left")).withColumn("entries", F.arrow_udf(_placed, "array<string>")(
        "words", F.coalesce(F.col("hits.i"), F.array().cast("array<int>")),
        F.coalesce(F.col("hits.entry"), F.array().cast("array<string>")))).drop("hits")


def _drawn(rows: pa.Table, seed: str, ratio: float, per_word: bool) -> tuple:
    """Words and their rows, places of the accepted words, languages drawn for these and draws of their translations."""
    words, row = _words_of(rows)
    ids, lists = blocks.column(rows, "sent_id").cast(pa.string()), blocks.column(rows, "tgt_langs")
    size = np.bincount(row, minlength=len(rows))
    place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    drawn = md5_words(pc.binary_join_element_wise(seed, ids.take(pa.array(row)), pa.array(place).cast(pa.string()), "lex", ":"))
    at = np.flatnonzero((drawn[2] + 0.5) / SPAN <= ratio)
    row_at, kinds = row[at], pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    choice = drawn[0][at] if per_word else md5_words(pc.binary_join_element_wise(seed, ids, "0", "lang", ":"))[0][row_at]
    lang = (np.cumsum(kinds) - kinds)[row_at] + choice % np.maximum(kinds, 1)[row_at]
    return words, row, at, lists.flatten().take(pa.array(lang, mask=kinds[row_at] == 0)), drawn[1][at].astype(np.int64)


def _by_chunks(rows: DataFrame, entries: DataFrame, opts: LexiconOptions) -> DataFrame:
    """The same in chunks of sentences that fit a task, each with the entries of its words; the draws are made in the batch."""
    n = blocks.places(rows, CHUNKS)
    rows = rows.filter(F.col("sent_id").isNotNull())  # as above
    draws = (str(opts.seed), opts.ratio, opts.per != "sentence")

    def ask(rows: pa.Table) -> tuple:
        words, row, at, langs, drawn = _drawn(rows, *draws)
        return blocks.column(rows, "src_lang").take(pa.array(row[at])), langs, words.take(pa.array(at)), pa.array(drawn)

    def work(chunk: int, rows: pa.Table, entries: pa.Table | None) -> Iterator[pa.RecordBatch]:
        words, row, at, langs, drawn = _drawn(rows, *draws)
        size = np.bincount(row, minlength=len(rows))
        entry = _found(entries, blocks.column(rows, "src_lang").take(pa.array(row[at])), langs, words.take(pa.array(at)))
        langs, drawn, at, entry = langs.filter(pa.array(entry >= 0)), drawn[entry >= 0], at[entry >= 0], entry[entry >= 0]
        done = words
        if len(at):
            choices = _Choices(blocks.column(entries, "value"))
            where = np.full(len(words), -1)
            where[at] = np.searchsorted(choices.ends, choices.before[entry] + drawn % choices.totals[entry], "right")
            done = pc.coalesce(choices.translations.take(pa.array(where, mask=where < 0)), words)
        joined = lambda flat: pc.binary_join(_lists(flat.drop_null(), row[flat.is_valid().to_numpy(zero_copy_only=False)], len(rows)), " ")
        yield from blocks.in_batches(pa.table({
            "sent_id": rows["sent_id"], "lang": rows["src_lang"], "n": pa.array(size, pa.int32()), "text": joined(words),
            "switched": joined(done), "hits": _lists(langs, row[at], len(rows))}))

    with files_cleaned(rows.sparkSession):
        found = stored(_chunk_entries(rows.withColumn("_chunk", blocks.place(n, "sent_id")),
                                      entries.select(*KEY, F.col("choices").alias("value")), n, ask), "chunk-entries")

    schema = StructType([rows.schema["sent_id"], StructField("lang", StringType()), StructField("n", IntegerType()),
                         StructField("text", StringType()), StructField("switched", StringType()), StructField("hits", ArrayType(StringType()))])
    return blocks.merged([blocks.packed(rows, blocks.place(n, "sent_id"), 0), found], n, work, schema)


def _lists(flat: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))), pa.int32()), flat)


def lex_substitute(df: DataFrame, lexicon: DataFrame, opts: LexiconOptions = LexiconOptions(),
                   entries: DataFrame | None = None) -> DataFrame:
    """Replace dictionary words of ``df(sent_id, lang, words)``; ``sent_id`` is unique.

    Result: ``sent_id, lang, n, text, switched, hits`` (``hits``: language of
    every replacement).  A sentence is one row, so with a dictionary of measured small
    size there is no exchange.  One digest per word serves all its draws.  ``entries`` are
    those of ``dictionary_entries``, where they are stored already.
    """
    langs = dictionary_languages(lexicon)
    langs = F.broadcast(langs) if fits_broadcast(langs, opts.broadcast_limit) else langs
    pick = lambda d: F.get("tgt_langs", F.pmod(d, F.greatest(F.size("tgt_langs"), F.lit(1))).cast("int"))
    rows = (df.select("sent_id", F.col("lang").alias("src_lang"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
            .join(langs, "src_lang", "left"))

    def drawn(df: DataFrame) -> DataFrame:
        df = df.withColumn("digests", F.transform("words", lambda w, i: digest(opts.seed, F.col("sent_id"), i, "lex")))
        if opts.per == "sentence":
            df = df.withColumn("lang0", pick(draw(opts.seed, F.col("sent_id"), 0, "lang"))).withColumn(
                "langs", F.transform("words", lambda w: F.col("lang0")))
        else:
            df = df.withColumn("langs", F.transform("digests", lambda d: pick(hex_word(d, 0))))
        return df.withColumn("draws", F.transform("digests", lambda d: hex_word(d, 1)))

    accept = lambda d: (hex_word(d, 2) + F.lit(0.5)) / F.lit(float(SPAN)) <= opts.ratio
    entries = stored(dictionary_entries(lexicon), "entries") if entries is None else entries
    known = compiled_dictionary(entries, opts.broadcast_limit)
    if known is not None:
        rows = drawn(rows)
        found = rows.withColumn("entries", _in_rows(rows, known))
    elif opts.broadcast_limit >= LEAST and rows.schema["sent_id"].dataType == LongType() and not df.isStreaming:
        return _by_chunks(rows, entries, opts)
    else:
        found = _by_join(rows, drawn, accept, entries, opts.broadcast_limit)
    accepted = F.zip_with("entries", "digests", lambda e, d: F.when(accept(d), e))
    done = found.withColumn("entries", accepted)
    return done.select(
        "sent_id", F.col("src_lang").alias("lang"), F.size("words").alias("n"), F.array_join("words", " ").alias("text"),
        F.array_join(F.zip_with("entries", "words", lambda e, w: F.coalesce(e, w)), " ").alias("switched"),
        F.filter(F.zip_with("entries", "langs", lambda e, g: F.when(e.isNotNull(), g)), lambda v: v.isNotNull()).alias("hits"))
