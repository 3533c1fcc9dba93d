"""Phrase collocation mining by SON partitioning.

1. Documents are dealt to ``shards`` by hash.  Every shard is mined completely, length by
   length, at the support divided by the number of shards: a phrase that reaches the support
   over all shards reaches this share of it in one of them at least.
2. The local counts bound the global one: where a phrase was not frequent it occurs less often
   than the local support.  Phrases whose bound misses the support go, and with them, in every
   shard, the longer phrases they are part of.
3. The union of the others, a Bloom filter of bounded size, picks the candidates out of the
   whole corpus.
4. Candidates are counted globally, by their words; false ones fall below the support.  A task
   hands on its counts packed, by parts of the phrases, and each part is summed over all tasks.

A shard is no task: it is mined by all of them, so neither a shard nor a phrase is held in
one place.  The local support must stay above one occurrence, or a shard would call every
phrase frequent: so there are few shards, whatever the size of the corpus.  Within a
shard a phrase is only tried when its parts were frequent there.

Words are told apart by 64-bit hashes inside a slice of text, phrases by 128 bits inside a
task, and by themselves beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from codemix.llm import bloom
from codemix.llm.common import WordHasher, give_back, mix, row_slices, stream, text_buffer, thin
from codemix.llm.order import numbered
from codemix.operators.lookup import lookup
from codemix.session import broadcast_if_small, small_batches, stored

SUPPORT, SHARDS, LONGEST = 10, 4, 3
UNKNOWN = "und"
#: Counts that a task holds before it hands them on.
HELD_KEYS, HELD_PHRASES = 1_000_000, 400_000
#: Counts travel packed, by parts of the phrases; a task sums one part at a time, after so many rows again.
PARTS, SUMMED_ROWS = 1024, 500_000

#: White space inside a piece, and characters that end one.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True
HARD = np.zeros(256, bool)
HARD[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Slices:
    """The words of some texts, which of them stand next to each other in a piece, and keys of phrases."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        self.hasher, self.langs = WordHasher(True, breaks=BLANK | HARD), langs
        self.data, self.bounds = text_buffer(texts)
        found: dict[str, np.uint64] = {}
        for lang in langs:
            if lang not in found:
                found[lang] = np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "<u8")[0]
        self.tongue = np.array([found[g] for g in langs], np.uint64)

    def __iter__(self) -> Iterator["Slices"]:
        for a, b in row_slices(self.bounds):
            base = int(self.bounds[a])
            self.part = self.data[base:int(self.bounds[b])]
            bounds = self.bounds[a:b + 1] - base
            self.starts, self.ends = self.hasher.spans(self.part, bounds)
            self.rows = a + np.searchsorted(bounds, self.starts, "right") - 1
            self.words = self.hasher.hashes(self.part, self.starts, self.ends)
            breaks = np.concatenate([[0], np.cumsum(HARD[self.part])])
            self.joined = np.zeros(len(self.starts), bool)  # with the next word
            self.joined[:-1] = (self.rows[1:] == self.rows[:-1]) & (breaks[self.starts[1:]] == breaks[self.ends[:-1]])
            yield self

    def keys(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... words: where the phrases of a piece start, and their keys."""
        at, key, length = np.arange(len(self.words)), mix(self.words ^ self.tongue[self.rows]), 1
        while True:
            yield at, key
            on = self.joined[at + length - 1]
            at, key = at[on], mix(key[on] * _STEP + self.words[at[on] + length])
            length += 1

    def frequent(self, length: int, filter_: np.ndarray | None, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and keys of the phrases of ``length`` words whose parts one word shorter are in the filter.

        ``salts`` holds, per text, what tells its shard's keys apart there.
        """
        steps = self.keys()
        for _ in range(length - 1):
            at, key = next(steps)
        if length > 1:
            ok = np.zeros(len(self.words) + 1, bool)
            ok[at[bloom.known(filter_, key ^ salts[self.rows[at]])]] = True
        at, key = next(steps)
        if length > 1:
            on = ok[at] & ok[at + 1]
            at, key = at[on], key[on]
        return at, key


def _salts(shards: int) -> np.ndarray:
    return stream(131, shards)


def _mine(length: int, filter_, salts: np.ndarray):
    """(shard, key, n) of the phrases of ``length`` words, summed over what a task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            for shard, keys in held.items():
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(key), shard, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["shard", "key", "n"])
            held.clear()

        for batch in thin(batches, "text"):
            shards = batch.column("shard").to_numpy()
            for part in Slices(batch.column("text"), batch.column("lang").to_pylist()):
                at, key = part.frequent(length, None if filter_ is None else filter_.value, salts[shards])
                of = shards[part.rows[at]]
                for shard in np.unique(of).tolist():
                    held.setdefault(shard, []).append(key[of == shard])
                size += len(key)
                if size > HELD_KEYS:
                    yield from close()
                    size = 0
        yield from close()

    return run


class Tally:
    """Counts of candidates that a task holds, by two 64-bit keys; phrases are written out once per key.

    Phrases stand one after the other as bytes in the order in which they came; ``place`` is where a key's is.
    """

    def __init__(self, longest: int, filter_: np.ndarray):
        self.longest, self.filter = longest, filter_
        self.langs: dict[str, int] = {}
        self.empty()

    def empty(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.n, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tongue, self.words, self.sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        self.bytes = [np.zeros(0, np.uint8)]
        self.totals: dict[str, int] = {}

    def rows(self) -> pa.RecordBatch:
        n, by = np.empty(len(self.n), np.int64), np.empty(len(self.n), np.uint64)
        n[self.place], by[self.place] = self.n, self.key
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype(np.int64)
        phrases = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(self.bytes))])
        known = pa.array(list(self.langs), pa.string()).take(pa.array(np.concatenate(self.tongue)))
        rest = len(self.totals)
        out = pa.RecordBatch.from_arrays([
            pa.concat_arrays([known, pa.array(list(self.totals), pa.string())]),
            pa.array(np.concatenate([*self.words, np.zeros(rest, np.int32)])),
            pa.concat_arrays([phrases.cast(pa.binary()).cast(pa.string()), pa.array([""] * rest, pa.string())]),
            pa.array(np.concatenate([n, np.array(list(self.totals.values()), np.int64)])),
            pa.array(np.concatenate([by, np.zeros(rest, np.uint64)]) % np.uint64(PARTS))],
            ["lang", "words", "phrase", "n", "part"])
        self.empty()
        return out

    def _write(self, part: Slices, text: np.ndarray, length: int, start: np.ndarray) -> None:
        """Append phrases of ``length`` words: their bytes, words joined by one space."""
        at = (start[:, None] + np.arange(length)).ravel()
        begin, size = part.starts[at], part.ends[at] - part.starts[at]
        room = size + 1
        room[length - 1::length] -= 1
        before = np.cumsum(size) - size
        run = np.arange(int(size.sum()), dtype=np.int32)
        out = np.full(int(room.sum()), 0x20, np.uint8)
        out[run + np.repeat((np.cumsum(room) - room - before).astype(np.int32), size)] = text[run + np.repeat((begin - before).astype(np.int32), size)]
        self.bytes.append(out)
        self.sizes.append(room.reshape(-1, length).sum(axis=1))
        rows, number = np.unique(part.rows[start], return_inverse=True)
        codes = np.array([self.langs.setdefault(part.langs[r], len(self.langs)) for r in rows.tolist()], np.int32)
        self.tongue.append(codes[number])
        self.words.append(np.full(len(start), length, np.int32))

    def add(self, part: Slices) -> Iterator[pa.RecordBatch]:
        """Count a slice; hands on what is held when it is much, or when two phrases share a key."""
        rows, n = np.unique(part.rows, return_counts=True)
        for row, times in zip(rows.tolist(), n.tolist(), strict=True):
            self.totals[part.langs[row]] = self.totals.get(part.langs[row], 0) + times
        text, other = np.frombuffer(part.part.tobytes().lower(), np.uint8), part.words * _STEP
        for length, (at, key) in zip(range(1, self.longest + 1), part.keys()):
            hit = bloom.known(self.filter, key)  # only candidates are sorted
            start, key = at[hit], key[hit]
            check = part.tongue[part.rows[start]]
            for j in range(length):
                check = mix(check + other[start + j])
            yield from self._merge(part, text, length, *_grouped(start, key, check))

    def _merge(self, part: Slices, text: np.ndarray, length: int, start, key, check, times) -> Iterator[pa.RecordBatch]:
        """Add phrases sorted by their keys."""
        spot = np.searchsorted(self.key, key)
        held = spot < len(self.key)
        held[held] = self.key[spot[held]] == key[held]
        if len(self.key) > HELD_PHRASES or (self.check[spot[held]] != check[held]).any():
            yield self.rows()
            spot[:], held[:] = 0, False
        twins = np.flatnonzero(key[1:] == key[:-1]) + 1  # two phrases of a slice with one key: all but one go on alone
        if len(twins):
            alone = Tally(self.longest, self.filter)
            for k in twins.tolist():
                yield from alone._merge(part, text, length, start[k:k + 1], key[k:k + 1], check[k:k + 1], times[k:k + 1])
                yield alone.rows()
            stay = np.ones(len(key), bool)
            stay[twins] = False
            start, key, check, times, spot, held = (x[stay] for x in (start, key, check, times, spot, held))
        self.n[spot[held]] += times[held]
        new = np.flatnonzero(~held)
        if not len(new):
            return
        self._write(part, text, length, start[new])
        places = len(self.n) + np.arange(len(new))
        for name, rest in (("key", key[new]), ("check", check[new]), ("n", times[new]), ("place", places)):
            setattr(self, name, np.insert(getattr(self, name), spot[new], rest))


def _grouped(start: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, ...]:
    """A start, the keys and the count of every phrase, by rising keys."""
    order = np.argsort(key)
    sorted_key, sorted_check = key[order], check[order]
    if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_check[1:] != sorted_check[:-1])).any():
        order = np.lexsort((check, key))  # two phrases share a key
        sorted_key, sorted_check = key[order], check[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_check[1:] != sorted_check[:-1])
    first = np.flatnonzero(fresh)
    return start[order[first]], sorted_key[first], sorted_check[first], np.diff(np.append(first, len(order)))


def _possible(found: DataFrame, support: int, shards: int, least: int) -> DataFrame:
    """Keys of (shard, key, n) that may reach the support over all shards, with the shards where they are frequent.

    A shard that does not list a key holds it at most ``least - 1`` times.
    """
    most = F.col("n") + (shards - F.size("of")) * (least - 1)
    return (found.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("of"))
            .filter(most >= support).select("key", "of"))


COUNTED = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _packed(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(part, counts): the rows of every part as one Arrow message."""
    part = rows.column("part").to_numpy()
    order = np.argsort(part, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(part[order], prepend=np.uint64(PARTS))), len(order)).tolist()
    rows = rows.select(COUNTED.names)
    for a in range(0, len(edges) - 1, 64):
        runs = list(zip(edges[a:a + 64], edges[a + 1:a + 65]))
        first = runs[0][0]
        some = rows.take(pa.array(order[first:runs[-1][1]]))
        yield pa.RecordBatch.from_arrays([
            pa.array([int(part[order[s]]) for s, _ in runs], pa.int32()),
            pa.array([some.slice(s - first, e - s).serialize().to_pybytes() for s, e in runs], pa.binary())], ["part", "counts"])
    del rows
    give_back()


def _count(longest: int, filter_):
    """(part, counts) of the candidates: packed lang, words, phrase, n; words 0 counts all word occurrences of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(longest, filter_.value)
        for batch in thin(batches, "text"):
            for part in Slices(batch.column("text"), batch.column("lang").to_pylist()):
                for rows in tally.add(part):
                    yield from _packed(rows)
        yield from _packed(tally.rows())

    return run


def _sum(support: int):
    """(lang, words, phrase, n) of the phrases that reach the support, and all rows of 0 words, from packed counts sorted by part."""

    def summed(held: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(held, COUNTED).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
        return rows.rename_columns({"n_sum": "n"}).select(COUNTED.names).cast(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, room = None, [], 0, SUMMED_ROWS

        def close() -> Iterator[pa.RecordBatch]:
            rows = summed(held)
            keep = pc.or_(pc.greater_equal(rows["n"], support), pc.equal(rows["words"], 0))
            yield from rows.filter(keep).to_batches()

        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                if now is not None and part != now:
                    yield from close()
                    held, size, room = [], 0, SUMMED_ROWS
                now = part
                rows = pa.ipc.read_record_batch(counts.as_buffer(), COUNTED)
                held.append(rows)
                size += rows.num_rows
                if size > room:
                    held = summed(held).to_batches()
                    size = sum(x.num_rows for x in held)
                    room = max(SUMMED_ROWS, 2 * size)
        if held:
            yield from close()

    return run


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of 1 to ``longest`` words that occur ``support`` times.

    A row of 0 words holds the number of all word occurrences of a language.
    """
    if not 1 <= shards < max(support, 2):
        raise ValueError("the support of a shard must exceed one occurrence")
    least = -(-support // shards)
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text",
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    salts = _salts(shards)
    salt = F.element_at(F.array(*[F.lit(int(x)) for x in salts.view(np.int64)]), F.col("shard") + 1)
    union, filter_ = None, None
    for length in range(1, longest + 1):
        local = rows.mapInArrow(_mine(length, filter_, salts), "shard int, key bigint, n bigint")
        found = local.groupBy("shard", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        found = stored(_possible(found, support, shards, least), "frequent")
        if filter_ is not None:
            filter_.destroy()
        union = found.select("key") if union is None else union.unionByName(found.select("key"))
        keys = union if length == longest else found.select("key", F.explode("of").alias("shard")).select(
            F.col("key").bitwiseXOR(salt).alias("key"))
        filter_ = sc.broadcast(bloom.build(keys, distinct=True))
    counted = rows.select("lang", "text").mapInArrow(_count(longest, filter_), "part int, counts binary")
    out = stored(counted.repartition("part").sortWithinPartitions("part")
                 .mapInArrow(_sum(support), "lang string, words int, phrase string, n bigint"), "counts")
    filter_.destroy()
    return out


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("list", first, length), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, longest: int = LONGEST,
                 top: int | None = 2000, covered: int = 50) -> DataFrame:
    """Phrases of 2 to ``longest`` words by how much they hold together: lang, rank, phrase, a, l, r, n, score.

    ``docs`` needs doc_id, text and lang.  A-Z count as a-z; pieces end at
    ``[.,;:!?\\x0A-\\x0D]``, their words are runs of ``[^\\x20\\x09]``.  ``a`` counts a phrase in
    the documents of a language (null: und), at least ``support`` times.  Each cut into a first
    and a last part, which occur l and r times, scores floor(1000000 * a * a / (l * r)); the
    cut of the lowest score counts, then the shortest first part.  Products are decimals of 38
    digits.  A phrase goes when a longer one with ``covered`` percent of its occurrences holds
    it.  The first ``top`` of a language stay (None: all), by score, a and phrase; n counts the
    words of the language.  Null text is empty; repeated rows count each; an empty table, or
    one without a frequent phrase, gives no rows.
    """
    counts = phrase_counts(docs, support, shards, longest)
    some = counts.filter(F.col("words") > 1).withColumn("list", F.split("phrase", " ")).withColumnRenamed("n", "a")
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"),
        _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = counts.filter((F.col("words") > 0) & (F.col("words") < longest))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = lookup(cuts, known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side],
                      F.col("phrase"))
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    scored = cuts.withColumn("up", exact["a"] * exact["a"] * F.lit(1000000)).withColumn(
        "down", exact["l"] * exact["r"]).withColumn("score", F.expr("up div down"))
    inner = some.filter(F.col("words") > 2).withColumn("w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("w") + 1))).select(
        "lang", _part(F.col("from"), F.col("w")).alias("phrase"), F.col("a").alias("longer"))
    both = scored.select("lang", "phrase", "a", F.struct("score", "k", "l", "r").alias("cut")).unionByName(
        inner, allowMissingColumns=True)
    best = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    kept = best.filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    ranked = numbered(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "lang",
                      F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = ranked if top is None else ranked.filter(F.col("pos") < top)
    totals = counts.filter(F.col("words") == 0).select("lang", "n")
    return ranked.join(broadcast_if_small(totals), "lang").select(
        "lang", (F.col("pos") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
