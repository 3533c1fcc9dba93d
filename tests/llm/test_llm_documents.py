"""Operators over documents against brute force, with nulls, empties, ties, repeats and clashing names."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codemix.llm import langid, line_dedup, mixing, near_dedup, packing
from codemix.llm.common import WordHasher, row_slices, text_buffer
from codemix.llm.registered import BPE as BPE_NAME, tokenizer_file

BPE = tokenizer_file(BPE_NAME)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLANKS = " \t\n\x0b\x0c\r"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))


def jargon(rng, n, size=60):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(n))


def test_word_hashes_tell_words_apart():
    texts = ["Hello world  HELLO\tx", "", None, "ab", "cd ", "  é ü é", "a\nb\x0bc\x0c", "x" * 5000 + " y"]
    data, bounds = text_buffer(pa.array(texts))
    hashes, cuts = WordHasher(True).words(data, bounds)
    found = {}
    for i, text in enumerate(texts):
        words = words_of(text)
        assert cuts[i + 1] - cuts[i] == len(words)
        for word, value in zip(words, hashes[cuts[i]:cuts[i + 1]].tolist(), strict=True):
            assert found.setdefault(word, value) == value
    assert len(set(found.values())) == len(found)
    long = np.frombuffer(b"word " * 600_000, np.uint8)
    assert len(set(WordHasher(True).words(long, np.array([0, len(long)]))[0].tolist())) == 1
    assert list(row_slices(np.array([0, 5, 100, 101]), 10)) == [(0, 1), (1, 2), (2, 3)]


# --- line dedup ---

def plain_line_dedup(rows, min_docs, keep_first):
    def key(line):
        return lowered(line.strip(BLANKS))

    seen, first = Counter(), {}
    for i, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")} - {""}:
            seen[k] += 1
            at = [key(x) for x in (text or "").split("\n")].index(k)
            first[k] = min(first.get(k, ((1 << 62), 0, 0)), (doc_id, at, i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < min_docs or keep_first and first[key(x)][2] == i]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("min_docs,keep_first", [(2, False), (3, True), (10, False)])
def test_line_dedup_is_brute_force(spark, min_docs, keep_first):
    rng = random.Random(min_docs)
    pool = ["The Line", "the line ", "\tthe line\r", "", "  ", "É x", "é x", *(f"n{i}" for i in range(40))]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "lone line\n" * 3 + "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [tuple(r) for r in line_dedup.dedup_lines(df, min_docs, keep_first).orderBy("doc_id").collect()]
    assert got == plain_line_dedup(rows, min_docs, keep_first)


def test_line_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n_lines string, at int, hi int")
    assert line_dedup.dedup_lines(empty, 2).collect() == []
    twice = spark.createDataFrame([(1, "a\nb", "x", 7), (1, "a\nb", "x", 7), (None, "b", "x", 7), (None, None, "x", 7)],
                                  "doc_id bigint, text string, n_lines string, hi int")
    got = line_dedup.dedup_lines(twice, 2)
    assert got.columns == ["doc_id", "text", "hi", "n_lines", "n_dropped"]
    assert sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == [
        (-1, "", 1, 0), (-1, "", 1, 1), (1, "", 2, 2), (1, "", 2, 2)]


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_BITS", 1 << 20)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1 << 20)
    rows = [(i, f"line {i % 7}\nown {i}") for i in range(30)]
    monkeypatch.setattr(line_dedup, "twice_seen", lambda docs, size: np.full(size // 8, 255, np.uint8))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in line_dedup.dedup_lines(df, 2).orderBy("doc_id").collect()]
    assert got == plain_line_dedup(rows, 2, False)


# --- near duplicates ---

def plain_sets(rows, k):
    out = {}
    for doc_id, text in rows:
        w = words_of(text)
        out[doc_id] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def plain_components(rows, k, percent=80):
    sets = plain_sets(rows, k)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(rng, n):
    """A chain of slowly drifting copies, stars of near copies and exact copies."""
    rows, base = [], jargon(rng, 80).split()
    for _ in range(n):
        base = list(base)
        base[rng.randrange(len(base))] = jargon(rng, 1)
        rows.append(" ".join(base))
    star = jargon(rng, 60).split()
    for _ in range(n):
        copy = list(star)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = jargon(rng, 1)
        rows.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    rows += [jargon(rng, 30) for _ in range(n)] + ["one", "One ", "two words", "two  words", None, "", "  \n", "x" * 90_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_brute_force(spark, words):
    rows = near_copies(random.Random(words), 40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, words).collect()}
    assert got == plain_components(rows, words)


def test_open_buckets_compare_all_their_components(spark):
    """A bucket of three whose pivot links to neither: the other two still meet."""
    base = [f"w{i}" for i in range(100)]
    near = base[:86] + [f"p{i}" for i in range(14)]
    twin = near[:85] + ["q0"] + near[86:]
    rows = [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(twin))]
    reps = spark.createDataFrame([(i, 99, [1], [2], None) for i, _ in rows],
                                 "doc_id bigint, n bigint, u array<bigint>, v array<bigint>, spread binary")
    links, labels = near_dedup.links_of(reps, spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80)
    expect = plain_components(rows, 2)
    assert {tuple(r) for r in links.collect()} == {(1, 2)}
    assert {r.id: r.label for r in labels.collect()} == {i: c for i, (_, c) in expect.items() if i}


def test_open_rows_are_sent_once_a_band(spark, monkeypatch, tmp_path):
    """Near copies share up to 96 tables; their counts of shingles travel once for each of 8 bands."""
    rng, words = random.Random(3), [f"w{i}" for i in range(400)]
    texts = [[w if rng.random() < 0.98 else f"{w}-{k}" for w in words] for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    reps = docs.mapInArrow(near_dedup._sign(2), near_dedup._SIGNED)
    log, meet = str(tmp_path / "rows"), near_dedup._meet

    def counting(percent):
        inner = meet(percent)

        def run(batches):
            def seen():
                for batch in batches:
                    with open(log, "a") as f:
                        f.write(f"{batch.num_rows}\n")
                    yield batch

            yield from inner(seen())

        return run

    monkeypatch.setattr(near_dedup, "_meet", counting)
    monkeypatch.setattr(near_dedup, "components", lambda links: spark.createDataFrame([(0, 0)], "id bigint, label bigint"))
    rows = near_dedup._buckets(reps)
    open_ = near_dedup._open(rows.filter("id != pivot").select("u", "key", "id", "n"), near_dedup.components(None))
    tables = open_.count()
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *_: pairs)
    monkeypatch.setattr(near_dedup, "_open", lambda rows, labels, first=[open_]: first.pop() if first else open_.limit(0))
    links, _ = near_dedup.links_of(reps, docs, 2, 80)
    assert {(r.a, r.b) for r in links.collect()} >= {(a, a + 1) for a in range(1, 39)}
    with open(log) as f:
        sent = sum(map(int, f))
    assert tables > 1000 and sent <= 2 * near_dedup.BANDS_U * 40


def test_long_texts_of_an_open_bucket_still_meet(spark):
    """Two alike sets of more than 80,000 shingles, without known counts, whose pivot links to neither."""
    near = [f"w{i}" for i in range(84_000)]
    rows = [(0, " ".join(f"p{i}" for i in range(84_000))), (1, " ".join(near)), (2, " ".join([*near, "q"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = docs.mapInArrow(near_dedup._sign(2), near_dedup._SIGNED)
    assert signed.filter("spread IS NULL AND n > 80000").count() == 3
    reps = signed.select("doc_id", "n", F.array(F.lit(1).cast("bigint")).alias("u"),
                         F.array(F.lit(2).cast("bigint")).alias("v"), "spread")
    links, labels = near_dedup.links_of(reps, docs, 2, 80)
    assert {tuple(r) for r in links.collect()} == {(1, 2)}
    assert {r.id: r.label for r in labels.collect()} == {1: 1, 2: 1}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.id: r.label for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert near_dedup.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_duplicate_edges(spark):
    shape = "doc_id bigint, text string, component_id string, n int, kept int"
    assert near_dedup.near_duplicates(spark.createDataFrame([], shape)).collect() == []
    rows = [(5, "a b c", None, 1, 1), (5, "a b c", None, 1, 1), (3, "A b  C", "z", 1, 1), (None, "a b c", "z", 1, 1),
            (9, None, None, None, None), (8, "", "", 0, 0)]
    df = spark.createDataFrame(rows, shape)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 2).collect())
    assert got == [(0, 2, None, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (8, 0, 8, True), (9, 0, 9, True)]
    left = near_dedup.drop_near_duplicates(df, 2, 80)
    assert left.columns == df.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 8, 9]


# --- language ---

def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=5)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, lens = rng.integers(97, 110, 23).astype(np.uint8), np.array([9, 7, 4, 3])
    args = (data, np.cumsum(lens) - lens, lens, np.repeat([0, 1, 2, 1], lens), rng.random(23))
    grads = net.gradients(*args)[1]
    for name, value in net.weights.items():
        for _ in range(5):
            at = tuple(int(rng.integers(0, n)) for n in value.shape)
            if name.startswith("in_"):
                at = (int(data[rng.integers(0, 23)]), at[1])
            keep, sides = value[at], []
            for step in (1e-4, -1e-4):
                value[at] = keep + step
                sides.append(net.gradients(*args)[0])
            value[at] = keep
            assert abs((sides[0] - sides[1]) / 2e-4 - grads[name][at]) < 1e-5


def test_language_of_held_out_documents(spark):
    rng = random.Random(4)
    stems = {"xa": ["kuru", "mane", "tosi", "hako"], "yb": ["brist", "klem", "grond", "schtu"], "zc": ["éloi", "oux", "ière"]}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(stems))
        rows.append((i, " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(25)), lang, "s", 1))
    rows += [(900, None, "xa", "s", 1), (901, "12 -- 34", "xa", "s", 1), (902, "", None, None, None), (903, "→ …", "yb", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df, langid.train(df, epochs=4)).withColumn(
        "held_out", langid.held_out()).collect()}
    assert {i: r.held_out for i, r in got.items()} == {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    held = [r for r in rows[:240] if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held) and held
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert langid.identify(empty, langid.train(empty)).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None, None, None), (None, "abc", None, None, None)], DOCS)
    got = langid.identify(unlabelled, langid.train(unlabelled)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_memory_and_long_words_change_nothing():
    net = langid.Network(["a", "b"])
    texts = pa.array(["word " * 50 + "x" * 500, "word other", None, "é" * 100])
    once = net.documents(texts)
    again = net.documents(texts)
    fresh = langid.Network(["a", "b"])
    fresh.weights = net.weights
    assert np.allclose(once[0], again[0]) and np.allclose(fresh.documents(texts)[0], once[0])
    assert once[1].tolist() == [True, True, False, True]


# --- mixing ---

def test_copies_follow_the_poisson_distribution(spark):
    rows = [(i, f"t{i}", None, "big" if i % 3 else "small", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix_sources(df, {"big": 0.5, "small": 0.5}, total=6000)
    per = {r.source: r.n for r in mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(per["big"] - 3000) < 250 and abs(per["small"] - 3000) < 250
    copies = Counter(mixed.filter("source = 'small'").groupBy("doc_id").count().rdd.map(lambda r: r["count"]).collect())
    share = {k: np.exp(-1.5) * 1.5 ** k / f for k, f in ((1, 1), (2, 2), (3, 6))}
    assert all(abs(copies[k] / 2000 - p) < 0.04 for k, p in share.items())
    again = mixing.mix_sources(df.repartition(7), {"big": 0.5, "small": 0.5}, total=6000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_large_means_and_edges(spark):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(900.0)).alias("s")).first().s
    assert abs(sum(1 - x for x in steps) - 900) < 1e-6
    df = spark.createDataFrame([(1, "a", "x", None, None, 9), (None, None, "y", "s", 1, 9), (None, None, "y", "s", 1, 9)],
                               DOCS + ", copy int")
    got = mixing.mix_sources(df, {None: 1.0}, total=5)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy", "order_key"]
    assert {r.source for r in got.collect()} <= {None}
    assert mixing.mix_sources(df, {"other": 1.0}).collect() == []
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"s": -1.0})


# --- packing ---

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_chunked_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    texts = ["a b  c\n\n d\t e ", "", "x  y", " lead", "trail  ", "foo <|endoftext|> bar<|endoftext|>\n", "don't we'll I'm\r\n\r\n'd",
             "日本 語  é", "\n", "a\x0b\x0cb", "\x85 q", "n\xa0 b", "　 x", None, "   ", "a\x1c b"]
    texts += ["".join(rng.choice(" \n\t ab'é.1  ,s<|\xa0") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = [x.tolist() for x in packing.Chunked(BPE).ids(pa.array(texts))]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_fill_reaches_the_closest_sum():
    rng = random.Random(2)
    for _ in range(60):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 9)))
        used = packing.fill(counts, 50)
        sums = {0}
        items = [k for k, n in counts.items() for _ in range(n)]
        top = max(items)
        items.remove(top)
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in used.items()) == max(s + top for s in sums if s + top <= 50)
        assert all(n <= counts[k] for k, n in used.items()) and used[top] >= 1


def test_packing_is_exact(spark, tokenizer):
    rng = random.Random(3)
    texts = [jargon(rng, rng.choice([1, 5, 50, 300, 900])) for _ in range(80)] + [None, "", "x " * 9000, "same", "same"]
    df = spark.createDataFrame([(i if i != 3 else None, t, "c") for i, t in enumerate(texts)],
                               "doc_id bigint, text string, length string").repartition(3)
    rows = packing.pack(df, BPE).collect()
    ids = {i if i != 3 else None: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for doc, tokens in ids.items():
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        at = 0
        for r in own:
            part = np.array(tokens[at:at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(tokens), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(tokens)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    waste = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        waste += 1024 - at
    assert waste <= 3 * 1023
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), BPE).collect() == []


def test_segments_are_counted_in_small_batches(monkeypatch):
    """A large Arrow batch is cut, and the counts are those of the whole."""
    seen, cut = [], langid.segments
    monkeypatch.setattr(langid, "segments", lambda hasher, data, bounds: seen.append(len(data)) or cut(hasher, data, bounds))
    batch = pa.RecordBatch.from_pydict({"text": ["one two " * 5000] * 300, "lang": ["en", "fr"] * 150})
    got = Counter()
    for out in langid._counted(iter([batch])):
        for r in out.to_pylist():
            got[r["lang"], r["segment"]] += r["n"]
    assert max(seen) <= 5 << 20 and set(got.values()) == {150 * 5000} and len(got) == 4
