"""BPE automaton, Merkle manifest and phrases against brute force and the tokenizer's own library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codemix.llm import bloom, bpe_automaton, merkle, packing, phrases
from codemix.llm.registered import BPE, WORD_BPE, tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file(WORD_BPE))


@pytest.fixture(scope="module")
def codec():
    return bpe_automaton.Codec(tokenizer_file(WORD_BPE))


# --- BPE --------------------------------------------------------------------

def merged(word, merges, end="</w>"):
    """Merge by merge over the whole word, each from left to right."""
    units = [*word[:-1], word[-1] + end]
    for a, b in merges:
        i, out = 0, []
        while i < len(units):
            if units[i:i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(units[i])
                i += 1
        units = out
    return units


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_merging(seed):
    rng = random.Random(seed)
    alphabet = "ab" if seed % 2 else "abc"
    made, merges = [*alphabet, *(c + "</w>" for c in alphabet)], []
    while len(merges) < 25:
        a, b = rng.choice([m for m in made if not m.endswith("</w>")]), rng.choice(made)
        if a + b not in made and len(a + b) < 16:
            made.append(a + b)
            merges.append((a, b))
    tokens = {t: i for i, t in enumerate(made)}
    automaton = bpe_automaton.Automaton(tokens, merges, "</w>")
    words = ["".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(300)] + ["a" * 400, "ab" * 300]
    found, counts = automaton.paths(words)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for k, word in enumerate(words):
        assert found[bounds[k]:bounds[k + 1]].tolist() == [tokens[t] for t in merged(word, merges)], word


def test_merges_that_cannot_be_ranked_are_refused():
    tokens = {t: i for i, t in enumerate(["a", "a</w>", "aa", "aaa", "aaa</w>", "aa</w>"])}
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(tokens, [("aa", "a"), ("a", "a")], "</w>")
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(tokens, [("a", "a"), ("aa", "a"), ("a", "aa")], "</w>")


def test_codec_equals_the_library(codec, library):
    rng = random.Random(5)
    names = [t.replace("</w>", "") for t in library.get_vocab()]
    texts = [None, "", " \n\t", "<|endoftext|>x<|startoftext|> <|EndofText|>", "  a\x85b\xa0c  d\x1ce\x1ff",
             "́ é Å ΣΑΣ İ ß ﬁ", "x" * 1000, "don't we'll I'D 's", "a1b22 33c!?!" + "é" * 700]
    texts += ["".join(rng.choices("aabeeinrsth'o l0 é.,\n", k=rng.randint(0, 60))) for _ in range(500)]
    texts += [" ".join(rng.choices(names, k=5)) + "".join(rng.choices(names, k=3)) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 127), rng.randint(0x80, 0x3000), rng.randint(0x300, 0x370),
                                      rng.randint(0x10000, 0x1FFFF), 0x2028])) for _ in range(30)) for _ in range(500)]
    found, labels = list(codec.encode(pa.array(texts))), bpe_automaton.Labels(tokenizer_file(WORD_BPE))
    for text, ids in zip(texts, found, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert labels.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_encode_keeps_rows_and_columns(spark):
    path = tokenizer_file(WORD_BPE)
    rows = spark.createDataFrame([(1, "Some text", "x"), (1, "Some text", "x"), (None, None, None)],
                                 "doc_id bigint, text string, ids string")
    out = bpe_automaton.decode(bpe_automaton.encode(rows, path), path).withColumn(
        "list", bpe_automaton.id_list(F.col("ids")))
    assert out.columns == ["doc_id", "text", "ids", "decoded", "list"]
    got = sorted(out.collect(), key=lambda r: str(r.doc_id))
    assert [r.decoded for r in got] == ["some</w> text</w>"] * 2 + [""]
    assert len(got[0].list) == len(got[0].ids) // 4 == 2 and got[2].list == []
    assert bpe_automaton.encode(rows.limit(0), path).collect() == []
    missing = spark.createDataFrame([(None,)], "ids binary")
    assert bpe_automaton.decode(missing, path).first().decoded is None


# --- Merkle -----------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root and the path (siblings before, after per level) of every node."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        runs = [now[k:k + 16] for k in range(0, len(now), 16)]
        for k, place in enumerate(at):
            run, slot = runs[place // 16], place % 16
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at[k] = place // 16
        now = [sha("".join(r)) for r in runs]
    return now[0], paths


@pytest.mark.parametrize("sizes", [{"a": 1}, {"b": 600, "a": 17, None: 16, "": 1, "é": 257},
                                   {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = [(rng.randint(-50, 10 ** 6), rng.choice(["Text É", "", None, "lower"]) if n > 1 else "One", None, s, k)
            for s, n in sizes.items() for k in range(n)]
    rows = [(d, t, lang, s, n) for d, t, lang, s, n in rows]
    if len(rows) > 100:
        rows += [rows[0], rows[0], (None, "No id", "en", "b", None)]  # repeats and a null id
    docs = spark.createDataFrame(rows, DOCS).withColumn("hash", F.lit(1)).repartition(7)
    got = merkle.manifest(docs).withColumn("proof", merkle.proof_digest(F.col("path"))).withColumn(
        "folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn(
        "other", merkle.fold(F.sha2(F.lit("x"), 256), F.col("path"))).collect()
    by_source = {}
    for d, t, lang, s, n in rows:
        by_source.setdefault(s, []).append((d is not None, d or 0, leaf_of((d, s, lang, n, t)), d))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([r[2] for r in sorted(by_source[s])]) for s in names}
    root, upper = tree([inner[s][0] for s in names])
    want = []
    for k, s in enumerate(names):
        for r, path in zip(sorted(by_source[s]), inner[s][1], strict=True):
            whole = path + upper[k]
            want.append((str(r[3]), r[2], inner[s][0], root, sha("".join(a + b for a, b in whole))))
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in got) == sorted(want)
    assert all(r.folded == root and r.other != root for r in got)


def test_manifest_of_nothing_and_clashes(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(empty, carry={"pos": F.lit(1)})


def test_lowered_capitals_are_found(spark):
    docs = spark.createDataFrame([(k, "Ab" if k % 2 else "ab", "en", "s", 2) for k in range(40)], DOCS)
    lowered = [F.lower("text") if c == "text" else F.col(c) for c in merkle.FIELDS]
    out = merkle.manifest(docs, carry={"seen": merkle.leaf(lowered)}).withColumn(
        "ok", merkle.fold(F.col("seen"), F.col("path")) == F.col("root"))
    assert all(r.ok == (r.doc_id % 2 == 0) for r in out.collect())
    assert zlib.crc32(b"15") % 5 == docs.filter("doc_id = 15").select(F.crc32(F.lit("15")) % 5).first()[0]


# --- phrases ----------------------------------------------------------------

def brute_phrases(rows, support, longest, top, covered):
    counts, totals = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    key = (lang, tuple(words[i:i + n]))
                    counts[key] = counts.get(key, 0) + 1
    out = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < support:
            continue
        inside = [f for (g, w), f in counts.items() if g == lang and len(w) > len(words) and f >= support
                  and any(w[i:i + len(words)] == words for i in range(len(w) - len(words) + 1))]
        if any(100 * f >= covered * a for f in inside):
            continue
        cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, ri, totals[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, le, ri) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("support,shards,longest,top,covered", [(10, 4, 3, 2000, 50), (3, 2, 4, 5, 80), (10, 9, 2, 50, 50)])
def test_phrases_equal_brute_force(spark, support, shards, longest, top, covered):
    rng = random.Random(support)
    words = ["a", "B", "new", "york", "é", "ü\xa0x", "of", "the", "\x1cz"]
    rows = []
    for _ in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 8))) if rng.random() < 0.6 else "New \t York of" for _ in range(4)]
        rows.append((rng.choice([". ", "\n", "\x0b", " , ", "!? "]).join(parts), rng.choice(["en", "en", "fr", None, "und"])))
    rows += [rows[0]] * 3 + [(None, "en"), ("", "en"), (" \t ", None), ("the cat " * 4000, "xx"), ("x y", "lonely")]
    docs = spark.createDataFrame([(i if i % 9 else None, t, g, 7) for i, (t, g) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, shard int").repartition(5)
    got = phrases.collocations(docs, support, shards, longest, top, covered).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, support, longest, top, covered)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.collocations(docs).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(docs, support=4, shards=4)


def test_words_join_within_pieces_of_a_row():
    part = list(phrases.Slices(pa.array(["one two, three " * 9, "one two three " * 12]), ["en", "fr"]))
    assert [int(p.joined.sum()) for p in part] == [9 + 8 + 35]


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": ["a b c. a b"] * 3, "lang": ["en"] * 3, "shard": pa.array([0, 1, 1], pa.int32())})
    whole = pa.Table.from_batches(phrases._mine(1, None, phrases._salts(2))(iter([batch] * 4)))
    monkeypatch.setattr(phrases, "HELD_KEYS", 5)
    parts = pa.Table.from_batches(phrases._mine(1, None, phrases._salts(2))(iter([batch] * 4)))
    assert parts.num_rows > whole.num_rows == 6 and pc.sum(parts["n"]) == pc.sum(whole["n"])


def test_large_products_are_exact(spark):
    a, le, ri = 10 ** 15 + 7, 3 * 10 ** 15 + 11, 10 ** 15 + 9
    row = spark.range(1).selectExpr(f"cast({a} as decimal(19,0)) a", f"cast({le} as decimal(19,0)) l",
                                    f"cast({ri} as decimal(19,0)) r").withColumn(
        "up", F.col("a") * F.col("a") * F.lit(1000000)).withColumn("down", F.col("l") * F.col("r")).selectExpr("up div down as s")
    assert row.first().s == 1000000 * a * a // (le * ri)


def test_filter_misses_no_key(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(-2 ** 63, 2 ** 63 - 1, 30_000)
    bits = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "key bigint"))
    assert bloom.known(bits, keys.view(np.uint64)).all()
    other = rng.integers(-2 ** 63, 2 ** 63 - 1, 30_000).view(np.uint64)
    assert bloom.known(bits, other).mean() < 0.01
    assert bloom.size_for(10 ** 12) == bloom.MAX_BITS and not bloom.known(
        bloom.build(spark.createDataFrame([], "key bigint")), other).any()


def test_phrases_that_share_a_key_are_told_apart():
    class Few(phrases.Slices):
        def keys(self):
            for at, key in super().keys():
                yield at, key & np.uint64(7)

    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefghij", k=40)) for _ in range(12)]
    tally, got = phrases.Tally(2, np.full(1 << 17, 255, np.uint8)), Counter()
    for a in range(0, 12, 3):
        for part in Few(pa.array(texts[a:a + 3]), ["en", "fr", "en"]):
            for rows in [*tally.add(part), tally.rows()]:
                for row in rows.to_pylist():
                    got[row["lang"], row["phrase"]] += row["n"] if row["words"] else 0
    want = Counter()
    for k, text in enumerate(texts):
        words = text.split()
        for phrase in [*words, *map(" ".join, zip(words, words[1:]))]:
            want["fr" if k % 3 == 1 else "en", phrase] += 1
    assert +got == want


def test_keys_that_cannot_reach_the_support_go(spark):
    """Of 4 shards at a local support of 3 one that lists 3 leaves 6 at most to the others."""
    found = spark.createDataFrame([(0, 1, 3), (0, 2, 4), (0, 3, 3), (2, 3, 3), (1, 4, 3), (3, 5, 30)], "shard int, key bigint, n bigint")
    left = {r["key"]: sorted(r["of"]) for r in phrases._possible(found, 10, 4, 3).collect()}
    assert left == {2: [0], 3: [0, 2], 5: [3]}


def test_distinct_keys_make_the_same_filter(spark):
    keys = spark.createDataFrame([(k * 7919 << 20,) for k in range(5000)], "key bigint")
    assert (bloom.build(keys) == bloom.build(keys, distinct=True)).all()


def test_filter_comes_in_few_jobs(spark):
    """Not one job for each shuffle partition."""
    keys = spark.range(5000).selectExpr("id * 7919 as key")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("filter-jobs", "")
    try:
        bloom.build(keys)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("filter-jobs")) < 20


def test_counts_travel_packed_and_add_up(monkeypatch):
    """A task hands on a row for each part, not for each phrase; sums do not depend on when they are made."""
    texts = [" ".join(f"w{(k * j) % 997}" for j in range(3000)) for k in range(1, 4)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en", "fr", "en"]})
    monkeypatch.setattr(phrases, "PARTS", 16)
    every = type("Filter", (), {"value": np.full(1 << 17, 255, np.uint8)})
    sent = [r for _ in range(2) for x in phrases._count(2, every)(iter([batch])) for r in x.to_pylist()]
    assert len(sent) == 2 * 16
    sent.sort(key=lambda r: r["part"])
    rows = pa.RecordBatch.from_pylist(sent, pa.schema([("part", pa.int32()), ("counts", pa.binary())]))
    want = Counter()
    for lang, text in zip(["en", "fr", "en"], texts):
        words = text.split()
        want[lang, 0, ""] += 2 * len(words)
        want.update({(lang, 1, w): 2 * n for w, n in Counter(words).items()})
        want.update({(lang, 2, w): 2 * n for w, n in Counter(map(" ".join, zip(words, words[1:]))).items()})
    for limit in (500_000, 10):
        monkeypatch.setattr(phrases, "SUMMED_ROWS", limit)
        found = [r for x in phrases._sum(7)(iter(rows.slice(k, 3) for k in range(0, 32, 3))) for r in x.to_pylist()]
        assert {(r["lang"], r["words"], r["phrase"]): r["n"] for r in found} == {
            k: n for k, n in want.items() if n >= 7 or k[1] == 0}
        assert len(found) == len({(r["lang"], r["words"], r["phrase"]) for r in found})


def test_texts_are_tokenised_in_small_blocks(monkeypatch):
    seen = []
    whole = packing.Chunked._block
    monkeypatch.setattr(packing.Chunked, "_block", lambda self, data, bounds: seen.append(len(data)) or whole(self, data, bounds))
    texts = pa.array(["some words of a text " * 1000, None, "x"] * 100)
    found = list(packing.Chunked(tokenizer_file(BPE)).ids(texts))
    assert len(found) == 300 and max(seen) <= 1 << 18 and (found[0] == found[297]).all() and not len(found[1])
