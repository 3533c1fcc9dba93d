"""Steps shared by the queries on translations: batch digests, the derived candidates, dropped edges."""

import random
from hashlib import md5

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from codemix.functions.batches import count_words, n_words
from codemix.functions.digests import md5_words
from codemix.functions.text import BLANK_CHARS, words
from codemix.operators import align, lexsub, switch
from codemix.operators.lookup import hot_keys
from codemix.plans import corpora


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_digests_equal_hashlib():
    messages = [b"x" * k for k in range(130)] + [b"0:%d:%d:xx" % (i ** 3, i) for i in range(9000)]
    got = md5_words(pa.array(messages)[3:])
    assert [got[:, k].astype(">u4").tobytes() for k in range(got.shape[1])] == [md5(m).digest() for m in messages[3:]]
    assert md5_words(pa.array([], pa.string())).shape == (4, 0)


def _candidate(sid, words, tgt):
    hexed = lambda i, tag: md5(":".join(["0", *([] if sid is None else [str(sid)]), str(i), tag]).encode()).hexdigest()
    kept = sorted((i // 2, h[8:16], i, h) for i, h in ((i, hexed(i, tgt)) for i in range(len(words))) if h[:2] >= "1a")
    bad = int(hexed(0, "bad:" + tgt)[:8], 16) % 30
    limit = (len(kept) + 2) // 3 if bad == 0 else len(kept)
    edges = set()
    for j, (_, _, i, h) in enumerate(kept[:limit]):
        edges |= {(i, j)} | ({(i - 1, j)} if h[16:18] < "25" and i else set()) | (
            {(i - 2, j)} if h[24:26] < "14" and i > 1 else set())
    texts = [f"{s}-{t}" for s, t in sorted(edges)] + ([f"{len(words)}-0"] if bad == 3 else [])
    text = " ".join(words) if bad == 2 else " ".join(f"{words[i]}_{tgt}" for _, _, i, _ in kept[:limit])
    return text, "" if bad == 1 else " ".join(texts)


def test_candidates_follow_their_draws(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(None if k == 7 else k * 10_000_001 - 50, " ".join(rng.choice("aé") * rng.randint(1, 3) for _ in range(1 + k % 40)))
            for k in range(300)]
    monkeypatch.setattr(corpora, "sentences", lambda *_: spark.createDataFrame(rows, "sent_id bigint, text string"))
    monkeypatch.setattr(corpora, "SLICE", 50)
    built = corpora._build_candidates(spark, "")
    assert "transform(" not in plan(built)  # no interpreted lambda per word
    got = {(r.sent_id, r.lang_idx): (r.lang, r.text, r.alignment) for r in built.collect()}
    assert got == {(sid, k): (t, *_candidate(sid, text.split(" "), t))
                   for sid, text in rows for k, t in enumerate(corpora.TARGETS)}


def test_alignments_are_parsed_once_over_batches(spark):
    rows = [("0-0 1-2 9-0",), (" 10-3\t x 1-12  1-2 10-3 ",), ("",), (None,), ("   ",), ("1234567890-0 0-0-0 -1-0 5- 7",),
            ("999999999-123456789 3-1",), ("é-1 2-2",)]
    df = spark.createDataFrame(rows, "alignment string").coalesce(1)
    parsed = align.parse_alignment(F.col("alignment"))
    want = [[(0, 0), (1, 2), (9, 0)], [(1, 2), (1, 12), (10, 3)], [], None, [], [], [(3, 1), (999999999, 123456789)], [(2, 2)]]
    assert [None if r.e is None else [tuple(e) for e in r.e] for r in df.select(parsed.alias("e")).collect()] == want
    plain = spark.createDataFrame([(f"{k}-{7 * k} {k + 1}-{10 ** (k % 9)}",) for k in range(100)], "alignment string")
    assert [[tuple(e) for e in r.e] for r in plain.select(parsed.alias("e")).collect()] == [
        [(k, 7 * k), (k + 1, 10 ** (k % 9))] for k in range(100)]
    sums = df.select(align.edge_sums(parsed).alias("e")).filter(F.col("e.n") > 0)
    assert [tuple(r.e) for r in sums.collect()] == [(len(w), sum(s for s, _ in w), sum(t for _, t in w)) for w in want if w]
    assert plan(sums).count("ArrowEvalPython") == 1 and "lambda" not in plan(sums)


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"doc_id": range(20_000), "text": [str(k) * 30 for k in range(20_000)]}), path)
    small, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    filled = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    try:
        spark.conf.set(small, "65536")
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() >= 4 and filled(docs) == 1  # splits enough, but one holds all rows
        assert filled(corpora.spread(docs, "doc_id")) >= 4
        assert corpora.spread(docs, "doc_id").count() == 20_000
    finally:
        spark.conf.set(small, old)
    even = spark.range(1000, numPartitions=8).withColumnRenamed("id", "doc_id")
    assert corpora.spread(even, "doc_id") is even
    assert corpora.spread(even.limit(0), "doc_id").count() == 0


def test_words_are_counted_like_they_are_split(spark):
    rng = random.Random(5)
    marks = BLANK_CHARS + "abé«’​中"
    texts = [None, "", " ", *("".join(rng.choice(marks if k % 2 else "ab  ") for _ in range(rng.randint(0, 12))) for k in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(n_words(F.col("text")).alias("n"), F.size(words(F.col("text"))).alias("m")).collect()
    assert all(r.n == r.m for r in rows) and rows[0].n is None
    assert count_words(pa.array(texts)[2:50]).tolist() == [r.n for r in rows[2:50]]


def test_candidates_are_judged_once(spark):
    long = " ".join(f"w{k}" for k in range(10))
    cases = [("0-0", long + "　", False), ("0-0", long + " x", True), ("0-0", "a b c d e", False), ("0-0", "a b c d e f", True),
             (" \t", "a " * 9, False), (None, "a " * 9, False), ("0-0", None, False), ("0-0", "  ", False), ("0-0", "a  b " * 8, True)]
    rows = [(1, long, [(k, f"l{k}", text, al) for k, (al, text, _) in enumerate(cases)]), (2, None, [(0, "l", long, "0-0")]),
            (3, "a", []), (4, "a", [(0, "l", "b", "0-0")])]
    df = spark.createDataFrame(rows, f"sent_id bigint, text string, cands {switch.CANDIDATE}").coalesce(1)
    done = switch.valid_candidates(df, switch.SwitchOptions())
    got = {r.sent_id: [c.lang_idx for c in r.cands] for r in done.collect()}
    assert got == {1: [k for k, (_, _, good) in enumerate(cases) if good], 4: [0]}
    kept = switch.valid_candidates(df, switch.SwitchOptions(copy_check=False, min_ratio=0.0)).filter("sent_id = 1")
    assert [c.lang_idx for c in kept.first().cands] == [0, 1, 2, 3, 8]
    assert [c.tw for c in kept.first().cands][3] == list("abcdef")
    # the filter on the number of candidates neither counts nor splits their words again
    assert plan(done).count("ArrowEvalPython") == 1 and plan(done).count("split(") == 2


def test_dropped_edges_take_the_sizes_once_per_row(spark):
    rows = [("0-0 1-2 9-0", 2, "a b"), (" 0-0\t x 1-1 ", 2, "a b"), ("", 1, "a"), (None, 1, "a"), ("0-0 1-1", None, "a"),
            ("0-0 1-1", 2, None), ("1234567890-0 0-0-0 -1-0", 2, "a b"), ("0-0", 1, "a")]
    df = spark.createDataFrame(rows, "alignment string, n int, tgt string")
    # an effect per evaluation would show in the plan: the split stands outside of any lambda
    out = df.select(align.dropped_edges(F.col("alignment"), F.col("n"), F.size(F.split("tgt", " "))).alias("d"))
    assert [r.d for r in out.collect()] == [2, 1, 0, 0, 2, 2, 3, 0]
    assert "lambda" not in plan(out)


def test_queues_are_drawn_in_batches(spark):
    rows = [(k, "a 12 c d", [(0, "xx", "A B C D", "0-0 1-1 2-2 3-3"), (1, None, "E F G H", "0-0 1-0 3-3")]) for k in (1, None)]
    df = spark.createDataFrame(rows, f"sent_id bigint, text string, cands {switch.CANDIDATE}")
    done = switch.with_phrases(switch.valid_candidates(df), switch.SwitchOptions(seed=5))
    for r in done.collect():
        for c, free in zip(r.cands, ([0, 2, 3], [0, 3]), strict=True):
            key = lambda at: ":".join(str(p) for p in (5, r.sent_id, at, c.lang and f"phrase:{c.lang}") if p is not None)
            at = [p.s[0] for p in c.phrases]
            want = [((int(md5(key(s).encode()).hexdigest()[:8], 16) >> 1) << 31) + k
                    for k, s in enumerate(at) if s in free and not (c.lang is None and s == 0)]
            assert c.queue == sorted(want)
    assert "md5(" not in plan(done)  # no interpreted draw per phrase


def test_only_accepted_words_are_joined_with_a_large_dictionary(spark, monkeypatch):
    lexicon = spark.createDataFrame([("en", "xx", w, w.upper()) for w in "abc"], "src_lang string, tgt_lang string, word string, translation string")
    df = spark.createDataFrame([(k, "en", list("abca")) for k in range(50)] + [(99, "en", []), (98, "fi", ["a"])],
                               "sent_id bigint, lang string, words array<string>")
    seen, lookup = [], lexsub.lookup
    monkeypatch.setattr(lexsub, "lookup", lambda tokens, *more: (seen.append(tokens.count()), lookup(tokens, *more))[1])
    run = lambda ratio, limit: lexsub.lex_substitute(df, lexicon, lexsub.LexiconOptions(ratio, broadcast_limit=limit))
    for ratio in (-1.0, 0.5, 1.0):
        assert sorted(map(str, run(ratio, 0).collect())) == sorted(map(str, run(ratio, 1 << 20).collect()))
    assert seen[0] == 0 and 0 < seen[1] < 200 < seen[2] == 201  # refused words stay in their rows


def test_hot_keys_are_counted_in_full_cells_only(spark):
    tokens = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "the").otherwise(F.col("id").cast("string")).alias("w"))
    assert [r.w for r in hot_keys(tokens, ["w"]).collect()] == ["the"]
    assert hot_keys(tokens.filter("w <> 'the'"), ["w"]) is None and hot_keys(tokens.limit(0), ["w"]) is None


def test_batches_of_long_texts_stay_small(spark):
    import pyarrow as pa

    from codemix import session

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        session.small_batches(spark, 1 << 20)
        rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 3000) t")
        assert max(r["n"] for r in rows.mapInArrow(sizes, "n bigint").collect()) < 2 << 20
        spark.conf.set(name, "1000")
        session.small_batches(spark)
        assert spark.conf.get(name).removesuffix("b") == "1000"
    finally:
        spark.conf.set(name, before)
