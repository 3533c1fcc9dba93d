"""Sampling, packing, vocabulary, scores, sources, subwords: brute force and properties."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemix.functions import text as T
from codemix.functions.draw import draw
from codemix.operators import align, clean, corpus, embed, lexsub, pack, sample, score, subword, vocab
from codemix.operators.lookup import lookup
from codemix.plans import queries_vocab
from codemix.session import dense_order, stored
from codemix.sources import lexicon, lines, logs, store


def greedy(sizes, max_tokens, max_sentences, multiple):
    out, held = [], []

    def close():
        cut = max(multiple * (len(held) // multiple), len(held) % multiple)
        out.append(cut)
        del held[:cut]

    for s in sizes:
        while held and (len(held) >= max_sentences or (len(held) + 1) * max(max(held), s) > max_tokens):
            close()
        held.append(s)
    while held:
        close()
    return out


def test_next_starts_against_row_by_row():
    rng = random.Random(3)
    for _ in range(1500):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 120))]
        limits = rng.randint(20, 100), rng.choice([3, 8, 1000]), rng.choice([1, 2, 4, 8])
        following = pack.next_starts(np.array(sizes), len(sizes), *limits)
        got, at = [], 0
        while at < len(sizes):
            got.append(following[at] - at)
            at = following[at]
        assert got == greedy(sizes, *limits)
        exits, steps = pack.chunk_exits(following, 5)
        assert exits[0] == 0 and steps[0] == len(got)


@pytest.mark.parametrize("multiple, fan, limit", [(1, 2, 1 << 20), (8, 3, 0), (8, 64, 1 << 20)])
def test_pack_batches_rows(spark, monkeypatch, multiple, fan, limit):
    monkeypatch.setattr(pack, "BLOCK", 16)
    rng = random.Random(9)
    rows = [(i, rng.choice([5, 5, 5, rng.randint(1, 30)]), rng.randint(1, 30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "ex_id bigint, src_len int, tgt_len int")
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    for chunk in (64, 501, 1 << 18):
        got = pack.pack_batches(df, 200, 64, multiple, chunk=chunk, fan=fan, limit=limit).orderBy("rank").collect()
        assert [r["ex_id"] for r in got] == [r[0] for r in ordered]
        counts = greedy([max(r[1:]) for r in ordered], 200, 64, multiple)
        assert [r["batch_no"] for r in got] == [b for b, n in enumerate(counts) for _ in range(n)]


def test_no_rows_no_batches_and_the_only_batch(spark):
    shape = "ex_id bigint, src_len int, tgt_len int"
    assert pack.pack_batches(spark.createDataFrame([], shape), 200).collect() == []
    one = pack.pack_batches(spark.createDataFrame([(1, 3, 3), (2, 3, 3)], shape), 200)
    assert pack.assign_shards(one, 1, drop_remainder=True).count() == 2
    assert pack.assign_shards(one, 2, drop_remainder=True).count() == 0


def test_too_long_row_fails(spark):
    df = spark.createDataFrame([(1, 300, 5)], "ex_id bigint, src_len int, tgt_len int")
    with pytest.raises(Exception, match="exceeds the budget"):
        pack.pack_batches(df, 200).collect()


def test_smallest_with_heavy_ties(spark):
    df = spark.range(5000).withColumn("key", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50))
    for k in (0, 1, 100, 1700, 2500, 4999, 5000, 6000):
        got = sample.smallest(df, F.col("key"), "id", k, fine=40).select("key").collect()
        want = sorted(r["key"] for r in df.collect())[:k]
        assert sorted(r["key"] for r in got) == want


def test_subsample_size_and_epochs(spark):
    df = spark.range(1001)
    a = {r["id"] for r in sample.subsample(df, "id", 0.25, 3, 1).collect()}
    b = {r["id"] for r in sample.subsample(df.repartition(9), "id", 0.25, 3, 1).collect()}
    c = {r["id"] for r in sample.subsample(df, "id", 0.25, 3, 2).collect()}
    assert len(a) == math.ceil(1001 * 0.25) and a == b and a != c
    with pytest.raises(ValueError):
        sample.subsample(df, "id", 1.5)


def _skewed_parts(spark, n):
    part = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 31 == 0, F.lit(None)).otherwise(F.col("id") % n)
    return spark.range(4000).select("id", part.cast("int").alias("part"), F.lit("x").alias("kind"))


@pytest.mark.parametrize("bits", [16, 30])
def test_groups_at_once_equal_one_after_the_other(spark, monkeypatch, bits):
    monkeypatch.setattr(sample, "CELL_BITS", bits)  # wide cells: several rows around every cut-off
    df = _skewed_parts(spark, 7)
    ratio = F.when(F.col("part") == 0, 0.07).when(F.col("part") == 1, 0.0).when(F.col("part") == 2, 1.0).otherwise(0.4)
    got = sample.subsample_groups(df, "id", ratio, 3, 2, "kind", "part").collect()
    want, of = set(), lambda p: {0: 0.07, 1: 0.0, 2: 1.0}.get(p, 0.4)
    key = draw("42:3:2", F.col("id"), 0, "subsample")
    rows = df.select("id", "part", key.alias("key")).collect()
    for p in {r["part"] for r in rows}:
        mine = sorted((r["key"], r["id"]) for r in rows if r["part"] == p)
        want |= {i for _, i in mine[:math.ceil(len(mine) * of(p))]}
    assert {r["id"] for r in got} == want and len(got) == len(want)


def test_groups_with_tied_draws_and_a_salted_join(spark):
    df = _skewed_parts(spark, 5).withColumn("key", F.col("id") % 4 * (1 << 20))  # ties of about 250 rows
    run = lambda limit: {r["id"] for r in sample.smallest_draws(
        df, F.col("key"), "id", lambda n: F.floor(n / 3), "part", limit=limit).collect()}
    rows = df.select("id", "part", "key", F.xxhash64("id").cast("double").alias("h")).collect()
    want = set()
    for p in {r["part"] for r in rows}:
        mine = sorted((r["key"], r["h"], r["id"]) for r in rows if r["part"] == p)
        want |= {i for *_, i in mine[:len(mine) // 3]}
    assert run(1 << 20) == run(0) == want
    whole = sorted((r["key"], r["h"], r["id"]) for r in rows)
    for k in (0, 1, 999, 4000, 5000):
        one = sample.smallest_draws(df, F.col("key"), "id", lambda _: F.lit(k).cast("bigint"))
        assert {r["id"] for r in one.collect()} == {i for *_, i in whole[:k]}
    assert sample.subsample_groups(df.limit(0), "id", F.lit(0.5), 1, 1, "part").count() == 0


def test_jobs_do_not_grow_with_the_parts(spark):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"parts{n}", "")
        sample.subsample_groups(_skewed_parts(spark, n), "id", F.lit(0.4), 1, 1, "part").collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"parts{n}"))

    assert jobs(2) == jobs(60)


def test_weighted_replacement_follows_weights(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") == 5, 1000).otherwise(1))
    got = sample.subsample_with_replacement(df, "id", 1.0, weight="w", block=100)
    assert got.count() == 2000 and got.filter("id is null").count() == 0
    share = got.filter("id = 5").count() / 2000
    assert abs(share - 1000 / 2999) < 0.05


def test_replacement_with_fractions(spark):
    df = spark.range(400).withColumn("w", F.when(F.col("id") < 200, 0.5).when(F.col("id") < 300, 0.0).otherwise(1.5))
    for block in (50, 1 << 20):
        got = sample.subsample_with_replacement(df, "id", 1.0, weight="w", block=block)
        rows = [r["id"] for r in got.collect()]
        assert len(rows) == 400 and None not in rows and not [i for i in rows if 200 <= i < 300]
        assert abs(sum(i < 200 for i in rows) / 400 - 0.4) < 0.1
    halves = df.withColumn("w", F.lit(0.5))
    assert sample.subsample_with_replacement(halves, "id", 0.5, weight="w").count() == 200
    same = lambda w: sorted(map(tuple, sample.subsample_with_replacement(df.withColumn("w", F.lit(w)), "id", 0.5, weight="w").collect()))
    assert same(1.0) == same(4.0)


def test_dense_order(spark):
    df = spark.range(1000).withColumn("k", draw(0, F.col("id"), 0, "x") % 3)
    got = [(r["k"], r["id"]) for r in dense_order(df, F.col("k"), F.col("id")).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert dense_order(df.filter("id < 0"), F.col("id")).count() == 0


def test_lookup_salted_equals_broadcast(spark):
    tokens = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 7)).alias("word"))
    table = spark.createDataFrame([("hot", 1), ("w1", 2)], "word string, v int")
    run = lambda limit: sorted(map(str, lookup(tokens, table, ["word"], F.col("id"), limit).select("id", "word", "v").collect()))
    assert run(1 << 20) == run(0)
    nulls = tokens.withColumn("word", F.when(F.col("word") != "hot", F.col("word")))
    assert lookup(nulls, table, ["word"], F.col("id"), 0).filter("v is not null").count() == lookup(
        nulls, table, ["word"], F.col("id")).filter("v is not null").count() > 0
    assert lookup(nulls, table, ["word"], F.col("id"), 0).count() == 500


def test_ids_keep_empty_rows(spark):
    voc = spark.createDataFrame([(4, "a"), (5, "b")], "id bigint, token string")
    df = spark.createDataFrame([(1, ["a", "x", "b"]), (2, []), (3, None), (4, ["b"])], "ex_id bigint, words array<string>")
    for limit in (1 << 20, 0):
        enc = vocab.encode_ids(df, voc, limit=limit)
        assert {r.ex_id: r.ids for r in enc.collect()} == {1: [4, 3, 5, 2], 2: [2], 3: [2], 4: [5, 2]}
        text = {r.ex_id: r.text for r in vocab.decode_ids(enc, voc, "hyp", limit=limit).collect()}
        assert text == {1: "a UNKNOWNTOKENINHYP b", 2: "", 3: "", 4: "b"}
        assert vocab.encode_ids(df, voc.limit(0), limit=limit).count() == 4
    plan = vocab.encode_ids(df, voc)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lexicon_substitution_paths_agree(spark):
    lex = spark.createDataFrame([("en", "xx", "a", "A1"), ("en", "xx", "a", "A2"), ("en", "xx", "a", "A2"),
                                 ("en", "yy", "a", "Y"), ("en", "yy", "b", "YB")],
                                "src_lang string, tgt_lang string, word string, translation string")
    df = spark.createDataFrame([(i, "en" if i % 5 else "fi", ["a", "b", "c", "a"]) for i in range(60)],
                               "sent_id bigint, lang string, words array<string>")
    run = lambda limit: sorted(map(str, lexsub.lex_substitute(df, lex, lexsub.LexiconOptions(
        1.0, per="word", broadcast_limit=limit)).select("sent_id", "switched", "n").collect()))
    assert run(1 << 20) == run(0)
    out = lexsub.lex_substitute(df, lex, lexsub.LexiconOptions(1.0)).collect()
    assert all(r["switched"] == r["text"] for r in out if r["lang"] == "fi")
    assert {w for r in out for w in r["switched"].split()} == {"A1", "A2", "Y", "YB", "b", "c", "a"}
    none = lexsub.lex_substitute(df, lex, lexsub.LexiconOptions(-1.0)).filter("switched <> text").count()
    assert none == 0


def test_read_lexicon_fields(spark, tmp_path):
    (tmp_path / "en-xx.txt").write_text("a b\nc\td e\n\n  \nlonely\nq r s\n")
    got = sorted(map(tuple, lexicon.read_lexicon(spark, str(tmp_path), ["en"], ["xx", "zz"]).collect()))
    assert got == [("en", "xx", "a", "b"), ("en", "xx", "c", "d e"), ("en", "xx", "q", "r")]


def test_line_numbers_over_splits(spark, tmp_path):
    content = [f"line {i} " + "x" * (i % 37) for i in range(20000)]
    (tmp_path / "train.en").write_text("\n".join(content) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = lines.read_lines(spark, str(tmp_path / "train.en"))
        assert got.rdd.getNumPartitions() > 1
        assert [r["text"] for r in got.orderBy("line_no").collect()] == content
        assert got.select("corpus", "lang").distinct().collect() == [("train", "en")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_generation_log(spark):
    df = spark.createDataFrame([("H-12\t-0.25\ta b",), ("P-12\t-1",), ("noise",), ("S-3\ttext",)], "value string")
    got = sorted(map(tuple, logs.parse_log(df).collect()))
    assert got == [("H", 12, -0.25, "a b"), ("P", 12, None, "-1"), ("S", 3, None, "text")]
    real = ["-0.8888964653015137", "-1.2e-05", "-inf", "odd", ""]
    rows = spark.createDataFrame([(f"H-{i}\t{x}\tt",) for i, x in enumerate(real)], "value string")
    assert [r["score"] for r in logs.parse_log(rows).orderBy("id").collect()] == [
        -0.8888964653015137, -1.2e-05, float("-inf"), None, None]


def test_zip_keeps_the_longest(spark):
    side = lambda n, name: spark.createDataFrame([(i, f"{name}{i}" if i != 1 else None) for i in range(n)], "line_no bigint, text string")
    got = lines.zip_lines(side(1, "a"), side(3, "b"), side(2, "c")).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(0, "a0", "b0", "c0", 0), (1, None, None, None, 1), (2, None, "b2", None, 2)]


def test_ratio_of_zero_leaves_a_corpus_out(spark):
    a, b = spark.range(2), spark.range(3)
    got = corpus.upsample_concat([a, b], [2, 0])
    assert Counter((r["part"], r["rep"]) for r in got.collect()) == {(0, 1): 2, (0, 2): 2}
    with pytest.raises(ValueError):
        corpus.upsample_concat([a, b], [-1, 1])


def test_load_split(spark, tmp_path):
    rows = [(1, "train", "a-b", 0), (2, "train", "b-a", 1), (3, "train", "a-b", 3), (4, "valid", "a-b", 1)]
    df = spark.createDataFrame(rows, "ex_id bigint, split string, direction string, part int").select(
        "*", F.array(F.lit(7)).alias("src"), F.array(F.lit(8), F.lit(9)).alias("tgt"), F.lit(1).alias("src_len"), F.lit(2).alias("tgt_len"))
    path = str(tmp_path / "store")
    store.write_encoded(df, path)
    got = {r["ex_id"]: (list(r["src"]), r["tgt_len"]) for r in store.load_split(spark, path, "train", "a", "b").collect()}
    assert got == {1: ([7], 2), 2: ([8, 9], 1)}   # part 3 lies behind a gap
    assert store.load_split(spark, path, "train", "a", "b", combine=False).count() == 1
    with pytest.raises(FileNotFoundError):
        store.load_split(spark, path, "valid", "a", "b")


def test_vocabulary_order_and_codes(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "z"]), (2, ["a", "q"])], "ex_id bigint, words array<string>")
    voc = vocab.build_vocab(df, ["en"], threshold=0)
    assert [tuple(r) for r in voc.orderBy("id").collect()] == [
        (4, "a", 2), (5, "b", 2), (6, "q", 1), (7, "z", 1), (8, "LANG_TOK_EN", 1)]
    small = vocab.build_vocab(df, ["en"], threshold=2)
    enc = vocab.encode_ids(df, small)
    assert {r["ex_id"]: list(r["ids"]) for r in enc.collect()} == {1: [5, 4, 5, 3, 2], 2: [4, 3, 2]}
    ref = {r["ex_id"]: r["text"] for r in vocab.decode_ids(enc, small, "ref").collect()}
    assert ref == {1: "b a b UNKNOWNTOKENINREF", 2: "a UNKNOWNTOKENINREF"}
    assert vocab.assert_known_tag(small, "LANG_TOK_EN") == 6
    with pytest.raises(ValueError):
        vocab.assert_known_tag(small, "LANG_TOK_QQ")


def test_length_filter_strict(spark):
    df = spark.createDataFrame([(1, 5, 5), (2, 9, 1)], "ex_id bigint, src_len int, tgt_len int")
    assert clean.filter_by_length(df, 8, 8).count() == 1
    with pytest.raises(Exception, match="pair longer than"):
        clean.filter_by_length(df, 8, 8, strict=True).collect()


def test_mix_modes(spark):
    ex = spark.range(300).select(F.col("id").alias("ex_id"), F.when(F.col("id") % 10 == 0, "valid").otherwise("train").alias("split"),
                                 (F.col("id") % 3).cast("int").alias("part"))
    par, mono = ex, ex.withColumn("ex_id", F.col("ex_id") + 1000)
    count = lambda df: {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()}
    assert count(corpus.mix_training(par, mono, "train", 1, 3)) == {"parallel": 270, "mono": 270}
    assert count(corpus.mix_training(par, mono, "train", 2, 3, one_mono_part=True)) == {"parallel": 270, "mono": 90}
    assert count(corpus.mix_training(par, None, "train", 1)) == {"parallel": 270}
    assert count(corpus.mix_training(par, mono, "train", 1)) == {"parallel": 270, "mono": 270}
    assert {r["part"] for r in corpus.mix_training(None, mono, "train", 2, one_mono_part=True).collect()} == {1}
    assert count(corpus.mix_training(None, mono, "train", 1, 3, mono_ratio=0.5)) == {"mono": 135}
    assert count(corpus.mix_training(par, mono, "valid", 1, 3)) == {"parallel": 30}
    assert count(corpus.mix_training(par, mono, "train", 1, 2, parallel_ratio=0.5)) == {"parallel": 135, "mono": 180}
    each = {r["part"]: r["count"] for r in corpus.mix_training(None, mono, "train", 1, mono_ratio=0.25).groupBy("part").count().collect()}
    assert each == {0: 23, 1: 23, 2: 23}  # 90 rows a part, rounded up in each
    assert count(corpus.mix_training(par, mono.limit(0), "train", 1, one_mono_part=True)) == {"parallel": 270}
    with pytest.raises(ValueError):
        corpus.mix_training(par, mono, "train", 0, 3)
    with pytest.raises(ValueError):
        corpus.assert_compatible({"vocab": "a", "pad_left": True}, {"vocab": "b", "pad_left": True})


def test_dev_split_overlap(spark):
    df = spark.range(10).withColumnRenamed("id", "slice_line")
    assert corpus.dev_split(df, 4).count() == 10
    both = corpus.dev_split(df, 4, overlap=1).filter("slice_line = 3")
    assert {r["split"] for r in both.collect()} == {"dev", "train"}


def test_bleu_and_chrf(spark):
    rows = [("same", "the cat sat on the mat .", "the cat sat on the mat ."), ("none", "a b c d e", "v w x y z"),
            ("short", "a b", "a b")]
    df = spark.createDataFrame(rows, "k string, ref string, hyp string")
    got = {r["k"]: r["bleu"] for r in score.corpus_bleu(df, ["k"]).collect()}
    smoothed = 100 * math.exp(sum(math.log(1 / (2 ** (j + 1) * (5 - j))) for j in range(4)) / 4)
    assert got == {"same": 100.0, "none": round(smoothed, 2), "short": 0.0}
    with pytest.raises(ValueError, match="unknown tokenizer"):
        score.corpus_bleu(df, ["k"], tokenizer="spm")
    pieces = df.select("k", F.split("ref", "").alias("ref"), F.split("hyp", "").alias("hyp"))
    assert {r["k"]: r["bleu"] for r in score.corpus_bleu(pieces, ["k"], tokenizer="pieces").collect()}["same"] == 100.0
    chrf = {r["k"]: r["chrf"] for r in score.corpus_chrf(df, ["k"]).collect()}
    assert chrf["same"] == 100.0 and chrf["none"] == 0.0
    tok = spark.createDataFrame([("Hi, it's 3.5-4 &quot;x&quot;!",)], "t string")
    assert tok.select(T.words(score.mteval_tokenize(F.col("t")))).first()[0] == \
        ["Hi", ",", "it's", "3.5", "-", "4", '"', "x", '"', "!"]


@pytest.mark.parametrize("step", [1 << 20, 50])
def test_ngram_matches_are_brute_force(monkeypatch, step):
    import pyarrow as pa

    from codemix.operators import ngrams

    def plain(h, r, order):
        row = []
        for n in range(1, order + 1):
            a, b = ([tuple(x[i:i + n]) for i in range(len(x) - n + 1)] for x in (h, r))
            row += [sum((Counter(a) & Counter(b)).values()), len(a), len(b)]
        return row

    monkeypatch.setattr(ngrams, "STEP", step)
    rng = random.Random(1)
    hyp = ["".join(rng.choices("abcé \U0001f600", k=rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    ref = ["".join(rng.choices("abcé ", k=rng.randint(0, 30))) for _ in range(200)] + ["x", None]
    assert ngrams.matches(pa.array(hyp), pa.array(ref), 6).to_pylist() == [
        plain(h or "", r or "", 6) for h, r in zip(hyp, ref, strict=True)]
    words_of = lambda rows: [None if t is None else t.split() for t in rows]
    kind = pa.list_(pa.string())
    got = ngrams.matches(pa.array(words_of(hyp), kind), pa.array(words_of(ref), kind), 4).to_pylist()
    assert got == [plain(h or [], r or [], 4) for h, r in zip(words_of(hyp), words_of(ref), strict=True)]
    assert ngrams.matches(pa.array([], pa.string()), pa.array([], pa.string()), 2).to_pylist() == []


def test_extreme_similarities_stay_finite(spark):
    big = spark.createDataFrame([([[30.0, 0.0], [0.0, 900.0]], [[30.0, 0.0], [0.0, 900.0]])],
                                "src_vecs array<array<double>>, tgt_vecs array<array<double>>")
    assert [(e.s, e.t) for e in align.align_embeddings(big).first().edges] == [(0, 0), (1, 1)]
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], [0.0, 1.0]), (1, 1, [0.0, 1.0], [0.0, 1.0])],
                               "batch_id bigint, pos bigint, a array<double>, c array<double>")
    assert embed.contrastive_loss(df, tau=0.0001).first()["loss"] == pytest.approx(2 * math.log(2))
    with pytest.raises(Exception, match="more than 1 rows"):
        embed.contrastive_loss(df, max_batch=1).collect()
    side = df.select("batch_id", "pos", F.col("a").alias("vec"))
    with pytest.raises(Exception, match="more than 1 rows"):
        embed.batch_pairs(side.filter("pos = 0"), side, max_batch=1).collect()


def test_contrastive_batch_limit(spark):
    df = spark.range(10).select(F.lit(1).alias("batch_id"), F.col("id").alias("pos"), F.array(F.lit(1.0)).alias("a"),
                                F.array(F.lit(1.0)).alias("c"))
    per = embed.contrastive_loss(df)
    assert per.first()["loss"] == pytest.approx(10 * math.log(10))
    with pytest.raises(Exception, match="a batch holds more"):
        embed.collect_batches(df, max_batch=5).collect()


def _loss(rows, tau):
    a, c = (np.array([r[k] for r in rows]) for k in (2, 3))
    a, c = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8) for v in (a, c))
    s = a @ c.T / tau
    top = s.max(axis=1)
    return float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - np.diag(s)).sum())


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contrastive_loss_of_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(embed, "TILE", 7)
    rng = np.random.default_rng(5)
    rows = [(b, int(p) * step, rng.normal(size=6).tolist(), rng.normal(size=6).tolist())
            for b, n, step in ((0, 1, 1), (1, 37, 1), (2, 400, 1), (3, 60, 9)) for p in range(n)]
    rows[5] = rows[5][:2] + ([0.0] * 6, rows[5][3])  # a zero vector
    rows += [(None, p, [1.0, 0.0], [1.0, 0.0]) for p in range(50)]  # a null batch of repeated rows, another length
    lost = [(1, 99, None, rows[0][3]), (4, 0, rows[0][2], None)]
    df = spark.createDataFrame(rows + lost, "batch_id bigint, pos bigint, a array<double>, c array<double>").withColumn("top", F.lit(1))
    for tau in (0.1, 0.0005):
        got = {r["batch_id"]: r for r in embed.contrastive_loss(df, tau, block=32, limit=limit).collect()}
        assert set(got) == {None, 0, 1, 2, 3}
        for b, r in got.items():
            mine = [x for x in rows if x[0] == b]
            assert r["nsentences"] == len(mine) and r["loss"] == pytest.approx(_loss(mine, tau), rel=1e-9, abs=1e-9)
    assert embed.contrastive_loss(df.limit(0)).count() == 0


def test_subwords(spark):
    text = ["low lower lowest", "new newer newest", "slow slower", "wide wider widest"] * 3
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(text)], "sent_id bigint, words array<string>")
    model = subword.learn_subwords(df, 30, seed_size=60)
    assert len(model) <= 30 and sum(map(math.exp, model.values())) == pytest.approx(1.0)
    assert all(c in model for c in "lowernstid" + subword.MARK)
    odd = spark.createDataFrame([(1, ["low", "Ωmega", "x"])], "sent_id bigint, words array<string>")
    enc = subword.encode_subwords(odd, model)
    assert enc.select(T.decode_pieces(F.col("pieces"))).first()[0] == "low Ωmega x"


def test_registered_subwords_have_the_operators_sizes(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["low"], "low")], "sent_id bigint, words array<string>, text string")
    sizes = []

    def learn(*args, **named):
        sizes.append((args[1:], named))
        rows = [(c, -1.0) for c in "low" + subword.MARK]
        return stored(spark.createDataFrame(rows, "piece string, logp double"), "model")

    monkeypatch.setattr(queries_vocab.C, "sentences", lambda *_: df)
    monkeypatch.setattr(subword, "learn_model", learn)
    assert queries_vocab.learn_subwords(spark, "").count() == 4
    assert [tuple(r) for r in queries_vocab.encode_subwords_round_trip(spark, "").collect()] == [(1, "low")]
    assert sizes == [((), {}), ((), {})]


def test_em_raises_the_likelihood():
    words = {"▁abab": 5, "▁abc": 3, "▁cab": 2}
    pieces = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    model = {p: -math.log(len(pieces)) for p in pieces}

    def likelihood(m):
        total = 0.0
        for w, c in words.items():
            a = [1.0] + [0.0] * len(w)
            for e in range(1, len(w) + 1):
                a[e] = sum(a[s] * math.exp(m[w[s:e]]) for s in range(e))
            total += c * math.log(a[-1])
        return total

    last = likelihood(model)
    for _ in range(4):
        expected = {}
        for w, c in words.items():
            for p, x in subword.expected_pieces(w, model).items():
                expected[p] = expected.get(p, 0.0) + c * x
        norm = sum(expected.values())
        model = {p: math.log(max(x / norm, 1e-300)) for p, x in expected.items()}
        now = likelihood({p: model.get(p, -700.0) for p in pieces})
        assert now >= last - 1e-9
        last = now


def test_long_words_do_not_underflow():
    model = {"a": -10.0, "aa": -12.0, "a" * 20: -15.0}
    got = subword.expected_pieces("a" * 300, model)
    assert sum(len(p) * c for p, c in got.items()) == pytest.approx(300)
    assert subword.viterbi("a" * 20, model)[0] == ["a" * 20]


def test_scorer_tokenizers_of_unspaced_scripts(spark):
    df = spark.createDataFrame([(" 我有3.5个 ok,好。𠀀 ", "これは x-5 カナ。")], "zh string, ja string")
    got = df.select(score.TOKENIZERS["zh"](F.col("zh")), score.TOKENIZERS["ja-mecab"](F.col("ja")),
                    score.TOKENIZERS["zh"](F.lit("costs 5.")), score.TOKENIZERS["zh"](F.lit("  "))).first()
    assert got[0] == ["我", "有", "3.5", "个", "ok", ",", "好", "。", "𠀀"]
    assert got[1] == ["こ", "れ", "は", "x-5", "カ", "ナ", "。"]
    assert got[2] == ["costs", "5."] and got[3] == []
    pairs = spark.createDataFrame([("ja", "これはいい本です", "これはいい本です"), ("zh", "我有一本书", "我有一本书")],
                                  "lang string, hyp string, ref string")
    names = pairs.select("lang", T.scorer_tokenizer(F.col("lang")).alias("t")).collect()
    for lang, name in names:
        assert score.corpus_bleu(pairs.filter(F.col("lang") == lang), ["lang"], tokenizer=name).first()["bleu"] == 100.0


def test_bpe_merges():
    ranks = {("l", "o"): 0, ("lo", "w</w>"): 1, ("e", "r</w>"): 2}
    assert subword.bpe_word("low", ranks) == ["low"]
    assert subword.bpe_word("lower", ranks) == ["lo@@", "w@@", "er"]


def test_text_columns(spark):
    df = spark.createDataFrame([("  a b\tc  ",), ("",), (" 　 ",)], "t string")
    assert [r[0] for r in df.select(T.words(F.col("t"))).collect()] == [["a", "b", "c"], [], []]
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(T.untag(F.lit("LANG_TOK_EN a b"))) == "a b" and val(T.untag(F.lit("alone"))) == "alone"
    assert val(T.postedit(F.lit('say "x y" now'), F.lit("fr"))) == "say « x y » now"
    assert val(T.remove_bpe(F.lit("lo@@ w er@@"))) == "low er"
    assert val(T.lang_tag(F.lit("fi_FI"))) == "LANG_TOK_FI"
    text = "Well-known (a) state, isn't it?"
    tok = val(T.tokenize(F.lit(text), F.lit("en")))
    assert tok == "Well @-@ known ( a ) state , isn 't it ?"
    assert val(T.detokenize(F.lit(tok), F.lit("en"))) == text
