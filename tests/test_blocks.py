"""Rows that travel in blocks: joins, assembled candidates, dictionaries by chunks; sentences and their words."""

import random

import pytest
from pyspark.sql import functions as F

from codemix.functions.draw import draw
from codemix.functions.text import BLANK_CHARS, LINE_END, strip, words
from codemix.operators import blocks, lexsub, switch
from codemix.plans import corpora, queries_text, queries_vocab

LEX = "src_lang string, tgt_lang string, word string, translation string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(df) -> list[str]:
    return sorted(map(str, df.collect()))


def test_joins_in_blocks_equal_joins(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BATCH", 400)
    monkeypatch.setattr(blocks, "GATHERED", 300)
    rng = random.Random(1)
    key = lambda: rng.choice([None, *range(12)])
    left = spark.createDataFrame([(key(), "é" * k, [k % 2 == 0, None]) for k in range(60)], "id bigint, a string, f array<boolean>")
    right = spark.createDataFrame([(f"b{k}" if k % 5 else None, key()) for k in range(50)], "b string, id bigint")
    got = blocks.joined(left, right, "id")
    assert got.columns == ["id", "a", "f", "b"] and "Join" not in plan(got)
    assert texts(got) == texts(left.join(right, "id")) and got.count() > 100
    assert blocks.joined(left, right.filter("false"), "id").count() == 0
    other = right.withColumn("id", F.col("id").cast("int"))
    assert texts(blocks.joined(left, other, "id")) == texts(left.join(other, "id"))


@pytest.mark.parametrize("with_ref", [False, True])
def test_candidates_are_assembled_in_blocks_as_by_rows(spark, monkeypatch, with_ref):
    monkeypatch.setattr(blocks, "GATHERED", 300)
    rng = random.Random(2)
    key = lambda: rng.choice([None, *range(9)])
    src = spark.createDataFrame([(key(), f"t {k}") for k in range(12)], "sent_id bigint, text string")
    ref = spark.createDataFrame([(key(), f"r {k}") for k in range(12)], "sent_id bigint, ref string") if with_ref else None
    some = lambda *of: rng.choice([None, *of])
    cands = spark.createDataFrame([(key(), some(0, 1), some("xx", "yy"), some("b", "é", "a"), some("", "0-0")) for _ in range(80)],
                                  "sent_id bigint, lang_idx int, lang string, text string, alignment string")
    done = switch.assemble_candidates(src, cands, ref)
    assert "Join" not in plan(done) and done.schema["cands"].dataType.simpleString() == switch.CANDIDATE
    monkeypatch.setattr(blocks, "fits", lambda *_: False)
    by_rows = switch.assemble_candidates(src, cands, ref)
    assert "Join" in plan(by_rows) and done.columns == by_rows.columns and texts(done) == texts(by_rows) != []


def test_sentences_keep_their_words(spark, tmp_path):
    rng = random.Random(4)
    marks = BLANK_CHARS + "ab é«’​中\r\n"
    docs = [(k, rng.choice(["en", None]), None if k == 5 else "".join(rng.choice(marks if k % 2 else "ab \n") for _ in range(k % 60)))
            for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    lines = df.select("doc_id", "lang", F.posexplode(F.split("text", LINE_END)).alias("pos", "line")).filter(strip(F.col("line")) != "")
    want = lines.select((F.col("doc_id") * 10_000_000 + F.col("pos") + 1).alias("sent_id"), "lang", words(F.col("line")).alias("words"))
    want = want.select("sent_id", "lang", "words", F.size("words").alias("n"), F.array_join("words", " ").alias("text"))
    got = corpora.sentences(spark, str(tmp_path))
    assert got.dtypes == want.dtypes and texts(got) == texts(want)
    assert "words" not in spark.read.parquet(corpora._STORED[(spark.sparkContext.applicationId, str(tmp_path), "sentences")]).columns


@pytest.mark.parametrize("per", ["sentence", "word"])
def test_a_large_dictionary_is_looked_up_by_chunks(spark, monkeypatch, per):
    rng = random.Random(3)
    lexicon = spark.createDataFrame([("en", t, f"w{k}", f"w{k}{t}{n % 3}") for t in "xy" for k in range(30) for n in range(1 + k % 5)], LEX)
    df = spark.createDataFrame([(i % 100, rng.choice(["en", "fr", None]), None if i == 7 else [
        rng.choice([None, *(f"w{j}" for j in range(35))]) for _ in range(i % 9)]) for i in range(150)],
                               "sent_id bigint, lang string, words array<string>")
    opts = lambda limit: lexsub.LexiconOptions(0.7, 3, per, limit)
    want = texts(lexsub.lex_substitute(df, lexicon, opts(1 << 24)))
    monkeypatch.setattr(lexsub, "LEAST", 0)
    monkeypatch.setattr(lexsub, "lookup", None)  # no word is joined by itself
    assert texts(lexsub.lex_substitute(df, lexicon, opts(0))) == want
    assert texts(lexsub.lex_substitute(df, lexicon.filter("false"), opts(0))) == texts(
        lexsub.lex_substitute(df, lexicon.filter("false"), opts(1 << 24)))


def test_entries_are_counted_in_blocks_as_by_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [tuple(rng.choice([None, *of]) for of in (["en"], "xy", "abc", ["é", "z", "A", ""])) for _ in range(300)]
    lexicon = spark.createDataFrame(rows, LEX)
    done = lexsub.dictionary_entries(lexicon)
    by_rows = lexsub.dictionary_entries(lexicon.withColumn("word", F.col("word").cast("varchar(9)")).withColumn(
        "tgt_lang", F.ascii("tgt_lang")).withColumn("tgt_lang", F.col("tgt_lang").cast("int")))
    assert "collect_list" not in plan(done) and "collect_list" in plan(by_rows)
    as_code = done.withColumn("tgt_lang", F.ascii("tgt_lang"))
    assert texts(as_code.select(by_rows.columns)) == texts(by_rows)
    assert done.schema["choices"].dataType.simpleString() == "array<struct<upto:bigint,translation:string>>"


def test_words_are_looked_up_once_per_chunk(spark, tmp_path, monkeypatch):
    docs = [(k, "a b a z\nc" if k % 2 else "b  b", "en" if k % 3 else None) for k in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    lexicon = spark.createDataFrame([("en", "xx", "a", "A"), ("en", "xx", "a", "A"), ("en", "zz", "b", "B")], LEX)
    monkeypatch.setattr(corpora, "lexicon", lambda *_: lexicon)
    df = queries_text.lexicon_lookup(spark, str(tmp_path))
    assert "posexplode" not in plan(df) and "Join" not in plan(df)
    got = {tuple(r) for r in df.collect()}
    counts = {None: {}, "en": {"xx": {"a": 2}, "zz": {"b": 1}}}
    want = set()
    for k, text, lang in docs:
        for pos, line in enumerate(text.split("\n"), 1):
            for tgt in corpora.TARGETS:
                n = [counts[lang].get(tgt, {}).get(w) for w in line.split()]
                hit = [v for v in n if v]
                want.add((k * 10_000_000 + pos, lang, tgt, len(n), len(hit), sum(hit)))
    assert got == want


def test_hypotheses_follow_their_draws(spark, monkeypatch):
    rows = [(None if k == 7 else k * 10_000_001 - 50, "en", " ".join(f"é{j}" for j in range(1 + k % 40))) for k in range(200)]
    monkeypatch.setattr(corpora, "sentences", lambda *_: spark.createDataFrame(rows, "sent_id bigint, lang string, text string"))
    monkeypatch.setattr(corpora, "SLICE_BYTES", 100)
    got = corpora.ref_hyp(spark, "")
    kept = F.filter(F.split("text", " "), lambda w, i: draw(0, F.col("sent_id"), i, "H") % 8 != 0)
    want = corpora.sentences().select("sent_id", F.col("lang").alias("grp"), F.col("text").alias("ref"), F.array_join(kept, " ").alias("hyp"))
    assert "md5(" not in plan(got) and got.dtypes == want.dtypes and texts(got) == texts(want)


def test_both_sides_of_decoded_ids_travel_in_blocks(spark, tmp_path):
    docs = [(k, "a b a z\nc" if k % 2 else f"b  b w{k}", "en") for k in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries_vocab.decode_ids(spark, str(tmp_path))
    assert "Join" not in plan(df)
    got = {r.ex_id: (r.ref, r.hyp) for r in df.collect()}
    assert len(got) == 60 and got[10_000_001] == ("a b a z",) * 2 and got[20_000_001] == tuple(
        f"b b UNKNOWNTOKENIN{s}" for s in ("REF", "HYP"))
