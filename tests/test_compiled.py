"""Compiled dictionaries and measured sizes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codemix.operators import compiled, lexsub, vocab
from codemix.session import dense_order, fits_broadcast


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5000])
def test_key_table_equals_a_dict(n):
    rng = np.random.default_rng(n)
    hashes = np.unique(rng.integers(-50, 50, n) if n == 17 else rng.integers(-2 ** 63, 2 ** 63 - 1, n))
    hashes = np.concatenate([hashes, (hashes[:1] + 64) if n == 2 else hashes[:0]])  # neighbours in one slot
    table, want = compiled.KeyTable(hashes), {int(h): k for k, h in enumerate(hashes)}
    asked = np.concatenate([hashes, rng.integers(-100, 100, 50), [0, -1]]).astype(np.int64)
    assert table.find(asked).tolist() == [want.get(int(h), -1) for h in asked]


def test_an_equal_hash_of_another_key_is_no_hit():
    known = compiled.Dictionary(compiled.KeyTable(np.array([5, 6])), pa.array(["a", "b"]), pa.array([1, 2]))
    keys = pa.array(["a", "x", None, "b"])
    assert known.entries(pa.array([5, 5, 5, 6]), keys.take).tolist() == [0, -1, -1, 1]


def test_tables_too_large_or_with_equal_hashes_are_not_compiled(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "hash bigint, key string, value int")
    assert compiled.compile_table(rows).values.to_pylist() in ([1, 2], [2, 1])
    assert compiled.compile_table(rows, limit=10) is None
    assert compiled.compile_table(rows.withColumn("hash", F.lit(1).cast("bigint"))) is None


def test_size_counts_content_and_nested_values(spark):
    rows = spark.createDataFrame([("abc", [("x" * 100, 1)] * 3), (None, None)], "t string, l array<struct<s:string,n:bigint>>")
    exact = (4 + 3) + (4 + 3 * (4 + 100 + 8)) + 4 + 4
    assert fits_broadcast(rows, exact, 0) and not fits_broadcast(rows, exact - 1, 0)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lookups_inside_rows_equal_the_join(spark, limit):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(50)] + ["é", "", "a b"]
    rows = [(i, [rng.choice([*words, "other"]) for _ in range(rng.randint(0, 9))]) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "ex_id bigint, words array<string>")
    voc = spark.createDataFrame([(k + 4, w, 1) for k, w in enumerate(words)], "id bigint, token string, cnt bigint")
    ids = {w: k + 4 for k, w in enumerate(words)}
    got = {r.ex_id: r.ids for r in vocab.encode_ids(df, voc, limit=limit).collect()}
    assert got == {i: [ids.get(w, 3) for w in ws or []] + [2] for i, ws in rows}
    back = {r.ex_id: r.text for r in vocab.decode_ids(vocab.encode_ids(df, voc), voc, "hyp", limit=limit).collect()}
    assert back == {i: " ".join(w if w in ids else "UNKNOWNTOKENINHYP" for w in ws or []) for i, ws in rows}


def test_substitution_is_the_same_compiled_joined_and_with_stored_entries(spark):
    rng = random.Random(2)
    lexicon = spark.createDataFrame([("en", t, f"w{k}", f"w{k}{t}{n}") for t in "xy" for k in range(20) for n in range(1 + k % 3)],
                                    "src_lang string, tgt_lang string, word string, translation string")
    df = spark.createDataFrame([(i, rng.choice(["en", "fr", None]), [f"w{rng.randint(0, 25)}" for _ in range(i % 7)])
                                for i in range(120)], "sent_id bigint, lang string, words array<string>")
    run = lambda limit, **more: sorted(map(str, lexsub.lex_substitute(
        df, lexicon, lexsub.LexiconOptions(ratio=0.8, per="word", broadcast_limit=limit), **more).collect()))
    want = run(1 << 20)
    assert want == run(0) == run(1 << 20, entries=lexsub.dictionary_entries(lexicon))
    assert any("x" in r or "y" in r for r in want)


def test_dense_order_numbers_rows_and_keeps_columns(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit("t").alias("_at_text")).repartition(9)
    got = {r.id: r["rank"] for r in dense_order(rows, F.desc("k"), F.asc("id")).collect()}
    want = {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)))}
    assert got == want and dense_order(rows.limit(0), F.asc("id")).collect() == []
