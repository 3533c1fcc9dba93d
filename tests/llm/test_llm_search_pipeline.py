"""The vector searches, the pipeline and the registered queries."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codemix.llm import ann, near_dedup, packing, registered, topk
from codemix.llm.registered import BPE as BPE_NAME, tokenizer_file

BPE = tokenizer_file(BPE_NAME)

SHAPE = "vec_id bigint, embedding array<float>, label int"
BAD = [None, [], [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("inf")] + [0.0] * 5, [1.0, 2.0]]


def vectors(seed, n, size=6, copies=200):
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(8, size)) * 3
    rows = (spots[rng.integers(0, 8, n)] + rng.normal(size=(n, size))).astype(np.float32)
    rows[:copies] = rows[0]
    return rows


def table(spark, rows, extra=()):
    data = [(i, v.tolist(), 0) for i, v in enumerate(rows)] + [(10_000 + i, v, None) for i, v in enumerate(extra)]
    return spark.createDataFrame(data, SHAPE).repartition(5)


def test_found_neighbours_are_exact_and_most_are_found(spark):
    rows = vectors(1, 1500)
    df = table(spark, rows, [*BAD, [0.0] * 6]).withColumn("score", F.lit("clash"))
    df = df.unionByName(df.filter("vec_id = 100"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert sorted(got) == list(range(0, 1500, 100))
    hits, real = 0, rows.astype(np.float64)
    for q, found in got.items():
        far = np.sqrt(((real - real[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(far)), far)) if i != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(far[v] - s) < 1e-12 for _, s, v in found)
        assert [(s, v) for _, s, v in found] == sorted((s, v) for _, s, v in found)
        hits += len(set(order) & {v for _, _, v in found})
    assert hits >= 0.95 * 10 * len(got)
    assert [v for _, _, v in got[100]] == list(range(10))


def test_split_cells_find_the_same(spark, monkeypatch):
    rows = vectors(2, 600, copies=5)
    df = table(spark, rows)
    once = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 50 == 0, k=3).collect()))
    monkeypatch.setattr(ann, "SPLIT_ROWS", 100)
    assert sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 50 == 0, k=3).collect())) == once


def test_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 2)
    df = spark.createDataFrame([(0, [0.0, 1.0], 0), (100, [500.0, 1.0], 0), (200, [0.0, -900.0], 0), (7, [3e5, 1.0], 0)], SHAPE)
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 100, 200)} == {
        0: [100, 200, 7], 100: [0, 200, 7], 200: [0, 100, 7]}
    for part in (df.limit(0), df.filter("vec_id = 0")):
        assert ann.nearest(part, F.col("vec_id") % 100 == 0).collect() == []
        assert topk.top_products(part, F.col("vec_id") % 50 == 0).collect() == []


def test_probes_come_in_order_of_cost():
    hashing = ann.Hashing(6, 2.0)
    rows = vectors(3, 50)
    home, probes = hashing.filed(rows.astype(float), 0), hashing.probes(rows.astype(float), 0)
    assert (probes[:, 0] == home).all() and all(len(set(p)) == ann.PROBES for p in probes.tolist())


@pytest.mark.parametrize("seed,sizes", [(4, {}), (5, {"BLOCK_ROWS": 64, "PIVOTS": 7, "SAMPLE": 40, "LEAF": 4, "QUERY_ROWS": 9})])
def test_top_products_are_exact(spark, monkeypatch, seed, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    rows = vectors(seed, 1200)
    extra = [*BAD, [0.0] * 6]
    df = table(spark, rows, extra).withColumn("rank", F.lit("clash"))
    got = sorted(map(tuple, topk.top_products(df, F.col("vec_id") % 50 == 0, k=5).collect()))
    whole = np.floor(rows.astype(np.float64) * 256).astype(np.int64)
    ids = np.concatenate([np.arange(len(rows)), [10_000 + len(BAD)]])
    whole = np.concatenate([whole, np.zeros((1, 6), np.int64)])
    expect = []
    for at in np.flatnonzero(ids % 50 == 0):
        score = whole @ whole[at]
        order = [i for i in np.lexsort((ids, -score)) if i != at][:5]
        expect += [(int(ids[at]), k + 1, int(ids[i]), int(score[i])) for k, i in enumerate(order)]
    assert got == sorted(expect)


def test_cover_tree_covers():
    points = vectors(6, 700).astype(np.float64)

    def check(node):
        below = node.rows
        assert np.sqrt(((points[below] - node.center) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(below.tolist())
        return max([1 + check(c) for c in node.children], default=0)

    assert check(topk.cover_tree(points, np.arange(700))) >= 1


# --- pipeline ---

def test_pipeline_composes_its_stages(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": ["the", "shore", "thing", "with", "wave"], "de": ["der", "schuh", "ung", "keit", "zug"]}

    def prose(lang, n):
        return " ".join(rng.choice(words[lang]) + str(rng.choice(["", "s", "er", "en"])) for _ in range(n))

    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        rows.append([i, prose(lang, 60) + "\nshared footer line\n" + prose(lang, 20), lang, f"s{i % 3}", 0])
    rows[50][1] = rows[10][1]
    rows[51][1] = rows[11][1] + " tail"
    rows += [[200, "12 34 --", "en", "s0", 0], [201, None, None, None, None], [202, "", "de", "s1", 0]]
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(
        f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    left = stage["language_id"](spark, docs, str(tmp_path))
    assert left.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in left.collect()} == set(range(120))
    lines = stage["line_dedup"](spark, left, str(tmp_path))
    text = {r.doc_id: r for r in lines.collect()}
    assert all(text[i].text == rows[i][1].replace("\nshared footer line\n", "\n") and text[i].n_chars == len(text[i].text) for i in range(120))
    near = stage["near_dedup"](spark, lines, str(tmp_path))
    kept = {r.doc_id for r in near.collect()}
    component = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(lines, 5).collect()}
    assert kept == set(component.values()) and component[50] == 10 and component[51] == 11
    mixed = stage["mixing"](spark, near, str(tmp_path))
    assert mixed.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in mixed.collect()} <= kept
    packed = stage["packing"](spark, mixed, str(tmp_path))
    tokens = {r.doc_id: r.n for r in packing.pack(near, BPE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed.agg(F.sum("length")).first()[0] == sum(tokens[r.doc_id] for r in mixed.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == packed.columns and whole.agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()


def test_language_stage_writes_the_recognised_language(spark):
    words = {"en": ["the", "shore", "thing", "with", "wave"], "de": ["der", "schuh", "jung", "keit", "zug"]}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang if i < 60 else None, None, None)
            for i in range(80) for lang in [["en", "de"][i % 3 % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == {i: ["en", "de"][i % 3 % 2] for i in range(80)}


@pytest.mark.parametrize("label", [None, "en"])
def test_language_stage_keeps_texts_when_nothing_is_learned(spark, label):
    rows = [(1, "the shore", None, None, None), (2, "12 --", label, None, None), (3, "été", None, None, None),
            (4, None, None, None, None), (5, "", None, None, None), (6, "中文", None, None, None), (7, "١٢ ×", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((r.doc_id, r.lang) for r in corpus_pipeline.language_id(spark, docs, "").collect())
    assert got == [(1, None), (3, None), (6, None)]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_equals_sql(spark, name):
    from oracle_check import compare, duck

    assert compare(spark, duck(SF_DIR), registered.QUERIES[name], registered.ORACLES[name], SF_DIR).startswith("ok")


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 14))
