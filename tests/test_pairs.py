"""Word counts of pairs and what their joins carry."""

from pyspark.sql import functions as F

from codemix.functions import text as T
from codemix.operators import align, clean
from codemix.plans import corpora, queries_switch

def test_pairs_are_cleaned_by_counts_made_once(spark):
    pairs = spark.createDataFrame([("a b", "c d"), ("a b c d", "e"), ("a", ""), ("a", None), ("a", " a")], "src string, tgt string")
    kept = clean.clean_pairs(pairs)
    assert [tuple(r) for r in kept.collect()] == [("a b", "c d")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # one a side; every mention of a count made the words again before


def test_flags_stand_for_the_words_of_a_phrase(spark):
    df = spark.createDataFrame([(["a", "1", "b"], "0-0 1-1 2-1 9-9 x", 2)], "words array<string>, alignment string, n_tgt int")
    by_words = align.phrases(df).first()["phrases"]
    flags = df.select(F.transform("words", T.is_alpha).alias("alpha"), "alignment", "n_tgt")
    assert align.phrases(flags).first()["phrases"] == by_words and len(by_words) == 2


def test_pairs_travel_without_their_words(spark, tmp_path):
    docs = [(k, "Ab cd 12 ef.\nGh ij", "en") for k in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries_switch.candidate_pairs(spark, str(tmp_path))
    assert not {"words", "tw", "src", "text"} & set(df.columns)
    assert df.count() == 40 * len(corpora.TARGETS)
