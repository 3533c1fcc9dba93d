"""Replacement, substitution and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def switch_stats(picks: DataFrame, langs: DataFrame) -> DataFrame:
    """Per language: replacements, mean source span (gaps included), mean target words.

    ``langs(lang)`` lists every translation language so that zero rows stay.
    """
    span = F.element_at("p.s", -1) + 1 - F.get("p.s", F.lit(0))
    one = picks.select(F.explode("picks").alias("p")).select(
        F.col("p.lang").alias("lang"), span.alias("span"), F.size("p.tw").alias("tw"))
    agg = one.groupBy("lang").agg(
        F.count(F.lit(1)).alias("replacements"), F.sum("span").alias("src_words"), F.sum("tw").alias("tgt_words"))
    out = langs.join(agg, "lang", "left").select(
        "lang", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("replacements", "src_words", "tgt_words")])
    mean = lambda c: F.when(F.col("replacements") > 0, F.round(F.col(c) / F.col("replacements"), 6))
    return out.select("lang", "replacements", mean("src_words").alias("mean_src_span"),
                      mean("tgt_words").alias("mean_tgt_words"))


def switch_totals(assembled: DataFrame, done: DataFrame) -> DataFrame:
    """One row for a run: lines in, without a valid candidate and out, replacements, overall means.

    ``assembled`` has a row per source line with candidates, ``done`` one per line that kept
    a valid one, with its ``picks``.
    """
    span = F.aggregate("picks", F.lit(0), lambda a, p: a + F.element_at(p["s"], -1) + 1 - F.get(p["s"], F.lit(0)))
    words = F.aggregate("picks", F.lit(0), lambda a, p: a + F.size(p["tw"]))
    ins = assembled.agg(F.count(F.lit(1)).alias("lines_in"))
    outs = done.select(F.size("picks").alias("k"), span.alias("span"), words.alias("words")).agg(
        F.count(F.lit(1)).alias("lines_out"), F.coalesce(F.sum("k"), F.lit(0)).alias("replacements"),
        F.sum("span").alias("span"), F.sum("words").alias("words"))
    mean = lambda c: F.when(F.col("replacements") > 0, F.round(F.col(c) / F.col("replacements"), 6))
    one = F.lit(1).alias("run")
    return (ins.select("*", one).join(outs.select("*", one), "run")
            .select("lines_in", (F.col("lines_in") - F.col("lines_out")).alias("lines_without"), "lines_out", "replacements",
                    mean("span").alias("mean_src_span"), mean("words").alias("mean_tgt_words")))


def lex_stats(substituted: DataFrame) -> DataFrame:
    """Total words (with no language) and replacements per language."""
    total = substituted.agg(F.lit("*").alias("lang"), F.sum("n").cast("bigint").alias("words"))
    hits = (substituted.select(F.explode("hits").alias("lang"))
            .groupBy("lang").agg(F.count(F.lit(1)).alias("words")))
    return total.unionByName(hits)


def corpus_counts(df: DataFrame, *keys: str, tokens: Column | None = None) -> DataFrame:
    """Lines (and tokens) per corpus."""
    aggs = [F.count(F.lit(1)).alias("n_lines")]
    if tokens is not None:
        aggs.append(F.sum(tokens).cast("bigint").alias("n_tokens"))
    return df.groupBy(*keys).agg(*aggs)


def sample_report(indexed: DataFrame, every: int, index: str = "rank") -> DataFrame:
    """Every N-th row of a corpus with dense 0-based row numbers."""
    return indexed.filter(F.col(index) % every == 0)
