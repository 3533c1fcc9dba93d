"""Bilingual dictionaries: files ``{src}-{tgt}.txt`` of ``word translation`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codemix.functions.text import strip

FILE = r"([A-Za-z]+)-([A-Za-z]+)\.txt(?:/part-[^/]*)?$"


def parse_entry(line: Column) -> Column:
    """Split at tabs when there is one, else at blanks; the first two fields count."""
    body = strip(line)
    fields = F.when(F.contains(body, F.lit("\t")), F.split(body, "\t")).otherwise(F.split(body, " "))
    return F.struct(F.get(fields, F.lit(0)).alias("word"), F.get(fields, F.lit(1)).alias("translation"))


def missing_dictionaries(lexicon: DataFrame, src_langs: list[str], tgt_langs: list[str]) -> DataFrame:
    """Wanted pairs (src_lang, tgt_lang) that have no entry; their target language is never drawn."""
    wanted = [(s, t) for s in src_langs for t in tgt_langs]
    pairs = lexicon.sparkSession.createDataFrame(wanted, "src_lang string, tgt_lang string")
    return pairs.join(lexicon.select("src_lang", "tgt_lang").distinct(), ["src_lang", "tgt_lang"], "left_anti")


def read_lexicon(spark: SparkSession, folder: str, src_langs: list[str], tgt_langs: list[str]) -> DataFrame:
    """``src_lang, tgt_lang, word, translation`` of the pairs that have a file.

    A pair without a file gives no rows, so its language is never drawn.
    Duplicates stay: they weigh the draw.  Blank lines and lines with one
    field are skipped.
    """
    raw = spark.read.text(folder, recursiveFileLookup=True)
    entry = parse_entry(F.col("value"))
    return (
        raw.select(F.col("_metadata.file_path").alias("file"), F.col("value"))
        .filter(strip(F.col("value")) != "")
        .select(F.regexp_extract("file", FILE, 1).alias("src_lang"),
                F.regexp_extract("file", FILE, 2).alias("tgt_lang"), entry.alias("e"))
        .filter(F.col("src_lang").isin(src_langs) & F.col("tgt_lang").isin(tgt_langs))
        .select("src_lang", "tgt_lang", "e.word", "e.translation")
        .filter(F.col("translation").isNotNull() & (F.col("translation") != ""))
    )
