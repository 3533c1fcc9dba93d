"""Composition of corpora: directions, slices, unions, mixes, recipes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codemix.functions.text import lang_short, with_tag
from codemix.operators.sample import sample_size, subsample_groups
from codemix.operators.switch import SwitchOptions, switch_by_kind


def directions(spark: SparkSession, langs: list[str]) -> DataFrame:
    """All ordered language pairs except self (a handful of rows, built from the list)."""
    side = F.array(*[F.lit(x) for x in langs])
    return (spark.range(1).select(F.explode(side).alias("src_lang"))
            .select("src_lang", F.explode(side).alias("tgt_lang")).filter("src_lang <> tgt_lang"))


def route_direction(src: Column, tgt: Column) -> Column:
    """Model family per direction: out of English, into English, or between others."""
    return F.when(lang_short(src) == "en", "1n").when(lang_short(tgt) == "en", "n1").otherwise("nn")


def tag_pairs(df: DataFrame) -> DataFrame:
    """Prefix both sides with the tag of their language."""
    return df.withColumn("src", with_tag(F.col("src"), F.col("src_lang"))).withColumn(
        "tgt", with_tag(F.col("tgt"), F.col("tgt_lang")))


def swap_sides(df: DataFrame) -> DataFrame:
    swap = {"src": "tgt", "tgt": "src"}
    return df.select(*[
        F.col(swap[c[:3]] + c[3:] if c[:3] in swap and swap[c[:3]] + c[3:] in df.columns else c).alias(c)
        for c in df.columns])


def bidirect(df: DataFrame, both: Column | None = None) -> DataFrame:
    """Every pair in both directions; ``both`` limits the reverse (e.g. train only)."""
    back = swap_sides(df if both is None else df.filter(both))
    return df.unionByName(back)


def concat_corpora(*dfs: DataFrame) -> DataFrame:
    """Union in order; ``part`` is the position of the corpus."""
    return reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(k)) for k, d in enumerate(dfs)])


def upsample_concat(dfs: list[DataFrame], ratios: list[int] | int) -> DataFrame:
    """Repeat corpora by integer ratios (one number: only the first); ``rep`` numbers the copies."""
    if isinstance(ratios, int):
        ratios = [ratios] + [1] * (len(dfs) - 1)
    if len(ratios) != len(dfs):
        raise ValueError("one ratio per corpus")
    if any(r < 0 for r in ratios):
        raise ValueError("a ratio must not be negative")
    times = F.element_at(F.array(*[F.lit(r) for r in ratios]), F.col("part") + 1)
    copies = F.when(times > 0, F.sequence(F.lit(1), times))  # a ratio of 0 leaves the corpus out
    return concat_corpora(*dfs).withColumn("rep", F.explode(copies))


def assert_compatible(*metas: dict) -> None:
    """Sets may only be mixed when vocabulary, padding side and special ids agree."""
    keys = ("vocab", "pad_left", "bos", "pad", "eos", "unk")
    for m in metas[1:]:
        bad = [k for k in keys if m.get(k) != metas[0].get(k)]
        if bad:
            raise ValueError(f"data sets differ in {bad}")


def differing_settings(settings: DataFrame) -> DataFrame:
    """Of rows (data_set, name, value): the names whose values differ between data sets, with their number.

    A set without a value counts as one with the value null.
    """
    sets = settings.select("data_set").distinct().count()
    per = settings.groupBy("name").agg(F.countDistinct("value").alias("n_values"),
                                       F.countDistinct(F.when(F.col("value").isNotNull(), F.col("data_set"))).alias("given"))
    total = F.col("n_values") + (F.col("given") < sets).cast("bigint")
    return per.select("name", total.alias("n_values")).filter("n_values > 1")


def mix_training(parallel: DataFrame | None, mono: DataFrame | None, split: str, epoch: int,
                 n_mono_parts: int | None = None, parallel_ratio: float = 1.0, mono_ratio: float = 1.0, seed: int = 0,
                 one_mono_part: bool = False) -> DataFrame:
    """Training set of an epoch from parallel and monolingual sets.

    Both inputs hold ``ex_id, split, part``; all ``mono`` parts are read, or one that
    rotates with the epoch when ``one_mono_part``.  ``n_mono_parts`` names their number,
    else the part numbers come from the data.  Only the training split is mixed and sub-sampled; other
    splits come from the parallel set (else from the mono set).  ``None`` for
    one input is the only-mono or only-parallel mode.
    """
    if epoch < 1:
        raise ValueError("epochs count from 1")
    base = parallel if parallel is not None else mono
    if base is None:
        raise ValueError("no data set")
    if split != "train" or mono is None:
        kind = "parallel" if parallel is not None else "mono"
        return base.filter(F.col("split") == split).withColumn("kind", F.lit(kind))
    for ratio in (parallel_ratio, mono_ratio):
        sample_size(0, ratio)  # a wrong ratio fails at once
    train = mono.filter(F.col("split") == split)
    if one_mono_part:
        parts = list(range(n_mono_parts)) if n_mono_parts is not None else sorted(
            r["part"] for r in train.select("part").distinct().collect() if r["part"] is not None)
        train = train.filter(F.col("part") == parts[(epoch - 1) % len(parts)] if parts else F.lit(False))
    elif n_mono_parts is not None:
        train = train.filter(F.col("part").between(0, n_mono_parts - 1))
    train = train.withColumn("kind", F.lit("mono")).withColumn("_part", F.col("part"))
    if parallel is not None:  # the parallel set is one group, whatever its parts
        train = train.unionByName(parallel.filter(F.col("split") == split).withColumn("kind", F.lit("parallel"))
                                  .withColumn("_part", F.lit(None).cast(train.schema["_part"].dataType)))
    ratio = F.when(F.col("kind") == "mono", F.lit(float(mono_ratio))).otherwise(F.lit(float(parallel_ratio)))
    return subsample_groups(train, "ex_id", ratio, seed, epoch, "kind", "_part").drop("_part")


def valid_for_mono(parallel: DataFrame, mono: DataFrame) -> DataFrame:
    """Mono set with the validation split of the parallel set."""
    return mono.filter(F.col("split") != "valid").unionByName(parallel.filter(F.col("split") == "valid"))


def per_direction(df: DataFrame) -> DataFrame:
    """Fine-tune sets: a ``direction`` column to partition by; each pair in both directions."""
    return bidirect(df).withColumn("direction", F.concat_ws("-", "src_lang", "tgt_lang"))


def write_per_direction(df: DataFrame, path: str) -> None:
    per_direction(df).write.partitionBy("direction").parquet(path)


# Which (origin, side) feeds the subword model and which the dictionary, per recipe.
RECIPES = {
    "main": {
        "subword": [("parallel", "switched"), ("parallel", "target"), ("mono", "target")],
        "dictionary": [("parallel", "switched"), ("parallel", "target"), ("mono", "switched"), ("mono", "target")],
    },
    "lexicon": {
        "subword": [("parallel", "raw"), ("parallel", "target"), ("mono", "raw")],
        "dictionary": [("parallel", "switched"), ("parallel", "target"), ("mono", "switched"), ("mono", "target")],
    },
    "distill": {
        "subword": [("parallel", "raw"), ("parallel", "translation"), ("mono", "raw"), ("mono", "translation")],
        "dictionary": [("parallel", "raw"), ("parallel", "translation"), ("mono", "raw"), ("mono", "translation")],
    },
    "scratch": {
        "subword": [("parallel", "raw"), ("parallel", "target"), ("mono", "raw")],
        "dictionary": [("parallel", "raw"), ("parallel", "target"), ("mono", "raw")],
    },
}


def assemble_vocab_corpora(df: DataFrame, kind: str) -> DataFrame:
    """Rows of the subword and the dictionary corpus; ``df`` holds ``origin, side``.

    One pass: each row lists the purposes it serves.
    """

    def wanted(purpose: str) -> Column:
        hit = reduce(lambda a, b: a | b, [(F.col("origin") == o) & (F.col("side") == s)
                                          for o, s in RECIPES[kind][purpose]])
        return F.when(hit, F.lit(purpose))

    purposes = F.filter(F.array(wanted("subword"), wanted("dictionary")), lambda p: p.isNotNull())
    return df.select("*", F.explode(purposes).alias("purpose"))


def head_n(df: DataFrame, n: int, line: str = "line_no") -> DataFrame:
    return df.filter(F.col(line) < n)


def line_range(df: DataFrame, lo: int, hi: int, line: str = "line_no") -> DataFrame:
    """Lines ``lo .. hi``, 1-based and inclusive, as a line editor counts them."""
    return df.filter(F.col(line).between(lo - 1, hi - 1))


def slice_by_language(df: DataFrame, langs: list[str], n_lines: Column, line: str = "line_no") -> DataFrame:
    """Spread a corpus over languages: slices of lines/k + 1 lines, in order."""
    k = len(langs)
    size = F.floor(n_lines / k) + 1
    at = F.floor(F.col(line) / size).cast("int")
    return (df.withColumn("slice", at)
            .withColumn("slice_lang", F.get(F.array(*[F.lit(x) for x in langs]), at))
            .withColumn("slice_line", (F.col(line) - at * size).cast("bigint")))


def dev_split(df: DataFrame, n: int = 285, line: str = "slice_line", overlap: int = 0) -> DataFrame:
    """First ``n`` lines of every slice are the dev set, the rest trains.

    ``overlap=1`` also trains on the last dev line of each slice.
    """
    dev, train = F.col(line) < n, F.col(line) >= n - overlap
    names = F.filter(F.array(F.when(dev, "dev"), F.when(train, "train")), lambda v: v.isNotNull())
    return df.select("*", F.explode(names).alias("split"))


def build_matrix(src: DataFrame, candidates: DataFrame, ref: DataFrame,
                 opts: SwitchOptions = SwitchOptions(ratio=0.75)) -> DataFrame:
    """All code-switch jobs at once.

    ``src(sent_id, job, kind, text)`` with ``kind`` parallel (one language per
    sentence) or mono (many languages); every row keeps its clean target.
    """
    done = switch_by_kind(src, candidates, ref, F.col("kind") == "parallel", opts)
    return done.select("sent_id", "job", "kind", "switched", "ref")
