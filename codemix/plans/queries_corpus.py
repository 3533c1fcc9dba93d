"""Queries: corpus files, stores, slices, unions and mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from codemix.operators import blocks, corpus, report, switch
from codemix.plans import corpora as C, oracle as O
from codemix.plans.queries_switch import SWITCH_MULTI, SWITCH_SINGLE
from codemix.plans.registry import query
from codemix.session import dense_order, scratch_path, stored
from codemix.sources import lines as L, logs, store

def _langs(spark, d):
    """The languages of the table (one small row each)."""
    rows = C.table(spark, d, "documents").select("lang").distinct().collect()
    return sorted(r["lang"] for r in rows if r["lang"] is not None)


def _written(spark, d):
    """The corpora of all languages as text folders ``train.{lang}``."""
    root = scratch_path(spark, "lines")
    rows = stored(C.lines(spark, d).select("lang", "line_no", "text"), "numbered")
    langs = _langs(spark, d)
    for lang in langs:
        L.write_lines(rows.filter(F.col("lang") == lang), f"{root}/train.{lang}")
    return [f"{root}/train.{lang}" for lang in langs]


@query("read_lines", f"WITH {O.LINES} SELECT 'train' AS corpus, lang, line_no, text FROM lines")
def read_lines(spark, d):
    return L.read_lines(spark, *_written(spark, d))


@query("zip_lines", f"""WITH {O.LINES},
nos AS (SELECT DISTINCT line_no FROM lines)
SELECT n.line_no, a.text, b.text AS text_1, c.text AS text_2, e.text AS text_3,
  ((a.text IS NULL)::INT + (b.text IS NULL)::INT + (c.text IS NULL)::INT + (e.text IS NULL)::INT)::INT AS n_missing
FROM nos n LEFT JOIN lines a ON n.line_no = a.line_no AND a.lang = 'fr'
LEFT JOIN lines b ON n.line_no = b.line_no AND b.lang = 'en' LEFT JOIN lines c ON n.line_no = c.line_no AND c.lang = 'de'
LEFT JOIN lines e ON n.line_no = e.line_no AND e.lang = 'es'""")
def zip_lines(spark, d):
    rows = stored(C.lines(spark, d).select("lang", "line_no", "text"), "numbered")
    side = lambda lang: rows.filter(F.col("lang") == lang).select("line_no", "text")
    return L.zip_lines(side("fr"), side("en"), side("de"), side("es"))


@query("write_parallel", f"""WITH {O.LINES}
SELECT lang, line_no, text, array_to_string(list_reverse(words), ' ') AS tgt FROM lines""")
def write_parallel(spark, d):
    root = scratch_path(spark, "parallel")
    rows = stored(C.lines(spark, d).select(
        "lang", "line_no", F.col("text").alias("src"), F.array_join(F.reverse("words"), " ").alias("tgt")), "numbered")
    langs = _langs(spark, d)
    for lang in langs:
        L.write_parallel(rows.filter(F.col("lang") == lang), f"{root}/{lang}", lang, "rev")
    side = lambda name: L.read_lines(spark, *[f"{root}/{x}.{x if name == 'src' else 'rev'}" for x in langs]).select(
        F.col("corpus").alias("lang"), "line_no", F.col("text").alias("text" if name == "src" else "tgt"))
    return side("src").join(side("tgt"), ["lang", "line_no"])


@query("generation_log", f"""WITH {O.SENT},
drawn AS (SELECT sent_id AS id, text, {O.draw(0, 'sent_id', 0, "'score'")} AS d FROM sent),
logs AS (SELECT id, text, CASE d % 3 WHEN 0 THEN '-0.' || lpad(d::VARCHAR, 16, '0') WHEN 1 THEN '-' || d || 'e-12'
  ELSE '-0.' || lpad((d % 10000)::VARCHAR, 4, '0') END AS sc FROM drawn)
SELECT 'S' AS tag, id, NULL::DOUBLE AS score, text FROM logs UNION ALL SELECT 'T', id, NULL, text FROM logs
UNION ALL SELECT 'H', id, sc::DOUBLE, 'LANG_TOK_XX ' || text FROM logs
UNION ALL SELECT 'P', id, NULL, sc FROM logs""")
def generation_log(spark, d):
    return logs.parse_log(C.log_lines(spark, d).select("value"))


@query("read_hypotheses", f"WITH {O.SENT} SELECT sent_id AS id, 'LANG_TOK_XX ' || text AS text FROM sent")
def read_hypotheses(spark, d):
    return logs.read_hypotheses(C.log_lines(spark, d).select("value")).orderBy("id")


EXAMPLES = f"""{O.SENT},
spl AS (SELECT *, {O.draw(0, 'sent_id', 0, "'split'")} AS d FROM sent),
ex AS MATERIALIZED (SELECT sent_id AS ex_id, lang, n, CASE WHEN lang IN ('en', 'fr') THEN 'parallel' ELSE 'mono' END AS kind,
  CASE WHEN d % 20 = 0 THEN 'valid' ELSE 'train' END AS split, ((d // 32) % 3)::INT AS part FROM spl)"""


def _store(spark, d):
    """Encoded pairs: parts 0 and 2 as xx-yy, part 1 swapped as yy-xx."""
    path = scratch_path(spark, "store")
    ex = C.mono_and_parallel(spark, d)
    src, tgt = F.sequence(F.lit(4), F.col("n") + 4), F.array(F.lit(4), F.lit(2))
    enc = ex.select("ex_id", "split", "part", src.alias("src"), tgt.alias("tgt")).withColumn(
        "direction", F.lit("xx-yy"))
    turned = F.col("part") == 1
    enc = enc.select(
        "ex_id", "split", "part", F.when(turned, F.lit("yy-xx")).otherwise(F.col("direction")).alias("direction"),
        F.when(turned, F.col("tgt")).otherwise(F.col("src")).alias("src"),
        F.when(turned, F.col("src")).otherwise(F.col("tgt")).alias("tgt"))
    store.write_encoded(enc.withColumn("src_len", F.size("src")).withColumn("tgt_len", F.size("tgt")), path)
    return path


@query("encoded_store", f"""WITH {EXAMPLES}
SELECT split, CASE part WHEN 1 THEN 'yy-xx' ELSE 'xx-yy' END AS direction, part, count(*) AS n_rows,
  sum(CASE part WHEN 1 THEN 2 ELSE n + 1 END)::BIGINT AS src_tokens FROM ex GROUP BY ALL""")
def encoded_store(spark, d):
    return store.read_encoded(spark, _store(spark, d)).groupBy("split", "direction", "part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("src_len").alias("src_tokens"))


@query("load_split", f"""WITH {EXAMPLES}
SELECT ex_id, part, (n + 1)::INT AS src_len, 2 AS tgt_len, (n + 4)::INT AS last FROM ex WHERE split = 'train'""")
def load_split(spark, d):
    got = store.load_split(spark, _store(spark, d), "train", "xx", "yy")
    return got.select("ex_id", "part", "src_len", "tgt_len", F.element_at("src", -1).alias("last"))


@query("rotate_parts", f"""WITH {EXAMPLES}
SELECT 5 AS epoch, split, part, count(*) AS n_rows FROM ex
WHERE part = CASE split WHEN 'train' THEN (5 - 1) % 3 ELSE 0 END GROUP BY ALL""")
def rotate_parts(spark, d):
    ex = C.mono_and_parallel(spark, d)
    train = store.rotate_part(ex.filter("split = 'train'"), 5, 3)
    rest = store.rotate_part(ex.filter("split <> 'train'"), 5, 3, train=False)
    return train.unionByName(rest).groupBy(F.lit(5).alias("epoch"), "split", "part").agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("write_scores", f"""WITH {O.SENT} SELECT lang || '-xx' AS direction, round(avg(n), 6) AS score FROM sent GROUP BY lang""")
def write_scores(spark, d):
    path = scratch_path(spark, "scores")
    scores = C.sentences(spark, d).groupBy(F.concat("lang", F.lit("-xx")).alias("direction")).agg(
        F.round(F.avg("n"), 6).alias("score"))
    store.write_scores(scores, path)
    return spark.read.schema("score double, direction string").json(path)


@query("directions", """
WITH l AS (SELECT DISTINCT lang FROM documents)
SELECT a.lang AS src_lang, b.lang AS tgt_lang FROM l a, l b WHERE a.lang <> b.lang""")
def directions(spark, d):
    langs = [r[0] for r in C.table(spark, d, "documents").select("lang").distinct().collect()]
    return corpus.directions(spark, langs)


@query("route_directions", """
WITH l AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT a.lang || '_XX' AS src_lang, b.lang || '_XX' AS tgt_lang, a.n AS n_docs,
  CASE WHEN a.lang = 'en' THEN '1n' WHEN b.lang = 'en' THEN 'n1' ELSE 'nn' END AS model
FROM l a, l b WHERE a.lang <> b.lang""")
def route_directions(spark, d):
    counts = C.table(spark, d, "documents").groupBy(F.concat("lang", F.lit("_XX")).alias("src_lang")).agg(
        F.count(F.lit(1)).alias("n_docs"))
    langs = [r[0] for r in counts.select("src_lang").collect()]
    return corpus.directions(spark, langs).join(F.broadcast(counts), "src_lang").withColumn(
        "model", corpus.route_direction(F.col("src_lang"), F.col("tgt_lang")))


def _pairs(spark, d):
    src = C.sentences(spark, d).select("sent_id", F.col("lang").alias("src_lang"), F.col("text").alias("src"))
    tgt = C.candidates(spark, d).select(
        "sent_id", F.col("lang").alias("tgt_lang"), F.col("text").alias("tgt"))
    return blocks.joined(src, tgt, "sent_id")


PAIRS = f"""{O.CAND},
prs AS (SELECT c.sent_id, s.lang AS src_lang, c.lang AS tgt_lang, s.text AS src, c.text AS tgt
  FROM cand c JOIN sent s ON c.sent_id = s.sent_id),
both_ways AS (SELECT * FROM prs UNION ALL SELECT sent_id, tgt_lang, src_lang, tgt, src FROM prs)"""


@query("bidirectional_pairs", f"WITH {PAIRS} SELECT sent_id, src_lang, tgt_lang, src, tgt FROM both_ways")
def bidirectional_pairs(spark, d):
    return corpus.bidirect(_pairs(spark, d))


@query("per_direction_sets", f"""WITH {PAIRS}
SELECT src_lang || '-' || tgt_lang AS direction, count(*) AS n_pairs, sum(length(src))::BIGINT AS src_chars
FROM both_ways GROUP BY ALL""")
def per_direction_sets(spark, d):
    path = scratch_path(spark, "directions")
    corpus.write_per_direction(_pairs(spark, d), path)
    return spark.read.parquet(path).groupBy("direction").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum(F.length("src")).alias("src_chars"))


@query("concat_corpora", f"""WITH {O.SENT}
SELECT array_position(['en', 'fr', 'de', 'es'], lang)::INT - 1 AS part, sent_id, text FROM sent""")
def concat_corpora(spark, d):
    s = C.sentences(spark, d).select("sent_id", "lang", "text")
    return corpus.concat_corpora(*[s.filter(F.col("lang") == x).drop("lang") for x in ("en", "fr", "de", "es")])


@query("upsample_concat", f"""WITH {O.SENT}
SELECT array_position(['en', 'fr', 'de', 'es'], lang)::INT - 1 AS part, rep::INT AS rep, sent_id
FROM sent, range(1, 5) r(rep) WHERE rep <= CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 3 WHEN 'de' THEN 0 ELSE 4 END""")
def upsample_concat(spark, d):
    s = C.sentences(spark, d).select("sent_id", "lang")
    return corpus.upsample_concat([s.filter(F.col("lang") == x).drop("lang") for x in ("en", "fr", "de", "es")], [1, 3, 0, 4])


def _sub(where: str, ratio: float, kind: str, epoch: int = 4) -> str:
    key = f"('0x' || substr(md5(concat_ws(':', '42:0:{epoch}', ex_id, 0, 'subsample')), 1, 8))::BIGINT"
    return f"""SELECT ex_id, part, '{kind}' AS kind FROM (
  SELECT *, row_number() OVER (ORDER BY {key}, ex_id) AS r, count(*) OVER () AS c FROM ex WHERE split = 'train' AND {where})
  WHERE r <= ceil(c * {ratio}::DOUBLE)"""


def _mix(spark, d, **kw):
    ex = C.mono_and_parallel(spark, d)
    return corpus.mix_training(ex.filter("kind = 'parallel'").drop("kind"), ex.filter("kind = 'mono'").drop("kind"),
                               parallel_ratio=0.7, mono_ratio=0.4, **kw).select("ex_id", "part", "kind")


@query("mix_training_all_parts", f"WITH {EXAMPLES} " + " UNION ALL ".join(
    [_sub("kind = 'parallel'", 0.7, "parallel")] + [_sub(f"kind = 'mono' AND part = {p}", 0.4, "mono") for p in range(3)]))
def mix_training_all_parts(spark, d):
    return _mix(spark, d, split="train", epoch=4)


@query("mix_training_one_part", f"WITH {EXAMPLES} " + _sub("kind = 'parallel'", 0.7, "parallel")
       + " UNION ALL " + _sub("kind = 'mono' AND part = 0", 0.4, "mono"))
def mix_training_one_part(spark, d):
    return _mix(spark, d, split="train", epoch=4, one_mono_part=True)


@query("valid_for_mono", f"""WITH {EXAMPLES}
SELECT ex_id, split, lang FROM ex WHERE (kind = 'mono' AND split <> 'valid') OR (kind = 'parallel' AND split = 'valid')""")
def valid_for_mono(spark, d):
    ex = C.mono_and_parallel(spark, d).select("ex_id", "split", "lang", "kind")
    return corpus.valid_for_mono(ex.filter("kind = 'parallel'").drop("kind"), ex.filter("kind = 'mono'").drop("kind"))


@query("compatible_sets", f"""WITH {O.SENT},
per AS (SELECT lang, count(*) AS n, max(n) AS longest FROM sent GROUP BY lang),
settings AS (SELECT lang, 'lines' AS name, n::VARCHAR AS value FROM per UNION ALL SELECT lang, 'pad', '1' FROM per
  UNION ALL SELECT lang, 'long', CASE WHEN longest > 30 THEN 'yes' ELSE 'no' END FROM per
  UNION ALL SELECT lang, 'bos', '0' FROM per WHERE lang <> 'es')
SELECT name, count(DISTINCT value) + (count(*) < (SELECT count(*) FROM per))::INT AS n_values FROM settings
GROUP BY name HAVING n_values > 1""")
def compatible_sets(spark, d):
    """Settings per language set, derived from its lines; ``bos`` is not stated for es."""
    per = C.sentences(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("longest"))
    named = F.create_map(
        F.lit("lines"), F.col("n").cast("string"), F.lit("pad"), F.lit("1"),
        F.lit("long"), F.when(F.col("longest") > 30, "yes").otherwise("no"),
        F.lit("bos"), F.when(F.col("lang") != "es", "0"))
    return corpus.differing_settings(per.select(F.col("lang").alias("data_set"), F.explode(named).alias("name", "value")))


# Stated apart from the operator's table: recipe, purpose, origin, sides.
RECIPE_ROWS = """
  ('main', 'subword', 'parallel', ['switched', 'target']), ('main', 'subword', 'mono', ['target']),
  ('main', 'dictionary', 'parallel', ['switched', 'target']), ('main', 'dictionary', 'mono', ['switched', 'target']),
  ('lexicon', 'subword', 'parallel', ['raw', 'target']), ('lexicon', 'subword', 'mono', ['raw']),
  ('lexicon', 'dictionary', 'parallel', ['switched', 'target']), ('lexicon', 'dictionary', 'mono', ['switched', 'target']),
  ('distill', 'subword', 'parallel', ['raw', 'translation']), ('distill', 'subword', 'mono', ['raw', 'translation']),
  ('distill', 'dictionary', 'parallel', ['raw', 'translation']), ('distill', 'dictionary', 'mono', ['raw', 'translation']),
  ('scratch', 'subword', 'parallel', ['raw', 'target']), ('scratch', 'subword', 'mono', ['raw']),
  ('scratch', 'dictionary', 'parallel', ['raw', 'target']), ('scratch', 'dictionary', 'mono', ['raw'])"""


@query("vocabulary_corpora", f"""WITH {O.SENT},
sided AS (SELECT CASE WHEN lang IN ('en', 'fr') THEN 'parallel' ELSE 'mono' END AS origin,
  unnest(['raw', 'switched', 'target', 'translation']) AS side, n FROM sent),
listed(kind, purpose, origin, sides) AS (VALUES {RECIPE_ROWS}),
recipe AS (SELECT kind, purpose, origin, unnest(sides) AS side FROM listed)
SELECT kind, purpose, r.origin, r.side, count(*) AS n_lines, sum(n)::BIGINT AS n_tokens
FROM recipe r JOIN sided s ON r.origin = s.origin AND r.side = s.side GROUP BY ALL""")
def vocabulary_corpora(spark, d):
    side = F.explode(F.array(*[F.lit(x) for x in ("raw", "switched", "target", "translation")]))
    rows = C.sentences(spark, d).select(
        F.when(F.col("lang").isin("en", "fr"), "parallel").otherwise("mono").alias("origin"), side.alias("side"), "n")
    sets = [corpus.assemble_vocab_corpora(rows, k).withColumn("kind", F.lit(k)) for k in corpus.RECIPES]
    all_sets = sets[0]
    for s in sets[1:]:
        all_sets = all_sets.unionByName(s)
    return report.corpus_counts(all_sets, "kind", "purpose", "origin", "side", tokens=F.col("n"))


@query("corpus_counts", f"""WITH {O.SENT} SELECT lang, count(*) AS n_lines, sum(n)::BIGINT AS n_tokens FROM sent GROUP BY lang""")
def corpus_counts(spark, d):
    return report.corpus_counts(C.sentences(spark, d), "lang", tokens=F.col("n"))


@query("head_and_range", f"""WITH {O.LINES}
SELECT 'head' AS cut, lang, line_no, text FROM lines WHERE line_no < 500
UNION ALL SELECT 'range', lang, line_no, text FROM lines WHERE line_no + 1 BETWEEN 20 AND 400""")
def head_and_range(spark, d):
    rows = stored(C.lines(spark, d).select("lang", "line_no", "text"), "numbered")
    return corpus.head_n(rows, 500).withColumn("cut", F.lit("head")).unionByName(
        corpus.line_range(rows, 20, 400).withColumn("cut", F.lit("range")))


SLICED = f"""{O.LINES},
sliced AS (SELECT *, line_no // (n_lines // 3 + 1) AS slice FROM lines),
placed AS (SELECT *, (['xx', 'yy', 'zz'])[slice + 1] AS slice_lang, line_no - slice * (n_lines // 3 + 1) AS slice_line FROM sliced)"""


def _sliced(spark, d):
    return corpus.slice_by_language(C.lines(spark, d), ["xx", "yy", "zz"], F.col("n_lines"))


@query("slice_by_language", f"WITH {SLICED} SELECT sent_id, slice::INT AS slice, slice_lang, slice_line FROM placed")
def slice_by_language(spark, d):
    return _sliced(spark, d).select("sent_id", "slice", "slice_lang", "slice_line")


@query("dev_split", f"""WITH {SLICED}
SELECT sent_id, slice_lang, CASE WHEN slice_line < 285 THEN 'dev' ELSE 'train' END AS split FROM placed""")
def dev_split(spark, d):
    return corpus.dev_split(_sliced(spark, d)).select("sent_id", "slice_lang", "split")


@query("sample_report", f"""WITH {O.SENT}, numbered AS (SELECT *, row_number() OVER (ORDER BY sent_id) - 1 AS rank FROM sent)
SELECT rank, sent_id, text FROM numbered WHERE rank % 1000 = 0""")
def sample_report(spark, d):
    rows = dense_order(C.sentences(spark, d).select("sent_id", "text"), F.col("sent_id"))
    return report.sample_report(rows, 1000).select("rank", "sent_id", "text")


def _matrix_sql(switched: str, langs: str, kind: str, job: str) -> str:
    return f"""SELECT sent_id, {job} AS job, '{kind}' AS kind, switched, ref FROM ({switched}, {O.REBUILT}
SELECT s.sent_id, s.lang, s.switched, array_to_string(list_reverse(t.words), ' ') AS ref
FROM switched s JOIN sent t ON s.sent_id = t.sent_id WHERE s.lang IN ({langs}))"""


@query("code_switch_matrix",
       _matrix_sql(SWITCH_SINGLE.replace(f", {O.REBUILT}", ""), "'en', 'fr'", "parallel",
                   "CASE lang WHEN 'en' THEN 'en-fr' ELSE 'fr-en' END")
       + " UNION ALL " + _matrix_sql(SWITCH_MULTI, "'de', 'es'", "mono", "'mono-' || lang"))
def code_switch_matrix(spark, d):
    s = C.sentences(spark, d)
    job = F.when(F.col("lang") == "en", "en-fr").when(F.col("lang") == "fr", "fr-en").otherwise(
        F.concat(F.lit("mono-"), F.col("lang")))
    src = s.select("sent_id", job.alias("job"), "text",
                   F.when(F.col("lang").isin("en", "fr"), "parallel").otherwise("mono").alias("kind"))
    return corpus.build_matrix(src, C.candidates(spark, d), C.references(spark, d),
                               switch.SwitchOptions(ratio=0.75))
