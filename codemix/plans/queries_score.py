"""Queries: scores of hypotheses, sentence vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from codemix.functions.text import untag_lang, words
from codemix.operators import align, embed, score
from codemix.plans import corpora as C, oracle as O
from codemix.plans.registry import query
from codemix.sources import logs

# Clipped n-gram counts of `toks(sent_id, grp, side, items, kind)`.
def _ngram_sql(kind: str, orders: range, sep: str) -> str:
    return f"""
SELECT sent_id, grp, '{kind}' AS kind, o, side, array_to_string(items[p : p + o - 1], '{sep}') AS gram
FROM toks, range({orders.start}, {orders.stop}) x(o), LATERAL (SELECT unnest(range(1, len(items) - o + 2)) AS p)
WHERE kind = '{kind}'"""


PIECES_SQL = """flatten(list_transform({w}, lambda w: CASE WHEN length(w) > 2 THEN ['▁' || w[1:2], w[3:]] ELSE ['▁' || w] END))"""

STATS = """
counted AS (SELECT sent_id, grp, kind, o, gram, count(*) FILTER (WHERE side = 'h') AS h,
  count(*) FILTER (WHERE side = 'r') AS r FROM grams GROUP BY ALL),
stats AS (SELECT grp, kind, o, sum(least(h, r))::DOUBLE AS m, sum(h)::DOUBLE AS h, sum(r)::DOUBLE AS r
  FROM counted GROUP BY ALL)"""


BLEU_SQL = f"""WITH {O.REFHYP},
toks AS (SELECT sent_id, grp, 'w' AS kind, 'h' AS side, {O.words('hyp')} AS items FROM refhyp
  UNION ALL SELECT sent_id, grp, 'w', 'r', {O.words('ref')} FROM refhyp),
grams AS ({_ngram_sql('w', range(1, 5), ' ')}), {STATS}
SELECT grp, round(100 * exp(sum(ln(m / h)) / 4) * any_value(bp), 2) AS bleu,
  any_value(sl)::BIGINT AS sys_len, any_value(rl)::BIGINT AS ref_len
FROM stats JOIN (SELECT grp AS g, h AS sl, r AS rl, CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END AS bp FROM stats WHERE o = 1)
  ON g = grp GROUP BY grp"""


@query("corpus_bleu", BLEU_SQL)
def corpus_bleu(spark, d):
    return score.corpus_bleu(C.ref_hyp(spark, d), ["grp"])


@query("score_log", BLEU_SQL)
def score_log(spark, d):
    """From a generation log to a score: H lines, sorted join with the references, tags off, BLEU."""
    rows = C.ref_hyp(spark, d)
    sid, tab = F.col("sent_id").cast("string"), F.lit("\t")
    log = rows.select(F.explode(F.array(
        F.concat(F.lit("S-"), sid, tab, "ref"), F.concat(F.lit("H-"), sid, tab, F.lit("-3.5e-05"), tab, F.lit("LANG_TOK_XX "), "hyp"),
        F.concat(F.lit("P-"), sid, tab, F.lit("-0.1")))).alias("value"))
    hyps = logs.read_hypotheses(log).select(
        F.col("id").alias("sent_id"), untag_lang(F.col("text"), F.lit("xx")).alias("hyp"))
    return score.corpus_bleu(rows.select("sent_id", "grp", "ref").join(hyps, "sent_id"), ["grp"])


MTEVAL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || {t} || ' ',
  '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'),
  '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')"""


def _mteval_words(col: str) -> str:
    text = col
    for a, b in (("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{a}', '{b}')"
    return O.words(MTEVAL_SQL.replace("{t}", text))


@query("corpus_bleu_13a", f"""WITH {O.REFHYP},
toks AS (SELECT sent_id, grp, 'w' AS kind, 'h' AS side, {_mteval_words('hyp')} AS items FROM refhyp
  UNION ALL SELECT sent_id, grp, 'w', 'r', {_mteval_words('ref')} FROM refhyp),
grams AS ({_ngram_sql('w', range(1, 5), ' ')}), {STATS}
SELECT grp, round(100 * exp(sum(ln(m / h)) / 4) * any_value(bp), 2) AS bleu,
  any_value(sl)::BIGINT AS sys_len, any_value(rl)::BIGINT AS ref_len
FROM stats JOIN (SELECT grp AS g, h AS sl, r AS rl, CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END AS bp FROM stats WHERE o = 1)
  ON g = grp GROUP BY grp""")
def corpus_bleu_13a(spark, d):
    return score.corpus_bleu(C.ref_hyp(spark, d), ["grp"], tokenizer="13a")


# A corpus with unspaced characters: two letters of the sentences become ideographs.
LETTERS, SIGNS = "qx", "的一"


def _sign_words(col: str) -> str:
    alone = f"regexp_replace(trim(translate({col}, '{LETTERS}', '{SIGNS}')), '([一-龥])', ' \\1 ', 'g')"
    return O.words(MTEVAL_SQL.replace("' ' || {t} || ' '", alone))


@query("corpus_bleu_zh", f"""WITH {O.REFHYP},
toks AS (SELECT sent_id, grp, 'w' AS kind, 'h' AS side, {_sign_words('hyp')} AS items FROM refhyp
  UNION ALL SELECT sent_id, grp, 'w', 'r', {_sign_words('ref')} FROM refhyp),
grams AS ({_ngram_sql('w', range(1, 5), ' ')}), {STATS}
SELECT grp, round(100 * exp(sum(ln(m / h)) / 4) * any_value(bp), 2) AS bleu,
  any_value(sl)::BIGINT AS sys_len, any_value(rl)::BIGINT AS ref_len
FROM stats JOIN (SELECT grp AS g, h AS sl, r AS rl, CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END AS bp FROM stats WHERE o = 1)
  ON g = grp GROUP BY grp""")
def corpus_bleu_zh(spark, d):
    sides = [F.translate(c, LETTERS, SIGNS).alias(c) for c in ("ref", "hyp")]
    return score.corpus_bleu(C.ref_hyp(spark, d).select("grp", *sides), ["grp"], tokenizer="zh")


@query("corpus_bleu_pieces", f"""WITH {O.REFHYP},
toks AS (SELECT sent_id, grp, 'w' AS kind, 'h' AS side, {PIECES_SQL.replace('{w}', O.words('hyp'))} AS items FROM refhyp
  UNION ALL SELECT sent_id, grp, 'w', 'r', {PIECES_SQL.replace('{w}', O.words('ref'))} FROM refhyp),
grams AS ({_ngram_sql('w', range(1, 5), ' ')}), {STATS}
SELECT grp, round(100 * exp(sum(ln(m / h)) / 4) * any_value(bp), 2) AS bleu,
  any_value(sl)::BIGINT AS sys_len, any_value(rl)::BIGINT AS ref_len
FROM stats JOIN (SELECT grp AS g, h AS sl, r AS rl, CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END AS bp FROM stats WHERE o = 1)
  ON g = grp GROUP BY grp""")
def corpus_bleu_pieces(spark, d):
    """Scores on pieces: here a word's first two characters and its rest."""
    pieces = lambda c: F.flatten(F.transform(words(F.col(c)), lambda w: F.when(F.length(w) > 2, F.array(
        F.concat(F.lit("▁"), F.substring(w, 1, 2)), F.substring(w, F.lit(3), F.length(w)))).otherwise(
        F.array(F.concat(F.lit("▁"), w)))))
    rows = C.ref_hyp(spark, d).select("grp", pieces("ref").alias("ref"), pieces("hyp").alias("hyp"))
    return score.corpus_bleu(rows, ["grp"], tokenizer="pieces")


@query("bleu_batch_counts", f"""WITH {O.REFHYP},
toks AS (SELECT sent_id, sent_id // 10000000 AS grp, 'w' AS kind, 'h' AS side, {O.words('hyp')} AS items FROM refhyp
  UNION ALL SELECT sent_id, sent_id // 10000000, 'w', 'r', {O.words('ref')} FROM refhyp),
grams AS ({_ngram_sql('w', range(1, 5), ' ')}), {STATS}
SELECT grp AS batch, sum(CASE WHEN o = 1 THEN m ELSE 0 END)::BIGINT AS m1, sum(CASE WHEN o = 4 THEN m ELSE 0 END)::BIGINT AS m4,
  sum(CASE WHEN o = 4 THEN h ELSE 0 END)::BIGINT AS h4, sum(CASE WHEN o = 1 THEN r ELSE 0 END)::BIGINT AS r1
FROM stats GROUP BY grp""")
def bleu_batch_counts(spark, d):
    df = C.ref_hyp(spark, d).withColumn("batch", F.floor(F.col("sent_id") / C.LINES_PER_DOC))
    return score.bleu_counts(df, ["batch"]).select("batch", "m1", "m4", "h4", "r1")


PUNCT = r"[!-/:-@\[-`{-~]"
SCORED = r"""flatten(list_transform({words}, lambda w: CASE WHEN length(w) = 1 THEN [w]
  WHEN regexp_matches(w, '{p}$') THEN [w[:-2], w[-1]] WHEN regexp_matches(w, '^{p}') THEN [w[1], w[2:]] ELSE [w] END))"""


def _scored_rows(col: str, side: str) -> str:
    scored = SCORED.replace("{words}", O.words(col)).replace("{p}", PUNCT)
    return f"SELECT sent_id, grp, 'w' AS kind, '{side}' AS side, {scored} AS items FROM refhyp"


CHAR_GRAMS = f"""
SELECT sent_id, grp, 'c' AS kind, o, side, substr(s, p, o) AS gram FROM (
  SELECT sent_id, grp, side, s, o, unnest(range(1, length(s) - o + 2)) AS p FROM (
    SELECT sent_id, grp, 'h' AS side, array_to_string({O.words('hyp')}, '') AS s FROM refhyp
    UNION ALL SELECT sent_id, grp, 'r', array_to_string({O.words('ref')}, '') FROM refhyp), range(1, 7) x(o))"""


@query("corpus_chrf", f"""WITH {O.REFHYP},
toks AS ({_scored_rows('hyp', 'h')} UNION ALL {_scored_rows('ref', 'r')}),
grams AS ({CHAR_GRAMS} UNION ALL {_ngram_sql('w', range(1, 3), ' ')}), {STATS},
pr AS (SELECT grp, avg(m / h) AS p, avg(m / r) AS q FROM stats WHERE h > 0 AND r > 0 GROUP BY grp)
SELECT grp, round(100 * 5 * p * q / (4 * p + q), 2) AS chrf FROM pr""")
def corpus_chrf(spark, d):
    return score.corpus_chrf(C.ref_hyp(spark, d), ["grp"])


@query("mean_pooling", f"""WITH {O.VECPAIR},
kept AS (SELECT batch_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS dim FROM vp WHERE pos < 4 + batch_id % 9)
SELECT batch_id, dim::INT AS dim, round(avg(x), 6) AS value FROM kept GROUP BY ALL""")
def mean_pooling(spark, d):
    rows = C.vector_pairs(spark, d).groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "a"))).alias("v"))
    padded = rows.select("batch_id", F.col("v.a").alias("vecs"), F.transform(
        "v", lambda e: e["pos"] < F.lit(4) + F.col("batch_id") % 9).alias("mask"))
    return embed.mean_pool(padded).select("batch_id", F.posexplode("pooled").alias("dim", "value")).select(
        "batch_id", "dim", F.round("value", 6).alias("value"))


@query("batch_pairs", f"""WITH {O.VECPAIR}
SELECT a.batch_id, a.pos AS j, c.pos AS i, round(list_inner_product(a.a, c.c), 5) AS dot
FROM vp a JOIN vp c ON a.batch_id = c.batch_id""")
def batch_pairs(spark, d):
    vp = C.vector_pairs(spark, d)
    pairs = embed.batch_pairs(vp.select("batch_id", "pos", F.col("a").alias("vec")),
                              vp.select("batch_id", "pos", F.col("c").alias("vec")))
    return pairs.select("batch_id", "j", "i", F.round(embed.dot(F.col("a"), F.col("c")), 5).alias("dot"))


@query("contrastive_loss", f"""WITH {O.VECPAIR},
sim AS (SELECT x.batch_id, x.pos AS j, y.pos AS i, list_inner_product(x.a, y.c)
    / (greatest(sqrt(list_inner_product(x.a, x.a)), 1e-8) * greatest(sqrt(list_inner_product(y.c, y.c)), 1e-8)) / 0.1 AS s
  FROM vp x JOIN vp y ON x.batch_id = y.batch_id),
terms AS (SELECT batch_id, j, ln(sum(exp(s))) - sum(s) FILTER (WHERE i = j) AS l FROM sim GROUP BY ALL)
SELECT batch_id, count(*) AS nsentences, round(sum(l), 6) AS loss, round(sum(l) / count(*) / ln(2), 6) AS bits
FROM terms GROUP BY batch_id""")
def contrastive_loss(spark, d):
    per = embed.contrastive_loss(C.vector_pairs(spark, d))
    return embed.reduce_loss(per, "batch_id").select(
        "batch_id", "nsentences", F.round("loss", 6).alias("loss"), F.round("contrastive_loss", 6).alias("bits"))


@query("align_embeddings", f"""WITH {O.VECPAIR},
sim AS (SELECT x.batch_id, x.pos AS s, y.pos AS t, exp(list_inner_product(x.a, y.c)) AS e
  FROM vp x JOIN vp y ON x.batch_id = y.batch_id),
norm AS (SELECT *, e / sum(e) OVER (PARTITION BY batch_id, s) AS pr, e / sum(e) OVER (PARTITION BY batch_id, t) AS pc FROM sim)
SELECT batch_id, s::INT AS s, t::INT AS t, round(pr, 6) AS p_row, round(pc, 6) AS p_col FROM norm WHERE pr > 0.05 AND pc > 0.05""")
def align_embeddings(spark, d):
    rows = C.vector_pairs(spark, d).groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "c"))).alias("v"))
    vecs = rows.select("batch_id", F.col("v.a").alias("src_vecs"), F.col("v.c").alias("tgt_vecs"))
    return align.align_embeddings(vecs, 0.05).select("batch_id", F.explode("edges").alias("e")).select(
        "batch_id", "e.s", "e.t", F.round("e.p_row", 6).alias("p_row"), F.round("e.p_col", 6).alias("p_col"))
