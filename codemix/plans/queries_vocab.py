"""Queries: vocabularies, id sequences, subwords."""

from __future__ import annotations

from pyspark.sql import functions as F

from codemix.functions import text as T
from codemix.operators import blocks, subword, vocab
from codemix.plans import corpora as C, oracle as O
from codemix.plans.queries_switch import joined_ints
from codemix.plans.registry import query
from codemix.session import broadcast_if_small, checkpointed, scratch_path, stored
from codemix.sources import store

TAGS = ["en", "fr", "de", "es"]


def vocab_sql(threshold: int) -> str:
    return f"""{O.SENT},
counted AS (SELECT w AS token, count(*) AS cnt FROM tok GROUP BY w HAVING count(*) >= {threshold}),
vocab AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id, token, cnt FROM counted
  UNION ALL SELECT (SELECT count(*) FROM counted) + 4 + k, tag, 1
  FROM (VALUES (0, 'LANG_TOK_EN'), (1, 'LANG_TOK_FR'), (2, 'LANG_TOK_DE'), (3, 'LANG_TOK_ES')) t(k, tag)),
encoded AS (
  SELECT t.sent_id AS ex_id, string_agg(coalesce(v.id, 3)::VARCHAR, ',' ORDER BY i) || ',2' AS ids
  FROM tok t LEFT JOIN vocab v ON t.w = v.token GROUP BY t.sent_id)"""


def _vocab(spark, d, threshold):
    return vocab.build_vocab(C.sentences(spark, d), TAGS, threshold=threshold)


@query("build_vocabulary", f"WITH {vocab_sql(0)} SELECT id, token, cnt FROM vocab")
def build_vocabulary(spark, d):
    return _vocab(spark, d, 0)


@query("vocabulary_store", f"WITH {vocab_sql(2)} SELECT id, token, cnt FROM vocab")
def vocabulary_store(spark, d):
    path = scratch_path(spark, "vocab") + "/dict.src"
    store.write_vocab(_vocab(spark, d, 2), path)
    return store.read_vocab(spark, path)


def _encoded(spark, d):
    voc = checkpointed(_vocab(spark, d, 2))
    df = C.sentences(spark, d).withColumnRenamed("sent_id", "ex_id")
    return voc, vocab.encode_ids(df, voc)


@query("encode_ids", f"WITH {vocab_sql(2)} SELECT ex_id, ids FROM encoded")
def encode_ids(spark, d):
    return _encoded(spark, d)[1].select("ex_id", joined_ints("ids").alias("ids"))


@query("decode_ids", f"""WITH {vocab_sql(2)}
SELECT t.sent_id AS ex_id, string_agg(coalesce(v.token, 'UNKNOWNTOKENINREF'), ' ' ORDER BY i) AS ref,
  string_agg(coalesce(v.token, 'UNKNOWNTOKENINHYP'), ' ' ORDER BY i) AS hyp
FROM tok t LEFT JOIN vocab v ON t.w = v.token GROUP BY t.sent_id""")
def decode_ids(spark, d):
    voc, enc = _encoded(spark, d)
    sides = [vocab.decode_ids(enc, voc, s).withColumnRenamed("text", s) for s in ("ref", "hyp")]
    return blocks.joined(*sides, "ex_id")


LENGTH_IDS = f"""{O.SENT}, ids AS (SELECT sent_id AS ex_id, n, list_transform(words, lambda w: length(w) + 4) AS body FROM sent)"""


def _length_ids(spark, d):
    """Stand-in ids (word length + 4), without end mark."""
    return C.sentences(spark, d).select(
        F.col("sent_id").alias("ex_id"), "n", F.transform("words", lambda w: F.length(w) + 4).alias("body"))


@query("shape_tokens", f"""WITH {LENGTH_IDS}
SELECT ex_id, array_to_string(list_concat(body[:49], [2]), ',') AS cut,
  array_to_string(list_concat([0], list_concat(list_concat(body, [2]), [32000 + n % 3])), ',') AS marked FROM ids""")
def shape_tokens(spark, d):
    ids = _length_ids(spark, d).withColumn("ids", F.concat("body", F.array(F.lit(vocab.EOS))))
    return ids.select(
        "ex_id", joined_ints(vocab.shape_tokens(F.col("ids"), max_positions=50)).alias("cut"),
        joined_ints(vocab.shape_tokens(F.col("ids"), prepend_bos=True, append_id=F.lit(32000) + F.col("n") % 3))
        .alias("marked"))


@query("swap_direction", f"""WITH {LENGTH_IDS},
tgts AS (SELECT ex_id, n, list_concat(body, [2]) AS src, list_concat(list_reverse(body), [2]) AS tgt,
  list_resize([]::BIGINT[], n % 3, 1) AS pads FROM ids),
pr AS (SELECT ex_id, src, list_concat(tgt, pads) AS tgt, list_concat([2], list_concat(tgt, pads)[:-2]) AS prev FROM tgts),
sw AS (SELECT ex_id, tgt AS src, list_concat(prev[1:1], src) AS joint FROM pr)
SELECT ex_id, array_to_string(src, ',') AS src, array_to_string(joint[2:], ',') AS tgt,
  array_to_string(joint[:-2], ',') AS prev, len(list_filter(src, lambda v: v <> 1))::INT AS n_src,
  len(list_filter(joint[2:], lambda v: v <> 1))::INT AS n_tgt FROM sw""")
def swap_direction(spark, d):
    pads = F.array_repeat(F.lit(vocab.PAD), F.col("n") % 3)
    eos = F.array(F.lit(vocab.EOS))
    pairs = _length_ids(spark, d).select(
        "ex_id", F.concat("body", eos).alias("src"), F.concat(F.reverse("body"), eos, pads).alias("tgt"))
    pairs = pairs.withColumn("prev", F.concat(eos, F.slice("tgt", F.lit(1), F.size("tgt") - 1)))
    out = vocab.swap_pair(pairs)
    return out.select("ex_id", *[joined_ints(c).alias(c) for c in ("src", "tgt", "prev")], "n_src", "n_tgt")


@query("learn_subwords")
def learn_subwords(spark, d):
    return subword.learn_model(C.sentences(spark, d)).select("piece", F.round("logp", 6).alias("logp"))


@query("subword_seeds", f"""WITH {O.SENT},
words AS MATERIALIZED (SELECT '▁' || w AS word, count(*) AS c FROM tok GROUP BY w),
cuts AS (SELECT word, c, l, unnest(range(1, len(word) - l + 2)) AS s FROM words, range(1, 17) x(l) WHERE l <= len(word)),
found AS (SELECT substr(word, s, l) AS piece, l::INT AS len, sum(c)::BIGINT AS freq FROM cuts GROUP BY ALL)
SELECT piece, len, freq FROM found WHERE len = 1 OR freq >= 2""")
def subword_seeds(spark, d):
    """Every repeated substring of the marked words with its count, from sorted suffixes."""
    return subword.substrings(subword.word_counts(C.sentences(spark, d)))


def _trigram_model(spark, d):
    """A fixed model: every substring of up to three characters of the marked words, by frequency."""
    counts = subword.word_counts(C.sentences(spark, d))
    rows = subword.substrings(counts, max_piece=3, min_count=1)
    return subword.normalised(rows.select("piece", F.col("freq").cast("double").alias("expected")))


# Best score of a prefix from those of the three before it; the longest piece wins a tie.
SEGMENTED = f"""WITH RECURSIVE {O.SENT},
words AS MATERIALIZED (SELECT '▁' || w AS word, count(*) AS c FROM tok GROUP BY w),
subs AS (SELECT substr(word, s, l) AS piece, sum(c) AS freq FROM words, range(1, 4) x(l),
  LATERAL (SELECT unnest(range(1, len(word) - l + 2)) AS s) GROUP BY piece),
model AS MATERIALIZED (SELECT piece, ln(freq::DOUBLE / (SELECT sum(freq) FROM subs)::DOUBLE) AS logp FROM subs),
walk(word, e, s0, p0, s1, p1, s2, p2) AS (
  SELECT word, 0, 0.0::DOUBLE, '', '-inf'::DOUBLE, '', '-inf'::DOUBLE, '' FROM words
  UNION ALL
  SELECT word, e + 1,
    CASE WHEN c3 >= c2 AND c3 >= c1 THEN c3 WHEN c2 >= c1 THEN c2 ELSE c1 END,
    CASE WHEN c3 >= c2 AND c3 >= c1 THEN p2 || ' ' || substr(word, e - 1, 3) WHEN c2 >= c1 THEN p1 || ' ' || substr(word, e, 2)
      ELSE p0 || ' ' || substr(word, e + 1, 1) END, s0, p0, s1, p1
  FROM (SELECT w.*, s0 + a.logp AS c1, s1 + coalesce(b.logp, 0) AS c2, s2 + coalesce(c.logp, 0) AS c3
    FROM walk w JOIN model a ON a.piece = substr(word, e + 1, 1) LEFT JOIN model b ON e >= 1 AND b.piece = substr(word, e, 2)
    LEFT JOIN model c ON e >= 2 AND c.piece = substr(word, e - 1, 3) WHERE e < len(word)))
"""


@query("segment_words", SEGMENTED + "SELECT word, trim(p0) AS pieces, round(s0, 6) AS score FROM walk WHERE e = len(word)")
def segment_words(spark, d):
    """Every distinct word under the fixed model, with its score."""
    model = _trigram_model(spark, d)
    words = C.sentences(spark, d).select(F.explode("words").alias("w")).distinct().select(
        F.concat(F.lit(subword.MARK), "w").alias("word"), F.array("w").alias("words"))
    cut = subword.encode_subwords(words, model).select("word", "pieces")
    scored = cut.select("word", "pieces", F.posexplode("pieces").alias("i", "piece")).join(broadcast_if_small(model), "piece")
    return scored.groupBy("word", "pieces").agg(F.round(F.sum("logp"), 6).alias("score")).select(
        "word", F.array_join("pieces", " ").alias("pieces"), "score")


# Sums over all segmentations: ahead from the beginning of a word, back from its end, over pieces of up to
# three characters. s1 and s2 are the sums one and two characters before s0.
EM_ROUND = SEGMENTED[:SEGMENTED.index("walk(")].rstrip() + """
ahead(word, e, s0, s1, s2) AS (
  SELECT word, 0, 0.0::DOUBLE, '-inf'::DOUBLE, '-inf'::DOUBLE FROM words
  UNION ALL
  SELECT word, e + 1, m + ln(exp(c1 - m) + exp(c2 - m) + exp(c3 - m)), s0, s1 FROM (
    SELECT *, greatest(c1, c2, c3) AS m FROM (
      SELECT w.*, s0 + a.logp AS c1, CASE WHEN e >= 1 THEN s1 + b.logp ELSE '-inf'::DOUBLE END AS c2,
        CASE WHEN e >= 2 THEN s2 + c.logp ELSE '-inf'::DOUBLE END AS c3
      FROM ahead w JOIN model a ON a.piece = substr(word, e + 1, 1) LEFT JOIN model b ON e >= 1 AND b.piece = substr(word, e, 2)
      LEFT JOIN model c ON e >= 2 AND c.piece = substr(word, e - 1, 3) WHERE e < len(word)))),
back(word, e, s0, s1, s2) AS (
  SELECT word, len(word), 0.0::DOUBLE, '-inf'::DOUBLE, '-inf'::DOUBLE FROM words
  UNION ALL
  SELECT word, e - 1, m + ln(exp(c1 - m) + exp(c2 - m) + exp(c3 - m)), s0, s1 FROM (
    SELECT *, greatest(c1, c2, c3) AS m FROM (
      SELECT w.*, s0 + a.logp AS c1, CASE WHEN e <= len(word) - 1 THEN s1 + b.logp ELSE '-inf'::DOUBLE END AS c2,
        CASE WHEN e <= len(word) - 2 THEN s2 + c.logp ELSE '-inf'::DOUBLE END AS c3
      FROM back w JOIN model a ON a.piece = substr(word, e, 1) LEFT JOIN model b ON e <= len(word) - 1 AND b.piece = substr(word, e, 2)
      LEFT JOIN model c ON e <= len(word) - 2 AND c.piece = substr(word, e, 3) WHERE e > 0))),
arcs AS (SELECT a.word, a.e AS s, a.e + l AS t, substr(a.word, a.e + 1, l) AS piece, a.s0 AS before
  FROM ahead a, range(1, 4) x(l) WHERE a.e + l <= len(a.word)),
uses AS (SELECT r.piece, c * exp(before + logp + b.s0 - z.s0) AS x FROM arcs r JOIN model m USING (piece)
  JOIN back b ON b.word = r.word AND b.e = r.t JOIN back z ON z.word = r.word AND z.e = 0 JOIN words w ON w.word = r.word)
SELECT piece, round(sum(x), 2) AS expected FROM uses GROUP BY piece"""


@query("subword_em_round", EM_ROUND)
def subword_em_round(spark, d):
    """Expected uses of every piece of the fixed model: one EM round by forward and backward sums."""
    counts = subword.word_counts(C.sentences(spark, d))
    uses = subword.expectation(counts, _trigram_model(spark, d)).filter("piece IS NOT NULL")
    return uses.select("piece", F.round("expected", 2).alias("expected"))


@query("prepare_ids", SEGMENTED.rstrip() + """,
seg AS MATERIALIZED (SELECT word, string_split(trim(p0), ' ') AS ps FROM walk WHERE e = len(word)),
flat AS MATERIALIZED (SELECT t.sent_id, t.i, unnest(ps) AS piece, generate_subscripts(ps, 1) AS j
  FROM tok t JOIN seg s ON s.word = '▁' || t.w),
voc AS (SELECT piece AS token, row_number() OVER (ORDER BY count(*) DESC, piece) + 3 AS id FROM flat GROUP BY piece)
SELECT sent_id AS ex_id, string_agg(v.id::VARCHAR, ',' ORDER BY i, j) || ',2' AS ids FROM flat JOIN voc v ON token = piece
GROUP BY sent_id""")
def prepare_ids(spark, d):
    """Sentences to ids: subwords, a vocabulary of the pieces, lookup."""
    cut = stored(subword.encode_subwords(C.sentences(spark, d), _trigram_model(spark, d)).select(
        F.col("sent_id").alias("ex_id"), "pieces"), "pieces")
    voc = stored(vocab.build_vocab(cut, [], words="pieces"), "vocabulary")
    return vocab.encode_ids(cut, voc, words="pieces").select("ex_id", joined_ints("ids").alias("ids"))


@query("encode_subwords_round_trip", f"WITH {O.SENT} SELECT sent_id, text FROM sent")
def encode_subwords_round_trip(spark, d):
    """Encode, then decode: the text itself."""
    sentences = C.sentences(spark, d)
    enc = subword.encode_subwords(sentences, subword.learn_model(sentences))
    return enc.select("sent_id", T.decode_pieces(F.col("pieces")).alias("text"))


def _merges(spark, d, n=300):
    """The most frequent character pairs of the corpus, as a merge list."""
    words = C.sentences(spark, d).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    pairs = words.filter("length(w) > 1").select("c", F.split("w", "").alias("ch")).select("c", F.explode(F.zip_with(
        F.slice("ch", F.lit(1), F.size("ch") - 1), F.slice("ch", F.lit(2), F.size("ch")),
        lambda a, b: F.when(b.isNotNull(), F.struct(a.alias("a"), b.alias("b"))))).alias("p")).filter("p IS NOT NULL")
    top = pairs.groupBy("p").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "p").limit(n)
    return [(r["p"]["a"], r["p"]["b"]) for r in top.collect()]


@query("bpe_round_trip", f"WITH {O.SENT} SELECT sent_id, text FROM sent")
def bpe_round_trip(spark, d):
    """Apply a merge list, then remove the marks: the text itself."""
    out = subword.apply_bpe(C.sentences(spark, d), _merges(spark, d))
    return out.select("sent_id", T.remove_bpe(F.array_join("pieces", " ")).alias("text"))


@query("decode_pieces", f"""WITH {O.SENT}
SELECT sent_id, trim(replace(array_to_string(list_transform(words, lambda w: '▁' || w), ''), '▁', ' ')) AS text,
  rtrim(replace(array_to_string(list_transform(words, lambda w: w[1:2] || '@@ ' || w[3:]), ' ') || ' ', '@@ ', '')) AS joined
FROM sent""")
def decode_pieces(spark, d):
    s = C.sentences(spark, d)
    pieces = F.transform("words", lambda w: F.concat(F.lit("▁"), w))
    cut = F.array_join(F.transform("words", lambda w: F.concat(
        F.substring(w, 1, 2), F.lit("@@ "), F.substring(w, F.lit(3), F.length(w)))), " ")
    return s.select("sent_id", T.decode_pieces(pieces).alias("text"), T.remove_bpe(cut).alias("joined"))
