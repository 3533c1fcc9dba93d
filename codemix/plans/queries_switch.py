"""Queries: alignment, code-switching and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codemix.functions.batches import n_words
from codemix.functions.text import is_alpha
from codemix.operators import align, blocks, report, switch
from codemix.plans import corpora as C, oracle as O
from codemix.plans.registry import query

SINGLE = switch.SwitchOptions(ratio=0.75, single_language=True)
MULTI = switch.SwitchOptions(ratio=0.75)


def joined_ints(col):
    return F.array_join(F.transform(col, lambda v: v.cast("string")), ",")


def assembled(spark, d):
    return switch.assemble_candidates(
        C.sentences(spark, d).select("sent_id", "lang", "text"), C.candidates(spark, d), C.references(spark, d))


def single_picks(spark, d):
    return switch.switch_picks(assembled(spark, d), SINGLE)


def candidate_pairs(spark, d):
    """One row per candidate: its alignment, the numbers of words, which source words are all letters.

    The join carries flags in place of the words of both sides, and they are found once per sentence.
    """
    src = C.sentences(spark, d).select("sent_id", "n", F.transform("words", is_alpha).alias("alpha"))
    cand = C.candidates(spark, d).select("sent_id", "lang", "alignment", n_words(F.col("text")).alias("n_tgt"))
    return blocks.joined(src, cand, "sent_id")


@query("alignment_parse", f"""WITH {O.CAND}
SELECT sent_id, lang, count(*) AS n_edges, sum(split_part(e, '-', 1)::BIGINT)::BIGINT AS sum_s,
  sum(split_part(e, '-', 2)::BIGINT)::BIGINT AS sum_t
FROM (SELECT sent_id, lang, unnest(string_split(alignment, ' ')) AS e FROM cand WHERE alignment <> '')
GROUP BY ALL""")
def alignment_parse(spark, d):
    edges = align.parse_alignment(F.col("alignment"))
    sums = C.candidates(spark, d).select("sent_id", "lang", align.edge_sums(edges).alias("e"))
    return sums.filter(F.col("e.n") > 0).select(
        "sent_id", "lang", F.col("e.n").alias("n_edges"), F.col("e.s").alias("sum_s"), F.col("e.t").alias("sum_t"))


@query("alignment_dropped", f"""WITH {O.CAND},
sized AS (SELECT *, len({O.words('text')}) AS m FROM cand)
SELECT sent_id, lang, count(*) AS n_dropped
FROM (SELECT sent_id, lang, n, m, unnest(string_split(alignment, ' ')) AS e FROM sized WHERE alignment <> '')
WHERE split_part(e, '-', 1)::BIGINT >= n OR split_part(e, '-', 2)::BIGINT >= m GROUP BY ALL""")
def alignment_dropped(spark, d):
    pairs = candidate_pairs(spark, d)
    return pairs.select("sent_id", "lang", align.dropped_edges(F.col("alignment"), F.col("n"), F.col("n_tgt")).cast("bigint")
                        .alias("n_dropped")).filter("n_dropped > 0")


@query("candidate_assembly", f"""WITH {O.CAND}
SELECT sent_id, count(*) AS n_cands, string_agg(lang || ':' || alignment, '|' ORDER BY lang_idx) AS alignments
FROM cand GROUP BY ALL""")
def candidate_assembly(spark, d):
    return assembled(spark, d).select(
        "sent_id", F.size("cands").cast("bigint").alias("n_cands"),
        F.array_join(F.transform("cands", lambda c: F.concat(c["lang"], F.lit(":"), c["alignment"])), "|")
        .alias("alignments"))


@query("candidate_validity", f"""WITH {O.VALID}
SELECT sent_id, string_agg(lang, ',' ORDER BY lang_idx) AS langs, any_value(ref) AS ref
FROM valid JOIN (SELECT sent_id AS id, array_to_string(list_reverse(words), ' ') AS ref FROM sent) ON id = sent_id
GROUP BY sent_id""")
def candidate_validity(spark, d):
    return switch.valid_candidates(assembled(spark, d), SINGLE).select(
        "sent_id", F.array_join(F.transform("cands", lambda c: c["lang"]), ",").alias("langs"), "ref")


def _phrase_rows(spark, d, **kw):
    pairs = candidate_pairs(spark, d)
    ph = align.phrases(pairs, **kw)
    return ph.select("sent_id", "lang", F.explode("phrases").alias("p")).select(
        "sent_id", "lang", joined_ints("p.s").alias("src_idx"), joined_ints("p.t").alias("tgt_idx"))


PHRASES_ALL = f"""WITH RECURSIVE {O.CAND},
pairs AS (SELECT *, len({O.words('text')}) AS m FROM cand WHERE alignment <> ''),
{O.phrases('pairs')}
SELECT sent_id, lang, array_to_string(ss, ',') AS src_idx, array_to_string(ts, ',') AS tgt_idx FROM phr"""


@query("phrase_extraction", PHRASES_ALL)
def phrase_extraction(spark, d):
    return _phrase_rows(spark, d)


@query("phrase_extraction_one_to_one", PHRASES_ALL + " WHERE len(ss) = 1 AND len(ts) = 1")
def phrase_extraction_one_to_one(spark, d):
    return _phrase_rows(spark, d, one_to_one=True)


@query("phrase_extraction_contiguous", PHRASES_ALL + " WHERE ss[-1] - ss[1] + 1 = len(ss)")
def phrase_extraction_contiguous(spark, d):
    return _phrase_rows(spark, d, contiguous_only=True)


@query("phrase_admissible", f"""WITH RECURSIVE {O.VALID}, {O.phrases()}
SELECT sent_id, lang, count(*) AS n_phrases, count(*) FILTER (WHERE NOT closed) AS n_admissible
FROM phr GROUP BY ALL""")
def phrase_admissible(spark, d):
    df = switch.with_phrases(switch.valid_candidates(assembled(spark, d), MULTI), MULTI)
    return (df.select("sent_id", F.explode("cands").alias("c"))
            .select("sent_id", F.col("c.lang").alias("lang"), F.size("c.phrases").cast("bigint").alias("n_phrases"),
                    F.size("c.queue").cast("bigint").alias("n_admissible"))
            .filter(F.col("n_phrases") > 0))


@query("language_choice", f"""WITH {O.VALID}, {O.PICKED} SELECT sent_id, lang FROM chosen""")
def language_choice(spark, d):
    df = switch.pick_language(switch.valid_candidates(assembled(spark, d), SINGLE), SINGLE.seed)
    return df.select("sent_id", F.get("cands", F.lit(0))["lang"].alias("lang"))


@query("greedy_replacement_single", f"""WITH RECURSIVE {O.VALID}, {O.PICKED}, {O.phrases('chosen')}, {O.PICKS_SINGLE}
SELECT sent_id, lang, array_to_string(ss, ',') AS src_idx,
  array_to_string(list_transform(ts, lambda j: tw[j + 1]), ' ') AS tgt_words FROM picks""")
def greedy_replacement_single(spark, d):
    return single_picks(spark, d).select("sent_id", F.explode("picks").alias("p")).select(
        "sent_id", F.col("p.lang").alias("lang"), joined_ints("p.s").alias("src_idx"),
        F.array_join("p.tw", " ").alias("tgt_words"))


SWITCH_SINGLE = f"""WITH RECURSIVE {O.VALID}, {O.PICKED}, {O.phrases('chosen')}, {O.PICKS_SINGLE}, {O.REBUILT}"""


@query("sentence_rebuild", SWITCH_SINGLE + " SELECT sent_id, switched FROM switched")
def sentence_rebuild(spark, d):
    return switch.rebuild(single_picks(spark, d)).select("sent_id", "switched")


@query("code_switch_bilingual", SWITCH_SINGLE + """
SELECT s.sent_id, s.lang, s.text, s.switched, array_to_string(list_reverse(t.words), ' ') AS ref
FROM switched s JOIN sent t ON s.sent_id = t.sent_id""")
def code_switch_bilingual(spark, d):
    return switch.code_switch(
        C.sentences(spark, d).select("sent_id", "lang", "text"), C.candidates(spark, d),
        C.references(spark, d), SINGLE).select("sent_id", "lang", "text", "switched", "ref")


# The multi-language loop, one tick per recursion step; `used` lists the replaced words.
PICKS_MULTI = f"""
queue AS MATERIALIZED (
  SELECT p.sent_id, p.lang, v.c, v.tw, v.n, ss, ts, row_number() OVER (PARTITION BY p.sent_id, p.lang
    ORDER BY {O.draw(0, 'p.sent_id', 'lab', "'phrase:' || p.lang")} >> 1, lab) AS o
  FROM phr p JOIN (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY lang_idx) - 1 AS c FROM valid) v
    ON p.sent_id = v.sent_id AND p.lang = v.lang WHERE NOT closed),
k AS (SELECT sent_id, count(*) AS k, any_value(n) AS n FROM valid GROUP BY sent_id),
walk(sent_id, k, n, step, cur, pos, used, total, picked, pc, po) AS (
  SELECT k.sent_id, k, k.n, 0, {O.draw(0, 'k.sent_id', 0, "'step'")} % k, [1, 1, 1], []::INT[], 0, FALSE,
    0::BIGINT, 0::BIGINT FROM k
  UNION ALL
  SELECT w.sent_id, w.k, w.n, CASE WHEN busy THEN step ELSE step + 1 END,
    CASE WHEN busy THEN cur ELSE {O.draw(0, 'w.sent_id', 'step + 1', "'step'")} % k END,
    list_transform(pos, lambda v, x: CASE WHEN x = cur + 1 THEN v + 1 ELSE v END),
    CASE WHEN busy THEN used ELSE list_concat(used, ss) END,
    CASE WHEN busy THEN total ELSE total + len(ss) END, NOT busy, cur, o
  FROM (SELECT w.*, q.ss, q.o, list_has_any(w.used, q.ss) AS busy FROM walk w JOIN queue q
    ON w.sent_id = q.sent_id AND w.cur = q.c AND w.pos[w.cur + 1] = q.o WHERE w.total / w.n <= 0.75) w),
picks AS MATERIALIZED (
  SELECT w.sent_id, (w.step - 1)::BIGINT AS step, q.lang, q.ss, q.ts, q.tw
  FROM walk w JOIN queue q ON w.sent_id = q.sent_id AND w.pc = q.c AND w.po = q.o WHERE picked)"""
SWITCH_MULTI = f"WITH RECURSIVE {O.VALID}, {O.phrases()}, {PICKS_MULTI}"


@query("greedy_replacement_multi", SWITCH_MULTI + """
SELECT sent_id, lang, array_to_string(ss, ',') AS src_idx,
  array_to_string(list_transform(ts, lambda j: tw[j + 1]), ' ') AS tgt_words FROM picks""")
def greedy_replacement_multi(spark, d):
    return (switch.switch_picks(assembled(spark, d), MULTI)
            .select("sent_id", F.explode("picks").alias("p"))
            .select("sent_id", F.col("p.lang").alias("lang"),
                    joined_ints("p.s").alias("src_idx"), F.array_join("p.tw", " ").alias("tgt_words")))


@query("code_switch_multilingual", SWITCH_MULTI + f""", {O.REBUILT}
SELECT s.sent_id, s.lang, s.text, s.switched, array_to_string(list_reverse(t.words), ' ') AS ref
FROM switched s JOIN sent t ON s.sent_id = t.sent_id""")
def code_switch_multilingual(spark, d):
    return switch.code_switch(
        C.sentences(spark, d).select("sent_id", "lang", "text"), C.candidates(spark, d),
        C.references(spark, d), MULTI).select("sent_id", "lang", "text", "switched", "ref")


@query("switch_totals", f"""WITH RECURSIVE {O.VALID}, {O.PICKED}, {O.phrases('chosen')}, {O.PICKS_SINGLE},
ins AS (SELECT count(DISTINCT sent_id) AS i FROM cand), outs AS (SELECT count(DISTINCT sent_id) AS o FROM valid)
SELECT any_value(i) AS lines_in, any_value(i) - any_value(o) AS lines_without, any_value(o) AS lines_out,
  count(*) AS replacements, round(sum(ss[-1] + 1 - ss[1]) / count(*), 6) AS mean_src_span,
  round(sum(len(ts)) / count(*), 6) AS mean_tgt_words FROM picks, ins, outs""")
def switch_totals(spark, d):
    lines = assembled(spark, d)
    return report.switch_totals(lines, switch.switch_picks(lines, SINGLE))


@query("switch_report", f"""WITH RECURSIVE {O.VALID}, {O.PICKED}, {O.phrases('chosen')}, {O.PICKS_SINGLE}
SELECT t.tgt AS lang, count(p.sent_id) AS replacements,
  CASE WHEN count(p.sent_id) > 0 THEN round(sum(ss[-1] + 1 - ss[1]) / count(p.sent_id), 6) END AS mean_src_span,
  CASE WHEN count(p.sent_id) > 0 THEN round(sum(len(ts)) / count(p.sent_id), 6) END AS mean_tgt_words
FROM (SELECT * FROM targets UNION ALL VALUES (3, 'ww')) t LEFT JOIN picks p ON p.lang = t.tgt GROUP BY t.tgt""")
def switch_report(spark, d):
    langs = spark.createDataFrame([(x,) for x in (*C.TARGETS, "ww")], "lang string")
    return report.switch_stats(single_picks(spark, d), langs)
