"""Queries: text columns, filters, dictionary substitution."""

from __future__ import annotations

from pyspark.sql import functions as F

from codemix.functions import text as T
from codemix.operators import blocks, clean, corpus, lexsub, report
from codemix.plans import corpora as C, oracle as O
from codemix.plans.registry import query
from codemix.sources import lexicon as lex_source
from codemix.session import scratch_path


@query("language_codes", """
SELECT lang || '_XX' AS code, substr(lang || '_XX', 1, 2) AS short,
  'LANG_TOK_' || upper(substr(lang || '_XX', 1, 2)) AS tag, count(*) AS n_docs FROM documents GROUP BY ALL""")
def language_codes(spark, d):
    code = F.concat("lang", F.lit("_XX"))
    return (C.table(spark, d, "documents").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n_docs"))
            .select("code", T.lang_short(F.col("code")).alias("short"), T.lang_tag(F.col("code")).alias("tag"), "n_docs"))


@query("tokenize_words", f"WITH {O.SENT} SELECT sent_id, n::INT AS n_words, text FROM sent")
def tokenize_words(spark, d):
    return C.sentences(spark, d).select("sent_id", F.col("n").alias("n_words"), "text")


@query("clean_pairs", f"""WITH {O.CAND}
SELECT sent_id, lang FROM cand
WHERE len({O.words('text')}) > 0 AND least(n / len({O.words('text')}), len({O.words('text')}) / n) >= 0.6
  AND text <> src_text""")
def clean_pairs(spark, d):
    src = C.sentences(spark, d).select("sent_id", F.col("text").alias("src"))
    pairs = blocks.joined(src, C.candidates(spark, d).select("sent_id", "lang", F.col("text").alias("tgt")), "sent_id")
    return clean.clean_pairs(pairs).select("sent_id", "lang")


@query("token_classes", rf"""WITH {O.SENT}
SELECT lang, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_full_match(w, '\p{{L}}+')) AS n_alpha,
  count(*) FILTER (WHERE regexp_full_match(w, '\p{{Nd}}+')) AS n_digit,
  count(*) FILTER (WHERE regexp_full_match(w, '[^\p{{L}}\p{{Nd}}]+')) AS n_symbol FROM tok GROUP BY lang""")
def token_classes(spark, d):
    tok = C.sentences(spark, d).select("lang", F.explode("words").alias("w"))
    count = lambda c: F.count(F.when(c, 1))
    return tok.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_tokens"), count(T.is_alpha(F.col("w"))).alias("n_alpha"),
        count(T.is_digit(F.col("w"))).alias("n_digit"), count(T.is_symbol(F.col("w"))).alias("n_symbol"))


@query("drop_blank_lines", rf"""
SELECT doc_id, count(*) AS n_lines FROM (
  SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM documents)
WHERE trim(line, {O.BLANK_CHARS}) <> '' GROUP BY doc_id""")
def drop_blank_lines(spark, d):
    raw = C.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", T.LINE_END)).alias("text"))
    return clean.drop_blank(raw).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def tagged_pairs(spark, d):
    src = C.sentences(spark, d).select("sent_id", F.concat("lang", F.lit("_XX")).alias("src_lang"), F.col("text").alias("src"))
    tgt = C.candidates(spark, d).select("sent_id", F.concat("lang", F.lit("_ZZ")).alias("tgt_lang"), F.col("text").alias("tgt"))
    return corpus.tag_pairs(blocks.joined(src, tgt, "sent_id"))


@query("tag_pairs", f"""WITH {O.CAND}
SELECT c.sent_id, s.lang || '_XX' AS src_lang, c.lang || '_ZZ' AS tgt_lang,
  'LANG_TOK_' || upper(s.lang) || ' ' || s.text AS src, 'LANG_TOK_' || upper(c.lang) || ' ' || c.text AS tgt
FROM cand c JOIN sent s ON c.sent_id = s.sent_id""")
def tag_pairs(spark, d):
    return tagged_pairs(spark, d)


@query("untag_output", f"""WITH {O.SENT}
SELECT sent_id, CASE WHEN n > 1 THEN array_to_string(words[2:], ' ') ELSE text END AS cut,
  replace('LANG_TOK_' || upper(lang) || ' ' || text, 'LANG_TOK_' || upper(lang) || ' ', '') AS plain FROM sent""")
def untag_output(spark, d):
    s = C.sentences(spark, d)
    return s.select("sent_id", T.untag(F.col("text")).alias("cut"),
                    T.untag_lang(T.with_tag(F.col("text"), F.col("lang")), F.col("lang")).alias("plain"))


@query("postedit_output", f"""WITH {O.SENT},
quoted AS (SELECT sent_id, lang, CASE WHEN n > 2 THEN words[1] || ' "' || words[2] || '" "' || array_to_string(words[3:], ' ') || '"'
  ELSE text END AS q FROM sent)
SELECT sent_id, CASE WHEN lang = 'fr' THEN regexp_replace(q, '"([^"]*)"', '« \\1 »', 'g') ELSE q END AS text,
  CASE lang WHEN 'zh' THEN 'zh' WHEN 'ja' THEN 'ja-mecab' ELSE 'none' END AS tokenizer FROM quoted""")
def postedit_output(spark, d):
    w = F.col("words")
    quoted = F.when(F.col("n") > 2, F.concat(
        F.get(w, F.lit(0)), F.lit(' "'), F.get(w, F.lit(1)), F.lit('" "'),
        F.array_join(F.slice(w, F.lit(3), F.size(w)), " "), F.lit('"'))).otherwise(F.col("text"))
    return C.sentences(spark, d).select(
        "sent_id", T.postedit(quoted, F.col("lang")).alias("text"), T.scorer_tokenizer(F.col("lang")).alias("tokenizer"))


def _rule_sql(expr, rules):
    for pattern, repl in rules:
        pattern, repl = pattern.replace("'", "''"), repl.replace("$", "\\").replace("'", "''")
        expr = f"regexp_replace({expr}, '{pattern}', '{repl}', 'g')"
    return expr


TOKENIZED = f"""WITH {O.SENT},
base AS (SELECT sent_id, lang, text, {_rule_sql('text', T.TOKENIZE)} AS b FROM sent),
tokd AS (SELECT sent_id, lang, text, array_to_string({O.words("CASE lang WHEN 'fr' THEN " + _rule_sql('b', T.APOSTROPHE['fr'])
  + " WHEN 'en' THEN " + _rule_sql('b', T.APOSTROPHE['en']) + " ELSE " + _rule_sql('b', T.APOSTROPHE['']) + " END")}, ' ') AS tokenized
  FROM base)"""


@query("tokenize_corpus", TOKENIZED + " SELECT sent_id, tokenized FROM tokd")
def tokenize_corpus(spark, d):
    return C.sentences(spark, d).select("sent_id", T.tokenize(F.col("text"), F.col("lang")).alias("tokenized"))


@query("detokenize_corpus", TOKENIZED + f""",
undone AS (SELECT sent_id, lang, {_rule_sql('tokenized', T.DETOKENIZE)} AS u FROM tokd)
SELECT sent_id, trim(CASE lang WHEN 'fr' THEN {_rule_sql('u', [T.DETOKENIZE_APOSTROPHE['fr']])}
  WHEN 'en' THEN {_rule_sql('u', [T.DETOKENIZE_APOSTROPHE['en']])} ELSE u END) AS detokenized FROM undone""")
def detokenize_corpus(spark, d):
    s = C.sentences(spark, d).select("sent_id", "lang", T.tokenize(F.col("text"), F.col("lang")).alias("tokenized"))
    return s.select("sent_id", T.detokenize(F.col("tokenized"), F.col("lang")).alias("detokenized"))


@query("unpaste_pairs", f"""WITH {O.CAND}
SELECT sent_id, lang, src_text AS src, text AS tgt FROM cand""")
def unpaste_pairs(spark, d):
    from codemix.sources.lines import unpaste_lines

    src = C.sentences(spark, d).select("sent_id", F.col("text").alias("src"))
    tgt = C.candidates(spark, d).select("sent_id", "lang", "text")
    pasted = blocks.joined(src, tgt, "sent_id").select(
        "sent_id", "lang", T.paste(F.col("src"), F.col("text")).alias("text"))
    return unpaste_lines(pasted)


@query("filter_by_length", f"""WITH {O.PAIR_LENGTHS}
SELECT ex_id, src_len::INT AS src_len, tgt_len::INT AS tgt_len FROM lens WHERE src_len <= 200 AND tgt_len <= 180""")
def filter_by_length(spark, d):
    return clean.filter_by_length(C.pair_lengths(spark, d), 200, 180)


@query("lexicon_read", f"""WITH {O.SENT} {O.LEX}
SELECT src_lang, tgt_lang, word, translation, count(*) AS n FROM lex GROUP BY ALL""")
def lexicon_read(spark, d):
    """Writes dictionary files (blank- and tab-separated, some blank lines) and reads them back."""
    root = scratch_path(spark, "lexicon")
    lex = C.lexicon(spark, d)
    pairs = sorted(map(tuple, lex.select("src_lang", "tgt_lang").distinct().collect()))
    for src, tgt in pairs:
        part = lex.filter((F.col("src_lang") == src) & (F.col("tgt_lang") == tgt))
        sep = "\t" if tgt == "zz" else " "
        value = F.explode(F.array(F.concat("word", F.lit(sep), "translation"), F.lit(" ")))
        part.select(value.alias("value")).write.text(f"{root}/{src}-{tgt}.txt")
    sides = [sorted({p[k] for p in pairs}) for k in range(2)]
    return (lex_source.read_lexicon(spark, root, *sides)
            .groupBy("src_lang", "tgt_lang", "word", "translation").agg(F.count(F.lit(1)).alias("n")))


@query("lexicon_missing", f"""WITH {O.SENT} {O.LEX}
SELECT lang AS src_lang, tgt AS tgt_lang FROM (SELECT DISTINCT lang FROM sent), (VALUES ('xx'), ('yy'), ('zz')) t(tgt)
WHERE (lang, tgt) NOT IN (SELECT src_lang, tgt_lang FROM lex)""")
def lexicon_missing(spark, d):
    langs = [r["lang"] for r in C.sentences(spark, d).select("lang").distinct().collect()]
    return lex_source.missing_dictionaries(C.lexicon(spark, d), langs, list(C.TARGETS))


@query("lexicon_lookup", f"""WITH {O.SENT} {O.LEX}
SELECT t.lang, t.sent_id, g.tgt AS tgt_lang, count(*) AS n_tokens, count(e.word) AS n_found, coalesce(sum(len(trs)), 0)::BIGINT AS n_entries
FROM tok t CROSS JOIN (VALUES ('xx'), ('yy'), ('zz')) g(tgt)
LEFT JOIN entries e ON t.lang = e.src_lang AND e.tgt_lang = g.tgt AND t.w = e.word GROUP BY ALL""")
def lexicon_lookup(spark, d):
    targets = F.explode(F.array(*[F.lit(t) for t in C.TARGETS])).alias("tgt_lang")
    tokens = C.sentences(spark, d).select("sent_id", F.col("lang").alias("src_lang"), targets, "words")
    found = lexsub.lookup_lexicon(tokens, C.lexicon(spark, d), value=F.element_at("choices", -1)["upto"])
    return found.select("sent_id", "src_lang", "tgt_lang", lexsub.found_sums(F.col("found")).alias("s")).groupBy(
        "sent_id", F.col("src_lang").alias("lang"), "tgt_lang").agg(
        F.sum("s.n").alias("n_tokens"), F.sum("s.found").alias("n_found"), F.sum("s.total").alias("n_entries"))


def _substitute(spark, d, per):
    return lexsub.lex_substitute(C.sentences(spark, d), C.lexicon(spark, d),
                                 lexsub.LexiconOptions(ratio=0.9, per=per), entries=C.entries(spark, d))


SUB_ROWS = """ SELECT sent_id, lang, string_agg(coalesce(entry, w), ' ' ORDER BY i) AS switched,
  count(entry) AS n_hits FROM subs GROUP BY ALL"""


@query("lexicon_substitution_per_sentence", f"WITH {O.substituted('sentence', 0.9)} {SUB_ROWS}")
def lexicon_substitution_per_sentence(spark, d):
    return _substitute(spark, d, "sentence").select(
        "sent_id", "lang", "switched", F.size("hits").cast("bigint").alias("n_hits"))


@query("lexicon_substitution_per_word", f"WITH {O.substituted('word', 0.9)} {SUB_ROWS}")
def lexicon_substitution_per_word(spark, d):
    return _substitute(spark, d, "word").select(
        "sent_id", "lang", "switched", F.size("hits").cast("bigint").alias("n_hits"))


@query("lexicon_report", f"""WITH {O.substituted('word', 0.9)}
SELECT '*' AS lang, count(*) AS words FROM subs
UNION ALL SELECT tgt_lang, count(*) FROM subs WHERE entry IS NOT NULL GROUP BY tgt_lang""")
def lexicon_report(spark, d):
    return report.lex_stats(_substitute(spark, d, "word"))
