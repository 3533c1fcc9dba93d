"""DuckDB statements of the derived corpora, shared by the oracle queries."""

BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK_CHARS = "||".join(f"chr({c})" for c in [
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}+'), lambda w: w <> '')"


def draw(seed, row_id, k, tag) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {seed}, {row_id}, {k}, {tag})), 1, 8))::BIGINT"


def uniform(seed, row_id, k, tag) -> str:
    return f"(({draw(seed, row_id, k, tag)} + 0.5) / 4294967296.0::DOUBLE)"


SENT = rf"""
raw_lines AS (
  SELECT doc_id, lang, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, lang, string_split_regex(text, '\r\n|\r|\n') AS parts FROM documents)),
sent AS MATERIALIZED (
  SELECT doc_id * 10000000 + pos AS sent_id, lang, words, len(words) AS n, array_to_string(words, ' ') AS text
  FROM (SELECT doc_id, lang, pos, {words('line')} AS words FROM raw_lines) WHERE len(words) > 0),
tok AS MATERIALIZED (
  SELECT sent_id, lang, n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM sent)"""

CAND = SENT + rf""",
targets(lang_idx, tgt) AS (VALUES (0, 'xx'), (1, 'yy'), (2, 'zz')),
hashed AS (
  SELECT sent_id, lang_idx, tgt, i, w, md5(concat_ws(':', 0, sent_id, i, tgt)) AS h FROM tok, targets),
kept AS MATERIALIZED (
  SELECT sent_id, lang_idx, tgt, i, w || '_' || tgt AS tw, substr(h, 17, 2) < '25' AS joined, substr(h, 25, 2) < '14' AS gapped,
    row_number() OVER (PARTITION BY sent_id, tgt ORDER BY i // 2, substr(h, 9, 8), i) - 1 AS j
  FROM hashed WHERE substr(h, 1, 2) >= '1a'),
raw_edges AS (
  SELECT sent_id, tgt, i AS s, j AS t FROM kept
  UNION ALL SELECT sent_id, tgt, i - 1, j FROM kept WHERE joined AND i >= 1
  UNION ALL SELECT sent_id, tgt, i - 2, j FROM kept WHERE gapped AND i >= 2),
bads AS (
  SELECT sent_id, lang_idx, tgt, n, text AS src_text, {draw(0, 'sent_id', 0, "'bad:' || tgt")} % 30 AS bad
  FROM sent, targets),
ktext AS (
  SELECT sent_id, tgt, string_agg(tw, ' ' ORDER BY j) AS txt,
    string_agg(tw, ' ' ORDER BY j) FILTER (WHERE j < (m + 2) // 3) AS txt3, any_value(m) AS m
  FROM (SELECT *, count(*) OVER (PARTITION BY sent_id, tgt) AS m FROM kept) GROUP BY ALL),
etext AS (
  SELECT e.sent_id, e.tgt, string_agg(s || '-' || t, ' ' ORDER BY s, t) AS al,
    string_agg(s || '-' || t, ' ' ORDER BY s, t) FILTER (WHERE t < (m + 2) // 3) AS al3
  FROM raw_edges e JOIN ktext k ON e.sent_id = k.sent_id AND e.tgt = k.tgt GROUP BY ALL),
cand AS MATERIALIZED (
  SELECT b.sent_id, b.lang_idx, b.tgt AS lang, n, src_text,
    coalesce(CASE bad WHEN 0 THEN txt3 WHEN 2 THEN src_text ELSE txt END, '') AS text,
    coalesce(CASE bad WHEN 0 THEN al3 WHEN 1 THEN '' WHEN 3 THEN concat_ws(' ', al, n || '-0') ELSE al END, '') AS alignment
  FROM bads b LEFT JOIN ktext k ON b.sent_id = k.sent_id AND b.tgt = k.tgt
  LEFT JOIN etext e ON b.sent_id = e.sent_id AND b.tgt = e.tgt)"""

VALID = CAND + rf""",
valid AS MATERIALIZED (
  SELECT *, len(tw) AS m FROM (SELECT *, {words('text')} AS tw FROM cand)
  WHERE trim(alignment) <> '' AND len(tw) > 0 AND text <> src_text
    AND least(n / len(tw), len(tw) / n) >= 0.6)"""


def phrases(source: str = "valid") -> str:
    """Connected components of the alignments of ``source`` (sent_id, lang, n, m, alignment)."""
    return rf"""
ve AS MATERIALIZED (
  SELECT DISTINCT sent_id, lang, split_part(e, '-', 1)::INT AS s, split_part(e, '-', 2)::INT AS t
  FROM (SELECT sent_id, lang, n, m, unnest(string_split(alignment, ' ')) AS e FROM {source})
  WHERE split_part(e, '-', 1)::INT < n AND split_part(e, '-', 2)::INT < m),
link AS MATERIALIZED (
  SELECT DISTINCT a.sent_id, a.lang, a.s AS x, b.s AS y FROM ve a JOIN ve b
    ON a.sent_id = b.sent_id AND a.lang = b.lang AND a.t = b.t AND a.s <> b.s),
reach(sent_id, lang, x, y) AS (
  SELECT sent_id, lang, x, y FROM link
  UNION SELECT r.sent_id, r.lang, r.x, l.y FROM reach r JOIN link l
    ON r.sent_id = l.sent_id AND r.lang = l.lang AND r.y = l.x),
low AS (SELECT sent_id, lang, x, min(y) AS y FROM reach GROUP BY ALL),
lab AS MATERIALIZED (
  SELECT e.sent_id, e.lang, e.s, least(e.s, coalesce(l.y, e.s)) AS lab
  FROM (SELECT DISTINCT sent_id, lang, s FROM ve) e
  LEFT JOIN low l ON e.sent_id = l.sent_id AND e.lang = l.lang AND e.s = l.x),
phr AS MATERIALIZED (
  SELECT a.sent_id, a.lang, a.lab, a.ss, a.alpha, a.closed, b.ts FROM (
    SELECT l.sent_id, l.lang, l.lab, list(l.s ORDER BY l.s) AS ss,
      bool_or(regexp_full_match(w, '\p{{L}}+')) AS alpha,
      bool_or(regexp_full_match(w, '\p{{Nd}}+') OR regexp_full_match(w, '[^\p{{L}}\p{{Nd}}]+')) AS closed
    FROM lab l JOIN tok k ON l.sent_id = k.sent_id AND l.s = k.i GROUP BY ALL) a
  JOIN (
    SELECT sent_id, lang, lab, list(t ORDER BY t) AS ts FROM (
      SELECT DISTINCT e.sent_id, e.lang, lab, t FROM ve e JOIN lab l
        ON e.sent_id = l.sent_id AND e.lang = l.lang AND e.s = l.s) GROUP BY ALL) b
    ON a.sent_id = b.sent_id AND a.lang = b.lang AND a.lab = b.lab
  WHERE alpha)"""


PICKED = f"""
chosen AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY lang_idx) - 1 AS k,
      count(*) OVER (PARTITION BY sent_id) AS c FROM valid)
  WHERE k = {draw(0, 'sent_id', 0, "'lang'")} % c)"""

PICKS_SINGLE = f"""
picks AS MATERIALIZED (
  SELECT * FROM (
    SELECT p.*, c.n, c.tw, coalesce(sum(len(ss)) OVER (PARTITION BY p.sent_id
      ORDER BY {draw(0, 'p.sent_id', 'lab', "'phrase:' || p.lang")} >> 1, lab
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM phr p JOIN chosen c ON p.sent_id = c.sent_id AND p.lang = c.lang WHERE NOT closed)
  WHERE before / n <= 0.75)"""

REBUILT = """
pieces AS (
  SELECT sent_id, array_to_string(list_concat(
      src[coalesce(lag(ss[-1]) OVER w, -1) + 2 : ss[1]],
      list_transform(ts, lambda j: tw[j + 1])), ' ') AS piece, ss, row_number() OVER w AS o
  FROM (SELECT p.*, s.words AS src FROM picks p JOIN sent s ON p.sent_id = s.sent_id)
  WINDOW w AS (PARTITION BY sent_id ORDER BY ss)),
joined AS (
  SELECT sent_id, string_agg(piece, ' ' ORDER BY o) AS body, arg_max(ss[-1], o) AS last
  FROM pieces GROUP BY sent_id),
switched AS MATERIALIZED (
  SELECT s.sent_id, s.lang, s.n, s.text,
    CASE WHEN body IS NULL THEN s.text
      ELSE concat_ws(' ', body, nullif(array_to_string(s.words[last + 2 :], ' '), '')) END AS switched
  FROM sent s LEFT JOIN joined j ON s.sent_id = j.sent_id
  WHERE s.sent_id IN (SELECT sent_id FROM valid))"""

LEX = f""",
lexw AS (SELECT DISTINCT lang, w FROM tok),
rolled AS (
  SELECT lang AS src_lang, w AS word, tgt AS tgt_lang, {draw(0, "concat_ws(':', lang, w)", 'tgt', "'lex'")} AS d
  FROM lexw, (VALUES ('xx'), ('yy'), ('zz')) t(tgt) WHERE NOT (lang = 'es' AND tgt = 'zz')),
lex AS MATERIALIZED (
  SELECT src_lang, tgt_lang, word, concat(word, '_', tgt_lang, r) AS translation
  FROM rolled, (VALUES (1), (2), (3)) v(r) WHERE r <= 1 + d % 3
  UNION ALL SELECT src_lang, tgt_lang, word, concat(word, '_', tgt_lang, 1) FROM rolled WHERE d % 5 = 0),
dict_langs AS (SELECT src_lang, list(DISTINCT tgt_lang ORDER BY tgt_lang) AS tl FROM lex GROUP BY src_lang),
entries AS MATERIALIZED (
  SELECT src_lang, tgt_lang, word, list(translation ORDER BY translation) AS trs FROM lex GROUP BY ALL)"""


def substituted(per: str, ratio: float) -> str:
    word = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    lang = draw(0, "sent_id", 0, "'lang'") if per == "sentence" else word(0)
    return SENT + LEX + f""",
hashed AS (SELECT *, md5(concat_ws(':', 0, sent_id, i, 'lex')) AS h FROM tok),
drawn AS (
  SELECT t.*, tl[1 + {lang} % len(tl)] AS tgt_lang
  FROM hashed t JOIN dict_langs g ON t.lang = g.src_lang),
subs AS MATERIALIZED (
  SELECT d.sent_id, d.lang, d.i, d.w, d.tgt_lang,
    CASE WHEN ({word(2)} + 0.5) / 4294967296.0::DOUBLE <= {ratio} THEN trs[1 + {word(1)} % len(trs)] END AS entry
  FROM drawn d LEFT JOIN entries e ON d.lang = e.src_lang AND d.tgt_lang = e.tgt_lang AND d.w = e.word)"""


LINES = SENT + """,
lines AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sent_id) - 1 AS line_no,
    count(*) OVER (PARTITION BY lang) AS n_lines FROM sent)"""

PAIR_LENGTHS = CAND + f""",
lens AS MATERIALIZED (
  SELECT sent_id * 3 + lang_idx AS ex_id, n + 1 AS src_len, len({words('text')}) + 1 AS tgt_len FROM cand)"""

REFHYP = SENT + f""",
refhyp AS MATERIALIZED (
  SELECT s.sent_id, s.lang AS grp, s.text AS ref, coalesce(h.hyp, '') AS hyp FROM sent s LEFT JOIN (
    SELECT sent_id, string_agg(w, ' ' ORDER BY i) AS hyp FROM tok
    WHERE {draw(0, 'sent_id', 'i', "'H'")} % 8 <> 0 GROUP BY sent_id) h ON s.sent_id = h.sent_id)"""

VECPAIR = """
emb AS (SELECT vec_id // 2 AS k, vec_id % 2 AS side, embedding::DOUBLE[] AS v FROM embeddings),
vp AS MATERIALIZED (
  SELECT a.k // 16 AS batch_id, a.k % 16 AS pos, a.v AS a, c.v AS c FROM emb a JOIN emb c
    ON a.k = c.k AND a.side = 0 AND c.side = 1)"""
