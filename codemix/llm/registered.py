"""The operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from codemix.llm import (
    ann, bpe_automaton, chat, html_main, langid, line_dedup, merkle, mixing, near_dedup, packing, phrases, topk,
    url_rules)



def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; the same on driver and executors."""
    folder = os.environ.get("CODEMIX_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_line_dedup", r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
common as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10),
judged as (select k.*, c.key is not null as gone from keyed k left join common c on c.key = k.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op2_html_main_text")
def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


RULES = [
    url_rules.Rule("org", "/", "allow"),
    url_rules.Rule("example.org", "/es/", "block"),
    url_rules.Rule("example.org", "/en/1", "block"),
    url_rules.Rule("com", "/fr/", "allow"),
    url_rules.Rule("com", "/de/", "block"),
]


@query("op3_url_rules", r"""
with parsed as (
  select page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ranked as (
  select d.*, r.h || r.p as rule, r.v,
         row_number() over (partition by page_id order by length(r.h || r.p) desc nulls last, r.h || r.p) as k
  from parsed d left join rules r
    on (d.host = r.h or d.host like '%.' || r.h) and starts_with(d.path, r.p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from ranked where k = 1
""")
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op4_mixing", f"""
with sizes as (select source, count(*) as n, sqrt(count(*)::double) as weight from documents group by source),
rates as (select source, (select sum(n) from sizes) / (select sum(weight) from sizes) * weight / n as rate from sizes),
steps as (
  select source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as step
  from (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as k from rates)),
drawn as (
  select *, (('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':0:copies'), 1, 8))::bigint + 0.5) / 4294967296.0 as at
  from documents),
counted as (
  select d.doc_id, d.source, md5(coalesce(d.text, '')) as text_md5,
         (select count(*) from steps s where s.source is not distinct from d.source and s.step <= d.at)::int as n_copies
  from drawn d),
dealt as (select *, unnest(range(1, n_copies + 1))::int as copy from counted)
select doc_id, source, text_md5, n_copies, copy,
       ('0x' || substr(md5('{mixing.SEED}:' || doc_id || ':' || copy || ':order'), 1, 8))::bigint as order_key
from dealt
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
                        "n_copies", "copy", "order_key")


@query("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(BPE))


@query("op9_chat_format", r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') as inside,
         replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') as head
  from turns)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|><|im_sep|><|im_end|>') + length(head) + length(inside))::bigint as formatted_chars
from marked group by conv_id
""")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = chat.format_chats(rows.unionByName(planted)).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("segments")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op10_top_products", """
with clean as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from clean q join clean c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5
""")
def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op11_bpe_round_trip")
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file(WORD_BPE)
    encoded = bpe_automaton.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe_automaton.decode(encoded.select("doc_id", "ids"), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_phrase_collocations", r"""
with pieces as (
  select row_number() over () as piece, lang, piece_text from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) as piece_text
    from documents)),
tokens as (
  select piece, lang, unnest(ws) as w, generate_subscripts(ws, 1) as i
  from (select piece, lang, list_filter(string_split_regex(piece_text, '[ \t]+'), lambda w: w <> '') as ws from pieces)),
near as materialized (
  select lang, w, lead(w, 1) over p as w2, lead(w, 2) over p as w3 from tokens window p as (partition by piece order by i)),
f1 as materialized (select lang, w, count(*) as f from near group by all),
f2 as materialized (select lang, w, w2, count(*) as f from near where w2 is not null group by all having count(*) >= 10),
f3 as materialized (select lang, w, w2, w3, count(*) as f from near where w3 is not null group by all having count(*) >= 10),
cuts as (
  select p.lang, p.w || ' ' || p.w2 as phrase, p.f as a, 1 as k, x.f as l, y.f as r
  from f2 p join f1 x using (lang, w) join f1 y on y.lang = p.lang and y.w = p.w2
  union all
  select p.lang, p.w || ' ' || p.w2 || ' ' || p.w3, p.f, 1, x.f, y.f
  from f3 p join f1 x using (lang, w) join f2 y on y.lang = p.lang and y.w = p.w2 and y.w2 = p.w3
  union all
  select p.lang, p.w || ' ' || p.w2 || ' ' || p.w3, p.f, 2, x.f, y.f
  from f3 p join f2 x using (lang, w, w2) join f1 y on y.lang = p.lang and y.w = p.w3),
scored as (
  select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from cuts),
best as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, k) as best from scored) where best = 1),
longer as (
  select lang, phrase, max(f) as f from (
    select lang, w || ' ' || w2 as phrase, f from f3 union all select lang, w2 || ' ' || w3, f from f3) group by all),
ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase where g.f is null or 100 * g.f < 50 * a)
select lang, rank, phrase, a, l, r, n, score::bigint as score
from ranked join (select lang, sum(f)::bigint as n from f1 group by lang) using (lang) where rank <= 2000
""")
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), support=10, longest=3, top=2000, covered=50)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEXT_SQL = f"translate(text, '{UPPER}', '{LOWER}')"


def _leaf_sql(text: str) -> str:
    sized = [f"coalesce(strlen({v}) || ':' || {v}, '-')"
             for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)]
    return f"sha256({' || '.join(sized)})"


@query("op13_merkle_manifest", f"""
with recursive checked as (
  select *, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [1::bigint, 1, 1, 1, 1, 1, 1, 1]),
      lambda x, one: case when x & one = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)) as crc
  from documents),
leaves as (
  select row_number() over () as row_id, doc_id, coalesce('=' || source, '-') as tree, {_leaf_sql('text')} as leaf,
    case when xor(crc, 4294967295::bigint) % 5 = 0 then {_leaf_sql(_TEXT_SQL)} else {_leaf_sql('text')} end as seen
  from checked),
placed as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by tree) as m from leaves),
nodes(level, tree, pos, m, hash) as (
  select 0, tree, pos, m, leaf from placed
  union all
  select level + 1, tree, pos // 16, (any_value(m) + 15) // 16, sha256(string_agg(hash, '' order by pos))
  from nodes where m > 1 group by level, tree, pos // 16),
subroots as materialized (
  select tree, hash as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as m
  from nodes where m = 1),
upper(level, pos, m, hash) as (
  select 0, pos, m, subroot from subroots
  union all
  select level + 1, pos // 16, (any_value(m) + 15) // 16, sha256(string_agg(hash, '' order by pos))
  from upper where m > 1 group by level, pos // 16),
walk(row_id, level, tree, pos, m, now, proof) as (
  select row_id, 0, tree, pos, m, seen, '' from placed
  union all
  select w.row_id, w.level + 1, w.tree, w.pos // 16, (w.m + 15) // 16,
    sha256(string_agg(case when n.pos = w.pos then w.now else n.hash end, '' order by n.pos)),
    w.proof || coalesce(string_agg(n.hash, '' order by n.pos) filter (n.pos <> w.pos), '')
  from walk w join nodes n on n.level = w.level and n.tree = w.tree and n.pos // 16 = w.pos // 16
  where w.m > 1 group by w.row_id, w.level, w.tree, w.pos, w.m, w.now, w.proof),
rest(row_id, level, pos, m, now, proof) as (
  select row_id, 0, s.pos, s.m, now, proof from walk join subroots s using (tree) where walk.m = 1
  union all
  select w.row_id, w.level + 1, w.pos // 16, (w.m + 15) // 16,
    sha256(string_agg(case when n.pos = w.pos then w.now else n.hash end, '' order by n.pos)),
    w.proof || coalesce(string_agg(n.hash, '' order by n.pos) filter (n.pos <> w.pos), '')
  from rest w join upper n on n.level = w.level and n.pos // 16 = w.pos // 16
  where w.m > 1 group by w.row_id, w.level, w.pos, w.m, w.now, w.proof)
select p.doc_id, p.leaf, s.subroot, u.hash as root, sha256(r.proof) as proof_sha256, r.now as folded_root,
  r.now = u.hash as verified
from placed p join subroots s using (tree) join rest r on r.row_id = p.row_id and r.m = 1
join upper u on u.m = 1
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    suspect = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in merkle.FIELDS]
    rows = merkle.manifest(docs, carry={"tampered": F.when(suspect, F.unhex(merkle.leaf(lowered)))})
    seen = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.fold(seen, F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
