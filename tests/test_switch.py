"""Phrase extraction and code-switching: hand cases, brute force, properties."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codemix.functions.text import words
from codemix.operators import align
from codemix.operators.switch import CANDIDATE, SwitchOptions, code_switch, rebuild_words, switch_picks

PICKS = "array<struct<s:array<int>,lang_idx:int,lang:string,tw:array<string>>>"


def draw(seed, row_id, k, tag):
    return int(hashlib.md5(f"{seed}:{row_id}:{k}:{tag}".encode()).hexdigest()[:8], 16)


def phrases_of(source, alignment, n_tgt, one_to_one=False, contiguous=False):
    """Brute force: merge edges that share an end until nothing changes."""
    groups = []
    for e in alignment.split():
        s, t = map(int, e.split("-"))
        if s < len(source) and t < n_tgt:
            groups.append(({s}, {t}))
    merged = True
    while merged:
        merged = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if groups[i][0] & groups[j][0] or groups[i][1] & groups[j][1]:
                    groups[i] = (groups[i][0] | groups[j][0], groups[i][1] | groups[j][1])
                    del groups[j]
                    merged = True
                    break
            if merged:
                break
    out = sorted((sorted(s), sorted(t)) for s, t in groups)
    out = [p for p in out if any(source[i].isalpha() for i in p[0])]
    if one_to_one:
        out = [p for p in out if len(p[0]) == len(p[1]) == 1]
    if contiguous:
        out = [p for p in out if p[0][-1] - p[0][0] + 1 == len(p[0])]
    return out


def switch_of(row_id, source, cands, ratio, single, seed=0):
    """Brute force: (language, text, alignment) candidates -> switched sentence or None."""
    n = len(source)
    ok = []
    for k, (lang, text, al) in enumerate(cands):
        tw = text.split()
        if al.strip() and tw and min(n / len(tw), len(tw) / n) >= 0.6 and tw != source:
            ok.append((lang, tw, al))
    if not ok:
        return None
    if single:
        ok = [ok[draw(seed, row_id, 0, "lang") % len(ok)]]
    closed = {i for i, w in enumerate(source) if w.isdigit() or not any(c.isalnum() for c in w)}
    queues = []
    for lang, tw, al in ok:
        keyed = [(draw(seed, row_id, p[0][0], f"phrase:{lang}") >> 1, k, p)
                 for k, p in enumerate(phrases_of(source, al, len(tw))) if not closed & set(p[0])]
        queues.append([(p, tw) for _, _, p in sorted(keyed)])
    used, total, picks, step = set(), 0, [], 0
    while total / n <= ratio:
        c = 0 if single else draw(seed, row_id, step, "step") % len(ok)
        while queues[c] and used & set(queues[c][0][0][0]):
            queues[c].pop(0)
        if not queues[c]:
            break
        (s, t), tw = queues[c].pop(0)
        used |= set(s)
        total += len(s)
        picks.append((s, [tw[j] for j in t]))
        step += 1
    out, prev = [], 0
    for s, tw in sorted(picks):
        out += source[prev:s[0]] + tw
        prev = s[-1] + 1
    return " ".join(out + source[prev:])


def extract(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id int, text string, alignment string, n_tgt int")
    got = align.phrases(df.withColumn("words", words(F.col("text"))), **kw).select("id", "phrases").collect()
    return {r["id"]: [(list(p["s"]), list(p["t"])) for p in r["phrases"]] for r in got}


def test_phrase_hand_cases(spark):
    rows = [
        (0, "a b c", "0-0 1-0 2-1", 2),            # many to one
        (1, "a b c d", "0-0 2-0 3-1", 2),          # gap
        (2, "12 ... x", "0-0 1-1 2-2", 3),         # digits and symbols carry no letters
        (3, "3a 4b", "0-0 1-1", 2),                # no all-letter word
        (4, "a b", "", 2),
        (5, "a b", "0-0 x 1-9 7-1 1-1 1-1", 2),    # malformed, out of range, repeated
        (6, "a", None, 1),
    ]
    got = extract(spark, rows)
    assert got[0] == [([0, 1], [0]), ([2], [1])]
    assert got[1] == [([0, 2], [0]), ([3], [1])]
    assert got[2] == [([2], [2])]
    assert got[3] == [] and got[4] == [] and got[6] == []
    assert got[5] == [([0], [0]), ([1], [1])]
    assert extract(spark, rows, one_to_one=True)[0] == [([2], [1])]
    assert extract(spark, rows, contiguous_only=True)[1] == [([3], [1])]


def random_case(rng, row_id, k=3):
    n = rng.randint(1, 14)
    source = [rng.choice(["a", "bb", "ccc", "7", "...", "x1", "d"]) for _ in range(n)]
    cands = []
    for c in range(k):
        m = rng.randint(1, 16)
        al = " ".join(f"{rng.randrange(n + 1)}-{rng.randrange(m + 1)}" for _ in range(rng.randint(0, 14)))
        cands.append((f"l{c}", " ".join(f"t{c}{j}" for j in range(m)), al))
    return row_id, source, cands


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    return [random_case(rng, i) for i in range(600)]


def test_phrases_against_brute_force(spark, cases):
    rows = [(i, " ".join(s), c[0][2], len(c[0][1].split())) for i, s, c in cases]
    for kw in ({}, {"one_to_one": True}, {"contiguous_only": True}):
        got = extract(spark, rows, **kw)
        for i, s, c in cases:
            want = phrases_of(s, c[0][2], len(c[0][1].split()), kw.get("one_to_one"), kw.get("contiguous_only"))
            assert got[i] == want, (s, c[0])


def test_long_chain_is_one_phrase(spark):
    n = 20000
    edges = [(i, i) for i in range(n)] + [(i + 1, i) for i in range(n - 1)]
    random.Random(1).shuffle(edges)
    got = extract(spark, [(0, " ".join(["a"] * n), " ".join(f"{s}-{t}" for s, t in edges), n)])
    assert got[0] == [(list(range(n)), list(range(n)))]


def frames(spark, cases):
    src = spark.createDataFrame([(i, " ".join(s)) for i, s, _ in cases], "sent_id bigint, text string")
    cands = spark.createDataFrame(
        [(i, k, *c) for i, _, cs in cases for k, c in enumerate(cs)],
        "sent_id bigint, lang_idx int, lang string, text string, alignment string")
    return src, cands


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("ratio", [0.3, 0.75, 1.0])
def test_switch_against_brute_force(spark, cases, single, ratio):
    src, cands = frames(spark, cases)
    opts = SwitchOptions(ratio=ratio, single_language=single)
    got = {r["sent_id"]: r["switched"] for r in code_switch(src, cands, None, opts).collect()}
    want = {i: switch_of(i, s, c, ratio, single) for i, s, c in cases}
    assert got == {i: v for i, v in want.items() if v is not None}


def test_switch_ignores_partitioning_and_keeps_the_reference(spark, cases):
    src, cands = frames(spark, cases)
    ref = src.select("sent_id", F.concat(F.lit("ref "), "text").alias("ref"))
    run = lambda p: sorted(map(tuple, code_switch(src.repartition(p), cands.repartition(p + 2), ref, SwitchOptions())
                               .select("sent_id", "switched", "ref").collect()))
    one = run(1)
    assert one == run(7)
    texts = {i: " ".join(s) for i, s, _ in cases}
    assert all(r[2] == "ref " + texts[r[0]] for r in one)


def test_negative_ratio_returns_the_source(spark, cases):
    src, cands = frames(spark, cases)
    done = code_switch(src, cands, None, SwitchOptions(ratio=-1.0)).filter("switched <> text").count()
    assert done == 0


def test_rebuild_gap_and_inner_pick(spark):
    pick = lambda s, tw: (s, 0, "l", tw)
    rows = [
        (0, "a b c d".split(), [pick([0, 2], ["T0"])]),                       # b is lost
        (1, "a b c d".split(), [pick([1], ["T2"]), pick([0, 2], ["T0"])]),    # the cursor moves back
        (2, "a b".split(), []),
    ]
    df = spark.createDataFrame(rows, f"id int, words array<string>, picks {PICKS}")
    got = {r["id"]: r["x"] for r in df.select("id", F.array_join(
        rebuild_words(F.col("words"), F.col("picks")), " ").alias("x")).collect()}
    assert got == {0: "T0 d", 1: "T0 T2 c d", 2: "a b"}


def test_overshoot_by_one_phrase(spark):
    src, cands = frames(spark, [(0, "a b c d".split(), [("l0", "p q r s", "0-0 1-0 1-1 2-2 3-2 3-3")])])
    got = switch_picks(assembled(src, cands), SwitchOptions(ratio=0.5, single_language=True)).first()
    assert len(got["picks"]) == 2  # at exactly the ratio another pick is allowed


def assembled(src, cands):
    from codemix.operators.switch import assemble_candidates

    return assemble_candidates(src, cands)


def test_options_of_validity(spark):
    src, cands = frames(spark, [
        (0, "a b".split(), [("l0", "a b", "0-0 1-1")]),              # copy
        (1, list("abcdefghij"), [("l0", "p q r s t", "0-0")]),       # 5 / 10 < 0.6
        (2, "a b".split(), [("l0", "p q", "  ")]),                   # no alignment
    ])
    ids = lambda **kw: {r["sent_id"] for r in code_switch(src, cands, None, SwitchOptions(**kw)).collect()}
    assert ids() == set()
    assert ids(copy_check=False) == {0}
    assert ids(min_ratio=0.5) == {1}


def test_stream_equals_batch(spark, cases, tmp_path):
    from codemix.streaming.switch_stream import read_assembled, switch_stream

    src, cands = frames(spark, cases)
    rows = assembled(src, cands).withColumn("ref", F.lit("r")).select("sent_id", "text", "cands", "ref")
    assert rows.schema["cands"].dataType.simpleString() == CANDIDATE
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    opts = SwitchOptions(ratio=0.75)
    switch_stream(read_assembled(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"),
                  opts).awaitTermination()
    got = {r["sent_id"]: r["switched"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["sent_id"]: r["switched"] for r in code_switch(src, cands, None, opts).collect()}
    assert got == want and got


def test_phrases_in_small_slices(spark, cases, monkeypatch):
    import pyarrow as pa

    from codemix.operators import components

    als = pa.array([[c[0] and c[2] for c in cs] for _, _, cs in cases] + [[]], pa.list_(pa.string()))
    n_tgt = pa.array([[len(c[1].split()) for c in cs] for _, _, cs in cases] + [[]], pa.list_(pa.int32()))
    alpha = pa.array([[w.isalpha() for w in s] for _, s, _ in cases] + [[True]], pa.list_(pa.bool_()))
    run = components.phrase_udf().func
    whole = run(als, n_tgt, alpha)
    monkeypatch.setattr(components, "MAX_BYTES", 100)
    assert run(als, n_tgt, alpha).equals(whole)
    assert len(list(components._slices(als))) > 10


def test_many_candidates_and_a_long_line(spark):
    """300 candidates of one sentence, and a line of 100,000 words."""
    n = 100_000
    rows = [(1, " ".join(f"w{chr(97 + i % 26)}" for i in range(40))), (2, " ".join(["word", "line"] * (n // 2)))]
    src = spark.createDataFrame(rows, "sent_id bigint, text string")
    cands = [(1, k, f"l{k}", " ".join(f"x{k}" for _ in range(40)), " ".join(f"{i}-{i}" for i in range(40))) for k in range(300)]
    cands += [(2, k, f"l{k}", " ".join([f"y{k}"] * n), " ".join(f"{i}-{i}" for i in range(n))) for k in range(2)]
    cand = spark.createDataFrame(cands, "sent_id bigint, lang_idx int, lang string, text string, alignment string")
    got = {r["sent_id"]: r["switched"].split() for r in code_switch(src, cand, opts=SwitchOptions(ratio=0.5)).collect()}
    assert len(got[1]) == 40 and 20 <= sum(w.startswith("x") for w in got[1]) <= 21
    assert len({w for w in got[1] if w.startswith("x")}) > 10
    assert len(got[2]) == n and n // 2 <= sum(w.startswith("y") for w in got[2]) <= n // 2 + 1
