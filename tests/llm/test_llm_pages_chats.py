"""HTML extraction, URL rules and chat formatting, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from codemix.llm import chat, html_main, url_rules
from codemix.llm.registered import RULES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><div id="cookie-notice">We use cookies on this site, agree please.</div>
<ul class="menu"><li><a href=x>Home</a><li><a>News</a></ul><div id=content><h1>Title here</h1>
<p>First para of\n the  story, long enough &amp; good.<p>Short.<div class="ad">Buy now, it is very cheap today!</div>
<p>Second <b>bold<br>para &eacute; goes on</b> with many words in it.</p><table><tr><td>Cell one<td>Cell two of the table.</table>
<div class=comments><p>I liked this article a lot, thank you very much for it.</p></div></div>
<form>Name <input><button>Send</button></form><aside>Also see this</aside><!-- no <p>text --><footer>&copy; 2020</footer>"""


# --- html ---

def test_main_text_leaves_the_rest_out():
    assert html_main.main_text(PAGE) == (
        "Title here First para of the story, long enough & good. Short. Second bold para é goes on with many words in it. "
        "Cell one Cell two of the table.")


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<p>a&lt;3 &#233; &am", "a<3 é &am"), ("<article><p>cut off <b", "cut off"),
    ("<article>no tags &amp", "no tags &"), ("<ARTICLE><P>One<P>Two</ARTICLE>", "One Two"),
    ("<article><p>x</p><script>if (a<b) '</p>'</script><p>y</p></article>", "x y"),
    ("<article><p hidden>gone<p>here<p style='display: none'>gone</article>", "here"),
    ("<article></b></p>stray</div> ends</article>", "stray ends"), ("<nav>only menu</nav>", ""),
])
def test_small_pages(page, text):
    assert html_main.main_text(page) == text


def test_cut_is_the_minimum():
    """Against all labellings of small random pages."""
    rng = random.Random(1)
    shapes = ["<p>{}</p>", "<li><a>{}</a></li>", "<div class=ad>{}</div>", "<section><p>{}</p></section>", "<td>{}</td>"]
    for _ in range(40):
        page = "".join(rng.choice(shapes).format(" ".join(["word"] * rng.randint(1, 25))) for _ in range(rng.randint(1, 7)))
        blocks = html_main.blocks_of(f"<div id=content>{page}</div>")
        n, graph = html_main._edges(blocks)
        odds = [html_main.odds(b) for b in blocks] + [0.0] * (n - len(blocks))

        def cost(side, n=n, graph=graph, odds=odds):
            ends = sum(max(odds[i], 0) if not side[i] else max(-odds[i], 0) for i in range(n))
            return ends + sum(w for a in range(n) for b, w in graph[a].items() if a < b and side[a] != side[b])

        least = {}
        for side in itertools.product((False, True), repeat=n):
            key = side[:len(blocks)]
            least[key] = min(least.get(key, 1e9), cost(side))
        assert least[tuple(html_main.content(blocks))] <= min(least.values()) + 1e-9


def test_long_page_and_columns(spark):
    long = "<article>" + "<p>A paragraph of the article, <i>number</i> one.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, 5), (2, None, None, 5), (2, None, None, 5)],
                               "page_id bigint, url string, html string, n_chars int")
    got = html_main.extract(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    rows = sorted((r.page_id, r.n_chars, len(r.text)) for r in got.collect())
    size = len("A paragraph of the article, number one.") * 20_000 + 19_999
    assert rows == [(1, size, size), (2, 0, 0), (2, 0, 0)]
    assert html_main.extract(df.limit(0)).collect() == []


# --- url rules ---

def plain_verdict(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.name), r.name, r.verdict != "block"), default=None)
    return host, path, best and best.name, best.verdict if best else otherwise


def test_rules_are_brute_force(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme/org/", "http://", "://org/", "http://ORG/", "http://org", "http://a.org?x/", "x://b.example.ORG/es/1",
            "http://example.org/en/12#/es/", "http://notexample.org/es/", "http://x.com/fr/a?b", "http://x.com/de/", "http://com/de",
            "a://b://c.org/", "http://a.org/\nx", "http://example.org./es/", "http://É.org/É", "http://u:p@example.org:80/es/"]
    urls += ["http://" + ".".join(rng.choices(["a", "example", "org", "com", "x"], k=rng.randint(1, 4))) + "/"
             + "/".join(rng.choices(["en", "es", "fr", "de", "1", "12"], k=rng.randint(0, 3))) for _ in range(300)]
    more = RULES + [url_rules.Rule("x.org", "/", "block"), url_rules.Rule("x.org", "/", "allow"), url_rules.Rule("a.b", "/en/", "block"),
                    url_rules.Rule("x.com", "/fr", "block"), url_rules.Rule("e.org", "/es/1", "allow")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    for rules in (RULES, more, []):
        got = url_rules.judge(df, rules)
        assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        for r in got.collect():
            assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], rules), urls[r.page_id]
    assert url_rules.judge(df.limit(0), RULES).collect() == []


def test_rules_are_filed_under_their_rarest_token(spark):
    hosts = spark.createDataFrame([("a.com", "/x/1")] * 5 + [("b.org", "/x/y")], "host string, path string")
    rules = [url_rules.Rule("com", "/x/", "block"), url_rules.Rule("org", "/x/y", "block")]
    index = url_rules.rarest_tokens(hosts, rules)
    assert {t: [r.name for r in found] for t, found in index.items()} == {".com": ["com/x/"], ".org": ["org/x/y"]}


# --- chats ---

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "\\<|im_sep|>\\", "<<|im_start|>|>", "", None, "é\n\U0001f600 <|", "\\\\|<\\", "$1 \\E"]


def test_chats_are_read_back(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "<|x", "a\nb"]), rng.choice(NASTY), "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segments string")
    got = chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("segments"))).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in r.read] == own and r.n_turns == len(own)
        assert r.learned == "".join(t for role, t in own if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted


def test_machine_and_edges(spark):
    def state(*roles):
        df = spark.createDataFrame([(1, i, role, "t") for i, role in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
        row = chat.format_chats(df).first()
        return row.state, row.valid, row.n_turns

    assert state("system", "user", "assistant") == ("answered", True, 3)
    assert state("user", "assistant", "user") == ("asked", True, 3)
    assert state("user", "user", "assistant") == ("error", False, 3)
    assert state("assistant") == ("error", False, 1)
    assert state("user", None) == ("error", False, 2)
    shape = "conv_id bigint, turn bigint, role string, text string"
    assert chat.format_chats(spark.createDataFrame([], shape)).collect() == []
    ties = [(None, None, None, None), (None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a")]
    row = chat.format_chats(spark.createDataFrame(ties, shape)).first()
    assert [s.text for s in row.segments[1::3]] == ["", "a", "a", "b"] and row.conv_id is None
    with pytest.raises(ValueError):
        chat.Template(turn="[INST]")


def test_long_conversation(spark):
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise(
        "assistant").alias("role"), F.concat(F.lit("text <| "), F.col("id")).alias("text"))
    row = chat.format_chats(df).select("state", "n_turns", F.sha2(chat.learned_text(F.col("segments")), 256).alias("sha")).first()
    said = "".join(f"text <| {i}" for i in range(1, 20_000, 2))
    assert (row.state, row.n_turns, row.sha) == ("answered", 20_000, hashlib.sha256(said.encode()).hexdigest())


def test_chat_plan_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.format_chats(df.select("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
