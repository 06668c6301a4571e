"""Prefix trie, whitening and page extraction against plain versions, with odd and empty tables."""

import html
import random
import re

import brute
import numpy as np
import pytest
from blotter.llm import html_extract, prefix_trie, whitening
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string"


def trie_rows(df, **options):
    return sorted(tuple(r) for r in prefix_trie.conversation_trie(df, **options).collect())


def odd_turns():
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["x", "yé", "z" * 40, None, ""]))
            for c in range(-6, 60) for t in range(r.choice([1, 2, 3, 9, 16, 33]))]
    chain = [(1000 + 5 * i, t, "u", "same") for i in range(12) for t in range(9, 10 + i)]  # each a prefix of the next
    ties = [(7, None, None, None), (7, 1, "b", "x"), (7, 1, "a", "y"), (7, 1, "a", "x"), (7, 1, "a", "x"), (None, 1, "a", "lost")]
    return rows + chain + ties


@pytest.mark.parametrize("batches", [(1,), (8, 1), (16, 4, 2, 1)])
def test_trie_equals_brute_force(spark, batches):
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURN).selectExpr("*", "1 as depth", "'x' as path", "2 as id", "3 as n", "'t' as turns")
    assert trie_rows(df, batches=batches) == brute.prefix_trie(rows)


def test_trie_of_hot_prefix_and_copies(spark):
    """A third of all conversations is one text; their ids are hashed in pieces."""
    rows = [(c, 0, "user", "hot" if c % 3 else f"own {c % 50}") for c in range(3000)] + [(c, 1, "assistant", f"{c % 7}") for c in range(1500)]
    assert trie_rows(spark.createDataFrame(rows, TURN).repartition(16)) == brute.prefix_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], TURN)) == []
    assert trie_rows(spark.createDataFrame([(None, 0, "a", "b")], TURN)) == []


def test_two_fattest(spark):
    cases = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(cases, "a int, b int").select("a", "b", prefix_trie._fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for r in got:
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


# ---------------------------------------------------------------- whitening

EMBEDDING = "vec_id long, embedding array<float>"


def whitened(df):
    return sorted((tuple(r) for r in whitening.whiten(df).collect()), key=repr)


def check_whitening(df, rows):
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    k = min(8, x.shape[1])
    assert len(got) == n * k
    for c in range(k):
        want = centred @ u[:, c] / np.sqrt(e[c])
        mine = np.array([got[i, c + 1].whitened for i, _ in rows])
        assert min(abs(mine - want).max(), abs(mine + want).max()) < 1e-6
    for j, (i, _) in enumerate(rows):
        r = got[i, 1]
        assert (r.n, r.deviation) == (n, int(((n * x[j] - s) ** 2).sum()))
        assert abs(r.explained - e[0] / e.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_equals_numpy(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    odd = [(10_000, None), (10_001, [None] * 64), (10_002, [float("nan")] + [0.0] * 63), (10_003, [float("inf")] * 64), (10_004, [0.1] * 63), (10_005, [])]
    for block in (1024, 16):  # several row blocks and column blocks
        monkeypatch.setattr(whitening, "BLOCK", block)
        check_whitening(df.select("vec_id", "embedding").unionByName(spark.createDataFrame(odd, EMBEDDING)).selectExpr("*", "1 as index", "2 as x", "3 as n"), rows)


def test_whitening_odd_tables(spark):
    assert whitened(spark.createDataFrame([], EMBEDDING)) == []
    assert whitened(spark.createDataFrame([(1, None)], EMBEDDING)) == []
    one = whitened(spark.createDataFrame([(1, [0.5, 2.0])], EMBEDDING))
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in one] == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None)]
    flat = whitened(spark.createDataFrame([(1, [0.5, 2.0]), (None, [0.5, 3.0]), (1, [0.5, 3.0])], EMBEDDING))  # one coordinate is constant
    assert [r[4] is None for r in flat] == [r[1] == 2 for r in flat] and flat[0][6] < 1e-12
    huge = whitened(spark.createDataFrame([(1, [1e30, 1.0]), (2, [-1e30, 2.0])], EMBEDDING))
    assert len(huge) == 4 and huge[0][3] is None


# ---------------------------------------------------------------- pages

PAGE = "page_id long, url string, html string"


def plain_article(source):
    """The article of a test page: its headings and paragraphs."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = [" ".join(html.unescape(p.replace("<br>", " ").replace("<b>", "")).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_pages_of_the_test_table(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(df.selectExpr("*", "'x' as host", "1 as k1", "'y' as text", "2 as marked")).collect()}
    for r in df.collect():
        assert got[r.page_id].text == plain_article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_templates_are_counted_per_host(spark):
    """Without rules by kind and without an article: what recurs on a host goes, what recurs elsewhere or by copying stays."""
    def page(i, host):
        box = f"<div>box of {host}</div><section><ul><li><a href='/{i}'>one</a></li><li>two</li></ul></section>"
        return (i, f"http://{host}/p{i}", f"<body>{box}<div><h1>Title {i}</h1><p>text {i} of the page<p>The end.</div><i>shared line</i></body>")

    rows = [page(i, "a.org" if i < 30 else "b.org") for i in range(60)] + [page(100, "c.org")]
    rows += [(200 + i, "http://a.org/copy", rows[0][2]) for i in range(50)]  # copies of a page make no template
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, PAGE), rules=False).collect()}
    for i in [*range(60), *range(200, 250)]:
        n = i if i < 60 else 0
        assert got[i].text == f"Title {n}\ntext {n} of the page\nshared line", got[i].text  # 'The end.' stands on every page
        assert got[i].n_template >= 2
    assert got[100].text.startswith("box of c.org\none\ntwo\nTitle 100") and got[100].n_template == 0


def test_article_text_survives_recurrence(spark):
    """Copied articles under different furniture keep their text; recurring boxes inside an article go."""
    rows = [(i, f"http://a.org/{i}", f"<div>nav {i}</div><article><div><h2>Same</h2><p>copied {'long ' * 20}text</p></div>"
                                     f"<div>read more on this site</div><p>OK.</p></article>") for i in range(20)]
    for r in html_extract.extract_pages(spark.createDataFrame(rows, PAGE)).collect():
        assert r.text == f"Same\ncopied {'long ' * 20}text\nOK." and r.n_template == 1


@pytest.mark.parametrize("source, want", [
    ("", ""), (None, ""), ("plain &amp; simple\n text", "plain & simple text"),
    ("<p>one<p>two<b>bold<br>line</p><p>three", "one\ntwobold line\nthree"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<script>var a='</p><p>no'</script><p>yes<style>p{}</style><!-- <p>no --><![CDATA[no]]></p>", "yes"),
    ("<nav>n</nav><header>h</header><main><header><h1>T</h1></header><p>x</p><aside>a</aside></main><footer>f</footer>", "T\nx"),
    ("<article>a &lt;b&gt; &#233;&nbsp;&eacute</article><article class='comment'>no</article>", "a <b> é é"),
    ("<div class='cookieNotice'>c</div><div id=content><p>x</p><div class=\"user-comments\"><p>c</p></div></div><p hidden>h</p>", "x"),
    ("<div role=navigation>n</div><p style='display: none'>h</p><p title='a > b'>x</p><p title=\"open>y", "x\ny"),
    ("<div class='sidebar-layout'><article><p>x</p></article><div class=ad>y</div></div>", "x"),
    ("<p>a</b></i></p></div>b<", "a\nb<"), ("<" * 3000 + "a" * 10, "<" * 2999), ("<div>" * 5000 + "deep", "deep"),
])
def test_extraction_by_kind(source, want):
    assert html_extract.extract(source or "")[0] == want


def test_odd_pages(spark):
    rows = [(None, None, None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "no scheme", "<p>b</p>"), (3, "http://h", ""), (4, "http://h/", "<p>" + "w " * 400_000 + "</p>")]
    got = sorted(((r.page_id, r.text[:3], r.n_chars) for r in html_extract.extract_pages(spark.createDataFrame(rows, PAGE)).collect()), key=repr)
    assert got == sorted([(None, "", 0), (1, "a", 1), (1, "a", 1), (2, "b", 1), (3, "", 0), (4, "w w", 799_999)], key=repr)
    assert html_extract.extract_pages(spark.createDataFrame([], PAGE)).collect() == []
